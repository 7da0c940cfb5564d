"""Flat tables: overlaps, placeholders, repeated batches, windows with late findings, rate limit by batches, sketches."""

import random
import shutil
from collections import Counter, defaultdict
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from redactlake.functions import spans
from redactlake.functions.detectors import CANDIDATE
from redactlake.operators import corpus, flat, scans
from redactlake.sources import batches, sinks
from redactlake.streaming import jobs

FIELDS = flat.CANDIDATE_FIELDS
TYPES = ["EMAIL", "IBAN", "PHONE"]


def random_candidates(draw, texts, width):
    """Spans that nest, touch, repeat and overlap; few different texts, so that placeholders are shared."""
    rows = []
    for scan_id in range(texts):
        for ordinal in range(draw.randrange(30)):
            start = draw.randrange(width)
            kind = draw.randrange(3)
            rows.append((scan_id, TYPES[kind], start, start + draw.randrange(1, 12), f"t{draw.randrange(6)}", 0.5, "r", draw.choice([kind, kind, 5]), ordinal))
    return rows


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_flat_forms_equal_those_in_the_row(spark, monkeypatch, block):
    monkeypatch.setattr(flat, "BLOCK", block)
    schema = "scan_id bigint, pii_type string, start bigint, end bigint, text string, confidence double, rule_id string, prio int, ordinal int"
    rows = spark.createDataFrame(random_candidates(random.Random(block), 60, 120), schema)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", F.struct(*FIELDS).alias("c")))), lambda s: s["c"])
    arrays = rows.groupBy("scan_id").agg(listed.cast(f"array<{CANDIDATE}>").alias("found"))
    in_row = arrays.select("scan_id", spans.assign_placeholders(spans.resolve_overlaps(F.col("found"))).alias("findings"))
    want = scans.explode_findings(in_row).select("scan_id", "start", "end", "pii_type", "text", "placeholder").collect()
    resolved = flat.resolve_flat(rows)
    got = flat.number_flat(resolved).select("scan_id", "start", "end", "pii_type", "text", "placeholder").collect()
    assert sorted(got) == sorted(want) and len(got) > 100
    assert flat.number_flat(flat.resolve_flat(rows.limit(0))).count() == 0


def test_chunks_that_overlap(spark):
    text = "vorn a@b.example.com mitte c@d.example.com hinten a@b.example.com ende"
    chunks = spark.createDataFrame([(1, begin, text[begin : begin + 45]) for begin in (0, 22)], "scan_id int, offset bigint, text string")
    found = chunks.select("scan_id", "offset", F.explode(scans.column_candidates("text")).alias("c"))
    whole = flat.from_chunks(found.select("scan_id", "offset", *[F.col("c")[f].alias(f) for f in FIELDS]), "offset")
    got = flat.number_flat(flat.resolve_flat(whole)).select("start", "end", "placeholder").collect()
    one = scans.scan_texts(spark.createDataFrame([(1, text)], "scan_id int, text string"))
    assert sorted(got) == sorted(scans.explode_findings(one).select("start", "end", "placeholder").collect()) and len(got) == 3


# --- batches that may be written again


def test_a_repeated_batch_counts_once(spark, tmp_path):
    path = str(tmp_path)
    rows = lambda *ns: spark.createDataFrame([(n, f"t{n % 2}") for n in ns], "n int, kind string")
    batches.write_batch(rows(1, 2, 3), path, "007", ("kind",))
    batches.write_batch(rows(4), path, "7", ("kind",))
    batches.write_batch(rows(1, 2, 3), path, "007", ("kind",))
    batches.write_attempt(rows(99), path, ("kind",))
    read = lambda: sorted((r.batch, r.n, r.kind) for r in batches.read_batches(spark, path).collect())
    assert read() == [("007", 1, "t1"), ("007", 2, "t0"), ("007", 3, "t1"), ("7", 4, "t0")]
    assert {r.batch: r.n_rows for r in batches.list_batches(spark, path).collect()} == {"007": 3, "7": 1}
    assert [r.batch for r in batches.superseded(spark, path).collect()] == ["007"]
    # a batch may shrink to nothing, and later ones may have more columns
    batches.write_batch(rows(), path, "007", ("kind",))
    batches.write_batch(rows(5).withColumn("more", F.lit(1)), path, "8", ("kind",))
    assert read() == [("7", 4, "t0"), ("8", 5, "t1")]
    assert {r.n: r.more for r in batches.read_batches(spark, path).collect()} == {4: None, 5: 1}
    with pytest.raises(ValueError):
        batches.write_batch(rows(1).withColumn("attempt", F.lit(1)), path, "9")


def test_sinks_by_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "an a@b.example.com"), (2, "nichts"), (3, None)], "scan_id int, text string")
    scanned = scans.scan_texts(docs)
    for _ in range(2):
        sinks.write_findings(scanned, f"{tmp_path}/f", batch="x")
        sinks.write_redacted(scanned, f"{tmp_path}/r", batch="x")
        sinks.write_mapping(scanned, f"{tmp_path}/m", batch="x")
    counts = [batches.read_batches(spark, f"{tmp_path}/{name}").count() for name in "frm"]
    assert counts == [1, 3, 1]


# --- streams in several batches


def fed(spark, tmp_path, waves, schema, start):
    """Run ``start`` on the stream of a folder after each wave of rows has arrived."""
    for rows in waves:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        start(jobs.read_stream(spark, f"{tmp_path}/in", "*.parquet")).awaitTermination()


def test_windows_and_late_findings(spark, tmp_path):
    at = lambda minutes: datetime(2024, 5, 1, 12, 0, 30, tzinfo=UTC) + timedelta(minutes=minutes)
    mail = "an a@b.example.com"
    waves = [
        [(at(0), mail), (at(20), mail), (None, mail)],
        [(at(1), mail), (at(9), mail), (at(15), mail), (at(0), "nichts")],  # the watermark is 10:30 after the start
        [(at(5), "nichts")],
        [(at(20), mail), (at(40), mail), (at(9), mail), (at(10), mail)],
    ]
    start = lambda texts: jobs.write_counts(texts, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    fed(spark, tmp_path, waves, "ts timestamp, text string", start)
    rows = jobs.read_windows(spark, f"{tmp_path}/out").where("minute is not null")
    base = int(datetime(2024, 5, 1, 12, tzinfo=UTC).timestamp())
    got = {(r.m - base) // 60: (r.n, r.late, r.closed) for r in rows.select(F.unix_seconds("minute").alias("m"), "n", "late", "closed").collect()}
    assert got == {0: (1, 0, True), 1: (0, 1, True), 9: (0, 2, True), 10: (1, 0, True), 15: (1, 0, True), 20: (2, 0, True), 40: (1, 0, False)}
    wide = jobs.read_windows(spark, f"{tmp_path}/out", lateness="1 hour")
    assert wide.agg(F.sum("late")).first()[0] == 0 and wide.where("closed").count() == 0
    total = jobs.read_counts(spark, f"{tmp_path}/out").agg(F.sum("n")).first()[0]
    assert total == wide.agg(F.sum("n")).first()[0] == 10
    texts = spark.read.parquet(f"{tmp_path}/out/_seen").orderBy("batch").select("texts").collect()
    assert [r.texts for r in texts] == [3, 4, 1, 4]


def brute_force(waves, limit):
    used, verdicts = Counter(), {}
    for rows in waves:
        for key, ts, seq in sorted(rows, key=lambda r: (r[1] or datetime.min.replace(tzinfo=UTC), r[2])):
            if key is None or ts is None:
                verdicts[seq] = True
                continue
            group = (key, int(ts.timestamp()) // 60)
            verdicts[seq] = used[group] < limit
            used[group] += 1
    return verdicts


def test_rate_limit_over_batches(spark, tmp_path):
    draw, base = random.Random(5), datetime(2024, 5, 1, 12, tzinfo=UTC)
    waves, seq = defaultdict(list), 0
    for wave in range(3):
        for _ in range(150):
            key = draw.choice(["busy"] * 6 + ["a", "b", None])
            waves[wave].append((key, base + timedelta(seconds=draw.randrange(240)), seq))
            seq += 1
    waves[1].append(("a", None, seq))
    start = lambda calls: jobs.write_admitted(calls, f"{tmp_path}/out", f"{tmp_path}/checkpoint", limit=20)
    fed(spark, tmp_path, waves.values(), "rate_key string, ts timestamp, seq bigint", start)
    got = spark.read.parquet(f"{tmp_path}/out/verdicts").collect()
    assert {r.seq: r.admitted for r in got} == brute_force(list(waves.values()), 20) and len(got) == seq + 1
    # a batch whose end was not recorded is repeated
    unrecorded = lambda folder, names: [n for n in names if folder.endswith("commits") and n.strip(".").split(".")[0] == "2"]
    shutil.copytree(tmp_path / "checkpoint", tmp_path / "before", ignore=unrecorded)
    jobs.write_admitted(
        jobs.read_stream(spark, f"{tmp_path}/in", "*.parquet"), f"{tmp_path}/out", f"{tmp_path}/before", limit=20
    ).awaitTermination()
    assert (tmp_path / "before" / "commits" / "2").exists()
    again = spark.read.parquet(f"{tmp_path}/out/verdicts").collect()
    assert sorted((r.seq, r.admitted) for r in again) == sorted((r.seq, r.admitted) for r in got)


# --- sketches


def test_sketches_of_several_days(spark):
    """Small counts are exact; a large one is within four standard errors, with documents that come on several days counted once."""
    many = spark.range(60_000).selectExpr("id as scan_id", "'EMAIL' as pii_type", "'viel' as text", "id % 3 as day")
    again = many.where("scan_id % 2 = 0").withColumn("day", F.lit(9))
    few = spark.createDataFrame([(n, "IBAN", f"w{n % 7}", n % 4) for n in range(300)] + [(1, "PHONE", "eins", 0), (1, "PHONE", "eins", 1)], "scan_id bigint, pii_type string, text string, day bigint")
    sketches = corpus.value_sketches(many.unionByName(again.selectExpr("scan_id", "pii_type", "text", "cast(day as bigint) as day")).unionByName(few))
    got = {(r.pii_type, r.text): r.docs for r in corpus.shared_by_sketches(sketches).collect()}
    exact = Counter(f"w{n % 7}" for n in range(300))
    assert {text: got["IBAN", text] for text in exact} == exact and ("PHONE", "eins") not in got
    error = 1.04 / (1 << corpus.SKETCH_BITS) ** 0.5
    assert abs(got["EMAIL", "viel"] - 60_000) < 4 * error * 60_000
    one_day = corpus.shared_by_sketches(sketches.where("day = 0"))
    assert abs({r.text: r.docs for r in one_day.collect()}["viel"] - 20_000) < 4 * error * 20_000
