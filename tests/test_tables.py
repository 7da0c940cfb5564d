"""White lists as tables, policies as of a time, pseudonyms of a corpus, spreading of small inputs."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from redactlake.functions.scan import ScanOptions, column_candidates
from redactlake.operators import corpus, scans
from redactlake.operators.policies import apply_policies_as_of, with_policy_as_of
from redactlake.operators.whitelists import containing, scan_with_tokens, token_index
from redactlake.plans import planted


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- white lists as tables


def test_texts_that_contain_a_token(spark):
    draw = random.Random(3)
    word = lambda most: "".join(draw.choices("abcü漢. ", k=draw.randrange(most)))
    texts = {word(14).lower() for _ in range(400)} | {"", "ab", "x" * 5000 + "nadel"}
    tokens = [word(7) for _ in range(60)] + [None, "", "  ", " \tNADEL ", "AB", "ü", "abcabcabcabcabc"]
    got = containing(spark.createDataFrame([(t,) for t in texts], "low string"), spark.createDataFrame([(t,) for t in tokens], "token string"))
    clean = {t.strip().lower() for t in tokens if t and t.strip()}
    assert sorted(r.low for r in got.collect()) == sorted(t for t in texts if any(c in t for c in clean))
    none = spark.createDataFrame([], "token string")
    assert containing(spark.createDataFrame([("a",)], "low string"), none).count() == 0


def test_tokens_are_filed_once_under_a_rare_piece(spark):
    tokens = spark.createDataFrame([(f"gleich{n}",) for n in range(50)] + [("gleich7",), (" GLEICH7 ",), ("ab",)], "token string")
    rows = {r.token: r.piece for r in token_index(tokens).collect()}
    assert len(rows) == 51 and rows["ab"] == "ab" and all(r.piece in r.token for r in token_index(tokens).collect())
    assert rows["gleich7"] == "ich7"


def test_scan_with_a_long_table(spark):
    """100,000 tokens; the same result as with the few that matter in the row, and no nested loop."""
    docs = spark.createDataFrame(
        [(n, f"an kunde{n}@stelle.example, Tel +49 30 {1000000 + n} und IBAN DE89 3704 0044 0532 0130 00") for n in range(200)] + [(900, "nichts"), (901, None)],
        "scan_id int, text string",
    )
    found = docs.withColumn("candidates", column_candidates("text")).persist()
    used = ["KUNDE17@", "stelle.example, ", "30 10000", "kunde5", "0532"]
    many = spark.range(100_000).select(F.concat(F.lit("fehlt-"), F.col("id").cast("string")).alias("token"))
    scanned = scan_with_tokens(found, many.union(spark.createDataFrame([(t,) for t in used], "token string")))
    assert "NestedLoop" not in plan(scanned) and "Cartesian" not in plan(scanned)
    want = scans.scan_texts(docs, options=ScanOptions(whitelist=used))
    columns = ["scan_id", "anonymised_text", "findings"]
    key = lambda r: r.scan_id
    assert sorted(scanned.select(columns).collect(), key=key) == sorted(want.select(columns).collect(), key=key)


# --- policies as of a time

START = datetime(2024, 5, 1, tzinfo=UTC)


def at(minutes):
    return None if minutes is None else (START + timedelta(minutes=minutes)).replace(tzinfo=None)


VERSIONS = "port int, valid_from timestamp, version int, detectors array<string>, whitelist array<string>, dry_run boolean"


@pytest.mark.parametrize("slice_seconds", [60, 3600, 10**8])
def test_policy_of_the_time(spark, slice_seconds):
    draw = random.Random(slice_seconds)
    versions = [(draw.randrange(4), draw.choice([0, 60, 120, draw.randrange(600)]), n, ["EMAIL"], [], False) for n in range(30)]
    versions += [(2, 300, 40, None, None, None), (None, 5, 41, [], [], True), (1, None, 42, [], [], True), (1, 200, 43, ["A"], [], False), (1, 200, 44, ["B"], [], True)]
    requests = [(n, draw.choice([1, 1, 1, 0, 2, 3, 9, None]), draw.choice([0, 60, 200, 300, None, draw.randrange(-50, 700)])) for n in range(400)]
    got = with_policy_as_of(
        spark.createDataFrame([(n, p, at(t)) for n, p, t in requests], "id int, port int, ts timestamp"),
        spark.createDataFrame([(p, at(t), *rest) for p, t, *rest in versions], VERSIONS),
        slice_seconds=slice_seconds,
    )
    want = {}
    for n, port, moment in requests:
        known = [v for v in versions if v[0] == port and port is not None and v[1] is not None and moment is not None and v[1] <= moment]
        last = max(known, key=lambda v: (v[1], v[2]), default=None)
        want[n] = (last[2], last[3], last[5]) if last else (None, None, None)
    rows = got.collect()
    assert len(rows) == len(requests) and {r.id: (r.version, r.detectors, r.dry_run) for r in rows} == want
    assert got.columns == ["id", "port", "ts", "version", "detectors", "whitelist", "dry_run"]


def test_masking_by_the_policy_of_the_time(spark):
    versions = [(1, at(0), 1, ["EMAIL"], [], False), (1, at(10), 2, ["PHONE"], [], False), (1, at(20), 3, ["EMAIL"], [], True), (1, at(30), 4, None, None, None)]
    body = "mail@stelle.example oder +49 30 1234567"
    requests = spark.createDataFrame([(n, 1, at(m), body) for n, m in enumerate((-1, 0, 10, 25, 30))], "id int, port int, ts timestamp, body string")
    masked = apply_policies_as_of(requests, spark.createDataFrame(versions, VERSIONS))
    got = {r.id: (r.version, r.kind, sorted(f.pii_type for f in r.scans[0].findings)) for r in masked.collect()}
    both = ["EMAIL", "PHONE"]
    assert got == {0: (None, "text", both), 1: (1, "text", ["EMAIL"]), 2: (2, "text", ["PHONE"]), 3: (3, "dry_run", ["EMAIL"]), 4: (4, "text", both)}


def test_no_window_sees_the_requests(spark):
    requests = spark.range(10).selectExpr("id", "1 as port", "timestamp_seconds(id) as ts", "'x' as body")
    text = plan(with_policy_as_of(requests, spark.createDataFrame([(1, at(0), 1, ["A"], [], False)], VERSIONS)))
    assert text.count("Window ") == 2 and "NestedLoop" not in text


# --- pseudonyms


@pytest.fixture(scope="module")
def documents(spark):
    """One address in half of all documents, others in one or two."""
    text = lambda n: " ".join(
        (["überall@stelle.example"] if n % 2 else []) + [f"Mail ü{n}@stelle.example"] * (n % 3) + [f"und k{n // 2}@stelle.example, +49 30 {1000000 + n}"] * (n % 5 > 0)
    )
    docs = spark.createDataFrame([(n, text(n)) for n in range(300)], "scan_id int, text string")
    return scans.scan_texts(docs).persist()


def test_numbers_follow_the_first_place(spark, documents, tmp_path):
    found = scans.explode_findings(documents).select("scan_id", "pii_type", "start", "text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        corpus.first_places(found).write.parquet(f"{tmp_path}/places")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    places = spark.read.parquet(f"{tmp_path}/places")
    assert places.select("part").distinct().count() > 2
    got = {(r.pii_type, r.text): (r.pseudonym, r.docs) for r in corpus.numbered_pseudonyms(places).collect()}
    want, numbers, docs = {}, {}, {}
    for r in sorted(found.collect(), key=lambda r: (r.scan_id, r.start)):
        docs.setdefault((r.pii_type, r.text), set()).add(r.scan_id)
        if (r.pii_type, r.text) not in want:
            numbers[r.pii_type] = numbers.get(r.pii_type, 0) + 1
            want[r.pii_type, r.text] = f"[{r.pii_type}_{numbers[r.pii_type]}]"
    assert got == {k: (v, len(docs[k])) for k, v in want.items()}


@pytest.mark.parametrize("common", [1000, 3, 1])
def test_masking_by_pseudonyms(monkeypatch, documents, common):
    monkeypatch.setattr(corpus, "COMMON", common)
    names = corpus.pseudonyms(scans.explode_findings(documents))
    known = {(r.pii_type, r.text): r.pseudonym for r in names.collect()}
    rows = corpus.mask_by_pseudonyms(documents, names).collect()
    assert len(rows) == documents.count()
    for row in rows:
        raw = row.text.encode()
        for f in reversed(row.findings):
            raw = raw[: f.start] + known[f.pii_type, f.text].encode() + raw[f.end :]
        assert row.masked_text == raw.decode()


def test_values_without_pseudonym_keep_their_placeholder(documents):
    names = corpus.pseudonyms(scans.explode_findings(documents)).where("pii_type <> 'EMAIL'")
    rows = corpus.mask_by_pseudonyms(documents, names).where("scan_id = 1").collect()
    assert rows[0].masked_text.startswith("ü[EMAIL_1] Mail ü[EMAIL_2] und [EMAIL_3], [PHONE_c")


# --- spreading


def test_small_inputs_are_spread_and_large_ones_are_not(spark, monkeypatch):
    docs = planted.corpus(spark, "/root/testdata/sf0.01")
    per_task = docs.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) == spark.sparkContext.defaultParallelism and min(r["count"] for r in per_task) > 100
    monkeypatch.setattr(scans, "SMALL_BYTES", 1)
    assert "Exchange" not in plan(scans.spread(planted.read(spark, "/root/testdata/sf0.01", "documents")))


def test_long_white_lists_have_longer_pieces(spark):
    """4,096 tokens that share 16 pieces of four characters."""
    tokens = spark.range(4096).selectExpr("lpad(bin(id), 12, '0') as token").union(spark.createDataFrame([("1x",), ("01x01",)], "token string"))
    filed = [r.n for r in token_index(tokens).groupBy("piece").agg(F.count("*").alias("n")).collect()]
    assert sum(filed) == 4098 and max(filed) <= 16
    texts = ["a" + format(77, "012b") + "b", "0101", "11111111111", "z1x", "1 x", "001x010", "0" * 40]
    got = containing(spark.createDataFrame([(t,) for t in texts], "low string"), tokens)
    assert sorted(r.low for r in got.collect()) == sorted([texts[0], texts[3], texts[5], texts[6]])
