"""Logs, rate limit, key check, streams."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from redactlake.operators import logs, traffic
from redactlake.plans import planted
from redactlake.plans.queries import queries
from redactlake.sources import access_log, sinks
from redactlake.streaming import jobs


def test_log_round_trip(spark, tmp_path):
    entries = spark.createDataFrame(
        [
            ("2026-03-14 14:51:21", "POST", "/v1/messages", 200, 299, 0, []),
            ("2026-03-14 14:51:22", "GET", "/a b 200", 502, 0, 2, ["EMAIL", "IBAN"]),
            ("2026-03-14 14:51:23", "DELETE", "/" + "x" * 40, 404, 1234567, 1, ["EMAIL"]),
        ],
        "ts string, method string, path string, status int, resp_bytes bigint, pii_count int, pii_types array<string>",
    ).withColumn("ts", F.to_timestamp("ts"))
    lines = [r["value"] for r in access_log.format_log(entries).collect()]
    assert lines[0] == "2026-03-14 14:51:21  POST   /v1/messages                    200    299 B  pii=0"
    access_log.write_log(entries, str(tmp_path / "log"))
    back = access_log.read_log(spark, str(tmp_path / "log")).drop("line", "source")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, entries.collect()))
    broken = spark.createDataFrame([("no log line",)], "line string")
    assert access_log.parse_log(broken).first()["status"] is None


def test_line_classes(spark):
    lines = {
        "2026-03-14 14:51:21  POST   /v1/messages   200    299 B  pii=0": ("success", False),
        "2026-03-14 14:51:21  POST   /v1/messages   301    502 B  pii=2 [EMAIL]": ("success", True),
        "2026-03-14 14:51:21  POST   /v1/messages   404    299 B  pii=0": ("warning", False),
        "2026-03-14 14:51:21  POST   /v1/messages   502    0 B  pii=10": ("danger", True),
        "200 300 x": ("neutral", False),
        "a b 700 +250 pii=": ("success", False),
        "": ("neutral", False),
    }
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    rows = df.select("line", logs.status_class(F.col("line")), logs.pii_flag(F.col("line"))).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == lines


def test_tail_keeps_few_rows_before_the_shuffle(spark):
    df = spark.range(5000).selectExpr("if(id < 4000, 'busy', 'calm') as source", "id as seq")
    tail = logs.tail(df, "source", ["seq"], 3)
    assert "WindowGroupLimit" in tail._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["seq"] for r in tail.collect()) == [3997, 3998, 3999, 4997, 4998, 4999]


def test_rate_key(spark):
    rows = [
        ("secret", "Bearer other", "1.2.3.4:5", "k:" + hashlib.sha256(b"secret").hexdigest()),
        ("", "Bearer tok", "1.2.3.4:5", "k:" + hashlib.sha256(b"tok").hexdigest()),
        (None, "Bearer ", "1.2.3.4:5", "ip:1.2.3.4"),
        (None, "basic x", "[::1]:80", "ip:::1"),
        (None, None, "::1", "ip:::1"),
        (None, None, "host", "ip:host"),
        (None, None, "[::1]x:80", "ip:[::1]x:80"),
        (None, None, ":80", "ip:"),
    ]
    df = spark.createDataFrame(rows, "k string, a string, addr string, want string")
    for r in df.select(traffic.rate_key(F.col("k"), F.col("a"), F.col("addr")).alias("key"), "want").collect():
        assert r["key"] == r["want"]


def sequential_admission(calls, limit):
    used, out = defaultdict(int), {}
    for seq, ts, key in sorted(calls, key=lambda c: (c[1], c[0])):
        slot = (key, ts // 60)
        used[slot] += 1
        out[seq] = used[slot] <= limit
    return out


def test_rate_limit_with_a_busy_key(spark):
    calls = [(i, 1_700_000_000 + (i * 7919) % 400, "busy" if i % 3 else f"k{i % 5}") for i in range(3000)]
    df = spark.createDataFrame(calls, "seq bigint, sec bigint, rate_key string").withColumn("ts", F.timestamp_seconds("sec"))
    admitted = traffic.admit(df)
    assert "WindowGroupLimit" in admitted._jdf.queryExecution().executedPlan().toString()
    assert {r["seq"]: r["admitted"] for r in admitted.collect()} == sequential_admission(calls, 120)


def test_key_check(spark):
    calls = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "seq int, key string")
    keys = spark.createDataFrame([(hashlib.sha256(b"a").hexdigest(),), ("",)], "hash string")
    assert {r["seq"]: r["admitted"] for r in traffic.admit_keys(calls, keys).collect()} == {1: True, 2: False, 3: False}
    blank = keys.where("hash = ''")
    assert all(r["admitted"] for r in traffic.admit_keys(calls, blank).collect())


def test_admission_over_several_batches(spark, tmp_path):
    calls = [(i, 1_700_000_040 + i // 40, "busy" if i % 4 else "calm") for i in range(2400)]
    schema = "seq bigint, sec bigint, rate_key string"
    source = str(tmp_path / "in")
    for part in range(3):
        rows = calls[part * 800 : (part + 1) * 800]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = jobs.admit_stream(stream.withColumn("ts", F.timestamp_seconds("sec")))
    jobs.write_stream(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 2400
    per_slot = defaultdict(int)
    for r in rows:
        per_slot[(r["rate_key"], r["ts"].minute)] += r["admitted"]
    wanted = defaultdict(int)
    for seq, ok in sequential_admission(calls, 120).items():
        _, sec, key = calls[seq]
        wanted[(key, (sec // 60) % 60)] += ok
    assert per_slot == wanted


def test_streams_equal_batch(spark, sf_dir):
    registered = queries()
    batch = sorted(map(tuple, registered["sink_redacted"](spark, sf_dir).collect()))
    assert sorted(map(tuple, registered["stream_scan"](spark, sf_dir).collect())) == batch
    sinks_read = registered["stream_sink"](spark, sf_dir).select("scan_id", "anonymised_text", "pii_found")
    assert sorted(map(tuple, sinks_read.collect())) == batch


def test_shared_folder_is_taken_from_the_session(spark):
    assert sinks.shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_scan_of_texts_needs_no_shuffle(spark, sf_dir):
    from redactlake.operators.scans import explode_findings, scan_texts

    documents = planted.read(spark, sf_dir, "documents").selectExpr("doc_id as scan_id", "text")
    plan = explode_findings(scan_texts(documents))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_long_log_lines_are_walked_once(spark):
    import time

    from redactlake.sources.access_log import parse_log

    line = "2024-01-02 03:04:05  GET    /a" + " " * 16_000 + "b 200  5 B  pii=1 [EMAIL]  404     12 B  pii=2 [EMAIL,IBAN]"
    df = spark.createDataFrame([(line,), ("2024-01-02 03:04:05  GET   200  5 B  pii=0",), ("x" * 50_000,)], "line string")
    parse_log(df.limit(1)).collect()
    begun = time.perf_counter()
    first, second, third = parse_log(df).collect()
    assert time.perf_counter() - begun < 5
    assert first["path"].startswith("/a  ") and first["status"] == 404 and first["pii_types"] == ["EMAIL", "IBAN"]
    assert second["path"] == "" and second["status"] == 200 and third["ts"] is None


def test_stream_rate_outside_utc_and_late_calls(spark, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        source, base = tmp_path / "in", 1_700_000_040
        # the same minute in several batches, with another one between, and a call that comes days late
        for n, seconds in enumerate([[0] * 100, [500], [-500_000], [1] * 100]):
            rows = [("k:busy", base + s, 1000 * n + i) for i, s in enumerate(seconds)]
            spark.createDataFrame(rows, "rate_key string, sec bigint, seq bigint").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("rate_key string, sec bigint, seq bigint").option("maxFilesPerTrigger", 1).parquet(str(source))
        calls = stream.withColumn("ts", F.timestamp_seconds("sec"))
        jobs.write_stream(jobs.admit_stream(calls), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        out = spark.read.parquet(str(tmp_path / "out"))
        assert out.count() == 202 and out.where("admitted").count() == 122
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_streams_read_tables_in_several_parts(spark, sf_dir, tmp_path):
    """A table may be a folder of files, beside other tables."""
    parts = str(tmp_path / "tables")
    for table in ("documents", "pages"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(3).write.parquet(f"{parts}/{table}.parquet")
    for name in ("stream_scan", "stream_sink"):
        whole = sorted(map(str, queries()[name](spark, sf_dir).collect()))
        assert sorted(map(str, queries()[name](spark, parts).collect())) == whole
