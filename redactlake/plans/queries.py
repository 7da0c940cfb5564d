"""Registered queries: each runs one operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake import fixed_values as fv
from redactlake.functions import spans
from redactlake.functions.scan import ScanOptions, column_candidates
from redactlake.operators import corpus, flat, logs, metrics, requests, scans, traffic, whitelists
from redactlake.operators.policies import apply_policies, apply_policies_as_of
from redactlake.operators.restore import restore as restore_texts
from redactlake.operators.restore import restore_bodies as restore_whole_bodies
from redactlake.plans import planted
from redactlake.sources import access_log, batches, sinks, tables
from redactlake.sources import policies as policy_source
from redactlake.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

FLAT = ["scan_id", "pii_type", "start", "end", "text", "confidence", "rule_id"]
WHITELIST = ["FIRMA3", " b.example.com ", "", "zürich", "123"]


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _scanned(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return scans.scan_texts(planted.corpus(spark, sf_dir), options=ScanOptions(**options))


# --- sources ---------------------------------------------------------------------------------------------------


@query
def src_corpus(spark, sf_dir):
    corpora = [
        tables.read_corpus(spark, f"{sf_dir}/documents.parquet", "doc_id", "text"),
        tables.read_corpus(spark, f"{sf_dir}/pages.parquet", "page_id", "html"),
        tables.read_corpus(spark, f"{sf_dir}/benchmark.parquet", "item_id", "text"),
        tables.read_corpus(spark, f"{sf_dir}/conversations.parquet", "conv_id", "text", role="role", part="turn"),
    ]
    out = corpora[0]
    for other in corpora[1:]:
        out = out.unionByName(other)
    return out.select("scan_id", "seg_id", "role", "path", "text")


@query
def src_requests(spark, sf_dir):
    """Bodies as bytes, every seventh one no UTF-8, written as a table and read again."""
    path = sinks.shared_dir(spark, "requests")
    _raw_bodies(spark, sf_dir).select(F.col("request_id").alias("id"), F.col("body").alias("payload")).write.parquet(path)
    triaged = requests.triage(requests.quarantine(tables.read_requests(spark, path, "id", "payload")))
    n_bytes = F.octet_length(F.coalesce("raw", F.encode("body", "utf-8"))).cast("bigint")
    return triaged.select("request_id", "kind", "quarantined", n_bytes.alias("n_bytes"))


@query
def src_access_log(spark, sf_dir):
    return access_log.parse_log(_log_lines(spark, sf_dir)).select(
        "seq",
        "ts",
        "method",
        "path",
        "status",
        "resp_bytes",
        "pii_count",
        F.array_join("pii_types", ",").alias("pii_types"),
    )


@query
def src_policies(spark, sf_dir):
    documents = planted.read(spark, sf_dir, "customer").selectExpr("c_custkey as doc_no", f"{POLICY_JSON} as json")
    parsed = policy_source.parse_policies(documents)
    lists = ["default_detectors", "default_whitelist", "detectors", "whitelist"]
    return parsed.select(
        "doc_no",
        "valid",
        "policy_no",
        "api_port",
        "policy_type",
        "port",
        "upstream",
        "dry_run",
        *[F.array_join(c, ",").alias(c) for c in lists],
    )


POLICY_JSON = """case cast(c_custkey % 9 as int)
 when 0 then concat('{"api_port": ', 9000 + c_custkey % 50, ', "default_detectors": ["EMAIL"], "proxies": [{"type": "chat", "port": ',
   9800 + c_custkey % 90, ', "upstream": "https://up.example.com", "guard": {"url": "", "detectors": ["EMAIL", "PHONE"], "whitelist": ["w',
   c_custkey, '"], "dry_run": true}}, {"type": "mail", "port": 9700, "upstream": "", "guard": {"detectors": [], "whitelist": []}}]}')
 when 1 then concat('{"api_port": ', 9000 + c_custkey % 50, ', "proxies": [], "default_whitelist": ["a", "b', c_custkey, '"]}')
 when 2 then concat('[{"type": "old", "port": ', 9600 + c_custkey % 70, ', "upstream": "u", "guard": {"detectors": ["IBAN"], "whitelist": []}}]')
 when 3 then '{not valid json'
 when 4 then concat('{"api_port": 1} {', c_custkey, '}')
 when 5 then concat('{"proxies": [{"type": "decoy", "a_meta": {"x": 1}, "port": ', 9500 + c_custkey % 40,
   ', "guard": {"detectors": ["PHONE"], "whitelist": ["v", "w"], "dry_run": true}}]}')
 when 6 then concat('{"api_port": "x", "proxies": [{"type": "chat", "port": ', c_custkey, '}]}')
 when 7 then 'null'
 end"""

# --- detectors -------------------------------------------------------------------------------------------------


def _detector_query(pii_type: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = scans.candidates(planted.corpus(spark, sf_dir), detectors=[pii_type])
        return found.select(*FLAT)

    return run


for _type in fv.PII_TYPES:
    REGISTRY[f"det_{_type.lower()}"] = _detector_query(_type)

# --- spans -----------------------------------------------------------------------------------------------------


@query
def select_detectors(spark, sf_dir):
    chosen = planted.corpus(spark, sf_dir).withColumn("detectors", F.expr(DETECTOR_CHOICE))
    scanned = scans.scan_texts(chosen, options=ScanOptions(detectors="detectors"))
    return scans.explode_findings(scanned).select(*FLAT, "placeholder")


# per row: all, two, a padded name that matches nothing, an unknown one
DETECTOR_CHOICE = """case cast(scan_id % 4 as int) when 0 then cast(array() as array<string>)
 when 1 then array('iban', 'Phone') when 2 then array(' EMAIL', 'ADDRESS') else array('NAME') end"""


@query
def candidates_all(spark, sf_dir):
    return scans.candidates(planted.corpus(spark, sf_dir)).select(*FLAT, "prio", "ordinal")


@query
def whitelist_filter(spark, sf_dir):
    scanned = _scanned(spark, sf_dir, whitelist=WHITELIST)
    return scans.explode_findings(scanned).select(*FLAT, "placeholder")


# tokens from orders: parts of addresses and numbers of which some occur, and many that don't
TOKENS = """select case cast(o_orderkey % 5 as int) when 0 then concat('Kontakt.', o_orderkey % 3000, '@') when 1 then concat(' X', o_orderkey, ' ')
 when 2 then concat('44', o_orderkey % 100000) when 3 then case when o_orderkey % 2 = 0 then '' else concat('ÖHR-', chr(cast(65 + o_orderkey % 26 as int))) end
 else concat(o_orderkey, '.', o_orderstatus, '.example') end as token from {orders} where o_orderkey is not null
 union all select '777' union all select '9!'"""


@query
def whitelist_table(spark, sf_dir):
    """A white list as long as the table orders."""
    path = sinks.shared_dir(spark, "candidates")
    planted.corpus(spark, sf_dir).withColumn("candidates", column_candidates("text")).write.parquet(f"{path}/found")
    found = spark.read.parquet(f"{path}/found")
    tokens = spark.sql(TOKENS, orders=planted.read(spark, sf_dir, "orders"))
    whitelists.scan_with_tokens(found, tokens).select("scan_id", "anonymised_text", "findings").write.parquet(f"{path}/scan")
    sinks.remove(spark, f"{path}/found")
    return spark.read.parquet(f"{path}/scan").select(
        "scan_id", "anonymised_text", F.size("findings").cast("bigint").alias("n_findings")
    )


@query
def merge_whitelists(spark, sf_dir):
    lists = planted.read(spark, sf_dir, "customer").selectExpr(
        "c_custkey as row_no",
        "array(' Alpha ', '', concat('K', c_custkey % 4), 'beta') as base",
        "array(lower(c_mktsegment), concat('k', c_custkey % 5), 'ALPHA', chr(9), 'Gamma', 'gamma') as requested",
    )
    merged = spans.merge_whitelists(F.col("base"), F.col("requested"))
    return lists.select("row_no", F.array_join(merged, "|").alias("tokens"), F.size(merged).alias("n_tokens"))


@query
def resolve_overlaps(spark, sf_dir):
    return scans.explode_findings(_scanned(spark, sf_dir)).select(*FLAT)


@query
def assign_placeholders(spark, sf_dir):
    return scans.explode_findings(_scanned(spark, sf_dir)).select("scan_id", "start", "text", "placeholder")


@query
def findings_flat(spark, sf_dir):
    """Candidates of two engines as one table, resolved and numbered without going back to the texts."""
    texts = planted.corpus(spark, sf_dir)
    halves = [fv.PII_TYPES[::2], fv.PII_TYPES[1::2]]
    found = [scans.candidates(texts, detectors=half) for half in halves]
    path = sinks.shared_dir(spark, "candidates")
    found[0].unionByName(found[1]).write.parquet(f"{path}/found")
    flat.resolve_flat(spark.read.parquet(f"{path}/found")).write.parquet(f"{path}/resolved")
    sinks.remove(spark, f"{path}/found")
    return flat.number_flat(spark.read.parquet(f"{path}/resolved")).select(*FLAT, "placeholder")


@query
def redact(spark, sf_dir):
    return _scanned(spark, sf_dir).select("scan_id", "anonymised_text")


@query
def scan_full(spark, sf_dir):
    found = F.transform(
        "findings",
        lambda f: F.concat_ws(
            ":", f["pii_type"], f["start"].cast("string"), f["end"].cast("string"), f["placeholder"]
        ),
    )
    return _scanned(spark, sf_dir).select(
        "scan_id",
        "anonymised_text",
        F.size("findings").cast("bigint").alias("n_findings"),
        F.array_join(found, " ").alias("findings"),
    )


@query
def anonymize(spark, sf_dir):
    return scans.anonymize(planted.corpus(spark, sf_dir))


@query
def placeholder_map(spark, sf_dir):
    return scans.placeholder_map(_scanned(spark, sf_dir)).select("scan_id", "placeholder", "text")


@query
def restore(spark, sf_dir):
    """Every fifth document's vault lacks the entries with number 2."""
    # one scan, written once; masked texts and vault are read from it, and the texts in clear are removed again
    path = sinks.shared_dir(spark, "restore")
    _scanned(spark, sf_dir).select("scan_id", "anonymised_text", "findings").write.parquet(f"{path}/scan")
    scanned = spark.read.parquet(f"{path}/scan")
    vault = scans.placeholder_map(scanned).where("scan_id % 5 <> 0 or placeholder not like '%|_2]' escape '|'")
    restore_texts(scanned.select("scan_id", "anonymised_text"), vault).write.parquet(f"{path}/restored")
    sinks.remove(spark, f"{path}/scan")
    return spark.read.parquet(f"{path}/restored")


@query
def findings_report(spark, sf_dir):
    texts = planted.corpus(spark, sf_dir).where(spans.trimmed(F.col("text")) != "")
    scanned = scans.scan_texts(texts)
    return scanned.select("scan_id", F.posexplode_outer("findings").alias("pos", "f")).where("f is not null").select(
        "scan_id",
        (F.col("pos") + 1).alias("row_no"),
        F.col("f.pii_type").alias("pii_type"),
        F.col("f.text").alias("text"),
        F.col("f.placeholder").alias("placeholder"),
        F.format_string("%.0f%%", F.col("f.confidence") * 100).alias("confidence"),
    )


# --- requests --------------------------------------------------------------------------------------------------


@query
def body_triage(spark, sf_dir):
    return requests.triage(planted.bodies(spark, sf_dir)).select("request_id", "kind")


def _raw_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted.bodies(spark, sf_dir).select(
        "request_id",
        F.when(F.col("request_id") % 7 == 0, F.concat(F.encode("body", "utf-8"), F.unhex(F.lit("C328"))))
        .otherwise(F.encode("body", "utf-8"))
        .alias("body"),
    )


@query
def quarantine_invalid_utf8(spark, sf_dir):
    split = requests.quarantine(_raw_bodies(spark, sf_dir))
    return split.select("request_id", "quarantined", "body", F.hex("raw").alias("raw_hex"))


@query
def mask_user_messages(spark, sf_dir):
    masked = requests.mask_user_turns(planted.turns(spark, sf_dir))
    return masked.select("conv_id", "turn", "role", "anonymised_text", F.size("findings").cast("bigint").alias("n_findings"))


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.mask_bodies(planted.bodies(spark, sf_dir))


def _segments_at(path_pattern: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = requests.masked_segments(_masked(spark, sf_dir))
        return rows.where(F.col("path").rlike(path_pattern)).select(
            "request_id", "path", "anonymised_text", F.col("n_findings").cast("bigint").alias("n_findings")
        )

    return run


REGISTRY["mask_text_blocks"] = _segments_at(r"\.content\[[0-9]+\]\.text$")
REGISTRY["mask_tool_results"] = _segments_at(r"\]\.content\[[0-9]+\]\.content")
REGISTRY["mask_tool_inputs"] = _segments_at(r"\.input\.")
REGISTRY["mask_raw_body"] = _segments_at("^body$")


def _flat_summary(masked: DataFrame, *keep: str) -> DataFrame:
    return requests.summarize(masked, keep=keep).select(
        "request_id",
        *keep,
        "pii_found",
        F.array_join("pii_types", ",").alias("pii_types"),
        F.array_join("placeholders", ",").alias("placeholders"),
        "is_json",
        "masked_bytes",
    )


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.whole_masked_bodies(planted.bodies(spark, sf_dir))


@query
def masked_body(spark, sf_dir):
    """Bodies that can be sent on."""
    return _whole(spark, sf_dir).select("request_id", "kind", "masked_body")


@query
def request_findings(spark, sf_dir):
    found = requests.request_findings(_masked(spark, sf_dir))
    return found.select("request_id", "path", "pii_type", "start", "end", "text", "placeholder")


@query
def body_vault(spark, sf_dir):
    return requests.body_vault(_masked(spark, sf_dir)).select("request_id", "path", "placeholder", "text")


@query
def restore_bodies(spark, sf_dir):
    """Masked bodies and vault are written apart; every fifth request's vault lacks the entries with number 2."""
    path, vault = sinks.shared_dir(spark, "masked-bodies"), sinks.shared_dir(spark, "body-vault")
    _whole(spark, sf_dir).select("request_id", "masked_body", "scans").write.parquet(f"{path}/scan")
    masked = spark.read.parquet(f"{path}/scan")
    requests.body_vault(masked).where("request_id % 5 <> 0 or placeholder not like '%|_2]' escape '|'").write.parquet(vault)
    restored = restore_whole_bodies(masked.select("request_id", "masked_body"), spark.read.parquet(vault))
    restored.write.parquet(f"{path}/restored")
    sinks.remove(spark, f"{path}/scan")
    return spark.read.parquet(f"{path}/restored")


@query
def dry_run_report(spark, sf_dir):
    return _flat_summary(requests.dry_run(planted.bodies(spark, sf_dir)))


@query
def scan_summary(spark, sf_dir):
    return _flat_summary(_masked(spark, sf_dir)).drop("masked_bytes")


@query
def masked_bytes(spark, sf_dir):
    return requests.summarize(_masked(spark, sf_dir)).select("request_id", "masked_bytes")


POLICIES = """select 8000 + n_nationkey as port,
 case cast(n_nationkey % 5 as int) when 0 then cast(array() as array<string>) when 1 then array('EMAIL')
  when 2 then array('iban', 'SECRET') when 3 then array('PHONE', 'URL_SECRET', 'ADDRESS') else array('EMAIL', 'KVNR') end as detectors,
 case when n_nationkey % 2 = 0 then array('firma1', 'ZÜRICH') else cast(array() as array<string>) end as whitelist,
 n_nationkey % 6 = 5 as dry_run
 from {nation}"""


@query
def policy_apply(spark, sf_dir):
    policies = spark.sql(POLICIES, nation=planted.read(spark, sf_dir, "nation"))
    bodies = planted.bodies(spark, sf_dir).withColumn("port", (8000 + F.col("conv_id") % 27).cast("int"))
    return _flat_summary(apply_policies(bodies, policies.withColumn("port", F.col("port").cast("int"))))


# three versions of a port's policy, a day apart; some have a fourth at the time of the third, one port's second is withdrawn
VERSIONS = """select cast(8000 + n_nationkey as int) as port, v as version,
 timestamp_seconds(1704067200 + least(v, 2) * 86400 + n_nationkey * 3600) as valid_from,
 case when n_nationkey = 9 and v = 1 then null else case cast((n_nationkey + v) % 5 as int) when 0 then cast(array() as array<string>) when 1 then array('EMAIL')
  when 2 then array('iban', 'SECRET') when 3 then array('PHONE', 'URL_SECRET', 'ADDRESS') else array('EMAIL', 'KVNR') end end as detectors,
 case when n_nationkey = 9 and v = 1 then null when (n_nationkey + v) % 2 = 0 then array('firma1', 'ZÜRICH') else cast(array() as array<string>) end as whitelist,
 case when n_nationkey = 9 and v = 1 then null else (n_nationkey + v) % 6 = 5 end as dry_run
 from {nation} lateral view explode(sequence(0, case when n_nationkey % 4 = 0 then 3 else 2 end)) as v"""


@query
def policy_as_of(spark, sf_dir):
    """Half of all requests come through one port."""
    versions = spark.sql(VERSIONS, nation=planted.read(spark, sf_dir, "nation"))
    bodies = planted.bodies(spark, sf_dir).selectExpr(
        "request_id",
        "cast(case when conv_id % 2 = 0 then 8008 else 8000 + conv_id % 27 end as int) as port",
        "timestamp_seconds(1704067200 + request_id * 7919 % 300000) as ts",
        "body",
    )
    masked = apply_policies_as_of(bodies, versions)
    return _flat_summary(masked, "version")


@query
def default_policy_fallback(spark, sf_dir):
    rows = planted.corpus(spark, sf_dir).selectExpr(
        "scan_id",
        "text",
        "case when scan_id % 3 = 0 then array('EMAIL', 'SECRET') when scan_id % 3 = 1 then cast(array() as array<string>) end as detectors",
        "case when scan_id % 2 = 0 then array('Firma2') end as whitelist",
        "case when scan_id % 5 < 3 then array('PHONE', 'iban', 'EMAIL') else cast(array() as array<string>) end as default_detectors",
        "array('FIRMA2', 'firma4') as default_whitelist",
    )
    effective = requests.effective_lists(rows)
    options = ScanOptions("effective_detectors", "effective_whitelist")
    scanned = scans.scan_texts(effective, options=options)
    return scanned.select(
        "scan_id",
        F.array_join("effective_detectors", ",").alias("detectors"),
        F.array_join("effective_whitelist", ",").alias("whitelist"),
        F.size("findings").cast("bigint").alias("n_findings"),
        "anonymised_text",
    )


# --- metrics, logs, traffic ------------------------------------------------------------------------------------


@query
def metrics_totals(spark, sf_dir):
    return metrics.totals(requests.summarize(_masked(spark, sf_dir)))


@query
def metrics_by_type(spark, sf_dir):
    return metrics.by_type(requests.summarize(_masked(spark, sf_dir)))


ENTRIES = """select event_id as seq, cast(ts as timestamp) as ts, cast(8000 + user_id % 25 as string) as source,
 case when event_id % 3 = 0 then 'GET' else 'POST' end as method, concat('/v1/', event_type) as path,
 cast(case when event_id % 11 = 0 then 502 when event_id % 7 = 0 then 404 when event_id % 5 = 0 then 301 else 200 end as int) as status,
 cast(event_id * 37 % 100003 as bigint) as resp_bytes,
 cast(case when event_id % 4 = 0 then event_id % 13 else 0 end as int) as pii_count,
 case when event_id % 4 = 0 and event_id % 13 > 1 and event_id % 11 <> 0 then array('EMAIL', 'IBAN')
  when event_id % 4 = 0 and event_id % 13 = 1 then array('PHONE') else cast(array() as array<string>) end as pii_types
 from {events}"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ENTRIES, events=planted.read(spark, sf_dir, "events"))


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines made from events; every 97th one is damaged."""
    lines = access_log.format_log(_entries(spark, sf_dir))
    damaged = F.when(F.col("seq") % 97 == 0, F.concat(F.lit("  broken "), F.substring("value", 12, 60)))
    return lines.select("seq", "source", damaged.otherwise(F.col("value")).alias("line"))


@query
def log_status_class(spark, sf_dir):
    return _log_lines(spark, sf_dir).select("seq", logs.status_class(F.col("line")).alias("status_class"))


@query
def log_pii_flag(spark, sf_dir):
    return _log_lines(spark, sf_dir).select("seq", logs.pii_flag(F.col("line")).alias("has_pii"))


@query
def log_tail(spark, sf_dir):
    return logs.tail(_entries(spark, sf_dir), "source", ["ts", "seq"]).select("source", "seq", "from_end")


@query
def log_traffic_report(spark, sf_dir):
    return logs.traffic_report(_entries(spark, sf_dir))


CALLS = """select event_id as seq, cast(ts as timestamp) as ts,
 case when event_id % 4 = 0 then concat('key-', user_id % 20) when event_id % 4 = 1 then '' end as api_key,
 case when event_id % 8 = 1 then concat('Bearer tok', user_id) when event_id % 8 = 2 then 'Basic abc' when event_id % 8 = 3 then 'Bearer ' end as auth,
 case cast(user_id % 5 as int) when 0 then concat('10.0.0.', user_id, ':', 4000 + event_id % 100) when 1 then concat('[2001:db8::', user_id, ']:443')
  when 2 then concat('2001:db8::', user_id) when 3 then concat('host', user_id) else concat('[::1]x:', user_id) end as addr
 from {events}"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CALLS, events=planted.read(spark, sf_dir, "events"))


@query
def rate_key(spark, sf_dir):
    key = traffic.rate_key(F.col("api_key"), F.col("auth"), F.col("addr"))
    return _calls(spark, sf_dir).select("seq", key.alias("rate_key"))


# thirty days of events squeezed into about 22 minutes, every second call from one caller
BURST = """select event_id as seq, timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz '2024-01-01 00:00:00', ts) div 2000 + 1704067200000000) as ts,
 case when event_id % 2 = 0 then 'k:busy' else concat('ip:', user_id % 10) end as rate_key from {events}"""


def _burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BURST, events=planted.read(spark, sf_dir, "events"))


@query
def rate_admit(spark, sf_dir):
    return traffic.admit(_burst(spark, sf_dir)).select("seq", "rate_key", "admitted")


# one policy document per nation, with a key, an empty hash, or a key without hash
KEY_JSON = """concat('{"api_port": 9000, "proxies": [], "api_keys": [{"id": "k', n_nationkey, '", "name": "', n_name, '", "hash": "',
 case when n_nationkey % 3 = 0 then '' else sha2(concat('key-', n_nationkey), 256) end, '", "hint": "…"}, {"id": "old", "name": "none"}]}')"""


@query
def api_key_admit(spark, sf_dir):
    documents = planted.read(spark, sf_dir, "nation").selectExpr(f"{KEY_JSON} as json")
    keys = policy_source.api_keys(documents)
    calls = _calls(spark, sf_dir).withColumn("key", traffic.presented_key(F.col("api_key"), F.col("auth")))
    return traffic.admit_keys(calls, keys).select("seq", "admitted")


# --- sinks: written, read back ---------------------------------------------------------------------------------


@query
def sink_findings(spark, sf_dir):
    path = sinks.shared_dir(spark, "findings")
    sinks.write_findings(_scanned(spark, sf_dir), path)
    return spark.read.parquet(path).select("scan_id", "pii_type", "start", "end", "text", "placeholder")


@query
def sink_redacted(spark, sf_dir):
    path = sinks.shared_dir(spark, "redacted")
    sinks.write_redacted(_scanned(spark, sf_dir), path)
    return spark.read.parquet(path).select("scan_id", "anonymised_text", F.col("n_findings").cast("bigint").alias("n_findings"))


@query
def sink_mapping(spark, sf_dir):
    path = sinks.shared_dir(spark, "mapping")
    sinks.write_mapping(_scanned(spark, sf_dir), path)
    return spark.read.parquet(path).select("scan_id", "placeholder", "text")


@query
def sink_repeated(spark, sf_dir):
    """Three batches, one of them written with other rows before, another broken off once and then repeated."""
    path, scratch = sinks.shared_dir(spark, "repeated"), sinks.shared_dir(spark, "scan")
    _scanned(spark, sf_dir).select("scan_id", "anonymised_text", "findings").write.parquet(scratch)
    scanned = spark.read.parquet(scratch)
    part = lambda n: scanned.where(F.col("scan_id") % 3 == n)
    sinks.write_redacted(scanned.where("scan_id % 3 > 0"), path, batch="part-1")
    batches.write_attempt(part(2).select("scan_id", "anonymised_text", F.lit(-1).alias("n_findings")), path)
    for n in (0, 1, 2, 2):
        sinks.write_redacted(part(n), path, batch=f"part-{n}")
    sinks.remove(spark, scratch)
    rows = batches.read_batches(spark, path)
    return rows.select("batch", "scan_id", "anonymised_text", F.col("n_findings").cast("bigint").alias("n_findings"))


@query
def sink_access_log(spark, sf_dir):
    path = sinks.shared_dir(spark, "access-log")
    access_log.write_log(_entries(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query
def sink_metrics(spark, sf_dir):
    path = sinks.shared_dir(spark, "metrics")
    sinks.write_metrics(metrics.exposition(requests.summarize(_masked(spark, sf_dir))), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


# --- streams: run to the end of the tables, results read back --------------------------------------------------


def _stream_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = jobs.read_stream(spark, sf_dir, "documents.parquet")
    return documents.selectExpr("doc_id as scan_id", f"{planted.CORPUS_TEXT} as text")


@query
def stream_scan(spark, sf_dir):
    path = sinks.shared_dir(spark, "stream-scan")

    def masked(scanned: DataFrame) -> DataFrame:
        return scanned.select("scan_id", "anonymised_text", F.size("findings").cast("bigint").alias("n_findings"))

    jobs.write_scan(_stream_corpus(spark, sf_dir), f"{path}/out", f"{path}/checkpoint", masked).awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("batch")


@query
def stream_metrics(spark, sf_dir):
    events = jobs.read_stream(spark, sf_dir, "events.parquet")
    texts = events.selectExpr("cast(ts as timestamp) as ts", f"{planted.sentence('event_id')} as text")
    path = sinks.shared_dir(spark, "stream-metrics")
    jobs.write_counts(texts, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return jobs.read_counts(spark, f"{path}/out")


# events arrive in waves of about ten days; every thirteenth is a wave late
WAVE = "case when day(ts) <= 10 then 0 when day(ts) <= 20 then 1 else 2 end + case when event_id % 13 = 0 then 1 else 0 end"
WAVES = 4


@query
def stream_windows(spark, sf_dir):
    """Windows by event time of a stream that runs once per wave, with late findings counted apart."""
    path = sinks.shared_dir(spark, "stream-windows")
    events = planted.read(spark, sf_dir, "events").select("event_id", "ts", F.expr(WAVE).alias("wave"))
    for wave in range(WAVES):
        events.where(F.col("wave") == wave).write.mode("append").parquet(f"{path}/arrived")
        arrived = jobs.read_stream(spark, f"{path}/arrived", "*.parquet")
        texts = arrived.selectExpr("cast(ts as timestamp) as ts", f"{planted.sentence('event_id')} as text")
        jobs.write_counts(texts, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return jobs.read_windows(spark, f"{path}/out")


@query
def stream_rate(spark, sf_dir):
    calls = spark.sql(BURST, events=jobs.read_stream(spark, sf_dir, "events.parquet"))
    path = sinks.shared_dir(spark, "stream-rate")
    jobs.write_admitted(calls, path, f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/verdicts").select("seq", "rate_key", "admitted")


@query
def stream_sink(spark, sf_dir):
    path, vault = sinks.shared_dir(spark, "stream-sink"), sinks.shared_dir(spark, "stream-vault")
    jobs.write_all_sinks(_stream_corpus(spark, sf_dir), f"{path}/out", vault, f"{path}/checkpoint").awaitTermination()
    read = {name: spark.read.parquet(f"{path}/out/{name}").drop("batch") for name in ("redacted", "summary", "findings")}
    last = read["findings"].groupBy("scan_id").agg(F.max("end").alias("last_end"), F.count("*").alias("n_findings"))
    secrets = spark.read.parquet(vault).groupBy("scan_id").agg(
        F.count("*").alias("n_entries"), F.sum(F.octet_length("text")).alias("vault_bytes")
    )
    joined = read["redacted"].join(read["summary"], "scan_id").join(last, "scan_id", "left").join(secrets, "scan_id", "left")
    return joined.select(
        "scan_id",
        "anonymised_text",
        "pii_found",
        F.array_join("pii_types", ",").alias("pii_types"),
        F.array_join("placeholders", ",").alias("placeholders"),
        "last_end",
        "n_findings",
        "n_entries",
        "vault_bytes",
    )


# --- the corpus as a whole -------------------------------------------------------------------------------------


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.explode_findings(_scanned(spark, sf_dir)).select("scan_id", "pii_type", "text")


@query
def corpus_pii_profile(spark, sf_dir):
    groups = planted.read(spark, sf_dir, "documents").selectExpr("doc_id as scan_id", "lang")
    return corpus.profile(_findings(spark, sf_dir), groups, "lang")


@query
def corpus_pseudonyms(spark, sf_dir):
    return corpus.pseudonyms(_findings(spark, sf_dir))


def _numbered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, str]:
    """The scanned corpus and its numbered pseudonyms, both written."""
    path = sinks.shared_dir(spark, "pseudonyms")
    _scanned(spark, sf_dir).select("scan_id", "text", "findings").write.parquet(f"{path}/scan")
    scanned = spark.read.parquet(f"{path}/scan")
    found = scans.explode_findings(scanned).select("scan_id", "pii_type", "start", "text")
    corpus.first_places(found).write.parquet(f"{path}/places")
    corpus.numbered_pseudonyms(spark.read.parquet(f"{path}/places")).write.parquet(f"{path}/names")
    return scanned, spark.read.parquet(f"{path}/names"), path


@query
def corpus_numbered_pseudonyms(spark, sf_dir):
    _, names, path = _numbered(spark, sf_dir)
    sinks.remove(spark, f"{path}/scan")
    return names


@query
def corpus_masked_by_pseudonyms(spark, sf_dir):
    scanned, names, path = _numbered(spark, sf_dir)
    corpus.mask_by_pseudonyms(scanned, names).select("scan_id", "masked_text").write.parquet(f"{path}/masked")
    sinks.remove(spark, f"{path}/scan")
    return spark.read.parquet(f"{path}/masked")


@query
def corpus_shared_values(spark, sf_dir):
    return corpus.shared_values(_findings(spark, sf_dir))


@query
def corpus_shared_sketches(spark, sf_dir):
    """Documents come on one of five days, every third one again on the day after; sketches of four days are merged."""
    path = sinks.shared_dir(spark, "sketches")
    found = _findings(spark, sf_dir)
    days = F.when(F.col("scan_id") % 3 == 0, F.array(F.col("scan_id") % 5, F.col("scan_id") % 5 + 1)).otherwise(F.array(F.col("scan_id") % 5))
    daily = found.withColumn("day", F.explode(days))
    corpus.value_sketches(daily).write.partitionBy("day").parquet(path)
    return corpus.shared_by_sketches(spark.read.parquet(path).where("day between 1 and 4"))


@query
def corpus_top_docs(spark, sf_dir):
    return corpus.top_documents(_findings(spark, sf_dir), TOP_DOCUMENTS)


TOP_DOCUMENTS = 20


@query
def corpus_clean_split(spark, sf_dir):
    labels = planted.read(spark, sf_dir, "labels").selectExpr("doc_id as scan_id", "quality", "toxic")
    return corpus.clean_split(_scanned(spark, sf_dir), labels)


@query
def scan_pages(spark, sf_dir):
    """Secrets in the addresses of web pages, and everything in their HTML."""
    pages = planted.read(spark, sf_dir, "pages")
    texts = pages.selectExpr("page_id", "'url' as part", "concat(url, '?token=', substr(md5(url), 1, 12)) as text").unionByName(
        pages.selectExpr("page_id", "'html' as part", f"concat(html, ' ', {planted.sentence('page_id')}) as text")
    )
    scanned = scans.scan_texts(texts)
    return scanned.select("page_id", "part", "anonymised_text", F.size("findings").cast("bigint").alias("n_findings"))


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
