"""Policy documents: JSON with a list of proxies, or in the older form just that list."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake import fixed_values as fv
from redactlake.functions.arrays import empty_array
from redactlake.functions.bodies import json_document

_FIELDS = "map<string,variant>"
_LIST = "array<variant>"


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _strings(value: Column, path: str) -> Column:
    return F.coalesce(_get(value, path, "array<string>"), empty_array("string"))


SETTINGS = ("detectors", "whitelist", "dry_run")
#: What stands in a document where a value of each kind is asked for; a missing value and null will do.
_KINDS = {"int": "BIGINT", "string": "STRING", "boolean": "BOOLEAN", "array<string>": "ARRAY<STRING>"}
_FIELD_KINDS = {"type": "string", "port": "int", "upstream": "string"}
_SETTING_KINDS = {"detectors": "array<string>", "whitelist": "array<string>", "dry_run": "boolean"}


def _wrong(value: Column, kinds: dict[str, str]) -> Column:
    """Whether one of the fields is of another kind."""
    wrong = F.lit(False)
    for field, kind in kinds.items():
        found = F.coalesce(F.schema_of_variant(_get(value, f"$.{field}", "variant")), F.lit("VOID"))
        allowed = ["VOID", _KINDS[kind], *(["ARRAY<VOID>"] if kind.startswith("array") else [])]
        wrong = wrong | ~found.isin(allowed)
    return wrong


def _settings(proxy: Column, key: str | None) -> Column:
    """The object with the settings of a proxy: the one under ``key``, or else the first that has one of their names."""
    if key:
        return _get(proxy, f"$.{key}", "variant")
    named = lambda v: reduce(or_, [_get(v, f"$.{name}", "variant").isNotNull() for name in SETTINGS])
    return F.get(F.filter(F.map_values(_get(proxy, "$", _FIELDS)), named), F.lit(0))


def parse_policies(documents: DataFrame, json: str = "json", settings_key: str | None = None) -> DataFrame:
    """One row per policy. Documents without policies, null ones and missing ones (NULL) give the default policy; malformed
    ones and ones with a value of the wrong kind give one row with ``valid`` = false.

    The settings of a proxy sit in the object under ``settings_key``; without it, in the first object that holds detectors,
    whitelist or dry_run.
    """
    parsed = documents.withColumn("_root", json_document(F.col(json)))
    listed = F.coalesce(_get(F.col("_root"), "$", _LIST), _get(F.col("_root"), "$.proxies", _LIST))
    wrong = _wrong(F.col("_root"), {"api_port": "int", "default_detectors": "array<string>", "default_whitelist": "array<string>"})
    wrong_proxy = lambda p: _wrong(p, _FIELD_KINDS) | _wrong(_settings(p, settings_key), _SETTING_KINDS)
    checked = parsed.withColumn("_listed", F.coalesce(listed, F.array().cast(_LIST))).withColumn(
        "_wrong", wrong | F.exists("_listed", wrong_proxy)
    )
    # the kind of the document itself
    kind = F.schema_of_variant("_root")
    known = (kind == "VOID") | F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
    root = checked.withColumn("valid", F.col(json).isNull() | (F.coalesce(known, F.lit(False)) & ~F.col("_wrong")))
    use = lambda c: F.when(F.col("valid"), c)
    proxies = root.select(
        *documents.columns,
        "valid",
        use(_get(F.col("_root"), "$.api_port", "int")).alias("api_port"),
        F.coalesce(use(_strings(F.col("_root"), "$.default_detectors")), empty_array("string")).alias("default_detectors"),
        F.coalesce(use(_strings(F.col("_root"), "$.default_whitelist")), empty_array("string")).alias("default_whitelist"),
        F.when(F.col("valid") & (F.size("_listed") > 0), F.col("_listed")).alias("_proxies"),
    ).select("*", F.posexplode_outer("_proxies").alias("policy_no", "_proxy"))
    settings = proxies.withColumn("_settings", _settings(F.col("_proxy"), settings_key))
    default_port = F.when(F.col("valid") & F.col("_proxy").isNull(), fv.DEFAULT_POLICY_PORT)
    return settings.select(
        *documents.columns,
        "valid",
        F.coalesce("policy_no", F.lit(0)).alias("policy_no"),
        "api_port",
        "default_detectors",
        "default_whitelist",
        _get(F.col("_proxy"), "$.type", "string").alias("policy_type"),
        F.coalesce(_get(F.col("_proxy"), "$.port", "int"), default_port).alias("port"),
        _get(F.col("_proxy"), "$.upstream", "string").alias("upstream"),
        _strings(F.col("_settings"), "$.detectors").alias("detectors"),
        _strings(F.col("_settings"), "$.whitelist").alias("whitelist"),
        F.coalesce(_get(F.col("_settings"), "$.dry_run", "boolean"), F.lit(False)).alias("dry_run"),
    )


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """Policy files, one document each."""
    documents = spark.read.text(path, wholetext=True).select(F.col("value").alias("json"))
    return parse_policies(documents).drop("json")


def api_keys(documents: DataFrame, json: str = "json") -> DataFrame:
    """The keys that policy documents list: key_id, name, hash; for ``admit_keys``. Keys without hash are left out."""
    keys = documents.select(F.explode(_get(json_document(F.col(json)), "$.api_keys", _LIST)).alias("_key"))
    fields = [_get(F.col("_key"), f"$.{name}", "string") for name in ("id", "name", "hash")]
    listed = keys.select(fields[0].alias("key_id"), fields[1].alias("name"), fields[2].alias("hash"))
    return listed.where(F.coalesce("hash", F.lit("")) != "")
