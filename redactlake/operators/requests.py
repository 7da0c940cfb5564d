"""Masking of request bodies and conversations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactlake import fixed_values as fv
from redactlake.functions.arrays import empty_array
from redactlake.functions.bodies import (
    allow_repeated_keys,
    body_kind,
    json_document,
    rewritten_body,
    scan_segments,
    segments_of,
    triage_kind,
)
from redactlake.functions.scan import ScanOptions, column_findings
from redactlake.functions.spans import FINDING, mapping_of, mask, merge_whitelists
from redactlake.operators.scans import FINDING_COLUMNS, explode_array


DOCUMENT = "_document"


def _parsed(df: DataFrame, body: str) -> DataFrame:
    """With the body's JSON value, parsed once for its kind and its texts."""
    allow_repeated_keys(df.sparkSession)
    return df.withColumn(DOCUMENT, json_document(F.col(body)))


def triage(df: DataFrame, body: str = "body") -> DataFrame:
    """Add ``kind``: empty, json, text or reject. Objects may repeat keys, of which the last counts; for that, the session's
    setting for repeated keys is switched on."""
    return _parsed(df, body).withColumn("kind", body_kind(F.col(body), F.col(DOCUMENT))).drop(DOCUMENT)


def quarantine(df: DataFrame, body: str = "body") -> DataFrame:
    """Split off bodies (binary) that are no UTF-8: they stay unscanned under a placeholder, their bytes in ``raw``."""
    text = F.col(body).cast("string")
    valid = F.is_valid_utf8(text)
    return (
        df.withColumn("quarantined", ~valid)
        .withColumn("raw", F.when(~valid, F.col(body)))
        .withColumn(body, F.when(valid, text).otherwise(F.lit(fv.BINARY_PLACEHOLDER)))
    )


def _scan(df: DataFrame, body: str, options: ScanOptions, kind: Callable[[Column], Column]) -> DataFrame:
    return (
        _parsed(df, body)
        .withColumn("kind", kind(F.col(DOCUMENT)))
        .withColumn("segments", segments_of(body, "kind", DOCUMENT))
        .withColumn("scans", scan_segments("segments", options))
        .drop("segments")
    )


def mask_bodies(df: DataFrame, body: str = "body", options: ScanOptions = ScanOptions()) -> DataFrame:
    """Add ``kind`` and ``scans``: path, text, masked text and findings of every segment. No shuffle."""
    return _scan(df, body, options, lambda document: body_kind(F.col(body), document)).drop(DOCUMENT)


def _with_masked_body(scanned: DataFrame, body: str) -> DataFrame:
    changed = F.transform(
        F.filter("scans", lambda s: F.size(s["findings"]) > 0),
        lambda s: F.struct(s["path"].alias("path"), s["anonymised_text"].alias("text")),
    )
    return (
        scanned.withColumn("_changed", changed)
        .withColumn("masked_body", rewritten_body(F.col(body), F.col("kind"), F.col(DOCUMENT), F.col("_changed")))
        .drop("_changed", DOCUMENT)
    )


def whole_masked_bodies(df: DataFrame, body: str = "body", options: ScanOptions = ScanOptions()) -> DataFrame:
    """As ``mask_bodies``, and ``masked_body``: the body that can be sent on. Texts of the user are masked where they stand, system
    and assistant parts, keys, numbers and white space stay as they are. Bodies of kind reject have none. No shuffle."""
    return _with_masked_body(_scan(df, body, options, lambda document: body_kind(F.col(body), document)), body)


def dry_run(df: DataFrame, body: str = "body", options: ScanOptions = ScanOptions()) -> DataFrame:
    """Scan whole bodies as they are, JSON syntax and all roles included, and change nothing."""
    return _scan(df, body, options, lambda document: triage_kind(F.col(body), document, F.lit(True))).drop(DOCUMENT)


def mask_by_policy(df: DataFrame, body: str = "body") -> DataFrame:
    """As ``mask_bodies``, with the lists of each row in detectors and whitelist and its dry_run flag."""
    asked = F.coalesce(F.col("dry_run"), F.lit(False))
    options = ScanOptions("detectors", "whitelist")
    return _scan(df, body, options, lambda document: triage_kind(F.col(body), document, asked)).drop(DOCUMENT)


def masked_segments(masked: DataFrame, key: str = "request_id") -> DataFrame:
    """One row per scanned text."""
    rows = explode_array(masked, "scans", [key], ["path", "text", "anonymised_text", "findings"])
    return rows.withColumn("n_findings", F.size("findings"))


def request_findings(masked: DataFrame, key: str = "request_id") -> DataFrame:
    """Findings table of masked bodies."""
    rows = explode_array(masked, "scans", [key], ["path", "findings"])
    return explode_array(rows, "findings", [key, "path"], FINDING_COLUMNS)


def body_vault(masked: DataFrame, key: str = "request_id") -> DataFrame:
    """Vault of masked bodies: key, path, placeholder, text. Placeholders start anew in every text of a body, so that the path is part of
    an entry's key. No shuffle."""
    rows = explode_array(masked, "scans", [key], ["path", "findings"])
    found = rows.select(key, "path", mapping_of(F.col("findings")).alias("mapping"))
    return explode_array(found, "mapping", [key, "path"], ["placeholder", "text"])


def _all_findings(scans: Column) -> Column:
    return F.flatten(F.transform(scans, lambda s: s["findings"]))


def masked_bytes(scans: Column) -> Column:
    """Bytes saved by masking, over the scanned texts; 0 if they grew."""

    def total(field: str) -> Column:
        return F.aggregate(
            scans, F.lit(0).cast("bigint"), lambda acc, s: acc + F.octet_length(s[field])
        )

    return F.greatest(F.lit(0).cast("bigint"), total("text") - total("anonymised_text"))


def summarize(masked: DataFrame, key: str = "request_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One summary per request, inside the row: count, types, placeholders, bytes; and the columns to ``keep``.

    Raw text lists a type once per finding, JSON and dry runs list each type once, sorted.
    """
    with_findings = masked.withColumn("_found", _all_findings(F.col("scans")))
    types = F.transform("_found", lambda f: f["pii_type"])
    placeholders = F.transform("_found", lambda f: f["placeholder"])
    return with_findings.select(
        key,
        *keep,
        F.size("_found").cast("bigint").alias("pii_found"),
        F.sort_array(F.array_distinct(placeholders)).alias("placeholders"),
        F.when(F.col("kind") == "text", types).otherwise(F.sort_array(F.array_distinct(types))).alias("pii_types"),
        (F.col("kind") == "json").alias("is_json"),
        F.when(F.col("kind") == "dry_run", F.lit(0).cast("bigint"))
        .otherwise(masked_bytes(F.col("scans")))
        .alias("masked_bytes"),
    )


def mask_user_turns(df: DataFrame, text: str = "text", options: ScanOptions = ScanOptions()) -> DataFrame:
    """Flat conversations: mask turns of the user, pass all others through, in one pass."""
    found = F.when(F.col("role") == "user", column_findings(text, options)).otherwise(empty_array(FINDING))
    return df.withColumn("findings", found).withColumn("anonymised_text", mask(F.col(text), F.col("findings")))


def effective_lists(
    df: DataFrame,
    detectors: str = "detectors",
    whitelist: str = "whitelist",
    default_detectors: str = "default_detectors",
    default_whitelist: str = "default_whitelist",
) -> DataFrame:
    """Requested detectors replace the default ones, requested whitelist tokens join the default ones."""
    requested = F.col(detectors)
    return df.withColumn(
        "effective_detectors",
        F.when(F.size(F.coalesce(requested, empty_array("string"))) > 0, requested).otherwise(
            F.coalesce(F.col(default_detectors), empty_array("string"))
        ),
    ).withColumn("effective_whitelist", merge_whitelists(F.col(default_whitelist), F.col(whitelist)))
