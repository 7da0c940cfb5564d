"""Scans over tables with one text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactlake.functions.scan import ScanOptions, column_candidates, column_findings
from redactlake.functions.spans import clean_tokens, mapping_of, mask

FINDING_COLUMNS = ["pii_type", "start", "end", "text", "confidence", "placeholder", "rule_id"]


#: An input with fewer bytes a core than this is spread over all cores.
SMALL_BYTES = 32 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a small input over all cores; a larger one stays as it is, so that a large corpus is never shuffled.

    The planner's estimate of the bytes decides, not the number of splits: a small file often has one row group, so that one
    of its splits holds all rows. Meant for tables straight from files; streams, and sessions whose plans can't be looked at from here, are left
    alone.
    """
    if df.isStreaming or not hasattr(df, "_jdf"):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, *keys) if size < SMALL_BYTES * cores else df


def with_whitelist(df: DataFrame, tokens: DataFrame, on: str, name: str = "whitelist") -> DataFrame:
    """Add the tokens of a table (``on``, token) as an array column, for ``ScanOptions(whitelist=name)``. Tokens are cleaned once
    per list; rows without a list get none. A list is as long as one row may be."""
    cleaned = tokens.select(on, F.explode(clean_tokens(F.array("token"))).alias("_token"))
    lists = cleaned.groupBy(on).agg(F.array_sort(F.collect_set("_token")).alias(name))
    return df.join(lists, on, "left")


def explode_array(df: DataFrame, array: str, keep: list[str], fields: list[str]) -> DataFrame:
    """One row per array element. The outer form keeps Spark from adding a size filter that would be pushed below the
    projection that computes the array, and so compute it twice."""
    return (
        df.select(*keep, F.explode_outer(array).alias("_e"))
        .where(F.col("_e").isNotNull())
        .select(*keep, *[F.col("_e")[f].alias(f) for f in fields])
    )


def candidates(df: DataFrame, text: str = "text", key: str = "scan_id", detectors=None) -> DataFrame:
    """Flat table of raw candidates, before white list and overlap resolution."""
    chosen = None if detectors is None else tuple(detectors)
    found = df.select(key, column_candidates(text, chosen).alias("candidates"))
    return explode_array(
        found, "candidates", [key], ["pii_type", "start", "end", "text", "confidence", "rule_id", "prio", "ordinal"]
    )


def scan_texts(df: DataFrame, text: str = "text", options: ScanOptions = ScanOptions()) -> DataFrame:
    """Add ``findings`` and ``anonymised_text``; one narrow stage, no shuffle."""
    return df.withColumn("findings", column_findings(text, options)).withColumn(
        "anonymised_text", mask(F.col(text), F.col("findings"))
    )


def anonymize(df: DataFrame, text: str = "text", options: ScanOptions = ScanOptions()) -> DataFrame:
    """Replace the text by its masked form."""
    columns: list[str | Column] = [c for c in df.columns if c != text]
    return scan_texts(df, text, options).select(*columns, "anonymised_text")


def explode_findings(scanned: DataFrame, key: str = "scan_id") -> DataFrame:
    """Findings table of a scan."""
    return explode_array(scanned, "findings", [key], FINDING_COLUMNS)


def placeholder_map(scanned: DataFrame, key: str = "scan_id") -> DataFrame:
    """Vault rows: which text stands behind a placeholder of a scan. Distinct within the row, so no shuffle."""
    return explode_array(
        scanned.select(key, mapping_of(F.col("findings")).alias("mapping")), "mapping", [key], ["placeholder", "text"]
    )
