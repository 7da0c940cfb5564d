"""Reports over access-log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactlake import fixed_values as fv
from redactlake.functions.spans import trimmed


def status_class(line: Column) -> Column:
    """success, warning or danger by the first token from the third on that is a number from 200 to 599."""
    tokens = F.split(trimmed(line), f"[{fv.UNICODE_SPACES}]+")
    later = F.when(F.size(tokens) > 2, F.slice(tokens, 3, F.size(tokens))).otherwise(F.array().cast("array<string>"))
    numbers = F.transform(
        F.filter(later, lambda t: t.rlike(r"^[+]?[0-9]+$")), lambda t: t.try_cast("bigint")
    )
    status = F.get(F.filter(numbers, lambda n: n.between(200, 599)), F.lit(0))
    return F.when(status >= 500, "danger").when(status >= 400, "warning").when(status >= 200, "success").otherwise(
        "neutral"
    )


def pii_flag(line: Column) -> Column:
    """Whether the first ``pii=`` of a line is followed by something other than 0."""
    text = trimmed(line)
    at = F.instr(text, "pii=")
    value = F.substr(text, at + 4, F.lit(1))
    return (at > 0) & (value != "") & (value != "0")


def tail(entries: DataFrame, source: str, newest_first: list[str], n: int = fv.LOG_TAIL_LINES) -> DataFrame:
    """Last n entries of each source. Spark keeps n rows per source and partition before it shuffles, so a source that
    holds most rows is no problem."""
    window = Window.partitionBy(source).orderBy(*[F.desc(c) for c in newest_first])
    return entries.withColumn("from_end", F.row_number().over(window)).where(F.col("from_end") <= n)


def traffic_report(entries: DataFrame) -> DataFrame:
    """Requests, errors, bytes and findings per source, path and status, with subtotals."""
    return entries.rollup("source", "path", "status").agg(
        F.grouping_id().cast("int").alias("level"),
        F.count("*").alias("requests"),
        F.count_if(F.col("status") >= 400).alias("errors"),
        F.sum("resp_bytes").alias("resp_bytes"),
        F.sum("pii_count").cast("bigint").alias("pii_findings"),
    )
