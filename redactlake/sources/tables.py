"""Reading corpora and request bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corpus(
    spark: SparkSession, path: str, key: str, text: str, role: str | None = None, part: str | None = None, fmt="parquet"
) -> DataFrame:
    """A table with a text column as segments: scan_id, seg_id, role, path, text. Only the columns named are read; keys
    keep their type."""
    rows = spark.read.format(fmt).load(path)
    return rows.select(
        F.col(key).alias("scan_id"),
        (F.col(part).cast("int") if part else F.lit(0)).alias("seg_id"),
        (F.col(role) if role else F.lit(None).cast("string")).alias("role"),
        F.lit(text).alias("path"),
        F.col(text).cast("string").alias("text"),
    )


def read_requests(spark: SparkSession, path: str, key: str, body: str, fmt="parquet") -> DataFrame:
    """A table of request bodies, text or binary: request_id, body. Keys keep their type."""
    rows = spark.read.format(fmt).load(path)
    return rows.select(F.col(key).alias("request_id"), F.col(body).alias("body"))
