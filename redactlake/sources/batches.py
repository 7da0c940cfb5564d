"""Tables that are written batch by batch, where a batch may be written again: after a failure, or with other rows.

Every attempt has a folder of its own, and an entry in the list of batches makes it count once its rows are complete. Readers see the
latest attempt of each batch and nothing of attempts that broke off.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ENTRY = "batch string, attempt string, n_rows bigint, fields string, written timestamp"


def write_attempt(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> tuple[str, int]:
    """Write rows that don't count yet: the name of the attempt and its number of rows."""
    attempt = f"a{uuid.uuid4().hex}"
    folder = f"{path}/rows/attempt={attempt}"
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(folder)
    # counts come from the footers of the files
    return attempt, rows.sparkSession.read.schema(rows.schema).parquet(folder).count()


def write_batch(rows: DataFrame, path: str, batch: str, partition_by: tuple[str, ...] = ()) -> None:
    """Write the rows of ``batch`` in place of those it had before. Columns may not be named ``batch`` or ``attempt``."""
    clash = {"batch", "attempt"} & set(rows.columns)
    if clash:
        raise ValueError(f"column names that batches need: {sorted(clash)}")
    attempt, n_rows = write_attempt(rows, path, partition_by)
    fields = json.dumps(rows.schema.jsonValue())
    entry = rows.sparkSession.range(1).select(
        F.lit(batch).alias("batch"),
        F.lit(attempt).alias("attempt"),
        F.lit(n_rows).cast("bigint").alias("n_rows"),
        F.lit(fields).alias("fields"),
        F.current_timestamp().alias("written"),
    )
    entry.coalesce(1).write.mode("append").parquet(f"{path}/batches")


def list_batches(spark: SparkSession, path: str) -> DataFrame:
    """batch, attempt, n_rows, fields, written: one row per batch, its latest attempt."""
    entries = spark.read.schema(ENTRY).parquet(f"{path}/batches")
    latest = entries.groupBy("batch").agg(F.max(F.struct("written", "attempt", "n_rows", "fields")).alias("last"))
    return latest.select("batch", "last.attempt", "last.n_rows", "last.fields", "last.written")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches, with ``batch``. Columns are those of the batch written last; older ones have NULL for new columns."""
    listed = list_batches(spark, path)
    fields = StructType.fromJson(json.loads(listed.orderBy(F.desc("written"), "attempt").first()["fields"]))
    rows = spark.read.schema(fields.add("attempt", "string")).parquet(f"{path}/rows")
    return rows.join(listed.select("attempt", "batch"), "attempt").drop("attempt")


def superseded(spark: SparkSession, path: str) -> DataFrame:
    """Entries whose attempt has been replaced: batch, attempt. Their folders may be removed when nobody reads them any more."""
    entries = spark.read.schema(ENTRY).parquet(f"{path}/batches")
    return entries.join(list_batches(spark, path), "attempt", "left_anti").select("batch", "attempt")
