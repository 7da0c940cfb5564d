"""Writing scan results. The original text is never written; the vault goes to a place of its own."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.operators.scans import explode_findings, placeholder_map
from redactlake.sources.batches import write_batch


#: Spreads a frequent type over this many tasks and files.
FILES_PER_TYPE = 64


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared one that the session names in spark.checkpoint.dir. Only a local session without
    that setting may use a temporary folder of the machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="redactlake-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def _write(rows: DataFrame, path: str, batch: str | None, partition_by: tuple[str, ...] = ()) -> None:
    """Append; or, with a batch, take the place of what the batch had before (``batches.read_batches`` reads it)."""
    if batch is None:
        rows.write.mode("append").partitionBy(*partition_by).parquet(path)
    else:
        write_batch(rows, path, batch, partition_by)


def write_findings(scanned: DataFrame, path: str, key: str = "scan_id", text: bool = True, batch: str | None = None) -> None:
    """Findings, in one folder per type, of at most FILES_PER_TYPE files each. A job that may run again names its batch."""
    rows = explode_findings(scanned, key)
    rows = rows if text else rows.drop("text")
    dealt = rows.repartition("pii_type", F.pmod(F.xxhash64(key), F.lit(FILES_PER_TYPE)))
    _write(dealt, path, batch, ("pii_type",))


def write_redacted(scanned: DataFrame, path: str, key: str = "scan_id", batch: str | None = None) -> None:
    """Masked texts."""
    redacted = scanned.select(key, "anonymised_text", F.size("findings").alias("n_findings"))
    _write(redacted, path, batch)


def write_mapping(scanned: DataFrame, path: str, key: str = "scan_id", batch: str | None = None) -> None:
    """The vault: what stands behind the placeholders."""
    _write(placeholder_map(scanned, key), path, batch)


def write_metrics(exposition: DataFrame, path: str) -> None:
    """Counter lines as one text file; the rows are a handful of totals."""
    exposition.orderBy("line_no").select("value").coalesce(1).write.mode("append").text(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that holds texts in clear, once it isn't read any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
