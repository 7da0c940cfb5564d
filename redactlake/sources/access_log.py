"""Access-log lines: reading and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake import fixed_values as fv

#: Anchored, without parts that could be matched in several ways: a line is walked once from its start to its path and once
#: from its end (as the reversed line) back to it, whatever its path holds.
HEAD = r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d  (\S++) "
REVERSED_TAIL = r"^(?:\]([^\[\]]*+)\[ )?+(\d++)=iip  B (\d++) {2,}+(\d++) "
TIME_CHARS = 19


def parse_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """Typed fields of each line; all NULL where a line has another layout."""
    split = lines.select(
        "*",
        F.regexp_extract(line, HEAD, 0).alias("_head"),
        F.reverse(F.regexp_extract(F.reverse(line), REVERSED_TAIL, 0)).alias("_tail"),
    )
    middle = F.char_length(line) - F.char_length("_head") - F.char_length("_tail")
    known = (F.col("_head") != "") & (F.col("_tail") != "") & (middle >= 0)
    back = F.reverse("_tail")
    types, count, size, status = (F.reverse(F.regexp_extract(back, REVERSED_TAIL, i)) for i in range(1, 5))
    typed = {
        "ts": F.try_to_timestamp(F.substring("_head", 1, TIME_CHARS), F.lit(fv.LOG_TIME_FORMAT)),
        "method": F.regexp_extract("_head", HEAD, 1),
        "path": F.btrim(F.substring(F.col(line), F.char_length("_head") + 1, middle), F.lit(" ")),
        "status": status.try_cast("int"),
        "resp_bytes": size.try_cast("bigint"),
        "pii_count": count.try_cast("int"),
        "pii_types": F.when(types == "", F.array().cast("array<string>")).otherwise(F.split(types, ",")),
    }
    return split.select(*lines.columns, *[F.when(known, value).alias(name) for name, value in typed.items()])


def format_log(entries: DataFrame) -> DataFrame:
    """One line per entry, column ``value``; entries need ts, method, path, status, resp_bytes, pii_count, pii_types."""
    types = F.coalesce(F.col("pii_types"), F.array().cast("array<string>"))
    suffix = F.concat(
        F.format_string("pii=%d", "pii_count"),
        F.when(F.size(types) > 0, F.concat(F.lit(" ["), F.array_join(types, ","), F.lit("]"))).otherwise(""),
    )
    line = F.format_string(
        fv.LOG_LINE_FORMAT,
        F.date_format("ts", fv.LOG_TIME_FORMAT),
        "method",
        "path",
        "status",
        "resp_bytes",
        suffix,
    )
    return entries.withColumn("value", line)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log files as a typed table, with the file each line came from."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("source"))
    return parse_log(lines)


def write_log(entries: DataFrame, path: str, batch: str | None = None) -> None:
    """Append lines; a batch has a folder of its own that is written anew when the batch is repeated."""
    lines = format_log(entries).select("value")
    if batch is None:
        lines.write.mode("append").text(path)
    else:
        lines.write.mode("overwrite").text(f"{path}/batch={batch}")
