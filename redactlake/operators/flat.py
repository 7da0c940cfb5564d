"""Overlaps and placeholders over a flat table of candidates, for findings of several engines and for texts that are scanned in chunks.

The results are those of the forms that work inside a row. A text may have any number of candidates: order within a text is
found in blocks of BLOCK bytes and carried from block to block, so that no task sorts all candidates of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactlake.functions.spans import resolve_overlaps
from redactlake.operators.scans import explode_array

#: Bytes of text whose candidates are put in order together.
BLOCK = 1 << 20
CANDIDATE_FIELDS = ["pii_type", "start", "end", "text", "confidence", "rule_id", "prio", "ordinal"]


def from_chunks(candidates: DataFrame, offset: str) -> DataFrame:
    """Candidates of chunks, moved to their place in the whole text: ``offset`` holds the byte at which the chunk begins. Chunks that
    overlap may give the same candidate twice; overlaps are resolved all the same."""
    moved = {name: F.col(name) + F.col(offset) for name in ("start", "end")}
    return candidates.withColumns(moved).drop(offset)


def _block(start: str) -> Column:
    return F.floor(F.col(start) / BLOCK)


def running_max(rows: DataFrame, key: str, value: Column, name: str, before: bool = False) -> DataFrame:
    """Add the largest ``value`` of the rows of the same text that start up to where this one does, or (``before``) before it. Rows
    with the same start get the same, however equal they are. Two levels: within a block, and over the blocks before it.
    """
    rows = rows.withColumn("_value", value)
    tops = rows.groupBy(key, "_block").agg(F.max("_value").alias("_top"))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(key, "_block", F.max("_top").over(earlier).alias("_carried"))
    inside = Window.partitionBy(key, "_block").orderBy("start").rangeBetween(Window.unboundedPreceding, -1 if before else 0)
    local = rows.withColumn("_local", F.max("_value").over(inside))
    return local.join(carried, [key, "_block"]).withColumn(name, F.greatest("_local", "_carried")).drop("_value", "_local", "_carried")


def islands(candidates: DataFrame, key: str = "scan_id") -> DataFrame:
    """Add ``island``: the start of the run of overlapping candidates that each one belongs to. A candidate that begins at or behind
    all earlier ends is apart from whatever was kept before it, so islands can be resolved one by one."""
    dealt = candidates.withColumn("_block", _block("start"))
    ends = running_max(dealt, key, F.col("end"), "_reached", before=True)
    begins = F.when(F.col("_reached").isNull() | (F.col("start") >= F.col("_reached")), F.col("start"))
    return running_max(ends, key, begins, "island").drop("_reached", "_block")


def resolve_flat(candidates: DataFrame, key: str = "scan_id") -> DataFrame:
    """Candidates (``key`` and CANDIDATE_FIELDS) that don't overlap, by the rules of ``spans.resolve_overlaps``. The candidates of
    one island meet in one row; islands of a text are independent rows. ``ordinal`` orders equal spans."""
    fields = F.struct(*CANDIDATE_FIELDS)
    # equal spans of different engines are put in the order that the row form takes from its array
    listed = F.sort_array(F.collect_list(F.struct("ordinal", fields.alias("candidate"))))
    grouped = islands(candidates, key).groupBy(key, "island").agg(listed.alias("_listed"))
    arrays = grouped.select(key, F.transform("_listed", lambda c: c["candidate"]).alias("_found"))
    kept = arrays.select(key, resolve_overlaps(F.col("_found")).alias("_kept"))
    return explode_array(kept, "_kept", [key], CANDIDATE_FIELDS)


def number_flat(resolved: DataFrame, key: str = "scan_id") -> DataFrame:
    """Add ``placeholder`` to candidates that don't overlap, by the rules of ``spans.assign_placeholders``: the texts of a type are
    numbered by their first place, and an equal text has the same placeholder whatever its type."""
    firsts = resolved.groupBy(key, "text").agg(F.min(F.struct("start", "pii_type")).alias("_first"))
    owners = firsts.select(
        key, "text", F.col("_first.start").alias("_at"), F.col("_first.pii_type").alias("_kind"), _block("_first.start").alias("_block")
    )
    sizes = owners.groupBy(key, "_kind", "_block").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(key, "_kind").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sizes.select(key, "_kind", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_carried"))
    inside = owners.withColumn("_inside", F.row_number().over(Window.partitionBy(key, "_kind", "_block").orderBy("_at")))
    number = (F.col("_carried") + F.col("_inside")).cast("string")
    named = inside.join(carried, [key, "_kind", "_block"]).select(
        key, "text", F.concat(F.lit("["), "_kind", F.lit("_"), number, F.lit("]")).alias("placeholder")
    )
    return resolved.join(named, [key, "text"])
