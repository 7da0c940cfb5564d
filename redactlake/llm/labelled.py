"""Labelled rows for fitting, and the rows that are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(modulus: int, rest: int) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text, modulo `modulus`, is `rest`."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == rest, F.lit(False))


def fitting_rows(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, limit: int, most_bytes: int
) -> list[tuple[str, int]]:
    """At most `limit` texts with their label, the labels first in the order of a hash of their ids.

    Of those labels, rows without text or of more than `most_bytes` bytes aren't used for fitting. Labels that are held out are
    never looked at. The chosen labels go to the documents (`limit` bounds what is broadcast), so that no text is shuffled.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).alias("y"))
    chosen = (
        known.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(modulus, rest))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "y")
        .limit(limit)
    )
    rows = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .where(F.octet_length("text").between(1, most_bytes))
        .join(F.broadcast(chosen), "doc_id")
        .orderBy(F.md5(F.col("doc_id").cast("string")), "text", "y")
        .limit(limit)
    )
    return [(row.text, row.y) for row in rows.select("text", "y").collect()]
