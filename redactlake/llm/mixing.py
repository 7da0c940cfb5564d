"""Mixing sources to target weights, with DataFrame functions only.

Documents get hash-random keys. Within a source they are ordered by key; prefix sums of their sizes are computed in two
levels: sums of (source, range of keys), prefixes over these, then prefixes inside each range. The number of ranges grows with the
root of the number of documents, so neither level meets in one task, whatever share of the rows a source holds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactlake.llm.store import Scratch, free_name

WORD = r"[^\x20\x09-\x0D]+"
SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
KEY_BITS = 60


def _sized(docs: DataFrame) -> DataFrame:
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, KEY_BITS // 4), 16, 10)
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").isNull().alias("no_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64("text").alias("text_hash"),
        key.cast("bigint").alias("key"),
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3) -> DataFrame:
    """One row per source (no_source, source): rank, source_size, target.

    Sources in order of code points, null last, have the weights in turn and share the size of all documents. A target stops
    at `most_epochs` times its source's size; what is above is shared again by weight until none is above. Written as the level
    that weights are filled up to: sources in order of their limit per weight, of which the first ones stop.
    """
    every = Window.orderBy("no_source", "source")
    by_limit = Window.orderBy("limit_per_weight", "rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    ranked = sizes.groupBy("no_source", "source").agg(F.sum("size").alias("source_size")).withColumn(
        "rank", F.row_number().over(every)
    )
    weight = F.array(*[F.lit(w) for w in weights])[(F.col("rank") - 1) % len(weights)]
    limited = (
        ranked.withColumn("weight", weight)
        .withColumn("limit", F.lit(most_epochs) * F.col("source_size"))
        .withColumn("limit_per_weight", F.col("limit").cast("double") / F.col("weight"))
    )
    stopped = F.coalesce(F.sum("limit").over(before), F.lit(0))
    level = (F.sum("source_size").over(whole) - stopped).cast("double") / F.sum("weight").over(onward)
    levels = limited.withColumn("level", level)
    reached = F.min(F.when(F.col("level") <= F.col("limit_per_weight"), F.struct("limit_per_weight", "rank", "level")))
    return levels.withColumn("reached", reached.over(whole)["level"]).select(
        "no_source",
        "source",
        "rank",
        "source_size",
        F.least(F.col("limit").cast("double"), F.col("weight") * F.col("reached")).alias("target"),
    )


def _takes(docs: DataFrame, weights: tuple[int, ...], most_epochs: int) -> DataFrame:
    sized = Scratch(docs.sparkSession, "mix").keep(_sized(docs), "sized")
    range_bits = math.ceil(math.log2(max(sized.count(), 2))) // 2
    ranged = sized.withColumn("range", F.shiftright("key", KEY_BITS - range_bits))
    by = ["no_source", "source"]
    earlier = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(*by, "range")
        .agg(F.sum("size").alias("range_size"))
        .withColumn("range_start", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
        .join(source_targets(sized, weights, most_epochs), by)
        .drop("range_size")
    )
    order = Window.partitionBy(*by, "range").orderBy("key", "doc_id", "size", "text_hash")
    inside = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    budget = F.floor("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0)
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    part = F.least(F.greatest(F.col("rest") - F.col("range_start") - F.col("inside"), F.lit(0)), F.col("size"))
    return (
        ranged.withColumn("inside", inside)
        .join(starts, [*by, "range"])
        .withColumn("budget", budget)
        .withColumn("epochs", epochs.cast("bigint"))
        .withColumn("rest", rest)
        .withColumn("taken", F.col("epochs") * F.col("size") + part)
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3) -> DataFrame:
    """One row per row of `docs` (doc_id, source, text): doc_id, size (words), source_size, target (of its source), taken
    (words that the mix takes, repeats counted).

    A source's budget is its target without a fraction. Whole epochs of the source come first; the rest goes to its documents in
    random order, the last of which is cut at the budget. The order depends on ids alone, so reruns agree; rows with the same
    id come in order of size and text. A null text has size 0, null is a source of its own, an empty table gives no rows.
    Other columns are ignored.
    """
    return _takes(docs, weights, most_epochs).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3) -> DataFrame:
    """The mix itself: rows of `docs` once per epoch, the last one of a source cut to the words that it gives; n_chars, where it
    is a column, follows the cut. Rows that take nothing are left out; rows with the same id, source and text share evenly.
    """
    taken, size, epoch, cut, row, no_source, source, text_hash = (
        free_name(docs, f"_{c}") for c in ("taken", "size", "epoch", "cut", "doc_id", "no_source", "source", "text_hash")
    )
    takes = (
        _takes(docs, weights, most_epochs)
        .groupBy("doc_id", "no_source", "source", "text_hash")
        .agg(F.floor(F.sum("taken") / F.count("*")).alias(taken), F.first("size").alias(size))
        .where(F.col(taken) > 0)
        .withColumnsRenamed({"doc_id": row, "no_source": no_source, "source": source, "text_hash": text_hash})
    )
    same = (
        F.col("doc_id").eqNullSafe(F.col(row))
        & (F.col("source").isNull() == F.col(no_source))
        & (F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col(source))
        & (F.xxhash64("text") == F.col(text_hash))
    )
    epochs = F.explode(F.sequence(F.lit(0), F.ceil(F.col(taken) / F.col(size)).cast("int") - 1))
    rows = docs.join(takes, same).withColumn(epoch, epochs)
    left = F.col(taken) - F.col(epoch) * F.col(size)
    spaced = F.regexp_extract_all("text", F.lit(SPACED_WORD), F.lit(0))
    rows = rows.withColumn(cut, F.when(left < F.col(size), F.array_join(F.slice(spaced, F.lit(1), left.cast("int")), "")))
    columns = {"text": F.coalesce(cut, "text")}
    if "n_chars" in docs.columns:
        length = F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.char_length(cut))
        columns["n_chars"] = length.cast(docs.schema["n_chars"].dataType)
    return rows.select(*[columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
