"""What filters of documents do in every order that they can be applied in.

Each document gets a mask of the filters that it fails. Documents are counted by part and mask, so that whatever follows
works on at most one cell per part and mask. The counts come by two narrow shuffles: one of digests (for texts that are
repeated) and one of labelled ids. A cell then folds across the array of all orders, a fixed literal that goes out with the
plan: per order an aggregate() over its letters carries whether the cell's documents are still there, and gives one weighted
struct per step. The 600 structs of a part's cells are added element by element.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactlake.llm.store import Scratch

BLANKS = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
STEP = "struct<filter:string,step:int,filter_order:string," + ",".join(f"{c}:bigint" for c in COUNTS) + ">"


def text_failures(text: Column) -> dict[str, Column]:
    """The filters A to D: few words, few different words, many capitals, symbols."""
    words = F.filter(F.split(text, BLANKS), lambda word: word != "")
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    # both counts of words come from one array, which a struct keeps from being made twice
    counted = F.transform(F.array(words), lambda own: F.struct(F.size(own).alias("n"), F.size(F.array_distinct(own)).alias("d")))[0]
    return {
        "AB": F.transform(
            F.array(counted),
            lambda c: F.when(c.n < 200, 1).otherwise(0) + F.when(F.lit(100) * c.d < F.lit(50) * c.n, 2).otherwise(0),
        )[0],
        "C": F.when(F.lit(100) * capitals.cast("bigint") > F.lit(2) * F.char_length(text), 4).otherwise(0),
        "D": F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0),
    }


def failure_masks(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """part, doc_id, mask (bits 0 to 4 for the filters A to E) of each row of `docs` (doc_id, text, source)."""
    rows = docs.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    own = functools.reduce(Column.__add__, text_failures(F.col("text")).values())
    narrow = scratch.keep(rows.select("part", "doc_id", own.alias("own"), F.unhex(F.sha2("text", 256)).alias("digest")), "masks")
    # only texts of several rows can be repeated; counts per task come first, so that no text's rows meet in one
    repeated = narrow.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    repeated = scratch.keep(repeated, "repeated")  # else the join would have to keep the partitions of the counts
    later = F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False))
    masks = narrow.join(repeated, "digest", "left").select(
        "part", "doc_id", (F.col("own") + F.when(later, 16).otherwise(0)).alias("mask")
    )
    return scratch.keep(masks, "all-masks")  # straight from the join, whose hot digests Spark can then split


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of a part with a mask, and those of them with the labels quality = 1 and toxic = 1."""
    told = labels.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.col("quality") == 1).cast("int").alias("good"),
        (F.col("toxic") == 1).cast("int").alias("toxic"),
    ).groupBy("doc_id").agg(F.coalesce(F.max("good"), F.lit(0)).alias("good"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"))
    marked = masks.join(told.where("good + toxic > 0"), "doc_id")
    by = ["part", "mask"]
    counted = masks.groupBy(*by).agg(F.count("*").alias("n")).withColumn("good", F.lit(0)).withColumn("toxic", F.lit(0))
    lost = marked.groupBy(*by).agg(F.lit(0).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return counted.unionByName(lost).groupBy(*by).agg(*[F.sum(c).cast("bigint").alias(c) for c in ("n", "good", "toxic")])


def _folded(cell: Column, orders: Column, letters: str) -> Column:
    """One cell across all orders: a weighted struct for each order and step, in this order."""

    def bit(letter: Column) -> Column:
        return F.getbit(cell.mask, F.instr(F.lit(letters), letter) - 1) == 1

    def step(order: Column) -> Callable[[Column, Column], Column]:
        def apply(state: Column, letter: Column) -> Column:
            fails, there = bit(letter), state.there
            only = fails & (F.bit_count(cell.mask) == 1)
            weight = lambda condition, count: F.when(condition, count).otherwise(F.lit(0).cast("bigint"))
            now = F.struct(
                letter.alias("filter"),
                (F.size(state.steps) + 1).alias("step"),
                order.alias("filter_order"),
                weight(there & ~fails, cell.n).alias("kept"),
                weight(there & fails, cell.n).alias("removed"),
                weight(~there & fails, cell.n).alias("redundant"),
                weight(only, cell.n).alias("unique_fails"),
                weight(there & fails, cell.good).alias("good_lost"),
                weight(there & fails, cell.toxic).alias("toxic_lost"),
            )
            return F.struct((there & ~fails).alias("there"), F.array_append(state.steps, now).alias("steps"))

        return apply

    def across(order: Column) -> Column:
        begin = F.struct(F.lit(True).alias("there"), F.array().cast(f"array<{STEP}>").alias("steps"))
        return F.aggregate(F.split(order, ""), begin, step(order), lambda state: state.steps)

    return F.flatten(F.transform(orders, across))


def _added(a: Column, b: Column) -> Column:
    return F.struct(
        b["filter"].alias("filter"), b.step.alias("step"), b.filter_order.alias("filter_order"), *[(a[c] + b[c]).alias(c) for c in COUNTS]
    )


def order_audit(cells: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of `cells` (part,
    mask, n, good, toxic; bit i of a mask for letter i). A part has at most one cell per mask, which are put in one row."""
    orders = F.split(F.lit(" ".join("".join(o) for o in itertools.permutations(letters))), " ")
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    none = F.lit(0).cast("bigint")
    nothing = _folded(
        F.struct(F.lit(0).alias("mask"), none.alias("n"), none.alias("good"), none.alias("toxic")), orders, letters
    )
    merged = F.aggregate("cells", nothing, lambda acc, cell: F.zip_with(acc, _folded(cell, orders, letters), _added))
    place = lambda s: F.instr(F.lit(letters), s["filter"])
    zeros = F.array(*[none] * len(letters))
    by_filter = F.aggregate(
        "steps", zeros, lambda acc, s: F.transform(acc, lambda v, i: v + F.when(i + 1 == place(s), s.removed).otherwise(none))
    )
    rows = parts.select("part", merged.alias("steps")).withColumn("by_filter", by_filter)
    rows = rows.select("part", "by_filter", F.inline("steps"))
    shapley = F.element_at("by_filter", F.instr(F.lit(letters), F.col("filter")))
    return rows.select("part", "filter_order", "step", "filter", *COUNTS, shapley.alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per source of `docs` (doc_id, text, source), order of the filters ABCDE and step, zeros included.

    A: under 200 words; B: under half of the words different; C: over 2 % of the code points are A to Z; D: holds one of
    #$%&*|; E: the text of a row with a smaller doc_id, in any source, removed or not. Words are maximal runs of [^\\x20\\x09-\\x0D].
    Rows count, also repeated ones; rows with the same id and text don't repeat each other. A null text is empty (it fails A
    only, and E where an empty text has a smaller id), a null source is the empty string. A row without doc_id never fails E, nor does it make others
    fail it, and has no label. Where `labels` (doc_id, quality, toxic) has several rows of an id, one that says 1 counts. An
    empty table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    return order_audit(mask_cells(failure_masks(docs, scratch), labels))
