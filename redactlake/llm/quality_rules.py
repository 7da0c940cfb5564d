"""Quality rules of documents: counts per text, and the perplexity of a byte n-gram model of the corpus (`byte_model`)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactlake.llm.base_rules import base_counts
from redactlake.llm.byte_model import beside, surprises
from redactlake.llm.store import Scratch

__all__ = ["base_counts", "quality_rules"]

#: Bands of so many languages are broadcast (some 100 bytes each); those of more are joined.
BROADCAST_LANGUAGES = 1 << 16


def quality_rules(
    docs: DataFrame, above: float = 3.0, below: float = 3.0, apart: float = 2.5, lone: float = 15.0, least: float = 0.02
) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, perplexity (per byte; null for empty texts), kept.

    kept is false where the base rules fail and where the perplexity leaves the bands of its language. Their middles are the medians
    of log2 perplexities of the documents that pass the base rules. A text's spread shrinks with the root of its length; its
    scale is the median deviation times that root. Upwards, a band reaches `above` spreads and `least` more. Downwards it reaches
    `below` spreads and `least` more in the perplexity after at most two bytes, since longer contexts know clean texts with near
    copies by heart. The first may lie at most `apart` spreads and `least` more nearer to the second than usual: where words are no
    words, longer contexts tell little. By counts less the one that a text adds itself, it reaches `lone` spreads and `least` more, for
    texts of a kind of their own. Every language has its own model and bands; null counts as the language of empty name.
    Null texts count as empty; of texts that are no UTF-8, each broken part counts as one character in word_chars.
    Repeated rows get the same result; other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    keyed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
    )
    measured = scratch.keep(surprises(keyed, scratch), "measured")
    judged = {"up": F.col("surprise"), "down": -F.col("near_surprise"), "near": F.col("surprise") - F.col("near_surprise")}
    judged["lone"] = F.col("lone_surprise")
    passing = measured.where("not base_failed")
    middles = passing.groupBy("lang").agg(*[F.percentile_approx(v, 0.5, 10_000).alias(f"{c}_middle") for c, v in judged.items()])
    off = {c: v - F.col(f"{c}_middle") for c, v in judged.items()}
    deviations = (
        beside(passing, scratch.keep(middles, "middles"), BROADCAST_LANGUAGES)
        .groupBy("lang")
        .agg(
            *[F.first(f"{c}_middle").alias(f"{c}_middle") for c in off],
            *[F.percentile_approx(F.abs(o) * F.sqrt("n_grams"), 0.5, 10_000).alias(f"{c}_deviation") for c, o in off.items()],
        )
    )
    root, inside = F.sqrt(F.greatest(F.col("n_grams"), F.lit(1))), F.lit(True)
    for (c, o), reach in zip(off.items(), (above, below, apart, lone), strict=True):
        inside &= o <= reach * F.lit(1.4826) * F.col(f"{c}_deviation") / root + least
    return beside(measured, scratch.keep(deviations, "bands"), BROADCAST_LANGUAGES).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.pow(F.lit(2.0), "surprise").alias("perplexity"),
        (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"),
    )
