"""From raw documents to packed training sequences, in stages that are written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.llm.exact_dedup import keep_one
from redactlake.llm.mixing import mixed
from redactlake.llm.ngram_join import ngram_links
from redactlake.llm.packing import pack
from redactlake.llm.quality_classifier import quality_scores
from redactlake.llm.store import Scratch, free_name

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents below this quality score go. Lower than the classifier's own threshold, so that clean documents stay.
REJECT_BELOW = 0.2
#: Near copies: word n-grams of this length, and this similarity in percent.
NGRAM, PERCENT = 5, 80
TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It learns from the table labels. Null texts are judged as empty ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    name = free_name(docs, "quality_result")
    return quality_scores(docs, labels, result_name=name).where(F.col(name)["score"] >= REJECT_BELOW).drop(name)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text up to A-Z in lower case, the one with the largest id."""
    return keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of the n-gram join connect, the one with the smallest id. Rows without id stay."""
    name = free_name(docs, "copy_id")
    linked = ngram_links(docs, NGRAM, PERCENT)
    copies = linked.where("doc_id != component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(copies, F.col("doc_id") == F.col(name), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: documents once per epoch that it takes, the last one of a source cut."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences; a document that the mix takes several times is packed as often."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing to target weights", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{number}")
        if number:
            scratch.drop(f"stage-{number - 1}")
    return docs


#: Model scores and packing have no counterpart in SQL.
ORACLE_SQL = None
