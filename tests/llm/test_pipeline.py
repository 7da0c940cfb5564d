"""The pipeline's stages, one after the other."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from redactlake.llm.exact_dedup import exact_groups
from redactlake.llm.mixing import mix
from redactlake.llm.ngram_join import ngram_links
from redactlake.llm.quality_classifier import quality_scores
from redactlake.llm.queries import oracle_sql, queries


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, sf_dir)
    low = {r.doc_id for r in quality_scores(docs, labels).where("quality_result.score < 0.2").collect()}
    assert good.schema == docs.schema and {r.doc_id for r in good.collect()} == {r.doc_id for r in docs.collect()} - low and low
    single = stages["exact dedup"](spark, good, sf_dir)
    kept = {r.doc_id for r in exact_groups(good).where("kept").collect()}
    assert single.schema == docs.schema and {r.doc_id for r in single.collect()} == kept and len(kept) < good.count()
    apart = stages["n-gram Jaccard join"](spark, single, sf_dir)
    firsts = {r.component_id for r in ngram_links(single, 5, 80).collect()}
    assert apart.schema == docs.schema and {r.doc_id for r in apart.collect()} == firsts
    blend = stages["mixing to target weights"](spark, apart, sf_dir)
    taken = sum(r.taken for r in mix(apart).collect())
    assert blend.schema == docs.schema and sum(len((r.text or "").encode().split()) for r in blend.collect()) == taken
    pieces = stages["packing"](spark, blend, sf_dir)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sum(1 + len(library.encode(r.text or "", add_special_tokens=False).ids) for r in blend.collect())
    assert sum(r.length for r in pieces.collect()) == tokens
    assert [r for r in corpus_pipeline.run(spark, sf_dir).groupBy().sum("length").collect()][0][0] == tokens


def test_stages_keep_columns_that_clash(spark, sf_dir):
    """Columns with the names that stages use inside come out as they went in, with null and empty texts and repeated rows."""
    names = ["_place", "_taken", "_size", "_epoch", "_cut", "_doc_id", "copy_id", "quality_result", "_no_source", "key", "rest", "score"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.limit(3).selectExpr("doc_id + 10000000 as doc_id", "cast(null as string) as text").unionByName(
        docs.limit(3).selectExpr("doc_id + 20000000 as doc_id", "'' as text")
    )
    docs = docs.unionByName(odd, allowMissingColumns=True).unionByName(docs.limit(5))
    docs = docs.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert [c for c in docs.columns if c in names] == names, name
        wrong = F.exists(F.array(*[~F.col(f"`{n}`").eqNullSafe(F.concat(F.lit(f"{n} "), F.col("doc_id"))) for n in names]), lambda x: x)
        assert docs.where(wrong).count() == 0 < docs.count(), name


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0, name


def test_registered_queries():
    names = list(queries())
    assert [int(name[2:].split("_")[0]) for name in names] == list(range(1, 14))
    assert set(oracle_sql()) <= set(names)


def test_quality_stage_takes_small_batches(spark):
    """The first stage has no intermediate tables, and scores whole texts all the same."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "10000")
    try:
        docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
        labels = spark.createDataFrame([(2, 1)], "doc_id bigint, quality int")
        assert quality_scores(docs, labels).count() == 2
        assert spark.conf.get(name) == "1000"
    finally:
        spark.conf.unset(name)
