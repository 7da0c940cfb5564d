"""Registered queries of the operators, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.llm.chat_format import repaired_turns
from redactlake.llm.exact_dedup import exact_groups
from redactlake.llm.filter_audit import filter_audit
from redactlake.llm.hard_negatives import hard_negatives
from redactlake.llm.mixing import mix
from redactlake.llm.ngram_join import ngram_links
from redactlake.llm.packing import pack
from redactlake.llm.quality_classifier import quality_scores
from redactlake.llm.quality_rules import quality_rules
from redactlake.llm.simhash_dedup import near_fingerprints
from redactlake.llm.suffix_dedup import repeated_passages
from redactlake.llm.token_counts import token_counts
from redactlake.llm.toxicity import toxicity_scores


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_links(table(spark, sf_dir, "documents"), length=3, percent=90)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("spans")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "quality_result.*")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = repaired_turns(table(spark, sf_dir, "conversations"))
    return turns.withColumn("rendered_sha256", F.sha2("rendered", 256)).drop("rendered")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_fingerprints(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    registered = [
        op1_ngram_join,
        op2_suffix_dedup,
        op3_exact_dedup,
        op4_toxicity,
        op5_packing,
        op6_quality_classifier,
        op7_chat_format,
        op8_quality_rules,
        op9_token_counts,
        op10_mixing,
        op11_filter_audit,
        op12_simhash_dedup,
        op13_hard_negatives,
    ]
    return {query.__name__: query for query in registered}


OP3 = """
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from (
  select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, sha256(norm) as text_sha256
  from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm
        from documents)
  window same as (partition by norm))
"""


OP10 = """
with docs as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
         substr(md5(coalesce(doc_id::varchar, '')), 1, 15) as key, text
  from documents),
ranked as (
  select source, row_number() over (order by source nulls last) as rank, source_size
  from (select source, sum(size)::bigint as source_size from docs group by source)),
limited as (
  select *, 1 + (rank - 1) % 3 as weight, 3 * source_size as top, (3 * source_size)::double / (1 + (rank - 1) % 3) as reach
  from ranked),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(top) over (order by reach, rank rows between unbounded preceding and 1 preceding), 0))::double
         / sum(weight) over (order by reach, rank rows between current row and unbounded following) as level
  from limited),
targets as (
  select source, source_size,
         least(top::double, weight * (select level from levels where level <= reach order by reach, rank limit 1)) as target
  from levels)
select doc_id, size, source_size, target,
       (epochs * size + least(greatest(budget - epochs * source_size - earlier, 0), size))::bigint as taken
from (
  select doc_id, size, source_size, target, floor(target)::bigint as budget,
         case when source_size > 0 then floor(target)::bigint // source_size else 0 end as epochs,
         sum(size) over (partition by docs.source order by key, doc_id, size rows unbounded preceding) - size as earlier
  from docs join targets on docs.source is not distinct from targets.source)
"""


OP11 = """
with recursive docs as (
  select coalesce(source, '') as part, doc_id, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words
  from documents),
failing as (
  select part, doc_id,
         [len(words) < 200,
          100 * len(list_distinct(words)) < 50 * len(words),
          100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
          regexp_matches(text, '[#$%&*|]'),
          coalesce(doc_id > min(doc_id) over (partition by text), false)] as fails
  from docs),
cells as (
  select part, fails, count(*) as n, count(*) filter (doc_id in (select doc_id from labels where quality = 1)) as good,
         count(*) filter (doc_id in (select doc_id from labels where toxic = 1)) as toxic
  from failing group by part, fails),
orders as (
  select '' as filter_order
  union all
  select filter_order || letter from orders, (select unnest(['A', 'B', 'C', 'D', 'E']) as letter)
  where not contains(filter_order, letter)),
steps as (
  select filter_order, step::int as step, substr(filter_order, step, 1) as filter, ord(substr(filter_order, step, 1)) - 64 as own,
         list_transform(range(1, step), lambda j: ord(substr(filter_order, j, 1)) - 64) as earlier
  from orders, range(1, 6) r(step) where length(filter_order) = 5),
judged as (
  select part, filter_order, step, filter, n, good, toxic, fails[own] as failed,
         len(list_filter(earlier, lambda j: fails[j])) = 0 as there, len(list_filter(fails, lambda x: x)) = 1 as single
  from cells, steps),
summed as (
  select part, filter_order, step, filter, coalesce(sum(n) filter (there and not failed), 0)::bigint as kept,
         coalesce(sum(n) filter (there and failed), 0)::bigint as removed,
         coalesce(sum(n) filter (not there and failed), 0)::bigint as redundant,
         coalesce(sum(n) filter (failed and single), 0)::bigint as unique_fails,
         coalesce(sum(good) filter (there and failed), 0)::bigint as good_lost,
         coalesce(sum(toxic) filter (there and failed), 0)::bigint as toxic_lost
  from judged group by part, filter_order, step, filter)
select *, (sum(removed) over (partition by part, filter))::bigint as shapley from summed
"""


OP13 = """
with vecs as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id,
         list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::bigint as score
  from vecs a join vecs b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, rank::int as rank, vec_id as negative_id, positive_score, score as negative_score from (
  select anchor_id, positive_id, positive_score, vec_id, score,
         row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank
  from positives join scores using (anchor_id)
  where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
where rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3, "op10_mixing": OP10, "op11_filter_audit": OP11, "op13_hard_negatives": OP13}
