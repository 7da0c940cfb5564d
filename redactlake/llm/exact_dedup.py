"""Exact duplicates by sorting the contents.

Normalised texts are dealt to partitions by sampled splitters over (first bytes, digest, id), sorted there by Spark's
external sort, and compared in full with their neighbour. As the id is part of the splitters' key, a text that a third of
all rows hold is spread over many partitions; what a run has beyond its partition is put together from the first and the
last run of each partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactlake.llm.members import likely_members
from redactlake.llm.store import Scratch
from redactlake.llm.texts import encoded, slices

LOCAL = "doc_id bigint, text_sha256 string, local_keep bigint, local_size bigint, lead boolean, part int, edge string"
HEAD_BYTES = 32


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the first bytes and the digest of the normalised text; the text itself goes on as it is."""
    for batch in batches:
        for part in slices(batch, "text"):
            texts = [text.lower() for text in encoded(part.column("text"))]
            heads = pa.array([text[:HEAD_BYTES] for text in texts], pa.binary())
            digests = pa.array([hashlib.sha256(text).digest() for text in texts], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*part.columns, heads, digests], [*part.schema.names, "head", "digest"]
            )


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text, ...) with equal texts next to each other, the largest id first, over all partitions."""
    order = ["head", "digest", F.col("doc_id").desc_nulls_last()]
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("head binary, digest binary").fields])
    return rows.mapInArrow(_keyed, schema).repartitionByRange(*order).sortWithinPartitions(*order)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal texts in one sorted partition. Holds the ids and digests of the partition, and two texts."""
    ids: list[int | None] = []
    digests: list[bytes] = []
    runs: list[int] = []
    before, run = None, -1
    for batch in batches:
        for part in slices(batch, "text"):
            ids += part.column("doc_id").to_pylist()
            keys = part.column("digest").to_pylist()
            for text, digest in zip(encoded(part.column("text")), keys, strict=True):
                if (text := text.lower()) != before:
                    run, before = run + 1, text
                    digests.append(digest)
                runs.append(run)
    of = np.asarray(runs, np.int64)
    sizes, firsts = np.bincount(of), np.flatnonzero(np.diff(of, prepend=-1))
    lead = np.zeros(len(of), bool)
    lead[firsts] = True
    for begin in range(0, len(ids), 50_000):
        own = of[begin : begin + 50_000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids[begin : begin + 50_000], pa.int64()),
                pa.array([digests[r].hex() for r in own.tolist()]),
                pa.array([ids[i] for i in firsts[own].tolist()], pa.int64()),
                pa.array(sizes[own], pa.int64()),
                pa.array(lead[begin : begin + 50_000]),
                pa.array(np.full(len(own), TaskContext.get().partitionId(), np.int32)),
                pa.array([("f" if r == 0 else "") + ("l" if r == run else "") for r in own.tolist()]),
            ],
            [field.split()[0] for field in LOCAL.split(", ")],
        )


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            digests = [hashlib.sha256(text.lower()).hexdigest() for text in encoded(part.column("text"))]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(digests)], [*part.schema.names, "sha"])


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null and empty are equal. The largest doc_id of a group stays; a
    null id counts as smaller than any other. Of rows that repeat the largest id one stays. Other columns are ignored. An
    empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    local = scratch.keep(_sorted(rows).select("doc_id", "text", "digest").mapInArrow(_runs, LOCAL), "local")
    # a run at the edge of its partition may go on in the next one: at most two rows a partition
    edges = local.where("lead and edge != ''")
    whole = (
        edges.groupBy("text_sha256")
        .agg(
            F.min_by("local_keep", "part").alias("whole_keep"),
            F.sum("local_size").alias("whole_size"),
            F.min("part").alias("whole_part"),
            F.count("*").alias("parts"),
        )
        .where("parts > 1")
    )
    fixes = edges.join(whole, "text_sha256").select("part", "edge", "whole_keep", "whole_size", "whole_part")
    within = F.col("whole_part").isNull()
    return local.join(F.broadcast(fixes), ["part", "edge"], "left").select(
        "doc_id",
        F.when(within, F.col("local_keep")).otherwise(F.col("whole_keep")).alias("keep_id"),
        F.coalesce("whole_size", "local_size").alias("group_size"),
        (F.col("lead") & (within | (F.col("whole_part") == F.col("part")))).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, all columns as they were: exactly one of each group of `exact_groups`.

    Most rows are told by their id not to be dropped and are passed on without a shuffle; only the others, and rows without
    id, are joined with the groups.
    """
    groups = exact_groups(docs)
    dropped = groups.where("not kept and doc_id is not null").select("doc_id").distinct()
    certain = likely_members(docs, "doc_id", dropped, others=True)
    doubtful = likely_members(docs, "doc_id", dropped).unionByName(docs.where("doc_id is null"))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rows = doubtful.select("doc_id", F.col("text").cast("string").alias("text"), F.struct(*rest, F.lit(1).alias("_")).alias("rest"))
    schema = T.StructType([*rows.schema.fields, T.StructField("sha", T.StringType())])
    kept = groups.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha"))
    single = rows.mapInArrow(_digested, schema).join(kept, same, "left_semi").dropDuplicates(["doc_id", "sha"])
    columns = [F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return certain.unionByName(single.select(*columns))
