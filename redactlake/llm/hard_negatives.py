"""Hard negatives of anchors by exact integer products of tiles.

Anchors and candidates fall into blocks by a hash of their rows. A cell takes one block of each and multiplies them as
int64 tiles by Strassen's recursion, with zero padding where an extent is odd and exact additions. Anchors are a stated query
set, so that every pair of a block of anchors and a block of candidates is one cell. From a cell only heaps go on: of each
anchor its best rows of the same label, later of each anchor and positive the best rows in the window that the
positive's score opens. Heaps of the same key merge into one, inside a cell tile by tile, between cells by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactlake.llm.store import Scratch

#: Bytes of a block's components, most rows of a block, and the extent of a tile.
BLOCK_BYTES, BLOCK_ROWS, TILE = 1 << 24, 8192, 512
#: Products of extents up to this are multiplied plainly.
LEAF = 32


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices by seven products of halves; odd extents get a row or column of zeros. Arithmetic is
    that of int64, exact as long as the results fit and else modulo 2**64."""
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    if min(rows, inner, columns) <= leaf:
        return a @ b
    m, k, n = (rows + 1) // 2, (inner + 1) // 2, (columns + 1) // 2
    a = np.pad(a, ((0, 2 * m - rows), (0, 2 * k - inner)))
    b = np.pad(b, ((0, 2 * k - inner), (0, 2 * n - columns)))
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out[:rows, :columns]


class Heaps:
    """For each key (a small integer) its best `size` rows: highest score first, then smallest vec_id, then smallest uid."""

    def __init__(self, size: int):
        self.size = size
        self.keys = self.scores = self.ids = self.uids = np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        own = [np.concatenate(x) for x in ((self.keys, keys), (self.scores, scores), (self.ids, ids), (self.uids, uids))]
        order = np.lexsort((own[3], own[2], ~own[1], own[0]))  # ~x falls as x rises, also at the ends of int64
        keys = own[0][order]
        begins = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        place = np.arange(len(keys)) - np.maximum.accumulate(np.where(begins, np.arange(len(keys)), 0))
        self.keys, self.scores, self.ids, self.uids = (x[order[place < self.size]] for x in own)


def best(scores: np.ndarray, open_: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the open places that can be among a row's best `size`: those that reach its size-th best score."""
    if scores.shape[1] > size:
        floor = np.where(open_, scores, np.iinfo(np.int64).min)
        floor = np.partition(floor, -size, axis=1)[:, -size]
        open_ = open_ & (scores >= floor[:, None])
    return np.nonzero(open_)


def matrix(rows: pa.Table | pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors as rows of `width` components, shorter ones filled with zeros."""
    lists = rows.column("q")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _numbers(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy().astype(np.int64)


def _tiles(anchors: pa.Table, candidates: pa.Table, width: int) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Scores of all anchors of a cell with all its candidates, tile by tile."""
    a, b = matrix(anchors, width), matrix(candidates, width)
    for i in range(0, len(a), TILE):
        for j in range(0, len(b), 4 * TILE):
            yield slice(i, i + TILE), slice(j, j + 4 * TILE), strassen(a[i : i + TILE], np.ascontiguousarray(b[j : j + 4 * TILE].T))


def _positives(width: int, count: int):
    """The best `count` other rows of the same label of each anchor in a cell."""

    def find(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        uid, label = _numbers(anchors, "uid"), _numbers(anchors, "label")
        uids, ids, labels = (_numbers(candidates, c) for c in ("uid", "vec_id", "label"))
        heaps = Heaps(count)
        for i, j, scores in _tiles(anchors, candidates, width):
            same = (label[i][:, None] == labels[j]) & (uid[i][:, None] != uids[j])
            at, other = best(scores, same, count)
            heaps.add(at + i.start, scores[at, other], ids[j][other], uids[j][other])
        return pa.table({"uid": uid[heaps.keys], "score": heaps.scores, "id": heaps.ids, "other": heaps.uids})

    return find


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """The least and the most score s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def _negatives(width: int, count: int, low: int, high: int):
    """The best `count` rows of other labels in the window of each anchor and positive in a cell."""

    def find(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        label, positives = _numbers(anchors, "label"), anchors.column("positives").to_pylist()
        uids, ids, labels = (_numbers(candidates, c) for c in ("uid", "vec_id", "label"))
        most = max(map(len, positives), default=0)
        bounds = np.zeros((most, 2, len(positives)), np.int64)
        bounds[:, 0], bounds[:, 1] = 1, 0  # no window
        limits = np.iinfo(np.int64)
        for at, own in enumerate(positives):
            for n, positive in enumerate(own):
                least, top = window(positive["score"], low, high)
                if least <= top:
                    bounds[n, :, at] = max(least, limits.min), min(top, limits.max)
        heaps = Heaps(count)
        for i, j, scores in _tiles(anchors, candidates, width):
            differs = label[i][:, None] != labels[j]
            for n in range(most):
                inside = differs & (scores >= bounds[n, 0, i, None]) & (scores <= bounds[n, 1, i, None])
                at, other = best(scores, inside, count)
                heaps.add((at + i.start) * most + n, scores[at, other], ids[j][other], uids[j][other])
        at, n = np.divmod(heaps.keys, max(most, 1))
        uid = _numbers(anchors, "uid")[at]
        return pa.table({"uid": uid, "place": n.astype(np.int32), "score": heaps.scores, "id": heaps.ids, "other": heaps.uids})

    return find


def _first(heaps: DataFrame, by: list[str], count: int) -> DataFrame:
    """Merges heaps: of each key the best `count` rows, with their rank. Each task cuts its own rows first."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "other")
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def integer_rows(vectors: DataFrame, scale: int, shift_every: int, labels: int) -> DataFrame:
    """vec_id, label, q of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    vec_id, label = F.col("vec_id").cast("bigint"), F.col("label").cast("bigint")
    shifted = F.when(F.col("vec_id") % shift_every == 0, (label + 1) % labels).otherwise(label)
    q = F.transform(x, lambda c: F.floor(F.lit(scale) * c))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd)
    return rows.select(vec_id.alias("vec_id"), shifted.alias("label"), q.alias("q"))


def hard_negatives(
    vectors: DataFrame,
    anchor_every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    shift_every: int = 7,
    labels: int = 10,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of `vectors` (vec_id, embedding, label).

    Rows with a null label, a null vector, a null or non-finite component, or no vec_id take no part. Ids divisible by
    `shift_every` get the label (label + 1) modulo `labels`. Components are floor(scale * x). Anchors are the rows with ids
    divisible by `anchor_every`; scores are inner products, the higher the better, ties by smaller vec_id. An anchor's
    positives are its first other rows of the same label. Of each anchor and positive come the first `negatives` rows of
    other labels with low * positive_score <= 100 * score <= high * positive_score.

    Vectors of different lengths are filled with zeros; an empty one scores 0. Rows that repeat an id are rows of their own:
    a repeated anchor has its results as often, and its copy can be a positive. Integer components outside the range of bigint are its
    nearest end, and scores that don't fit are taken modulo 2**64. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "negatives")
    numbered = integer_rows(vectors, scale, shift_every, labels).withColumn("uid", F.monotonically_increasing_id())
    rows = scratch.keep(numbered.select("uid", "vec_id", "label", "q"), "rows")
    anchors = rows.where(F.col("vec_id") % anchor_every == 0)
    sizes = rows.agg(
        F.count("*").alias("n"), F.count_if(F.col("vec_id") % anchor_every == 0).alias("anchors"), F.max(F.size("q")).alias("width")
    ).first()
    width = max(sizes.width or 0, 1)
    block = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * width)))
    across, down = -(-max(sizes.n, 1) // block), -(-max(sizes.anchors, 1) // block)
    place = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.withColumn("column", place(across)).withColumn("row", every(down)).groupBy("row", "column")

    def cells(own: DataFrame):
        return own.withColumn("row", place(down)).withColumn("column", every(across)).groupBy("row", "column")

    found = cells(anchors).cogroup(candidates).applyInArrow(
        _positives(width, positives), "uid bigint, score bigint, id bigint, other bigint"
    )
    chosen = _first(found, ["uid"], positives)
    by_anchor = chosen.groupBy("uid").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("positive_id"), "score"))).alias("positives")
    )
    judged = scratch.keep(anchors.join(by_anchor, "uid"), "anchors")
    found = cells(judged).cogroup(candidates).applyInArrow(
        _negatives(width, negatives, low, high), "uid bigint, place int, score bigint, id bigint, other bigint"
    )
    of_each = judged.select("uid", F.col("vec_id").alias("anchor_id"), F.posexplode("positives").alias("place", "positive"))
    return _first(found, ["uid", "place"], negatives).join(of_each, ["uid", "place"]).select(
        "anchor_id",
        "positive.positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        F.col("positive.score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
