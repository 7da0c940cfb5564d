"""Quality of whole texts by a convolutional network over bytes, in numpy.

A byte is a learnt vector; filters over WIDTH bytes, every STEP bytes, give activations; these are max-pooled over chunks of
CHUNK_BLOCKS blocks that overlap by one block and cover the whole text; mean and maximum over all chunks go into one
probability. The network is fitted in the driver on a bounded sample of labelled rows and sent to the tasks (some 20 kB).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactlake.llm.labelled import fitting_rows, held_out
from redactlake.llm.store import small_batches
from redactlake.llm.texts import encoded, slices

WIDTH, STEP, BLOCK, CHUNK_BLOCKS = 12, 4, 64, 4
VECTOR, FILTERS = 6, 24
CHUNK_STRIDE = CHUNK_BLOCKS - 1


class Network:
    """Parameters: byte vectors, filters with their bias, weights of the pooled activations with their bias."""

    def __init__(self, seed: int = 0):
        draw = np.random.default_rng(seed)
        self.vectors = draw.normal(0, 0.5, (256, VECTOR)).astype(np.float32)
        self.filters = draw.normal(0, (2 / (WIDTH * VECTOR)) ** 0.5, (WIDTH * VECTOR, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = draw.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.bias, self.out, self.shift]

    def pooled(self, texts: list[bytes]) -> dict:
        """All chunks of all texts: maxima of the activations and where they are, and the first chunk of each text."""
        sizes = np.array([-(-(len(text) + WIDTH) // BLOCK) for text in texts])  # in blocks, with zeros at the end
        ends = np.cumsum(sizes)
        data = np.zeros(int(ends[-1]) * BLOCK + WIDTH, np.uint8)
        for text, end, size in zip(texts, ends.tolist(), sizes.tolist(), strict=True):
            data[(end - size) * BLOCK : (end - size) * BLOCK + len(text)] = np.frombuffer(text, np.uint8)
        flat = self.vectors[data].reshape(-1)
        count = int(ends[-1]) * BLOCK // STEP
        strides = (STEP * VECTOR * flat.itemsize, flat.itemsize)
        windows = np.lib.stride_tricks.as_strided(flat, (count, WIDTH * VECTOR), strides)
        active = np.maximum(np.ascontiguousarray(windows) @ self.filters + self.bias, 0)
        per_block = BLOCK // STEP
        blocks = active.reshape(-1, per_block, FILTERS)
        block_best = blocks.argmax(1)
        block_max = np.take_along_axis(blocks, block_best[:, None], 1)[:, 0]
        chunks = np.maximum(1, -(-(sizes - 1) // CHUNK_STRIDE))
        chunk_ends = np.cumsum(chunks)
        number = np.arange(int(chunk_ends[-1])) - np.repeat(chunk_ends - chunks, chunks)  # within its text
        begin = np.repeat(ends - sizes, chunks) + number * CHUNK_STRIDE
        members = np.minimum(begin[:, None] + np.arange(CHUNK_BLOCKS), np.repeat(ends, chunks)[:, None] - 1)
        own = block_max[members]
        best = own.argmax(1)
        block = np.take_along_axis(members, best, 1)
        return {
            "max": np.take_along_axis(own, best[:, None], 1)[:, 0],
            "window": block * per_block + np.take_along_axis(block_best, block, 0),
            "first": chunk_ends - chunks,
            "chunks": chunks,
            "data": data,
        }

    def features(self, pool: dict) -> np.ndarray:
        mean = np.add.reduceat(pool["max"], pool["first"], axis=0) / pool["chunks"][:, None]
        return np.hstack([mean, np.maximum.reduceat(pool["max"], pool["first"], axis=0)])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        logits = self.features(self.pooled(texts)).astype(np.float64) @ self.out + self.shift[0]
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))

    def gradients(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        pool = self.pooled(texts)
        features = self.features(pool)
        logits = features @ self.out + self.shift[0]
        error = ((1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels) * weights).astype(np.float32)
        back = error[:, None] * self.out
        of = np.repeat(np.arange(len(texts)), pool["chunks"])
        top = pool["max"] == features[of, FILTERS:]  # the chunks that hold a text's maximum
        share = np.add.reduceat(top.astype(np.float32), pool["first"], axis=0)
        chunk = back[of, :FILTERS] / pool["chunks"][of, None] + np.where(top, back[of, FILTERS:] / share[of], 0)
        chunk *= pool["max"] > 0
        used, filters = np.nonzero(chunk)
        amount = chunk[used, filters]
        bytes_at = pool["data"][pool["window"][used, filters][:, None] * STEP + np.arange(WIDTH)]
        inputs = self.vectors[bytes_at].reshape(len(used), -1)
        to_filters = np.zeros_like(self.filters)
        for f in range(FILTERS):
            to_filters[:, f] = amount[filters == f] @ inputs[filters == f]
        to_inputs = (self.filters.T[filters] * amount[:, None]).reshape(-1, VECTOR)
        to_vectors = np.stack(
            [np.bincount(bytes_at.ravel(), to_inputs[:, v], minlength=256) for v in range(VECTOR)], 1
        )
        return [
            to_vectors.astype(np.float32),
            to_filters,
            np.bincount(filters, amount, minlength=FILTERS).astype(np.float32),
            (error @ features).astype(np.float32),
            np.array([error.sum()], np.float32),
        ]


def fit(
    rows: list[tuple[bytes, int]], seen: int = 10_000, batch: int = 32, rate: float = 0.015, seed: int = 0
) -> Network:
    """A network by Adam over about `seen` rows, repeats counted; the rarer label weighs more, by the root of the shares'
    ratio. Without rows of both labels it scores 0.5 for every text, or near the only label seen."""
    network = Network(seed)
    labels = np.array([label for _, label in rows], np.float32)
    if len(set(labels.tolist())) < 2:
        network.out[:] = 0
        network.shift[:] = 0 if not rows else 4 * (2 * labels[0] - 1)
        return network
    share = labels.mean()
    weights = np.where(labels == 1, (1 - share) ** 0.5, share**0.5)
    weights /= weights.mean()
    draw = np.random.default_rng(seed)
    parameters = network.parameters()
    mean, square = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    passes = -(-seen // len(rows))
    step, steps = 0, passes * -(-len(rows) // batch)
    for _ in range(passes):
        order = draw.permutation(len(rows))
        for begin in range(0, len(rows), batch):
            own = order[begin : begin + batch]
            step += 1
            now = rate * (1 - (step - 1) / steps)
            for p, g, m, s in zip(
                parameters, network.gradients([rows[i][0] for i in own], labels[own], weights[own]), mean, square, strict=True
            ):
                g = g / len(own)
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return network


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    modulus: int = 3,
    rest: int = 1,
    fit_rows: int = 3000,
    fit_bytes: int = 1 << 14,
    result_name: str = "quality_result",
) -> DataFrame:
    """The rows of `docs` (doc_id, text, ...) with held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 if score
    is at least 0.5) in the struct `result_name`, which no column of `docs` may have as its name.

    Fitted on at most `fit_rows` labelled rows of at most `fit_bytes` bytes that aren't held out; every whole text is scored.
    Null and empty texts are scored as a text of zero bytes. Repeated rows get the same score; columns other than doc_id and
    text have no part in it. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    network = fit([(t.encode(), y) for t, y in fitting_rows(docs, labels, label, modulus, rest, fit_rows, fit_bytes)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                scores = network.scores(encoded(part.column("text")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], [*part.schema.names, "score"])

    text = F.col("text").cast("string").alias("text")
    rest_of = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.lit(1).alias("_"))
    rows = docs.select("doc_id", text, rest_of.alias("rest"))
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    scored = rows.mapInArrow(score, schema)
    result = F.struct(
        held_out(modulus, rest).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
    columns = [F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return scored.select(*columns, result.alias(result_name))
