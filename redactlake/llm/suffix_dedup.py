"""Removing passages that occur more than once, by sorting suffixes.

Where `depth` equal bytes start at two places, both belong to one bucket of suffixes: the bucket of the rarest-looking short string
(the one with the least hash) among those bytes. A text's neighbouring suffixes of one bucket form a segment. Equal segments are
counted before anything is sorted; buckets with one segment need no sorting, the others are sorted block by block with a
difference cover (`cover_sort`), so that a task holds one block of bounded size. Buckets with so many different segments
that they would exceed a block are dealt further, by a digest of the whole `depth` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactlake.llm.cover_sort import classes
from redactlake.llm.members import likely_members
from redactlake.llm.store import Scratch
from redactlake.llm.texts import encoded, raw, slices

DEPTH, GRAM = 400, 32
WINDOW = DEPTH - GRAM + 1
#: Bytes whose suffixes are looked at together; bytes of a block; different segments of a bucket that is sorted whole.
PIECE, BLOCK, SORTED_WHOLE = 1 << 19, 1 << 20, 2000
POSITION = np.uint64((1 << 24) - 1)
#: A segment: its bucket, the place of the bucket's string in the text, how far before it the first and the last suffix
#: start, and a digest of its bytes.
SEGMENT = np.dtype([("bucket", "<i8"), ("at", "<u4"), ("first", "<u2"), ("last", "<u2"), ("print", "S16")])
BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
BASE = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes from each place on."""
    hashes, width, power = BYTES[data], 1, BASE
    while width < GRAM:
        hashes = hashes[:-width] * np.uint64(power) + hashes[width:]
        width, power = 2 * width, power * power % (1 << 64)
    hashes ^= hashes >> np.uint64(31)
    return hashes * np.uint64(0xBF58476D1CE4E5B9)


def segments(data: np.ndarray, ends: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segments of texts data[begin:end], places counted from the start of `data`, and the text of each. At most PIECE and
    DEPTH bytes."""
    none = np.zeros(0, SEGMENT), np.zeros(0, np.int64)
    if len(data) < DEPTH:
        return none
    hashes = gram_hashes(data)
    least = (hashes & ~POSITION) | np.arange(len(hashes), dtype=np.uint64)  # of equal hashes the leftmost
    width = 1
    while 2 * width <= WINDOW:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[: len(hashes) - WINDOW + 1], least[WINDOW - width :])
    at = (least & POSITION).astype(np.int64)
    counts = np.maximum(ends - begins - DEPTH + 1, 0)  # suffixes with DEPTH bytes, per text
    of = np.repeat(np.arange(len(ends)), counts)
    if not len(of):
        return none
    suffix = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[of]
    at = at[suffix]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (of[1:] != of[:-1])]))
    last = np.append(new[1:], len(of)) - 1
    out = np.zeros(len(new), SEGMENT)
    out["bucket"] = hashes[at[new]].view(np.int64)
    out["at"] = at[new]
    out["first"], out["last"] = at[new] - suffix[new], at[new] - suffix[last]
    whole = memoryview(np.ascontiguousarray(data))
    spans = zip(suffix[new].tolist(), (suffix[last] + DEPTH).tolist(), strict=True)
    out["print"] = [xxhash.xxh3_128_digest(whole[a:b]) for a, b in spans]
    return out, of[new]


def text_segments(text: np.ndarray) -> np.ndarray:
    """The segments of one text of any length, piece by piece."""
    parts = []
    for begin in range(0, max(1, len(text) - DEPTH + 1), PIECE):
        own = text[begin : begin + PIECE + DEPTH - 1]
        found, _ = segments(own, np.array([len(own)]), np.array([0]))
        found["at"] += begin
        parts.append(found)
    return np.concatenate(parts)


def text_key(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", PIECE):
            data, offsets = raw(part.column("text"))
            data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
            if len(data) <= PIECE:
                found, of = segments(data, offsets[1:], offsets[:-1])
                found["at"] -= offsets[of].astype(np.uint32)
                cuts = np.searchsorted(of, np.arange(part.num_rows + 1))
                blobs = [found[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            else:
                blobs = [text_segments(data).tobytes()]
            texts = encoded(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("row_key"),
                    pa.array([text_key(text) for text in texts], pa.binary()),
                    pa.array([len(text) for text in texts], pa.int64()),
                    pa.array([hashlib.sha256(text).hexdigest() for text in texts]),
                    pa.array(blobs, pa.binary()),
                ],
                ["doc_id", "row_key", "text_key", "n_bytes", "sha256", "segments"],
            )


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 500):
            part = batch.slice(begin, 500)
            blobs = part.column("segments").to_pylist()
            found = np.frombuffer(b"".join(blobs), SEGMENT)
            of = np.repeat(np.arange(part.num_rows), [len(blob) // SEGMENT.itemsize for blob in blobs])
            prints = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(16), len(found), [None, pa.py_buffer(np.ascontiguousarray(found["print"]).tobytes())]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("text_key").take(pa.array(of)),
                    part.column("row_key").take(pa.array(of)),
                    pa.array(found["bucket"].astype(np.int64)),
                    pa.array(found["at"].astype(np.int64)),
                    pa.array(found["first"].astype(np.int32)),
                    pa.array(found["last"].astype(np.int32)),
                    prints.cast(pa.binary()),
                ],
                ["text_key", "row_key", "bucket", "at", "first", "last", "print"],
            )


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text is the wanted one, and not another one of the same id."""
    for batch in batches:
        same = [text_key(t) == k for t, k in zip(encoded(batch.column("text")), batch.column("text_key").to_pylist(), strict=True)]
        yield batch.filter(pa.array(same, pa.bool_())).select(["text_key", "text"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of segments, out of their text."""
    for batch in batches:
        for part in slices(batch, "text"):
            places = [part.column(c).to_pylist() for c in ("at", "first", "last")]
            texts = zip(encoded(part.column("text")), *places, strict=True)
            own = [text[at - first : at - last + DEPTH] for text, at, first, last in texts]
            names = ["bucket", "first", "last", "print", "copies", "different"]
            columns = [part.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own, pa.binary())], [*names, "bytes"])


FOUND = "bucket bigint, first int, last int, print binary, distances array<int>"


def _found(rows: list[tuple], distances: list[list[int]]) -> pa.RecordBatch:
    columns = list(zip(*[row[:4] for row in rows], strict=True))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(columns[0], pa.int64()),
            pa.array(columns[1], pa.int32()),
            pa.array(columns[2], pa.int32()),
            pa.array(columns[3], pa.binary()),
            pa.array(distances, pa.list_(pa.int32())),
        ],
        ["bucket", "first", "last", "print", "distances"],
    )


def _sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets of segments, block by block: which suffixes of each segment have an equal one."""
    held: list[tuple] = []
    size, bucket = 0, None

    def block() -> pa.RecordBatch:
        text = np.frombuffer(b"".join(row[5] for row in held), np.uint8)
        counts = np.array([row[1] - row[2] + 1 for row in held])
        begins = np.cumsum([0, *[len(row[5]) for row in held[:-1]]])
        of = np.repeat(np.arange(len(held)), counts)
        number = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        order, group = classes(text, begins[of] + number)
        copies = np.array([row[4] for row in held])
        segment = np.searchsorted(begins, order, "right") - 1
        again = np.bincount(group, copies[segment])[group] > 1
        mark = np.zeros(len(text), bool)
        mark[order[again]] = True
        marked = [
            [row[1] - i for i in np.flatnonzero(mark[b : b + c]).tolist()]
            for row, b, c in zip(held, begins.tolist(), counts.tolist(), strict=True)
        ]
        return _found(held, marked)

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("bucket", "first", "last", "print", "copies", "bytes")], strict=True):
            if row[0] != bucket and size >= BLOCK:
                yield block()
                held, size = [], 0
            bucket = row[0]
            held.append(row)
            size += len(row[5])
    if held:
        yield block()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each suffix of a segment, with a digest of its DEPTH bytes."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 200):
            part = batch.slice(begin, 200)
            out = []
            for row in zip(*[part.column(c).to_pylist() for c in ("bucket", "first", "last", "print", "copies", "bytes")], strict=True):
                whole = memoryview(row[5])
                for i in range(row[1] - row[2] + 1):
                    out.append((*row[:5], row[1] - i, xxhash.xxh3_128_digest(whole[i : i + DEPTH])))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
            names = ["bucket", "first", "last", "print", "copies", "distance", "suffix"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of texts of which the suffixes at `starts` occur again."""
    for batch in batches:
        for part in slices(batch, "text"):
            out = []
            for key, text, starts in zip(
                part.column("text_key").to_pylist(), encoded(part.column("text")), part.column("starts").to_pylist(), strict=True
            ):
                step = np.zeros(len(text) + 1, np.int64)
                np.add.at(step, np.array(starts, np.int64), 1)
                np.add.at(step, np.array(starts, np.int64) + DEPTH, -1)
                gone = np.cumsum(step)[:-1] > 0
                edges = np.diff(gone.astype(np.int8), prepend=0, append=0)
                begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                spans = [{"start": a, "end": b} for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                out.append((key, int(gone.sum()), hashlib.sha256(kept).hexdigest(), spans))
            columns = list(zip(*out, strict=True))
            kinds = [pa.binary(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["text_key", "removed", "left", "parts"]
            )


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_bytes (UTF-8), n_removed, n_spans, kept_sha256 (of the remaining
    bytes), spans (array of start, end: byte ranges that are removed).

    A byte is removed when a string of DEPTH bytes covers it that also starts at another place of any text, the same one included;
    strings are judged on the input and don't cross rows. Null counts as empty. Rows with equal texts, whatever their ids,
    are copies of each other: from DEPTH bytes on they are removed whole. Other columns are ignored; an empty table
    gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("row_key"), text)
    schema = "doc_id bigint, row_key bigint, text_key binary, n_bytes bigint, sha256 string, segments binary"
    profiles = scratch.keep(rows.mapInArrow(_profiles, schema), "profiles")
    narrow = scratch.keep(profiles.drop("segments", "row_key"), "narrow")
    schema = "text_key binary, row_key bigint, bucket bigint, at bigint, first int, last int, print binary"
    listed = profiles.where("length(segments) > 0").select("text_key", "row_key", "segments").mapInArrow(_listed, schema)
    often = scratch.keep(listed.groupBy("bucket").count().where("count > 1").select("bucket"), "often")
    again = listed.join(often, "bucket")
    # equal texts are one text from here on, with the number of its copies
    own = scratch.keep(
        again.groupBy("text_key", "bucket", "at", "first", "last", "print").agg(
            F.count("*").alias("copies"), F.min("row_key").alias("row_key")
        ),
        "own",
    )
    scratch.drop("profiles")
    identity = ["bucket", "first", "last", "print"]
    kinds = scratch.keep(
        own.groupBy(*identity).agg(
            F.sum("copies").alias("copies"), F.min(F.struct("text_key", "row_key", "at")).alias("sample")
        ),
        "kinds",
    )
    buckets = kinds.groupBy("bucket").agg(F.count("*").alias("different"))
    crowded = scratch.keep(buckets.where("different > 1"), "crowded")
    to_sort = scratch.keep(
        kinds.join(crowded, "bucket").select(*identity, "copies", "different", "sample.*"), "to-sort"
    )
    alone = own.where("copies = 1").select("text_key", "row_key", "bucket", "first", "last", "print", "at")
    wanted = scratch.keep(
        to_sort.select("text_key", "row_key").union(alone.select("text_key", "row_key")).groupBy("text_key").agg(F.min("row_key").alias("row_key")),
        "wanted",
    )
    texts = scratch.keep(
        likely_members(rows.select("row_key", "text"), "row_key", wanted.select("row_key")).join(wanted, "row_key").mapInArrow(_checked, "text_key binary, text string").dropDuplicates(["text_key"]),
        "texts",
    )
    cut = scratch.keep(
        to_sort.join(texts, "text_key").select(*identity, "copies", "different", "at", "text").mapInArrow(
            _cut, "bucket bigint, first int, last int, print binary, copies bigint, different bigint, bytes binary"
        ),
        "cut",
    )
    whole = cut.where(F.col("different") <= SORTED_WHOLE).drop("different")
    in_blocks = whole.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sorted_blocks, FOUND)
    schema = "bucket bigint, first int, last int, print binary, copies bigint, distance int, suffix binary"
    digested = cut.where(F.col("different") > SORTED_WHOLE).drop("different").mapInArrow(_digested, schema)
    digested = scratch.keep(digested, "digested")
    twice = digested.groupBy("bucket", "suffix").agg(F.sum("copies").alias("n")).where("n > 1").drop("n")
    twice = scratch.keep(twice, "twice")
    dealt = digested.join(twice, ["bucket", "suffix"]).groupBy(*identity).agg(F.collect_list("distance").alias("distances"))
    found = scratch.keep(in_blocks.unionByName(dealt).where("size(distances) > 0"), "found-again")
    # segments that occur as a whole more than once, without sorting
    copied = kinds.where("copies > 1").select(*identity, F.sequence("last", "first").alias("distances"))
    repeats = scratch.keep(
        found.join(copied.select(*identity), identity, "left_anti").unionByName(copied), "repeats"
    )
    starts = alone.join(repeats, identity).select("text_key", F.transform("distances", lambda d: F.col("at") - d).alias("starts"))
    starts = starts.groupBy("text_key").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    schema = "text_key binary, removed bigint, left string, parts array<struct<start: bigint, end: bigint>>"
    partly = scratch.keep(texts.join(starts, "text_key").mapInArrow(_removed, schema), "partly")
    several = scratch.keep(
        narrow.where(F.col("n_bytes") >= DEPTH).groupBy("text_key").count().where("count > 1").select("text_key", F.lit(True).alias("several")),
        "several",
    )
    all_rows = narrow.join(several, "text_key", "left").join(partly, "text_key", "left")
    gone = F.col("several").isNotNull()
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    everything = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end")))
    spans = F.when(gone, everything).otherwise(F.coalesce("parts", none))
    return all_rows.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.size(spans).cast("bigint").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("left", "sha256")).alias("kept_sha256"),
        spans.alias("spans"),
    )
