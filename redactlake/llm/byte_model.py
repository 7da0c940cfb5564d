"""A modified Kneser-Ney model of byte n-grams, one per language, that grows with the corpus and never meets in one place.

Texts are dealt to blocks by their hash, so equal texts meet and count once. A block sends its different 5-grams, with their counts in
the texts that are learnt from, to the bucket of the two bytes before the last. So all n-grams of three and more bytes that a 5-gram
leads to meet in one bucket: it adds up the counts of all blocks, keeps them as sorted arrays, and counts from them the different bytes
in front that make the counts of the shorter n-grams. How many n-grams were counted once to four times, and the counts of pairs of
bytes, are summed over the buckets of a language; they give the three discounts of each order and the two lowest orders.

Buckets then answer each block with the logarithms for its 5-grams, and blocks score their texts. Arrays are compressed; nothing goes to
the driver but the names and sizes of the languages with at least a 256th of the corpus.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactlake.llm.base_rules import base_counts
from redactlake.llm.store import Scratch
from redactlake.llm.texts import encoded, slices

#: The length of the longest n-grams, the last byte included; the shortest whose context lies in one bucket; and the longest of the
#: second surprise, which a text that has near copies does not lower by much.
ORDER, LOCAL, NEAR = 5, 3, 3
BLOCK_BYTES, BUCKET_BYTES = 1 << 25, 1 << 26
#: Bytes of texts that a task holds before it sends them, that are sorted at once, and bytes of places in one row of a bucket.
PACK_BYTES, SORT_BYTES, ROW_BYTES = 1 << 26, 1 << 22, 1 << 26
#: The facts of so many languages are broadcast (some 1 MB each); those of more are joined.
BROADCAST_LANGUAGES = 64
#: Codes of the numbers of n-grams counted once to four times, after those of the pairs of bytes: four for each order from ORDER down.
PAIRS = 1 << 16
#: Bits of a logarithm behind the point, in 16 bits.
LOG_SCALE = 1 << 10
MEASURED = (
    "doc_id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, surprise double, near_surprise double, lone_surprise double, n_grams bigint"
)
PACK = "lang string, block int, buckets int, pack binary"
SENT = "bucket int, lang string, block int, keys binary, counts binary, size int"
COUNTED = (
    "lang string, bucket int, keys binary, counts binary, size int, "
    "blocks array<int>, sizes array<int>, places binary, codes array<int>, numbers array<bigint>"
)
ANSWER = "bucket int, lang string, block int, logs binary, size int"


def grams(text: bytes) -> np.ndarray:
    """The ORDER bytes up to each byte of a text and up to its end, as numbers; zero bytes stand beyond the text."""
    return np.concatenate([*gram_runs(text)])


def gram_runs(text: bytes) -> Iterator[np.ndarray]:
    """`grams` of a text, SORT_BYTES at a time."""
    own = np.zeros(len(text) + ORDER, np.uint8)
    own[ORDER - 1 : -1] = np.frombuffer(text, np.uint8)
    for begin in range(0, len(text) + 1, SORT_BYTES):
        part = own[begin : begin + SORT_BYTES + ORDER - 1]
        n = len(part) - ORDER + 1
        code = np.zeros(n, np.uint64)
        for i in range(ORDER):
            code = (code << np.uint64(8)) | part[i : i + n]
        yield code


def tail(code: np.ndarray, order: int) -> np.ndarray:
    return code & np.uint64((1 << 8 * order) - 1)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys, and the sum of the counts of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts[order], starts) if len(keys) else counts


def packed(values: np.ndarray) -> bytes:
    """Compressed, the bytes of equal weight together."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T) if len(values) else values
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpacked(data: bytes, kind: type, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Of ascending keys."""
    return packed(np.diff(keys, prepend=np.zeros(1, keys.dtype)))


def unpacked_keys(data: bytes, kind: type, n: int) -> np.ndarray:
    return np.cumsum(unpacked(data, kind, n), dtype=kind)


def bucket_table(buckets: int) -> np.ndarray:
    """The bucket of each pair of bytes."""
    mixed = (np.arange(PAIRS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(min(buckets, PAIRS))).astype(np.uint16)


def shorter(keys: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of `order` bytes at the end of longer ones by one byte: sorted, and how many different bytes were counted in front."""
    return summed(tail(keys, order), (counts > 0).astype(np.int64))


def seen_times(counts: np.ndarray) -> np.ndarray:
    """How many n-grams have a count of one, two, three and four."""
    return np.bincount(counts[(counts > 0) & (counts < 5)], minlength=5)[1:5]


def discounts(times: np.ndarray) -> np.ndarray:
    """What is taken off the counts zero, one, two and from three on; numbers that are missing count as one."""
    n = np.maximum(times, 1).astype(float)
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0, *np.clip([i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3)], 0.1, [0.9, 1.8, 2.7])])


def without_own(discount: np.ndarray) -> np.ndarray:
    """Discounts by which a text can't vouch for itself: one of each count is taken off first. For counts zero to three and from four."""
    return np.array([0.0, *(1 + discount)])


def level(keys: np.ndarray, counts: np.ndarray, discount: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The probabilities of sorted different n-grams of one order, all of whose contexts' counted n-grams are among them.

    `below` holds those of the n-grams shorter by the first byte; a context that was never counted leaves all to them.
    """
    context = keys >> np.uint64(8)
    starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    lengths = np.diff(starts, append=len(keys))
    taken = discount[np.minimum(counts, len(discount) - 1)]
    mass = np.repeat(np.add.reduceat(counts, starts), lengths)
    freed = np.repeat(np.add.reduceat(taken, starts), lengths)
    whole = np.maximum(mass, 1)
    return (counts - taken) / whole + np.where(mass > 0, freed / whole, 1.0) * below


def pair_probabilities(numbers: np.ndarray, altered=lambda discount: discount) -> np.ndarray:
    """Of all pairs of bytes, from how many different bytes were counted in front of each: the last byte after the first."""
    singles = (numbers.reshape(256, 256) > 0).sum(0)
    first, second = (altered(discounts(seen_times(n))) for n in (singles, numbers))
    lone = level(np.arange(256, dtype=np.uint64), singles, first, np.full(256, 1 / 256))
    return level(np.arange(PAIRS, dtype=np.uint64), numbers, second, np.tile(lone, 256))


def bucket_logs(keys: np.ndarray, counts: np.ndarray, facts: np.ndarray) -> list[np.ndarray]:
    """-log2, times LOG_SCALE, of the probabilities of a bucket's sorted ORDER-grams, of those of their last NEAR bytes, and of the
    first by the discounts `without_own`.

    `facts` holds the numbers for the PAIRS, then those of `seen_times` for each order from ORDER down to LOCAL.
    """
    levels = [(keys, counts)]
    for order in range(ORDER - 1, LOCAL - 1, -1):
        levels.append(shorter(*levels[-1], order))
    lowest = tail(levels[-1][0], 2).astype(np.int64)
    plain, alone = (pair_probabilities(facts[:PAIRS], *how)[lowest] for how in ((), (without_own,)))
    times = facts[PAIRS:].reshape(-1, 4)
    for order, (own, n), seen in zip(range(LOCAL, ORDER + 1), levels[::-1], times[::-1], strict=True):
        if order > LOCAL:
            at = np.searchsorted(last, tail(own, order - 1))
            plain, alone = plain[at], alone[at]
        discount, last = discounts(seen), own
        plain, alone = level(own, n, discount, plain), level(own, n, without_own(discount), alone)
        if order == NEAR:
            near = plain[np.searchsorted(own, tail(keys, NEAR))]
    return [np.minimum(np.rint(-np.log2(p) * LOG_SCALE), 65535).astype(np.uint16) for p in (plain, near, alone)]


def _pack_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = defaultdict(lambda: defaultdict(list)), 0
    names = [c.split()[0] for c in PACK.split(", ")]
    options = pa.ipc.IpcWriteOptions(compression="zstd")

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, block, buckets), texts in held.items():
            out = pa.BufferOutputStream()
            columns = [pa.array(list(texts.values()), pa.list_(pa.int64())), pa.array(list(texts), pa.large_binary())]
            rows = pa.RecordBatch.from_arrays(columns, ["ids", "text"])
            with pa.ipc.new_stream(out, rows.schema, options=options) as writer:
                writer.write_batch(rows)
            yield _table([(lang, block, buckets, out.getvalue().to_pybytes())], PACK).to_batches()[0]
        held.clear()

    for batch in batches:
        for part in slices(batch, "text"):
            keys = zip(*(part.column(c).to_pylist() for c in names[:-1]), strict=True)
            ids = part.column("doc_id").to_pylist()
            for key, doc_id, text in zip(keys, ids, encoded(part.column("text")), strict=True):
                held[key][text].append(doc_id)
                size += len(text)
            if size >= PACK_BYTES:
                yield from sent()
                size = 0
    yield from sent()


def _unpack(packs: pa.Table) -> dict[bytes, list[int | None]]:
    """The different texts of a block, with the ids of their rows."""
    found = defaultdict(list)
    for pack in packs.column("pack"):
        rows = pa.ipc.open_stream(pack.as_buffer()).read_all()
        for ids, text in zip(rows.column("ids").to_pylist(), rows.column("text").to_pylist(), strict=True):
            found[text] += ids
    return found


def block_grams(texts: Iterator[tuple[bytes, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted different ORDER-grams of a block's texts, and their counts in the texts that are learnt from."""
    pieces, held, size = [], ([], []), 0

    def flushed() -> None:
        for learnt, own in enumerate(held):
            if own:
                keys, counts = np.unique(np.concatenate(own), return_counts=True)
                pieces.append((keys, counts * learnt))
                own.clear()

    for text, learnt in texts:
        for run in gram_runs(text):
            held[learnt].append(run)
            size += len(run)
            if size >= SORT_BYTES:
                flushed()
                size = 0
    flushed()
    if not pieces:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return summed(np.concatenate([k for k, _ in pieces]), np.concatenate([c for _, c in pieces]))


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The buckets of sorted n-grams, and the places of each one's; they depend on the n-grams alone, so that a block that is asked
    again finds the answers in the same order."""
    at = bucket_table(buckets)[(keys >> np.uint64(8)).astype(np.uint16)]
    order = np.argsort(at, kind="stable")
    ends = np.searchsorted(at[order], np.arange(min(buckets, PAIRS) + 1))
    for bucket, (begin, end) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if begin < end:
            yield bucket, order[begin:end]


def _send(packs: pa.Table) -> pa.Table:
    lang, block, buckets = (packs.column(c)[0].as_py() for c in ("lang", "block", "buckets"))
    keys, counts = block_grams((text, not base_counts(text)[5]) for text in _unpack(packs) if text)
    out = [
        (bucket, lang, block, packed_keys(keys[own]), packed(counts[own].astype(np.uint32)), len(own))
        for bucket, own in by_bucket(keys, buckets)
    ]
    return _table(out, SENT)


def _count(sent: pa.Table) -> pa.Table:
    """The n-grams of one bucket of a language, their counts over all blocks, and where each block's are among them."""
    lang, bucket = sent.column("lang")[0].as_py(), sent.column("bucket")[0].as_py()
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    waiting, size = [], 0
    columns = [sent.column(c) for c in ("block", "keys", "counts", "size")]
    for i in range(len(sent)):
        _, own, n, length = (c[i].as_py() for c in columns)
        waiting.append((unpacked_keys(own, np.uint64, length), unpacked(n, np.uint32, length).astype(np.int64)))
        size += length
        if size >= max(SORT_BYTES, len(keys)) or i == len(sent) - 1:
            keys, counts = summed(*(np.concatenate([a, *b]) for a, b in zip((keys, counts), zip(*waiting, strict=True), strict=True)))
            waiting, size = [], 0
    levels = [(keys, counts)]
    for order in range(ORDER - 1, LOCAL - 1, -1):
        levels.append(shorter(*levels[-1], order))
    pairs, front = shorter(*levels[-1], 2)
    codes = [*pairs[front > 0].tolist(), *range(PAIRS, PAIRS + 4 * len(levels))]
    numbers = [*front[front > 0].tolist(), *np.concatenate([seen_times(n) for _, n in levels]).tolist()]
    model = (packed_keys(keys), packed(counts), len(keys))
    out, blocks, sizes, places = [], [], [], []

    def row() -> None:
        facts = ([], []) if out else (codes, numbers)
        out.append((lang, bucket, *model, blocks[:], sizes[:], packed(np.concatenate(places)), *facts))
        for held in (blocks, sizes, places):
            held.clear()

    for i in range(len(sent)):
        block, own, _, length = (c[i].as_py() for c in columns)
        at = np.searchsorted(keys, unpacked_keys(own, np.uint64, length)).astype(np.uint32)
        blocks.append(block)
        sizes.append(length)
        places.append(np.diff(at, prepend=np.uint32(0)))
        if 4 * sum(sizes) >= ROW_BYTES:
            row()
    if blocks:
        row()
    return _table(out, COUNTED)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block's n-grams in a bucket, the logarithms of their probabilities."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            facts = np.zeros(PAIRS + 4 * (ORDER - LOCAL + 1), np.int64)
            facts[row["all_codes"]] = row["all_numbers"]
            keys = unpacked_keys(row["keys"], np.uint64, row["size"])
            logs = bucket_logs(keys, unpacked(row["counts"], np.int64, row["size"]), facts)
            ends = np.cumsum(row["sizes"])
            places = np.split(unpacked(row["places"], np.uint32, int(ends[-1])), ends[:-1])
            for block, steps in zip(row["blocks"], places, strict=True):
                at = np.cumsum(steps, dtype=np.uint32)
                own = packed(np.concatenate([of[at] for of in logs]))
                yield _table([(row["bucket"], row["lang"], block, own, len(at))], ANSWER).to_batches()[0]


def _score(packs: pa.Table, answers: pa.Table) -> pa.Table:
    out, lang = [], packs.column("lang")[0].as_py()
    texts = _unpack(packs)
    codes, _ = block_grams((text, False) for text in texts if text)
    logs = np.zeros((3, len(codes)), np.uint16)
    told = {row["bucket"]: row for row in answers.to_pylist()}
    for bucket, own in by_bucket(codes, packs.column("buckets")[0].as_py()):
        logs[:, own] = unpacked(told[bucket]["logs"], np.uint16, 3 * told[bucket]["size"]).reshape(3, -1)
    for text, ids in texts.items():
        means, n = (None,) * 3, len(text) + 1 if text else 0
        if text:
            sums = np.zeros(3, np.int64)
            for run in gram_runs(text):
                sums += logs[:, np.searchsorted(codes, np.sort(run))].sum(1, dtype=np.int64)
            means = (sums / (LOG_SCALE * n)).tolist()
        counts = base_counts(text)
        out += [(doc_id, lang, *counts, *means, n) for doc_id in ids]
    return _table(out, MEASURED)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {
        "int": pa.int32(),
        "bigint": pa.int64(),
        "string": pa.string(),
        "binary": pa.binary(),
        "double": pa.float64(),
        "boolean": pa.bool_(),
        "array<int>": pa.list_(pa.int32()),
        "array<bigint>": pa.list_(pa.int64()),
    }
    fields = [tuple(c.split()) for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table([pa.array(v, kinds[k]) for v, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def beside(rows: DataFrame, languages: DataFrame, most: int) -> DataFrame:
    """`rows` with the columns of their language's row, which are broadcast if at most `most` languages have one."""
    few = languages.limit(most + 1).count() <= most
    return rows.join(F.broadcast(languages) if few else languages, "lang", "left")


def block_column(docs: DataFrame) -> tuple[F.Column, int]:
    """The block of each text within its language, and the bytes of all texts. Blocks follow the bytes of the language; languages with
    less than a 256th of all bytes are dealt as if they had that much."""
    bytes_of = docs.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"))
    total = bytes_of.agg(F.sum("bytes")).first()[0] or 0
    blocks = F.lit(1 + total // 256 // BLOCK_BYTES)
    for lang, size in bytes_of.where(F.col("bytes") * 256 >= total).collect():  # at most 256
        blocks = F.when(F.col("lang") == lang, F.lit(1 + size // BLOCK_BYTES)).otherwise(blocks)
    return F.pmod(F.xxhash64("text"), blocks).cast("int"), total


def surprises(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """MEASURED for each row of `docs` (doc_id, text and lang, both without nulls); surprise is bits a byte, null for empty texts;
    near_surprise is the same by at most NEAR - 1 bytes before each, lone_surprise by counts less the one of the text itself. Texts that pass the base rules are learnt from, equal ones once."""
    block, total = block_column(docs)
    buckets = F.lit(4 + total // BUCKET_BYTES).cast("int")
    dealt = docs.select("lang", block.alias("block"), buckets.alias("buckets"), "doc_id", "text")
    packs = dealt.mapInArrow(_pack_documents, PACK)
    sent = packs.groupBy("lang", "block").applyInArrow(_send, SENT)
    counted = scratch.keep(sent.groupBy("lang", "bucket").applyInArrow(_count, COUNTED), "counted")
    pairs = counted.select("lang", F.explode(F.arrays_zip("codes", "numbers")).alias("own")).groupBy("lang", "own.codes")
    facts = (
        pairs.agg(F.sum("own.numbers").alias("number"))
        .groupBy("lang")
        .agg(F.collect_list(F.struct("codes", "number")).alias("own"))  # at most PAIRS and a few
        .select("lang", F.col("own.codes").alias("all_codes"), F.col("own.number").alias("all_numbers"))
    )
    told = beside(counted.drop("codes", "numbers"), scratch.keep(facts, "facts"), BROADCAST_LANGUAGES)
    answers = told.mapInArrow(_answer, ANSWER)
    scored = packs.groupBy("lang", "block").cogroup(answers.groupBy("lang", "block"))
    return scored.applyInArrow(_score, MEASURED)
