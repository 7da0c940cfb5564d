"""Near duplicates by 64-bit fingerprints of word shingles that differ in few bits, found by Golay codes.

A fingerprint is cut into segments of 23, 23 and 18 bits. Of at most 4 differing bits, two segments together have at most 2,
and words of 23 bits at a distance of at most 2 have a codeword within distance 4 in common (golay.near_indices). Every fingerprint is
thus filed under each pair of segments and each pair of codeword indices near to them; linked fingerprints meet in a file at
least once, where they are compared bit by bit. So no link is lost.

Equal fingerprints are one class from the start. Files are dealt by sampled ranges of (key, fingerprint), so that a file with very
many fingerprints is spread. Files of a few give their linked pairs, others a spanning forest of their links, and those
that are large or at the edge of a partition are compared block by block, each pair of blocks giving a forest. The number of
links is in proportion to the rows filed, whatever the size of a group of near copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactlake.llm.components import components
from redactlake.llm.golay import near_indices
from redactlake.llm.store import Scratch
from redactlake.llm.texts import encoded, slices

SEED, BITS = 42, 64
#: The lowest bit and the width of the segments.
SEGMENTS = ((41, 23), (18, 23), (0, 18))
MOST_DIFFERING = 4
#: Fingerprints of a file that give all their pairs; of a file that is compared at once; of a block of a larger file.
SMALL_FILE, WHOLE_FILE, BLOCK = 8, 512, 2048
PIECE_BYTES = 1 << 20
_BLANK = regex.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """The text in pieces of about `size` bytes, cut at blanks only."""
    begin = 0
    while begin < len(text):
        blank = _BLANK.search(text, begin + size) if begin + size < len(text) else None
        end = blank.start() if blank else len(text)
        yield text[begin:end]
        begin = end


def fingerprint(text: bytes, length: int = 4, size: int = PIECE_BYTES) -> int:
    """Bit b is set if it is in over half of the XXH64 hashes of the text's shingles, repeats included."""
    counts, n, carry = np.zeros(BITS, np.int64), 0, []
    for piece in pieces(text, size):
        words = carry + piece.lower().split()
        if len(words) >= length:
            shingles = map(b" ".join, zip(*[words[i : len(words) - length + 1 + i] for i in range(length)], strict=True))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - length + 1)
            n += len(hashes)
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        carry = words[len(words) - length + 1 :] if len(words) >= length else words
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(carry), SEED) if carry else 0
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def _fingerprints(length: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                own = np.array([fingerprint(text, length) for text in encoded(part.column("text"))], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.view(np.int64))], ["doc_id", "print"])

    return prints


def file_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the files that each fingerprint (uint64) is in, and the position of the fingerprint."""
    near = [near_indices(((prints >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)) for low, width in SEGMENTS]
    keys, of = [], []
    for pair, (first, second) in enumerate(((0, 1), (0, 2), (1, 2))):
        (a, n_a), (b, n_b) = near[first], near[second]
        for i in range(a.shape[1]):
            for j in range(b.shape[1]):
                at = np.flatnonzero((n_a > i) & (n_b > j))
                keys.append((pair << 24) | (a[at, i] << 12) | b[at, j])
                of.append(at)
    return np.concatenate(keys), np.concatenate(of)


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 1000):
            prints = batch.column("print").to_numpy()[begin : begin + 1000]
            keys, of = file_keys(prints.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[of])], ["key", "print"])


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))


def forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of links that hold together what all links between the fingerprints hold together."""
    left, a, b = np.arange(len(prints)), [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            own = todo.pop()
            near = differing(prints[left], prints[own : own + 1]) <= MOST_DIFFERING
            if near.any():
                found = left[near]
                left = left[~near]
                a.append(np.full(len(found), own))
                b.append(found)
                todo += found.tolist()
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, print) to links (null, a, b) and to members of large files, and of those at the partition's edges, which
    may go on in another partition: (key, print, null)."""

    def judged(key: np.ndarray, own: np.ndarray, began: bool, ends: bool) -> pa.RecordBatch:
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(begins, len(key)))
        of = np.repeat(np.arange(len(begins)), sizes)
        away = sizes > WHOLE_FILE
        away[0] |= began
        away[-1] |= ends
        a, b = [], []
        at = np.flatnonzero(~away[of])
        linked = np.zeros(len(begins), bool)
        for gap in range(1, WHOLE_FILE):
            at = at[at + gap < len(key)]
            at = at[of[at] == of[np.minimum(at + gap, len(key) - 1)]]
            if not len(at):
                break
            near = at[differing(own[at], own[at + gap]) <= MOST_DIFFERING]
            few = sizes[of[near]] <= SMALL_FILE
            linked[of[near[~few]]] = True
            a.append(own[near[few]])
            b.append(own[near[few] + gap])
        for n in np.flatnonzero(linked).tolist():
            members = own[begins[n] : begins[n] + sizes[n]]
            x, y = forest(members)
            a.append(members[x])
            b.append(members[y])
        none = np.zeros(0, np.int64)
        a, b, sent = np.concatenate([none, *a]), np.concatenate([none, *b]), away[of]
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(key[sent])]),
                pa.concat_arrays([pa.array(a), pa.array(own[sent])]),
                pa.concat_arrays([pa.array(b), pa.nulls(int(sent.sum()), pa.int64())]),
            ],
            ["key", "a", "b"],
        )

    carry, began = (np.zeros(0, np.int64), np.zeros(0, np.int64)), True
    for batch in batches:
        key, own = (np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(carry, ("key", "print"), strict=True))
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if not cut and len(key) > 100_000:  # a file longer than some batches goes out as it comes
            yield judged(key, own, True, True)
            carry, began = (key[:0], own[:0]), True
            continue
        if cut:
            yield judged(key[:cut], own[:cut], began, False)
            began = False
        carry = key[cut:], own[cut:]
    if len(carry[0]):
        yield judged(*carry, began, True)


def _block_forest(group: pa.Table) -> pa.Table:
    prints = np.unique(group.column("print").to_numpy())
    a, b = forest(prints)
    return pa.table({"a": prints[a], "b": prints[b]})


def print_links(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) between different fingerprints of `prints` (print) that hold together all that differ in few bits."""
    filed = prints.mapInArrow(_filed, "key bigint, print bigint").repartitionByRange("key", "print")
    found = scratch.keep(
        filed.sortWithinPartitions("key", "print").mapInArrow(_links, "key bigint, a bigint, b bigint"), "found"
    )
    members = found.where("key is not null").select("key", F.col("a").alias("print"))
    blocks = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    placed = members.join(blocks, "key").withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    celled = placed.select("key", "print", "own", other.alias("other")).select(
        "key", "print", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    )
    # dealt anew: by the join all cells of a key would be in one task
    late = celled.repartition("key", "low", "high").groupBy("key", "low", "high").applyInArrow(_block_forest, "a bigint, b bigint")
    return found.where("key is null").select("a", "b").unionByName(late)


def near_fingerprints(docs: DataFrame, length: int = 4) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links
    reach, itself included).

    Shingles are `length` words [^\\x20\\x09-\\x0D]+ joined by spaces, A-Z in lower case, repeats included; a text with fewer words is one
    shingle, one without words (null, empty) has fingerprint zero and links like any other. Rows link when their
    fingerprints differ in at most 4 bits. Rows with the same doc_id but different fingerprints hold these together. A row without
    doc_id has the component of the rows with its fingerprint, or null. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    printed = scratch.keep(rows.mapInArrow(_fingerprints(length), "doc_id bigint, print bigint"), "prints")
    known = printed.where("doc_id is not null")
    reps = scratch.keep(known.groupBy("print").agg(F.min("doc_id").alias("rep")), "reps")
    links = scratch.keep(print_links(reps.select("print"), scratch).distinct(), "links")
    first, second = (reps.select(F.col("print").alias(c), F.col("rep").alias(f"rep_{c}")) for c in ("a", "b"))
    by_rep = links.join(first, "a").join(second, "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    several = known.groupBy("doc_id").agg(F.min("print").alias("least"), F.max("print").alias("most")).where("least != most")
    same_id = known.join(several, "doc_id", "left_semi").join(reps, "print").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reached = components(by_rep.unionByName(same_id), scratch, "components")
    classes = scratch.keep(
        reps.join(reached, F.col("rep") == F.col("id"), "left").select("print", F.coalesce("component", "rep").alias("component_id")),
        "classes",
    )
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    return printed.join(classes, "print", "left").select("doc_id", hexed, "component_id")
