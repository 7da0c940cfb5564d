"""Packing token sequences into windows of several context sizes.

Each task tokenizes its documents and packs them in groups of bounded size: whole windows of the longest size first, what is
left of a document is routed to the smallest size that holds it. Windows are then filled from the largest size down: a window
opens with the longest piece of its size, its gap takes the longest pieces that fit, of its own size or from shorter ones,
and what remains of the gap takes a cut from the longest piece left. So a window is full unless the group runs out; its rest
goes on into the task's next group, and the last one is split into windows of smaller powers of two. No shuffle is needed.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from redactlake.llm.texts import slices

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
    "window int, step_group bigint"
)
#: A character beyond those on which the pre-tokenizers of both libraries are known to agree.
UNCOMMON = re.compile("[^\\x00-\\x1b\\x20-ɏ‐-‧‰-⁞€]")


@functools.cache
def encoder(path: str):
    """Ids of texts as the tokenizers library gives them, one encoder per worker process.

    A byte-level vocabulary without normaliser is applied through tiktoken, which gives the same ids several times as
    fast; texts that hold an added token's string or uncommon characters go through the tokenizers library itself.
    """
    whole = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    byte_level = spec["pre_tokenizer"] == {
        "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True
    }
    added = [token["content"] for token in spec["added_tokens"]]

    def plain(text: str) -> list[int]:
        return whole.encode(text, add_special_tokens=False).ids

    if not byte_level or spec["normalizer"] or spec["model"]["type"] != "BPE":
        return plain
    # the printable stand-ins of the 256 bytes: those that print stand for themselves, the rest follow from 256 on
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printing]
    byte_of = {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("fast", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> list[int]:
        if UNCOMMON.search(text) or any(token in text for token in added):
            return plain(text)
        return fast.encode_ordinary(text)

    return ids


class Packer:
    """Windows of one task. `tiers` are powers of two, the longest first."""

    def __init__(self, tiers: tuple[int, ...], first_sequence: int):
        self.tiers, self.sequence = tiers, first_sequence
        self.rows: list[tuple] = []  # piece: its document's number, start, length, sequence, offset, window size
        self.waiting: list[list[tuple[int, int]]] = [[] for _ in range(tiers[0] + 1)]  # by length: (document, start)
        self.present = 0  # bit n: a piece of n tokens waits
        self.tokens = 0  # in all waiting pieces

    def add(self, document: int, tokens: int) -> None:
        longest = self.tiers[0]
        for start in range(0, tokens - longest + 1, longest):
            self._place([(document, start, longest)], longest)
        if tokens % longest:
            self._wait(document, tokens - tokens % longest, tokens % longest)

    def _wait(self, document: int, start: int, length: int) -> None:
        self.waiting[length].append((document, start))
        self.present |= 1 << length
        self.tokens += length

    def _take(self, most: int) -> tuple[int, int, int] | None:
        """The longest piece of at most `most` tokens."""
        if not (length := (self.present & ((2 << most) - 1)).bit_length() - 1) > 0:
            return None
        document, start = self.waiting[length].pop()
        if not self.waiting[length]:
            self.present ^= 1 << length
        self.tokens -= length
        return document, start, length

    def _place(self, pieces: list[tuple[int, int, int]], window: int) -> None:
        offset = 0
        for document, start, length in pieces:
            self.rows.append((document, start, length, self.sequence, offset, window))
            offset += length
        self.sequence += 1

    def fill(self, keep_below: int) -> None:
        """Packs what waits, tier by tier, until fewer than `keep_below` tokens wait."""
        for tier, shorter in zip(self.tiers, [*self.tiers[1:], 0], strict=True):
            while self.tokens >= max(tier, keep_below) and self.present >> (shorter + 1):
                self._window(tier)
        while self.tokens >= max(keep_below, 1):
            self._window(next((tier for tier in self.tiers if tier <= self.tokens), self.tiers[0]))

    def _window(self, tier: int) -> None:
        pieces, gap = [], tier
        while gap:
            piece = self._take(gap) or self._take(self.tiers[0])
            if piece is None:
                break
            document, start, length = piece
            if length > gap:  # cut: its rest waits in the tier of its new length
                self._wait(document, start + gap, length - gap)
                length = gap
            pieces.append((document, start, length))
            gap -= length
        self._place(pieces, tier)


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    tiers: tuple[int, ...] = (2048, 1024, 512, 256, 128, 64),
    group_tokens: int = 1 << 21,
    step_tokens: int = 1 << 16,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document of `docs` (doc_id, text): doc_id, start (its document's ids before it), length,
    ids_crc32 (unsigned, of its ids as little-endian 32-bit numbers), doc_tokens (with `end_id`), sequence_id, offset (in the
    sequence), window (the sequence's size) and step_group; with `with_ids` also the ids.

    A document's ids are those of the tokenizer file without special tokens, then `end_id`; null and empty texts have
    `end_id` alone. Each id lies in exactly one piece; repeated rows are packed each. A sequence holds at most `tiers[0]` tokens and
    fills its window, except for at most one of fewer than `tiers[-1]` tokens per task. Step groups hold sequences of one task,
    about `step_tokens` tokens each. Other columns are ignored; an empty table gives no pieces. A task holds the ids of
    `group_tokens` tokens or of one document.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer)
        packer = Packer(tiers, TaskContext.get().partitionId() << 33)
        held: dict[int, tuple[int | None, np.ndarray]] = {}  # of documents with a piece that isn't written yet
        seen, size, steps = 0, 0, packer.sequence

        def written() -> pa.RecordBatch:
            """The packed pieces, step groups dealt so that each has the same number of tokens."""
            nonlocal steps
            rows, packer.rows = sorted(packer.rows, key=lambda row: (-row[5], row[3], row[4])), []
            groups, filled, last = [], 0, None
            for row in rows:
                if row[3] != last:
                    if filled + row[5] > step_tokens:
                        steps, filled = steps + 1, 0
                    last, filled = row[3], filled + row[5]
                groups.append(steps)
            steps += 1
            ids = [held[row[0]][1][row[1] : row[1] + row[2]] for row in rows]
            columns = [
                pa.array([held[row[0]][0] for row in rows], pa.int64()),
                pa.array([row[1] for row in rows], pa.int64()),
                pa.array([row[2] for row in rows], pa.int64()),
                pa.array([zlib.crc32(part.tobytes()) for part in ids], pa.int64()),
                pa.array([len(held[row[0]][1]) for row in rows], pa.int64()),
                pa.array([row[3] for row in rows], pa.int64()),
                pa.array([row[4] for row in rows], pa.int64()),
                pa.array([row[5] for row in rows], pa.int32()),
                pa.array(groups, pa.int64()),
            ]
            names = [column.split()[0] for column in PIECES.split(", ")]
            if with_ids:
                columns.append(pa.array([part.astype(np.int32) for part in ids], pa.list_(pa.int32())))
                names.append("ids")
            still = {document for pieces in packer.waiting for document, _ in pieces}
            for document in [d for d in held if d not in still]:
                del held[document]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.asarray([*ids_of(text or ""), end_id], "<u4")
                    held[seen] = doc_id, ids
                    packer.add(seen, len(ids))
                    seen, size = seen + 1, size + len(ids)
                    if size >= group_tokens:
                        packer.fill(keep_below=tiers[0])
                        yield written()
                        size = 0
        packer.fill(keep_below=0)
        yield written()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(packed, PIECES + (", ids array<int>" if with_ids else ""))
