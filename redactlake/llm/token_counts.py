"""Token counts of whole texts, as the sentencepiece library gives them.

Huge texts are encoded in overlapping chunks and spliced where both encodings have a token boundary that is proven stable:
between a character that is no space and a following space. The proof is read off the vocabulary: no piece holds a space mark
after another character, so no merge crosses such a place and the encoding on either side doesn't depend on the other. If
an overlap has no such place, or the two encodings don't agree there, the overlap is widened and, in the end, covers the rest.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactlake.llm.texts import raw, slices

MARK = "▁"
COUNTED = "doc_id bigint, n_bytes bigint, n_tokens bigint"


@functools.cache
def processor(path: str) -> tuple[sentencepiece.SentencePieceProcessor, bool]:
    """The library's model, and whether places before a space are stable in it. One per worker process."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return model, not any(re.search(f"[^{MARK}]{MARK}", piece) for piece in pieces)


def stable_places(text: bytes, begin: int, end: int) -> Iterator[int]:
    """Places from `begin` to `end` of a space after a character that is neither a space nor its mark."""
    at = text.find(b" ", max(begin, 1), end)
    while at > 0:
        if text[at - 1] != 32 and not text.endswith(MARK.encode(), 0, at):
            yield at
        at = text.find(b" ", at + 1, end)


def whole_characters(text: bytes, at: int) -> int:
    """The first place from `at` on where a character begins."""
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return at


def count_spliced(model: sentencepiece.SentencePieceProcessor, text: bytes, chunk: int, overlap: int) -> int:
    """Tokens of `text` by chunks of about `chunk` bytes; equal to encoding it at once."""
    total, begin = 0, 0  # tokens before the last splice; its place
    while True:
        core, wide = whole_characters(text, begin + chunk), overlap
        while True:
            end = whole_characters(text, core + wide)
            if end >= len(text):
                return total + len(_starts(model, text, begin, len(text)))
            left, right = _starts(model, text, begin, end), _starts(model, text, core, end)
            agreed = set(left).intersection(right)
            if splice := next((at for at in stable_places(text, core + 1, end) if at in agreed), 0):
                break
            wide *= 4
        total += sum(start < splice for start in left)
        begin = splice


def _starts(model: sentencepiece.SentencePieceProcessor, text: bytes, begin: int, end: int) -> list[int]:
    """Where the tokens of text[begin:end] start, as places in `text`. The library puts a space mark in front of what it
    encodes; where a space stands there already, it is left out beforehand."""
    spaced = begin > 0 and text[begin] == 32
    if spaced and end - begin == 1:
        return [begin]
    starts = [begin + spaced + p.begin for p in _pieces(model, text[begin + spaced : end].decode())]
    return [begin, *starts[1:]] if spaced else starts


def _pieces(model: sentencepiece.SentencePieceProcessor, text: str):
    return model.encode(text, return_type="proto", num_threads=1).pieces


def token_counts(docs: DataFrame, model: str, chunk: int = 1 << 15, overlap: int = 1 << 8) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_bytes of UTF-8, n_tokens.

    Null and empty texts have 0 of both. Begin and end marks aren't counted and nothing is truncated. `model` is the path of
    a model file that every executor can read. Repeated rows are counted each; other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, stable = processor(model)
        for batch in batches:
            for part in slices(batch, "text"):
                _, offsets = raw(part.column("text"))
                huge = (offsets[1:] - offsets[:-1] > 2 * chunk) & stable
                texts = part.column("text").to_pylist()
                short = ["" if big or text is None else text for text, big in zip(texts, huge, strict=True)]
                tokens = [len(ids) for ids in library.encode(short, num_threads=1)]
                for i in huge.nonzero()[0].tolist():
                    tokens[i] = count_spliced(library, texts[i].encode(), chunk, overlap)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(offsets[1:] - offsets[:-1]), pa.array(tokens, pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, COUNTED)
