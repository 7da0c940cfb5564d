"""Token counts, packing, mixing and chat formatting."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from redactlake.llm import chat_format
from redactlake.llm.chat_format import FOLLOWS, ROLES, repaired_turns
from redactlake.llm.mixing import mix, mixed
from redactlake.llm.packing import Packer, pack
from redactlake.llm.token_counts import count_spliced, processor, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_token_counts(make, awkward):
    rows = [*awkward, (500, "<s> </s> a  b ▁ c ", "en", "a")]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, *_ in rows), key=str)
    got = token_counts(make(rows), PIECES, chunk=500, overlap=16)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_splices_equal_whole_encodings():
    library, stable = processor(PIECES)
    assert stable
    draw = random.Random(1)
    parts = ["a", "b", " ", "  ", "the", "\n", "\t", "▁", "é", "漢", " ", "<s>", "ing", ".", "🙂"]
    for _ in range(400):
        text = "".join(draw.choices(parts, k=draw.randrange(80)))
        assert count_spliced(library, text.encode(), draw.randrange(1, 20), draw.randrange(1, 6)) == len(library.encode(text))
    for text in ("x" * 3000, " " * 3000, "y" * 2000 + " z" * 2000):
        assert count_spliced(library, text.encode(), 100, 10) == len(library.encode(text))


def test_packing_is_a_round_trip(make, awkward):
    rows = [*awkward, (500, "x <|endoftext|> y 漢字 \x1c ² z", "en", "a")]
    library = Tokenizer.from_file(BYTES)
    want = defaultdict(int)
    for doc_id, text, *_ in rows:
        want[doc_id, tuple([*library.encode(text or "", add_special_tokens=False).ids, 1])] += 1
    got = pack(make(rows).coalesce(2), BYTES, group_tokens=5000, with_ids=True).toPandas()
    assert [zlib.crc32(np.asarray(ids, "<u4").tobytes()) for ids in got.ids] == got.ids_crc32.tolist()
    sequences = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert all((s.offset == s.length.cumsum() - s.length).all() for _, s in sequences)
    totals = sequences.length.sum()
    assert totals.max() <= 2048 and sum(0 if n & (n - 1) == 0 else 2048 - n for n in totals) <= 2 * 2048
    assert (got.groupby("step_group").length.sum() <= 1 << 16).all()
    once = {i for i, _ in want if i is not None and sum(n for (j, _), n in want.items() if j == i) == 1}
    for doc_id, ids in want:
        if doc_id in once:
            own = got[got.doc_id == doc_id].sort_values("start")
            assert [x for piece in own.ids for x in piece] == list(ids) and set(own.doc_tokens) == {len(ids)}
            assert own.start.tolist() == (own.length.cumsum() - own.length).tolist()
    assert got.length.sum() == sum(len(ids) * n for (_, ids), n in want.items())


def test_packer_fills_windows():
    draw = random.Random(4)
    packer = Packer((64, 32, 16, 8), 0)
    sizes = [draw.randrange(1, 200) for _ in range(300)]
    for number, size in enumerate(sizes):
        packer.add(number, size)
        if number % 50 == 0:
            packer.fill(keep_below=64)
    packer.fill(keep_below=0)
    filled, seen = defaultdict(int), defaultdict(set)
    for document, start, length, sequence, _, _ in packer.rows:
        filled[sequence] += length
        assert seen[document].isdisjoint(range(start, start + length))
        seen[document].update(range(start, start + length))
    assert [len(seen[i]) for i in range(300)] == sizes
    assert sum(n not in (8, 16, 32, 64) for n in filled.values()) <= 1


def plain_mix(rows):
    sizes = defaultdict(int)
    count = lambda text: len(re.findall("[^\x20\x09-\x0d]+", text or ""))
    for _, text, _, source in rows:
        sizes[source] += count(text)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        left = sum(sizes.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return sizes, target | share, count
        for s in over:
            target[s] = 3.0 * sizes[s]
            free.discard(s)


def test_mix(make, awkward):
    docs = make(awkward)
    sizes, target, count = plain_mix(awkward)
    source_of = {(row[0], count(row[1])): row[3] for row in awkward}
    got = mix(docs).collect()
    assert len(got) == len(awkward) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mix(docs.repartition(5)).collect()), key=str)
    taken = defaultdict(int)
    for row in got:
        source = source_of[row.doc_id, row.size]
        assert row.source_size == sizes[source] and row.target == pytest.approx(target[source]) and 0 <= row.taken <= 3 * row.size
        taken[source] += row.taken
    for source, words in taken.items():
        assert words == int(target[source] + 1e-9)
    whole = mixed(docs)
    assert whole.schema == docs.schema
    emitted = defaultdict(int)
    for row in whole.collect():
        emitted[row.source] += count(row.text)
        assert row.n_chars == len(row.text)
    assert all(abs(emitted[s] - taken[s]) <= 3 for s in taken)


def test_no_rows(empty):
    assert mix(empty).count() == 0 and mixed(empty).count() == 0
    assert token_counts(empty, PIECES).count() == 0 and pack(empty, BYTES).count() == 0


def cheapest(given):
    """Least cost of a repair, by trying everything."""
    best = {(0, 0): 0}
    for i in range(len(given) + 1):
        for _ in range(4):
            for state in range(4):
                for role in FOLLOWS[state] if (i, state) in best else ():
                    best[i, role] = min(best.get((i, role), 99999), best[i, state] + 2)
        if i < len(given):
            for state in range(4):
                for role in (1, 2, 3) if (i, state) in best else ():
                    label = 3 * (role != given[i])
                    for cost in ([label] if role in FOLLOWS[state] else []) + ([label + 1] if role == state else []):
                        best[i + 1, role] = min(best.get((i + 1, role), 99999), best[i, state] + cost)
    return best[len(given), 3]


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_repaired_turns(spark, coalesce):
    draw = random.Random(3)
    names = ["tool", "System ", "user", "assistant"]
    given = {k: [draw.choice([0, 1, 2, 3, 2, 3]) for _ in range(draw.randrange(1, 9) if k else 900)] for k in range(60)}
    rows = [(k, i, names[g], f"t{k}.{i} <|end|>", 1) for k, own in given.items() for i, g in enumerate(own)]
    draw.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        turns = repaired_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, part int"))
        got = turns.toPandas().sort_values(["conv_id", "turn"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k, own in got.groupby("conv_id"):
        text = "".join(own.rendered)
        roles = [ROLES.index(role) + 1 for role in re.findall(r"<\|(system|user|assistant)\|>\n", text)]
        assert all(b in FOLLOWS[a] for a, b in zip([0, *roles], roles, strict=False)) and roles[-1] == 3
        assert text.count("<|end|>") == len(roles)
        assert re.findall(r"t\d+\.\d+", text) == [f"t{k}.{i}" for i in range(len(given[k]))]
        assert own.cost.sum() == cheapest(given[k])


def test_awkward_turns(spark):
    rows = [(1, None, None, None), (1, 1, "user", "a"), (1, 1, "user", "a"), (None, 3, "user", "b"), (None, None, "assistant", "c")]
    got = repaired_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert got.count() == 5
    rendered = "".join(row.rendered for row in got.where("conv_id = 1").orderBy("turn", "role").collect())
    assert rendered.count("<|assistant|>") >= 1
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert repaired_turns(empty).count() == 0
    assert chat_format.STEPS[2][0, 2] == (0, (), False)
