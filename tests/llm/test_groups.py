"""Exact groups, n-gram links and repeated passages against plain computations."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from redactlake.llm import cover_sort, ngram_join, suffix_dedup
from redactlake.llm.exact_dedup import exact_groups, keep_one
from redactlake.llm.ngram_join import Rule, bitmap, folded, ngram_links, ngram_set
from redactlake.llm.suffix_dedup import DEPTH, repeated_passages


def tuples(df):
    return sorted(map(tuple, df.collect()), key=str)


def ascii_lower(text):
    return (text or "").encode().lower()


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_exact_groups(spark, make, awkward, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        docs = make(awkward)
        got = tuples(exact_groups(docs))
        kept = keep_one(docs)
        kept_rows = kept.select("doc_id", "text").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = defaultdict(list)
    for doc_id, text, *_ in awkward:
        groups[ascii_lower(text)].append(doc_id)
    want = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, -(i or 0)))
        digest = hashlib.sha256(text).hexdigest()
        want += [(i, ids[0], len(ids), n == 0, digest) for n, i in enumerate(ids)]
    assert got == sorted(want, key=str)
    assert kept.schema == docs.schema
    assert Counter(ascii_lower(row.text) for row in kept_rows) == Counter(dict.fromkeys(groups, 1))
    assert {row.doc_id for row in kept_rows} == {row[0] for row in got if row[3]}


def test_exact_groups_of_one_hot_text(spark, make):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = make([(i, "The Same" if i % 3 else f"text {i}") for i in range(600)])
        got = exact_groups(rows).where("text_sha256 = sha2('the same', 256)").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {row.keep_id for row in got} == {599} and {row.group_size for row in got} == {400}
    assert [row.doc_id for row in got if row.kept] == [599]


def plain_links(rows, length, percent):
    """Union-find over all pairs; rows with the same id are one document."""
    sets = [(doc_id, ngram_set((text or "").encode(), length)) for doc_id, text, *_ in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            both = len(np.intersect1d(a, b))
            if i is not None and j is not None and len(a) and len(b):
                if 100 * both >= percent * (len(a) + len(b) - both):
                    low, high = sorted((top(i), top(j)))
                    parent[high] = low
    by_set = {}
    for i, a in sets:
        if i is not None and len(a):
            by_set.setdefault(a.tobytes(), top(i))
    return [(i, len(a), by_set.get(a.tobytes(), i) if len(a) else i) for i, a in sets]


@pytest.mark.parametrize(("length", "percent", "small"), [(3, 90, 8), (5, 80, 2), (2, 50, 3)])
def test_ngram_links(monkeypatch, make, awkward, length, percent, small):
    monkeypatch.setattr(ngram_join, "SMALL_TILE", small)
    monkeypatch.setattr(ngram_join, "TARGETS", 3000)
    monkeypatch.setattr(ngram_join, "PROBES", 1500)
    got = tuples(ngram_links(make(awkward), length, percent))
    assert got == sorted(plain_links(awkward, length, percent), key=str)
    assert any(row[2] != row[0] for row in got)


@pytest.mark.parametrize(("targets", "probes"), [(1 << 19, 1 << 18), (6000, 3000)])
def test_one_large_group_of_near_copies(spark, make, monkeypatch, targets, probes):
    """500 texts at some 80 % of each other: links are whole, and those between components stay fewer than the sets of the blocks."""
    monkeypatch.setattr(ngram_join, "TARGETS", targets)
    monkeypatch.setattr(ngram_join, "PROBES", probes)
    draw = np.random.default_rng(12)
    base = [f"w{n}" for n in range(120)]
    rows = []
    for i in range(500):
        words = list(base)
        for at in draw.choice(120, draw.integers(1, 4), replace=False):
            words[at] = f"x{draw.integers(10_000)}"
        rows.append((i, " ".join(words), "en", "a"))
    made = []
    block = ngram_join._crossed

    def counted(rule):
        made.append(rule)
        return block(rule)

    monkeypatch.setattr(ngram_join, "_crossed", counted)
    got = tuples(ngram_links(make(rows), 5, 80))
    assert made and got == sorted(plain_links(rows, 5, 80), key=str)
    assert 1 < len({row[2] for row in got}) < 500


def test_blocks_give_a_spanning_forest():
    draw = np.random.default_rng(13)
    rule = Rule(5, 80)
    base = np.unique(draw.integers(0, 1 << 63, 60).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[draw.random(len(base)) > 0.1], draw.integers(0, 1 << 63, 3).astype(np.uint64)])) for _ in range(80)]
    probe = np.arange(80) % 4 == 0
    labels = np.arange(80) // 2
    links = ngram_join.spanning(sets, labels, probe, rule)
    parents = [list(range(40)), list(range(40))]

    def top(parent, i):
        while parent[i] != i:
            i = parent[i]
        return i

    for p, t in links:
        assert probe[p] and not probe[t] and rule.linked(sets[p], sets[t])
        parents[0][top(parents[0], labels[p])] = top(parents[0], labels[t])
    for p in np.flatnonzero(probe):
        for t in np.flatnonzero(~probe):
            if rule.linked(sets[p], sets[t]):
                parents[1][top(parents[1], labels[p])] = top(parents[1], labels[t])
    groups = [{frozenset(i for i in range(40) if top(parent, i) == top(parent, j)) for j in range(40)} for parent in parents]
    assert groups[0] == groups[1] and len(links) == 40 - len(groups[0]) < 40


def test_signatures_keep_every_linked_pair():
    draw = np.random.default_rng(3)
    for percent in (60, 80, 90):
        rule = Rule(3, percent)
        for size in (1, 2, 5, 9, 10, 11, 30, 80, 400):
            for _ in range(20):
                a = np.unique(draw.integers(0, 1 << 63, size).astype(np.uint64))
                b = np.unique(np.concatenate([a[draw.random(len(a)) > 0.1], draw.integers(0, 1 << 63, size // 8).astype(np.uint64)]))
                same = np.intersect1d(rule.signatures(a), rule.signatures(b))
                assert len(same) or np.array_equal(a, b) or not rule.linked(a, b)


def test_bitmaps_bound_the_difference():
    draw = np.random.default_rng(4)
    for size in (1, 20, 300):
        a = np.unique(draw.integers(0, 1 << 63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[: size // 2], draw.integers(0, 1 << 63, 3 * size).astype(np.uint64)]))
        x, y = bitmap(a), bitmap(b)
        width = min(len(x), len(y))
        differ = int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_bitmaps_are_short_and_tell_sets_apart():
    """Some 1 bit per n-gram at 80 %: blocks send a bitmap for every member of every tile."""
    draw = np.random.default_rng(14)
    assert len(bitmap(np.arange(300, dtype=np.uint64))) == 64
    for percent in (50, 60, 80, 90, 100):
        rule = Rule(5, percent)
        for size in (120, 300, 2000):
            common, *own = (np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64)) for n in (size // 4, size, size))
            a, b = (np.union1d(common, x) for x in own)
            x, y = bitmap(a, rule.bits), bitmap(b, rule.bits)
            assert len(x) * 8 <= 2 * rule.bits * len(a)
            width = min(len(x), len(y))
            differ = int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum())
            assert rule.differing(len(a) + len(b)) < differ <= len(np.setxor1d(a, b))


def test_texts_are_sent_for_likely_pairs_only(monkeypatch, make):
    """60 texts share a passage in threes, which makes them candidates; one pair of them links."""
    draw = np.random.default_rng(15)

    def words(n):
        return [f"w{x}" for x in draw.integers(0, 1 << 40, n)]

    passages = [words(60) for _ in range(20)]
    texts = [[*words(30), *passages[i // 3], *words(30)] for i in range(60)]
    texts[1] = [*texts[0][:-2], "x", "y"]
    rows = [(i, " ".join(text), "en", "a") for i, text in enumerate(texts)]
    sent, members = [], ngram_join.likely_members

    def noted(frame, key, ids):
        out = members(frame, key, ids)
        if frame.columns == ["rep", "text"]:
            sent.append((frame.count(), out.count()))
        return out

    monkeypatch.setattr(ngram_join, "likely_members", noted)
    got = tuples(ngram_links(make(rows), 5, 80))
    assert got == sorted(plain_links(rows, 5, 80), key=str) and got[1][2] == 0
    assert sent and all(before > 20 and after < 10 for before, after in sent)


def plain_removal(rows):
    counts = Counter(
        data[p : p + DEPTH] for data in ((text or "").encode() for _, text, *_ in rows) for p in range(len(data) - DEPTH + 1)
    )
    out = []
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - DEPTH + 1):
            if counts[data[p : p + DEPTH]] > 1:
                gone[p : p + DEPTH] = True
        gone = gone[:-1]
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("whole", [2000, 2])
def test_repeated_passages(monkeypatch, make, awkward, whole):
    monkeypatch.setattr(suffix_dedup, "SORTED_WHOLE", whole)
    rows = [row for row in awkward if len(row[1] or "") < 5000] + [(300, "ab" * 900, "en", "a"), (301, "xab" * 500, "en", "a")]
    result = repeated_passages(make(rows))
    got = tuples(result.drop("spans"))
    assert got == sorted(plain_removal(rows), key=str)
    assert any(0 < row[2] < row[1] for row in got)


def test_texts_longer_than_a_piece_have_the_same_segments(monkeypatch):
    draw = np.random.default_rng(1)
    text = draw.integers(97, 123, 9000).astype(np.uint8)
    whole, _ = suffix_dedup.segments(text, np.array([len(text)]), np.array([0]))
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    parts = suffix_dedup.text_segments(text)
    covered = lambda own: {(int(s["bucket"]), int(s["at"]) - d) for s in own for d in range(s["last"], s["first"] + 1)}
    assert covered(whole) == covered(parts) and len(covered(whole)) == len(text) - DEPTH + 1


def test_cover_sort_orders_and_groups():
    draw = np.random.default_rng(2)
    base = draw.integers(97, 100, 900).astype(np.uint8)
    parts = [base, base[100:], base[:700], np.full(650, 97, np.uint8), np.tile(base[:7], 90)]
    text, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
    suffixes = np.concatenate([np.arange(e - len(p), e - DEPTH + 1) for p, e in zip(parts, ends, strict=True)])
    order, group = cover_sort.classes(text, suffixes)
    data = text.tobytes()
    own = [data[p : p + DEPTH] for p in order.tolist()]
    assert sorted(order.tolist()) == sorted(suffixes.tolist()) and own == sorted(own)
    assert [a == b for a, b in zip(own, own[1:], strict=False)] == [a == b for a, b in zip(group, group[1:], strict=False)]


@pytest.mark.parametrize("operator", [exact_groups, ngram_links, repeated_passages, keep_one])
def test_empty_tables(empty, operator):
    assert operator(empty).count() == 0


@pytest.mark.parametrize("find", [repeated_passages, ngram_links])
def test_batches_of_texts_stay_small(spark, find):
    """Spark's batches of 10,000 whole texts would stand in every task several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for before, after in (("10000", "1000"), ("0", "1000"), ("70", "70")):
        spark.conf.set(name, before)
        try:
            find(spark.createDataFrame([(1, "a b c d e f"), (2, None)], "doc_id bigint, text string")).collect()
            assert spark.conf.get(name) == after
        finally:
            spark.conf.unset(name)


def test_blocks_give_out_few_pairs_as_such_and_many_as_members():
    rule = ngram_join.Rule(5, 80)
    near = np.arange(1, 101, dtype=np.uint64)

    def involved(sets):
        columns = {"tile": [0], "block": [0], "probe_block": [0], "rep": range(len(sets)), "label": range(len(sets)), "probe": None}
        rows = {k: list(v) * (len(sets) if len(v) == 1 else 1) for k, v in columns.items() if v is not None}
        twice = pa.table({k: v + v for k, v in rows.items()} | {"probe": [True] * len(sets) + [False] * len(sets)})
        twice = twice.append_column("n", pa.array([len(own) for own in sets] * 2))
        twice = twice.append_column("bits", pa.array([ngram_join.bitmap(own) for own in sets] * 2))
        return ngram_join._involved(rule)(twice).select(["rep", "other"]).to_pylist()

    apart = [np.arange(1000 * i, 1000 * i + 100, dtype=np.uint64) for i in range(1, 8)]
    assert involved([near, near[:95], *apart]) == [{"rep": 0, "other": 1}, {"rep": 1, "other": 0}]
    many = involved([near] * 9)
    assert [row["rep"] for row in many] == [*range(9), *range(9)] and all(row["other"] is None for row in many)
    assert involved(apart) == []
