"""Fingerprints and their groups against plain computations."""

import numpy as np
import pytest
import xxhash

from redactlake.llm import golay, simhash_dedup
from redactlake.llm.simhash_dedup import MOST_DIFFERING, differing, file_keys, fingerprint, forest, near_fingerprints


def test_every_word_is_near_one_codeword():
    table, counts = golay.patterns()
    weights = np.bitwise_count(table)
    assert counts.tolist().count(1) == 1 + 23 + 253 and counts.tolist().count(6) == 1771
    assert all((weights[s, : counts[s]] <= 3).sum() == 1 for s in range(len(counts)))
    data = np.arange(1 << golay.DATA)
    codewords = (data << 11) | golay.remainder(data << 11)
    assert not golay.remainder(codewords).any()
    assert min(np.bitwise_count(codewords[1:])) == 7


def test_indices_are_the_codewords_near_by():
    words = np.random.default_rng(5).integers(0, 1 << 23, 50)
    data = np.arange(1 << golay.DATA)
    codewords = (data << 11) | golay.remainder(data << 11)
    found, counts = golay.near_indices(words)
    for word, own, n in zip(words, found, counts, strict=True):
        assert sorted(own[:n]) == np.flatnonzero(np.bitwise_count(codewords ^ word) <= 4).tolist()


def test_linked_fingerprints_share_a_file():
    draw = np.random.default_rng(6)
    a = draw.integers(0, 1 << 64, 3000, dtype=np.uint64)
    b = a.copy()
    for n in range(MOST_DIFFERING):
        on = draw.random(len(b)) < (n + 2) / 5
        b[on] ^= np.uint64(1) << draw.integers(0, 64, int(on.sum()), dtype=np.uint64)
    files = [set() for _ in range(len(a))], [set() for _ in range(len(a))]
    for prints, own in zip((a, b), files, strict=True):
        keys, of = file_keys(prints)
        for key, n in zip(keys.tolist(), of.tolist(), strict=True):
            own[n].add(key)
    assert all(x & y for x, y in zip(*files, strict=True))


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("size", [1, 7, 60, 1 << 20])
def test_fingerprints_of_texts_in_pieces(prose, size):
    for text in [*prose[:40], "", " \t", "one", "A b\x0bC", "a b c d", "  lead and trail \n", "Ünï 漢字 🙂 x y", "word " * 3000]:
        assert fingerprint(text.encode(), size=size) == plain_fingerprint(text)


def test_the_library_hashes_as_spark_does(spark):
    own = spark.sql("select hex(xxhash64('four short words here')) as h").first().h
    assert f"{fingerprint(b'FOUR short words here'):016X}" == own


def plain_groups(rows, prints):
    parent = {i: i for i, *_ in rows if i is not None}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    known = [(row[0], p) for row, p in zip(rows, prints, strict=True) if row[0] is not None]
    for n, (i, p) in enumerate(known):
        for j, q in known[:n]:
            if (p ^ q).bit_count() <= 4:
                low, high = sorted((top(i), top(j)))
                parent[high] = low
    of = {p: top(i) for i, p in known}
    return sorted([(row[0], f"{p:016x}", of.get(p)) for row, p in zip(rows, prints, strict=True)], key=str)


@pytest.mark.parametrize(("small", "whole", "block"), [(8, 512, 2048), (2, 6, 5)])
def test_near_fingerprints(monkeypatch, make, awkward, small, whole, block):
    for name, value in (("SMALL_FILE", small), ("WHOLE_FILE", whole), ("BLOCK", block)):
        monkeypatch.setattr(simhash_dedup, name, value)
    got = sorted(map(tuple, near_fingerprints(make(awkward)).collect()), key=str)
    assert got == plain_groups(awkward, [plain_fingerprint(row[1]) for row in awkward])
    assert any(row[2] != row[0] for row in got)


@pytest.mark.parametrize(("small", "whole", "block"), [(8, 512, 2048), (4, 40, 30)])
def test_one_large_group_gives_few_links(spark, monkeypatch, small, whole, block):
    """900 fingerprints within two bits of one another's neighbours: links follow the rows, not the pairs."""
    for name, value in (("SMALL_FILE", small), ("WHOLE_FILE", whole), ("BLOCK", block)):
        monkeypatch.setattr(simhash_dedup, name, value)
    base = 0x0123456789ABCDEF
    near = [base ^ (1 << i) ^ (1 << j) for i in range(43) for j in range(i)]
    far = [base ^ (0xFFFFF << k) for k in range(0, 40, 7)]
    values = np.array(near + far, np.uint64).view(np.int64)
    scratch = simhash_dedup.Scratch(spark, "test")
    prints = spark.createDataFrame([(int(v),) for v in values], "print bigint")
    links = simhash_dedup.print_links(prints, scratch).distinct().collect()
    assert all((link.a ^ link.b).bit_count() <= 4 or differing(*np.array([[link.a], [link.b]]))[0] <= 4 for link in links)
    parent = {int(v): int(v) for v in values}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for link in links:
        parent[top(link.a)] = top(link.b)
    assert len({top(int(v)) for v in values}) == 1 + len(far)
    assert len(links) < len(near) * 60 < len(near) ** 2 / 2


def test_forest_spans():
    draw = np.random.default_rng(8)
    prints = np.unique(draw.integers(0, 1 << 9, 300)).astype(np.int64)
    a, b = forest(prints)
    assert len(a) == len(prints) - 1 and (differing(prints[a], prints[b]) <= 4).all()
    a, b = forest(prints[:0])
    assert not len(a)


def test_empty_table(empty):
    assert near_fingerprints(empty).count() == 0
