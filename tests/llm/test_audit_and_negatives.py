"""Filter audit and hard negatives against plain computations, and against their SQL."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from redactlake.llm import hard_negatives as hn
from redactlake.llm.filter_audit import filter_audit, order_audit
from redactlake.llm.hard_negatives import Heaps, hard_negatives, matrix, strassen, window
from redactlake.llm.queries import OP11, OP13


def tuples(df):
    return sorted(map(tuple, df.collect()), key=str)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain_audit(rows, good, toxic):
    least = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    parts = defaultdict(list)
    for doc_id, text, _, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and least[text] < doc_id,
        }
        parts[source or ""].append((doc_id, {x for x in fails if fails[x]}))
    out, removed_by = [], Counter()
    for part, own in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                removed_by[part, x] += len(gone)
                redundant = sum(x in d[1] for d in own) - len(gone)
                unique = sum(d[1] == {x} for d in own)
                lost = (sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone))
                out.append((part, order, step, len(left), len(gone), redundant, unique, *lost))
    return sorted([(*row, removed_by[row[0], row[1][row[2] - 1]]) for row in out], key=str)


def test_filter_audit(spark, make, awkward):
    draw = random.Random(2)
    long = ["Word%d" % draw.randrange(90) for _ in range(300)]
    rows = awkward + [(400 + i, " ".join(long[: 150 + 50 * i]).lower(), "en", "a") for i in range(4)]
    rows += [(410, "A# " * 300, "en", None), (411, "plain text " * 300, "en", ""), (412, "plain text " * 300, "en", "q")]
    labels = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(420)] + [(3, 0, None), (None, 1, 1), (4, None, 1), (4, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = tuples(filter_audit(make(rows), known).select(AUDIT))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    assert got == plain_audit(rows, good, toxic)
    assert all(any(row[n] for row in got) for n in range(3, 10))


def test_audit_of_other_filters(spark):
    cells = spark.createDataFrame([("x", 3, 2, 1, 0), ("x", 0, 5, 0, 0)], "part string, mask int, n bigint, good bigint, toxic bigint")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.good_lost, r.shapley) for r in order_audit(cells, "AB").collect()}
    assert got == {("AB", 1): (5, 2, 0, 1, 2), ("AB", 2): (5, 0, 2, 0, 2), ("BA", 1): (5, 2, 0, 1, 2), ("BA", 2): (5, 0, 2, 0, 2)}


def test_sql_of_audit_and_negatives(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "labels", "embeddings"):
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    for df, sql in (
        (filter_audit(spark.table("documents"), spark.table("labels")), OP11),
        (hard_negatives(spark.table("embeddings")), OP13),
    ):
        result = con.execute(sql)
        columns = [c[0] for c in result.description]
        assert sorted(df.columns) == sorted(columns)
        assert tuples(df.select(columns)) == sorted(result.fetchall(), key=str)


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 2), (17, 9, 33), (64, 64, 64), (70, 65, 99)])
def test_strassen_is_exact(shape):
    m, k, n = shape
    draw = np.random.default_rng(m)
    for limit in (1000, 1 << 62):  # large ones wrap around alike
        a, b = draw.integers(-limit, limit, (m, k)), draw.integers(-limit, limit, (k, n))
        assert np.array_equal(strassen(a, b, 2), a @ b)
    a, b = draw.integers(-(1 << 20), 1 << 20, (m, k)), draw.integers(-(1 << 20), 1 << 20, (k, n))
    assert strassen(a, b, 4).tolist() == (a.astype(object) @ b.astype(object)).tolist()


def test_heaps_keep_the_best():
    draw = np.random.default_rng(7)
    heaps, rows = Heaps(3), []
    for _ in range(5):
        own = [draw.integers(0, high, 40) for high in (6, 4, 20, 1000)]
        heaps.add(*own)
        rows += zip(*[x.tolist() for x in own], strict=True)
    want = [row for key in range(6) for row in sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2], r[3]))[:3]]
    assert list(zip(heaps.keys, heaps.scores, heaps.ids, heaps.uids, strict=True)) == want


def test_window_is_that_of_integers():
    for positive in range(-40, 41):
        least, most = window(positive, 30, 90)
        inside = [s for s in range(-60, 61) if 30 * positive <= 100 * s <= 90 * positive]
        assert inside == [s for s in range(-60, 61) if least <= s <= most]


def plain_negatives(rows):
    own = []
    for n, (vec_id, vector, label, *_) in enumerate(rows):
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        own.append((n, vec_id, label, [math.floor(256 * x) for x in vector]))
    out = []
    for n, anchor, label, q in own:
        if anchor % 100:
            continue
        scores = [(-sum(a * b for a, b in zip(q, v, strict=False)), i, m, y) for m, i, y, v in own if m != n]
        positives = sorted(s for s in scores if s[3] == label)[:5]
        for p in positives:
            fit = sorted(s for s in scores if s[3] != label and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0])[:10]
            out += [(anchor, p[1], rank, s[1], -p[0], -s[0]) for rank, s in enumerate(fit, 1)]
    return sorted(out, key=str)


VECTORS = "vec_id bigint, embedding array<float>, label int, uid string, q string, `row` int, score double, place int"


@pytest.mark.parametrize(("block", "tile"), [(8192, 512), (16, 7)])
def test_hard_negatives(spark, monkeypatch, block, tile):
    monkeypatch.setattr(hn, "BLOCK_ROWS", block)
    monkeypatch.setattr(hn, "TILE", tile)
    draw = np.random.default_rng(11)
    vectors = [[float(x) for x in draw.integers(-3, 5, 6) / 8] for _ in range(30)]
    rows = [(i * 10, vectors[draw.integers(30)], int(draw.integers(10))) for i in range(120)]  # many ties
    rows += [(5, None, 1), (7, [0.5] * 6, None), (None, [0.5] * 6, 1), (9, [0.5, None], 1), (11, [float("nan")] * 6, 2)]
    rows += [(13, [float("inf")] * 6, 2), (15, [], 3), (17, [0.5] * 9, 4), (100, [0.25] * 6, 5), rows[20], rows[20]]
    rows = [(*row, "u", "q", 1, 0.5, 2) for row in rows]
    got = tuples(hard_negatives(spark.createDataFrame(rows, VECTORS)))
    assert got == plain_negatives(rows) and got
    assert {row[0] for row in got} >= {100, 200}


def test_empty_and_extreme_vectors(spark, empty):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives(none).count() == 0
    assert filter_audit(empty, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0
    huge = spark.createDataFrame([(i, [3e38, -3e38], i % 2, "u", "q", 1, 0.5, 2) for i in range(0, 400, 50)], VECTORS)
    assert hard_negatives(huge).count() >= 0
    assert hard_negatives(spark.createDataFrame([(100, [], 1, "u", "q", 1, 0.5, 2)], VECTORS)).count() == 0
    assert matrix(hn.pa.table({"q": hn.pa.array([[1], [], [2, 3]], hn.pa.list_(hn.pa.int64()))}), 3).tolist() == [[1, 0, 0], [0, 0, 0], [2, 3, 0]]
