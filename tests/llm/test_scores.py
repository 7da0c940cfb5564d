"""Classifiers and rules: held-out accuracy, exact base counts, awkward rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from redactlake.llm import byte_model, toxicity
from redactlake.llm.quality_classifier import Network, fit, quality_scores
from redactlake.llm.quality_rules import base_counts, quality_rules
from redactlake.llm.toxicity import Grammar, learn_lexicon, toxicity_scores


def held_out(doc_id, modulus, rest):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == rest


@pytest.fixture(scope="module")
def labelled(spark, make):
    """Clean and noisy texts, some with insults; labels of all but the awkward rows."""
    draw = random.Random(9)
    words = ["".join(draw.choices("aeioulnrst", k=draw.randrange(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(500):
        own = draw.choices(words, k=draw.randrange(8, 120))
        toxic, quality = i % 4 == 0, int(i % 5 != 0)
        if toxic:
            for _ in range(3):
                own[draw.randrange(len(own))] = draw.choice(["vermin", "dimwit", "buffoon"])
        text = " ".join(own) if quality else " ".join(w + draw.choice(["%%%", "&&&", "$$$"]) for w in own)
        rows.append((i, text))
        labels.append((i, quality, int(toxic)))
    rows += [(600, None), (601, ""), (None, "no id"), rows[0], (602, "word " * 40_000)]
    labels += [(None, 1, 0), (3, None, None), (999, 1, 1)]
    return make(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), rows, labels


@pytest.mark.parametrize(("scores", "modulus", "rest", "label"), [("quality", 3, 1, 1), ("toxic", 5, 0, 2)])
def test_classifiers(labelled, scores, modulus, rest, label):
    docs, labels, rows, known = labelled
    if scores == "quality":
        result = quality_scores(docs, labels)
        assert result.columns == [*docs.columns, "quality_result"]
        result = result.select("doc_id", "quality_result.*")
    else:
        result = toxicity_scores(docs, labels)
    got = result.collect()
    assert Counter(row.doc_id for row in got) == Counter(row[0] for row in rows)
    truth = {row[0]: row[label] for row in known[:500]}
    judged = [row.predicted == truth[row.doc_id] for row in got if row.held_out and row.doc_id in truth]
    assert len(judged) > 50 and np.mean(judged) > 0.95
    for row in got:
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.5)
        assert row.held_out == held_out(row.doc_id, modulus, rest)


def test_held_out_labels_are_never_used(spark, labelled):
    docs, labels, _, known = labelled
    turned = [(i, q if i is None or not held_out(i, 5, 0) else 1, t if i is None or not held_out(i, 5, 0) else 1) for i, q, t in known]
    other = spark.createDataFrame(turned, labels.schema)
    first, second = (sorted(map(str, toxicity_scores(docs, own).collect())) for own in (labels, other))
    assert first == second


def test_without_labels(empty, labelled):
    docs, labels, *_ = labelled
    none = labels.where("false")
    assert {row.score for row in toxicity_scores(docs, none).collect()} == {0.5}
    assert {row.s for row in quality_scores(docs, none).selectExpr("quality_result.score as s").collect()} == {0.5}
    assert quality_scores(empty, labels).count() == 0 and toxicity_scores(empty, labels).count() == 0


def test_network_gradient():
    network = Network(1)
    texts, labels, weights = [b"some text of bytes" * 20, b"%%% &&&", b""], np.array([1, 0, 1.0]), np.ones(3)

    def loss():
        p = np.clip(network.scores(texts), 1e-9, 1 - 1e-9)
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).sum()

    for own, slope in zip(network.parameters(), network.gradients(texts, labels, weights), strict=True):
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        step = 1e-2
        own[at] += step
        up = loss()
        own[at] -= 2 * step
        down = loss()
        own[at] += step
        assert abs((up - down) / (2 * step) - slope[at]) < 0.05 * max(1, abs(slope[at]))


def test_every_byte_has_a_part_in_the_score():
    network = fit([(b"plain words here " * 9, 1), (b"%$&#*%$&#*%$&#*" * 9, 0)] * 20)
    clean = b"plain words here " * 300
    for at in (0, len(clean) // 2, len(clean)):
        assert network.scores([clean[:at] + b"%$&#*%$&#*" * 12 + clean[at:]])[0] < network.scores([clean])[0]


def test_clauses_and_not_words_are_scored():
    grammar = Grammar({"buffoon$": 5.0, "vermi": 3.0}, np.zeros(1))
    kinds = lambda text: [kind for kind, _ in grammar.clause(text.split())]
    assert kinds("you buffoon") == ["insult_target"] and kinds("a buffoon") == ["insult"]
    assert kinds("you are not a buffoon") == ["insult_negated"] and kinds("they said buffoon") == ["insult_reported"]
    assert kinds("kill you") == ["threat_target"] and kinds("never kill") == ["threat_negated"] and kinds("nothing here") == []
    assert kinds("buffoon they are") == ["insult_target"] and kinds("said they kill") == ["threat_reported"]
    assert kinds("buffoon said not you vermin") == ["insult_target", "insult_negated"]
    assert kinds("verminous") == ["insult"] and kinds("buffoons") == []
    assert grammar.features("").tolist()[1:] == [0.0] * (len(grammar.features("")) - 1)


def test_near_copies_count_once_in_the_lexicon():
    text = "one two three strangeword five six seven"
    copies = [(text + f" tail{i}", 1) for i in range(9)] + [(f"clean number {i} here", 0) for i in range(9)]
    assert not learn_lexicon(copies)
    assert toxicity.SHORTEST == 4


def plain_base(text):
    text = text or ""
    blank = " \t\n\v\f\r"
    words = "".join(" " if c in blank else c for c in text).split(" ")
    words = [w for w in words if w]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if any(c not in blank for c in line)]
    failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed


def test_quality_rules(make, awkward):
    rows = [*awkward, (400, "a b c d e " * 30, "en", "a"), (401, "l\nl\n\nl \nx\x85y z # *", "en", "a")]
    got = quality_rules(make(rows)).collect()
    want = Counter((row[0], *plain_base(row[1])) for row in rows)
    assert Counter(tuple(row)[:7] for row in got) == want
    for row in got:
        assert not (row.base_failed and row.kept) and (row.perplexity is None) == (row.n_words == 0 and row.word_chars == 0 and row.doc_id != 202)


def test_odd_texts_leave_the_band(make):
    draw = random.Random(2)
    words = ["".join(draw.choices("aeioulnrst", k=draw.randrange(2, 8))) for _ in range(300)]
    rows = [(i, " ".join(draw.choices(words, k=150)), "en") for i in range(200)]
    rows += [(900, " ".join(draw.choices(["zqxj", "qqzw", "xvkq", "jjqz", "wzxk", "vqpz"], k=150)), "en")]
    rows += [(901, " ".join("".join(draw.choices("XQZWK", k=6)) for _ in range(200)), "en")]
    kept = {row.doc_id: row.kept for row in quality_rules(make(rows)).collect()}
    assert all(kept[i] for i in range(200)) and not kept[901]


def test_band_below_rejects_predictable_texts(make):
    draw = random.Random(2)
    words = ["".join(draw.choices("aeioulnrst", k=draw.randrange(2, 8))) for _ in range(300)]
    rows = [(i, " ".join(draw.choices(words, k=150)), "en") for i in range(200)]
    rows += [(900, " ".join(draw.choices(["zqxj", "qqzw", "xvkq", "jjqz", "wzxk", "vqpz"], k=150)), "en")]
    row = {row.doc_id: row for row in quality_rules(make(rows)).collect()}
    assert not row[900].base_failed and not row[900].kept and all(row[i].kept for i in range(200))


def test_frequent_junk_is_rejected_and_near_copies_stay(make):
    draw = random.Random(3)
    words = ["".join(draw.choices("aeioulnrst", k=draw.randrange(2, 8))) for _ in range(300)]
    texts = [draw.choices(words, k=draw.randrange(60, 200)) for _ in range(300)]
    rows = [(i, " ".join(own).capitalize() + ".") for i, own in enumerate(texts)]
    rows += [(1000 + i, " ".join(w + draw.choice(["%%%", "***", "$$$"]) for w in own)) for i, own in enumerate(texts[:30])]
    rows += [(2000 + i, " | ".join(own)) for i, own in enumerate(texts[30:60])]
    rows += [(3000 + i, rows[0][1] + f" {words[i]} {words[i + 1]}") for i in range(30)]
    got = {row.doc_id: row for row in quality_rules(make(rows)).collect()}
    junk = [got[i] for i in got if 1000 <= i < 3000 and not got[i].base_failed]
    clean = [got[i] for i in got if (i < 1000 or i >= 3000) and not got[i].base_failed]
    assert len(junk) > 30 and not any(row.kept for row in junk)
    assert np.mean([row.kept for row in clean]) > 0.98 and all(got[i].kept for i in range(3000, 3030))


def test_model_grows_with_the_corpus(spark, make, monkeypatch):
    """More text brings more n-grams, and any number of blocks and buckets gives the same surprises."""
    texts = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyzÄ漢% ", k=900)) for i in range(40)]
    different = [len(np.unique(np.concatenate([byte_model.grams(t.encode()) for t in texts[:n]]))) for n in (4, 40)]
    assert different[1] > 9 * different[0]
    rows = [(i, text, ("en", "fr", None)[i % 3]) for i, text in enumerate([*texts, *texts[:5], "", "word " * 999])]
    first = {row.doc_id: row.perplexity for row in quality_rules(make(rows)).collect()}
    monkeypatch.setattr(byte_model, "BLOCK_BYTES", 5000)
    monkeypatch.setattr(byte_model, "BUCKET_BYTES", 10_000)
    again = {row.doc_id: row.perplexity for row in quality_rules(make(rows)).collect()}
    assert first.keys() == again.keys() and first[40] is not None and first[45] is None
    assert all(first[i] == pytest.approx(again[i], rel=1e-5) for i in first if first[i] is not None)


def plain_kneser_ney(texts):
    """A function for the probability of a byte after at most four, by dictionaries."""
    counts = [Counter() for _ in range(6)]
    for text in texts:
        padded = bytes(4) + text + bytes(1)
        counts[5].update(padded[i : i + 5] for i in range(len(text) + 1))
    for order in (4, 3, 2, 1):
        counts[order].update(gram[1:] for gram in counts[order + 1])
    off = {}
    for order in range(1, 6):
        times = Counter(counts[order].values())
        n = [max(1, times[i]) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        off[order] = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.1), most) for i, most in ((1, 0.9), (2, 1.8), (3, 2.7))]

    def probability(gram):
        if not gram:
            return 1 / 256
        order, after = len(gram), {g: c for g, c in counts[len(gram)].items() if g[:-1] == gram[:-1]}
        if not after:
            return probability(gram[1:])
        taken = {g: off[order][min(c, 3) - 1] for g, c in after.items()}
        own = after.get(gram, 0) - taken.get(gram, 0)
        return (own + sum(taken.values()) * probability(gram[1:])) / sum(after.values())

    return probability


def test_perplexity_is_that_of_plain_kneser_ney(make, monkeypatch):
    """Over several blocks and buckets, rows of buckets split; copies and texts that fail the base rules aren't counted."""
    monkeypatch.setattr(byte_model, "BLOCK_BYTES", 300)
    monkeypatch.setattr(byte_model, "BUCKET_BYTES", 300)
    monkeypatch.setattr(byte_model, "SORT_BYTES", 64)
    monkeypatch.setattr(byte_model, "ROW_BYTES", 400)
    draw = random.Random(8)
    words = ["so", "Ännä", "tell", "me", "%%", "and", "漢字", "then", "a1"]
    texts = [" ".join(draw.choices(words, k=draw.randrange(10, 25))) for _ in range(30)]
    texts = [t for t in texts if not base_counts(t.encode())[5]]
    rows = [(i, t, "en") for i, t in enumerate([*texts, texts[0], texts[0], "too short §", "\0 zero"])]
    model = plain_kneser_ney([t.encode() for t in texts])
    for row in quality_rules(make(rows)).collect():
        padded = bytes(4) + rows[row.doc_id][1].encode() + bytes(1)
        logs = [np.log2(model(padded[i : i + 5])) for i in range(len(padded) - 4)]
        assert np.log2(row.perplexity) == pytest.approx(-np.mean(logs), abs=1e-3)


def test_probabilities_after_a_context_sum_to_one():
    draw = np.random.default_rng(5)
    pairs = byte_model.pair_probabilities(draw.integers(0, 3, byte_model.PAIRS) * draw.integers(0, 2, byte_model.PAIRS))
    assert np.allclose(pairs.reshape(256, 256).sum(1), 1)
    below = draw.random(256)
    counts = draw.integers(0, 6, 256)
    got = byte_model.level(np.arange(256, dtype=np.uint64) + np.uint64(512), counts, np.array([0, 0.5, 0.9, 1.3]), below / below.sum())
    assert got.sum() == pytest.approx(1)


def test_languages_beyond_the_broadcast_are_joined(make, monkeypatch):
    draw = random.Random(1)
    rows = [(i, " ".join(draw.choices(["one", "two", "six", "ten", "plain"], k=30)), ("en", "fr", None)[i % 3]) for i in range(30)]
    first = {row.doc_id: row for row in quality_rules(make(rows)).collect()}
    monkeypatch.setattr(byte_model, "BROADCAST_LANGUAGES", 1)
    monkeypatch.setattr("redactlake.llm.quality_rules.BROADCAST_LANGUAGES", 1)
    assert first == {row.doc_id: row for row in quality_rules(make(rows)).collect()}


def test_texts_that_are_no_utf8(spark):
    rows = spark.range(3).selectExpr("id as doc_id", "cast(unhex('C328') as string) as text", "'en' as lang")
    assert [row.word_chars for row in quality_rules(rows).collect()] == [2, 2, 2]


def test_every_language_has_its_own_model(make):
    draw = random.Random(4)
    rows = []
    for lang in range(40):
        letters = "".join(draw.sample("abcdefghijklmnopqrstuvwxyz", 9))
        words = ["".join(draw.choices(letters, k=draw.randrange(2, 8))) for _ in range(150)]
        rows += [(100 * lang + i, " ".join(draw.choices(words, k=100)), f"l{lang:02}") for i in range(25)]
    words = rows[0][1].split()
    strange = [(100 * lang + 99, " ".join(draw.choices(words, k=100)), f"l{lang:02}") for lang in range(1, 40)]
    got = {row.doc_id: row for row in quality_rules(make(rows + strange)).collect()}
    judged = [got[i] for i, *_ in strange if not got[i].base_failed]
    assert len(judged) > 30 and not any(row.kept for row in judged)
    assert np.mean([got[i].kept for i, *_ in rows]) > 0.98


def test_quality_rules_of_nothing(empty):
    assert quality_rules(empty).count() == 0


def test_base_counts_of_repeated_windows():
    assert base_counts(b"a b c d e f a b c d e g")[4] == 10
