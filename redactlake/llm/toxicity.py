"""Toxicity of whole texts by a weighted grammar of finite-state transducers over clauses.

Words are read as symbols: insults (a learnt lexicon of words and beginnings of words, each with a weight), threats, targets, negations,
reported speech. Four transducers are composed into one that reads the symbols of a clause: the first marks what is negated, the second
what is reported, the third what is aimed at somebody, who may be named before or after it, and the last writes kinds of matches. The best
path of a clause tells how it is read, so that "you are no X" or "they said X" don't count like "you X". What the clauses of a text emit goes
into a logistic score; its fitted weights are the weights of the arcs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactlake.llm.labelled import fitting_rows, held_out
from redactlake.llm.texts import slices
from redactlake.llm.transducers import NOTHING, Arc, Transducer, cascade

TARGETS = frozenset("you your yours he she they him her them du dich dir ihr sie tu toi vous ton votre tú usted ustedes tus".split())
NEGATIONS = frozenset("not no never neither nor nicht kein keine nie ne pas jamais aucun nunca ni jamás".split())
REPORTS = frozenset("said says say told wrote called quote sagte sagt schrieb dit disait écrit dijo dice escribió".split())
THREATS = frozenset("kill hurt shoot stab burn beat töten schlagen tuer frapper brûler matar golpear quemar".split())

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:,\n\r()\"|]+")
INSULT, THREAT, TARGET, NEGATION, REPORT = "i", "t", "g", "n", "r"
#: Marks that transducers hand on behind a symbol.
AIMED, DENIED, QUOTED = "+", "-", "~"
#: What the composed transducer writes.
KINDS = (
    "insult", "insult_target", "insult_negated", "insult_reported", "threat", "threat_target", "threat_negated", "threat_reported",
)
WRITTEN = dict(zip((a + b for a in (INSULT, THREAT) for b in (NOTHING, AIMED, DENIED, QUOTED)), KINDS, strict=True))
#: Weights of the kinds before any are fitted: of two readings, the aimed one counts.
FIRST_WEIGHTS = {kind: 2.0 if kind.endswith("_target") else 1.0 for kind in KINDS}
#: Longer clauses are not kept in the cache of readings.
SHORTEST, CACHE, CACHED_CLAUSE = 4, 300_000, 40


def _marking(signal: str, mark: str, others: tuple[str, ...], marked: tuple[str, ...]) -> Transducer:
    """After ``signal``, which it takes out, every symbol of ``marked`` gets ``mark``; ``others`` go through."""
    arcs = [Arc(state, signal, NOTHING, 0.0, 1) for state in (0, 1)]
    arcs += [Arc(state, symbol, symbol, 0.0, state) for state in (0, 1) for symbol in others]
    for symbol in marked:
        arcs += [Arc(0, symbol, symbol, 0.0, 0), Arc(1, symbol, symbol + mark, 0.0, 1)]
    return Transducer(arcs, frozenset((0, 1)))


def _aiming() -> Transducer:
    """Insults and threats are aimed in a clause with a target. State 1: one has been read. State 2: one is still to come."""
    arcs = [Arc(0, TARGET, NOTHING, 0.0, 1), Arc(1, TARGET, NOTHING, 0.0, 1), Arc(2, TARGET, NOTHING, 0.0, 1)]
    for symbol in (INSULT, THREAT):
        arcs += [Arc(0, symbol, symbol, 0.0, 0), Arc(0, symbol, symbol + AIMED, 0.0, 2)]
        arcs += [Arc(state, symbol, symbol + AIMED, 0.0, state) for state in (1, 2)]
        arcs += [Arc(state, symbol + mark, symbol + mark, 0.0, state) for state in (0, 1, 2) for mark in (DENIED, QUOTED)]
    return Transducer(arcs, frozenset((0, 1)))


def clause_transducer(weights: dict[str, float]) -> Transducer:
    """Negation, reported speech, targets and kinds, composed; ``weights`` are those of the kinds."""
    denied = (INSULT + DENIED, THREAT + DENIED)
    kinds = Transducer([Arc(0, read, kind, weights[kind], 0) for read, kind in WRITTEN.items()], frozenset((0,)))
    return cascade(
        (
            _marking(NEGATION, DENIED, (TARGET, REPORT), (INSULT, THREAT)),
            _marking(REPORT, QUOTED, (TARGET, *denied), (INSULT, THREAT)),
            _aiming(),
            kinds,
        )
    )


class Grammar:
    """The composed transducers with their weights."""

    def __init__(self, lexicon: dict[str, float], weights: np.ndarray, threats: dict[str, float] | None = None, arcs: dict[str, float] = FIRST_WEIGHTS):
        self.lexicon, self.weights = lexicon, weights  # entries ending in $ are whole words, others begin words
        self.threats = dict.fromkeys(THREATS, 1.0) if threats is None else threats
        self.clauses = clause_transducer(arcs)
        self.symbols: dict[str, tuple[str, float] | None] = {}
        self.readings: dict[str, tuple[str, ...]] = {}

    def symbol(self, word: str) -> tuple[str, float] | None:
        """A word's symbol and weight; for most words nothing."""
        if word in self.symbols:
            return self.symbols[word]
        if len(self.symbols) > CACHE:
            self.symbols.clear()
        found = [self.lexicon.get(word + "$", 0.0)]
        found += [self.lexicon.get(word[:n], 0.0) for n in range(SHORTEST, len(word) + 1)]
        if max(found) > 0:
            out = (INSULT, max(found))
        elif word in self.threats:
            out = (THREAT, self.threats[word])
        else:
            listed = ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS))
            out = next(((s, 0.0) for s, own in listed if word in own), None)
        self.symbols[word] = out
        return out

    def clause(self, words: list[str]) -> list[tuple[str, float]]:
        """Matches of one clause by its best path: each kind with the greatest weight of its words."""
        read = [found for found in map(self.symbol, words) if found]
        symbols = "".join(symbol for symbol, _ in read)
        if INSULT not in symbols and THREAT not in symbols:
            return []
        kinds = self.readings.get(symbols)
        if kinds is None:
            kinds = self.clauses.best_path(symbols)[1]  # there is a path for every clause
            if len(symbols) <= CACHED_CLAUSE and len(self.readings) < CACHE:
                self.readings[symbols] = kinds
        matches: dict[str, float] = {}
        for kind, (_, weight) in zip(kinds, read, strict=True):
            if kind != NOTHING:
                matches[kind] = max(matches.get(kind, 0.0), weight)
        return list(matches.items())

    def features(self, text: str) -> np.ndarray:
        """Per kind the greatest weight and a damped sum; the damped number of matches among all words."""
        text = text.lower()
        words = WORD.findall(text)
        greatest, total, matches = dict.fromkeys(KINDS, 0.0), dict.fromkeys(KINDS, 0.0), 0
        known, symbol = self.symbols, self.symbol
        if any((known[w] if w in known else symbol(w)) for w in set(words)):
            for part in CLAUSE.split(text):
                for kind, weight in self.clause(WORD.findall(part)):
                    greatest[kind], total[kind], matches = max(greatest[kind], weight), total[kind] + weight, matches + 1
        values = [v for kind in KINDS for v in (greatest[kind], math.log1p(total[kind]))]
        best = max(greatest.values())
        return np.array([1.0, *values, best, math.log1p(100 * matches / (len(words) + 20))])

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.weights, -30, 30))))


def learn_lexicon(rows: list[tuple[str, int]], least_texts: int = 5, least_weight: float = 2.5) -> dict[str, float]:
    """Words and beginnings of words that toxic texts hold much more often. Near copies count as one text."""
    once: dict[tuple[int, int], set[str]] = {}
    for text, label in rows:
        words = WORD.findall(text.lower())
        triples = zip(words, words[1:] or words, words[2:] or words, strict=False)
        key = min((xxhash.xxh3_64_intdigest(" ".join(t)) for t in triples), default=0)
        once.setdefault((key, label), set(words))
    toxic = [words for (_, label), words in once.items() if label == 1]
    clean = [words for (_, label), words in once.items() if label == 0]

    def entries(words: set[str]) -> set[str]:
        return {w[:n] for w in words for n in range(SHORTEST, len(w) + 1)} | {w + "$" for w in words}

    seen = Counter(e for words in toxic for e in entries(words))
    seen = Counter({e: n for e, n in seen.items() if n >= least_texts})
    # where nearly all texts go on in the same way, the longer entry says as much and less else
    longer = Counter()
    for e, n in seen.items():
        longer[e[:-1]] = max(longer[e[:-1]], n)
    seen = Counter({e: n for e, n in seen.items() if longer[e] < 0.9 * n})
    otherwise = Counter(e for words in clean for e in entries(words) if e in seen)
    lexicon = {
        e: math.log((n + 0.5) / (len(toxic) + 1) / ((otherwise[e] + 0.5) / (len(clean) + 1))) for e, n in seen.items()
    }
    return {e: weight for e, weight in lexicon.items() if weight >= least_weight}


def threat_weights(rows: list[tuple[str, int]], least: float = 0.2, most: float = 5.0) -> dict[str, float]:
    """How much more often toxic texts hold each threat (log of the ratio), within bounds."""
    texts, held = Counter(), {0: Counter(), 1: Counter()}
    for text, label in rows:
        texts[label] += 1
        held[label].update(THREATS.intersection(WORD.findall(text.lower())))
    share = lambda word, label: (held[label][word] + 0.5) / (texts[label] + 1)
    return {word: min(max(math.log(share(word, 1) / share(word, 0)), least), most) for word in sorted(THREATS)}


def _logistic(x: np.ndarray, y: np.ndarray, steps: int, ridge: float) -> np.ndarray:
    """Weights by Newton's method; the first column is the constant."""
    weights, free = np.zeros(x.shape[1]), np.arange(x.shape[1]) > 0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(len(weights)) * free + 1e-6 * np.eye(len(weights))
        weights -= np.linalg.solve(hessian, x.T @ (p - y) + ridge * len(x) * weights * free)
    return weights


def arc_weights(weights: np.ndarray) -> dict[str, float]:
    """Weights of the arcs that write a kind: what a match of it adds to the score. An aimed match never weighs less than a plain one."""
    arcs = {kind: float(weights[1 + 2 * n] + weights[2 + 2 * n]) for n, kind in enumerate(KINDS)}
    for plain in ("insult", "threat"):
        arcs[f"{plain}_target"] = max(arcs[f"{plain}_target"], arcs[plain] + 1e-3)
    return arcs


def fit(rows: list[tuple[str, int]], steps: int = 30, ridge: float = 1e-2, rounds: int = 2) -> Grammar:
    """The lexicon from one half of the rows, the weights from the other, then the lexicon from all rows. Weights of arcs and the
    readings that they choose are fitted in turn. Without rows of both labels every text scores 0.5, or near the only label seen."""
    labels = np.array([label for _, label in rows], float)
    size = 3 + 2 * len(KINDS)
    if len(set(labels.tolist())) < 2:
        weights = np.zeros(size)
        weights[0] = 0 if not rows else 4 * (2 * labels[0] - 1)
        return Grammar({}, weights)
    lexicon, threats, arcs = learn_lexicon(rows[::2], 4), threat_weights(rows[::2]), FIRST_WEIGHTS
    for _ in range(rounds):
        half = Grammar(lexicon, np.zeros(size), threats, arcs)
        weights = _logistic(np.array([half.features(text) for text, _ in rows[1::2]]), labels[1::2], steps, ridge)
        arcs = arc_weights(weights)
    return Grammar(learn_lexicon(rows), weights, threat_weights(rows), arcs)


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    modulus: int = 5,
    rest: int = 0,
    fit_rows: int = 8000,
    fit_bytes: int = 1 << 13,
) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score
    is at least 0.5).

    The lexicon and the weights are fitted in the driver on at most `fit_rows` labelled rows of at most `fit_bytes` bytes that
    aren't held out, and sent to the tasks (the lexicon has at most as many entries as those rows have beginnings of words
    in five texts or more). Whole texts are scored; null and empty texts match nothing. Repeated rows get the same score; other
    columns have no part in it. An empty table gives no rows.
    """
    grammar = fit(fitting_rows(docs, labels, label, modulus, rest, fit_rows, fit_bytes))
    grammar.symbols.clear()
    grammar.readings.clear()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                scores = [grammar.score(text or "") for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(score, T.StructType.fromDDL("doc_id bigint, score double"))
    return scored.select(
        "doc_id",
        held_out(modulus, rest).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
