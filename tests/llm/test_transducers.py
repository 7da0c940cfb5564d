"""Composition and best paths against trying all paths."""

import itertools
import random

from redactlake.llm.toxicity import FIRST_WEIGHTS, INSULT, NEGATION, REPORT, TARGET, THREAT, clause_transducer
from redactlake.llm.transducers import NOTHING, Arc, Transducer, cascade, compose


def all_paths(machine, symbols):
    """Every path of a machine: weight and outputs, without those of nothing."""
    paths = [(0, 0.0, ())]
    for symbol in symbols:
        paths = [
            (arc.target, weight + arc.weight, (*written, arc.written))
            for state, weight, written in paths
            for arc in machine.arcs
            if arc.source == state and arc.read == symbol
        ]
    return [(weight, written) for state, weight, written in paths if state in machine.finals]


def random_machine(draw, reads, writes, states=3):
    arcs = {
        (draw.randrange(states), draw.choice(reads), draw.choice([*writes, NOTHING]), draw.randrange(states)) for _ in range(12)
    }
    return Transducer(
        [Arc(a, r, w, draw.randrange(-4, 5) / 4, b) for a, r, w, b in sorted(arcs)], frozenset(draw.sample(range(states), 2))
    )


def test_composition_and_best_paths_equal_all_paths():
    draw, found = random.Random(7), 0
    for _ in range(60):
        first, second = random_machine(draw, "ab", "xy"), random_machine(draw, "xy", "pq")
        both = compose(first, second)
        for symbols in itertools.chain.from_iterable(itertools.product("ab", repeat=n) for n in range(5)):
            want = [
                (weight + more, tuple(w for w in written if w))
                for weight, handed in all_paths(first, symbols)
                for more, written in all_paths(second, [h for h in handed if h])
            ]
            got = [(weight, tuple(w for w in written if w)) for weight, written in all_paths(both, symbols)]
            assert sorted(got) == sorted(want)
            best = both.best_path(symbols)
            assert (best is None) == (not want) and (best is None or best[0] == max(want)[0])
            found += len(want)
    assert found > 500


def test_composition_is_associative():
    draw = random.Random(8)
    for _ in range(20):
        a, b, c = (random_machine(draw, x, y) for x, y in (("ab", "xy"), ("xy", "pq"), ("pq", "uv")))
        left, right = cascade((a, b, c)), compose(a, compose(b, c))
        for symbols in itertools.product("ab", repeat=3):
            assert sorted(all_paths(left, symbols)) == sorted(all_paths(right, symbols))


def test_every_clause_has_a_reading():
    """By the rules of the grammar, stated plainly."""
    machine = clause_transducer(FIRST_WEIGHTS)
    names = {INSULT: "insult", THREAT: "threat"}
    for length in range(6):
        for symbols in itertools.product((INSULT, THREAT, TARGET, NEGATION, REPORT), repeat=length):
            want = []
            for n, symbol in enumerate(symbols):
                if symbol in names:
                    mark = "_negated" if NEGATION in symbols[:n] else "_reported" if REPORT in symbols[:n] else "_target" if TARGET in symbols else ""
                    want.append(names[symbol] + mark)
                else:
                    want.append(NOTHING)
            assert machine.best_path(symbols)[1] == tuple(want)
