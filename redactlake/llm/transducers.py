"""Weighted finite-state transducers as tables of arcs: composition and best paths, weights add up along a path."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

NOTHING = ""


@dataclass(frozen=True)
class Arc:
    """From a state to a state: one symbol is read, one written (NOTHING writes none)."""

    source: int
    read: str
    written: str
    weight: float
    target: int


@dataclass
class Transducer:
    """Starts in state 0; a path counts if it ends in a final state."""

    arcs: list[Arc]
    finals: frozenset[int]
    leaving: dict[tuple[int, str], list[Arc]] = field(init=False)

    def __post_init__(self) -> None:
        self.leaving = defaultdict(list)
        for arc in self.arcs:
            self.leaving[arc.source, arc.read].append(arc)
        self.leaving = dict(self.leaving)

    def best_path(self, symbols: Sequence[str]) -> tuple[float, tuple[str, ...]] | None:
        """The greatest weight of a path that reads all symbols, and what it writes for each of them; None if there is no path.
        Of equally good paths the one with the smaller outputs counts."""
        reached: dict[int, tuple[float, tuple[str, ...]]] = {0: (0.0, ())}
        for symbol in symbols:
            following: dict[int, tuple[float, tuple[str, ...]]] = {}
            for state, (weight, written) in reached.items():
                for arc in self.leaving.get((state, symbol), ()):
                    found = (weight + arc.weight, (*written, arc.written))
                    known = following.get(arc.target)
                    if known is None or (-found[0], found[1]) < (-known[0], known[1]):
                        following[arc.target] = found
            reached = following
        ends = [found for state, found in reached.items() if state in self.finals]
        return min(ends, key=lambda found: (-found[0], found[1])) if ends else None


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that hands what ``first`` writes to ``second``; states are the pairs that can be reached. Where ``first`` writes
    nothing, ``second`` stays where it is."""
    numbers, waiting, arcs = {(0, 0): 0}, [(0, 0)], []
    out_of: dict[int, list[Arc]] = defaultdict(list)
    for arc in first.arcs:
        out_of[arc.source].append(arc)

    def number(pair: tuple[int, int]) -> int:
        if pair not in numbers:
            numbers[pair] = len(numbers)
            waiting.append(pair)
        return numbers[pair]

    while waiting:
        left, right = waiting.pop()
        here = numbers[left, right]
        for arc in out_of[left]:
            if arc.written == NOTHING:
                arcs.append(Arc(here, arc.read, NOTHING, arc.weight, number((arc.target, right))))
                continue
            for then in second.leaving.get((right, arc.written), ()):
                arcs.append(Arc(here, arc.read, then.written, arc.weight + then.weight, number((arc.target, then.target))))
    finals = frozenset(n for (left, right), n in numbers.items() if left in first.finals and right in second.finals)
    return Transducer(arcs, finals)


def cascade(machines: Iterable[Transducer]) -> Transducer:
    """All of them, one after the other."""
    composed, *others = machines
    for machine in others:
        composed = compose(composed, machine)
    return composed
