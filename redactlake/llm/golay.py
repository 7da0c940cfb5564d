"""The perfect binary Golay code of length 23: every word is at a distance of at most 3 from exactly one of 4096 codewords."""

from __future__ import annotations

import functools
import itertools

import numpy as np

LENGTH, DATA = 23, 12
#: A generator polynomial of the code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value).
GENERATOR = 0b110001110101


def remainder(words: np.ndarray) -> np.ndarray:
    """The 11-bit syndrome of each word: its remainder by the generator polynomial."""
    left = np.array(words, np.int64)
    for bit in range(LENGTH - 1, LENGTH - DATA - 1, -1):
        left ^= ((left >> bit) & 1) * (GENERATOR << (bit - (LENGTH - DATA)))
    return left


@functools.cache
def patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error patterns of weight at most 4 that have it, as a table of six columns, and how many they are.

    One has weight at most 3 and leads to the nearest codeword; if its weight is 3, five more have weight 4.
    """
    errors = np.array([sum(1 << b for b in bits) for weight in range(5) for bits in itertools.combinations(range(LENGTH), weight)])
    syndromes = remainder(errors)
    order = np.argsort(syndromes, kind="stable")
    errors, syndromes = errors[order], syndromes[order]
    counts = np.bincount(syndromes, minlength=1 << (LENGTH - DATA))
    table = np.zeros((len(counts), counts.max()), np.int64)
    table[syndromes, np.arange(len(errors)) - np.repeat(np.cumsum(counts) - counts, counts)] = errors
    return table, counts


def near_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 12-bit indices of the codewords within distance 4 of each word (one or six), and how many they are.

    Two words at a distance of at most 2 have an index in common: both are within 1 of a word between them, whose
    nearest codeword is within 3 of it.
    """
    table, counts = patterns()
    own = remainder(words)
    return (words[:, None] ^ table[own]) >> (LENGTH - DATA), counts[own]
