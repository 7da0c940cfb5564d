"""Counts per text that the base rules of quality look at."""

from __future__ import annotations

import numpy as np

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
LEAST_WORDS, WINDOW, REPEATED_PERCENT = 10, 5, 20


def base_counts(text: bytes) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words, plain = text.split(), text.decode(errors="replace")
    word_chars = len(plain) - sum(map(plain.count, BLANKS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeated = 0
    if len(words) > WINDOW:
        hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        windows = np.zeros(len(words) - WINDOW + 1, np.uint64)
        for i in range(WINDOW):
            windows = (windows ^ (windows >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(windows) + i]
        ordered = np.sort(windows)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            begins = np.flatnonzero(np.isin(windows, twice))
            covered = np.zeros(len(words) + 1, np.int64)
            np.add.at(covered, begins, 1)
            np.add.at(covered, begins + WINDOW, -1)
            repeated = int((np.cumsum(covered)[:-1] > 0).sum())
    failed = len(words) < LEAST_WORDS or 100 * repeated > REPEATED_PERCENT * len(words)
    symbols = sum(map(plain.count, SYMBOLS))
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated, failed
