"""Winnowed seeds: which windows of a text can occur elsewhere.

Every window of `window` symbols has one seed, the gram of `gram` symbols in it whose hash is
smallest (the leftmost of equals). Equal windows have equal seeds at equal places, so whatever two
texts share is found among the windows of shared seeds. Neighbouring windows mostly have the same
seed: such a run is described once, by its seed and the symbols that its windows cover.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from gridloom.llm.hashing import Prefix, sliding_min

_PLACE = np.uint64((1 << 24) - 1)


@dataclass
class Runs:
    """Runs of windows with one seed: first and last window start, place of the seed, hashes of the seed and of the run's symbols about it, text index."""

    first: np.ndarray
    last: np.ndarray
    place: np.ndarray
    seed: np.ndarray
    content: np.ndarray
    text: np.ndarray


@dataclass
class Marks:
    """Distinct seeds' places of shorter windows: place, hash of the seed, text index."""

    place: np.ndarray
    seed: np.ndarray
    text: np.ndarray


def _chosen(ranked: np.ndarray, text: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one text, and the place of each one's seed."""
    n = len(text) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = sliding_min(ranked, window - gram + 1)[:n]
    starts = np.flatnonzero(text[:n] == text[window - 1 :])
    return starts, (least[starts] & _PLACE).astype(np.int64)


def runs(symbols: np.ndarray, offsets: np.ndarray, gram: int, window: int) -> Runs:
    """Runs of all texts; symbols are 64-bit hashes, offsets the texts' starts and the end, by symbol."""
    return runs_and_marks(symbols, offsets, gram, window, 0)[0]


def runs_and_marks(symbols: np.ndarray, offsets: np.ndarray, gram: int, window: int, near: int) -> tuple[Runs, Marks]:
    """runs(), and the seeds of windows of `near` symbols if it is not 0.

    Seeds of the longer windows are among those of the shorter ones. The symbols of one call must stay
    under 2**24; longer texts are cut by the caller with an overlap of window - 1 symbols.
    """
    if len(symbols) >= 1 << 24:
        raise ValueError("too many symbols in one call")
    prefix = Prefix(symbols)
    grams = prefix.windows(gram)
    ranked = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = _chosen(ranked, text, gram, near)[1] if near else np.zeros(0, np.int64)
    at = at[np.concatenate((np.ones(min(1, len(at)), bool), at[1:] != at[:-1]))]  # places rise with the windows
    marks = Marks(at, grams[at], text[at])
    starts, place = _chosen(ranked, text, gram, window)
    cut = np.flatnonzero(np.concatenate((np.ones(min(1, len(starts)), bool), (place[1:] != place[:-1]) | (np.diff(starts) != 1))))
    first, last = starts[cut], starts[np.append(cut, len(starts))[1:] - 1]
    place = place[cut]
    content = prefix.ranges(first, last + window) ^ ((place - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return Runs(first, last, place, grams[place], content, text[first]), marks
