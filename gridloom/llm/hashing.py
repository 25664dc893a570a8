"""Vectorized hashes of bytes, words and windows.

Polynomial hashes modulo 2**64 with an odd base, taken from prefix sums and then mixed; symbols get
random 64-bit values first, so that the low bits are as good as the high ones.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: The separators of words: space and the control characters 9 to 13.
BLANKS = np.zeros(256, bool)
BLANKS[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    x ^= x >> U(33)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


@lru_cache(maxsize=2)
def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    size = 1 << 20
    while size < n:
        size *= 2
    return _powers(size, base)[:n]


class Prefix:
    """Prefix sums over 64-bit symbols, for the hash of any range in constant time."""

    def __init__(self, symbols: np.ndarray):
        self.sums = np.zeros(len(symbols) + 1, U)
        np.cumsum(symbols * powers(len(symbols)), out=self.sums[1:])

    def ranges(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of symbols[start:stop], arrays of equal length."""
        inverse = powers(len(self.sums), INVERSE)
        return mix((self.sums[stop] - self.sums[start]) * inverse[start] + (stop - start).astype(U))

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all windows of a size, by start."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, U)
        return mix((self.sums[size:] - self.sums[:n]) * powers(n, INVERSE) + U(size))


def word_spans(data: np.ndarray, separators: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs between separators."""
    edge = np.diff(np.concatenate(([True], separators[data], [True])).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    return Prefix(values[data]).ranges(starts, stops)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another with a line feed after each, and the offsets of their starts and of the end."""
    offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))
    return np.frombuffer(b"\n".join([*texts, b""]), np.uint8), offsets


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of a width, by start."""
    out, done = values, 1
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of true flags."""
    edge = np.diff(np.concatenate(([False], flags, [False])).view(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(starts: np.ndarray, stops: np.ndarray, size: int) -> np.ndarray:
    """Flags of the positions inside any of the ranges."""
    step = np.bincount(starts, minlength=size + 1).astype(np.int64)
    step -= np.bincount(stops, minlength=size + 1)
    return np.cumsum(step[:size]) > 0


def spread(base: np.ndarray, count: np.ndarray) -> np.ndarray:
    """base[i], base[i] + 1, ... for count[i] values, one after another."""
    total = np.cumsum(count)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(base - (total - count), count)
