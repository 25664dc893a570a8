"""Repeats of a minimum length in a set of texts, from a Burrows-Wheeler transform.

The suffixes of the texts are sorted by prefix doubling. Intervals of suffixes that share a prefix
are then expanded breadth-first by backward extension, one symbol in front at a time: the interval
of `c + w` within the transform follows from that of `w`. The level at which the end of an interval
is first met is the common prefix of the two suffixes there, so common prefixes come out by
increasing value, and the search stops at the minimum length. Neighbours whose common prefix is
still open then share at least that many symbols.
"""

from __future__ import annotations

import numpy as np

from gridloom.llm.hashing import spread


def suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sorted suffixes of texts that stand one after another, each closed by a 0 at `ends`; the closing zeros sort by place."""
    n = len(text)
    closed = np.zeros(n, bool)
    closed[ends] = True
    rank = np.zeros(n, np.int64)
    # The first 7 symbols of each suffix as one number; a suffix that ends earlier is padded by its end's own number later.
    padded = np.concatenate((text.astype(np.uint64), np.zeros(7, np.uint64)))
    left = np.searchsorted(ends, np.arange(n))
    room = ends[left] - np.arange(n)
    packed = np.zeros(n, np.uint64)
    for k in range(7):
        packed = (packed << np.uint64(8)) | np.where(room > k, padded[k : n + k], np.uint64(0))
    # Suffixes of under 7 symbols are told apart by which text's end they run into.
    short = room < 7
    order = np.argsort(packed, kind="stable")
    # stable: equal short suffixes keep the order of their places, which is the order of their ends
    new = np.concatenate(([True], packed[order[1:]] != packed[order[:-1]]))
    new |= short[order] | np.concatenate(([False], short[order[:-1]]))
    head = np.flatnonzero(new)
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    step, todo = 7, np.flatnonzero(~new)
    open_group = np.zeros(n, bool)
    open_group[todo] = True
    open_group[todo - 1] = True
    where = np.flatnonzero(open_group)  # places in `order` whose groups have several members
    while len(where):
        members = order[where]
        second = rank[np.minimum(members + step, n - 1)]
        key = rank[members] * np.int64(n) + second
        again = np.argsort(key, kind="stable")
        members, key = members[again], key[again]
        order[where] = members
        same = np.concatenate(([False], key[1:] == key[:-1]))
        first = rank[members]  # ranks are the places of the groups' heads
        group_start = np.concatenate(([True], first[1:] != first[:-1]))
        at = np.arange(len(members))
        begin = np.maximum.accumulate(np.where(group_start, at, 0))
        head = np.maximum.accumulate(np.where(~same, at, 0))
        rank[members] = first + (head - begin)
        still = same.copy()
        still[:-1] |= same[1:]
        where = where[still]
        step *= 2
    return order


def open_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Flags over the sorted suffixes: whether one has at least `length` symbols in common with the one before it."""
    n = len(text)
    front = text[order - 1].astype(np.int64)  # the transform; text[-1] closes the last text
    # The place of (symbol, i) in the sorted transform is the start of the extended interval.
    steps = np.argsort(front, kind="stable")
    extend = np.empty(n, np.int64)
    extend[steps] = np.arange(n)
    sigma = int(front.max()) + 1
    open_at = np.ones(n + 1, bool)
    open_at[0] = open_at[n] = False
    low, high = np.array([0]), np.array([n])
    closers = int(np.searchsorted(text[order], 1))
    for level in range(length):
        # The distinct symbols in front of each interval, with their first and last place in it.
        size = high - low
        one = size == 1
        spot = low[one]
        spot = spot[front[spot] > 0]
        new_low, new_high = [extend[spot]], [extend[spot] + 1]
        wide_low, size = low[~one], size[~one]
        if len(size):
            owner = np.repeat(np.arange(len(size)), size)
            at = spread(wide_low, size)
            place, symbol = extend[at], front[at]
            # Within an interval equal symbols extend to neighbouring places: runs of (owner, place) are intervals.
            turn = np.argsort(place, kind="stable")
            place, owner, symbol = place[turn], owner[turn], symbol[turn]
            head = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1] + 1) | (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1]))))
            tail = np.append(head[1:], len(place)) - 1
            real = symbol[head] > 0
            new_low.append(place[head][real])
            new_high.append(place[tail][real] + 1)
        if level == 0:  # the closing zeros are symbols of their own, which nothing extends
            new_low.append(np.arange(closers))
            new_high.append(np.arange(closers) + 1)
        low, high = np.concatenate(new_low), np.concatenate(new_high)
        fresh = open_at[high]
        low, high = low[fresh], high[fresh]
        open_at[high] = False
        if not len(low):
            break
    return open_at[:n]


def repeated_starts(texts: list[bytes], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text, flags of the starts whose next `length` bytes start anywhere else too; a text of weight w stands for w equal ones."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(sizes) - 1
    raw = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    present = np.zeros(256, bool)
    inside = np.ones(len(raw), bool)
    inside[ends] = False
    present[raw[inside]] = True
    code = np.zeros(256, np.uint8 if present.sum() < 255 else np.uint16)
    code[present] = np.arange(1, present.sum() + 1)
    text = np.where(inside, code[raw], 0)
    order = suffix_array(text, ends)
    shared = open_prefixes(text, order, length)
    head = np.flatnonzero(~shared)
    owner = np.searchsorted(ends, order)
    weight = np.add.reduceat(weights[owner], head)
    whole = ends[owner] - order >= length
    flags = np.zeros(len(text), bool)
    flags[order] = (np.repeat(weight, np.diff(np.append(head, len(order)))) >= 2) & whole
    return np.split(flags, np.cumsum(sizes)[:-1])
