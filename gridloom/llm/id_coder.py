"""Adaptive context-mixing range coder for blocks of token ids.

Three models predict the next id: the id that followed the two ids before it (order 2), the one that
followed the id before it (order 1), and frequencies of ids (order 0). Orders 2 and 1 keep a confidence with
each prediction; the likelier one of the two is the candidate. How likely it is follows from both confidences,
whether both orders agree, and the candidate's order-0 frequency, mixed in the logistic domain with weights that
learn. The id is range coded in one event: the candidate's share of the range, and the rest of it by order-0
frequencies, in which ids not yet met share an escape.

Every block starts anew and carries a checksum, so blocks are decoded apart from each other. Within a
block, lanes of consecutive ids are coded side by side with common models: each step handles one id of every
lane with array operations. The inputs of the mixer take few values, so it mixes and learns once for
each combination of these (a cell), not for each id. All arithmetic is on integers, and of lanes that
change the same entry in one step the last one counts, so every machine decodes what another one coded.

A block is: 4 bytes number of ids, 4 bytes CRC-32 of the ids, 4 bytes size of the code, the code: 32-bit
words in the order in which the lanes read them.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

HEAD = struct.Struct("<III")
BLOCK_IDS = 3 << 20
#: Lanes of a block, and ids that a lane has at least if there are several.
LANES, LANE_IDS = 8192, 256
#: No byte of code holds as many ids: the likeliest candidate takes 0.011 bits.
IDS_A_BYTE = 1024
ORDER1, ORDER2 = 1 << 16, 1 << 17
#: Bits of a confidence, and of the order-0 share of a candidate as the mixer sees it.
SURE_BITS, SHARE_BITS = 3, 4
SUREST = (1 << SURE_BITS) - 1
CELLS = 1 << 2 * SURE_BITS + 1 + SHARE_BITS
#: Steps after which the mixer learns and the order-0 frequencies are counted, once a block is under way.
MIX_EVERY, COUNT_EVERY = 16, 32
#: Order-0 frequencies sum up to this; ids that have one of their own.
TOTAL, MOST_IDS = 1 << 16, 1 << 15
_SETTLED, _WORD = np.uint64(1 << 32), np.uint64(32)
_HALF = np.uint64(16)


class BlockError(ValueError):
    """A block's code or checksum is damaged."""


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Integer tables of the logistic function (of x / 256, to 12 bits) and of its inverse."""
    squash = np.empty(4096, np.int64)
    # 4096 / (1 + exp(-x)) at x = -8, -7.5, ..., 8.
    knots = [1, 2, 4, 6, 10, 17, 27, 45, 74, 120, 194, 310, 488, 747, 1102, 1546, 2048, 2550, 2994, 3349, 3608, 3786, 3902, 3976, 4022, 4051, 4069, 4079, 4086, 4090, 4092, 4093, 4094]
    for x in range(4096):
        i, part = divmod(x, 128)
        squash[x] = (knots[i] * (128 - part) + knots[i + 1] * part) // 128
    stretch = np.searchsorted(squash, np.arange(4096)).clip(0, 4095) - 2048
    return squash, stretch


SQUASH, STRETCH = _tables()
#: What a cell is made of.
_CELL = np.arange(CELLS)
_SURE2, _SURE1 = _CELL >> SURE_BITS + 1 + SHARE_BITS, _CELL >> 1 + SHARE_BITS & SUREST
_AGREE, _SHARE = (_CELL >> SHARE_BITS & 1).astype(bool), _CELL & (1 << SHARE_BITS) - 1


class _Mixer:
    """Chances of the candidate by cell, and how they are learned."""

    def __init__(self):
        # Times that a prediction was tried and right: by order and confidence, and by order-0 share.
        levels = np.arange(SUREST + 1)
        self.tried = [np.full(SUREST + 1, 16), np.full(SUREST + 1, 16), np.full(1 << SHARE_BITS, 16)]
        self.right = [1 + levels * 13 // SUREST, 1 + levels * 13 // SUREST, np.full(1 << SHARE_BITS, 2)]
        self.weights = np.full((4, 3), 1 << 14)  # of 2**16, by agreement and order of the candidate
        self.mix()

    def mix(self) -> None:
        one, two, zero = (STRETCH[(r << 12) // t] for r, t in zip(self.right, self.tried, strict=True))
        #: Whether the candidate is that of order 2, by confidences of orders 2 and 1.
        self.second = (two[:, None] >= one[None, :]).ravel()
        second = self.second[_SURE2 << SURE_BITS | _SURE1]
        one, two = one[_SURE1], two[_SURE2]
        other = np.where(second, one, two)
        self.inputs = np.stack([np.where(second, two, one), np.where(_AGREE, other, -(other + 2048) >> 1), zero[_SHARE]])
        self.set = _AGREE * 2 + second
        self.of_second = second
        mixed = (self.weights[self.set].T * self.inputs).sum(axis=0) >> 15
        self.chance = SQUASH[mixed.clip(-2047, 2047) + 2048].clip(4, 4064)
        self.bound = (self.chance << 4).astype(np.uint64)

    def learn(self, seen: np.ndarray) -> None:
        """seen: by cell, times that the candidate was wrong and right."""
        tried, right = seen.sum(axis=1), seen[:, 1]
        error = right * 4095 - tried * self.chance
        for k in range(4):
            own = self.set == k
            count = int(tried[own].sum())
            if count:
                self.weights[k] += (self.inputs[:, own] * error[own]).sum(axis=1) // count >> 7
        np.clip(self.weights, -(1 << 17), 1 << 17, out=self.weights)
        mine = [~self.of_second | _AGREE, self.of_second | _AGREE, np.ones(CELLS, bool)]
        for k, (level, size) in enumerate(((_SURE1, SUREST + 1), (_SURE2, SUREST + 1), (_SHARE, 1 << SHARE_BITS))):
            for total, new in ((self.tried[k], tried), (self.right[k], right)):
                sums = np.zeros(size, np.int64)
                np.add.at(sums, level[mine[k]], new[mine[k]])
                total += sums
            full = self.tried[k] > 1 << 18
            self.tried[k] -= np.where(full, self.tried[k] >> 1, 0)
            self.right[k] -= np.where(full, self.right[k] >> 1, 0)
            np.minimum(self.right[k], self.tried[k] - 1, out=self.right[k])
            np.maximum(self.right[k], 1, out=self.right[k])
        self.mix()


class _Frequencies:
    """Order-0 frequencies of ids, with an escape for those that have none."""

    def __init__(self, vocabulary: int):
        self.escape = vocabulary
        self.counts = np.zeros(vocabulary, np.int64)
        self._build(np.zeros(0, np.int64), np.zeros(0, np.int64))

    def count(self, ids: np.ndarray) -> None:
        self.counts += np.bincount(ids.ravel(), minlength=self.escape)
        known = np.flatnonzero(self.counts)
        least = 1
        while len(known) > MOST_IDS:
            least += 1
            known = known[self.counts[known] >= least]
        self._build(known, self.counts[known])

    def _build(self, known: np.ndarray, counts: np.ndarray) -> None:
        # The escape gets about as much as the ids met once.
        rare = int((counts == 1).sum()) + 1
        counts = np.append(counts, rare)
        sizes = 1 + counts * (TOTAL - len(counts)) // counts.sum()
        sizes[-1] += TOTAL - sizes.sum()
        symbols = np.append(known, self.escape)
        starts = np.cumsum(sizes) - sizes
        #: start << 32 | size by id.
        self.place = np.full(self.escape + 1, int(starts[-1]) << 32 | int(sizes[-1]), np.uint64)
        self.place[known] = starts[:-1].astype(np.uint64) << _WORD | sizes[:-1].astype(np.uint64)
        self.symbol = np.repeat(symbols, sizes)
        self.known = np.zeros(self.escape, bool)
        self.known[known] = True
        self.share = np.zeros(self.escape, np.int64)
        self.share[known] = np.minimum(np.frexp(sizes[:-1].astype(float))[1], (1 << SHARE_BITS) - 1)


class _Writer:
    def __init__(self, lanes: int, steps: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.at = np.zeros(lanes, np.int64)
        self.words = np.zeros((4 * steps + 4, lanes), np.uint64)  # above 32 bits: carries; what is not written takes no memory
        self.read: list[np.ndarray] = []

    def _carry(self, lanes: np.ndarray) -> None:
        if len(lanes):
            self.words[self.at[lanes] - 1, lanes] += np.uint64(1)

    def _settle(self, lanes: np.ndarray) -> None:
        at, low = self.at[lanes], self.low[lanes]
        self.words[at, lanes] += low >> _WORD
        self.read.append((at + 2) * len(self.low) + lanes)
        self.at[lanes] = at + 1
        self.low[lanes] = low << _WORD
        self.range[lanes] <<= _WORD

    def event(self, bound: np.ndarray, hit: np.ndarray, frequencies: _Frequencies, guess: np.ndarray, ids: np.ndarray) -> np.ndarray:
        cut = (self.range >> _HALF) * bound
        low = self.low
        miss = np.flatnonzero(~hit)
        cut_miss = cut[miss]
        place = frequencies.place[ids[miss]]
        unit = (self.range[miss] - cut_miss) >> _HALF
        old = low[miss]
        new = old + cut_miss + unit * (place >> _WORD)
        self.range = cut
        cut[miss] = unit * (place & np.uint64(0xFFFFFFFF))
        low[miss] = new
        self._carry(miss[new < old])
        self._settle(np.flatnonzero(cut < _SETTLED))
        escaped = miss[~frequencies.known[ids[miss]]]
        if len(escaped):
            for shift in _shifts(frequencies.escape):
                unit = self.range[escaped] >> _HALF
                old = self.low[escaped]
                new = old + unit * (ids[escaped] >> shift & 0xFFFF).astype(np.uint64)
                self.low[escaped], self.range[escaped] = new, unit
                self._carry(escaped[new < old])
                self._settle(escaped[unit < _SETTLED])
        return ids

    def finish(self) -> bytes:
        lanes, every = len(self.low), np.arange(len(self.low))
        # The upper word rounded up, with zeros below, lies in the range; the reader finds zeros after it.
        new = self.low + (_SETTLED - np.uint64(1))
        self._carry(np.flatnonzero(new < self.low))
        self.words[self.at, every] += new >> _WORD
        most = int(self.at.max()) + 2
        words = self.words[:most]
        while (over := words >> _WORD).any():
            words &= np.uint64(0xFFFFFFFF)
            words[:-1] += over[1:]
        return words.ravel()[np.concatenate([np.arange(2 * lanes), *self.read])].astype("<u4").tobytes()


class _Reader:
    def __init__(self, code: bytes, lanes: int):
        if len(code) % 4 or len(code) < 8 * lanes:
            raise BlockError("a block's code has no whole words")
        self.words = np.frombuffer(code, "<u4")
        self.code = self.words[:lanes].astype(np.uint64) << _WORD | self.words[lanes : 2 * lanes]
        self.range = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.at = 2 * lanes

    def _settle(self, lanes: np.ndarray) -> None:
        words = self.words[self.at : self.at + len(lanes)]
        if len(words) < len(lanes):
            raise BlockError("a block's code ends too early")
        self.at += len(lanes)
        self.code[lanes] = self.code[lanes] << _WORD | words
        self.range[lanes] <<= _WORD

    def event(self, bound: np.ndarray, _, frequencies: _Frequencies, guess: np.ndarray, __) -> np.ndarray:
        cut = (self.range >> _HALF) * bound
        miss = np.flatnonzero(self.code >= cut)
        cut_miss = cut[miss]
        code = self.code[miss] - cut_miss
        unit = (self.range[miss] - cut_miss) >> _HALF
        got = frequencies.symbol[np.minimum(code // unit, np.uint64(TOTAL - 1)).astype(np.int64)]
        place = frequencies.place[got]
        self.range = cut
        cut[miss] = unit * (place & np.uint64(0xFFFFFFFF))
        self.code[miss] = code - unit * (place >> _WORD)
        self._settle(np.flatnonzero(cut < _SETTLED))
        escaped = np.flatnonzero(got == frequencies.escape)
        if len(escaped):
            lanes = miss[escaped]
            value = np.zeros(len(lanes), np.int64)
            for shift in _shifts(frequencies.escape):
                unit = self.range[lanes] >> _HALF
                digit = np.minimum(self.code[lanes] // unit, np.uint64(0xFFFF))
                value |= digit.astype(np.int64) << shift
                self.code[lanes] -= unit * digit
                self.range[lanes] = unit
                self._settle(lanes[unit < _SETTLED])
            if (value >= frequencies.escape).any():
                raise BlockError("a block holds an id beyond its vocabulary")
            got[escaped] = value
        guess[miss] = got
        return guess


def _shifts(vocabulary: int) -> range:
    """Of the 16-bit digits of an id, the highest first."""
    return range((max(vocabulary - 1, 1).bit_length() - 1) // 16 * 16, -1, -16)


def _shape(size: int) -> tuple[int, int]:
    """Steps and lanes of a block."""
    steps = -(-size // min(LANES, max(1, size // LANE_IDS)))
    return steps, -(-size // steps)


def _run(coder, steps: int, lanes: int, ids: np.ndarray | None, vocabulary: int) -> np.ndarray:
    """Ids by step and lane; ids is None to read them."""
    mixer, frequencies = _Mixer(), _Frequencies(vocabulary)
    # prediction << SURE_BITS | confidence
    first, second = np.zeros(ORDER1, np.int64), np.zeros(ORDER2, np.int64)
    out = np.zeros((steps, lanes), np.int64) if ids is None else ids
    seen = np.zeros((MIX_EVERY, lanes), np.int64)
    held = counted = 0
    before = last = np.zeros(lanes, np.int64)
    for step in range(steps):
        slot1 = last & ORDER1 - 1
        slot2 = (before * 0x9E35 + last * 0x2C1B >> 3) & ORDER2 - 1
        entry1, entry2 = first[slot1], second[slot2]
        guess1, guess2 = entry1 >> SURE_BITS, entry2 >> SURE_BITS
        sure1, sure2 = entry1 & SUREST, entry2 & SUREST
        sure = sure2 << SURE_BITS | sure1
        guess = np.where(mixer.second[sure], guess2, guess1)
        cell = (sure << 1 | (guess1 == guess2)) << SHARE_BITS | frequencies.share[guess]
        own = None if ids is None else ids[step]
        hit = None if ids is None else guess == own
        got = coder.event(mixer.bound[cell], hit, frequencies, guess.copy(), own)
        if ids is None:
            out[step] = got
            hit = guess == got
        seen[held] = cell << 1 | hit
        held += 1
        early = not step & step + 1  # after 1, 2, 4, ... steps
        if held == MIX_EVERY or early:
            mixer.learn(np.bincount(seen[:held].ravel(), minlength=2 * CELLS).reshape(CELLS, 2))
            held = 0
        fresh = got << SURE_BITS
        for table, slot, entry, known, sure in ((first, slot1, entry1, guess1, sure1), (second, slot2, entry2, guess2, sure2)):
            table[slot] = np.where(known == got, entry + (sure < SUREST), np.where(sure > 0, entry - 1, fresh))
        if step + 1 - counted == COUNT_EVERY or early:
            frequencies.count(out[counted : step + 1])
            counted = step + 1
        before, last = last, got
    return out


def encode_blocks(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """Each block of ids (smaller than vocabulary) as bytes."""
    out = []
    for block in blocks:
        code = b""
        if len(block):
            steps, lanes = _shape(len(block))
            ids = np.zeros(steps * lanes, np.int64)
            ids[: len(block)] = block
            coder = _Writer(lanes, steps)
            _run(coder, steps, lanes, np.ascontiguousarray(ids.reshape(lanes, steps).T), vocabulary)
            code = coder.finish()
        out.append(HEAD.pack(len(block), zlib.crc32(block.astype("<u4").tobytes()), len(code)) + code)
    return out


def split_blocks(data: bytes) -> list[bytes]:
    """The blocks that stand one after another in data."""
    out, at = [], 0
    while at < len(data):
        if at + HEAD.size > len(data) or at + HEAD.size + HEAD.unpack_from(data, at)[2] > len(data):
            raise BlockError("data end within a block")
        stop = at + HEAD.size + HEAD.unpack_from(data, at)[2]
        out.append(data[at:stop])
        at = stop
    return out


def decode_blocks(blocks: list[bytes], vocabulary: int) -> list[np.ndarray]:
    """The ids of each block; BlockError if a checksum does not fit."""
    out = []
    for block in blocks:
        size, check, _ = HEAD.unpack_from(block)
        ids = np.zeros(0, "<u4")
        if size > IDS_A_BYTE * len(block):
            raise BlockError(f"{len(block)} bytes hold no {size} ids")
        if size:
            steps, lanes = _shape(size)
            ids = _run(_Reader(block[HEAD.size :], lanes), steps, lanes, None, vocabulary).T.ravel()[:size].astype("<u4")
        if zlib.crc32(ids.tobytes()) != check:
            raise BlockError(f"checksum of a block of {size} ids does not fit")
        out.append(ids)
    return out
