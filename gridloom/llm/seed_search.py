"""Distributed search for windows that occur elsewhere, by winnowed seeds.

Documents are dealt to chunks of a few megabytes, and three rounds run over the chunks:

1. Each chunk asks for its distinct seeds; the bucket of a seed answers whether it occurs again, and
   for marks (seeds of shorter windows, where they are wanted) whether another document has it.
2. Each chunk sends the distinct regions (the symbols of a run of windows) of such seeds; a bucket
   holds all regions of its seeds and decides, by the operator's own method, which of their windows
   occur elsewhere.
3. Each chunk puts the verdicts together for its documents.

A chunk sends a seed or a region once, however many of its documents hold it, so a passage in a
third of all rows reaches its bucket as a row for each chunk. A seed with very many different regions
(a common passage in ever new surroundings) is not gathered: its windows are sent each under their
own 128-bit hash, which deals them evenly. Chunks and buckets grow in number with the input.

All rounds are one plan; the chunks' exchange is the same in each and is reused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import groups_for, input_bytes, utf8_of
from gridloom.llm.hashing import Prefix, mix, spread
from gridloom.llm.seeds import Runs, runs_and_marks

DEAD, LIVE, HOT = 0, 1, 2
#: Symbols that are worked on at a time.
SLAB = 1 << 20
LAST_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Plan:
    """What is searched, and in what portions: bytes of text for a chunk and a bucket, and the regions of a seed from which on it is hot.

    near: shorter windows whose seeds are only asked for (marks); 0 for none.
    """

    window: int
    gram: int
    near: int = 0
    chunk_bytes: int = 3 << 20
    bucket_bytes: int = 6 << 20
    hot_regions: int = 2048


@dataclass
class Regions:
    """Requests of one bucket: a row for each chunk's distinct region."""

    seed: np.ndarray
    content: np.ndarray
    owner: np.ndarray  # smallest document id
    weight: np.ndarray  # 1, or 2 if the chunk holds the region more often
    start: np.ndarray  # offsets of the symbols in `symbols`, and the end
    symbols: np.ndarray


class Chunk:
    """The runs of a chunk's documents."""

    def __init__(self, group: pa.Table, plan: Plan, symbols_of: Callable[[bytes], np.ndarray], hash_of: Callable[[np.ndarray], np.ndarray], marks: bool = False):
        self.plan, self.hash_of, self.shortest = plan, hash_of, plan.near if marks and plan.near else plan.window
        ids = group.column("doc_id")
        self.ids = ids.to_pylist()
        self.owner = np.array([LAST_ID if i is None else i for i in self.ids], np.int64)
        self.texts = list(utf8_of(group.column("text")))
        self.symbols = [symbols_of(t) for t in self.texts]
        parts: list[tuple[Runs, np.ndarray, np.ndarray]] = []
        near: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for slab in self._slabs():
            flat = hash_of(np.concatenate([self.symbols[d][a:b] for d, a, b in slab]))
            offsets = np.concatenate(([0], np.cumsum([b - a for _, a, b in slab])))
            doc, start = np.array([d for d, _, _ in slab]), np.array([a for _, a, _ in slab])
            found, own = runs_and_marks(flat, offsets, plan.gram, plan.window, plan.near if marks else 0)
            parts.append((found, doc[found.text], start[found.text] - offsets[found.text]))
            near.append((doc[own.text], own.place + start[own.text] - offsets[own.text], own.seed))
        self.mark_doc, self.mark_place, self.mark_seed = (np.concatenate(x) for x in zip(*near, strict=True))
        join = lambda pick, kind: np.concatenate([pick(*p) for p in parts]) if parts else np.zeros(0, kind)
        self.doc = join(lambda r, d, s: d, np.int64)
        self.first = join(lambda r, d, s: r.first + s, np.int64)
        self.last = join(lambda r, d, s: r.last + s, np.int64)
        self.seed = join(lambda r, d, s: r.seed, np.uint64)
        self.content = join(lambda r, d, s: r.content, np.uint64)

    def _slabs(self) -> Iterator[list[tuple[int, int, int]]]:
        """Lists of (document, from, to), of SLAB symbols or little more; a long document is cut so that each window start falls to one part."""
        slab, size = [], 0
        for d, own in enumerate(self.symbols):
            if len(own) < self.shortest:
                continue
            for a in range(0, max(1, len(own) - self.plan.window + 1), SLAB):
                b = min(a + SLAB + self.plan.window - 1, len(own))
                if slab and size + b - a > SLAB:
                    yield slab
                    slab, size = [], 0
                slab.append((d, a, b))
                size += b - a
        if slab:
            yield slab

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct seeds, and for each its number of different regions and whether it occurs more than once."""
        order = np.lexsort((self.content, self.seed))
        seed, content = self.seed[order], self.content[order]
        head = np.flatnonzero(np.concatenate((np.ones(min(1, len(seed)), bool), seed[1:] != seed[:-1])))
        fresh = np.concatenate((np.ones(min(1, len(seed)), bool), (seed[1:] != seed[:-1]) | (content[1:] != content[:-1])))
        if not len(seed):
            return seed, head, head.astype(bool)
        return seed[head], np.add.reduceat(fresh.astype(np.int64), head), np.diff(np.append(head, len(seed))) > 1

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct seeds of each document's shorter windows, and the documents."""
        order = np.lexsort((self.mark_doc, self.mark_seed))
        seed, doc = self.mark_seed[order], self.mark_doc[order]
        fresh = np.concatenate((np.ones(min(1, len(seed)), bool), (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])))
        return seed[fresh], doc[fresh]

    def codes(self, answers: dict[int, np.ndarray], buckets: int) -> np.ndarray:
        """The answer for each run."""
        unique, back = np.unique(self.seed, return_inverse=True)
        code = np.zeros(len(unique), np.uint8)
        place = (unique % np.uint64(buckets)).astype(np.int64)
        for b, got in answers.items():
            code[place == b] = got
        return code[back]

    def names(self) -> np.ndarray:
        """Hashes of the texts."""
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.texts), np.uint64, len(self.texts))

    def regions(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the live runs: their places, the place in `first` of each one's region, and the runs that stand first for their regions, in order of seed and content."""
        live = np.flatnonzero(code == LIVE)
        order = live[np.lexsort((self.owner[self.doc[live]], self.content[live], self.seed[live]))]
        seed, content = self.seed[order], self.content[order]
        fresh = np.concatenate((np.ones(min(1, len(seed)), bool), (seed[1:] != seed[:-1]) | (content[1:] != content[:-1])))
        return order, np.cumsum(fresh) - 1, order[fresh]

    def windows(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the hot runs' windows: document, start, and two 64-bit hashes."""
        hot = np.flatnonzero(code == HOT)
        if not len(hot):
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64), none.astype(np.uint64)
        count = self.last[hot] - self.first[hot] + 1
        doc = np.repeat(self.doc[hot], count)
        start = spread(self.first[hot], count)
        one, two = np.zeros(len(doc), np.uint64), np.zeros(len(doc), np.uint64)
        for d in np.unique(doc):
            at = np.flatnonzero(doc == d)
            # Only the stretch of the document that the windows touch is hashed.
            low, high = start[at].min(), start[at].max() + self.plan.window
            flat = self.hash_of(self.symbols[d][low:high])
            a, b = start[at] - low, start[at] - low + self.plan.window
            one[at], two[at] = Prefix(flat).ranges(a, b), Prefix(mix(flat ^ np.uint64(0x5851F42D4C957F2D))).ranges(a, b)
        return doc, start, one, two


ASK = "bucket int, chunk long, kind int, seeds binary, notes binary"
#: Kinds of messages: seeds and their codes, regions and windows with their verdicts, marks and which are shared, and the names of a chunk's documents.
SEEDS, REGIONS, WINDOWS, MARKS, NAMES = range(5)


def _dealt(seed: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of the seeds of each bucket."""
    place = (seed % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    used, at = np.unique(place[order], return_index=True)
    yield from zip(used.tolist(), np.split(order, at[1:]), strict=True) if len(used) else ()


def _ask(chunk: Chunk, number: int, buckets: int) -> pa.Table:
    seed, different, often = chunk.seeds()
    notes = (np.minimum(different, 32767).astype(np.uint16) << np.uint16(1)) | often.astype(np.uint16)
    rows = [(b, SEEDS, seed[own].tobytes(), notes[own].tobytes()) for b, own in _dealt(seed, buckets)]
    if chunk.plan.near:
        mark, doc = chunk.marks()
        rows += [(b, MARKS, mark[own].tobytes(), doc[own].astype(np.uint32).tobytes()) for b, own in _dealt(mark, buckets)]
        rows.append((number % buckets, NAMES, chunk.names().tobytes(), b""))
    return pa.table({
        "bucket": pa.array([r[0] for r in rows], pa.int32()),
        "chunk": pa.array([number] * len(rows), pa.int64()),
        "kind": pa.array([r[1] for r in rows], pa.int32()),
        "seeds": pa.array([r[2] for r in rows], pa.binary()),
        "notes": pa.array([r[3] for r in rows], pa.binary()),
    })


def _answer(group: pa.Table, hot_regions: int) -> pa.Table:
    kind = group.column("kind").to_numpy()
    seeds = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("seeds")]
    notes = group.column("notes")
    replies: dict[int, bytes] = {int(i): seeds[i].tobytes() for i in np.flatnonzero(kind == NAMES)}
    for of, width in ((SEEDS, np.uint16), (MARKS, np.uint32)):
        rows = np.flatnonzero(kind == of).tolist()
        if not rows:
            continue
        note = np.concatenate([np.frombuffer(notes[i].as_py(), width) for i in rows])
        unique, back = np.unique(np.concatenate([seeds[i] for i in rows]), return_inverse=True)
        cut = np.concatenate(([0], np.cumsum([len(seeds[i]) for i in rows])))
        if of == SEEDS:
            times = np.bincount(back, 1 + (note & 1), len(unique))
            different = np.bincount(back, note >> 1, len(unique))
            code = np.where(times < 2, DEAD, np.where(different > hot_regions, HOT, LIVE)).astype(np.uint8)[back]
            replies |= {i: code[a:b].tobytes() for i, a, b in zip(rows, cut[:-1], cut[1:], strict=True)}
        else:  # a mark comes once for each document
            shared = np.bincount(back, minlength=len(unique))[back] > 1
            replies |= {i: note[a:b][shared[a:b]].tobytes() for i, a, b in zip(rows, cut[:-1], cut[1:], strict=True)}
    return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "kind": group.column("kind"), "reply": pa.array([replies[i] for i in range(group.num_rows)], pa.binary())})


REQUEST = "bucket int, chunk long, kind int, keys binary, owners binary, weights binary, sizes binary, symbols binary"
REPLY = "chunk long, bucket int, kind int, reply binary"


def _send(chunk: Chunk, number: int, code: np.ndarray, buckets: int) -> pa.Table:
    rows = []
    order, region, lead = chunk.regions(code)
    if len(lead):
        weight = np.minimum(np.bincount(region), 2).astype(np.uint8)
        place = (chunk.seed[lead] % np.uint64(buckets)).astype(np.int64)
        for b in np.unique(place):
            own = np.flatnonzero(place == b)
            run = lead[own]
            parts = [chunk.symbols[d][a : z + chunk.plan.window] for d, a, z in zip(chunk.doc[run].tolist(), chunk.first[run].tolist(), chunk.last[run].tolist(), strict=True)]
            keys = np.stack([chunk.seed[run], chunk.content[run]], axis=1)
            rows.append((int(b), number, REGIONS, keys.tobytes(), chunk.owner[chunk.doc[run]].tobytes(), weight[own].tobytes(), np.array([len(p) for p in parts], np.int32).tobytes(), np.concatenate(parts).tobytes()))
    doc, _, one, two = chunk.windows(code)
    if len(doc):
        head, back, times, owner = _distinct_windows(one, two, chunk.owner[doc])
        place = (one[head] % np.uint64(buckets)).astype(np.int64)
        for b in np.unique(place):
            own = np.flatnonzero(place == b)
            keys = np.stack([one[head[own]], two[head[own]]], axis=1)
            rows.append((int(b), number, WINDOWS, keys.tobytes(), owner[own].tobytes(), np.minimum(times[own], 2).astype(np.uint8).tobytes(), b"", b""))
    kinds = [pa.int32(), pa.int64(), pa.int32()] + [pa.binary()] * 5
    names = [c.split()[0] for c in REQUEST.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _distinct_windows(one: np.ndarray, two: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place of one window of each content in order of hash, the content of each window, and each content's number and smallest owner."""
    order = np.lexsort((owner, two, one))
    fresh = np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])))
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(fresh) - 1
    head = order[fresh]
    return head, back, np.bincount(back), owner[head]


def _decide(group: pa.Table, plan: Plan, dtype: np.dtype, solve: Callable[[Regions, Plan], list[np.ndarray]], by_owner: bool) -> pa.Table:
    """Replies: a flag for each window of each requested region, and for each requested window; 1 if it occurs elsewhere (before, if by_owner)."""
    kind = group.column("kind").to_numpy()
    column = lambda name, rows, t: [np.frombuffer(group.column(name)[int(i)].as_py(), t) for i in rows]
    replies: dict[int, bytes] = {}
    rows = np.flatnonzero(kind == REGIONS)
    if len(rows):
        keys = [k.reshape(-1, 2) for k in column("keys", rows, np.uint64)]
        all_keys = np.concatenate(keys)
        size = np.concatenate(column("sizes", rows, np.int32)).astype(np.int64)
        regions = Regions(all_keys[:, 0], all_keys[:, 1], np.concatenate(column("owners", rows, np.int64)), np.concatenate(column("weights", rows, np.uint8)).astype(np.int64), np.concatenate(([0], np.cumsum(size))), np.concatenate(column("symbols", rows, dtype)))
        flags = solve(regions, plan)
        at = 0
        for i, k in zip(rows, keys, strict=True):
            replies[int(i)] = np.concatenate(flags[at : at + len(k)]).astype(np.uint8).tobytes()
            at += len(k)
    rows = np.flatnonzero(kind == WINDOWS)
    if len(rows):
        keys = [k.reshape(-1, 2) for k in column("keys", rows, np.uint64)]
        flat, owner, weight = np.concatenate(keys), np.concatenate(column("owners", rows, np.int64)), np.concatenate(column("weights", rows, np.uint8))
        head, back, _, least = _distinct_windows(flat[:, 0], flat[:, 1], owner)
        flag = (least[back] < owner) if by_owner else np.bincount(back, weight)[back] >= 2
        at = 0
        for i, k in zip(rows, keys, strict=True):
            replies[int(i)] = flag[at : at + len(k)].astype(np.uint8).tobytes()
            at += len(k)
    return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "kind": group.column("kind"), "reply": pa.array([replies[i] for i in range(group.num_rows)], pa.binary())})


def _hits(chunk: Chunk, code: np.ndarray, replies: dict[tuple[int, int], np.ndarray], buckets: int, by_owner: bool) -> tuple[np.ndarray, np.ndarray]:
    """Documents and starts of the windows that occur elsewhere."""
    docs, starts = [], []
    order, region, lead = chunk.regions(code)
    if len(lead):
        place = (chunk.seed[lead] % np.uint64(buckets)).astype(np.int64)
        count = chunk.last[lead] - chunk.first[lead] + 1
        base = np.concatenate(([0], np.cumsum(count)))
        flags = np.zeros(base[-1], bool)
        for b in np.unique(place):
            own = np.flatnonzero(place == b)
            flags[spread(base[own], count[own])] = replies[int(b), REGIONS] > 0
        size = count[region]
        hit = flags[spread(base[region], size)]
        if by_owner:
            hit |= np.repeat(chunk.owner[chunk.doc[order]] > chunk.owner[chunk.doc[lead]][region], size)
        docs.append(np.repeat(chunk.doc[order], size)[hit])
        starts.append(spread(chunk.first[order], size)[hit])
    doc, start, one, two = chunk.windows(code)
    if len(doc):
        head, back, _, owner = _distinct_windows(one, two, chunk.owner[doc])
        place = (one[head] % np.uint64(buckets)).astype(np.int64)
        flag = np.zeros(len(head), bool)
        for b in np.unique(place):
            flag[place == b] = replies[int(b), WINDOWS] > 0
        hit = flag[back]
        if by_owner:
            hit |= chunk.owner[doc] > owner[back]
        docs.append(doc[hit])
        starts.append(start[hit])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(starts)


def search(
    docs: DataFrame,
    plan: Plan,
    symbols_of: Callable[[bytes], np.ndarray],
    hash_of: Callable[[np.ndarray], np.ndarray],
    dtype: np.dtype,
    solve: Callable[[Regions, Plan], list[np.ndarray]],
    finish: Callable[[bytes, np.ndarray, int], tuple],
    schema: str,
    by_owner: bool,
) -> DataFrame:
    """doc_id and what finish(text, starts of windows that occur elsewhere, marks that other documents have too) gives, for each row of docs (doc_id, text).

    symbols_of cuts a text into symbols of a dtype, hash_of gives their 64-bit hashes; solve decides the
    windows of a bucket's regions. by_owner: a window counts only if it occurs under a smaller id.
    """
    size = input_bytes(docs)
    chunks, buckets = groups_for(size, plan.chunk_bytes), groups_for(size, plan.bucket_bytes)
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"), "doc_id", "text")

    def ask(key, group):
        return _ask(Chunk(group, plan, symbols_of, hash_of, marks=True), key[0].as_py(), buckets)

    def answer(group):
        return _answer(group, plan.hot_regions)

    def read(replies: pa.Table) -> tuple[dict[int, np.ndarray], dict[tuple[int, int], np.ndarray]]:
        got = {(b, k): np.frombuffer(r.as_py(), np.uint8) for b, k, r in zip(replies.column("bucket").to_pylist(), replies.column("kind").to_pylist(), replies.column("reply"), strict=True)}
        return {b: r for (b, k), r in got.items() if k == SEEDS}, got

    def shared_marks(chunk: Chunk, got: dict[tuple[int, int], np.ndarray], number: int) -> list[int]:
        """For each text how many of its marks are in other documents too; rows may come in another order than when they were marked, so texts are known by their names."""
        if not plan.near:
            return [0] * len(chunk.ids)
        names = got[number % buckets, NAMES].view(np.uint64)
        marked = np.concatenate([np.zeros(0, np.uint32), *[r.view(np.uint32) for (_, k), r in got.items() if k == MARKS]])
        count = dict(zip(names.tolist(), np.bincount(marked, minlength=len(names)).tolist(), strict=True))
        return [count[n] for n in chunk.names().tolist()]

    def send(key, group, replies):
        chunk = Chunk(group, plan, symbols_of, hash_of)
        return _send(chunk, key[0].as_py(), chunk.codes(read(replies)[0], buckets), buckets)

    def decide(group):
        return _decide(group, plan, dtype, solve, by_owner)

    def conclude(key, group, replies):
        chunk = Chunk(group, plan, symbols_of, hash_of)
        answers, got = read(replies)
        doc, start = _hits(chunk, chunk.codes(answers, buckets), got, buckets, by_owner)
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        cut = np.searchsorted(doc, np.arange(len(chunk.ids) + 1))
        marked = shared_marks(chunk, got, key[0].as_py())
        rows = [(i, *finish(t, start[a:b], m)) for i, t, a, b, m in zip(chunk.ids, chunk.texts, cut[:-1], cut[1:], marked, strict=True)]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        fields = [("doc_id", pa.int64()), *((c.split()[0], kinds[c.split()[1]]) for c in schema.split(", "))]
        return pa.table([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])

    grouped = dealt.groupBy("chunk")
    answers = grouped.applyInArrow(ask, ASK).groupBy("bucket").applyInArrow(answer, REPLY)
    verdicts = grouped.cogroup(answers.groupBy("chunk")).applyInArrow(send, REQUEST).groupBy("bucket").applyInArrow(decide, REPLY)
    return grouped.cogroup(answers.unionByName(verdicts).groupBy("chunk")).applyInArrow(conclude, f"doc_id long, {schema}")
