"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The n-grams of the test items are counted over the whole corpus. Those that occur are seeds: all of
a short item, and of a longer one the rarest of every few neighbours, so that any unedited stretch of
a few words holds one. Seeds join passages of the documents to items, and a local alignment of words
scores each passage, so that copies with words changed, added or left out are found too.

All of it is tables and joins: two passes over the documents, one that counts n-grams and one that
cuts the passages about seeds, look n-grams up in a bit table of bounded size, and what that lets
through wrongly falls out in the exact joins that follow. Neither documents nor items are collected.

Words are runs of letters, digits and characters beyond ASCII; ASCII letters in lower case.

Defined results: null and empty texts and items without a word take no part; an item shorter than an
n-gram is its own n-gram; texts and items of any length are taken whole; repeated documents, and
rows of equal or null ids, are judged each by their own text; items of one id are judged each and the
best is given; of equal scores the passage that starts first is given; empty tables give no rows; other
columns are not read (find_leaks) or carried unchanged (remove_leaks).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import documents, join_by_count, pieces, staged, utf8_of
from gridloom.llm.hashing import BYTE_VALUE, Prefix, joined, spread, word_hashes, word_spans

SEPARATORS = np.ones(256, bool)
SEPARATORS[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = False
SEPARATORS[128:] = False
FOLDED = BYTE_VALUE.copy()
FOLDED[65:91] = BYTE_VALUE[97:123]
#: Size of the table of n-grams as a power of 2, at least and at most (64 MB), bits for each n-gram, and the power of what is sent as a row.
LEAST_BITS, MOST_BITS, GRAM_BITS, ROW_BITS = 20, 29, 32, 19
#: An n-gram sets a bit for each of these shifts of its hash.
PROBES = (0, 18, 35)
#: Leaked texts whose keys (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


@dataclass(frozen=True)
class LeakRules:
    """Seeds are n-grams of n words: all of an item of short_words or less, else the rarest of `among` neighbours; a passage is a leak if its alignment reaches min_score of an item's perfect score."""

    n: int = 3
    among: int = 3
    short_words: int = 24
    min_score: float = 0.6
    slack: float = 0.3
    #: Text of items whose words are broadcast to the candidates; a larger benchmark meets them by a shuffle.
    block_bytes: int = 32 << 20


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the first word's index of each text and of the end."""
    data, offsets = joined(texts)
    starts, stops = word_spans(data, SEPARATORS)
    return word_hashes(data, starts, stops, FOLDED), np.searchsorted(starts, offsets)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams; of all words if there are fewer than n."""
    return Prefix(words).windows(min(n, max(len(words), 1)))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score (match 2, other word -1, gap -1) and where in the passage it stops."""
    steps = np.arange(len(passage) + 1)
    row, best, stop = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        fresh = np.maximum(row - 1, 0)
        fresh[1:] = np.maximum(fresh[1:], row[:-1] + np.where(passage == word, 2, -1))
        row = np.maximum.accumulate(fresh + steps) - steps
        if row.max() > best:
            best, stop = int(row.max()), int(row.argmax())
    return best, stop


def _by_texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in pieces(batch, column):
            yield part, *tokens(list(utf8_of(part.column(column))))


KEY = ["k1", "k2"]


def _keyed(df: DataFrame) -> DataFrame:
    """doc_id, text and two hashes by which texts are told apart."""
    return df.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item (a number of its own), item_id, n_words, words (64-bit hashes) of the items with a word, staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for part, words, at in _by_texts(batches, "text"):
            size = np.diff(at)
            yield pa.RecordBatch.from_arrays([pa.array(range(number, number + part.num_rows), pa.int64()), part.column("doc_id"), pa.array(size, pa.int64()), pa.array([words[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["item", "item_id", "n_words", "words"])
            number += part.num_rows

    source = documents(benchmark, item_col, text_col).filter("text is not null and doc_id is not null")
    return staged(source.mapInArrow(run, "item long, item_id long, n_words long, words binary").filter("n_words > 0"), "items")


def _grams_of(items: DataFrame, rules: LeakRules) -> DataFrame:
    """item, size (its number of words), hash, offset of the items' n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [grams(np.frombuffer(w.as_py(), np.uint64), rules.n) for w in batch.column("words")]
            count = np.array([len(g) for g in own], np.int64)
            flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), count), pa.int64()) for c in ("item", "n_words")] + [pa.array(flat.view(np.int64)), pa.array(spread(np.zeros(len(count), np.int64), count), pa.int64())], ["item", "size", "hash", "offset"])

    return items.select("item", "n_words", "words").mapInArrow(run, "item long, size long, hash long, offset long")


class Table:
    """A bit table of hashes; it may say yes wrongly, never no."""

    def __init__(self, width: int, rows: dict[int, bytes]):
        self.width = np.uint64(64 - width)
        size = 1 << min(width, ROW_BITS)
        self.bits = np.zeros((max(1, (1 << width) // size), size // 8), np.uint8)
        for i, row in rows.items():
            self.bits[i] = np.frombuffer(row, np.uint8)
        self.bits = self.bits.ravel()

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Where the hashes are that the table holds; few are left after the first probe."""
        left = np.arange(len(hashes))
        for shift in PROBES:
            at = ((hashes[left] << np.uint64(shift)) >> self.width).astype(np.int64)
            left = left[(self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
        return left


def bit_table(hashes: DataFrame) -> Table:
    """The bit table of the column `hash`; it grows with the number of hashes up to a fixed size."""
    width = min(MOST_BITS, max(LEAST_BITS, int(hashes.count() * GRAM_BITS).bit_length()))
    row_bits = min(width, ROW_BITS)

    def run(key, group):
        bits = np.zeros(1 << row_bits, np.uint8)
        bits[group.column("at").to_numpy() & ((1 << row_bits) - 1)] = 1
        return pa.table({"row": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    at = hashes.select(F.explode(F.array(*[F.shiftrightunsigned(F.shiftleft("hash", shift), 64 - width) for shift in PROBES])).alias("at")).distinct()
    rows = at.groupBy(F.shiftright("at", row_bits).alias("row")).applyInArrow(run, "row long, bits binary").collect()  # 64 MB in all at most
    return Table(width, {r.row: bytes(r.bits) for r in rows})


def _hits(words: np.ndarray, at: np.ndarray, widths: list[int], table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, place and hash of the n-grams that the table holds, by place."""
    found = []
    for width in widths:
        hashes = Prefix(words).windows(width)
        place = table.places(hashes)
        doc = np.searchsorted(at, place, "right") - 1
        inside = place + width <= at[doc + 1]
        found.append((doc[inside], place[inside], hashes[place[inside]]))
    doc, place, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(place, kind="stable")
    return doc[order], place[order], hashes[order]


def gram_counts(docs: DataFrame, widths: list[int], table: Table) -> DataFrame:
    """hash, n_docs of the n-grams that the table holds; a task sends one row for each of them and 4 MB of text at most."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, at in _by_texts(batches, "text"):
            doc, _, hashes = _hits(words, at, widths, shared.value)
            order = np.lexsort((doc, hashes))
            doc, hashes = doc[order], hashes[order]
            first = np.concatenate((np.ones(min(1, len(doc)), bool), (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])))
            unique, count = np.unique(hashes[first], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(count, pa.int64())], ["hash", "n"])

    return docs.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n_docs"))


def choose_seeds(size: int, seen: np.ndarray, rules: LeakRules) -> np.ndarray:
    """Which of an item's n-grams are seeds, by the documents that hold them; n-grams of no document are none."""
    if size <= rules.short_words:
        return np.flatnonzero(seen > 0)
    rank = np.where(seen > 0, seen, np.iinfo(np.int64).max)
    wide = min(rules.among, len(rank))
    least = np.lib.stride_tricks.sliding_window_view(rank, wide).argmin(axis=1) + np.arange(len(rank) - wide + 1)
    least = np.unique(least)
    return least[seen[least] > 0]


def _seeds(item_grams: DataFrame, counts: DataFrame, rules: LeakRules) -> DataFrame:
    """item, hash, offset, n_docs of the seeds, staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for item, size, own in zip(*(batch.column(c).to_pylist() for c in ("item", "size", "own")), strict=True):
                seen = np.array([g["n_docs"] for g in own], np.int64)
                rows += [(item, own[i]["hash"], own[i]["offset"], own[i]["n_docs"]) for i in choose_seeds(size, seen, rules).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], ["item", "hash", "offset", "n_docs"])

    seen = item_grams.join(counts, "hash", "left").select("item", "size", F.struct("offset", "hash", F.coalesce("n_docs", F.lit(0)).alias("n_docs")).alias("gram"))
    lists = seen.groupBy("item", "size").agg(F.array_sort(F.collect_list("gram")).alias("own"))
    return staged(lists.mapInArrow(run, "item long, hash long, offset long, n_docs long"), "seeds")


PASSAGE = "k1 long, k2 long, start long, words binary, hashes array<long>, places array<int>"


def _passages(docs: DataFrame, widths: list[int], table: Table, reach: int) -> DataFrame:
    """The stretches of words about seeds, once for each text, with hashes and places of the seeds; staged.

    Each seed is in one passage, which has `reach` words on either side of it and four times as many at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)
    kinds = [pa.int64()] * 3 + [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, at in _by_texts(batches, "text"):
            doc, place, hashes = _hits(words, at, widths, shared.value)
            cell = (place - at[doc]) // (2 * reach)
            cut = np.flatnonzero(np.concatenate((np.ones(min(1, len(doc)), bool), (doc[1:] != doc[:-1]) | (cell[1:] != cell[:-1]))))
            keys = [part.column(k).to_numpy() for k in KEY]
            rows = []
            for a, b in zip(cut.tolist(), np.append(cut, len(doc))[1:].tolist(), strict=True):
                d = int(doc[a])
                start, stop = max(int(at[d]), int(place[a]) - reach), min(int(at[d + 1]), int(place[b - 1]) + reach)
                rows.append((int(keys[0][d]), int(keys[1][d]), start - int(at[d]), words[start:stop].tobytes(), hashes[a:b].view(np.int64), (place[a:b] - start).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in PASSAGE.split(", ")])

    return staged(docs.select("text", *KEY).mapInArrow(run, PASSAGE).dropDuplicates([*KEY, "start"]), "passages")


def best_alignment(own: np.ndarray, words: np.ndarray, diagonals: list[int], rules: LeakRules) -> tuple[float, int, int] | None:
    """Score, first word and word after the last of the best passage near the diagonals (where the item would start), None below the least score."""
    slack, best = int(len(own) * rules.slack) + 2, None
    turns = np.unique(np.array(diagonals, np.int64))
    cut = np.concatenate(([0], np.flatnonzero(np.diff(turns) > slack) + 1, [len(turns)]))
    for first, last in zip(turns[cut[:-1]].tolist(), turns[cut[1:] - 1].tolist(), strict=True):
        start, stop = max(0, first - slack), min(len(words), last + len(own) + slack)
        here = words[start:stop]
        if np.isin(own, here).sum() < rules.min_score * len(own):  # no alignment can match more words
            continue
        score, end = align(own, here)
        share = score / (2 * len(own))
        if share >= rules.min_score and (best is None or share > best[0]):
            best = share, start + end - align(own[::-1], here[:end][::-1])[1], start + end
    return best


LEAK = "k1 long, k2 long, item_id long, score double, word_start long, word_stop long"


def _aligned(rules: LeakRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k1, k2, at, item_id, words, own, diagonals in zip(*(batch.column(c) for c in ("k1", "k2", "start", "item_id", "words", "own", "diagonals")), strict=True):
                found = best_alignment(np.frombuffer(own.as_py(), np.uint64), np.frombuffer(words.as_py(), np.uint64), diagonals.as_py(), rules)
                if found:
                    rows.append((k1.as_py(), k2.as_py(), item_id.as_py(), found[0], found[1] + at.as_py(), found[2] + at.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.float64() if i == 3 else pa.int64()) for i in range(6)], [c.split()[0] for c in LEAK.split(", ")])

    return run


def _leaks(docs: DataFrame, benchmark: DataFrame, rules: LeakRules, item_col: str, text_col: str) -> DataFrame:
    """The leaks of each different text: its hashes, item_id, score, word_start, word_stop; staged."""
    items = _items(benchmark, item_col, text_col)
    known = items.agg(F.max("n_words").alias("most"), F.sum(F.octet_length("words")).alias("bytes"), F.collect_set(F.least("n_words", F.lit(rules.n))).alias("widths")).first()
    if known.most is None:
        return docs.sparkSession.createDataFrame([], LEAK)
    widths = sorted(known.widths)
    item_grams = _grams_of(items, rules)
    seeds = _seeds(item_grams, gram_counts(docs, widths, bit_table(item_grams)), rules)
    passages = _passages(docs, widths, bit_table(seeds), int(known.most * (1 + rules.slack)) + 2 + rules.n)
    place = [*KEY, "start"]
    hits = passages.select(*place, F.explode(F.arrays_zip("hashes", "places")).alias("h")).select(*place, F.col("h.hashes").alias("hash"), F.col("h.places").alias("place"))
    total = passages.agg(F.sum(F.size("hashes"))).first()[0] or 0
    pairs = join_by_count(hits, seeds, "hash", total, "n_docs").groupBy(*place, "item").agg(F.collect_set((F.col("place") - F.col("offset")).cast("int")).alias("diagonals"))
    own = items.select("item", "item_id", F.col("words").alias("own"))
    candidates = pairs.join(F.broadcast(own) if known.bytes <= rules.block_bytes else own, "item").join(passages.select(*place, "words"), place)
    best = F.max(F.struct("score", (-F.col("word_start")).alias("a"), (-F.col("word_stop")).alias("b"))).alias("best")
    scored = candidates.mapInArrow(_aligned(rules), LEAK).groupBy(*KEY, "item_id").agg(best)
    return staged(scored.select(*KEY, "item_id", "best.score", (-F.col("best.a")).alias("word_start"), (-F.col("best.b")).alias("word_stop")), "leaks")


def _small(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if its rows, which are counted, are few; else adaptive execution splits what a large key brings to the join."""
    return F.broadcast(table) if table.count() <= BROADCAST_KEYS else table


def find_leaks(docs: DataFrame, benchmark: DataFrame, rules: LeakRules = LeakRules(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each row of docs and item found in it: doc_id, item_id, score (share of the perfect score), word_start, word_stop."""
    source = _keyed(documents(docs, id_col, text_col))
    leaks = _leaks(source, benchmark, rules, item_col, item_text_col)
    return source.select("doc_id", *KEY).join(_small(leaks), KEY).select("doc_id", "item_id", "score", "word_start", "word_stop")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, rules: LeakRules = LeakRules(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of documents without a leak, with all their columns."""
    leaks = _leaks(_keyed(documents(docs, id_col, text_col)), benchmark, rules, item_col, item_text_col)
    gone = _small(staged(leaks.select(*[F.col(k).alias(f"__{k}") for k in KEY]).distinct(), "leaked", ids_only=True))
    text = docs[f"`{text_col}`"].cast("string")
    return docs.join(gone, (F.xxhash64(text) == gone["__k1"]) & (F.xxhash64(F.lit(1), text) == gone["__k2"]), "left_anti")
