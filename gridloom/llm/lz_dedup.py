"""Substring dedup of words by relative Lempel-Ziv parsing.

A document's words are factored greedily against indexed reference blocks, which hold the regions
of all documents by the seeds they share. A factor of `words` words or more that is copied from a
document with a smaller id is a duplicate span. The last windows before a factor's end reach over it, so
the parse goes on from the first of them, and windows across a boundary are checked like all others.

Words are runs without ASCII white space, taken unchanged.

Defined results: a null text has no words; windows never cross documents and are judged on the input;
an equal id is not smaller, so rows of one id do not bear on each other; a null id counts as larger
than every id; texts shorter than a window stay whole, longer ones of any length are parsed whole; an
empty table gives an empty result; other columns are not read.

Regions fold into one by a 64-bit hash of their words, and windows of a hot seed are told apart by 128-bit
hashes (seed_search); within a block words, as 64-bit hashes, are compared one by one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import documents
from gridloom.llm.hashing import Prefix, covered, spread, word_hashes, word_spans
from gridloom.llm.seed_search import Plan, Regions, search

#: Bytes of a text that are cut into words at a time.
PORTION = 4 << 20


def _symbols(text: bytes) -> np.ndarray:
    """Hashes of the text's words."""
    if len(text) <= PORTION:
        data = np.frombuffer(text, np.uint8)
        return word_hashes(data, *word_spans(data)) if len(data) else np.zeros(0, np.uint64)
    parts, at = [], 0
    while at < len(text):
        stop = min(at + PORTION, len(text))
        while stop < len(text) and text[stop] not in b" \t\n\v\f\r":
            stop += 1
        data = np.frombuffer(text, np.uint8)[at:stop]
        parts.append(word_hashes(data, *word_spans(data)))
        at = stop
    return np.concatenate(parts)


def _hashes(symbols: np.ndarray) -> np.ndarray:
    return symbols


def solve(regions: Regions, plan: Plan) -> list[np.ndarray]:
    """Flags of the windows of each region that a document with a smaller id has too."""
    window = plan.window
    # Equal regions: the one with the smallest owner is parsed; to the others it is one long factor.
    order = np.lexsort((regions.owner, regions.content, regions.seed))
    fresh = np.concatenate(([True], (regions.seed[order][1:] != regions.seed[order][:-1]) | (regions.content[order][1:] != regions.content[order][:-1])))
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(fresh) - 1
    lead = order[fresh]
    first, stop, owner = regions.start[lead], regions.start[lead + 1], regions.owner[lead]
    count = stop - first - window + 1
    base = np.concatenate(([0], np.cumsum(count)))
    # Index of the block: all windows of the lead regions, the smallest owner of each hash in front.
    of = np.repeat(np.arange(len(lead)), count)
    at = spread(first, count)
    hashes = Prefix(regions.symbols).ranges(at, at + window)
    sort = np.lexsort((owner[of], hashes))
    head = np.flatnonzero(np.concatenate(([True], hashes[sort][1:] != hashes[sort][:-1])))
    source = np.empty(len(at), np.int64)
    source[sort] = np.repeat(sort[head], np.diff(np.append(head, len(sort))))
    flags = np.zeros(len(at), bool)
    cursor, live = base[:-1].copy(), np.arange(len(lead))
    while len(live):
        here = cursor[live]
        there = source[here]
        hit = owner[of[there]] < owner[live]
        size = np.zeros(len(live), np.int64)
        rows = np.flatnonzero(hit)
        a, b = at[here[rows]], at[there[rows]]
        room = np.minimum(stop[live[rows]] - a, stop[of[there[rows]]] - b)
        grow = np.arange(len(rows))
        while len(grow):  # words are compared one by one, those of the hash's window too
            same = regions.symbols[a[grow] + size[rows[grow]]] == regions.symbols[b[grow] + size[rows[grow]]]
            size[rows[grow[same]]] += 1
            grow = grow[same & (size[rows[grow]] < room[grow])]
        long = np.flatnonzero(size >= window)
        inside = size[long] - window + 1
        flags[spread(here[long], inside)] = True
        # After a factor the parse goes on with the first window that reaches over its end.
        cursor[live] += np.maximum(size - window + 1, 1)
        live = live[cursor[live] < base[live + 1]]
    own = [flags[a:b] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]
    later = regions.owner > owner[kind]
    return [np.ones(len(own[k]), bool) if z else own[k] for k, z in zip(kind.tolist(), later.tolist(), strict=True)]


def remove_repeats(docs: DataFrame, words: int = 13, id_col: str = "doc_id", text_col: str = "text", **portions: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by a space) for each row; portions as in Plan."""

    def finish(text: bytes, starts: np.ndarray, _: int) -> tuple[int, int, str]:
        own = text.split()
        if not len(starts):
            return len(own), 0, b" ".join(own).decode("utf-8", "replace")
        gone = covered(starts, starts + words, len(own))
        return len(own), int(gone.sum()), b" ".join([own[i] for i in np.flatnonzero(~gone).tolist()]).decode("utf-8", "replace")

    plan = Plan(window=words, gram=max(1, (words - 1) // 2), **portions)
    return search(documents(docs, id_col, text_col), plan, _symbols, _hashes, np.uint64, solve, finish, "n_words long, n_removed long, kept string", by_owner=True)


def digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def oracle(words: int = 13) -> str:
    """digests() of the table documents in DuckDB's SQL."""
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i:i + {words - 1}], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - {words - 2})) AS i FROM d)),
f AS (SELECT gram, min(doc_id) AS first FROM g GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, pos FROM (SELECT g.doc_id, unnest(range(i, i + {words})) AS pos FROM g JOIN f USING (gram) WHERE first < g.doc_id)),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d),
k AS (SELECT w.doc_id, count(gone.pos) AS n_removed, string_agg(word, ' ' ORDER BY w.pos) FILTER (WHERE gone.pos IS NULL) AS kept FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.pos = w.pos GROUP BY 1)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
