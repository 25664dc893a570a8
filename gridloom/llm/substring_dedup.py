"""Exact substring dedup with a Burrows-Wheeler transform bounded at a minimum length.

Every byte that lies in a string of `length` bytes which also starts anywhere else is removed. Seeds
bring together the regions where that can be; in each bucket the regions' suffixes are sorted, and
common prefixes are derived by breadth-first backward extension up to the minimum length.

Defined results: a null text is empty; matches never cross documents; overlapping occurrences count,
also in one document; strings are judged on the input, not on what is left; repeated rows and rows of
equal or null ids are documents of their own; an empty table gives an empty result; other columns are
not read; texts of any length are worked on whole, in parts that overlap. Texts are taken as UTF-8 bytes, and what is left of one need not be valid UTF-8, so it is binary.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.bwt import repeated_starts
from gridloom.llm.common import documents
from gridloom.llm.hashing import BYTE_VALUE, covered, runs_of
from gridloom.llm.seed_search import Plan, Regions, search

#: Bytes of regions in one transform.
TRANSFORM_BYTES = 1 << 20


def _symbols(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def _hashes(symbols: np.ndarray) -> np.ndarray:
    return BYTE_VALUE[symbols]


def solve(regions: Regions, plan: Plan) -> list[np.ndarray]:
    """Flags of the windows of each region. Equal regions fold into one of their summed weight; the regions of a seed share a transform."""
    data = regions.symbols.tobytes()
    texts = [data[a:b] for a, b in zip(regions.start[:-1].tolist(), regions.start[1:].tolist(), strict=True)]
    groups: dict[int, dict[bytes, int]] = {}
    for seed, text, weight in zip(regions.seed.tolist(), texts, regions.weight.tolist(), strict=True):
        own = groups.setdefault(seed, {})
        own[text] = own.get(text, 0) + weight
    flags: dict[tuple[int, bytes], np.ndarray] = {}
    batch: list[tuple[int, bytes, int]] = []
    size = 0
    for seed, own in groups.items():
        if len(own) == 1:  # no other region has this seed, so a window occurs as often as the region does
            text, weight = next(iter(own.items()))
            flags[seed, text] = np.full(len(text) - plan.window + 1, weight >= 2)
            continue
        for text, weight in own.items():
            batch.append((seed, text, weight))
            size += len(text)
        if size >= TRANSFORM_BYTES:
            _transform(batch, flags, plan.window)
            batch, size = [], 0
    _transform(batch, flags, plan.window)
    return [flags[seed, text] for seed, text in zip(regions.seed.tolist(), texts, strict=True)]


def _transform(batch: list[tuple[int, bytes, int]], flags: dict, window: int) -> None:
    if batch:
        found = repeated_starts([t for _, t, _ in batch], np.array([w for _, _, w in batch]), window)
        for (seed, text, _), own in zip(batch, found, strict=True):
            flags[seed, text] = own[: len(text) - window + 1]


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", **portions: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), n_shared_seeds, kept (binary) for each row; portions as in Plan.

    n_shared_seeds tells of passages that other documents have too, but that may be too short to be
    removed: any 7/8 length bytes in a row hold one of the text's seeds, strings of length/2 bytes, and
    those which stand in another document are counted. A text that has 7/8 length bytes in a row in common with
    another one has one at least; a text that has no length/2 bytes in common has none.
    """

    def finish(text: bytes, starts: np.ndarray, marks: int) -> tuple[int, int, int, int, bytes]:
        if not len(starts):
            return len(text), 0, 0, marks, text
        gone = covered(starts, starts + length, len(text))
        return len(text), int(gone.sum()), len(runs_of(gone)[0]), marks, np.frombuffer(text, np.uint8)[~gone].tobytes()

    gram = max(1, length // 2)
    plan = Plan(window=length, gram=gram, near=max(gram, 7 * length // 8), **portions)
    return search(documents(docs, id_col, text_col), plan, _symbols, _hashes, np.uint8, solve, finish, "n_bytes long, n_removed long, n_spans long, n_shared_seeds long, kept binary", by_owner=False)


def digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_shared_seeds")
