"""Substring, Lempel-Ziv, line and near-duplicate operators against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import bwt, jaccard_join, line_dedup, lz_dedup, substring_dedup
from gridloom.llm.components import components
from tests.llm.util import SCHEMA, corpus, covered, jaccard_classes, words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=20) | st.text("ab", max_size=30).map(str.encode), st.integers(1, 2)), min_size=1, max_size=8, unique_by=lambda x: x[0]), st.integers(1, 6))
def test_bounded_transform_finds_all_repeats(items, length):
    texts, weights = [t for t, _ in items], np.array([w for _, w in items])
    times = Counter()
    for t, w in items:
        for i in range(len(t) - length + 1):
            times[t[i : i + length]] += w
    want = [[i + length <= len(t) and times[t[i : i + length]] >= 2 for i in range(len(t) + 1)] for t in texts]
    assert [list(map(bool, x)) for x in bwt.repeated_starts(texts, weights, length)] == want


def substring_brute(rows, length):
    times = Counter()
    data = [((t or "").encode()) for _, t, *_ in rows]
    for t in data:
        for i in range(len(t) - length + 1):
            times[t[i : i + length]] += 1
    out = []
    for (d, *_), t in zip(rows, data, strict=True):
        gone = covered([i for i in range(len(t) - length + 1) if times[t[i : i + length]] > 1], length, len(t))
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("portions", [{}, {"chunk_bytes": 500, "bucket_bytes": 300}, {"chunk_bytes": 500, "bucket_bytes": 300, "hot_regions": 0}])
def test_substring_dedup(spark, portions):
    rows = corpus() + [(None, "null id " * 12, None, None, None), (7, corpus()[7][1], "en", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = substring_dedup.digests(substring_dedup.remove_repeats(docs, 40, **portions)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == substring_brute(rows, 40)


def shares(rows, size):
    """For each row, whether it has a string of `size` bytes in common with another row."""
    data = [(t or "").encode() for _, t, *_ in rows]
    grams = [{t[i : i + size] for i in range(len(t) - size + 1)} for t in data]
    times = Counter(g for own in grams for g in own)
    return [any(times[g] > 1 for g in own) for own in grams]


@pytest.mark.parametrize("portions", [{}, {"chunk_bytes": 500, "bucket_bytes": 300}])
def test_shared_seeds_tell_of_shorter_passages(spark, portions):
    rows = [r for r in corpus(11) if r[0] < 100] + [(200, "this is one that holds some words in common ", "en", "s", 1), (201, "again, one that holds some words in common.", "en", "s", 1), (202, "qq " * 70, "en", "s", 1)]
    got = {r.doc_id: r.n_shared_seeds for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), 40, **portions).collect()}
    long, short = shares(rows, 35), shares(rows, 20)
    assert all(got[r[0]] > 0 for r, yes in zip(rows, long, strict=True) if yes) and all(got[r[0]] == 0 for r, yes in zip(rows, short, strict=True) if not yes)
    assert got[200] and got[201] and not got[202] and not all(got.values())


def lz_brute(rows, size):
    first = {}
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = words(t)
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), d)
    out = []
    for d, t, *_ in rows:
        w = words(t)
        earlier = lambda x, d=d: x is not None and (d is None or x < d)
        gone = covered([i for i in range(len(w) - size + 1) if earlier(first[tuple(w[i : i + size])])], size, len(w))
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("portions", [{}, {"chunk_bytes": 500, "bucket_bytes": 300}, {"chunk_bytes": 500, "bucket_bytes": 300, "hot_regions": 0}])
def test_lempel_ziv_dedup(spark, portions):
    rows = corpus(2) + [(None, corpus(2)[2][1], None, None, None), (7, corpus(2)[7][1], "en", "x", 1)]
    got = lz_dedup.digests(lz_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), 6, **portions)).collect()
    assert sorted(map(tuple, got), key=str) == lz_brute(rows, 6)


def test_long_texts_are_cut_with_overlap(spark, monkeypatch):
    from gridloom.llm import seed_search

    monkeypatch.setattr(seed_search, "SLAB", 64)
    rows = [(1, "abcdefghij" * 40, "en", "s", 1), (2, "xyz" + "abcdefghij" * 20, "en", "s", 1), (3, "unique text here", "en", "s", 1)]
    chunk = seed_search.Chunk(__import__("pyarrow").table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}), seed_search.Plan(window=40, gram=20), substring_dedup._symbols, substring_dedup._hashes)
    for d, t in enumerate(r[1] for r in rows):
        starts = sorted(s for a, z in zip(chunk.first[chunk.doc == d], chunk.last[chunk.doc == d], strict=True) for s in range(a, z + 1))
        assert starts == list(range(max(0, len(t) - 39)))


def test_equal_windows_share_seeds():
    from gridloom.llm import seeds
    from gridloom.llm.hashing import BYTE_VALUE

    data = np.frombuffer((b"q" * 13 + bytes(range(65, 105))) * 3, np.uint8)
    r = seeds.runs(BYTE_VALUE[data], np.array([0, len(data)]), 5, 20)
    seen = {}
    for a, z, p, s in zip(r.first, r.last, r.place, r.seed, strict=True):
        for i in range(a, z + 1):
            assert seen.setdefault(data[i : i + 20].tobytes(), (p - i, s)) == (p - i, s)
    assert sum(r.last - r.first + 1) == len(data) - 19


@pytest.mark.parametrize("rules", [jaccard_join.JoinRules(), jaccard_join.JoinRules(block_nodes=3)])
def test_jaccard_classes(spark, rules):
    rows = corpus(3, 90)
    got = jaccard_join.classes(spark.createDataFrame(rows, SCHEMA), rules).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == jaccard_classes(rows)


def test_chains_of_weakly_similar_documents_take_linear_work(spark, monkeypatch):
    """Neighbours in a chain share buckets but are not similar: bucket by bucket the pairs follow the chain's length, and links of true copies in it are found."""
    n = 500
    rows = [(i, " ".join(f"w{k}" for k in range(8 * i, 8 * i + 60)), "en", "s", 1) for i in range(n)]
    rows += [(1000 + i, rows[i][1].replace(f"w{8 * i + 59}", "edited"), "en", "s", 1) for i in range(0, n, 5)]
    seen = {}
    plain = jaccard_join._places

    def kept(parts, nodes, rules):
        out = plain(parts, nodes, rules)
        seen["pairs"] = sum(r.n**2 for r in out.select(jaccard_join.F.explode("places").alias("p")).groupBy("p.component", "p.band").agg(jaccard_join.F.count("*").alias("n")).collect())
        seen["bands"] = {r.band for r in out.select(jaccard_join.F.explode("places").alias("p")).select("p.band").distinct().collect()}
        return out

    monkeypatch.setattr(jaccard_join, "_places", kept)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.classes(spark.createDataFrame(rows, SCHEMA), jaccard_join.JoinRules(block_nodes=8)).collect()}
    assert got == jaccard_classes(rows)
    assert max(seen["bands"]) > 0 and seen["pairs"] < 24 * 5 * len(rows) < len(rows) ** 2 / 4


def test_jaccard_edges(spark):
    rows = [(1, None, "a", "b", 1), (2, "", "a", "b", 1), (3, "one two", "a", "b", 1), (4, "one  two", "a", "b", 1), (None, "one two", "a", "b", 1), (4, "one  two", "a", "b", 1)]
    got = sorted(map(tuple, jaccard_join.classes(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(1, 1, 0, 1), (2, 2, 0, 1), (3, 3, 2, 3), (4, 3, 2, 3), (4, 3, 2, 3), (None, None, 0, 1)], key=str)
    assert jaccard_join.classes(spark.createDataFrame([], SCHEMA)).collect() == []
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, SCHEMA).withColumn("node", jaccard_join.F.lit(5)))
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 2, 3] and "node" in kept.columns


def test_one_row_of_each_class_stays(spark):
    """By brute force over rows, where ids repeat with other texts, with equal rows, and are null."""
    rows = [(d % 40, *rest) for d, *rest in corpus(13, 80)] + [(None, "one two three", "a", "b", 1)] * 2
    rows += [(1, "w1 w2 w3 w4 w5 w6 w7", "a", "b", 1), (2, "w1 w2 w3 w4 w5 w6 w7", "a", "b", 1), (2, "another text altogether, far from any other", "a", "b", 1), (3, "same twice", "a", "z", 1), (3, "same twice", "a", "y", 2), (3, "same twice", "a", "z", 1)]
    by_row = jaccard_classes([(i, r[1]) for i, r in enumerate(rows) if r[0] is not None])
    members = {}
    for i, (c, _) in by_row.items():
        members.setdefault(c, []).append(i)
    kept = [tuple(r) for r in jaccard_join.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()]
    left = Counter(kept)
    assert not left - Counter(rows)
    for own in members.values():
        if words(rows[own[0]][1]):  # one of the rows of the smallest id
            least = min(rows[i][0] for i in own)
            # rows of two classes may be equal in nothing, so each class is met in its own rows
            assert sum(left[r] for r in {rows[i] for i in own}) == 1 and any(left[rows[i]] for i in own if rows[i][0] == least)
    blank = [r for r in rows if r[0] is None or not words(r[1])]
    assert all(left[r] == blank.count(r) for r in blank)


def test_banding_reaches_its_recall():
    rules = jaccard_join.JoinRules()
    assert 1 - (1 - rules.threshold**rules.rows) ** rules.bands >= rules.recall


def test_intersections_match_sets():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    got = jaccard_join.intersections(sets, np.arange(0, 20), np.arange(10, 30), common=4, width=7)
    for i in range(20):
        for j in range(20):
            if i != j + 10:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j + 10]))


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (3, 4), (5, 4), (20, 20), (12, 11), (12, 10)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10, 12: 10}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def line_brute(rows):
    """Kept text by doc_id, for unique ids: lines that stand together with a neighbour earlier go, with blank lines in between."""
    seen, out = set(), {}
    for d, t, *_ in sorted(rows):
        lines = (t or "").split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
        gone = set()
        for a, b in zip(full, full[1:], strict=False):
            if (lines[a], lines[b]) in seen:
                gone.update(range(a, b + 1))
            seen.add((lines[a], lines[b]))
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_line_dedup(spark):
    rows = corpus(4)
    done = line_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).withColumn("lines", line_dedup.F.lit("clash")))
    got = {r.doc_id: r.text for r in done.collect()}
    want = line_brute(rows)
    assert {d: t or "" for d, t in got.items()} == want
    assert got[101] is None and done.columns[:6] == ["doc_id", "text", "lang", "source", "n_chars", "lines"]
    assert any(want[d] != (t or "") for d, t, *_ in rows)


def test_passages_in_foreign_surroundings_go(spark):
    """Runs of two lines or more that occur earlier go whole, whatever stands around; other lines stay."""
    rng = np.random.default_rng(12)
    fresh = lambda n: [f"own line {rng.integers(1 << 40)}" for _ in range(n)]
    rows, runs, own = [], {}, {}
    for k in range(400):
        size = int(rng.integers(2, 9))
        run = [f"passage {k} line {i}" for i in range(size)]
        blank = [""] * int(rng.integers(0, 2))
        runs[1000 + k] = run
        own[1000 + k] = fresh(int(rng.integers(0, 4))), fresh(int(rng.integers(0, 4)))
        rows.append((k, "\n".join(fresh(int(rng.integers(0, 4))) + run + fresh(int(rng.integers(0, 4)))), "en", "s", 1))
        rows.append((1000 + k, "\n".join(own[1000 + k][0] + blank + run[:1] + blank + run[1:] + own[1000 + k][1]), "en", "s", 1))
    got = {r.doc_id: r for r in line_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k]["__n_removed"] == 0 for k in range(400))
    left = {d: [x for x in got[d].text.split("\n") if x] for d in runs}
    assert all(set(own[d][0] + own[d][1]) <= set(left[d]) for d in runs)
    assert all(left[d] == own[d][0] + own[d][1] and got[d]["__n_chunks"] == 1 for d in runs)
    assert sum(len(run) == 2 for run in runs.values()) > 30


def test_line_dedup_edges(spark):
    block = "\n".join(f"line {i}" for i in range(30))
    rows = [(1, block, "a", "b", 1), (1, block, "a", "c", 1), (None, block, "a", "b", 1), (2, block, "a", "b", 1)]
    got = {(r.doc_id, r.source): r for r in line_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, "b"].text == block == got[1, "c"].text == got[None, "b"].text
    assert got[2, "b"]["__n_removed"] > 0 and len(got) == 4
    assert line_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.remove_repeats(empty).collect() == [] and lz_dedup.remove_repeats(empty).collect() == []


@pytest.mark.parametrize("share", [2, 1000])
def test_join_by_count_equals_a_join(spark, share):
    from pyspark.sql import functions as F

    from gridloom.llm.common import join_by_count

    left = spark.range(400).select((F.col("id") % 7 * (F.col("id") % 3)).alias("k"), F.col("id").alias("v"), F.lit(1).alias("n_left"))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top")).filter("k <> 4")
    got = sorted(map(tuple, join_by_count(left, right, "k", 400, share=share).collect()))
    assert got == sorted(map(tuple, left.join(right, "k").select("k", "v", "n_left", "n", "top").collect()))
    assert join_by_count(left.limit(0), right, "k", 0).collect() == []
