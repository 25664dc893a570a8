"""N-gram Jaccard join by MinHash banding.

Documents are sets of word n-grams. Equal sets fold into one node first. Band and row counts are
chosen for the target recall at the threshold; nodes are shuffled on their band hashes, and each
bucket ties its members to its smallest, so a bucket of any size brings rows in proportion to it.
The components of these ties hold all candidate pairs. All pairs of a component are verified on full
n-gram sets, in tiles of bounded size when it is large. A large component whose buckets hold far fewer
pairs than it has, such as a chain of weakly similar documents, is verified bucket by bucket instead,
each pair in the first band that it shares, so its work follows its candidates and not its square. A tile
returns counts of links and a spanning forest of them, not the pairs.

Defined results: words are runs without ASCII white space, taken as they stand; a text of fewer than
n words is one n-gram of all its words; texts of any length are compared whole; a null, empty or blank
text has no n-grams, links to nothing and is a class of its own; equal sets are linked; rows are judged
each, so rows of one doc_id may differ, and repeated rows are copies of each other; classes are named by
their smallest doc_id; a row with a null id takes no part and has a null class; an empty table gives an
empty result; other columns are not read (classes) or carried (keep_one).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import documents, pieces, splittable_join, staged, utf8_of
from gridloom.llm.components import components
from gridloom.llm.hashing import Prefix, joined, mix, spread, word_hashes, word_spans


@dataclass(frozen=True)
class JoinRules:
    """n-gram size, Jaccard threshold, and recall that banding is to reach for pairs at the threshold."""

    n: int = 5
    threshold: float = 0.8
    recall: float = 0.9999
    rows: int = 5
    #: Nodes and bytes of n-gram hashes in a block of a component; a tile is two blocks.
    block_nodes: int = 512
    block_bytes: int = 8 << 20
    #: A component goes by buckets if all its pairs are more than so many times those of its buckets.
    sparse: int = 4

    @property
    def bands(self) -> int:
        """Bands of `rows` rows that reach the recall: 1 - (1 - t**rows)**bands >= recall."""
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.threshold**self.rows))


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hashes of all texts, and the first one's index of each text and of the end."""
    data, offsets = joined(texts)
    starts, stops = word_spans(data)
    at = np.searchsorted(starts, offsets)
    prefix = Prefix(word_hashes(data, starts, stops))
    count = np.diff(at)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    first = np.concatenate(([0], np.cumsum(size)))
    begin = spread(at[:-1], size)
    return prefix.ranges(begin, begin + np.repeat(np.minimum(count, n), size)), first


def _sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    hashes, first = shingles(texts, n)
    return [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def _set_hash(own: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(np.bitwise_xor.reduce(mix(own)) ^ mix(own * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)) if len(own) else 0


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _describe(docs: DataFrame, rules: JoinRules) -> DataFrame:
    """doc_id, key, node (name of the set, null without n-grams), size, bands (hashes, with the band's number in them)."""
    draw = np.random.default_rng(20240229)
    factor = draw.integers(1, 1 << 63, rules.bands * rules.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = list(utf8_of(part.column("text")))
                hashes, first = shingles(texts, rules.n)
                full = np.flatnonzero(np.diff(first) > 0)
                names, sizes = [None] * len(texts), [0] * len(texts)
                bands = np.zeros((rules.bands, len(full)), np.uint64)
                if len(full):
                    for i in full:
                        own = np.unique(hashes[first[i] : first[i + 1]])
                        names[i], sizes[i] = int(np.uint64(_set_hash(own)).view(np.int64)), len(own)
                    for b in range(rules.bands):
                        for r in range(rules.rows):
                            least = np.minimum.reduceat(hashes * factor[b * rules.rows + r], first[full])
                            bands[b] = mix(bands[b] * np.uint64(31) + least + np.uint64(b + 1))
                lists = [None] * len(texts)
                for i, own in zip(full.tolist(), _signed(bands.T.copy()).tolist(), strict=True):
                    lists[i] = own
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "key", "node", "size", "bands"])

    return docs.mapInArrow(run, "doc_id long, key long, node long, size long, bands array<long>")


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, common: int = 16, width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of sets[left] x sets[right]; n-grams of few sets by pairs, of many by matrix products."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    edge = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True])))
    count = np.diff(edge)
    row, col = np.full(len(sets), -1), np.full(len(sets), -1)
    row[left], col[right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros(len(left) * len(right), np.float64)
    for k in range(2, common + 1):
        of = owner[edge[:-1][count == k][:, None] + np.arange(k)]
        for a in range(k):
            for b in range(k):
                x, y = row[of[:, a]], col[of[:, b]]
                ok = (x >= 0) & (y >= 0) & (of[:, a] != of[:, b])
                if ok.any():
                    out += np.bincount(x[ok] * len(right) + y[ok], minlength=len(out)) if ok.sum() > len(out) // 8 else _scatter(out, x[ok] * len(right) + y[ok])
    out = out.reshape(len(left), len(right))
    many = np.flatnonzero(count > common)
    for i in range(0, len(many), width):
        part = many[i : i + width]
        dense = np.zeros((len(sets), len(part)), np.float32)
        sizes = count[part]
        at = spread(edge[:-1][part], sizes)
        dense[owner[at], np.repeat(np.arange(len(part)), sizes)] = 1
        out += dense[left] @ dense[right].T
    return out


def _scatter(out: np.ndarray, at: np.ndarray) -> float:
    np.add.at(out, at, 1.0)
    return 0.0


def _verify(rules: JoinRules):
    """Grouped map: links of a tile as (node, root within the tile, documents linked); in a tile of a bucket, of pairs that share no earlier band."""

    def run(key, group):
        node = group.column("node").to_numpy()
        block = group.column("block").to_numpy()
        copies = group.column("copies").to_numpy().astype(np.float64)
        sets = [np.frombuffer(s.as_py(), np.uint64) for s in group.column("grams")]
        band, i, j = (k.as_py() for k in key[1:])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        size = np.array([len(s) for s in sets], np.float64)
        shared = intersections(sets, left, right) if len(left) and len(right) else np.zeros((len(left), len(right)))
        total = size[left][:, None] + size[right][None, :]
        linked = shared * (1 + rules.threshold) >= rules.threshold * total - 1e-6
        linked &= left[:, None] != right[None, :]
        if band > 0 and linked.any():
            bands = np.stack([np.array(b.as_py(), np.int64)[:band] for b in group.column("bands")])
            for k in range(band):
                linked &= bands[left, k][:, None] != bands[right, k][None, :]
        links = np.zeros(len(node))
        links[left] += linked @ copies[right]
        if i != j:
            links[right] += linked.T @ copies[left]
        # Labels by propagation of the smallest index over the links of the tile.
        label = np.arange(len(node))
        while True:
            new = label.copy()
            if len(left) and len(right):
                new[left] = np.minimum(new[left], np.where(linked, label[right][None, :], len(node)).min(axis=1))
                new[right] = np.minimum(new[right], np.where(linked, new[left][:, None], len(node)).min(axis=0))
            new = new[new]
            if (new == label).all():
                break
            label = new
        found = np.flatnonzero(links > 0)
        return pa.table({"node": node[found], "root": node[label[found]], "links": links[found].astype(np.int64)})

    return run


def _grams(rules: JoinRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "copies", "bands", "places"]
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = _sets(list(utf8_of(part.column("text"))), rules.n)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array([s.tobytes() for s in sets], pa.binary())], [*names, "grams"])

    return run


PLACES = "array<struct<component:long,band:int,blocks:int,block:int>>"


def _places(parts: DataFrame, nodes: DataFrame, rules: JoinRules) -> DataFrame:
    """node, places: the tiles' rows and columns that a node is in. A component, or a bucket of a sparse one, is dealt to blocks by a hash of the node, and every pair of blocks is a tile."""

    def place(component: str, band: Column, blocks: Column) -> Column:
        return F.struct(F.col(component).alias("component"), band.alias("band"), blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))

    blocks = F.greatest(F.ceil(F.col("members") / rules.block_nodes), F.ceil(F.col("bytes") / rules.block_bytes), F.lit(1)).cast("int")
    extent = [F.count(F.lit(1)).alias("members"), (F.sum("size") * 8).alias("bytes")]
    sized = parts.join(nodes.select("node", "size"), "node")
    planned = staged(splittable_join(sized, sized.groupBy("root").agg(*extent), "root").withColumn("blocks", blocks), "planned", ids_only=True)
    whole = F.array(place("root", F.lit(-1), F.col("blocks"))).alias("places")
    if planned.filter("blocks > 1").isEmpty():
        return planned.select("node", whole)
    banded = planned.filter("blocks > 1").select("node", "root", "size").join(nodes.select("node", "bands"), "node").select("node", "root", "size", F.posexplode("bands").alias("band", "bucket"))
    buckets = staged(banded.groupBy("root", "band", "bucket").agg(*extent).filter("members > 1").withColumn("blocks", blocks), "buckets", ids_only=True)
    squares = buckets.groupBy("root").agg(F.sum(F.col("members") * F.col("members")).alias("pairs"))
    sizes = planned.filter("blocks > 1").groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    sparse = staged(squares.join(sizes, "root").filter(F.col("n") * F.col("n") > rules.sparse * F.col("pairs")).select("root"), "sparse", ids_only=True)
    by_bucket = banded.drop("size").join(sparse, "root").join(buckets.select("band", "bucket", "blocks"), ["band", "bucket"])
    return planned.join(sparse, "root", "left_anti").select("node", whole).unionByName(by_bucket.groupBy("node").agg(F.collect_list(place("bucket", F.col("band"), F.col("blocks"))).alias("places")))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, key: a row is told from others of its doc_id by a hash of its text."""
    return documents(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))


def _linked(source: DataFrame, rules: JoinRules) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, key, node) and the nodes: node, keeper (smallest doc_id and key of its class), links to other documents, copies."""
    described = staged(_describe(source, rules), "minhash")
    row = F.struct("doc_id", "key")
    nodes = staged(described.filter("node is not null and doc_id is not null").groupBy("node").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands")), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    pivots = banded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket", "pivot")
    ties = splittable_join(banded, pivots, "bucket").filter("node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v"))
    parts = staged(components(ties), "candidates", ids_only=True)
    wanted = _places(parts, nodes, rules).join(nodes.select("node", "first", "copies", "bands"), "node")
    texts = source.join(wanted.select("first.doc_id", "first.key", "node", "copies", F.when(F.exists("places", lambda p: p["band"] > 0), F.col("bands")).alias("bands"), "places"), ["doc_id", "key"])
    grams = texts.select("text", "node", "copies", "bands", "places").mapInArrow(_grams(rules), f"node long, copies long, bands array<long>, places {PLACES}, grams binary").dropDuplicates(["node"])
    tiled = grams.withColumn("p", F.explode("places")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("p.blocks") - 1)))
    tiles = tiled.select("p.component", "p.band", F.least("p.block", "other").alias("i"), F.greatest("p.block", "other").alias("j"), "node", "copies", "p.block", F.when(F.col("p.band") > 0, F.col("bands")).alias("bands"), "grams")
    verified = staged(tiles.groupBy("component", "band", "i", "j").applyInArrow(_verify(rules), "node long, root long, links long"), "links")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(verified.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = nodes.select("node", "first", "copies").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keepers = named.groupBy("root").agg(F.min("first").alias("keeper"))
    result = splittable_join(named, keepers, "root").select("node", "keeper", F.coalesce("links", F.lit(0)).alias("links"), "copies")
    return described.select("doc_id", "key", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")), result


def classes(docs: DataFrame, rules: JoinRules = JoinRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: doc_id, class_id, n_links (other documents at the threshold or above), n_copies (documents of the same set)."""
    rows, nodes = _linked(_keyed(docs, id_col, text_col), rules)
    return rows.join(nodes, "node", "left").select("doc_id", F.coalesce("keeper.doc_id", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies"))


def keep_one(docs: DataFrame, rules: JoinRules = JoinRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all its columns: that of the smallest doc_id, then of the smallest hash of text, then of all columns.

    Rows without an id or without n-grams stay. Rows of one doc_id are told apart by their texts, so a
    text that is in another class than its id's other texts is not lost.
    """
    rows, nodes = _linked(_keyed(docs, id_col, text_col), rules)
    row = F.struct("doc_id", "key")
    judged = staged(rows.filter("node is not null").join(nodes, "node").groupBy("doc_id", "key").agg(F.first("keeper").alias("keeper"), F.count(F.lit(1)).alias("n")).withColumn("gone", row != F.col("keeper")).filter("gone or n > 1").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "gone"), "judged", ids_only=True)
    own_id, own_key = docs[f"`{id_col}`"].cast("long"), F.xxhash64(docs[f"`{text_col}`"].cast("string"))
    gone = judged.filter("gone")
    kept = docs.join(gone, (own_id == gone["__id"]) & (own_key == gone["__key"]), "left_anti")
    again = judged.filter("not gone").withColumn("__again", F.lit(True)).drop("gone")
    if again.isEmpty():
        return kept
    # Rows that stand several times with one id and text: the one of the smallest hash of all columns stays.
    marked = kept.join(again, (own_id == again["__id"]) & (own_key == again["__key"]), "left")
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    one = marked.filter("__again").groupBy("__id", "__key").agg(F.min_by(whole, F.xxhash64(*hashed)).alias("row"))
    return marked.filter("__again is null").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(one.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)]))


def oracle(n: int = 5) -> str:
    """classes() of the table documents at 0.8 in DuckDB's SQL, by all pairs of a common n-gram."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:least(i + {n - 1}, len(words))], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {n - 2}, least(len(words), 1) + 1))) AS i FROM d)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y, shared = cx.n AND shared = cy.n AS same FROM p JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE 5 * shared >= 4 * (cx.n + cy.n - shared)),
r(id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.id WHERE r.root < l.y)
SELECT d.doc_id, (SELECT min(root) FROM r WHERE r.id = d.doc_id) AS class_id, (SELECT count(*) FROM l WHERE l.x = d.doc_id) AS n_links, 1 + (SELECT count(*) FROM l WHERE l.x = d.doc_id AND l.same) AS n_copies FROM d
"""
