"""Line dedup by content-defined chunks of lines.

A hash rolls over the hashes of the lines that are not blank, two at a time. A chunk is a maximal run
of lines whose rolling hashes all occur earlier in the corpus (under a smaller doc_id, or further up in
the document). So content alone draws its boundaries, where what was there before ends, and neither what stands
around a chunk nor a shift moves them. Chunks are removed after a comparison of their lines byte by byte,
with blank lines inside them; a single line, repeated as it may be, is no chunk.

Boundaries at lines of certain hashes, the usual form, do not give right results: documents have few
lines, most repeated runs have two or three, and whatever rule leaves a boundary out leaves some of them untouched.

Defined results: null and empty texts and texts of one line have no chunks; blank lines separate
nothing; lines are judged on the input, not on what is left; documents keep their row even if no line
is left; rows whose id is null are returned unchanged and are not compared; rows of one doc_id are put
apart by their text, equal rows of one id are one document and each of them gets its result; texts of
any length are taken whole; an empty table gives an empty result; other columns are carried, whatever
their names. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import join_by_count, staged

#: A line that is not blank.
FILLED = r"[^ \t\n\x0B\f\r]"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once; a column that a lambda names would be computed for each element.

    The outer forms of explode are used on what comes out: before the inner form Catalyst puts a
    filter on the array's size, which computes it once more.
    """
    return F.transform(F.array(value), body)[0]


def _pairs(lines: Column) -> Column:
    """start and stop (lines, from 0) and rolled (hash) of every two neighbouring lines that are not blank."""
    filled = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.when(x.rlike(FILLED), F.xxhash64(x)).alias("hash"))), lambda c: c["hash"].isNotNull())
    pair = lambda a, b: F.struct(a["at"].alias("start"), b["at"].alias("stop"), F.xxhash64(a["hash"], b["hash"]).alias("rolled"))
    count = lambda full: F.greatest(F.size(full) - 1, F.lit(0))
    return _let(filled, lambda full: F.zip_with(F.slice(full, 1, count(full)), F.slice(full, 2, count(full)), pair))


def _text(lines: Column, span: Column) -> Column:
    return F.concat_ws("\n", F.get(lines, span["start"]), F.get(lines, span["stop"]))


def pairs(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, start, stop, rolled of all neighbouring lines."""
    found = docs.filter(F.col("text").contains("\n")).select("doc_id", "text_key", F.explode_outer(_let(_lines(F.col("text")), _pairs)).alias("c"))
    return found.select("doc_id", "text_key", "c.*").filter(F.col("rolled").isNotNull())


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, gone: the lines of each document that are in a chunk, in order.

    Rolling hashes meet first; lines of repeated ones only are compared, each with the first
    occurrence of its hash. A hash may stand in a third of all rows: hashes meet their counts by
    join_by_count(), and in the join of texts adaptive execution splits it, as the other side has one row.
    """
    key = F.struct("doc_id", "text_key", "start")
    marked = staged(pairs(docs), "lines")
    first = marked.groupBy("rolled").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).filter("n > 1")
    wanted = join_by_count(marked, first, "rolled", marked.count()).select("doc_id", "text_key", F.struct("start", "stop", "rolled", (F.col("first") == key).alias("is_first")).alias("w"))
    by_doc = wanted.groupBy("doc_id", "text_key").agg(F.collect_set("w").alias("wanted"))
    cut = lambda lines: F.transform("wanted", lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), c["rolled"].alias("rolled"), c["is_first"].alias("is_first"), _text(lines, c).alias("both")))
    texts = docs.join(by_doc, ["doc_id", "text_key"]).select("doc_id", "text_key", F.explode_outer(_let(_lines(F.col("text")), cut)).alias("c")).select("doc_id", "text_key", "c.*")
    later = texts.filter(~F.col("is_first")).drop("is_first")
    original = texts.filter("is_first").select("rolled", F.col("both").alias("original"))
    same = later.join(original, "rolled").filter(F.col("both") == F.col("original"))
    return same.select("doc_id", "text_key", F.explode(F.sequence("start", "stop")).alias("line")).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("line")).alias("gone"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns with repeated lines taken from the text, and __n_lines, __n_removed (lines), __n_chunks (runs of removed lines)."""
    columns = docs.columns
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns) if c not in (id_col, text_col)]
    inner = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_key"), *([F.struct(*others).alias("rest")] if others else []))
    # The joins see the same rows and, without other columns, share one exchange of the texts.
    told = inner.filter(F.col("doc_id").isNotNull())
    alone = inner.filter(F.col("doc_id").isNull()).withColumn("gone", F.lit(None).cast("array<int>"))
    lined = told.join(removals(told.select("doc_id", "text", "text_key")), ["doc_id", "text_key"], "left").unionByName(alone)

    def kept(lines: Column) -> Column:
        """What stands before, between and after the lines that go."""
        stops = F.concat("gone", F.array(F.size(lines)))
        starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g + 1))
        return F.array_join(F.flatten(F.zip_with(starts, stops, lambda a, b: F.slice(lines, a + 1, b - a))), "\n")

    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(_let(_lines(F.col("text")), kept))
    back = [F.col("doc_id").cast(docs.schema[c].dataType).alias(c) if c == id_col else text.alias(c) if c == text_col else F.col(f"rest.c{i}").alias(c) for i, c in enumerate(columns)]
    breaks = F.zip_with(F.slice("gone", 1, F.size("gone") - 1), F.slice("gone", 2, F.size("gone") - 1), lambda a, b: b - a > 1)
    runs = F.when(F.col("gone").isNotNull(), 1 + F.size(F.filter(breaks, lambda x: x)))
    counts = [F.size(_lines(F.col("text"))).cast("long").alias("__n_lines"), F.when(F.col("gone").isNotNull(), F.size("gone")).otherwise(0).cast("long").alias("__n_removed"), F.coalesce(runs, F.lit(0)).cast("long").alias("__n_chunks")]
    return lined.select(*back, *counts)


ORACLE = rf"""
WITH lined AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM lined),
pair AS (SELECT doc_id, i AS start, line AS one, lead(i) OVER w AS stop, lead(line) OVER w AS two FROM line WHERE regexp_matches(line, '{FILLED}') WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY one, two ORDER BY doc_id, start) AS nth FROM pair WHERE stop IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, stop + 1)) AS i FROM ranked WHERE nth > 1),
marked AS (SELECT l.*, g.i IS NOT NULL AS away, lag(g.i) OVER (PARTITION BY l.doc_id ORDER BY l.i) IS NOT NULL AS after FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE away) AS n_removed, count(*) FILTER (WHERE away AND NOT after) AS n_chunks, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT away), '')) AS kept_sha256 FROM marked GROUP BY doc_id
"""
