"""URL filter with a temporal list: dated entries become validity intervals, captures are judged as of their fetch time.

An entry of a list says what holds for a pattern from its date on: block, allow or remove (nothing
holds). Patterns are a host, a parent domain of it, or a host with the first parts of a path. Every
capture is joined, on each pattern that its URL falls under, with the entries valid at its fetch
time; the longest pattern decides, and of equal patterns on several lists block wins over allow.

Hosts are lower-cased, without port, user and closing dots; an address (IPv4, or IPv6 in brackets) has no
parent domains. Patterns are read in the same way, and empty parts of a path count in neither.

Defined results: a null or hostless URL or a null time matches nothing and is kept; URLs of any length
are taken whole; of entries of one list and pattern on one date the highest seq counts, and of equal seq
the last action by name; entries with a null in any column are left out; repeated captures (same id, URL
and time) are one, null ids too; an empty list keeps all, no captures give no rows; other columns are not
read. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A list of at most so many intervals is broadcast (a row is some 200 bytes); a larger one is joined by shuffle.
BROADCAST_ROWS = 50_000
#: Parts that a host's captures are dealt to in a shuffled join.
SALTS = 32

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)"
ADDRESS = r"^\[|^[0-9]+(\.[0-9]+){3}$"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """list_name, pattern, action, valid_from, valid_to (exclusive, null while open) of the times when an entry holds."""
    named = ["list_name", "pattern", "action", "listed_on", "seq"]
    last = Window.partitionBy("list_name", "pattern", "listed_on").orderBy(F.desc("seq"), F.desc("action"))
    following = Window.partitionBy("list_name", "pattern").orderBy("listed_on")
    return (
        entries.select(*named)
        .dropna()
        .withColumn("pattern", normal_pattern(F.col("pattern")))
        .withColumn("rank", F.row_number().over(last))
        .filter("rank = 1")
        .withColumn("valid_to", F.lead("listed_on").over(following))
        .filter(F.col("action").isin("block", "allow"))
        .select("list_name", "pattern", "action", F.col("listed_on").alias("valid_from"), "valid_to")
    )


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit(""))), r"\.+$", "")


def normal_pattern(pattern: Column) -> Column:
    """A list's pattern as URLs give it: lower case, no dots after the host, no empty path parts."""
    parts = F.filter(F.split(F.lower(pattern), "/"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, F.regexp_replace(p, r"\.+$", "")).otherwise(p)), "/")


def patterns_of(url: Column, depth: int) -> Column:
    """The patterns a URL falls under: host, parent domains of two labels or more, host with up to `depth` path parts."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    parents = F.when(host.rlike(ADDRESS), 1).otherwise(F.greatest(F.size(labels) - 1, F.lit(1)))
    domains = F.transform(F.sequence(F.lit(1), parents), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.slice(F.filter(F.split(F.lower(F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))), "/"), lambda p: p != ""), 1, depth)
    deep = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.concat(domains, deep)).otherwise(F.array().cast("array<string>"))


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_on", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each capture: capture_id, url, fetched_on, host, n_active, pattern, list_name, action, kept.

    URLs give patterns as deep as the deepest of the list. A list within broadcast_rows, which are counted, meets the captures where they are. A larger one is
    shuffled by pattern and salt, so that a host with a third of all captures is dealt to many tasks.
    """
    source = captures.select(F.col(f"`{id_col}`").alias("capture_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{time_col}`").alias("fetched_on")).withColumn("host", host_of(F.col("url")))
    spans = intervals(entries)
    size = spans.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("pattern", "/")) - 1).alias("depth")).first()
    keyed = source.withColumn("pattern", F.explode_outer(patterns_of(F.col("url"), size["depth"] or 0)))
    small = size["n"] <= broadcast_rows
    if small:
        on, right = ["pattern"], F.broadcast(spans)
    else:
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("capture_id", "url", "fetched_on"), F.lit(SALTS)))
        on, right = ["pattern", "salt"], spans.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    right = right.withColumnRenamed("pattern", "rule")
    match = (keyed["pattern"] == right["rule"]) & (keyed["fetched_on"] >= right["valid_from"]) & (right["valid_to"].isNull() | (keyed["fetched_on"] < right["valid_to"]))
    if not small:
        match = match & (keyed["salt"] == right["salt"])
    hit = keyed.join(right, match, "left")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("size"), (F.col("action") == "block").alias("blocks"), F.col("rule").alias("rule"), F.col("list_name").alias("list_name"), F.col("action").alias("action"))))
    return (
        hit.groupBy("capture_id", "url", "fetched_on", "host")
        .agg(F.count("rule").alias("n_active"), best.alias("best"))
        .select("capture_id", "url", "fetched_on", "host", "n_active", F.col("best.rule").alias("pattern"), F.col("best.list_name").alias("list_name"), F.col("best.action").alias("action"), F.coalesce(F.col("best.action") != "block", F.lit(True)).alias("kept"))
    )


# The query's list and fetch times: the tables have neither, so a small dated list stands here and the
# fetch day follows from the page's number.
FETCHED_ON = "date_add(DATE '2024-01-01', cast(page_id * 37 % 366 as int))"
# list_name, pattern, action, listed_on, seq.
ENTRIES = [
    ("adult", "example.net", "block", "2024-03-01", 1),
    ("adult", "example.net", "remove", "2024-05-15", 2),
    ("adult", "tionsh.example.net", "block", "2024-02-10", 3),
    ("adult", "tionsh.example.net", "remove", "2024-04-01", 4),
    ("adult", "tionsh.example.net", "block", "2024-09-20", 5),
    ("adult", "tionsh.example.net/es", "allow", "2024-10-01", 6),
    ("malware", "example.org", "block", "2024-06-01", 1),
    ("malware", "www.theren.example.org", "allow", "2024-06-15", 2),
    ("malware", "www.theren.example.org", "block", "2024-06-15", 3),
    ("malware", "m.tiontion.example.com", "block", "2024-01-01", 4),
    ("malware", "m.tiontion.example.com/en", "allow", "2024-07-04", 5),
    ("malware", "m.tiontion.example.com/en", "remove", "2024-07-04", 6),
    ("malware", "blog.tionble.example.com/de", "block", "2024-08-08", 7),
    ("trusted", "ththan.example.net", "allow", "2024-01-15", 1),
    ("trusted", "tionsh.example.net", "allow", "2024-11-11", 2),
    ("trusted", "blog.ththth.example.org", "allow", "2024-05-05", 3),
    ("trusted", "ththon.example.com", "allow", "2024-02-29", 4),
]

_VALUES = ", ".join(f"('{name}', '{pattern}', '{action}', DATE '{day}', {seq})" for name, pattern, action, day, seq in ENTRIES)
ORACLE = rf"""
WITH entries(list_name, pattern, action, listed_on, seq) AS (VALUES {_VALUES}),
last AS (SELECT *, row_number() OVER (PARTITION BY list_name, pattern, listed_on ORDER BY seq DESC, action DESC) AS rank FROM entries),
spans AS (SELECT list_name, pattern, action, listed_on AS valid_from, lead(listed_on) OVER (PARTITION BY list_name, pattern ORDER BY listed_on) AS valid_to FROM last WHERE rank = 1),
source AS (
  SELECT DISTINCT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS DATE) AS fetched_on,
         regexp_replace(lower(coalesce(regexp_extract(url, '{HOST}', 1), '')), '\.+$', '') AS host,
         list_filter(string_split(lower(coalesce(regexp_extract(url, '{PATH}', 1), '')), '/'), lambda p: p <> '')[1:{max(e[1].count("/") for e in ENTRIES)}] AS parts
  FROM pages),
keyed AS (
  SELECT page_id, url, fetched_on, host, unnest(CASE WHEN host = '' THEN [NULL] ELSE
         list_concat(list_transform(range(1, CASE WHEN regexp_matches(host, '{ADDRESS}') THEN 2 ELSE greatest(len(string_split(host, '.')), 2) END), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
                     list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[1:i], '/'))) END) AS pattern
  FROM source),
hit AS (
  SELECT k.page_id, k.url, k.fetched_on, k.host, s.pattern AS rule, s.list_name, s.action,
         row_number() OVER (PARTITION BY k.page_id, k.url, k.fetched_on ORDER BY length(s.pattern) DESC NULLS LAST, s.action = 'block' DESC, s.pattern DESC, s.list_name DESC) AS rank,
         count(s.pattern) OVER (PARTITION BY k.page_id, k.url, k.fetched_on) AS n_active
  FROM keyed k LEFT JOIN spans s ON k.pattern = s.pattern AND s.action <> 'remove' AND k.fetched_on >= s.valid_from AND (s.valid_to IS NULL OR k.fetched_on < s.valid_to))
SELECT page_id, url, fetched_on, host, n_active, rule AS pattern, list_name, action, coalesce(action <> 'block', true) AS kept FROM hit WHERE rank = 1
"""
