"""Secret scan with corpus-wide ownership frequency.

Base patterns find assignments, access keys and long hexadecimal runs. Beside them, tokens that look
random are candidates. The hashes of all candidates are counted corpus-wide by distinct repositories
and owners: a value that several owners hold is a widely copied example, one that stays with a single
owner looks live. Random-looking tokens that are live add spans of kind `live`; base spans stay.

Defined results: a null or empty text has no spans; a null repository or owner counts as one of its
own; repeated rows count once for each repository and owner; every row is scanned and answered by
itself, also rows of one doc_id or of a null id; texts of any length are scanned whole; spans of one
start stand in the order of their kinds; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import join_by_count, staged, texts_of

# The base patterns, in the order of their kinds. A letter of the first stands for either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")
HINTS = ("passw", "secret", "token", "api")


@dataclass(frozen=True)
class OwnershipRules:
    """A candidate token has min_length characters, a digit, letters and min_entropy bits a character; a value that example_owners or more owners hold, in example_repos or more repositories, is an example."""

    min_length: int = 20
    min_entropy: float = 3.2
    example_owners: int = 2
    example_repos: int = 2


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, value) of base matches by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), "assign", m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    # A run of 32 or more is what is left of the leftmost maximal runs when shorter ones are dropped.
    found += [(m.start(), "hex", m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def random_tokens(text: str, rules: OwnershipRules) -> list[tuple[int, int, str]]:
    """(start, end, value) of tokens that look random: letters and digits mixed, of high entropy."""
    out = []
    for m in _token_pattern(rules.min_length).finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and entropy(v) >= rules.min_entropy:
            out.append((m.start(), m.end(), v))
    return out


_PATTERNS: dict[int, re.Pattern] = {}


def _token_pattern(least: int) -> re.Pattern:
    return _PATTERNS.setdefault(least, re.compile(rf"[A-Za-z0-9+/_-]{{{least},}}"))


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


SCAN_SCHEMA = "row long, doc_id long, repo string, owner string, n_assign long, n_access long, n_hex long, base array<struct<kind:string,start:long,stop:long,value_hash:long>>, extra array<struct<kind:string,start:long,stop:long,value_hash:long>>"


def scan(docs: DataFrame, rules: OwnershipRules, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """Spans and candidate hashes of each whole text; `row` numbers the rows, for as long as the result is staged."""
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("value_hash", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            counts, base, extra = [], [], []
            for text in texts_of(batch.column("text")):
                found = base_spans(text)
                by = Counter(x[1] for x in found)
                counts.append([by[k] for k in KINDS])
                base.append([{"kind": k, "start": s, "stop": e, "value_hash": _hash(v)} for s, k, e, v in found])
                taken = [(s, e) for s, _, e, _ in found]
                extra.append([{"kind": "live", "start": s, "stop": e, "value_hash": _hash(v)} for s, e, v in random_tokens(text, rules) if not any(a < e and s < b for a, b in taken)])
            arrays = [pa.array(range(row, row + batch.num_rows), pa.int64()), batch.column("doc_id"), batch.column("repo"), batch.column("owner"), *[pa.array([c[i] for c in counts], pa.int64()) for i in range(3)], pa.array(base, item), pa.array(extra, item)]
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "repo", "owner", "n_assign", "n_access", "n_hex", "base", "extra"])

    part = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00null"))
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), part(repo_col).alias("repo"), part(owner_col).alias("owner"))
    return source.mapInArrow(run, SCAN_SCHEMA)


def ownership(scanned: DataFrame, rules: OwnershipRules) -> DataFrame:
    """Distinct repositories and owners of each candidate value: value_hash, n (spans), n_repos, n_owners, verdict.

    Values are counted by repository and owner before they meet, so a value in a third of all
    documents brings a row for each repository and owner, not for each document.
    """
    values = scanned.select("repo", "owner", F.explode(F.concat("base", "extra")).alias("c")).select("repo", "owner", F.col("c.value_hash").alias("value_hash"))
    held = values.groupBy("repo", "owner", "value_hash").agg(F.count(F.lit(1)).alias("n"))
    return held.groupBy("value_hash").agg(F.sum("n").alias("n"), F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners")).withColumn("verdict", F.when((F.col("n_owners") >= rules.example_owners) & (F.col("n_repos") >= rules.example_repos), "example").otherwise("live"))


def find_secrets(docs: DataFrame, rules: OwnershipRules = OwnershipRules(), id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source") -> DataFrame:
    """One row for each row: base counts, base spans, all spans, and how many candidates are live or copied.

    The scan is staged once, and verdicts come back to the rows by the number that it has written for
    each, so equal or null ids do no harm.
    """
    scanned = staged(scan(docs, rules, id_col, text_col, repo_col, owner_col), "secrets")
    verdicts = ownership(scanned, rules)
    spans = scanned.select("row", F.explode(F.concat("base", "extra")).alias("c")).select("row", "c.*")
    judged = join_by_count(spans, verdicts, "value_hash", spans.count())
    per_row = judged.groupBy("row").agg(
        F.collect_list(F.when((F.col("kind") == "live") & (F.col("verdict") == "live"), F.struct("kind", "start", "stop"))).alias("added"),
        F.count_if((F.col("verdict") == "live")).alias("n_live"),
        F.count_if((F.col("verdict") == "example")).alias("n_example"),
    )
    base = F.transform("base", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop")))
    order = lambda k: F.array_position(F.array(*[F.lit(x) for x in (*KINDS, "live")]), k)
    everything = F.array_sort(F.transform(F.concat("base_spans", F.coalesce("added", F.array().cast("array<struct<kind:string,start:long,stop:long>>"))), lambda c: F.struct(c["start"].alias("start"), order(c["kind"]).alias("rank"), c["stop"].alias("stop"), c["kind"].alias("kind"))))
    joined = lambda spans: F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["stop"].cast("string"))), ",")
    return (
        scanned.withColumn("base_spans", base)
        .join(per_row, "row", "left")
        .select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(everything).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))
    )
