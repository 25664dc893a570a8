"""Quality rules by distribution divergence.

Each document's character-class and common-word histograms are compared with a reference for its
language by Jensen-Shannon distance. The references are medians over all documents of a language, so
they are corpus statistics; rules of counts (too few words, repeated word windows) stand beside them.

Defined results: a null or empty text has no words and fails the base rule; an unknown or null
language shares one reference; texts below the length guards are never judged by distance; texts of
any length are measured whole; every row is judged by itself, so repeated rows and equal or null ids
do no harm; a distance equal to its bound passes; an empty table gives an empty result; other columns
are not read (judge) or carried (keep_good).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import pieces, staged, utf8_of

# Common words by language.
COMMON_WORDS = {
    "en": "the of and to in is was that for on are with as be by at from it this or an have not which a".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au plus pas avec ne se ce à".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero".split(),
}
# Character classes; other ASCII is punctuation, bytes that go on a code point are not counted.
CLASSES = ["lower", "upper", "digit", "blank", "symbol", "punctuation", "control", "beyond_ascii"]
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class QualityRules:
    """Bounds of the rules; distances are Jensen-Shannon distances with logarithms to base 2.

    A text fails by its character classes alone beyond max_class_distance, or where both histograms
    are further off than both_class_distance and both_word_distance: short clean texts with a few
    numbers are far off in one of them only.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    max_class_distance: float = 0.3
    min_class_chars: int = 200
    both_class_distance: float = 0.2
    both_word_distance: float = 0.25
    min_both_words: int = 60


def _class_table() -> np.ndarray:
    kind = np.full(256, len(CLASSES), np.uint8)
    kind[:128] = CLASSES.index("punctuation")
    kind[:32] = kind[127] = CLASSES.index("control")
    for name, chars in (("lower", bytes(range(97, 123))), ("upper", bytes(range(65, 91))), ("digit", b"0123456789"), ("blank", b" \t\n\v\f\r"), ("symbol", SYMBOLS)):
        kind[list(chars)] = CLASSES.index(name)
    kind[0xC0:] = CLASSES.index("beyond_ascii")
    return kind


CLASS_OF = _class_table()
WORD_INDEX = {lang: {w.encode(): i for i, w in enumerate(words)} for lang, words in COMMON_WORDS.items()}
HISTOGRAM_SCHEMA = "lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, classes array<long>, common array<long>"
HISTOGRAM = dict(zip([c.split()[0] for c in HISTOGRAM_SCHEMA.split(", ")], [pa.string()] + [pa.int64()] * 6 + [pa.list_(pa.int64())] * 2, strict=True))


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words covered by windows of `size` words found twice or more."""
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times, reach, covered = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if times[window] > 1:
            covered += i + size - max(i, reach)
            reach = i + size
    return covered


def repeated_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = data.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    return sum(n - 1 for line, n in Counter(lines).items() if n > 1 and line.split())


def _code_points(data: bytes) -> int:
    return len(data) - int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))


def measure(data: bytes, lang: str | None) -> tuple:
    """The counts and histograms of one text, as in HISTOGRAM from n_words on."""
    words = data.split()
    classes = np.bincount(CLASS_OF[np.frombuffer(data, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]
    index = WORD_INDEX.get(lang or "", {})
    common = [0] * (len(index) + 1)
    if index:
        for w, n in Counter(data.lower().split()).items():
            common[index.get(w, len(index))] += n
    else:
        common[0] = len(words)
    n_chars = _code_points(data)
    blanks = n_chars - int(classes[CLASSES.index("blank")])
    return len(words), blanks, int(classes[CLASSES.index("symbol")]), repeated_lines(data), repeated_words(words), n_chars, classes.tolist(), common


def _measured(text: str, lang: str, names: list[str]):
    """Batches with the counts and histograms put behind the columns of `names`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, text)):
            langs = [x if x in COMMON_WORDS else "other" for x in batch.column(lang).to_pylist()]
            rows = [measure(data, x) for data, x in zip(utf8_of(batch.column(text)), langs, strict=True)]
            columns = [langs, *(list(c) for c in zip(*rows, strict=True))] if rows else [[] for _ in HISTOGRAM]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(c, k) for c, k in zip(columns, HISTOGRAM.values(), strict=True))], [*names, *HISTOGRAM])

    return run


def histograms(docs: DataFrame, columns: list[str], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts and histograms of each row, beside the named columns as c0, c1, ...; words are runs without ASCII white space."""
    names = [f"c{i}" for i in range(len(columns))]
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)], *[F.col(f"`{c}`").cast("string").alias(n) for c, n in ((text_col, "text"), (lang_col, "lang_name"))])
    # A text that is carried anyway is not sent twice.
    text = names[columns.index(text_col)] if text_col in columns and source.schema[names[columns.index(text_col)]].dataType.simpleString() == "string" else "text"
    carried = source.drop("text") if text != "text" else source
    kinds = {c: source.schema[c].dataType.simpleString() for c in names}
    return carried.mapInArrow(_measured(text, "lang_name", names), ", ".join([*(f"{c} {k}" for c, k in kinds.items()), HISTOGRAM_SCHEMA]))


def references(hists: DataFrame, steps: int = 1000) -> DataFrame:
    """Median share of each class and word among all documents of a language, in steps of 1/steps.

    Medians, so that junk in a language does not bend its reference; the steps bound what the exact
    percentile keeps. A row for each language of COMMON_WORDS and one for all others, at most.
    """

    def medians(column: str, size: int) -> Column:
        total = F.aggregate(F.col(column), F.lit(0).cast("long"), lambda s, v: s + v)
        share = lambda i: F.round(F.try_divide(F.get(column, F.lit(i)) * steps, total))
        return F.array(*[F.coalesce(F.percentile(share(i), F.lit(0.5)), F.lit(0.0)) for i in range(size)]).alias(f"ref_{column}")

    widest = max(map(len, COMMON_WORDS.values())) + 1
    return hists.groupBy("lang").agg(medians("classes", len(CLASSES)), medians("common", widest))


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts or shares; the shorter counts as zeros beyond its end, no counts at all as distance 0."""

    def share(x: Column) -> Column:
        total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
        return F.transform(x, lambda v: F.try_divide(v.cast("double"), total))

    def term(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def both(p: Column, q: Column) -> Column:
        p, q = F.coalesce(p, F.lit(0.0)), F.coalesce(q, F.lit(0.0))
        m = (p + q) / 2
        return term(p, m) + term(q, m)

    divergence = F.aggregate(F.zip_with(share(a), share(b), both), F.lit(0.0), lambda s, v: s + v) / 2
    return F.sqrt(F.greatest(F.coalesce(divergence, F.lit(0.0)), F.lit(0.0)))


def _verdicts(docs: DataFrame, rules: QualityRules, columns: list[str], text_col: str, lang_col: str) -> DataFrame:
    """The named columns as c0, c1, ... with counts, distances and verdict of each row.

    The histograms are staged once, as references and verdicts both read them. The references are
    broadcast: at most one row for each known language and one for the rest.
    """
    hists = staged(histograms(docs, columns, text_col, lang_col), "quality")
    joined = hists.join(F.broadcast(references(hists)), "lang", "left")
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    far = ((F.col("n_chars") >= rules.min_class_chars) & (F.col("class_distance") > rules.max_class_distance)) | (
        (F.col("n_words") >= rules.min_both_words) & (F.col("class_distance") > rules.both_class_distance) & (F.col("word_distance") > rules.both_word_distance)
    )
    measured = joined.withColumn("class_distance", js_distance(F.col("classes"), F.col("ref_classes"))).withColumn("word_distance", js_distance(F.col("common"), F.col("ref_common")))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~far)


def judge(docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row: counts, both distances, base_failed and the verdict `kept`."""
    found = _verdicts(docs, rules, [id_col], text_col, lang_col)
    return found.select(F.col("c0").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that the rules keep, with all their columns; each row is decided by itself.

    Rows carry their columns through the measurement, so no verdict is joined back by an id.
    """
    return _verdicts(docs, rules, docs.columns, text_col, lang_col).filter("kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def oracle(rules: QualityRules = QualityRules()) -> str:
    """judge() of the table documents in DuckDB's SQL."""
    widest = max(map(len, COMMON_WORDS.values())) + 1
    patterns = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "blank": r" \x09-\x0D", "symbol": "#*$%&|<>", "control": r"\x00-\x08\x0E-\x1F\x7F"}
    count = lambda chars: f"length(regexp_replace(t, '[^{chars}]', '', 'g'))"
    ascii_all = r"length(regexp_replace(t, '[^\x00-\x7F]', '', 'g'))"
    counts = [f"{ascii_all} - " + " - ".join(count(c) for c in patterns.values()) if n == "punctuation" else f"length(t) - {ascii_all}" if n == "beyond_ascii" else count(patterns[n]) for n in CLASSES]
    lists = " ".join(f"WHEN '{lang}' THEN [{', '.join(repr(w) for w in words)}]" for lang, words in COMMON_WORDS.items())
    median = lambda column, i: f"coalesce(quantile_cont(round({column}[{i + 1}] * 1000 / nullif(list_sum({column}), 0)::DOUBLE), 0.5), 0)"

    def distance(a: str, b: str) -> str:
        p, q = (f"coalesce({x}[i] / nullif(list_sum({x}), 0)::DOUBLE, 0)" for x in (a, b))
        term = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
        shares = f"CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN list_sum(list_transform(range(1, greatest(len({a}), len({b})) + 1), lambda i: {term(p)} + {term(q)})) / 2 ELSE 0 END"
        return f"sqrt(greatest({shares}, 0))"

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({", ".join(repr(x) for x in COMMON_WORDS)}) THEN lang ELSE 'other' END AS lang, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS words FROM documents),
c AS (SELECT *, len(words) AS n_words, length(t) AS n_chars, [{", ".join(counts)}] AS classes, CASE lang {lists} ELSE []::VARCHAR[] END AS listed,
  list_transform(words, lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS low FROM d),
m AS (SELECT *, list_concat(list_transform(listed, lambda x: len(list_filter(low, lambda w: w = x))), [len(list_filter(low, lambda w: NOT list_contains(listed, w)))]) AS common FROM c),
refs AS (SELECT lang, [{", ".join(median("classes", i) for i in range(len(CLASSES)))}] AS rc, [{", ".join(median("common", i) for i in range(widest))}] AS rw FROM m GROUP BY 1),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, sum(n - 1)::BIGINT AS n FROM (SELECT doc_id, line, count(*) AS n FROM line WHERE regexp_matches(line, '[^ \\x09-\\x0D]') GROUP BY 1, 2) GROUP BY 1),
gram AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM gram JOIN (SELECT doc_id, g FROM gram GROUP BY 1, 2 HAVING count(*) > 1) USING (doc_id, g)) GROUP BY 1),
j AS (SELECT m.doc_id, n_words, n_chars, n_chars - classes[{CLASSES.index("blank") + 1}] AS word_chars, classes[{CLASSES.index("symbol") + 1}] AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  {distance("classes", "rc")} AS cd, {distance("common", "rw")} AS wd FROM m JOIN refs USING (lang) LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed,
  NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words OR (n_chars >= {rules.min_class_chars} AND cd > {rules.max_class_distance}::DOUBLE) OR (n_words >= {rules.min_both_words} AND cd > {rules.both_class_distance}::DOUBLE AND wd > {rules.both_word_distance}::DOUBLE)) AS kept,
  round(cd, 6) AS class_distance, round(wd, 6) AS word_distance FROM j
"""
