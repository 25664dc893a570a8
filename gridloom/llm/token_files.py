"""Token-id files: documents tokenized, coded in context-mixing blocks and written in order of doc_id.

The files are Parquet rows (shards) of whole documents, in ascending order: ids and lengths of the
documents, and their token ids as blocks that stand alone (see id_coder). A shard carries where it
starts within its part; the parts' sizes give the starts in the whole corpus.

Defined results: a null or empty text has the end id only; rows of one doc_id are documents of their
own, in order of a hash of their text; null ids come first; texts of any length are taken whole; an empty
table gives no rows; other columns are not read. A damaged block raises BlockError when it is read, and
a tokenizer whose ids depend on white space is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import documents, groups_for, input_bytes, pieces
from gridloom.llm.id_coder import BLOCK_IDS, decode_blocks, encode_blocks, split_blocks
from gridloom.sources.shared import shared_folder

SHARD = "part int, shard int, part_start long, n_ids long, doc_ids array<long>, lengths array<long>, vocabulary int, blocks binary"
ARROW_SHARD = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("part_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("vocabulary", pa.int32()), ("blocks", pa.binary())])
#: Ids from which a shard is closed, and bytes of text that are tokenized at once.
SHARD_IDS, BATCH_BYTES = BLOCK_IDS, 4 << 20
#: Words whose ids a worker keeps between batches, and runs of letters that are encoded as one text.
KEPT_WORDS, RUNS_AT_ONCE = 600_000, 100
#: Parts in a block of the prefix sums, and parts whose starts are broadcast (some 16 bytes each).
BLOCK_PARTS, BROADCAST_PARTS = 4096, 1_000_000


def _steps(part: dict | None, inner: str) -> list[dict]:
    return [] if part is None else [x for p in part[inner] for x in _steps(p, inner)] if part["type"] == "Sequence" else [part]


#: What stands about white space when a pre-tokenizer is tried out.
PROBE = "a b\t1\n!\r.  's\v_ \f-\n\né \t'"


def drops_white_space(model: str) -> bool:
    """Whether a model's ids are those of its text's runs without white space, one after another.

    It is so where the normalizer composes, folds case or replaces white space by spaces, the first step
    of the pre-tokenizer keeps matches of a pattern, of which none holds white space, and nothing
    is added, cut or filled up after it.
    """
    from tokenizers import Tokenizer

    spec = json.loads(model)
    normal, pre = _steps(spec.get("normalizer"), "normalizers"), _steps(spec.get("pre_tokenizer"), "pretokenizers")
    spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    if any(x["type"] not in ("NFC", "Lowercase") and x != spaces for x in normal) or any(spec.get(k) for k in ("post_processor", "truncation", "padding")):
        return False
    if not pre or (pre[0]["type"], pre[0].get("behavior"), pre[0].get("invert")) != ("Split", "Removed", True) or any(x["type"] != "ByteLevel" or x["add_prefix_space"] or x["use_regex"] for x in pre[1:]):
        return False
    found = Tokenizer.from_str(model).pre_tokenizer.pre_tokenize_str(PROBE)
    return not any(set(PROBE[a:b]) & set(" \t\n\v\f\r") for _, (a, b) in found)


#: The pattern that keeps a run of letters, and marks after it, as tokens of their own, as in the public model.
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters that normalizers map one by one to letters, and the marks that may follow them in a word.
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u0410-\u044f]+"
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LETTERS_AND_MARKS = f"^{LETTERS}[!-&(-/:-@\\[-`{{-~]*$"


def _ids(tokenizer, texts: list[str]) -> Iterator[np.ndarray]:
    for i in range(0, len(texts), 50_000):
        for one in tokenizer.encode_batch_fast(texts[i : i + 50_000], add_special_tokens=False):
            yield np.array(one.ids, np.uint32)


def _gathered(starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The entries `at` of a list of runs in flat, one after another."""
    out = [np.zeros(0, flat.dtype)]
    for i in range(0, len(at), 1 << 20):
        part = at[i : i + (1 << 20)]
        own = sizes[part]
        stops = np.cumsum(own)
        out.append(flat[np.repeat(starts[part] - stops + own, own) + np.arange(int(stops[-1]))])
    return np.concatenate(out)


class WordTokenizer:
    """A tokenizers library model that drops white space; each distinct run without ASCII white space is encoded once.

    Neither the model's normalizer nor its pre-tokenizer looks across white space, so the ids of a
    text are those of its runs. Where the model takes runs of letters as tokens, those and marks after them are
    encoded apart, and many runs at once: each ends with a piece of the end of a word. If there
    are not as many of these as runs, the runs are encoded one by one.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        if not drops_white_space(model):
            raise ValueError("the tokenizer's ids are not those of runs without white space")
        self.tokenizer = Tokenizer.from_str(model)
        self.vocabulary = self.tokenizer.get_vocab_size()
        spec = json.loads(model)
        suffix = spec["model"].get("end_of_word_suffix")
        self.lowers = any(x["type"] == "Lowercase" for x in _steps(spec.get("normalizer"), "normalizers"))
        self.ends = self.merges = None
        if spec["model"]["type"] == "BPE" and suffix and _steps(spec["pre_tokenizer"], "pretokenizers")[0]["pattern"] == {"Regex": LETTER_RUNS}:
            names = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(names.values()) + 1, bool)
            self.ends[[i for name, i in names.items() if name.endswith(suffix)]] = True
            # Lower-case ASCII letters pass the normalizer and the pre-tokenizer unchanged.
            self.merges = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}))
        self._parts, self._flat = pa.array([], pa.large_string()), np.zeros(0, np.uint32)
        self._starts = self._sizes = np.zeros(0, np.int64)

    def encode(self, texts: pa.Array, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, each followed by those of end, one after another; and how many each has."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        words = split.flatten().dictionary_encode()
        starts, sizes, flat = self._words(words.dictionary)
        stops = np.cumsum(pc.list_value_length(split).to_numpy())
        at = np.insert(words.indices.to_numpy(), stops, len(sizes))
        starts, sizes, flat = np.append(starts, len(flat)), np.append(sizes, len(end)), np.append(flat, end)
        before = np.cumsum(sizes[at])[stops + np.arange(len(stops))]
        return _gathered(starts, sizes, flat, at), np.diff(before, prepend=0)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each word start, how many there are, and the ids."""
        stems, tails, tail = words, [""], np.zeros(len(words), np.int64)
        if self.ends is not None:
            plain = pc.match_substring_regex(words, LETTERS_AND_MARKS)
            stems = pc.if_else(plain, pc.ascii_rtrim(pc.ascii_lower(words) if self.lowers else words, MARKS), words)
            cut = pc.subtract(pc.binary_length(words), pc.binary_length(stems)).to_numpy()
            marked = np.flatnonzero(cut)
            own = pa.array([w[-n:] for w, n in zip(words.take(marked).cast(pa.large_binary()).to_pylist(), cut[marked].tolist(), strict=True)], pa.large_binary()).cast(pa.large_string()).dictionary_encode()
            tails += own.dictionary.to_pylist()
            tail[marked] = 1 + own.indices.to_numpy()
        coded = pa.concat_arrays([stems, pa.array(tails, pa.large_string())]).dictionary_encode()
        place = self._places(coded.dictionary)[coded.indices.to_numpy()]
        both = np.stack([place[: len(words)], place[len(words) :][tail]], axis=1)
        sizes = self._sizes[both].sum(axis=1)
        return np.cumsum(sizes) - sizes, sizes, _gathered(self._starts, self._sizes, self._flat, both.ravel())

    def _places(self, parts: pa.Array) -> np.ndarray:
        """Which of the kept parts each of some distinct ones is; fresh ones are encoded."""
        place = pc.index_in(parts, value_set=self._parts)
        if len(self._parts) + place.null_count > KEPT_WORDS:  # what these texts hold is kept
            keep = place.drop_null().to_numpy()
            self._flat = _gathered(self._starts, self._sizes, self._flat, keep)
            self._parts, self._sizes = self._parts.take(keep), self._sizes[keep]
            self._starts = np.cumsum(self._sizes) - self._sizes
            place = pc.index_in(parts, value_set=self._parts)
        fresh = parts.filter(place.is_null())
        place = place.fill_null(-1).to_numpy().astype(np.int64)
        place[place < 0] = len(self._parts) + np.arange(len(fresh))
        starts, sizes, flat = self._encoded(fresh)
        self._parts = pa.concat_arrays([self._parts, fresh])
        self._starts, self._sizes = np.concatenate([self._starts, starts + len(self._flat)]), np.concatenate([self._sizes, sizes])
        self._flat = np.concatenate([self._flat, flat])
        return place

    def _encoded(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        texts = [w.decode("utf-8", "replace") for w in parts.cast(pa.large_binary()).to_pylist()]
        plain = np.zeros(len(texts), bool) if self.ends is None else pc.match_substring_regex(parts, f"^{LETTERS}$").to_numpy(zero_copy_only=False)
        starts, sizes, flat, held = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [np.zeros(0, np.uint32)], 0
        lower = np.zeros(len(texts), bool) if self.ends is None else pc.match_substring_regex(parts, "^[a-z]+$").to_numpy(zero_copy_only=False)
        alone = [np.flatnonzero(~plain)]
        for tokenizer, together in ((self.merges, np.flatnonzero(plain & lower)), (self.tokenizer, np.flatnonzero(plain & ~lower))):
            groups = [together[i : i + RUNS_AT_ONCE] for i in range(0, len(together), RUNS_AT_ONCE)]
            for group, one in zip(groups, _ids(tokenizer, [" ".join([texts[i] for i in g]) for g in groups]), strict=True):
                stops = np.flatnonzero(self.ends[one]) + 1
                if len(stops) != len(group) or stops[-1] != len(one):
                    alone.append(group)
                    continue
                sizes[group] = np.diff(stops, prepend=0)
                starts[group] = held + stops - sizes[group]
                flat.append(one)
                held += len(one)
        alone = np.concatenate(alone)
        for i, one in zip(alone.tolist(), _ids(self.tokenizer, [texts[i] for i in alone.tolist()]), strict=True):
            starts[i], sizes[i] = held, len(one)
            flat.append(one)
            held += len(one)
        return starts, sizes, np.concatenate(flat)


@lru_cache(maxsize=2)
def _tokenizer(model: str) -> WordTokenizer:
    return WordTokenizer(model)


def _shard(part: int, shard: int, start: int, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, vocabulary: int) -> pa.RecordBatch:
    blocks = np.array_split(ids, max(1, round(len(ids) / BLOCK_IDS))) if len(ids) else []
    row = {"part": part, "shard": shard, "part_start": start, "n_ids": len(ids), "doc_ids": doc_ids, "lengths": lengths, "vocabulary": vocabulary, "blocks": b"".join(encode_blocks(blocks, vocabulary))}
    return pa.RecordBatch.from_pylist([row], ARROW_SHARD)


def _shards(batches: Iterator[pa.RecordBatch], tokenizer: WordTokenizer, part: int, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    vocabulary = max(tokenizer.vocabulary, *(end + 1).tolist(), 1)
    shard = start = size = 0
    doc_ids: list[int | None] = []
    lengths, ids = [], []

    def close() -> pa.RecordBatch:
        nonlocal shard, start, size, doc_ids, lengths, ids
        out = _shard(part, shard, start, doc_ids, np.concatenate(lengths), np.concatenate(ids), vocabulary)
        shard, start, size, doc_ids, lengths, ids = shard + 1, start + size, 0, [], [], []
        return out

    for batch in batches:
        for piece in pieces(batch, "text", BATCH_BYTES):
            own, sizes = tokenizer.encode(piece.column("text"), end)
            doc_ids += piece.column("doc_id").to_pylist()
            lengths.append(sizes)
            ids.append(own)
            size += len(own)
            if size >= SHARD_IDS:
                yield close()
    if doc_ids:
        yield close()


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize each whole text, append end_id, and write the files under path.

    Documents are dealt by ranges of doc_id, so the parts follow each other in order; the tokenizer's
    file, whose size is fixed by the model, is sent to the workers.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        model = spark.sparkContext.broadcast(file.read())
    end = np.array([] if end_id is None else [end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _shards(batches, _tokenizer(model.value), TaskContext.get().partitionId(), end)

    source = documents(docs, id_col, text_col).withColumn("turn", F.xxhash64("text"))
    parts = groups_for(input_bytes(docs, text_col), 16 << 20, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = source.repartitionByRange(parts, "doc_id", "turn").sortWithinPartitions("doc_id", "turn").select("doc_id", "text")
    ordered.mapInArrow(run, SHARD).write.option("compression", "none").parquet(path)


def _starts(shards: DataFrame) -> DataFrame:
    """part, before: the ids of all parts before a part. Prefix sums within blocks of parts, and over the blocks' sums, a row for each BLOCK_PARTS parts."""
    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("block", F.floor(F.col("part") / BLOCK_PARTS))
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = sums.withColumn("inside", ahead(Window.partitionBy("block").orderBy("part")))
    blocks = sums.groupBy("block").agg(F.sum("n").alias("n")).withColumn("outside", ahead(Window.orderBy("block"))).drop("n")
    return inside.join(blocks, "block").select("part", (F.col("inside") + F.col("outside")).alias("before"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (binary: little-endian unsigned 32-bit) from the files."""
    shards = spark.read.schema(SHARD).parquet(path)
    starts = _starts(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _documents(batch.slice(i, 1).to_pylist()[0])

    placed = shards.join(F.broadcast(starts) if starts.count() <= BROADCAST_PARTS else starts, "part")
    return placed.mapInArrow(run, "doc_id long, start long, ids binary")


def _documents(row: dict) -> pa.RecordBatch:
    ids = np.concatenate([np.zeros(0, "<u4"), *decode_blocks(split_blocks(row["blocks"]), row["vocabulary"])])
    lengths = np.array(row["lengths"], np.int64)
    stops = np.cumsum(lengths)
    starts = (row["before"] + row["part_start"] + stops - lengths).tolist()
    texts = [ids[stop - n : stop].tobytes() for n, stop in zip(row["lengths"], stops.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "start", "ids"])


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """write() into the shared folder, and read() back."""
    path = f"{shared_folder(docs.sparkSession)}/gridloom-tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer_path, end_id, id_col, text_col)
    return read(docs.sparkSession, path)


def digests(read_back: DataFrame) -> DataFrame:
    return read_back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
