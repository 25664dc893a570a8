"""SentencePiece encoding and decoding with a merge-type prefix table.

For every prefix of a segment the table holds the one token that its encoding ends in. The
candidates are the pieces that end there, which an automaton over reversed pieces yields; a
candidate holds if it goes with the last token of what stands before it, that is if merging the two
pieces' characters gives just these two pieces. Ids are then recovered from the end backwards.

Segments are runs that no merge can cross (a piece has white space at its front only, and characters
outside the vocabulary never merge), so texts of any length are encoded whole, and each distinct
segment of a batch once.

Defined results: a null or empty text gives the begin and end ids only; characters outside the
vocabulary become byte pieces; texts of any length are encoded whole; rows are encoded each by itself, so repeated rows, equal or null ids,
and empty tables need no care; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import documents, pieces, texts_of

SPACE = "▁"
#: Segments up to this many characters are solved side by side, longer ones one at a time.
SIDE_BY_SIDE = 40
#: Entries kept in a worker between batches.
KEPT_SEGMENTS, KEPT_PAIRS = 120_000, 300_000
_NO_PAIR = np.int64(-1)


class PrefixTable:
    """Encoder for a BPE model with identity normalization."""

    def __init__(self, model: bytes):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto.FromString(model)
        norm = spec.normalizer_spec
        kinds = proto.ModelProto.SentencePiece
        if spec.trainer_spec.model_type != proto.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with identity normalization and white space in front is needed")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.processor = spm.SentencePieceProcessor(model_proto=model)
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.begin, self.end, self.unknown = self.processor.bos_id(), self.processor.eos_id(), self.processor.unk_id()
        self.piece = {i: p.piece for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        self.rank = {p.piece: (-p.score, i) for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        self.bytes_at = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        if len(self.bytes_at) < 256:
            raise ValueError("a piece for each byte is needed")
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece has white space after other characters")
        self.known = frozenset("".join(self.rank))
        newline = "" if any("\n" in p for p in self.rank) else "\n"
        self.segment = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if newline else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self._pairs: dict[int, bool] = {}
        self._segments: dict[str, bytes] = {}
        own = {i: p for i, p in self.piece.items() if self._merge(p) == [p]}
        self._ends_scalar = {p: i for i, p in own.items()}
        self.longest = max(map(len, own.values()))
        self._length = np.ones(max(own) + 1, np.int64)
        for i, p in own.items():
            self._length[i] = len(p)
        self._build_automaton(own)
        self._pair_key = np.full(1 << 20, _NO_PAIR)
        self._pair_fits = np.zeros(1 << 20, bool)

    def _merge(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best pair again and again, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((r[0], i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1]))), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _build_automaton(self, own: dict[int, str]) -> None:
        """Trie over reversed pieces: edges sorted by (node, character), and the piece that each node ends."""
        edges: dict[tuple[int, int], int] = {}
        token = [-1]
        for i, p in own.items():
            node = 0
            for c in reversed(p):
                key = (node, ord(c))
                if key not in edges:
                    edges[key] = len(token)
                    token.append(-1)
                node = edges[key]
            token[node] = i
        keys = np.array([(n << 21) | c for n, c in edges], np.int64)
        order = np.argsort(keys)
        self._edge_key, self._edge_to = keys[order], np.array(list(edges.values()), np.int64)[order]
        self._token = np.array(token, np.int64)

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of the two pieces' characters is these two pieces."""
        key = left << 20 | right
        got = self._pairs.get(key)
        if got is None:
            if len(self._pairs) >= KEPT_PAIRS:
                self._pairs.clear()
            got = self._pairs[key] = self._merge(self.piece[left] + self.piece[right]) == [self.piece[left], self.piece[right]]
        return got

    def _fits_many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        slot = ((key * 0x9E3779B1) >> 11) & (len(self._pair_key) - 1)
        fits = self._pair_fits[slot]
        missed = np.flatnonzero(self._pair_key[slot] != key)
        if len(missed):
            fresh, back = np.unique(key[missed], return_inverse=True)
            values = np.array([self.fits(int(k) >> 20, int(k) & 0xFFFFF) for k in fresh])
            fits[missed] = values[back]
            at = ((fresh * 0x9E3779B1) >> 11) & (len(self._pair_key) - 1)
            self._pair_key[at], self._pair_fits[at] = _NO_PAIR, False
            last = dict(zip(at.tolist(), range(len(fresh)), strict=True))  # one key for each slot
            rows = np.fromiter(last.values(), np.int64)
            self._pair_key[at[rows]], self._pair_fits[at[rows]] = fresh[rows], values[rows]
        return fits

    def encode_one(self, segment: str) -> list[int]:
        """Ids of a segment of any length and characters."""
        n, unknown = len(segment), self.unknown
        last, width = [0] * (n + 1), [0] * (n + 1)
        for e in range(1, n + 1):
            if segment[e - 1] not in self.known:
                last[e], width[e] = unknown, 1
                continue
            for k in range(1, min(self.longest, e) + 1):
                t = self._ends_scalar.get(segment[e - k : e])
                if t is None or (e > k and width[e - k] == 0):
                    continue
                if e == k or last[e - k] == unknown or self.fits(last[e - k], t):
                    last[e], width[e] = t, k
                    break
        out: list[int] = []
        e = n
        while e:
            out.extend([self.bytes_at[b] for b in reversed(segment[e - 1].encode("utf-8", "surrogatepass"))] if last[e] == unknown else [last[e]])
            e -= width[e]
        return out[::-1]

    def encode_many(self, segments: list[str]) -> list[bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of short segments without unknown characters."""
        count = len(segments)
        lengths = np.fromiter(map(len, segments), np.int64, count)
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begin = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        longest = int(lengths.max())
        last = np.full((count, longest + 1), -1, np.int64)
        for e in range(1, longest + 1):
            rows = np.flatnonzero(lengths >= e)
            node = np.zeros(len(rows), np.int64)
            for k in range(1, min(self.longest, e) + 1):
                key = (node << 21) | codes[begin[rows] + e - k]
                at = np.minimum(np.searchsorted(self._edge_key, key), len(self._edge_key) - 1)
                alive = self._edge_key[at] == key
                rows, node = rows[alive], self._edge_to[at[alive]]
                if not len(rows):
                    break
                token = self._token[node]
                test = np.flatnonzero(token >= 0)
                if not len(test):
                    continue
                if e > k:
                    before = last[rows[test], e - k]
                    test, before = test[before >= 0], before[before >= 0]
                    test = test[self._fits_many(before, token[test])] if len(test) else test
                last[rows[test], e] = token[test]
                keep = np.ones(len(rows), bool)
                keep[test] = False  # the last token is unique
                rows, node = rows[keep], node[keep]
        at, rows, steps = lengths.copy(), np.arange(count), []
        while len(rows):
            token = last[rows, at[rows]]
            steps.append((rows, token))
            at[rows] -= self._length[token]
            rows = rows[at[rows] > 0]
        owner = np.concatenate([r for r, _ in steps])
        token = np.concatenate([t for _, t in steps])
        turn = np.repeat(np.arange(len(steps)), [len(r) for r, _ in steps])
        order = np.lexsort((-turn, owner))
        data = token[order].astype("<u4").tobytes()
        cut = 4 * np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=count))))
        return [data[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of whole texts with begin and end ids, as little-endian unsigned 32-bit integers."""
        find, memo = self.segment.findall, self._segments
        split = [find(self.prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        fresh = {s for segs in split for s in segs if s not in memo}
        if len(memo) + len(fresh) > KEPT_SEGMENTS:
            memo.clear()
            fresh = {s for segs in split for s in segs}
        short = [s for s in fresh if len(s) <= SIDE_BY_SIDE and self.known.issuperset(s)]
        for i in range(0, len(short), 100_000):
            part = short[i : i + 100_000]
            memo.update(zip(part, self.encode_many(part), strict=True))
        for s in fresh.difference(short):
            memo[s] = np.array(self.encode_one(s), "<u4").tobytes()
        ends = [np.array([i], "<u4").tobytes() for i in (self.begin, self.end)]
        return [b"".join([ends[0], *map(memo.__getitem__, segs), ends[1]]) for segs in split]

    def decode(self, ids: bytes) -> str:
        return self.processor.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(maxsize=2)
def codec(model: bytes) -> PrefixTable:
    """The encoder of a model; built once in each worker."""
    return PrefixTable(model)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) and decoded (the library's decode of them) for each row.

    The model file is read by the driver and sent along: its size is fixed by the model.
    """
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model.value)
        for batch in batches:
            for part in pieces(batch, "text"):
                ids = own.encode(texts_of(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and digests of encode()'s rows."""
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
