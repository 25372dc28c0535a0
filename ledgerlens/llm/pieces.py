"""SentencePiece encoding and decoding, batched in numpy.

Texts are cut into words that no piece crosses; the distinct words of a batch are grouped by length, and words of equal
length advance together as rows of one matrix. All their substrings are hashed by a rolling hash and probed in the sorted
hashes of the pieces at once.

A unigram model is decoded by Viterbi: for each end, the best start over all pieces is a vectorised maximum whose argument
is stored as backpointer. A BPE model isn't a sum of scores, so Viterbi would give other pieces than the model defines;
for those the same matrices drive the merges: in each step the best adjacent pair of every word is a vectorised maximum.
The kind of the model file decides.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import importable

#: Words of more characters are merged one by one with a heap: a matrix over their substrings would grow too large.
LONG = 64
CACHE_WORDS = 400_000
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: piece types
UNIGRAM, BPE = 1, 2  # fixed values: model types
_BASE = np.uint64(0x100000001B3)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol-buffers message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}[kind] if kind != 2 else varint()
            yield key >> 3, data[at : at + n]
            at += n


@dataclass
class PieceModel:
    """A piece model: pieces, scores, types and the normaliser's switches. Build it with `load`."""

    pieces: list[str]
    scores: np.ndarray
    types: np.ndarray
    kind: int
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    byte_fallback: bool = False
    ids: dict[str, int] = field(init=False)

    def __post_init__(self):
        self.ids = {p: i for i, p in enumerate(self.pieces)}
        usable = [i for i, t in enumerate(self.types) if t in (NORMAL, USER)]
        self.unknown = int(np.flatnonzero(self.types == UNKNOWN)[0])
        self.byte_ids = [self.ids.get(f"<0x{b:02X}>", self.unknown) for b in range(256)]
        self.longest = max((len(self.pieces[i]) for i in usable), default=1)
        hashes = np.array([self._hash_one(self.pieces[i]) for i in usable], np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.keys, self.key_ids = hashes[order], np.array(usable, np.int64)[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces have one hash")
        # One byte a bucket of hashes: most substrings are no piece, and needn't be searched for.
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> np.uint64(44)] = True
        self.spelled = [bytes([int(p[1:-1], 16)]) if t == BYTE else b" \xe2\x81\x87 " if t == UNKNOWN else b"" if t == CONTROL else p.replace(MARK, " ").encode() for p, t in zip(self.pieces, self.types, strict=True)]
        self.usable = {self.pieces[i]: i for i in usable}
        self.unknown_score = float(self.scores[usable].min() - 10.0) if usable else -10.0
        inside = set("".join(p for p in self.usable if len(p) > 1))
        # White space that is part of no longer piece stands alone, so texts can be cut there.
        alone = "".join(re.escape(c) for c in "\n\r\t\x0b\x0c" if c not in inside)
        self.cutter = re.compile(rf"{MARK}*[^{MARK}{alone}]+|{MARK}+|[{alone}]") if alone else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    @staticmethod
    def _hash_one(s: str) -> int:
        h = 0
        for c in s:
            h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
        return h

    @classmethod
    def load(cls, data: bytes) -> PieceModel:
        pieces, scores, types = [], [], []
        kind, fallback = UNIGRAM, False
        flags = {"dummy_prefix": True, "squeeze": True, "escape": True}
        for number, value in _fields(data):
            if number == 1:
                text, score, type_ = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        text = v.decode("utf-8")
                    elif n == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif n == 3:
                        type_ = v
                pieces.append(text), scores.append(score), types.append(type_)
            elif number == 2:
                for n, v in _fields(value):
                    kind = v if n == 3 else kind
                    fallback = bool(v) if n == 35 else fallback
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2 and v:
                        raise ValueError("models with a character map are not supported")
                    if n in (3, 4, 5):
                        flags[{3: "dummy_prefix", 4: "squeeze", 5: "escape"}[n]] = bool(v)
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        return cls(pieces, np.array(scores), np.array(types), kind, byte_fallback=fallback, **flags)

    # Normalising and cutting

    def normalize(self, text: str | None) -> str:
        text = text or ""
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if self.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", MARK) if self.escape else text

    def words(self, text: str | None) -> list[str]:
        return self.cutter.findall(self.normalize(text))

    # Encoding

    def _matrix(self, words: list[str]) -> np.ndarray:
        """id[w, start, length-1] of each substring that is a piece, else -1; words are of one length."""
        n = len(words[0])
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n).astype(np.uint64) + np.uint64(1)
        top = min(n, self.longest)
        out = np.full((len(words), n, top), -1, np.int64)
        h = np.zeros_like(chars)
        for k in range(top):
            h = h[:, : n - k] * _BASE + chars[:, k:]
            w, i = np.nonzero(self.maybe[h >> np.uint64(44)])
            want = h[w, i]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            out[w, i, k] = np.where(self.keys[at] == want, self.key_ids[at], -1)
        return out

    def _viterbi(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Best segmentations of words of one length by the sum of scores: word, start, end and id of each part."""
        ids = self._matrix(words)
        count, n, top = ids.shape
        score = np.where(ids >= 0, self.scores[ids], -np.inf)
        score[:, :, 0] = np.where(ids[:, :, 0] >= 0, score[:, :, 0], self.unknown_score)
        best, back = np.full((count, n + 1), -np.inf), np.zeros((count, n + 1), np.int64)
        best[:, 0] = 0
        for end in range(1, n + 1):
            starts = np.arange(max(0, end - top), end)
            total = best[:, starts] + score[:, starts, end - starts - 1]
            pick = total.argmax(axis=1)
            best[:, end], back[:, end] = total[np.arange(count), pick], starts[pick]
        live, nxt = np.zeros((count, n), bool), np.zeros((count, n), np.int64)
        rows, end = np.arange(count), np.full(count, n)
        while len(rows):
            start = back[rows, end]
            live[rows, start], nxt[rows, start] = True, end
            rows, end = rows[start > 0], start[start > 0]
        return self._parts(ids, live, nxt)

    @staticmethod
    def _parts(ids: np.ndarray, live: np.ndarray, nxt: np.ndarray) -> tuple[np.ndarray, ...]:
        w, start = np.nonzero(live)
        end = nxt[w, start]
        return w, start, end, ids[w, start, end - start - 1]

    def _merge(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Merges of words of one length: each step joins every word's best adjacent pair, leftmost first.

        Returns word, start, end and id of each part.
        """
        ids = self._matrix(words)
        count, n, top = ids.shape
        score = np.where(ids >= 0, self.scores[ids], -np.inf)
        # next[w, i]: end of the symbol that starts at i, or 0 where none starts; place n is a sentinel.
        nxt = np.tile(np.arange(1, n + 2), (count, 1))
        nxt[:, n] = n
        live = np.ones((count, n), bool)
        rows = np.arange(count)
        place = np.arange(n)
        while len(rows) and n > 1:
            second = nxt[rows][:, :n]
            end = np.take_along_axis(nxt[rows], second, axis=1)
            length = end - place
            ok = live[rows] & (second < n) & (length <= top)
            value = np.where(ok, score[rows[:, None], place, np.minimum(length, top) - 1], -np.inf)
            pick = value.argmax(axis=1)
            good = value[np.arange(len(rows)), pick] > -np.inf
            rows, pick, second, end = rows[good], pick[good], second[good], end[good]
            k = np.arange(len(rows))
            live[rows, second[k, pick]] = False
            nxt[rows, pick] = end[k, pick]
        return self._parts(ids, live, nxt)

    def _merge_long(self, word: str) -> list[tuple[int, int]]:
        """The same merges for one long word, with a heap over adjacent pairs."""
        n = len(word)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        alive, heap = [True] * n, []

        def offer(i: int) -> None:
            j = nxt[i] if i >= 0 else n
            if i >= 0 and j < n and nxt[j] - i <= self.longest and (p := self.usable.get(word[i : nxt[j]])) is not None:
                heapq.heappush(heap, (-self.scores[p], i, j, nxt[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, j, end = heapq.heappop(heap)
            if alive[i] and j < n and alive[j] and nxt[i] == j and nxt[j] == end:
                alive[j], nxt[i] = False, end
                if end < n:
                    prev[end] = i
                offer(prev[i])
                offer(i)
        return [(i, nxt[i]) for i in range(n) if alive[i]]

    def _viterbi_long(self, word: str) -> list[tuple[int, int]]:
        n = len(word)
        best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                p = self.usable.get(word[start:end])
                s = self.scores[p] if p is not None else self.unknown_score if end - start == 1 else -np.inf
                if best[start] + s > best[end]:
                    best[end], back[end] = best[start] + s, start
        spans, end = [], n
        while end:
            spans.append((back[end], end))
            end = back[end]
        return spans[::-1]

    def _ids(self, word: str, spans: list[tuple[int, int]]) -> tuple[int, ...]:
        out: list[int] = []
        gap = False  # the previous character was unknown too: without bytes, a run of them is one id
        for a, b in spans:
            p = self.usable.get(word[a:b])
            if p is not None:
                out.append(p)
            elif self.byte_fallback:
                out.extend(self.byte_ids[x] for x in word[a:b].encode("utf-8", "replace"))
            elif not gap:
                out.append(self.unknown)
            gap = p is None
        return tuple(out)

    def encode_words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct words."""
        by_length: dict[int, list[str]] = {}
        out = {}
        with np.errstate(over="ignore", invalid="ignore"):
            for w in words:
                if len(w) > LONG:
                    out[w] = self._ids(w, self._merge_long(w) if self.kind == BPE else self._viterbi_long(w))
                else:
                    by_length.setdefault(len(w), []).append(w)
            for n, same in by_length.items():
                step = max(1, 2_000_000 // (n * min(n, self.longest)))
                for at in range(0, len(same), step):
                    part = same[at : at + step]
                    which, start, end, found = self._merge(part) if self.kind == BPE else self._viterbi(part)
                    cuts = np.searchsorted(which, np.arange(len(part) + 1)).tolist()
                    plain = np.ones(len(part), bool)
                    plain[which[found < 0]] = False
                    flat = found.tolist()
                    for k, (w, ok) in enumerate(zip(part, plain.tolist(), strict=True)):
                        a, b = cuts[k], cuts[k + 1]
                        out[w] = tuple(flat[a:b]) if ok else self._ids(w, list(zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)))
        return out

    # Decoding

    def decode(self, ids) -> str:
        """The text of ids: bytes are joined and decoded, marks become blanks, the dummy prefix goes."""
        get = self.spelled.__getitem__
        text = b"".join(map(get, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


class Encoder:
    """Encodes and decodes texts in batches; encoded words are kept up to CACHE_WORDS."""

    def __init__(self, model: PieceModel):
        self.model, self.cache = model, {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.model.words(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = list({w for words in cut for w in words if w not in self.cache})
        self.cache.update(self.model.encode_words(new))
        get, chain = self.cache.__getitem__, itertools.chain.from_iterable
        return [np.fromiter(chain(map(get, words)), np.int32) for words in cut]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return [self.model.decode(x.tolist()) for x in ids]


def encode(docs: DataFrame, model_bytes: bytes, batch: int = 256) -> DataFrame:
    """docs with `ids` (array<int>): the ids of the whole text; null or empty text has none.

    One pass without a shuffle. The model, of fixed size, is broadcast; a column `ids` of docs is replaced.
    """
    spark = docs.sparkSession
    importable(spark)
    sent = spark.sparkContext.broadcast(model_bytes)
    rest = [c for c in docs.columns if c != "ids"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = Encoder(PieceModel.load(sent.value))
        for table in batches:
            for at in range(0, table.num_rows, batch):
                part = table.slice(at, batch)
                ids = encoder.encode(part.column(part.schema.get_field_index("text")).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, "ids"])

    source = docs.select(*rest)
    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, model_bytes: bytes) -> DataFrame:
    """rows with `decoded` (string): the text of `ids`; null ids give null."""
    spark = rows.sparkSession
    importable(spark)
    sent = spark.sparkContext.broadcast(model_bytes)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = PieceModel.load(sent.value)
        for table in batches:
            for at in range(0, table.num_rows, 256):
                part = table.slice(at, 256)
                column = part.column(part.schema.get_field_index("ids"))
                flat, cuts, known = column.values.to_numpy(), column.offsets.to_pylist(), column.is_valid().to_pylist()
                texts = [model.decode(flat[a:b].tolist()) if ok else None for a, b, ok in zip(cuts[:-1], cuts[1:], known, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def model_file(path: str | None = None) -> bytes:
    """Bytes of a model file on the driver; by default the public 32,000-piece model of the tokenizer folder."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def pieces_digest(docs: DataFrame, model_bytes: bytes) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip): round_trip says whether decoding the ids gives the text back."""
    model = PieceModel.load(model_bytes)
    both = decode(encode(docs.select("doc_id", "text"), model_bytes), model_bytes)
    text = F.coalesce("text", F.lit(""))
    if model.squeeze:
        text = F.regexp_replace(F.trim(text), " +", " ")
    return both.select("doc_id", "ids", F.size("ids").alias("n_ids"), (F.col("decoded") == F.replace(text, F.lit(MARK), F.lit(" "))).alias("round_trip"))
