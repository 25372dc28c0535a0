"""LM scoring by cross-entropy difference.

Two bigram models, one of a target corpus and one of the background (all documents), share one vocabulary and one set of
bigrams: every word and every bigram, at any input size. The models are matched: background counts are scaled to the
target's number of tokens, which gives the expected counts of a draw of the target's size. A document is scored without its
own words (they are taken out of both models first), so a document of the target has no advantage over others.

    P(w | v) = (n(v, w) + BETA) / (n(v) + BETA * V), n(v) = sum of n(v, w) over w; a document begins after a START.

The score is the mean over a document's tokens of the target's loss minus the background's: the lower, the more the document
looks like the target. A document's loss splits into a sum over its bigrams and its contexts, each of which needs one count
only. So its distinct bigrams and contexts go once, sorted and packed, to the bucket where all occurrences of a key meet;
the bucket counts them and sends back sums by document. What occurs in one document only changes nothing and sends nothing
back. Frequent keys (a share of HOT of all tokens, at most 2 / HOT of them) don't go to buckets, so that no bucket gets more
than a fixed share of a key; they are chosen on a sample of documents and counted over all of them, and their counts are
broadcast. A wrong choice costs time, never a count.

Keys are 51 bits of a hash; where two of n keys fall together, which happens to one key in 2^51 / n, they share counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, importable
from .words import finish, hashed_parts

BETA = 0.05
#: Share of all tokens from which on a key's counts are broadcast.
HOT = 2e-6
#: One in so many documents is looked at to choose frequent keys.
SAMPLE = 16
#: Documents and tokens that are packed together; tokens of a bucket on average.
DOC_BITS = 12
TOKENS_IN_PACKET, TOKENS_IN_BUCKET = 1_000_000, 1_500_000
LEAST_BUCKETS = 64
#: Most packets whose targets are broadcast (at most 1 kB each); with more they are joined.
BROADCAST_PACKETS = 20_000

#: Places that stand for no frequent key: START as a context, and all tokens.
STARTS, TOKENS = -1, -2

_DOC, _KEY = np.uint64((1 << DOC_BITS) - 1), np.uint64(DOC_BITS)
_KIND = np.uint64(1 << DOC_BITS)
_START, _MIX = np.uint64(0x5851F42D4C957F2D), np.uint64(0x9E3779B97F4A7C15)


def keys(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bigrams of texts of n words each, a START before each text, and of the contexts that are words.

    A key's last DOC_BITS bits are the number of the text; the bit before tells contexts (1) from bigrams (0).
    """
    doc = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    first = (np.cumsum(n) - n)[n > 0]
    before = np.empty_like(words)
    before[1:], before[first] = words[:-1], _START
    later = np.ones(len(words), bool)
    later[first] = False
    low = ~(_DOC | _KIND)
    with np.errstate(over="ignore"):
        pairs = (finish(before * _MIX + words) & low) | doc
        return pairs, (finish(before[later] ^ _MIX) & low) | _KIND | doc[later]


def counted(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each stands there."""
    at = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
    return sorted_keys[at], np.diff(np.append(at, len(sorted_keys)))


def pack(*columns: np.ndarray) -> bytes:
    """Byte by byte, the highest bytes of all numbers together, so that small numbers compress."""
    return b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns)


def unpack(data: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        w = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * w, at).reshape(w, n).T).view(kind).reshape(n))
        at += n * w
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.zeros(1, x.dtype))


@dataclass
class Packet:
    """Documents taken together: their ids, numbers of words, and their distinct keys with counts."""

    number: int
    ids: pa.Array
    words: np.ndarray
    keys: np.ndarray
    counts: np.ndarray

    def hot(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key whether it is one of hot (sorted, without documents), and its place there."""
        lo, hi = np.searchsorted(self.keys, hot << _KEY), np.searchsorted(self.keys, (hot << _KEY) | _DOC, "right")
        some, change = hi > lo, np.zeros(len(self.keys) + 1, np.int64)
        change[lo[some]] += 1
        change[hi[some]] -= 1
        return np.cumsum(change)[:-1] > 0, np.repeat(np.arange(len(hot)), hi - lo)


def packets(batches: Iterator[pa.RecordBatch]) -> Iterator[Packet]:
    """Packets of a partition's rows (doc_id, text); the same rows give the same packets, with the same numbers."""
    ids, sizes, parts, tokens, docs, nth = [], [], [], 0, 0, 0
    where = TaskContext.get().partitionId() if TaskContext.get() else 0

    def packet() -> Packet:
        n, w = np.concatenate(sizes), np.concatenate(parts)
        names = pa.concat_arrays(ids)
        number = xxhash.xxh3_64(w.tobytes())
        for x in (n.tobytes(), names.fill_null(-1).to_numpy().tobytes(), f"{where} {nth}".encode()):
            number.update(x)
        del w
        both = np.concatenate(keys(np.concatenate(parts), n))
        parts.clear()
        both.sort()
        return Packet(number.intdigest() >> 1, names, n, *counted(both))

    for batch in batches:
        for i, j, hashes, n in hashed_parts(batch.column("text")):
            names, at = batch.column("doc_id").slice(i, j - i), 0
            ends = np.cumsum(n)
            while at < len(n):
                done = ends[at - 1] if at else 0
                # A packet ends with the document that fills it, or with its last place.
                to = min(len(n), at + (1 << DOC_BITS) - docs, int(np.searchsorted(ends, done + TOKENS_IN_PACKET - tokens)) + 1)
                ids.append(names.slice(at, to - at))
                sizes.append(n[at:to])
                parts.append(hashes[done : ends[to - 1]])
                tokens, docs, at = tokens + int(ends[to - 1] - done), docs + to - at, to
                if tokens >= TOKENS_IN_PACKET or docs == 1 << DOC_BITS:
                    yield packet()
                    ids, sizes, parts, tokens, docs, nth = [], [], [], 0, 0, nth + 1
    if docs:
        yield packet()


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys that a packet has twice or more, and the tokens of the packet under a null key."""
    for p in packets(batches):
        distinct, at = np.unique(p.keys >> _KEY, return_index=True)
        n = np.add.reduceat(p.counts, at) if len(at) else np.zeros(0, np.int64)
        often = n > 1
        found = pa.array(distinct[often].astype(np.int64))
        yield pa.record_batch([pa.concat_arrays([found, pa.array([None], pa.int64())]), pa.array(np.append(n[often], p.words.sum()))], ["key", "n"])


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, hashes, _ in hashed_parts(batch.column("text")):
            yield pa.record_batch([pa.array(np.unique(hashes).view(np.int64))], ["word"])


def _described(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row a packet: ids, numbers of words, and the frequent keys by place and document."""
    for p in packets(batches):
        mask, place = p.hot(hot)
        at = (place.astype(np.uint64) << _KEY | (p.keys[mask] & _DOC)).astype(np.uint32)
        ids = pa.ListArray.from_arrays(pa.array([0, len(p.ids)], pa.int32()), p.ids)
        words = pa.ListArray.from_arrays(pa.array([0, len(p.words)], pa.int32()), pa.array(p.words.astype(np.int64)))
        yield pa.record_batch([pa.array([p.number]), ids, words, pa.array([int(mask.sum())]), pa.array([pack(_steps(at), p.counts[mask].astype(np.uint32))], pa.binary())], ["packet", "ids", "words", "size", "data"])


def _postings(batches: Iterator[pa.RecordBatch], hot: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """A row a packet and bucket: the other keys; a bucket is a key's highest bits."""
    for p in packets(batches):
        mask, _ = p.hot(hot)
        k, c = p.keys[~mask], p.counts[~mask]
        cuts = np.append(np.searchsorted(k, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(k))
        rows = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
        data = [pack(_steps(k[lo:hi]), c[lo:hi].astype(np.uint32)) for _, lo, hi in rows]
        columns = [pa.array([b for b, _, _ in rows], pa.int32()), pa.array([p.number] * len(rows), pa.int64()), pa.array([hi - lo for _, lo, hi in rows], pa.int64()), pa.array(data, pa.binary())]
        yield pa.record_batch(columns, ["bucket", "packet", "size", "data"])


@dataclass(frozen=True)
class Model:
    """What losses need beside a key's own counts. scale: target tokens by background tokens. starts: documents with a word."""

    vocabulary: int
    scale: float
    starts: tuple[int, int]

    def gains(self, n, t, count, target, context) -> tuple[np.ndarray, np.ndarray]:
        """By how much keys change the log-probability of a document that has them count times, in the target's and the background's model, against never seen keys.

        n and t: a key's occurrences in all documents and in the target, this document's included.
        """
        prior = np.where(context, BETA * self.vocabulary, BETA)
        sign = np.where(context, -count, count)
        return sign * np.log1p((t - count * target) / prior), sign * np.log1p((n - count) * self.scale / prior)


def _targets(words: list[int] | None) -> np.ndarray:
    """Whether a packet's documents are in the target, from 64 bits a number."""
    bits = np.array(words if words is not None and len(words) else [0] * (1 << DOC_BITS - 6), np.int64).astype("<i8")
    return np.unpackbits(bits.view(np.uint8), bitorder="little").astype(np.int64)


def _summed(doc: np.ndarray, t: np.ndarray, b: np.ndarray) -> tuple[int, bytes]:
    t, b = np.bincount(doc, t), np.bincount(doc, b)
    who = np.flatnonzero((t != 0) | (b != 0))
    return len(who), pack(who.astype(np.uint16), t[who].astype(np.float32), b[who].astype(np.float32))


def _count_bucket(table: pa.Table, model: Model) -> pa.Table:
    """Counts a bucket's keys and sums up what they change, a row a packet."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("packet", "size", "data", "target")), strict=True))
    every, counts, targets, cuts = [], [], [], np.cumsum([0, *(r[1] for r in rows)])
    for _, size, data, target in rows:
        step, c = unpack(data, size, "u8", "u4")
        k = np.cumsum(step, dtype=np.uint64)
        every.append(k)
        counts.append(c.astype(np.int64))
        targets.append(_targets(target)[(k & _DOC).astype(np.int64)])
    key, count, target = np.concatenate(every), np.concatenate(counts), np.concatenate(targets)
    del every, counts, targets
    doc = (key & _DOC).astype(np.int64)
    key >>= _KEY
    order = np.argsort(key)
    run = key[order]
    at = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    sizes = np.diff(np.append(at, len(run)))
    n = np.repeat(np.add.reduceat(count[order], at), sizes)
    t = np.repeat(np.add.reduceat((count * target)[order], at), sizes)
    shared = np.repeat(sizes > 1, sizes)
    who = order[shared]
    gains = np.zeros((2, len(key)))
    gains[:, who] = model.gains(n[shared], t[shared], count[who], target[who], (key[who] & np.uint64(1)) == 1)
    out = []
    for (packet, *_), lo, hi in zip(rows, cuts[:-1], cuts[1:], strict=True):
        size, data = _summed(doc[lo:hi], gains[0, lo:hi], gains[1, lo:hi])
        if size:
            out.append((packet, size, data))
    names = (("packet", pa.int64()), ("size", pa.int64()), ("data", pa.binary()))
    return pa.table([pa.array([r[i] for r in out], kind) for i, (_, kind) in enumerate(names)], names=[c for c, _ in names])


def _hot_counts(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Occurrences of the frequent keys in all documents and in the target, by place; the same of STARTS and TOKENS."""
    n, t, starts, tokens = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(2, np.int64), np.zeros(2, np.int64)
    for pdf in batches:
        for count, data, words, bits in zip(pdf["size"], pdf["data"], pdf["words"], pdf["target"], strict=True):
            step, c = unpack(data, count, "u4", "u4")
            at, target = np.cumsum(step, dtype=np.uint32), _targets(bits)
            place = (at >> np.uint32(DOC_BITS)).astype(np.int64)
            n += np.bincount(place, c, size).astype(np.int64)
            t += np.bincount(place, c * target[at & np.uint32(_DOC)], size).astype(np.int64)
            words = np.asarray(words, np.int64)
            starts += [(words > 0).sum(), (words > 0) @ target[: len(words)]]
            tokens += [words.sum(), words @ target[: len(words)]]
    some = np.flatnonzero(n)
    yield pd.DataFrame({"place": [*some, STARTS, TOKENS], "n": [*n[some], starts[0], tokens[0]], "t": [*t[some], starts[1], tokens[1]]})


def _finish(table: pa.Table, model: Model, hot: np.ndarray, n: np.ndarray, t: np.ndarray) -> pa.Table:
    """Losses of a packet's documents, from the packet's own row and the sums of the buckets."""
    rows = table.to_pylist()
    own = next((r for r in rows if r["words"] is not None), None)
    if own is None or sum(r["words"] is not None for r in rows) > 1:
        raise ValueError("the documents were not read as before: write the input to a table first")
    words, target = np.array(own["words"], np.int64), _targets(own["target"])[: len(own["words"])]
    sums = np.zeros((2, len(words)))
    for r in rows:
        if r is not own:
            who, a, b = unpack(r["data"], r["size"], "u2", "f4", "f4")
            sums[0, who] += a
            sums[1, who] += b
    step, c = unpack(own["data"], own["size"], "u4", "u4")
    at = np.cumsum(step, dtype=np.uint32)
    place, doc, c = (at >> np.uint32(DOC_BITS)).astype(np.int64), (at & np.uint32(_DOC)).astype(np.int64), c.astype(np.int64)
    for k, gain in enumerate(model.gains(n[place], t[place], c, target[doc], (hot[place] & np.uint64(1)) == 1)):
        sums[k] += np.bincount(doc, gain, len(words))
    for k, gain in enumerate(model.gains(model.starts[0], model.starts[1], np.ones(len(words)), target, np.ones(len(words), bool))):
        sums[k] += gain
    with np.errstate(all="ignore"):
        loss = np.log(model.vocabulary) - sums / words
    none = words == 0
    columns = [pa.array(own["ids"], pa.int64()), pa.array(words), *(pa.array(x, pa.float64(), mask=none) for x in (loss[0], loss[1]))]
    return pa.table([*columns, pc.subtract(columns[2], columns[3])], names=["doc_id", "n_tokens", "loss_target", "loss_background", "score"])


def vocabulary_size(docs: DataFrame) -> int:
    """Number of distinct words to within about a percent, and one for words never seen; it only sets the smoothing."""
    return docs.select("text").mapInArrow(_vocabulary, "word long").agg(F.approx_count_distinct("word", 0.01)).first()[0] + 1


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, score) of every row of docs (doc_id, text), whole texts.

    target: ids (doc_id) of the target corpus; all rows form the background. Null texts and texts without words have n_tokens
    0 and null losses and score. Equal rows are documents of their own, of which each counts for the others; repeated ids are
    in the target together, null ids never. Without a target, or without documents, scores are 0 or there are no rows. Texts
    of any length are read whole. Other columns are not read.

    docs is read several times and must be a table or files: rows that came in other partitions the next time are an error.
    """
    spark = docs.sparkSession
    importable(spark)
    scratch = Scratch(spark)
    source = docs.select(F.col("doc_id").cast("long"), "text")
    vocabulary = vocabulary_size(source)
    some = source.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0).mapInArrow(_frequent, "key long, n long")
    some = scratch.write(some.groupBy("key").agg(F.sum("n").alias("n")), "sample")
    sampled = some.filter("key is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = some.filter(F.col("key").isNotNull() & (F.col("n") >= F.lit(HOT * sampled)) & (F.col("n") > 3)).select("key").toPandas()
    hot = np.sort(often["key"].to_numpy(np.int64).astype(np.uint64))
    hot_keys = spark.sparkContext.broadcast(hot)
    described = scratch.write(source.mapInArrow(lambda x: _described(x, hot_keys.value), "packet long, ids array<long>, words array<long>, size long, data binary"), "packets")

    place = F.posexplode("ids").alias("at", "doc_id")
    found = described.select("packet", place).join(target.select("doc_id").distinct(), "doc_id", "left_semi")
    targets = found.groupBy("packet", F.shiftright("at", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, at & 63)")).alias("b"))
    by_place = F.map_from_entries(F.collect_list(F.struct("k", "b")))
    targets = targets.groupBy("packet").agg(by_place.alias("m"))
    whole = F.transform(F.sequence(F.lit(0), F.lit((1 << DOC_BITS - 6) - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("long")))
    targets = scratch.write(targets.select("packet", whole.alias("target")), "targets")
    targets = F.broadcast(targets) if described.count() <= BROADCAST_PACKETS else targets
    own = described.join(targets, "packet", "left")
    sums = own.mapInPandas(lambda x: _hot_counts(x, len(hot_keys.value)), "place long, n long, t long").groupBy("place").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toPandas()
    total = {r.place: (r.n, r.t) for r in sums[sums["place"] < 0].itertuples()}
    known, inner = np.zeros((2, len(hot)), np.int64), sums[sums["place"] >= 0]
    known[:, inner["place"].to_numpy(np.int64)] = inner[["n", "t"]].to_numpy(np.int64).T
    n, t = total.get(TOKENS, (0, 0))
    model = Model(vocabulary, t / n if n else 0.0, tuple(int(x) for x in total.get(STARTS, (0, 0))))
    counts = spark.sparkContext.broadcast(known)
    bits = max(int(math.log2(LEAST_BUCKETS)), math.ceil(math.log2(max(n, 1) / TOKENS_IN_BUCKET)))

    cold = source.mapInArrow(lambda x: _postings(x, hot_keys.value, bits), "bucket int, packet long, size long, data binary")
    part = cold.join(targets, "packet", "left").groupBy("bucket").applyInArrow(lambda x: _count_bucket(x, model), "packet long, size long, data binary")
    every = own.unionByName(part, allowMissingColumns=True).groupBy("packet")
    return every.applyInArrow(lambda x: _finish(x, model, hot_keys.value, *counts.value), "doc_id long, n_tokens long, loss_target double, loss_background double, score double")


def lm_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The target corpus is what the labels call good (quality 1, not toxic)."""
    return score(docs, labels.filter("quality = 1 and coalesce(toxic, 0) = 0"))
