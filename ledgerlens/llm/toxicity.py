"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a logistic score over hashed words; a document's score is the noisy-or
of its sentences, 1 - prod(1 - p). Only documents have labels: the gradient of the noisy-or hands a toxic label to the
sentences that explain it, so the trained model also says which sentences offend.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, importable

BITS = 20
#: Most labelled rows used for the fit, those with the smallest hashes of doc_id; the only bound in this module.
SAMPLE_ROWS = 20_000
EPOCHS, RATE, SPARSE = 250, 1.0, 2e-5
CACHE_WORDS = 400_000
#: Features worked on at a time in the fit, so that its memory follows the sample's int32 features alone.
BLOCK = 1 << 18
_SPLIT = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    #: Where there was nothing to tell apart: the share of toxic documents, which each document gets, however long it is.
    share: float | None = None

    def probability(self, z: np.ndarray) -> np.ndarray:
        """Probabilities of the sentences of one document."""
        if self.share is not None:
            return np.full(len(z), -np.expm1(np.log1p(-self.share) / max(len(z), 1)))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Buckets(dict):
    """Feature of a word; the cache starts anew when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> (64 - BITS)
        return value


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Spans of the parts of a text between . ! ? and line ends that hold a letter."""
    text, out, at = text or "", [], 0
    for m in _SPLIT.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, b) for a, b in out if _WORD.search(text, a, b)]


def bag(text: str | None, buckets: Buckets) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Features of all sentences, one after another, each once a sentence; the sentence of each; spans."""
    spans = sentences(text)
    ids, which = [], []
    for k, (a, b) in enumerate(spans):
        found = {buckets[w] for w in _WORD.findall(text[a:b].lower())}
        ids.extend(found)
        which.extend([k] * len(found))
    return np.array(ids, np.int64), np.array(which, np.int64), spans


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Features of each document as int32, and the number of features of each of its sentences."""
    buckets = Buckets()
    for pdf in batches:
        out = []
        for h, y, text in zip(pdf["h"], pdf["y"], pdf["text"], strict=True):
            ids, which, spans = bag(text, buckets)
            if spans:
                out.append((h, y, np.bincount(which, minlength=len(spans)).astype(np.int32).tobytes(), ids.astype(np.int32).tobytes()))
        yield pd.DataFrame(out, columns=["h", "y", "sizes", "ids"])


@dataclass(frozen=True)
class Bags:
    """Labels of documents, sentences of each, features of each sentence (one at least), and the features themselves."""

    y: np.ndarray
    sentences: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray

    def blocks(self) -> list[Bags]:
        """Parts of whole documents, of about BLOCK features each."""
        ends = np.cumsum(self.sizes)[np.cumsum(self.sentences) - 1] if len(self.y) else np.zeros(0, np.int64)
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, BLOCK)), len(ends)))
        s = np.concatenate([[0], np.cumsum(self.sentences)])
        f = np.concatenate([[0], ends])
        return [Bags(self.y[a:b], self.sentences[a:b], self.sizes[s[a] : s[b]], self.ids[f[a] : f[b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def gradient(bags: Bags, weights: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Gradient of the summed negative log-likelihood of the labels under the noisy-or of the sentences."""
    z = np.add.reduceat(weights[bags.ids], np.cumsum(bags.sizes) - bags.sizes) + bias
    p = np.clip(1 / (1 + np.exp(-np.clip(z, -35, 35))), 1e-9, 1 - 1e-9)
    clean = np.exp(np.add.reduceat(np.log1p(-p), np.cumsum(bags.sentences) - bags.sentences))
    toxic = np.clip(1 - clean, 1e-9, 1)
    of_doc = np.where(bags.y == 1, -clean / toxic, 1.0)
    grad = p * np.repeat(of_doc, bags.sentences)
    return np.bincount(bags.ids, np.repeat(grad, bags.sizes), minlength=len(weights)), float(grad.sum())


def fit_bags(bags: Bags) -> Model:
    """Adagrad on the noisy-or likelihood with an L1 penalty; documents are worked through in blocks in each epoch.

    Without documents of both labels there is nothing to learn: every document with a sentence gets the share of toxic ones,
    moved a little from 0 and 1.
    """
    n = len(bags.y)
    if not n or bags.y.min() == bags.y.max():
        share = float(bags.y.mean()) if n else 0.0
        return Model(np.zeros(1 << BITS), 0.0, (share + 0.01) / 1.02)
    used, place = np.unique(bags.ids, return_inverse=True)
    blocks = Bags(bags.y, bags.sentences, bags.sizes, place.astype(np.int32)).blocks()
    del place
    weights, seen = np.zeros(len(used)), np.full(len(used), 1e-8)
    bias, bias_seen = -8.0, 1e-8
    for _ in range(EPOCHS):
        g, gb = np.zeros(len(used)), 0.0
        for block in blocks:
            part, at = gradient(block, weights, bias)
            g += part
            gb += at
        g, gb = g / n, gb / n
        seen += g * g
        step = RATE / np.sqrt(seen)
        weights -= step * g
        weights = np.sign(weights) * np.maximum(np.abs(weights) - step * SPARSE, 0)
        bias_seen += gb * gb
        bias -= RATE * gb / np.sqrt(bias_seen)
    whole = np.zeros(1 << BITS)
    whole[used] = weights
    return Model(whole, bias)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from at most sample_rows labelled rows whose crc32(doc_id) mod 5 is not 0; other labels are never read.

    Rows without a sentence say nothing and are left out. Repeated ids make several rows, each with each of its labels; the
    bound holds for the rows. The driver gets the features of these rows as int32, in Arrow batches.
    """
    scratch = Scratch(docs.sparkSession)
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    order = F.xxhash64("doc_id")
    chosen = usable.select("doc_id", F.col("toxic").cast("int").alias("y")).orderBy(order, "doc_id", "y").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(order.alias("h"), "y", "text")
    kept = scratch.write(rows.mapInPandas(_bags, "h long, y int, sizes binary, ids binary"), "bags")
    found = kept.orderBy("h", "y", "ids", "sizes").limit(sample_rows).toArrow()  # the fit doesn't depend on the order in which tasks end
    scratch.drop()

    def joined(name: str) -> tuple[np.ndarray, list[int]]:
        parts = [x.as_buffer() for x in found.column(name)]
        return np.concatenate([np.frombuffer(x, np.int32) for x in parts] or [np.zeros(0, np.int32)]), [x.size // 4 for x in parts]

    (ids, _), (sizes, sentences) = joined("ids"), joined("sizes")
    y = found.column("y").to_numpy().astype(np.int64)
    del found
    return fit_bags(Bags(y, np.array(sentences, np.int64), sizes, ids))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_sentences, worst_start, worst_length, n_offending, worst_sentence) of every row, whole texts.

    Null texts and texts without a letter have no sentence: score 0, worst_* null. Texts of any length are read whole, a row
    at a time; equal texts get equal scores, of equal sentences the first is the worst; a row comes out for each row, also
    of null or repeated ids; other columns are not read. The model, of fixed size, is broadcast.
    """
    spark = docs.sparkSession
    importable(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, buckets = sent.value, Buckets()
        names = ["doc_id", "score", "n_sentences", "worst_start", "worst_length", "n_offending", "worst_sentence"]
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids, which, spans = bag(text, buckets)
                if not spans:
                    out.append((doc_id, 0.0, 0, None, None, 0, None))
                    continue
                p = model.probability(np.bincount(which, model.weights[ids], minlength=len(spans)) + model.bias)
                k = int(p.argmax())
                a, b = spans[k]
                out.append((doc_id, float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), len(spans), a, b - a, int((p >= 0.5).sum()), text[a:b].strip()))
            frame = pd.DataFrame(out, columns=names)
            yield frame.astype({"worst_start": "Int64", "worst_length": "Int64"})

    schema = "doc_id string, score double, n_sentences long, worst_start long, worst_length long, n_offending long, worst_sentence string"
    out = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """held_out is crc32 of the id as text mod 5 = 0 (of an empty text for a null id)."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "n_offending", "worst_start", "worst_length")
