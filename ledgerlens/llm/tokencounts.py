"""Token counts that follow edits.

A document's text is cut into pre-tokens, which the tokenizer encodes one by one. The counts are kept in a segment tree
whose leaves are runs of pre-tokens and whose inner nodes hold sums of characters, pre-tokens and tokens. An edit
re-encodes only the pre-tokens that it can change: from the last boundary whose left side doesn't look at the edit to the
first boundary after it that the old text had too. The sums above the touched leaves are updated, the rest is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, importable

#: Pre-tokens in a leaf: a leaf splits beyond twice as many.
LEAF = 128
CACHE_WORDS = 400_000
#: Columns of a kept tree.
TREE = "lengths array<int>, tokens array<int>, leaves array<int>, n_pretokens long, n_tokens long"
TREE_NAMES = ("lengths", "tokens", "leaves", "n_pretokens", "n_tokens")


class Tokenizer:
    """Token counts of pre-tokens of one vocabulary, kept up to CACHE_WORDS."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.find = regex.compile(pattern)
        outer = self

        class Counts(dict):
            def __missing__(self, word: str) -> int:
                if len(self) >= CACHE_WORDS:
                    self.clear()
                value = self[word] = len(outer.encoding.encode_ordinary(word))
                return value

        self.counts = Counts()

    def cut(self, text: str) -> list[str]:
        return self.find.findall(text)


class Leaf:
    __slots__ = ("lengths", "tokens")

    def __init__(self, lengths: np.ndarray, tokens: np.ndarray):
        self.lengths, self.tokens = lengths, tokens

    def sums(self) -> tuple[int, int, int]:
        return int(self.lengths.sum()), len(self.lengths), int(self.tokens.sum())


class TokenTree:
    """The segment tree of one text. sums[1] is the root; node k has children 2k and 2k+1; leaves start at `width`."""

    def __init__(self, tokenizer: Tokenizer, text: str):
        self.tokenizer, self.text = tokenizer, text
        words = tokenizer.cut(text)
        self._fill(np.fromiter(map(len, words), np.int64, len(words)), np.fromiter(map(tokenizer.counts.__getitem__, words), np.int64, len(words)))
        #: Pre-tokens encoded since the text was first read.
        self.reencoded = 0

    @classmethod
    def of_parts(cls, tokenizer: Tokenizer, text: str, lengths: np.ndarray, tokens: np.ndarray, leaves: np.ndarray) -> TokenTree:
        """The tree that `parts` came from; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.tokenizer, tree.text, tree.reencoded = tokenizer, text, 0
        ends = np.cumsum(leaves)
        tree.leaves = [Leaf(lengths[b - n : b], tokens[b - n : b]) for n, b in zip(leaves, ends, strict=True)]
        tree._grow()
        return tree

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lengths and tokens of all pre-tokens, and how many of them each leaf holds."""
        return np.concatenate([x.lengths for x in self.leaves]), np.concatenate([x.tokens for x in self.leaves]), np.array([len(x.lengths) for x in self.leaves])

    def _fill(self, lengths: np.ndarray, tokens: np.ndarray) -> None:
        self.leaves = [Leaf(lengths[i : i + LEAF], tokens[i : i + LEAF]) for i in range(0, len(lengths), LEAF)] or [Leaf(lengths, tokens)]
        self._grow()

    def _grow(self) -> None:
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 3), np.int64)
        for k, leaf in enumerate(self.leaves):
            self.sums[self.width + k] = leaf.sums()
        at = self.width
        while at > 1:
            at //= 2
            self.sums[at : 2 * at] = self.sums[2 * at : 4 * at : 2] + self.sums[2 * at + 1 : 4 * at : 2]

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1][2])

    @property
    def n_pretokens(self) -> int:
        return int(self.sums[1][1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """Leaf that holds the character at `place` (the last leaf for the end), and where it starts."""
        k, start = 1, 0
        while k < self.width:
            k *= 2
            if place >= start + self.sums[k][0] and k + 1 < 2 * self.width and self.sums[k + 1][0]:
                start += int(self.sums[k][0])
                k += 1
        return min(k - self.width, len(self.leaves) - 1), start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces text[start:end]; places are cut to the text."""
        n = len(self.text)
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        text = self.text[:start] + new + self.text[end:]
        # A pre-token looks at one character beyond its end at most, so those that end before `start - 1` stay; one more
        # is taken back because a blank may move from one pre-token to the next.
        first, at = self.leaf_at(max(start - 1, 0))
        while True:
            bounds = at + np.cumsum(self.leaves[first].lengths)
            stay = max(0, int(np.searchsorted(bounds, start - 1)) - 1)
            if stay or not first:
                break
            first -= 1
            at -= int(self.leaves[first].lengths.sum())
        begin = at + int(self.leaves[first].lengths[:stay].sum())
        shift = len(new) - (end - start)
        lengths, tokens = [], []
        leaf, old = first, begin  # boundary of the old text, as leaf and place in it
        inside = stay
        place = begin
        count = self.tokenizer.counts
        for m in self.tokenizer.find.finditer(text, begin):
            # Does the old text have a boundary here, beyond the edit? Then the rest is as before.
            if place >= start + len(new):
                want = place - shift
                while old < want and leaf < len(self.leaves):
                    if inside < len(self.leaves[leaf].lengths):
                        old += int(self.leaves[leaf].lengths[inside])
                        inside += 1
                    else:
                        leaf, inside = leaf + 1, 0
                if old == want and old >= end:
                    break
            lengths.append(m.end() - m.start())
            tokens.append(count[m.group()])
            place = m.end()
        else:
            leaf, inside = len(self.leaves), 0
        self.reencoded += len(lengths)
        self.text = text
        tail = self.leaves[leaf] if leaf < len(self.leaves) else Leaf(np.zeros(0, np.int64), np.zeros(0, np.int64))
        head = self.leaves[first]
        joined = Leaf(np.concatenate([head.lengths[:stay], np.array(lengths, np.int64), tail.lengths[inside:]]), np.concatenate([head.tokens[:stay], np.array(tokens, np.int64), tail.tokens[inside:]]))
        last = min(leaf, len(self.leaves) - 1)
        if first == last and 0 < len(joined.lengths) <= 2 * LEAF:
            self.leaves[first] = joined
            k = self.width + first
            self.sums[k] = joined.sums()
            while k > 1:
                k //= 2
                self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]
            return
        parts = [Leaf(joined.lengths[i : i + LEAF], joined.tokens[i : i + LEAF]) for i in range(0, len(joined.lengths), LEAF)]
        self.leaves[first : last + 1] = parts
        self.leaves = self.leaves or [joined]
        self._grow()


def default_vocabulary(path: str | None = None) -> tuple[dict[bytes, int], str]:
    """(ranks, pattern) of a rank file on the driver; by default the public byte-level BPE of 50,256 entries."""
    import base64

    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, public_tokenizers.PATTERN


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    values = np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def _columns(trees: list[TokenTree]) -> list[pa.Array]:
    parts = zip(*(t.parts() for t in trees), strict=True)
    return [*map(_lists, map(list, parts)), pa.array([t.n_pretokens for t in trees], pa.int64()), pa.array([t.n_tokens for t in trees], pa.int64())]


def _rows(column: pa.ListArray) -> list[np.ndarray]:
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield batch.slice(at, 256)


def _with(rows: DataFrame, drop: tuple[str, ...] = (), more: str = "") -> T.StructType:
    return T.StructType([f for f in rows.schema if f.name not in drop] + T.StructType.fromDDL(more + TREE).fields)


def build_trees(docs: DataFrame, vocabulary: tuple[dict[bytes, int], str]) -> DataFrame:
    """The trees of docs (doc_id, text), and edits where docs has them: one row a document, to be written and kept.

    lengths and tokens are the pre-tokens in order, leaves how many of them each leaf holds, n_pretokens and n_tokens the
    sums at the root: a reader of counts reads these columns alone. Null text counts as empty and has one empty leaf; null
    and repeated ids are rows like others; other columns of docs are left out; an empty table gives an empty one. One pass
    without a shuffle; memory follows the longest text.
    """
    spark = docs.sparkSession
    importable(spark)
    sent = spark.sparkContext.broadcast(vocabulary)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *(c for c in ("edits",) if c in docs.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(*sent.value)
        for part in _packets(batches):
            trees = [TokenTree(tokenizer, text) for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, *_columns(trees)], [*part.schema.names, *TREE_NAMES])

    return rows.mapInArrow(run, _with(rows))


def edit_trees(trees: DataFrame, vocabulary: tuple[dict[bytes, int], str]) -> DataFrame:
    """trees after the edits of their column `edits`, with n_tokens_before and n_reencoded.

    edits is an array of (start, end, new): text[start:end] becomes new, one edit after another, in code points of the text
    as it then is; equal edits each count. Null or empty edits change nothing; a null part of an edit is 0 or empty; places
    beyond the text are cut to it. Only the pre-tokens that an edit can change are encoded. Null and repeated ids are rows
    like others; no shuffle; memory follows the longest text.
    """
    spark = trees.sparkSession
    importable(spark)
    sent = spark.sparkContext.broadcast(vocabulary)
    rows = trees.select("doc_id", "text", "edits", *TREE_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(*sent.value)
        for part in _packets(batches):
            kept = zip(part.column("text").to_pylist(), *(_rows(part.column(c)) for c in TREE_NAMES[:3]), strict=True)
            done = [TokenTree.of_parts(tokenizer, *x) for x in kept]
            for tree, edits in zip(done, part.column("edits").to_pylist(), strict=True):
                for e in edits or ():
                    tree.edit(e["start"] or 0, e["end"] or 0, e["new"] or "")
            own = [part.column("doc_id"), pa.array([t.text for t in done], pa.string()), part.column("n_tokens"), pa.array([t.reencoded for t in done], pa.int64())]
            yield pa.RecordBatch.from_arrays([*own, *_columns(done)], ["doc_id", "text", "n_tokens_before", "n_reencoded", *TREE_NAMES])

    return rows.mapInArrow(run, _with(rows, ("edits", *TREE_NAMES), "n_tokens_before long, n_reencoded long, "))


def apply_edits(trees: DataFrame, edits: DataFrame, vocabulary: tuple[dict[bytes, int], str]) -> DataFrame:
    """Kept trees after a batch of edits (doc_id, edits), as `build_trees` gives them.

    Only edited documents go through Python; all others are passed on as they are. Several rows of one id are one list of
    edits, in the order of the arrays' values; edits of a null id go to the rows with a null id, those of an unknown id
    nowhere. Rows that share an id all take its edits.
    """
    batch = edits.groupBy(F.col("doc_id").alias("__id")).agg(F.flatten(F.sort_array(F.collect_list("edits"))).alias("edits")).filter(F.size("edits") > 0)
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    kept = trees.select("doc_id", "text", *TREE_NAMES)
    edited = edit_trees(kept.join(batch, same).drop("__id"), vocabulary)
    return kept.join(batch, same, "left_anti").unionByName(edited.select(*kept.columns))


def count_edited(docs: DataFrame, vocabulary: tuple[dict[bytes, int], str]) -> DataFrame:
    """(doc_id, n_tokens_before, n_tokens, n_pretokens, n_reencoded, edited_text) of docs (doc_id, text, edits).

    Trees are built and edited in one go, for documents whose trees nobody keeps; rules as in `edit_trees`.
    """
    out = edit_trees(build_trees(docs, vocabulary), vocabulary)
    return out.select("doc_id", "n_tokens_before", "n_tokens", "n_pretokens", "n_reencoded", F.col("text").alias("edited_text"))


def revision_edits(text: str = "text", doc_id: str = "doc_id"):
    """The edits of the query: a word in the middle goes, a sentence comes at a place that follows the id, the end is closed."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t)
    middle = F.call_function("div", n, F.lit(2)).cast("int")
    place = F.pmod(F.pmod(F.coalesce(F.col(doc_id), F.lit(0)), n + 1) * F.lit(7919).cast("long"), n + 1).cast("int")  # the remainder first: ids may have 64 bits
    edit = lambda a, b, new: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), new.alias("new"))
    return F.array(
        edit(middle, F.least(n, middle + 9), F.lit("")),
        edit(place, place, F.concat(F.lit(" Revised "), F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.lit(". "))),
        edit(F.lit(2**31 - 1), F.lit(2**31 - 1), F.lit("\nEnd.")),
    )


def token_digest(docs: DataFrame, vocabulary: tuple[dict[bytes, int], str]) -> DataFrame:
    """Builds and stores the trees of all documents, then edits the stored ones."""
    trees = Scratch(docs.sparkSession).write(build_trees(docs.select("doc_id", "text"), vocabulary), "trees")
    out = edit_trees(trees.withColumn("edits", revision_edits()), vocabulary)
    return out.select("doc_id", "n_tokens_before", "n_tokens", "n_pretokens", "n_reencoded", F.crc32("text").alias("edited_crc32"))
