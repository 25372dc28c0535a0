"""Alignment of the tokens of two tokenizers by merge-path partitioning.

Both token rows of a text spell the same bytes, so each is an ascending list of end offsets, and aligning them is a merge of
the two lists. Diagonal binary searches cut that merge into pieces of equal work that need nothing of each other: a piece
emits the overlaps of its own ends, and the groups that a cut goes through are stitched from what the pieces say about their
ends. Ends of all documents of a batch stand in one list, as they have their totals in common, so a piece may hold many short
documents or a part of a long one.

How many documents hold a pair of ids linked is counted by Spark over all documents. Frequent pairs, of which there can be only
1/HOT, are looked up in a broadcast table, all others by a join.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, importable

#: Ends merged in one piece.
PIECE = 1 << 16
#: Bytes of text encoded together; a longer text is alone.
BATCH_BYTES = 1 << 19
#: Share of all (document, pair) rows from which a pair is looked up in the broadcast table: at most 1/HOT pairs.
HOT = 2e-6


@dataclass
class Vocabularies:
    """Both tokenizers as files' contents; `path`s are parameters of `load`."""

    a: str
    b: bytes

    @classmethod
    def load(cls, a: str | None = None, b: str | None = None) -> Vocabularies:
        """Of a byte-level BPE JSON file and a piece model file on the driver; by default the public ones."""
        import public_tokenizers

        with open(a or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(b or public_tokenizers.path("piece_bpe_32k.model"), "rb") as g:
            return cls(f.read(), g.read())


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the others for
    code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Speller:
    """Encodes texts with both tokenizers and knows the bytes of every id."""

    def __init__(self, vocabularies: Vocabularies):
        import sentencepiece
        import tiktoken

        letters = byte_letters()
        parsed = json.loads(vocabularies.a)
        self.a_bytes: dict[int, bytes] = {i: bytes(letters[c] for c in entry) for entry, i in parsed["model"]["vocab"].items()}
        if sorted(self.a_bytes) != list(range(len(self.a_bytes))):
            raise ValueError("ids of the byte-level vocabulary must be gapless")
        # In this vocabulary an id is the rank of its merge, which is all that the merging library needs.
        split = parsed["pre_tokenizer"]
        if split.get("type") != "ByteLevel" or parsed.get("normalizer") or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("only plain byte-level vocabularies are supported")
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the pattern of byte-level pre-tokenizers
        self.a = tiktoken.Encoding("aligned", pat_str=pattern, mergeable_ranks={v: k for k, v in self.a_bytes.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=vocabularies.b)
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces]
        self.a_table, self.b_table = _table(self.a_bytes[i] for i in range(len(self.a_bytes))), _table(self.b_bytes)
        self.a_text, self.b_text = _table(b"%d," % i for i in range(len(self.a_bytes))), _table(b"%d," % i for i in range(len(self.b_bytes)))
        self.b_bits = max(1, (len(self.b_bytes) - 1).bit_length())

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both; a text has none where it is null or empty or one of the two doesn't spell its bytes."""
        own_a, own_b = [], []
        none = np.zeros(0, np.int64)
        for text, b in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1), strict=True):
            want = (" " + (text or "")).encode()
            b = np.array(b, np.int64)
            if not text or spell(self.b_table, b) != want:
                own_a.append(none), own_b.append(none)
                continue
            a = np.array(self.a.encode_ordinary(" " + text), np.int64)
            same = spell(self.a_table, a) == want
            own_a.append(a if same else none), own_b.append(b if same else none)
        return own_a, own_b


def _table(entries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries' bytes in one array, and each entry's start and length."""
    entries = list(entries)
    lengths = np.array([len(x) for x in entries], np.int64)
    return np.frombuffer(b"".join(entries), np.uint8), np.cumsum(lengths) - lengths, lengths


def spread(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the entries `ids` behind one another, and where each ends."""
    flat, starts, lengths = table
    n = lengths[ids]
    ends = np.cumsum(n)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[ids] - (ends - n), n)], ends


def spell(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> bytes:
    return spread(table, ids)[0].tobytes()


def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge path of two ascending lists crosses every `piece`-th diagonal: how many of a and of b stand before.

    Equal ends of a come before those of b. All binary searches advance together.
    """
    d = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (low < high).any():
        i = (low + high) // 2
        more = np.zeros(len(d), bool)
        open_ = low < high
        more[open_] = a[i[open_]] <= b[d[open_] - i[open_] - 1]  # a[i] stands before the last b taken, so i is too small
        low, high = np.where(open_ & more, i + 1, low), np.where(open_ & ~more, i, high)
    return low, d - low


def overlaps(a: np.ndarray, b: np.ndarray, i: tuple[int, int], j: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Overlaps that end within one piece, a[i0:i1] and b[j0:j1], as indexes into a and b.

    Each end, of either list, closes one overlap: of the first token of a and the first of b that reach it. An end that both
    have in common closes one overlap only, and belongs to the piece that has a's.
    """
    if j[0] < j[1] and i[0] > 0 and b[j[0]] == a[i[0] - 1]:
        j = (j[0] + 1, j[1])
    ends = np.sort(np.concatenate([a[i[0] : i[1]], b[j[0] : j[1]]]), kind="stable")
    if len(ends):
        ends = ends[np.append(True, ends[1:] != ends[:-1])]
    return i[0] + np.searchsorted(a[i[0] : i[1]], ends), j[0] + np.searchsorted(b[j[0] : j[1]], ends)


def align(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(link_a, link_b, group_a, group_b): all overlaps in order, and the group of every token of a and of b.

    A piece numbers groups from 0; the count of common ends in the pieces before it, and so the group that the cut goes
    through, is added when pieces are stitched.
    """
    at_a, at_b = diagonals(a, b, piece)
    links, groups_a, groups_b, before = [], [], [], 0
    for k in range(len(at_a) - 1):
        i, j = (int(at_a[k]), int(at_a[k + 1])), (int(at_b[k]), int(at_b[k + 1]))
        x, y = overlaps(a, b, i, j)
        links.append((x, y))
        shared = a[x[a[x] == b[y]]]
        groups_a.append(before + np.searchsorted(shared, a[i[0] : i[1]]))
        # An end of b that a's end in the piece before has in common closes the group counted there.
        groups_b.append(before + np.searchsorted(shared, b[j[0] : j[1]]) - (b[j[0] : j[1]] <= (a[i[0] - 1] if i[0] else -1)))
        before += len(shared)
    empty = np.zeros(0, np.int64)
    return (*(np.concatenate([empty, *(x[s] for x in links)]) for s in (0, 1)), np.concatenate([empty, *groups_a]), np.concatenate([empty, *groups_b]))


def _cuts(counts: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def aligned(speller: Speller, texts: list[str | None], piece: int = PIECE) -> dict:
    """Columns of a batch of texts: n_a, n_b, n_groups, n_links, groups (bytes), and distinct pairs with how often each is linked."""
    ids_a, ids_b = speller.encode(texts)
    doc_a, doc_b = _cuts([len(x) for x in ids_a]), _cuts([len(x) for x in ids_b])
    all_a, all_b = np.concatenate(ids_a), np.concatenate(ids_b)
    ends_a, ends_b = np.cumsum(speller.a_table[2][all_a]), np.cumsum(speller.b_table[2][all_b])
    link_a, link_b, group_a, group_b = align(ends_a, ends_b, piece)
    n = len(texts)
    # Groups of a document follow those of the documents before it, so where its tokens begin says where its groups do.
    first = np.zeros(n + 1, np.int64)
    first[1:] = np.append(group_a, -1)[doc_a[1:] - 1] + 1
    # Text: all A ids of a group, then its B ids; the mark behind an id says what follows.
    in_a, in_b = np.bincount(group_a, minlength=int(first[-1])), np.bincount(group_b, minlength=int(first[-1]))
    upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
    place = np.empty(len(all_a) + len(all_b), np.int64)
    place_a, place_b = np.arange(len(all_a)) + (upto_b - in_b)[group_a], np.arange(len(all_b)) + upto_a[group_b]
    place[place_a], place[place_b] = np.arange(len(all_a)), len(all_a) + np.arange(len(all_b))
    flat_a, flat_b = speller.a_text, speller.b_text
    both = (np.concatenate([flat_a[0], flat_b[0]]), np.concatenate([flat_a[1], len(flat_a[0]) + flat_b[1]]), np.concatenate([flat_a[2], flat_b[2]]))
    text, ends = spread(both, np.concatenate([all_a, len(flat_a[1]) + all_b])[place])
    if len(ends):
        last_a, last_b = place_a[upto_a - 1], place_b[upto_b - 1]
        text[ends[last_a] - 1], text[ends[last_b] - 1] = ord("|"), ord(";")
    cut = np.concatenate([[0], ends])[doc_a + doc_b]
    raw = text.tobytes()
    groups = [raw[x : y - 1] if y > x else b"" for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    # Links of a document stand together, as its bytes do.
    per_link = np.searchsorted(doc_a, link_a, side="right") - 1
    n_links = np.bincount(per_link, minlength=n) if len(link_a) else np.zeros(n, np.int64)
    bits = speller.b_bits
    pairs = (all_a[link_a] << bits) | all_b[link_b] if len(link_a) else np.zeros(0, np.int64)
    wide = int(pairs.max(initial=0)).bit_length()
    keys, times = np.unique((per_link << wide) | pairs, return_counts=True)
    owner = np.searchsorted(keys >> wide, np.arange(n + 1))
    return {
        "n_a": np.diff(doc_a),
        "n_b": np.diff(doc_b),
        "n_groups": np.diff(first),
        "n_links": n_links,
        "groups": groups,
        "pairs": keys & ((1 << wide) - 1),
        "times": times,
        "owner": owner,
    }


def _batches(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of at most BATCH_BYTES together, a longer text alone."""
    start, size, part = 0, 0, []
    for k, text in enumerate(column):
        text = text.as_py()
        n = 3 * len(text or "") // 2 + 1
        if part and size + n > BATCH_BYTES:
            yield start, part
            start, size, part = k, 0, []
        part.append(text)
        size += n
    if part:
        yield start, part


def _lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def align_documents(docs: DataFrame, vocabularies: Vocabularies, *, with_groups: bool = False) -> DataFrame:
    """docs (doc_id, text) as (row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times), to be written.

    pairs are the distinct pairs of ids linked in a document, each as A's id above `b_bits` bits of B's, ascending; times says
    how often each is linked. with_groups adds the groups as text. Texts that are null, empty or not spelled by both tokenizers
    have zeros, an empty groups_sha256 and no pairs. One pass without a shuffle; `row` numbers rows once they are stored;
    memory follows BATCH_BYTES or the longest text.
    """
    spark = docs.sparkSession
    importable(spark)
    sent = spark.sparkContext.broadcast(vocabularies)
    more = ", groups string" if with_groups else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(sent.value)
        for batch in batches:
            for at, texts in _batches(batch.column("text")):
                out = aligned(speller, texts)
                groups = out["groups"]
                columns = [
                    batch.column("row").slice(at, len(texts)),
                    batch.column("doc_id").slice(at, len(texts)),
                    *(pa.array(out[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                    pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in groups], pa.string()),
                    _lists(out["pairs"], out["owner"], pa.int64()),
                    _lists(out["times"], out["owner"], pa.int32()),
                    *([pa.array([x.decode() for x in groups], pa.string())] if with_groups else []),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", *(x.split()[0] for x in COUNTS.split(", ")), "pairs", "times", *(["groups"] if with_groups else [])])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(run, f"row long, doc_id {dict(docs.dtypes)['doc_id']}, {COUNTS}, pairs array<long>, times array<int>{more}")


def pair_counts(stored: DataFrame, b_bits: int) -> DataFrame:
    """(pair, n, best) of a stored result of `align_documents`: in how many documents each pair is linked, and whether no
    pair of its A id is in more. Tasks count their own documents before anything is shuffled."""
    counts = stored.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    a = F.shiftright("pair", b_bits).alias("a")
    counts = counts.select("pair", "n", a)
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_scores(stored: DataFrame, counts: DataFrame, scratch: Scratch, hot: float = HOT) -> DataFrame:
    """(row, n_best, count_sum) of each stored document, from the stored counts of pairs.

    Pairs with a share of `hot` or more of all (document, pair) rows, at most 1/hot of them, are broadcast and looked up where
    the documents are; the others' rows are joined with their counts, none of which holds more than that share.
    """
    spark = stored.sparkSession
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    least = max(1, int(hot * total))
    often = counts.filter(F.col("n") >= least).orderBy("pair").toArrow()  # at most 1/hot rows
    table = spark.sparkContext.broadcast(tuple(often.column(c).to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = table.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pairs, times = (part.column(c).flatten().to_numpy() for c in ("pairs", "times"))
                cuts = part.column("pairs").offsets.to_numpy()
                cuts = cuts - cuts[0]
                if len(known):
                    found = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
                    hit = known[found] == pairs
                    sums = np.where(hit, n[found] * times, 0)
                    bests = np.where(hit & best[found], times, 0).astype(np.int64)
                else:
                    hit, sums, bests = np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
                upto = [np.concatenate([[0], np.cumsum(x)]) for x in (sums, bests, ~hit)]
                count_sum, n_best, rest = (x[cuts[1:]] - x[cuts[:-1]] for x in upto)
                left = np.concatenate([[0], np.cumsum(rest)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), _lists(pairs[~hit], left, pa.int64()), _lists(times[~hit], left, pa.int32())],
                    ["row", "n_best", "count_sum", "pairs", "times"],
                )

    kept = scratch.write(stored.select("row", "pairs", "times").mapInArrow(run, "row long, n_best long, count_sum long, pairs array<long>, times array<int>"), "frequent")
    rare = kept.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times"))
    rare = rare.join(counts.filter(F.col("n") < least), "pair")
    rare = rare.select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    return kept.select("row", "n_best", "count_sum").unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment(docs: DataFrame, vocabularies: Vocabularies | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row for each row of docs (doc_id, text).

    A reads a blank and the text, B the text, to which it adds the blank itself. A pair's count is the number of rows of docs
    that hold it linked; n_best counts a document's links whose pair has the highest count of its A id, ties included.
    Texts that are null, empty or not spelled by both tokenizers have zeros and ''. Null and repeated ids are rows like others,
    and each repeated row counts as a document; other columns are left out; an empty table gives an empty one. Very long texts
    are aligned whole, in pieces; memory follows the longest text.
    """
    vocabularies = vocabularies or Vocabularies.load()
    scratch = Scratch(docs.sparkSession)
    stored = scratch.write(align_documents(docs.select("doc_id", "text"), vocabularies), "aligned")
    counts = scratch.write(pair_counts(stored, Speller(vocabularies).b_bits), "counts")
    scores = link_scores(stored, counts, scratch)
    return stored.join(scores, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
