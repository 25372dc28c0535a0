"""Exact deduplication by content-defined chunk recipes.

A text without its white space is cut into chunks where its content says so, so equal passages give equal chunks wherever
they stand. Every distinct chunk gets an identifier, which is verified against all chunks of the corpus; a document is then
the ordered list of its chunks' identifiers, its recipe. Texts are equal when their recipes are. Texts move through one
shuffle at most, as chunks, after each task has dropped its repeated ones; documents are compared and joined by recipes of 16
bytes a chunk.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, Scratch, set_aside

#: Code points of a chunk: no end is looked for before the first number, and the second is the longest chunk.
SHORTEST, LONGEST = 512, 4096
#: A chunk ends behind a mark that stands before a letter of this class: every few sentences of prose.
ENDS, STARTS = "[.!?,;:。！？、]", "[AEIOUaeiou。！？、]"
CHUNK = rf"(?s).{{{SHORTEST - 1},{LONGEST - 1}}}?{ENDS}(?={STARTS})|.{{1,{LONGEST}}}"
#: Seeds tried before giving up; two different chunks share 128 bits about once in 10^16 corpora of 10^11 chunks.
SEEDS = 8


def normalised(text: Column) -> Column:
    """text without the characters [\\x20\\x09-\\x0D]; null counts as empty."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), WS_CHARS, F.coalesce(text, F.lit("")))


def chunks(norm: Column) -> Column:
    """The chunks of a normalised text in order; joined they are the text. An empty text has none."""
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def identifier(chunk: Column, seed: int) -> Column:
    """128 bits of a chunk under a seed."""
    return F.struct(F.xxhash64(F.lit(2 * seed), chunk).alias("a"), F.xxhash64(F.lit(2 * seed + 1), chunk).alias("b"))


def verified_seed(docs: DataFrame, identify: Callable[[Column, int], Column] = identifier) -> int:
    """The first seed under which no two different chunks of docs share an identifier.

    All distinct chunks are compared as texts: grouped by identifier and chunk, there must be as many as there are
    identifiers. Raises ValueError if SEEDS seeds all fail.
    """
    pieces = docs.select(F.explode(F.array_distinct(chunks(normalised(F.col("text"))))).alias("chunk"))
    for seed in range(SEEDS):
        told_apart = pieces.select(identify(F.col("chunk"), seed).alias("id"), "chunk").distinct()
        if not told_apart.groupBy("id").count().filter("count > 1").count():
            return seed
    raise ValueError("two chunks share an identifier under every seed")


def recipes(docs: DataFrame, seed: int, identify: Callable[[Column, int], Column] = identifier) -> DataFrame:
    """docs (doc_id, text) as (row, doc_id, n_chars, text_sha256, recipe), to be written: `row` numbers rows once they are stored."""
    with_text = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), normalised(F.col("text")).alias("norm"))
    return with_text.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "n_chars",
        F.sha2("norm", 256).alias("text_sha256"),
        F.transform(chunks(F.col("norm")), lambda c: identify(c, seed)).alias("recipe"),
    )


def groups(docs: DataFrame, scratch: Scratch | None = None, identify: Callable[[Column, int], Column] = identifier) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row for each row of docs (doc_id, text).

    Texts are equal when identical without [\\x20\\x09-\\x0D]; null counts as empty, and all empty texts are one group. In
    each group the row with the most code points in its original text stays, of those the one with the smallest doc_id, a
    null id coming last; of repeated rows (one id and one text) exactly one has kept = true. keep_id is the id of the row
    that stays, so it may be null. Other columns of docs are left out (`drop_copies` keeps them); an empty table gives an
    empty one. Texts of any length are cut whole; memory follows the longest text.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    listed = scratch.write(recipes(docs, verified_seed(docs, identify), identify), "recipes")
    first = F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("n"), "doc_id", "row")).alias("first")
    same = listed.groupBy("recipe").agg(F.count("*").alias("group_size"), first).filter("group_size > 1")
    # Written, as adaptive execution splits a hot key of a join of two tables, but not of a table with its own sums.
    stays = scratch.write(same.select("recipe", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row")), "stays")
    out = listed.join(stays, "recipe", "left")
    alone = F.col("keep_row").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, columns of any name unchanged; which one stays is said in `groups`.

    Each row gets a number and is written once, so that the rows that stay are found by number.
    """
    scratch = Scratch(docs.sparkSession)
    packed, back = set_aside(docs, "doc_id", "text")
    stored = scratch.write(packed.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    told = groups(stored.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("doc_id"), "text"), scratch)
    return back(stored.join(told.filter("kept").select(F.col("doc_id._row").alias("_row")), "_row", "left_semi"))


def exact_digest(docs: DataFrame) -> DataFrame:
    """What the registered query returns."""
    return groups(docs)
