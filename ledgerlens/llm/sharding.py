"""Sharding by a Feistel permutation of global row numbers (DataFrame functions only).

Rows get numbers 0..N-1 that depend on their content alone, a keyed permutation of 0..N-1 gives each a place in the
shuffled order, and shard and slot are place mod shards and place div shards: both are computable from the number, shard
sizes differ by one at most, and slots have no gap.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, let

SHARDS = 40
ROUNDS = 6
#: Equal rows are numbered in chunks of so many, so that no bucket and no task gets them all.
CHUNK = 4096
ROWS_IN_BUCKET = 20_000


def _step(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the Feistel network over Z_a x Z_b; a bijection of 0..a*b-1."""
    left, right = F.call_function("div", x, F.lit(b).cast("long")), F.pmod(x, F.lit(b).cast("long"))
    for k in range(ROUNDS):
        if k % 2:
            right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(seed), F.lit(k)), F.lit(b)), F.lit(b)).cast("long")
        else:
            left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(seed), F.lit(k)), F.lit(a)), F.lit(a)).cast("long")
    return left * F.lit(b).cast("long") + right


def permute(x: Column, n: int, seed: int) -> Column:
    """Place of x (0 <= x < n) in a keyed permutation of 0..n-1.

    The network works on a*b >= n values with a*b - n < a. A value outside is passed again (cycle walking) until it falls
    below n; as fewer than a values lie outside, a passes always do. About one row in sqrt(n) walks at all.
    """
    if n <= 1:
        return F.lit(0).cast("long")
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    return let(
        _step(x, a, b, seed),
        lambda y: F.when(y < n, y).otherwise(
            F.aggregate(F.sequence(F.lit(1), F.lit(a)), y, lambda acc, _: F.when(acc < n, acc).otherwise(_step(acc, a, b, seed)))
        ),
    )


def collapse(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Equal rows as one with `m` copies, m <= CHUNK: equal rows are counted map-side, then cut into chunks."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("m"))
    chunks = F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("m") - 1, F.lit(CHUNK)))
    return counted.withColumn("chunk", F.explode(chunks)).withColumn("m", F.least(F.lit(CHUNK).cast("long"), F.col("m") - F.col("chunk") * CHUNK))


def numbered(rows: DataFrame, keys: list[str], scratch: Scratch) -> tuple[DataFrame, int]:
    """Rows with a global number `row_no`, 0..N-1, and N.

    Rows are dealt to hash buckets of about 20,000; a bucket's first number is the sum of the buckets before it (a table
    of one row a bucket), and inside a bucket rows are ordered by content. No task sees more than a bucket. Equal rows are
    interchangeable, so the result does not depend on files, partitions or retries.
    """
    cut = scratch.write(collapse(rows, keys), "rows")
    distinct, n = cut.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0))).first()
    buckets = max(1, -(-distinct // ROWS_IN_BUCKET))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64(*keys, "chunk"), F.lit(buckets)))
    sums = cut.groupBy("bucket").agg(F.sum("m").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket").orderBy(*keys, "chunk").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("start", F.coalesce(F.sum("m").over(inside), F.lit(0))).join(offsets, "bucket")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))
    out = placed.withColumn("copy", copies).withColumn("row_no", F.col("offset") + F.col("start") + F.col("copy"))
    return out.select(*keys, "row_no"), n


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """(doc_id, size, text_crc32, row_no, shard, slot) of every row of docs (doc_id, text).

    Null ids and repeated rows are rows like others; null text has size 16 and the crc32 of an empty text (0). Texts are read once and
    reduced to digests before the first shuffle.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.xxhash64("text").alias("__h"),
    )
    placed, n = numbered(rows, ["doc_id", "size", "text_crc32", "__h"], scratch)
    at = placed.withColumn("place", permute(F.col("row_no"), n, seed))
    return at.select(
        "doc_id", "size", "text_crc32", "row_no", "place",
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.call_function("div", F.col("place"), F.lit(shards)).alias("slot"),
    )


def sharding_digest(docs: DataFrame) -> DataFrame:
    out = shard(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no", "place")
