"""Text rules, hashes and graph components used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cuts import Scratch, fingerprint, importable

__all__ = ["LOWER", "UPPER", "WORD", "WS_CHARS", "Scratch", "components", "fingerprint", "hash60", "importable", "let", "lower_ascii", "set_aside"]

#: The white space of the word rule, as characters and as regular expressions.
WS_CHARS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row."""
    return F.transform(F.array(value), body)[0]


def set_aside(docs: DataFrame, *used: str):
    """docs as its columns `used` and one struct of all others, and a function that puts columns back in the order of docs.

    Helper columns of an operator can't clash with columns inside the struct. The function takes a result and further
    columns for its end.
    """
    rest = [c for c in docs.columns if c not in used]
    of = lambda c: "`" + c.replace("`", "``") + "`"
    packed = docs.select(*(of(c) for c in docs.columns if c in used), *([F.struct(*map(of, rest)).alias("_aside")] if rest else []))

    def back(out: DataFrame, *more: Column) -> DataFrame:
        return out.select(*(F.col(of(c)) if c in used else F.col("_aside").getField(c).alias(c) for c in docs.columns), *more)

    return packed, back


def lower_ascii(c: Column) -> Column:
    """c with A-Z lower-cased; lower() does the same, and much faster, where there is nothing else to lower."""
    return let(c, lambda x: F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER)))


def hash60(*cols: Column) -> Column:
    """60 bits of an md5 over the columns, null written as \\N: the same value in any SQL engine."""
    text = F.concat_ws("/", *(F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of an undirected graph given as (u, v): component is the smallest node reachable.

    Alternates large-star and small-star steps until the edges stop changing, which takes about log2 of the longest
    path. All minima are partial aggregates and all joins are equi-joins that adaptive execution can split, so a hub or
    a component with a third of all nodes is spread over tasks. Self-loops and repeated edges are fine; an empty table
    gives an empty result.
    """
    first = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    state = scratch.write(first.filter("u <> v").distinct(), "edges")
    before = None
    while (now := fingerprint(state, "u", "v")) != before:
        before = now
        both = state.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(state.select(F.col("v").alias("a"), F.col("u").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.write(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        new = scratch.write(small.select("e.*").filter("u <> v").distinct(), "edges")
        for old in (state, large):
            scratch.drop(old)
        state = new
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
