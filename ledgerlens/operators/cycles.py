"""Strong components, and the short cycles that lie inside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cuts import Scratch, dealt, fingerprint

#: Hops that one job makes before it looks whether anything has changed.
HOPS = 5


def _settled(table: DataFrame, hop: Callable[[DataFrame], DataFrame], scratch: Scratch, name: str, hops: int = HOPS) -> DataFrame:
    """`hop` applied to a stored table until its rows stay the same, `hops` times a job; the tables in between are dropped."""
    before = fingerprint(table, *table.columns)
    while True:
        grown = table
        for _ in range(hops):
            grown = hop(grown)
        grown = scratch.step(grown, name)
        scratch.drop(table)
        table, now = grown, fingerprint(grown, *grown.columns)
        if now == before:
            return table
        before = now


def _trimmed(links: DataFrame) -> DataFrame:
    """Links whose payer is paid and whose payee pays; the others are on no cycle."""
    paid, pays = links.select(F.col("dst").alias("src")).distinct(), links.select(F.col("src").alias("dst")).distinct()
    return links.join(dealt(paid), "src", "left_semi").join(dealt(pays), "dst", "left_semi").select("src", "dst")


def strong_components(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(gid, component) of every node; component is the smallest node of those that it reaches and that reach it.

    Links are trimmed until each begins and ends inside the rest. Then every node takes the largest node that reaches it as its
    colour; what reaches that node inside the colour is its strong component. Components found leave, and the rest, cut to links
    within a colour, goes round again. Maxima are partial aggregates, so a hub is no hot task; the number of hops follows the
    longest shortest way. Nodes are numbers without nulls; edges may repeat; no edges give each node its own component.
    """
    links = scratch.step(edges.select("src", "dst").filter("src <> dst").distinct(), "strong")
    found = None
    while True:
        links = _settled(links, _trimmed, scratch, "trimmed", 1)
        if not links.take(1):
            break
        ends = links.select(F.col("src").alias("v")).distinct()  # each pays and is paid, as links are trimmed
        loops = ends.select(F.col("v").alias("src"), F.col("v").alias("dst"))  # by which a node keeps what it has
        ways = scratch.step(links.unionByName(loops), "ways")

        def spread(state: DataFrame, ways: DataFrame = ways) -> DataFrame:
            return ways.join(dealt(state), F.col("src") == F.col("v")).groupBy(F.col("dst").alias("v")).agg(F.max("c").alias("c"))

        colours = _settled(scratch.step(ends.select("v", F.col("v").alias("c")), "colours"), spread, scratch, "colours")
        inner = ways.join(dealt(colours.select(F.col("v").alias("src"), "c")), "src").join(dealt(colours.select(F.col("v").alias("dst"), F.col("c").alias("other"))), "dst")
        inner = scratch.step(inner.filter("c = other").select("src", "dst", "c"), "inside")

        def back(state: DataFrame, inner: DataFrame = inner) -> DataFrame:
            return inner.join(dealt(state.select(F.col("v").alias("dst"), "c")), ["dst", "c"]).select(F.col("src").alias("v"), "c").distinct()

        members = _settled(scratch.step(colours.filter("v = c"), "members"), back, scratch, "members")
        found = members if found is None else found.unionByName(members)
        gone = members.select("v")
        rest = inner.filter("src <> dst").join(dealt(gone.withColumnRenamed("v", "src")), "src", "left_anti").join(dealt(gone.withColumnRenamed("v", "dst")), "dst", "left_anti")
        before, links = links, scratch.step(rest.select("src", "dst"), "strong")
        for table in (before, ways, colours, inner):
            scratch.drop(table)
    if found is None:
        return nodes.select("gid", F.col("gid").alias("component"))
    least = found.groupBy("c").agg(F.min("v").alias("component"))
    named = found.join(dealt(least), "c").select(F.col("v").alias("gid"), "component")
    return nodes.select("gid").join(dealt(named), "gid", "left").select("gid", F.coalesce("component", "gid").alias("component"))


def _inside(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(src, dst, sum_kzt) of the edges within a strong component; the ends are structs (-links, gid), which put hubs first."""
    proper = edges.select("src", "dst", "sum_kzt").filter("src <> dst")
    ends = proper.select(F.explode(F.array("src", "dst")).alias("gid")).distinct()
    part = scratch.step(strong_components(ends, proper, scratch), "parts")
    kept = proper.join(dealt(part.select(F.col("gid").alias("src"), "component")), "src").join(dealt(part.select(F.col("gid").alias("dst"), F.col("component").alias("other"))), "dst").filter("component = other")
    kept = scratch.step(kept.select("src", "dst", "sum_kzt"), "inside")
    links = kept.select(F.explode(F.array("src", "dst")).alias("gid")).groupBy("gid").agg((-F.count("*")).alias("d"))
    node = lambda end: links.select(F.col("gid").alias(end), F.struct("d", "gid").alias(f"{end}_node"))
    return scratch.step(kept.join(dealt(node("src")), "src").join(dealt(node("dst")), "dst").select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"), "sum_kzt"), "ordered")


def cycles(edges: DataFrame, scratch: Scratch, longest: int = 5, grown: list | None = None) -> DataFrame:
    """(path, length, min_edge_kzt, total_kzt): simple directed cycles of up to `longest` edges, starting at their smallest node.

    Only edges within a strong component are walked. A cycle is found at its node with the most links, from which half of it grows
    forward and half backward through nodes with fewer, so hubs are walked through from greater hubs only; the halves meet by an
    equi-join on both ends. So the longest prefix is half a cycle, not all of it but one edge. Parallel edges have to be summed
    before; edges from a node to itself are cycles of one edge. `grown` gets the number of half paths of each length.
    """
    e = edges.select("src", "dst", "sum_kzt")
    found = e.filter(F.col("src") == F.col("dst")).select(F.array("src").alias("path"), F.array("sum_kzt").alias("sums"))
    inner = _inside(e, scratch)
    step = inner.withColumnsRenamed({"src": "s", "dst": "d", "sum_kzt": "m"})
    ahead = {1: inner.filter("dst > src").select("src", F.col("dst").alias("end"), F.array("dst").alias("nodes"), F.array("sum_kzt").alias("sums"))}
    behind = {1: inner.filter("src > dst").select(F.col("dst").alias("src"), F.col("src").alias("end"), F.array("src").alias("nodes"), F.array("sum_kzt").alias("sums"))}
    for k in range(2, longest + 1):
        half, rest = k - k // 2, k // 2
        if half not in ahead:
            more = ahead[half - 1].join(dealt(step), (F.col("end") == F.col("s")) & (F.col("d") > F.col("src"))).filter(~F.array_contains("nodes", F.col("d")))
            ahead[half] = scratch.write(more.select("src", F.col("d").alias("end"), F.array_append("nodes", F.col("d")).alias("nodes"), F.array_append("sums", F.col("m")).alias("sums")), f"ahead{half}")
        if rest not in behind:
            more = behind[rest - 1].join(dealt(step), (F.col("end") == F.col("d")) & (F.col("s") > F.col("src"))).filter(~F.array_contains("nodes", F.col("s")))
            behind[rest] = scratch.write(more.select("src", F.col("s").alias("end"), F.array_prepend("nodes", F.col("s")).alias("nodes"), F.array_prepend("sums", F.col("m")).alias("sums")), f"behind{rest}")
        other = behind[rest].select("src", "end", F.slice("nodes", 2, max(rest - 1, 0)).alias("way"), F.col("sums").alias("back"))
        both = ahead[half].join(dealt(other), ["src", "end"]).filter(~F.arrays_overlap("nodes", "way"))
        ids = F.transform(F.concat(F.array("src"), "nodes", "way"), lambda x: x["gid"])
        found = found.unionByName(both.select(ids.alias("path"), F.concat("sums", "back").alias("sums")))
    if grown is not None:
        grown += [x.count() for half in (ahead, behind) for k, x in half.items() if k > 1]
    first = F.array_position("path", F.array_min("path")).cast("int")
    turned = lambda c: F.concat(F.slice(c, first, F.size(c)), F.slice(c, 1, first - 1)).alias(c)
    found = found.select(turned("path"), turned("sums"))
    total = F.aggregate("sums", F.lit(0.0), lambda a, x: a + x)
    return found.select("path", F.size("path").alias("length"), F.array_min("sums").alias("min_edge_kzt"), total.alias("total_kzt"))
