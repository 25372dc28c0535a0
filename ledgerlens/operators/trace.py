"""Traced subgraphs: where money came from or went to, paths with a fallback without directions, routes to shared receivers.

All walks are level by level over tables; a level's edges are kept, so the result is a subgraph and not only its nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cuts import Scratch
from . import graph

#: Hops of a trace, and receivers whose routes are told.
HOPS, RECEIVERS = 4, 8


def _turned(edges: DataFrame) -> DataFrame:
    other = {"src": "dst", "dst": "src"}
    return edges.select(*(F.col(other.get(c, c)).alias(c) for c in edges.columns))


def flow_trace(edges: DataFrame, gid: int, scratch: Scratch, direction: str = "out", hops: int = HOPS) -> DataFrame:
    """(src, dst, sum_kzt, n_tx, level, direction): the edges that money takes within `hops` steps from a node (out) or to it (in).

    level is the step at which an edge is walked: the hops of its nearer end, plus one. Each node is left once, at the level
    where it is first met, so each edge comes once; edges back to known nodes belong to the trace. both gives the two traces.
    """
    if direction == "both":
        return flow_trace(edges, gid, scratch, "out", hops).unionByName(flow_trace(edges, gid, scratch, "in", hops))
    if direction not in ("in", "out"):
        raise ValueError("direction is in, out or both")
    links = edges.select("src", "dst", "sum_kzt", "n_tx")
    links = links if direction == "out" else _turned(links)
    start = edges.sparkSession.range(1).select(F.lit(0).alias("key"), F.lit(gid).cast("long").alias("gid"))
    met = graph.reach(links.select("src", "dst"), start, scratch, hops - 1).select(F.col("gid").alias("src"), (F.col("hops") + 1).alias("level"))
    found = links.join(met, "src").select("src", "dst", "sum_kzt", "n_tx", "level")
    return (found if direction == "out" else _turned(found)).withColumn("direction", F.lit(direction))


def traced_path(edges: DataFrame, src: int, dst: int, scratch: Scratch) -> DataFrame:
    """(step, src, dst, forward, directed): the edges of a shortest path, in order.

    Where there is no path along the edges' directions, one that disregards them: directed is then false on all its rows, and
    forward tells which edges are walked from payer to payee (where both directions exist, yes). No row if there is neither.
    """
    spark = edges.sparkSession
    both = edges.select("src", "dst")
    found = graph.shortest_path(both, src, dst, scratch)
    directed = bool(found.take(1))
    if not directed:
        either = both.unionByName(_turned(both)).distinct()
        found = graph.shortest_path(either, src, dst, scratch)
    steps = found.select(F.posexplode(F.arrays_zip(F.expr("slice(nodes, 1, size(nodes) - 1)").alias("a"), F.expr("slice(nodes, 2, size(nodes) - 1)").alias("b"))).alias("k", "e")) if found.take(1) else spark.range(0).select(F.lit(0).alias("k"), F.struct(F.col("id").alias("a"), F.col("id").alias("b")).alias("e"))
    steps = steps.select((F.col("k") + 1).cast("int").alias("step"), F.col("e.a").alias("a"), F.col("e.b").alias("b"))
    own = both.distinct().withColumnsRenamed({"src": "a", "dst": "b"}).withColumn("forward", F.lit(True))
    out = steps.join(own, ["a", "b"], "left").withColumn("forward", F.coalesce("forward", F.lit(False)))
    ends = lambda x, y: F.when(F.col("forward"), F.col(x)).otherwise(F.col(y))
    return out.select("step", ends("a", "b").alias("src"), ends("b", "a").alias("dst"), "forward", F.lit(directed).alias("directed"))


def shared_receivers(edges: DataFrame, gids: list[int], scratch: Scratch, hops: int = HOPS, first: int | None = RECEIVERS) -> tuple[DataFrame, DataFrame]:
    """Receivers that money from two or more of the given nodes reaches within `hops`, and the routes to the first of them.

    The first table is (gid, n_linked, total_hops): those linked with most given nodes come first, then those with fewest hops
    in sum, then the smallest id. The second is (key, gid, step, src, dst): a shortest route from each given node `key` that
    reaches the receiver, by the smallest id at each step back. All routes go back together, a join a step.
    """
    spark = edges.sparkSession
    links = edges.select("src", "dst").distinct()
    given = spark.createDataFrame([(int(g),) for g in dict.fromkeys(gids)], "gid long")
    met = scratch.write(graph.reach(links, given.select(F.col("gid").alias("key"), "gid"), scratch, hops), "met")
    ends = met.filter("hops > 0").join(F.broadcast(given), "gid", "left_anti")  # given: a call's arguments
    receivers = ends.groupBy("gid").agg(F.count("*").alias("n_linked"), F.sum("hops").alias("total_hops")).filter("n_linked >= 2")
    receivers = scratch.write(receivers, "receivers")
    order = [F.desc("n_linked"), "total_hops", "gid"]
    chosen = receivers if first is None else receivers.orderBy(*order).limit(first)
    now = scratch.write(ends.join(chosen.select("gid"), "gid").select("key", "gid", F.col("gid").alias("at"), "hops"), "ends")
    routes = None
    for _ in range(hops):
        back = now.filter("hops > 0").join(links.withColumnRenamed("dst", "at"), "at")
        back = back.join(met.select("key", F.col("gid").alias("src"), (F.col("hops") + 1).alias("hops")), ["key", "src", "hops"])
        step = scratch.write(back.groupBy("key", "gid", "at", "hops").agg(F.min("src").alias("src")), "step")
        rows = step.select("key", "gid", F.col("hops").alias("step"), "src", F.col("at").alias("dst"))
        routes = rows if routes is None else routes.unionByName(rows)
        now = step.select("key", "gid", F.col("src").alias("at"), (F.col("hops") - 1).alias("hops"))
    return receivers.orderBy(*order) if first is None else chosen, routes
