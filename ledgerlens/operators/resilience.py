"""What is left of a network when nodes are taken out: the first ones by priority against random ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cuts import Scratch
from ..functions.scalars import rnd
from .graph import components, reach


def measure(nodes: DataFrame, edges: DataFrame, removed: DataFrame, scenarios: DataFrame, scratch: Scratch) -> DataFrame:
    """(scenario, giant, volume, n_components) of all scenarios in one go; removed: (scenario, gid).

    Each scenario is a copy of the graph; for sets that contain each other see `nested`.
    """
    every = nodes.select("gid", "is_seed").crossJoin(F.broadcast(scenarios))  # scenarios: a few dozen rows
    left = scratch.write(every.join(removed, ["scenario", "gid"], "left_anti"), "left")
    out = edges.crossJoin(F.broadcast(scenarios))
    gone = removed.withColumnRenamed("gid", "src")
    out = out.join(gone, ["scenario", "src"], "left_anti").join(removed.withColumnRenamed("gid", "dst"), ["scenario", "dst"], "left_anti")
    out = scratch.write(out.select(F.col("scenario").alias("key"), "src", "dst", "sum_kzt"), "kept")
    key = lambda c: F.struct(F.col("key"), F.col(c).alias("gid"))
    found = components(left.select(F.struct(F.col("scenario").alias("key"), "gid").alias("node")), out.select(key("src").alias("u"), key("dst").alias("v")), scratch)
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).groupBy(F.col("component.key").alias("scenario")).agg(F.max("n").alias("giant"), F.count("*").alias("n_components"))
    reached = reach(out.select("key", "src", "dst"), left.filter("is_seed").select(F.col("scenario").alias("key"), "gid"), scratch)
    volume = out.join(reached.select("key", F.col("gid").alias("src")), ["key", "src"], "left_semi").groupBy(F.col("key").alias("scenario")).agg(F.sum("sum_kzt").alias("volume"))
    return sizes.join(volume, "scenario", "left").na.fill(0.0, ["volume"])


class _Nested:
    """The graph that stays in all removals (the core), what it looks like from outside, and the nodes that are taken out."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, order: DataFrame, ns: list[int], scratch: Scratch):
        self.scratch, self.levels = scratch, sorted({*ns, 0}, reverse=True)
        joins = F.lit(self.levels[0])
        for n, above in zip(self.levels[1:], self.levels[:-1], strict=True):
            joins = F.when(F.col("at") <= above, n).otherwise(joins)
        order = order.filter(F.col("at") <= self.levels[0])
        self.order = scratch.step(order.select("chain", "gid", joins.alias("joins")), "order")
        self.taken = scratch.step(self.order.select("gid").distinct().join(nodes.select("gid", "is_seed"), "gid"), "taken")
        self.chains = scratch.step(self.order.select("chain").distinct(), "chains")
        side = lambda end: F.broadcast(self.taken.select(F.col("gid").alias(end), F.lit(True).alias(f"{end}_taken")))
        tagged = edges.select("src", "dst", "sum_kzt").join(side("src"), "src", "left").join(side("dst"), "dst", "left").na.fill(False, ["src_taken", "dst_taken"])
        self.edges = scratch.write(tagged, "tagged")
        self.core = nodes.select("gid", "is_seed").join(F.broadcast(self.taken.select("gid")), "gid", "left_anti")
        self.inner = self.edges.filter("NOT src_taken AND NOT dst_taken")
        self.outer = self.edges.filter("src_taken OR dst_taken")

    def joined(self, df: DataFrame, end: str) -> DataFrame:
        """df (chain, ...) with `<end>_joins`, null for a node that the chain never takes out."""
        own = self.order.select("chain", F.col("gid").alias(end), F.col("joins").alias(f"{end}_joins"))
        return df.join(F.broadcast(own), ["chain", end], "left")

    def taken_by_chain(self) -> DataFrame:
        """(chain, gid, is_seed, joins) of every node that some chain takes out, in every chain."""
        every = self.taken.crossJoin(F.broadcast(self.chains)).withColumnRenamed("gid", "node")
        return self.joined(every, "node").select("chain", F.col("node").alias("gid"), "is_seed", F.coalesce("node_joins", F.lit(self.levels[0])).alias("joins"))

    def parts(self) -> DataFrame:
        """(chain, n, giant, n_components): labels go on from the smallest graph to the next larger one."""
        scratch, top = self.scratch, self.levels[0]
        label = scratch.write(components(self.core.select(F.col("gid").alias("node")), self.inner.select(F.col("src").alias("u"), F.col("dst").alias("v")), scratch), "core")
        sizes = scratch.write(label.groupBy("component").agg(F.count("*").alias("size")), "sizes")
        named = lambda end: label.select(F.col("node").alias(end), F.col("component").alias(f"{end}_label"))
        links = self.outer.join(named("src"), "src", "left").join(named("dst"), "dst", "left")
        links = links.select(F.coalesce("src_label", "src").alias("a"), F.coalesce("dst_label", "dst").alias("b"))
        links = scratch.step(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u <> v").distinct(), "contracted")
        touched = sizes.join(links.select(F.explode(F.array("u", "v")).alias("component")).distinct(), "component", "left_semi")
        still = sizes.join(touched.select("component"), "component", "left_anti").agg(F.coalesce(F.max("size"), F.lit(0)).alias("most"), F.count("*").alias("others"))
        own = self.joined(self.joined(links.crossJoin(F.broadcast(self.chains)), "u"), "v")
        own = own.select("chain", "u", "v", F.least(F.coalesce("u_joins", F.lit(top)), F.coalesce("v_joins", F.lit(top))).alias("joins"))
        later = scratch.step(own, "links")
        taken = scratch.step(self.taken_by_chain().select("chain", "gid", "joins"), "taken")
        groups = scratch.step(touched.crossJoin(F.broadcast(self.chains)).select("chain", F.col("component").alias("gid"), "size"), "groups")
        key = lambda c: F.struct("chain", F.col(c).alias("gid"))
        rows = None
        for n in self.levels:
            there = groups.unionByName(taken.filter(F.col("joins") == n).select("chain", "gid", F.lit(1).cast("long").alias("size")))
            now = later.filter(F.col("joins") == n)
            found = components(there.select(key("gid").alias("node")), now.select(key("u").alias("u"), key("v").alias("v")), scratch)
            name = scratch.step(found.select("node.chain", F.col("node.gid").alias("gid"), F.col("component.gid").alias("to")), "names")
            groups = scratch.step(there.join(name, ["chain", "gid"]).groupBy("chain", F.col("to").alias("gid")).agg(F.sum("size").alias("size")), "groups")
            for end in ("u", "v"):
                later = later.join(name.select("chain", F.col("gid").alias(end), F.col("to").alias(f"{end}_to")), ["chain", end], "left").withColumn(end, F.coalesce(f"{end}_to", end)).drop(f"{end}_to")
            later = scratch.step(later.filter((F.col("joins") < n) & (F.col("u") != F.col("v"))).select("chain", "u", "v", "joins").distinct(), "links")
            row = self.chains.join(groups.groupBy("chain").agg(F.max("size").alias("most_here"), F.count("*").alias("n_here")), "chain", "left").crossJoin(still)
            row = row.select("chain", F.lit(n).alias("n"), F.greatest(F.coalesce("most_here", F.lit(0)), "most").alias("giant"), (F.coalesce("n_here", F.lit(0)) + F.col("others")).alias("n_components"))
            rows = row if rows is None else rows.unionByName(row)
        return rows

    def volumes(self) -> DataFrame:
        """(chain, n, volume): the core is walked once, each chain only walks what its own nodes add to that."""
        scratch, top = self.scratch, self.levels[0]
        base = scratch.write(reach(self.inner.select("src", "dst"), self.core.filter("is_seed").select(F.lit(0).alias("key"), "gid"), scratch).select("gid"), "base")
        from_base = self.edges.filter("NOT src_taken").join(base.withColumnRenamed("gid", "src"), "src", "left_semi")
        fixed = from_base.filter("NOT dst_taken").agg(F.coalesce(F.sum("sum_kzt"), F.lit(0.0)).alias("fixed"))
        fed = scratch.step(from_base.filter("dst_taken").groupBy(F.col("dst").alias("gid")).agg(F.sum("sum_kzt").alias("fed")), "fed")
        taken = scratch.step(self.taken_by_chain().join(F.broadcast(fed), "gid", "left"), "started")
        more = None  # (chain, gid, joins): reached by the chain only
        for n in self.levels:
            fresh = taken.filter(F.col("joins") == n)
            start = fresh.filter("is_seed OR fed IS NOT NULL").select("chain", "gid")
            if more is not None:
                paid = more.join(self.outer.filter("dst_taken"), more["gid"] == F.col("src")).select("chain", F.col("dst").alias("gid"))
                start = start.unionByName(fresh.select("chain", "gid").join(paid, ["chain", "gid"], "left_semi")).distinct()
            front = scratch.step(start.withColumn("joins", F.lit(n)), "front")
            while front.take(1):
                more = front if more is None else scratch.step(more.unionByName(front), "reached")
                ahead = front.select("chain", F.col("gid").alias("src")).join(self.edges.select("src", "dst"), "src").select("chain", "dst").distinct()
                ahead = self.joined(ahead, "dst").filter(F.coalesce("dst_joins", F.lit(top)) >= n).select("chain", F.col("dst").alias("gid"))
                ahead = ahead.join(base, "gid", "left_anti").join(more.select("chain", "gid"), ["chain", "gid"], "left_anti")
                front = scratch.step(ahead.withColumn("joins", F.lit(n)), "front")
        sums = taken.filter("fed IS NOT NULL").select("chain", "joins", F.col("fed").alias("sum_kzt"))
        if more is not None:
            spent = self.joined(more.select("chain", F.col("gid").alias("src"), "joins").join(self.edges.select("src", "dst", "sum_kzt"), "src"), "dst")
            sums = sums.unionByName(spent.select("chain", F.least("joins", F.coalesce("dst_joins", F.lit(top))).alias("joins"), "sum_kzt"))
        sums = sums.groupBy("chain", "joins").agg(F.sum("sum_kzt").alias("s"))
        ns = self.chains.select("chain", F.explode(F.array(*map(F.lit, self.levels))).alias("n"))
        upto = ns.join(sums, (ns["chain"] == sums["chain"]) & (F.col("joins") >= F.col("n")), "left").groupBy(ns["chain"], "n").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))
        return upto.crossJoin(fixed).select("chain", "n", (F.col("s") + F.col("fixed")).alias("volume"))


def nested(nodes: DataFrame, edges: DataFrame, order: DataFrame, ns: list[int], scratch: Scratch) -> DataFrame:
    """(chain, n, giant, n_components, volume) with the first n nodes of each chain's order removed, for each n and for 0.

    order: (chain, gid, at), places from 1 on without repetition; chains times the largest n bounds what is broadcast. The graph
    without any of these nodes is labelled and walked once for all chains. A chain then puts its nodes back, from the largest n
    down: labels and reached nodes go on from one n to the next, and a link is looked at only once it joins. So a chain costs the
    links at the removed nodes, contracted to the labels at their ends, instead of copies of the graph. giant and n_components are
    0 where no node is left; nodes of the order that the network lacks take a place and change nothing.
    """
    run = _Nested(nodes, edges, order, ns, scratch)
    return run.parts().join(run.volumes(), ["chain", "n"])


def drawn(ranked: DataFrame, most: int, draws: int, seed: int) -> DataFrame:
    """(chain, gid, at): chain 0 in order of rank, chains 1 to `draws` non-seeds by a hash, up to `most` nodes each.

    All draws are ranked in one pass; each partition first keeps the `most` best of a draw.
    """
    salts = np.random.default_rng(seed).integers(0, 2**62, size=draws)
    top = ranked.filter(F.col("rank") <= most).select(F.lit(0).alias("chain"), "gid", F.col("rank").cast("int").alias("at"))
    if not draws:
        return top
    keys = F.explode(F.array(*(F.struct(F.lit(i + 1).alias("chain"), F.xxhash64("gid", F.lit(int(s))).alias("h")) for i, s in enumerate(salts))))
    keyed = ranked.filter(~F.col("is_seed")).select("gid", keys.alias("k")).select("gid", "k.*")
    nth = F.row_number().over(Window.partitionBy("chain").orderBy("h", "gid"))
    return top.unionByName(keyed.withColumn("at", nth).filter(F.col("at") <= most).select("chain", "gid", "at"))


def resilience(ranked: DataFrame, edges: DataFrame, scratch: Scratch, ns: tuple = (5, 10, 20, 50), draws: int = 20, seed: int = 42) -> DataFrame:
    """One row for each number removed: shares of the giant component and of seed-reachable turnover, and components.

    ranked: (gid, is_seed, rank). A random draw takes the nodes with the smallest hashes of gid and draw among the non-seeds; its
    larger removals contain the smaller ones.
    """
    found = scratch.step(nested(ranked, edges, drawn(ranked, max(ns), draws, seed), list(ns), scratch), "resilience")
    base = found.filter("chain = 0 AND n = 0").select(F.col("giant").alias("g0"), F.col("volume").alias("v0"))
    rows = found.filter("n > 0").crossJoin(F.broadcast(base))
    giant, vol = F.col("giant") / F.col("g0"), F.try_divide(F.col("volume"), F.col("v0"))
    avg = lambda x, top: F.avg(F.when((F.col("chain") == 0) if top else (F.col("chain") > 0), x))
    return rows.groupBy(F.col("n").alias("removed_n")).agg(
        rnd(avg(giant, True), 3).alias("giant_share_top"), rnd(avg(giant, False), 3).alias("giant_share_random"),
        rnd(avg(vol, True), 3).alias("seed_reach_volume_top"), rnd(avg(vol, False), 3).alias("seed_reach_volume_random"),
        avg(F.col("n_components"), True).cast("long").alias("n_components_top"), rnd(avg(F.col("n_components"), False), 1).alias("n_components_random"),
    )
