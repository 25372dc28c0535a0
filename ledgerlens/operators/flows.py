"""Degrees, volumes, seed links and simple ratios of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scalars import ratio, rnd
from ..sources.network import Network


def node_flows(net: Network, cfg: Config) -> DataFrame:
    """One row a node: partners, money (to the cent) and transfers in and out, averages, ratio and what outflow lacks."""
    side = lambda key, p: net.edges.groupBy(F.col(key).alias("gid")).agg(
        F.count("*").alias(f"{p}_deg"), rnd(F.sum("sum_kzt"), 2).alias(f"{p}_kzt"), F.sum("n_tx").alias(f"{p}_tx"))
    df = net.nodes.join(side("dst", "in"), "gid", "left").join(side("src", "out"), "gid", "left")
    df = df.na.fill(0, ["in_deg", "in_kzt", "in_tx", "out_deg", "out_kzt", "out_tx"])
    avg = lambda p: F.when(F.col(f"{p}_tx") > 0, F.col(f"{p}_kzt") / F.col(f"{p}_tx")).otherwise(0.0)
    observed = F.col("depth") <= cfg.max_observed_out_depth
    return df.withColumns({
        "pass_through": ratio(F.col("out_kzt"), F.col("in_kzt")),
        "avg_in": avg("in"), "avg_out": avg("out"),
        "unseen_inflow_kzt": F.greatest(F.lit(0.0), F.col("out_kzt") - F.col("in_kzt")),
        "observed_out": observed, "truncated": ~observed,
    })


def seed_links(net: Network) -> DataFrame:
    """(gid, seed_in, seed_out): payers and payees that are seeds; nodes without such a link are absent."""
    seeds = net.nodes.filter("is_seed").select("gid")
    paid = net.edges.join(seeds, net.edges["src"] == seeds["gid"], "left_semi").groupBy(F.col("dst").alias("gid")).agg(F.count("*").alias("seed_in"))
    pays = net.edges.join(seeds, net.edges["dst"] == seeds["gid"], "left_semi").groupBy(F.col("src").alias("gid")).agg(F.count("*").alias("seed_out"))
    return paid.join(pays, "gid", "full_outer").na.fill(0, ["seed_in", "seed_out"])


def pair_weights(edges: DataFrame) -> DataFrame:
    """(a, b, weight) with a < b: money of both directions; self-payments are left out."""
    return edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("sum_kzt").alias("weight"))


def totals(net: Network) -> DataFrame:
    """One row: sizes, turnover and period."""
    n = net.nodes.agg(F.count("*").alias("n_nodes"), F.count_if("is_seed").alias("n_seed"))
    e = net.edges.agg(F.count("*").alias("n_edges"), rnd(F.sum("sum_kzt"), 2).alias("total_kzt"))
    t = net.transactions.agg(F.count("*").alias("n_tx"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return n.crossJoin(e).crossJoin(t)  # one row each
