"""Sources: the three tables of a transfer network, their checks, and a network derived from an event table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cuts import Scratch

_long, _double = T.LongType(), T.DoubleType()
NODES = T.StructType([T.StructField("gid", _long), T.StructField("depth", T.IntegerType()), T.StructField("is_seed", T.BooleanType())])
EDGES = T.StructType([T.StructField("src", _long), T.StructField("dst", _long), T.StructField("sum_kzt", _double), T.StructField("n_tx", _long), T.StructField("depth", T.ByteType())])
TRANSACTIONS = T.StructType([T.StructField("src", _long), T.StructField("dst", _long), T.StructField("date", T.DateType()), T.StructField("sum_kzt", _double)])


@dataclass(frozen=True)
class Network:
    nodes: DataFrame
    edges: DataFrame
    transactions: DataFrame


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*(F.to_date(f.name).alias(f.name) if f.dataType == T.DateType() else F.col(f.name).cast(f.dataType) for f in schema))


def load(spark: SparkSession, path: str) -> Network:
    """Reads nodes, edges and transactions; ids become bigint, timestamps dates."""
    read = lambda name, schema: _typed(spark.read.parquet(f"{path}/{name}.parquet"), schema)
    return Network(read("nodes", NODES), read("edges", EDGES), read("transactions", TRANSACTIONS))


def edges_of(transactions: DataFrame) -> DataFrame:
    """One row for each ordered pair: total and number of transfers."""
    return transactions.groupBy("src", "dst").agg(F.sum("sum_kzt").alias("sum_kzt"), F.count("*").alias("n_tx"))


def check(net: Network) -> DataFrame:
    """(rule, n_violations): edges against transactions, unique keys, ids that exist, nodes without edges."""
    again = edges_of(net.transactions).withColumnsRenamed({"sum_kzt": "s", "n_tx": "k"})
    both = net.edges.select("src", "dst", "sum_kzt", "n_tx").join(again, ["src", "dst"], "full_outer")
    ends = net.edges.select(F.col("src").alias("gid")).union(net.edges.select(F.col("dst").alias("gid"))).distinct()
    count = lambda rule, df: df.agg(F.count("*").alias("n_violations")).select(F.lit(rule).alias("rule"), "n_violations")
    rules = {
        "pair_only_on_one_side": both.filter(F.col("n_tx").isNull() | F.col("k").isNull()),
        "sum_differs": both.filter(F.abs(F.col("sum_kzt") - F.col("s")) > 0.01),
        "count_differs": both.filter(F.col("n_tx") != F.col("k")),
        "gid_repeated": net.nodes.groupBy("gid").count().filter("count > 1"),
        "edge_end_unknown": ends.join(net.nodes, "gid", "left_anti"),
        "node_without_edge": net.nodes.join(ends, "gid", "left_anti"),
    }
    out = None
    for rule, df in rules.items():
        one = count(rule, df)
        out = one if out is None else out.unionByName(one)
    return out


def depths(edges: DataFrame, seeds: DataFrame, hops: int, scratch: Scratch) -> DataFrame:
    """(gid, depth): fewest hops from a seed, up to `hops`. Each hop joins the frontier only and drops what is known."""
    seen = scratch.write(seeds.select("gid").distinct().withColumn("depth", F.lit(0)), "depth0")
    frontier = seen
    for hop in range(1, hops + 1):
        reached = frontier.join(edges, frontier["gid"] == edges["src"]).select(F.col("dst").alias("gid")).distinct()
        frontier = scratch.write(reached.join(seen, "gid", "left_anti").withColumn("depth", F.lit(hop)), f"depth{hop}")
        seen = seen.unionByName(frontier)
    return seen


def from_events(events: DataFrame, hops: int = 4) -> Network:
    """A network from (event_id, ts, user_id, value, props): hubs, communities of ten and long links, by integer rules.

    Outgoing transfers of the last hop are hidden, as in a crawl.
    """
    scratch = Scratch(events.sparkSession)
    sizes = events.agg((F.max("user_id") + 1).alias("n")).selectExpr("n", "greatest(1, n div 30) AS h")
    k = F.get_json_object("props", "$.k").cast("bigint").alias("k")
    rows = events.filter("value >= 120").select("event_id", "ts", "user_id", "value", k).crossJoin(F.broadcast(sizes))
    raw = rows.selectExpr(
        "CASE WHEN event_id % 5 = 0 THEN (user_id % h) * 30 + 7 ELSE user_id END AS src",
        """CASE WHEN k < 55 THEN (user_id div 10) * 10 + (user_id + 1 + k % 3) % 10
                WHEN k < 75 THEN ((user_id div 30 + k % 3) % h) * 30 + 7 + least(k % 4, 1) * 4
                ELSE (user_id * 7 + k * 13) % n END AS dst""",
        "to_date(ts) AS date",
        "CASE WHEN event_id % 3 < 2 THEN (floor(value) - 120) * 1000D + 5000D ELSE rint(((value - 120) * 1000 + 5000) * 100) / 100 END AS sum_kzt",
    )
    all_tx = scratch.write(raw.filter("src <> dst").selectExpr("CAST(src AS bigint) src", "CAST(dst AS bigint) dst", "date", "CAST(sum_kzt AS double) sum_kzt"), "transfers")
    seeds = events.filter("user_id % 28 = 3").select(F.col("user_id").cast("bigint").alias("gid"))
    nodes = depths(all_tx.select("src", "dst").distinct(), seeds, hops, scratch).withColumn("is_seed", F.col("depth") == 0)
    nodes = scratch.write(nodes, "nodes")
    shown = all_tx.join(nodes.filter(F.col("depth") < hops).select(F.col("gid").alias("src"), "depth"), "src")
    shown = scratch.write(shown, "transactions")
    edges = shown.groupBy("src", "dst").agg(F.sum("sum_kzt").alias("sum_kzt"), F.count("*").alias("n_tx"), (F.min("depth") + 1).cast("byte").alias("depth"))
    return Network(nodes, scratch.write(edges, "edges"), shown.select("src", "dst", "date", "sum_kzt"))
