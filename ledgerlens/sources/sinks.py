"""Sinks: CSV with fixed columns, nested JSON, a run summary, reading back, and the check of written results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import ROLES
from ..functions.scalars import rnd

# Column order of the node table.
NODE_COLUMNS = (
    "gid", "role", "role_score", "cluster_id", "priority_score", "evidence", "rank", "is_seed", "depth", "rule_fired", "alt_role", "typology", "sink_status", "truncated", "p_forward",
    "in_deg", "out_deg", "in_kzt", "out_kzt", "in_tx", "out_tx", "out_in_ratio", "fast_share", "unseen_inflow_kzt", "seed_in", "seed_out", "pagerank", "betweenness", "flags",
    "prio_role", "prio_flow", "prio_centrality", "prio_seed", "prio_flags",
)


def nodes_roles(scored: DataFrame) -> DataFrame:
    """The node table without nulls: -1 where a ratio doesn't apply, - for no flag or typology."""
    text = lambda c: F.when(c == "", "-").otherwise(c)
    return scored.withColumns({
        "out_in_ratio": F.when(F.col("in_kzt") > 0, rnd(F.col("out_kzt") / F.col("in_kzt"), 4)).otherwise(-1.0),
        "fast_share": rnd(F.coalesce("fast_share", F.lit(-1.0)), 4),
        "flags": text(F.array_join("flags", ";")), "typology": text(F.coalesce("typology", F.lit(""))),
        "pagerank": rnd(F.col("pagerank"), 8), "betweenness": rnd(F.col("betweenness"), 8),
    }).select(*NODE_COLUMNS)


def write_csv(df: DataFrame, path: str, order: list | None = None, seen: dict[str, Column] | None = None) -> dict:
    """A folder of CSV parts (UTF-8, header, LF). An order is kept by range partitions, so no task holds all rows.

    `seen` are aggregates that the write itself takes of its rows; they are returned. They are observed behind the last exchange,
    where each row passes once.
    """
    out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    watch = Observation()
    out = out.observe(watch, *named(seen)) if seen else out
    out.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
    return dict(watch.get) if seen else {}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, order: list | None = None, separator: str = "\n") -> None:
    """JSON records with all keys, one after the other; ids as strings, which keep all their digits everywhere."""
    ids = {c: F.col(c).cast("string") for c in df.columns if c in ("gid", "src", "dst")}
    out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    out.withColumns(ids).write.mode("overwrite").option("ignoreNullFields", False).option("lineSep", separator).json(path)


def document(scored: DataFrame, edges: DataFrame, clusters: DataFrame, lists: DataFrame, top: DataFrame) -> dict[str, tuple[DataFrame, list]]:
    """Sections of the result document with their order: nodes, edges with their transfers, clusters, top nodes; one record a row."""
    text = lambda c: F.col(c).cast("string")
    money = ("in_kzt", "out_kzt")
    plain = ("role", "rule_fired", "typology", "evidence", "is_seed", "depth", "truncated", "sink_status", "in_deg", "out_deg", "in_tx", "out_tx", "flags")
    nodes = scored.select(
        text("gid").alias("id"), F.col("rank"), *plain, *(rnd(F.col(c), 2).alias(c) for c in money), F.when(F.col("alt_role") == "-", "").otherwise(F.col("alt_role")).alias("alt_role"),
        rnd(F.col("role_score"), 3).alias("role_score"), rnd(F.col("priority_score"), 4).alias("priority"), F.col("cluster_id").alias("cluster"),
        F.when(F.col("truncated"), rnd(F.col("p_forward"), 3)).alias("p_forward"), rnd(F.col("fast_share"), 3).alias("fast_share"),
        *(rnd(F.col(c), 6).alias(c) for c in ("pagerank", "betweenness")), F.struct(*(rnd(F.col(f"prio_{k}"), 4).alias(k) for k in ("role", "flow", "centrality", "seed", "flags"))).alias("prio_parts"),
    )
    links = edges.join(lists, ["src", "dst"], "left").select(text("src").alias("from"), text("dst").alias("to"), rnd(F.col("sum_kzt"), 2).alias("sum"), "n_tx", F.col("transfers").alias("tx"))
    mix = scored.groupBy("cluster_id", "role").agg(F.count("*").alias("n")).groupBy("cluster_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("roles"))  # six roles
    groups = clusters.join(mix, "cluster_id", "left").select(
        F.col("cluster_id").alias("id"), "n_nodes", "n_seed", F.col("sum_kzt_internal").alias("sum_internal"), "hypothesis",
        F.filter(F.split("top_gids", ";"), lambda x: x != "").alias("top_gids"), "roles", "stability", "isolated_fragment",
    )
    best = top.select("rank", text("gid").alias("gid"), "role", F.col("priority_score").alias("priority"), "why", "is_seed")
    return {"nodes": (nodes, ["rank"]), "edges": (links, ["from", "to"]), "clusters": (groups, ["id"]), "top": (best, ["rank"])}


def node_counts() -> dict[str, Column]:
    """Aggregates over scored nodes: how many of each role, new leads in the top 20, nodes that pass on what they get."""
    ratio = F.col("out_kzt") / F.when(F.col("in_kzt") > 0, F.col("in_kzt"))
    return {f"n_{r}": F.count_if(F.col("role") == r) for r in ROLES} | {"new_leads_top20": F.count_if((F.col("rank") <= 20) & ~F.col("is_seed")), "n_ratio_near_1": F.count_if(ratio.between(0.8, 1.2))}


def cluster_counts() -> dict[str, Column]:
    """Aggregates over the cluster table: clusters, and those with more than one seed."""
    return {"n_clusters": F.count_if(F.expr("cluster_id > 0")), "n_clusters_with_seeds": F.count_if(F.expr("cluster_id > 0 AND n_seed > 1"))}


def named(aggregates: dict[str, Column]) -> list[Column]:
    return [x.alias(name) for name, x in aggregates.items()]


def metrics(scored: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: the counts of nodes and clusters."""
    return scored.agg(*named(node_counts())).crossJoin(clusters.agg(*named(cluster_counts())))


def written(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A written CSV table with the types of `like`; an empty text and a null are one in CSV and come back as empty text."""
    return spark.read.schema(like.schema).option("header", True).csv(path).na.fill("")


def headers(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, n_violations): columns of the written tables {path: like} that are missing, renamed (a byte order mark does that) or out of place."""
    count = lambda path, like: len(set(enumerate(spark.read.option("header", True).csv(path).columns)) ^ set(enumerate(like.columns)))
    return spark.range(1).select(F.lit("columns").alias("rule"), F.lit(sum(count(p, x) for p, x in tables.items())).cast("long").alias("n_violations"))


def validate(nodes: DataFrame, roles: DataFrame, clusters: DataFrame, top: DataFrame) -> DataFrame:
    """(rule, n_violations) over written tables; all zero means they hold."""
    known, ends = nodes.select("gid"), roles.select("gid")
    bad = lambda df: df.agg(F.count("*").alias("n_violations"))
    null = F.lit(False)
    for c in roles.columns:
        null = null | F.col(c).isNull()
    sizes = clusters.agg(F.sum("n_nodes").alias("n"), F.sum("n_seed").alias("s")).crossJoin(nodes.agg(F.count("*").alias("n0"), F.count_if("is_seed").alias("s0")))
    again = top.join(roles.select("gid", F.col("role").alias("r"), F.col("priority_score").alias("p")), "gid", "left")
    rules = {
        "node_missing": bad(known.join(ends, "gid", "left_anti")),
        "node_unknown": bad(ends.join(known, "gid", "left_anti")),
        "gid_repeated": bad(roles.groupBy("gid").count().filter("count > 1")),
        "null_value": bad(roles.filter(null)),
        "role_unknown": bad(roles.filter(~F.col("role").isin(*ROLES))),
        "score_outside": bad(roles.filter(~F.col("role_score").between(0, 1) | ~F.col("priority_score").between(0, 1))),
        "evidence": bad(roles.filter((F.length("evidence") > 200) | (F.trim("evidence") == "") | ~F.col("evidence").rlike(r"\d"))),
        "cluster_unknown": bad(roles.join(clusters, "cluster_id", "left_anti")),
        "cluster_sizes": bad(sizes.filter("n <> n0 OR s <> s0")),
        "hypothesis": bad(clusters.filter("hypothesis IS NULL")),
        "priority_rises": bad(roles.select("rank", "priority_score").join(roles.select((F.col("rank") - 1).alias("rank"), F.col("priority_score").alias("next")), "rank").filter("next > priority_score")),
        "top_differs": bad(again.filter("r IS NULL OR r <> role OR abs(p - priority_score) > 1e-9")),
        "top_few": top.agg(F.when(F.count("*") < F.least(F.lit(20), F.lit(nodes.count())), 1).otherwise(0).cast("long").alias("n_violations")),
        "top_ranks": top.agg(F.when((F.count("*") > 0) & ((F.min("rank") != 1) | (F.max("rank") != F.count("*")) | (F.countDistinct("rank") != F.count("*"))), 1).otherwise(0).cast("long").alias("n_violations")),
    }
    out = None
    for rule, df in rules.items():
        df = df.select(F.lit(rule).alias("rule"), "n_violations")
        out = df if out is None else out.unionByName(df)
    return out
