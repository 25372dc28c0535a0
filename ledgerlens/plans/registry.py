"""The registered queries over the network that the event table gives, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EVENTS
from ..functions.cuts import Scratch, importable
from ..functions.scalars import rnd
from ..operators import clusters, cycles, flows, forward, graph, lookup, priority, resilience, temporal, trace
from ..sources import files, network, sinks
from ..streaming import flows as stream_flows
from . import report
from .analysis import Analysis, Reclustered
from .oracles import PAGERANK_STEPS, SQL
from .saved import Saved, save

_memo: dict[tuple, tuple[tuple, Analysis]] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """Size, number of files and time of change of a table."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    about = fs.getContentSummary(at)
    return about.getLength(), about.getFileCount(), fs.getFileStatus(at).getModificationTime()


def analysis(spark: SparkSession, sf_dir: str, by_component: bool = False) -> Analysis:
    """The analysis of a data folder, kept for the session: a query computes only the steps that no other has asked for.

    A changed event table gets a new analysis.

    by_component: clusters are the components of the edges with two transfers or more, which SQL can express.
    """
    key, state = (spark.sparkContext.applicationId, sf_dir, by_component), _state(spark, f"{sf_dir}/events.parquet")
    if key not in _memo or _memo[key][0] != state:
        importable(spark)
        if by_component:
            base = analysis(spark, sf_dir)
            found = base._keep(components_of(base), "components")
            _memo[key] = state, Reclustered(base, found.select(F.col("node").alias("gid"), (F.col("component") + 1).alias("cluster_id")))
        else:
            _memo[key] = state, Analysis(network.from_events(spark.read.parquet(f"{sf_dir}/events.parquet")), EVENTS, pagerank_steps=PAGERANK_STEPS)
    return _memo[key][1]


def components_of(a: Analysis) -> DataFrame:
    strong = a.net.edges.filter("n_tx >= 2")
    return graph.components(a.net.nodes.select(F.col("gid").alias("node")), strong.select(F.col("src").alias("u"), F.col("dst").alias("v")), a.scratch)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, as sums of doubles depend on their order."""
    return df.withColumns({c: rnd(F.col(c), digits) for c, t in df.dtypes if t == "double"}) if any(t == "double" for _, t in df.dtypes) else df


def _backtest(a: Analysis) -> DataFrame:
    rows = a._keep(forward.backtest_rows(forward.training(a.structure), a.cfg), "backtest")
    auc = forward.auc(rows, a.scratch).select(F.lit("auc").alias("bin"), F.col("auc").alias("predicted"), F.lit(None).cast("double").alias("actual"), F.lit(None).cast("long").alias("n"))
    return forward.calibration(rows).unionByName(auc)


def _removal(a: Analysis) -> DataFrame:
    """Fixed removals: none, the hub payers, and every tenth id."""
    scenarios = a.net.nodes.sparkSession.createDataFrame([(0,), (1,), (2,)], "scenario int")
    gone = a.net.nodes.select("gid", F.explode(F.array_compact(F.array(F.when(F.col("gid") % 30 == 7, 1), F.when(F.col("gid") % 10 == 0, 2)))).alias("scenario"))
    return resilience.measure(a.net.nodes, a.net.edges, gone, scenarios, a.scratch)


def _nested_removals(a: Analysis) -> DataFrame:
    """The first 5 and 20 nodes of two fixed orders: by the remainder of 7, and of 10."""
    first = lambda chain, by: a.net.nodes.orderBy(F.col("gid") % by, "gid").limit(20).select(F.lit(chain).alias("chain"), "gid", F.row_number().over(Window.orderBy(F.col("gid") % by, "gid")).alias("at"))  # noqa: E731  20 rows
    return resilience.nested(a.net.nodes, a.net.edges, first(0, 7).unionByName(first(1, 10)), [5, 20], a.scratch)


def _node_record(a: Analysis) -> DataFrame:
    """Node 7 with its cluster's size and its largest payers and payees, amounts in hundredths."""
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["gid"], F.rint(x["sum_kzt"] * 100).cast("bigint"), x["n_tx"])), ",").alias(c)
    found = lookup.node(a.scored, a.net.edges, a.cluster_table, 7)
    return found.select("gid", "role", "priority_score", F.col("rank").cast("long").alias("rank"), "cluster_id", "cluster_n_nodes", "cluster_n_seed", listed("top_payers"), listed("top_payees"))


def _traced_paths(a: Analysis) -> DataFrame:
    """From node 7 to 37, and to node 7 from the first node that pays nobody, which directions don't allow."""
    still = a.net.nodes.join(a.net.edges.select(F.col("src").alias("gid")), "gid", "left_anti").agg(F.min("gid")).first()[0]
    parts = [trace.traced_path(a.net.edges, x, y, a.scratch).withColumn("start", F.lit(x).cast("long")) for x, y in ((7, 37), (still, 7))]
    return parts[0].unionByName(parts[1])


def _shared_receivers(a: Analysis) -> DataFrame:
    found, routes = trace.shared_receivers(a.net.edges, [7, 37, 67], a.scratch)
    return found.join(routes, "gid").select("gid", "n_linked", "total_hops", "key", "step", "src", "dst")


def _stored(a: Analysis) -> Saved:
    """The analysis saved and opened again, as another session would."""
    spark, path = a.net.nodes.sparkSession, f"{a.scratch.root}/store"
    if "saved" not in a.__dict__:
        save(a, path, bucket_rows=200)
        a.__dict__["saved"] = Saved(spark, path)
    return a.__dict__["saved"]


def _stored_partners(a: Analysis) -> DataFrame:
    return _stored(a).rows("partners", 7).select("gid", "direction", "other", "sum_kzt", "n_tx", "first", "last", "role", "is_seed", "priority_score")


def _stored_members(a: Analysis) -> DataFrame:
    """The members of node 7's cluster, after a lookup of the node and of its cluster."""
    saved = _stored(a)
    node = saved.rows("nodes", 7).first()
    about = saved.rows("clusters", node["cluster_id"]).select("cluster_id", "n_nodes", "n_seed")
    return saved.rows("members", node["cluster_id"]).join(about, "cluster_id").select("cluster_id", "n_nodes", "n_seed", F.col("rank").cast("long").alias("rank"), "gid", "role")


def _stream_patterns(a: Analysis) -> DataFrame:
    """The transfers as a stream, which stops and goes on from its checkpoint; a last row without ids closes all days."""
    spark, root = a.net.nodes.sparkSession, f"{a.scratch.root}/stream"
    if "stream" not in a.__dict__:
        tx = a.net.transactions.select("src", "dst", F.timestamp_seconds(F.unix_date("date") * 86400).alias("ts"), "sum_kzt")
        none = F.lit(None)
        end = tx.agg((F.max("ts") + F.expr("INTERVAL 90 DAYS")).alias("ts")).select(none.cast("long").alias("src"), none.cast("long").alias("dst"), "ts", none.cast("double").alias("sum_kzt"))
        for part in (tx, end):
            part.write.mode("append").parquet(f"{root}/in")
            stream_flows.run(stream_flows.node_patterns(spark.readStream.schema(tx.schema).parquet(f"{root}/in"), a.cfg, "60 days"), f"{root}/out", f"{root}/state")
        a.__dict__["stream"] = spark.read.parquet(f"{root}/out")
    return stream_flows.latest(a.__dict__["stream"])


def _exported_nodes(a: Analysis) -> DataFrame:
    """The node table, written as parts, joined to one file, and read back from it."""
    spark, folder, nodes = a.net.nodes.sparkSession, f"{a.scratch.root}/single/nodes_roles", sinks.nodes_roles(a.scored)
    sinks.write_csv(nodes, folder, ["rank"])
    files.join_csv(spark, folder, f"{folder}.csv")
    back = sinks.written(spark, f"{folder}.csv", nodes)
    return back.select("gid", "priority_score", "prio_role", "prio_flow", "prio_centrality", "prio_seed", "prio_flags", F.col("rank").cast("long").alias("rank"))


def _written(a: Analysis) -> DataFrame:
    return a.write(f"{a.scratch.root}/output")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = {
        "edges_agg": lambda a: network.edges_of(a.net.transactions),
        "node_flows": lambda a: flows.node_flows(a.net, a.cfg),
        "bfs_depth": lambda a: a.net.nodes,
        "orphans_anti": lambda a: a.net.nodes.join(a.net.edges.filter("n_tx >= 2").select(F.explode(F.array("src", "dst")).alias("gid")), "gid", "left_anti").select("gid"),
        "sanity_full_outer": lambda a: network.check(a.net),
        "undirected_weights": lambda a: flows.pair_weights(a.net.edges),
        "seed_links": lambda a: flows.seed_links(a.net),
        "late_share": lambda a: temporal.late_share(a.net.transactions, a.cfg),
        "bursts": lambda a: temporal.bursts(a.net.transactions),
        "repeat_amounts": lambda a: temporal.repeat_amounts(a.net.transactions, a.cfg),
        "active_days": lambda a: temporal.active_days(a.net.transactions),
        "stream_patterns": _stream_patterns,
        "fast_share": lambda a: temporal.fast_share(a.net.transactions, a.cfg),
        "routes": lambda a: temporal.routes(a.net.transactions, a.cfg),
        "p_forward_table": lambda a: a.forward_cells.select("b_deg", "b_tx", "p", "n", "base"),
        "p_forward_backtest": _backtest,
        "p_forward": lambda a: a.forwarded.select("gid", "p_forward"),
        "robust_anomaly": lambda a: a.anomalies,
        "pagerank": lambda a: a.pagerank,
        "betweenness": lambda a: a.betweenness,
        "cycles": lambda a: a.cycles.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "length", "min_edge_kzt", "total_kzt"),
        "strong_components": lambda a: cycles.strong_components(a.net.nodes, a.net.edges, a.scratch),
        "components": components_of,
        "seed_reach_volume": lambda a: graph.reach_volume(a.net.edges, a.net.nodes.filter("is_seed"), a.scratch),
        "removal": _removal,
        "nested_removals": _nested_removals,
        "neighbors": lambda a: graph.neighbours(a.net.edges, 7),
        "partners": lambda a: lookup.partners(a.net.transactions, 7),
        "top_paths": lambda a: lookup.ranked_paths(a.net.edges, 7, 37, 3, a.scratch, 20).select(F.array_join(F.col("nodes").cast("array<string>"), ">").alias("nodes"), "bottleneck_kzt", "n_hops"),
        "widest_paths": lambda a: graph.widest_paths(a.net.edges, 7, 37, 4, 20, a.scratch).select(F.array_join(F.col("nodes").cast("array<string>"), ">").alias("nodes"), "bottleneck_kzt", "n_hops"),
        "flow_trace": lambda a: trace.flow_trace(a.net.edges, 7, a.scratch, "both"),
        "traced_path": _traced_paths,
        "shared_receivers": _shared_receivers,
        "shortest_path": lambda a: graph.shortest_path(a.net.edges, 7, 37, a.scratch).select(F.array_join(F.col("nodes").cast("array<string>"), ">").alias("nodes"), "n_hops"),
        "find_paths": lambda a: graph.paths(a.net.edges, 7, 37, 3, a.scratch).select(F.array_join(F.col("nodes").cast("array<string>"), ">").alias("nodes"), "bottleneck_kzt", "n_hops"),
        "common_counterparties": lambda a: graph.common_counterparties(a.net.edges, [7, 37, 67], "out", 2, a.scratch).select("gid", "n_linked", F.array_join(F.transform("linked", lambda x: F.concat_ws(":", x["gid"], x["hops"])), ",").alias("linked")),
        "edge_tx_lists": lambda a: temporal.edge_lists(a.net.transactions).select("src", "dst", F.array_join(F.transform("transfers", lambda x: F.concat_ws(" ", F.date_format(x["date"], "yyyy-MM-dd"), F.rint(x["sum_kzt"] * 100).cast("bigint"))), ",").alias("transfers")),
        "graph_totals": lambda a: flows.totals(a.net),
        "communities": lambda a: a.communities.filter("run = 0").select("gid", "community").join(a.cluster, "gid"),
        "community_modularity": lambda a: clusters.modularity(a.pairs, a.communities.filter("run = 0").select("gid", "community")),
        "roles": lambda a: a.roles.select("gid", "role", "role_score", "rule_fired", "alt_role", "evidence", "sink_status"),
        "priority": lambda a: a.scored.orderBy("rank").select("gid", "role", "role_score", "priority_score", "prio_role", "prio_flow", "prio_centrality", "prio_seed", "prio_flags", "rank"),
        "top_nodes": lambda a: a.top_nodes,
        "cluster_table": lambda a: a.cluster_table,
        "resilience": lambda a: a.resilience,
        "get_node": lambda a: lookup.node(a.scored.drop("flags"), a.net.edges, a.cluster_records, 7),
        "cluster_summary": lambda a: lookup.cluster(a.scored, a.cluster_table, 1),
        "overview": lambda a: flows.totals(a.net).crossJoin(sinks.metrics(a.scored, a.cluster_records)),
        "outputs_check": _written,
    }
    fixed = {
        "cluster_flows": lambda a: clusters.flows(a.net.edges, a.cluster),
        "modularity": lambda a: clusters.modularity(a.pairs, a.cluster.withColumnRenamed("cluster_id", "community")),
        "seed_cluster_span": lambda a: a.span,
        "cluster_numbers": lambda a: clusters.number(a.net.nodes, a.pairs, a.cluster.withColumnRenamed("cluster_id", "community")),
        "roles_by_component": lambda a: a.roles.select("gid", "role", "role_score", "alt_role", "sink_status"),
        "flags": lambda a: a.flagged.select("gid", F.array_join("flags", ";").alias("flags"), "typology"),
        "priority_by_component": lambda a: a.scored.select("gid", "priority_score", "prio_role", "prio_flow", "prio_centrality", "prio_seed", "prio_flags", F.col("rank").cast("long").alias("rank")),
        "sensitivity": lambda a: priority.sensitivity(a.scored, a.cfg),
        "data_requests": lambda a: a.data_requests.groupBy("request").agg(F.count("*").alias("n"), F.sum("gid").alias("gids")),
        "search_nodes": lambda a: lookup.search(a.scored, role="consolidator", min_in_deg=6, min_priority=0.3).select("gid", "rank"),
        "resolve_suffix": lambda a: lookup.resolve(a.net.nodes, "x-7").select("gid", "tier"),
        "cluster_top": lambda a: a.cluster_table.select("cluster_id", "n_nodes", "n_seed", "sum_kzt_internal", "top_gids", "isolated_fragment", "max_priority"),
        "cluster_roles": lambda a: a.cluster_table.select("cluster_id", "roles_mix", "sum_kzt_in_external", "sum_kzt_out_external"),
        "top_by_component": lambda a: a.top_nodes.select(F.col("rank").cast("long").alias("rank"), "gid", "role", "priority_score", "cluster_id", "is_seed", "in_kzt", "out_kzt", "confidence", "level"),
        "overview_by_component": lambda a: flows.totals(a.net).crossJoin(sinks.metrics(a.scored, a.cluster_table)),
        "run_summary": lambda a: report.long_form(report.summary(a, report.counts(a))),
        "exported_nodes": _exported_nodes,
        "node_record": _node_record,
        "stored_partners": _stored_partners,
        "stored_members": _stored_members,
    }
    make = lambda f, by: lambda spark, sf_dir: rounded(f(analysis(spark, sf_dir, by)))
    return {k: make(f, False) for k, f in plain.items()} | {k: make(f, True) for k, f in fixed.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
