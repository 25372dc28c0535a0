"""The whole run: features, communities, roles, flags, priority and tables, in their fixed order."""

from __future__ import annotations

import time
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.cuts import Scratch
from ..operators import clusters, cycles, flows, forward, graph, priority, resilience, roles, temporal
from ..sources import files, sinks
from ..sources.network import Network, check
from . import export, report, saved

#: Rules whose violations are told and break nothing.
INFORMATIVE = ("input_node_without_edge",)


class Analysis:
    """Steps over one network; each is computed once, when first asked for, and kept in the shared folder.

    cluster: None for communities, or a table (gid, cluster_id). pagerank_steps is the least number of iterations of PageRank.
    """

    def __init__(self, net: Network, cfg: Config, cluster: DataFrame | None = None, pagerank_steps: int | None = None):
        self.net, self.cfg, self.given, self.steps = net, cfg, cluster, pagerank_steps
        self.scratch = Scratch(net.nodes.sparkSession)

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return self.scratch.write(df, name)

    @cached_property
    def structure(self) -> DataFrame:
        df = flows.node_flows(self.net, self.cfg).join(flows.seed_links(self.net), "gid", "left").na.fill(0, ["seed_in", "seed_out"])
        return self._keep(df, "structure")

    @cached_property
    def pagerank(self) -> DataFrame:
        return self._keep(graph.pagerank(self.net.nodes, self.net.edges, self.scratch, least=self.steps or 1), "pagerank")

    @cached_property
    def betweenness(self) -> DataFrame:
        return self._keep(graph.betweenness(self.net.nodes, self.net.edges, self.scratch), "betweenness")

    @cached_property
    def forward_cells(self) -> DataFrame:
        return self._keep(forward.table(forward.training(self.structure), self.cfg), "forward")

    @cached_property
    def forwarded(self) -> DataFrame:
        """The structure with p_forward."""
        return forward.add_p_forward(self.structure, self.forward_cells)

    @cached_property
    def anomalies(self) -> DataFrame:
        """(gid, anomaly_z), which follows from the structure alone."""
        return self._keep(priority.anomaly(self.structure, self.scratch).select("gid", "anomaly_z"), "anomalies")

    @cached_property
    def features(self) -> DataFrame:
        df = self.forwarded.join(self.pagerank, "gid").join(self.betweenness, "gid")
        df = df.join(temporal.node_temporal(self.net.transactions, self.cfg), "gid", "left")
        df = df.na.fill(0, ["burst_in", "burst_out", "active_days", "repeat_amount_n", "late_in_share"])
        return self._keep(df.join(self.anomalies, "gid"), "features")

    @cached_property
    def pairs(self) -> DataFrame:
        return self._keep(flows.pair_weights(self.net.edges), "pairs")

    @cached_property
    def communities(self) -> DataFrame:
        """(run, gid, community) of run 0, which counts."""
        if "every_run" in self.__dict__:
            return self.every_run.filter("run = 0")
        return self._keep(clusters.louvain(self.pairs, self.scratch, resolution=self.cfg.resolution), "communities")

    @cached_property
    def every_run(self) -> DataFrame:
        """(run, gid, community) of run 0 and of the runs that measure its stability; all share their jobs, unless run 0 is there already."""
        if "communities" in self.__dict__:
            return self.communities.unionByName(self._keep(clusters.louvain(self.pairs, self.scratch, self.cfg.stability_runs, self.cfg.resolution, 1), "reruns"))
        return self._keep(clusters.louvain(self.pairs, self.scratch, self.cfg.stability_runs + 1, self.cfg.resolution), "communities")

    @cached_property
    def cluster(self) -> DataFrame:
        if self.given is not None:
            return self._keep(self.given, "cluster")
        return self._keep(clusters.number(self.net.nodes, self.pairs, self.communities.filter("run = 0").select("gid", "community")), "cluster")

    @cached_property
    def stability(self) -> DataFrame:
        if self.given is not None:
            return self.cluster.select("cluster_id").distinct().withColumn("stability", F.lit(1.0))
        every = self.every_run
        ids = self.communities.filter("run = 0").join(self.cluster, "gid").select("community", "cluster_id").distinct()
        return clusters.stability(every).join(ids, "community").select("cluster_id", "stability")

    @cached_property
    def span(self) -> DataFrame:
        return clusters.seed_span(self.net.edges, self.cluster, self.net.nodes)

    @cached_property
    def roles(self) -> DataFrame:
        return self._keep(roles.assign(self.features.join(self.cluster, "gid"), self.span, self.cfg, self.scratch), "roles")

    @cached_property
    def cycles(self) -> DataFrame:
        return self._keep(cycles.cycles(self.net.edges, self.scratch, self.cfg.cycle_max_len), "cycles")

    @cached_property
    def routes(self) -> DataFrame:
        return self._keep(temporal.routes(self.net.transactions, self.cfg), "routes")

    @cached_property
    def flagged(self) -> DataFrame:
        on_cycle = self.cycles.select(F.explode("path").alias("gid"))
        df = priority.flags(self.roles, on_cycle, self.routes.select(F.col("b").alias("gid")), self.cfg)
        return self._keep(df.withColumn("typology", roles.typology()), "flagged")

    @cached_property
    def scored(self) -> DataFrame:
        return self._keep(priority.score(priority.components(self.flagged, self.cfg, self.scratch), self.cfg, self.scratch), "scored")

    @cached_property
    def giant(self) -> DataFrame:
        """gids of the largest weakly connected component, the one with the smallest node on ties."""
        found = self._keep(graph.components(self.net.nodes.select(F.col("gid").alias("node")), self.net.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), self.scratch), "components")
        best = found.groupBy("component").agg(F.count("*").alias("n")).agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
        return found.join(F.broadcast(best), "component").select(F.col("node").alias("gid"))

    @cached_property
    def cluster_records(self) -> DataFrame:
        """The cluster table without the stability, which alone needs the other runs of communities."""
        return self._keep(clusters.cluster_records(self.scored, self.net.edges, self.giant), "records")

    @cached_property
    def cluster_table(self) -> DataFrame:
        stable = self.stability
        return self._keep(clusters.cluster_table(self.cluster_records, stable), "clusters")

    @cached_property
    def top_nodes(self) -> DataFrame:
        best = self.scored.filter(F.col("rank") <= self.cfg.top_n).join(self.cluster_records.select("cluster_id", "hypothesis"), "cluster_id")
        return best.withColumns({"why": priority.why(), "confidence": priority.confidence_label(F.col("role_score")), "level": priority.priority_label(F.col("rank"))}).select(
            "rank", "gid", "role", "priority_score", "why", "cluster_id", "is_seed", "in_kzt", "out_kzt", "confidence", "level",
            F.when(F.col("typology") == "", "-").otherwise(F.col("typology")).alias("typology"), "role_score", (~F.col("is_seed")).alias("new_lead"), "evidence",
        )

    @cached_property
    def data_requests(self) -> DataFrame:
        return priority.data_requests(self.scored, self.cfg)

    @cached_property
    def resilience(self) -> DataFrame:
        return resilience.resilience(self.scored.select("gid", "is_seed", "rank"), self.net.edges, self.scratch)

    def write(self, path: str) -> DataFrame:
        """Writes all tables below path, each as a folder of parts and as a single file, with one document of all results; saves the
        results for lookups there; returns the checks: of the network (rules that begin with input_) and of the single files, read again."""
        began = time.monotonic()
        self.stability  # before the nodes, so that all runs of communities share their jobs
        nodes = self._keep(sinks.nodes_roles(self.scored), "nodes_roles")
        routes = self.routes.withColumns({"first": F.date_format("first", "yyyy-MM-dd"), "last": F.date_format("last", "yyyy-MM-dd")})
        cyc = self.cycles.withColumn("path", F.array_join(F.transform(F.array_append("path", F.col("path")[0]), lambda x: x.cast("string")), " → "))
        counted = sinks.write_csv(nodes, f"{path}/nodes_roles", ["rank"], sinks.node_counts())
        counted |= sinks.write_csv(self.cluster_table, f"{path}/clusters", ["cluster_id"], sinks.cluster_counts())
        sinks.write_csv(self.top_nodes, f"{path}/top_nodes", ["rank"])
        counted |= sinks.write_csv(cyc.select("length", "path", "min_edge_kzt", "total_kzt"), f"{path}/cycles", [F.desc("min_edge_kzt"), "length", "path"], {"n_cycles": F.count("*")})
        counted |= sinks.write_csv(routes, f"{path}/routes", [F.desc("n_dates"), F.desc("sum_out"), "a", "b", "c"], {"n_routes": F.count("*")})
        sinks.write_csv(self.resilience, f"{path}/resilience", ["removed_n"])
        sinks.write_csv(self.data_requests, f"{path}/data_requests", [F.desc("node_priority"), "gid", "request"])
        sinks.write_csv(self.forward_cells.select(F.col("b_deg").alias("in_deg"), F.col("b_tx").alias("in_tx"), F.round("p", 3).alias("p_forward"), "n"), f"{path}/p_forward_table")
        tables = {f"{path}/nodes_roles.csv": nodes, f"{path}/clusters.csv": self.cluster_table, f"{path}/top_nodes.csv": self.top_nodes}
        spark = self.net.nodes.sparkSession
        saved.save(self, f"{path}/store")
        seconds = F.lit(round(time.monotonic() - began, 1)).alias("seconds")
        report.summary(self, counted).select("*", seconds).coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
        summary = files.read_small(spark, f"{path}/metrics")
        files.join_document(spark, summary, {}, f"{path}/metrics.json")
        export.document(self, path, summary)
        export.tables(self, path)
        given = check(self.net).withColumn("rule", F.concat(F.lit("input_"), "rule"))
        return given.unionByName(sinks.validate(self.net.nodes, *(sinks.written(spark, p, x) for p, x in tables.items()))).unionByName(sinks.headers(spark, tables))


def _of_base(step: str) -> property:
    return property(lambda self: getattr(self.base, step))


class Reclustered(Analysis):
    """An analysis with other clusters (gid, cluster_id). Steps that know no clusters are those of `base`, each made when first asked for."""

    def __init__(self, base: Analysis, cluster: DataFrame):
        super().__init__(base.net, base.cfg, cluster, base.steps)
        self.base = base

    structure, pagerank, betweenness, forward_cells, forwarded, anomalies, features, pairs, cycles, routes, giant = map(
        _of_base, ("structure", "pagerank", "betweenness", "forward_cells", "forwarded", "anomalies", "features", "pairs", "cycles", "routes", "giant")
    )
