"""Which queries need the runs of communities that only measure stability, and that all runs share one call."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ledgerlens.config import EVENTS
from ledgerlens.operators import clusters, priority
from ledgerlens.plans import registry
from ledgerlens.plans.analysis import Analysis


class Without(SimpleNamespace):
    """An analysis that has no other runs of communities."""

    cfg, top_nodes = EVENTS, Analysis.top_nodes.func

    @property
    def cluster_table(self):
        raise AssertionError("other runs of communities were asked for")

    stability = every_run = cluster_table


@pytest.fixture()
def without(spark):
    node = "gid long, cluster_id long, role string, role_score double, priority_score double, rank int, is_seed boolean, in_kzt double, out_kzt double, typology string, evidence string, flags array<string>"
    row = lambda g, r: (g, 1, "transit", 0.5, 0.4, r, False, 10.0, 9.0, "", "1", [])
    net = SimpleNamespace(
        nodes=spark.createDataFrame([(7, 0, True), (8, 1, False)], "gid long, depth int, is_seed boolean"), edges=spark.createDataFrame([(7, 8, 10.0, 1, 1)], "src long, dst long, sum_kzt double, n_tx long, depth byte"),
        transactions=spark.sql("SELECT 7L AS src, 8L AS dst, DATE'2024-01-01' AS date, 10D AS sum_kzt"),
    )
    return Without(net=net, scored=spark.createDataFrame([row(7, 1), row(8, 2)], node), cluster_records=spark.createDataFrame([(1, 2, 1, "x")], "cluster_id long, n_nodes long, n_seed long, hypothesis string"))


def test_get_node_and_overview_ask_for_no_other_runs(spark, without, monkeypatch):
    monkeypatch.setattr(registry, "analysis", lambda *_: without)
    known = registry.queries()
    assert known["get_node"](spark, "-").first().cluster_n_nodes == 2
    assert known["overview"](spark, "-").first().n_clusters == 1


def test_top_nodes_ask_for_no_other_runs(without, monkeypatch):
    monkeypatch.setattr(priority, "why", lambda: F.col("hypothesis"))
    assert [r.rank for r in without.top_nodes().orderBy("rank").collect()] == [1, 2]


@pytest.mark.parametrize("before", [False, True])
def test_all_runs_share_a_call_unless_run_0_is_there(spark, monkeypatch, before):
    asked, one = [], spark.createDataFrame([(0, 1, 1), (1, 1, 1)], "run int, gid long, community long")
    monkeypatch.setattr(clusters, "louvain", lambda pairs, scratch, runs=1, resolution=1.0, first=0: asked.append((first, runs)) or one.filter(f"run BETWEEN {first} AND {first + runs - 1}"))
    a = Analysis.__new__(Analysis)
    a.__dict__ |= {"given": None, "pairs": None, "scratch": None, "cfg": EVENTS, "_keep": lambda df, name: df, "cluster": spark.createDataFrame([(1, 5)], "gid long, cluster_id long")}
    if before:
        a.communities
    assert a.stability.collect()[0].stability == 1.0 and a.communities.count() == 1
    assert asked == ([(0, 1), (1, EVENTS.stability_runs)] if before else [(0, EVENTS.stability_runs + 1)])
