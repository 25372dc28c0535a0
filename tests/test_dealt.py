"""Joins that loops repeat don't pass tables through the driver, however small these are."""

from __future__ import annotations

import random

import pytest

from ledgerlens.functions.cuts import Scratch
from ledgerlens.operators import clusters, cycles, flows, graph


def done(spark):
    """Physical plans of all executions by their number."""
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {found.apply(i).executionId(): found.apply(i).physicalPlanDescription() for i in range(found.size())}


@pytest.fixture(scope="module")
def net(spark):
    rng = random.Random(5)
    pairs = sorted({(a, b) for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(40)) if a != b})
    edges = Scratch(spark).write(spark.createDataFrame([(a, b, 1.0 + a) for a, b in pairs], "src long, dst long, sum_kzt double"), "edges")
    return Scratch(spark).write(edges.selectExpr("explode(array(src, dst)) AS gid").distinct(), "nodes"), edges


LOOPS = {
    "pagerank": lambda nodes, edges, s: graph.pagerank(nodes, edges, s),
    "communities": lambda nodes, edges, s: clusters.louvain(flows.pair_weights(edges), s, 2),
    "modularity": lambda nodes, edges, s: clusters.modularity(flows.pair_weights(edges), nodes.selectExpr("gid", "gid % 3 AS community")),
    "strong_components": cycles.strong_components,
    "cycles": lambda nodes, edges, s: cycles.cycles(edges, s),
    "components": lambda nodes, edges, s: graph.components(nodes.withColumnRenamed("gid", "node"), edges.selectExpr("src AS u", "dst AS v"), s),
}


@pytest.mark.parametrize("name", LOOPS)
def test_no_broadcast_joins(spark, net, name):
    before = set(done(spark))
    assert LOOPS[name](*net, Scratch(spark)).collect()
    plans = [p for k, p in done(spark).items() if k not in before]
    assert plans and not any("BroadcastHashJoin" in p for p in plans)
