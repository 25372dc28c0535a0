"""Nested removals against whole copies of the graph, and by hand."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.cuts import Scratch
from ledgerlens.operators import resilience


def tables(spark, pairs, n, seeds):
    edges = spark.createDataFrame([(a, b, float(1 + i)) for i, (a, b) in enumerate(pairs)], "src long, dst long, sum_kzt double")
    return spark.createDataFrame([(i, i in seeds) for i in range(n)], "gid long, is_seed boolean"), edges


def whole(nodes, edges, order, ns, scratch):
    spark, chains = nodes.sparkSession, sorted({r.chain for r in order.collect()})
    wanted = [(c, n) for c in chains for n in (*ns, 0)]
    scenarios = spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate(wanted)], "scenario int, chain int, n int")
    removed = order.join(F.broadcast(scenarios), "chain").filter("at <= n").select("scenario", "gid")
    found = resilience.measure(nodes, edges, removed, scenarios.select("scenario"), scratch)
    rows = scenarios.join(found, "scenario", "left").na.fill(0)
    return {(r.chain, r.n): (r.giant, r.n_components, pytest.approx(r.volume)) for r in rows.collect()}


@pytest.mark.parametrize("seed, n, m, first", [(1, 24, 34, 6), (2, 24, 60, 12), (3, 8, 10, 8)])
def test_equal_to_whole_copies(spark, seed, n, m, first):
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})
    nodes, edges = tables(spark, pairs, n, set(rng.sample(range(n), 2)))
    rows = [(c, g, i + 1) for c in range(4) for i, g in enumerate(rng.sample(range(n), first))]
    order, ns, scratch = spark.createDataFrame(rows, "chain int, gid long, at int"), [2, 5, first], Scratch(spark)
    got = {(r.chain, r.n): (r.giant, r.n_components, r.volume) for r in resilience.nested(nodes, edges, order, ns, scratch).collect()}
    assert got == whole(nodes, edges, order, ns, scratch)


def test_a_star_by_hand(spark):
    pairs = [(0, i) for i in range(1, 7)] + [(6, 7)]
    nodes, edges = tables(spark, pairs, 9, {0})
    order = spark.createDataFrame([(0, 6, 1), (0, 0, 2), (0, 99, 3)], "chain int, gid long, at int")
    got = {r.n: (r.giant, r.n_components, r.volume) for r in resilience.nested(nodes, edges, order, [1, 2, 3], Scratch(spark)).collect()}
    assert got == {0: (8, 2, 28.0), 1: (6, 3, 15.0), 2: (1, 7, 0.0), 3: (1, 7, 0.0)}


def test_draws_are_nested_repeatable_and_without_seeds(spark):
    ranked = spark.createDataFrame([(i, i % 4 == 0, i + 1) for i in range(40)], "gid long, is_seed boolean, rank long")
    draw = lambda most, df: {(r.chain, r.at): r.gid for r in resilience.drawn(df, most, 3, 42).collect()}
    few, many = draw(4, ranked), draw(9, ranked.repartition(5))
    assert few.items() <= many.items() and len(many) == 36
    assert all(g % 4 for (c, _), g in many.items() if c) and [many[0, k] for k in range(1, 10)] == list(range(9))
    assert len({tuple(many[c, k] for k in range(1, 10)) for c in (1, 2, 3)}) == 3
