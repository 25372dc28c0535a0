"""Strong components and cycles against brute force."""

from __future__ import annotations

import itertools
import random

import pytest

from ledgerlens.functions.cuts import Scratch
from ledgerlens.operators import cycles


def tables(spark, pairs, extra=()):
    nodes = sorted({x for p in pairs for x in p} | set(extra))
    edges = spark.createDataFrame([(a, b, 1.0 + i) for i, (a, b) in enumerate(pairs)], "src long, dst long, sum_kzt double")
    return spark.createDataFrame([(n,) for n in nodes], "gid long"), edges


def strong(nodes, pairs):
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            for s in nodes:
                if a in reach[s]:
                    reach[s].add(b)
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}


def every_cycle(pairs, longest):
    have, nodes = set(pairs), sorted({x for p in pairs for x in p})
    return {(n, *rest) for n in nodes for k in range(longest) for rest in itertools.permutations([x for x in nodes if x > n], k) if all(p in have for p in itertools.pairwise((n, *rest, n)))}


def some_pairs(seed, n, m):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


@pytest.mark.parametrize("pairs", [some_pairs(1, 9, 12), some_pairs(2, 9, 16), [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (6, 7), (8, 8)], [(i + 1, i) for i in range(9)]])
def test_strong_components(spark, pairs):
    nodes, edges = tables(spark, pairs, extra=[40])
    got = {r.gid: r.component for r in cycles.strong_components(nodes, edges, Scratch(spark)).collect()}
    assert got == strong(list(got), pairs) and 40 in got


def test_strong_components_with_repeated_edges_and_without_any(spark):
    nodes, edges = tables(spark, [(-(2**63), 2**63 - 1), (2**63 - 1, -(2**63)), (5, -(2**63))])
    got = {r.gid: r.component for r in cycles.strong_components(nodes, edges.unionByName(edges), Scratch(spark)).collect()}
    assert got == {-(2**63): -(2**63), 2**63 - 1: -(2**63), 5: 5}
    assert {tuple(r) for r in cycles.strong_components(nodes, edges.limit(0), Scratch(spark)).collect()} == {(x, x) for x in got}
    assert cycles.strong_components(nodes.limit(0), edges.limit(0), Scratch(spark)).count() == 0


@pytest.mark.parametrize("pairs, longest", [([(1, 2), (2, 3), (3, 1), (1, 4), (4, 1), (7, 7)], 5), (some_pairs(3, 8, 26), 5), (some_pairs(4, 8, 30), 4), (some_pairs(5, 8, 26), 6), (some_pairs(6, 8, 30), 1)])
def test_cycles(spark, pairs, longest):
    _, edges = tables(spark, pairs)
    cost = {p: 1.0 + i for i, p in enumerate(pairs)}
    rows = cycles.cycles(edges, Scratch(spark), longest).collect()
    want = every_cycle(pairs, longest)
    assert sorted(tuple(r.path) for r in rows) == sorted(want)
    for r in rows:
        sums = [cost[p] for p in itertools.pairwise((*r.path, r.path[0]))]
        assert (r.length, r.min_edge_kzt, r.total_kzt) == (len(r.path), min(sums), sum(sums))


def test_a_hub_grows_few_half_paths(spark):
    """40 payers into a hub that pays 40 others, and one cycle through it: only the cycle is walked."""
    pairs = [(100 + i, 1) for i in range(40)] + [(1, 200 + i) for i in range(40)] + [(1, 2), (2, 3), (3, 1)]
    _, edges = tables(spark, pairs)
    grown = []
    assert [tuple(r.path) for r in cycles.cycles(edges, Scratch(spark), 5, grown).collect()] == [(1, 2, 3)]
    assert sum(grown) <= 4
    assert cycles.cycles(edges.limit(0), Scratch(spark)).count() == 0
