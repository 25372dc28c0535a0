"""Traces, fallback paths, shared receivers, widest paths and betweenness in blocks against brute force on small graphs."""

from __future__ import annotations

import itertools
import random
from collections import deque

import pytest
from test_graph import brandes, random_pairs, tables

from ledgerlens.functions.cuts import Scratch
from ledgerlens.operators import graph, trace


def levels(pairs, start):
    seen, queue = {start: 0}, deque([start])
    while queue:
        v = queue.popleft()
        for a, b in sorted(pairs):
            if a == v and b not in seen:
                seen[b] = seen[v] + 1
                queue.append(b)
    return seen


@pytest.mark.parametrize("hops", [1, 2, 4])
def test_flow_trace(spark, hops):
    pairs = random_pairs(11, 14, 30) + [(50, 51)]
    _, edges = tables(spark, pairs)
    want = set()
    for direction in ("out", "in"):
        own = pairs if direction == "out" else [(b, a) for a, b in pairs]
        at = levels(own, 0)
        want |= {((a, b) if direction == "out" else (b, a), at[a] + 1, direction) for a, b in own if at.get(a, 99) < hops}
    got = trace.flow_trace(edges, 0, Scratch(spark), "both", hops)
    assert {((r.src, r.dst), r.level, r.direction) for r in got.collect()} == want and got.count() == len(want)
    assert got.columns == ["src", "dst", "sum_kzt", "n_tx", "level", "direction"]
    with pytest.raises(ValueError):
        trace.flow_trace(edges, 0, Scratch(spark), "up")


def test_traced_path_falls_back(spark):
    _, edges = tables(spark, [(1, 2), (3, 2), (3, 4), (5, 6)])
    rows = lambda a, b: [tuple(r) for r in trace.traced_path(edges, a, b, Scratch(spark)).orderBy("step").collect()]
    assert rows(1, 2) == [(1, 1, 2, True, True)]
    assert rows(1, 4) == [(1, 1, 2, True, False), (2, 3, 2, False, False), (3, 3, 4, True, False)]
    assert rows(1, 6) == [] and rows(1, 1) == []


def test_shared_receivers(spark):
    pairs = random_pairs(12, 16, 34)
    _, edges = tables(spark, pairs)
    given = [0, 3, 5]
    at = {g: levels(pairs, g) for g in given}
    linked = {}
    for v in {x for p in pairs for x in p} - set(given):
        hops = [at[g][v] for g in given if 0 < at[g].get(v, 99) <= 4]
        if len(hops) >= 2:
            linked[v] = (-len(hops), sum(hops), v)
    best = sorted(linked, key=linked.get)[:8]
    found, routes = trace.shared_receivers(edges, given, Scratch(spark))
    assert {(r.gid, -r.n_linked, r.total_hops) for r in found.collect()} == {(v, *linked[v][:2]) for v in best}
    told = {}
    for r in routes.collect():
        assert (r.src, r.dst) in set(pairs)
        told.setdefault((r.key, r.gid), {})[r.step] = (r.src, r.dst)
    assert set(told) == {(g, v) for v in best for g in given if 0 < at[g].get(v, 99) <= 4}
    for (g, v), steps in told.items():
        chain = [steps[k] for k in sorted(steps)]
        assert len(chain) == at[g][v] and chain[0][0] == g and chain[-1][1] == v and all(x[1] == y[0] for x, y in itertools.pairwise(chain))
    everyone, _ = trace.shared_receivers(edges, given, Scratch(spark), first=None)
    assert {r.gid for r in everyone.collect()} == set(linked)


def simple_paths(amounts, src, dst, longest):
    out, stack = [], [((src,), float("inf"))]
    while stack:
        nodes, low = stack.pop()
        if nodes[-1] == dst and len(nodes) > 1:
            out.append((-low, len(nodes) - 1, list(nodes)))
            continue
        if len(nodes) <= longest:
            stack += [((*nodes, b), min(low, x)) for (a, b), x in amounts.items() if a == nodes[-1] and b not in nodes]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 3, 10, 1000])
def test_widest_paths(spark, k):
    rng = random.Random(k)
    pairs = random_pairs(20 + k, 9, 40)
    amounts = {p: float(rng.choice([1, 2, 3, 5, 8, rng.random()])) for p in pairs}
    edges = spark.createDataFrame([(a, b, x, 1) for (a, b), x in amounts.items()], "src long, dst long, sum_kzt double, n_tx long")
    got = [(-r.bottleneck_kzt, r.n_hops, r.nodes) for r in graph.widest_paths(edges, 0, 1, 4, k, Scratch(spark)).collect()]
    assert got == simple_paths(amounts, 0, 1, 4)[:k]
    assert graph.widest_paths(edges, 0, 0, 4, k, Scratch(spark)).count() == 0 == graph.widest_paths(edges, 0, 77, 4, k, Scratch(spark)).count()


def test_widest_paths_grow_few_on_a_hub(spark):
    n = 120
    rows = [(0, 100 + i, 10.0 + i) for i in range(n)] + [(100 + i, 1, 9.0 + 2 * i) for i in range(n)] + [(1, 1000 + i, 5.0 + i) for i in range(n)] + [(1000 + i, 2, 7.0 + i / 2) for i in range(n)]
    edges = spark.createDataFrame(rows, "src long, dst long, sum_kzt double").selectExpr("*", "1L AS n_tx")
    grown = []
    got = [(-r.bottleneck_kzt, r.n_hops, r.nodes) for r in graph.widest_paths(edges, 0, 2, 4, 5, Scratch(spark), grown).collect()]
    amounts = {(a, b): x for a, b, x in rows}
    assert got == simple_paths(amounts, 0, 2, 4)[:5]
    ties = sum(-low == -got[-1][0] for low, _, _ in simple_paths(amounts, 0, 2, 4))
    assert sum(grown) <= 4 * (ties + 5) < n * n / 10


def test_betweenness_in_blocks_and_after_a_break(spark, tmp_path, monkeypatch):
    pairs = random_pairs(31, 12, 30)
    nodes, edges = tables(spark, pairs, extra=[99])
    want = brandes(sorted({x for p in pairs for x in p} | {99}), pairs)
    same = lambda df: {r.gid: r.betweenness for r in df.collect()} == pytest.approx(want, abs=1e-12)
    for sources in (100, 5, 1):
        assert same(graph.betweenness(nodes, edges, Scratch(spark), sources))
    kept, done = f"file://{tmp_path}/blocks", []
    real = graph._dependencies

    def breaks(own, links, scratch):
        done.append(own.count())
        if len(done) == 3:
            raise RuntimeError("lost")
        return real(own, links, scratch)

    monkeypatch.setattr(graph, "_dependencies", breaks)
    with pytest.raises(RuntimeError):
        graph.betweenness(nodes, edges, Scratch(spark), 3, kept)
    assert same(graph.betweenness(nodes, edges, Scratch(spark), 3, kept)) and len(done) == 3 + (len(want) + 2) // 3 - 2
