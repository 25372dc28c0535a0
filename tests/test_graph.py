"""Graph operators against small graphs worked out by hand and brute force on random ones."""

from __future__ import annotations

import itertools
import random
import time
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.functions.cuts import Scratch
from ledgerlens.operators import clusters, graph, packed


def tables(spark, pairs, extra=()):
    nodes = sorted({x for p in pairs for x in p} | set(extra))
    edges = spark.createDataFrame([(a, b, 1.0 + i, 1) for i, (a, b) in enumerate(pairs)], "src long, dst long, sum_kzt double, n_tx long")
    return spark.createDataFrame([(n, n % 3 == 0) for n in nodes], "gid long, is_seed boolean"), edges


def random_pairs(seed, n=9, m=18):
    rng = random.Random(seed)
    return sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})


def brandes(nodes, pairs):
    out = defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, sigma, order, q = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        while q:
            v = q.popleft()
            order.append(v)
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    q.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        delta = defaultdict(float)
        for v in reversed(order):
            for w in out[v]:
                if dist.get(w) == dist[v] + 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if v != s:
                score[v] += delta[v]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) for v, x in score.items()}


def test_diamond_betweenness(spark):
    nodes, edges = tables(spark, [(1, 2), (2, 4), (1, 3), (3, 4)])
    got = {r.gid: r.betweenness for r in graph.betweenness(nodes, edges, Scratch(spark)).collect()}
    assert got == {1: 0, 2: pytest.approx(0.5 / 6), 3: pytest.approx(0.5 / 6), 4: 0}


def test_betweenness_random(spark):
    pairs = random_pairs(3)
    nodes, edges = tables(spark, pairs)
    got = {r.gid: r.betweenness for r in graph.betweenness(nodes, edges, Scratch(spark)).collect()}
    want = brandes(list(got), pairs)
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_components_and_isolated(spark):
    nodes, edges = tables(spark, [(5, 4), (4, 3), (8, 9), (7, 7)], extra=[6])
    got = {r.node: r.component for r in graph.components(nodes.selectExpr("gid AS node"), edges.selectExpr("src AS u", "dst AS v"), Scratch(spark)).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 6: 6, 7: 7, 8: 8, 9: 8}


def test_pagerank_tolerance(spark):
    nodes, edges = tables(spark, random_pairs(5), extra=[20])
    got = {r.gid: r.pagerank for r in graph.pagerank(nodes, edges, Scratch(spark)).collect()}
    w, ids = defaultdict(dict), list(got)
    for r in edges.collect():
        w[r.src][r.dst] = r.sum_kzt
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(200):
        lost = sum(rank[v] for v in ids if not w[v])
        new = {v: 0.15 / len(ids) + 0.85 * lost / len(ids) for v in ids}
        for v in ids:
            for u, x in w[v].items():
                new[u] += 0.85 * rank[v] * x / sum(w[v].values())
        rank = new
    assert sum(got.values()) == pytest.approx(1)
    assert all(got[v] == pytest.approx(rank[v], abs=1e-5) for v in ids)


def test_paths_and_reach(spark):
    pairs = random_pairs(7)
    nodes, edges = tables(spark, pairs)
    adjacent = set(pairs)
    want = set()
    for k in range(0, 3):
        for mid in itertools.permutations([x for x in range(9) if x not in (0, 1)], k):
            path = (0, *mid, 1)
            if all(p in adjacent for p in itertools.pairwise(path)):
                want.add(path)
    assert {tuple(r.nodes) for r in graph.paths(edges, 0, 1, 3, Scratch(spark)).collect()} == want
    volume = graph.reach_volume(edges, nodes.filter("is_seed"), Scratch(spark)).first()
    seen, q = {0, 3, 6} & {x for p in pairs for x in p}, deque([0, 3, 6])
    while q:
        v = q.popleft()
        for a, b in pairs:
            if a == v and b not in seen:
                seen.add(b)
                q.append(b)
    assert volume.n_reached == len(seen)


def test_louvain_two_cliques(spark):
    clique = lambda ids: list(itertools.combinations(ids, 2))
    pairs = spark.createDataFrame([(a, b, 1.0) for a, b in clique([1, 2, 3, 4]) + clique([11, 12, 13, 14]) + [(4, 11)]], "a long, b long, weight double")
    runs = clusters.louvain(pairs, Scratch(spark), runs=3)
    for run in range(3):
        member = {r.gid: r.community for r in runs.filter(f"run = {run}").collect()}
        assert len(set(member.values())) == 2 and len({member[g] for g in (1, 2, 3, 4)}) == 1
    assert {r.stability for r in clusters.stability(runs).collect()} == {1.0}
    q = clusters.modularity(pairs, runs.filter("run = 0").select("gid", "community")).first()[0]
    assert q == pytest.approx(12 / 13 - 0.5)


def test_blocks_of_betweenness_are_bounded_by_rows(spark, monkeypatch):
    pairs = random_pairs(3)
    nodes, edges = tables(spark, pairs)
    n, sizes, whole = nodes.count(), [], graph._dependencies
    monkeypatch.setattr(graph, "ROWS", 4 * n)
    monkeypatch.setattr(graph, "_dependencies", lambda own, *rest: sizes.append(own.count()) or whole(own, *rest))
    got = {r.gid: r.betweenness for r in graph.betweenness(nodes, edges, Scratch(spark)).collect()}
    assert len(sizes) == -(-n // 4) and sum(sizes) == n
    assert got == pytest.approx(brandes(sorted(got), pairs))

#: Ties, a loop, nodes out of reach, a hub with more neighbours than a slice, ids far apart.
ODD = sorted({*random_pairs(11, 14, 34), *((20, x) for x in range(12)), *((x, 21) for x in range(3, 14)), (21, 20), (-7, 20), (3, 3), (1 << 60, 2)})


@pytest.mark.parametrize("held", [1000, 0])
def test_betweenness_in_tasks_and_by_rows(spark, monkeypatch, held):
    by_rows, whole = [], graph._by_rows
    monkeypatch.setattr(graph, "HELD", held)
    monkeypatch.setattr(graph, "WORK", 400)
    monkeypatch.setattr(graph, "_by_rows", lambda *a: by_rows.append(1) or whole(*a))
    nodes, edges = tables(spark, ODD, extra=[40, 41])
    got = {r.gid: r.betweenness for r in graph.betweenness(nodes, edges, Scratch(spark), sources=9).collect()}
    assert got == pytest.approx(brandes(sorted(got), ODD))
    assert bool(by_rows) == (not held)


def test_betweenness_task_in_slices(monkeypatch):
    for name, size in (("SIDE", 3), ("WIDE", 4), ("CHUNK", 5)):
        monkeypatch.setattr(packed, name, size)
    ids = sorted({x for p in ODD for x in p})
    links = [p for p in ODD if p[0] != p[1]] + [(x, None) for x in [*ids, 99, 1 << 61]]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in (0, 1)], ["src", "dst"])
    (found,) = packed.task(iter([batch(links[:20]), batch(links[20:])]))
    got = dict.fromkeys(ids, 0.0) | dict(zip(found["gid"].to_pylist(), found["delta"].to_pylist(), strict=True))
    n = len(ids)
    assert got == pytest.approx({k: x * (n - 1) * (n - 2) for k, x in brandes(ids, ODD).items()})
    assert [x["gid"].to_pylist() for x in packed.task(iter([batch([(4, None)])]))] == [[]]


def test_betweenness_makes_no_tables_of_pairs(spark):
    """A job a block, however many levels the shortest paths have: here 60."""
    nodes, edges = tables(spark, [(k, k + 1) for k in range(60)])
    scratch = Scratch(spark)
    got = {r.gid: r.betweenness for r in graph.betweenness(nodes, edges, scratch).collect()}
    assert got == pytest.approx({k: k * (60 - k) / (60 * 59) for k in range(61)})
    assert scratch.count <= 3


def test_betweenness_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "WORK", 1)
    monkeypatch.setattr(graph, "SOURCES", 2)
    nodes, edges = tables(spark, ODD, extra=[40, 41])
    got = {r.gid: r.betweenness for r in graph.betweenness(nodes, edges, Scratch(spark)).collect()}
    assert got == pytest.approx(brandes(sorted(got), ODD))


@pytest.mark.parametrize("n", [254, 255, 256, 600])
def test_betweenness_task_with_long_paths(n):
    """Hops of more than a byte, in a path and in a ring."""
    for ring in (False, True):
        links = [(k, k + 1) for k in range(n)] + [(n, 0)] * ring
        rows = [*links, *((k, None) for k in range(n + 1))]
        (found,) = packed.task(iter([pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in (0, 1)], ["src", "dst"])]))
        got = dict(zip(found["gid"].to_pylist(), found["delta"].to_pylist(), strict=True))
        assert got == ({k: n * (n - 1) / 2 for k in range(n + 1)} if ring else {k: k * (n - k) for k in range(1, n)})


def random_links(n, m, sources):
    """Batches of a task: random links of n nodes, and the first nodes as sources."""
    rng = np.random.default_rng(1)
    src, dst = rng.integers(0, n, (2, m))
    whole = [pa.array(np.concatenate((src, np.arange(sources)))), pa.array(np.concatenate((dst, np.zeros(sources, np.int64))), mask=np.arange(m + sources) >= m)]
    return [pa.RecordBatch.from_arrays(whole, ["src", "dst"])]


def test_betweenness_task_in_copies(monkeypatch):
    found = []
    for links in (1, 1000, 7000, 1_000_000):
        monkeypatch.setattr(packed, "TOGETHER", links)
        found += [x.to_pydict() for x in packed.task(iter(random_links(300, 1000, 100)))]
    assert all(x["gid"] == found[0]["gid"] and x["delta"] == pytest.approx(found[0]["delta"]) for x in found)


def test_betweenness_task_takes_few_passes_over_the_links():
    """Time as a multiple of adding up along all links once for each source: about 4; 14 and more where every level read the payers of all open nodes."""
    n, m, sources = 9000, 42_000, 256
    batches, to, total = random_links(n, m, sources), np.random.default_rng(2).integers(0, n, m), np.zeros(n)
    took = []
    for f in (lambda: [np.add.at(total, to, total[to] * 1e-3 + 1) for _ in range(sources)], lambda: list(packed.task(iter(batches)))):
        f()
        began = time.process_time()
        f()
        took.append(time.process_time() - began)
    assert took[1] < 9 * took[0]
