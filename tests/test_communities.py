"""Communities on random graphs: as good as a sequential run within a bound, ends without a gain left, every run by itself."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from ledgerlens.functions.cuts import Scratch
from ledgerlens.operators import clusters


def graph_of(seed, n=90, groups=6, inside=0.35, across=0.02):
    rng = random.Random(seed)
    return [(a, b, round(rng.uniform(0.5, 3), 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < (inside if a % groups == b % groups else across)]


def quality(pairs, member):
    m = sum(w for *_, w in pairs)
    k, inner = defaultdict(float), 0.0
    for a, b, w in pairs:
        k[member[a]] += w
        k[member[b]] += w
        inner += w if member[a] == member[b] else 0
    return inner / m - sum((x / (2 * m)) ** 2 for x in k.values())


def one_at_a_time(pairs):
    """Sequential Louvain: nodes in order, each to its best neighbouring community, then contraction."""
    names = {x: x for p in pairs for x in p[:2]}
    now = list(pairs)
    while True:
        links, k = defaultdict(lambda: defaultdict(float)), defaultdict(float)
        m = sum(w for *_, w in now)
        for a, b, w in now:
            k[a] += w
            k[b] += w
            if a != b:
                links[a][b] += w
                links[b][a] += w
        c, tot, any_move = {x: x for x in k}, dict(k), False
        moving = True
        while moving:
            moving = False
            for v in sorted(k):
                near = defaultdict(float)
                for u, w in links[v].items():
                    near[c[u]] += w
                tot[c[v]] -= k[v]
                gain = lambda x: near[x] / m - k[v] * tot[x] / (2 * m * m)  # noqa: B023, E731
                best = max([*near, c[v]], key=lambda x: (gain(x), x == c[v]))
                if gain(best) > gain(c[v]) + 1e-12:
                    c[v], moving, any_move = best, True, True
                tot[c[v]] += k[v]
        if not any_move:
            return names
        names = {x: c[y] for x, y in names.items()}
        sums = defaultdict(float)
        for a, b, w in now:
            sums[tuple(sorted((c[a], c[b])))] += w
        now = [(a, b, w) for (a, b), w in sums.items()]


@pytest.mark.parametrize("seed,across", [(1, 0.02), (2, 0.1), (3, 0.3)])
def test_as_good_as_one_at_a_time(spark, seed, across):
    pairs = graph_of(seed, across=across)
    got = clusters.louvain(spark.createDataFrame(pairs, "a long, b long, weight double"), Scratch(spark), runs=2).collect()
    want = quality(pairs, one_at_a_time(pairs))
    for run in (0, 1):
        member = {r.gid: r.community for r in got if r.run == run}
        assert set(member) == {x for p in pairs for x in p[:2]}
        assert quality(pairs, member) >= want - 0.03  # other local optima than in that order


def test_a_level_ends_without_a_gain_left(spark):
    pairs = graph_of(5, n=60, across=0.15)
    scratch = Scratch(spark)
    df = spark.createDataFrame([(0, a, b, w) for a, b, w in pairs], "run int, a long, b long, weight double")
    ends = df.selectExpr("run", "a AS node", "b AS other", "weight").unionByName(df.selectExpr("run", "b AS node", "a AS other", "weight"))
    degree = ends.groupBy("run", "node").agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "k")
    both = scratch.step(ends.join(degree, ["run", "node"]), "both")
    state = scratch.step(degree.selectExpr("*", "node AS c"), "state")
    to, moved = clusters._settle(both, state, sum(w for *_, w in pairs), 1.0, range(1), 0, scratch)
    member = {r.node: r.c for r in to.collect()}
    best = quality(pairs, member)
    assert moved and best > 0
    for v in member:
        for c in {member[b if a == v else a] for a, b, _ in pairs if v in (a, b)}:
            assert quality(pairs, member | {v: c}) <= best + 1e-9


def test_self_pairs_and_no_pairs(spark):
    pairs = spark.createDataFrame([(1, 1, 5.0), (2, 3, 1.0)], "a long, b long, weight double")
    got = {r.gid: r.community for r in clusters.louvain(pairs, Scratch(spark)).collect()}
    assert got[2] == got[3] != got[1]
    assert clusters.louvain(pairs.limit(0), Scratch(spark)).count() == 0


def test_sweeps_leave_no_tables(spark, tmp_path):
    """What stays of a call is the result's table, whatever the number of sweeps."""
    scratch = Scratch(spark)
    scratch.root = f"file://{tmp_path}/scratch"
    clusters.louvain(spark.createDataFrame(graph_of(4, n=40), "a long, b long, weight double"), scratch, runs=2)
    left = [x.name for x in (tmp_path / "scratch").iterdir()]
    assert left and not [x for x in left if x.split("-", 1)[1] in ("sweep", "adjacent", "settled")]
