"""Communities by blocks of nodes: few jobs a level, no gain left with many blocks, a run by itself as among others."""

from __future__ import annotations

from ledgerlens.functions.cuts import Scratch
from ledgerlens.operators import clusters

from test_communities import graph_of, one_at_a_time, quality


class Counting(Scratch):
    def __init__(self, spark):
        super().__init__(spark)
        self.names = []

    def write(self, df, name, **how):
        self.names.append(name)
        return super().write(df, name, **how)


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long, weight double")


def test_a_level_is_one_job_where_the_graph_is_one_block(spark):
    scratch = Counting(spark)
    clusters.louvain(frame(spark, graph_of(1)), scratch, runs=3)
    assert scratch.names.count("sweep") == scratch.names.count("settled") < 8


def test_no_gain_is_left_with_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 60)
    pairs = graph_of(5, n=60, across=0.15)
    scratch = Scratch(spark)
    df = spark.createDataFrame([(0, a, b, w) for a, b, w in pairs], "run int, a long, b long, weight double")
    ends = df.selectExpr("run", "a AS node", "b AS other", "weight").unionByName(df.selectExpr("run", "b AS node", "a AS other", "weight"))
    state = scratch.step(ends.groupBy("run", "node").agg({"weight": "sum"}).selectExpr("run", "node", "`sum(weight)` AS k", "node AS c"), "state")
    to, moved = clusters._settle(scratch.step(ends, "both"), state, sum(w for *_, w in pairs), 1.0, range(1), 0, scratch)
    member = {r.node: r.c for r in to.collect()}
    best = quality(pairs, member)
    assert moved and best > 0 and len(member) == 60
    for v in member:
        for c in {member[b if a == v else a] for a, b, _ in pairs if v in (a, b)}:
            assert quality(pairs, member | {v: c}) <= best + 1e-9


def test_many_blocks_are_as_good_and_a_run_is_the_same_alone(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 200)
    pairs = graph_of(2, across=0.1)
    among = {(r.run, r.gid): r.community for r in clusters.louvain(frame(spark, pairs), Scratch(spark), runs=2).collect()}
    alone = {(r.run, r.gid): r.community for r in clusters.louvain(frame(spark, pairs), Scratch(spark), runs=1, first=1).collect()}
    assert alone == {x: c for x, c in among.items() if x[0] == 1}
    want = quality(pairs, one_at_a_time(pairs))
    for run in range(2):
        assert quality(pairs, {g: c for (r, g), c in among.items() if r == run}) >= want - 0.03
