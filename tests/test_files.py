"""Written files, read again and checked; the shortest path by brute force."""

from __future__ import annotations

import itertools

from ledgerlens.functions.cuts import Scratch
from ledgerlens.operators import graph
from ledgerlens.sources import sinks


def test_written_tables_come_back(spark, tmp_path):
    df = spark.createDataFrame([(10**17 + 1, 0.1 + 0.2, 'a "b",\\ c', True, 1), (2, 0.5, "", False, 2)], "gid long, p double, t string, s boolean, rank int")
    path = f"file://{tmp_path}/t"
    sinks.write_csv(df, path, ["rank"])
    assert sorted(sinks.written(spark, path, df).collect()) == sorted(df.collect())
    found = lambda like: sinks.headers(spark, {path: like}).first()["n_violations"]
    assert found(df) == 0 and found(df.withColumnRenamed("p", "q")) > 0 and found(df.select("p", "gid", "t", "s", "rank")) > 0 and found(df.drop("rank")) > 0


def test_shortest_path(spark):
    rows = [(1, 2), (2, 3), (3, 6), (1, 4), (4, 5), (5, 6), (6, 7), (7, 1), (8, 8), (2, 2), (9, 1)]
    edges, scratch = spark.createDataFrame(rows, "src long, dst long"), Scratch(spark)
    have = set(rows)
    for src, dst in [(1, 7), (1, 6), (7, 2), (1, 1), (8, 1), (3, 9)]:
        want = None
        for n in range(1, 8):
            ways = [p for p in itertools.permutations(range(1, 10), n) if p[0] == src and p[-1] == dst and all(e in have for e in zip(p, p[1:]))]
            if ways:
                want = min(ways, key=lambda p: p[::-1])
                break
        got = graph.shortest_path(edges, src, dst, scratch).collect()
        assert [tuple(r.nodes) for r in got] == ([want] if want else []) and all(r.n_hops == len(r.nodes) - 1 for r in got)
