"""Lookups: order, limits, totals, dates of partners, and calls by name."""

from __future__ import annotations

import datetime
import json
from types import SimpleNamespace

import pytest

from ledgerlens.functions.cuts import Scratch
from ledgerlens.operators import lookup


@pytest.fixture(scope="module")
def a(spark):
    day = lambda k: datetime.date(2024, 1, k)
    transfers = [(1, 2, day(3), 10.0), (1, 2, day(1), 5.0), (1, 3, day(2), 40.0), (3, 2, day(2), 20.0), (2, 4, day(4), 7.0), (3, 4, day(5), 9.0)]
    transactions = spark.createDataFrame(transfers, "src long, dst long, date date, sum_kzt double")
    edges = spark.createDataFrame([(1, 2, 15.0, 2), (1, 3, 40.0, 1), (3, 2, 20.0, 1), (2, 4, 7.0, 1), (3, 4, 9.0, 1)], "src long, dst long, sum_kzt double, n_tx long")
    scored = spark.createDataFrame([(g, "transit" if g < 3 else "terminal", 1, g, 1.0 / g) for g in range(1, 5)], "gid long, role string, cluster_id int, rank int, priority_score double")
    clusters = spark.createDataFrame([(1, 4, 1, "why")], "cluster_id int, n_nodes long, n_seed long, hypothesis string")
    return SimpleNamespace(net=SimpleNamespace(edges=edges, transactions=transactions), scored=scored, cluster_table=clusters, scratch=Scratch(spark))


def test_partners_have_dates_and_order(a):
    got = [tuple(r) for r in lookup.partners(a.net.transactions, 2).collect()]
    day = lambda k: datetime.date(2024, 1, k)
    assert got == [(3, "in", 20.0, 1, day(2), day(2)), (1, "in", 15.0, 2, day(1), day(3)), (4, "out", 7.0, 1, day(4), day(4))]
    assert [r.gid for r in lookup.partners(a.net.transactions, 2, "in", 1).collect()] == [3]


def test_paths_by_bottleneck(a):
    got = [(r.nodes, r.bottleneck_kzt) for r in lookup.ranked_paths(a.net.edges, 1, 4, 4, a.scratch).collect()]
    assert got == [([1, 3, 4], 9.0), ([1, 2, 4], 7.0), ([1, 3, 2, 4], 7.0)]
    assert lookup.ranked_paths(a.net.edges, 1, 4, 4, a.scratch, 1).count() == 1


def test_calls_by_name(a):
    ask = lambda name, **given: json.loads(lookup.call(a, name, given))
    found = ask("get_node", gid=2)
    assert found["gid"] == 2 and [p["gid"] for p in found["top_payers"]] == [3, 1] and found["hypothesis"] == "why"
    assert ask("neighbors", gid=1, limit=1) == {"total": 2, "rows": [{"gid": 3, "direction": "out", "sum_kzt": 40.0, "n_tx": 1, "first": "2024-01-02", "last": "2024-01-02", "role": "terminal", "priority_score": 1 / 3}]}
    assert ask("top_nodes", role="transit", n=1)["total"] == 2 and ask("cluster_summary", cluster_id=1)["n_nodes"] == 4
    common = ask("common_counterparties", gids=[1, 3], max_hops=1)["rows"]
    assert [r["gid"] for r in common] == [2] and common[0]["n_linked"] == 2
    assert ask("get_node", gid=99)["error"] == "not_found" and ask("nothing")["error"] == "unknown_tool"
    assert ask("get_node")["error"] == "bad_arguments" and ask("neighbors", gid="x")["error"] == "bad_arguments" and ask("neighbors", gid=1, direction="up")["error"] == "bad_arguments"
