"""Temporal operators, scalars, roles and sinks on small tables."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.config import Config, EVENTS
from ledgerlens.functions import scalars as S
from ledgerlens.functions.cuts import Scratch, average_rank, numbered
from ledgerlens.operators import lookup, priority, roles, temporal
from ledgerlens.plans.analysis import Analysis
from ledgerlens.sources import network, sinks

DAY = dt.date(2024, 1, 1)
CFG = Config(period_end="2024-01-30")


def transfers(spark, rows):
    return spark.createDataFrame([(a, b, DAY + dt.timedelta(days=d), float(m)) for a, b, d, m in rows], "src long, dst long, date date, sum_kzt double")


def fifo(rows, node, lag=2):
    """Pool of single inflows, oldest first."""
    events = sorted([(d, 0, m) for a, b, d, m in rows if b == node] + [(d, 1, m) for a, b, d, m in rows if a == node])
    pool, fast = [], 0.0
    for d, kind, m in events:
        if not kind:
            pool.append([d, m])
            continue
        for p in pool:
            if 0 <= d - p[0] <= lag:
                take = min(p[1], m)
                p[1] -= take
                m -= take
                fast += take
    return fast / sum(m for a, b, d, m in rows if b == node)


def test_fast_share_by_hand(spark):
    rows = [(1, 2, 1, 100), (2, 3, 1, 30), (2, 3, 3, 40), (2, 3, 4, 50)]
    got = temporal.fast_share(transfers(spark, rows), CFG).collect()
    assert [(r.gid, round(r.fast_share, 9), r.first_lag) for r in got] == [(2, 0.7, 0)]


def test_fast_share_random(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(6), rng.randrange(6), rng.randrange(12), rng.randrange(1, 50)) for _ in range(200)]
    rows = [r for r in rows if r[0] != r[1]]
    for r in temporal.fast_share(transfers(spark, rows), CFG).collect():
        assert r.fast_share == pytest.approx(fifo(rows, r.gid))


def test_bursts_take_the_first_of_tied_days(spark):
    r = temporal.bursts(transfers(spark, [(1, 9, 5, 10), (2, 9, 5, 10), (3, 9, 2, 10), (4, 9, 2, 10)])).filter("gid = 9").first()
    assert (r.burst_in, r.burst_in_date, r.burst_out) == (2, DAY + dt.timedelta(days=2), 0)


def test_routes_count_equal_amounts_of_a_day_once(spark):
    rows = [(1, 2, 0, 10), (1, 2, 0, 10), (2, 3, 1, 7), (1, 2, 5, 10), (2, 3, 8, 9), (2, 3, 7, 9)]
    r = temporal.routes(transfers(spark, rows), CFG).collect()
    assert [(x.a, x.b, x.c, x.n_dates, x.sum_in, x.sum_out) for x in r] == [(1, 2, 3, 2, 20.0, 16.0)]


def test_ranks(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, 1.0, 3.0, 2.0])], "id int, v double")
    assert [r.r for r in average_rank(df, "v", Scratch(spark), "r").orderBy("id").collect()] == [3.5, 1.0, 3.5, 2.0]
    assert [r.n for r in numbered(df, [F.desc("v"), F.asc("id")], Scratch(spark), "n").orderBy("id").collect()] == [1, 4, 2, 3]


def test_texts(spark):
    row = spark.range(1).select(
        S.money(F.lit(1_234_567.0)).alias("a"), S.money(F.lit(45_400.0)).alias("b"), S.times(F.lit(2.26)).alias("c"), S.percent(F.lit(0.123)).alias("d"),
        roles.payees(F.lit(21)).alias("e"), roles.payees(F.lit(12)).alias("f"), roles.transfers(F.lit(3)).alias("g"), S.rnd(F.lit(0.575), 2).alias("h"),
        S.clip_text(F.lit("a" * 150 + "; " + "b" * 60 + "; c")).alias("i"), S.clip_text(F.lit("x" * 300)).alias("j"), S.short_id(F.lit(123456789012345678)).alias("k"),
    ).first()
    assert row.asDict() == {"a": "1,23 млн ₸", "b": "45 тыс ₸", "c": "2,3×", "d": "12%", "e": "21 получателю", "f": "12 получателям", "g": "3 перевода", "h": 0.57, "i": "a" * 150, "j": "x" * 199 + "…", "k": "…9012345678"}


def test_levels(spark):
    got = spark.createDataFrame([(0.8, 50), (0.7, 51), (0.1, 999)], "s double, r int").select(priority.confidence_label(F.col("s")), priority.priority_label(F.col("r"))).collect()
    assert [tuple(r) for r in got] == [("сильно", "высокий"), ("умеренно", "средний"), ("слабо", "низкий")]


BASE = dict(gid=1, is_seed=False, truncated=False, in_deg=0, out_deg=0, in_kzt=0.0, out_kzt=0.0, in_tx=0, out_tx=0, avg_in=0.0, avg_out=0.0, seed_in=0, seed_out=0, betweenness=0.0, p_forward=0.0, fast_share=None, late_in_share=0.0, burst_in=0, burst_out=0, span=0, activity=0.4)
LADDER = [
    (dict(in_deg=8, out_deg=20, in_kzt=1e5, out_kzt=1e5), "coordinator", 0.5, "not_sink"),
    (dict(in_deg=7, out_deg=20, in_kzt=1e5, out_kzt=1e5), "consolidator", 0.636, "not_sink"),
    (dict(seed_out=3, out_deg=3, out_kzt=1e5), "coordinator", 0.5, "not_sink"),
    (dict(out_deg=10, out_kzt=1e5), "distributor", 0.5, "not_sink"),
    (dict(in_deg=4, in_kzt=1e5, in_tx=4), "consolidator", 0.5, "confirmed_sink"),
    (dict(in_deg=4, in_kzt=1e5, in_tx=4, truncated=True), "consolidator", 0.5, "truncated_depth"),
    (dict(in_deg=1, in_kzt=2e4, in_tx=1, truncated=True), "peripheral", 0.6, "truncated_depth"),
    (dict(in_deg=1, in_kzt=4e4, in_tx=1, truncated=True, p_forward=0.3), "terminal", 0.7, "truncated_depth"),
    (dict(in_deg=1, in_kzt=4e4, in_tx=1, truncated=True, p_forward=0.7), "transit", 0.6, "truncated_depth"),
    (dict(is_seed=True, out_deg=1, out_kzt=3e4), "transit", 0.5, "not_sink"),
    (dict(in_deg=1, out_deg=1, in_kzt=1e5, out_kzt=1e5), "transit", 0.8, "not_sink"),
    (dict(in_deg=1, in_kzt=1e6, in_tx=1), "terminal", 1.0, "confirmed_sink"),
    (dict(in_deg=1, in_kzt=1e6, in_tx=1, late_in_share=0.5), "terminal", 0.6, "truncated_time"),
    (dict(), "peripheral", 1.0, "no_data"),
    (dict(in_deg=1, in_kzt=1e4, in_tx=1), "peripheral", 0.6, "confirmed_sink"),
    (dict(in_deg=1, out_deg=1, in_kzt=1e5, out_kzt=3e4, in_tx=1), "peripheral", 0.6, "not_sink"),
]


def test_role_ladder(spark):
    types = "gid long, is_seed boolean, truncated boolean, in_deg long, out_deg long, in_kzt double, out_kzt double, in_tx long, out_tx long, avg_in double, avg_out double, seed_in long, seed_out long, betweenness double, p_forward double, fast_share double, late_in_share double, burst_in long, burst_out long, span long, activity double"
    df = spark.createDataFrame([tuple((BASE | x | {"gid": i}).values()) for i, (x, *_) in enumerate(LADDER)], types)
    df = df.selectExpr("*", "CASE WHEN in_kzt > 0 THEN out_kzt / in_kzt ELSE double('inf') END AS ratio", "coalesce(fast_share, 0D) AS fast", "late_in_share >= 0.5 AND in_deg > 0 AS late", "1D AS btw_cut", "'' AS burst_in_day", "'' AS burst_out_day")
    got = df.withColumn("d", roles.decide(CFG)).select("gid", "d.*").orderBy("gid").collect()
    assert [(r.role, r.role_score, r.sink_status) for r in got] == [tuple(x[1:]) for x in LADDER]
    assert all(r.evidence and len(r.evidence) <= 200 and any(c.isdigit() for c in r.evidence) for r in got)


def test_load_check_and_whole_run(spark, tmp_path):
    rng = random.Random(9)
    rows = sorted({(rng.randrange(30), rng.randrange(30), rng.randrange(28), rng.randrange(5, 90) * 1000) for _ in range(160)})
    tx = transfers(spark, [r for r in rows if r[0] != r[1]])
    seeds = spark.createDataFrame([(0,), (1,)], "gid long")
    nodes = network.depths(tx.select("src", "dst").distinct(), seeds, 4, Scratch(spark)).selectExpr("gid", "depth", "depth = 0 AS is_seed")
    nodes = nodes.unionByName(spark.createDataFrame([(99, 0, True)], "gid long, depth int, is_seed boolean"))
    tx = tx.join(nodes.filter("depth <= 3").selectExpr("gid AS src"), "src", "left_semi")
    edges = network.edges_of(tx).withColumn("depth", F.lit(1).cast("byte"))
    for name, df in (("nodes", nodes), ("edges", edges), ("transactions", tx)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    net = network.load(spark, str(tmp_path))
    assert {r.rule: r.n_violations for r in network.check(net).collect()} == {"pair_only_on_one_side": 0, "sum_differs": 0, "count_differs": 0, "gid_repeated": 0, "edge_end_unknown": 0, "node_without_edge": 1}
    a = Analysis(net, EVENTS)
    assert {r.rule for r in a.write(f"{tmp_path}/out").collect() if r.n_violations} == set()
    scored = {r.gid: r for r in a.scored.collect()}
    assert scored[99].role == "peripheral" and scored[99].sink_status == "no_data" and scored[99].cluster_id == 0
    assert sorted(r["rank"] for r in scored.values()) == list(range(1, len(scored) + 1))
    assert all(r.role_score <= 0.6 for r in scored.values() if r.is_seed and r.role == "transit")
    assert all(("rapid movement" in r.typology) == ("fast_transit" in r.flags) for r in scored.values())
    back = sinks.read_csv(spark, f"{tmp_path}/out/nodes_roles", a._keep(sinks.nodes_roles(a.scored), "x").selectExpr("*").schema.simpleString()[7:-1].replace(":", " "))
    assert back.count() == len(scored)
    assert all(len(r.why) > 50 for r in a.top_nodes.collect())


def test_resolve_tiers(spark):
    df = spark.createDataFrame([(12345, 1), (99945, 2), (45, 3), (94501, 4)], "gid long, rank int")
    ids = lambda q: sorted(r.gid for r in lookup.resolve(df, q).collect())
    assert (ids("45"), ids("x345"), ids("450"), ids("abc"), ids("777")) == ([45], [12345], [94501], [], [])


def test_ids_in_text(spark):
    df = spark.createDataFrame([("узел 100000000000000001 и …4567, ещё 4567 и 12",)], "text string")
    assert lookup.ids_in(df).first().ids == ["100000000000000001", "4567"]
