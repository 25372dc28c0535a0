"""Streams against the batch: several files, late rows, restarts from the checkpoint."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.config import Config
from ledgerlens.operators import temporal
from ledgerlens.streaming import flows

SCHEMA = "src long, dst long, ts timestamp, sum_kzt double"


def when(day: int, hour: int = 0) -> dt.datetime:
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=day)


def transfers(seed: int, days: range, n: int) -> list[tuple]:
    draw = random.Random(seed)
    rows = [(draw.randrange(9), draw.randrange(9), when(draw.choice(days), draw.randrange(24)), float(draw.randrange(1, 50))) for _ in range(n)]
    return rows + rows[:5]


def put(spark, path, rows) -> None:
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")


def advance(spark, path, make, out: str):
    """Runs a stream over the new files, from its checkpoint, into a table; returns all that it has written so far."""
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    flows.run(make(source), f"{path}/{out}", f"{path}/{out}-state")
    return spark.read.parquet(f"{path}/{out}")


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("date", F.to_date("ts"))


def test_edge_totals_equal_the_batch(spark, tmp_path):
    rows = [(i % 5, i % 3 + 5, dt.datetime(2024, 1, 1 + i % 9, i % 24), float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = flows.edge_totals(stream).writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = df.groupBy(F.to_date("ts").alias("date"), "src", "dst").agg(F.sum("sum_kzt").alias("s"), F.count("*").alias("n"))
    assert sorted(map(tuple, spark.table("totals").collect())) == sorted(map(tuple, want.collect()))


def test_daily_partners_leave_out_what_is_late(spark, tmp_path):
    make = lambda s: flows.daily_partners(s, "2 days")
    first, second = transfers(1, range(0, 6), 60), transfers(2, range(8, 12), 40)
    put(spark, tmp_path, first)
    put(spark, tmp_path, second)
    advance(spark, tmp_path, make, "days")
    put(spark, tmp_path, [(1, 2, when(0), 1e6), (1, None, when(9), 7.0), (None, 1, when(9), None)])  # the first is late
    put(spark, tmp_path, [(None, None, when(40), None), (1, 2, None, 1e6)])
    found = {(r.date, r.gid): tuple(r)[2:] for r in advance(spark, tmp_path, make, "days").collect()}
    want: dict = {}
    for s, d, t, x in first + second + [(1, None, when(9), 7.0), (None, 1, when(9), 0.0)]:
        for gid, other, side in ((d, s, 0), (s, d, 1)):
            if gid is not None:
                sums = want.setdefault((t.date(), gid), ([set(), 0.0], [set(), 0.0]))
                sums[side][0].add(other)
                sums[side][1] += x
    assert found == {k: (len(i - {None}), a, len(o - {None}), b) for k, ((i, a), (o, b)) in want.items()}


def test_patterns_equal_the_batch_after_restarts(spark, tmp_path):
    cfg = Config()
    make = lambda s: flows.node_patterns(s, cfg, "2 days")
    parts = [transfers(k, range(6 * k, 6 * k + 6), 45) for k in range(3)]
    parts[1] = [r for r in parts[1] if r[0] != 4 and r[1] != 4]  # a node that is silent for a while
    parts[2] += [(100, 101, when(13), 5.0)]  # one side only
    sent = []
    for k, rows in enumerate(parts):
        put(spark, tmp_path, rows)
        put(spark, tmp_path, [(None, None, when(6 * k + 8), None)])  # closes the part's days
        sent += rows
        check(spark, cfg, sent, advance(spark, tmp_path, make, "patterns"))
    again = flows.latest(spark.read.parquet(f"{tmp_path}/patterns")).count()
    put(spark, tmp_path, [(1, 2, when(3), 1e6)])  # late
    assert flows.latest(advance(spark, tmp_path, make, "patterns")).count() == again
    check(spark, cfg, sent, spark.read.parquet(f"{tmp_path}/patterns"))


def check(spark, cfg, sent, written) -> None:
    found = {r.gid: r for r in flows.latest(written).collect()}
    tx = batch(spark, sent)
    fast, burst = ({r.gid: r for r in df.collect()} for df in (temporal.fast_share(tx, cfg), temporal.bursts(tx)))
    assert found.keys() == burst.keys()
    for gid, r in found.items():
        assert all(r[c] == burst[gid][c] for c in ("burst_in", "burst_in_date", "burst_out", "burst_out_date"))
        if gid in fast:
            assert r.fast_share == pytest.approx(fast[gid].fast_share) and r.first_lag == fast[gid].first_lag
        else:
            assert r.fast_share is None and r.first_lag is None
