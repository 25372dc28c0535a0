"""Transfers as a stream: totals of pairs, daily partners, and the patterns of each node as its days close.

A day is one of UTC, as windows are. A day closes when the watermark has passed its end; what comes for it later is left out, as
are rows without a time, and each closed day is given once. A row without payer and payee counts nowhere but moves the watermark,
so a source that falls silent can close its last days with one. A null amount counts as 0.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import Config
from ..functions.cuts import importable

PATTERNS = "gid bigint, date date, fast_share double, first_lag int, burst_in bigint, burst_in_date date, burst_out bigint, burst_out_date date"
_int, _long, _double = T.IntegerType(), T.LongType(), T.DoubleType()
_KINDS = {
    "day": _int, "pools": T.ArrayType(_double), "moved": _double, "received": _double, "first_in": _int, "first_out": _int,
    "burst_in": _long, "burst_in_day": _int, "burst_out": _long, "burst_out_day": _int,
}
_STATE = T.StructType([T.StructField(name, kind) for name, kind in _KINDS.items()])


def utc_day(window: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(window["start"]) / 86400).cast("int"))


def edge_totals(transfers: DataFrame, delay: str = "3 days") -> DataFrame:
    """Per day and pair: money and transfers, kept until the watermark passes. transfers: (src, dst, ts, sum_kzt)."""
    days = transfers.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("day"), "src", "dst")
    return days.agg(F.sum("sum_kzt").alias("sum_kzt"), F.count("*").alias("n_tx")).select(utc_day(F.col("day")).alias("date"), "src", "dst", "sum_kzt", "n_tx")


def _by_day(transfers: DataFrame, delay: str) -> DataFrame:
    """(day, gid, payers, in_kzt, payees, out_kzt) of closed days.

    The partners of a node are told apart by a group for each (day, node, partner), so those of a hub are spread over all tasks;
    only their counts meet.
    """
    # The time is part of each side: a filter on it can't be moved below the watermark, which would lose the rows that only move it.
    side = lambda gid, other, incoming: F.struct(F.col(gid).alias("gid"), F.col(other).alias("other"), F.lit(incoming).alias("incoming"), F.col("ts").alias("at"))
    sides = F.filter(F.array(side("dst", "src", True), side("src", "dst", False)), lambda x: x["gid"].isNotNull() & x["at"].isNotNull())
    rows = transfers.withWatermark("ts", delay).select("ts", F.coalesce("sum_kzt", F.lit(0.0)).alias("sum_kzt"), F.explode(sides).alias("s"))
    rows = rows.select("ts", "sum_kzt", "s.gid", "s.other", "s.incoming")
    each = rows.groupBy(F.window("ts", "1 day").alias("w"), "gid", "other", "incoming").agg(F.sum("sum_kzt").alias("sum_kzt"))
    known = F.col("other").isNotNull()
    of = lambda x, incoming: F.when(F.col("incoming") if incoming else ~F.col("incoming"), x)
    return each.groupBy(F.window(F.window_time("w"), "1 day").alias("day"), "gid").agg(
        F.count(of(F.when(known, 1), True)).alias("payers"), F.coalesce(F.sum(of(F.col("sum_kzt"), True)), F.lit(0.0)).alias("in_kzt"),
        F.count(of(F.when(known, 1), False)).alias("payees"), F.coalesce(F.sum(of(F.col("sum_kzt"), False)), F.lit(0.0)).alias("out_kzt"),
    )


def daily_partners(transfers: DataFrame, delay: str = "3 days") -> DataFrame:
    """(date, gid, payers, in_kzt, payees, out_kzt): different partners and money of each node on each closed day, exactly."""
    return _by_day(transfers, delay).select(utc_day(F.col("day")).alias("date"), "gid", "payers", "in_kzt", "payees", "out_kzt")


class _NodePatterns(StatefulProcessor):
    """A node's days in order. Kept are the amounts of the last days that later outflow may still use, sums and maxima."""

    def __init__(self, lag: int):
        self.lag = lag

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  names that Spark calls
        was = self.kept.get() if self.kept.exists() else (None, [0.0] * (self.lag + 1), 0.0, 0.0, None, None, 0, None, 0, None)
        last, pools, moved, received, first_in, first_out, most_in, most_in_day, most_out, most_out_day = was
        for day, payers, come, payees, gone in sorted((r["d"], r["payers"], r["in_kzt"], r["payees"], r["out_kzt"]) for r in rows):
            gap = day - last if last is not None else self.lag + 1
            pools = ([0.0] * gap + list(pools))[: self.lag + 1]  # one place older a day
            pools[0] = come
            received += come
            first_out = day if first_out is None and gone > 0 else first_out
            for age in range(self.lag, -1, -1):  # oldest money goes first
                used = min(pools[age], gone)
                pools[age], gone, moved = pools[age] - used, gone - used, moved + used
            last = day
            first_in = day if first_in is None and come > 0 else first_in
            if payers > most_in:
                most_in, most_in_day = payers, day
            if payees > most_out:
                most_out, most_out_day = payees, day
        self.kept.update((last, pools, moved, received, first_in, first_out, most_in, most_in_day, most_out, most_out_day))
        both = first_in is not None and first_out is not None
        yield Row(
            gid=key[0], date=_date(last), fast_share=moved / received if both and received > 0 else None, first_lag=first_out - first_in if both else None,
            burst_in=most_in, burst_in_date=_date(most_in_day), burst_out=most_out, burst_out_date=_date(most_out_day),
        )

    def close(self) -> None:
        pass


def _date(day: int | None) -> dt.date | None:
    return None if day is None else dt.date(1970, 1, 1) + dt.timedelta(days=day)


def node_patterns(transfers: DataFrame, cfg: Config, delay: str = "3 days") -> DataFrame:
    """PATTERNS of each node after its last closed day, given anew whenever days of it close (update with `latest`).

    fast_share and first_lag are those of `temporal.fast_share`, the bursts those of `temporal.bursts`, over all closed days; a node
    that lacks one side has null for the former. Days reach a node once and in order, as the aggregation gives each when it closes,
    so the state of a node is one row of fixed size. It needs the RocksDB state store, which `run` sets.
    """
    importable(transfers.sparkSession)
    days = _by_day(transfers, delay).select("gid", F.unix_date(utc_day(F.col("day"))).alias("d"), "payers", "in_kzt", "payees", "out_kzt")
    return days.groupBy("gid").transformWithState(_NodePatterns(cfg.fast_lag_days), PATTERNS, "Append", "None")


def latest(patterns: DataFrame) -> DataFrame:
    """One row a node of the written rows of `node_patterns`: the last one."""
    rest = [c for c in patterns.columns if c != "gid"]
    return patterns.groupBy("gid").agg(F.max_by(F.struct(*rest), "date").alias("x")).select("gid", *(F.col(f"x.{c}").alias(c) for c in rest))


def run(rows: DataFrame, path: str, state: str) -> None:
    """Takes in what the source has now and appends the rows that this closes to the table at path; goes on from `state` when called again."""
    conf, kind = rows.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(kind, None)
    conf.set(kind, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start()
    finally:
        conf.unset(kind) if before is None else conf.set(kind, before)
    query.awaitTermination()
