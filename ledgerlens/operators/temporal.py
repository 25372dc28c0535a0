"""Patterns over the dates of transfers. The grain is a day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.cuts import Scratch
from ..functions.order import median_and_mad


def fast_share(tx: DataFrame, cfg: Config) -> DataFrame:
    """(gid, fast_share, first_lag) of nodes that both receive and send.

    Outflow consumes inflow of the last fast_lag_days days, oldest first, same-day inflow included. Only fast_lag_days + 1
    daily amounts can still be consumed, so the state is that many numbers; a node's series has at most one entry a day.
    """
    lag = cfg.fast_lag_days
    side = lambda key, name: tx.groupBy(F.col(key).alias("gid"), "date").agg(F.sum("sum_kzt").alias(name))
    days = side("dst", "i").withColumn("o", F.lit(0.0)).unionByName(side("src", "o").withColumn("i", F.lit(0.0)).select("gid", "date", "i", "o"))
    days = days.groupBy("gid", "date").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    series = days.groupBy("gid").agg(
        F.sort_array(F.collect_list(F.struct(F.unix_date("date").alias("d"), "i", "o"))).alias("s"),
        F.sum("i").alias("total"), F.min(F.when(F.col("i") > 0, F.col("date"))).alias("fi"), F.min(F.when(F.col("o") > 0, F.col("date"))).alias("fo"),
    ).filter("fi is not null and fo is not null")

    def step(acc, x):
        gap = x["d"] - acc["d"]
        pool = [x["i"]]
        for age in range(1, lag + 1):
            held = F.lit(0.0)
            for shift in range(1, age + 1):
                held = F.when(gap == shift, acc["b"][age - shift]).otherwise(held)
            pool.append(held)
        left, new, older = x["o"], [], F.lit(0.0)
        for age in range(lag, -1, -1):
            use = F.least(pool[age], F.greatest(left - older, F.lit(0.0)))
            new.insert(0, pool[age] - use)
            older = older + pool[age]
        return F.struct(x["d"].alias("d"), F.array(*new).alias("b"), (acc["f"] + F.least(left, older)).alias("f"))

    start = F.struct(F.lit(-(10**6)).alias("d"), F.array(*[F.lit(0.0)] * (lag + 1)).alias("b"), F.lit(0.0).alias("f"))
    moved = F.aggregate("s", start, step, lambda acc: acc["f"])
    return series.select("gid", F.when(F.col("total") > 0, moved / F.col("total")).alias("fast_share"), F.datediff("fo", "fi").alias("first_lag"))


def late_share(tx: DataFrame, cfg: Config) -> DataFrame:
    """(gid, late_in_share): share of inflow in the last late_days days of the period."""
    late = F.col("date") >= F.date_sub(F.lit(cfg.period_end).cast("date"), cfg.late_days - 1)
    return tx.groupBy(F.col("dst").alias("gid")).agg(F.try_divide(F.coalesce(F.sum(F.when(late, F.col("sum_kzt"))), F.lit(0.0)), F.sum("sum_kzt")).alias("late_in_share"))


def bursts(tx: DataFrame) -> DataFrame:
    """(gid, burst_in, burst_in_date, burst_out, burst_out_date): most partners on one day, and the first such day."""
    def side(key: str, other: str, p: str) -> DataFrame:
        daily = tx.groupBy(F.col(key).alias("gid"), "date").agg(F.countDistinct(other).alias("n"))
        return daily.groupBy("gid").agg(F.max("n").alias(f"burst_{p}"), F.max_by("date", F.struct("n", -F.unix_date("date"))).alias(f"burst_{p}_date"))

    return side("dst", "src", "in").join(side("src", "dst", "out"), "gid", "full_outer").na.fill(0, ["burst_in", "burst_out"])


def repeat_amounts(tx: DataFrame, cfg: Config) -> DataFrame:
    """(gid, repeat_amount, repeat_amount_n): a payee's most frequent round amount from two payers or more; ties: smaller."""
    rows = tx.filter(F.col("sum_kzt") % 1000 == 0).groupBy(F.col("dst").alias("gid"), "sum_kzt").agg(F.count("*").alias("n"), F.countDistinct("src").alias("payers"))
    rows = rows.filter((F.col("n") >= cfg.repeat_amount_min) & (F.col("payers") >= 2))
    return rows.groupBy("gid").agg(F.max_by("sum_kzt", F.struct("n", -F.col("sum_kzt"))).alias("repeat_amount"), F.max("n").alias("repeat_amount_n"))


def active_days(tx: DataFrame) -> DataFrame:
    """(gid, active_days): days with a transfer on either side."""
    return tx.select(F.col("src").alias("gid"), "date").unionByName(tx.select(F.col("dst").alias("gid"), "date")).groupBy("gid").agg(F.countDistinct("date").alias("active_days"))


def routes(tx: DataFrame, cfg: Config) -> DataFrame:
    """Repeated routes a -> b -> c: b pays c within fast_lag_days of a's payment, on route_min_dates days or more.

    The lag is an equi-join: each first leg is repeated for the days on which the second may follow, so a hub's rows are
    spread over (hub, day). sum_in and sum_out count equal amounts of one day once.
    """
    first = tx.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("date").alias("d1"), F.col("sum_kzt").alias("s1")).distinct()
    first = first.withColumn("d2", F.explode(F.transform(F.sequence(F.lit(0), F.lit(cfg.fast_lag_days)), lambda k: F.date_add("d1", k))))
    second = tx.select(F.col("src").alias("b"), F.col("dst").alias("c"), F.col("date").alias("d2"), F.col("sum_kzt").alias("s2")).distinct()
    m = first.join(second, ["b", "d2"]).filter("a <> c")
    key = ["a", "b", "c"]
    dates = m.groupBy(*key).agg(F.countDistinct("d1").alias("n_dates"), F.min("d1").alias("first"), F.max("d2").alias("last")).filter(F.col("n_dates") >= cfg.route_min_dates)
    sum_in = m.select(*key, "d1", "s1").distinct().groupBy(*key).agg(F.sum("s1").alias("sum_in"))
    sum_out = m.select(*key, "d2", "s2").distinct().groupBy(*key).agg(F.sum("s2").alias("sum_out"))
    return dates.join(sum_in, key).join(sum_out, key)


def edge_lists(tx: DataFrame) -> DataFrame:
    """(src, dst, transfers): each pair's transfers by date."""
    return tx.groupBy("src", "dst").agg(F.sort_array(F.collect_list(F.struct("date", F.col("sum_kzt").alias("sum_kzt")))).alias("transfers"))


def node_temporal(tx: DataFrame, cfg: Config) -> DataFrame:
    out = fast_share(tx, cfg)
    for part in (late_share(tx, cfg), bursts(tx), repeat_amounts(tx, cfg), active_days(tx)):
        out = out.join(part, "gid", "full_outer")
    return out


def robust_z(df: DataFrame, group: str, names: dict[str, str], scratch: Scratch) -> DataFrame:
    """df with 0.6745 * (x - median) / MAD inside each group for the columns in names, under their new names; 0 where the MAD is 0.

    All columns go through one selection by ranges; no buffer holds a group.
    """
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("of"), F.col(c).alias("x")) for c in names))).alias("v")
    middle = median_and_mad(df.select(F.col(group).alias("__g"), each).select("__g", "v.*"), ["__g", "of"], "x", scratch)
    own = lambda c, x: F.max(F.when(F.col("of") == c, F.col(x))).alias(f"__{x}_{c}")
    wide = middle.groupBy("__g").agg(*(own(c, x) for c in names for x in ("median", "mad")))
    out = df.join(wide, F.col(group).eqNullSafe(F.col("__g")), "left").drop("__g")
    z = {new: F.when(F.col(f"__mad_{c}") > 0, F.lit(0.6745) * (F.col(c) - F.col(f"__median_{c}")) / F.col(f"__mad_{c}")).otherwise(0.0) for c, new in names.items()}
    return out.withColumns(z).drop(*(f"__{x}_{c}" for c in names for x in ("median", "mad")))
