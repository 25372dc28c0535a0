"""Order statistics by ranges against numpy, on ties, nulls, hot groups and empty tables."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import order
from ledgerlens.functions.cuts import Scratch
from ledgerlens.operators.temporal import robust_z


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = [(None if g == 3 else g, rng.choice([rng.random(), 0.5, 1.0, -2.0])) for g in (0, 0, 0, 1, 3) for _ in range(400)]
    return out + [(2, 7.5), (4, None), (5, 1.0), (5, 2.0), (0, None)]


def by_group(rows):
    out = defaultdict(list)
    for g, x in rows:
        if x is not None:
            out[g].append(x)
    return out


def test_quantiles(spark, rows):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "g int, x double")
        asked = {"low": 0.0, "q1": 0.25, "median": 0.5, "q99": 0.99, "high": 1.0}
        got = {r.g: tuple(r[1:]) for r in order.quantiles(df, ["g"], "x", asked, Scratch(spark)).collect()}
        want = {g: tuple(np.quantile(x, list(asked.values()))) for g, x in by_group(rows).items()}
        assert set(got) == set(want) and all(got[g] == pytest.approx(want[g], abs=1e-12) for g in want)
        values = [x for _, x in rows if x is not None]
        assert tuple(order.quantiles(df, [], "x", asked, Scratch(spark)).first()) == pytest.approx(tuple(np.quantile(values, list(asked.values()))), abs=1e-12)
        assert order.quantiles(df.filter("false"), ["g"], "x", asked, Scratch(spark)).count() == 0 == order.quantiles(df.filter("x is null"), [], "x", asked, Scratch(spark)).count()
        mad = {r.g: (r.median, r.mad) for r in order.median_and_mad(df, ["g"], "x", Scratch(spark)).collect()}
        assert all(mad[g] == pytest.approx((np.median(x), np.median(np.abs(np.array(x) - np.median(x)))), abs=1e-12) for g, x in by_group(rows).items())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_only_ranges_with_a_wanted_rank_are_read(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(10_000).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 10_007).alias("x"))
        counts, ranges = order.ranked_ranges(df, ["g"], "x", Scratch(spark))
        assert ranges.count() > 2
        found = order.at_ranks(counts, ranges, ["g"], spark.createDataFrame([(1, 0), (1, 9_999)], "g int, rank long"))
        everything = sorted(r.x for r in df.collect())
        assert {(r["rank"], r.value) for r in found.collect()} == {(0, everything[0]), (9_999, everything[-1])}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[p#\d+ IN \(\d+,\d+\)", plan)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_robust_z(spark, rows):
    df = spark.createDataFrame([(g, x, 2.0) for g, x in rows if x is not None], "g int, x double, same double")
    got = robust_z(df, "g", {"x": "zx", "same": "zs"}, Scratch(spark))
    assert got.columns == ["g", "x", "same", "zx", "zs"] and got.count() == df.count()
    groups = by_group(rows)
    for r in got.collect():
        x = np.array(groups[r.g])
        mad = np.median(np.abs(x - np.median(x)))
        assert r.zs == 0 and r.zx == pytest.approx(0.6745 * (r.x - np.median(x)) / mad if mad else 0.0, abs=1e-12)
