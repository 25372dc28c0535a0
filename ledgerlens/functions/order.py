"""Exact order statistics by ranges: no task and no buffer holds the values of a group.

Equal values are counted, the counts are cut into ranges by group and value, and the ranges' sums say which of them hold the
wanted ranks. Only those ranges are read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cuts import Scratch


def ranked_ranges(df: DataFrame, by: list[str], value: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Counts of the values of df in the order of (by, value), stored in folders by range `p`, and the place of each range.

    The first table is (by, value, n, p), the second (by, p, low, high): the values of a group in a range have the 0-based ranks
    low..high. Null values don't count. A group with a third of all rows spreads over as many ranges as its different values need.
    """
    kept = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    counts = scratch.write(kept.repartitionByRange(*by, "value").withColumn("p", F.spark_partition_id()), "counts", by=["p"])
    sums = counts.groupBy(*by, "p").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("p"))  # one row a range
    return counts, sums.select(*by, "p", (upto - F.col("n")).alias("low"), (upto - 1).alias("high"))


def at_ranks(counts: DataFrame, ranges: DataFrame, by: list[str], wanted: DataFrame) -> DataFrame:
    """(by, rank, value) of the wanted ranks (by, rank), which lie inside their groups.

    The driver gets the numbers of the ranges that hold a rank, and only their folders are read; the running sums are over one
    range each.
    """
    inside = F.col("w.rank").between(F.col("r.low"), F.col("r.high"))
    for c in by:
        inside = inside & F.col(f"w.{c}").eqNullSafe(F.col(f"r.{c}"))
    held = (wanted.alias("w") if by else F.broadcast(wanted).alias("w")).join(ranges.alias("r"), inside)  # without groups, two ranks a probability
    held = held.select(*(F.col(f"r.{c}").alias(f"__{c}") for c in by), "rank", F.col("r.p").alias("__p"), "low")
    upto = F.sum("n").over(Window.partitionBy("p", *by).orderBy("value"))
    read = counts.filter(F.col("p").isin([r["__p"] for r in held.select("__p").distinct().collect()])).withColumn("upto", upto)
    on = (F.col("p") == F.col("__p")) & F.col("rank").between(F.col("low") + F.col("upto") - F.col("n"), F.col("low") + F.col("upto") - 1)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return read.join(held, on).select(*by, "rank", "value")


def quantiles(df: DataFrame, by: list[str], value: str, probabilities: dict[str, float], scratch: Scratch) -> DataFrame:
    """One row a group (by) with a column for each of the named probabilities: exact quantiles, linear between the two next ranks.

    Groups may be null; a group without values has no row, nor has an empty table. NaN counts as the largest value.
    """
    counts, ranges = ranked_ranges(df, by, value, scratch)
    sizes = ranges.groupBy(*by).agg((F.max("high") + 1).alias("size")).filter("size > 0")
    ranks = {}
    for name, p in probabilities.items():
        place = F.lit(float(p)) * (F.col("size") - 1)
        ranks |= {f"__{name}": place, f"__{name}_0": F.floor(place), f"__{name}_1": F.ceil(place)}
    asked = sizes.withColumns(ranks)
    wanted = asked.select(*by, F.explode(F.array(*(F.col(f"__{name}_{k}") for name in probabilities for k in (0, 1)))).alias("rank")).distinct()
    found = at_ranks(counts, ranges, by, wanted).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", F.col("value").cast("double")))).alias("at"))  # two ranks a probability
    found = found.select(*(F.col(c).alias(f"__{c}") for c in by), "at")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))

    def exact(name: str):
        low, high = (F.col("at")[F.col(f"__{name}_{k}")] for k in (0, 1))
        return F.when(low == high, low).otherwise(low + (high - low) * (F.col(f"__{name}") - F.col(f"__{name}_0"))).alias(name)

    return (asked.join(found, same) if by else asked.crossJoin(found)).select(*by, *map(exact, probabilities))  # one row each without groups


def median_and_mad(df: DataFrame, by: list[str], value: str, scratch: Scratch) -> DataFrame:
    """(by, median, mad): the median of each group and the median of the distances from it."""
    middle = scratch.write(quantiles(df, by, value, {"median": 0.5}, scratch), "median")
    other = middle.select(*(F.col(c).alias(f"__{c}") for c in by), "median")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    away = df.join(other, same).select(*by, F.abs(F.col(value) - F.col("median")).alias("away"))
    return quantiles(away, by, "away", {"mad": 0.5}, scratch).select(*(F.col(c).alias(f"__{c}") for c in by), "mad").join(middle, same).select(*by, "median", "mad")
