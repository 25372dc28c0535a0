"""The summary of a run: one row of counts that were taken while the tables were written, and measures of the models."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import rnd
from ..operators import clusters, forward, priority
from ..sources import sinks

if TYPE_CHECKING:
    from .analysis import Analysis


def counts(a: Analysis) -> dict[str, int]:
    """What a write observes, taken by reading the tables instead."""
    rows = (a.scored.agg(*sinks.named(sinks.node_counts())), a.cluster_table.agg(*sinks.named(sinks.cluster_counts())), a.cycles.agg(F.count("*").alias("n_cycles")), a.routes.agg(F.count("*").alias("n_routes")))
    return {k: v for row in rows for k, v in row.first().asDict().items()}


def summary(a: Analysis, counted: dict[str, int]) -> DataFrame:
    """One row: the counts; modularity of the clusters; how much of the top 20 stays under other weights; of the table of forwarding
    shares its base rate, the rate at each depth, the area under the curve and the calibration of its backtest.

    Measures of empty data are null, lists of them empty.
    """
    out = a.net.nodes.sparkSession.range(1).select(*(F.lit(v).cast("long").alias(k) for k, v in counted.items()))
    train = a._keep(forward.training(a.structure), "train")
    tested = a._keep(forward.backtest_rows(train, a.cfg), "backtest")
    kept = priority.sensitivity(a.scored, a.cfg).select(F.col("min_overlap").alias("top20_min_overlap"), F.col("mean_overlap").alias("top20_mean_overlap"))
    listed = lambda df, name, *cols: df.agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))  # noqa: E731  a row a depth or bin
    depth = train.groupBy("depth").agg(rnd(F.avg("fwd"), 3).alias("rate"), F.count("*").alias("n"))
    bins = forward.calibration(tested).select("bin", rnd(F.col("predicted"), 3).alias("predicted"), rnd(F.col("actual"), 3).alias("actual"), "n")
    parts = (
        clusters.modularity(a.pairs, a.cluster.select("gid", F.col("cluster_id").alias("community"))).select(rnd(F.col("modularity"), 3).alias("modularity")),
        kept,
        train.agg(rnd(F.avg("fwd"), 3).alias("base_rate"), F.count("*").alias("n_train")),
        forward.auc(tested, a.scratch).select(rnd(F.col("auc"), 3).alias("auc")),
        listed(depth, "rate_by_depth", "depth", "rate", "n"),
        listed(bins, "calibration", "bin", "predicted", "actual", "n"),
    )
    for part in parts:
        out = out.crossJoin(part)  # one row each
    return out


def long_form(row: DataFrame) -> DataFrame:
    """(metric, value) of a summary; lists give a row for each of their values, named by depth or bin."""
    flat = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c, t in row.dtypes if not t.startswith("array")]

    def listed(column: str, name: str, by: str, field: str) -> Column:
        return F.transform(column, lambda x: F.struct(F.concat_ws(" ", F.lit(name), x[by].cast("string"), F.lit(field)).alias("metric"), x[field].cast("double").alias("value")))

    depth = [listed("rate_by_depth", "depth", "depth", f) for f in ("rate", "n")]
    bins = [listed("calibration", "bin", "bin", f) for f in ("predicted", "actual", "n")]
    return row.select(F.explode(F.concat(F.array(*flat), *depth, *bins)).alias("m")).select("m.*")
