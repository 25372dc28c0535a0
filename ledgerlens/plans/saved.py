"""The results of an analysis, saved for lookups, and read again in any later session."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cuts import Scratch
from ..operators import flows, lookup, priority
from ..sources import sinks
from ..sources.store import BUCKET_ROWS, Snapshot, Store

#: Last digits of an id by which the table of suffixes is dealt.
SUFFIX = 4


def suffix(gid: Column) -> Column:
    return F.right(gid.cast("string"), F.lit(SUFFIX))


def save(a, path: str, bucket_rows: int = BUCKET_ROWS) -> Snapshot:
    """Commits the tables that lookups need: nodes and partners by id, clusters and members by cluster, ids by suffix, edges by payer."""
    spark = a.scored.sparkSession
    explained = a.scored.join(a.cluster_table.select("cluster_id", "hypothesis"), "cluster_id", "left").withColumn("why", priority.why()).drop("hypothesis")
    tables = {
        "nodes": (explained, "gid", []),
        "partners": (lookup.partner_table(a.net.transactions, a.scored), "gid", ["direction", F.desc("sum_kzt"), "other"]),
        "clusters": (a.cluster_table, "cluster_id", []),
        "members": (a.scored.select("cluster_id", "rank", "gid", "role", "priority_score", "is_seed"), "cluster_id", ["rank"]),
        "suffixes": (a.scored.select(suffix(F.col("gid")).alias("suffix"), "gid", "rank"), "suffix", ["gid"]),
        "edges": (a.net.edges, "src", ["dst"]),
    }
    overview = flows.totals(a.net).crossJoin(sinks.metrics(a.scored, a.cluster_table)).first()  # one row each
    return Store(spark, path).commit(tables, overview.asDict(recursive=True), bucket_rows)


@dataclass(frozen=True)
class _Net:
    edges: DataFrame


class Saved:
    """A saved analysis for `lookup.call` and `cards.explain`: its snapshot is looked up anew at `refresh`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)
        self.snapshot = self.store.snapshot()

    def refresh(self) -> bool:
        """Takes the last commit; whether it is another one."""
        before, self.snapshot = self.snapshot, self.store.snapshot()
        return before.version != self.snapshot.version

    def rows(self, name: str, key) -> DataFrame:
        return self.snapshot.rows(name, key)

    @property
    def scored(self) -> DataFrame:
        return self.snapshot.table("nodes")

    @property
    def cluster_table(self) -> DataFrame:
        return self.snapshot.table("clusters")

    @property
    def net(self) -> _Net:
        return _Net(self.snapshot.table("edges"))

    @cached_property
    def scratch(self) -> Scratch:
        return Scratch(self.spark)

    @property
    def overview(self) -> dict:
        return self.snapshot.summary

    @property
    def total(self) -> int:
        return self.snapshot.manifest["tables"]["nodes"]["rows"]

    def ids_by_suffix(self, digits: str) -> DataFrame | None:
        """(gid, rank) of the ids that end in these digits, from one bucket; None where the digits are too few for that."""
        if len(digits) < SUFFIX:
            return None
        return self.rows("suffixes", digits[-SUFFIX:]).filter(F.col("gid").cast("string").endswith(digits)).select("gid", "rank")
