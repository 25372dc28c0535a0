"""Tables that cut the lineage of iterative plans, in the folder that all executors share."""

from __future__ import annotations

import atexit
import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parquet size up to which a loop's table is one partition.
SMALL_BYTES = 2 << 20

#: Masters whose workers run on the driver's machine.
LOCAL = r"local(\[.*\])?"

_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset, on a local master, a folder of our own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.fullmatch(LOCAL, spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="ledgerlens-")
    return _own_dirs[app]


def importable(spark: SparkSession) -> None:
    """Lets Python workers import the package: on a local master from where the driver has it, on a cluster from an archive that
    every executor fetches, those that come later too. The archive lies in the shared folder, one an application."""
    package, sc = Path(__file__).resolve().parents[1], spark.sparkContext
    if re.fullmatch(LOCAL, sc.master):
        root, env = str(package.parent), sc.environment
        paths = env.get("PYTHONPATH", "").split(os.pathsep)
        if root not in paths:
            env["PYTHONPATH"] = os.pathsep.join(x for x in [root, *paths] if x)
    elif sc.applicationId not in _shipped:
        at = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/ledgerlens/code-{sc.applicationId}.zip")
        fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
        out = fs.create(at, True)
        out.write(archive(package))
        out.close()
        sc.addPyFile(fs.makeQualified(at).toString())
        _shipped.add(sc.applicationId)


def archive(package: Path) -> bytes:
    """The package's modules as a zip file that Python can import from."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    return held.getvalue()


def dealt(df: DataFrame) -> DataFrame:
    """df as a side of a join that is dealt by its keys at every size, for joins that loops repeat: Spark would else broadcast tables of a
    few MB, and each repetition would pass them through the driver anew."""
    return df.hint("merge")


class Scratch:
    """Tables of one operator call, written as Parquet into the shared folder.

    Writing a table cuts the lineage, so that a lost executor costs a re-read instead of a recomputation. The tables live
    until `drop` or the end of the driver, as a lazy result may still read them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        importable(spark)
        self.root = f"{shared_dir(spark)}/ledgerlens/{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.drop)

    def write(self, df: DataFrame, name: str, *, sort: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
        """by: columns that become folders, which a filter on them then prunes."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path, partitionBy=by)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def step(self, df: DataFrame, name: str) -> DataFrame:
        """`write` for loops: a table of up to SMALL_BYTES on disk is read as one partition, so that the next step's joins and
        sums need no exchange; a larger one keeps its partitions."""
        out = self.write(df, name)
        if int(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL_BYTES:
            return out
        one = out.coalesce(1)
        one._scratch_path = out._scratch_path
        return one

    def drop(self, df: DataFrame | None = None) -> None:
        """Deletes one table, or all of them."""
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.root if df is None else df._scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session has ended: the folder's owner cleans up
            if df is not None:
                raise


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def fingerprint(df: DataFrame, *cols: str) -> tuple:
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64(*cols))).first())


def average_rank(df: DataFrame, value: str, scratch: Scratch, name: str) -> DataFrame:
    """df with `name`: the 1-based rank of value, ties getting the average of their places.

    Values are counted first, then range-partitioned; ranges are summed and their rows numbered by range, so that no task
    orders the whole table.
    """
    from pyspark.sql import Window

    counts = df.groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    ranged = scratch.write(counts.repartitionByRange("__v").withColumn("__p", F.spark_partition_id()), "ranked")
    sums = ranged.groupBy("__p").agg(F.sum("__n").alias("__s"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__p", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))
    inside = Window.partitionBy("__p").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    ranks = ranged.withColumn("__i", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(offsets, "__p")
    ranks = ranks.select("__v", (F.col("__o") + F.col("__i") + (F.col("__n") + 1) / F.lit(2.0)).alias(name))
    return df.join(ranks, F.col(value).eqNullSafe(F.col("__v")), "left").drop("__v")


def numbered(df: DataFrame, order: list, scratch: Scratch, name: str) -> DataFrame:
    """df with `name`: its 1-based place in a total order, found range by range."""
    from pyspark.sql import Window

    ranged = scratch.write(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ordered")
    sums = ranged.groupBy("__p").agg(F.count("*").alias("__s"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__p", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))
    nth = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return ranged.withColumn("__i", nth).join(offsets, "__p").withColumn(name, F.col("__o") + F.col("__i")).drop("__p", "__i", "__o")
