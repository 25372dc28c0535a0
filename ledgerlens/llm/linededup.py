"""Line dedup with levelled sorted runs of line hashes.

A run is a table of (h1, h2, n_docs), sorted by hash. A batch of documents is reduced to its lines' document counts,
merge-anti-joined with the keys that are settled already (seen in enough documents), and what is left becomes a run of
level 0. When a level has FANOUT runs they are compacted into one run of the next level, and keys that reach the
threshold move to the settled run. Equal keys are never held as texts: two 64-bit hashes stand for them.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, WS_CHARS, let, lower_ascii, set_aside

MIN_DOCS = 10
FANOUT = 4
BATCHES = 5


def line_key(line: Column) -> Column:
    """A line stripped and with A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(WS_CHARS)))


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def line_hash(line: Column) -> Column:
    """Two hashes of a line's key; null for an empty key."""
    return let(line_key(line), lambda x: F.when(F.length(x) > 0, key_hash(x)))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_keys(text: str) -> Column:
    """Distinct keys of a text's lines, as hashes."""
    # Texts are made distinct before they are hashed: for structs the function compares all pairs.
    keys = F.array_distinct(F.filter(F.transform(lines(F.col(text)), line_key), lambda x: F.length(x) > 0))
    return F.transform(keys, key_hash)


class Kept(Scratch):
    """Tables of a folder that outlive the session; names never repeat."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.count = spark, root.rstrip("/"), 0

    def write(self, df: DataFrame, name: str, *, sort: list[str] | None = None) -> DataFrame:
        return super().write(df, f"{name}-{uuid.uuid4().hex}", sort=sort)

    def saved(self) -> list[str]:
        """Complete states, oldest first."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/state/*/_SUCCESS")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
        return sorted(x.getPath().getParent().toString() for x in found)


class LineRuns:
    """The runs; `add` a batch, then `settled` has the keys of at least min_docs documents.

    path: a folder that keeps the runs. Runs of one path go on where the last complete batch left them, in a later session
    too: each batch ends with a new list of its runs, and replaced runs are deleted after that. One writer at a time; a batch
    that was broken off is added again. Without a path the runs are scratch tables.
    """

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT, path: str | None = None):
        self.spark, self.kept = spark, path is not None
        self.scratch = Kept(spark, path) if path else Scratch(spark)
        self.min_docs, self.fanout, self.batches = min_docs, fanout, 0
        self.levels: list[list[DataFrame]] = [[]]
        self.done: list[DataFrame] = []
        self.stale: list[DataFrame] = []
        if path and (states := self.scratch.saved()):
            self.batches = int(states[-1].rsplit("/", 1)[1])
            # One row a run, and at most fanout runs a level.
            for r in spark.read.parquet(states[-1]).orderBy("level", "nth").collect():
                run = spark.read.parquet(r["path"])
                run._scratch_path = r["path"]
                while r["level"] >= len(self.levels):
                    self.levels.append([])
                (self.done if r["level"] < 0 else self.levels[r["level"]]).append(run)

    def _save(self) -> None:
        self.batches += 1
        if self.kept:
            runs = [(level, nth, x._scratch_path) for level, xs in enumerate([self.done, *self.levels], -1) for nth, x in enumerate(xs)]
            self.spark.createDataFrame(runs, "level int, nth int, path string").coalesce(1).write.parquet(f"{self.scratch.root}/state/{self.batches:09d}")
        for run in self.stale:
            self.scratch.drop(run)
        self.stale = []

    def add(self, docs: DataFrame) -> None:
        """Adds a batch of documents (text)."""
        self.add_lines(docs.select(F.explode_outer(line_keys("text")).alias("h")).filter("h IS NOT NULL").select("h.*"))

    def add_lines(self, keys: DataFrame) -> None:
        """Adds a batch given as (h1, h2), once a document: counts them, without the settled keys, as a new run."""
        counts = keys.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))
        for run in self.done:
            counts = counts.join(run, ["h1", "h2"], "left_anti")
        self._push(0, self.scratch.write(counts, "run0", sort=["h1", "h2"]))
        if len(self.done) >= self.fanout:
            one = self.scratch.write(reduce(DataFrame.unionByName, self.done).distinct(), "settled", sort=["h1", "h2"])
            self.stale, self.done = self.stale + self.done, [one]
        self._save()

    def _push(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._compact(runs, level + 1))

    def _compact(self, runs: list[DataFrame], level: int) -> DataFrame:
        """One run of the sums; keys that have reached the threshold move to the settled runs."""
        merged = self.scratch.write(reduce(DataFrame.unionByName, runs).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs")), f"run{level}", sort=["h1", "h2"])
        self.done.append(self.scratch.write(merged.filter(F.col("n_docs") >= self.min_docs).select("h1", "h2"), "settled", sort=["h1", "h2"]))
        self.stale += runs
        left = self.scratch.write(merged.filter(F.col("n_docs") < self.min_docs), f"left{level}", sort=["h1", "h2"])
        self.scratch.drop(merged)
        return left

    def settled(self) -> DataFrame:
        """(h1, h2) of all keys found in at least min_docs documents so far; the runs stay as they are, and more batches may follow."""
        found, left = list(self.done), [run for level in self.levels for run in level]
        if left:
            total = reduce(DataFrame.unionByName, left).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))
            found.append(self.scratch.write(total.filter(F.col("n_docs") >= self.min_docs).select("h1", "h2"), "reached", sort=["h1", "h2"]))
            if self.kept:
                self.stale.append(found[-1])
        if not found:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        return reduce(DataFrame.unionByName, found).distinct() if len(found) > 1 else found[0]


def drop_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """docs with `text` without the lines whose key is in at least min_docs documents, and n_lines, n_dropped (long).

    Documents are rows: a repeated row counts again. Null and empty text are one empty line, null stays null, empty keys
    are never dropped, and the lines that stay keep their bytes and order. Columns n_lines and n_dropped of docs are
    replaced, all others stay. The batches are hash slices of the rows. A document meets its frequent lines by a hash of id and text: only
    hashes and line places are shuffled to find them, then texts once.
    """
    spark, columns = docs.sparkSession, docs.columns
    docs, back = set_aside(docs, "doc_id", "text")
    runs = LineRuns(spark, min_docs)
    slice_of = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    # Outer generators: an inner one is given a filter on its array's size, which computes the array once more.
    keys = docs.select(slice_of.alias("batch"), F.explode_outer(line_keys("text")).alias("h")).filter("h IS NOT NULL").select("batch", "h.*")
    keys = runs.scratch.write(keys, "keys")  # texts are read once, batches are slices of their hashes
    for b in range(batches):
        runs.add_lines(keys.filter(F.col("batch") == b))
    runs.scratch.drop(keys)
    frequent = runs.settled()
    key = F.xxhash64("doc_id", F.xxhash64("text"), F.xxhash64(F.lit(2), "text"))
    # The document's key travels inside the elements: a column made from the text beside them would copy it for each line.
    elements = let(key, lambda k: F.transform(lines(F.col("text")), lambda x: F.struct(k.alias("k"), line_hash(x).alias("h"))))
    each = docs.select(F.posexplode_outer(elements).alias("pos", "e")).filter("e.h IS NOT NULL")
    each = each.select(F.col("e.k").alias("__k"), "pos", F.col("e.h.h1").alias("h1"), F.col("e.h.h2").alias("h2"))
    gone = each.join(frequent, ["h1", "h2"]).groupBy("__k").agg(F.collect_set("pos").alias("__gone"))
    places = lambda found: F.array_except(F.sequence(F.lit(0), F.size(found) - 1), F.col("__gone"))
    kept = let(lines(F.col("text")), lambda found: F.transform(places(found), lambda i: F.get(found, i)))
    out = docs.withColumn("__k", key).join(gone.hint("shuffle_hash"), "__k", "left")
    counts = {"n_lines": F.size(lines(F.col("text"))).cast("long"), "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long")}
    out = out.withColumns({f"__{c}": v for c, v in counts.items()})
    out = out.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    new = [F.col(f"__{c}") for c in counts]
    out = back(out, *new)
    return out.select(*("`" + c.replace("`", "``") + "`" for c in columns if c not in counts), *(x.alias(c) for c, x in zip(counts, new, strict=True)))


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    out = drop_frequent_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
