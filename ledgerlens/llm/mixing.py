"""Mixing sources to target weights by a time-varying curriculum (DataFrame functions only).

Each source demands words along a schedule over training time 0..1. Integrating the schedule gives its cumulative demand;
inverting that at a document's first word gives the time at which the document is trained on. Documents are then
range-sorted by that time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sharding
from .common import Scratch, WORD, WS_CHARS, hash60, set_aside
from .sharding import collapse

WEIGHTS = (3, 1, 2)
SHARE, MOST_REPEATS = 1.5, 2
#: Slope of a source's weight over time, by place of the source: rising, level, falling. Each keeps the same integral.
SLOPES = (0.5, 0.0, -0.5)
#: Most words, and most rows, that a range of a source should hold on average.
WORDS_IN_BUCKET, ROWS_IN_BUCKET = 4_000_000, 250_000
#: Positions are whole ticks of training time.
TICKS = 1_000_000_000


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pick(values: tuple, i: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(i, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, source_size, place, target) from (source, source_size): one row a source.

    Shares follow the weights; a target stops at MOST_REPEATS times its source, and what is left over is shared again by
    weight until no target is above its cap. Only sums travel to the driver. Ordering sources by code point is one task
    over one row a source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = scratch.write(sizes.withColumn("place", rank).withColumn("weight", pick(WEIGHTS, F.col("place"))), "sources")
    cap = F.col("source_size") * MOST_REPEATS
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * SHARE
    level, full = 0.0, -1
    while True:
        above = cap <= F.col("weight") * F.lit(level)
        n, capped, weight = table.agg(
            F.count_if(above), F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.coalesce(F.sum(F.when(above, 0).otherwise(F.col("weight"))), F.lit(0))
        ).first()
        if n == full or not weight:
            break
        full, level = n, (total - capped) / weight
    target = F.when(above, cap.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return table.select("source", "source_size", "place", target.alias("target"))


def inverse_demand(share: Column, slope: Column) -> Column:
    """Time at which a share (0..1) of a source's demand is met, for the weight 1 + slope * (2t - 1).

    The integral is t + slope * (t^2 - t); its inverse is the root in 0..1, in the form that holds for slope 0 too.
    """
    flat = F.lit(1.0) - slope
    return F.lit(2.0) * share / (flat + F.sqrt(flat * flat + F.lit(4.0) * slope * share))


def mix(docs: DataFrame, seed: int = 11) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, position, h) of every row of docs (doc_id, text, source).

    Documents of a source stand in hash order; the mix walks its demand through them, up to MOST_REPEATS times, and cuts
    only the document where the demand ends, so that a source's taken words equal its rounded target. The running sum
    over a source is taken by ranges of the hash: ranges are summed first, so no task holds a whole source. position is
    null where nothing is taken. Null text has size 0; null is a source of its own, the last; repeated rows count each.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select("doc_id", "source", n_words().alias("size"), F.coalesce(hash60(F.col("text")), F.lit(-1)).alias("h"))
    keys = ["doc_id", "source", "size", "h"]
    cut = scratch.write(collapse(rows, keys).withColumn("o", hash60(F.lit(seed), F.col("doc_id"), F.col("h"), F.col("chunk"))), "sizes")
    by_source = cut.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    goal = targets(by_source, scratch)
    words = goal.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    ranges = max(1, math.ceil(words / WORDS_IN_BUCKET), math.ceil(cut.count() / ROWS_IN_BUCKET))
    cut = cut.withColumn("range", F.call_function("div", F.col("o"), F.lit(2**60 // ranges + 1)))
    sums = cut.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("m")).alias("n"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "range").orderBy("o", "doc_id", "h", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("size") * F.col("m")).over(inside), F.lit(0))
    placed = cut.withColumn("start", start)
    on = lambda x, y, *c: [x[k].eqNullSafe(y[k]) for k in c]
    placed = placed.join(offsets, on(placed, offsets, "source", "range")).drop(offsets["source"]).drop(offsets["range"])
    placed = placed.join(goal, on(placed, goal, "source")).drop(goal["source"])
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    first = F.col("offset") + F.col("start") + F.col("copy") * F.col("size")
    demand = F.rint("target").cast("long")
    part = lambda k: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("demand") - F.col("first") - F.col("source_size") * k))
    out = copies.withColumns({"first": first, "demand": demand})
    out = out.withColumn("taken", part(0) + part(1))
    share = F.col("first").cast("double") / F.col("demand").cast("double")
    position = F.when(F.col("taken") > 0, F.rint(inverse_demand(share, pick(SLOPES, F.col("place"))) * TICKS).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", position.alias("position"), "first", "demand", "place", "h", "chunk")


def _first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word, n >= 1."""
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    rest = F.element_at(F.split(text, r"[\x20\x09-\x0D]+", n.cast("int") + 1 + lead), -1)
    return F.rtrim(F.substring(text, F.lit(1), F.length(text) - F.length(rest)), F.lit(WS_CHARS))


def training_order(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """docs as the mix takes them: one row a taken copy, range-sorted by position; columns of docs only.

    Documents without words, and those past the demand of their source, are not taken. The copy in which a source's demand
    ends keeps its first words (n_chars follows). Texts are shuffled twice: to meet their decisions, and to be sorted. Columns of
    any name travel along unchanged.
    """
    docs, back = set_aside(docs, "doc_id", "text", "source", "n_chars")
    cols = docs.columns
    names = ("first", "demand", "source_size", "place", "size")
    key = ["__doc_id", "__source", "__h"]
    chunks = mixed.groupBy(*(F.col(c[2:]).alias(c) for c in key), F.col("chunk").alias("__chunk")).agg(F.count("*").alias("__m"), F.min("first").alias("__first"), *(F.max(c).alias(f"__{c}") for c in names[1:]))
    plan = chunks.groupBy(*key).agg(F.sum("__m").alias("__m"), F.min("__first").alias("__first"), *(F.max(f"__{c}").alias(f"__{c}") for c in names[1:]))
    keyed = docs.withColumn("__k", F.coalesce(hash60(F.col("text")), F.lit(-1)))
    joined = keyed.join(plan, keyed["doc_id"].eqNullSafe(plan["__doc_id"]) & keyed["source"].eqNullSafe(plan["__source"]) & (keyed["__k"] == plan["__h"]))
    joined = joined.select(*cols, "__k", "__m", *(f"__{c}" for c in names))
    # The copies of a chunk stand one after another in their source, chunks anywhere; which of equal rows is which doesn't matter.
    nth = F.row_number().over(Window.partitionBy("doc_id", "source", "__k").orderBy(F.lit(0))) - 1
    many = joined.filter("__m > 1").drop("__first").withColumn("__nth", nth.cast("long"))
    many = many.withColumn("__c", F.call_function("div", F.col("__nth"), F.lit(sharding.CHUNK))).withColumn("__in", F.col("__nth") % F.lit(sharding.CHUNK))
    begin = chunks.select(*(F.col(c).alias(f"{c}_b") for c in key), "__chunk", "__first")
    many = many.join(begin, many["doc_id"].eqNullSafe(begin["__doc_id_b"]) & many["source"].eqNullSafe(begin["__source_b"]) & (many["__k"] == begin["__h_b"]) & (many["__c"] == begin["__chunk"]))
    many = many.withColumn("__first", F.col("__first") + F.col("__in") * F.col("__size"))
    rows = joined.filter("__m = 1").unionByName(many.select(joined.columns))
    at = lambda k: F.col("__first") + F.col("__source_size") * k
    copy = lambda k: F.struct(
        F.least(F.col("__size"), F.col("__demand") - at(k)).alias("words"),
        inverse_demand(at(k).cast("double") / F.col("__demand").cast("double"), pick(SLOPES, F.col("__place"))).alias("position"),
    )
    copies = F.filter(F.transform(F.array(*(F.lit(k) for k in range(MOST_REPEATS))), lambda k: F.when((F.col("__demand") > at(k)) & (F.col("__size") > 0), copy(k))), lambda x: x.isNotNull())
    out = rows.withColumn("__c", F.explode(copies))
    cut = F.col("__c.words") < F.col("__size")
    text = F.when(cut, _first_words(F.col("text"), F.col("__c.words"))).otherwise(F.col("text"))
    changed = {"text": text} | ({"n_chars": F.when(cut, F.length(text).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))} if "n_chars" in cols else {})
    out = out.withColumns(changed)
    return back(out.repartitionByRange(F.col("__c.position"), F.xxhash64("doc_id")).sortWithinPartitions("__c.position", "doc_id").select(*cols))


def mixing_digest(docs: DataFrame) -> DataFrame:
    out = mix(docs).select("doc_id", "size", "source_size", "target", "taken", "position")
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
