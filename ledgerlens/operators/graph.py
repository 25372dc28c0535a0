"""Graph operators as loops over DataFrames; each step is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.cuts import Scratch, dealt, fingerprint, finished
from . import packed


#: Iterations of PageRank in one job; more make its plan slower to prepare than a job's start costs.
CHAIN = 5


def pagerank(nodes: DataFrame, edges: DataFrame, scratch: Scratch, steps: int | None = None, damping: float = 0.85, tol: float = 1e-6, most: int = 100, least: int = 1) -> DataFrame:
    """(gid, pagerank) by power iteration, weighted by money; dangling mass is spread evenly.

    `steps` fixes the number of iterations; otherwise it stops after `least` or more when the ranks move by less than n * tol in
    sum, at `most` at the latest.

    Teleports and dangling mass add multiples of the vector of ones, so the k-th ranks are a sum of c[k, j] * v[j], where v[j] is
    the vector of ones after j walks along the links. A job makes CHAIN of the v in one plan: it carries them as an array, needs
    nothing from the driver in between, and all its joins read one exchange of the links, dealt by payer. What dangling nodes
    hold of each v is observed while the table is written, which gives the c. Sums are partial aggregates, so a payee with a
    third of all edges is no hot task.
    """
    n = nodes.count()
    if not n:
        return nodes.select("gid", F.lit(0.0).alias("pagerank"))
    out = edges.groupBy("src").agg(F.sum("sum_kzt").alias("w"))
    paid = edges.join(dealt(out), "src").select("src", "dst", (F.lit(damping) * F.col("sum_kzt") / F.col("w")).alias("p"))
    stay = nodes.select(F.col("gid").alias("src"), F.col("gid").alias("dst"), F.lit(None).cast("double").alias("p"))
    links = scratch.step(paid.unionByName(stay), "links")
    state = nodes.select("gid").join(dealt(out.select(F.col("src").alias("gid"), F.lit(True).alias("sends"))), "gid", "left")
    state = scratch.step(state.select("gid", F.col("sends").isNotNull().alias("sends"), F.array(F.lit(1.0)).alias("v")), "walks")
    lost = [float(state.filter("NOT sends").count())]
    weights = [[1.0 / n]]  # weights[k][j] is c[k, j]
    last = steps if steps is not None else most

    def ahead() -> None:
        """The c of one more iteration."""
        c = weights[-1]
        weights.append([(1 - damping) / n + damping / n * sum(x * y for x, y in zip(c, lost, strict=False)), *c])

    def mix(c: list[float]):
        return F.aggregate(F.zip_with("v", F.array(*map(F.lit, c)), lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda x, y: x + y)

    def moved(k: int):
        before = [*weights[k - 1], 0.0]
        return F.sum(F.abs(mix([x - y for x, y in zip(weights[k], before, strict=True)])))

    done = 0
    while done < last:
        width = min(CHAIN, last - done)
        now = state
        for _ in range(width):
            at = links.join(dealt(now), links["src"] == now["gid"])
            own = F.col("p").isNull()
            grown = at.groupBy("dst").agg(F.max(F.when(own, F.col("sends"))).alias("sends"), F.max(F.when(own, F.col("v"))).alias("v"), F.coalesce(F.sum(F.when(~own, F.col("p") * F.element_at("v", -1))), F.lit(0.0)).alias("next"))
            now = grown.select(F.col("dst").alias("gid"), "sends", F.array_append("v", F.col("next")).alias("v"))
        seen = Observation()
        held = [F.sum(F.when(~F.col("sends"), F.element_at("v", k - width))).alias(f"v{k}") for k in range(width)]
        before = state
        state = scratch.step(now.observe(seen, *held), "walks")
        scratch.drop(before)
        lost += [seen.get[f"v{k}"] or 0.0 for k in range(width)]
        for _ in range(width):
            ahead()
        if steps is None and done + width >= least:
            tried = range(max(done + 1, least), done + width + 1)
            far = state.agg(*(moved(k).alias(f"m{k}") for k in tried)).first()
            last = next((k for k in tried if far[f"m{k}"] < n * tol), last)
        done += width
    return scratch.step(state.select("gid", mix(weights[last]).alias("pagerank")), "rank")


def shortest_paths(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Level by level (s, v, sigma): nodes first reached from s in that many hops and the number of shortest paths."""
    links = edges.select("src", "dst").filter("src <> dst").distinct()
    levels = [scratch.write(nodes.select(F.col("gid").alias("s"), F.col("gid").alias("v"), F.lit(1.0).alias("sigma")), "level0")]
    seen = levels[0].select("s", "v")
    while True:
        ahead = levels[-1].join(links, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("sigma").alias("sigma"))
        new = scratch.write(ahead.join(seen, ["s", "v"], "left_anti"), f"level{len(levels)}")
        if not new.take(1):
            return levels
        levels.append(new)
        seen = seen.unionByName(new.select("s", "v"))


#: Pairs (source, node) of a block of betweenness, and how many times fewer where they are rows.
ROWS, AS_ROWS = 100_000_000_000, 1000
#: Links up to which tasks hold them next to their sources; pairs (source, link) of a task, but at least so many sources, as each task gets all links.
HELD, WORK, SOURCES = 4_000_000, 50_000_000, 1000


def betweenness(nodes: DataFrame, edges: DataFrame, scratch: Scratch, sources: int | None = None, kept: str | None = None) -> DataFrame:
    """(gid, betweenness): exact, directed, in hops, over (n-1)(n-2) ordered pairs, ends left out.

    A block of about `sources` sources is a job, and only sums by node stay of it; unless given, `sources` is such that a block has
    about ROWS pairs, at any number of nodes. With up to HELD links, sources are dealt to tasks with the links, and no pair is a row; with more,
    the shortest paths of a block grow as rows (source, node), level by level, and dependencies come back the same way. With `kept`, a
    folder in shared storage, finished blocks are found there, so a run that broke off goes on where it was.
    """
    n = nodes.count()
    links = scratch.write(edges.select("src", "dst").filter("src <> dst").distinct(), "links")
    n_links = links.count()
    held = n_links <= HELD
    blocks = max(1, -(-n // (sources or max(1, (ROWS if held else ROWS // AS_ROWS) // max(n, 1)))))
    tasks = max(1, min(-(-n * n_links // (blocks * WORK)), -(-n // (blocks * SOURCES)))) if held else 0
    spark, sums = nodes.sparkSession, None
    for k in range(blocks):
        path = kept and f"{kept.rstrip('/')}/{k:05d}-of-{blocks:05d}"
        if not (path and finished(spark, path)):
            own = nodes.select("gid").filter(F.pmod(F.xxhash64("gid"), F.lit(blocks)) == k)
            part, used = _dependencies(own, links, scratch, tasks)
            if path:
                part.write.mode("overwrite").parquet(path)
            else:
                part = scratch.write(part, f"block{k}")
            for table in used:
                scratch.drop(table)
        part = spark.read.schema("gid long, delta double").parquet(path) if path else part
        sums = part if sums is None else sums.unionByName(part)
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    sums = sums.groupBy("gid").agg((F.sum("delta") * scale).alias("betweenness"))
    return nodes.select("gid").join(sums, "gid", "left").na.fill(0.0, ["betweenness"])


def _dependencies(own: DataFrame, links: DataFrame, scratch: Scratch, tasks: int) -> tuple[DataFrame, list[DataFrame]]:
    """(gid, delta): what the shortest paths from the sources `own` add to each node, and the stored tables it is made of; by so many
    tasks that hold the links, or by rows where tasks is 0."""
    return (_by_tasks(own, links, tasks), []) if tasks else _by_rows(own, links, scratch)


def _by_tasks(own: DataFrame, links: DataFrame, tasks: int) -> DataFrame:
    ranged = own.repartitionByRange(tasks, "gid").select(F.spark_partition_id().alias("task"), F.col("gid").alias("src"), F.lit(None).cast("long").alias("dst"))
    rows = ranged.unionByName(links.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "src", "dst"))
    found = rows.repartitionById(tasks, "task").mapInArrow(packed.task, "gid long, delta double")
    return found.groupBy("gid").agg(F.sum("delta").alias("delta"))


def _by_rows(own: DataFrame, links: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    levels = shortest_paths(own, links, scratch)
    used, total, back = list(levels), None, None
    for k in range(len(levels) - 1, 0, -1):
        here = levels[k]
        here = here.withColumn("delta", F.lit(0.0)) if back is None else here.join(back, ["s", "v"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
        here = scratch.write(here, f"delta{k}")
        used.append(here)
        total = here.select("v", "delta") if total is None else total.unionByName(here.select("v", "delta"))
        before = levels[k - 1].select("s", F.col("v").alias("u"), F.col("sigma").alias("su"))
        part = here.join(links, F.col("v") == F.col("dst")).join(before, (here["s"] == before["s"]) & (F.col("src") == F.col("u")))
        back = part.groupBy(here["s"].alias("s"), F.col("u").alias("v")).agg(F.sum(F.col("su") / F.col("sigma") * (1 + F.col("delta"))).alias("delta"))
    if total is None:
        return own.select("gid", F.lit(0.0).alias("delta")), used
    return total.groupBy(F.col("v").alias("gid")).agg(F.sum("delta").alias("delta")), used


def components(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node; edges (u, v) undirected; component is the smallest node reachable.

    Alternates large-star and small-star steps until nothing changes; all minima are partial aggregates. Nodes may be of any
    type with an order, so several graphs can run at once with a struct of graph and node.
    """
    state = scratch.step(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while (now := fingerprint(state, "u", "v")) != before:
        before = now
        both = state.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(state.select(F.col("v").alias("a"), F.col("u").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = scratch.step(both.join(dealt(low), "a").filter("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        state = scratch.step(large.join(dealt(low), "u").select(pair).select("e.*").filter("u <> v").distinct(), "edges")
    found = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(dealt(found), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def reach(edges: DataFrame, starts: DataFrame, scratch: Scratch, hops: int | None = None) -> DataFrame:
    """(key, gid, hops) of what each start (key, gid) reaches along edges (src, dst), the start included, by fewest hops.

    With a column `key` in edges too, each key walks its own graph.
    """
    own = "key" in edges.columns
    seen = scratch.write(starts.select("key", "gid").distinct().withColumn("hops", F.lit(0)), "reach0")
    frontier, k = seen, 0
    while hops is None or k < hops:
        k += 1
        on = (frontier["gid"] == edges["src"]) & (frontier["key"] == edges["key"]) if own else frontier["gid"] == edges["src"]
        new = frontier.join(edges, on).select(frontier["key"], F.col("dst").alias("gid")).distinct()
        frontier = scratch.write(new.join(seen, ["key", "gid"], "left_anti").withColumn("hops", F.lit(k)), f"reach{k}")
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
    return seen


def reach_volume(edges: DataFrame, seeds: DataFrame, scratch: Scratch) -> DataFrame:
    """One row: nodes that money from the seeds can reach and the turnover of edges that start there."""
    got = reach(edges, seeds.select(F.lit(0).alias("key"), "gid"), scratch).select("gid")
    volume = edges.join(got, edges["src"] == got["gid"], "left_semi").agg(F.coalesce(F.sum("sum_kzt"), F.lit(0.0)).alias("volume"))
    return got.agg(F.count("*").alias("n_reached")).crossJoin(volume)


def _steps(edges: DataFrame, src: int, dst: int, longest: int, scratch: Scratch) -> DataFrame:
    """(src, dst, sum_kzt, left) of the edges from which dst is within reach: left is the number of hops from the edge's end to it."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    left = reach(back, edges.sparkSession.range(1).select(F.lit(0).alias("key"), F.lit(dst).cast("long").alias("gid")), scratch, longest).select(F.col("gid").alias("dst"), F.col("hops").alias("left"))
    return scratch.write(edges.join(left, "dst").select("src", "dst", "sum_kzt", "left"), "steps")


def _grow(steps: DataFrame, src: int, dst: int, longest: int, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """(nodes, low) of all simple paths of at most `longest` of these steps, and the stored prefixes of each length."""
    open_ = steps.sparkSession.range(1).select(F.array(F.lit(src).cast("long")).alias("nodes"), F.lit(float("inf")).alias("low")).filter(F.lit(src != dst))
    out, grown = None, []
    for k in range(1, longest + 1):
        more = open_.join(steps, F.element_at("nodes", -1) == F.col("src")).filter((F.col("left") <= longest - k) & ~F.array_contains("nodes", F.col("dst")))
        more = scratch.write(more.select(F.array_append("nodes", F.col("dst")).alias("nodes"), F.least("low", "sum_kzt").alias("low")), f"paths{k}")
        grown.append(more)
        done = more.filter(F.element_at("nodes", -1) == dst)
        open_ = more.filter(F.element_at("nodes", -1) != dst)
        out = done if out is None else out.unionByName(done)
    return out, grown


def paths(edges: DataFrame, src: int, dst: int, longest: int, scratch: Scratch) -> DataFrame:
    """(nodes, bottleneck_kzt, n_hops): all simple paths of at most `longest` (1..6) edges, pruned by the way left to dst."""
    longest = max(1, min(longest, 6))
    out, _ = _grow(_steps(edges, src, dst, longest, scratch), src, dst, longest, scratch)
    return out.select("nodes", F.col("low").alias("bottleneck_kzt"), (F.size("nodes") - 1).alias("n_hops"))


#: Thresholds tried at once, and how many walks a wanted path may have above the chosen one before it is refined.
LEVELS, SLACK = 16, 4


def _walks(steps: DataFrame, src: int, dst: int, longest: int, floors: list[float], scratch: Scratch) -> dict[float, float]:
    """For each floor, the number of walks from src to dst whose amounts all reach it. Nodes carry counts, so no walk is a row."""
    spark = steps.sparkSession
    counts = dict.fromkeys(floors, 0.0)
    now = spark.createDataFrame([(f, src, 1.0) for f in floors], "floor double, at long, n double")
    for k in range(1, longest + 1):
        ahead = now.join(steps, (F.col("at") == F.col("src")) & (F.col("sum_kzt") >= F.col("floor")) & (F.col("left") <= longest - k) & (F.col("dst") != src))
        now = scratch.write(ahead.groupBy("floor", F.col("dst").alias("at")).agg(F.sum("n").alias("n")), "walks")
        for floor, _, n in now.filter(F.col("at") == dst).collect():  # a row a floor
            counts[floor] += n
        now = now.filter(F.col("at") != dst)
    return counts


def widest_paths(edges: DataFrame, src: int, dst: int, longest: int, k: int, scratch: Scratch, grown: list | None = None) -> DataFrame:
    """(nodes, bottleneck_kzt, n_hops): the k simple paths of at most `longest` (1..6) edges with the largest smallest amount;
    equal ones by fewest hops, then by their nodes.

    Branch and bound on the k-th bottleneck. Counting walks above descending floors finds a floor that about k paths reach; edges
    below it cannot be on one of the k best once k simple paths reach it, so only the rest grow paths, and only where they can
    still end. All paths that tie with the k-th are grown. Where walks that visit a node twice made the count too high, the floor
    goes down. `grown` gets the number of stored prefixes of each attempt.
    """
    longest, k = max(1, min(longest, 6)), max(1, int(k))
    steps = _steps(edges, src, dst, longest, scratch).filter(F.col("dst") != src)
    everything = float("-inf")
    ceiling, wanted = float("inf"), float(k)
    while True:
        floor, above = everything, ceiling
        while True:  # floors between `floor` and `above`, the largest with enough walks and the next one
            between = steps.filter((F.col("sum_kzt") >= floor) & (F.col("sum_kzt") < above))
            tried = between.agg(F.percentile_approx("sum_kzt", [i / LEVELS for i in range(LEVELS)], 1000).alias("q")).first().q or []
            tried = sorted({float(x) for x in tried} - {floor})
            if not tried:
                break
            counts = _walks(steps, src, dst, longest, tried, scratch)
            enough = [f for f in tried if counts[f] >= wanted]
            above = min((f for f in tried if counts[f] < wanted), default=above)
            if not enough:
                break
            floor = max(enough)
            if counts[floor] <= SLACK * wanted:
                break
        wide = _steps(steps.filter(F.col("sum_kzt") >= floor).drop("left"), src, dst, longest, scratch)  # the way left, above the floor
        out, stored = _grow(wide, src, dst, longest, scratch)
        if grown is not None:
            grown.append(sum(x.count() for x in stored))
        if floor == everything or out.count() >= k:
            ordered = out.select("nodes", F.col("low").alias("bottleneck_kzt"), (F.size("nodes") - 1).alias("n_hops"))
            return ordered.orderBy(F.desc("bottleneck_kzt"), "n_hops", "nodes").limit(k)
        ceiling, wanted = floor, wanted * 4


def shortest_path(edges: DataFrame, src: int, dst: int, scratch: Scratch) -> DataFrame:
    """(nodes, n_hops): one path of fewest edges, by the smallest id at each step back from dst; no row where dst is out of reach.

    The driver sees the number of hops only; the path is a single row.
    """
    start = edges.sparkSession.range(1).select(F.lit(0).alias("key"), F.lit(src).cast("long").alias("gid"))
    ways = scratch.write(reach(edges.select("src", "dst"), start, scratch).select("gid", "hops"), "ways")
    path = ways.filter(F.col("gid") == dst).select(F.array("gid").alias("nodes"), F.col("hops").alias("n_hops"))
    end = path.first()
    for k in range(end["n_hops"] - 1 if end else -1, -1, -1):
        before = edges.select("src", "dst").join(ways.filter(F.col("hops") == k).select(F.col("gid").alias("src")), "src", "left_semi")
        back = path.join(before, F.get("nodes", F.lit(0)) == F.col("dst")).groupBy("nodes", "n_hops").agg(F.min("src").alias("src"))
        path = scratch.write(back.select(F.array_prepend("nodes", F.col("src")).alias("nodes"), "n_hops"), f"back{k}")
    return path


def common_counterparties(edges: DataFrame, gids: list[int], direction: str, hops: int, scratch: Scratch) -> DataFrame:
    """(gid, n_linked, linked): nodes within `hops` (1..4) of two or more given nodes, without these; linked has the hops."""
    spark = edges.sparkSession
    links = edges.select("src", "dst") if direction == "out" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    given = spark.createDataFrame([(int(g),) for g in dict.fromkeys(gids)], "gid long")
    got = reach(links.distinct(), given.select(F.col("gid").alias("key"), "gid"), scratch, max(1, min(hops, 4))).filter("hops > 0")
    rows = got.join(F.broadcast(given), "gid", "left_anti").groupBy("gid").agg(F.count("*").alias("n_linked"), F.sort_array(F.collect_list(F.struct(F.col("key").alias("gid"), "hops"))).alias("linked"))
    return rows.filter("n_linked >= 2")


def neighbours(edges: DataFrame, gid: int, direction: str = "both") -> DataFrame:
    """(gid, direction, sum_kzt, n_tx) of the payers (in) and payees (out) of a node."""
    side = lambda key, other, name: edges.filter(F.col(key) == gid).select(F.col(other).alias("gid"), F.lit(name).alias("direction"), "sum_kzt", "n_tx")
    parts = [side("dst", "src", "in")] * (direction in ("in", "both")) + [side("src", "dst", "out")] * (direction in ("out", "both"))
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]
