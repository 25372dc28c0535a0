"""Communities: modularity optimisation, numbering, flows, stability, and the cluster table."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..config import ROLE_NAMES, TYPOLOGIES
from ..functions.cuts import Scratch, dealt
from ..functions.scalars import money, percent, rnd, short_id
from . import moves

#: Links of a block of nodes, whose moves one task works out; a smaller graph is one block, a larger one gets as many as it needs.
BLOCK = 500_000
#: Share of the blocks that move at once.
AT_ONCE = 0.5


def louvain(pairs: DataFrame, scratch: Scratch, runs: int = 1, resolution: float = 1.0, first: int = 0) -> DataFrame:
    """(run, gid, community) for runs first..first+runs-1 of a parallel Louvain over undirected pairs (a, b, weight).

    Nodes that would gain by it move to the neighbouring community with the largest gain, the smallest id on ties; which of them move at once
    is drawn by hashes that follow from node, run and level. A level ends when no node of it would gain by a move, at any size of the graph;
    communities are then contracted, until a level moves nothing. All runs share the jobs: run is part of every key. Deterministic
    for given data; a run gives the same by itself and among others.
    """
    ids = range(first, first + runs)
    links = pairs.select(F.explode(F.sequence(F.lit(first), F.lit(first + runs - 1))).alias("run"), "a", "b", "weight")
    links = scratch.step(links, "pairs")
    total = pairs.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    members = links.select("run", F.col("a").alias("gid")).unionByName(links.select("run", F.col("b").alias("gid"))).distinct().withColumn("node", F.col("gid"))
    members = scratch.step(members, "members")
    level = 0
    while True:
        sides = [(x, y) for x, y in (("a", "b"), ("b", "a"))]
        ends = [links.select("run", F.col(x).alias("node"), F.col(y).alias("other"), "weight") for x, y in sides]
        ends = ends[0].unionByName(ends[1])  # a pair inside a node counts twice, as both its ends do
        degree = ends.groupBy("run", "node").agg(F.sum("weight").alias("k"))
        state = scratch.step(degree.withColumn("c", F.col("node")), "state")
        to, moved = _settle(ends.filter("node <> other"), state, total, resolution, ids, level, scratch)
        if not moved:
            for table in (links, to, state):
                scratch.drop(table)
            return members.select("run", "gid", F.col("node").alias("community"))
        level += 1
        before = members
        members = scratch.step(members.join(dealt(to), ["run", "node"]).select("run", "gid", F.col("c").alias("node")), "members")
        a, b = to.withColumnsRenamed({"node": "a", "c": "ca"}), to.withColumnsRenamed({"node": "b", "c": "cb"})
        joined = links.join(dealt(a), ["run", "a"]).join(dealt(b), ["run", "b"]).groupBy("run", F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("weight").alias("weight"))
        old, links = links, scratch.step(joined, "pairs")
        for table in (before, old, to, state):
            scratch.drop(table)


def _settle(both: DataFrame, state: DataFrame, total: float, resolution: float, ids: range, level: int, scratch: Scratch) -> tuple[DataFrame, bool]:
    """(run, node, c) after a level, where no node would gain by a move, and whether any node moved.

    Nodes are dealt to blocks by hash, each with about BLOCK links at most. Each sweep is one job: a task gets a block's links and the communities of
    all nodes at their ends, and moves the block's nodes until none of them would gain (`moves.settle`). With one block, that ends the
    level. With more, blocks take turns: a share of them makes its moves at once, and the next sweep observes for each run the modularity and
    how many nodes would still go. Where the moves of several blocks have not raised the modularity, the run goes back and lets half as many blocks
    go; one block alone always raises it, so each run ends. A row keeps what going back needs (`alt`: the community it came from, or
    would have gone to), so a sweep reads the last table only, and older ones are dropped.
    """
    most = both.groupBy("run").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = max(1, -(-most // (2 * BLOCK)))  # each link is there from both of its ends
    block = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    slot = (F.col("run").cast("int") - ids[0]) * blocks + block
    none = lambda kind: F.lit(None).cast(kind)
    links = both.select("run", slot.alias("task"), none("boolean").alias("own"), "node", "other", "weight", none("double").alias("k"), none("long").alias("alt"), none("boolean").alias("went"))
    if blocks > 1:
        near = both.select("run", block.alias("block"), F.col("other").alias("node")).unionByName(state.select("run", block.alias("block"), "node"))
        near = scratch.write(near.distinct(), "near")
    now = state.select("run", "node", "k", "c", none("long").alias("alt"), F.lit(False).alias("went"))
    quality: dict[int, float] = {}
    share, start = dict.fromkeys(ids, AT_ONCE), dict.fromkeys(ids, 0)
    open_, ended, table, moved = list(ids), {}, None, False
    of_run = lambda x: F.element_at(F.array(*(F.lit(x[r]) for r in ids)), F.col("run") - (ids[0] - 1))
    work = partial(moves.task, total=float(total), resolution=float(resolution), salt=(ids[0] * blocks) << 8 | level)
    while open_:
        tot = now.groupBy("run", "c").agg(F.sum("k").alias("weight"))
        rows = now.join(dealt(tot), ["run", "c"])
        rows = rows.join(dealt(near), ["run", "node"]) if blocks > 1 else rows.withColumn("block", F.lit(0))
        rows = rows.select(((F.col("run").cast("int") - ids[0]) * blocks + F.col("block")).alias("task"), (F.col("block") == block).alias("own"), "node", F.col("c").alias("other"), "weight", "k", "alt", "went")
        sent = links.filter(F.col("run").isin(open_)).drop("run").unionByName(rows).repartitionById(len(ids) * blocks, "task")
        found = sent.mapInArrow(work, moves.SCHEMA).select((F.floor(F.col("task") / blocks) + ids[0]).cast("int").alias("run"), "node", "k", "c", "to", "alt", "went", "q")
        seen = Observation()
        told = [F.expr(x) for r in open_ for x in (f"sum(if(run = {r}, q, NULL)) AS q{r}", f"count_if(run = {r} AND to IS NOT NULL) AS n{r}", f"count_if(run = {r} AND went) AS m{r}")]
        before, table = table, scratch.step(found.observe(seen, *told).drop("q"), "sweep")
        if before is not None and before not in ended.values():
            scratch.drop(before)
        kept, width, counts = dict.fromkeys(ids, False), dict.fromkeys(ids, 0), seen.get
        for r in list(open_):
            q, n, went = (counts[f"{x}{r}"] for x in "qnm")
            if blocks == 1 or q is None:
                moved = moved or bool(n)
                open_.remove(r)
                ended[r] = table
            elif r in quality and not went:
                start[r] += max(1, int(share[r] * blocks))  # these blocks had nothing to move
            elif r in quality and q <= quality[r] + moves.LEAST_GAIN / 10:
                share[r] /= 2
            else:
                moved = moved or r in quality
                start[r] += max(1, int(share[r] * blocks)) if r in quality else 0
                quality[r], kept[r], share[r] = q, True, AT_ONCE
                if not n:
                    open_.remove(r)
                    ended[r] = table
            width[r] = max(1, int(share[r] * blocks))
        if open_:
            last = table.filter(F.col("run").isin(open_))
            back = ~of_run(kept) & F.col("went")
            goal = F.when(of_run(kept), F.col("to")).when(F.col("went"), F.col("c")).otherwise(F.col("alt"))
            last = last.select("run", "node", "k", F.when(back, F.col("alt")).otherwise(F.col("c")).alias("c"), goal.alias("goal"))
            turn = F.pmod(block + of_run(start), F.lit(blocks)) < of_run(width)
            last = last.withColumn("went", turn & F.col("goal").isNotNull())
            now = last.select("run", "node", "k", F.when(F.col("went"), F.col("goal")).otherwise(F.col("c")).alias("c"), F.when(F.col("went"), F.col("c")).otherwise(F.col("goal")).alias("alt"), "went")
    out = None
    for last in {t._scratch_path: t for t in ended.values()}.values():
        of = last.filter(F.col("run").isin([r for r, t in ended.items() if t is last])).select("run", "node", F.coalesce("to", "c").alias("c"))
        out = of if out is None else out.unionByName(of)
    out = scratch.step(out, "settled")
    for x in {t._scratch_path: t for t in (*([near] if blocks > 1 else []), *ended.values())}.values():
        scratch.drop(x)
    return out, moved


def modularity(pairs: DataFrame, member: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: modularity of a partition (gid, community) of the pairs' nodes."""
    a, b = member.withColumnsRenamed({"gid": "a", "community": "ca"}), member.withColumnsRenamed({"gid": "b", "community": "cb"})
    e = pairs.join(dealt(a), "a").join(dealt(b), "b")
    inside = e.groupBy(F.col("ca").alias("c")).agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("l"))
    ends = e.select(F.col("ca").alias("c"), "weight").unionByName(e.select(F.col("cb").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("k"))
    m = pairs.agg(F.sum("weight").alias("m"))
    share = F.col("k") / (2 * F.col("m"))
    return ends.join(dealt(inside), "c", "left").crossJoin(F.broadcast(m)).agg(F.sum(F.coalesce("l", F.lit(0.0)) / F.col("m") - F.lit(resolution) * share * share).alias("modularity"))


def number(nodes: DataFrame, pairs: DataFrame, member: DataFrame) -> DataFrame:
    """(gid, cluster_id): communities by inner turnover, size (both falling) and smallest gid; 0 for nodes without edges.

    The order is over one row a community.
    """
    a, b = member.withColumnsRenamed({"gid": "a", "community": "ca"}), member.withColumnsRenamed({"gid": "b", "community": "cb"})
    inner = pairs.join(dealt(a), "a").join(dealt(b), "b").filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(rnd(F.sum("weight"), 2).alias("inner"))
    sizes = member.groupBy("community").agg(F.count("*").alias("n"), F.min("gid").alias("low")).join(inner, "community", "left")
    order = Window.orderBy(F.coalesce("inner", F.lit(0.0)).desc(), F.desc("n"), "low")
    ids = sizes.select("community", F.row_number().over(order).alias("cluster_id"))
    return nodes.select("gid").join(member.join(ids, "community").select("gid", "cluster_id"), "gid", "left").na.fill(0, ["cluster_id"])


def stability(runs: DataFrame) -> DataFrame:
    """(community, stability): mean over runs 1.. of the best Jaccard overlap with a community of run 0."""
    base = runs.filter("run = 0").select("gid", F.col("community").alias("c0"))
    other = runs.filter("run > 0")
    n0 = base.groupBy("c0").agg(F.count("*").alias("n0"))
    n1 = other.groupBy("run", "community").agg(F.count("*").alias("n1"))
    both = base.join(other, "gid").groupBy("c0", "run", "community").agg(F.count("*").alias("i")).join(n0, "c0").join(n1, ["run", "community"])
    best = both.groupBy("c0", "run").agg(F.max(F.col("i") / (F.col("n0") + F.col("n1") - F.col("i"))).alias("j"))
    return best.groupBy(F.col("c0").alias("community")).agg(rnd(F.avg("j"), 3).alias("stability"))


def flows(edges: DataFrame, cluster: DataFrame) -> DataFrame:
    """(cluster_id, sum_kzt_internal, sum_kzt_in_external, sum_kzt_out_external)."""
    a, b = cluster.withColumnsRenamed({"gid": "src", "cluster_id": "ca"}), cluster.withColumnsRenamed({"gid": "dst", "cluster_id": "cb"})
    e = edges.join(a, "src").join(b, "dst")
    same, m = F.col("ca") == F.col("cb"), F.col("sum_kzt")
    side = F.explode(F.array(F.struct(F.col("ca").alias("cluster_id"), F.when(same, m).otherwise(0.0).alias("i"), F.lit(0.0).alias("x"), F.when(same, 0.0).otherwise(m).alias("o")), F.struct(F.col("cb").alias("cluster_id"), F.lit(0.0).alias("i"), F.when(same, 0.0).otherwise(m).alias("x"), F.lit(0.0).alias("o"))))
    sums = e.select(side.alias("s")).select("s.*").groupBy("cluster_id").agg(*(rnd(F.sum(c), 2).alias(n) for c, n in (("i", "sum_kzt_internal"), ("x", "sum_kzt_in_external"), ("o", "sum_kzt_out_external"))))
    return sums


def seed_span(edges: DataFrame, cluster: DataFrame, nodes: DataFrame) -> DataFrame:
    """(gid, span): clusters with seeds among a node's neighbours and its own; cluster 0 doesn't count."""
    seeded = nodes.filter("is_seed").join(cluster, "gid").filter("cluster_id <> 0").select("cluster_id").distinct()
    near = edges.select(F.col("src").alias("gid"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("gid"), F.col("src").alias("other")))
    near = near.unionByName(nodes.select("gid", F.col("gid").alias("other"))).distinct()
    of = cluster.withColumnRenamed("gid", "other")
    spans = near.join(of, "other").join(seeded, "cluster_id", "left_semi").groupBy("gid").agg(F.countDistinct("cluster_id").alias("span"))
    return nodes.select("gid").join(spans, "gid", "left").na.fill(0, ["span"])


# Column order of the cluster table.
CLUSTER_COLUMNS = ("cluster_id", "n_nodes", "n_seed", "sum_kzt_internal", "top_gids", "hypothesis", "roles_mix", "sum_kzt_in_external", "sum_kzt_out_external", "stability", "isolated_fragment", "max_priority")


def hypothesis(isolated: Column) -> Column:
    """Up to two sentences on what a cluster may be for, from the columns of `cluster_table`. Texts are fixed values."""
    n = lambda role: F.col(f"n_{role}")
    has_coord = n("coordinator") > 0
    coord = F.when(has_coord, F.concat(F.lit("признаки управляющего ядра: координатор "), short_id(F.col("coord.gid")), F.lit(" (от "), F.col("coord.in_deg"), F.lit(" плательщиков, "), F.col("coord.out_deg"), F.lit(" получателей, "), money(F.col("coord.in_kzt") + F.col("coord.out_kzt")), F.lit(")")))
    has_cons = (n("consolidator") > 0) & ((F.col("n_seed") >= 2) | ~has_coord)
    cons = F.when(has_cons, F.concat(F.lit(f"признаки {TYPOLOGIES['consolidator']}: "), short_id(F.col("cons.gid")), F.lit(" собирает от "), F.col("cons.in_deg"), F.lit(" плательщиков ("), money(F.col("cons.in_kzt")), F.lit(")"), F.when(F.col("n_seed") > 0, F.concat(F.lit(", в кластере "), F.col("n_seed"), F.lit(" seed"))).otherwise("")))
    before = F.when(has_coord, 1).otherwise(0) + F.when(has_cons, 1).otherwise(0)
    has_dist = (n("distributor") > 0) & (before < 2)
    dist = F.when(has_dist, F.concat(F.lit(f"признаки {TYPOLOGIES['distributor']}: "), short_id(F.col("dist.gid")), F.lit(" → "), F.col("dist.out_deg"), F.lit(" получателей ("), money(F.col("dist.out_kzt")), F.lit(") — возможны выплаты участникам/обналичивание")))
    share = n("transit") / F.col("n_nodes")
    has_transit = (share >= 0.3) & (before + F.when(has_dist, 1).otherwise(0) < 2)
    transit = F.when(has_transit, F.concat(F.lit(f"признаки {TYPOLOGIES['transit']}: "), percent(share), F.lit(" узлов пропускают деньги дальше — возможен прогон для разрыва следа")))
    none = F.concat(F.lit("периферия: "), n("terminal"), F.lit(" конечных получателей и "), n("peripheral"), F.lit(" разовых контактов без признаков дальнейшего движения"))
    text = F.concat_ws("; ", coord, cons, dist, transit)
    text = F.when(text == "", none).otherwise(text)
    text = F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))
    text = F.when(isolated, F.concat(F.lit("Изолированный фрагмент (нет связи с основной сетью). "), text)).otherwise(text)
    zero = F.concat(F.col("n_nodes"), F.lit(" seed без внутрибанковских переводов ≥5 000 ₸ за июль: вероятны наличные, другие банки или суммы ниже порога — запросить иные каналы."))
    return F.when(F.col("cluster_id") == 0, zero).otherwise(F.concat(text, F.lit(".")))


def cluster_records(scored: DataFrame, edges: DataFrame, giant: DataFrame) -> DataFrame:
    """One row a cluster, without its stability. scored: nodes with cluster, role and priority; giant: gids of the largest component."""
    best = lambda role, *by: F.max_by(F.when(F.col("role") == role, F.struct("gid", "in_deg", "out_deg", "in_kzt", "out_kzt")), F.when(F.col("role") == role, F.struct(*by)))
    nth = Window.partitionBy("cluster_id").orderBy(F.desc("priority_score"), "gid")
    top = scored.withColumn("nth", F.row_number().over(nth)).filter("nth <= 5").groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "gid"))), lambda x: x["gid"].cast("string")), ";").alias("top_gids"))
    g = scored.join(giant.withColumn("in_giant", F.lit(1)), "gid", "left").groupBy("cluster_id").agg(
        F.count("*").alias("n_nodes"), F.count_if("is_seed").alias("n_seed"), F.max("priority_score").alias("max_priority"), F.max("in_giant").alias("in_giant"),
        *(F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ROLE_NAMES),
        best("coordinator", "priority_score", -F.col("gid")).alias("coord"), best("consolidator", "in_deg", "priority_score", -F.col("gid")).alias("cons"), best("distributor", "out_deg", "priority_score", -F.col("gid")).alias("dist"),
    )
    mix = F.filter(F.array(*(F.struct((-F.col(f"n_{r}")).alias("n"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, (r, t) in enumerate(ROLE_NAMES.items()))), lambda x: x["n"] < 0)
    df = g.join(top, "cluster_id").join(flows(edges, scored.select("gid", "cluster_id")), "cluster_id", "left")
    df = df.na.fill(0.0, ["sum_kzt_internal", "sum_kzt_in_external", "sum_kzt_out_external"])
    isolated = (F.col("cluster_id") != 0) & F.col("in_giant").isNull()
    df = df.withColumns({"roles_mix": F.array_join(F.transform(F.array_sort(mix), lambda x: F.concat(x["t"], F.lit(": "), -x["n"])), ", "), "isolated_fragment": isolated, "hypothesis": hypothesis(isolated)})
    return df.select(*(c for c in CLUSTER_COLUMNS if c != "stability"))


def cluster_table(records: DataFrame, stable: DataFrame) -> DataFrame:
    """The records with the stability of each cluster: 1 where it has none."""
    return records.join(stable, "cluster_id", "left").na.fill(1.0, ["stability"]).select(*CLUSTER_COLUMNS)
