"""Lookups over the results: search, ranking, ids by suffix, node and cluster records, partners, and calls by name as JSON.

Results are an analysis of this session or a saved one; of a saved one, lookups by key read one bucket (`rows`)."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cuts import Scratch
from ..sources import sinks
from . import flows, graph

#: Characters of the JSON that a call gives.
MOST_CHARS = 12_000
#: Ids that an ambiguous text is answered with.
MOST_MATCHES = 20


def search(scored: DataFrame, role=None, cluster=None, is_seed=None, min_in_deg=None, min_out_deg=None, min_priority=None, limit: int | None = 20) -> DataFrame:
    """Nodes that meet all given conditions, first by rank; all of them without a limit."""
    df = scored
    for cond in (
        None if role is None else F.col("role") == role,
        None if cluster is None else F.col("cluster_id") == int(cluster),
        None if is_seed is None else F.col("is_seed") == bool(is_seed),
        None if min_in_deg is None else F.col("in_deg") >= min_in_deg,
        None if min_out_deg is None else F.col("out_deg") >= min_out_deg,
        None if min_priority is None else F.col("priority_score") >= min_priority,
    ):
        df = df if cond is None else df.filter(cond)
    return df.orderBy("rank") if limit is None else df.orderBy("rank").limit(max(1, int(limit)))


def top(scored: DataFrame, role=None, cluster=None, n: int = 10) -> DataFrame:
    return search(scored, role=role, cluster=cluster, limit=n)


def resolve(nodes: DataFrame, text: str) -> DataFrame:
    """(gid, rank, tier) of the first tier with a hit: exact id, ids that end so, ids that contain the digits. Nodes without a rank get
    none."""
    digits = re.sub(r"[^0-9]", "", text)
    gid = F.col("gid").cast("string")
    tier = F.when(gid == digits, 1).when(gid.endswith(digits), 2).when(gid.contains(digits), 3) if digits else F.lit(None).cast("int")
    known = [c for c in ("gid", "rank") if c in nodes.columns]
    hits = nodes.select(*known, tier.alias("tier")).filter("tier is not null")
    return hits.join(F.broadcast(hits.agg(F.min("tier").alias("tier"))), "tier").select(*known, "tier")


def ids_in(texts: DataFrame, column: str = "text") -> DataFrame:
    """texts with `ids`: distinct 18-digit ids and other runs of four digits or more, in order."""
    return texts.withColumn("ids", F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(r"\d{18}|\d{4,}"), F.lit(0))))


def partner_table(transactions: DataFrame, about: DataFrame) -> DataFrame:
    """(gid, direction, other, sum_kzt, n_tx, first, last, days) of every node's payers (in) and payees (out), with what `about`
    (gid, ..) knows of the other one's role, is_seed and priority_score.

    A filter on gid goes through to the transfers. days are the first four different ones.
    """
    sides = {"in": ("dst", "src"), "out": ("src", "dst")}
    parts = [transactions.select(F.col(own).alias("gid"), F.lit(name).alias("direction"), F.col(other).alias("other"), "date", "sum_kzt") for name, (own, other) in sides.items()]
    by_day = parts[0].unionByName(parts[1]).groupBy("gid", "direction", "other", "date").agg(F.sum("sum_kzt").alias("s"), F.count("*").alias("n"))
    sums = by_day.groupBy("gid", "direction", "other").agg(
        F.sum("s").alias("sum_kzt"), F.sum("n").alias("n_tx"), F.min("date").alias("first"), F.max("date").alias("last"), F.slice(F.array_sort(F.collect_list("date")), 1, 4).alias("days")
    )
    known = about.select(F.col("gid").alias("other"), *(c for c in ("role", "is_seed", "priority_score") if c in about.columns))
    return sums.join(known, "other", "left").select("gid", "direction", "other", *sums.columns[3:], *known.columns[1:])


def rows_of(a, name: str, key) -> DataFrame:
    """Rows of one key of a result's table: nodes and partners by gid, clusters and members by cluster_id."""
    if hasattr(a, "rows"):
        return a.rows(name, key)
    if name == "partners":
        return partner_table(a.net.transactions, a.scored).filter(F.col("gid") == key)
    by = "gid" if name == "nodes" else "cluster_id"
    return (a.cluster_table if name == "clusters" else a.scored).filter(F.col(by) == key)


class Ambiguous(LookupError):
    """Several ids end in what was asked for."""

    def __init__(self, text: str, matches: list[int]):
        super().__init__(f"{text}: {len(matches)} ids or more match")
        self.matches = matches


def matches(a, text: str) -> DataFrame:
    """(gid, rank, tier) as in `resolve`; of a saved result, ids are first looked up by their last digits."""
    digits = re.sub(r"[^0-9]", "", text)
    if hasattr(a, "ids_by_suffix") and (ends := a.ids_by_suffix(digits)) is not None:
        found = resolve(ends, text)
        if found.take(1):
            return found
        return resolve(a.snapshot.table("suffixes").select("gid", "rank"), text)
    return resolve(a.scored, text)


def one_id(a, text) -> int:
    """The id that a text names: a full id, or the end or a part that only one id has."""
    digits = str(text).strip()
    if not re.fullmatch(r"-?\d+", digits):
        raise ValueError(f"{text}: not an id")
    found = [r["gid"] for r in matches(a, digits).orderBy("rank").limit(MOST_MATCHES).collect()]
    if not found:
        raise LookupError(f"{text}: no such node")
    if len(found) > 1:
        raise Ambiguous(digits, found)
    return found[0]


def node(scored: DataFrame, edges: DataFrame, clusters: DataFrame, gid: int, partners: int = 5) -> DataFrame:
    """One row: the node's record, its cluster's size and hypothesis, and its largest payers and payees."""
    def side(key: str, other: str, name: str) -> DataFrame:
        first = edges.filter(F.col(key) == gid).select("sum_kzt", F.col(other).alias("gid"), "n_tx").orderBy(F.desc("sum_kzt"), F.desc("gid")).limit(partners)
        return first.agg(F.sort_array(F.collect_list(F.struct("sum_kzt", "gid", "n_tx")), asc=False).alias(name))

    payers, payees = side("dst", "src", "top_payers"), side("src", "dst", "top_payees")
    about = clusters.select("cluster_id", F.col("n_nodes").alias("cluster_n_nodes"), F.col("n_seed").alias("cluster_n_seed"), "hypothesis")
    return scored.filter(F.col("gid") == gid).join(about, "cluster_id", "left").crossJoin(payers).crossJoin(payees)  # one row each


def cluster(scored: DataFrame, clusters: DataFrame, cluster_id: int, members: int = 8) -> DataFrame:
    """One row: the cluster and its first members by rank."""
    top_ = scored.filter(F.col("cluster_id") == cluster_id).orderBy("rank").limit(members).agg(F.sort_array(F.collect_list(F.struct("rank", "gid", "role"))).alias("members"))
    return clusters.filter(F.col("cluster_id") == cluster_id).crossJoin(top_)


def partners(transactions: DataFrame, gid: int, direction: str = "both", limit: int | None = None) -> DataFrame:
    """(gid, direction, sum_kzt, n_tx, first, last) of a node's payers (in) and payees (out), largest amounts first."""
    sides = {"in": ("dst", "src"), "out": ("src", "dst")}
    parts = [transactions.filter(F.col(own) == gid).select(F.col(other).alias("gid"), F.lit(name).alias("direction"), "sum_kzt", "date") for name, (own, other) in sides.items() if direction in (name, "both")]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = rows.groupBy("gid", "direction").agg(F.sum("sum_kzt").alias("sum_kzt"), F.count("*").alias("n_tx"), F.min("date").alias("first"), F.max("date").alias("last"))
    out = out.orderBy(F.desc("sum_kzt"), "direction", "gid")
    return out if limit is None else out.limit(max(1, int(limit)))


def ranked_paths(edges: DataFrame, src: int, dst: int, longest: int, scratch: Scratch, limit: int = 200) -> DataFrame:
    """Simple paths, those with the largest bottleneck first, then the shorter ones."""
    return graph.widest_paths(edges, src, dst, longest, limit, scratch)


def ranked_common(scored: DataFrame, edges: DataFrame, gids: list[int], direction: str, hops: int, scratch: Scratch, limit: int = 20) -> DataFrame:
    """Common counterparties with role and priority: those linked with most of the given nodes first, then by priority."""
    rows = graph.common_counterparties(edges, gids, direction, hops, scratch).join(scored.select("gid", "role", "priority_score"), "gid")
    return rows.orderBy(F.desc("n_linked"), F.desc("priority_score"), "gid").limit(max(1, int(limit)))


def _records(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def node_record(a, gid: int, partners: int = 5) -> dict | None:
    """A node's record with its cluster's sizes and hypothesis, why it stands where it does, and its largest partners on each
    side with their roles and dates; None for an unknown id. Of a saved result this reads three buckets."""
    found = _records(rows_of(a, "nodes", gid).limit(1))
    if not found:
        return None
    record = found[0]
    about = _records(rows_of(a, "clusters", record["cluster_id"]).limit(1))
    if about:
        record |= {"cluster_n_nodes": about[0]["n_nodes"], "cluster_n_seed": about[0]["n_seed"], "hypothesis": about[0]["hypothesis"]}
    nth = F.row_number().over(Window.partitionBy("direction").orderBy(F.desc("sum_kzt"), F.desc("other")))
    first = rows_of(a, "partners", gid).drop("days").withColumn("nth", nth).filter(F.col("nth") <= partners).orderBy("direction", "nth").drop("nth", "gid")
    sides = {"in": [], "out": []}
    for row in _records(first.withColumnRenamed("other", "gid")):
        sides[row.pop("direction")].append(row)
    if "why" in record:
        record["why_top"] = record.pop("why")
    return record | {"top_payers": sides["in"], "top_payees": sides["out"]}


def call(a, name: str, arguments: dict | None = None) -> str:
    """JSON of a lookup on an analysis, of this session or saved, by name, of at most MOST_CHARS characters.

    Ids may be given in full, as their last digits, or as any part that only one id has. Faults are results, not exceptions:
    {"error": kind, "message": text} with kind unknown_tool, bad_arguments, not_found or ambiguous, which has the first
    matches. Every lookup has a limit, so only its first rows come to the driver; total is the number of rows without the limit.
    """

    def at_most(limit) -> int:
        return max(1, int(limit))

    def neighbours(gid, direction: str = "both", limit: int = 20) -> dict:
        if direction not in ("in", "out", "both"):
            raise ValueError("direction is in, out or both")
        every = rows_of(a, "partners", one_id(a, gid)).drop("gid", "days", "is_seed")
        every = every if direction == "both" else every.filter(F.col("direction") == direction)
        every = every.withColumnRenamed("other", "gid")
        return {"total": every.count(), "rows": _records(every.orderBy(F.desc("sum_kzt"), "direction", "gid").limit(at_most(limit)))}

    def overview() -> dict:
        """Totals, metrics and the first five nodes."""
        sums = a.overview if hasattr(a, "overview") else one(flows.totals(a.net).crossJoin(sinks.metrics(a.scored, a.cluster_table)))  # one row each
        return {**sums, "top": _records(top(a.scored, n=5).select("rank", "gid", "role", "priority_score", "cluster_id"))}

    def get_node(gid) -> dict:
        return node_record(a, one_id(a, gid))

    def shortest(src, dst) -> dict:
        return one(graph.shortest_path(a.net.edges, one_id(a, src), one_id(a, dst), a.scratch))

    def ranked(role: str | None = None, cluster_id: int | None = None, n: int = 10) -> dict:
        rows = rows_of(a, "members", cluster_id) if cluster_id is not None else a.scored
        rows = rows if role is None else rows.filter(F.col("role") == role)
        return {"total": rows.count(), "rows": _records(top(rows, n=n).select("rank", "gid", "role", "priority_score", "cluster_id"))}

    def cluster_summary(cluster_id: int, members: int = 8) -> dict:
        first = rows_of(a, "members", int(cluster_id)).orderBy("rank").limit(at_most(members)).select("rank", "gid", "role")
        return one(rows_of(a, "clusters", int(cluster_id))) | {"members": _records(first)}

    def searched(limit: int = 20, **given) -> dict:
        rows = search(a.scored, **given, limit=None)
        return {"total": rows.count(), "rows": _records(rows.limit(at_most(limit)).select("rank", "gid", "role", "priority_score"))}

    def paths(src, dst, max_len: int = 4, limit: int = 20) -> dict:
        ends = one_id(a, src), one_id(a, dst)
        return {"rows": _records(ranked_paths(a.net.edges, *ends, int(max_len), a.scratch, at_most(limit)))}

    def common(gids, direction: str = "out", max_hops: int = 2, limit: int = 20) -> dict:
        if direction not in ("in", "out"):
            raise ValueError("direction is in or out")
        given = list(dict.fromkeys(one_id(a, g) for g in gids))
        if len(given) < 2:
            raise ValueError("two different nodes or more are needed")
        rows = a.scratch.write(graph.common_counterparties(a.net.edges, given, direction, int(max_hops), a.scratch), "common")
        about = rows.join(a.scored.select("gid", "role", "priority_score"), "gid").orderBy(F.desc("n_linked"), F.desc("priority_score"), "gid")
        return {"total": rows.count(), "rows": _records(about.limit(at_most(limit)))}

    def one(df: DataFrame) -> dict:
        found = _records(df.limit(1))
        if not found:
            raise LookupError("no such record")
        return found[0]

    tools = {
        "overview": overview,
        "shortest_path": shortest,
        "get_node": get_node,
        "cluster_summary": cluster_summary,
        "neighbors": neighbours,
        "top_nodes": ranked,
        "search_nodes": searched,
        "resolve": lambda text, limit=20: {"rows": _records(matches(a, str(text)).orderBy("rank").limit(at_most(limit)))},
        "find_paths": paths,
        "common_counterparties": common,
    }
    if name not in tools:
        out = {"error": "unknown_tool", "message": f"{name}: one of {', '.join(sorted(tools))}"}
    else:
        try:
            out = tools[name](**(arguments or {}))
        except Ambiguous as error:
            out = {"error": "ambiguous", "message": str(error), "matches": [str(g) for g in error.matches]}
        except LookupError as error:
            out = {"error": "not_found", "message": str(error)}
        except (TypeError, ValueError) as error:
            out = {"error": "bad_arguments", "message": str(error)}
    return json.dumps(out, ensure_ascii=False, default=str)[:MOST_CHARS]
