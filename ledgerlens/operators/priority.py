"""Flags, the review priority with its parts, its sensitivity, explanations and data requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIDENCE, FLAG_TEXTS, PRIORITY, ROLE_NAMES, SIGNALS, Config
from ..functions.cuts import Scratch, average_rank, numbered
from ..functions.scalars import money, number, rnd
from .temporal import robust_z


def anomaly(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds anomaly_z: the larger robust z of money and transfers among nodes of one depth, rounded to 2 digits."""
    df = nodes.withColumns({"__v": F.log1p(F.col("in_kzt") + F.col("out_kzt")), "__c": F.log1p(F.col("in_tx") + F.col("out_tx"))})
    df = robust_z(df, "depth", {"__v": "__zv", "__c": "__zc"}, scratch)
    return df.withColumn("anomaly_z", rnd(F.greatest("__zv", "__zc"), 2)).drop("__v", "__c", "__zv", "__zc")


def flags(nodes: DataFrame, cycle_nodes: DataFrame, route_nodes: DataFrame, cfg: Config) -> DataFrame:
    """Adds flags: array of codes in a fixed order. cycle_nodes and route_nodes are tables of gid."""
    mark = lambda df, name: df.select("gid").distinct().withColumn(name, F.lit(True))
    df = nodes.join(mark(cycle_nodes, "__cycle"), "gid", "left").join(mark(route_nodes, "__route"), "gid", "left")
    c = F.col
    late = (c("late_in_share") >= cfg.late_share) & (c("in_deg") > 0) & (c("out_deg") == 0) & ~c("truncated")
    when = {
        "fast_transit": c("fast_share") >= cfg.fast_share_min,
        "burst_in": c("burst_in") >= cfg.burst_in_payers,
        "burst_out": c("burst_out") >= cfg.burst_out_recipients,
        "in_cycle": c("__cycle"),
        "repeat_route": c("__route"),
        "repeat_amounts": c("repeat_amount_n") >= cfg.repeat_amount_min,
        "anomaly": c("anomaly_z") >= cfg.anomaly_z,
        "unseen_inflow": (c("unseen_inflow_kzt") >= cfg.unseen_min_kzt) & ~c("is_seed"),
        "late_inflow": late,
        "truncated": c("truncated"),
    }
    return df.withColumn("flags", F.array_compact(F.array(*(F.when(cond, name) for name, cond in when.items())))).drop("__cycle", "__route")


def components(nodes: DataFrame, cfg: Config, scratch: Scratch) -> DataFrame:
    """Adds the five parts c_role, c_flow, c_centrality, c_seed, c_flags, each in 0..1."""
    n = float(max(nodes.count(), 1))
    df = average_rank(average_rank(nodes, "pagerank", scratch, "__p"), "betweenness", scratch, "__b")
    weight = F.lit(0.0)
    for role, w in cfg.role_weight.items():
        weight = F.when(F.col("role") == role, w).otherwise(weight)
    signals = F.size(F.array_intersect("flags", F.array(*(F.lit(s) for s in SIGNALS))))
    return df.withColumns({
        "c_role": weight * F.col("role_score"), "c_flow": F.col("activity"),
        "c_centrality": F.greatest(F.col("__p") / n, F.col("__b") / n),
        "c_seed": F.least(F.lit(1.0), (F.col("seed_in") + F.col("seed_out")) / 3),
        "c_flags": F.least(F.lit(1.0), signals / 3),
    }).drop("__p", "__b")


def _weighted(weights: dict, cfg: Config) -> Column:
    total = F.lit(0.0)
    for k, w in weights.items():
        total = total + F.col(f"c_{k}") * F.lit(w)
    disc = F.when(F.col("is_seed"), cfg.seed_discount).otherwise(1.0)
    return rnd(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total * disc)), 4)




def score(parts: DataFrame, cfg: Config, scratch: Scratch) -> DataFrame:
    """Adds priority_score, prio_<part> and rank (1 = first; by score, inflow, gid)."""
    disc = F.when(F.col("is_seed"), cfg.seed_discount).otherwise(1.0)
    df = parts.withColumn("priority_score", _weighted(cfg.weights, cfg))
    df = df.withColumns({f"prio_{k}": rnd(F.col(f"c_{k}") * F.lit(w) * disc, 4) for k, w in cfg.weights.items()})
    return numbered(df, [F.desc("priority_score"), F.desc("in_kzt"), F.asc("gid")], scratch, "rank")


def variants(cfg: Config) -> list[dict]:
    """Each weight by a fifth less and more, all rescaled to one."""
    out = []
    for name in cfg.weights:
        for f in (0.8, 1.2):
            w = {k: v * f if k == name else v for k, v in cfg.weights.items()}
            out.append({k: v / sum(w.values()) for k, v in w.items()})
    return out


def sensitivity(scored: DataFrame, cfg: Config, k: int = 20) -> DataFrame:
    """One row (k, min_overlap, mean_overlap): how much of the top k stays when weights change.

    All variants are scored in one pass; each keeps its top k by a limit per variant, not by an order over all rows.
    """
    scores = F.explode(F.array(*(F.struct(F.lit(i).alias("variant"), _weighted(w, cfg).alias("s")) for i, w in enumerate(variants(cfg)))))
    rows = scored.select("gid", "in_kzt", "rank", scores.alias("v")).select("gid", "in_kzt", "rank", "v.*")
    nth = F.row_number().over(Window.partitionBy("variant").orderBy(F.desc("s"), F.desc("in_kzt"), "gid"))
    hits = rows.withColumn("nth", nth).filter(F.col("nth") <= k).groupBy("variant").agg(F.sum((F.col("rank") <= k).cast("int")).alias("hits"))
    share = F.col("hits") / F.lit(float(k))
    return hits.agg(F.lit(k).alias("k"), rnd(F.min(share), 3).alias("min_overlap"), rnd(F.avg(share), 3).alias("mean_overlap"))


def _label(levels, x: Column, up: bool) -> Column:
    out = F.lit(levels[-1][1])
    for bound, text in reversed(levels[:-1]):
        out = F.when(x >= bound if up else x <= bound, text).otherwise(out)
    return out


def confidence_label(x: Column) -> Column:
    return _label(CONFIDENCE, F.coalesce(x, F.lit(0.0)), True)


def priority_label(rank: Column) -> Column:
    return _label(PRIORITY, rank, False)


def why(hypothesis: str = "hypothesis") -> Column:
    """Explanation of a scored row with its cluster's hypothesis. Texts are fixed values."""
    c = F.col
    name = F.lit("")
    for role, text in ROLE_NAMES.items():
        name = F.when(c("role") == role, text).otherwise(name)
    typ = F.when(c("typology") != "", F.concat(F.lit(" — "), c("typology"))).otherwise("")
    head = F.concat(name, typ, F.lit(" (уверенность "), number(c("role_score"), 2), F.lit("; "), c("rule_fired"), F.lit("). "), c("evidence"))
    texts = F.create_map(*(F.lit(x) for pair in FLAG_TEXTS.items() for x in pair))
    shown = F.array_intersect("flags", F.array(*(F.lit(s) for s in (*SIGNALS, "unseen_inflow"))))
    signals = F.when(F.size(shown) > 0, F.concat(F.lit("Сигналы: "), F.array_join(F.transform(shown, lambda f: F.element_at(texts, f)), "; ")))
    parts = F.concat(
        F.lit("Приоритет "), number(c("priority_score"), 3), F.lit(" = роль "), number(c("prio_role"), 3), F.lit(" + оборот "), number(c("prio_flow"), 3),
        F.lit(" + центральность "), number(c("prio_centrality"), 3), F.lit(" + связь с seed "), number(c("prio_seed"), 3), F.lit(" + сигналы "), number(c("prio_flags"), 3),
        F.when(c("is_seed"), " (×0,9: уже известный seed)").otherwise(""),
    )
    cluster = F.concat(F.lit("Кластер "), c("cluster_id"), F.lit(": "), c(hypothesis))
    trimmed = [F.rtrim(x, F.lit(".")) for x in (head, signals, parts, cluster)]
    return F.concat(F.concat_ws(". ", *trimmed), F.lit("."))


def data_requests(scored: DataFrame, cfg: Config) -> DataFrame:
    """(gid, request, reason, node_priority): which data would close a gap; up to four rows a node, one scan."""
    c = F.col
    row = lambda cond, request, reason: F.when(cond, F.struct(F.lit(request).alias("request"), reason.alias("reason")))
    rules = F.array_compact(F.array(
        row(c("sink_status") == "no_data", "Наличные/межбанковские операции и переводы < 5 000 ₸", F.lit("seed без внутрибанковских переводов ≥5 000 ₸ за июль")),
        row(c("truncated") & (c("role").isin("consolidator", "transit") | (c("in_kzt") >= cfg.request_min_kzt)), "Выписка исходящих за июль–август",
            F.concat(F.lit("4-е колено: исходящие не выгружены; получил "), money(c("in_kzt")), F.lit(", p_forward="), number(c("p_forward"), 2))),
        row((c("unseen_inflow_kzt") >= cfg.unseen_min_kzt) & ~c("truncated"), "Входящие переводы от клиентов вне выборки / других банков",
            F.concat(F.lit("отправил на "), money(c("unseen_inflow_kzt")), F.lit(" больше, чем получил в выборке"))),
        row(c("sink_status") == "truncated_time", "Операции за август 2026",
            F.concat(F.lit("основные поступления 30–31 июля ("), money(c("in_kzt")), F.lit("), продолжение не видно"))),
    ))
    return scored.select("gid", F.explode(rules).alias("r"), c("priority_score").alias("node_priority")).select("gid", "r.*", "node_priority")
