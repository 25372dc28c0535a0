"""Roles of nodes: an ordered list of rules, the first that holds decides.

Every rule is a condition and a struct of results; the list is one CASE expression, so all nodes are decided in one pass
without a shuffle. Texts are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RAPID, TYPOLOGIES, Config
from ..functions.cuts import Scratch, average_rank
from ..functions.order import quantiles
from ..functions.scalars import clip_text, counted, money, number, percent, plural, ramp, rnd, score, times

L = F.lit


def _t(*parts) -> Column:
    """Text of parts; columns are cast."""
    return F.concat(*(p.cast("string") if isinstance(p, Column) else L(p) for p in parts))


def payers(n: Column) -> Column:
    return counted(n, "плательщика", "плательщиков", "плательщиков")


def payees(n: Column) -> Column:
    return counted(n, "получателю", "получателям", "получателям")


def transfers(n: Column) -> Column:
    return counted(n, "перевод", "перевода", "переводов")


def flow_line() -> Column:
    c = F.col
    got = F.when(c("in_deg") > 0, _t("получил ", money(c("in_kzt")), " от ", payers(c("in_deg")), " (", transfers(c("in_tx")), ")"))
    sent = F.when(c("out_deg") > 0, _t("отправил ", money(c("out_kzt")), " ", payees(c("out_deg")), " (", transfers(c("out_tx")), ")"))
    return F.concat_ws(", ", got, sent)


def _result(role: str, role_score: Column, rule: Column, alt: Column | str, evidence: Column, sink: Column | str) -> Column:
    col = lambda x: L(x) if isinstance(x, str) else x
    return F.struct(
        L(role).alias("role"), role_score.cast("double").alias("role_score"), rule.alias("rule_fired"), col(alt).alias("alt_role"),
        clip_text(evidence).alias("evidence"), col(sink).alias("sink_status"),
    )


def decide(cfg: Config) -> Column:
    """The decision of a row with the node's features, `ratio` (inf without inflow), `fast`, `late`, `span`, `btw_cut` and `activity`."""
    c = F.col
    ratio, fast, late, p = c("ratio"), c("fast"), c("late"), c("p_forward")
    seeds = F.when(c("seed_in") > 0, _t("; seed среди плательщиков: ", c("seed_in"))).otherwise("")

    hub = (c("in_deg") >= cfg.hub_min_in) & (c("out_deg") >= cfg.hub_min_out)
    pays = c("seed_out") >= cfg.coord_min_seed_payees
    bridge = (c("betweenness") >= c("btw_cut")) & (c("betweenness") > 0) & (c("span") >= cfg.bridge_min_seed_clusters)
    option = lambda cond, order, s, rule, text: F.when(cond, F.struct(s.alias("s"), L(-order).alias("o"), rule.alias("rule"), text.alias("text")))
    best = F.array_max(F.array_compact(F.array(
        option(hub, 1, score(ramp(c("in_deg"), cfg.hub_min_in, cfg.hub_full_in), ramp(c("out_deg"), cfg.hub_min_out, cfg.hub_full_out)),
               _t("R1 хаб: in_deg=", c("in_deg"), f"≥{cfg.hub_min_in}, out_deg=", c("out_deg"), f"≥{cfg.hub_min_out}"),
               _t("Хаб: собирает от ", payers(c("in_deg")), " (", money(c("in_kzt")), ") и раздаёт ", payees(c("out_deg")), " (", money(c("out_kzt")), "); связан с ", c("span"), " кластерами с seed")),
        option(pays, 2, score(ramp(c("seed_out"), cfg.coord_min_seed_payees, cfg.coord_full_seed_payees)),
               _t("R1 платит seed: seed-получателей=", c("seed_out"), f"≥{cfg.coord_min_seed_payees}"),
               _t("Платит ", c("seed_out"), " известным участникам (seed); ", flow_line())),
        option(bridge, 3, score(ramp(c("span"), cfg.bridge_min_seed_clusters, cfg.bridge_full_seed_clusters)),
               _t("R1 мост: посредничество ", number(c("betweenness"), 4), " (топ-1%), кластеров с seed=", c("span")),
               _t("Мост между ", c("span"), " кластерами с seed (посредничество в топ-1%); ", flow_line())),
    )))
    many = c("out_deg") >= cfg.distr_min_out
    fans = many & (c("out_deg") >= cfg.distr_fan_ratio * F.greatest(c("in_deg"), L(1)))
    gathers = (c("in_deg") >= cfg.cons_min_in) | (c("seed_in") >= cfg.cons_min_seed_payers)
    coordinator = _result("coordinator", best["s"], best["rule"], F.when(fans, "distributor").when(gathers, "consolidator").otherwise("-"), _t(best["text"], seeds), "not_sink")

    spreads = fans & (~gathers | (c("out_deg") / cfg.distr_min_out >= c("in_deg") / cfg.cons_min_in))
    text = _t("Веерная раздача: ", money(c("out_kzt")), " ", payees(c("out_deg")), " (", transfers(c("out_tx")), ", в среднем ", money(c("avg_out")), ")",
              F.when(c("in_deg") > 0, _t("; получил ", money(c("in_kzt")), " от ", payers(c("in_deg")))).otherwise("; входящие вне выборки"),
              F.when(c("burst_out") >= cfg.burst_out_recipients, _t("; ", c("burst_out"), " ", plural(c("burst_out"), "получатель", "получателя", "получателей"), " за один день (", c("burst_out_day"), ")")).otherwise(""))
    distributor = _result("distributor", score(ramp(c("out_deg"), cfg.distr_min_out, cfg.distr_strong_out)), _t("R2: out_deg=", c("out_deg"), f"≥{cfg.distr_min_out} и ≥{cfg.distr_fan_ratio:g}×in_deg"), F.when(gathers, "consolidator").otherwise("-"), text, "not_sink")

    sink = F.when(c("truncated"), "truncated_depth").when(c("out_deg") > 0, "not_sink").when(late, "truncated_time").otherwise("confirmed_sink")
    onward = (
        F.when(c("truncated"), "; 4-е колено: исходящие не выгружены")
        .when((c("out_deg") > 0) & (ratio <= cfg.transit_hi), _t("; дальше ушло ", percent(ratio), " полученного ", payees(c("out_deg"))))
        .when(c("out_deg") > 0, _t("; отправил ", payees(c("out_deg")), " в ", times(ratio), " больше полученного (невидимые входящие)"))
        .otherwise("; дальше не отправлял")
    )
    text = _t("Получает от ", payers(c("in_deg")), ": ", money(c("in_kzt")), ", ", transfers(c("in_tx")), " (в среднем ", money(c("avg_in")), ")", seeds, onward,
              F.when(c("burst_in") >= cfg.burst_in_payers, _t("; ", c("burst_in"), " ", plural(c("burst_in"), "плательщик", "плательщика", "плательщиков"), " за один день (", c("burst_in_day"), ")")).otherwise(""))
    rule = F.when(c("in_deg") >= cfg.cons_min_in, _t("R3: in_deg=", c("in_deg"), f"≥{cfg.cons_min_in}")).otherwise(_t("R3: seed-плательщиков=", c("seed_in"), f"≥{cfg.cons_min_seed_payers}"))
    strength = F.greatest(ramp(c("in_deg"), cfg.cons_min_in, cfg.cons_strong_in), ramp(c("seed_in"), cfg.cons_min_seed_payers, cfg.cons_full_seed_payers))
    consolidator = _result("consolidator", score(strength), rule, F.when(many, "distributor").when(sink == "confirmed_sink", "terminal").otherwise("-"), text, sink)

    material = (c("in_kzt") >= cfg.term_min_kzt) | (c("in_tx") >= cfg.term_min_tx)
    hidden = _t("4-е колено, исходящие не выгружены; ", flow_line(), ". У узлов колен 1–3 с таким профилем пересылают дальше ", percent(p))
    slight = _result("peripheral", rnd(1 - c("activity"), 3), _t("R6: разовый перевод ", money(c("in_kzt")), " < ", money(L(cfg.term_min_kzt))), "-", _t("Разовый перевод ", money(c("in_kzt")), " от ", payers(c("in_deg")), "; 4-е колено, исходящие не выгружены"), "truncated_depth")
    stays = _result("terminal", rnd(1 - p, 3), _t("T4: p_forward=", number(p, 2), f"<{cfg.trunc_forward_cut} (оценка по коленам 1–3)"), "transit", hidden, "truncated_depth")
    moves = _result("transit", rnd(F.least(p, L(cfg.trunc_transit_cap)), 3), _t("T4: p_forward=", number(p, 2), f"≥{cfg.trunc_forward_cut} (оценка)"), "terminal", hidden, "truncated_depth")

    seed_only = (c("out_deg") > 0) & c("is_seed") & (c("in_kzt") == 0)
    seed = _result("transit", F.least(score(ramp(c("out_kzt"), cfg.term_min_kzt, cfg.term_full_kzt)), L(cfg.seed_transit_cap)), L("R4s: seed с исходящими, входящие не наблюдаются"), "-",
                   _t("Seed: входящие вне выгрузки; отправил ", money(c("out_kzt")), " ", payees(c("out_deg")), " (", transfers(c("out_tx")), ") — передаёт средства дальше по цепочке"), "not_sink")

    passes = (c("out_deg") > 0) & (c("in_deg") > 0) & ((ratio >= cfg.transit_weak_lo) | (fast >= cfg.fast_share_min))
    close = (
        F.when(ratio.between(cfg.transit_lo, cfg.transit_hi), 1.0)
        .when(ratio > cfg.transit_hi, F.greatest(L(0.0), 1 - F.log(ratio / cfg.transit_hi) / F.log(L(10.0))))
        .otherwise(L(0.5) * (ratio - cfg.transit_weak_lo) / L(cfg.transit_lo - cfg.transit_weak_lo))
    )
    s = rnd(L(0.5) + L(0.3) * close + L(0.2) * fast, 3)
    s = F.when(c("is_seed"), F.least(s, L(cfg.seed_transit_cap))).otherwise(s)
    over = ratio > cfg.transit_hi
    text = _t(flow_line(), "; ", F.when(over, _t("отправил в ", times(ratio), " больше полученного → есть невидимые входящие")).otherwise(_t("дальше ушло ", percent(ratio))),
              F.when(fast > 0, _t("; ", percent(fast), f" полученного ушло за ≤{cfg.fast_lag_days} дн")).otherwise(""), seeds)
    rule = F.when(over, _t("R4: out/in=", number(ratio, 2), f">{cfg.transit_hi} (невидимые входящие)")).otherwise(_t("R4: out/in=", number(ratio, 2), F.when(ratio >= cfg.transit_lo, f"∈[{cfg.transit_lo};{cfg.transit_hi}]").otherwise(f"≥{cfg.transit_weak_lo}")))
    transit = _result("transit", s, rule, "-", F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, L(2))), "not_sink")

    ends = (c("in_deg") > 0) & (ratio <= cfg.term_max_out_share) & material
    s = score(ramp(c("in_kzt"), cfg.term_min_kzt, cfg.term_full_kzt), 1 - ratio / cfg.term_max_out_share)
    text = _t("Получил ", money(c("in_kzt")), " от ", payers(c("in_deg")), " (", transfers(c("in_tx")), "), дальше ушло ", percent(ratio), F.when(late, _t("; ", percent(c("late_in_share")), " поступило 30–31 июля — август не виден")).otherwise(""), seeds)
    terminal = _result("terminal", F.when(late, rnd(s * cfg.late_penalty, 3)).otherwise(s), _t("R5: out/in=", number(ratio, 2), f"≤{cfg.term_max_out_share}, in=", money(c("in_kzt"))), "-", text, F.when(late, "truncated_time").otherwise("confirmed_sink"))

    low = rnd(F.greatest(L(0.05), 1 - c("activity")), 3)
    nothing = _result("peripheral", L(1.0), L("R6: нет переводов ≥5 000 ₸"), "-", L("Seed без внутрибанковских переводов ≥5 000 ₸ за июль: 0 входящих и 0 исходящих — данных для роли нет"), "no_data")
    once = _result("peripheral", low, _t("R6: in=", money(c("in_kzt")), "<", money(L(cfg.term_min_kzt)), " и 1 перевод"), "-", _t("Разовое поступление: ", money(c("in_kzt")), " от ", payers(c("in_deg")), " (", transfers(c("in_tx")), "); дальше не отправлял", seeds), F.when(late, "truncated_time").otherwise("confirmed_sink"))
    mixed = _result("peripheral", low, _t("R6: out/in=", number(ratio, 2), f" между {cfg.term_max_out_share} и {cfg.transit_weak_lo}"), "-", _t("Смешанный профиль: ", flow_line(), "; дальше ушло ", percent(F.least(ratio, L(1.0))), seeds), "not_sink")

    return (
        F.when(hub | pays | bridge, coordinator).when(spreads, distributor).when(gathers, consolidator)
        .when(c("truncated") & ~material, slight).when(c("truncated") & (p < cfg.trunc_forward_cut), stays).when(c("truncated"), moves)
        .when(seed_only, seed).when(passes, transit).when(ends, terminal)
        .when((c("in_deg") == 0) & (c("out_deg") == 0), nothing).when(c("out_deg") == 0, once).otherwise(mixed)
    )


def with_activity(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds activity: percentile of money moved, ties averaged."""
    n = nodes.count()
    df = average_rank(nodes.withColumn("__x", F.log1p(F.col("in_kzt") + F.col("out_kzt"))), "__x", scratch, "__r")
    return df.withColumn("activity", F.col("__r") / F.lit(float(max(n, 1)))).drop("__x", "__r")


def assign(nodes: DataFrame, span: DataFrame, cfg: Config, scratch: Scratch) -> DataFrame:
    """nodes (all features and cluster_id) with role, role_score, rule_fired, alt_role, evidence, sink_status, activity, span."""
    cut = quantiles(nodes.select("betweenness"), [], "betweenness", {"btw_cut": cfg.bridge_btw_quantile}, scratch)
    df = with_activity(nodes, scratch).join(span, "gid").crossJoin(F.broadcast(cut))
    df = df.withColumns({
        "ratio": F.when(F.col("in_kzt") > 0, F.col("out_kzt") / F.col("in_kzt")).otherwise(float("inf")),
        "fast": F.coalesce("fast_share", F.lit(0.0)),
        "late": (F.col("late_in_share") >= cfg.late_share) & (F.col("in_deg") > 0),
        "burst_in_day": F.coalesce(F.date_format("burst_in_date", "dd.MM"), F.lit("")),
        "burst_out_day": F.coalesce(F.date_format("burst_out_date", "dd.MM"), F.lit("")),
    })
    return df.withColumn("d", decide(cfg)).select(*nodes.columns, "activity", "span", "d.*")


def typology() -> Column:
    """Names of money-laundering typologies of a row with role and flags."""
    of_role = F.lit(None).cast("string")
    for role, name in TYPOLOGIES.items():
        if name:
            of_role = F.when(F.col("role") == role, name).otherwise(of_role)
    return F.concat_ws("; ", of_role, F.when(F.array_contains("flags", "fast_transit"), RAPID))
