"""Text cards of nodes, as one column expression over a node's row, and answers to a query by id or suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FLAG_TEXTS, ROLE_NAMES
from ..functions.scalars import money, number
from . import lookup, priority

# Words of the cards.
PARTS = {"role": "роль", "flow": "оборот", "centrality": "центральность", "seed": "связь с seed", "flags": "флаги"}
SINKS = {
    "confirmed_sink": "исходящих нет (выгружены полностью) — деньги остаются",
    "truncated_depth": "4-е колено: исходящие не выгружены (обрыв обхода)",
    "truncated_time": "поступления в конце июля: пересылка могла уйти в август",
    "not_sink": "есть исходящие переводы",
    "no_data": "нет переводов ≥5 000 ₸ в выгрузке",
}
MATCHES = 20


def _t(*parts) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def _named(names: dict[str, str], key: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[key], key)


def amount(x: Column) -> Column:
    """`money`, with whole units in groups of three below 10,000, and a dash for null."""
    small = F.concat(F.translate(F.format_number(F.rint(x), 0), ",", " "), F.lit(" ₸"))
    return F.when(x.isNull(), "—").when(F.abs(x) < 1e4, small).otherwise(money(x))


def _partners(rows: DataFrame, direction: str, title: str, arrow: str, most: int) -> DataFrame:
    """One row: the lines of a node's largest partners on one side, null where it has none. rows: as in `lookup.partner_table`."""
    side = rows.filter(F.col("direction") == direction)
    first = side.orderBy(F.desc("sum_kzt"), "other").limit(most)
    days = _t(F.array_join(F.transform(F.slice("days", 1, 3), lambda d: F.date_format(d, "MM-dd")), ", "), F.when(F.size("days") > 3, ", …").otherwise(""))
    line = _t(f"  {arrow} ", F.col("other"), " [", _named(ROLE_NAMES, F.coalesce("role", F.lit("?"))), F.when(F.col("is_seed"), ", seed").otherwise(""), "] ", amount(F.col("sum_kzt")), ", ", F.col("n_tx"), " перев. (", days, ")")
    lines = first.select(F.struct((-F.col("sum_kzt")).alias("s"), "other", line.alias("line")).alias("x")).agg(F.sort_array(F.collect_list("x"))["line"].alias("lines"))
    text = _t(title, " (", F.size("lines"), " из ", F.col("total"), "):\n", F.array_join("lines", "\n"))
    return lines.crossJoin(side.agg(F.count("*").alias("total"))).select(F.when(F.col("total") > 0, text).alias(f"{direction}_lines"))  # one row each


def card(a, gid: int, most: int = 5) -> DataFrame:
    """(gid, text) of one node of an analysis, of this session or saved; no row for an unknown id. At most `most` partners of a
    side are read out. Of a saved analysis, the node, its cluster and its partners are read from a bucket each."""
    c = F.col
    node = lookup.rows_of(a, "nodes", gid)
    if hasattr(a, "rows"):
        place = node.select("cluster_id").first()
        table, total = a.rows("clusters", place[0] if place else None), F.lit(a.total)
    else:
        table, total = a.cluster_table, None
    about = table.select("cluster_id", F.col("n_nodes").alias("k_nodes"), F.col("n_seed").alias("k_seed"), "hypothesis", "stability")
    row = node.join(about, "cluster_id", "left")
    row = row.withColumn("total", total) if total is not None else row.crossJoin(a.scored.agg(F.count("*").alias("total")))
    partners = lookup.rows_of(a, "partners", gid)
    row = row.crossJoin(_partners(partners, "in", "Крупнейшие плательщики", "←", most)).crossJoin(_partners(partners, "out", "Крупнейшие получатели", "→", most))
    filled = lambda name: ~F.coalesce(c(name), F.lit("")).isin("", "-")
    parts = F.concat_ws(" + ", *(_t(f"{word} ", number(c(f"prio_{k}"), 2)) for k, word in PARTS.items()))
    cluster = _t("Кластер ", c("cluster_id"), F.when(c("k_nodes").isNotNull(), _t(" (", c("k_nodes"), " узл., ", c("k_seed"), " seed", F.coalesce(_t(", устойчивость ", number(c("stability"), 2)), F.lit("")), "): ", F.coalesce("hypothesis", F.lit("")))).otherwise(""))
    guess = F.when(c("truncated") & c("p_forward").isNotNull(), _t("; оценка P(пересылает дальше) = ", number(c("p_forward") * 100, 0), "%")).otherwise("")
    side = lambda k, who: (c(f"{k}_deg"), f" {who}, ", c(f"{k}_tx"), " перев., ", amount(c(f"{k}_kzt")))
    text = F.concat_ws(
        "\n",
        _t("gid ", c("gid"), "  [", F.when(c("is_seed"), "seed, ").otherwise(""), "колено ", c("depth"), "]"),
        _t("Роль: ", _named(ROLE_NAMES, c("role")), " — роль выражена ", priority.confidence_label(c("role_score")), " (", number(c("role_score") * 100, 0), "%)",
           F.when(filled("alt_role"), _t(" · также признаки: ", _named(ROLE_NAMES, c("alt_role")))).otherwise("")),
        F.when(filled("typology"), _t("Типология AML: ", c("typology"))),
        F.when(filled("rule_fired"), _t("Правило: ", c("rule_fired"))),
        F.when(filled("evidence"), _t("Обоснование: ", c("evidence"))),
        _t("Приоритет проверки: ", priority.priority_label(c("rank")), ", №", c("rank"), " из ", c("total"), " (балл ", number(c("priority_score"), 2), " = ", parts, ")"),
        cluster,
        _t("Статус стока: ", _named(SINKS, c("sink_status")), guess),
        F.when(F.size("flags") > 0, _t("Флаги: ", F.array_join(F.transform("flags", lambda f: _named(FLAG_TEXTS, f)), "; "))),
        _t("Метрики: входящие — ", *side("in", "плательщ."), "; исходящие — ", *side("out", "получат."),
           F.when(c("fast_share").isNotNull(), _t("; переслано за ≤2 дн: ", number(c("fast_share") * 100, 0), "% входящих")).otherwise(""),
           "; PageRank ", number(c("pagerank"), 4), "; посредничество ", number(c("betweenness"), 4)),
        c("in_lines"), c("out_lines"),
        F.when(c("in_lines").isNull() & c("out_lines").isNull(), "Связей в выгрузке нет."),
    )
    return row.select("gid", text.alias("text"))


def match_line() -> Column:
    """A node's line in a list of matches."""
    c = F.col
    return _t("  ", c("gid"), "  ", _named(ROLE_NAMES, c("role")), F.when(c("is_seed"), ", seed").otherwise(""), ", приоритет ", priority.priority_label(c("rank")), " (№", c("rank"), "), кластер ", c("cluster_id"))


def explain(a, text: str) -> str:
    """The card of the only match of a query; the first MATCHES matches by rank if there are more; else that there is none."""
    found = lookup.matches(a, text)
    n = found.count()
    if not n:
        return f"Узел по запросу «{text}» не найден (искали полный gid, окончание и подстроку)."
    if n == 1:
        return card(a, found.first()["gid"]).first()["text"]
    first = a.scored.join(found.select("gid"), "gid").orderBy("rank").limit(MATCHES).select("rank", match_line().alias("line")).orderBy("rank").collect()
    return "\n".join([f"Найдено {n} узлов по «{text}» — уточните (показаны {len(first)} по приоритету):", *(r["line"] for r in first)])
