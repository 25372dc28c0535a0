"""Cards: every line of a node, lists of matches, misses, amounts."""

from __future__ import annotations

import datetime
from types import SimpleNamespace

from pyspark.sql import functions as F

from ledgerlens.operators import cards


def test_cards(spark):
    day = lambda k: datetime.date(2024, 1, k)
    tx = spark.createDataFrame([(11, 21, day(k), 600_000.0) for k in (1, 2, 3, 4)] + [(31, 21, day(2), 5_000.0)], "src long, dst long, date date, sum_kzt double")
    names = "gid long, role string, role_score double, alt_role string, typology string, rule_fired string, evidence string, rank int, priority_score double, cluster_id int, sink_status string, truncated boolean, p_forward double, is_seed boolean, depth int, in_deg long, out_deg long, in_tx long, out_tx long, in_kzt double, out_kzt double, fast_share double, pagerank double, betweenness double, flags array<string>"
    row = lambda gid, rank: (gid, "terminal", 0.85, "-" if gid == 77 else "transit", "", "rule", "why 1", rank, 0.5, 1, "truncated_depth", True, 0.4, gid == 11, 4, 2, 0, 5, 0, 2_405_000.0, 0.0, None, 0.01, 0.0, ["in_cycle"])
    scored = spark.createDataFrame([row(21, 1), row(11, 2), row(31, 3), row(77, 60)], names).withColumns({f"prio_{k}": F.lit(0.1) for k in cards.PARTS})
    table = spark.createDataFrame([(1, 4, 1, "h", 0.75)], "cluster_id int, n_nodes long, n_seed long, hypothesis string, stability double")
    a = SimpleNamespace(net=SimpleNamespace(transactions=tx), scored=scored, cluster_table=table)
    lines = cards.explain(a, "21").split("\n")
    assert lines[0] == "gid 21  [колено 4]" and lines[1] == "Роль: Конечный получатель — роль выражена сильно (85%) · также признаки: Транзит"
    assert lines[4].startswith("Приоритет проверки: высокий, №1 из 4 (балл 0.50 = роль 0.10 + ") and lines[5] == "Кластер 1 (4 узл., 1 seed, устойчивость 0.75): h"
    assert lines[6].endswith("оценка P(пересылает дальше) = 40%")
    assert lines[-3:] == ["Крупнейшие плательщики (2 из 2):", "  ← 11 [Конечный получатель, seed] 2,40 млн ₸, 4 перев. (01-01, 01-02, 01-03, …)", "  ← 31 [Конечный получатель] 5 000 ₸, 1 перев. (01-02)"]
    alone = cards.explain(a, "77")
    assert alone.endswith("Связей в выгрузке нет.") and "также признаки" not in alone
    several = cards.explain(a, "1").split("\n")
    assert several[0].startswith("Найдено 3 узлов") and several[2] == "  11  Конечный получатель, seed, приоритет высокий (№2), кластер 1"
    assert "не найден" in cards.explain(a, "999") and cards.card(a, 5).count() == 0
