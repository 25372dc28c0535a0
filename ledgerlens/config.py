"""Thresholds and weights, and the fixed vocabulary of results."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    """They decide the results. Override for other data."""

    max_observed_out_depth: int = 3
    period_end: str = "2026-07-31"
    late_days: int = 2
    late_share: float = 0.5
    fast_lag_days: int = 2
    hub_min_in: int = 8
    hub_min_out: int = 20
    hub_full_in: int = 20
    hub_full_out: int = 80
    coord_min_seed_payees: int = 3
    coord_full_seed_payees: int = 6
    bridge_btw_quantile: float = 0.99
    bridge_min_seed_clusters: int = 4
    bridge_full_seed_clusters: int = 8
    distr_min_out: int = 10
    distr_fan_ratio: float = 3.0
    distr_strong_out: int = 60
    cons_min_in: int = 4
    cons_min_seed_payers: int = 2
    cons_strong_in: int = 15
    cons_full_seed_payers: int = 4
    transit_lo: float = 0.8
    transit_hi: float = 1.2
    transit_weak_lo: float = 0.5
    fast_share_min: float = 0.8
    seed_transit_cap: float = 0.6
    term_min_kzt: float = 30_000.0
    term_min_tx: int = 2
    term_max_out_share: float = 0.10
    term_full_kzt: float = 1_000_000.0
    late_penalty: float = 0.6
    trunc_forward_cut: float = 0.5
    trunc_transit_cap: float = 0.6
    p_forward_prior: float = 10.0
    weights: dict = field(default_factory=lambda: {"role": 0.35, "flow": 0.25, "centrality": 0.20, "seed": 0.10, "flags": 0.10})
    seed_discount: float = 0.9
    role_weight: dict = field(default_factory=lambda: {"coordinator": 1.0, "consolidator": 0.9, "distributor": 0.8, "transit": 0.6, "terminal": 0.5, "peripheral": 0.1})
    top_n: int = 50
    resolution: float = 1.0
    stability_runs: int = 10
    burst_in_payers: int = 3
    burst_out_recipients: int = 5
    route_min_dates: int = 2
    repeat_amount_min: int = 3
    anomaly_z: float = 3.5
    cycle_max_len: int = 5
    unseen_min_kzt: float = 100_000.0
    request_min_kzt: float = 300_000.0


#: The test network's period ends here.
EVENTS = Config(period_end="2024-01-30")

# Names of results.
ROLES = ("coordinator", "consolidator", "distributor", "transit", "terminal", "peripheral")
ROLE_NAMES = {"coordinator": "Координатор", "consolidator": "Консолидатор", "distributor": "Распределитель", "transit": "Транзит", "terminal": "Конечный получатель", "peripheral": "Периферия"}
TYPOLOGIES = {"coordinator": "", "consolidator": "funnel account (воронка)", "distributor": "fan-out payouts", "transit": "pass-through / money mule layering", "terminal": "", "peripheral": ""}
RAPID = "rapid movement of funds"
SIGNALS = ("fast_transit", "burst_in", "burst_out", "in_cycle", "repeat_route", "repeat_amounts", "anomaly")
FLAG_TEXTS = {
    "fast_transit": "rapid movement of funds: ушло дальше за ≤2 дн",
    "burst_in": "синхронные поступления от нескольких плательщиков в один день",
    "burst_out": "веерная рассылка многим получателям в один день",
    "in_cycle": "участвует в возвратном потоке (цикле)",
    "repeat_route": "устойчивый повторяющийся маршрут A→B→C",
    "repeat_amounts": "повторяющиеся одинаковые суммы",
    "anomaly": "аномальный профиль относительно своего колена",
    "unseen_inflow": "отдаёт больше, чем получил в выборке (невидимые входящие)",
    "late_inflow": "основные поступления 30–31 июля (продолжение в августе не видно)",
    "truncated": "4-е колено: исходящие не выгружены",
}
CONFIDENCE = ((0.8, "сильно"), (0.6, "умеренно"), (0.0, "слабо"))
PRIORITY = ((50, "высокий"), (200, "средний"), (None, "низкий"))
