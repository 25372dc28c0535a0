"""DuckDB SQL of the registered queries, put together from named parts."""

from __future__ import annotations

from ..config import CONFIDENCE, PRIORITY, ROLE_NAMES

PAGERANK_STEPS = 30


def _r(x: str, digits: int = 6) -> str:
    return f"round_even(({x}) * 1e{digits}, 0) / 1e{digits}"


NET = """
p   AS (SELECT max(user_id) + 1 AS n, greatest(1, (max(user_id) + 1) // 30) AS h FROM events),
raw AS (SELECT CASE WHEN event_id % 5 = 0 THEN (user_id % h) * 30 + 7 ELSE user_id END AS src,
               CASE WHEN k < 55 THEN (user_id // 10) * 10 + (user_id + 1 + k % 3) % 10
                    WHEN k < 75 THEN ((user_id // 30 + k % 3) % h) * 30 + 7 + least(k % 4, 1) * 4
                    ELSE (user_id * 7 + k * 13) % n END AS dst,
               CAST(ts AS DATE) AS date,
               CASE WHEN event_id % 3 < 2 THEN (floor(value) - 120) * 1000 + 5000 ELSE round_even(((value - 120) * 1000 + 5000) * 100, 0) / 100 END AS sum_kzt
        FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), p WHERE value >= 120),
t0  AS MATERIALIZED (SELECT * FROM raw WHERE src <> dst),
e0  AS (SELECT DISTINCT src, dst FROM t0),
bfs AS (SELECT user_id AS gid, 0 AS lvl FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 28 = 3
        UNION SELECT e0.dst, lvl + 1 FROM bfs JOIN e0 ON e0.src = bfs.gid WHERE lvl < 4),
nodes AS MATERIALIZED (SELECT gid, CAST(min(lvl) AS INTEGER) AS depth, min(lvl) = 0 AS is_seed FROM bfs GROUP BY gid),
tx  AS MATERIALIZED (SELECT t0.* FROM t0 JOIN nodes ON nodes.gid = t0.src WHERE depth <= 3),
edges AS MATERIALIZED (SELECT src, dst, sum(sum_kzt) AS sum_kzt, count(*) AS n_tx FROM tx GROUP BY 1, 2)"""

PAIRS = "pairs AS MATERIALIZED (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(sum_kzt) AS weight FROM edges WHERE src <> dst GROUP BY 1, 2)"

STRUCT = f"""
i_ AS (SELECT dst AS gid, count(*) AS d, {_r('sum(sum_kzt)', 2)} AS k, sum(n_tx) AS t FROM edges GROUP BY 1),
o_ AS (SELECT src AS gid, count(*) AS d, {_r('sum(sum_kzt)', 2)} AS k, sum(n_tx) AS t FROM edges GROUP BY 1),
si AS (SELECT dst AS gid, count(*) AS n FROM edges WHERE src IN (SELECT gid FROM nodes WHERE is_seed) GROUP BY 1),
so AS (SELECT src AS gid, count(*) AS n FROM edges WHERE dst IN (SELECT gid FROM nodes WHERE is_seed) GROUP BY 1),
st AS MATERIALIZED (
  SELECT n.*, CAST(coalesce(i_.d, 0) AS BIGINT) AS in_deg, coalesce(i_.k, 0) AS in_kzt, CAST(coalesce(i_.t, 0) AS BIGINT) AS in_tx,
         CAST(coalesce(o_.d, 0) AS BIGINT) AS out_deg, coalesce(o_.k, 0) AS out_kzt, CAST(coalesce(o_.t, 0) AS BIGINT) AS out_tx,
         coalesce(si.n, 0) AS seed_in, coalesce(so.n, 0) AS seed_out, depth <= 3 AS observed_out, depth > 3 AS truncated,
         greatest(0.0, coalesce(o_.k, 0) - coalesce(i_.k, 0)) AS unseen
  FROM nodes n LEFT JOIN i_ USING (gid) LEFT JOIN o_ USING (gid) LEFT JOIN si USING (gid) LEFT JOIN so USING (gid))"""

FAST = """
fd AS (SELECT gid, date, sum(i) AS i, sum(o) AS o FROM (SELECT dst AS gid, date, sum_kzt AS i, 0.0 AS o FROM tx UNION ALL SELECT src, date, 0.0, sum_kzt FROM tx) GROUP BY 1, 2),
fb AS (SELECT gid, min(date) AS lo, max(date) AS hi, sum(i) AS total, min(date) FILTER (i > 0) AS fi, min(date) FILTER (o > 0) AS fo FROM fd GROUP BY 1 HAVING sum(i) > 0 AND sum(o) > 0),
fs AS (SELECT gid, lo AS day, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS f, 0 AS k FROM fb
       UNION ALL
       SELECT gid, CAST(day + 1 AS DATE), n0 - least(n0, greatest(o - n2 - n1, 0)), n1 - least(n1, greatest(o - n2, 0)), n2 - least(n2, o), f + least(o, n0 + n1 + n2), k + 1
       FROM (SELECT s.gid, s.day, s.f, s.k, coalesce(d.i, 0) AS n0, s.b0 AS n1, s.b1 AS n2, coalesce(d.o, 0) AS o
             FROM fs s JOIN fb ON fb.gid = s.gid AND s.day <= fb.hi LEFT JOIN fd d ON d.gid = s.gid AND d.date = s.day)),
fast AS MATERIALIZED (SELECT fs.gid, max(f) / any_value(total) AS fast_share, CAST(any_value(fo) - any_value(fi) AS INTEGER) AS first_lag FROM fs JOIN fb USING (gid) GROUP BY fs.gid)"""

LATE = "late AS (SELECT dst AS gid, coalesce(sum(sum_kzt) FILTER (date >= DATE '2024-01-29'), 0) / sum(sum_kzt) AS late_in_share FROM tx GROUP BY 1)"

BURST = """
bi AS (SELECT gid, max(n) AS n, min(date) FILTER (n = m) AS day FROM (SELECT *, max(n) OVER (PARTITION BY gid) AS m FROM (SELECT dst AS gid, date, count(DISTINCT src) AS n FROM tx GROUP BY 1, 2)) GROUP BY 1),
bo AS (SELECT gid, max(n) AS n, min(date) FILTER (n = m) AS day FROM (SELECT *, max(n) OVER (PARTITION BY gid) AS m FROM (SELECT src AS gid, date, count(DISTINCT dst) AS n FROM tx GROUP BY 1, 2)) GROUP BY 1),
burst AS (SELECT gid, coalesce(bi.n, 0) AS burst_in, bi.day AS burst_in_date, coalesce(bo.n, 0) AS burst_out, bo.day AS burst_out_date FROM bi FULL JOIN bo USING (gid))"""

REPEAT = """
rep AS (SELECT gid, sum_kzt AS repeat_amount, n AS repeat_amount_n FROM (
  SELECT dst AS gid, sum_kzt, count(*) AS n, count(DISTINCT src) AS payers FROM tx WHERE sum_kzt % 1000 = 0 GROUP BY 1, 2)
  WHERE n >= 3 AND payers >= 2 QUALIFY row_number() OVER (PARTITION BY gid ORDER BY n DESC, sum_kzt) = 1)"""

ROUTES = """
leg AS (SELECT DISTINCT t1.src AS a, t1.dst AS b, t2.dst AS c, t1.date AS d1, t1.sum_kzt AS s1, t2.date AS d2, t2.sum_kzt AS s2
        FROM tx t1 JOIN tx t2 ON t1.dst = t2.src AND t2.date - t1.date BETWEEN 0 AND 2 AND t1.src <> t2.dst),
routes AS (SELECT a, b, c, count(DISTINCT d1) AS n_dates, min(d1) AS first, max(d2) AS last,
                  (SELECT sum(s1) FROM (SELECT DISTINCT d1, s1 FROM leg x WHERE x.a = leg.a AND x.b = leg.b AND x.c = leg.c)) AS sum_in,
                  (SELECT sum(s2) FROM (SELECT DISTINCT d2, s2 FROM leg x WHERE x.a = leg.a AND x.b = leg.b AND x.c = leg.c)) AS sum_out
           FROM leg GROUP BY a, b, c HAVING count(DISTINCT d1) >= 2)"""

_DEG = "CASE WHEN in_deg = 2 THEN '2' WHEN in_deg BETWEEN 3 AND 4 THEN '3–4' WHEN in_deg >= 5 THEN '5+' ELSE '1' END"
_TX = "CASE WHEN in_tx BETWEEN 2 AND 4 THEN '2–4' WHEN in_tx >= 5 THEN '5+' ELSE '1' END"
FORWARD = f"""
tr AS (SELECT gid, depth, {_DEG} AS b_deg, {_TX} AS b_tx, CAST(out_deg > 0 AS INTEGER) AS fwd FROM st WHERE NOT is_seed AND depth BETWEEN 1 AND 3 AND in_deg > 0),
fw AS (SELECT b_deg, b_tx, (sum(fwd) + 10 * base) / (count(*) + 10) AS p, count(*) AS n, base FROM tr, (SELECT avg(fwd) AS base FROM tr) GROUP BY b_deg, b_tx, base),
pf AS (SELECT st.gid, CASE WHEN observed_out THEN CAST(out_deg > 0 AS DOUBLE) ELSE {_r('coalesce(fw.p, ' + _r('(SELECT max(base) FROM fw)', 3) + ')', 3)} END AS p_forward
       FROM st LEFT JOIN fw ON fw.b_deg = {_DEG} AND fw.b_tx = {_TX})"""
BACKTEST = """
f2 AS (SELECT b_deg, b_tx, (sum(fwd) + 10 * base) / (count(*) + 10) AS p, base FROM (SELECT * FROM tr WHERE depth <= 2), (SELECT avg(fwd) AS base FROM tr WHERE depth <= 2) GROUP BY b_deg, b_tx, base),
te AS (SELECT tr.fwd, coalesce(f2.p, (SELECT max(base) FROM f2)) AS pred FROM tr LEFT JOIN f2 USING (b_deg, b_tx) WHERE tr.depth = 3),
rk AS (SELECT *, rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0 AS r FROM te),
au AS (SELECT CASE WHEN sum(fwd) > 0 AND sum(1 - fwd) > 0 THEN (sum(r) FILTER (fwd = 1) - sum(fwd) * (sum(fwd) + 1) / 2) / (sum(fwd) * sum(1 - fwd)) END AS auc FROM rk),
cb AS (SELECT CASE WHEN pred <= 0.35 THEN '(0.0, 0.35]' WHEN pred <= 0.5 THEN '(0.35, 0.5]' WHEN pred <= 0.65 THEN '(0.5, 0.65]' ELSE '(0.65, 1.0]' END AS bin, avg(pred) AS predicted, avg(fwd) AS actual, count(*) AS n
       FROM te WHERE pred > 0 AND pred <= 1 GROUP BY 1)"""
ANOMALY = f"""
lv AS (SELECT gid, depth, ln(1 + in_kzt + out_kzt) AS v, ln(1.0 + in_tx + out_tx) AS c FROM st),
m1 AS (SELECT depth, median(v) AS mv, median(c) AS mc FROM lv GROUP BY 1),
m2 AS (SELECT depth, median(abs(v - mv)) AS dv, median(abs(c - mc)) AS dc FROM lv JOIN m1 USING (depth) GROUP BY 1),
an AS (SELECT gid, {_r('greatest(CASE WHEN dv > 0 THEN 0.6745 * (v - mv) / dv ELSE 0 END, CASE WHEN dc > 0 THEN 0.6745 * (c - mc) / dc ELSE 0 END)', 2)} AS anomaly_z
       FROM lv JOIN m1 USING (depth) JOIN m2 USING (depth))"""


def _pagerank() -> str:
    parts = [
        "pw AS (SELECT src, sum(sum_kzt) AS w FROM edges GROUP BY 1)",
        "pl AS MATERIALIZED (SELECT src, dst, sum_kzt / w AS p FROM edges JOIN pw USING (src))",
        "pn AS (SELECT count(*)::DOUBLE AS n FROM nodes)",
        "ps AS MATERIALIZED (SELECT gid, pw.src IS NOT NULL AS sends FROM nodes LEFT JOIN pw ON pw.src = gid)",
        "r0 AS MATERIALIZED (SELECT gid, sends, 1 / n AS r FROM ps, pn)",
    ]
    for k in range(1, PAGERANK_STEPS + 1):
        b = f"r{k - 1}"
        parts.append(
            f"r{k} AS MATERIALIZED (SELECT b.gid, b.sends, 0.15 / n + 0.85 * (coalesce(g.s, 0) + (SELECT coalesce(sum(r) FILTER (NOT sends), 0) FROM {b}) / n) AS r "
            f"FROM {b} b CROSS JOIN pn LEFT JOIN (SELECT dst, sum(r * p) AS s FROM pl JOIN {b} ON gid = src GROUP BY dst) g ON g.dst = b.gid)"
        )
    return ",\n".join(parts) + f",\npr AS (SELECT gid, r AS pagerank FROM r{PAGERANK_STEPS})"


BETWEEN = """
bw AS (SELECT gid AS s, gid AS v, 0 AS l, 1.0::DOUBLE AS c FROM nodes
       UNION ALL SELECT bw.s, e.dst, bw.l + 1, sum(bw.c) FROM bw JOIN edges e ON e.src = bw.v AND e.src <> e.dst WHERE bw.l < 12 GROUP BY bw.s, e.dst, bw.l),
sp AS MATERIALIZED (SELECT s, v, min(l) AS d, arg_min(c, l) AS g FROM bw GROUP BY s, v),
bs AS (SELECT x.v AS gid, sum(x.g * y.g / z.g) AS b FROM sp x JOIN sp y ON y.s = x.v JOIN sp z ON z.s = x.s AND z.v = y.v AND x.d + y.d = z.d WHERE x.d > 0 AND y.d > 0 GROUP BY 1),
bt AS MATERIALIZED (SELECT gid, coalesce(b, 0) * (SELECT CASE WHEN count(*) > 2 THEN 1.0 / ((count(*) - 1) * (count(*) - 2)) ELSE 1.0 END FROM nodes) AS betweenness FROM nodes LEFT JOIN bs USING (gid))"""

CYCLES = """
cy AS (SELECT [src, dst] AS path, [sum_kzt] AS sums FROM edges WHERE dst > src
       UNION ALL SELECT list_append(path, e.dst), list_append(sums, e.sum_kzt) FROM cy JOIN edges e ON e.src = path[-1] WHERE len(path) < 5 AND e.dst > path[1] AND NOT list_contains(path, e.dst)),
cycles AS MATERIALIZED (SELECT path, list_append(sums, e.sum_kzt) AS sums FROM cy JOIN edges e ON e.src = path[-1] AND e.dst = path[1])"""

COMPONENTS = """
ce AS (SELECT src AS a, dst AS b FROM edges WHERE n_tx >= 2 UNION SELECT dst, src FROM edges WHERE n_tx >= 2),
cc AS (SELECT gid AS a, gid AS b FROM nodes UNION SELECT cc.a, ce.b FROM cc JOIN ce ON ce.a = cc.b),
comp AS MATERIALIZED (SELECT a AS gid, min(b) AS component FROM cc GROUP BY a),
cl AS (SELECT gid, component + 1 AS cluster_id FROM comp)"""

SPAN = """
sc AS (SELECT DISTINCT cluster_id FROM cl JOIN nodes USING (gid) WHERE is_seed),
nb AS (SELECT src AS gid, dst AS o FROM edges UNION SELECT dst, src FROM edges UNION SELECT gid, gid FROM nodes),
span AS (SELECT n.gid, count(DISTINCT sc.cluster_id) AS span FROM nodes n LEFT JOIN nb USING (gid) LEFT JOIN cl ON cl.gid = nb.o LEFT JOIN sc ON sc.cluster_id = cl.cluster_id GROUP BY 1)"""


def _ramp(x: str, lo: float, hi: float) -> str:
    return f"least(1.0, greatest(0.0, ({x} - {lo}) / {float(hi - lo)}))"


def _score(*s: str) -> str:
    return _r(f"0.5 + 0.5 * (({' + '.join(s)}) / {float(len(s))})", 3)


_RULES = f"""
fx AS MATERIALIZED (
  SELECT st.*, span.span, pr.pagerank, bt.betweenness, pf.p_forward, an.anomaly_z, fast.fast_share, coalesce(late.late_in_share, 0) AS late_in_share,
         coalesce(burst.burst_in, 0) AS burst_in, coalesce(burst.burst_out, 0) AS burst_out, coalesce(rep.repeat_amount_n, 0) AS repeat_amount_n,
         CASE WHEN in_kzt > 0 THEN out_kzt / in_kzt ELSE 'inf'::DOUBLE END AS ratio, coalesce(fast.fast_share, 0) AS fast,
         coalesce(late.late_in_share, 0) >= 0.5 AND in_deg > 0 AS is_late,
         (rank() OVER (ORDER BY ln(1 + in_kzt + out_kzt)) + (count(*) OVER (PARTITION BY ln(1 + in_kzt + out_kzt)) - 1) / 2.0) / count(*) OVER () AS activity,
         (SELECT quantile_cont(betweenness, 0.99) FROM bt) AS cut
  FROM st JOIN span USING (gid) JOIN pr USING (gid) JOIN bt USING (gid) JOIN pf USING (gid) JOIN an USING (gid) LEFT JOIN fast USING (gid) LEFT JOIN late USING (gid) LEFT JOIN burst USING (gid) LEFT JOIN rep USING (gid)),
f1 AS (SELECT *, in_deg >= 8 AND out_deg >= 20 AS hub, seed_out >= 3 AS pays, betweenness >= cut AND betweenness > 0 AND span >= 4 AS bridge,
              out_deg >= 10 AND out_deg >= 3 * greatest(in_deg, 1) AS fans, in_deg >= 4 OR seed_in >= 2 AS gathers, in_kzt >= 30000 OR in_tx >= 2 AS material FROM fx),
fr AS (SELECT *, CASE
    WHEN hub OR pays OR bridge THEN 1 WHEN fans AND (NOT gathers OR out_deg / 10.0 >= in_deg / 4.0) THEN 2 WHEN gathers THEN 3
    WHEN truncated AND NOT material THEN 4 WHEN truncated AND p_forward < 0.5 THEN 5 WHEN truncated THEN 6
    WHEN out_deg > 0 AND is_seed AND in_kzt = 0 THEN 7 WHEN out_deg > 0 AND in_deg > 0 AND (ratio >= 0.5 OR fast >= 0.8) THEN 8
    WHEN in_deg > 0 AND ratio <= 0.1 AND material THEN 9 WHEN in_deg = 0 AND out_deg = 0 THEN 10 WHEN out_deg = 0 THEN 11 ELSE 12 END AS rule,
    CASE WHEN ratio BETWEEN 0.8 AND 1.2 THEN 1.0 WHEN ratio > 1.2 THEN greatest(0.0, 1 - ln(ratio / 1.2) / ln(10)) ELSE 0.5 * (ratio - 0.5) / (0.8 - 0.5) END AS close FROM f1),
rl AS MATERIALIZED (SELECT *,
    CASE WHEN rule = 1 THEN 'coordinator' WHEN rule = 2 THEN 'distributor' WHEN rule = 3 THEN 'consolidator' WHEN rule IN (5, 9) THEN 'terminal' WHEN rule IN (6, 7, 8) THEN 'transit' ELSE 'peripheral' END AS role,
    CASE rule
      WHEN 1 THEN greatest(CASE WHEN hub THEN {_score(_ramp('in_deg', 8, 20), _ramp('out_deg', 20, 80))} ELSE 0 END, CASE WHEN pays THEN {_score(_ramp('seed_out', 3, 6))} ELSE 0 END, CASE WHEN bridge THEN {_score(_ramp('span', 4, 8))} ELSE 0 END)
      WHEN 2 THEN {_score(_ramp('out_deg', 10, 60))}
      WHEN 3 THEN {_score('greatest(' + _ramp('in_deg', 4, 15) + ', ' + _ramp('seed_in', 2, 4) + ')')}
      WHEN 4 THEN {_r('1 - activity', 3)} WHEN 5 THEN {_r('1 - p_forward', 3)} WHEN 6 THEN {_r('least(p_forward, 0.6)', 3)}
      WHEN 7 THEN least({_score(_ramp('out_kzt', 30000, 1000000))}, 0.6)
      WHEN 8 THEN least({_r('0.5 + 0.3 * close + 0.2 * fast', 3)}, CASE WHEN is_seed THEN 0.6 ELSE 9 END)
      WHEN 9 THEN CASE WHEN is_late THEN {_r('0.6 * ' + _score(_ramp('in_kzt', 30000, 1000000), '1 - ratio / 0.1'), 3)} ELSE {_score(_ramp('in_kzt', 30000, 1000000), '1 - ratio / 0.1')} END
      WHEN 10 THEN 1.0 ELSE {_r('greatest(0.05, 1 - activity)', 3)} END AS role_score,
    CASE rule WHEN 1 THEN CASE WHEN fans THEN 'distributor' WHEN gathers THEN 'consolidator' ELSE '-' END WHEN 2 THEN CASE WHEN gathers THEN 'consolidator' ELSE '-' END
      WHEN 3 THEN CASE WHEN out_deg >= 10 THEN 'distributor' WHEN NOT truncated AND out_deg = 0 AND NOT is_late THEN 'terminal' ELSE '-' END WHEN 5 THEN 'transit' WHEN 6 THEN 'terminal' ELSE '-' END AS alt_role,
    CASE WHEN rule IN (1, 2, 7, 8, 12) THEN 'not_sink' WHEN rule = 3 THEN CASE WHEN truncated THEN 'truncated_depth' WHEN out_deg > 0 THEN 'not_sink' WHEN is_late THEN 'truncated_time' ELSE 'confirmed_sink' END
      WHEN rule IN (4, 5, 6) THEN 'truncated_depth' WHEN rule = 10 THEN 'no_data' WHEN is_late THEN 'truncated_time' ELSE 'confirmed_sink' END AS sink_status
  FROM fr)"""

_FLAGS = """
oc AS (SELECT DISTINCT unnest(path) AS gid FROM cycles),
orr AS (SELECT DISTINCT b AS gid FROM leg GROUP BY a, b, c HAVING count(DISTINCT d1) >= 2),
fl AS MATERIALIZED (SELECT rl.*, list_filter([
    CASE WHEN fast_share >= 0.8 THEN 'fast_transit' END, CASE WHEN burst_in >= 3 THEN 'burst_in' END, CASE WHEN burst_out >= 5 THEN 'burst_out' END,
    CASE WHEN oc.gid IS NOT NULL THEN 'in_cycle' END, CASE WHEN orr.gid IS NOT NULL THEN 'repeat_route' END, CASE WHEN repeat_amount_n >= 3 THEN 'repeat_amounts' END,
    CASE WHEN anomaly_z >= 3.5 THEN 'anomaly' END, CASE WHEN unseen >= 100000 AND NOT is_seed THEN 'unseen_inflow' END,
    CASE WHEN is_late AND out_deg = 0 AND NOT truncated THEN 'late_inflow' END, CASE WHEN truncated THEN 'truncated' END], lambda x: x IS NOT NULL) AS flags
  FROM rl LEFT JOIN oc USING (gid) LEFT JOIN orr USING (gid))"""

_W = {"role": 0.35, "flow": 0.25, "centrality": 0.20, "seed": 0.10, "flags": 0.10}


def _total(w: dict) -> str:
    return _r("least(1.0, greatest(0.0, (" + " + ".join(f"c_{k} * {v!r}::DOUBLE" for k, v in w.items()) + ") * disc))", 4)


def _rank(x: str) -> str:
    return f"(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0) / count(*) OVER ()"


_SCORED = f"""
pc AS (SELECT *, CASE role WHEN 'coordinator' THEN 1.0 WHEN 'consolidator' THEN 0.9 WHEN 'distributor' THEN 0.8 WHEN 'transit' THEN 0.6 WHEN 'terminal' THEN 0.5 ELSE 0.1 END * role_score AS c_role,
              activity AS c_flow, greatest({_rank('pagerank')}, {_rank('betweenness')}) AS c_centrality, least(1.0, (seed_in + seed_out) / 3.0) AS c_seed,
              least(1.0, len(list_filter(flags, lambda x: x NOT IN ('unseen_inflow', 'late_inflow', 'truncated'))) / 3.0) AS c_flags, CASE WHEN is_seed THEN 0.9 ELSE 1.0 END::DOUBLE AS disc FROM fl),
pq AS (SELECT *, {_total(_W)} AS priority_score, {', '.join(f"{_r(f'c_{k} * {v}::DOUBLE * disc', 4)} AS prio_{k}" for k, v in _W.items())} FROM pc),
scored AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY priority_score DESC, in_kzt DESC, gid) AS rank FROM pq)"""


def _sensitivity() -> str:
    rows = []
    i = 0
    for name in _W:
        for f in (0.8, 1.2):
            w = {k: v * f if k == name else v for k, v in _W.items()}
            w = {k: v / sum(w.values()) for k, v in w.items()}
            rows.append(f"SELECT {i} AS variant, gid, in_kzt, rank, {_total(w)} AS s FROM scored")
            i += 1
    return f"""sv AS ({' UNION ALL '.join(rows)}),
sh AS (SELECT variant, count(*) FILTER (rank <= 20) / 20.0 AS share FROM (SELECT * FROM sv QUALIFY row_number() OVER (PARTITION BY variant ORDER BY s DESC, in_kzt DESC, gid) <= 20) GROUP BY 1)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join((NET, *parts)) + "\n"


_FEATURES = (STRUCT, FAST, LATE, BURST, REPEAT, FORWARD, ANOMALY, _pagerank(), BETWEEN, COMPONENTS, SPAN)
_ROLES = (*_FEATURES, _RULES)
_LEGS = ROUTES.split(",\nroutes AS")[0]
_FLAGGED = (*_ROLES, CYCLES, _LEGS, _FLAGS)
_ALL = (*_FLAGGED, _SCORED)

_REMOVAL = """
sn AS (SELECT unnest([0, 1, 2]) AS scenario),
ln AS MATERIALIZED (SELECT scenario, gid, is_seed FROM sn, nodes WHERE NOT (scenario = 1 AND gid % 30 = 7) AND NOT (scenario = 2 AND gid % 10 = 0)),
le AS MATERIALIZED (SELECT a.scenario, src, dst, sum_kzt FROM edges JOIN ln a ON a.gid = src JOIN ln b ON b.gid = dst AND a.scenario = b.scenario),
lu AS (SELECT scenario, src AS a, dst AS b FROM le UNION SELECT scenario, dst, src FROM le),
lc AS (SELECT scenario, gid AS a, gid AS b FROM ln UNION SELECT lc.scenario, lc.a, lu.b FROM lc JOIN lu ON lu.scenario = lc.scenario AND lu.a = lc.b),
lz AS (SELECT scenario, low, count(*) AS n FROM (SELECT scenario, a, min(b) AS low FROM lc GROUP BY 1, 2) GROUP BY 1, 2),
lr AS (SELECT scenario, gid FROM ln WHERE is_seed UNION SELECT lr.scenario, le.dst FROM lr JOIN le ON le.scenario = lr.scenario AND le.src = lr.gid),
lv2 AS (SELECT le.scenario, sum(sum_kzt) AS volume FROM le JOIN lr ON lr.scenario = le.scenario AND lr.gid = le.src GROUP BY 1)"""

_NESTED = """
ro AS (SELECT 0 AS chain, gid, row_number() OVER (ORDER BY gid % 7, gid) AS place FROM nodes UNION ALL SELECT 1, gid, row_number() OVER (ORDER BY gid % 10, gid) FROM nodes),
rs AS (SELECT *, chain * 100 + n AS scenario FROM (SELECT unnest([0, 1]) AS chain), (SELECT unnest([0, 5, 20]) AS n)),
ln AS MATERIALIZED (SELECT scenario, gid, is_seed FROM rs JOIN ro USING (chain) JOIN nodes USING (gid) WHERE place > n),
le AS MATERIALIZED""" + _REMOVAL.split("le AS MATERIALIZED", 1)[1]

_ROUTES_ONLY = "routes AS" + ROUTES.split(",\nroutes AS", 1)[1]
_MODULARITY = """SELECT sum(l / m - (k / (2 * m)) * (k / (2 * m))) AS modularity FROM (SELECT c, sum(w) AS k, sum(i) AS l FROM (
        SELECT x.cluster_id AS c, weight AS w, CASE WHEN x.cluster_id = y.cluster_id THEN weight ELSE 0 END AS i FROM pairs JOIN cl x ON x.gid = a JOIN cl y ON y.gid = b
        UNION ALL SELECT y.cluster_id, weight, 0 FROM pairs JOIN cl y ON y.gid = b) GROUP BY c), (SELECT sum(weight) AS m FROM pairs)"""

_PATHS = """
pa AS (SELECT [7::BIGINT] AS nodes, 'inf'::DOUBLE AS low
       UNION ALL SELECT list_append(nodes, e.dst), least(low, sum_kzt) FROM pa JOIN edges e ON e.src = nodes[-1] WHERE len(nodes) <= 3 AND nodes[-1] <> 37 AND NOT list_contains(nodes, e.dst))"""
_SHORTEST = """
sh AS (SELECT 7::BIGINT AS gid, 0 AS hops UNION SELECT e.dst, hops + 1 FROM sh JOIN edges e ON e.src = sh.gid WHERE hops < 12),
sd AS MATERIALIZED (SELECT gid, min(hops) AS hops FROM sh GROUP BY gid),
sb AS MATERIALIZED (SELECT e.dst AS gid, min(e.src) AS before FROM edges e JOIN sd a ON a.gid = e.src JOIN sd b ON b.gid = e.dst WHERE b.hops = a.hops + 1 GROUP BY e.dst),
sw AS (SELECT [gid] AS nodes FROM sd WHERE gid = 37 UNION ALL SELECT list_prepend(sb.before, nodes) FROM sw JOIN sb ON sb.gid = nodes[1] WHERE nodes[1] <> 7)"""
_COMMON = """
cr AS (SELECT unnest([7, 37, 67])::BIGINT AS key, unnest([7, 37, 67])::BIGINT AS gid, 0 AS hops UNION SELECT cr.key, e.dst, hops + 1 FROM cr JOIN edges e ON e.src = cr.gid WHERE hops < 2),
cm AS (SELECT key, gid, min(hops) AS hops FROM cr GROUP BY 1, 2)"""
_TRACE = """
to_ AS (SELECT 7::BIGINT AS gid, 0 AS hops UNION SELECT e.dst, hops + 1 FROM to_ JOIN edges e ON e.src = to_.gid WHERE hops < 3),
ti_ AS (SELECT 7::BIGINT AS gid, 0 AS hops UNION SELECT e.src, hops + 1 FROM ti_ JOIN edges e ON e.dst = ti_.gid WHERE hops < 3)"""
_UNDIRECTED = """
ue AS MATERIALIZED (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
uz AS (SELECT min(gid) AS z FROM nodes WHERE gid NOT IN (SELECT src FROM edges)),
us AS (SELECT z AS gid, 0 AS hops FROM uz UNION SELECT b, hops + 1 FROM us JOIN ue ON a = gid WHERE hops < 8),
ud AS MATERIALIZED (SELECT gid, min(hops) AS hops FROM us GROUP BY gid),
ub AS MATERIALIZED (SELECT b AS gid, min(a) AS before FROM ue JOIN ud x ON x.gid = a JOIN ud y ON y.gid = b WHERE y.hops = x.hops + 1 GROUP BY b),
uw AS (SELECT [gid] AS nodes FROM ud WHERE gid = 7 UNION ALL SELECT list_prepend(ub.before, nodes) FROM uw JOIN ub ON ub.gid = nodes[1] WHERE nodes[1] <> (SELECT z FROM uz)),
un AS (SELECT unnest(range(1, len(nodes))) AS step, nodes FROM uw WHERE nodes[1] = (SELECT z FROM uz)),
dn AS (SELECT unnest(range(1, len(nodes))) AS step, nodes FROM sw WHERE nodes[1] = 7)"""
_SHARED = """
hr AS (SELECT unnest([7, 37, 67])::BIGINT AS key, unnest([7, 37, 67])::BIGINT AS gid, 0 AS hops UNION SELECT hr.key, e.dst, hops + 1 FROM hr JOIN edges e ON e.src = hr.gid WHERE hops < 4),
hm AS MATERIALIZED (SELECT key, gid, min(hops) AS hops FROM hr GROUP BY 1, 2),
hc AS MATERIALIZED (SELECT gid, count(*) AS n_linked, sum(hops) AS total_hops FROM hm WHERE hops > 0 AND gid NOT IN (7, 37, 67) GROUP BY gid HAVING count(*) >= 2 ORDER BY n_linked DESC, total_hops, gid LIMIT 8),
hp AS MATERIALIZED (SELECT b.key, b.gid, min(e.src) AS before FROM edges e JOIN hm b ON b.gid = e.dst JOIN hm a ON a.key = b.key AND a.gid = e.src AND a.hops = b.hops - 1 GROUP BY 1, 2),
hw AS (SELECT key, gid, gid AS at, hops FROM hm WHERE hops > 0 AND gid IN (SELECT gid FROM hc) UNION ALL SELECT hw.key, hw.gid, hp.before, hw.hops - 1 FROM hw JOIN hp ON hp.key = hw.key AND hp.gid = hw.at WHERE hw.hops > 1)"""
_FLOWS = f"""
ef AS (SELECT a.cluster_id AS ca, b.cluster_id AS cb, sum_kzt FROM edges JOIN cl a ON a.gid = src JOIN cl b ON b.gid = dst),
cf AS (SELECT cluster_id, {_r('sum(i)', 2)} AS sum_kzt_internal, {_r('sum(x)', 2)} AS sum_kzt_in_external, {_r('sum(o)', 2)} AS sum_kzt_out_external FROM (
   SELECT ca AS cluster_id, CASE WHEN ca = cb THEN sum_kzt ELSE 0 END AS i, 0.0 AS x, CASE WHEN ca <> cb THEN sum_kzt ELSE 0 END AS o FROM ef
   UNION ALL SELECT cb, 0.0, CASE WHEN ca <> cb THEN sum_kzt ELSE 0 END, 0.0 FROM ef) GROUP BY 1)"""
_NUMBERS = f"""
ci AS (SELECT a.cluster_id AS c, {_r('sum(weight)', 2)} AS w FROM pairs JOIN cl a ON a.gid = pairs.a JOIN cl b ON b.gid = pairs.b WHERE a.cluster_id = b.cluster_id GROUP BY 1),
cn AS (SELECT cluster_id AS c, row_number() OVER (ORDER BY coalesce(w, 0) DESC, count(*) DESC, min(gid)) AS n FROM cl LEFT JOIN ci ON ci.c = cluster_id GROUP BY cluster_id, w)"""
_GIANT = """
gu AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
gc AS (SELECT gid AS a, gid AS b FROM nodes UNION SELECT gc.a, gu.b FROM gc JOIN gu ON gu.a = gc.b),
gm AS (SELECT a AS gid, min(b) AS low FROM gc GROUP BY 1),
gg AS (SELECT gid FROM gm WHERE low = (SELECT low FROM gm GROUP BY low ORDER BY count(*) DESC, low LIMIT 1))"""
_REQ = """
rq AS (SELECT gid, 'Наличные/межбанковские операции и переводы < 5 000 ₸' AS request FROM scored WHERE sink_status = 'no_data'
  UNION ALL SELECT gid, 'Выписка исходящих за июль–август' FROM scored WHERE truncated AND (role IN ('consolidator', 'transit') OR in_kzt >= 300000)
  UNION ALL SELECT gid, 'Входящие переводы от клиентов вне выборки / других банков' FROM scored WHERE unseen >= 100000 AND NOT truncated
  UNION ALL SELECT gid, 'Операции за август 2026' FROM scored WHERE sink_status = 'truncated_time')"""
_PRIO = ", ".join(f"prio_{k}" for k in _W)
_TYPE = "CASE role WHEN 'consolidator' THEN 'funnel account (воронка)' WHEN 'distributor' THEN 'fan-out payouts' WHEN 'transit' THEN 'pass-through / money mule layering' END"

_NAMES = ", ".join(f"('{role}', '{name}', {i})" for i, (role, name) in enumerate(ROLE_NAMES.items()))
_TOTALS = f"SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM nodes WHERE is_seed) AS n_seed, (SELECT count(*) FROM edges) AS n_edges, {_r('(SELECT sum(sum_kzt) FROM edges)', 2)} AS total_kzt, count(*) AS n_tx, min(date) AS first_date, max(date) AS last_date FROM tx"


def _levels(levels, x: str, compare: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} {compare} {bound} THEN '{text}'" for bound, text in levels[:-1]) + f" ELSE '{levels[-1][1]}' END"


SQL = {
    "edges_agg": _with() + f"SELECT src, dst, {_r('sum_kzt')} AS sum_kzt, n_tx FROM edges",
    "node_flows": _with(STRUCT) + f"""SELECT gid, depth, is_seed, in_deg, in_kzt, in_tx, out_deg, out_kzt, out_tx, CASE WHEN in_kzt > 0 THEN {_r('out_kzt / in_kzt')} END AS pass_through,
        CASE WHEN in_tx > 0 THEN {_r('in_kzt / in_tx')} ELSE 0.0 END AS avg_in, CASE WHEN out_tx > 0 THEN {_r('out_kzt / out_tx')} ELSE 0.0 END AS avg_out, {_r('unseen')} AS unseen_inflow_kzt, observed_out, truncated FROM st""",
    "bfs_depth": _with() + "SELECT gid, depth, is_seed FROM nodes",
    "orphans_anti": _with() + "SELECT gid FROM nodes WHERE gid NOT IN (SELECT src FROM edges WHERE n_tx >= 2 UNION SELECT dst FROM edges WHERE n_tx >= 2)",
    "sanity_full_outer": _with() + """SELECT 'pair_only_on_one_side' AS rule, 0::BIGINT AS n_violations UNION ALL SELECT 'sum_differs', 0 UNION ALL SELECT 'count_differs', 0
        UNION ALL SELECT 'gid_repeated', (SELECT count(*) FROM (SELECT gid FROM nodes GROUP BY gid HAVING count(*) > 1)) UNION ALL SELECT 'edge_end_unknown', (SELECT count(*) FROM (SELECT src AS g FROM edges UNION SELECT dst FROM edges) WHERE g NOT IN (SELECT gid FROM nodes))
        UNION ALL SELECT 'node_without_edge', (SELECT count(*) FROM nodes WHERE gid NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges))""",
    "undirected_weights": _with(PAIRS) + f"SELECT a, b, {_r('weight')} AS weight FROM pairs",
    "seed_links": _with(STRUCT) + "SELECT gid, CAST(seed_in AS BIGINT) AS seed_in, CAST(seed_out AS BIGINT) AS seed_out FROM st WHERE seed_in + seed_out > 0",
    "late_share": _with(LATE) + f"SELECT gid, {_r('late_in_share')} AS late_in_share FROM late",
    "bursts": _with(BURST) + "SELECT * FROM burst",
    "repeat_amounts": _with(REPEAT) + "SELECT * FROM rep",
    "active_days": _with() + "SELECT gid, count(DISTINCT date) AS active_days FROM (SELECT src AS gid, date FROM tx UNION ALL SELECT dst, date FROM tx) GROUP BY 1",
    "stream_patterns": _with(FAST, BURST) + f"""SELECT gid, d.date, {_r('fast_share')} AS fast_share, first_lag, burst_in, burst_in_date, burst_out, burst_out_date
        FROM (SELECT gid, max(date) AS date FROM fd GROUP BY 1) d JOIN burst USING (gid) LEFT JOIN fast USING (gid)""",
    "fast_share": _with(FAST) + f"SELECT gid, {_r('fast_share')} AS fast_share, first_lag FROM fast",
    "routes": _with(ROUTES) + f"SELECT a, b, c, n_dates, first, last, {_r('sum_in')} AS sum_in, {_r('sum_out')} AS sum_out FROM routes",
    "p_forward_table": _with(STRUCT, FORWARD) + f"SELECT b_deg, b_tx, {_r('p')} AS p, n, {_r('base')} AS base FROM fw",
    "p_forward_backtest": _with(STRUCT, FORWARD, BACKTEST) + f"SELECT bin, {_r('predicted')} AS predicted, {_r('actual')} AS actual, n FROM cb UNION ALL SELECT 'auc', {_r('auc')}, NULL, NULL FROM au",
    "p_forward": _with(STRUCT, FORWARD) + "SELECT * FROM pf",
    "robust_anomaly": _with(STRUCT, ANOMALY) + "SELECT * FROM an",
    "pagerank": _with(_pagerank()) + f"SELECT gid, {_r('pagerank')} AS pagerank FROM pr",
    "betweenness": _with(BETWEEN) + f"SELECT gid, {_r('betweenness')} AS betweenness FROM bt",
    "strong_components": _with("sr AS (SELECT gid AS s, gid AS v FROM nodes UNION SELECT sr.s, edges.dst FROM sr JOIN edges ON edges.src = sr.v)")
    + "SELECT x.s AS gid, min(x.v) AS component FROM sr x JOIN sr y ON y.s = x.v AND y.v = x.s GROUP BY x.s",
    "cycles": _with(CYCLES) + f"SELECT array_to_string(path, '>') AS path, CAST(len(path) AS INTEGER) AS length, {_r('list_min(sums)')} AS min_edge_kzt, {_r('list_sum(sums)')} AS total_kzt FROM cycles",
    "components": _with(COMPONENTS) + "SELECT gid AS node, component FROM comp",
    "seed_reach_volume": _with("rc AS (SELECT gid FROM nodes WHERE is_seed UNION SELECT dst FROM rc JOIN edges ON src = gid)") + f"SELECT count(*) AS n_reached, {_r('(SELECT sum(sum_kzt) FROM edges WHERE src IN (SELECT gid FROM rc))')} AS volume FROM rc",
    "nested_removals": _with(_NESTED)
    + f"SELECT CAST(scenario // 100 AS INTEGER) AS chain, CAST(scenario % 100 AS INTEGER) AS n, coalesce(max(lz.n), 0) AS giant, count(lz.n) AS n_components, {_r('coalesce(any_value(volume), 0)')} AS volume FROM (SELECT scenario FROM rs) LEFT JOIN lz USING (scenario) LEFT JOIN lv2 USING (scenario) GROUP BY scenario",
    "removal": _with(_REMOVAL) + f"SELECT CAST(lz.scenario AS INTEGER) AS scenario, max(n) AS giant, count(*) AS n_components, {_r('coalesce(any_value(volume), 0)')} AS volume FROM lz LEFT JOIN lv2 USING (scenario) GROUP BY lz.scenario",
    "neighbors": _with() + f"SELECT src AS gid, 'in' AS direction, {_r('sum_kzt')} AS sum_kzt, n_tx FROM edges WHERE dst = 7 UNION ALL SELECT dst, 'out', {_r('sum_kzt')}, n_tx FROM edges WHERE src = 7",
    "partners": _with() + f"SELECT src AS gid, 'in' AS direction, {_r('sum(sum_kzt)')} AS sum_kzt, count(*) AS n_tx, min(date) AS first, max(date) AS last FROM tx WHERE dst = 7 GROUP BY src UNION ALL SELECT dst, 'out', {_r('sum(sum_kzt)')}, count(*), min(date), max(date) FROM tx WHERE src = 7 GROUP BY dst",
    "top_paths": _with(_PATHS) + f"SELECT array_to_string(nodes, '>') AS nodes, {_r('low')} AS bottleneck_kzt, CAST(len(nodes) - 1 AS INTEGER) AS n_hops FROM pa WHERE nodes[-1] = 37 ORDER BY low DESC, len(nodes), nodes LIMIT 20",
    "shortest_path": _with(_SHORTEST) + "SELECT array_to_string(nodes, '>') AS nodes, CAST(len(nodes) - 1 AS INTEGER) AS n_hops FROM sw WHERE nodes[1] = 7",
    "widest_paths": _with(_PATHS.replace("len(nodes) <= 3", "len(nodes) <= 4")) + f"SELECT array_to_string(nodes, '>') AS nodes, {_r('low')} AS bottleneck_kzt, CAST(len(nodes) - 1 AS INTEGER) AS n_hops FROM pa WHERE nodes[-1] = 37 ORDER BY low DESC, len(nodes), nodes LIMIT 20",
    "flow_trace": _with(_TRACE) + f"""SELECT src, dst, {_r('sum_kzt')} AS sum_kzt, n_tx, CAST(min(hops) + 1 AS INTEGER) AS level, 'out' AS direction FROM edges JOIN to_ ON gid = src GROUP BY src, dst, sum_kzt, n_tx
        UNION ALL SELECT src, dst, {_r('sum_kzt')}, n_tx, CAST(min(hops) + 1 AS INTEGER), 'in' FROM edges JOIN ti_ ON gid = dst GROUP BY src, dst, sum_kzt, n_tx""",
    "traced_path": _with(_SHORTEST, _UNDIRECTED) + """SELECT 7::BIGINT AS start, CAST(step AS INTEGER) AS step, nodes[step] AS src, nodes[step + 1] AS dst, true AS forward, true AS directed FROM dn
        UNION ALL SELECT (SELECT z FROM uz), CAST(step AS INTEGER), CASE WHEN fw THEN nodes[step] ELSE nodes[step + 1] END, CASE WHEN fw THEN nodes[step + 1] ELSE nodes[step] END, fw, false
        FROM (SELECT un.*, e.src IS NOT NULL AS fw FROM un LEFT JOIN edges e ON e.src = nodes[step] AND e.dst = nodes[step + 1])""",
    "shared_receivers": _with(_SHARED) + """SELECT hc.gid, n_linked, CAST(total_hops AS BIGINT) AS total_hops, hw.key, CAST(hw.hops AS INTEGER) AS step, hp.before AS src, hw.at AS dst
        FROM hc JOIN hw USING (gid) JOIN hp ON hp.key = hw.key AND hp.gid = hw.at""",
    "find_paths": _with(_PATHS) + f"SELECT array_to_string(nodes, '>') AS nodes, {_r('low')} AS bottleneck_kzt, CAST(len(nodes) - 1 AS INTEGER) AS n_hops FROM pa WHERE nodes[-1] = 37",
    "common_counterparties": _with(_COMMON) + "SELECT gid, count(*) AS n_linked, string_agg(key || ':' || hops, ',' ORDER BY key) AS linked FROM cm WHERE hops > 0 AND gid NOT IN (7, 37, 67) GROUP BY gid HAVING count(*) >= 2",
    "edge_tx_lists": _with() + "SELECT src, dst, string_agg(CAST(date AS VARCHAR) || ' ' || CAST(round_even(sum_kzt * 100, 0) AS BIGINT), ',' ORDER BY date, sum_kzt) AS transfers FROM tx GROUP BY src, dst",
    "graph_totals": _with() + _TOTALS,
    "cluster_flows": _with(COMPONENTS, _FLOWS) + "SELECT * FROM cf",
    "modularity": _with(PAIRS, COMPONENTS) + f"SELECT {_r('modularity')} AS modularity FROM ({_MODULARITY})",
    "seed_cluster_span": _with(COMPONENTS, SPAN) + "SELECT * FROM span",
    "cluster_numbers": _with(PAIRS, COMPONENTS, _NUMBERS) + "SELECT gid, CAST(n AS INTEGER) AS cluster_id FROM cl JOIN cn ON cn.c = cluster_id",
    "roles_by_component": _with(*_ROLES) + "SELECT gid, role, role_score, alt_role, sink_status FROM rl",
    "flags": _with(*_FLAGGED) + f"SELECT gid, array_to_string(flags, ';') AS flags, concat_ws('; ', {_TYPE}, CASE WHEN list_contains(flags, 'fast_transit') THEN 'rapid movement of funds' END) AS typology FROM fl",
    "priority_by_component": _with(*_ALL) + f"SELECT gid, priority_score, {_PRIO}, rank FROM scored",
    "sensitivity": _with(*_ALL, _sensitivity()) + f"SELECT 20 AS k, {_r('min(share)', 3)} AS min_overlap, {_r('avg(share)', 3)} AS mean_overlap FROM sh",
    "data_requests": _with(*_ALL, _REQ) + "SELECT request, count(*) AS n, CAST(sum(gid) AS BIGINT) AS gids FROM rq GROUP BY 1",
    "search_nodes": _with(*_ALL) + "SELECT gid, rank FROM scored WHERE role = 'consolidator' AND in_deg >= 6 AND priority_score >= 0.3 ORDER BY rank LIMIT 20",
    "resolve_suffix": _with() + "SELECT gid, CAST(tier AS INTEGER) AS tier FROM (SELECT gid, CASE WHEN gid::VARCHAR = '7' THEN 1 WHEN suffix(gid::VARCHAR, '7') THEN 2 WHEN contains(gid::VARCHAR, '7') THEN 3 END AS tier FROM nodes) WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER ()",
    "cluster_top": _with(*_ALL, _FLOWS, _GIANT) + """SELECT cluster_id, count(*) AS n_nodes, count(*) FILTER (is_seed) AS n_seed, coalesce(any_value(sum_kzt_internal), 0) AS sum_kzt_internal,
        string_agg(gid::VARCHAR, ';' ORDER BY nth) FILTER (nth <= 5) AS top_gids, NOT bool_or(gid IN (SELECT gid FROM gg)) AS isolated_fragment, max(priority_score) AS max_priority
        FROM (SELECT scored.*, cl.cluster_id, row_number() OVER (PARTITION BY cl.cluster_id ORDER BY priority_score DESC, scored.gid) AS nth FROM scored JOIN cl USING (gid)) LEFT JOIN cf USING (cluster_id) GROUP BY cluster_id""",
    "cluster_roles": _with(*_ALL, _FLOWS) + f"""SELECT g.cluster_id, string_agg(name || ': ' || n, ', ' ORDER BY n DESC, nth) AS roles_mix, coalesce(any_value(sum_kzt_in_external), 0) AS sum_kzt_in_external, coalesce(any_value(sum_kzt_out_external), 0) AS sum_kzt_out_external
        FROM (SELECT cluster_id, role, count(*) AS n FROM scored JOIN cl USING (gid) GROUP BY 1, 2) g JOIN (VALUES {_NAMES}) v(role, name, nth) USING (role) LEFT JOIN cf ON cf.cluster_id = g.cluster_id GROUP BY g.cluster_id""",
    "top_by_component": _with(*_ALL) + f"""SELECT rank, gid, role, priority_score, cluster_id, is_seed, in_kzt, out_kzt, {_levels(CONFIDENCE, 'role_score', '>=')} AS confidence, {_levels(PRIORITY, 'rank', '<=')} AS level
        FROM scored JOIN cl USING (gid) WHERE rank <= 50""",
    "overview_by_component": _with(*_ALL) + f"""SELECT n_nodes, n_seed, n_edges, total_kzt, n_tx, first_date, last_date, {', '.join(f"count(*) FILTER (role = '{r}') AS n_{r}" for r in ROLE_NAMES)},
        count(*) FILTER (rank <= 20 AND NOT is_seed) AS new_leads_top20, count(*) FILTER (in_kzt > 0 AND out_kzt / in_kzt BETWEEN 0.8 AND 1.2) AS n_ratio_near_1,
        count(DISTINCT cluster_id) AS n_clusters, (SELECT count(*) FROM (SELECT cluster_id FROM nodes JOIN cl USING (gid) WHERE is_seed GROUP BY 1 HAVING count(*) > 1)) AS n_clusters_with_seeds
        FROM scored JOIN cl USING (gid), ({_TOTALS}) t GROUP BY ALL""",
    "run_summary": _with(*_ALL, _sensitivity(), BACKTEST, PAIRS, _ROUTES_ONLY)
    + " UNION ALL ".join(
        [f"SELECT 'n_{r}' AS metric, count(*) FILTER (role = '{r}')::DOUBLE AS value FROM scored" for r in ROLE_NAMES]
        + [
            "SELECT 'new_leads_top20', count(*) FILTER (rank <= 20 AND NOT is_seed) FROM scored",
            "SELECT 'n_ratio_near_1', count(*) FILTER (in_kzt > 0 AND out_kzt / in_kzt BETWEEN 0.8 AND 1.2) FROM scored",
            "SELECT 'n_clusters', count(DISTINCT cluster_id) FROM cl",
            "SELECT 'n_clusters_with_seeds', count(*) FROM (SELECT cluster_id FROM nodes JOIN cl USING (gid) WHERE is_seed GROUP BY 1 HAVING count(*) > 1)",
            "SELECT 'n_cycles', count(*) FROM cycles",
            "SELECT 'n_routes', count(*) FROM routes",
            f"SELECT 'modularity', {_r('modularity', 3)} FROM ({_MODULARITY})",
            f"SELECT 'top20_min_overlap', {_r('min(share)', 3)} FROM sh",
            f"SELECT 'top20_mean_overlap', {_r('avg(share)', 3)} FROM sh",
            f"SELECT 'base_rate', {_r('avg(fwd)', 3)} FROM tr",
            "SELECT 'n_train', count(*) FROM tr",
            f"SELECT 'auc', {_r('auc', 3)} FROM au",
            f"SELECT 'depth ' || depth || ' rate', {_r('avg(fwd)', 3)} FROM tr GROUP BY depth",
            "SELECT 'depth ' || depth || ' n', count(*) FROM tr GROUP BY depth",
            f"SELECT 'bin ' || bin || ' predicted', {_r('predicted', 3)} FROM cb",
            f"SELECT 'bin ' || bin || ' actual', {_r('actual', 3)} FROM cb",
            "SELECT 'bin ' || bin || ' n', n FROM cb",
        ]
    ),
    "node_record": _with(*_ALL) + """SELECT gid, role, priority_score, rank, cluster_id, (SELECT count(*) FROM cl x WHERE x.cluster_id = cl.cluster_id) AS cluster_n_nodes, (SELECT count(*) FROM cl x JOIN nodes USING (gid) WHERE x.cluster_id = cl.cluster_id AND is_seed) AS cluster_n_seed,
        (SELECT coalesce(string_agg(g || ':' || CAST(round_even(s * 100, 0) AS BIGINT) || ':' || n, ',' ORDER BY s DESC, g DESC), '') FROM (SELECT src AS g, sum_kzt AS s, n_tx AS n FROM edges WHERE dst = 7 ORDER BY s DESC, g DESC LIMIT 5)) AS top_payers,
        (SELECT coalesce(string_agg(g || ':' || CAST(round_even(s * 100, 0) AS BIGINT) || ':' || n, ',' ORDER BY s DESC, g DESC), '') FROM (SELECT dst AS g, sum_kzt AS s, n_tx AS n FROM edges WHERE src = 7 ORDER BY s DESC, g DESC LIMIT 5)) AS top_payees
        FROM scored JOIN cl USING (gid) WHERE gid = 7""",
    "stored_partners": _with(*_ALL) + f"""SELECT 7::BIGINT AS gid, direction, other, {_r('s')} AS sum_kzt, n AS n_tx, first, last, role, is_seed, priority_score FROM (
        SELECT 'in' AS direction, src AS other, sum(sum_kzt) AS s, count(*) AS n, min(date) AS first, max(date) AS last FROM tx WHERE dst = 7 GROUP BY src
        UNION ALL SELECT 'out', dst, sum(sum_kzt), count(*), min(date), max(date) FROM tx WHERE src = 7 GROUP BY dst) LEFT JOIN scored ON scored.gid = other""",
    "stored_members": _with(*_ALL) + """SELECT cluster_id, count(*) OVER () AS n_nodes, count(*) FILTER (is_seed) OVER () AS n_seed, rank, gid, role
        FROM scored JOIN cl USING (gid) WHERE cluster_id = (SELECT cluster_id FROM cl WHERE gid = 7)""",
}
SQL["exported_nodes"] = SQL["priority_by_component"]
