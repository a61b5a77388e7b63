"""DuckDB SQL that computes what the registered queries compute."""

from __future__ import annotations

K, FOUND, ROUNDS = 4, 4, 4

_PANEL = """
panel AS (SELECT date_trunc('week', l_shipdate)::TIMESTAMP AS ts, l_suppkey::BIGINT AS algo_id, 1e6::DOUBLE + max(l_extendedprice) AS close FROM lineitem GROUP BY 1, 2),
cal AS (SELECT ts, (row_number() OVER (ORDER BY ts) - 1)::INT AS i FROM (SELECT DISTINCT ts FROM panel)),
pr AS (SELECT *, lag(close) OVER (PARTITION BY algo_id ORDER BY ts) AS prev FROM panel),
rets AS (SELECT pr.ts, i, algo_id, CASE WHEN prev IS NULL OR prev = 0 THEN 0.0::DOUBLE ELSE close / prev - 1 END AS ret, close <> 0 AS active FROM pr JOIN cal USING (ts))"""
_MACRO = """,
nn AS (SELECT count(DISTINCT algo_id)::DOUBLE AS n FROM rets),
mu AS (SELECT cal.ts, cal.i, coalesce(sum(ret), 0) / max(n) AS m, max(n) AS n, count(ret) AS obs, coalesce(sum(CASE WHEN ret > 0 THEN 1 ELSE 0 END), 0) AS up FROM cal CROSS JOIN nn LEFT JOIN rets USING (i) GROUP BY 1, 2),
sq AS (SELECT i, sum((ret - m) * (ret - m)) AS s FROM rets JOIN (SELECT i, m FROM mu) USING (i) GROUP BY 1),
macro AS (SELECT ts, mu.i, m AS syn_mkt_ret, sqrt((coalesce(s, 0) + (n - obs) * m * m) / (n - 1)) AS syn_vix, up / n AS syn_breadth FROM mu LEFT JOIN sq USING (i))"""
_SERIES = f""",
sz AS (SELECT (algo_id % {K})::INT AS cluster, count(DISTINCT algo_id) AS n FROM rets GROUP BY 1),
sm AS (SELECT i, (algo_id % {K})::INT AS cluster, sum(ret) AS s FROM rets GROUP BY 1, 2),
cr AS (SELECT ts, cal.i, sz.cluster, coalesce(s, 0.0) / n AS ret FROM cal CROSS JOIN sz LEFT JOIN sm ON sm.i = cal.i AND sm.cluster = sz.cluster),
series AS (SELECT *, CASE WHEN count(*) OVER w = 20 THEN stddev_samp(ret) OVER w ELSE 0.0 END AS vol, CASE WHEN count(*) OVER w = 20 THEN sum(ret) OVER w ELSE 0.0 END AS mom FROM cr WINDOW w AS (PARTITION BY cluster ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""
_MONTHS = """,
mo AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, 1e6::DOUBLE + max(o_totalprice) AS e FROM orders GROUP BY 1),
mr AS (SELECT month, coalesce(e / lag(e) OVER (ORDER BY month) - 1, 0.0) AS monthly_return FROM mo)"""


def _asof(first: str, where: str = "") -> str:
    return f""",
me AS (SELECT last_day(strptime(month || '-01', '%Y-%m-%d')::DATE) AS month_end, product(1 + monthly_return) OVER (ORDER BY month) AS equity FROM mr {where}),
dates AS (SELECT DISTINCT ts::DATE AS date FROM cal),
af AS (SELECT d.date, me.equity FROM dates d ASOF LEFT JOIN me ON d.date >= me.month_end),
fl AS (SELECT date, {first} AS equity FROM af),
bench AS (SELECT date, coalesce(equity / lag(equity) OVER (ORDER BY date) - 1, 0.0) AS bench_ret FROM fl)"""


_BFILL = "coalesce(equity, (SELECT equity FROM me ORDER BY month_end LIMIT 1), 1.0)"
_ACT = f""",
act AS (SELECT ts, i, cluster, ret, greatest(0.0, least(1.0, 0.5 + 20.0 * coalesce(lag(mom) OVER (PARTITION BY cluster ORDER BY i), 0.0))) AS a FROM series),
legs AS (SELECT ts, cluster, ret, exp(a) AS e FROM act UNION ALL SELECT ts, {K}, 0.0, exp(0.5::DOUBLE) FROM (SELECT DISTINCT ts FROM act)),
wts AS (SELECT ts, cluster, ret, e / sum(e) OVER (PARTITION BY ts) AS w FROM legs)"""


def _sim(source: str, keys: str, window: int) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", ")) if keys else "true"
    by = f"PARTITION BY {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    headb = "".join(f"b.{k}, " for k in keys.split(", ")) if keys else ""
    return f""",
numbered AS (SELECT {head}ts, row_number() OVER ({by} ORDER BY ts) - 1 AS pos, count(*) OVER ({by}) AS n FROM {source}),
steps AS (SELECT {head}ts, pos FROM numbered WHERE pos >= {window} AND pos <= greatest({window}, n - 2)),
sw AS (SELECT {headb}b.ts, w.cluster, w.ret, w.w, coalesce(lag(w.w) OVER (PARTITION BY {headb}w.cluster ORDER BY b.ts), CASE WHEN w.cluster = {K} THEN 1.0 ELSE 0.0 END) AS pw FROM steps b JOIN wts w ON w.ts = b.ts),
day AS (SELECT {head}ts, sum(abs(w - pw) * 2.0) AS turnover, sum(CASE WHEN cluster < {K} THEN w * ret ELSE 0.0 END) * 2.0 AS gross, max(CASE WHEN cluster = {K} THEN w END) AS cash_weight FROM sw GROUP BY ALL),
net AS (SELECT day.*, turnover * 0.0005 AS cost, gross - turnover * 0.0005 AS ret, bench_ret FROM day JOIN bench ON bench.date = day.ts::DATE),
log AS (SELECT *, 100 * product(1 + ret) OVER ({by} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity, greatest(-10.0, least(10.0, (ret - bench_ret) * 10 - CASE WHEN ret < -0.02 THEN abs(ret) * 50 ELSE 0.0 END - turnover * 0.005)) AS reward FROM net)"""


def _kpi(keys: str) -> str:
    by, head, group = (f"PARTITION BY {keys}", f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "", "")
    return f""",
dd AS (SELECT *, equity / max(equity) OVER ({by} ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM log),
k0 AS (SELECT {head}count(*) AS periods, arg_max(equity, ts) / arg_min(equity, ts) - 1 AS total_return, date_diff('day', min(ts::DATE), max(ts::DATE)) / 365.25::DOUBLE AS years, stddev_samp(ret) AS sd, stddev_samp(CASE WHEN ret < 0 THEN ret END) AS down, min(drawdown) AS max_drawdown, stddev_samp(bench_ret) AS bsd, regr_slope(ret, bench_ret) AS slope, regr_intercept(ret, bench_ret) AS icept, sum(CASE WHEN ret > 0 THEN 1 ELSE 0 END) / count(*)::DOUBLE AS win_rate FROM dd {group}),
k1 AS (SELECT *, CASE WHEN years > 0 THEN pow(1 + total_return, 1 / years) - 1 ELSE 0.0 END AS cagr, coalesce(sd * sqrt(252), 0.0) AS vol, coalesce(down * sqrt(252), 0.0) AS dvol FROM k0),
kpi AS (SELECT *, CASE WHEN vol > 0 THEN (cagr - 0.03) / vol ELSE 0.0 END AS sharpe, CASE WHEN dvol > 0 THEN (cagr - 0.03) / dvol ELSE 0.0 END AS sortino, CASE WHEN max_drawdown < 0 THEN cagr / abs(max_drawdown) ELSE 0.0 END AS calmar, CASE WHEN periods > 1 AND bsd > 0 THEN icept * 252 ELSE 0.0 END AS alpha, CASE WHEN periods > 1 AND bsd > 0 THEN slope ELSE 0.0 END AS beta FROM k1)"""


_RUN = _PANEL + _SERIES + _MONTHS + _asof(_BFILL) + _ACT
_LOG = _RUN + _sim("(SELECT DISTINCT ts FROM act)", "", 30)
_FOLDS = """,
folds(fold, a, b, c, d) AS (SELECT 'F' || y, DATE '1995-01-01', make_date(y - 1, 12, 31), make_date(y, 1, 1), make_date(y, 12, 31) FROM (VALUES (1997), (1998), (1999)) t(y)),
spans AS (SELECT fold, 'train' AS split, a AS s, b AS e FROM folds UNION ALL SELECT fold, 'test', c, d FROM folds),
folded AS (SELECT fold, split, ts FROM (SELECT DISTINCT ts FROM act), spans WHERE ts::DATE BETWEEN s AND e)"""
_WF = _RUN + _FOLDS + _sim("folded", "fold, split", 12)
_DENSE = """,
life AS (SELECT algo_id, min(i) AS a, max(i) AS b FROM rets GROUP BY 1),
dense AS (SELECT c.i, l.algo_id, coalesce(r.ret, 0.0) AS ret, coalesce(r.active, false) AS active FROM life l JOIN cal c ON c.i BETWEEN greatest(0, a - 60) AND b + 60 LEFT JOIN rets r ON r.algo_id = l.algo_id AND r.i = c.i)"""
def _feat(k: int) -> str:
    return _DENSE + f""",
wf AS (SELECT i, algo_id, product(1 + ret) OVER w - 1 AS ret_total, stddev_samp(ret) OVER w AS volatility, sum(active::INT) OVER w / 60.0::DOUBLE AS live FROM dense WINDOW w AS (PARTITION BY algo_id ORDER BY i ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
el AS (SELECT *, count(*) OVER (PARTITION BY i) AS many FROM wf WHERE i >= 60 AND live > 0.8),
feat AS (SELECT i, algo_id, coalesce(ret_total, 0.0) AS ret_total, coalesce(volatility, 0.0) AS volatility FROM el WHERE many >= {k}),
scaled AS MATERIALIZED (SELECT i, algo_id, round((ret_total - avg(ret_total) OVER w) / CASE WHEN stddev_pop(ret_total) OVER w = 0 THEN 1.0 ELSE stddev_pop(ret_total) OVER w END, 9) AS x, round((volatility - avg(volatility) OVER w) / CASE WHEN stddev_pop(volatility) OVER w = 0 THEN 1.0 ELSE stddev_pop(volatility) OVER w END, 9) AS y FROM feat WINDOW w AS (PARTITION BY i))"""


_FEAT = _feat(FOUND)


def _kmeans() -> str:
    far = "SELECT i, 0 AS c, x, y FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY x*x + y*y, algo_id) AS n FROM scaled) WHERE n = 1"
    out = f", c0 AS MATERIALIZED ({far})"
    for j in range(1, FOUND):
        out += f""", c{j} AS MATERIALIZED (SELECT * FROM c{j - 1} UNION ALL SELECT i, {j}, x, y FROM (SELECT i, x, y, row_number() OVER (PARTITION BY i ORDER BY d DESC, algo_id) AS n FROM (SELECT p.i, p.algo_id, p.x, p.y, min((p.x-c.x)*(p.x-c.x)+(p.y-c.y)*(p.y-c.y)) AS d FROM scaled p JOIN c{j - 1} c USING (i) GROUP BY ALL)) WHERE n = 1)"""
    now = f"c{FOUND - 1}"
    own = "SELECT i, algo_id, px AS x, py AS y, c FROM (SELECT p.i, p.algo_id, p.x AS px, p.y AS py, c.c, row_number() OVER (PARTITION BY p.i, p.algo_id ORDER BY (p.x-c.x)*(p.x-c.x)+(p.y-c.y)*(p.y-c.y), c.c) AS n FROM scaled p JOIN {0} c USING (i)) WHERE n = 1"
    for j in range(ROUNDS):
        out += f", o{j} AS MATERIALIZED ({own.format(now)}), m{j} AS MATERIALIZED (SELECT k.i, k.c, coalesce(avg(o.x), any_value(k.x)) AS x, coalesce(avg(o.y), any_value(k.y)) AS y FROM {now} k LEFT JOIN o{j} o ON o.i = k.i AND o.c = k.c GROUP BY 1, 2)"
        now = f"m{j}"
    return out + f", of AS MATERIALIZED ({own.format(now)}), rk AS (SELECT i, c, (row_number() OVER (PARTITION BY i ORDER BY y, x) - 1)::INT AS cluster FROM {now}), labels AS (SELECT of.i, algo_id, cluster FROM of JOIN rk ON rk.i = of.i AND rk.c = of.c)"


def _restarts(k: int, starts: int) -> str:
    """Labels (i, algo_id, cluster) of scaled points by rounds that go on until centres rest, the best of several starts.

    Centres are lists by date i and start s; coordinates are whole numbers of a thousand-millionth.
    """
    d = "(x - cx[c]) * (x - cx[c]) + (y - cy[c]) * (y - cy[c])"
    drawn = "-ln((('0x' || substr(md5(concat_ws(':', i, s, {0}, algo_id)), 1, 8))::UBIGINT::DOUBLE + 1) / 4294967297.0::DOUBLE)"
    won = "arg_min({{'x': x, 'y': y}}, {{'k': {0}, 'a': algo_id}})"
    out = f""",
pts AS MATERIALIZED (SELECT i, algo_id, round(x * 1e9)::BIGINT::DOUBLE AS x, round(y * 1e9)::BIGINT::DOUBLE AS y FROM scaled),
g0 AS MATERIALIZED (SELECT i, s, [p.x] AS cx, [p.y] AS cy FROM (SELECT i, s, {won.format(f"CASE WHEN s = 0 THEN x * x + y * y ELSE {drawn.format(0)} END")} AS p FROM pts CROSS JOIN range({starts}) t(s) GROUP BY i, s))"""
    for j in range(1, k):
        key = f"CASE WHEN s = 0 THEN -near WHEN near > 0 THEN {drawn.format(j)} / near ELSE 1e308 END"
        out += f""",
g{j} AS MATERIALIZED (SELECT i, s, list_append(cx, p.x) AS cx, list_append(cy, p.y) AS cy FROM (SELECT i, s, any_value(cx) AS cx, any_value(cy) AS cy, {won.format(key)} AS p
  FROM (SELECT *, list_min(list_transform(range(1, {j + 1}), lambda c: {d})) AS near FROM pts JOIN g{j - 1} USING (i)) GROUP BY i, s))"""
    mean = lambda v: ", ".join(f"coalesce((sum({v}::BIGINT) FILTER (own = {c}))::DOUBLE / count(*) FILTER (own = {c}), any_value(c{v})[{c}])" for c in range(1, k + 1))
    near = f"list_transform(range(1, {k + 1}), lambda c: {d})"
    return out + f""",
rounds(r, i, s, cx, cy, moved) AS (
  SELECT 0, i, s, cx, cy, true FROM g{k - 1}
  UNION ALL
  SELECT r + 1, i, s, nx, ny, nx <> cx OR ny <> cy FROM (
    SELECT r, i, s, any_value(cx) AS cx, any_value(cy) AS cy, [{mean("x")}] AS nx, [{mean("y")}] AS ny FROM (
      SELECT *, list_position(ds, list_min(ds)) AS own FROM (SELECT rounds.*, pts.x, pts.y, {near} AS ds FROM rounds JOIN pts USING (i) WHERE moved AND r < 300)) GROUP BY r, i, s)),
ends AS (SELECT i, s, arg_max({{'cx': cx, 'cy': cy}}, r) AS e FROM rounds GROUP BY i, s),
spread AS (SELECT i, s, sum(list_min({near}) / 1e18) AS inertia, any_value(cx) AS cx, any_value(cy) AS cy FROM (SELECT i, s, e.cx AS cx, e.cy AS cy FROM ends) JOIN pts USING (i) GROUP BY i, s),
best AS (SELECT i, arg_min({{'cx': cx, 'cy': cy}}, {{'v': round(inertia, 9), 's': s}}) AS e FROM spread GROUP BY i),
placed AS (SELECT i, e.cx AS cx, e.cy AS cy, list_transform(list_sort(list_transform(range(1, {k + 1}), lambda c: {{'y': e.cy[c], 'x': e.cx[c], 'c': c}})), lambda t: t.c) AS o FROM best),
labels AS MATERIALIZED (SELECT i, algo_id, (list_position(o, list_position(ds, list_min(ds))) - 1)::INT AS cluster FROM (SELECT i, algo_id, o, {near} AS ds FROM pts JOIN placed USING (i)))"""


def _found(k: int) -> str:
    """Returns of found clusters."""
    return f""",
held AS (SELECT l.i, l.cluster, avg(coalesce(r.ret, 0.0)) AS ret FROM labels l LEFT JOIN rets r ON r.i = l.i AND r.algo_id = l.algo_id GROUP BY 1, 2),
found AS (SELECT g.i, g.cluster, coalesce(h.ret, 0.0) AS ret FROM (SELECT i, cluster::INT AS cluster FROM (SELECT DISTINCT i FROM labels), range({k}) t(cluster)) g LEFT JOIN held h ON h.i = g.i AND h.cluster = g.cluster)"""


_FOUND = _PANEL + _FEAT + _kmeans() + _found(FOUND)


def _w(body: str) -> str:
    return "WITH " + ("RECURSIVE " if "rounds(" in body else "") + body.strip()


_DAY = "ts::DATE AS d"
_PICK = ", ".join(f"max(CASE WHEN cluster = {c} THEN round({x}, 6) END) AS C{c}_{x.title()}" for c in range(K) for x in ("ret", "vol", "mom"))

ORACLES: dict[str, str] = {
    "q01_panel": _w(_PANEL) + f" SELECT {_DAY}, algo_id, round(close, 4) AS close FROM panel",
    "q02_dedupe_first": "SELECT user_id, ts::DATE AS date, min(event_id) AS event_id FROM events GROUP BY 1, 2",
    "q03_calendar": _w(_PANEL) + f" SELECT {_DAY}, i FROM cal",
    "q04_returns_padded": _w(_PANEL) + " SELECT i, algo_id, round(ret, 6) AS ret FROM rets",
    "q05_active_mask": "WITH e AS (SELECT ts::DATE AS d, user_id AS algo_id, arg_max(value, {'t': ts, 'e': event_id}) AS close FROM events GROUP BY 1, 2), c AS (SELECT d, (row_number() OVER (ORDER BY d) - 1)::INT AS i FROM (SELECT DISTINCT d FROM e)) SELECT i, algo_id, (close <> 0)::INT AS active FROM e JOIN c USING (d) WHERE close IS NOT NULL",
    "q06_dense_lifespan": _w(_PANEL + _DENSE) + " SELECT algo_id, count(*) AS n, min(i) AS lo, max(i) AS hi, sum(active::INT)::BIGINT AS live FROM dense GROUP BY 1",
    "q07_macro": _w(_PANEL + _MACRO) + " SELECT i, round(syn_mkt_ret, 8) AS syn_mkt_ret, round(syn_vix, 8) AS syn_vix, round(syn_breadth, 6) AS syn_breadth FROM macro",
    "q08_eligibility": _w(_PANEL + _FEAT) + " SELECT i, count(*) AS eligible, sum(algo_id)::BIGINT AS ids FROM feat GROUP BY 1",
    "q09_window_features": _w(_PANEL + _FEAT) + " SELECT i, algo_id, round(ret_total, 6) AS ret_total, round(volatility, 6) AS volatility FROM feat",
    "q10_scaled_features": _w(_PANEL + _FEAT) + " SELECT i, algo_id, round(x, 5) AS x, round(y, 5) AS y FROM scaled",
    "q11_kmeans_labels": _w(_PANEL + _FEAT + _kmeans()) + " SELECT i, algo_id, cluster FROM labels",
    "q12_cluster_returns": _w(_FOUND) + " SELECT i, cluster, round(ret, 6) AS ret FROM found",
    "q13_cluster_vol_mom": _w(_FOUND) + " SELECT i, cluster, CASE WHEN count(*) OVER w = 20 THEN round(stddev_samp(ret) OVER w, 6) ELSE 0.0 END AS vol, CASE WHEN count(*) OVER w = 20 THEN round(sum(ret) OVER w, 6) ELSE 0.0 END AS mom FROM found WINDOW w AS (PARTITION BY cluster ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
    "q14_cluster_wide": _w(_PANEL + _SERIES) + f" SELECT i, {_PICK} FROM series GROUP BY i",
    "q15_monthly_equity": "WITH x AS (SELECT 1)" + _MONTHS + _asof("equity").split(",\ndates")[0] + " SELECT month_end, round(equity, 6) AS equity FROM me",
    "q16_benchmark_asof_bfill": _w(_PANEL + _MONTHS + _asof(_BFILL, "WHERE month >= '1996-01'")) + " SELECT date, round(bench_ret, 8) AS bench_ret FROM bench",
    "q17_benchmark_asof_one": _w(_PANEL + _MONTHS + _asof("coalesce(equity, 1.0)", "WHERE month >= '1996-01'")) + " SELECT date, round(bench_ret, 8) AS bench_ret FROM bench",
    "q18_resample_daily_ffill": "WITH e AS (SELECT user_id, ts, max(value) AS value FROM events GROUP BY 1, 2), d AS (SELECT user_id, ts::DATE AS date, arg_max(value, ts) AS value FROM e GROUP BY 1, 2), s AS (SELECT user_id, unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM d GROUP BY 1) SELECT s.user_id, s.date, round(d.value, 4) AS value FROM s ASOF JOIN d ON d.user_id = s.user_id AND s.date >= d.date",
    "q19_align_inner_dates": _w(_PANEL + _MACRO + _SERIES + _MONTHS + _asof(_BFILL)) + " SELECT s.ts::DATE AS date, cluster, round(ret, 6) AS ret, round(syn_mkt_ret, 8) AS syn_mkt_ret, round(bench_ret, 8) AS bench_ret FROM series s JOIN macro USING (ts) JOIN bench ON bench.date = s.ts::DATE WHERE s.ts::DATE BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'",
    "q20_backtest_log": _w(_LOG) + f" SELECT {_DAY}, round(equity, 4) AS equity, round(ret, 8) AS ret, round(turnover, 6) AS turnover, round(cost, 8) AS cost, round(cash_weight, 6) AS cash_weight FROM log",
    "q21_drawdown_curve": _w(_LOG) + f" SELECT {_DAY}, round(equity / first_value(equity) OVER w * 100, 4) AS rebased, round(equity / max(equity) OVER w - 1, 6) AS drawdown FROM log WINDOW w AS (ORDER BY ts ROWS UNBOUNDED PRECEDING)",
    "q22_kpis": _w(_LOG + _kpi("")) + " SELECT periods, round(total_return, 5) AS total_return, round(cagr, 5) AS cagr, round(vol, 5) AS vol, round(max_drawdown, 5) AS max_drawdown, round(sharpe, 5) AS sharpe, round(sortino, 5) AS sortino, round(calmar, 5) AS calmar, round(win_rate, 5) AS win_rate FROM kpi",
    "q23_alpha_beta": _w(_LOG + _kpi("")) + " SELECT round(alpha, 5) AS alpha, round(beta, 5) AS beta FROM kpi",
    "q24_cluster_profile": _w(_PANEL + _SERIES) + " SELECT cluster, round(avg(ret) * 252, 6) AS ret, round(stddev_samp(ret) * sqrt(252), 5) AS vol FROM series GROUP BY 1",
    "q25_allocation_rank": _w(_LOG) + f" SELECT cluster::INT AS cluster, round(avg(w), 6) AS mean_weight FROM sw WHERE cluster < {K} GROUP BY 1",
    "q26_return_histogram": _w(_LOG) + ", e AS (SELECT min(ret) AS lo, max(ret) AS hi, count(*) AS total FROM log) SELECT least(49, floor((ret - lo) / ((hi - lo) / 50)))::INT AS bin, count(*) AS n, round(count(*) * any_value(1.0 / (total * ((hi - lo) / 50))), 3) AS density FROM log, e GROUP BY 1",
    "q27_report_lines": _w(_LOG + _kpi("")) + ", l AS (SELECT unnest([{'n': 0, 'k': 'Total Return', 'v': format('{:.2f}%', total_return * 100)}, {'n': 1, 'k': 'CAGR', 'v': format('{:.2f}%', cagr * 100)}, {'n': 2, 'k': 'Vol', 'v': format('{:.2f}%', vol * 100)}, {'n': 3, 'k': 'Max DD', 'v': format('{:.2f}%', max_drawdown * 100)}, {'n': 4, 'k': 'Sharpe', 'v': format('{:.2f}', sharpe)}, {'n': 5, 'k': 'Sortino', 'v': format('{:.2f}', sortino)}, {'n': 6, 'k': 'Alpha', 'v': format('{:.2f}%', alpha * 100)}, {'n': 7, 'k': 'Beta', 'v': format('{:.2f}', beta)}, {'n': 8, 'k': 'Win Rate', 'v': format('{:.2f}%', win_rate * 100)}]) AS r FROM kpi) SELECT r.n::INT AS n, rpad(r.k, 15, ' ') || ' | ' || lpad(r.v, 10, ' ') AS line FROM l",
    "q28_walkforward_folds": _w(_WF) + " SELECT fold, split, count(*) AS steps, min(ts::DATE) AS first, max(ts::DATE) AS last, round(arg_max(equity, ts), 3) AS equity FROM log GROUP BY 1, 2",
    "q29_stitched_curve": _w(_WF) + f" SELECT {_DAY}, round(100 * product(1 + ret) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING), 4) AS curve FROM log WHERE split = 'test'",
    "q30_fold_summary": _w(_WF + _kpi("fold, split")) + " SELECT fold, round(max(CASE WHEN split = 'train' THEN total_return END), 5) AS train_ret, round(max(CASE WHEN split = 'test' THEN total_return END), 5) AS test_ret, round(max(CASE WHEN split = 'train' THEN sharpe END), 4) AS train_sharpe, round(max(CASE WHEN split = 'test' THEN sharpe END), 4) AS test_sharpe FROM kpi GROUP BY 1",
    "q31_allocate_capital": _w(_PANEL) + f", d AS (SELECT ts FROM cal WHERE i = 105), lt AS (SELECT max(rets.ts) AS ts FROM rets, d WHERE rets.i % 10 = 0 AND rets.ts <= d.ts), h AS (SELECT algo_id, (algo_id % {K})::INT AS cluster FROM rets JOIN lt USING (ts) WHERE algo_id IN (SELECT algo_id FROM rets JOIN d USING (ts) WHERE active)), wt(cluster, weight) AS (VALUES (0, 0.4::DOUBLE), (1, 0.3::DOUBLE), (3, 0.2::DOUBLE)) SELECT algo_id, round(1e6 * weight / count(*) OVER (PARTITION BY cluster), 4) AS amount FROM h JOIN wt USING (cluster)",
    "q33_baseline_weights": _w(_PANEL + _SERIES) + f", u AS (SELECT i, cluster, greatest(0.0, mom) AS u, sum(greatest(0.0, mom)) OVER (PARTITION BY i) AS t FROM series) SELECT i, cluster::INT AS slot, CASE WHEN t > 0 THEN round(u / t, 6) ELSE 0.0 END AS weight FROM u UNION ALL SELECT i, {K}, 0.0 FROM cal",
    "q34_observation_window": _w(_PANEL + _SERIES) + f", o AS (SELECT i, round(lag(ret, 1) OVER w, 6) AS last_ret, round(lag(ret, 30) OVER w, 6) AS first_ret FROM series WHERE cluster = 0 WINDOW w AS (ORDER BY i)) SELECT i, 30 AS n, {3 * K + 3} AS width, last_ret, first_ret FROM o WHERE i >= 30",
    "q35_reward": _w(_LOG) + f" SELECT {_DAY}, round(reward, 6) AS reward FROM log",
    "q37_global_curves": _w(_WF) + ", o AS (SELECT ts::DATE AS d, 100 * product(1 + ret) OVER (ORDER BY ts) AS strategy FROM log WHERE split = 'test'), b AS (SELECT date AS d, 100 * product(1 + bench_ret) OVER (ORDER BY date) AS bench FROM bench WHERE date BETWEEN (SELECT min(d) FROM o) AND (SELECT max(d) FROM o)) SELECT d, round(strategy, 4) AS strategy, round(bench, 4) AS bench FROM b LEFT JOIN o USING (d)",
}


def _report(names: str, width: int) -> str:
    """Lines (n, line) of figures in kpi: a list of (name, value) structs."""
    return f"SELECT n, format('{{:<{width}}} | {{:>10}}', k, v) AS line FROM (SELECT unnest(generate_series(0, len(l) - 1)) AS n, unnest(list_transform(l, lambda x: x.k)) AS k, unnest(list_transform(l, lambda x: x.v)) AS v FROM (SELECT [{names}] AS l FROM kpi))"


def _figure(name: str, value: str, form: str) -> str:
    shown = {"%": f"format('{{:.2f}}%', {value} * 100)", "#": f"format('{{:.2f}}', {value})", "d": f"format('{{}} days', {value})"}
    return f"{{'k': '{name}', 'v': {shown[form]}}}"


_SHORT = ", ".join(_figure(*x) for x in (("Total Return", "total_return", "%"), ("CAGR", "cagr", "%"), ("Vol", "vol", "%"), ("Max DD", "max_drawdown", "%"), ("Sharpe", "sharpe", "#"), ("Sortino", "sortino", "#"), ("Alpha", "alpha", "%"), ("Beta", "beta", "#"), ("Win Rate", "win_rate", "%")))
_LONG = ", ".join(_figure(*x) for x in (("Period", "periods", "d"), ("Total Return", "total_return", "%"), ("CAGR", "cagr", "%"), ("Volatility", "vol", "%"), ("Max Drawdown", "max_drawdown", "%"), ("Sharpe Ratio", "sharpe", "#"), ("Sortino Ratio", "sortino", "#"), ("Calmar Ratio", "calmar", "#"), ("Alpha (Ann.)", "alpha", "%"), ("Beta", "beta", "#"), ("Win Rate", "win_rate", "%")))

#: Ordinary least squares on three lagged indicators, by Cramer's rule over their covariances.
_OLS = _PANEL + _MACRO + _SERIES + """,
lagged AS (SELECT ts, lag(syn_mkt_ret) OVER w AS x1, lag(syn_vix) OVER w AS x2, lag(syn_breadth) OVER w AS x3 FROM macro WINDOW w AS (ORDER BY ts)),
cov AS (SELECT cluster, avg(ret) AS y, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, covar_pop(x1, x1) AS a, covar_pop(x1, x2) AS b, covar_pop(x1, x3) AS c, covar_pop(x2, x2) AS d, covar_pop(x2, x3) AS e, covar_pop(x3, x3) AS f, covar_pop(x1, ret) AS p, covar_pop(x2, ret) AS q, covar_pop(x3, ret) AS r FROM series JOIN lagged USING (ts) WHERE x1 IS NOT NULL GROUP BY 1),
det AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS v FROM cov),
beta AS (SELECT cluster, y, m1, m2, m3, (p * (d * f - e * e) - b * (q * f - e * r) + c * (q * e - d * r)) / v AS b1, (a * (q * f - e * r) - p * (b * f - e * c) + c * (b * r - q * c)) / v AS b2, (a * (d * r - q * e) - b * (b * r - q * c) + p * (b * e - d * c)) / v AS b3 FROM det)"""

#: The patterned network of 16 over the 30 rows before each: cells of a row, inputs, three layers.
_NET = _PANEL + _MACRO + _SERIES + """,
cell AS (SELECT i, 3 * cluster AS c, ret AS v FROM series UNION ALL SELECT i, 3 * cluster + 1, vol FROM series UNION ALL SELECT i, 3 * cluster + 2, mom FROM series
  UNION ALL SELECT i, 12, syn_mkt_ret FROM macro UNION ALL SELECT i, 13, syn_vix FROM macro UNION ALL SELECT i, 14, syn_breadth FROM macro),
inp AS (SELECT cal.i, 15 * r.r + c AS j, v FROM cal CROSS JOIN range(30) r(r) JOIN cell ON cell.i = cal.i - 30 + r.r WHERE cal.i >= 30),
l1 AS (SELECT i, h.h, tanh(sum(v * sin(1.0 + 3.0 * j + 7.0 * h.h)) / sqrt(450.0)) AS v FROM inp CROSS JOIN range(16) h(h) GROUP BY 1, 2),
l2 AS (SELECT i, g.g, tanh(sum(v * sin(12.0 + 3.0 * h + 7.0 * g.g)) / sqrt(16.0)) AS v FROM l1 CROSS JOIN range(16) g(g) GROUP BY 1, 2),
l3 AS (SELECT i, o.o AS slot, least(1.0, greatest(0.0, 0.5 + sum(v * sin(23.0 + 3.0 * g + 7.0 * o.o)) / sqrt(16.0))) AS action FROM l2 CROSS JOIN range(5) o(o) GROUP BY 1, 2)"""

_CW = ", ".join(f"max(CASE WHEN cluster = {c} THEN round(w, 6) END) AS C{c}_w" for c in range(K))

#: Clusters of the full size, and all that is built on them.
FULL, STARTS = 10, 10
_LABELS = _PANEL + _feat(FULL) + _restarts(FULL, STARTS)
_FULL = _LABELS + _found(FULL) + """,
series AS (SELECT cal.ts, f.i, f.cluster, f.ret, CASE WHEN count(*) OVER w = 20 THEN stddev_samp(f.ret) OVER w ELSE 0.0 END AS vol, CASE WHEN count(*) OVER w = 20 THEN sum(f.ret) OVER w ELSE 0.0 END AS mom
  FROM found f JOIN cal USING (i) WINDOW w AS (PARTITION BY f.cluster ORDER BY f.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""
_WIDE = ", ".join(f"max(CASE WHEN cluster = {c} THEN round({x}, 6) END) AS C{c}_{x.title()}" for c in range(FULL) for x in ("ret", "vol", "mom"))
_CASH = lambda sql: sql.replace(f"SELECT ts, {K}, 0.0", f"SELECT ts, {FULL}, 0.0").replace(f"cluster = {K} THEN", f"cluster = {FULL} THEN").replace(f"cluster < {K} THEN", f"cluster < {FULL} THEN")
_FULL_RUN = _FULL + _MONTHS + _asof(_BFILL) + _CASH(_ACT)

ORACLES |= {
    "q38_full_kmeans_labels": _w(_LABELS) + " SELECT i, algo_id, cluster FROM labels",
    "q39_full_cluster_wide": _w(_FULL) + f" SELECT i, {_WIDE} FROM series GROUP BY i",
    "q40_full_backtest_log": _w(_FULL_RUN + _CASH(_sim("(SELECT DISTINCT ts FROM act)", "", 30))) + f" SELECT {_DAY}, round(equity, 4) AS equity, round(ret, 8) AS ret, round(turnover, 6) AS turnover, round(cost, 8) AS cost, round(cash_weight, 6) AS cash_weight FROM log",
    "q60_full_walk_forward": _w(_FULL_RUN + _FOLDS + _CASH(_sim("folded", "fold, split", 30)) + _kpi("fold, split")) + " SELECT fold AS Fold, round(max(CASE WHEN split = 'train' THEN total_return END), 4) AS Train_Ret, round(max(CASE WHEN split = 'test' THEN total_return END), 4) AS Test_Ret, round(max(CASE WHEN split = 'train' THEN sharpe END), 4) AS Train_Sharpe, round(max(CASE WHEN split = 'test' THEN sharpe END), 4) AS Test_Sharpe FROM kpi GROUP BY 1",
    "q32_baseline_fit": _w(_OLS) + " SELECT cluster, round(y - b1 * m1 - b2 * m2 - b3 * m3, 4) AS intercept, round(b1, 4) AS b_ret, round(b2, 4) AS b_vix, round(b3, 4) AS b_breadth FROM beta",
    "q41_universe_written": _w(_PANEL) + " SELECT i, algo_id, round(ret, 6) AS ret, active::INT AS active, year(ts)::INT AS year FROM rets WHERE ts::DATE BETWEEN DATE '1996-03-01' AND DATE '1997-06-30'",
    "q42_macro_written": ORACLES["q07_macro"],
    "q68_macro_by_new_dates": ORACLES["q07_macro"],
    "q43_clusters_written": ORACLES["q14_cluster_wide"],
    "q44_labels_written": _w(_PANEL) + f" SELECT i, algo_id, (algo_id % {K})::INT AS cluster FROM rets WHERE i % 10 = 0",
    "q45_execution_csv": _w(_LOG) + f", cw AS (SELECT ts, {_CW} FROM sw GROUP BY ts) SELECT {_DAY}, round(equity, 4) AS equity, round(ret, 8) AS return, round(bench_ret, 8) AS benchmark_return, 2.0::DOUBLE AS leverage, round(cost, 8) AS cost, round(cash_weight, 6) AS cash_weight, cw.* EXCLUDE (ts) FROM log JOIN cw USING (ts)",
    "q46_executive_report": _w(_LOG + _kpi("")) + f", body AS ({_report(_LONG, 25)}), d AS (SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS a, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS b FROM log) SELECT 0 AS n, '--- PORTFOLIO: EXECUTIVE REPORT (Test) ---' AS line UNION ALL SELECT 1, '' UNION ALL SELECT 2, 'Period: ' || a || ' -> ' || b FROM d UNION ALL SELECT 3, repeat('-', 40) UNION ALL SELECT (n + 4)::INT, line FROM body UNION ALL SELECT 15, repeat('-', 40)",
    "q47_executive_summary": _w(_LOG + _kpi("")) + f", body AS ({_report(_SHORT, 15)}) SELECT 0 AS n, '--- REPORT: All - Out-of-Sample ---' AS line UNION ALL SELECT (n + 1)::INT, line FROM body",
    "q48_metrics_summary": _w(_WF + _kpi("fold, split")) + " SELECT fold AS Fold, round(max(CASE WHEN split = 'train' THEN total_return END), 4) AS Train_Ret, round(max(CASE WHEN split = 'test' THEN total_return END), 4) AS Test_Ret, round(max(CASE WHEN split = 'train' THEN sharpe END), 4) AS Train_Sharpe, round(max(CASE WHEN split = 'test' THEN sharpe END), 4) AS Test_Sharpe FROM kpi GROUP BY 1",
    "q49_prices_from_csv": _w(_PANEL) + " SELECT i, algo_id::VARCHAR AS algo_id, round(ret, 6) AS ret FROM rets",
    "q50_labels_from_csv": _w(_PANEL + _FEAT + _kmeans()) + " SELECT i, algo_id::VARCHAR AS algo_id, cluster FROM labels",
    "q51_data_audit": _w(_PANEL + _SERIES) + " SELECT round(avg((r + v + m) / 3), 6) AS mean FROM (SELECT cluster, avg(ret) AS r, avg(vol) AS v, avg(mom) AS m FROM series GROUP BY 1)",
    "q52_return_density": _w(_LOG) + ", e AS (SELECT min(ret) AS lo, max(ret) AS hi, count(*) AS n, stddev_samp(ret) * pow(count(*), -0.2) AS h FROM log), g AS (SELECT p::INT AS point, lo - 3 * h + p * (hi - lo + 6 * h) / 199 AS x, n, h FROM e, range(200) t(p)) SELECT point, round(any_value(x), 8) AS x, round(sum(exp(-pow((x - ret) / h, 2) / 2)) / any_value(n * h * sqrt(2 * pi())), 4) AS density FROM g, log GROUP BY point",
    "q53_weight_stack": _w(_LOG) + f", mw AS (SELECT cluster, CASE WHEN cluster < {K} THEN avg(w) ELSE -1.0 END AS m FROM sw GROUP BY 1) SELECT {_DAY}, cluster::INT AS cluster, round(w, 6) AS weight, round(sum(w) OVER (PARTITION BY ts ORDER BY m DESC, cluster ROWS UNBOUNDED PRECEDING), 6) AS top FROM sw JOIN mw USING (cluster)",
    "q54_benchmark_reindexed": _w(_LOG) + f" SELECT {_DAY}, CASE WHEN ts::DATE >= DATE '1997-01-01' THEN round(bench_ret, 8) ELSE 0.0 END AS bench_ret FROM log",
    "q55_rebalance_returns": _w(_PANEL) + f", l AS (SELECT i + s.s AS i, algo_id, (algo_id % {K})::INT AS cluster FROM rets CROSS JOIN range(5) s(s) WHERE i >= 60 AND (i - 60) % 5 = 0), h AS (SELECT l.i, cluster, sum(coalesce(ret, 0.0)) / count(*) AS ret FROM l LEFT JOIN rets USING (i, algo_id) GROUP BY 1, 2) SELECT g.i::INT AS i, g.cluster::INT AS cluster, round(coalesce(ret, 0.0), 6) AS ret FROM (SELECT i, c AS cluster FROM (SELECT DISTINCT i FROM l) CROSS JOIN range({K}) t(c)) g JOIN cal USING (i) LEFT JOIN h USING (i, cluster)",
    "q56_date_mismatches": _w(_PANEL) + " SELECT 'benchmark' AS what, count(*) AS missing FROM cal WHERE ts::DATE < DATE '1996-01-01'",
    "q57_trades_benchmark": "WITH t AS (SELECT o_orderdate AS ts, 1e6::DOUBLE + max(o_totalprice) AS e FROM orders GROUP BY 1), d AS (SELECT ts::DATE AS date, arg_max(e, ts) AS e FROM t GROUP BY 1), s AS (SELECT unnest(generate_series((SELECT min(date) FROM d)::TIMESTAMP, (SELECT max(date) FROM d)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date), f AS (SELECT s.date, d.e FROM s ASOF JOIN d ON d.date <= s.date) SELECT date, round(coalesce(e / lag(e) OVER (ORDER BY date) - 1, 0.0), 8) AS bench_ret FROM f",
    "q58_zero_benchmark": _w(_PANEL) + " SELECT DISTINCT ts::DATE AS date, 0.0::DOUBLE AS bench_ret FROM cal",
    "q59_network_rollout": _w(_NET) + " SELECT i, slot::INT AS slot, round(action, 6) AS action FROM l3",
}


#: Shuffles 0 to 200 of blocks of five steps; 0 leaves all where it is.
_PERM = """,
st AS (SELECT fold, split, ts, row_number() OVER (PARTITION BY fold, split ORDER BY ts) - 1 AS pos FROM steps),
cl AS (SELECT st.fold, st.split, pos, w.cluster, w.ret, w.w FROM st JOIN wts w USING (ts) WHERE w.cluster < 4),
mv AS (SELECT fold, split, draw, pos AS src, row_number() OVER (PARTITION BY fold, split, draw ORDER BY CASE WHEN draw = 0 THEN '' ELSE md5(concat_ws(':', 42, fold, split, draw, pos // 5)) END, pos) - 1 AS pos FROM st CROSS JOIN range(201) t(draw)),
er AS (SELECT mv.fold, mv.split, draw, mv.pos, sum(a.w * b.ret) * 2.0 - any_value(net.cost) AS ret FROM mv JOIN cl a ON a.fold = mv.fold AND a.split = mv.split AND a.pos = mv.pos
  JOIN cl b ON b.fold = mv.fold AND b.split = mv.split AND b.pos = mv.src AND b.cluster = a.cluster
  JOIN st ON st.fold = mv.fold AND st.split = mv.split AND st.pos = mv.pos JOIN net ON net.fold = st.fold AND net.split = st.split AND net.ts = st.ts GROUP BY 1, 2, 3, 4),
ra AS (SELECT fold, split, draw, count(*) AS steps, round(coalesce(avg(ret) / stddev_samp(ret), 0.0), 9) AS ratio FROM er GROUP BY 1, 2, 3),
ow AS (SELECT fold, split, steps, ratio FROM ra WHERE draw = 0)"""

#: The portfolio's value since entry from step to step: open value v, steps left in cash, and what closed it.
_GUARD = """,
lg AS (SELECT log.*, row_number() OVER (ORDER BY ts) - 1 AS pos FROM log),
walk(pos, v, rest, held, entered, closed) AS (
  SELECT -1::BIGINT, 1.0::DOUBLE, 0, false, false, NULL::VARCHAR
  UNION ALL
  SELECT lg.pos, CASE WHEN walk.rest > 0 OR hit IS NOT NULL THEN 1.0 ELSE now END, CASE WHEN walk.rest > 0 THEN walk.rest - 1 WHEN hit IS NOT NULL THEN 5 ELSE 0 END, walk.rest = 0,
    walk.rest = 0 AND NOT walk.held AND walk.pos >= 0, CASE WHEN walk.rest = 0 THEN hit END
  FROM walk JOIN lg ON lg.pos = walk.pos + 1, LATERAL (SELECT walk.v * (1 + lg.ret) AS now), LATERAL (SELECT CASE WHEN now - 1 <= -0.05 THEN 'stop' WHEN now - 1 >= 0.08 THEN 'take' END AS hit)),
gd AS (SELECT lg.ts, held, walk.closed, CASE WHEN held THEN CASE WHEN entered THEN 4.0 * (1 - cash_weight) ELSE turnover END + CASE WHEN walk.closed IS NOT NULL THEN 4.0 * (1 - cash_weight) ELSE 0.0 END ELSE 0.0 END AS paid, lg.ret AS was, lg.cost AS cost FROM lg JOIN walk USING (pos)),
gr AS (SELECT *, CASE WHEN held THEN was + cost - paid * 0.0005 ELSE 0.0 END AS ret FROM gd)"""

_LOYO = """,
yrs AS (SELECT DISTINCT year(ts) AS y FROM act),
pairs AS (SELECT 'without ' || o.y AS fold, CASE WHEN y.y = o.y THEN 'test' ELSE 'train' END AS split, y.y, o.y AS out FROM yrs y CROSS JOIN yrs o),
folded AS (SELECT fold, split, (split = 'train' AND pairs.y > out AND EXISTS (SELECT 1 FROM yrs WHERE yrs.y < out))::INT AS part, ts FROM (SELECT DISTINCT ts FROM act) a JOIN pairs ON year(a.ts) = pairs.y)"""
#: Parts' returns one after another make a split's equity.
_PARTS = """,
parted AS (SELECT * EXCLUDE (equity) FROM log),
whole AS (SELECT *, 100 * product(1 + ret) OVER (PARTITION BY fold, split ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM parted)"""

_HOLD = """,
hp AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM act)),
hs AS (SELECT ts, pos FROM hp WHERE pos >= 30 AND pos <= greatest(30, n - 2)),
hg AS (SELECT s.ts, s.cluster, s.ret, coalesce(product(1 + s.ret) OVER (PARTITION BY s.cluster ORDER BY s.ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS g FROM series s JOIN hs USING (ts)),
hd AS (SELECT ts, sum(g * ret) / sum(g) AS gross, max(CASE WHEN cluster = 0 THEN g END) / sum(g) AS w0, CASE WHEN row_number() OVER (ORDER BY ts) = 1 THEN 0.001::DOUBLE ELSE 0.0 END AS cost FROM hg GROUP BY ts)"""

#: Least squares of each fold's training years by Cramer's rule, traded in the year left out.
_CV = _RUN + _MACRO + _LOYO + """,
lagged AS (SELECT ts, lag(syn_mkt_ret) OVER w AS x1, lag(syn_vix) OVER w AS x2, lag(syn_breadth) OVER w AS x3 FROM macro WINDOW w AS (ORDER BY ts)),
lr AS (SELECT fold, split, series.ts, cluster, ret, x1, x2, x3 FROM series JOIN lagged USING (ts) JOIN folded USING (ts) WHERE x1 IS NOT NULL),
cov AS (SELECT fold, cluster, avg(ret) AS y, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, covar_pop(x1, x1) AS a, covar_pop(x1, x2) AS b, covar_pop(x1, x3) AS c, covar_pop(x2, x2) AS d, covar_pop(x2, x3) AS e, covar_pop(x3, x3) AS f, covar_pop(x1, ret) AS p, covar_pop(x2, ret) AS q, covar_pop(x3, ret) AS r FROM lr WHERE split = 'train' GROUP BY 1, 2),
det AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS v FROM cov),
beta AS (SELECT fold, cluster, y, m1, m2, m3, (p * (d * f - e * e) - b * (q * f - e * r) + c * (q * e - d * r)) / v AS b1, (a * (q * f - e * r) - p * (b * f - e * c) + c * (b * r - q * c)) / v AS b2, (a * (d * r - q * e) - b * (b * r - q * c) + p * (b * e - d * c)) / v AS b3 FROM det),
pr2 AS (SELECT lr.fold, ts, lr.cluster, lr.ret, greatest(0.0, y + b1 * (x1 - m1) + b2 * (x2 - m2) + b3 * (x3 - m3)) AS u FROM lr JOIN beta USING (fold, cluster) WHERE split = 'test'),
bw AS (SELECT fold, ts, cluster, ret, CASE WHEN sum(u) OVER w > 0 THEN u / sum(u) OVER w ELSE 0.0 END AS w FROM pr2 WINDOW w AS (PARTITION BY fold, ts)),
bx AS (SELECT * FROM bw UNION ALL SELECT DISTINCT fold, ts, 4, 0.0::DOUBLE, 0.0::DOUBLE FROM bw),
tested AS (SELECT DISTINCT fold, ts FROM bw)"""
_CV_SIM = _sim("tested", "fold", 12).replace("JOIN wts w ON w.ts = b.ts", "JOIN bx w ON w.ts = b.ts AND w.fold = b.fold")
_FIGURES = "round(total_return, {0}) AS total_return, round(vol, {0}) AS vol, round(max_drawdown, {0}) AS max_drawdown, round(win_rate, {0}) AS win_rate FROM kpi"

ORACLES |= {
    "q61_permutation_test": _w(_WF + _PERM) + " SELECT ow.fold, ow.split, ow.steps, round(ow.ratio, 6) AS ratio, (count(*) - 1)::INT AS at_least, round(count(*) / 201.0::DOUBLE, 6) AS p_value FROM ow JOIN ra ON ra.fold = ow.fold AND ra.split = ow.split AND ra.ratio >= ow.ratio GROUP BY 1, 2, 3, 4",
    "q62_stop_and_take": "WITH RECURSIVE " + (_LOG + _GUARD).strip() + f" SELECT {_DAY}, round(100 * product(1 + ret) OVER (ORDER BY ts), 4) AS equity, round(ret, 8) AS ret, round(paid, 6) AS turnover, held, closed FROM gr",
    "q63_leave_one_year_out": _w(_RUN + _LOYO + _sim("folded", "fold, split, part", 12) + _PARTS + _kpi("fold, split").replace("FROM log)", "FROM whole)")) + f" SELECT fold, split, periods, {_FIGURES.format(5)}",
    "q64_buy_and_hold": _w(_RUN + _HOLD) + f" SELECT {_DAY}, round(100 * product(1 + gross - cost) OVER (ORDER BY ts), 4) AS equity, round(gross - cost, 8) AS ret, round(cost, 8) AS cost, round(w0, 6) AS w0 FROM hd",
    "q65_baseline_cross_validated": _w(_CV + _CV_SIM + _kpi("fold")) + f" SELECT fold, periods, {_FIGURES.format(4)}",
    "q66_allocate_calendar": _w(_LOG) + f", lt AS (SELECT DISTINCT ts FROM rets WHERE i % 10 = 0), ao AS (SELECT log.ts, lt.ts AS lts FROM log ASOF JOIN lt ON log.ts >= lt.ts), hh AS (SELECT ao.ts, r.algo_id, (r.algo_id % {K})::INT AS cluster FROM ao JOIN rets r ON r.ts = ao.lts JOIN rets m ON m.ts = ao.ts AND m.algo_id = r.algo_id AND m.active), aw AS (SELECT ts, cluster, w FROM sw WHERE cluster < {K}) SELECT hh.ts::DATE AS d, algo_id, round(1e6 * w / count(*) OVER (PARTITION BY hh.ts, hh.cluster), 3) AS amount FROM hh JOIN aw ON aw.ts = hh.ts AND aw.cluster = hh.cluster",
    "q67_loader_modes": _w(_PANEL + _MONTHS + _asof(_BFILL, "WHERE month >= '1996-01'") + ", one AS (SELECT date, coalesce(e / lag(e) OVER (ORDER BY date) - 1, 0.0) AS bench_ret FROM (SELECT date, coalesce(equity, 1.0) AS e FROM af))")
    + ", t AS (SELECT o_orderdate::DATE AS date, arg_max(e, o_orderdate) AS e FROM (SELECT o_orderdate, 1e6::DOUBLE + max(o_totalprice) AS e FROM orders GROUP BY 1) GROUP BY 1), sp AS (SELECT unnest(generate_series((SELECT min(date) FROM t)::TIMESTAMP, (SELECT max(date) FROM t)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date), tr AS (SELECT date, coalesce(e / lag(e) OVER (ORDER BY date) - 1, 0.0) AS bench_ret FROM (SELECT sp.date, t.e FROM sp ASOF JOIN t ON t.date <= sp.date))"
    + ", al AS (SELECT 'train' AS mode, * FROM tr UNION ALL SELECT 'test', * FROM bench UNION ALL SELECT 'walk_forward', * FROM one) SELECT mode, count(*) AS dates, round(arg_min(bench_ret, date), 8) AS first, round(sum(bench_ret), 6) AS total FROM al JOIN dates USING (date) WHERE date BETWEEN DATE '1995-06-01' AND DATE '1998-12-31' GROUP BY 1",
}
