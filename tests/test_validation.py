"""Ordered scans, restarts of k-means, validation, risk rules, allocation over a calendar and split price files against loops."""

import hashlib
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelflow.config import EngineConfig
from panelflow.operators import allocate, benchmark, cluster, panel, risk, validation
from panelflow.operators.scan import running
from panelflow.sources import adapters

DAY0 = datetime(2019, 12, 20)


def _days(n, step=1):
    return [DAY0 + timedelta(days=step * i) for i in range(n)]


@pytest.mark.parametrize("unit", ["year", "month", "day"])
def test_running_values_cross_blocks(spark, unit):
    rng = np.random.default_rng(1)
    v = [None if rng.random() < 0.3 else float(rng.integers(-9, 9)) for _ in range(40)]
    v[:2] = [None, None]
    rows = [(t, x) for t, x in zip(_days(40, 11), v)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(40)], "ts timestamp, v double")
    c = F.col("v")
    got = running(df, "ts", ["ts"], unit, n=("count", None), p=("product", 1 + c / 10), s=("sum", c), m=("max", c), f=("last", c), b=("lag", c)).orderBy("ts").toPandas()
    x = pd.Series(v, dtype=float)
    want = pd.DataFrame({"n": range(1, 41), "p": (1 + x / 10).fillna(1.0).cumprod(), "s": x.fillna(0.0).cumsum(), "m": x.cummax().ffill(), "f": x.ffill(), "b": x.shift()})
    pd.testing.assert_frame_equal(got[list(want)], want, check_dtype=False)


def test_running_over_nothing_and_without_time(spark):
    empty = spark.createDataFrame([], "ts timestamp, v double")
    assert running(empty, "ts", ["ts"], n=("count", None)).collect() == []
    null = spark.createDataFrame([(None, 1.0), (DAY0, 2.0)], "ts timestamp, v double")
    assert [r.n for r in running(null, "ts", ["ts"], n=("count", None)).collect()] == [1]
    with pytest.raises(ValueError, match="decade"):
        running(null, "ts", ["ts"], "decade", n=("count", None))


def test_no_scan_runs_in_one_task(spark):
    p = spark.createDataFrame([(t, i % 3, 1.0 + i) for i, t in enumerate(_days(30))], "ts timestamp, algo_id long, close double")
    plan = panel.calendar(p)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "_block" in plan.split("windowspecdefinition(")[1][:30]


def test_indicators_equal_the_dense_frame(spark):
    rng = np.random.default_rng(4)
    cells = [(t, a, float(100 + rng.normal())) for t in _days(12) for a in range(9) if rng.random() < 0.6]
    p = spark.createDataFrame(cells, "ts timestamp, algo_id long, close double")
    times = panel.calendar(p)
    rets = panel.returns(p, times)
    got = panel.macro(rets, times).orderBy("i").toPandas()
    wide = rets.toPandas().pivot(index="i", columns="algo_id", values="ret").fillna(0.0)
    want = np.column_stack([wide.mean(axis=1), wide.std(axis=1), (wide > 0).mean(axis=1)])
    assert np.allclose(got[["syn_mkt_ret", "syn_vix", "syn_breadth"]], want, atol=1e-15)


def _lloyd(p, c):
    while True:
        own = ((p[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([p[own == j].sum(axis=0) / (own == j).sum() if (own == j).any() else c[j] for j in range(len(c))])
        if (new == c).all():
            return own, c, ((p - c[own]) ** 2).sum()
        c = new


def _seeded(p, ids, date_no, start, k):
    def u(step, a):
        return (int(hashlib.md5(f"{date_no}:{start}:{step}:{a}".encode()).hexdigest()[:8], 16) + 1) / 4294967297.0

    chosen = [min(range(len(p)), key=lambda r: ((p[r] ** 2).sum() if start == 0 else -np.log(u(0, ids[r])), ids[r]))]
    for step in range(1, k):
        near = np.min([((p - p[c]) ** 2).sum(axis=1) for c in chosen], axis=0)
        key = [-near[r] if start == 0 else -np.log(u(step, ids[r])) / near[r] if near[r] > 0 else 1e308 for r in range(len(p))]
        chosen.append(min(range(len(p)), key=lambda r: (key[r], ids[r])))
    return p[chosen]


def test_kmeans_takes_the_best_start(spark):
    rng = np.random.default_rng(9)
    dates = {i: (rng.permutation(100)[:n].tolist(), np.round(rng.normal(0, 1, (n, 2)), 3) * 1e9) for i, n in ((3, 40), (4, 25), (5, 5))}
    dates[6] = (list(range(6)), np.zeros((6, 2)))
    rows = [(i, a, float(x / 1e9), float(y / 1e9)) for i, (ids, p) in dates.items() for a, (x, y) in zip(ids, p)]
    got = cluster.kmeans(spark.createDataFrame(rows, "i int, algo_id long, x double, y double"), 5, starts=4).toPandas()
    assert len(got) == len(rows)
    for i, (ids, p) in dates.items():
        tried = [_lloyd(p, _seeded(p, ids, i, s, 5)) for s in range(4)]
        own, c, _ = min(tried, key=lambda t: round(t[2] / 1e18, 9))
        rank = np.empty(5, int)
        rank[np.lexsort((c[:, 0], c[:, 1]))] = np.arange(5)
        assert dict(zip(got[got.i == i].algo_id, got[got.i == i].cluster)) == dict(zip(ids, rank[own]))


def _log(spark, n=37, k=3, seed=2):
    rng = np.random.default_rng(seed)
    w = rng.dirichlet(np.ones(k + 1), n)
    rets, cost = rng.normal(0.004, 0.04, (n, k)), rng.random(n) * 0.002
    ret = (w[:, :k] * rets).sum(axis=1) * 2 - cost
    rows = [("a", t, 100.0, float(ret[i]), 0.0, 2.0, float(cost[i] / 0.0005), float(cost[i]), w[i].tolist(), float(w[i, k]), rets[i].tolist()) for i, t in enumerate(_days(n))]
    schema = "fold string, ts timestamp, equity double, ret double, benchmark_return double, leverage double, turnover double, cost double, weights array<double>, cash_weight double, rets array<double>"
    return spark.createDataFrame(rows, schema), w[:, :k], rets, cost, ret


def test_permutation_test_equals_a_loop(spark):
    log, w, rets, cost, ret = _log(spark)
    got = validation.permutation_test(log, EngineConfig(), times=30, block=4).first()

    def ratio(r):
        return round(r.mean() / r.std(ddof=1), 9)

    more = 0
    for draw in range(1, 31):
        order = sorted(range(len(ret)), key=lambda p: (hashlib.md5(f"42:a:{draw}:{p // 4}".encode()).hexdigest(), p))
        more += ratio((w * rets[order]).sum(axis=1) * 2 - cost) >= ratio(ret)
    assert (got.steps, round(got.ratio, 8), got.at_least, got.p_value) == (37, round(ratio(ret), 8), more, (more + 1) / 31)


@pytest.mark.parametrize("wait", [0, 3, None])
def test_stop_and_take_equal_a_loop(spark, wait):
    log, _, _, cost, ret = _log(spark, seed=7)
    cfg = EngineConfig(stop_loss=-0.06, take_profit=0.07, wait=wait)
    rows = log.toPandas()
    got = risk.guarded(log, cfg).orderBy("ts").toPandas()
    value, left, back, worth, why_seen = 1.0, 0, -1, 100.0, set()
    for i in range(len(ret)):
        swap = 4 * (1 - rows.cash_weight[i])
        if left:
            left, paid, r, why = left - 1, 0.0, 0.0, None
        else:
            value *= 1 + ret[i]
            why = "stop" if value - 1 <= -0.06 else "take" if value - 1 >= 0.07 else None
            paid = (swap if i == back else rows.turnover[i]) + (swap if why else 0.0)
            r = ret[i] + cost[i] - paid * 0.0005
            if why:
                value, left, back = 1.0, 10**9 if wait is None else wait, i + 1 + (10**9 if wait is None else wait)
        worth *= 1 + r
        why_seen.add(why)
        assert got.ret[i] == pytest.approx(r, abs=1e-12) and got.equity[i] == pytest.approx(worth) and got.turnover[i] == pytest.approx(paid)
        assert (got.closed[i] or None) == why
    assert why_seen >= {None, "stop" if wait is None else "take"} or wait is None


def test_spans_are_sets_of_days(spark):
    d = lambda m, n: date(2020, m, n)
    spans = spark.createDataFrame([("f", "train", d(1, 1), d(1, 5)), ("f", "train", d(1, 4), d(1, 9)), ("f", "train", d(1, 10), d(1, 12)), ("f", "train", d(2, 1), d(2, 2)), ("f", "test", d(3, 9), d(3, 1))], "fold string, split string, a date, b date")
    merged = sorted((r.split, r.part, r.a, r.b) for r in validation.merged_spans(spans).collect())
    assert merged == [("train", 0, d(1, 1), d(1, 12)), ("train", 1, d(2, 1), d(2, 2))]
    rows = spark.createDataFrame([(datetime(2020, 1, 4, 23), 1), (datetime(2020, 1, 31), 2), (datetime(2020, 2, 2, 5), 3)], "ts timestamp, v int")
    assert sorted((r.v, r.part) for r in validation.in_spans(rows, spans).collect()) == [(1, 0), (3, 1)]


def test_leave_one_year_out(spark):
    rows = spark.createDataFrame([(datetime(y, 5, 1),) for y in (2018, 2019, 2021)], "ts timestamp")
    got = validation.leave_one_year_out(rows).collect()
    assert len(got) == 9 and sorted(r.a.year for r in got if r.split == "test") == [2018, 2019, 2021]
    assert sorted(r.a.year for r in got if r.fold == "without 2019" and r.split == "train") == [2018, 2021]


def test_buy_and_hold_equals_a_loop(spark):
    rng = np.random.default_rng(6)
    rets = rng.normal(0, 0.03, (20, 4))
    rows = spark.createDataFrame([("a", t, rets[i].tolist(), 0.0) for i, t in enumerate(_days(20))], "fold string, ts timestamp, rets array<double>, bench_ret double")
    got = validation.buy_and_hold(rows, EngineConfig(obs_window=5)).orderBy("ts").toPandas()
    parts, worth = np.full(4, 25.0), 100.0
    for n, i in enumerate(range(5, 19)):
        assert np.allclose(got.weights[n][:4], parts / parts.sum()) and got.weights[n][4] == 0
        r = (parts * (1 + rets[i])).sum() / parts.sum() - 1 - (0.001 if n == 0 else 0.0)
        parts, worth = parts * (1 + rets[i]), worth * (1 + r)
        assert got.ret[n] == pytest.approx(r) and got.equity[n] == pytest.approx(worth)
    assert len(got) == 14


def test_calendar_of_allocations_equals_each_date(spark):
    t = _days(6)
    labels = spark.createDataFrame([(t[1], a, a % 2) for a in range(5)] + [(t[3], a, 0) for a in range(4)], "ts timestamp, algo_id long, cluster int")
    mask = spark.createDataFrame([(t[i], a, (a + i) % 3 > 0) for i in (1, 2, 4) for a in range(5)], "ts timestamp, algo_id long, active boolean")
    weights = spark.createDataFrame([(x, c, w) for x in t for c, w in ((0, 0.5), (1, 0.3), (2, 0.1), (0 + 3, 0.0))], "ts timestamp, cluster int, weight double")
    got = sorted((r.ts, r.algo_id, round(r.amount, 9)) for r in allocate.distribute_calendar(100.0, weights, labels, mask).collect())
    want = [(x, r.algo_id, round(r.amount, 9)) for x in t for r in allocate.distribute(100.0, weights.where(F.col("ts") == F.lit(x)).drop("ts"), labels, mask, str(x)).collect()]
    assert got == sorted(want) and {x for x, *_ in got} == set(t[1:])


def test_observations_across_blocks(spark):
    n, k = 60, 2
    feats = spark.createDataFrame([(t, i, c, float(i), float(c), 0.5) for i, t in enumerate(_days(n)) for c in range(k)], "ts timestamp, i int, cluster int, ret double, vol double, mom double")
    ind = spark.createDataFrame([(t, i, 1.0, 2.0, float(-i)) for i, t in enumerate(_days(n))], "ts timestamp, i int, syn_mkt_ret double, syn_vix double, syn_breadth double")
    got = {r.i: r.obs for r in cluster.observations(feats, ind, 7, block=10).collect()}
    assert got == {i: [[float(j), 0.0, 0.5, float(j), 1.0, 0.5, 1.0, 2.0, float(-j)] for j in range(i - 7, i)] for i in range(7, n)}


def test_price_files_are_split_and_packed(spark, tmp_path):
    lines = [f"2024-01-01 {h:02d}:{m:02d}:00,{h * 60 + m}" for h in range(24) for m in range(60)]
    (tmp_path / "long.csv").write_text("datetime,close\n" + "\n".join([*lines, *(x.split(",")[0] + ",-1" for x in lines)]) + "\n")
    for i in range(40):
        (tmp_path / f"s{i}.csv").write_text(f"close,extra,datetime\n{i}.5,x,2024-01-01\n")
    (tmp_path / "bad.csv").write_text("datetime,close\n2024-01-01,1\n2024-01-02,what\n2024-01-03,3\n")
    (tmp_path / "none.csv").write_text("time,price\n2024-01-01,1\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "quiet.csv").write_text("datetime,close\n")
    kept = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        adapters.pack_small_files(spark, "1k", "20k")
        rows = adapters.read_prices(spark, str(tmp_path))
        parts = adapters.scan_prices(spark, str(tmp_path)).where("algo_id = 'long'").select("seq.start").distinct().count()
        first = panel.dedupe_first(rows, ["algo_id", "ts"], "seq").toPandas()
        assert parts > 2
        own = first[first.algo_id == "long"]
        assert len(own) == 1440 and (own.close == own.ts.dt.hour * 60 + own.ts.dt.minute).all()
        assert set(first.algo_id) == {"long", *(f"s{i}" for i in range(40))}
        assert dict(zip(first.algo_id, first.close))["s7"] == 7.5
        some = adapters.read_prices(spark, str(tmp_path), "row").where("algo_id = 'bad'").orderBy("ts").collect()
        assert [r.close for r in some] == [1.0, 3.0]
        found = {r.algo_id: r._corrupt for r in adapters.scan_prices(spark, str(tmp_path)).where("_corrupt is not null").collect()}
        assert found == {"bad": "2024-01-02,what", "none": "time,price"}
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    with pytest.raises(ValueError, match="neither"):
        adapters.read_prices(spark, str(tmp_path), "neither")


def test_the_benchmark_runs_on_through_days_without_a_step(spark):
    from panelflow.operators import backtest

    log = spark.createDataFrame([("a", t, 0.1) for t in (_days(9)[1], _days(9)[4])], "fold string, ts timestamp, ret double")
    bench = spark.createDataFrame([(t.date(), 0.5) for t in _days(9)], "date date, bench_ret double")
    got = backtest.global_curves(log, bench).orderBy("date").collect()
    assert [r.bench for r in got] == pytest.approx([150.0, 225.0, 337.5, 506.25]) and [r.strategy and round(r.strategy, 6) for r in got] == [110.0, None, None, 121.0]


def test_trades_with_equal_days_and_gaps(spark):
    rows = spark.createDataFrame([(datetime(2020, 1, 1, 9), 100.0), (datetime(2020, 1, 1, 17), 110.0), (datetime(2020, 1, 4), 121.0)], "ts timestamp, equity double")
    got = [round(r.bench_ret, 9) for r in benchmark.trade_returns(rows).orderBy("date").collect()]
    assert got == [0.0, 0.0, 0.0, 0.1]
