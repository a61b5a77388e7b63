"""Rules of the engine on small panels, and every query against its SQL twin."""

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelflow.config import EngineConfig
from panelflow.operators import allocate, backtest, benchmark, cluster, panel
from panelflow.plans import learner, policy, registry
from panelflow.sources import adapters, writers

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _panel(spark, rows):
    return spark.createDataFrame(rows, "ts string, algo_id long, close double").withColumn("ts", F.to_timestamp("ts"))


def test_gap_is_padded_and_zero_price_restarts(spark):
    p = _panel(spark, [("2024-01-01", 1, 1.0), ("2024-01-02", 1, 2.0), ("2024-01-03", 1, None), ("2024-01-04", 1, 3.0), ("2024-01-01", 2, 3.0), ("2024-01-02", 2, 0.0), ("2024-01-03", 2, 5.0)])
    rows = panel.returns(p, panel.calendar(p)).orderBy("algo_id", "i").collect()
    assert [(r.algo_id, r.i, r.ret, r.active) for r in rows] == [(1, 0, 0.0, True), (1, 1, 1.0, True), (1, 3, 0.5, True), (2, 0, 0.0, True), (2, 1, -1.0, False), (2, 2, 0.0, True)]


@pytest.mark.parametrize("live,eligible", [(48, False), (49, True)])
def test_eligibility_needs_more_than_the_share(spark, live, eligible):
    full = spark.range(61).select(F.col("id").cast("int").alias("i"), F.lit(1).cast("long").alias("algo_id"), F.lit(0.0).alias("ret"), (F.col("id") < live).alias("active"))
    assert (cluster.window_features(full, 60, 0.8, 1).count() == 1) is eligible


@pytest.mark.parametrize("n,steps", [(30, 0), (31, 1), (32, 1), (40, 9)])
def test_steps_of_an_episode(spark, n, steps):
    rows = spark.range(n).select(F.lit("a").alias("fold"), F.timestamp_seconds(F.col("id") * 86400).alias("ts"), F.array(*[F.lit(0.01)] * 10).alias("rets"), F.lit(0.0).alias("bench_ret"), F.array(*[F.lit(0.0)] * 11).alias("action"))
    log = backtest.simulate(rows, EngineConfig()).orderBy("ts").collect()
    assert len(log) == steps
    if log:
        assert log[0].turnover == pytest.approx(4 * 10 / 11)


def test_simulator_equals_a_loop(spark):
    rng = np.random.default_rng(1)
    rets, bench, act = rng.normal(0, 0.02, (50, 3)), rng.normal(0, 0.01, 50), rng.random((50, 4))
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1) + timedelta(days=i), rets[i].tolist(), float(bench[i]), act[i].tolist()) for i in range(50)], "fold string, ts timestamp, rets array<double>, bench_ret double, action array<double>")
    got = backtest.simulate(rows, EngineConfig()).orderBy("ts").toPandas()
    value, prev, want = 100.0, np.array([0, 0, 0, 1.0]), []
    for i in range(30, 49):
        w = np.exp(act[i]) / np.exp(act[i]).sum()
        turn = np.abs((w - prev) * 2).sum()
        r = (w[:3] * 2) @ rets[i] - turn * 0.0005
        value *= 1 + r
        prev = w
        want.append((value, r, np.clip((r - bench[i]) * 10 - (abs(r) * 50 if r < -0.02 else 0) - turn * 0.005, -10, 10)))
    assert np.allclose(got[["equity", "ret", "reward"]], want)


def test_constant_benchmark_has_no_beta(spark):
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1) + timedelta(days=i), 100.0 + i, 0.01, 0.0) for i in range(4)], "fold string, ts timestamp, equity double, ret double, benchmark_return double")
    k = backtest.kpis(rows, EngineConfig()).first()
    assert (k.alpha, k.beta) == (0.0, 0.0)


def test_gap_rules_of_the_benchmark(spark):
    times = _panel(spark, [(f"2020-{m:02d}-{d:02d}", 1, 1.0) for m, d in ((6, 10), (6, 29), (6, 30), (7, 31))]).select("ts")
    monthly = spark.createDataFrame([("2020-06", 0.1), ("2020-07", 0.2)], "month string, monthly_return double")
    got = {g: [round(r.bench_ret, 9) for r in benchmark.asof_returns(times, monthly, g).orderBy("date").collect()] for g in ("bfill", "one")}
    assert got == {"bfill": [0.0, 0.0, 0.0, 0.2], "one": [0.0, 0.0, 0.1, 0.2]}


def test_baseline_weights(spark):
    row = spark.range(1).select(allocate.baseline_weights(F.array(F.lit(-1.0), F.lit(-2.0))).alias("a"), allocate.baseline_weights(F.array(F.lit(1.0), F.lit(3.0))).alias("b"), allocate.baseline_weights(F.array(F.lit(-1.0)), True).alias("c")).first()
    assert (row.a, row.b, row.c) == ([0.0, 0.0, 0.0], [0.25, 0.75, 0.0], [0.0, 1.0])


def test_price_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("datetime,open,close\n2024-01-01,1,2.5\n2024-01-01,1,9\n2024-01-02 10:00:00,1,\n")
    (tmp_path / "b.csv").write_text("datetime,open\n2024-01-01,1\n")
    (tmp_path / "c.csv").write_text("datetime,close\nnot a date,1\n")
    (tmp_path / "d.txt").write_text("datetime,close\n2024-01-01,1\n")
    rows = panel.dedupe_first(adapters.read_prices(spark, str(tmp_path)), ["algo_id", "ts"], "seq").orderBy("ts").collect()
    assert [(r.algo_id, r.close) for r in rows] == [("a", 2.5), ("a", None)]


def _plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype != float:
            df[c] = df[c].astype(str).str.replace(" 00:00:00", "")
    keys = [c for c in df if df[c].dtype != float] or list(df)
    return df.sort_values(keys).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = _plain(registry.QUERIES[name](spark, SF).toPandas()), _plain(con.execute(registry.ORACLES[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=1e-9)


def test_learned_policy_reads_the_whole_window(spark, tmp_path):
    rng = np.random.default_rng(3)
    obs = rng.normal(0, 1, (2, 4, 3))
    obs[1, 1:] = obs[0, 1:]  # the two differ in their oldest row only
    rows = spark.createDataFrame([(datetime(2024, 1, i + 1), o.tolist()) for i, o in enumerate(obs)], "ts timestamp, obs array<array<double>>")
    net = policy.Network(12, 2)
    got = np.array([r.action for r in policy.roll_out(net, rows).orderBy("ts").collect()])
    assert not np.allclose(got[0], got[1]) and np.allclose(got, net(obs.reshape(2, 12)))


def test_learner_improves_and_its_weights_are_kept(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.5, (60, 2, 4))
    rets = 0.02 * np.tanh(3 * x[:, -1, :2])
    rows = [(f, datetime(2024, 1, 1) + timedelta(days=i), x[i].tolist(), rets[i].tolist(), 0.0) for f in ("a", "b") for i in range(60)]
    df = spark.createDataFrame(rows, "fold string, ts timestamp, obs array<array<double>>, rets array<double>, bench_ret double")
    cfg = EngineConfig(train_steps=20_000)
    weights = learner.train_folds(df, cfg)
    learner.save(weights, str(tmp_path / "w"))
    net = learner.load(spark, str(tmp_path / "w"), "a")
    assert [w.shape for w, _ in net.layers] == [(8, 128), (128, 128), (128, 3)]
    flat = x.reshape(60, 8)
    score = lambda n: learner.rewards(n(flat), np.eye(3)[-1:], rets, np.zeros(60), cfg)[0].mean()
    assert score(net) > score(policy.Network(8, 3)) + 0.005
    again = learner.load(spark, str(tmp_path / "w"), "b")
    assert all(np.allclose(p, q) for a, b in zip(net.layers, again.layers) for p, q in zip(a, b))


def test_rewards_equal_the_simulator(spark):
    rng = np.random.default_rng(6)
    rets, bench, act = rng.normal(0, 0.02, (20, 3)), rng.normal(0, 0.01, 20), rng.normal(0.5, 1, (20, 4))
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1) + timedelta(days=i), rets[i].tolist(), float(bench[i]), act[i].tolist()) for i in range(20)], "fold string, ts timestamp, rets array<double>, bench_ret double, action array<double>")
    cfg = EngineConfig(obs_window=0)
    got = [r.reward for r in backtest.simulate(rows, cfg).orderBy("ts").collect()]
    assert np.allclose(got, learner.rewards(act, np.eye(4)[-1:], rets, bench, cfg)[0][:19])


def test_files_to_backtest(spark, tmp_path):
    """Price files with string ids, through panel, clusters and simulator, to the written log and reports and back."""
    rng = np.random.default_rng(4)
    raw = tmp_path / "raw"
    raw.mkdir()
    for a in range(14):
        price = 100 * np.cumprod(1 + rng.normal(0.0005, 0.01 + 0.002 * a, 130))
        days = [datetime(2024, 1, 1) + timedelta(days=i) for i in range(130)]
        (raw / f"algo_{a}.csv").write_text("datetime,close\n" + "".join(f"{d:%Y-%m-%d %H:%M:%S},{p}\n" for d, p in zip(days, price)))
    rows = panel.dedupe_first(adapters.read_prices(spark, str(raw)), ["algo_id", "ts"], "seq").drop("seq")
    times = panel.calendar(rows)
    rets = panel.returns(rows, times)
    cfg = EngineConfig(clusters=3, obs_window=10)
    points = cluster.scaled(cluster.window_features(panel.dense(rets, times, cfg.window), cfg.window, cfg.active_share, cfg.clusters))
    labels = cluster.kmeans(points, cfg.clusters)
    assert dict(labels.dtypes)["algo_id"] == "string" and labels.count() == 14 * 70
    series = cluster.cluster_features(cluster.cluster_returns(labels, rets, times, cfg.clusters))
    out = str(tmp_path / "out")
    for name, table in (("clusters", series), ("macro", panel.macro(rets, times)), ("labels", labels)):
        writers.write_table(table, out, name)
    writers.write_universe(rets, out)
    assert writers.read_table(spark, out, "universe", "2024-02-01", "2024-02-10").count() == 140
    series, macro = writers.read_table(spark, out, "clusters"), writers.read_table(spark, out, "macro")
    monthly, trades = adapters.read_benchmark(spark, str(tmp_path / "none.csv"), None)
    bench = benchmark.benchmark_returns(times, monthly, trades)
    log = backtest.simulate(policy.equal(registry._frame(series, bench)), cfg)
    path = writers.write_execution(log, out, cfg.clusters, "test", 3)
    assert path.endswith("/test_episode_3.csv") and (tmp_path / "out" / "test_episode_3.csv").is_file()
    back = writers.read_execution(spark, path).toPandas()
    assert np.allclose(back["equity"], log.orderBy("ts").toPandas()["equity"]) and list(back.columns[-3:]) == ["C0_w", "C1_w", "C2_w"]
    assert writers.write_execution(log.limit(0), out, 3) is None
    figures = backtest.kpis(log, cfg)
    lines = (tmp_path / "out" / "Test_Executive_Report.txt") if writers.write_report(log, figures, out) else None
    text = lines.read_text().split("\n")
    assert text[0] == "--- PORTFOLIO: EXECUTIVE REPORT (Test) ---" and text[2].startswith("Period: 2024-") and text[4] == f"{'Period':<25} | {f'{len(back)} days':>10}"
    writers.write_summary(figures, out, "F - Out-of-Sample")
    writers.write_summary(figures, out, "G - Out-of-Sample")  # replaces the first
    assert (tmp_path / "out" / "Executive_Summary.txt").read_text().startswith("--- REPORT: G - Out-of-Sample ---\nTotal Return    | ")
    benchmark.require_same_dates(series, macro.join(series.select("ts").distinct(), "ts"), bench.join(series.select(F.to_date("ts").alias("date")).distinct(), "date"))
    with pytest.raises(ValueError, match="clusters lacks"):
        benchmark.require_same_dates(series, macro, bench)


def test_benchmark_modes(spark, tmp_path):
    (tmp_path / "m.csv").write_text("month,start_equity,end_equity,monthly_return\n2024-01,100,110,0.1\n")
    (tmp_path / "t.csv").write_text("dateClose,equity_EOD\n2024-01-01 10:00:00+00:00,100\n2024-01-01 23:30:00.250+02:00,110\n2024-01-03T01:00:00+00:00,121\n")
    times = _panel(spark, [(f"2024-01-{d:02d}", 1, 1.0) for d in (1, 2, 3)] + [("2024-02-01", 1, 1.0)]).select("ts")
    both = adapters.read_benchmark(spark, str(tmp_path / "m.csv"), str(tmp_path / "t.csv"))
    took = lambda **k: [round(r.bench_ret, 6) for r in benchmark.benchmark_returns(times, **k).orderBy("date").collect()]
    assert took(monthly=both[0], trades=both[1], training=True) == [0.0, 0.0, 0.1]
    assert took(monthly=both[0], training=True) == [0.0] * 4  # a monthly file does not train
    assert took(monthly=both[0], gap="one") == [0.0, 0.0, 0.0, 0.1] and took() == [0.0] * 4
    with pytest.raises(ValueError, match="the test"):
        benchmark.require_rows(times.where("ts > '2030-01-01'"), "the test")


def test_infinite_values_become_zero(spark):
    day = datetime(2024, 1, 2)
    c = spark.createDataFrame([(day, 0, float("inf"), float("nan"), None)], "ts timestamp, cluster int, ret double, vol double, mom double")
    m = spark.createDataFrame([(day, 0, float("-inf"), 1.0, 0.5)], "ts timestamp, i int, syn_mkt_ret double, syn_vix double, syn_breadth double")
    b = spark.createDataFrame([(day.date(), 0.25)], "date date, bench_ret double")
    r = benchmark.align(c, m, b).first()
    assert (r.ret, r.vol, r.mom, r.syn_mkt_ret, r.bench_ret) == (0.0, 0.0, 0.0, 0.0, 0.25)


def test_capital_without_the_date_in_the_mask(spark):
    labels = spark.createDataFrame([(datetime(2024, 1, 1), "a", 0), (datetime(2024, 1, 1), "b", 0), (datetime(2024, 1, 1), "c", 1)], "ts timestamp, algo_id string, cluster int")
    mask = spark.createDataFrame([(datetime(2024, 1, 2), "a", True), (datetime(2024, 1, 2), "b", False)], "ts timestamp, algo_id string, active boolean")
    weights = spark.createDataFrame([(0, 0.5), (7, 0.5)], "cluster int, weight double")
    pay = lambda at: {r.algo_id: r.amount for r in allocate.distribute(100.0, weights, labels, mask, at).collect()}
    assert pay("2024-01-02") == {"a": 50.0} and pay("2024-01-03") == {"a": 25.0, "b": 25.0}


def test_full_size_clusters_have_converged(spark):
    rets, times = registry._returns(spark, SF)
    cfg = registry.CFG
    points = cluster.scaled(cluster.window_features(panel.dense(rets, times, cfg.window), cfg.window, cfg.active_share, cfg.clusters))
    rows = points.join(registry.QUERIES["q38_full_kmeans_labels"](spark, SF), ["i", "algo_id"]).toPandas()
    assert len(rows) == points.count() and rows.cluster.max() == 9
    for _, date in rows.groupby("i"):
        p, own = date[["x", "y"]].to_numpy(), date.cluster.to_numpy()
        found = np.unique(own)
        centres = np.array([p[own == j].mean(axis=0) for j in found])
        d = ((p[:, None] - centres) ** 2).sum(axis=2)
        assert (d[np.arange(len(p)), np.searchsorted(found, own)] <= d.min(axis=1) + 1e-9).all()


def test_entry(spark):
    assert registry.entry(spark, "/root/testdata/sf0.001").count() == 1
