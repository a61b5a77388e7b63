"""Queries by name, over panels made of the fixture tables, and their DuckDB twins in `oracles`."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.config import EngineConfig
from panelflow.operators import allocate, backtest, benchmark, cluster, panel, risk, validation
from panelflow.plans import learner, policy
from panelflow.plans.oracles import ORACLES
from panelflow.sources import adapters, writers
from panelflow.streaming import daily

#: Clusters of the queries that take a series' id modulo K for its cluster, and of those that find clusters.
K, FOUND, ROUNDS = 4, 4, 4
CFG = EngineConfig()


def _r(c, n: int = 6):
    return F.round(c, n)


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.supplier_weeks(spark, sf_dir)


def _returns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _panel(spark, sf_dir)
    times = panel.calendar(rows)
    return panel.returns(rows, times), times


def _written_returns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """_returns, written: what several parts of a plan read, so that lineitem is read once."""
    rows = writers.save(_panel(spark, sf_dir), "panel")
    times = writers.save(panel.calendar(rows), "times")
    return writers.save(panel.returns(rows, times), "returns"), times


def _series(rets: DataFrame, times: DataFrame) -> DataFrame:
    """Cluster series (ts, i, cluster, ret, vol, mom) of clusters by id modulo K, every series a member at every time."""
    size = rets.groupBy(F.pmod("algo_id", F.lit(K)).cast("int").alias("cluster")).agg(F.countDistinct("algo_id").alias("n"))
    sums = rets.groupBy("i", F.pmod("algo_id", F.lit(K)).cast("int").alias("cluster")).agg(F.sum("ret").alias("s"))
    grid = times.crossJoin(F.broadcast(size))
    series = grid.join(sums, ["i", "cluster"], "left").select("ts", "i", "cluster", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("ret"))
    return cluster.cluster_features(series, CFG.feature_window)


def _frame(series: DataFrame, bench: DataFrame, fold: str = "all") -> DataFrame:
    """(fold, ts, rets, moms, bench_ret): a row a time, cluster values as arrays."""
    rows = series.groupBy("ts").agg(F.array_sort(F.collect_list(F.struct("cluster", "ret", "mom"))).alias("c")).withColumn("date", F.to_date("ts"))
    return rows.join(bench, "date").select(F.lit(fold).alias("fold"), "ts", F.transform("c", lambda x: x["ret"]).alias("rets"), F.transform("c", lambda x: x["mom"]).alias("moms"), "bench_ret")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rets, times = _returns(spark, sf_dir)
    bench = benchmark.asof_returns(times, adapters.order_months(spark, sf_dir), "bfill")
    return backtest.simulate(policy.momentum(_frame(_series(rets, times), bench)), CFG)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the momentum policy over panel B."""
    rows = adapters.brand_months(spark, sf_dir)
    times = panel.calendar(rows)
    rets = panel.returns(rows, times)
    bench = benchmark.asof_returns(times, adapters.order_months(spark, sf_dir), "bfill")
    return backtest.kpis(backtest.simulate(policy.momentum(_frame(_series(rets, times), bench)), replace(CFG, obs_window=3)), CFG)


def q01_panel(spark, sf_dir):
    return _panel(spark, sf_dir).select(F.to_date("ts").alias("d"), "algo_id", _r("close", 4).alias("close"))


def q02_dedupe_first(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "events").withColumn("date", F.to_date("ts"))
    return panel.dedupe_first(e, ["user_id", "date"], "event_id").select("user_id", "date", "event_id")


def q03_calendar(spark, sf_dir):
    return panel.calendar(_panel(spark, sf_dir)).select(F.to_date("ts").alias("d"), "i")


def q04_returns_padded(spark, sf_dir):
    return _returns(spark, sf_dir)[0].select("i", "algo_id", _r("ret").alias("ret"))


def q05_active_mask(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("ts"), F.col("user_id").alias("algo_id")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))
    return panel.returns(e, panel.calendar(e)).select("i", "algo_id", F.col("active").cast("int").alias("active"))


def q06_dense_lifespan(spark, sf_dir):
    rets, times = _returns(spark, sf_dir)
    return panel.dense(rets, times, CFG.window).groupBy("algo_id").agg(F.count("*").alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.sum(F.col("active").cast("int")).alias("live"))


def q07_macro(spark, sf_dir):
    m = panel.macro(*_returns(spark, sf_dir))
    return m.select("i", _r("syn_mkt_ret", 8).alias("syn_mkt_ret"), _r("syn_vix", 8).alias("syn_vix"), _r("syn_breadth").alias("syn_breadth"))


def _features(spark, sf_dir):
    rets, times = _returns(spark, sf_dir)
    return cluster.window_features(panel.dense(rets, times, CFG.window), CFG.window, CFG.active_share, FOUND)


def q08_eligibility(spark, sf_dir):
    return _features(spark, sf_dir).groupBy("i").agg(F.count("*").alias("eligible"), F.sum("algo_id").alias("ids"))


def q09_window_features(spark, sf_dir):
    return _features(spark, sf_dir).select("i", "algo_id", _r("ret_total").alias("ret_total"), _r("volatility").alias("volatility"))


def q10_scaled_features(spark, sf_dir):
    return cluster.scaled(_features(spark, sf_dir)).select("i", "algo_id", _r("x", 5).alias("x"), _r("y", 5).alias("y"))


def _labels(rets, times):
    found = cluster.window_features(panel.dense(rets, times, CFG.window), CFG.window, CFG.active_share, FOUND)
    return cluster.kmeans(cluster.scaled(found), FOUND, ROUNDS)


def q11_kmeans_labels(spark, sf_dir):
    return _labels(*_written_returns(spark, sf_dir))


def _found(spark, sf_dir):
    rets, times = _written_returns(spark, sf_dir)
    return cluster.cluster_returns(_labels(rets, times), rets, times, FOUND)


def q12_cluster_returns(spark, sf_dir):
    return _found(spark, sf_dir).select("i", "cluster", _r("ret").alias("ret"))


def q13_cluster_vol_mom(spark, sf_dir):
    return cluster.cluster_features(_found(spark, sf_dir)).select("i", "cluster", _r("vol").alias("vol"), _r("mom").alias("mom"))


def q14_cluster_wide(spark, sf_dir):
    w = cluster.wide(_series(*_returns(spark, sf_dir)), K)
    return w.select("i", *(_r(c).alias(c) for c in w.columns if c.startswith("C")))


def q15_monthly_equity(spark, sf_dir):
    return benchmark.monthly_equity(adapters.order_months(spark, sf_dir)).select("month_end", _r("equity").alias("equity"))


def _asof(spark, sf_dir, gap):
    times = panel.calendar(_panel(spark, sf_dir))
    # the benchmark starts a year late here, so that the gap rules differ
    late = adapters.order_months(spark, sf_dir).where("month >= '1996-01'")
    return benchmark.asof_returns(times, late, gap).select("date", _r("bench_ret", 8).alias("bench_ret"))


def q16_benchmark_asof_bfill(spark, sf_dir):
    return _asof(spark, sf_dir, "bfill")


def q17_benchmark_asof_one(spark, sf_dir):
    return _asof(spark, sf_dir, "one")


def q18_resample_daily_ffill(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return benchmark.resample_daily(e, ["user_id"], "value").select("user_id", "date", _r("value", 4).alias("value"))


def q19_align_inner_dates(spark, sf_dir):
    rets, times = _returns(spark, sf_dir)
    bench = benchmark.asof_returns(times, adapters.order_months(spark, sf_dir), "bfill")
    rows = benchmark.align(_series(rets, times), panel.macro(rets, times), bench, "1996-01-01", "1998-12-31")
    return rows.select("date", "cluster", _r("ret").alias("ret"), _r("syn_mkt_ret", 8).alias("syn_mkt_ret"), _r("bench_ret", 8).alias("bench_ret"))


def q20_backtest_log(spark, sf_dir):
    return _log(spark, sf_dir).select(F.to_date("ts").alias("d"), _r("equity", 4).alias("equity"), _r("ret", 8).alias("ret"), _r("turnover").alias("turnover"), _r("cost", 8).alias("cost"), _r("cash_weight").alias("cash_weight"))


def q21_drawdown_curve(spark, sf_dir):
    return backtest.drawdown(_log(spark, sf_dir)).select(F.to_date("ts").alias("d"), _r("rebased", 4).alias("rebased"), _r("drawdown").alias("drawdown"))


def q22_kpis(spark, sf_dir):
    k = backtest.kpis(_log(spark, sf_dir), CFG)
    return k.select("periods", *(_r(c, 5).alias(c) for c in ("total_return", "cagr", "vol", "max_drawdown", "sharpe", "sortino", "calmar", "win_rate")))


def q23_alpha_beta(spark, sf_dir):
    return backtest.kpis(_log(spark, sf_dir), CFG).select(_r("alpha", 5).alias("alpha"), _r("beta", 5).alias("beta"))


def q24_cluster_profile(spark, sf_dir):
    s = _series(*_returns(spark, sf_dir))
    return s.groupBy("cluster").agg(_r(F.avg("ret") * 252).alias("ret"), _r(F.stddev_samp("ret") * F.sqrt(F.lit(252.0)), 5).alias("vol"))


def q25_allocation_rank(spark, sf_dir):
    return backtest.allocation_rank(_log(spark, sf_dir)).select("cluster", _r("mean_weight").alias("mean_weight"))


def q26_return_histogram(spark, sf_dir):
    return backtest.histogram(_log(spark, sf_dir)).select("bin", "n", _r("density", 3).alias("density"))


def q27_report_lines(spark, sf_dir):
    return backtest.report_lines(backtest.kpis(_log(spark, sf_dir), CFG)).select("n", "line")


FOLDS = [(f"F{y}", "1995-01-01", f"{y - 1}-12-31", f"{y}-01-01", f"{y}-12-31") for y in (1997, 1998, 1999)]


def _folds(spark):
    folds = spark.createDataFrame(FOLDS, "fold string, tr_start string, tr_end string, te_start string, te_end string")
    return folds.select("fold", *(F.col(c).cast("date").alias(c) for c in folds.columns[1:]))


def _folded(spark, sf_dir):
    """Each fold's log; features are those of the whole series, as folds slice ready features."""
    rets, times = _returns(spark, sf_dir)
    bench = benchmark.asof_returns(times, adapters.order_months(spark, sf_dir), "bfill")
    acted = policy.momentum(_frame(_series(rets, times), bench)).drop("fold")
    return backtest.simulate(backtest.walk_forward(acted, _folds(spark)), replace(CFG, obs_window=12), ("fold", "split"))


def q28_walkforward_folds(spark, sf_dir):
    return _folded(spark, sf_dir).groupBy("fold", "split").agg(F.count("*").alias("steps"), F.min(F.to_date("ts")).alias("first"), F.max(F.to_date("ts")).alias("last"), _r(F.max_by("equity", "ts"), 3).alias("equity"))


def q29_stitched_curve(spark, sf_dir):
    return backtest.stitched(_folded(spark, sf_dir).where("split = 'test'")).select(F.to_date("ts").alias("d"), _r("curve", 4).alias("curve"))


def q30_fold_summary(spark, sf_dir):
    p = backtest.fold_summary(backtest.kpis(_folded(spark, sf_dir), CFG, ("fold", "split")))
    return p.select(F.col("Fold").alias("fold"), *(_r(c, 5 if c.endswith("Ret") else 4).alias(c.lower()) for c in p.columns[1:]))


def q31_allocate_capital(spark, sf_dir):
    rets, times = _returns(spark, sf_dir)
    labels = rets.where("i % 10 = 0").select("ts", "algo_id", F.pmod("algo_id", F.lit(K)).cast("int").alias("cluster"))
    weights = spark.createDataFrame([(0, 0.4), (1, 0.3), (2, 0.0), (3, 0.2), (9, 0.1)], "cluster int, weight double")
    at = times.where("i = 105").select(F.col("ts").cast("string")).first()[0]
    return allocate.distribute(1e6, weights, labels, rets.select("ts", "algo_id", "active"), at).select("algo_id", _r("amount", 4).alias("amount"))


def q32_baseline_fit(spark, sf_dir):
    rets, times = _returns(spark, sf_dir)
    fit = allocate.baseline_fit(_series(rets, times), panel.macro(rets, times))
    return spark.createDataFrame([(c, *map(float, v)) for c, v in sorted(fit.items())], "cluster int, intercept double, b_ret double, b_vix double, b_breadth double").select("cluster", *(_r(c, 4).alias(c) for c in ("intercept", "b_ret", "b_vix", "b_breadth")))


def q33_baseline_weights(spark, sf_dir):
    s = _series(*_returns(spark, sf_dir)).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("cluster", "mom"))).alias("c"))
    w = s.select("i", allocate.baseline_weights(F.transform("c", lambda x: x["mom"])).alias("w"))
    return w.select("i", F.posexplode("w").alias("slot", "weight")).select("i", "slot", _r("weight").alias("weight"))


def q34_observation_window(spark, sf_dir):
    rets, times = _returns(spark, sf_dir)
    o = cluster.observations(_series(rets, times), panel.macro(rets, times), CFG.obs_window)
    return o.select("i", F.size("obs").alias("n"), F.size(F.get("obs", F.lit(0))).alias("width"), _r(F.get(F.element_at("obs", -1), F.lit(0))).alias("last_ret"), _r(F.get(F.element_at("obs", 1), F.lit(0))).alias("first_ret"))


def q35_reward(spark, sf_dir):
    return _log(spark, sf_dir).select(F.to_date("ts").alias("d"), _r("reward").alias("reward"))


def _observed(spark, sf_dir):
    """Observations, and the simulator's rows."""
    rets, times = _returns(spark, sf_dir)
    series = _series(rets, times)
    bench = benchmark.asof_returns(times, adapters.order_months(spark, sf_dir), "bfill")
    return cluster.observations(series, panel.macro(rets, times), CFG.obs_window), _frame(series, bench)


def q36_policy_rollout(spark, sf_dir):
    """The learned policy's log: trained on the first half of the calendar in a task, its weights written and read back, rolled out over all."""
    obs, frame = _observed(spark, sf_dir)
    half = obs.agg(F.max("i").alias("last")).select((F.col("last") / 2).alias("half"))
    rows = obs.crossJoin(F.broadcast(half)).where(F.col("i") < F.col("half")).join(frame, "ts")
    path = writers.shared_folder(spark, "policy")
    learner.save(learner.train_folds(rows, CFG), path)
    net = learner.load(spark, path, "all")
    log = backtest.simulate(frame.join(policy.roll_out(net, obs), "ts"), replace(CFG, obs_window=0))
    return log.select(F.to_date("ts").alias("d"), _r("equity", 4).alias("equity"), _r("ret", 8).alias("ret"))


def q37_global_curves(spark, sf_dir):
    """Strategy on the stitched dates and benchmark on all dates from the first step to the last, each from 100: plot data of the global chart."""
    log = _folded(spark, sf_dir).where("split = 'test'")
    bench = benchmark.asof_returns(_returns(spark, sf_dir)[1], adapters.order_months(spark, sf_dir), "bfill")
    c = backtest.global_curves(log, bench)
    return c.select(F.col("date").alias("d"), _r("strategy", 4).alias("strategy"), _r("bench", 4).alias("bench"))


def _full_labels(rets, times):
    found = cluster.window_features(panel.dense(rets, times, CFG.window), CFG.window, CFG.active_share, CFG.clusters, CFG.rebalance)
    return cluster.kmeans(cluster.scaled(found), CFG.clusters, starts=CFG.starts)


def _full(rets, times):
    """Series (ts, i, cluster, ret, vol, mom) of clusters found at full size: CFG.clusters, each date until it converges."""
    return cluster.cluster_features(cluster.cluster_returns(_full_labels(rets, times), rets, times, CFG.clusters, CFG.rebalance), CFG.feature_window)


def q38_full_kmeans_labels(spark, sf_dir):
    return _full_labels(*_written_returns(spark, sf_dir))


def q39_full_cluster_wide(spark, sf_dir):
    w = cluster.wide(_full(*_written_returns(spark, sf_dir)), CFG.clusters)
    return w.select("i", *(_r(c).alias(c) for c in w.columns if c.startswith("C")))


def q40_full_backtest_log(spark, sf_dir):
    """The momentum policy's log over found clusters."""
    rets, times = _written_returns(spark, sf_dir)
    bench = benchmark.asof_returns(times, adapters.order_months(spark, sf_dir), "bfill")
    log = backtest.simulate(policy.momentum(_frame(_full(rets, times), bench)), CFG)
    return log.select(F.to_date("ts").alias("d"), _r("equity", 4).alias("equity"), _r("ret", 8).alias("ret"), _r("turnover").alias("turnover"), _r("cost", 8).alias("cost"), _r("cash_weight").alias("cash_weight"))


def q41_universe_written(spark, sf_dir):
    """Returns and activity written by year and read back between two dates."""
    folder = writers.shared_folder(spark, "universe")
    writers.write_universe(_returns(spark, sf_dir)[0], folder)
    rows = writers.read_table(spark, folder, "universe", "1996-03-01", "1997-06-30")
    return rows.select("i", "algo_id", _r("ret").alias("ret"), F.col("active").cast("int").alias("active"), F.col("year").cast("int").alias("year"))


def q42_macro_written(spark, sf_dir):
    folder = writers.shared_folder(spark, "macro")
    writers.write_table(panel.macro(*_returns(spark, sf_dir)), folder, "macro")
    m = writers.read_table(spark, folder, "macro")
    return m.select("i", _r("syn_mkt_ret", 8).alias("syn_mkt_ret"), _r("syn_vix", 8).alias("syn_vix"), _r("syn_breadth").alias("syn_breadth"))


def q43_clusters_written(spark, sf_dir):
    folder = writers.shared_folder(spark, "clusters")
    writers.write_table(_series(*_returns(spark, sf_dir)), folder, "clusters")
    w = cluster.wide(writers.read_table(spark, folder, "clusters"), K)
    return w.select("i", *(_r(c).alias(c) for c in w.columns if c.startswith("C")))


def _by_id(rets: DataFrame) -> DataFrame:
    return rets.select("ts", "i", "algo_id", F.pmod("algo_id", F.lit(K)).cast("int").alias("cluster"))


def q44_labels_written(spark, sf_dir):
    folder = writers.shared_folder(spark, "labels")
    writers.write_table(_by_id(_returns(spark, sf_dir)[0]).where("i % 10 = 0"), folder, "labels")
    return writers.read_table(spark, folder, "labels").select("i", "algo_id", "cluster")


def q45_execution_csv(spark, sf_dir):
    path = writers.write_execution(_log(spark, sf_dir), writers.shared_folder(spark, "log"), K, "test")
    log = writers.read_execution(spark, path)
    return log.select(F.to_date("date").alias("d"), _r("equity", 4).alias("equity"), _r("return", 8).alias("return"), _r("benchmark_return", 8).alias("benchmark_return"), "leverage", _r("cost", 8).alias("cost"), _r("cash_weight").alias("cash_weight"), *(_r(f"C{c}_w").alias(f"C{c}_w") for c in range(K)))


def q46_executive_report(spark, sf_dir):
    log = _log(spark, sf_dir)
    return writers.read_lines(spark, writers.write_report(log, backtest.kpis(log, CFG), writers.shared_folder(spark, "report")))


def q47_executive_summary(spark, sf_dir):
    figures = backtest.kpis(_log(spark, sf_dir), CFG)
    return writers.read_lines(spark, writers.write_summary(figures, writers.shared_folder(spark, "summary"), "All - Out-of-Sample"))


def q48_metrics_summary(spark, sf_dir):
    figures = backtest.kpis(_folded(spark, sf_dir), CFG, ("fold", "split"))
    rows = writers.read_fold_summary(spark, writers.write_fold_summary(figures, writers.shared_folder(spark, "folds")))
    return rows.select("Fold", *(_r(c, 4).alias(c) for c in rows.columns[1:]))


def _from_files(spark, sf_dir):
    """The panel written as a CSV a series and read back, ids as strings."""
    folder = f"{writers.shared_folder(spark, 'prices')}/raw"
    writers.write_prices(_panel(spark, sf_dir), folder)
    rows = writers.save(panel.dedupe_first(adapters.read_prices(spark, folder), ["algo_id", "ts"], "seq").drop("seq"), "panel")
    times = writers.save(panel.calendar(rows), "times")
    return writers.save(panel.returns(rows, times), "returns"), times


def q49_prices_from_csv(spark, sf_dir):
    return _from_files(spark, sf_dir)[0].select("i", "algo_id", _r("ret").alias("ret"))


def q50_labels_from_csv(spark, sf_dir):
    return _labels(*_from_files(spark, sf_dir))


def q51_data_audit(spark, sf_dir):
    w = cluster.wide(_series(*_returns(spark, sf_dir)), K)
    return benchmark.audit(w, [c for c in w.columns if c.startswith("C")]).select(_r("mean").alias("mean"))


def q52_return_density(spark, sf_dir):
    d = backtest.density(_log(spark, sf_dir))
    return d.select("point", _r("x", 8).alias("x"), _r("density", 4).alias("density"))


def q53_weight_stack(spark, sf_dir):
    w = backtest.weight_stack(_log(spark, sf_dir))
    return w.select(F.to_date("ts").alias("d"), "cluster", _r("weight").alias("weight"), _r("top").alias("top"))


def q54_benchmark_reindexed(spark, sf_dir):
    """The log's dates with a benchmark that starts after them: 0 before it does."""
    times = _returns(spark, sf_dir)[1]
    late = benchmark.asof_returns(times, adapters.order_months(spark, sf_dir), "bfill").where("date >= '1997-01-01'")
    return benchmark.reindexed(_log(spark, sf_dir).select("ts"), late).select(F.to_date("ts").alias("d"), _r("bench_ret", 8).alias("bench_ret"))


def q55_rebalance_returns(spark, sf_dir):
    """Labels made every fifth row hold for five rows."""
    rets, times = _returns(spark, sf_dir)
    labels = _by_id(rets).where(f"i >= {CFG.window} and (i - {CFG.window}) % 5 = 0").drop("ts")
    return cluster.cluster_returns(labels, rets, times, K, 5).select("i", "cluster", _r("ret").alias("ret"))


def q56_date_mismatches(spark, sf_dir):
    rets, times = _returns(spark, sf_dir)
    bench = benchmark.asof_returns(times, adapters.order_months(spark, sf_dir), "bfill").where("date >= '1996-01-01'")
    return benchmark.mismatches(_series(rets, times), panel.macro(rets, times), bench)


def q57_trades_benchmark(spark, sf_dir):
    """Training's benchmark from trade-level rows."""
    trades = adapters.table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("ts")).agg((F.lit(1e6) + F.max("o_totalprice")).alias("equity"))
    times = _returns(spark, sf_dir)[1]
    return benchmark.benchmark_returns(times, trades=trades, training=True).select("date", _r("bench_ret", 8).alias("bench_ret"))


def q58_zero_benchmark(spark, sf_dir):
    """No benchmark file is there: zeros."""
    monthly, trades = adapters.read_benchmark(spark, f"{sf_dir}/no_monthly.csv", f"{sf_dir}/no_trades.csv")
    return benchmark.benchmark_returns(_returns(spark, sf_dir)[1], monthly, trades)


def q59_network_rollout(spark, sf_dir):
    """A fixed network over the whole observation window."""
    obs, _ = _observed(spark, sf_dir)
    net = policy.Network.patterned(CFG.obs_window * (3 * K + 3), K + 1, 16)
    acted = policy.roll_out(net, obs).join(obs.select("ts", "i"), "ts")
    return acted.select("i", F.posexplode("action").alias("slot", "action")).select("i", "slot", _r("action").alias("action"))


def q60_full_walk_forward(spark, sf_dir):
    """Folds at full size: found clusters, window and rounds of the configuration."""
    rets, times = _written_returns(spark, sf_dir)
    bench = benchmark.asof_returns(times, adapters.order_months(spark, sf_dir), "bfill")
    acted = policy.momentum(_frame(_full(rets, times), bench)).drop("fold")
    figures = backtest.kpis(backtest.simulate(backtest.walk_forward(acted, _folds(spark)), CFG, ("fold", "split")), CFG, ("fold", "split"))
    return backtest.fold_summary(figures).select("Fold", *(_r(c, 4).alias(c) for c in ("Train_Ret", "Test_Ret", "Train_Sharpe", "Test_Sharpe")))


def q61_permutation_test(spark, sf_dir):
    """Each fold's p-value of its weights against returns in shuffled order."""
    p = validation.permutation_test(_folded(spark, sf_dir), CFG, ("fold", "split"))
    return p.select("fold", "split", "steps", _r("ratio").alias("ratio"), F.col("at_least").cast("int").alias("at_least"), _r("p_value").alias("p_value"))


def q62_stop_and_take(spark, sf_dir):
    """The log under stop-loss and take-profit, tight enough for both to close it."""
    log = risk.guarded(_log(spark, sf_dir), replace(CFG, stop_loss=-0.05, take_profit=0.08))
    return log.select(F.to_date("ts").alias("d"), _r("equity", 4).alias("equity"), _r("ret", 8).alias("ret"), _r("turnover").alias("turnover"), "held", "closed")


def _acted(spark, sf_dir):
    """Rows of the simulator without a fold, momentum's action on each."""
    rets, times = _returns(spark, sf_dir)
    bench = benchmark.asof_returns(times, adapters.order_months(spark, sf_dir), "bfill")
    return policy.momentum(_frame(_series(rets, times), bench)).drop("fold")


def q63_leave_one_year_out(spark, sf_dir):
    """Momentum's figures on each year left out and on the others."""
    acted, cfg = _acted(spark, sf_dir), replace(CFG, obs_window=12)
    log = validation.cross_validated(acted, validation.leave_one_year_out(acted), cfg)
    k = backtest.kpis(log, cfg, ("fold", "split"))
    return k.select("fold", "split", "periods", *(_r(c, 5).alias(c) for c in ("total_return", "vol", "max_drawdown", "win_rate")))


def q64_buy_and_hold(spark, sf_dir):
    rets, times = _returns(spark, sf_dir)
    bench = benchmark.asof_returns(times, adapters.order_months(spark, sf_dir), "bfill")
    log = validation.buy_and_hold(_frame(_series(rets, times), bench), CFG)
    return log.select(F.to_date("ts").alias("d"), _r("equity", 4).alias("equity"), _r("ret", 8).alias("ret"), _r("cost", 8).alias("cost"), _r(F.get("weights", F.lit(0))).alias("w0"))


def q65_baseline_cross_validated(spark, sf_dir):
    """The linear baseline from fit to figures: fitted on each fold's training years, its predictions traded in the year left out."""
    rets, times = _returns(spark, sf_dir)
    series = _series(rets, times)
    frame = _frame(series, benchmark.asof_returns(times, adapters.order_months(spark, sf_dir), "bfill")).drop("fold", "moms")
    spans = validation.leave_one_year_out(frame)
    rows = writers.save(validation.in_spans(allocate.baseline_rows(series, panel.macro(rets, times)), spans).select("fold", "split", "ts", "cluster", "ret", "x0", "x1", "x2", "x3"), "baseline")
    fitted = allocate.baseline_coefficients(rows.where("split = 'train'"), ("fold",))
    weights = allocate.baseline_predict(rows.where("split = 'test'"), fitted, ("fold",))
    log = backtest.simulate(frame.join(weights, "ts"), replace(CFG, obs_window=12))
    k = backtest.kpis(log, CFG)
    return k.select("fold", "periods", *(_r(c, 4).alias(c) for c in ("total_return", "vol", "max_drawdown", "win_rate")))


def q66_allocate_calendar(spark, sf_dir):
    """A million dealt out at every step of the log, by its weights and labels made every tenth row."""
    rets, times = _returns(spark, sf_dir)
    bench = benchmark.asof_returns(times, adapters.order_months(spark, sf_dir), "bfill")
    log = backtest.simulate(policy.momentum(_frame(_series(rets, times), bench)), CFG)
    weights = log.select("ts", F.posexplode(F.slice("weights", F.lit(1), F.size("weights") - 1)).alias("cluster", "weight"))
    labels = _by_id(rets).where("i % 10 = 0").select("ts", "algo_id", "cluster")
    paid = allocate.distribute_calendar(1e6, weights, labels, rets.select("ts", "algo_id", "active"))
    return paid.select(F.to_date("ts").alias("d"), "algo_id", _r("amount", 3).alias("amount"))


def q67_loader_modes(spark, sf_dir):
    """What each script's loader makes of the same files: dates, and the benchmark's first and summed return."""
    rets, times = _returns(spark, sf_dir)
    series, macro = writers.save(_series(rets, times), "series"), writers.save(panel.macro(rets, times), "macro")
    monthly = adapters.order_months(spark, sf_dir).where("month >= '1996-01'")
    trades = adapters.table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("ts")).agg((F.lit(1e6) + F.max("o_totalprice")).alias("equity"))
    found = None
    for mode in benchmark.MODES:
        rows = benchmark.load(mode, series, macro, monthly, trades, "1995-06-01", "1998-12-31").where("cluster = 0")
        row = rows.groupBy(F.lit(mode).alias("mode")).agg(F.count("*").alias("dates"), _r(F.min_by("bench_ret", "date"), 8).alias("first"), _r(F.sum("bench_ret")).alias("total"))
        found = row if found is None else found.union(row)
    return found


def q68_macro_by_new_dates(spark, sf_dir):
    """q07 of a panel whose dates arrive in three portions, each appended by a stream that takes what is there."""
    rows, inbox, folder = writers.save(_panel(spark, sf_dir), "panel"), f"{writers.shared_folder(spark, 'inbox')}/in", writers.shared_folder(spark, "daily")
    for since, until in ((1, 1994), (1994, 1997), (1997, 10_000)):
        rows.where(F.year("ts").between(since, until - 1)).select("ts", "algo_id", "close").write.mode("append").parquet(inbox)
        daily.run_available(spark, inbox, folder)
    m = daily.read_macro(spark, folder)
    return m.select("i", _r("syn_mkt_ret", 8).alias("syn_mkt_ret"), _r("syn_vix", 8).alias("syn_vix"), _r("syn_breadth").alias("syn_breadth"))


QUERIES = {name: f for name, f in sorted(globals().items()) if name[:1] == "q" and name[1:3].isdigit()}
