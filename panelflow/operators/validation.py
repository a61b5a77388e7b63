"""Is it skill?  Permutation tests, folds of several ranges, leave-one-year-out, and holding without a hand in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelflow.config import EngineConfig
from panelflow.operators import backtest
from panelflow.sources.writers import save


def permutation_test(log: DataFrame, cfg: EngineConfig, keys: tuple[str, ...] = ("fold",), times: int = 200, block: int = 5, seed: int = 42) -> DataFrame:
    """(keys, steps, ratio, at_least, p_value): how often weights earn as much on shuffled returns as on their own.

    Blocks of `block` steps of a fold's cluster returns change places, `times`
    times, in the order of a digest of seed, fold, time and block; weights and
    their costs stay.  ratio is the steps' mean return over its sample deviation
    (0 without deviation), compared at nine digits; the p-value counts the log
    itself as one of the shuffles.  All shuffles are rows of one plan: a fold's
    steps meet by place, nothing is drawn on the driver.
    """
    place = Window.partitionBy(*keys).orderBy("ts")
    steps = log.select(*keys, (F.row_number().over(place) - 1).alias("pos"), "weights", "cost", "leverage", "rets")
    # read twice below: the log's own plan is long
    steps = save(steps, "steps")
    draw = F.md5(F.concat_ws(":", F.lit(seed), *keys, "draw", F.floor(F.col("pos") / block)).cast("binary"))
    moved = steps.select(*keys, "pos", "rets").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(times))))
    by = Window.partitionBy(*keys, "draw").orderBy("rank", "pos")
    # draw 0 leaves everything where it is
    moved = moved.withColumn("rank", F.when(F.col("draw") == 0, F.lit("")).otherwise(draw))
    moved = moved.select(*keys, "draw", (F.row_number().over(by) - 1).alias("pos"), "rets")
    earned = moved.join(steps.drop("rets"), [*keys, "pos"])
    gross = F.aggregate(F.zip_with(F.slice("weights", F.lit(1), F.size("rets")), "rets", lambda w, r: w * r), F.lit(0.0), lambda a, x: a + x) * F.col("leverage")
    ret = earned.select(*keys, "draw", (gross - F.col("cost")).alias("ret"))
    ratios = ret.groupBy(*keys, "draw").agg(F.count("*").alias("steps"), F.round(F.coalesce(F.try_divide(F.avg("ret"), F.stddev_samp("ret")), F.lit(0.0)), 9).alias("ratio"))
    own = F.max(F.when(F.col("draw") == 0, F.col("ratio")))
    every = ratios.groupBy(*keys).agg(F.max("steps").alias("steps"), own.alias("ratio"), F.collect_list("ratio").alias("all"))
    return every.withColumn("at_least", F.size(F.filter("all", lambda x: x >= F.col("ratio"))) - 1).select(*keys, "steps", "ratio", "at_least", ((F.col("at_least") + 1) / (times + 1)).alias("p_value"))


def merged_spans(spans: DataFrame) -> DataFrame:
    """(fold, split, part, a, b) of spans (fold, split, a, b): ranges of a split that overlap or touch become one; parts count from 0."""
    by = Window.partitionBy("fold", "split").orderBy("a", "b")
    reach = F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.where("a <= b").withColumn("new", F.coalesce(F.col("a") > F.date_add(reach, 1), F.lit(True)).cast("int"))
    runs = new.withColumn("part", F.sum("new").over(by) - 1)
    return runs.groupBy("fold", "split", "part").agg(F.min("a").alias("a"), F.max("b").alias("b"))


def in_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows (ts, ...) once for each (fold, split, part) of spans (fold, split, a, b) that holds their date.

    A split is a set of ranges, so a row is in it once however many of its spans
    hold it.  Rows and spans meet by year, not by comparing each with each.
    """
    years = merged_spans(spans).withColumn("_year", F.explode(F.sequence(F.year("a"), F.year("b"))))
    held = rows.withColumn("_year", F.year("ts")).join(years, "_year")
    return held.where(F.to_date("ts").between(F.col("a"), F.col("b"))).drop("_year", "a", "b")


def leave_one_year_out(rows: DataFrame) -> DataFrame:
    """(fold, split, a, b): a fold a year of rows, which tests on it and trains on all the others."""
    years = rows.agg(F.collect_set(F.year("ts")).alias("years"))
    pairs = years.select("years", F.explode("years").alias("out")).select("out", F.explode("years").alias("y"))
    split = F.when(F.col("y") == F.col("out"), "test").otherwise("train")
    return pairs.select(F.concat(F.lit("without "), "out").alias("fold"), split.alias("split"), F.make_date("y", F.lit(1), F.lit(1)).alias("a"), F.make_date("y", F.lit(12), F.lit(31)).alias("b"))


def cross_validated(rows: DataFrame, spans: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The log by (fold, split): each range of a split is an episode of its own, their returns compounded one after another."""
    log = backtest.simulate(in_spans(rows, spans), cfg, ("fold", "split", "part")).drop("part")
    so_far = Window.partitionBy("fold", "split").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("equity", 100 * F.product(1 + F.col("ret")).over(so_far))


def buy_and_hold(rows: DataFrame, cfg: EngineConfig, keys: tuple[str, ...] = ("fold",)) -> DataFrame:
    """The log of a portfolio bought in equal parts at a fold's first step and never touched: weights drift with returns.

    rows are the simulator's (keys, ts, rets, bench_ret); steps are the
    simulator's too.  Nothing is borrowed, and only the purchase costs.
    """
    by = Window.partitionBy(*keys).orderBy("ts")
    n = F.count("*").over(Window.partitionBy(*keys))
    steps = rows.select(*keys, "ts", "rets", "bench_ret", (F.row_number().over(by) - 1).alias("pos"), n.alias("n"))
    steps = steps.where((F.col("pos") >= cfg.obs_window) & (F.col("pos") <= F.greatest(F.lit(cfg.obs_window), F.col("n") - 2)))
    long = steps.select(*keys, "ts", "pos", "bench_ret", F.posexplode("rets").alias("cluster", "r"))
    before = Window.partitionBy(*keys, "cluster").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    worth = long.withColumn("g", F.coalesce(F.product(1 + F.col("r")).over(before), F.lit(1.0)))
    day = worth.groupBy(*keys, "ts", "pos", "bench_ret").agg(F.array_sort(F.collect_list(F.struct("cluster", "g", "r"))).alias("c"))
    total = lambda f: F.aggregate("c", F.lit(0.0), lambda a, x: a + f(x))
    day = day.withColumn("g", total(lambda x: x["g"]))
    bought = F.when(F.row_number().over(by) == 1, 2.0).otherwise(0.0)
    day = day.withColumn("turnover", bought).withColumn("cost", F.col("turnover") * cfg.cost_rate)
    day = day.withColumn("ret", F.try_divide(total(lambda x: x["g"] * x["r"]), F.col("g")) - F.col("cost"))
    day = day.withColumn("weights", F.concat(F.transform("c", lambda x: F.try_divide(x["g"], F.col("g"))), F.array(F.lit(0.0))))
    equity = 100 * F.product(1 + F.col("ret")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return day.select(*keys, "ts", equity.alias("equity"), "ret", F.col("bench_ret").alias("benchmark_return"), F.lit(1.0).alias("leverage"), "turnover", "cost", "weights", F.lit(0.0).alias("cash_weight"))
