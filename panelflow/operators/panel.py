"""Panels in long form: calendar, padded returns, activity, life spans, cross-sectional indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelflow.operators.scan import running


def dedupe_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def calendar(panel: DataFrame) -> DataFrame:
    """(ts, i) of all distinct times, taken before null closes go; i counts from 0."""
    return running(panel.select("ts").distinct(), "ts", ["ts"], n=("count", None)).select("ts", (F.col("n") - 1).cast("int").alias("i"))


def changes(panel: DataFrame) -> DataFrame:
    """Rows of known close with `ret`, the change from the series' last known price, 0 at first and after a price of 0; and `active`."""
    w = Window.partitionBy("algo_id").orderBy("ts")
    rows = panel.where("close is not null").withColumn("prev", F.lag("close").over(w))
    ret = F.when(F.col("prev").isNull() | (F.col("prev") == 0), 0.0).otherwise(F.try_divide("close", "prev") - 1)
    return rows.withColumn("ret", ret).withColumn("active", F.col("close") != 0).drop("prev")


def returns(panel: DataFrame, times: DataFrame) -> DataFrame:
    """(ts, i, algo_id, close, ret, active): change from the series' last known price; 0 at first and after a price of 0.

    A null close is a gap: it has no row, which stands for a return of 0 and not active.
    """
    return changes(panel).join(times, "ts").select("ts", "i", "algo_id", "close", "ret", "active")


def dense(rets: DataFrame, times: DataFrame, window: int) -> DataFrame:
    """(i, algo_id, ret, active) for each series' life, padded by a window on both sides; gaps are 0 and not active."""
    last = times.agg(F.max("i").alias("last"))
    life = rets.groupBy("algo_id").agg(F.min("i").alias("a"), F.max("i").alias("b")).crossJoin(F.broadcast(last))
    days = life.select("algo_id", F.explode(F.sequence(F.greatest(F.lit(0), F.col("a") - window), F.least(F.col("b") + window, "last"))).alias("i"))
    full = days.join(rets.select("i", "algo_id", "ret", "active"), ["algo_id", "i"], "left")
    return full.select("i", "algo_id", F.coalesce("ret", F.lit(0.0)).alias("ret"), F.coalesce("active", F.lit(False)).alias("active"))


def moments(rets: DataFrame, times: DataFrame, by: str = "i") -> DataFrame:
    """times with k, a, v, up: each date's number of returns, their mean and variance, and how many are above 0; 0 without returns."""
    parts = rets.groupBy(by).agg(F.count("ret").alias("k"), F.avg("ret").alias("a"), F.var_pop("ret").alias("v"), F.count_if(F.col("ret") > 0).alias("up"))
    return times.join(parts, by, "left").fillna({"k": 0, "a": 0.0, "v": 0.0, "up": 0})


def indicators(parts: DataFrame, n: DataFrame) -> DataFrame:
    """Indicators from dates' moments (ts, i, k, a, v, up) and the number of series n, one row."""
    day = parts.crossJoin(F.broadcast(n))
    # the zeros' mean is 0, so the gap between both means is a, and squares gain a * a * k * (n - k) / n
    squares = F.col("k") * F.col("v") + F.col("a") * F.col("a") * F.col("k") * F.try_divide(F.col("n") - F.col("k"), F.col("n"))
    vix = F.sqrt(F.try_divide(squares, F.col("n") - 1))
    return day.select("ts", "i", (F.col("k") * F.col("a") / F.col("n")).alias("syn_mkt_ret"), vix.alias("syn_vix"), (F.col("up") / F.col("n")).alias("syn_breadth"))


def macro(rets: DataFrame, times: DataFrame) -> DataFrame:
    """(ts, i, syn_mkt_ret, syn_vix, syn_breadth) over all N series ever seen; a series without a row counts as a return of 0.

    A date's rows come down to count, mean and squares about the mean, which
    partial aggregates merge; the N - count zeros of absent series are one more
    such triple, merged by the same rule in closed form.
    """
    n = rets.agg(F.countDistinct("algo_id").cast("double").alias("n"))
    return indicators(moments(rets, times), n)
