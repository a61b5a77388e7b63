"""Benchmark alignment: month-ends, as-of joins with both gap rules, daily resampling, inner alignment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelflow.operators.scan import running


def monthly_equity(monthly: DataFrame) -> DataFrame:
    """(month_end, equity): compounded monthly returns at each month's last day."""
    ends = monthly.select(F.last_day(F.to_date("month", "yyyy-MM")).alias("month_end"), "monthly_return")
    return running(ends, "month_end", ["month_end"], equity=("product", 1 + F.col("monthly_return"))).select("month_end", "equity")


def change(days: DataFrame, value: str) -> DataFrame:
    """(date, bench_ret) of (date, value): the change from the date before, 0 at the first."""
    rows = running(days.select("date", value), "date", ["date"], before=("lag", F.col(value)))
    return rows.select("date", F.coalesce(F.try_divide(value, "before") - 1, F.lit(0.0)).alias("bench_ret"))


def asof_returns(times: DataFrame, monthly: DataFrame, gap: str) -> DataFrame:
    """(date, bench_ret) on the dates of times: the last equity known, and its change.

    Before the first month-end, gap "bfill" takes the first equity (no jump), "one" takes 1.0.
    """
    dates = times.select(F.to_date("ts").alias("date")).distinct()
    # month-ends and dates in one order, a month-end before its own date: one scan, no range join
    known = monthly_equity(monthly).select(F.col("month_end").alias("date"), "equity", F.lit(False).alias("own"))
    both = dates.select("date", F.lit(None).cast("double").alias("equity"), F.lit(True).alias("own")).union(known)
    joined = running(both.withColumnRenamed("equity", "at"), "date", ["date", "own"], equity=("last", F.col("at"))).where("own").select("date", "equity")
    if gap == "bfill":
        first = joined.agg(F.min_by("equity", F.when(F.col("equity").isNotNull(), F.col("date"))).alias("first"))
        joined = joined.crossJoin(F.broadcast(first)).withColumn("equity", F.coalesce("equity", "first"))
    return change(joined.withColumn("equity", F.coalesce("equity", F.lit(1.0))), "equity")


def zeros(times: DataFrame) -> DataFrame:
    """A benchmark that never moves, where no file is there."""
    return times.select(F.to_date("ts").alias("date"), F.lit(0.0).alias("bench_ret")).distinct()


def daily_last(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The last non-null of each value in each day."""
    return rows.groupBy(*keys, F.to_date("ts").alias("date")).agg(*(F.expr(f"max_by({v}, ts) filter (where {v} is not null)").alias(v) for v in values))


def resample_daily(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, date, value) for every day from the first to the last of each key, gaps filled forward."""
    days = daily_last(rows, keys, [value])
    span = days.groupBy(*keys).agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date"))
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return span.join(days, [*keys, "date"], "left").withColumn(value, F.last(value, ignorenulls=True).over(w))


def align(clusters: DataFrame, indicators: DataFrame, bench: DataFrame, start=None, end=None, cleaned: bool = True) -> DataFrame:
    """Rows of clusters whose date is in all three and between start and end, both included where given; infinite values become 0 where cleaned."""
    rows = clusters.withColumn("date", F.to_date("ts")).join(indicators.withColumn("date", F.to_date("ts")).drop("ts", "i"), "date").join(bench, "date")
    if start is not None:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    if not cleaned:
        return rows
    clean = lambda c: F.when(F.isnan(c) | F.col(c).isin(float("inf"), float("-inf")) | F.col(c).isNull(), 0.0).otherwise(F.col(c)).alias(c)
    kinds = dict(rows.dtypes)
    return rows.select(*(clean(c) if kinds[c] == "double" else F.col(c) for c in rows.columns))


def reindexed(rows: DataFrame, bench: DataFrame) -> DataFrame:
    """rows (ts, ...) with bench_ret of their date, 0 on dates the benchmark lacks; no row is lost."""
    return rows.withColumn("date", F.to_date("ts")).join(bench, "date", "left").withColumn("bench_ret", F.coalesce("bench_ret", F.lit(0.0))).drop("date")


def trade_returns(trades: DataFrame) -> DataFrame:
    """(date, bench_ret) of a trade-level benchmark (ts, equity): the day's last equity, gaps filled forward, and its change."""
    days = daily_last(trades, [], ["equity"])
    span = days.agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date"))
    filled = running(span.join(days.withColumnRenamed("equity", "at"), "date", "left"), "date", ["date"], equity=("last", F.col("at")))
    return change(filled, "equity")


def benchmark_returns(times: DataFrame, monthly: DataFrame | None = None, trades: DataFrame | None = None, gap: str = "bfill", training: bool = False) -> DataFrame:
    """(date, bench_ret) from what is there.

    Training takes the trades, or else zeros, whether or not there is a monthly
    file; testing takes the monthly file, or else zeros.
    """
    if training:
        return trade_returns(trades) if trades is not None else zeros(times)
    return asof_returns(times, monthly, gap) if monthly is not None else zeros(times)


def mismatches(clusters: DataFrame, indicators: DataFrame, bench: DataFrame) -> DataFrame:
    """(what, missing): dates that one of the three has and another lacks."""
    days = {"clusters": clusters.select(F.to_date("ts").alias("date")), "indicators": indicators.select(F.to_date("ts").alias("date")), "benchmark": bench.select("date")}
    seen = None
    for name, rows in days.items():
        rows = rows.distinct().select("date", F.lit(name).alias("what"))
        seen = rows if seen is None else seen.union(rows)
    by = seen.groupBy("date").agg(F.collect_set("what").alias("has"))
    lacks = by.select(F.explode(F.array_except(F.array(*(F.lit(n) for n in days)), "has")).alias("what"))
    return lacks.groupBy("what").agg(F.count("*").alias("missing"))


def require_same_dates(clusters: DataFrame, indicators: DataFrame, bench: DataFrame) -> None:
    """Raises where the three do not cover the same dates."""
    found = mismatches(clusters, indicators, bench).collect()
    if found:
        raise ValueError("dates differ: " + ", ".join(f"{r['what']} lacks {r['missing']}" for r in sorted(found)))


def audit(features: DataFrame, columns: list[str]) -> DataFrame:
    """(mean): the mean of the columns' means of a wide table."""
    means = features.agg(*(F.avg(c).alias(c) for c in columns))
    return means.select((sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns)).alias("mean"))


def require_rows(rows: DataFrame, what: str) -> DataFrame:
    if rows.isEmpty():
        raise ValueError(f"{what} has no rows in the range")
    return rows


@dataclass(frozen=True)
class Mode:
    """What a script's loader does: the benchmark it takes, its leading gap, whether infinite values become 0, what an empty range is."""

    trades: bool
    gap: str
    cleaned: bool
    empty: str


#: How training, the test and the walk-forward load.
MODES = {
    "train": Mode(trades=True, gap="bfill", cleaned=True, empty="allowed"),
    "test": Mode(trades=False, gap="bfill", cleaned=False, empty="error"),
    "walk_forward": Mode(trades=False, gap="one", cleaned=False, empty="allowed"),
}


def load(mode: str, clusters: DataFrame, indicators: DataFrame, monthly: DataFrame | None = None, trades: DataFrame | None = None, start=None, end=None) -> DataFrame:
    """The aligned rows as one of MODES loads them, from start to end, both included where given."""
    m = MODES[mode]
    bench = benchmark_returns(clusters.select("ts"), monthly, trades, m.gap, m.trades)
    rows = align(clusters, indicators, bench, start, end, m.cleaned)
    return require_rows(rows, mode) if m.empty == "error" else rows
