"""Capital to single algorithms, and the linear baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.functions.linear import solve
from panelflow.operators.scan import running
from panelflow.sources.writers import save


def distribute(capital: float, weights: DataFrame, labels: DataFrame, mask: DataFrame, at: str) -> DataFrame:
    """(algo_id, amount): each cluster's budget split evenly among its members alive at `at`.

    Labels are the latest on or before `at`; a cluster without members keeps its
    budget unspent; if the mask does not know `at`, nobody is filtered.
    """
    day = F.lit(at).cast("timestamp")
    latest = labels.where(F.col("ts") <= day).agg(F.max("ts").alias("ts"))
    held = labels.join(F.broadcast(latest), "ts").select("algo_id", "cluster")
    today = mask.where(F.col("ts") == day)
    known = today.agg((F.count("*") > 0).alias("known"))
    alive = today.where("active").select("algo_id", F.lit(True).alias("alive")).distinct()
    held = held.crossJoin(F.broadcast(known)).join(alive, "algo_id", "left").where("not known or alive").select("algo_id", "cluster")  # known is one row
    share = held.join(weights.where("weight > 0"), "cluster")
    return share.select("algo_id", (capital * F.col("weight") / F.count("*").over(Window.partitionBy("cluster"))).alias("amount"))


def distribute_calendar(capital: float, weights: DataFrame, labels: DataFrame, mask: DataFrame) -> DataFrame:
    """(ts, algo_id, amount) for every time of weights (ts, cluster, weight), by the rules of `distribute`.

    Each time takes the latest labels (ts, algo_id, cluster) on or before it;
    times before any labels have no row.  Times of both are put in one order and
    the last one with labels is carried on, so no time is compared with all
    others; members are counted before they are joined, so a cluster that holds
    most series is no one's window.
    """
    # read three times below, and a log's plan is long
    wanted = save(weights.where("weight > 0").select("ts", "cluster", "weight"), "weights")
    made = labels.select("ts", F.col("ts").alias("own"), F.lit(False).alias("asks")).distinct()
    both = made.union(wanted.select("ts", F.lit(None).cast("timestamp"), F.lit(True)).distinct())
    # false comes first: labels of a time hold at that time
    asof = running(both, "ts", ["ts", "asks"], labelled=("last", F.col("own"))).where("asks and labelled is not null").select("ts", "labelled")
    held = asof.join(labels.select(F.col("ts").alias("labelled"), "algo_id", "cluster"), "labelled").drop("labelled")
    seen = mask.select("ts").distinct().withColumn("known", F.lit(True))
    alive = mask.where("active").select("ts", "algo_id").withColumn("alive", F.lit(True))
    held = held.join(seen, "ts", "left").join(alive, ["ts", "algo_id"], "left").where("known is null or alive").select("ts", "algo_id", "cluster")
    share = wanted.join(held.groupBy("ts", "cluster").agg(F.count("*").alias("members")), ["ts", "cluster"])
    return held.join(share, ["ts", "cluster"]).select("ts", "algo_id", (capital * F.col("weight") / F.col("members")).alias("amount"))


#: The indicators a baseline reads, an intercept before them.
INDICATORS = ("syn_mkt_ret", "syn_vix", "syn_breadth")


def baseline_rows(clusters: DataFrame, indicators: DataFrame) -> DataFrame:
    """clusters with x0 = 1 and the indicators x1, x2, x3 of the time before; the first time goes."""
    lagged = running(indicators.select("ts", *INDICATORS), "ts", ["ts"], **{f"x{j + 1}": ("lag", F.col(c)) for j, c in enumerate(INDICATORS)})
    return clusters.join(lagged.where("x1 is not null").select("ts", F.lit(1.0).alias("x0"), "x1", "x2", "x3"), "ts")


def baseline_coefficients(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, cluster, b) of baseline_rows: least squares by cluster, intercept first.

    One aggregate of the normal equations' sums; their 4 x 4 systems, one a key
    and cluster, are solved on the driver.
    """
    by = [*keys, "cluster"]
    sums = rows.groupBy(*by).agg(*(F.sum(F.col(f"x{a}") * F.col(f"x{b}")).alias(f"a{a}{b}") for a in range(4) for b in range(4)), *(F.sum(F.col(f"x{a}") * F.col("ret")).alias(f"b{a}") for a in range(4))).collect()
    solved = [(*(r[k] for k in by), [float(v) for v in solve([[r[f"a{a}{b}"] for b in range(4)] for a in range(4)], [r[f"b{a}"] for a in range(4)])]) for r in sums]
    kinds = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in by]
    return rows.sparkSession.createDataFrame(solved, ", ".join([*kinds, "b array<double>"]))


def baseline_fit(clusters: DataFrame, indicators: DataFrame) -> dict[int, list[float]]:
    """Coefficients (intercept first) by cluster of its return on the indicators of the time before."""
    return {r["cluster"]: r["b"] for r in baseline_coefficients(baseline_rows(clusters, indicators)).collect()}


def baseline_predict(rows: DataFrame, coefficients: DataFrame, keys: tuple[str, ...] = (), all_cash: bool = False) -> DataFrame:
    """(keys, ts, weights) from baseline_rows: each cluster's return as the fit sees it coming, positive ones in proportion.

    What is read is known before the step, as the indicators are those of the time before.
    """
    told = F.aggregate(F.zip_with("b", F.array("x0", "x1", "x2", "x3"), lambda b, x: b * x), F.lit(0.0), lambda s, v: s + v)
    seen = rows.join(coefficients, [*keys, "cluster"]).groupBy(*keys, "ts").agg(F.array_sort(F.collect_list(F.struct("cluster", told.alias("p")))).alias("c"))
    return seen.select(*keys, "ts", baseline_weights(F.transform("c", lambda c: c["p"]), all_cash).alias("weights"))


def baseline_weights(predicted: Column, all_cash: bool = False) -> Column:
    """Positive predictions in proportion, 0 for cash; if none is positive all 0, or all cash where asked."""
    up = F.transform(predicted, lambda v: F.greatest(F.lit(0.0), v))
    total = F.aggregate(up, F.lit(0.0), lambda s, v: s + v)
    none = F.concat(F.transform(predicted, lambda v: F.lit(0.0)), F.array(F.lit(1.0 if all_cash else 0.0)))
    return F.when(total > 0, F.concat(F.transform(up, lambda v: F.try_divide(v, total)), F.array(F.lit(0.0)))).otherwise(none)
