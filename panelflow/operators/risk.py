"""Hard risk rules: a stop-loss and a take-profit that close the portfolio, with re-entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.config import EngineConfig

#: Of a wait that never ends.
NEVER = 2**31 - 1


def closings(log: DataFrame, stop: float, take: float, wait: int | None, keys: tuple[str, ...] = ("fold",)) -> DataFrame:
    """(keys, pos, why, until): the steps after which a fold's portfolio is closed, and the first step that is traded again.

    The value since entry is folded over the fold's steps in order.  At stop or
    less below entry, or take or more above, it is closed after the step; then
    `wait` steps go by in cash (None: all that are left) and it is entered anew.
    What is carried from step to step is the value, the wait and the closings so
    far, not the steps.
    """
    place = Window.partitionBy(*keys).orderBy("ts")
    steps = log.select(*keys, (F.row_number().over(place) - 1).cast("int").alias("pos"), "ret")
    path = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "ret"))).alias("path"))
    empty = F.array().cast("array<struct<pos:int,why:string,until:int>>")
    rest = NEVER if wait is None else wait

    def state(value: Column, left: Column, closed: Column) -> Column:
        return F.struct(value.cast("double").alias("value"), left.cast("int").alias("left"), closed.alias("closed"))

    def step(was: Column, x: Column) -> Column:
        now = was["value"] * (1 + x["ret"])
        why = F.when(now - 1 <= stop, "stop").when(now - 1 >= take, "take")
        until = F.lit(NEVER) if wait is None else x["pos"] + 1 + rest
        event = F.struct(x["pos"].alias("pos"), why.alias("why"), until.cast("int").alias("until"))
        held = F.when(why.isNotNull(), state(F.lit(1.0), F.lit(rest), F.concat(was["closed"], F.array(event)))).otherwise(state(now, F.lit(0), was["closed"]))
        return F.when(was["left"] > 0, state(F.lit(1.0), was["left"] - 1, was["closed"])).otherwise(held)

    found = path.select(*keys, F.explode(F.aggregate("path", state(F.lit(1.0), F.lit(0), empty), step, lambda s: s["closed"])).alias("e"))
    return found.select(*keys, "e.*")


def guarded(log: DataFrame, cfg: EngineConfig, keys: tuple[str, ...] = ("fold",)) -> DataFrame:
    """log under the rules of cfg, with held (is the step traded) and closed (stop or take where it closes).

    A closing sells all that is not cash at the step's end, a re-entry buys it
    back from cash; both pay for twice the invested share.  A step in cash earns
    and costs nothing.
    """
    place = Window.partitionBy(*keys).orderBy("ts")
    steps = log.withColumn("pos", (F.row_number().over(place) - 1).cast("int"))
    events = closings(log, cfg.stop_loss, cfg.take_profit, cfg.wait, keys)
    ends = events.select(*keys, "pos", F.col("why").alias("closed"), "until")
    rows = steps.join(ends, [*keys, "pos"], "left")
    before = place.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("back", F.coalesce(F.last("until", ignorenulls=True).over(before), F.lit(-1))).withColumn("held", F.col("pos") >= F.col("back"))
    swap = 2 * F.col("leverage") * (1 - F.col("cash_weight"))
    entry = F.when(F.col("pos") == F.col("back"), swap).otherwise(F.col("turnover"))
    turnover = F.when(F.col("held"), entry + F.when(F.col("closed").isNotNull(), swap).otherwise(0.0)).otherwise(0.0)
    rows = rows.withColumn("paid", turnover).withColumn("ret", F.when(F.col("held"), F.col("ret") + F.col("cost") - F.col("paid") * cfg.cost_rate).otherwise(0.0))
    equity = 100 * F.product(1 + F.col("ret")).over(place.rowsBetween(Window.unboundedPreceding, 0))
    cash = F.when(F.col("held"), F.col("cash_weight")).otherwise(1.0)
    return rows.select(*keys, "ts", equity.alias("equity"), "ret", "benchmark_return", "leverage", F.col("paid").alias("turnover"), (F.col("paid") * cfg.cost_rate).alias("cost"), cash.alias("cash_weight"), "held", "closed")
