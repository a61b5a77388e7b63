"""Running values over all time without a task that sees all rows.

Time is cut into blocks of the calendar.  Each block is scanned by itself, one
summary a block goes into a row that holds as many of them as the calendar has
blocks, and what the blocks before amount to is put on each block's rows.  The
cut is an expression of the time alone, so a task that is run again finds the
same blocks, and both scans read one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units of the calendar that a block can be.
UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute")
#: What a block amounts to, in order of time, as a fold of its rows: start value, and how two stretches join.
_NEUTRAL = {"count": 0, "product": 1.0, "sum": 0.0, "max": None, "last": None, "lag": None}


def _joined(kind: str, a: Column, b: Column) -> Column:
    """The value of a stretch of value a followed by one of value b."""
    if kind in ("count", "sum"):
        return a + b
    if kind == "product":
        return a * b
    if kind == "lag":
        return b
    return F.greatest(a, b) if kind == "max" else F.coalesce(b, a)


def _local(kind: str, value: Column, w) -> Column:
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return {
        "count": lambda: F.row_number().over(w).cast("long"), "product": lambda: F.product(value).over(so_far), "sum": lambda: F.sum(value).over(so_far),
        "max": lambda: F.max(value).over(so_far), "last": lambda: F.last(value, ignorenulls=True).over(so_far), "lag": lambda: F.lag(value).over(w),
    }[kind]()


def running(rows: DataFrame, time: str, order: list[str], unit: str = "year", **wanted: tuple[str, Column | None]) -> DataFrame:
    """rows with a column for each name=(kind, value): its running value by order, which begins with the time.

    Kinds: count (from 1), product, sum and max of what is so far, last (the
    latest value that is not null), lag (the value of the row before).  Products
    and sums pass over nulls.  unit is the calendar's unit that a task holds
    rows of; order must tell all rows apart where kinds depend on it.  Rows
    without a time have no place and go.
    """
    if unit not in UNITS:
        raise ValueError(f"{unit} is none of {', '.join(UNITS)}")
    values = {n: F.lit(1) if v is None else v for n, (_, v) in wanted.items()}
    rows = rows.select("*", F.date_trunc(unit, F.col(time).cast("timestamp")).alias("_block"), *(v.alias(f"_v_{n}") for n, v in values.items()))
    # said here, the join's own condition leaves both scans alike, so that they share a shuffle and the source is read once
    rows = rows.where(F.col("_block").isNotNull())
    w = Window.partitionBy("_block").orderBy(*order)
    kinds = {n: k for n, (k, _) in wanted.items()}
    local = rows.select("*", *(_local(k, F.col(f"_v_{n}"), w).alias(f"_l_{n}") for n, k in kinds.items()))
    key = F.struct(*order)
    whole = {
        "count": lambda v: F.count("*"), "product": F.product, "sum": F.sum, "max": F.max,
        "last": lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), key)), "lag": lambda v: F.max_by(v, key),
    }
    summary = rows.groupBy("_block").agg(*(whole[k](f"_v_{n}").alias(n) for n, k in kinds.items()))
    every = summary.agg(F.array_sort(F.collect_list(F.struct("_block", *kinds))).alias("s"))
    typed = {n: F.lit(_NEUTRAL[k]).cast(summary.schema[n].dataType) for n, k in kinds.items()}
    before = F.transform("s", lambda x, at: F.struct(x["_block"].alias("_block"), F.aggregate(
        F.slice("s", F.lit(1), at), F.struct(*(typed[n].alias(n) for n in kinds)),
        lambda a, b: F.struct(*(_joined(k, a[n], F.coalesce(b[n], typed[n]) if k in ("count", "product", "sum") else b[n]).alias(n) for n, k in kinds.items())),
    ).alias("c")))
    carried = every.select(F.explode(before).alias("b")).select("b._block", F.col("b.c").alias("_c"))
    out = local.join(carried, "_block")
    # the first row of a block has the block before in front of it
    end = {n: F.coalesce(F.col(f"_l_{n}"), typed[n]) if k != "lag" else F.when(F.row_number().over(w) == 1, F.col("_c")[n]).otherwise(F.col(f"_l_{n}")) for n, k in kinds.items()}
    return out.select(*(c for c in rows.columns if c != "_block" and c[:3] != "_v_"), *((end[n] if k == "lag" else _joined(k, F.col("_c")[n], end[n])).alias(n) for n, k in kinds.items()))
