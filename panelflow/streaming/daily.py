"""New dates appended to a written panel: prices arrive in a folder, returns and each date's moments are added.

A micro-batch's number names all it writes: the returns of its dates, their
moments, what came late, and the snapshot of every series' last price after it.
A batch that is run again reads the snapshot before it and replaces its own
folders, so a stream that was stopped anywhere goes on without a row lost or
doubled.  The snapshot is written last and makes the batch count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.operators import panel
from panelflow.sources.adapters import exists

#: The state is one row a series, whatever the panel's length; the newest ts of all stands in each.
LAST = "algo_id long, ts timestamp, close double, newest timestamp"
UNIVERSE = "ts timestamp, algo_id long, close double, ret double, active boolean"
MOMENTS = "ts timestamp, k long, a double, v double, up long"
LATE = "ts timestamp, algo_id long, close double"


def _part(folder: str, name: str, batch: int) -> str:
    return f"{folder}/{name}/batch={batch}"


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _snapshot(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    path = _part(folder, "last", batch)
    if batch < 0:
        return spark.createDataFrame([], LAST)
    if not exists(spark, f"{path}/_SUCCESS"):
        raise ValueError(f"{path} is missing: the folder isn't the one that this checkpoint wrote")
    return spark.read.schema(LAST).parquet(path)


def append(prices: DataFrame, batch: int, folder: str) -> None:
    """Adds the dates of prices (ts, algo_id, close) to folder as batch number `batch`, after which `batch` - 1 must be there.

    Of rows that repeat a series and time the one of the smallest close counts.
    Rows at or before the newest time written are late: they change nothing and
    are kept in `late`.  Null closes are gaps, yet their dates are dates; rows
    without time or series go.  A batch without rows is still a batch.
    """
    spark = prices.sparkSession
    before = _snapshot(spark, folder, batch - 1)
    newest = before.agg(F.max("newest").alias("_newest"))
    prices = prices.select(F.col("ts").cast("timestamp").alias("ts"), F.col("algo_id").cast("long").alias("algo_id"), F.col("close").cast("double").alias("close")).where("ts is not null and algo_id is not null")
    marked = prices.crossJoin(F.broadcast(newest))  # one row
    marked.where("ts <= _newest").drop("_newest").write.mode("overwrite").parquet(_part(folder, "late", batch))
    new = panel.dedupe_first(marked.where("_newest is null or ts > _newest").drop("_newest"), ["algo_id", "ts"], F.asc_nulls_last("close"))

    # the last price of each series stands before its new ones, so that the first of them has a price to change from
    rows = before.select("ts", "algo_id", "close", F.lit(False).alias("_new")).unionByName(new.withColumn("_new", F.lit(True)))
    moved = panel.changes(rows).where("_new")
    moved.select("ts", "algo_id", "close", "ret", "active").write.mode("overwrite").parquet(_part(folder, "universe", batch))
    rets = spark.read.schema(UNIVERSE).parquet(_part(folder, "universe", batch))
    times = new.select("ts").distinct()
    panel.moments(rets, times, "ts").select("ts", "k", "a", "v", "up").write.mode("overwrite").parquet(_part(folder, "moments", batch))

    top = times.agg(F.max("ts").alias("_top")).crossJoin(newest).select(F.coalesce("_top", "_newest").alias("newest"))
    known = rows.where("close is not null").groupBy("algo_id").agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close"))
    known.crossJoin(F.broadcast(top)).write.mode("overwrite").parquet(_part(folder, "last", batch))
    if batch > 1:
        _drop(spark, _part(folder, "last", batch - 2))


def run_available(spark: SparkSession, inbox: str, folder: str, files_per_batch: int | None = None) -> None:
    """Appends what is new in inbox, a folder of Parquet files (ts, algo_id, close), and returns when nothing is left.

    Files are taken by their time of change, all at once or files_per_batch at
    a time; the stream's checkpoint is beside the tables.
    """
    source = spark.readStream.schema("ts timestamp, algo_id long, close double")
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    stream = source.parquet(inbox).writeStream.foreachBatch(lambda rows, batch: append(rows, batch, folder))
    stream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def _latest(spark: SparkSession, folder: str) -> int:
    """The newest batch whose snapshot is whole, -1 for none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/last")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return max((int(n.removeprefix("batch=")) for n in names if exists(spark, f"{folder}/last/{n}/_SUCCESS")), default=-1)


def _read(spark: SparkSession, folder: str, name: str, schema: str, latest: int) -> DataFrame:
    """Rows of a table's batches that count."""
    if latest < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch int").parquet(f"{folder}/{name}").where(F.col("batch") <= latest).drop("batch")


def read_returns(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Returns and calendar of all batches that count, as `panel.returns` and `panel.calendar` give them for the whole panel."""
    latest = _latest(spark, folder)
    times = panel.calendar(_read(spark, folder, "moments", MOMENTS, latest))
    return _read(spark, folder, "universe", UNIVERSE, latest).join(times, "ts").select("ts", "i", "algo_id", "close", "ret", "active"), times


def read_macro(spark: SparkSession, folder: str) -> DataFrame:
    """Indicators of all dates that count, as `panel.macro` gives them: moments are stored, so series seen later count in earlier dates too."""
    latest = _latest(spark, folder)
    parts = _read(spark, folder, "moments", MOMENTS, latest)
    n = _snapshot(spark, folder, latest).agg(F.count("*").cast("double").alias("n"))
    return panel.indicators(parts.join(panel.calendar(parts), "ts"), n)
