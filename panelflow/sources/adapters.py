"""Sources: price files, benchmark files with fallbacks, and panels made of the fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.operators.scan import running
from panelflow.sources.writers import save, shared_folder

PRICE_SCHEMA = "datetime string, close double"
MONTHLY_SCHEMA = "month string, start_equity double, end_equity double, monthly_return double"
#: Formats of trade times, tried in order.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd HH:mm[XXX]", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy")

#: While price files are read: else their lines' table has a file for every few of them, and the driver keeps up to 250 MB of listings that nothing asks for again.
_READING = {"spark.sql.files.openCostInBytes": "64k", "spark.sql.hive.filesourcePartitionFileCacheSize": "0"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def parse_time(col: str):
    return F.coalesce(*(F.try_to_timestamp(F.col(col), F.lit(f)) for f in TIME_FORMATS))


def pack_small_files(spark: SparkSession, open_cost: str = "64k", most: str = "256m") -> None:
    """Has scans planned from now on put many small files into one task: a file costs little to open, a task holds up to `most`.

    With Spark's own 4 MB a file some 14,000 price files of 50 KB fill 450 tasks, with 64 KB seven.
    """
    spark.conf.set("spark.sql.files.openCostInBytes", open_cost)
    spark.conf.set("spark.sql.files.maxPartitionBytes", most)


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file, seq, value) of price files, written as a table; the folders series-N are read one after the other, so that the driver keeps one's files at a time."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda glob, folders: sorted(x.getPath().toString() for x in fs.globStatus(path(f"{folder.rstrip('/')}/{glob}")) or () if x.isDirectory() == folders)
    dealt = names("series-" + "[0-9]" * 9, True)
    parts = [[folder]] if not dealt else [*([x] for x in dealt), *filter(None, [names("*.csv", False)])]
    at, kept = f"{shared_folder(spark, 'lines')}/rows", {c: spark.conf.get(c) for c in _READING}
    try:
        for c, v in _READING.items():
            spark.conf.set(c, v)
        for part in parts:
            lines = spark.read.text(part, pathGlobFilter="*.csv").select(
                F.col("_metadata.file_name").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")).alias("seq"), "value",
            )
            lines.write.mode("append").parquet(at)
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    return spark.read.schema(lines.schema).parquet(at)


def scan_prices(spark: SparkSession, folder: str) -> DataFrame:
    """(algo_id, ts, close, seq, _corrupt) of every *.csv in folder and its folders series-N, not elsewhere below it, as they are now; the id is the file's name without .csv.

    Files are read line by line, so a large one is split and small ones share a
    task.  seq, the start of a line's split and its number in the task, orders a
    file's lines as they stand.  Columns are found by the file's first line; a
    file that lacks `datetime` or `close` there has one row, that line as
    corrupt.  _corrupt holds a line that does not parse, else null.  Lines equal
    to the first one of their file are headers.  Files are opened once: their
    lines are written as a table, which all that follows reads.
    """
    lines = _lines(spark, folder)
    head = lines.groupBy("file").agg(F.min_by("value", "seq").alias("head"))
    names = F.transform(F.split("head", ","), lambda c: F.trim(c))
    at = {c: F.array_position(names, c).cast("int") for c in ("datetime", "close")}
    rows = lines.join(head.select("file", "head", *(at[c].alias(f"_{c}") for c in at)), "file")
    known = (F.col("_datetime") > 0) & (F.col("_close") > 0)
    rows = rows.where(F.when(known, (F.col("value") != F.col("head")) & (F.col("value") != "")).otherwise(F.col("value") == F.col("head")))
    cells = F.split("value", ",", -1)
    cell = lambda c: F.get(cells, F.when(known, F.col(f"_{c}") - 1))
    rows = rows.withColumn("price", cell("close")).withColumn("raw", cell("datetime"))
    rows = rows.withColumn("ts", parse_time("raw")).withColumn("close", F.expr("try_cast(nullif(price, '') as double)"))
    bad = F.col("ts").isNull() | (F.col("close").isNull() & F.col("price").isNotNull() & (F.col("price") != ""))
    return rows.select(F.regexp_replace("file", r"\.csv$", "").alias("algo_id"), "ts", "close", "seq", F.when(bad, F.col("value")).alias("_corrupt"))


def read_prices(spark: SparkSession, folder: str, on_error: str = "file") -> DataFrame:
    """(algo_id, ts, close, seq) of scan_prices; on_error says what a line that does not parse takes with it.

    "file", as a reader that gives up on a bad file would, leaves the file out
    whole; "row" leaves out the line.
    """
    rows = scan_prices(spark, folder)
    if on_error == "file":
        broken = rows.where("_corrupt is not null").select("algo_id").distinct()
        rows = rows.join(broken, "algo_id", "left_anti")
    elif on_error == "row":
        rows = rows.where("_corrupt is null")
    else:
        raise ValueError(f"on_error is {on_error}, not file or row")
    return rows.select("algo_id", "ts", "close", "seq")


def read_benchmark(spark: SparkSession, monthly: str | None, trades: str | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """The monthly file and the trades (ts, equity), each None where its path is none or no file is there; alignment picks."""
    found = None
    if monthly and exists(spark, monthly):
        found = spark.read.option("header", True).schema(MONTHLY_SCHEMA).csv(monthly)
    return found, read_trades(spark, trades) if trades and exists(spark, trades) else None


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    """(ts, equity) of a trade-level benchmark file; times in mixed formats, as UTC."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(parse_time("dateClose").alias("ts"), F.expr("try_cast(equity_EOD as double)").alias("equity")).where("ts is not null")


def supplier_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel A (ts, algo_id, close): one series a supplier, weekly."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.date_trunc("week", "l_shipdate").alias("ts"), F.col("l_suppkey").cast("long").alias("algo_id"))
    return rows.agg((F.lit(1e6) + F.max("l_extendedprice")).alias("close"))


def brand_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel B (ts, algo_id, close): one series a brand, monthly."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return items.groupBy(F.date_trunc("month", "l_shipdate").alias("ts"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("algo_id")).agg((F.lit(1e6) + F.max("l_extendedprice")).alias("close"))


def order_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly benchmark (month, monthly_return) of the largest order."""
    m = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg((F.lit(1e6) + F.max("o_totalprice")).alias("e"))
    m = running(m.withColumn("at", F.to_date("month", "yyyy-MM")), "at", ["at"], before=("lag", F.col("e")))
    return m.select("month", F.coalesce(F.col("e") / F.col("before") - 1, F.lit(0.0)).alias("monthly_return"))
