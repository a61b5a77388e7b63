"""Sinks: universe, indicators, clusters and labels as Parquet; logs and summaries as CSV; reports as text; all replace what was there."""

from __future__ import annotations

import re
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.operators import backtest

#: Price files of a folder, about: more are dealt out to several, as Spark's driver keeps all files of what it reads or writes.
FOLDER_FILES = 10_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors share; it goes when the driver's JVM ends.

    Where that is unset, a local master gets a temporary folder, a cluster an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='panelflow-')}"
    path = f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, where = _file_system(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def save(rows: DataFrame, name: str) -> DataFrame:
    """rows written to a fresh shared folder and read back: what several plans read, or a loop's state without its history."""
    path = f"{shared_folder(rows.sparkSession, name)}/rows"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_universe(rets: DataFrame, folder: str) -> None:
    """Returns and activity as one long table by year, so that date ranges prune folders; a year's rows are shared out by ranges of time."""
    rows = rets.withColumn("year", F.year("ts"))
    rows.repartitionByRange("year", "ts").sortWithinPartitions("ts", "algo_id").write.mode("overwrite").partitionBy("year").parquet(f"{folder}/universe")


def write_table(rows: DataFrame, folder: str, name: str) -> None:
    """Indicators, cluster features or labels, long, in order of time."""
    rows.repartitionByRange("i").sortWithinPartitions("i").write.mode("overwrite").parquet(f"{folder}/{name}")


def read_table(spark: SparkSession, folder: str, name: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """A written table, between two dates, both included, where given; a universe reads only those years."""
    rows = spark.read.parquet(f"{folder}/{name}")
    years = "year" in rows.columns
    if start is not None:
        rows = rows.where(F.to_date("ts") >= F.lit(start).cast("date"))
        rows = rows.where(F.col("year") >= int(start[:4])) if years else rows
    if end is not None:
        rows = rows.where(F.to_date("ts") <= F.lit(end).cast("date"))
        rows = rows.where(F.col("year") <= int(end[:4])) if years else rows
    return rows


def _one_file(spark: SparkSession, write, path: str) -> str:
    """Lets write() fill a folder with one part and moves that part to path."""
    work = f"{path}.{uuid.uuid4().hex}"
    write(work)
    fs, at = _file_system(spark, path)
    part = next(s.getPath() for s in fs.listStatus(_file_system(spark, work)[1]) if s.getPath().getName().startswith("part-"))
    fs.delete(at, True)
    if not fs.rename(part, at):
        raise OSError(f"{path} could not be written")
    fs.delete(_file_system(spark, work)[1], True)
    return path


def execution_columns(log: DataFrame, k: int) -> DataFrame:
    """The log as it is written: date, equity, return, benchmark_return, leverage, cost, cash_weight, C0_w, C1_w, ..."""
    weights = (F.get("weights", F.lit(c)).alias(f"C{c}_w") for c in range(k))
    return log.select(F.col("ts").alias("date"), "equity", F.col("ret").alias("return"), "benchmark_return", "leverage", "cost", "cash_weight", *weights)


def write_execution(log: DataFrame, folder: str, k: int, prefix: str = "train", episode: int = 1) -> str | None:
    """{prefix}_episode_{episode}.csv, a row a step in order; no file and None for a log without steps."""
    if log.isEmpty():
        return None
    rows = execution_columns(log, k).coalesce(1).sortWithinPartitions("date")
    stamp = "yyyy-MM-dd HH:mm:ss"
    return _one_file(log.sparkSession, lambda at: rows.write.option("header", True).option("timestampFormat", stamp).csv(at), f"{folder}/{prefix}_episode_{episode}.csv")


def read_execution(spark: SparkSession, path: str) -> DataFrame:
    head = "date timestamp, equity double, `return` double, benchmark_return double, leverage double, cost double, cash_weight double"
    names = spark.read.option("header", True).csv(path).columns[7:]
    schema = ", ".join([head, *(f"{n} double" for n in names)])
    return spark.read.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").schema(schema).csv(path)


def _write_lines(lines: DataFrame, path: str) -> str:
    """lines (n, line) in order of n; as many rows as a report has."""
    rows = lines.coalesce(1).sortWithinPartitions("n").select("line")
    return _one_file(lines.sparkSession, lambda at: rows.write.text(at), path)


def write_report(log: DataFrame, figures: DataFrame, folder: str, prefix: str = "Test", title: str = "PORTFOLIO") -> str:
    return _write_lines(backtest.executive_report(log, figures, prefix, title), f"{folder}/{prefix}_Executive_Report.txt")


def write_summary(figures: DataFrame, folder: str, title: str) -> str:
    return _write_lines(backtest.executive_summary(figures, title), f"{folder}/Executive_Summary.txt")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, line) of a written report."""
    whole = spark.read.text(path, wholetext=True).select(F.split(F.rtrim(F.col("value"), F.lit("\n")), "\n").alias("l"))
    return whole.select(F.posexplode("l").alias("n", "line"))


def write_fold_summary(figures: DataFrame, folder: str) -> str:
    """Metrics_Summary.csv (Fold, Train_Ret, Test_Ret, Train_Sharpe, Test_Sharpe) of figures by fold and split."""
    rows = backtest.fold_summary(figures).coalesce(1).sortWithinPartitions("Fold")
    return _one_file(figures.sparkSession, lambda at: rows.write.option("header", True).csv(at), f"{folder}/Metrics_Summary.csv")


def read_fold_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("Fold string, Train_Ret double, Test_Ret double, Train_Sharpe double, Test_Sharpe double").csv(path)


def write_prices(panel: DataFrame, folder: str) -> None:
    """One {algo_id}.csv (datetime, close) a series, as the price source reads them; of more than FOLDER_FILES series, dealt out to folders series-N below.

    The driver holds no more than one folder's files at a time.  In a local
    folder, which executors share, tasks write each file under its name.
    Elsewhere Spark writes a folder a series, and the driver only moves each
    folder's one file, many at a time.
    """
    spark = panel.sparkSession
    # ids as Spark names the folders of a table, in which those without a name are one
    name = F.coalesce(F.expr("nullif(cast(algo_id as string), '')"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    rows = save(panel.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("datetime"), "close", name.alias("algo_id")), "prices")
    n = -(-rows.agg(F.countDistinct("algo_id")).first()[0] // FOLDER_FILES)
    below = [f"/series-{k:09d}" for k in range(n)] if n > 1 else [""]
    rows = rows.withColumn("below", F.pmod(F.xxhash64("algo_id"), F.lit(len(below))).cast("int"))
    fs, target = _file_system(spark, folder)
    fs.delete(target, True)
    for b in below:
        fs.mkdirs(_file_system(spark, folder + b)[1])
    if fs.getUri().getScheme() == "file":
        return _write_local(rows, fs.makeQualified(target).toUri().getPath(), below)
    if n > 1:
        at = f"{shared_folder(spark, 'prices')}/rows"
        rows.repartition("below").write.partitionBy("below").parquet(at)
        rows = spark.read.schema(rows.schema).parquet(at)
    for k, b in enumerate(below):
        _write_moved(rows.where(F.col("below") == k).drop("below"), folder + b)


def _write_local(rows: DataFrame, folder: str, below: list[str]) -> None:
    """Price files of rows (datetime, close, algo_id, below), written by the tasks; a file gets its name when it is whole."""
    special = r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]"""

    def write(batches):
        import os
        import re
        import uuid
        from itertools import groupby

        import pyarrow as pa

        key, out, path, files = None, None, "", 0
        for batch in batches:
            ids = zip(batch.column("algo_id").to_pylist(), batch.column("below").to_pylist(), batch.column("line").to_pylist())
            for (algo, k), lines in groupby(ids, lambda x: x[:2]):
                if algo != key:
                    if out:
                        out.close()
                        os.replace(out.name, path)
                    key, files = algo, files + 1
                    name = re.sub(special, lambda c: f"%{ord(c[0]):02X}", algo)
                    path = f"{folder}{below[k]}/{name}.csv"
                    out = open(f"{folder}{below[k]}/.{uuid.uuid4().hex}", "w", encoding="utf-8", newline="")
                    out.write("datetime,close\n")
                out.writelines(x[2] for x in lines)
        if out:
            out.close()
            os.replace(out.name, path)
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lines = rows.repartition("algo_id").sortWithinPartitions("algo_id", "datetime").select("algo_id", "below", F.concat(text("datetime"), F.lit(","), text("close"), F.lit("\n")).alias("line"))
    lines.mapInArrow(write, "files long").write.format("noop").mode("overwrite").save()


def _write_moved(rows: DataFrame, folder: str) -> None:
    """Price files of rows (datetime, close, algo_id), written by Spark and moved to folder, which is there."""
    spark = rows.sparkSession
    work = f"{folder}.{uuid.uuid4().hex}"
    rows.repartition("algo_id").sortWithinPartitions("algo_id", "datetime").write.partitionBy("algo_id").option("header", True).csv(work)
    fs, at = _file_system(spark, work)
    path = spark._jvm.org.apache.hadoop.fs.Path
    # listed by Spark, without their contents: asking the driver's file system for each folder takes longer than all else
    parts = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(work).select("path").toPandas()["path"]

    def move(part: str) -> None:
        name = part.rsplit("/", 2)[1][len("algo_id=") :]
        if not fs.rename(path(part), path(f"{folder}/{name}.csv")):
            raise OSError(f"{folder}/{name}.csv could not be written")

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(move, parts))
    fs.delete(at, True)
