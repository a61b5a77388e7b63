"""Scratch tables in the cluster's shared folder, worker caches, connected components."""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define words by it.
SPACE = r"[\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir.

    Where it is unset a local master gets a folder of its own; a cluster's
    executors would each write to their own disk, so there it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share; the master is {master}")
        at = f"file://{tempfile.mkdtemp(prefix='panelflow-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor loses none of them.

    Those that no later plan reads are dropped at once, the rest when the
    driver's JVM ends: results are read lazily, so no operator can tell sooner.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        fs, at = self._at(self.root)
        fs.mkdirs(at)
        fs.deleteOnExit(at)

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def save(self, df: DataFrame) -> DataFrame:
        at = self.path()
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes saved tables that no later plan reads."""
        for path in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
            fs, at = self._at(path)
            fs.delete(at, True)


def by_size(batch: pa.RecordBatch, most: int) -> Iterator[tuple[list, list]]:
    """Ids and texts, the first two columns, of runs of a batch's rows that end once they hold `most` bytes.

    Only a run's rows become Python objects, however many rows Arrow put in the batch.
    """
    sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = min(len(sizes), int(np.searchsorted(ends, most + (ends[a - 1] if a else 0))) + 1)
        yield batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist()
        a = b


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, whichever task asks for it."""
    name = "_panelflow_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].held = {}
    return sys.modules[name].held


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64, wrapping."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def find_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over edges (a, b): every node that isn't the smallest of its class, and that smallest node."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)].tolist(), flat[len(a) :].tolist()
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(u, v):
        x, y = root(x), root(y)
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    roots = np.fromiter((root(x) for x in range(len(nodes))), dtype=np.int64, count=len(nodes))
    own = roots != np.arange(len(nodes))
    return nodes[own], nodes[roots[own]]


def _union_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch becomes the spanning stars of its own edges."""
    for batch in batches:
        if batch.num_rows:
            u, v = find_roots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component_id) for every node of edges (u long, v long), component_id the smallest id reachable.

    Union-find inside each Arrow batch, then alternating large and small stars
    until the edges no longer change.  Hubs are aggregated before the shuffle
    and joined by keys that adaptive execution can split.  No edge: no row.
    """

    def stars(e: DataFrame) -> DataFrame:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        return e.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    now = scratch.save(edges.mapInArrow(_union_batches, "u long, v long").distinct())
    before = state(now)
    while before[0]:
        after = scratch.save(stars(now))
        scratch.drop(now)
        now, was, before = after, before, state(after)
        if was == before:
            break
    return now.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(now.select("v", F.col("v").alias("w")).distinct())
