"""Centroid clustering on whole numbers: a float32 product screens centroids, rounding intervals that overlap are settled exactly.

For a vector x and a centroid c the rank |c|^2 - 2 x.c orders centroids as the
squared distance does.  |c|^2 is exact, x.c comes from one float32 matrix product.
Each of its terms is rounded at most twice on the way in, once as a product and
once in each of dim - 1 additions in whatever order, so its error is at most
gamma(dim + 2) * |x| * |c|, gamma(m) = m u / (1 - m u) and u = 2 ** -24.  A
centroid whose interval lies wholly above another's cannot win; where more than
one is left their distances are summed in 64-bit integers and the lowest number
wins a tie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.llm.common import Scratch

SCALE = 64
#: Entries are below this size, so that no squared distance of up to 128 of them leaves 64 bits.
LIMIT = 2**27
ROWS = 8_192


def whole_numbers(vectors: DataFrame, dim: int, vector_col: str, id_col: str) -> DataFrame:
    """(id, x array<long>) of the vectors of exactly dim entries, none null or non-finite: floor(64 * entry).

    A vector with an entry of 2 ** 27 or more after scaling is dropped like a
    non-finite one, as no long holds its distances.  Null and repeated ids stay.
    """
    v = F.col(vector_col).cast("array<double>")
    fine = F.coalesce((F.size(v) == dim) & F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < LIMIT / SCALE)), F.lit(False))
    return vectors.where(fine).select(F.col(id_col).alias("id"), F.transform(F.when(fine, v), lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def screen(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds [row, centroid] of |c|^2 - 2 x.c over int64 rows and centroids."""
    dim = x.shape[1]
    gamma = (dim + 2) * 2.0**-24 / (1 - (dim + 2) * 2.0**-24)
    product = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    squares = (centroids * centroids).sum(axis=1)
    # a part in 2 ** 40 more pays for the roots' and these sums' own rounding in doubles
    length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))[:, None] * np.sqrt(squares.astype(np.float64))
    half = 2 * gamma * length * (1 + 2.0**-40) + 2.0**-40 * (squares + 2 * length)
    rank = squares - 2 * product
    return rank - half, rank + half


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid, the lowest number of equally near ones, and its squared distance, both exact."""
    low, high = screen(x, centroids)
    able = low <= high.min(axis=1, keepdims=True)
    own = able.argmax(axis=1)
    row, c = np.nonzero(able & (able.sum(axis=1) > 1)[:, None])
    if len(row):
        gap = x[row] - centroids[c]
        exact = (gap * gap).sum(axis=1)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(exact, first)
        tied = np.where(exact == np.repeat(least, np.diff(first, append=len(row))), c, len(centroids))
        own[row[first]] = np.minimum.reduceat(tied, first)
    gap = x - centroids[own]
    return own, (gap * gap).sum(axis=1)


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            yield part.column(0), part.column(1).flatten().to_numpy().reshape(part.num_rows, dim)


def seeds(rows: DataFrame, k: int, salt: str = "1:") -> np.ndarray:
    """The vectors of the k smallest lowercase-hex sha256 of salt and the id in decimal, in that order; null ids come last, equal ids by vector."""
    key = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    first = rows.select("x", key.alias("h")).orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in first], np.int64)


def refine(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every centroid becomes the exact floor of its vectors' mean; one without vectors stays.

    A task sends one row of sums a centroid, so the shuffle holds k rows a task.
    """
    k, dim = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for _, x in _matrices(batches, dim):
            own, _ = nearest(x, centroids)
            count += np.bincount(own, minlength=k)
            order = np.argsort(own, kind="stable")
            begin = np.flatnonzero(np.diff(own[order], prepend=-1))
            total[own[order][begin]] += np.add.reduceat(x[order], begin, axis=0)
        held = np.flatnonzero(count)
        ends = pa.array(np.arange(len(held) + 1, dtype=np.int32) * dim)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(count[held]), pa.ListArray.from_arrays(ends, pa.array(total[held].ravel()))], names=["c", "n", "s"])

    parts = rows.mapInArrow(sums, "c long, n long, s array<long>")
    found = parts.groupBy("c").agg(F.sum("n").alias("n"), *(F.sum(F.get("s", F.lit(j))).alias(f"s{j}") for j in range(dim))).collect()
    out = centroids.copy()
    for r in found:
        out[r["c"]] = [r[f"s{j}"] // r["n"] for j in range(dim)]
    return out


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every row."""
    dim = centroids.shape[1]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _matrices(batches, dim):
            own, distance = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(own.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    return rows.mapInArrow(near, f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance long")


def _by_cluster(values: list) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), "cluster")


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that counts.

    With fewer than k vectors there are as many centroids as vectors; without
    any there is no row.  Extra columns go.  What the driver holds is k vectors.
    """
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, dim, vector_col, id_col)
    centroids = seeds(rows, k)
    if not len(centroids):
        kind = vectors.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = refine(rows, centroids)
    assigned = Scratch(spark, "centroids").save(assign(rows, centroids))
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    each = _by_cluster([sums.get(c, 0) for c in range(len(centroids))]).cast("long").alias("cluster_inertia")
    return assigned.select(F.col("id").alias(id_col), "cluster", "distance", each, F.lit(sum(sums.values())).cast("long").alias("inertia"), _by_cluster(digest).alias("centroid_sha256"))
