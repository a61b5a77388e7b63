"""Whitening of embeddings: one aggregation sums centred products of all pairs of dimensions, LAPACK decomposes their covariance.

Entries become whole numbers first.  Sums of entries are exact; products are of
entries less their dimension's rounded mean, whole numbers too, whose sums in
doubles are exact below 2 ** 53, so a stage that an executor's loss repeats gives
the same bits.  The rounding of the mean, at most a half, is taken off in closed
form.  The driver holds a dimensions x dimensions matrix and never a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
#: Entries of this size and more have no exact place among the sums: their rows are dropped like non-finite ones.
TOO_LARGE = float(2**40)


@dataclass(frozen=True)
class Whitening:
    """n rows with sums S by dimension; components are rows of unit length by falling eigenvalue."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float


def fixed_point(vectors: DataFrame, vector_col: str, id_col: str) -> DataFrame:
    """(id, x array<long>) of the rows that count: entries floor(1024 * c) + 100000.

    A vector that is null or empty, holds a null or non-finite entry or one too
    large is dropped, and so is one of another length than most vectors have
    (the shorter length where two are as frequent).  Null and repeated ids stay.
    """
    v = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < TOO_LARGE)) & (F.size(v) > 0), F.lit(False))
    # filters are free to run in any order, so entries that would overflow are never turned into whole numbers
    rows = vectors.where(fine).select(F.col(id_col).alias("id"), F.transform(F.when(fine, v), lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("x") == (lengths["d"] if lengths else 0))


def moments(rows: DataFrame, x: str, dim: int) -> tuple[int, list[int]]:
    """Rows and exact sums of the array column x by dimension."""
    got = rows.agg(F.count("*").alias("n"), *(F.sum(F.get(x, F.lit(j)).cast("decimal(20,0)")).alias(f"s{j}") for j in range(dim))).first()
    return got["n"], [int(got[f"s{j}"] or 0) for j in range(dim)]


def centred_products(rows: DataFrame, column: str, dim: int) -> np.ndarray:
    """The symmetric matrix of sums of products of all pairs of entries of an array column, from one aggregation.

    A generated SQL sum stands for each diagonal of the upper triangle, wrapped
    round, and a group for each place on it: dim / 2 + 1 sums of dim groups hold
    every pair, in a row code short enough to be compiled.
    """
    places = rows.selectExpr(f"concat({column}, {column}) AS d", f"posexplode({column}) AS (i, a)")
    sums = places.groupBy("i").agg(*(F.expr(f"sum(a * d[i + {t}])").alias(f"p{t}") for t in range(dim // 2 + 1))).collect()
    out = np.zeros((dim, dim))
    for row in sums:
        for t in range(dim // 2 + 1):
            i, j = row["i"], (row["i"] + t) % dim
            out[i, j] = out[j, i] = row[f"p{t}"]
    return out


def fit(rows: DataFrame, x: str = "x") -> Whitening | None:
    """The whitening of the array column x over all rows; None where there are none."""
    first = rows.select(F.size(x).alias("d")).first()
    if first is None:
        return None
    dim = first["d"]
    n, sums = moments(rows, x, dim)
    pivot = [(2 * s + n) // (2 * n) for s in sums]
    centred = rows.select(F.array(*((F.get(x, F.lit(j)) - p).cast("double") for j, p in enumerate(pivot))).alias("c"))
    rest = np.array([s - n * p for s, p in zip(sums, pivot)], float)
    covariance = (centred_products(centred, "c", dim) - np.outer(rest, rest) / n) / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")
    return Whitening(n, sums, values[order], vectors.T[order], float(np.trace(covariance)))


def scales(fitted: Whitening, most: int) -> np.ndarray:
    """Up to `most` components over the root of their eigenvalue.

    Components whose eigenvalue is nothing but rounding (below 1e-12 of the
    largest) have no scale and are left out.
    """
    kept = fitted.eigenvalues[:most] > max(1e-12 * fitted.eigenvalues[0], 1e-9)
    return fitted.components[:most][kept] / np.sqrt(fitted.eigenvalues[:most][kept])[:, None]


def whiten(rows: DataFrame, fitted: Whitening, most: int) -> DataFrame:
    """(id, x, w) of rows (id, x): x less its mean, projected on the scaled components, an entry each."""
    means, by = np.array([s / fitted.n for s in fitted.sums]), scales(fitted, most)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(means))
                w = np.einsum("nd,kd->nk", x - means, by)
                ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(by))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], names=["id", "x", "w"])

    return rows.select("id", "x").mapInArrow(project, f"id {rows.schema['id'].dataType.simpleString()}, x array<long>, w array<double>")


def deviation(x: str, fitted: Whitening) -> Column:
    """Sum over dimensions of (n * x - S) ** 2, exact; null where no long holds it."""
    terms = [F.try_subtract(F.try_multiply(F.get(x, F.lit(j)), F.lit(fitted.n).cast("long")), F.lit(s).cast("long")) for j, s in enumerate(fitted.sums)]
    out = F.lit(0).cast("long")
    for t in terms:
        out = F.try_add(out, F.try_multiply(t, t))
    return out


def identity_error(whitened: DataFrame, n: int, dim: int) -> float:
    """The largest absolute entry of the covariance of the array column w over all n rows minus the identity."""
    means = whitened.agg(*(F.avg(F.get("w", F.lit(k))).alias(f"m{k}") for k in range(dim))).first()
    centred = whitened.select(F.array(*(F.get("w", F.lit(k)) - means[k] for k in range(dim))).alias("c"))
    return float(np.abs(centred_products(centred, "c", dim) / n - np.eye(dim)).max())


def whitened_components(vectors: DataFrame, most: int = 8, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row a vector and component.

    Extra columns go; a table without a vector that counts, or whose vectors are
    all equal, gives no row.
    """
    rows = fixed_point(vectors, vector_col, id_col)
    fitted = fit(rows)
    kept = len(scales(fitted, most)) if fitted else 0
    if not kept:
        kind = vectors.schema[id_col].dataType.simpleString()
        columns = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, {columns}")
    whitened = whiten(rows, fitted, most)
    error = identity_error(whitened, fitted.n, kept)
    explained = F.array(*(F.lit(float(e / fitted.trace)) for e in fitted.eigenvalues[:kept]))
    out = whitened.select("id", deviation("x", fitted).alias("deviation"), F.posexplode("w").alias("k", "whitened"))
    return out.select(
        F.col("id").alias(id_col), (F.col("k") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(explained, "k").alias("explained"), F.lit(error).alias("identity_error"),
    )
