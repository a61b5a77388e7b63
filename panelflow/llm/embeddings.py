"""Embedding near-dedup by collision counting over one-dimensional projections.

Every vector is projected on many random directions.  Each projection is sorted
and every vector's window, centred on it, is read off the sorted order; pairs in
enough windows are verified by their cosine in double precision.  Window and
count are calibrated on the threshold: at a cosine of exactly THRESHOLD a pair's
difference on a direction is normal with deviation sqrt(2 - 2 * THRESHOLD).

A window of one projection holds a fixed share of all vectors, so that windows
over the whole table would grow with its square.  Pairs are therefore sought
inside cells: a cell is made of the signs of some further projections, and the
cells are drawn anew in as many tables as the wanted recall takes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm.common import Scratch, connected_components

THRESHOLD = 0.9
PROJECTIONS, WINDOW, RECALL = 64, 0.6, 0.9995
#: Vectors wanted in a cell, and the most that are compared as one block.
CELL, BLOCK = 1024, 2048
SEED = 20
#: Rows verified at a time.
ROWS = 256


def calibrate(n: int, threshold: float = THRESHOLD) -> dict:
    """Signs in a cell, tables, and collisions a pair needs, for n vectors."""
    bits = min(30, max(0, math.ceil(math.log2(max(1, n) / CELL))))
    p = (1 - math.acos(threshold) / math.pi) ** bits
    tables = 1 if bits == 0 else math.ceil(math.log(1 - RECALL) / math.log(1 - p))
    q = math.erf(WINDOW / math.sqrt(2 - 2 * threshold) / math.sqrt(2))
    tail, least = 0.0, 0
    while True:
        tail += math.comb(PROJECTIONS, least) * q**least * (1 - q) ** (PROJECTIONS - least)
        if tail > (1 - RECALL) / 10:
            return {"bits": bits, "tables": tables, "least": least}
        least += 1


def directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((dim, n))


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def codes_of(unit: np.ndarray, signs: np.ndarray, bits: int) -> np.ndarray:
    """The cell of every row in each table that signs has directions of."""
    tables = signs.shape[1] // bits if bits else 1
    if not bits:
        return np.zeros((len(unit), tables), np.int32)
    return ((unit @ signs >= 0).reshape(len(unit), tables, bits) * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def _cells(dim: int, kind: str, plan: dict):
    """Maps (id, copies, vector) to the vector's bytes and its cell in each table."""
    bits, tables = plan["bits"], plan["tables"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = directions(dim, bits * tables, SEED + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            codes = codes_of(units(x.astype(np.float64)), signs, bits)
            raw = np.ascontiguousarray(x.astype(kind))
            offsets = np.arange(0, raw.nbytes + 1, raw.itemsize * dim, dtype=np.int32)
            vec = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
            lists = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, tables, dtype=np.int32), pa.array(codes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vec, lists], names=["id", "copies", "vec", "cells"])

    return run


def collisions(places: np.ndarray, least: int, window: float = WINDOW) -> np.ndarray:
    """Which pairs (row, column) lie in each other's windows on `least` projections or more.

    On every projection the rows are sorted; the rows inside a row's window are
    a run of that order, kept as a bitset: the difference of two prefixes.  The
    bitsets are summed by bit-sliced counters, so a pair is one bit a plane.
    """
    n, many = places.shape
    width = -(-n // 64)
    one = np.zeros((n, width), np.uint64)
    one[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
    prefix = np.zeros((n + 1, width), np.uint64)

    def inside(c: int) -> np.ndarray:
        p = places[:, c]
        order = np.argsort(p, kind="stable")
        np.bitwise_xor.accumulate(one[order], axis=0, out=prefix[1:])
        return prefix[np.searchsorted(p[order], p + window, side="right")] ^ prefix[np.searchsorted(p[order], p - window, side="left")]

    def full(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and carry of three planes."""
        x = a ^ b
        return x ^ c, (a & b) | (x & c)

    planes = [np.zeros((n, width), np.uint64) for _ in range(many.bit_length())]
    for c in range(0, many, 2):
        carry_in = inside(c)
        planes[0], carry = full(planes[0], carry_in, inside(c + 1)) if c + 1 < many else full(planes[0], carry_in, np.zeros_like(carry_in))
        for k in range(1, len(planes)):
            planes[k], carry = planes[k] ^ carry, planes[k] & carry
    more, equal = np.zeros((n, width), np.uint64), np.full((n, width), np.uint64(2**64 - 1))
    for k in reversed(range(len(planes))):
        if least >> k & 1:
            equal &= planes[k]
        else:
            more |= equal & planes[k]
            equal &= ~planes[k]
    return np.unpackbits((more | equal).view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)


def block_links(x: np.ndarray, lines: np.ndarray, signs: np.ndarray, plan: dict, table: int, across: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of one block's rows that are links and share a cell in no earlier table; across: each row's side, where only pairs of both count."""
    unit = units(x)
    near = np.triu(collisions((unit @ lines).astype(np.float32), plan["least"]), 1)
    if across is not None:
        near &= across[:, None] != across[None, :]
    for a in range(0, len(x), ROWS):
        own = near[a : a + ROWS]
        if own.any():
            own &= unit[a : a + ROWS] @ unit.T >= threshold
    i, j = np.nonzero(near)
    if table and len(i):
        codes = codes_of(unit, signs[:, : table * plan["bits"]], plan["bits"])
        step = max(1, 4_000_000 // table)
        new = np.concatenate([~(codes[i[a : a + step]] == codes[j[a : a + step]]).any(axis=1) for a in range(0, len(i), step)])
        i, j = i[new], j[new]
    return i, j


def classes_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that each of n rows reaches over the links (i, j)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _blocks(dim: int, kind: str, plan: dict, threshold: float):
    """Rows (t, cell, a, b, id, own, copies, vec) sorted by block to (u, v, n): vectors linked to u where v is null, else a spanning link."""
    names = ("t", "cell", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, signs = directions(dim, PROJECTIONS, SEED), directions(dim, plan["bits"] * plan["tables"], SEED + 1)
        held: pa.Table | None = None

        def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            key = np.stack([rows[c].to_numpy() for c in names], axis=1).astype(np.int64)
            edge = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            ids, own, copies = (rows[c].to_numpy() for c in ("id", "own", "copies"))
            vectors = np.frombuffer(b"".join(rows["vec"].to_pylist()), kind).reshape(-1, dim)
            for p, q in zip([0, *edge.tolist()], [*edge.tolist(), len(ids)]):
                if q - p < 2:
                    continue
                across = own[p:q] == key[p, 3] if key[p, 2] != key[p, 3] else None
                i, j = block_links(vectors[p:q].astype(np.float64), lines, signs, plan, int(key[p, 0]), across, threshold)
                if len(i):
                    node, weight = ids[p:q], copies[p:q]
                    n = np.bincount(i, weight[j], q - p) + np.bincount(j, weight[i], q - p)
                    low = classes_of(q - p, i, j)
                    at, tied = np.flatnonzero(n), np.flatnonzero(low != np.arange(q - p))
                    u = pa.array(np.concatenate([node[at], node[tied]]))
                    v = pa.array(np.concatenate([node[at], node[low[tied]]]), mask=np.arange(len(u)) < len(at))
                    yield pa.RecordBatch.from_arrays([u, v, pa.array(np.concatenate([n[at], np.zeros(len(tied))]).astype(np.int64))], names=["u", "v", "n"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            key = np.stack([held[c].to_numpy() for c in names], axis=1)
            other = np.flatnonzero((key != key[-1]).any(axis=1)) if len(key) else key
            if len(other):
                done = int(other[-1]) + 1
                yield from links(held.slice(0, done))
                held = held.slice(done)
        if held is not None and held.num_rows:
            yield from links(held)

    return run


def _links(nodes: DataFrame, dim: int, kind: str, threshold: float, tmp: Scratch) -> DataFrame:
    """(u, v, n) of nodes (node, v, copies) whose vectors have dim components."""
    plan = calibrate(nodes.count(), threshold)
    made = nodes.select(F.col("node").alias("id"), "copies", "v").mapInArrow(_cells(dim, kind, plan), "id long, copies long, vec binary, cells array<int>")
    cells = tmp.save(made)
    spread = cells.select("id", "copies", "vec", F.posexplode("cells").alias("t", "cell"))
    # only cells of several blocks are joined: as many as hold BLOCK rows at most
    hot = tmp.save(spread.groupBy("t", "cell").count().where(F.col("count") > BLOCK).select("t", "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    spread = spread.join(hot, ["t", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    spread = spread.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))
    key = ["t", "cell", "a", "b"]
    dealt = pairs.select(*key, "id", "own", "copies", "vec").repartition(*key).sortWithinPartitions(*key, "id")
    return dealt.mapInArrow(_blocks(dim, kind, plan, threshold), "u long, v long, n long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept): vectors linked where their cosine is at least threshold.

    Null, empty and zero vectors and those with null or non-finite components
    are linked with nothing, nor are vectors of different lengths compared.
    Equal vectors, by 128 bits of hashes, are one node that counts as many; a
    cell of more than BLOCK nodes is compared in blocks, pair by pair of them,
    so no task holds a whole hot cell, and a block gives a count for each vector
    and spanning links, not its pairs.  Rows that repeat an id are vectors of
    their own, of which the class is still named by the smallest id.  A null id
    is left out; other columns are not read; an empty table gives no row.
    """
    tmp = Scratch(vectors.sparkSession, "embeddings")
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v")).where("id is not null")
    unique = rows.groupBy("id").count().where(F.col("count") > 1).isEmpty()
    rows = rows.withColumn("key", F.col("id")) if unique else tmp.save(rows.withColumn("key", F.monotonically_increasing_id()))
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    named = rows.where("fine").select("id", "key", F.xxhash64("v").alias("h0"), F.xxhash64(F.lit("second"), "v").alias("h1"), "v")
    nodes = tmp.save(named.groupBy("h0", "h1").agg(F.min("key").alias("node"), F.count("*").alias("copies"), F.min_by("v", "key").alias("v")))
    dims = [r[0] for r in nodes.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    alone = rows.where("not fine").select("id", "key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("class"))
    if not dims:
        found = alone
    else:
        links = None
        for dim in dims:
            more = _links(nodes.where(F.size("v") == dim), dim, kind, threshold, tmp)
            links = more if links is None else links.union(more)
        links = tmp.save(links)
        classes = connected_components(links.where("v is not null").select("u", "v"), tmp)
        degree = links.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
        own = nodes.drop("v").join(degree, "node", "left").join(classes.withColumnRenamed("id", "node"), "node", "left")
        n_links = (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
        own = tmp.save(own.select("h0", "h1", n_links, F.coalesce("component_id", "node").alias("class")))
        found = named.drop("v").join(own, ["h0", "h1"]).select("id", "key", "n_links", "class").union(alone)
    if unique:
        found = found.withColumnRenamed("class", "component_id")
    else:
        found = tmp.save(found)
        least = tmp.save(found.groupBy("class").agg(F.min("id").alias("component_id")))
        found = found.join(least, "class")
    return found.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
