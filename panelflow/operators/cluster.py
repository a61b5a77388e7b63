"""Rolling clusters: trailing features, eligibility, scaling, k-means by date, cluster series."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.sources.writers import save


def window_features(full: DataFrame, window: int, share: float, k: int, rebalance: int = 1) -> DataFrame:
    """(i, algo_id, ret_total, volatility) of eligible series at each rebalance row, over the `window` rows before it.

    Eligible: active in more than `share` of those rows.  Rows with fewer than k eligible series are left out.
    """
    w = Window.partitionBy("algo_id").orderBy("i").rowsBetween(-window, -1)
    rows = full.select("i", "algo_id", (F.product(1 + F.col("ret")).over(w) - 1).alias("ret_total"), F.stddev_samp("ret").over(w).alias("volatility"), (F.sum(F.col("active").cast("int")).over(w) / window).alias("live"))
    rows = rows.where((F.col("i") >= window) & (F.col("live") > share) & ((F.col("i") - window) % rebalance == 0))
    enough = rows.groupBy("i").count().where(F.col("count") >= k).select("i")
    return rows.join(enough, "i", "left_semi").select("i", "algo_id", F.coalesce("ret_total", F.lit(0.0)).alias("ret_total"), F.coalesce("volatility", F.lit(0.0)).alias("volatility"))


def scaled(features: DataFrame) -> DataFrame:
    """(i, algo_id, x, y): ret_total and volatility less their mean over the date, by population deviation, 1 if that is 0; 9 decimals."""
    w = Window.partitionBy("i")
    unit = lambda c: F.round((F.col(c) - F.avg(c).over(w)) / F.when(F.stddev_pop(c).over(w) == 0, 1.0).otherwise(F.stddev_pop(c).over(w)), 9)
    return features.select("i", "algo_id", unit("ret_total").alias("x"), unit("volatility").alias("y"))


#: Coordinates are whole numbers of this part, so that sums, and with them centres, are the same in whatever order.
UNIT = 1_000_000_000


def _distances() -> Column:
    """Squared distances of a point (x, y) from the centres in the arrays cx, cy."""
    return F.zip_with("cx", "cy", lambda a, b: (F.col("x") - a) * (F.col("x") - a) + (F.col("y") - b) * (F.col("y") - b))


def seed(points: DataFrame, k: int, starts: int) -> DataFrame:
    """(i, start, cx, cy): k centres a date and start, all dates and starts at once, one aggregate a centre.

    Start 0 is farthest-first: the point nearest the date's mean, then always
    the one farthest from its nearest centre.  The others draw each centre with
    odds in proportion to that squared distance: of exponential waiting times
    -ln(u) / distance the shortest wins, u drawn by a digest of date, start,
    centre and id.  Ties go to the lowest id.
    """
    race = points.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))

    def drawn(step: int) -> Column:
        digest = F.md5(F.concat_ws(":", "i", "start", F.lit(step), F.col("algo_id")).cast("binary"))
        return -F.log((F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 1) / 4294967297.0)

    best = lambda key: F.min(F.struct(key.alias("key"), "algo_id", "x", "y")).alias("p")
    first = F.when(F.col("start") == 0, F.col("x") * F.col("x") + F.col("y") * F.col("y")).otherwise(drawn(0))
    state = race.groupBy("i", "start").agg(best(first)).select("i", "start", F.array("p.x").alias("cx"), F.array("p.y").alias("cy"))
    # each step is written: adaptive execution plans a chain of k joins anew for each of its stages
    for step in range(1, k):
        near = F.array_min(_distances())
        key = F.when(F.col("start") == 0, -near).when(near > 0, drawn(step) / F.nullif(near, F.lit(0.0))).otherwise(F.lit(1e308))
        state = save(state, "centres")
        found = points.join(state, "i").groupBy("i", "start").agg(best(key), F.first("cx").alias("cx"), F.first("cy").alias("cy"))
        state = found.select("i", "start", F.concat("cx", F.array("p.x")).alias("cx"), F.concat("cy", F.array("p.y")).alias("cy"))
    return state


def lloyd(points: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """The centres after one more round, and whether any moved.

    Points are summed by cluster before the shuffle, which carries a row a date,
    start and cluster of each task; an empty cluster keeps its centre.
    """
    rows = points.join(state.select("i", "start", "cx", "cy"), "i").withColumn("d", _distances())
    own = rows.withColumn("own", (F.array_position("d", F.array_min("d")) - 1).cast("int"))
    sums = own.groupBy("i", "start", "own").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("long")).alias("x"), F.sum(F.col("y").cast("long")).alias("y"))
    means = sums.groupBy("i", "start").agg(F.map_from_entries(F.collect_list(F.struct("own", F.struct((F.col("x") / F.col("n")).alias("x"), (F.col("y") / F.col("n")).alias("y"))))).alias("m"))
    mean = lambda v: F.transform(f"c{v}", lambda old, c: F.coalesce(F.try_element_at("m", c)[v], old))
    new = state.select("i", "start", "cx", "cy").join(means, ["i", "start"]).select("i", "start", "cx", "cy", mean("x").alias("nx"), mean("y").alias("ny"))
    return new.select("i", "start", F.col("nx").alias("cx"), F.col("ny").alias("cy"), ((F.col("cx") != F.col("nx")) | (F.col("cy") != F.col("ny"))).alias("moved"))


def _near(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest centre, the lowest of equals, and its squared distance; as _distances works them out."""
    own, least = np.zeros(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), 8192):
        px, py, o, d = x[at : at + 8192], y[at : at + 8192], own[at : at + 8192], least[at : at + 8192]
        d[:] = (px - cx[0]) * (px - cx[0]) + (py - cy[0]) * (py - cy[0])
        for c in range(1, len(cx)):
            dx, dy = px - cx[c], py - cy[c]
            other = dx * dx + dy * dy
            o[other < d] = c
            np.minimum(d, other, out=d)
    return own, least


_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [int(abs(math.sin(j + 1)) * 2**32) for j in range(64)]


def _md5_heads(blocks: np.ndarray) -> np.ndarray:
    """The first four bytes, as a number, of the MD5 of padded blocks (a row of 64 bytes a message), many rows at once."""
    out, u = np.empty(len(blocks), np.uint32), np.uint32
    for at in range(0, len(blocks), 16384):
        w = np.ascontiguousarray(blocks[at : at + 16384].view("<u4").T)
        a, b, c, d = (np.full(w.shape[1], v, u) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
        f, high = np.empty_like(a), np.empty_like(a)
        for j in range(64):
            if j < 32:
                p, q, r, g = (b, c, d, j) if j < 16 else (d, b, c, (5 * j + 1) % 16)
                np.bitwise_xor(q, r, out=f)
                f &= p
                f ^= r
            elif j < 48:
                np.bitwise_xor(b, c, out=f)
                f ^= d
                g = (3 * j + 5) % 16
            else:
                np.invert(d, out=f)
                f |= b
                f ^= c
                g = 7 * j % 16
            f += a
            f += u(_SINES[j])
            f += w[g]
            np.right_shift(f, u(32 - _TURNS[j]), out=high)
            f <<= u(_TURNS[j])
            f |= high
            f += b
            a, b, c, d, f = d, f, b, c, a
        out[at : at + 16384] = a + u(0x67452301)
    return out.byteswap()


def _blocks(head: int, tails: list[bytes]) -> np.ndarray | None:
    """Padded blocks of messages that end in tails, their first bytes left free for a head; None if one is too long for a block."""
    lengths = np.fromiter(map(len, tails), np.int64, len(tails)) + head
    if lengths.max() > 55:
        return None
    widest = max(1, int(lengths.max()) - head)
    blocks = np.zeros((len(tails), 64), np.uint8)
    blocks[:, head : head + widest] = np.array(tails, f"S{widest}").view(np.uint8).reshape(-1, widest)
    blocks[np.arange(len(tails)), lengths] = 0x80
    blocks[:, 56:] = (lengths * 8).astype("<u8").view(np.uint8).reshape(-1, 8)
    return blocks


def _draw(head: bytes, tails: list[bytes], kept: dict[int, np.ndarray | None]) -> np.ndarray:
    """Exponential waiting times, drawn by the digests of head and each tail; kept holds the blocks for heads of a length."""
    if len(head) not in kept:
        kept.clear()
        kept[len(head)] = _blocks(len(head), tails)
    blocks = kept[len(head)]
    if blocks is None:
        firsts = np.frombuffer(b"".join([hashlib.md5(head + t).digest()[:4] for t in tails]), ">u4")
    else:
        blocks[:, : len(head)] = np.frombuffer(head, np.uint8)
        firsts = _md5_heads(blocks)
    return -np.log((firsts.astype(float) + 1) / 4294967297.0)


def _seed_date(x: np.ndarray, y: np.ndarray, tails: list[bytes], kept: dict, i: int, start: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """What `seed` draws for a date and start, of points in order of their ids."""
    drawn = lambda step: _draw(f"{i}:{start}:{step}".encode(), tails, kept)
    chosen = [int(np.argmin(drawn(0) if start else x * x + y * y))]
    near = np.full(len(x), np.inf)
    for step in range(1, k):
        dx, dy = x - x[chosen[-1]], y - y[chosen[-1]]
        near = np.minimum(near, dx * dx + dy * dy)
        key = np.divide(drawn(step), near, out=np.full(len(x), 1e308), where=near > 0) if start else -near
        chosen.append(int(np.argmin(key)))
    return x[chosen], y[chosen]


def _label_date(points: pa.Table, k: int, rounds: int | None, starts: int, most: int) -> pa.Table:
    """(i, algo_id, cluster) of one date's points: all starts to their end, the one of least inertia."""
    points = points.take(pc.sort_indices(points["algo_id"], null_placement="at_start"))
    ids = pc.cast(points["algo_id"], pa.string()).to_pylist() if starts > 1 else []
    tails, kept = [b"" if a is None else f":{a}".encode() for a in ids], {}
    x, y, i = points["x"].to_numpy(), points["y"].to_numpy(), points["i"][0].as_py()
    wx, wy, best = x.astype(np.int64), y.astype(np.int64), None
    for start in range(starts):
        cx, cy = _seed_date(x, y, tails, kept, i, start, k)
        for _ in range(most if rounds is None else rounds):
            own, _d = _near(x, y, cx, cy)
            n, sx, sy = np.bincount(own, minlength=k), np.zeros(k, np.int64), np.zeros(k, np.int64)
            np.add.at(sx, own, wx)
            np.add.at(sy, own, wy)
            nx, ny = (np.where(n > 0, s / np.maximum(n, 1), c) for s, c in ((sx, cx), (sy, cy)))
            rests = rounds is None and (nx == cx).all() and (ny == cy).all()
            cx, cy = nx, ny
            if rests:
                break
        own, least = _near(x, y, cx, cy)
        inertia = round(float((least / (float(UNIT) * UNIT)).sum()), 9)
        if best is None or inertia < best[0]:
            best = inertia, own, cx, cy
    _, own, cx, cy = best
    rank = np.empty(k, np.int32)
    rank[np.lexsort((np.arange(k), cx, cy))] = np.arange(k)
    return pa.table({"i": points["i"], "algo_id": points["algo_id"], "cluster": rank[own]})


#: Points of a date that one task takes, with some 300 bytes each; a date of more goes through joined rounds.
TASK_POINTS = 1_000_000


def kmeans(points: DataFrame, k: int, rounds: int | None = None, starts: int = 1, most: int = 300, task_points: int = TASK_POINTS) -> DataFrame:
    """(i, algo_id, cluster), written: Lloyd's rounds of every date and start; each date keeps the start of least inertia.

    With rounds every start takes as many; without, a start goes on until its
    centres rest, `most` rounds at the most.  Inertias are compared at nine
    digits, the lowest start wins a tie.  Clusters are numbered by (y, x) of
    their centres.  Dates know nothing of each other: a date of up to
    task_points goes to a task, which takes it through all its rounds, so there
    are as many jobs for a hundred rounds as for one.  The points of a larger
    date stay spread over tasks, and each round is a join.  Both give the same.
    """
    whole = lambda v: F.round(F.col(v) * UNIT).cast("long").cast("double").alias(v)
    points = save(points.select("i", "algo_id", whole("x"), whole("y")), "points")
    sizes = points.groupBy("i").count()
    dates, largest = sizes.agg(F.count("*"), F.coalesce(F.max("count"), F.lit(0))).first()
    schema = f"i {points.schema['i'].dataType.simpleString()}, algo_id {points.schema['algo_id'].dataType.simpleString()}, cluster int"
    large = F.broadcast(sizes.where(F.col("count") > task_points).select("i"))
    small = points if largest <= task_points else points.join(large, "i", "left_anti")
    # as many partitions as dates, so that a task holds one or a few
    small = small.repartition(max(1, min(dates, 1000)), "i").groupBy("i").applyInArrow(lambda date: _label_date(date, k, rounds, starts, most), schema)
    if largest > task_points:
        small = small.union(_spread_kmeans(save(points.join(large, "i", "left_semi"), "points"), k, rounds, starts, most))
    return save(small, "labels")


def _spread_kmeans(points: DataFrame, k: int, rounds: int | None, starts: int, most: int) -> DataFrame:
    """kmeans of dates that no task should hold, all dates and starts together.

    Starts that rest leave the loop.  What is read again and again is written
    to the shared folder, so lost executors lose no round.
    """
    state, rested, done = save(seed(points, k, starts), "centres"), None, 0
    while done != (most if rounds is None else rounds):
        now, done = save(lloyd(points, state, k), "centres"), done + 1
        if rounds is None:
            still = now.where("not moved").drop("moved")
            rested = still if rested is None else rested.union(still)
            state = now.where("moved").drop("moved")
            if state.isEmpty():
                break
        else:
            state = now.drop("moved")
    # written, so that what follows does not plan a union of all rounds anew for each of its stages
    state = state if rested is None else save(rested.union(state), "centres")
    order = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.struct(F.get("cy", c).alias("y"), F.get("cx", c).alias("x"), c.alias("c")))), lambda s: s["c"])
    if starts > 1:
        inertia = points.join(state, "i").groupBy("i", "start").agg(F.sum(F.array_min(_distances()) / (float(UNIT) * UNIT)).alias("s"), F.first("cx").alias("cx"), F.first("cy").alias("cy"))
        state = inertia.groupBy("i").agg(F.min(F.struct(F.round("s", 9).alias("s"), "start", "cx", "cy")).alias("b")).select("i", "b.cx", "b.cy")
    labelled = points.join(state.select("i", "cx", "cy", order.alias("order")), "i").withColumn("d", _distances())
    return labelled.select("i", "algo_id", (F.array_position("order", (F.array_position("d", F.array_min("d")) - 1).cast("int")) - 1).cast("int").alias("cluster"))


def cluster_returns(labels: DataFrame, rets: DataFrame, times: DataFrame, k: int, rebalance: int = 1) -> DataFrame:
    """(ts, i, cluster, ret): equal-weight return of each cluster's members, 0 for those without a row and for empty clusters.

    Labels of row r hold for rows r to r + rebalance - 1.
    """
    held = labels.withColumn("i", F.explode(F.sequence(F.col("i"), F.col("i") + rebalance - 1)))
    mean = held.join(rets.select("i", "algo_id", "ret"), ["i", "algo_id"], "left").groupBy("i", "cluster").agg((F.sum(F.coalesce("ret", F.lit(0.0))) / F.count("*")).alias("ret"))
    grid = held.select("i").distinct().withColumn("cluster", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return grid.join(mean, ["i", "cluster"], "left").join(times, "i").select("ts", "i", "cluster", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def cluster_features(series: DataFrame, window: int = 20) -> DataFrame:
    """series with vol and mom: sample deviation and sum over `window` rows, the current included; 0 before there are as many."""
    w = Window.partitionBy("cluster").orderBy("i").rowsBetween(1 - window, 0)
    full = F.count("*").over(w) == window
    return series.withColumn("vol", F.when(full, F.stddev_samp("ret").over(w)).otherwise(0.0)).withColumn("mom", F.when(full, F.sum("ret").over(w)).otherwise(0.0))


def wide(features: DataFrame, k: int) -> DataFrame:
    """One row a time with C0_Ret, C0_Vol, C0_Mom, C1_Ret, ..."""
    out = features.groupBy("ts", "i").pivot("cluster", list(range(k))).agg(F.first("ret").alias("Ret"), F.first("vol").alias("Vol"), F.first("mom").alias("Mom"))
    return out.select("ts", "i", *(F.col(f"{c}_{x}").alias(f"C{c}_{x}") for c in range(k) for x in ("Ret", "Vol", "Mom")))


def observations(features: DataFrame, indicators: DataFrame, window: int, block: int = 256) -> DataFrame:
    """(ts, i, obs): the `window` rows before each, as arrays of cluster values then indicators.

    Rows go to tasks by blocks of i, and those that the next block's first rows
    look back on go there too.
    """
    row = features.groupBy("ts", "i").agg(F.array_sort(F.collect_list(F.struct("cluster", "ret", "vol", "mom"))).alias("c"))
    flat = F.concat(F.flatten(F.transform("c", lambda s: F.array(s["ret"], s["vol"], s["mom"]))), F.array("syn_mkt_ret", "syn_vix", "syn_breadth"))
    block = max(block, window)
    own = F.floor(F.col("i") / block)
    near = F.when(F.pmod("i", F.lit(block)) >= block - window, F.array(own, own + 1)).otherwise(F.array(own))
    rows = row.join(indicators.drop("i"), "ts").select("ts", "i", flat.alias("v"), own.alias("own"), F.explode(near).alias("block"))
    w = Window.partitionBy("block").orderBy("i").rowsBetween(-window, -1)
    rows = rows.withColumn("obs", F.collect_list("v").over(w)).where(F.col("own") == F.col("block"))
    return rows.where(F.size("obs") == window).select("ts", "i", "obs")
