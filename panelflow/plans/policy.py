"""Policies: actions as columns of the features known before a step."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def equal(rows: DataFrame) -> DataFrame:
    return rows.withColumn("action", F.array_repeat(F.lit(0.5), F.size("rets") + 1))


def momentum(rows: DataFrame, scale: float = 20.0) -> DataFrame:
    """Scores 0.5 + scale * momentum of the row before, held to [0, 1]; cash 0.5.  rows has keys fold, ts and arrays rets, moms."""
    before = F.lag("moms").over(Window.partitionBy("fold").orderBy("ts"))
    score = F.transform(F.coalesce(F.col("_m"), F.transform("rets", lambda r: F.lit(0.0))), lambda m: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + scale * m)))
    return rows.withColumn("_m", before).withColumn("action", F.concat(score, F.array(F.lit(0.5)))).drop("_m")


class Network:
    """A tanh network of two hidden layers from an observation's rows, one after another, to scores, held to [0, 1]."""

    def __init__(self, inputs: int, outputs: int, hidden: int = 128, seed: int = 42):
        rng = np.random.Generator(np.random.PCG64(seed))
        sizes = [(inputs, hidden), (hidden, hidden), (hidden, outputs)]
        self.layers = [(rng.standard_normal(s) / np.sqrt(s[0]), np.zeros(s[1])) for s in sizes]
        w, b = self.layers[-1]
        self.layers[-1] = (0.01 * w, b + 0.5)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(self.layers):
            x = x @ w + b
            if i + 1 < len(self.layers):
                x = np.tanh(x)
        return np.clip(x, 0.0, 1.0)

    @classmethod
    def patterned(cls, inputs: int, outputs: int, hidden: int) -> Network:
        """A network whose weights are sines of their places: any engine can make the same."""
        out = cls(inputs, outputs, hidden)
        at = lambda shape, k: np.sin(1.0 + 3.0 * np.arange(shape[0])[:, None] + 7.0 * np.arange(shape[1])[None, :] + 11.0 * k) / np.sqrt(shape[0])
        out.layers = [(at(w.shape, k), np.full(len(b), 0.5 if k == 2 else 0.0)) for k, (w, b) in enumerate(out.layers)]
        return out


def flat(observations: Iterable) -> np.ndarray:
    """A row an observation: all rows of its window, the oldest first."""
    return np.stack([np.concatenate([np.asarray(row, float) for row in o]) for o in observations])


def roll_out(network: Network, observations: DataFrame) -> DataFrame:
    """(ts, action) by the network over (ts, obs), deterministic, in Arrow batches."""

    def act(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield pd.DataFrame({"ts": rows["ts"], "action": list(network(flat(rows["obs"])))})

    return observations.select("ts", "obs").mapInPandas(act, "ts timestamp, action array<double>")
