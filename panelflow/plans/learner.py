"""The learned policy: clipped policy-gradient training, one fold a task, and its weights as a table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from panelflow.config import EngineConfig
from panelflow.plans.policy import Network, flat

#: The learner's settings.
RATE, STEPS, BATCH, EPOCHS, ENTROPY, GAMMA, LAMBDA, CLIP, VALUE, NORM = 2e-4, 2048, 64, 10, 0.01, 0.99, 0.95, 0.2, 0.5, 0.5
WEIGHTS = "fold string, layer int, rows int, cols int, w array<double>, b array<double>"


def _forward(layers: list, x: np.ndarray) -> list[np.ndarray]:
    """Inputs of every layer, then the output; hidden layers are tanh."""
    acts = [x]
    for i, (w, b) in enumerate(layers):
        x = x @ w + b
        acts.append(np.tanh(x) if i + 1 < len(layers) else x)
    return acts


def _backward(layers: list, acts: list[np.ndarray], grad: np.ndarray) -> list[np.ndarray]:
    out = []
    for i in reversed(range(len(layers))):
        out += [grad.sum(axis=0), acts[i].T @ grad]
        if i:
            grad = (grad @ layers[i][0].T) * (1 - acts[i] ** 2)
    return out[::-1]


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = ([np.zeros_like(p) for p in params] for _ in range(2))

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        scale = min(1.0, NORM / (norm + 1e-8))
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            m += 0.1 * (scale * g - m)
            v += 0.001 * ((scale * g) ** 2 - v)
            p -= rate * m / (np.sqrt(v) + 1e-8)


def rewards(actions: np.ndarray, before: np.ndarray, rets: np.ndarray, bench: np.ndarray, cfg: EngineConfig) -> tuple[np.ndarray, np.ndarray]:
    """Rewards of steps in order, as the simulator gives them, and their weights; before: the weights held at the first, rows of none start from cash."""
    e = np.exp(np.clip(actions, 0.0, 1.0))
    w = e / e.sum(axis=1, keepdims=True)
    held = np.vstack([before, w[:-1]])
    turnover = np.abs(w - held).sum(axis=1) * cfg.leverage
    got = cfg.leverage * (w[:, :-1] * rets).sum(axis=1) - turnover * cfg.cost_rate
    raw = (got - bench) * 10 - np.where(got < -0.02, np.abs(got) * 50, 0.0) - turnover * cfg.turnover_penalty
    return np.clip(raw, -10, 10), w


def learn(x: np.ndarray, rets: np.ndarray, bench: np.ndarray, cfg: EngineConfig, seed: int = 42) -> Network:
    """A network trained for cfg.train_steps steps over an episode's rows, again and again from cash.

    Observations don't depend on actions, so the STEPS steps of a round are made
    at once; then EPOCHS passes over them in batches.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    outputs = rets.shape[1] + 1
    actor, critic = Network(x.shape[1], outputs, seed=seed), Network(x.shape[1], 1, seed=seed + 1)
    spread = np.full(outputs, -1.0)
    adam = Adam([*(p for layer in actor.layers for p in layer), *(p for layer in critic.layers for p in layer), spread], RATE)
    cash, at = np.eye(outputs)[-1:], 0
    held = cash
    for _ in range(-(-cfg.train_steps // STEPS)):
        pos = (at + np.arange(STEPS + 1)) % len(x)
        mean, value = _forward(actor.layers, x[pos])[-1][:-1], _forward(critic.layers, x[pos])[-1][:, 0]
        action = mean + np.exp(spread) * rng.standard_normal(mean.shape)
        old = -(((action - mean) / np.exp(spread)) ** 2 / 2 + spread).sum(axis=1)
        reward, begin = np.empty(STEPS), 0
        for end in [*(np.flatnonzero(pos[:-1] == len(x) - 1) + 1).tolist(), STEPS]:
            if end > begin:
                part = pos[begin:end]
                reward[begin:end], w = rewards(action[begin:end], held, rets[part], bench[part], cfg)
                held = cash if part[-1] == len(x) - 1 else w[-1:]
                begin = end
        done = pos[:-1] == len(x) - 1
        gain, last = np.empty(STEPS), 0.0
        for i in reversed(range(STEPS)):
            more = 0.0 if done[i] else 1.0
            last = reward[i] + GAMMA * value[i + 1] * more - value[i] + GAMMA * LAMBDA * more * last
            gain[i] = last
        wanted, own, at = gain + value[:-1], pos[:-1], int(pos[-1])
        for _ in range(EPOCHS):
            order = rng.permutation(STEPS)
            for b in np.split(order, STEPS // BATCH):
                acts, vals = _forward(actor.layers, x[own[b]]), _forward(critic.layers, x[own[b]])
                z = (action[b] - acts[-1]) / np.exp(spread)
                ratio = np.exp(-(z**2 / 2 + spread).sum(axis=1) - old[b])
                g = (gain[b] - gain[b].mean()) / (gain[b].std() + 1e-8)
                free = np.where(g >= 0, ratio <= 1 + CLIP, ratio >= 1 - CLIP)
                pull = -(g * ratio * free)[:, None] / len(b)
                grads = _backward(actor.layers, acts, pull * z / np.exp(spread))
                grads += _backward(critic.layers, vals, VALUE * 2 * (vals[-1] - wanted[b][:, None]) / len(b))
                adam.step([*grads, (pull * (z**2 - 1)).sum(axis=0) - ENTROPY])
    return actor


def train_folds(rows: DataFrame, cfg: EngineConfig, seed: int = 42) -> DataFrame:
    """The trained weights (fold, layer, rows, cols, w, b) of rows (fold, ts, obs, rets, bench_ret): a fold is trained by one task, all at once.

    A fold holds a row a date; a fold without rows gives no weights.
    """

    def fit(fold: pd.DataFrame) -> pd.DataFrame:
        fold = fold.sort_values("ts")
        net = learn(flat(fold["obs"]), np.stack(fold["rets"].to_numpy()), fold["bench_ret"].to_numpy(), cfg, seed)
        name = fold["fold"].iloc[0]
        made = [(name, i, *w.shape, w.reshape(-1).tolist(), b.tolist()) for i, (w, b) in enumerate(net.layers)]
        return pd.DataFrame(made, columns=["fold", "layer", "rows", "cols", "w", "b"])

    return rows.select("fold", "ts", "obs", "rets", "bench_ret").groupBy("fold").applyInPandas(fit, WEIGHTS)


def network(weights: DataFrame, fold: str) -> Network:
    """A fold's network from its table; a few layers reach the driver."""
    found = sorted(weights.where(weights["fold"] == fold).collect(), key=lambda r: r["layer"])
    out = Network.__new__(Network)
    out.layers = [(np.array(r["w"]).reshape(r["rows"], r["cols"]), np.array(r["b"])) for r in found]
    return out


def save(weights: DataFrame, path: str) -> None:
    weights.write.mode("overwrite").parquet(path)


def load(spark, path: str, fold: str) -> Network:
    return network(spark.read.schema(WEIGHTS).parquet(path), fold)
