"""Optimizers over a function that gives loss and gradient, and training callbacks."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


@dataclass
class Optimizer:
    rate: float = 0.01
    max_iter: int = 1000
    tol: float = 1e-6
    history: list[float] = field(default_factory=list)

    def reset(self, n: int) -> None:
        """Clears the state for n parameters."""

    def step(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        return x - self.rate * g

    def minimize(self, f: Objective, start: np.ndarray) -> dict:
        x = np.asarray(start, float).copy()
        self.reset(len(x))
        self.history = []
        done = False
        for _ in range(self.max_iter):
            loss, g = f(x)
            self.history.append(float(loss))
            if np.linalg.norm(g) < self.tol:
                done = True
                break
            x = self._move(f, x, loss, g)
        return {"x": x, "loss": float(f(x)[0]), "iterations": len(self.history), "converged": done}

    def _move(self, f: Objective, x: np.ndarray, loss: float, g: np.ndarray) -> np.ndarray:
        return self.step(x, g)


@dataclass
class GradientDescent(Optimizer):
    """With line_search, steps shrink by 0.8 until the loss falls by 0.3 of what the slope promises."""

    line_search: bool = False

    def _move(self, f, x, loss, g):
        if not self.line_search:
            return self.step(x, g)
        t, slope = 1.0, float(g @ g)
        while t > 1e-12 and f(x - t * g)[0] > loss - 0.3 * t * slope:
            t *= 0.8
        return x - t * g


@dataclass
class Momentum(Optimizer):
    momentum: float = 0.9

    def reset(self, n):
        self.v = np.zeros(n)

    def step(self, x, g):
        self.v = self.momentum * self.v - self.rate * g
        return x + self.v


@dataclass
class RMSProp(Optimizer):
    decay: float = 0.9

    def reset(self, n):
        self.s = np.zeros(n)

    def step(self, x, g):
        self.s = self.decay * self.s + (1 - self.decay) * g * g
        return x - self.rate * g / (np.sqrt(self.s) + 1e-8)


@dataclass
class Adam(Optimizer):
    beta1: float = 0.9
    beta2: float = 0.999

    def reset(self, n):
        self.m, self.v, self.t = np.zeros(n), np.zeros(n), 0

    def step(self, x, g):
        self.t += 1
        self.m = self.beta1 * self.m + (1 - self.beta1) * g
        self.v = self.beta2 * self.v + (1 - self.beta2) * g * g
        return x - self.rate * (self.m / (1 - self.beta1**self.t)) / (np.sqrt(self.v / (1 - self.beta2**self.t)) + 1e-8)


OPTIMIZERS = {"gd": GradientDescent, "sgd": GradientDescent, "momentum": Momentum, "rmsprop": RMSProp, "adam": Adam}


def create_optimizer(name: str, **options) -> Optimizer:
    if name not in OPTIMIZERS:
        raise ValueError(f"no optimizer {name}; known: {', '.join(OPTIMIZERS)}")
    return OPTIMIZERS[name](**options)


@dataclass
class EarlyStopping:
    patience: int = 10
    min_delta: float = 0.0
    best: float = math.inf
    waited: int = 0
    stop: bool = False

    def __call__(self, epoch: int, loss: float, params, optimizer) -> None:
        if loss < self.best - self.min_delta:
            self.best, self.waited = loss, 0
        else:
            self.waited += 1
            self.stop = self.waited >= self.patience


@dataclass
class ModelCheckpoint:
    best: float = math.inf
    params: object = None
    epoch: int = -1

    def __call__(self, epoch: int, loss: float, params, optimizer) -> None:
        if loss < self.best:
            self.best, self.params, self.epoch = loss, np.array(params, copy=True), epoch


def learning_rate_scheduler(schedule: Callable[[int], float]):
    def call(epoch: int, loss: float, params, optimizer: Optimizer) -> None:
        optimizer.rate = schedule(epoch)

    return call


def train_function(f: Objective, start: np.ndarray, optimizer: str | Optimizer = "adam", epochs: int = 1000, callbacks: tuple = (), **options) -> dict:
    """Steps of an optimizer with callbacks (epoch, loss, parameters, optimizer); one whose stop is true ends the run."""
    opt = create_optimizer(optimizer, **options) if isinstance(optimizer, str) else optimizer
    x = np.asarray(start, float).copy()
    opt.reset(len(x))
    losses = []
    for epoch in range(epochs):
        loss, g = f(x)
        losses.append(float(loss))
        for c in callbacks:
            c(epoch, loss, x, opt)
        if any(getattr(c, "stop", False) for c in callbacks):
            break
        x = opt.step(x, g)
    return {"x": x, "losses": losses, "epochs": len(losses)}


def train(objective: Callable, df: DataFrame, columns: list[str], y: str, id_col: str, start: np.ndarray, optimizer: str | Optimizer = "adam", epochs: int = 100, batches: int = 1, callbacks: tuple = (), seed: int = 0, **options) -> dict:
    """Mini-batch descent on all rows of a table: objective(parameters, x, y) gives the sum of losses and its gradient over an array of
    rows. Each epoch deals the rows anew into batches by a hash; a batch is one aggregation, of one row a partition. Callbacks are
    those of train_function(); one whose stop is true ends the run."""
    made = create_optimizer(optimizer, **options) if isinstance(optimizer, str) else optimizer
    params, history, p = np.asarray(start, float).copy(), [], len(columns)
    rows = df.select(F.col(id_col).alias("id"), *(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate([*columns, y]))).dropna().persist()
    names = [f"x{k}" for k in range(p + 1)]
    made.reset(len(params))

    def partial(now: np.ndarray):
        def run(frames):
            n, loss, slope = 0, 0.0, np.zeros(len(now))
            for f in frames:
                data = f[names].to_numpy(float)
                own, g = objective(now, data[:, :p], data[:, p])
                n, loss, slope = n + len(data), loss + float(own), slope + g
            if n:
                yield pd.DataFrame({"n": [n], "loss": [loss], "g": [slope.tolist()]})

        return run

    for epoch in range(epochs):
        total, count = 0.0, 0
        for b in range(batches):
            part = rows if batches == 1 else rows.where(F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), "id"), F.lit(batches)) == b)
            got = part.mapInPandas(partial(params), "n long, loss double, g array<double>").collect()
            n = sum(r["n"] for r in got)
            if n:
                params = made.step(params, np.sum([r["g"] for r in got], axis=0) / n)
                total, count = total + sum(r["loss"] for r in got), count + n
        history.append(total / max(1, count))
        for call in callbacks:
            call(epoch, history[-1], params, made)
        if any(getattr(call, "stop", False) for call in callbacks):
            break
    rows.unpersist()
    return {"params": params, "loss": history[-1] if history else math.nan, "history": history, "epochs": len(history)}
