"""Pipelines of estimators, parameter search, and several models side by side."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import total
from ..operators.splits import cross_validate, k_fold


@dataclass
class Pipeline:
    """(name, step) in order; steps have fit(df) and transform(df), the last one predict(df) instead."""

    steps: list[tuple[str, object]]
    fitted: bool = False

    def fit(self, df: DataFrame) -> Pipeline:
        for k, (_, s) in enumerate(self.steps):
            s.fit(df)
            if k < len(self.steps) - 1:
                df = s.transform(df)
        self.fitted = True
        return self

    def _through(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            raise RuntimeError("fit() comes first")
        for _, s in self.steps[:-1]:
            df = s.transform(df)
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        return self.steps[-1][1].transform(self._through(df))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.steps[-1][1].predict(self._through(df))


def parameter_grid(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]


class distributions:  # noqa: N801
    """Descriptions of parameter distributions."""

    @staticmethod
    def uniform(low: float, high: float) -> dict:
        return {"type": "uniform", "low": low, "high": high}

    @staticmethod
    def loguniform(low: float, high: float) -> dict:
        return {"type": "loguniform", "low": low, "high": high}

    @staticmethod
    def randint(low: int, high: int) -> dict:
        return {"type": "randint", "low": low, "high": high}

    @staticmethod
    def choice(options: list) -> dict:
        return {"type": "choice", "options": options}


def sample_from(d, rng: np.random.Generator):
    if isinstance(d, list):
        return d[int(rng.integers(len(d)))]
    if d["type"] == "uniform":
        return float(rng.uniform(d["low"], d["high"]))
    if d["type"] == "loguniform":
        return float(math.exp(rng.uniform(math.log(d["low"]), math.log(d["high"]))))
    if d["type"] == "randint":
        return int(rng.integers(d["low"], d["high"]))
    return d["options"][int(rng.integers(len(d["options"])))]


def _search(fit: Callable, score: Callable, df: DataFrame, id_col: str, candidates: list[dict], cv: int, shuffle: bool, seed: int) -> dict:
    folds = k_fold(df, id_col, cv, shuffle, seed).persist()
    results = []
    for params in candidates:
        try:
            got = cross_validate(lambda d, p=params: fit(d, **p), score, folds)
        except (ValueError, ArithmeticError, np.linalg.LinAlgError):
            got = {"scores": [], "mean": -math.inf, "std": math.nan}
        results.append({"params": params, **got})
    folds.unpersist()
    best = max(results, key=lambda r: r["mean"])  # the first of equal ones
    return {"results": results, "best_params": best["params"], "best_score": best["mean"], "best_model": fit(df, **best["params"])}


def grid_search_cv(fit: Callable, score: Callable, df: DataFrame, id_col: str, grid: dict[str, list], cv: int = 5, shuffle: bool = False, seed: int = 0) -> dict:
    """fit(train, **params) and score(model, test); higher is better. A combination that fails scores -Infinity."""
    return _search(fit, score, df, id_col, parameter_grid(grid), cv, shuffle, seed)


def random_search_cv(fit: Callable, score: Callable, df: DataFrame, id_col: str, dists: dict, n_iter: int = 20, cv: int = 5, seed: int = 0) -> dict:
    rng = np.random.default_rng(seed)
    return _search(fit, score, df, id_col, [{k: sample_from(d, rng) for k, d in dists.items()} for _ in range(n_iter)], cv, True, seed)


class GridSearchCV:
    def __init__(self, fit: Callable, grid: dict[str, list], score: Callable, cv: int = 5):
        self.fit_function, self.grid, self.score, self.cv = fit, grid, score, cv

    def fit(self, df: DataFrame, id_col: str) -> GridSearchCV:
        vars(self).update(grid_search_cv(self.fit_function, self.score, df, id_col, self.grid, self.cv))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return self.best_model.predict(df)


@dataclass
class BranchPipeline:
    """Several fitted models on the same rows; combiner: vote, weighted_vote, average, max, min, or a function of columns."""

    branches: dict[str, object]
    combiner: str | Callable = "vote"
    weights: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> BranchPipeline:
        for b in self.branches.values():
            b.fit(df)
        return self

    def _all(self, df: DataFrame) -> DataFrame:
        for n, b in self.branches.items():
            df = b.predict(df).withColumnRenamed("prediction", f"p_{n}")
        return df

    def _columns(self):
        return [F.col(f"p_{n}") for n in self.branches]

    def predict(self, df: DataFrame) -> DataFrame:
        """df with the branches' predictions, prediction, and (for votes) confidence: the winner's share of weight. Ties go to the smaller label."""
        out, c = self._all(df), self._columns()
        if callable(self.combiner):
            return out.withColumn("prediction", self.combiner(*c))
        if self.combiner == "average":
            return out.withColumn("prediction", total(c) / F.lit(float(len(c))))
        if self.combiner in ("max", "min"):
            return out.withColumn("prediction", F.greatest(*c) if self.combiner == "max" else F.least(*c))
        w = {n: self.weights.get(n, 1.0) if self.combiner == "weighted_vote" else 1.0 for n in self.branches}
        votes = [total([F.when(other == own, F.lit(float(w[n]))).otherwise(0.0) for n, other in zip(self.branches, c, strict=True)]) for own in c]
        top = F.greatest(*votes) if len(votes) > 1 else votes[0]
        winner = F.least(*(F.when(v == top, own) for v, own in zip(votes, c, strict=True))) if len(c) > 1 else c[0]
        return out.withColumns({"prediction": winner, "confidence": top / F.lit(float(sum(w.values())))})

    def agreement_score(self, df: DataFrame) -> float:
        """Mean share of pairs of branches that agree."""
        c = self._columns()
        same = [F.when(a == b, 1.0).otherwise(0.0) for i, a in enumerate(c) for b in c[i + 1 :]]
        return self._all(df).agg(F.avg(total(same) / F.lit(float(len(same))))).first()[0] if same else 1.0


