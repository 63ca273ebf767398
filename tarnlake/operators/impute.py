"""Imputation: by a column's statistic (also within groups), by nearest rows, and by chained regressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import clean, is_missing, total
from ..session import cut
from .kernels import gram, solve
from .neighbours import nearest


@dataclass
class SimpleImputer:
    """mean, median, most_frequent (ties: smallest value) or constant; a column without values is filled with 0."""

    strategy: str = "mean"
    fill_value: object = 0.0
    values: dict[str, object] = field(default_factory=dict)
    group: str | None = None
    group_values: DataFrame | None = None

    def _statistic(self, c: str, text: bool) -> Column:
        v = F.col(c) if text else clean(c)
        if self.strategy == "constant":
            return F.lit(self.fill_value)
        if self.strategy == "most_frequent" or text:
            return F.expr(f"mode() within group (order by {'`' + c + '`' if text else f'CASE WHEN isnan(`{c}`) THEN NULL ELSE `{c}` END'})")
        return F.avg(v) if self.strategy == "mean" else F.median(v)

    def fit(self, df: DataFrame, columns: list[str], group: str | None = None) -> SimpleImputer:
        kinds = dict(df.dtypes)
        stats = [F.coalesce(self._statistic(c, kinds[c] == "string"), F.lit("" if kinds[c] == "string" else 0.0)).alias(c) for c in columns]
        row = df.agg(*stats).first()
        self.values, self.group = {c: row[c] for c in columns}, group
        if group:
            raw = [self._statistic(c, kinds[c] == "string").alias(f"__{c}") for c in columns]
            self.group_values = df.groupBy(group).agg(*raw)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        gone = {c: is_missing(c, kinds[c] in ("double", "float")) for c in self.values}
        if self.group_values is None:
            return df.withColumns({c: F.when(gone[c], F.lit(v)).otherwise(F.col(c)) for c, v in self.values.items()})
        out = df.join(self.group_values, self.group, "left")
        return out.withColumns({c: F.when(gone[c], F.coalesce(F.col(f"__{c}"), F.lit(v))).otherwise(F.col(c)) for c, v in self.values.items()}).drop(*(f"__{c}" for c in self.values))

    def fit_transform(self, df: DataFrame, columns: list[str], group: str | None = None) -> DataFrame:
        return self.fit(df, columns, group).transform(df)


def simple_impute(df: DataFrame, columns: list[str], **options) -> DataFrame:
    return SimpleImputer(**options).fit_transform(df, columns)


@dataclass
class KNNImputer:
    """Mean of the k nearest rows that have the value (distance over the columns present in both, not rescaled; rows at distance 0
    are skipped). Only rows with a missing value are searched for."""

    k: int = 5
    weights: str = "uniform"
    data: DataFrame | None = None
    columns: list[str] = field(default_factory=list)
    id_col: str = "row_id"

    def fit(self, df: DataFrame, columns: list[str], id_col: str) -> KNNImputer:
        self.data, self.columns, self.id_col = df.select(id_col, *(clean(c).alias(c) for c in columns)), columns, id_col
        return self

    def _near(self, df: DataFrame) -> DataFrame | None:
        """__q, __d and the columns of the k nearest rows of each row with a gap. Rows of one pattern of present columns are searched
        among rows that share the same of these columns; what the patterns find is put together."""
        pattern = F.concat(*(F.when(clean(c).isNull(), "0").otherwise("1") for c in self.columns))
        ask = cut(df.select(F.col(self.id_col).alias("__q"), *(clean(c).alias(c) for c in self.columns), pattern.alias("__p")).where(F.col("__p").contains("0")))
        held = self.data.withColumn("__p", pattern)
        asked, known = (sorted(r[0] for r in t.select("__p").distinct().collect()) for t in (ask, held))
        found = None
        for q in asked:
            shared: dict[str, list[str]] = {}
            for p in known:
                both = "".join("1" if a == b == "1" else "0" for a, b in zip(p, q, strict=True))
                if "1" in both:
                    shared.setdefault(both, []).append(p)
            for both, patterns in shared.items():
                own = [c for c, b in zip(self.columns, both, strict=True) if b == "1"]
                one = nearest(ask.where(F.col("__p") == q), held.where(F.col("__p").isin(patterns)), own, self.k, "__q", self.id_col, skip_self=True, least=1e-10).drop("place")
                found = one if found is None else found.union(one)
        if found is None:
            return None
        w = Window.partitionBy("id_l").orderBy("distance", "id_r")
        best = found.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= self.k)
        return best.select(F.col("id_l").alias("__q"), F.col("distance").alias("__d"), F.col("id_r").alias(self.id_col)).join(self.data, self.id_col)

    def transform(self, df: DataFrame) -> DataFrame:
        near = self._near(df)
        if near is None:
            near = self.data.limit(0).withColumns({"__q": F.col(self.id_col), "__d": F.lit(0.0)})
        weight = F.lit(1.0) if self.weights == "uniform" else 1 / F.col("__d")
        stats = [F.try_divide(F.sum(F.when(F.col(c).isNotNull(), weight * F.col(c))), F.sum(F.when(F.col(c).isNotNull(), weight))).alias(f"n_{c}") for c in self.columns]
        filled = near.groupBy("__q").agg(*stats)
        overall = self.data.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in self.columns)).first()
        out = df.join(filled, F.col(self.id_col) == F.col("__q"), "left")
        return out.withColumns({c: F.coalesce(clean(c), F.col(f"n_{c}"), F.lit(overall[c])) for c in self.columns}).select(df.columns)


def knn_impute(df: DataFrame, columns: list[str], id_col: str, **options) -> DataFrame:
    return KNNImputer(**options).fit(df, columns, id_col).transform(df)


@dataclass
class IterativeImputer:
    """Chained least squares: each column in turn is regressed on the others over the rows that have it, and its gaps are predicted."""

    max_iter: int = 10
    tol: float = 1e-3
    initial: str = "mean"
    low: float | None = None
    high: float | None = None
    start: SimpleImputer | None = None
    models: dict[str, list[float]] = field(default_factory=dict)
    columns: list[str] = field(default_factory=list)

    def _fill(self, c: str, beta) -> Column:
        others = [o for o in self.columns if o != c]
        v = total([F.lit(float(beta[0])), *(F.col(o) * F.lit(float(b)) for o, b in zip(others, beta[1:], strict=True))])
        if self.low is not None:
            v = F.greatest(v, F.lit(self.low))
        if self.high is not None:
            v = F.least(v, F.lit(self.high))
        return F.when(F.col(f"__gone_{c}"), v).otherwise(F.col(c))

    def _prepare(self, df: DataFrame) -> DataFrame:
        return self.start.transform(df.withColumns({f"__gone_{c}": clean(c).isNull() for c in self.columns} | {c: clean(c) for c in self.columns}))

    def _run(self, df: DataFrame, fit: bool) -> DataFrame:
        now = cut(self._prepare(df))
        with_gaps = [c for c in self.columns if c in self.models] if not fit else [c for c, r in zip(self.columns, now.agg(*(F.max(f"__gone_{c}") for c in self.columns)).first(), strict=True) if r]
        for _ in range(self.max_iter):
            before = self.models.copy()
            step = now
            for c in with_gaps:
                if fit:
                    others = [F.lit(1.0), *(F.col(o) for o in self.columns if o != c)]
                    _, _, g = gram(step.where(~F.col(f"__gone_{c}")), [*others, F.col(c)])
                    self.models[c] = solve(g[:-1, :-1], g[:-1, -1]).tolist()
                step = step.withColumn(c, self._fill(c, self.models[c]))
            now = cut(step)
            if fit and before.keys() == self.models.keys() and all(np.abs(np.array(before[c]) - self.models[c]).max() < self.tol for c in before):
                break
        return now.drop(*(f"__gone_{c}" for c in self.columns))

    def fit_transform(self, df: DataFrame, columns: list[str]) -> DataFrame:
        self.columns, self.start, self.models = columns, SimpleImputer(self.initial).fit(df, columns), {}
        return self._run(df, True)

    def fit(self, df: DataFrame, columns: list[str]) -> IterativeImputer:
        self.fit_transform(df, columns)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self._run(df, False)


def iterative_impute(df: DataFrame, columns: list[str], **options) -> DataFrame:
    return IterativeImputer(**options).fit_transform(df, columns)
