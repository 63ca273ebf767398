"""Recipes: a chain of preparation steps, fitted by prep() and replayed by bake().

Steps are held until prep(). By default they are fitted on the training part only; resampling and row removal happen in
training alone. Everything a step learns is small; its effect is column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import clean, correlation, is_missing
from ..operators import impute, ordination, outliers, prepare, splits
from ..operators.kernels import pick_sorted

#: A fitted step: data and feature names to data and feature names.
Apply = Callable[[DataFrame, list[str]], tuple[DataFrame, list[str]]]


@dataclass
class Step:
    name: str
    fit: Callable[[DataFrame, list[str]], Apply]
    train_only: bool = False


@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame | None
    features: list[str]
    steps: list[tuple[str, Apply, bool]]


@dataclass(frozen=True)
class Recipe:
    data: DataFrame
    x: tuple[str, ...]
    y: str | None
    id_col: str
    steps: tuple[Step, ...] = ()
    split_options: dict | None = field(default=None)

    def _with(self, name: str, fit, train_only: bool = False) -> Recipe:
        return Recipe(self.data, self.x, self.y, self.id_col, (*self.steps, Step(name, fit, train_only)), self.split_options)

    def _plain(self, name: str, change: Callable[[DataFrame], DataFrame], train_only: bool = False) -> Recipe:
        return self._with(name, lambda df, x: lambda d, f: (change(d), f), train_only)

    def parse_numeric(self, columns: list[str]) -> Recipe:
        return self._plain("parse_numeric", lambda d: prepare.parse_numeric(d, columns))

    def clean(self, valid: dict[str, list]) -> Recipe:
        return self._plain("clean", lambda d: prepare.clean_categorical(d, valid))

    def one_hot(self, columns: list[str], drop_first: bool = True, prefix: bool = True) -> Recipe:
        def fit(df, x):
            enc = prepare.OneHotEncoder(drop_first, prefix=prefix).fit(df, columns, self.id_col)
            names = [n for c in columns for n, _ in enc.names(c)]
            return lambda d, f: (enc.transform(d), [c for c in f if c not in columns] + names)

        return self._with("one_hot", fit)

    def scale(self, columns: list[str] | None = None, method: str = "standard") -> Recipe:
        def fit(df, x):
            s = (prepare.StandardScaler() if method == "standard" else prepare.MinMaxScaler()).fit(df, columns or x)
            return lambda d, f: (s.transform(d), f)

        return self._with("scale", fit)

    def _ordination(self, name: str, make, columns: list[str] | None, k: int | None, prefix: str) -> Recipe:
        def fit(df, x):
            used = columns or x
            model = make(df, used)

            def apply(d, f):
                out = model.transform(d, k, prefix) if k else model.transform(d, prefix=prefix)
                new = [c for c in out.columns if c not in d.columns]
                return out.drop(*used), [c for c in f if c not in used] + new

            apply.model = model
            return apply

        return self._with(name, fit)

    def pca(self, columns: list[str] | None = None, n_components: int | None = None, scale: bool = True, center: bool = True) -> Recipe:
        return self._ordination("pca", lambda d, c: ordination.PCA(center, scale).fit(d, c), columns, n_components, "PC")

    def lda(self, columns: list[str] | None = None, n_components: int | None = None) -> Recipe:
        return self._ordination("lda", lambda d, c: ordination.LDA().fit(d, c, self.y), columns, n_components, "LD")

    def rda(self, response: list[str], predictors: list[str]) -> Recipe:
        def fit(df, x):
            model = ordination.RDA().fit(df, response, predictors)

            def apply(d, f):
                out = model.transform(d, "RDA")
                return out, [c for c in f if c not in predictors] + [c for c in out.columns if c not in d.columns]

            return apply

        return self._with("rda", fit)

    def _impute(self, strategy: str, columns: list[str]) -> Recipe:
        def fit(df, x):
            m = impute.SimpleImputer(strategy).fit(df, columns)
            return lambda d, f: (m.transform(d), f)

        return self._with(f"impute_{strategy}", fit)

    def impute_mean(self, columns: list[str]) -> Recipe:
        return self._impute("mean", columns)

    def impute_median(self, columns: list[str]) -> Recipe:
        return self._impute("median", columns)

    def impute_mode(self, columns: list[str]) -> Recipe:
        return self._impute("most_frequent", columns)

    def impute_knn(self, columns: list[str], k: int = 5) -> Recipe:
        def fit(df, x):
            m = impute.KNNImputer(k).fit(df, columns, self.id_col)
            return lambda d, f: (m.transform(d), f)

        return self._with("impute_knn", fit)

    def impute_iterative(self, columns: list[str], max_iter: int = 10, tol: float = 1e-3) -> Recipe:
        def fit(df, x):
            m = impute.IterativeImputer(max_iter, tol).fit(df, columns)
            return lambda d, f: (m.transform(d), f)

        return self._with("impute_iterative", fit)

    def remove_outliers(self, columns: list[str], method: str = "mahalanobis", contamination: float = 0.1, **options) -> Recipe:
        def fit(df, x):
            if method == "mahalanobis":
                m = outliers.MahalanobisDistance(contamination, **options).fit(df, columns)
            elif method == "isolation_forest":
                m = outliers.IsolationForest(contamination=contamination, **options).fit(df, columns, self.id_col)
            else:
                m = outliers.LocalOutlierFactor(contamination=contamination, **options)
                m.fit(df, columns, self.id_col)
            mark = (lambda d: m.predict(d)) if method != "lof" else (lambda d: m.fit(d, columns, self.id_col))
            return lambda d, f: (mark(d).where("label = 1").select(d.columns), f)

        return self._with("remove_outliers", fit, True)

    def clip_outliers(self, columns: list[str], multiplier: float = 1.5) -> Recipe:
        """Values are held within the quartiles (order statistics at floor places) by multiplier times their distance."""

        def fit(df, x):
            limits = {}
            for c in columns:
                own = df.select(clean(c).alias("v")).where("v is not null")
                n = own.count()
                a, b = pick_sorted(own, "v", [math.floor(n * 0.25), math.floor(n * 0.75)])
                limits[c] = (a - multiplier * (b - a), b + multiplier * (b - a))
            return lambda d, f: (d.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), F.col(c)))) for c, (lo, hi) in limits.items()}), f)

        return self._with("clip_outliers", fit)

    def create_interactions(self, columns: list[str]) -> Recipe:
        pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
        new = [f"{a}_x_{b}" for a, b in pairs]
        return self._with("interactions", lambda df, x: lambda d, f: (d.withColumns({n: F.col(a) * F.col(b) for n, (a, b) in zip(new, pairs, strict=True)}), f + new))

    def create_polynomial(self, columns: list[str], degree: int = 2) -> Recipe:
        new = {f"{c}^{k}": F.pow(F.col(c).cast("double"), F.lit(float(k))) for c in columns for k in range(2, degree + 1)}
        return self._with("polynomial", lambda df, x: lambda d, f: (d.withColumns(new), f + list(new)))

    def bin_continuous(self, column: str, bins: int = 5, labels: list[str] | None = None) -> Recipe:
        """Equal widths; values beyond the fitted range go to the first or last bin."""

        def fit(df, x):
            low, high = df.agg(F.min(clean(column)), F.max(clean(column))).first()
            step = ((high or 0.0) - (low or 0.0)) / bins or 1.0
            k = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(column) - F.lit(float(low or 0.0))) / F.lit(float(step))).cast("int")))
            value = F.array(*(F.lit(v) for v in labels))[k] if labels else (k + 1)
            return lambda d, f: (d.withColumn(f"{column}_bin", F.when(~is_missing(column), value)), [*f, f"{column}_bin"])

        return self._with("bin", fit)

    def upsample(self, ratio: float = 1.0, seed: int = 0) -> Recipe:
        return self._plain("upsample", lambda d: splits.upsample(d, self.y, self.id_col, ratio, seed), True)

    def downsample(self, ratio: float = 1.0, seed: int = 0) -> Recipe:
        return self._plain("downsample", lambda d: splits.downsample(d, self.y, self.id_col, ratio, seed), True)

    def select_by_variance(self, threshold: float = 0.0) -> Recipe:
        def fit(df, x):
            row = df.agg(*(F.var_pop(clean(c)) for c in x)).first() if x else []
            keep = [c for c, v in zip(x, row, strict=True) if (v or 0.0) > threshold]
            return lambda d, f: (d.drop(*(c for c in x if c not in keep)), [c for c in f if c not in x or c in keep])

        return self._with("variance", fit)

    def select_by_correlation(self, threshold: float = 0.95) -> Recipe:
        """Of two columns with a higher absolute correlation (over rows that have both) the second goes."""

        def fit(df, x):
            pairs = [(a, b) for i, a in enumerate(x) for b in x[i + 1 :]]
            row = df.agg(*(correlation(clean(a), clean(b)) for a, b in pairs)).first() if pairs else []
            gone: set[str] = set()
            for (a, b), r in zip(pairs, row, strict=True):
                if a not in gone and b not in gone and r is not None and abs(r) > threshold:
                    gone.add(b)
            return lambda d, f: (d.drop(*gone), [c for c in f if c not in gone])

        return self._with("correlation", fit)

    def split(self, ratio: float = 0.7, shuffle: bool = True, seed: int = 0) -> Recipe:
        return Recipe(self.data, self.x, self.y, self.id_col, self.steps, {"ratio": ratio, "shuffle": shuffle, "seed": seed})

    def prep(self, fit_on: str = "train") -> Prepared:
        train, test = splits.train_test_split(self.data, self.id_col, **self.split_options) if self.split_options else (self.data, None)
        fit_rows, features, fitted = (self.data if fit_on == "all" else train), list(self.x), []
        for k, step in enumerate(self.steps):
            apply = step.fit(fit_rows, features)
            fitted.append((f"{k}:{step.name}", apply, step.train_only))
            before = features
            fit_rows, features = apply(fit_rows, before)
            train = apply(train, before)[0] if fit_on == "all" else fit_rows
            if test is not None and not step.train_only:
                test = apply(test, before)[0]
        return Prepared(train, test, features, fitted)

    def bake(self, prepared: Prepared, data: DataFrame) -> DataFrame:
        features = list(self.x)
        for _, apply, train_only in prepared.steps:
            if not train_only:
                data, features = apply(data, features)
        return data

    def summary(self) -> str:
        return "\n".join([f"recipe: {len(self.x)} features, target {self.y}", *(f"{k + 1}. {s.name}" + " (training only)" * s.train_only for k, s in enumerate(self.steps))])


def recipe(data: DataFrame, x: list[str], y: str | None, id_col: str) -> Recipe:
    return Recipe(data, tuple(x), y, id_col)
