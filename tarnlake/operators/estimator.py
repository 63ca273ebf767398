"""A common face of models: parameters, state, warnings, and scores. A model is given as a function that fits it."""

from __future__ import annotations

import html
import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.persistence import Saveable, save_model
from ..sources.tables import numeric_columns
from .metrics import accuracy, r2

#: Columns beyond which a fit warns.
MANY_COLUMNS = 100


class Estimator(Saveable):
    """make(df, columns, y, **params) gives a fitted object with predict(df) or transform(df)."""

    def __init__(self, make: Callable, **params):
        self.make, self.params, self.model, self.columns, self.y = make, dict(params), None, [], None
        self._warnings: list[dict] = []

    @property
    def is_fitted(self) -> bool:
        return self.model is not None

    def ensure_fitted(self, method: str) -> None:
        if not self.is_fitted:
            raise RuntimeError(f"{method}() comes after fit()")

    def get_params(self) -> dict:
        return dict(self.params)

    def set_params(self, **params) -> Estimator:
        self.params |= params
        return self

    def state(self) -> dict:
        return {"fitted": self.is_fitted, "kind": type(self).__name__, "params": self.get_params(), "columns": self.columns, "warnings": len(self._warnings), "memory": self.memory_usage()}

    def memory_usage(self) -> int:
        """Bytes of the saved model."""
        return len(save_model(self.model)) if self.is_fitted else 0

    def add_warning(self, kind: str, message: str, **details) -> None:
        self._warnings.append({"kind": kind, "message": message} | details)

    def warnings(self, kind: str | None = None) -> list[dict]:
        return [w for w in self._warnings if kind in (None, w["kind"])]

    def has_warnings(self) -> bool:
        return bool(self._warnings)

    def clear_warnings(self) -> None:
        self._warnings.clear()

    def _arguments(self, df: DataFrame, columns: list[str] | None, y: str | None) -> list[str]:
        """The columns to fit on: those given, or all numeric ones but the target; unknown ones raise, many warn."""
        chosen = columns or [c for c in numeric_columns(df) if c != y]
        unknown = [c for c in [*chosen, *([y] if y else [])] if c not in df.columns]
        if unknown:
            raise ValueError(f"no column {', '.join(unknown)}")
        if len(chosen) > MANY_COLUMNS:
            self.add_warning("size", f"{len(chosen)} columns", columns=len(chosen))
        return chosen

    def fit(self, df: DataFrame, columns: list[str] | None = None, y: str | None = None) -> Estimator:
        self.columns, self.y = self._arguments(df, columns, y), y
        self.model = self.make(df, self.columns, y, **self.params)
        return self

    def to_json(self) -> dict:
        return {"params": self.params, "columns": self.columns, "y": self.y, "model": json.loads(save_model(self.model)) if self.is_fitted else None}

    def _repr_html_(self) -> str:
        rows = "".join(f"<tr><td>{html.escape(str(k))}</td><td>{html.escape(str(v))}</td></tr>" for k, v in self.state().items())
        return f"<table>{rows}</table>"


class Regressor(Estimator):
    def predict(self, df: DataFrame, **options) -> DataFrame:
        self.ensure_fitted("predict")
        return self.model.predict(df, **options)

    def score(self, df: DataFrame) -> float:
        """R2; 0 where the target is constant."""
        return self.predict(df).agg(r2(self.y, "prediction")).first()[0] or 0.0


class Classifier(Estimator):
    """Text labels are fitted as numbers (by sorted label) and come back as text."""

    def __init__(self, make: Callable, **params):
        super().__init__(make, **params)
        self.labels: list | None = None

    def fit(self, df: DataFrame, columns: list[str] | None = None, y: str | None = None) -> Classifier:
        from .prepare import LabelEncoder

        self.labels = None
        if dict(df.dtypes).get(y) == "string":
            encoder = LabelEncoder().fit(df, y)
            self.labels, df = encoder.classes, encoder.transform(df, y)
        super().fit(df, columns, y)
        return self

    def predict(self, df: DataFrame, **options) -> DataFrame:
        self.ensure_fitted("predict")
        out = self.model.predict(df, **options)
        if self.labels is None:
            return out
        return out.withColumn("prediction", F.array(*(F.lit(v) for v in self.labels))[F.col("prediction").cast("int")])

    def predict_proba(self, df: DataFrame) -> DataFrame:
        self.ensure_fitted("predict_proba")
        return self.model.predict_proba(df)

    def score(self, df: DataFrame) -> float:
        """Accuracy."""
        return self.predict(df).agg(accuracy(self.y, "prediction")).first()[0] or 0.0


class Transformer(Estimator):
    def transform(self, df: DataFrame) -> DataFrame:
        self.ensure_fitted("transform")
        return self.model.transform(df)

    def fit_transform(self, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
        return self.fit(df, columns).transform(df)
