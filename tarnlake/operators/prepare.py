"""Encoding, scaling and other preparation of columns. Fitted objects are small; transforms are column expressions."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import clean
from ..sources.tables import na_omit, numeric_columns

#: Categories of a column at most: they are held on the driver and in expressions.
MAX_CATEGORIES = 10_000


def categories(df: DataFrame, column: str, order: str | None = None) -> list:
    """Distinct present values: by first appearance in the order column, or sorted as text."""
    rows = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order or F.lit(0)).alias("o"))
    got = rows.orderBy("o" if order else F.col(column).cast("string")).limit(MAX_CATEGORIES + 1).collect()
    if len(got) > MAX_CATEGORIES:
        raise ValueError(f"{column} has over {MAX_CATEGORIES} categories")
    return [r[column] for r in got]


def code_of(column: str | Column, cats: list, missing=None) -> Column:
    """Number of the category in cats, missing for others."""
    if not cats:
        return F.lit(missing).cast("double")
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.create_map(*(F.lit(x) for i, v in enumerate(cats) for x in (v, float(i))))[c], F.lit(missing).cast("double"))


@dataclass
class LabelEncoder:
    """Codes of categories: by first appearance (order given) or sorted. unknown: error, nan, or extend (codes after the last)."""

    unknown: str = "nan"
    classes: list = field(default_factory=list)

    def fit(self, df: DataFrame, column: str, order: str | None = None) -> LabelEncoder:
        self.classes = categories(df, column, order)
        return self

    def transform(self, df: DataFrame, column: str, output: str | None = None, order: str | None = None) -> DataFrame:
        if self.unknown == "extend":
            self.classes = self.classes + [c for c in categories(df, column, order) if c not in set(self.classes)]
        code = code_of(column, self.classes)
        if self.unknown == "error":
            code = F.when(F.col(column).isNull() | code.isNotNull(), code).otherwise(F.raise_error(F.lit("unknown label")).cast("double"))
        return df.withColumn(output or column, code)

    def inverse(self, df: DataFrame, column: str, output: str | None = None) -> DataFrame:
        cats = F.array(*(F.lit(c) for c in self.classes))
        return df.withColumn(output or column, F.try_element_at(cats, F.col(column).cast("int") + 1))


@dataclass
class OneHotEncoder:
    """0/1 columns `column_category`; missing values are zeros; unknown ones are zeros or an error."""

    drop_first: bool = False
    unknown: str = "ignore"
    prefix: bool = True
    cats: dict[str, list] = field(default_factory=dict)

    def fit(self, df: DataFrame, columns: list[str], order: str | None = None) -> OneHotEncoder:
        self.cats = {c: categories(df, c, order) for c in columns}
        return self

    def names(self, column: str) -> list[tuple[str, object]]:
        return [(f"{column}_{v}" if self.prefix else str(v), v) for v in self.cats[column][1 if self.drop_first else 0 :]]

    def transform(self, df: DataFrame, keep: bool = False) -> DataFrame:
        new: dict[str, Column] = {}
        for c, cats in self.cats.items():
            known = F.col(c).isNull() | F.col(c).isin(cats)
            source = F.col(c) if self.unknown == "ignore" else F.when(known, F.col(c)).otherwise(F.raise_error(F.lit(f"unknown category in {c}")).cast(df.schema[c].dataType))
            new |= {name: F.when(source == F.lit(v), 1.0).otherwise(0.0) for name, v in self.names(c)}
        return df.withColumns(new).drop(*([] if keep else self.cats))


def one_hot_table(df: DataFrame, columns: list[str], order: str, drop_first: bool = True, keep: bool = False, prefix: bool = True) -> DataFrame:
    return OneHotEncoder(drop_first, prefix=prefix).fit(df, columns, order).transform(df, keep)


@dataclass
class Prepared:
    data: DataFrame
    x: list[str]
    y: str | None
    encoders: dict


def prepare_x(df: DataFrame, columns: list[str] | None = None, omit: bool = True, encode: str = "label", order: str | None = None, encoders: dict | None = None) -> Prepared:
    """Rows with all columns present; numbers as doubles, other columns encoded (label or onehot)."""
    columns = columns or numeric_columns(df)
    data = na_omit(df, columns) if omit else df
    numbers, names, held = set(numeric_columns(df)), [], dict(encoders or {})
    for c in columns:
        if c in numbers:
            data = data.withColumn(c, F.col(c).cast("double"))
            names.append(c)
        elif isinstance(held.get(c), OneHotEncoder) or (c not in held and encode == "onehot"):
            enc = held.setdefault(c, None) or OneHotEncoder().fit(data, [c], order)
            held[c] = enc
            data = enc.transform(data, keep=False)
            names += [n for n, _ in enc.names(c)]
        else:
            held[c] = held.get(c) or LabelEncoder().fit(data, c, order)
            data = held[c].transform(data, c)
            names.append(c)
    return Prepared(data, names, None, held)


def prepare_xy(df: DataFrame, columns: list[str], target: str, omit: bool = True, encode: str = "label", order: str | None = None) -> Prepared:
    """As prepare_x; a target that is no number is label-encoded."""
    data = na_omit(df, [*columns, target]) if omit else df
    out = prepare_x(data, columns, False, encode, order)
    if target not in numeric_columns(df):
        enc = LabelEncoder().fit(data, target, order)
        out.data, out.encoders["y"] = enc.transform(out.data, target), enc
    else:
        out.data = out.data.withColumn(target, F.col(target).cast("double"))
    out.y = target
    return out


@dataclass
class StandardScaler:
    """(x - mean) / population deviation; constant columns are only centred."""

    mean: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame, columns: list[str]) -> StandardScaler:
        row = df.agg(*(F.avg(clean(c)) for c in columns), *(F.stddev_pop(clean(c)) for c in columns)).first()
        k = len(columns)
        self.mean = {c: row[i] or 0.0 for i, c in enumerate(columns)}
        self.scale = {c: row[k + i] or 1.0 for i, c in enumerate(columns)}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(self.scale[c]) for c, m in self.mean.items()})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * F.lit(self.scale[c]) + F.lit(m) for c, m in self.mean.items()})

    def fit_transform(self, df: DataFrame, columns: list[str]) -> DataFrame:
        return self.fit(df, columns).transform(df)


@dataclass
class MinMaxScaler:
    """Columns into a range; constant columns to its lower end."""

    low: float = 0.0
    high: float = 1.0
    least: dict[str, float] = field(default_factory=dict)
    width: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame, columns: list[str]) -> MinMaxScaler:
        row = df.agg(*(F.min(clean(c)) for c in columns), *(F.max(clean(c)) for c in columns)).first()
        k = len(columns)
        self.least = {c: float(row[i] or 0.0) for i, c in enumerate(columns)}
        self.width = {c: float((row[k + i] or 0.0) - (row[i] or 0.0)) for i, c in enumerate(columns)}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        span = self.high - self.low
        return df.withColumns({c: F.lit(self.low) + (F.col(c) - F.lit(m)) / F.lit(self.width[c] or 1.0) * F.lit(span if self.width[c] else 0.0) for c, m in self.least.items()})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        span = (self.high - self.low) or 1.0
        return df.withColumns({c: (F.col(c) - F.lit(self.low)) / F.lit(span) * F.lit(self.width[c]) + F.lit(m) for c, m in self.least.items()})

    def fit_transform(self, df: DataFrame, columns: list[str]) -> DataFrame:
        return self.fit(df, columns).transform(df)


def polynomial_features(df: DataFrame, columns: list[str], degree: int = 2, bias: bool = False) -> DataFrame:
    """All products of up to degree columns, named `a*b`, `a^2`."""
    out: dict[str, Column] = {"bias": F.lit(1.0)} if bias else {}
    for d in range(2, degree + 1):
        for combo in itertools.combinations_with_replacement(columns, d):
            powers = [(c, combo.count(c)) for c in dict.fromkeys(combo)]
            value = F.lit(1.0)
            for c in combo:
                value = value * F.col(c)
            out["*".join(c if k == 1 else f"{c}^{k}" for c, k in powers)] = value
    return df.withColumns(out)


NUMBER_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def parse_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """The number that a text starts with; null where there is none."""
    return df.withColumns({c: F.regexp_extract(F.col(c).cast("string"), NUMBER_PREFIX, 1).try_cast("double") for c in columns})


def clean_categorical(df: DataFrame, valid: dict[str, list]) -> DataFrame:
    """Rows whose values are all in the columns' lists."""
    keep = F.lit(True)
    for c, values in valid.items():
        keep = keep & F.coalesce(F.col(c).isin(values), F.lit(False))
    return df.where(keep)


def label_encode(df: DataFrame, column: str, output: str | None = None, keep: bool = True, cats: list | None = None, order: str | None = None) -> DataFrame:
    name = output or f"{column}_idx"
    out = df.withColumn(name, code_of(column, cats if cats is not None else categories(df, column, order)))
    return out if keep else out.drop(column)


@dataclass
class Preprocessor:
    """parse -> clean -> label -> one-hot, fitted once and replayed: unseen labels extend the codes, unseen categories are zeros."""

    numeric: list[str] = field(default_factory=list)
    valid: dict[str, list] = field(default_factory=dict)
    label: list[str] = field(default_factory=list)
    one_hot: list[str] = field(default_factory=list)
    order: str | None = None
    encoders: dict = field(default_factory=dict)

    def _start(self, df: DataFrame) -> DataFrame:
        return clean_categorical(parse_numeric(df, self.numeric), self.valid)

    def fit(self, df: DataFrame) -> Preprocessor:
        data = self._start(df)
        self.encoders = {c: LabelEncoder("extend").fit(data, c, self.order) for c in self.label}
        if self.one_hot:
            self.encoders["__one_hot"] = OneHotEncoder().fit(data, self.one_hot, self.order)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        data = self._start(df)
        for c in self.label:
            data = self.encoders[c].transform(data, c, f"{c}_idx", self.order)
        return self.encoders["__one_hot"].transform(data) if self.one_hot else data
