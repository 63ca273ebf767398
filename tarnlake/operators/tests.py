"""Hypothesis tests. Rows are reduced to moments, ranks or counts by aggregates; p-values come from exact distributions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special as sp
from ..functions.expressions import clean, correlation
from .kernels import average_ranks, positions, running, value_ranks

SIDES = ("two-sided", "less", "greater")


def _p_from(cdf: float, alternative: str) -> float:
    if alternative not in SIDES:
        raise ValueError(f"alternative is one of {SIDES}")
    return cdf if alternative == "less" else 1 - cdf if alternative == "greater" else 2 * min(cdf, 1 - cdf)


def _t_p(t: float, df: float, alternative: str) -> float:
    if alternative == "two-sided":
        return 0.0 if math.isinf(t) else sp.beta_i(df / 2, 0.5, df / (df + t * t))
    return _p_from(sp.t_cdf(t, df), alternative)


def _normal_p(z: float, alternative: str) -> float:
    return math.erfc(abs(z) / math.sqrt(2)) if alternative == "two-sided" else _p_from(sp.normal_cdf(z), alternative)


def _ratio(top: float, below: float) -> float:
    return top / below if below else 0.0 if not top else math.copysign(math.inf, top)


def moments(df: DataFrame, value: str, group: str | None = None) -> list:
    """Rows with g, n, mean, var (sample) of each group, in the groups' order."""
    rows = df.select(clean(value).alias("v"), (F.col(group) if group else F.lit(None)).alias("g")).where("v is not null")
    return rows.groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.coalesce(F.var_samp("v"), F.lit(0.0)).alias("var")).orderBy("g").collect()


def one_sample_t_test(df: DataFrame, column: str, mu: float = 0.0, alternative: str = "two-sided") -> dict:
    m = moments(df, column)
    if not m or m[0]["n"] < 2:
        raise ValueError("two values are needed")
    n, mean, var = m[0]["n"], m[0]["mean"], m[0]["var"]
    t = _ratio(mean - mu, math.sqrt(var / n))
    return {"statistic": t, "df": n - 1, "p_value": _t_p(t, n - 1, alternative), "mean": mean, "n": n, "alternative": alternative}


def two_sample_t_test(df: DataFrame, value: str, group: str, alternative: str = "two-sided") -> dict:
    """Student's test with a pooled variance; exactly two groups."""
    m = moments(df, value, group)
    if len(m) != 2:
        raise ValueError("exactly two groups are needed")
    a, b = m
    dof = a["n"] + b["n"] - 2
    pooled = ((a["n"] - 1) * a["var"] + (b["n"] - 1) * b["var"]) / dof
    t = _ratio(a["mean"] - b["mean"], math.sqrt(pooled * (1 / a["n"] + 1 / b["n"])))
    return {"statistic": t, "df": dof, "p_value": _t_p(t, dof, alternative), "mean1": a["mean"], "mean2": b["mean"], "pooled_variance": pooled}


def paired_t_test(df: DataFrame, first: str, second: str, mu: float = 0.0, alternative: str = "two-sided") -> dict:
    return one_sample_t_test(df.select((F.col(first) - F.col(second)).alias("d")), "d", mu, alternative)


def chi_square_test(df: DataFrame, observed: str, expected: str) -> dict:
    """Goodness of fit over rows of observed and expected counts."""
    row = df.agg(F.sum((F.col(observed) - F.col(expected)) ** 2 / F.col(expected)).alias("x"), F.count("*").alias("n"), F.min(expected).alias("low")).first()
    if row["low"] is None or row["low"] <= 0:
        raise ValueError("expected counts must be positive")
    return {"statistic": row["x"], "df": row["n"] - 1, "p_value": sp.chi2_sf(row["x"], row["n"] - 1)}


def one_way_anova(df: DataFrame, value: str, group: str) -> dict:
    return _anova(moments(df, value, group))


def _anova(m: list) -> dict:
    k, n = len(m), sum(g["n"] for g in m)
    if k < 2 or n <= k:
        raise ValueError("two groups and more values than groups are needed")
    grand = sum(g["n"] * g["mean"] for g in m) / n
    between, within = sum(g["n"] * (g["mean"] - grand) ** 2 for g in m), sum((g["n"] - 1) * g["var"] for g in m)
    ms_between, ms_within = between / (k - 1), within / (n - k)
    f = _ratio(ms_between, ms_within)
    return {"statistic": f, "df_between": k - 1, "df_within": n - k, "ss_between": between, "ss_within": within, "ms_between": ms_between, "ms_within": ms_within, "p_value": sp.f_sf(f, k - 1, n - k), "groups": [{"group": g["g"], "n": g["n"], "mean": g["mean"]} for g in m]}


def tukey_hsd(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> dict:
    """All pairs of groups by the studentized range."""
    a = one_way_anova(df, value, group)
    g, k, dof = a["groups"], len(a["groups"]), a["df_within"]
    critical, out = sp.studentized_range_quantile(1 - alpha, k, dof), []
    for i in range(k):
        for j in range(i + 1, k):
            diff = g[j]["mean"] - g[i]["mean"]
            se = math.sqrt(a["ms_within"] / 2 * (1 / g[i]["n"] + 1 / g[j]["n"]))
            q = _ratio(abs(diff), se)
            p = 1 - sp.studentized_range_cdf(q, k, dof) if math.isfinite(q) else 0.0
            out.append({"group1": g[i]["group"], "group2": g[j]["group"], "diff": diff, "se": se, "q_statistic": q, "p_value": p, "lower": diff - critical * se, "upper": diff + critical * se, "significant": p < alpha})
    return {"comparisons": out, "q_critical": critical, "alpha": alpha, "anova": a}


def rank_sums(df: DataFrame, value: str, group: str) -> list:
    """Rows with g, n and r (sum of joint average ranks) of each group."""
    rows = df.select(clean(value).alias("v"), F.col(group).alias("g")).where("v is not null")
    counts = rows.groupBy("v", "g").agg(F.count("*").alias("k"))
    return counts.join(value_ranks(rows, "v").select("v", "rank"), "v").groupBy("g").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("rank")).alias("r")).orderBy("g").collect()


def mann_whitney_u(df: DataFrame, value: str, group: str, alternative: str = "two-sided") -> dict:
    """Normal approximation without corrections for ties and continuity; the statistic is the smaller U."""
    a, b = rank_sums(df, value, group)
    n1, n2 = a["n"], b["n"]
    u1 = a["r"] - n1 * (n1 + 1) / 2
    z = _ratio(u1 - n1 * n2 / 2, math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12))
    return {"statistic": min(u1, n1 * n2 - u1), "u1": u1, "u2": n1 * n2 - u1, "z": z, "p_value": _normal_p(z, alternative)}


def kruskal_wallis(df: DataFrame, value: str, group: str) -> dict:
    """H without a correction for ties."""
    m = rank_sums(df, value, group)
    n = sum(g["n"] for g in m)
    h = 12 / (n * (n + 1)) * sum(g["r"] ** 2 / g["n"] for g in m) - 3 * (n + 1)
    return {"statistic": h, "df": len(m) - 1, "p_value": sp.chi2_sf(h, len(m) - 1)}


def levene_test(df: DataFrame, value: str, group: str, center: str = "median", trim: float = 0.1) -> dict:
    """Analysis of variance of absolute deviations from each group's median, mean or trimmed mean."""
    rows = df.select(clean(value).alias("v"), F.col(group).alias("g")).where("v is not null")
    if center == "trimmed":
        cut_at = rows.groupBy("g").agg(F.floor(F.count("*") * trim).alias("k"))
        low, high = Window.partitionBy("g").orderBy("v"), Window.partitionBy("g").orderBy(F.desc("v"))
        kept = rows.withColumns({"a": F.row_number().over(low), "b": F.row_number().over(high)}).join(cut_at, "g").where("a > k and b > k")
        middle = kept.groupBy("g").agg(F.avg("v").alias("c"))
    else:
        middle = rows.groupBy("g").agg((F.median("v") if center == "median" else F.avg("v")).alias("c"))
    away = rows.join(middle, "g").select("g", F.abs(F.col("v") - F.col("c")).alias("v"))
    a = one_way_anova(away, "v", "g")
    return {k: a[k] for k in ("statistic", "df_between", "df_within", "p_value")} | {"center": center}


def _correlation(r: float | None, n: int, alternative: str, level: float) -> dict:
    if r is None or math.isnan(r) or n < 3:
        return {"statistic": 0.0, "r": 0.0, "df": n - 2, "p_value": 1.0, "n": n, "lower": math.nan, "upper": math.nan}
    t = _ratio(r * math.sqrt(n - 2), math.sqrt(max(0.0, 1 - r * r)))
    half = sp.normal_quantile(1 - (1 - level) / 2) / math.sqrt(n - 3) if n > 3 else math.inf
    z = math.atanh(r) if abs(r) < 1 else math.copysign(math.inf, r)
    return {"statistic": t, "r": r, "df": n - 2, "p_value": _t_p(t, n - 2, alternative), "n": n, "lower": math.tanh(z - half), "upper": math.tanh(z + half)}


def pearson_correlation(df: DataFrame, x: str, y: str, alternative: str = "two-sided", level: float = 0.95) -> dict:
    rows = df.select(clean(x).alias("x"), clean(y).alias("y")).where("x is not null and y is not null")
    got = rows.agg(correlation("x", "y").alias("r"), F.count("*").alias("n")).first()
    return _correlation(got["r"], got["n"], alternative, level)


def spearman_correlation(df: DataFrame, x: str, y: str, alternative: str = "two-sided", level: float = 0.95) -> dict:
    rows = df.select(clean(x).alias("x"), clean(y).alias("y")).where("x is not null and y is not null")
    ranked = average_ranks(average_ranks(rows, "x", "rx"), "y", "ry")
    got = ranked.agg(correlation("rx", "ry").alias("r"), F.count("*").alias("n")).first()
    return _correlation(got["r"], got["n"], alternative, level)


def fisher_exact_test(table: list[list[int]], alternative: str = "two-sided") -> dict:
    """2 x 2 tables; the odds ratio is that of the sample."""
    (a, b), (c, d) = table
    r1, c1, n = a + b, a + c, a + b + c + d
    choose = lambda m, k: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)
    low, high = max(0, c1 - (n - r1)), min(r1, c1)
    p = {k: math.exp(choose(r1, k) + choose(n - r1, c1 - k) - choose(n, c1)) for k in range(low, high + 1)}
    own = p[a]
    pick = {"less": lambda k: k <= a, "greater": lambda k: k >= a, "two-sided": lambda k: p[k] <= own * (1 + 1e-10)}[alternative]
    odds = (a * d) / (b * c) if b * c else math.inf if a * d else math.nan
    return {"p_value": min(1.0, sum(v for k, v in p.items() if pick(k))), "odds_ratio": odds, "alternative": alternative}


def fisher_from_rows(df: DataFrame, x: str, y: str, alternative: str = "two-sided") -> dict:
    """Fisher's test of two columns with two values each."""
    got = df.groupBy(x, y).count().collect()
    xs, ys = sorted({r[x] for r in got}), sorted({r[y] for r in got})
    n = {(r[x], r[y]): r["count"] for r in got}
    return fisher_exact_test([[n.get((u, v), 0) for v in ys] for u in xs], alternative)


def cohens_d(df: DataFrame, value: str, group: str, pooled: bool = True) -> float:
    a, b = moments(df, value, group)
    s = math.sqrt(((a["n"] - 1) * a["var"] + (b["n"] - 1) * b["var"]) / (a["n"] + b["n"] - 2)) if pooled else math.sqrt(a["var"])
    return _ratio(a["mean"] - b["mean"], s)


def eta_squared(anova: dict) -> float:
    whole = anova["ss_between"] + anova["ss_within"]
    return anova["ss_between"] / whole if whole else 0.0


def omega_squared(anova: dict) -> float:
    whole = anova["ss_between"] + anova["ss_within"] + anova["ms_within"]
    return (anova["ss_between"] - anova["df_between"] * anova["ms_within"]) / whole if whole else 0.0


def bonferroni(df: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    m = df.where(F.col(p).isNotNull()).count()
    adjusted = F.least(F.col(p) * F.lit(float(m)), F.lit(1.0))
    return df.withColumns({"adjusted": adjusted, "rejected": adjusted <= alpha})


def _placed(df: DataFrame, p: str) -> tuple[DataFrame, int]:
    rows = positions(df.where(F.col(p).isNotNull()), [F.col(p)], "__k")
    return rows, rows.count()


def holm_bonferroni(df: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Step-down adjustment: running maximum of (m - place + 1) p."""
    rows, m = _placed(df, p)
    raw = F.least(F.col(p) * (F.lit(m) - F.col("__k") + 1), F.lit(1.0))
    out = running(rows, [F.col("__k")], {"adjusted": (raw, "max")})
    return out.withColumn("rejected", F.col("adjusted") <= alpha).drop("__k")


def fdr(df: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg: running minimum of p m / place from the largest p down, and critical values."""
    rows, m = _placed(df, p)
    raw = F.least(F.col(p) * F.lit(float(m)) / F.col("__k"), F.lit(1.0))
    out = running(rows, [F.desc("__k")], {"adjusted": (raw, "min")})
    return out.withColumns({"critical": F.col("__k") / F.lit(float(max(1, m))) * F.lit(alpha), "rejected": F.col("adjusted") <= alpha}).drop("__k")


@dataclass
class StatisticalTest:
    """A test as an object: fit(df, **columns) keeps the result."""

    function: object
    options: dict
    result: dict | None = None

    def fit(self, df: DataFrame, **columns) -> StatisticalTest:
        self.result = self.function(df, **columns, **self.options)
        return self

    def summary(self) -> str:
        if self.result is None:
            raise RuntimeError("fit() comes first")
        lines = [f"{k}: {v:.6g}" if isinstance(v, float) else f"{k}: {v}" for k, v in self.result.items() if not isinstance(v, (list, dict))]
        return "\n".join([self.function.__name__, *lines])

    def to_json(self) -> dict:
        return {"test": self.function.__name__, "options": self.options, "result": self.result}


def OneSampleTTest(**o):  # noqa: N802
    return StatisticalTest(one_sample_t_test, o)


def TwoSampleTTest(**o):  # noqa: N802
    return StatisticalTest(two_sample_t_test, o)


def OneWayAnova(**o):  # noqa: N802
    return StatisticalTest(one_way_anova, o)


def ChiSquareTest(**o):  # noqa: N802
    return StatisticalTest(chi_square_test, o)


def TukeyHSD(**o):  # noqa: N802
    return StatisticalTest(tukey_hsd, o)
