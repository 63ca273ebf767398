"""Generalized linear, mixed and multinomial models. Each iteration is one aggregation of p x p sums, solved on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special as sp
from ..functions.expressions import total
from ..functions.formula import apply_formula, design
from ..sources.persistence import Saveable
from .families import create_family
from .kernels import gram


def linear(beta, columns: list[str | Column], offset: str | Column | None = None) -> Column:
    terms = [(F.col(c) if isinstance(c, str) else c) * F.lit(float(b)) for b, c in zip(beta, columns, strict=True)]
    if offset is not None:
        terms.append(F.col(offset) if isinstance(offset, str) else offset)
    return total(terms)


@dataclass
class GLMResult(Saveable):
    names: list[str]
    coefficients: list[float]
    covariance: list[list[float]]
    family: str
    link: str
    theta: float
    dispersion: float
    deviance: float
    null_deviance: float
    log_likelihood: float
    aic: float
    bic: float
    n: int
    df_residual: int
    iterations: int
    converged: bool
    formula: str | None = None
    columns: list[str] = field(default_factory=list)

    @property
    def standard_errors(self) -> list[float]:
        return [math.sqrt(max(0.0, self.covariance[k][k])) for k in range(len(self.names))]

    @property
    def pseudo_r2(self) -> float:
        return 1 - self.deviance / self.null_deviance if self.null_deviance else 0.0

    def pvalues(self) -> list[float]:
        return [math.erfc(abs(b / s) / math.sqrt(2)) if s else 0.0 for b, s in zip(self.coefficients, self.standard_errors, strict=True)]

    def confint(self, alpha: float = 0.05) -> list[tuple[float, float]]:
        z = sp.normal_quantile(1 - alpha / 2)
        return [(b - z * s, b + z * s) for b, s in zip(self.coefficients, self.standard_errors, strict=True)]

    def _design(self) -> list[Column]:
        if self.formula:
            return [c for _, c in design(self.formula)[1]]
        return [F.lit(1.0) if n == "(Intercept)" else F.col(n).cast("double") for n in self.names]

    def predict(self, df: DataFrame, kind: str = "response", output: str = "prediction", interval: bool = False, level: float = 0.95, offset: str | None = None) -> DataFrame:
        """df with the prediction (link or response); with interval, bounds made on the link's scale."""
        x = self._design()
        _, link = create_family(self.family, self.link, self.theta)
        eta = linear(self.coefficients, x, offset)
        back = link.inverse if kind == "response" else (lambda e: e)
        new = {output: back(eta)}
        if interval:
            c = np.array(self.covariance)
            quad = total([x[i] * x[j] * F.lit(float(c[i, j])) for i in range(len(x)) for j in range(len(x))])
            half = F.lit(sp.normal_quantile(1 - (1 - level) / 2)) * F.sqrt(F.greatest(quad, F.lit(0.0)))
            a, b = back(eta - half), back(eta + half)
            new |= {f"{output}_lower": F.least(a, b), f"{output}_upper": F.greatest(a, b)}
        return df.withColumns(new)

    def residuals(self, df: DataFrame, y: str | Column) -> DataFrame:
        """df with fitted, response, Pearson, deviance and working residuals."""
        family, link = create_family(self.family, self.link, self.theta)
        y = (F.col(y) if isinstance(y, str) else y).cast("double")
        eta = linear(self.coefficients, self._design())
        m = family.bound(link.inverse(eta))
        return df.withColumns({"fitted": m, "residual": y - m, "pearson": (y - m) / F.sqrt(family.variance(m)), "deviance_residual": F.signum(y - m) * F.sqrt(F.greatest(family.deviance(y, m), F.lit(0.0))), "working": (y - m) / link.slope(eta)})

    def summary(self) -> str:
        head = f"{self.family} ({self.link}), n = {self.n}, deviance {self.deviance:.6g} (null {self.null_deviance:.6g}), AIC {self.aic:.6g}, BIC {self.bic:.6g}"
        rows = [f"{n:<20}{b:>14.6g}{s:>14.6g}{p:>12.4g}" for n, b, s, p in zip(self.names, self.coefficients, self.standard_errors, self.pvalues(), strict=True)]
        return "\n".join([head, f"{'':<20}{'estimate':>14}{'std. error':>14}{'p':>12}", *rows])


def _log_likelihood(family, rows: DataFrame, mu: Column, deviance: float, n: float, dispersion: float) -> tuple[float, int]:
    """Log-likelihood as in R, and the number of parameters beside the coefficients."""
    y, w = F.col("y"), F.col("w")
    if family.name == "gaussian":
        s = rows.agg(F.sum(F.ln(F.greatest(w, F.lit(1e-300))))).first()[0]
        return -(n * (math.log(2 * math.pi * deviance / n) + 1) - s) / 2 if deviance > 0 else math.inf, 1
    if family.name == "binomial":
        each = w * (y * F.ln(mu) + (1 - y) * F.ln(1 - mu))
        return rows.agg(F.sum(each)).first()[0], 0
    if family.name == "inverse_gaussian":
        d = deviance / n
        return rows.agg(F.sum(-(F.lit(math.log(2 * math.pi * d)) + 3 * F.ln(y)) / 2 * w)).first()[0] - n / 2, 1
    counted = rows.withColumn("m", mu).groupBy("y", "m").agg(F.sum("w").alias("w"))
    parts = counted.select("y", "m", "w").mapInPandas(_ll_rows(family.name, deviance / n, family.theta), "v double")
    return parts.agg(F.sum("v")).first()[0], 1 if family.name == "gamma" else 0


def _ll_rows(name: str, d: float, theta: float | None):
    def run(frames):
        import pandas as pd

        for f in frames:
            y, m, w = (f[c].to_numpy() for c in ("y", "m", "w"))
            lg = np.vectorize(math.lgamma, otypes=[float])
            if name == "poisson":
                v = np.where(y > 0, y * np.log(m), 0) - m - lg(y + 1)
            elif name == "gamma":
                a = 1 / d
                v = -a * y / m + (a - 1) * np.log(y) - a * np.log(m * d) - math.lgamma(a)
            else:
                v = lg(y + theta) - math.lgamma(theta) - lg(y + 1) + theta * np.log(theta / (theta + m)) + np.where(y > 0, y * np.log(m / (theta + m)), 0)
            yield pd.DataFrame({"v": v * w})

    return run


def fit_glm(df: DataFrame, y: str | Column, columns: list[str], family: str = "gaussian", link: str | None = None, intercept: bool = True, weights: str | None = None, offset: str | None = None, ridge: float = 0.0, max_iter: int = 100, tol: float = 1e-8, theta: float = 1.0, names: list[str] | None = None) -> GLMResult:
    """Iteratively reweighted least squares. Rows with a missing value are left out."""
    fam, lnk = create_family(family, link, theta)
    y = (F.col(y) if isinstance(y, str) else y).cast("double")
    x = [F.col(c).cast("double") for c in columns]
    rows = df.select(y.alias("y"), *(c.alias(f"x{k}") for k, c in enumerate(x)), (F.col(weights).cast("double") if weights else F.lit(1.0)).alias("w"), (F.col(offset).cast("double") if offset else F.lit(0.0)).alias("o"))
    rows = rows.dropna().where(~total([F.isnan(c).cast("int") for c in rows.columns]).cast("boolean")).persist()
    cols: list[Column] = ([F.lit(1.0)] if intercept else []) + [F.col(f"x{k}") for k in range(len(columns))]
    all_names = (["(Intercept)"] if intercept else []) + (names or columns)
    p, w, o = len(cols), F.col("w"), F.col("o")
    n = rows.count()
    if n <= 0:
        raise ValueError("no complete rows")
    mu = fam.bound(fam.start(F.col("y")))
    eta = None if lnk.name == "probit" else lnk.link(mu)
    beta, deviance, done, k = np.zeros(p), math.inf, False, 0
    for k in range(1, max_iter + 1):
        if eta is None:  # start of a probit fit: a line through the middle of its curve
            eta = lnk.link(mu)
        slope = lnk.slope(eta)
        slope = F.when(F.abs(slope) < 1e-10, F.lit(1e-10)).otherwise(slope)
        z = eta - o + (F.col("y") - mu) / slope
        ww = w * slope * slope / F.greatest(fam.variance(mu), F.lit(1e-10))
        made = rows.select(*(c.alias(f"c{i}") for i, c in enumerate(cols)), z.alias("z"), ww.alias("ww"))
        _, _, c = gram(made, [*(f"c{i}" for i in range(p)), "z"], "ww")
        a = c[:p, :p] + ridge * np.eye(p)
        beta = np.linalg.lstsq(a, c[:p, p], rcond=None)[0] if np.linalg.matrix_rank(a) < p else np.linalg.solve(a, c[:p, p])
        eta = linear(beta, cols, o)
        mu = fam.bound(lnk.inverse(eta))
        new = rows.agg(F.sum(w * fam.deviance(F.col("y"), mu))).first()[0]
        done = abs(new - deviance) < tol * (abs(new) + 0.1) if math.isfinite(deviance) else False
        deviance = new
        if done or (fam.name == "gaussian" and lnk.name == "identity"):
            done = True
            break
    slope = lnk.slope(eta)
    made = rows.select(*(c.alias(f"c{i}") for i, c in enumerate(cols)), (w * slope * slope / fam.variance(mu)).alias("ww"), F.col("y"), w.alias("w0"), mu.alias("mu"))
    _, _, c = gram(made, [f"c{i}" for i in range(p)], "ww")
    pearson, sum_w, sum_wy = made.agg(F.sum(F.col("w0") * (F.col("y") - F.col("mu")) ** 2 / fam.variance(F.col("mu"))), F.sum("w0"), F.sum(F.col("w0") * F.col("y"))).first()
    df_residual = n - p
    dispersion = 1.0 if fam.known_dispersion else pearson / max(1, df_residual)
    null_mu = F.lit(sum_wy / sum_w)
    null = rows.agg(F.sum(w * fam.deviance(F.col("y"), fam.bound(null_mu)))).first()[0]
    ll, extra = _log_likelihood(fam, rows, mu, deviance, n, dispersion)
    rows.unpersist()
    aic = -2 * ll + 2 * (p + extra)
    return GLMResult(all_names, beta.tolist(), (dispersion * np.linalg.pinv(c + ridge * np.eye(p))).tolist(), fam.name, lnk.name, theta, dispersion, deviance, null, ll, aic, -2 * ll + math.log(n) * (p + extra), n, df_residual, k, done, None, list(columns))


def fit_formula(df: DataFrame, formula: str, **options) -> GLMResult:
    """fit_glm on a formula's design; predictions apply the formula again."""
    made, names, f = apply_formula(df, formula)
    if f.random:
        raise ValueError("random terms need fit_glmm()")
    out = fit_glm(made, "y", [f"x{k}" for k in range(len(names))], intercept=False, names=names, **options)
    out.formula, out.columns = formula, names
    return out


def fit_lm(df: DataFrame, y: str, columns: list[str], **options) -> GLMResult:
    return fit_glm(df, y, columns, "gaussian", **options)


def fit_logit(df: DataFrame, y: str, columns: list[str], **options) -> GLMResult:
    return fit_glm(df, y, columns, "binomial", **options)


@dataclass
class MixedResult(Saveable):
    fixed: GLMResult
    group: str
    variance: float
    residual_variance: float
    effects: DataFrame
    iterations: int

    def predict(self, df: DataFrame, kind: str = "response", allow_new: bool = True, output: str = "prediction") -> DataFrame:
        """Groups that were not met have no effect, or raise."""
        _, link = create_family(self.fixed.family, self.fixed.link, self.fixed.theta)
        joined = df.join(self.effects, self.group, "left")
        u = F.col("effect") if allow_new else F.when(F.col("effect").isNotNull(), F.col("effect")).otherwise(F.raise_error(F.lit("unknown group")).cast("double"))
        eta = linear(self.fixed.coefficients, self.fixed._design()) + F.coalesce(u, F.lit(0.0))
        return joined.withColumn(output, link.inverse(eta) if kind == "response" else eta).drop("effect")


def fit_glmm(df: DataFrame, y: str, columns: list[str], group: str, family: str = "gaussian", link: str | None = None, max_iter: int = 50, tol: float = 1e-6) -> MixedResult:
    """A random intercept for each group, by penalised quasi-likelihood: fixed effects given the intercepts, intercepts given the
    fixed effects (one aggregate a group), and variances from both, in turn."""
    from ..session import cut

    fam, lnk = create_family(family, link)
    rows = df.select(F.col(group).alias("g"), F.col(y).cast("double").alias("y"), *(F.col(c).cast("double") for c in columns)).dropna().persist()
    effects = cut(rows.select("g").distinct().withColumn("effect", F.lit(0.0)))
    variance, residual, old, fit, k = 1.0, 1.0, None, None, 0
    for k in range(1, max_iter + 1):
        with_u = rows.join(effects, "g")
        fit = fit_glm(with_u, "y", columns, family, link, offset="effect", max_iter=25)
        x = [F.lit(1.0), *(F.col(c) for c in columns)]
        fixed = linear(fit.coefficients, x)
        eta = fixed + F.col("effect")
        mu = fam.bound(lnk.inverse(eta))
        slope = lnk.slope(eta)
        w = slope * slope / F.greatest(fam.variance(mu), F.lit(1e-10))
        z = eta + (F.col("y") - mu) / slope - fixed
        residual = fit.dispersion if not fam.known_dispersion else 1.0
        sums = with_u.groupBy("g").agg(F.sum(w).alias("sw"), F.sum(w * z).alias("swz"))
        new = sums.select("g", (F.col("swz") / (F.col("sw") + F.lit(residual / max(variance, 1e-10)))).alias("effect"), (F.lit(residual) / (F.col("sw") + F.lit(residual / max(variance, 1e-10)))).alias("v"))
        new = cut(new)
        variance = max(1e-6, new.agg(F.avg(F.col("effect") ** 2 + F.col("v"))).first()[0])
        effects = new.select("g", "effect")
        beta = np.array(fit.coefficients)
        if old is not None and np.abs(beta - old[0]).max() < tol and abs(variance - old[1]) < tol * (1 + variance):
            break
        old = (beta, variance)
    rows.unpersist()
    return MixedResult(fit, group, variance, residual, effects.withColumnRenamed("g", group), k)


@dataclass
class MultinomialResult(Saveable):
    classes: list
    names: list[str]
    coefficients: list[list[float]]  # one row a class but the first
    log_likelihood: float
    iterations: int
    converged: bool

    def _shares(self) -> list[Column]:
        x = [F.lit(1.0) if n == "(Intercept)" else F.col(n).cast("double") for n in self.names]
        eta = [F.lit(0.0), *(linear(b, x) for b in self.coefficients)]
        top = F.greatest(*eta)
        e = [F.exp(v - top) for v in eta]
        return [v / total(e) for v in e]

    def predict(self, df: DataFrame, kind: str = "class", output: str = "prediction") -> DataFrame:
        shares = self._shares()
        if kind == "probabilities":
            return df.withColumns({f"{output}_{c}": s for c, s in zip(self.classes, shares, strict=True)})
        best = F.array_max(F.array(*(F.struct(s.alias("p"), F.lit(-k).alias("k")) for k, s in enumerate(shares))))
        return df.withColumn(output, F.array(*(F.lit(c) for c in self.classes))[-best["k"]])


def fit_multinomial(df: DataFrame, y: str, columns: list[str], max_iter: int = 50, tol: float = 1e-8, ridge: float = 0.0) -> MultinomialResult:
    """Newton steps on the softmax model; the first class (sorted) is the reference."""
    rows = df.select(F.col(y).alias("y"), *(F.col(c).cast("double") for c in columns)).dropna().persist()
    classes = [r["y"] for r in rows.select("y").distinct().orderBy("y").collect()]
    p, k = len(columns) + 1, len(classes) - 1
    out = MultinomialResult(classes, ["(Intercept)", *columns], np.zeros((k, p)).tolist(), -math.inf, 0, False)
    x = [F.lit(1.0), *(F.col(c) for c in columns)]
    for step in range(1, max_iter + 1):
        shares = out._shares()[1:]
        first = out._shares()[0]
        is_ = [F.when(F.col("y") == F.lit(c), 1.0).otherwise(0.0) for c in classes]
        ll = F.sum(F.ln(F.greatest(total([i * s for i, s in zip(is_, [first, *shares], strict=True)]), F.lit(1e-300))))
        grad = [F.sum(x[a] * (is_[c + 1] - shares[c])) for c in range(k) for a in range(p)]
        hess = [F.sum(x[a] * x[b] * shares[c] * ((1.0 if c == d else 0.0) - shares[d])) for c in range(k) for d in range(c, k) for a in range(p) for b in range(p)]
        row = rows.agg(ll, *grad, *hess).first()
        g, h, at = np.array(row[1 : 1 + k * p]), np.zeros((k * p, k * p)), 1 + k * p
        for c in range(k):
            for d in range(c, k):
                block = np.array(row[at : at + p * p]).reshape(p, p)
                h[c * p : c * p + p, d * p : d * p + p] = block
                h[d * p : d * p + p, c * p : c * p + p] = block.T
                at += p * p
        beta = np.array(out.coefficients).reshape(-1)
        done = abs(row[0] - out.log_likelihood) < tol * (abs(row[0]) + 0.1)
        out.log_likelihood, out.iterations, out.converged = row[0], step, done
        if done:
            break
        out.coefficients = (beta + np.linalg.lstsq(h + ridge * np.eye(k * p), g - ridge * beta, rcond=None)[0]).reshape(k, p).tolist()
    rows.unpersist()
    return out


class GLM(Saveable):
    """One estimator for formulas and columns, several classes (one against the rest, or multinomial), several targets and groups."""

    def __init__(self, family: str = "gaussian", link: str | None = None, multiclass: str = "ovr", **options):
        self.family, self.link, self.multiclass, self.options, self.models = family, link, multiclass, options, {}

    def fit(self, df: DataFrame, formula: str | None = None, y: str | list[str] | None = None, columns: list[str] | None = None, group: str | None = None) -> GLM:
        options = {"family": self.family, "link": self.link, **self.options}
        self.targets = y if y is not None else formula.split("~")[0].strip()
        if formula and "|" in formula:
            made, names, f = apply_formula(df, formula)
            named = made.select(F.col("y").alias("y"), *(F.col(f"x{k}").alias(n) for k, n in enumerate(names) if n != "(Intercept)"), F.col("group0").alias(f.random[0].group))
            self.models = {"mixed": fit_glmm(named, "y", [n for n in names if n != "(Intercept)"], f.random[0].group, self.family, self.link)}
        elif formula:
            self.models = {"single": fit_formula(df, formula, **options)}
        elif group:
            self.models = {"mixed": fit_glmm(df, y, columns, group, self.family, self.link)}
        elif isinstance(y, list):
            data = df.dropna(subset=[*y, *columns])
            ones = total([F.col(t).cast("double") for t in y])
            share = data.agg(F.avg(F.when((ones == 1) & (F.greatest(*(F.col(t).cast("double") for t in y)) == 1), 1.0).otherwise(0.0))).first()[0]
            if self.family == "binomial" and len(y) > 1 and share == 1.0:  # exclusive targets are classes of one model
                label = F.coalesce(*(F.when(F.col(t).cast("double") == 1, F.lit(t)) for t in y))
                self.models = {"multinomial": fit_multinomial(data.withColumn("__class", label), "__class", columns)}
            else:
                self.models = {t: fit_glm(data, t, columns, **options) for t in y}
        elif self.family == "binomial" and dict(df.dtypes)[y] == "string":
            classes = [r[0] for r in df.select(y).dropna().distinct().orderBy(y).collect()]
            if self.multiclass == "multinomial":
                self.models = {"multinomial": fit_multinomial(df, y, columns)}
            else:
                one = lambda c: fit_glm(df.withColumn("__y", F.when(F.col(y) == c, 1.0).otherwise(0.0)), "__y", columns, **options)
                self.models = {c: one(c) for c in (classes[1:] if len(classes) == 2 else classes)}
                self.classes = classes
        else:
            self.models = {"single": fit_glm(df, y, columns, **options)}
        return self

    def predict(self, df: DataFrame, **options) -> DataFrame:
        if not self.models:
            raise RuntimeError("fit() comes first")
        names = list(self.models)
        if len(names) == 1 and names[0] in ("single", "mixed", "multinomial"):
            return self.models[names[0]].predict(df, **options)
        out = df
        for k, n in enumerate(names):
            out = self.models[n].predict(out, output=f"__p{k}" if hasattr(self, "classes") else f"prediction_{n}", **options)
        if not hasattr(self, "classes"):
            return out
        if len(self.classes) == 2:
            return out.withColumn("prediction", F.when(F.col("__p0") >= 0.5, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0]))).drop("__p0")
        best = F.array_max(F.array(*(F.struct(F.col(f"__p{k}").alias("p"), F.lit(-k).alias("k")) for k in range(len(names)))))
        return out.withColumn("prediction", F.array(*(F.lit(c) for c in names))[-best["k"]]).drop(*(f"__p{k}" for k in range(len(names))))

    def score(self, df: DataFrame) -> float:
        """R2 of predictions for numbers, accuracy for classes; the mean over several targets."""
        from . import metrics

        if not self.models:
            raise ValueError("fit() comes first")
        targets = self.targets if isinstance(self.targets, list) else [self.targets]
        out, scores = self.predict(df), []
        for t in targets:
            p = f"prediction_{t}" if len(targets) > 1 else "prediction"
            measure = metrics.accuracy if self.family == "binomial" and dict(out.dtypes)[p] == dict(df.dtypes).get(t) else metrics.r2
            scores.append(out.agg(measure(t, p)).first()[0])
        return sum(scores) / len(scores)

    def summary(self) -> str:
        return "\n\n".join(m.summary() if hasattr(m, "summary") else str(m) for m in self.models.values())


def compare_models(models: dict[str, GLMResult], criterion: str = "aic") -> list[dict]:
    """By the criterion, with differences to the best, exp(-difference / 2), and Akaike weights (these sum to 1)."""
    value = {k: getattr(m, criterion) for k, m in models.items()}
    best = min(value.values())
    e = {k: math.exp(-(v - best) / 2) for k, v in value.items()}
    return [{"model": k, criterion: value[k], "delta": value[k] - best, "relative_likelihood": e[k], "weight": e[k] / sum(e.values()), "log_likelihood": models[k].log_likelihood} for k in sorted(value, key=value.get)]


def likelihood_ratio_test(a: GLMResult, b: GLMResult) -> dict:
    small, large = sorted((a, b), key=lambda m: len(m.names))
    df = len(large.names) - len(small.names)
    x = max(0.0, 2 * (large.log_likelihood - small.log_likelihood))
    return {"statistic": x, "df": df, "p_value": sp.chi2_sf(x, df) if df else 1.0}


def pairwise_lrt(models: dict[str, GLMResult]) -> list[dict]:
    names = list(models)
    return [{"model1": a, "model2": b, **likelihood_ratio_test(models[a], models[b])} for i, a in enumerate(names) for b in names[i + 1 :] if len(models[a].names) != len(models[b].names)]


def coefficient_table(models: dict[str, GLMResult], alpha: float = 0.05) -> list[dict]:
    return [{"model": k, "term": n, "estimate": b, "lower": lo, "upper": hi} for k, m in models.items() for n, b, (lo, hi) in zip(m.names, m.coefficients, m.confint(alpha), strict=True)]
