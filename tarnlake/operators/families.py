"""Links and exponential families as expressions of the mean and of the linear predictor."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SQRT2, SQRT2PI = math.sqrt(2), math.sqrt(2 * math.pi)


def normal_cdf(x: Column) -> Column:
    """By erf's series near zero and erfc's continued fraction beyond, both of fixed length."""
    z = F.abs(x) / F.lit(SQRT2)
    # erf by its Maclaurin series for small arguments, erfc by a continued fraction beyond.
    series = F.lit(0.0)
    for k in range(30, -1, -1):
        series = F.lit((-1) ** k / math.factorial(k) / (2 * k + 1)) + z * z * series if k < 30 else F.lit(1 / math.factorial(30) / 61)
    erf = F.lit(2 / math.sqrt(math.pi)) * z * series
    fraction = z
    for k in range(40, 0, -1):
        fraction = z + F.lit(k / 2) / fraction
    erfc = F.exp(-z * z) / F.lit(math.sqrt(math.pi)) / fraction
    upper = F.when(z < 2, (1 - erf) / 2).otherwise(erfc / 2)
    return F.when(x > 0, 1 - upper).otherwise(upper)


@dataclass(frozen=True)
class Link:
    """g(mu), its inverse, and the derivative of the mean by the predictor."""

    name: str
    link: Callable[[Column], Column]
    inverse: Callable[[Column], Column]
    slope: Callable[[Column], Column]
    scalar: Callable[[float], float]
    scalar_inverse: Callable[[float], float]


def _probit(p: float) -> float:
    from ..functions.special import normal_quantile

    return normal_quantile(p)


def _phi(x: float) -> float:
    return math.erfc(-x / SQRT2) / 2


def _expit(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def _sigmoid(e: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), e))))


LINKS = {
    "identity": Link("identity", lambda m: m, lambda e: e, lambda e: F.lit(1.0), lambda m: m, lambda e: e),
    "log": Link("log", F.ln, lambda e: F.exp(F.least(e, F.lit(700.0))), lambda e: F.exp(F.least(e, F.lit(700.0))), math.log, math.exp),
    "logit": Link("logit", lambda m: F.ln(m / (1 - m)), _sigmoid, lambda e: _sigmoid(e) * (1 - _sigmoid(e)), lambda m: math.log(m / (1 - m)), _expit),
    "probit": Link("probit", lambda m: F.lit(SQRT2PI) * (m - 0.5), normal_cdf, lambda e: F.exp(-e * e / 2) / F.lit(SQRT2PI), _probit, _phi),
    "inverse": Link("inverse", lambda m: 1 / m, lambda e: 1 / e, lambda e: -1 / (e * e), lambda m: 1 / m, lambda e: 1 / e),
    "inverse_squared": Link("inverse_squared", lambda m: 1 / (m * m), lambda e: 1 / F.sqrt(e), lambda e: -1 / (2 * F.pow(e, F.lit(1.5))), lambda m: 1 / m**2, lambda e: 1 / math.sqrt(e)),
    "sqrt": Link("sqrt", F.sqrt, lambda e: e * e, lambda e: 2 * e, math.sqrt, lambda e: e * e),
}


def _ylogy(y: Column, m: Column) -> Column:
    return F.when(y > 0, y * F.ln(y / m)).otherwise(0.0)


@dataclass(frozen=True)
class Family:
    """Variance function, starting mean, unit deviance, and minus twice the log-likelihood of a row (given the dispersion's estimate)."""

    name: str
    canonical: str
    links: tuple[str, ...]
    variance: Callable[[Column], Column]
    start: Callable[[Column], Column]
    deviance: Callable[[Column, Column], Column]
    known_dispersion: bool
    clip: tuple[float | None, float | None] = (None, None)
    theta: float | None = None

    def bound(self, m: Column) -> Column:
        low, high = self.clip
        if low is not None:
            m = F.greatest(m, F.lit(low))
        return F.least(m, F.lit(high)) if high is not None else m


def _binomial_deviance(y, m):
    return 2 * (_ylogy(y, m) + _ylogy(1 - y, 1 - m))


def _families(theta: float) -> dict[str, Family]:
    tiny = 1e-10
    return {
        "gaussian": Family("gaussian", "identity", ("identity", "log", "inverse"), lambda m: F.lit(1.0), lambda y: y, lambda y, m: (y - m) * (y - m), False),
        "binomial": Family("binomial", "logit", ("logit", "probit", "log", "identity"), lambda m: m * (1 - m), lambda y: (y + 0.5) / 2, _binomial_deviance, True, (tiny, 1 - tiny)),
        "poisson": Family("poisson", "log", ("log", "identity", "sqrt"), lambda m: m, lambda y: F.greatest(y + 0.1, F.lit(0.1)), lambda y, m: 2 * (_ylogy(y, m) - (y - m)), True, (tiny, None)),
        "gamma": Family("gamma", "inverse", ("inverse", "log", "identity"), lambda m: m * m, lambda y: F.greatest(y, F.lit(tiny)), lambda y, m: 2 * ((y - m) / m - F.ln(y / m)), False, (tiny, None)),
        "inverse_gaussian": Family("inverse_gaussian", "inverse_squared", ("inverse_squared", "inverse", "log", "identity"), lambda m: m * m * m, lambda y: F.greatest(y, F.lit(tiny)), lambda y, m: (y - m) * (y - m) / (y * m * m), False, (tiny, None)),
        "negative_binomial": Family("negative_binomial", "log", ("log", "identity", "sqrt"), lambda m: m + m * m / F.lit(theta), lambda y: y + 1 / 6, lambda y, m: 2 * (_ylogy(y, m) - (y + F.lit(theta)) * F.ln((y + F.lit(theta)) / (m + F.lit(theta)))), True, (tiny, None), theta),
    }


ALIASES = {"normal": "gaussian", "bernoulli": "binomial", "inversegaussian": "inverse_gaussian", "negativebinomial": "negative_binomial", "nb": "negative_binomial"}


def create_family(family: str = "gaussian", link: str | None = None, theta: float = 1.0) -> tuple[Family, Link]:
    name = ALIASES.get(family.lower(), family.lower())
    families = _families(theta)
    if name not in families:
        raise ValueError(f"no family {family}; known: {', '.join(families)}")
    f = families[name]
    link = link or f.canonical
    if link not in f.links:
        raise ValueError(f"{name} takes the links {', '.join(f.links)}")
    return f, LINKS[link]


def canonical_link(family: str) -> str:
    return create_family(family)[0].canonical
