"""Model formulas `y ~ terms + (random | group)` as column expressions. Arithmetic is parsed, never evaluated as code.

`a:b` is a product, `a*b` stands for a + b + a:b, `- 1` and `0` drop the intercept, `- term` takes a term out."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRANSFORMS = {"log": F.ln, "log10": F.log10, "log2": F.log2, "sqrt": F.sqrt, "exp": F.exp, "abs": F.abs, "sin": F.sin, "cos": F.cos, "tan": F.tan}
_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z_][\w.]*)|(\*\*|.))")


def transform(name: str, c: Column) -> Column:
    """A function of a column; logarithms of 0 are -Infinity and of negative numbers NaN."""
    if name not in TRANSFORMS:
        raise ValueError(f"no function {name}; known: {', '.join(TRANSFORMS)}")
    out = TRANSFORMS[name](c)
    if name.startswith("log"):
        out = F.when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan"))).otherwise(out)
    return out


class Arithmetic:
    """+ - * / ^ ** parentheses, numbers, columns and the functions above."""

    def __init__(self, text: str):
        self.tokens = [m.group(1, 2, 3) for m in _TOKEN.finditer(text.strip()) if m.group(0).strip()]
        self.at, self.text = 0, text

    def _peek(self) -> str | None:
        return self.tokens[self.at][2] if self.at < len(self.tokens) else None

    def parse(self) -> Column:
        out = self._sum()
        if self.at != len(self.tokens):
            raise ValueError(f"cannot read {self.text!r}")
        return out

    def _sum(self) -> Column:
        out = self._product()
        while (op := self._peek()) in ("+", "-"):
            self.at += 1
            out = out + self._product() if op == "+" else out - self._product()
        return out

    def _product(self) -> Column:
        out = self._sign()
        while (op := self._peek()) in ("*", "/"):
            self.at += 1
            out = out * self._sign() if op == "*" else F.try_divide(out, self._sign())
        return out

    def _sign(self) -> Column:
        if (op := self._peek()) in ("+", "-"):
            self.at += 1
            return self._sign() if op == "+" else -self._sign()
        return self._power()

    def _power(self) -> Column:
        base = self._atom()
        if self._peek() in ("^", "**"):
            self.at += 1
            return F.pow(base, self._sign())
        return base

    def _atom(self) -> Column:
        if self.at >= len(self.tokens):
            raise ValueError(f"cannot read {self.text!r}")
        number, name, other = self.tokens[self.at]
        self.at += 1
        if number:
            return F.lit(float(number))
        if name and self._peek() != "(":
            return F.col(f"`{name}`" if "." in name else name).cast("double")
        if name:
            self.at += 1
            inner = self._close()
            return transform(name, inner)
        if other == "(":
            return self._close()
        raise ValueError(f"cannot read {self.text!r}")

    def _close(self) -> Column:
        out = self._sum()
        if self._peek() != ")":
            raise ValueError(f"a parenthesis is open in {self.text!r}")
        self.at += 1
        return out


def expression(text: str) -> Column:
    return Arithmetic(text).parse()


@dataclass
class Random:
    group: str
    intercept: bool
    slopes: list[str]


@dataclass
class Formula:
    response: str
    terms: list[tuple[str, ...]]
    intercept: bool = True
    random: list[Random] = field(default_factory=list)
    original: str = ""


def _cut(text: str, marks: str) -> list[tuple[str, str]]:
    """Parts of a text at marks outside of parentheses, each with the mark before it."""
    out, depth, now, mark = [], 0, "", "+"
    for c in text:
        depth += (c == "(") - (c == ")")
        if c in marks and not depth:
            if now.strip() or out:
                out.append((mark, now.strip()))
            now, mark = "", c
        else:
            now += c
    return [(m, p) for m, p in [*out, (mark, now.strip())] if p]


def parse_formula(text: str) -> Formula:
    if text.count("~") != 1:
        raise ValueError("a formula has one ~")
    left, right = (x.strip() for x in text.split("~"))
    out = Formula(left, [], original=text)
    for sign, part in _cut(right, "+-"):
        if part.startswith("(") and "|" in part:
            inner, group = part[1:-1].split("|")
            names = [p for _, p in _cut(inner, "+")]
            out.random.append(Random(group.strip(), "0" not in names, [n for n in names if n not in ("0", "1")]))
        elif part in ("0", "1"):
            out.intercept = (part == "1") == (sign == "+")
        else:
            factors = [p for _, p in _cut(part, "*")]
            new = [tuple(f for s in subset for _, f in _cut(s, ":")) for subset in _subsets(factors)]
            if sign == "-":
                out.terms = [t for t in out.terms if t not in new]
            else:
                out.terms += [t for t in new if t not in out.terms]
    return out


def _subsets(factors: list[str]) -> list[list[str]]:
    """Non-empty subsets, smaller ones first."""
    out = [[f for k, f in enumerate(factors) if bits >> k & 1] for bits in range(1, 1 << len(factors))]
    return sorted(out, key=len)


def _factor(text: str) -> list[tuple[str, Column]]:
    if m := re.fullmatch(r"I\((.*)\)", text):
        return [(text, expression(m[1]))]
    if m := re.fullmatch(r"poly\(\s*([\w.]+)\s*,\s*(\d+)\s*\)", text):
        return [(m[1] if k == 1 else f"{m[1]}^{k}", F.pow(F.col(m[1]).cast("double"), F.lit(float(k)))) for k in range(1, int(m[2]) + 1)]
    return [(text, expression(text))]


def design(formula: str | Formula, intercept: bool | None = None) -> tuple[Column, list[tuple[str, Column]], Formula]:
    """Response, and the design's named columns, `(Intercept)` first."""
    f = parse_formula(formula) if isinstance(formula, str) else formula
    keep = f.intercept if intercept is None else intercept
    out: list[tuple[str, Column]] = [("(Intercept)", F.lit(1.0))] if keep else []
    for term in f.terms:
        parts = [("", None)]
        for factor in term:
            parts = [(f"{n}:{m}" if n else m, c if v is None else v * c) for n, v in parts for m, c in _factor(factor)]
        out += parts
    return expression(f.response), out, f


def apply_formula(df: DataFrame, formula: str, keep: list[str] | None = None) -> tuple[DataFrame, list[str], Formula]:
    """df's keep columns with response y, the design as x0, x1, .. and the random groups; the design's names; the formula."""
    y, columns, f = design(formula)
    out = df.select(*(keep or []), y.alias("y"), *(c.alias(f"x{k}") for k, (_, c) in enumerate(columns)), *(F.col(r.group).alias(f"group{k}") for k, r in enumerate(f.random)))
    return out, [n for n, _ in columns], f
