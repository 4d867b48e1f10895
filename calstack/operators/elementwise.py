"""Expressions of one row: functions of a column and reductions of several.

Missing is NULL; NaN is never stored. Division, remainder and logarithms follow
IEEE arithmetic (infinities, not errors), whatever ANSI mode is set.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def number(value: float | None) -> Column:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return F.lit(None).cast("double")
    return F.lit(float(value))


def valid(x: Column) -> Column:
    """NaN becomes missing."""
    return F.when(~F.isnan(x), x)


def all_valid(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, (c.isNotNull() for c in columns))


def divide(a: Column, b: Column) -> Column:
    by = F.when(b != 0, b)
    return valid(F.when(b == 0, a * F.lit(INF)).otherwise(a / by))


def remainder(a: Column, b: Column) -> Column:
    """Sign of the divisor; a zero divisor gives a missing value."""
    by = F.when(b != 0, b)
    return valid(a - F.floor(a / by).cast("double") * by)


def power(a: Column, b: Column) -> Column:
    return valid(F.pow(a, b))


def log(x: Column) -> Column:
    return F.when(x == 0, F.lit(-INF)).when(x > 0, F.ln(x))


def log1p(x: Column) -> Column:
    return F.when(x == -1, F.lit(-INF)).when(x > -1, F.log1p(x))


FUNCTIONS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "neg": ("Additive inverse", lambda x: -x),
    "inv": ("Multiplicative inverse", lambda x: divide(F.lit(1.0), x)),
    "abs": ("Absolute value", F.abs),
    "sqrt": ("Square root", lambda x: F.when(x >= 0, F.sqrt(x))),
    "log": ("Natural logarithm", log),
    "exp": ("Exponential", F.exp),
    "lnot": ("1 where the value is 0, else 0, missing included", lambda x: F.when(x == 0, F.lit(1.0)).otherwise(F.lit(0.0))),
    "expm1": ("Exponential minus one", F.expm1),
    "log1p": ("Natural logarithm of one more", log1p),
    "sign": ("Sign", F.signum),
    "inc": ("One more", lambda x: x + F.lit(1.0)),
    "dec": ("One less", lambda x: x - F.lit(1.0)),
    "zero_to_na": ("Zeros become missing", lambda x: F.when(x != 0, x)),
}


def fold(step: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    """A left fold over an array of valid values."""
    return lambda a: F.aggregate(F.slice(a, 2, 1 << 30), F.element_at(a, 1), step)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def variance(a: Column) -> Column:
    """Of the whole population, in two passes."""
    return F.element_at(F.transform(F.array(mean(a)), lambda m: mean(F.transform(a, lambda x: (x - m) * (x - m)))), 1)


def median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return (F.get(s, low) + F.get(s, high)) / 2


#: Reductions over an array of valid values, and for all-valid rows a plain form
#: that stays within generated code.
REDUCTIONS: dict[str, tuple[str, Callable[[Column], Column], Callable[[list[Column]], Column] | None]] = {
    "add": ("Sum", total, lambda c: reduce(lambda a, b: a + b, c)),
    "sub": ("Difference", fold(lambda a, b: a - b), lambda c: reduce(lambda a, b: a - b, c)),
    "mul": ("Product", fold(lambda a, b: a * b), lambda c: reduce(lambda a, b: a * b, c)),
    "div": ("Quotient", fold(divide), lambda c: reduce(divide, c)),
    "pow": ("Power", fold(power), lambda c: reduce(power, c)),
    "mod": ("Remainder", fold(remainder), lambda c: reduce(remainder, c)),
    "avg": ("Arithmetic mean", mean, lambda c: reduce(lambda a, b: a + b, c) / len(c)),
    "std": ("Standard deviation of the population", lambda a: F.sqrt(variance(a)), None),
    "var": ("Variance of the population", variance, None),
    "min": ("Least", F.array_min, lambda c: F.least(*c) if len(c) > 1 else c[0]),
    "max": ("Greatest", F.array_max, lambda c: F.greatest(*c) if len(c) > 1 else c[0]),
    "med": ("Median", median, None),
}


def reduction(name: str, columns: list[Column], ignore_missing: bool) -> Column:
    """Missing if any value is; ignoring them, only if all are."""
    _, over_array, plain = REDUCTIONS[name]
    if not ignore_missing:
        return F.when(all_valid(columns), valid(plain(columns) if plain else over_array(F.array(*columns))))
    kept = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, valid(over_array(kept)))


def rank(columns: list[Column], which: int) -> Column:
    """0-based place of one column's value among all, missing last, ties in order."""
    x = columns[which]
    place = F.lit(0)
    for j, y in enumerate(columns):
        if j != which:
            first = (y <= x) if j < which else (y < x)
            beside = y.isNotNull() | F.lit(j < which)
            place = place + F.when(x.isNotNull(), F.when(y.isNotNull() & first, 1).otherwise(0)).otherwise(F.when(beside, 1).otherwise(0))
    return place.cast("double")
