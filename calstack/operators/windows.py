"""Window expressions over the valid rows of a group.

`ok` marks the rows in which every column of the group is valid and which lie in the
evaluated range. It is part of the window's partition, so frames count valid rows
only and one sort serves all columns and frames of the group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from calstack.operators.elementwise import divide, valid

#: Windows wider than this are put together from two parts instead of framed anew for each row.
WIDE = 256


@dataclass(frozen=True)
class Rows:
    """The ordered valid rows of a group."""

    keys: tuple[str, ...]
    ok: Column
    descending: bool = False

    @property
    def spec(self) -> WindowSpec:
        order = F.desc("ordinal") if self.descending else F.asc("ordinal")
        return Window.partitionBy(*self.keys, self.ok).orderBy(order)

    @property
    def so_far(self) -> WindowSpec:
        return self.spec.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, self.ok)

    def last(self, n: int) -> WindowSpec:
        return self.spec.rowsBetween(-(n - 1), 0)

    def block(self, k: Column, n: int, descending: bool) -> WindowSpec:
        """The rows of a row's block of n, up to it in order or in reverse."""
        order = F.desc("ordinal") if descending else F.asc("ordinal")
        return Window.partitionBy(*self.keys, self.ok, F.floor(k / n)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)

    def lag(self, x: Column, n: int) -> Column:
        return F.lag(x, n).over(self.spec) if n else x


def full(rows: Rows, n: int, x: Column) -> Column:
    """x where n valid rows have been seen."""
    return F.when(F.row_number().over(rows.spec) >= n, x)


def first_or_ratio(rows: Rows, x: Column) -> Column:
    first = F.first(x).over(rows.so_far)
    return F.when(first != 0, x / F.when(first != 0, first) - 1)


CUMULATIVE: dict[str, tuple[str, Callable[[Rows, Column], Column]]] = {
    "add": ("Running sum", lambda r, x: F.sum(x).over(r.so_far)),
    "sub": ("First value less all later ones", lambda r, x: F.first(x).over(r.so_far) * 2 - F.sum(x).over(r.so_far)),
    "mul": ("Running product", lambda r, x: valid(F.product(x).over(r.so_far))),
    "avg": ("Running mean", lambda r, x: F.avg(x).over(r.so_far)),
    "std": ("Running standard deviation of the sample", lambda r, x: F.when(F.count(x).over(r.so_far) > 1, F.stddev_samp(x).over(r.so_far))),
    "var": ("Running variance of the sample", lambda r, x: F.when(F.count(x).over(r.so_far) > 1, F.var_samp(x).over(r.so_far))),
    "min": ("Running least", lambda r, x: F.min(x).over(r.so_far)),
    "max": ("Running greatest", lambda r, x: F.max(x).over(r.so_far)),
    "lag": ("First value", lambda r, x: F.first(x).over(r.so_far)),
    "dif": ("Difference from the first value", lambda r, x: x - F.first(x).over(r.so_far)),
    "ret": ("Return since the first value", first_or_ratio),
}


def at_least(rows: Rows, n: int, least: int, x: Column) -> Column:
    return F.when(F.row_number().over(rows.spec) >= min(least, n) if least > 1 else F.lit(True), x)


def z_score(rows: Rows, x: Column, n: int) -> Column:
    std = F.stddev_pop(x).over(rows.last(n))
    return at_least(rows, 2, 2, F.when(std != 0, (x - F.avg(x).over(rows.last(n))) / F.when(std != 0, std)))


ROLLING: dict[str, tuple[str, Callable[[Rows, Column, int], Column]]] = {
    "add": ("Rolling sum", lambda r, x, n: full(r, n, F.sum(x).over(r.last(n)))),
    "avg": ("Rolling mean of at least two values", lambda r, x, n: at_least(r, 2, 2, F.avg(x).over(r.last(n)))),
    "std": ("Rolling standard deviation of the population", lambda r, x, n: full(r, n, F.stddev_pop(x).over(r.last(n)))),
    "var": ("Rolling variance of the population", lambda r, x, n: full(r, n, F.var_pop(x).over(r.last(n)))),
    "min": ("Rolling least", lambda r, x, n: full(r, n, F.min(x).over(r.last(n)))),
    "max": ("Rolling greatest", lambda r, x, n: full(r, n, F.max(x).over(r.last(n)))),
    "med": ("Rolling median", lambda r, x, n: full(r, n, F.percentile(x, F.lit(0.5)).over(r.last(n)))),
    "lag": ("Value n - 1 rows before", lambda r, x, n: r.lag(x, n - 1)),
    "dif": ("Difference from n - 1 rows before", lambda r, x, n: x - r.lag(x, n - 1)),
    "ret": ("Return since n - 1 rows before", lambda r, x, n: valid(divide(x, r.lag(x, n - 1)) - 1)),
    "zsc": ("Rolling z-score", z_score),
}


def covariance(rows: Rows, x: list[Column], n: int) -> Column:
    """Mean of products less product of means, of any number of columns."""
    product, means = x[0], F.avg(x[0]).over(rows.last(n))
    for y in x[1:]:
        product, means = product * y, means * F.avg(y).over(rows.last(n))
    return full(rows, n, F.avg(product).over(rows.last(n)) - means)


def correlation(rows: Rows, x: list[Column], n: int) -> Column:
    """Covariance over the product of variances."""
    spread = F.var_pop(x[0]).over(rows.last(n))
    for y in x[1:]:
        spread = spread * F.var_pop(y).over(rows.last(n))
    return divide(covariance(rows, x, n), spread)


def block_rows(window: int) -> int:
    """Rows over which the weights of an exponential window stay within doubles."""
    import math

    decay = 1 - 2 / (window + 1.0)
    return max(1, int(345 / -math.log(decay))) if decay > 0 else 1


def exponential_steps(rows: Rows, window: int):
    """Three layers of expressions for y = a * x + (1 - a) * y of the row before, the
    first y being the first x. Rows are cut into blocks within which weights cannot
    overflow; a block starts from the last value of the one before, whose own start
    has no weight left that a double could show. Each layer maps the columns of the
    one before (x, k, s) to an expression."""
    alpha = 2 / (window + 1.0)
    decay, size = 1 - alpha, block_rows(window)

    def number(x: Column) -> Column:
        return F.row_number().over(rows.spec) - 1

    def within(x: Column, k: Column) -> Column:
        j = F.pmod(k, F.lit(size)).cast("double")
        spec = Window.partitionBy(*rows.keys, rows.ok, F.floor(k / size)).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
        return F.pow(F.lit(decay), j) * F.sum(x * F.lit(alpha) * F.pow(F.lit(decay), -j)).over(spec)

    def carried(x: Column, k: Column, s: Column) -> Column:
        j = F.pmod(k, F.lit(size)).cast("double")
        block = F.floor(k / size)
        before = Window.partitionBy(*rows.keys, rows.ok).orderBy(block).rangeBetween(-1, -1)
        last = F.max(F.struct(k.alias("k"), s.alias("s"))).over(before)["s"]
        start = F.when(block == 0, F.first(x).over(rows.so_far)).otherwise(last)
        return s + F.pow(F.lit(decay), j + 1) * start

    return number, within, carried


def bias(k: Column, window: int) -> Column:
    """Correction of an exponentially weighted variance on row k (from 0)."""
    decay = 1 - 2 / (window + 1.0)
    m = F.least(k + 1, F.lit(window)).cast("double")
    if decay <= 0:
        return F.lit(None).cast("double")
    one = (1 - F.pow(F.lit(decay), m)) / (1 - decay)
    two = (1 - F.pow(F.lit(decay * decay), m)) / (1 - decay * decay)
    under = one * one - two
    return F.when(k > 0, one * one / F.when(under > 0, under))
