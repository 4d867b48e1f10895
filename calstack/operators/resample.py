"""From one calendar to another: slots are grouped by the target slot they end in.

A target slot has a value only if its last day is also the last day of a source
slot, so a finer calendar gets gaps. `last` and `first` look across the borders of
periods within the slots evaluated; the others see their own period's slots only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calstack.functions.calendar import Periodicity, Range

METHODS = ("last", "sum", "avg", "lastnofill", "min", "max", "first", "firstnofill")


def resampled(frame: DataFrame, source: Range, to: Periodicity, wanted: list[tuple[str, str, str]], keys: tuple[str, ...]) -> DataFrame:
    """(keys, ordinal, columns) of `wanted`: (column of `frame`, method, new name)."""
    order = Window.partitionBy(*keys).orderBy("ordinal")
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    filled: dict[tuple[str, str], Column] = {}
    for column, method, _ in wanted:
        if method in ("last", "first"):
            spec, pick = (before, F.last) if method == "last" else (after, F.first)
            filled[column, method] = pick(F.col(column), ignorenulls=True).over(spec).alias(f"{column}_{method}")
    end = source.periodicity.end_column(F.col("ordinal"))
    slots = frame.select("*", *filled.values(), end.alias("_end")).withColumn("_to", to.ordinal_column(F.col("_end")))
    slots = slots.withColumn("_ends", F.col("_end") == to.end_column(F.col("_to")))

    def aggregate(column: str, method: str) -> Column:
        x = F.col(column)
        return {
            "last": lambda: F.max_by(F.col(f"{column}_last"), F.col("ordinal")),
            "lastnofill": lambda: F.max_by(x, F.col("ordinal")),
            "first": lambda: F.min_by(F.col(f"{column}_first"), F.col("ordinal")),
            "firstnofill": lambda: F.min_by(x, F.col("ordinal")),
            "sum": lambda: F.coalesce(F.sum(x), F.lit(0.0)),
            "avg": lambda: F.avg(x),
            "min": lambda: F.min(x),
            "max": lambda: F.max(x),
        }[method]()

    made = slots.groupBy(*keys, "_to").agg(F.max("_ends").alias("_ends"), *(aggregate(c, m).alias(n) for c, m, n in wanted))
    return made.where("_ends").select(*keys, F.col("_to").alias("ordinal"), *(n for _, _, n in wanted))
