"""Series from pandas frames, and from tables whose rows are aggregated by period."""

from __future__ import annotations

import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calstack.functions.calendar import Period, Periodicity, Range, periodicity


class PandasFrame:
    """A pandas frame with a regular DatetimeIndex. On another calendar its values are
    matched on their exact date, or (round_) on the slot that holds it, which on a
    finer calendar looks ahead to the slot's end."""

    exact = True
    keys: tuple[str, ...] = ()

    def __init__(self, pandas: Any, round_: bool = False) -> None:
        import pandas as pd

        frame = pandas.to_frame() if isinstance(pandas, pd.Series) else pandas
        self.round_ = round_
        self.headers = [str(c) for c in frame.columns]
        self.range = Range.from_index(frame.index)
        self.periodicity = self.range.periodicity
        self.ordinals = [self.periodicity.ordinal(d.date()) for d in frame.index]
        self.data = frame.astype("float64").to_numpy()

    def bounds(self) -> tuple[datetime.date, datetime.date] | None:
        ends = [self.periodicity.end(o) for o in (self.range.start, self.range.stop - 1)]
        return ends[0], ends[1]

    def frame(self, spark: SparkSession, start: int, stop: int, columns: list[int], keys: list[str]) -> DataFrame:
        rows = [(o, *(None if v != v else float(v) for v in (self.data[i, c] for c in columns))) for i, o in enumerate(self.ordinals) if start <= o < stop]
        return spark.createDataFrame(rows, ", ".join(["ordinal long", *(f"v{c} double" for c in columns)]))

    def entities(self, keys: tuple[str, ...]) -> DataFrame:
        raise ValueError("a pandas frame has no keys")


class Facts:
    """A table aggregated by period and key: header -> (function, column). Only the
    columns and days that a program needs are read; the aggregation runs in parallel
    before anything is put in order of time."""

    exact = False
    round_ = False

    def __init__(self, table: DataFrame, date: str, values: dict[str, tuple[str, str | Column]], period: str | Periodicity = "B", keys: tuple[str, ...] = ()) -> None:
        self.table, self.date, self.values = table, date, values
        self.periodicity, self.keys = periodicity(period), keys
        self.headers = list(values)

    def bounds(self) -> tuple[datetime.date, datetime.date] | None:
        low, high = self.table.select(F.min(F.col(self.date).cast("date")), F.max(F.col(self.date).cast("date"))).first()
        if low is None:
            return None
        return self.periodicity.end(self.periodicity.ordinal(low)), self.periodicity.end(self.periodicity.ordinal(high))

    def frame(self, spark: SparkSession, start: int, stop: int, columns: list[int], keys: list[str]) -> DataFrame:
        first, last = Period(start, self.periodicity)[0], Period(stop - 1, self.periodicity)[-1]
        at, kind = F.col(self.date), self.table.schema[self.date].dataType.simpleString()
        # wider by two days, as weekends roll forward; the slot decides
        low, high = (F.lit(d + datetime.timedelta(days=n)).cast(kind if kind != "string" else "date") for d, n in ((first, -2), (last, 3)))
        rows = self.table.where((at >= low) & (at < high)) if kind != "string" else self.table
        slotted = rows.withColumn("ordinal", self.periodicity.ordinal_column(at.cast("date")))
        slotted = slotted.where(F.col("ordinal").between(start, stop - 1))
        return slotted.groupBy(*keys, "ordinal").agg(*(self.aggregate(c, at).alias(f"v{c}") for c in columns))

    def aggregate(self, column: int, at: Column) -> Column:
        name, source = self.values[self.headers[column]]
        x = F.col(source) if isinstance(source, str) else source
        x = x.cast("double")
        made = {"last": lambda: F.max_by(x, F.struct(at, x)), "first": lambda: F.min_by(x, F.struct(at, x)), "count": lambda: F.count(x)}
        found = made[name]() if name in made else getattr(F, name)(x)
        return F.when(~F.isnan(found.cast("double")), found.cast("double"))

    def entities(self, keys: tuple[str, ...]) -> DataFrame:
        return self.table.select(*keys).distinct()
