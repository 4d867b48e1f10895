"""A store of series in Parquet: frame#column$row -> values by slot.

A write makes a new version of its frame: the values that it brings, sorted by column,
row and slot so that a range reads few row groups, and then the catalog of all series,
whose completion mark makes the version current. A version is whole (`data`) or adds to
the one before (`added`); of a slot's values the latest counts, and a missing one takes
the earlier ones out. So a write costs as much as it brings; after MOST_ADDED of them the
next one is written whole. Readers see a complete version or the one before. Series of a
frame keep their calendar and type; an update must touch or overlap what is there.
"""

from __future__ import annotations

import datetime
import os
import re
from dataclasses import dataclass
from typing import Any
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calstack.functions.calendar import CALENDARS, Periodicity, Range, from_offset_code, periodicity

#: Types of stored series: code, and what a gap reads as.
TYPES = {"F": ("double", None), "N": ("long", 0), "B": ("boolean", False)}
#: Versions that may add to a whole one.
MOST_ADDED = 16
VALUES = "col string, row string, ordinal long, value double"
CATALOG = "frame string, col string, row string, col_no int, row_no int, type string, calendar string, start long, stop long, created timestamp, updated timestamp"


def literal(text: str) -> str:
    """A text in SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted(column: str) -> str:
    """A column's name in SQL."""
    return "`" + column.replace("`", "``") + "`"


@dataclass(frozen=True)
class Key:
    """frame#col$row; a trailing * on col or row stands for all that begin so."""

    frame: str
    col: str | None = None
    row: str | None = None

    @classmethod
    def parse(cls, key: str) -> Key:
        frame, hash_, rest = key.partition("#")
        col, dollar, row = rest.partition("$") if hash_ else ("", "", "")
        if not hash_ and "$" in frame:
            frame, dollar, row = key.partition("$")
        if not frame:
            raise KeyError(f"no frame in {key!r}")
        return cls(frame, col if hash_ and col else None, row if dollar and row else None)

    @staticmethod
    def fits(value: str, pattern: str | None) -> bool:
        if pattern is None:
            return True
        return value.startswith(pattern[:-1]) if pattern.endswith("*") else value == pattern

    def matches(self, col: str, row: str) -> bool:
        return self.fits(col, self.col) and self.fits(row, self.row)


@dataclass(frozen=True)
class Metadata:
    """One stored series."""

    frame: str
    col: str
    row: str
    col_no: int
    row_no: int
    type: str
    calendar: str
    start: int
    stop: int
    created: datetime.datetime | None = None
    updated: datetime.datetime | None = None

    @property
    def range(self) -> Range:
        return Range(self.start, self.stop, CALENDARS[self.calendar])

    @property
    def header(self) -> str:
        return self.col + (f"${self.row}" if self.row else "")

    @property
    def key(self) -> str:
        return f"{self.frame}#{self.col}" + (f"${self.row}" if self.row else "")


class Store:
    """store[key] = frame, store[key], store[key, start:stop], del store[key]."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    @property
    def spark(self) -> SparkSession:
        return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()

    # Versions

    def files(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def listed(self, path: str) -> list[str]:
        jvm, fs = self.files()
        at = jvm.org.apache.hadoop.fs.Path(path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def versions(self, frame: str) -> list[int]:
        """Complete versions of a frame, in order."""
        at = f"{self.path}/{quote(frame, safe='')}"
        found = [int(v[2:]) for v in self.listed(at) if re.fullmatch(r"v=\d+", v)]
        return sorted(v for v in found if "_SUCCESS" in self.listed(f"{at}/v={v}/catalog"))

    def chain(self, frame: str) -> list[int]:
        """The versions that make up the current one: the last whole one and what follows."""
        found = self.versions(frame)
        whole = next(i for i in range(len(found) - 1, -1, -1) if "data" in self.listed(self.at(frame, found[i])))
        return found[whole:]

    def at(self, frame: str, version: int) -> str:
        return f"{self.path}/{quote(frame, safe='')}/v={version}"

    def remove(self, path: str) -> None:
        jvm, fs = self.files()
        fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)

    # Catalog

    @property
    def keys(self) -> list[str]:
        """The frames that hold a series."""
        return [f for f in sorted(unquote(d) for d in self.listed(self.path)) if self.versions(f)]

    def keys_for_prefix(self, prefix: str) -> list[str]:
        return [k for k in self.keys if k.startswith(prefix)]

    def get_metadata(self, key: str) -> list[Metadata]:
        """The series that a key names, by their stored order."""
        k = Key.parse(key)
        versions = self.versions(k.frame)
        if not versions:
            return []
        rows = self.spark.read.schema(CATALOG).parquet(f"{self.at(k.frame, versions[-1])}/catalog").collect()
        found = [Metadata(*r) for r in rows if k.matches(r["col"], r["row"])]
        return sorted(found, key=lambda m: (m.col_no, m.row_no))

    @property
    def all_series(self) -> list[Metadata]:
        return [m for k in self.keys for m in self.get_metadata(k)]

    def columns(self, key: str) -> list[str]:
        return list(dict.fromkeys(m.col for m in self.get_metadata(key)))

    # Reading

    def series(self, key: str, start: int | None = None, stop: int | None = None) -> DataFrame:
        """(col, row, ordinal, value): the stored values of a key within slots."""
        k = Key.parse(key)
        first, *later = self.chain(k.frame)

        def part(version: int, folder: str) -> DataFrame:
            rows = self.spark.read.schema(VALUES).parquet(f"{self.at(k.frame, version)}/{folder}")
            for name, pattern in (("col", k.col), ("row", k.row)):
                if pattern is not None:
                    rows = rows.where(F.col(name).startswith(pattern[:-1]) if pattern.endswith("*") else F.col(name) == pattern)
            if start is not None:
                rows = rows.where(F.col("ordinal") >= start)
            if stop is not None:
                rows = rows.where(F.col("ordinal") < stop)
            return rows.select("col", "row", "ordinal", "value", F.lit(version).alias("_v"))

        rows = part(first, "data")
        if not later:
            return rows.drop("_v")
        for version in later:
            rows = rows.union(part(version, "added"))
        latest = F.max(F.struct("_v", "value"))["value"].alias("value")
        return rows.groupBy("col", "row", "ordinal").agg(latest).where("value IS NOT NULL")

    def __getitem__(self, key: str | tuple[str, slice]) -> DataFrame:
        """date, row label if the frame has any, and a column for each stored one, all
        slots from the first to the last, gaps as the type reads them."""
        key, part = key if isinstance(key, tuple) else (key, slice(None))
        found = self.get_metadata(key)
        if not found:
            raise KeyError(key)
        calendar = CALENDARS[found[0].calendar]
        whole = Range(min(m.start for m in found), max(m.stop for m in found), calendar)
        start = whole.start if part.start is None else calendar[part.start].ordinal
        stop = whole.stop if part.stop is None else calendar[part.stop].ordinal
        start, stop = max(start, whole.start), min(stop, whole.stop)
        named = any(m.row for m in found)
        columns = list(dict.fromkeys(m.col for m in found))
        types = {m.col: m.type for m in found}
        slots = self.spark.range(start, max(start, stop), 1, 1).withColumnRenamed("id", "ordinal")
        if named:
            labels = sorted({(m.row_no, m.row) for m in found})
            slots = slots.withColumn("_l", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(r).alias("r")) for n, r in labels)))).select("ordinal", F.col("_l.n").alias("_n"), F.col("_l.r").alias("row"))
        else:
            slots = slots.withColumn("row", F.lit("")).withColumn("_n", F.lit(0))
        wide = self.series(key, start, stop).groupBy("row", "ordinal").agg(*(F.expr(f"max(CASE WHEN `col` = {literal(c)} THEN `value` END) AS v{i}") for i, c in enumerate(columns)))
        made = slots.join(wide, ["row", "ordinal"], "left")

        def shown(i: int, c: str):
            kind, gap = TYPES[types[c]]
            x = F.col(f"v{i}")
            x = (x != 0) if kind == "boolean" else x.cast(kind)
            return (x if gap is None else F.coalesce(x, F.lit(gap).cast(kind))).alias(c)

        date = calendar.end_column(F.col("ordinal")).alias("date")
        return made.orderBy("ordinal", "_n").select(date, *(["row"] if named else []), *(shown(i, c) for i, c in enumerate(columns)))

    def pandas(self, key: str, part: slice = slice(None)):
        """The same with a DatetimeIndex, or a two-level index of dates and labels."""
        import pandas as pd

        frame = self[key, part].toPandas()
        frame["date"] = pd.to_datetime(frame["date"])
        return frame.set_index(["date", "row"] if "row" in frame.columns and any(m.row for m in self.get_metadata(key)) else "date")

    def diags(self, key: str) -> DataFrame:
        """The diagonal of a frame of columns by rows: series whose labels are equal."""
        found = [m for m in self.get_metadata(key) if m.col == m.row]
        if not found:
            raise KeyError(key)
        calendar = CALENDARS[found[0].calendar]
        rows = self.series(key).where(F.col("col") == F.col("row"))
        wide = rows.groupBy("ordinal").agg(*(F.max(F.when(F.col("col") == m.col, F.col("value"))).alias(m.col) for m in found))
        return wide.orderBy("ordinal").select(calendar.end_column(F.col("ordinal")).alias("date"), *(m.col for m in found))

    # Writing

    def __setitem__(self, key: str, frame: Any) -> None:
        self.write(key, frame)

    def write(self, key: str, frame: Any, period: str | Periodicity | None = None, dates: str = "date", labels: str | None = None) -> None:
        """Stores a pandas frame or series (its index holds dates, or dates and row
        labels), or a Spark frame with a column of dates and maybe one of labels."""
        k = Key.parse(key)
        if isinstance(frame, DataFrame):
            wide, columns, kinds, calendar = frame, [c for c in frame.columns if c not in (dates, labels)], {}, periodicity(period or "B")
            for c in columns:
                kind = frame.schema[c].dataType
                kinds[c] = "B" if isinstance(kind, T.BooleanType) else "N" if isinstance(kind, T.IntegralType) else "F"
            order = F.monotonically_increasing_id()
        else:
            wide, columns, kinds, calendar, labels, dates = self.from_pandas(k, frame, period)
            order = F.col("_n")
        if len(set(columns)) < len(columns):
            raise ValueError("a frame has two columns of one name")
        names = {c: (k.col if k.col is not None and len(columns) == 1 and not k.col.endswith("*") else c) for c in columns}
        row = F.col(labels).cast("string") if labels else F.lit(k.row or "")
        # as one text: a call for each of thousands of columns takes longer than the write
        each = (f"named_struct('col', {literal(names[c])}, 'col_no', {i}, 'type', '{kinds[c]}', 'value', CAST({quoted(c)} AS DOUBLE))" for i, c in enumerate(columns))
        values = F.expr(f"explode(array({', '.join(each)}))")
        at = calendar.ordinal_column(F.col(dates).cast("date"))
        long = wide.select(at.alias("ordinal"), row.alias("row"), order.alias("_o"), values.alias("s")).select("ordinal", "row", "_o", "s.*")
        long = long.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
        self.upsert(k.frame, long, calendar)

    def from_pandas(self, k: Key, frame: Any, period: str | Periodicity | None):
        import pandas as pd

        if isinstance(frame, pd.Series):
            frame = frame.to_frame(frame.name if frame.name is not None else (k.col or ""))
        if not frame.columns.is_unique:
            raise ValueError("a frame has two columns of one name")
        two = isinstance(frame.index, pd.MultiIndex)
        index = frame.index.get_level_values(0) if two else frame.index
        if period is not None:
            calendar = periodicity(period)
        else:
            unique = pd.DatetimeIndex(index.unique())
            code = getattr(index, "freqstr", None) or (pd.infer_freq(unique) if len(unique) > 2 else None) or "B"
            calendar = from_offset_code(code)
        columns, kinds = [str(c) for c in frame.columns], {}
        for c, kind in zip(columns, frame.dtypes, strict=True):
            if kind.kind not in "fiub":
                raise TypeError(f"{c} has values of type {kind}")
            kinds[c] = {"f": "F", "i": "N", "u": "N", "b": "B"}[kind.kind]
        flat = frame.astype("float64").reset_index(drop=True)
        rows = [(i, d.date(), str(r), *(None if v != v else v for v in values)) for i, (d, r, values) in enumerate(zip(index, frame.index.get_level_values(1) if two else [""] * len(frame), flat.to_numpy().tolist(), strict=True))]
        schema = T.StructType([T.StructField("_n", T.LongType()), T.StructField("_date", T.DateType()), T.StructField("_row", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in columns)])
        return self.spark.createDataFrame(rows, schema), columns, kinds, calendar, "_row" if two else None, "_date"

    def upsert(self, frame: str, long: DataFrame, calendar: Periodicity) -> None:
        """Adds (ordinal, row, _o, col, col_no, type, value) to a frame; of a slot's
        values the last one written stays. Series without any value are left out, and
        new series of doubles begin and end with a value."""
        versions = self.versions(frame)
        version = versions[-1] + 1 if versions else 0
        here = self.at(frame, version)
        self.remove(here)
        old = {(m.col, m.row): m for m in self.get_metadata(frame)}
        # of two rows for a slot, the later one; read for the catalog and for the write
        last = F.max(F.struct("_o", "value", "col_no", "type")).alias("s")
        long = long.groupBy("col", "row", "ordinal").agg(last).select("col", "row", "ordinal", "s.*").persist()
        try:
            self.put(frame, long, calendar, versions, old, here)
        finally:
            long.unpersist()

    def put(self, frame: str, long: DataFrame, calendar: Periodicity, versions: list[int], old: dict[tuple[str, str], Metadata], here: str) -> None:
        """Checks the new series against the catalog, then writes the next version."""
        filled = F.when(F.col("value").isNotNull(), F.col("ordinal"))
        found = long.groupBy("col", "row").agg(F.min("col_no").alias("col_no"), F.min("_o").alias("_o"), F.max("type").alias("type"), F.min(filled).alias("start"), F.max(filled).alias("last"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high")).collect()
        kept = {(r["col"], r["row"]): r for r in found if r["start"] is not None}
        if not kept:
            return
        catalog: dict[tuple[str, str], tuple] = {}
        now = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
        row_numbers = {m.row: m.row_no for m in old.values()}
        column_numbers = {m.col: m.col_no for m in old.values()}
        for key, r in sorted(kept.items(), key=lambda x: (x[1]["col_no"], x[1]["_o"])):
            column_numbers.setdefault(r["col"], max([r["col_no"], *(n + 1 for n in column_numbers.values())]) if old else r["col_no"])
            row_numbers.setdefault(r["row"], len(row_numbers))
            m = old.get(key)
            if m is None:
                whole = r["type"] != "F"
                start, stop, kind, created = (r["low"] if whole else r["start"]), (r["high"] if whole else r["last"]) + 1, r["type"], now
            else:
                if m.calendar != calendar.code:
                    raise ValueError(f"{m.key} is on calendar {m.calendar}, not {calendar.code}")
                if m.type != r["type"]:
                    raise ValueError(f"{m.key} has type {m.type}, not {r['type']}")
                if r["low"] > m.stop or r["high"] + 1 < m.start:
                    raise ValueError(f"an update of {m.key} leaves a gap")
                start, stop, kind, created = min(m.start, r["low"]), max(m.stop, r["high"] + 1), m.type, m.created
            catalog[key] = (frame, r["col"], r["row"], column_numbers[r["col"]], row_numbers[r["row"]], kind, calendar.code, start, stop, created, now)
        for key, m in old.items():
            catalog.setdefault(key, tuple(getattr(m, f) for f in Metadata.__dataclass_fields__))
        chain = self.chain(frame) if versions else []
        new = long.select("col", "row", "ordinal", "value")
        if len(chain) > MOST_ADDED:
            before = self.series(frame).withColumn("_v", F.lit(0))
            latest = F.max(F.struct("_v", "value"))["value"].alias("value")
            new = before.union(new.withColumn("_v", F.lit(1))).groupBy("col", "row", "ordinal").agg(latest)
        whole = not 0 < len(chain) <= MOST_ADDED
        if whole:
            new = new.where("value IS NOT NULL")
        new.repartitionByRange("col", "row", "ordinal").sortWithinPartitions("col", "row", "ordinal").write.parquet(f"{here}/{'data' if whole else 'added'}")
        self.spark.createDataFrame(list(catalog.values()), CATALOG).coalesce(1).write.parquet(f"{here}/catalog")
        for v in versions:  # what makes up the version before stays for those who read it now
            if v < chain[0]:
                self.remove(self.at(frame, v))

    def __delitem__(self, key: str) -> None:
        k = Key.parse(key)
        gone = {(m.col, m.row) for m in self.get_metadata(key)}
        if not gone:
            raise KeyError(key)
        rest = [m for m in self.get_metadata(k.frame) if (m.col, m.row) not in gone]
        if not rest:
            self.remove(f"{self.path}/{quote(k.frame, safe='')}")
            return
        versions = self.versions(k.frame)
        here = self.at(k.frame, versions[-1] + 1)
        self.remove(here)
        names = self.spark.createDataFrame([(m.col, m.row) for m in rest], "col string, row string")
        self.series(k.frame).join(F.broadcast(names), ["col", "row"], "left_semi").sortWithinPartitions("col", "row", "ordinal").write.parquet(f"{here}/data")
        self.spark.createDataFrame([tuple(getattr(m, f) for f in Metadata.__dataclass_fields__) for m in rest], CATALOG).coalesce(1).write.parquet(f"{here}/catalog")

    def delete_all(self) -> None:
        for frame in self.listed(self.path):
            self.remove(f"{self.path}/{frame}")


class StoredFrame:
    """The series of a key as the columns of a program; reads only the slots needed."""

    exact = False
    round_ = False
    keys: tuple[str, ...] = ()

    def __init__(self, store: Store, key: str) -> None:
        self.store, self.key = store, key
        self.found = store.get_metadata(key)
        if not self.found:
            raise KeyError(key)
        self.headers = [m.header for m in self.found]
        self.periodicity = CALENDARS[self.found[0].calendar]

    def bounds(self) -> tuple[datetime.date, datetime.date] | None:
        return self.periodicity.end(min(m.start for m in self.found)), self.periodicity.end(max(m.stop for m in self.found) - 1)

    def frame(self, spark: SparkSession, start: int, stop: int, columns: list[int], keys: list[str]) -> DataFrame:
        wanted = [self.found[c] for c in columns]
        names = sorted({m.col for m in wanted})
        rows = self.store.series(self.key, start, stop).where(F.col("col").isin(names))
        return rows.groupBy("ordinal").agg(*(F.expr(f"max(CASE WHEN `col` = {literal(m.col)} AND `row` = {literal(m.row)} THEN `value` END) AS v{c}") for c, m in zip(columns, wanted, strict=True)))

    def entities(self, keys: tuple[str, ...]) -> DataFrame:
        raise ValueError("a stored frame has no keys")


_default: Store | None = None


def default_store() -> Store:
    """The store at $CALSTACK_STORE, else in the warehouse, which all executors share."""
    global _default
    if _default is None:
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        _default = Store(os.environ.get("CALSTACK_STORE") or f"{spark.conf.get('spark.sql.warehouse.dir')}/calstack_store")
    return _default


def use_store(path: str) -> Store:
    """Makes the store at a path the default one."""
    global _default
    _default = Store(path)
    return _default
