"""From nodes and a range of slots to one DataFrame.

Each calendar that a program touches gets one wide frame: the slots of all ranges
that its nodes are needed over, one left join for each source, then layers of
select. A node is computed once for each range that it is needed over, or once for
all if it does not depend on the range. What a word may see of earlier or later
slots is part of the ranges, so every source is read over just those slots.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calstack.functions.calendar import Periodicity, Range
from calstack.operators import elementwise, windows
from calstack.operators.resample import resampled
from calstack.plans.program import Input, Node, Slot

#: Kinds of nodes whose value in a row follows from their inputs in that row alone.
ROWWISE = {"apply", "constant", "calendar", "source", "function", "reduction", "fill", "rank", "sync", "random"}


@dataclass
class Item:
    """A column of a frame: its layer, and the expression over earlier layers."""

    name: str
    level: int
    build: Callable[[], Column]

    @property
    def column(self) -> Column:
        return F.col(self.name)


@dataclass
class Frame:
    """The columns to be computed on one calendar."""

    periodicity: Periodicity
    keys: tuple[str, ...]
    start: int | None = None
    stop: int | None = None
    items: dict[Any, Item] = field(default_factory=dict)
    joins: dict[Any, tuple[Any, dict[int, str]]] = field(default_factory=dict)
    changes: dict[Any, dict[tuple[int, str], tuple[Input, str]]] = field(default_factory=dict)
    held: list[Any] = field(default_factory=list)

    def cover(self, start: int, stop: int) -> None:
        self.start = start if self.start is None else min(self.start, start)
        self.stop = stop if self.stop is None else max(self.stop, stop)

    def add(self, key: Any, after: list[Item], build: Callable[[], Column]) -> Item:
        if key not in self.items:
            level = 1 + max((i.level for i in after), default=0)
            self.items[key] = Item(f"_x{len(self.items)}", level, build)
        return self.items[key]

    # What a node needs

    def need(self, source: Input, start: int, stop: int) -> Item:
        """The item of an input over a range."""
        node = source.node
        self.cover(start, stop)
        self.held.append(node)
        if node.kind == "source" and node.params["source"].periodicity != self.periodicity:
            if getattr(node.params["source"], "exact", False):
                return self.matched(node)
            return self.changed(source, node.params["source"].periodicity, start, stop)
        key = (id(node), None, None) if rowwise(node) else (id(node), start, stop)
        if key in self.items and not rowwise(node):
            return self.items[key]
        return getattr(self, f"_{node.kind}")(key, node, start, stop)

    def inputs(self, node: Node, start: int, stop: int) -> list[Item]:
        return [self.need(i, start, stop) for i in node.inputs]

    def siblings(self, node: Node, start: int, stop: int) -> list[Item]:
        """The inputs of all that live in the node's group."""
        members = node.group.members if node in node.group.members else [*node.group.members, node]
        return [item for m in members for item in self.inputs(m, start, stop)]

    def between(self, start: int, stop: int) -> Item:
        return self.add(("between", start, stop), [], lambda: F.col("ordinal").between(start, stop - 1))

    def valid(self, node: Node, start: int, stop: int) -> Item:
        """Rows of the range in which all of the node's group is valid."""
        own = self.siblings(node, start, stop)
        names = tuple(i.name for i in own)
        return self.add(("valid", names, start, stop), own, lambda: elementwise.all_valid([F.col(n) for n in names]) & F.col("ordinal").between(start, stop - 1))

    # Kinds of nodes

    def _constant(self, key: Any, node: Node, start: int, stop: int) -> Item:
        return self.add(key, [], lambda: elementwise.number(node.params["value"]))

    def _random(self, key: Any, node: Node, start: int, stop: int) -> Item:
        seed = node.params["seed"]
        return self.add(key, [], lambda: F.randn(len(self.items) if seed is None else seed))

    def _calendar(self, key: Any, node: Node, start: int, stop: int) -> Item:
        def build() -> Column:
            o, p = F.col("ordinal"), self.periodicity
            end, before = p.end_column(o), p.end_column(o - 1)
            if node.params["name"] == "period_ordinal":
                return o.cast("double")
            if node.params["name"] == "timestamp":
                return F.unix_date(end).cast("double") * F.lit(86400e9)
            if node.params["name"] == "day_count":
                return F.datediff(end, before).cast("double")
            turn = F.make_date(F.year(end), F.lit(1), F.lit(1))
            days = [F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31))).cast("double") for d in (before, end)]
            whole = F.datediff(end, before) / days[0]
            return F.when(F.year(end) == F.year(before), whole).otherwise(F.datediff(turn, before) / days[0] + F.datediff(end, turn) / days[1])

        return self.add(key, [], build)

    def _source(self, key: Any, node: Node, start: int, stop: int) -> Item:
        source, column = node.params["source"], node.params["column"]
        _, names = self.joins.setdefault(id(source), (source, {}))
        name = names.setdefault(column, f"_s{len(self.joins)}_{column}")
        return self.add(key, [], lambda: F.col(name))

    def matched(self, node: Node) -> Item:
        """A source column on another calendar, by the date or the slot that holds it."""
        source, column = node.params["source"], node.params["column"]
        _, names = self.joins.setdefault(id(source), (source, {}))
        name = names.setdefault(column, f"_s{len(self.joins)}_{column}")
        return self.add((id(node), None, None), [], lambda: F.col(name))

    def _function(self, key: Any, node: Node, start: int, stop: int) -> Item:
        (x,) = self.inputs(node, start, stop)
        return self.add(key, [x], lambda: elementwise.valid(elementwise.FUNCTIONS[node.params["name"]][1](x.column)))

    def _apply(self, key: Any, node: Node, start: int, stop: int) -> Item:
        (x,) = self.inputs(node, start, stop)
        return self.add(key, [x], lambda: elementwise.valid(node.params["function"](x.column).cast("double")))

    def _fill(self, key: Any, node: Node, start: int, stop: int) -> Item:
        (x,) = self.inputs(node, start, stop)
        return self.add(key, [x], lambda: F.coalesce(x.column, elementwise.number(node.params["value"])))

    def _reduction(self, key: Any, node: Node, start: int, stop: int) -> Item:
        x = self.inputs(node, start, stop)
        return self.add(key, x, lambda: elementwise.reduction(node.params["name"], [i.column for i in x], node.params["ignore"]))

    def _rank(self, key: Any, node: Node, start: int, stop: int) -> Item:
        x = self.siblings(node, start, stop)
        return self.add(key, x, lambda: elementwise.rank([i.column for i in x], node.group.members.index(node)))

    def _sync(self, key: Any, node: Node, start: int, stop: int) -> Item:
        own, x = self.siblings(node, start, stop), self.inputs(node, start, stop)[0]
        return self.add(key, own, lambda: F.when(elementwise.all_valid([i.column for i in own]), x.column))

    def _cumulative(self, key: Any, node: Node, start: int, stop: int) -> Item:
        ok, (x,) = self.valid(node, start, stop), self.inputs(node, start, stop)
        rows = windows.Rows(self.keys, ok.column, node.params["reverse"])
        return self.add(key, [ok, x], lambda: F.when(ok.column, windows.CUMULATIVE[node.params["name"]][1](rows, x.column)))

    def back(self, node: Node, start: int) -> int:
        return start - max(5, int(node.params["window"] * 1.25))

    def _rolling(self, key: Any, node: Node, start: int, stop: int) -> Item:
        start, n, name = self.back(node, start), node.params["window"], node.params["name"]
        ok, (x,) = self.valid(node, start, stop), self.inputs(node, start, stop)
        rows = windows.Rows(self.keys, ok.column)
        if n > windows.WIDE and name in ("add", "avg", "std", "var", "zsc"):
            return self.wide(key, rows, ok, x, n, name)
        return self.add(key, [ok, x], lambda: F.when(ok.column, elementwise.valid(windows.ROLLING[name][1](rows, x.column, n))))

    def wide(self, key: Any, rows: windows.Rows, ok: Item, x: Item, n: int, name: str) -> Item:
        """Moments of a wide window from those of its two parts: the valid rows are cut
        into blocks of n, so a window is the end of a block and the beginning of the
        next. Each row is in no sum but those of windows that hold it."""
        own = (ok.name, x.name, n)
        k = self.add((*own, "k"), [ok, x], lambda: F.row_number().over(rows.spec) - 1)
        parts = {}
        for side, descending in (("end", True), ("begin", False)):
            for what, made in (("n", F.count), ("mean", F.avg), ("var", F.var_pop)):
                parts[side, what] = self.add((*own, side, what), [k], lambda made=made, descending=descending: made(x.column).over(rows.block(k.column, n, descending)))
        # the end of the block before begins n - 1 rows back, unless this row ends its own
        before = {w: self.add((*own, "before", w), [parts["end", w], k], lambda w=w: F.when((k.column >= n) & (F.pmod(k.column, F.lit(n)) != n - 1), rows.lag(parts["end", w].column, n - 1))) for w in ("n", "mean", "var")}

        def build() -> Column:
            (n1, m1, v1), (n2, m2, v2) = ([side[w].column for w in ("n", "mean", "var")] for side in (before, {w: parts["begin", w] for w in ("n", "mean", "var")}))
            both, alone = n1 + n2, n1.isNull()
            mean = F.when(alone, m2).otherwise((n1 * m1 + n2 * m2) / both)
            apart = m1 - m2
            variance = F.when(alone, v2).otherwise((n1 * v1 + n2 * v2) / both + n1 * n2 * apart * apart / (both * both))
            std, rows_seen = F.sqrt(variance), F.when(alone, n2).otherwise(both)
            made = {"add": mean * rows_seen, "avg": mean, "var": variance, "std": std, "zsc": F.when(std != 0, (x.column - mean) / F.when(std != 0, std))}
            return F.when(ok.column & (k.column + 1 >= (2 if name in ("avg", "zsc") else n)), elementwise.valid(made[name]))

        return self.add(key, [*before.values(), *parts.values(), ok], build)

    def _rolling_pair(self, key: Any, node: Node, start: int, stop: int) -> Item:
        start, n = self.back(node, start), node.params["window"]
        ok, x = self.valid(node, start, stop), self.inputs(node, start, stop)
        rows = windows.Rows(self.keys, ok.column)
        made = windows.covariance if node.params["name"] == "rcov" else windows.correlation
        return self.add(key, [ok, *x], lambda: F.when(ok.column, made(rows, [i.column for i in x], n)))

    def exponential_mean(self, key: Any, rows: windows.Rows, ok: Item, x: Item, window: int) -> tuple[Item, Item]:
        number, within, carried = windows.exponential_steps(rows, window)
        k = self.add((key, "k"), [ok, x], lambda: number(x.column))
        s = self.add((key, "s"), [k], lambda: within(x.column, k.column))
        return k, self.add((key, "y"), [s], lambda: F.when(ok.column, carried(x.column, k.column, s.column)))

    def _exponential(self, key: Any, node: Node, start: int, stop: int) -> Item:
        start, window, name = self.back(node, start), node.params["window"], node.params["name"]
        ok, (x,) = self.valid(node, start, stop), self.inputs(node, start, stop)
        rows = windows.Rows(self.keys, ok.column)
        k, mean = self.exponential_mean((ok.name, x.name, window), rows, ok, x, window)
        if name == "mean":
            return self.add(key, [mean], lambda: mean.column)
        apart = self.add((ok.name, x.name, window, "apart"), [mean], lambda: (x.column - mean.column) * (x.column - mean.column))
        _, spread = self.exponential_mean((ok.name, apart.name, window), rows, ok, apart, window)
        variance = self.add((ok.name, x.name, window, "variance"), [spread, k], lambda: F.when(ok.column, spread.column * windows.bias(k.column, window)))
        return self.add(key, [variance], lambda: F.sqrt(variance.column) if name == "std" else variance.column)

    def _ffill(self, key: Any, node: Node, start: int, stop: int) -> Item:
        start -= node.params["lookback"]
        inside, (x,) = self.between(start, stop), self.inputs(node, start, stop)

        def build() -> Column:
            rows = windows.Rows(self.keys, inside.column)
            found = F.last(x.column, ignorenulls=True).over(rows.so_far)
            if node.params["leave_end"]:
                found = F.when(F.col("ordinal") <= F.max(F.when(x.column.isNotNull(), F.col("ordinal"))).over(rows.whole), found)
            return F.when(inside.column, found)

        return self.add(key, [inside, x], build)

    def _fillfirst(self, key: Any, node: Node, start: int, stop: int) -> Item:
        first = start - node.params["lookback"]
        inside = self.between(first, start + 1)
        own, (x,) = self.siblings(node, first, stop), self.inputs(node, first, stop)

        def build() -> Column:
            rows = windows.Rows(self.keys, inside.column)
            found = F.last(F.when(elementwise.all_valid([i.column for i in own]), x.column), ignorenulls=True).over(rows.so_far)
            return F.when(F.col("ordinal") == start, found).otherwise(x.column)

        return self.add(key, [inside, *own], build)

    def _zero_first(self, key: Any, node: Node, start: int, stop: int) -> Item:
        (x,) = self.inputs(node, start, stop)
        return self.add(key, [x], lambda: F.when(F.col("ordinal") == start, F.lit(0.0)).otherwise(x.column))

    def _join(self, key: Any, node: Node, start: int, stop: int) -> Item:
        cut = self.periodicity.ordinal(node.params["date"])
        if stop <= cut or start >= cut:
            x = self.need(node.inputs[0 if stop <= cut else -1], start, stop)
            return self.add(key, [x], lambda: x.column)
        a, b = self.need(node.inputs[0], start, cut), self.need(node.inputs[1], cut, stop)
        return self.add(key, [a, b], lambda: F.when(F.col("ordinal") < cut, a.column).otherwise(b.column))

    def _start(self, key: Any, node: Node, start: int, stop: int) -> Item:
        wanted = node.params["start"]
        first = start + wanted if isinstance(wanted, int) else self.periodicity.ordinal(wanted)
        (x,) = self.inputs(node, first, max(first, stop))
        return self.add(key, [x], lambda: F.when(F.col("ordinal") >= first, x.column))

    def _period(self, key: Any, node: Node, start: int, stop: int) -> Item:
        if node.params["periodicity"] == self.periodicity:
            (x,) = self.inputs(node, start, stop)
            return self.add(key, [x], lambda: x.column)
        return self.changed(node.inputs[0], node.params["periodicity"], start, stop)

    def changed(self, source: Input, period: Periodicity, start: int, stop: int) -> Item:
        """An input evaluated on another calendar and resampled to this one; all that
        cover the same slots of a calendar are computed and joined together."""
        wide = Range(start, stop, self.periodicity).change_periodicity(period)
        columns = self.changes.setdefault((period.code, wide.start, wide.stop), {})
        _, name = columns.setdefault((id(source.node), source.resampler), (source, f"_p{len(self.changes)}_{len(columns)}"))
        return self.add(("change", id(source.node), source.resampler, wide.start, wide.stop), [], lambda: F.col(name))

    # The DataFrame

    def base(self, spark: SparkSession) -> DataFrame:
        start, stop = self.start or 0, self.stop or 0
        if not self.keys:
            return spark.range(start, max(start, stop), 1, 1).withColumnRenamed("id", "ordinal")
        keyed = [s for s in all_sources(self.held) if set(self.keys) <= set(s.keys)]
        if not keyed:
            raise ValueError(f"no source has the keys {self.keys}")
        entities = keyed[0].entities(self.keys)
        for s in keyed[1:]:
            entities = entities.union(s.entities(self.keys))
        slots = F.explode(F.sequence(F.lit(start).cast("long"), F.lit(max(start, stop - 1)).cast("long")))
        return entities.distinct().select(*self.keys, slots.alias("ordinal"))

    def build(self, spark: SparkSession) -> DataFrame:
        made = self.base(spark)
        for source, names in self.joins.values():
            keys = [k for k in self.keys if k in source.keys]
            if source.periodicity == self.periodicity:
                frame = source.frame(spark, self.start, self.stop, list(names), keys)
                made = made.join(frame.select(*keys, "ordinal", *(F.col(f"v{i}").alias(n) for i, n in names.items())), [*keys, "ordinal"], "left")
                continue
            own = Range(self.start, max(self.stop, self.start + 1), self.periodicity).change_periodicity(source.periodicity)
            frame = source.frame(spark, own.start, own.stop, list(names), keys)
            date = self.periodicity.end_column(F.col("ordinal"))
            frame = frame.select(*keys, F.col("ordinal").alias("_slot"), *(F.col(f"v{i}").alias(n) for i, n in names.items()))
            made = made.withColumn("_slot", source.periodicity.ordinal_column(date)).join(frame, [*keys, "_slot"], "left")
            if not source.round_:
                same = source.periodicity.end_column(F.col("_slot")) == date
                made = made.withColumns({n: F.when(same, F.col(n)) for n in names.values()})
            made = made.drop("_slot")
        for (code, start, stop), columns in self.changes.items():
            made = made.join(self.change(spark, code, start, stop, columns), [*self.keys, "ordinal"], "left")
        levels: dict[int, list[Item]] = {}
        for item in self.items.values():
            levels.setdefault(item.level, []).append(item)
        for level in sorted(levels):
            made = made.select("*", *(i.build().alias(i.name) for i in levels[level]))
        return made

    def change(self, spark: SparkSession, code: str, start: int, stop: int, columns: dict) -> DataFrame:
        from calstack.functions.calendar import CALENDARS

        wide = Range(start, stop, CALENDARS[code])
        frame, names = compiled(spark, [source for source, _ in columns.values()], wide, self.keys)
        wanted = [(names[i], source.resampler, name) for i, (source, name) in enumerate(columns.values())]
        return resampled(frame, wide, self.periodicity, wanted, self.keys)


def rowwise(node: Node) -> bool:
    """Whether a node has the same value in a row whatever range it is evaluated over.
    A source may be resampled from another calendar, which depends on the range."""
    if node.kind in ("constant", "calendar", "random"):
        return True
    if node.kind == "source":
        return bool(getattr(node.params["source"], "exact", False))
    if node.kind not in ROWWISE:
        return False
    if "rowwise" not in node.params:
        members = node.group.members if node.kind in ("rank", "sync") else [node]
        node.params["rowwise"] = all(rowwise(i.node) for m in [*members, node] for i in m.inputs)
    return node.params["rowwise"]


def all_sources(nodes: list[Node]) -> list:
    found, todo, seen = {}, list(nodes), set()
    while todo:
        node = todo.pop()
        if id(node) not in seen:
            seen.add(id(node))
            if node.kind == "source":
                found[id(node.params["source"])] = node.params["source"]
            todo += [i.node for i in node.inputs]
    return list(found.values())


def compiled(spark: SparkSession, inputs: list[Input], wanted: Range, keys: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """(frame, names): keys, ordinal and a column for each input over the range."""
    frame = Frame(wanted.periodicity, keys)
    items = [frame.need(i, wanted.start, wanted.stop) for i in inputs]
    made = frame.build(spark).where(F.col("ordinal").between(wanted.start, wanted.stop - 1))
    return made.select(*keys, "ordinal", *dict.fromkeys(i.name for i in items)), [i.name for i in items]


def headed(stack: list[Slot], taken: tuple[str, ...]) -> list[str]:
    """Headers as column names: a repeated one gets a number."""
    names: list[str] = []
    used = {t.lower() for t in taken}
    for slot in stack:
        name, n = slot.header, 0
        while name.lower() in used:
            n += 1
            name = f"{slot.header}_{n}"
        used.add(name.lower())
        names.append(name)
    return names


def evaluate(stack: list[Slot], wanted: Range, keys: tuple[str, ...] = ()) -> DataFrame:
    """The columns of a stack over a range: keys, date, and a column for each header,
    in order of date."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    if keys:
        # slots are dealt by key alone, which serves the joins on (key, slot) and the
        # windows after them without another exchange; a key has few slots
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    frame, names = compiled(spark, [s.input for s in stack], wanted, tuple(keys))
    date = wanted.periodicity.end_column(F.col("ordinal")).alias("date")
    made = frame.select(*keys, date, *(F.col(n).alias(h) for n, h in zip(names, headed(stack, (*keys, "date")), strict=True)))
    return made.orderBy("date") if not keys else made
