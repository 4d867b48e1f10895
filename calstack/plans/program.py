"""Programs: immutable chains of words, and the stack of columns that they build.

A program holds no data. Running it over an empty stack gives columns that refer to
nodes of an expression graph; only asking for rows compiles those to a DataFrame.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any, NamedTuple

from calstack.functions.calendar import CALENDARS, Period, Range, is_date, periodicity


class Input(NamedTuple):
    node: Node
    resampler: str


@dataclass(eq=False)
class Group:
    """Columns made by one application of a word; they share a mask of valid rows.
    A member all of whose copies are discarded leaves, unless `fixed`."""

    fixed: bool = False
    members: list[Node] = field(default_factory=list)


@dataclass(eq=False)
class Node:
    """One computation. `params` depend on `kind`, see plans.compile."""

    kind: str
    params: dict[str, Any] = field(default_factory=dict)
    inputs: list[Input] = field(default_factory=list)
    group: Group = field(default_factory=Group)
    copies: int = 1

    def __post_init__(self) -> None:
        self.group.members.append(self)


@dataclass(eq=False)
class Slot:
    """A column on the stack."""

    node: Node
    header: str
    resampler: str = "last"

    def copy(self) -> Slot:
        self.node.copies += 1
        return Slot(self.node, self.header, self.resampler)

    def discard(self) -> None:
        self.node.copies -= 1
        if not self.node.copies and not self.node.group.fixed:
            self.node.group.members.remove(self.node)

    @property
    def input(self) -> Input:
        return Input(self.node, self.resampler)


@dataclass(frozen=True)
class Selector:
    """Which columns a word takes from the stack, and what becomes of the rest."""

    part: slice = slice(None)
    patterns: tuple[str, ...] | None = None
    copies: bool = False
    discards: bool = False

    def positions(self, stack: list[Slot]) -> list[int]:
        if self.patterns is None:
            return list(range(len(stack))[self.part])
        return [i for p in self.patterns for i, s in enumerate(stack) if re.match(p, s.header)]


TOP, TOP_TWO, ALL, NONE = (Selector(s) for s in (slice(-1, None), slice(-2, None), slice(None), slice(0, 0)))


@dataclass(frozen=True)
class Definition:
    """A word: run(stack, call, *arguments) changes the selected columns in place."""

    name: str
    category: str
    doc: str
    select: Selector
    run: Callable[..., None]
    inverse: bool = False
    quotes: bool = False


@dataclass(frozen=True)
class Step:
    word: Definition
    args: tuple = ()
    kwargs: tuple[tuple[str, Any], ...] = ()
    select: Selector = ALL

    def __str__(self) -> str:
        own = [repr(a) if not isinstance(a, Program) else f"({a})" for a in self.args] + [f"{k}={v!r}" for k, v in self.kwargs]
        text = self.word.name + (f"({', '.join(own)})" if own else "")
        if self.select.patterns is not None:
            text += f".cols[{list(self.select.patterns)}]"
        elif self.select.part != self.word.select.part:
            s = self.select.part
            text += f".cols[{'' if s.start is None else s.start}:{'' if s.stop is None else s.stop}]"
        return text + ".copy" * self.select.copies + ".discard" * (self.select.discards and not self.word.select.discards)


class Call:
    """What a running word sees besides its columns: the quotations before it."""

    def __init__(self, steps: tuple[Step, ...], at: int, quoted: dict[int, Program]) -> None:
        self.steps, self.at, self.quoted = steps, at, quoted

    def quotations(self, count: int) -> list[Program]:
        """The contiguous quotations before this word, nearest first; -1 for all."""
        found, i = [], self.at - 1
        while i >= 0 and len(found) != count and self.steps[i].word.quotes:
            if i in self.quoted:
                found.append(self.quoted[i])
            i -= 1
        if len(found) < count or not found:
            raise ValueError(f"{self.steps[self.at].word.name} lacks a quotation")
        return found

    def take(self, count: int) -> list[Program]:
        """The same, no longer seen by later words."""
        found = self.quotations(count)
        for i in sorted(self.quoted, reverse=True)[:count]:
            del self.quoted[i]
        return found

    def push(self, program: Program) -> None:
        """Makes this word stand for a quotation."""
        self.quoted[self.at] = program


class Columns:
    def __init__(self, program: Program) -> None:
        self.program = program

    def __getitem__(self, key: int | slice | str | list[str]) -> Program:
        if isinstance(key, int):
            return self.program.selecting(part=slice(key, None if key == -1 else key + 1), patterns=None)
        if isinstance(key, slice):
            return self.program.selecting(part=key, patterns=None)
        if isinstance(key, str | list):
            return self.program.selecting(patterns=(key,) if isinstance(key, str) else tuple(key))
        raise IndexError("columns are selected by number, slice, pattern or list of patterns")


@dataclass(frozen=True)
class Program:
    """Words in order. `+` joins programs, `~` quotes one."""

    steps: tuple[Step, ...] = ()

    def __add__(self, other: Program | float) -> Program:
        if isinstance(other, int | float):
            other = constant(other)
        return Program(self.steps + other.steps) if isinstance(other, Program) else NotImplemented

    def __radd__(self, other: float) -> Program:
        return constant(other) + self if isinstance(other, int | float) else NotImplemented

    def __invert__(self) -> Program:
        if len(self.steps) == 1 and self.steps[0].word.name == "q" and self.steps[0].args:
            return self.steps[0].args[0]
        return word("q")(self)

    def __call__(self, *args: Any, **kwargs: Any) -> Program:
        if len(self.steps) != 1:
            raise TypeError("only a single word takes arguments")
        step = self.steps[0]
        inspect.signature(step.word.run).bind(None, None, *args, **kwargs)
        return Program((replace(step, args=args, kwargs=tuple(kwargs.items())),))

    def selecting(self, **changes: Any) -> Program:
        last = self.steps[-1]
        return Program((*self.steps[:-1], replace(last, select=replace(last.select, **changes))))

    @property
    def cols(self) -> Columns:
        return Columns(self)

    @property
    def copy(self) -> Program:
        return self.selecting(copies=True)

    @property
    def discard(self) -> Program:
        return self.selecting(discards=True)

    @property
    def local(self) -> Program:
        """The program run on a stack of its own."""
        return ~self + word("call").selecting(part=slice(0, 0))

    def run(self, stack: list[Slot]) -> list[Slot]:
        quoted: dict[int, Program] = {}
        for at, step in enumerate(self.steps):
            chosen = step.select.positions(stack)
            if step.word.inverse:
                chosen = sorted(set(range(len(stack))) - set(chosen))
            taken, gone, seen = [], set(), set()
            for i in chosen:
                if step.select.copies or i in seen:
                    taken.append(stack[i].copy())
                else:
                    taken.append(stack[i])
                    gone.add(i)
                seen.add(i)
            if step.select.discards:
                for i in set(range(len(stack))) - seen:
                    stack[i].discard()
                    gone.add(i)
            stack[:] = [s for i, s in enumerate(stack) if i not in gone]
            step.word.run(taken, Call(self.steps, at, quoted), *step.args, **dict(step.kwargs))
            stack.extend(taken)
        return stack

    @property
    def stack(self) -> list[Slot]:
        return self.run([])

    @property
    def columns(self) -> list[str]:
        """Headers, without evaluating."""
        return [s.header for s in self.stack]

    def describe(self) -> str:
        """The stack as a tree: headers, nodes, what they are computed from, and how
        many columns share a node's group."""
        lines: list[str] = []

        def tell(node: Node, depth: int, label: str) -> None:
            own = {k: v for k, v in node.params.items() if k not in ("source", "rowwise")}
            lines.append("  " * depth + f"{label}{node.kind}{own or ''} (group of {len(node.group.members)})")
            for i in node.inputs:
                tell(i.node, depth + 1, f"{i.resampler}: " if i.resampler != "last" else "")

        for slot in self.stack:
            tell(slot.node, 0, f"{slot.header}: ")
        return "\n".join(lines)

    @property
    def rows(self) -> Rows:
        """rows[start:stop:periodicity] as a Spark DataFrame with a date column."""
        return Rows(self)

    @property
    def values(self) -> Rows:
        """The same without dates, its rows in order."""
        return Rows(self, dates=False)

    @property
    def pandas(self) -> Rows:
        """The same as a pandas DataFrame with the headers as they are."""
        return Rows(self, pandas=True)

    @property
    def all(self):
        return self.rows[:]

    @property
    def last(self):
        """The last row, as a pandas Series."""
        return self.pandas[-1:].iloc[-1]

    @property
    def first(self):
        return self.pandas[:1].iloc[0]

    def over(self, *keys: str) -> Panel:
        """The program run for every value of the sources' key columns."""
        return Panel(self, keys)

    def __str__(self) -> str:
        return " + ".join(f"~({s.args[0]})" if s.word.name == "q" and s.args else str(s) for s in self.steps)

    def __repr__(self) -> str:
        return f"Program[{self}]"


@dataclass(frozen=True)
class Panel:
    program: Program
    keys: tuple[str, ...]

    @property
    def rows(self) -> Rows:
        return Rows(self.program, keys=self.keys)


@dataclass(frozen=True)
class Rows:
    """Turns an index into a range of slots, and the program into a DataFrame."""

    program: Program
    dates: bool = True
    pandas: bool = False
    keys: tuple[str, ...] = ()

    def __getitem__(self, key: Any):
        from calstack.plans.compile import evaluate

        stack = self.program.stack
        wanted = resolve(key, stack)
        if self.pandas:
            import pandas as pd

            frame = evaluate(stack, wanted, self.keys).toPandas().sort_values("date")
            out = pd.DataFrame(frame.iloc[:, 1:].to_numpy(), index=pd.DatetimeIndex(frame["date"], name=None), columns=[s.header for s in stack])
            return out.astype("float64")
        frame = evaluate(stack, wanted, self.keys)
        return frame if self.dates else frame.drop("date")


def sources(stack: list[Slot]) -> list:
    found, todo, seen = [], [s.node for s in stack], set()
    while todo:
        node = todo.pop()
        if id(node) not in seen:
            seen.add(id(node))
            if node.kind == "source":
                found.append(node.params["source"])
            todo += [i.node for i in node.inputs]
    return found


def resolve(key: Any, stack: list[Slot]) -> Range:
    """Dates and numbers of slots against the calendar and bounds of the sources; the
    calendar is the last visited source's, or business days."""
    if isinstance(key, Range):
        return key
    if isinstance(key, Period):
        return key.to_range()
    own = sources(stack)
    calendar = own[-1].periodicity if own else CALENDARS["B"]
    if isinstance(key, int) or is_date(key):
        return calendar[key].to_range()
    if isinstance(key, tuple) and len(key) == 2 and isinstance(key[0], slice):
        key = slice(key[0].start, key[0].stop, key[1])
    if not isinstance(key, slice):
        raise TypeError("rows are selected by date, number, slice or range")
    if key.step is not None:
        calendar = periodicity(key.step)
    needs = [k is None or isinstance(k, int) for k in (key.start, key.stop)]
    low = high = None
    if own and any(needs):
        bounds = [b for s in own if (b := s.bounds()) is not None]
        if bounds:
            low = calendar.ordinal(min(s for s, _ in bounds))
            high = calendar.ordinal(max(e for _, e in bounds)) + 1

    def bound(x: Any, default: int) -> int:
        if x is None:
            return default
        if isinstance(x, int) and low is not None:
            return high + x if x < 0 else low + x
        return calendar[x].ordinal

    start = bound(key.start, low if low is not None else 0)
    stop = bound(key.stop, high if high is not None else calendar.next().ordinal)
    return Range(start, max(start, stop), calendar)


def word(name: str) -> Program:
    from calstack.plans.vocabulary import VOCABULARY

    found = VOCABULARY[name]
    return found if isinstance(found, Program) else Program((Step(found, select=found.select),))


def constant(*values: float) -> Program:
    return word("c")(*values)
