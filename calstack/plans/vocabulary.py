"""The words, by category, and the names that resolve to them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from calstack.functions.calendar import Periodicity, parse_date, periodicity
from calstack.operators.elementwise import FUNCTIONS, REDUCTIONS
from calstack.operators.windows import CUMULATIVE, ROLLING
from calstack.plans.program import ALL, NONE, TOP, TOP_TWO, Call, Definition, Group, Node, Program, Selector, Slot, Step

VOCABULARY: dict[str, Definition | Program] = {}
Stack = list[Slot]


def add(name: str, category: str, doc: str, select: Selector, run: Callable[..., None], **more: bool) -> None:
    VOCABULARY[name] = Definition(name, category, doc, select, run, **more)


def define(name: str, category: str, doc: str, select: Selector, **more: bool) -> Callable:
    def register(run: Callable[..., None]) -> Callable[..., None]:
        add(name, category, doc, select, run, **more)
        return run

    return register


def derive(stack: Stack, kind: str, fixed: bool = False, **params: Any) -> None:
    """Every column becomes a node over itself, all in one group."""
    group = Group(fixed)
    for slot in stack:
        slot.node = Node(kind, dict(params), [slot.input], group)
        slot.resampler = "last"


def combine(stack: Stack, kind: str, header: int = 0, **params: Any) -> None:
    """All columns become one."""
    if stack:
        node = Node(kind, params, [s.input for s in stack])
        stack[:] = [Slot(node, stack[header].header)]


# Creation


@define("c", "creation", "A constant column for each value", NONE)
def _c(stack: Stack, call: Call, *values: float) -> None:
    stack += [Slot(Node("constant", {"value": v}), "c" + str(v).replace("-", "_").replace(".", "_")) for v in values]


@define("r", "creation", "Constant columns 0 to n - 1", NONE)
def _r(stack: Stack, call: Call, n: int) -> None:
    _c(stack, call, *range(n))


add("nan", "creation", "A column of missing values", NONE, lambda stack, call: stack.append(Slot(Node("constant", {"value": None}), "nan")))


@define("randn", "creation", "Draws from a standard normal distribution", NONE)
def _randn(stack: Stack, call: Call, seed: int | None = None) -> None:
    stack.append(Slot(Node("random", {"seed": seed}), "randn"))


for _name, _doc in (
    ("timestamp", "End of the period in nanoseconds since 1970"),
    ("period_ordinal", "Number of the period's slot"),
    ("day_count", "Days since the end of the period before"),
    ("year_frac", "Actual/actual fraction of a year since the period before"),
):
    add(_name, "creation", _doc, NONE, lambda stack, call, name=_name: stack.append(Slot(Node("calendar", {"name": name}), name)))


def from_source(stack: Stack, source: Any) -> None:
    group = Group(fixed=True)
    for i, header in enumerate(source.headers):
        stack.append(Slot(Node("source", {"source": source, "column": i}, group=group), header))


@define("load", "creation", "The stored series of a key", NONE)
def _load(stack: Stack, call: Call, key: str, store: Any = None) -> None:
    from calstack.sources.store import StoredFrame, default_store

    source = StoredFrame(store or default_store(), key)
    for i, header in enumerate(source.headers):  # no group: each series is by itself
        stack.append(Slot(Node("source", {"source": source, "column": i}), header))


@define("from_pandas", "creation", "The columns of a pandas DataFrame or Series", NONE)
def _from_pandas(stack: Stack, call: Call, pandas: Any, round_: bool = False) -> None:
    from calstack.sources.frames import PandasFrame

    from_source(stack, PandasFrame(pandas, round_))


@define("from_spark", "creation", "Columns of a Spark DataFrame, one row for each date and key", NONE)
def _from_spark(stack: Stack, call: Call, frame: Any, date: str, values: list[str], period: str = "B", keys: tuple[str, ...] = ()) -> None:
    from calstack.sources.frames import Facts

    from_source(stack, Facts(frame, date, {v: ("last", v) for v in values}, period, tuple(keys)))


@define("facts", "creation", "Columns that aggregate a table's rows by period: header -> (function, column)", NONE)
def _facts(stack: Stack, call: Call, frame: Any, date: str, values: dict, period: str = "B", keys: tuple[str, ...] = ()) -> None:
    from calstack.sources.frames import Facts

    source = Facts(frame, date, values, period, tuple(keys))
    for i, header in enumerate(source.headers):
        stack.append(Slot(Node("source", {"source": source, "column": i}), header))


# Stack


def _id(stack: Stack, call: Call) -> None:
    pass


def _some(stack: Stack, call: Call) -> None:
    if not stack:
        raise IndexError(f"no column for {call.steps[call.at].word.name}")


add("id", "stack", "Does nothing", ALL, _id)
add("pull", "stack", "Brings the selected columns to the top", ALL, _some)
add("dup", "stack", "Copies the selected columns to the top", replace(TOP, copies=True), _some)
add("keep", "stack", "Removes the columns that are not selected", replace(ALL, discards=True), _id)
add("drop", "stack", "Removes the selected columns", replace(TOP, discards=True), _id, inverse=True)
add("nip", "stack", "Removes all but the top column", replace(TOP, discards=True), _id)


@define("roll", "stack", "The last selected column becomes the first", ALL)
def _roll(stack: Stack, call: Call) -> None:
    stack[:] = stack[-1:] + stack[:-1]


add("swap", "stack", "Swaps the two top columns", TOP_TWO, _roll)
add("rev", "stack", "Reverses the columns", ALL, lambda stack, call: stack.reverse())


@define("interleave", "stack", "Deals equal blocks of columns in turns", ALL)
def _interleave(stack: Stack, call: Call, parts: int = 2) -> None:
    if len(stack) % parts:
        raise ValueError(f"{len(stack)} columns do not make {parts} equal parts")
    size = len(stack) // parts
    stack[:] = [stack[p * size + i] for i in range(size) for p in range(parts)]


add("hsort", "stack", "Sorts the columns by header", ALL, lambda stack, call: stack.sort(key=lambda s: s.header))

# Headers


def _split(headers: tuple[str, ...]) -> list[str]:
    return headers[0].split(",") if len(headers) == 1 else list(headers)


@define("hset", "headers", "Sets the headers of the last columns", ALL)
def _hset(stack: Stack, call: Call, *headers: str) -> None:
    names = _split(headers)
    if len(names) > len(stack):
        raise ValueError(f"{len(names)} headers for {len(stack)} columns")
    for slot, name in zip(stack[len(stack) - len(names) :], names, strict=True):
        slot.header = name


@define("hsetall", "headers", "Sets all headers, over and over, the last one to the last column", ALL)
def _hsetall(stack: Stack, call: Call, *headers: str) -> None:
    names = _split(headers)
    for i, slot in enumerate(stack):
        slot.header = names[(i - len(stack)) % len(names)]


def renaming(name: str, doc: str, change: Callable[..., str]) -> None:
    def run(stack: Stack, call: Call, *args: Any, **kwargs: Any) -> None:
        for slot in stack:
            slot.header = change(slot.header, *args, **kwargs)

    add(name, "headers", doc, ALL, run)


renaming("hformat", "Formats the headers", lambda header, format_spec: format_spec.format(header))
renaming("hreplace", "Replaces text in the headers", lambda header, old, new="": header.replace(old, new))
renaming("happly", "Applies a function to the headers", lambda header, header_func: header_func(header))


def letters(n: int) -> str:
    """0 is a, 25 is z, 26 is aa."""
    text = ""
    while n >= 0:
        n, last = divmod(n, 26)
        text, n = "abcdefghijklmnopqrstuvwxyz"[last] + text, n - 1
    return text


@define("halpha", "headers", "Headers a, b, ... z, aa", ALL)
def _halpha(stack: Stack, call: Call) -> None:
    for i, slot in enumerate(stack):
        slot.header = letters(i)


# Quotation and combinators


@define("q", "quotation", "Quotes a program", NONE, quotes=True)
def _q(stack: Stack, call: Call, quoted: Program | None = None) -> None:
    if quoted is not None:
        call.push(quoted)


def _call(stack: Stack, call: Call) -> None:
    call.quotations(1)[0].run(stack)


add("call", "combinators", "Runs the quotation", ALL, _call)
add("call0", "combinators", "Runs the quotation on a stack of its own", NONE, _call)


@define("map", "combinators", "Runs the quotation on every so many columns", ALL)
def _map(stack: Stack, call: Call, every: int = 1) -> None:
    if len(stack) % every:
        raise ValueError(f"{len(stack)} columns do not divide by {every}")
    stack[:] = [s for i in range(0, len(stack), every) for s in call.quotations(1)[0].run(stack[i : i + every])]


@define("repeat", "combinators", "Runs the quotation so many times", ALL)
def _repeat(stack: Stack, call: Call, times: int = 2) -> None:
    for _ in range(times):
        call.quotations(1)[0].run(stack)


@define("hmap", "combinators", "Runs the quotation on the columns of each header", ALL)
def _hmap(stack: Stack, call: Call) -> None:
    groups: dict[str, Stack] = {}
    for slot in stack:
        groups.setdefault(slot.header, []).append(slot)
    stack[:] = [s for group in groups.values() for s in call.quotations(1)[0].run(group)]


@define("cleave", "combinators", "Runs each quotation on its own copy of the columns", ALL)
def _cleave(stack: Stack, call: Call, num_quotations: int = -1) -> None:
    quoted = call.quotations(num_quotations)
    stack[:] = [s for program in reversed(quoted) for s in program.run([slot.copy() for slot in stack])]


@define("ifexists", "combinators", "Runs the quotation if there are so many columns", ALL)
def _ifexists(stack: Stack, call: Call, count: int = 1) -> None:
    if len(stack) >= count:
        _call(stack, call)


@define("ifexistselse", "combinators", "Runs the top quotation if there are so many columns, else the second", ALL)
def _ifexistselse(stack: Stack, call: Call, count: int = 1) -> None:
    call.quotations(2)[0 if len(stack) >= count else 1].run(stack)


@define("ifheaders", "combinators", "Runs the quotation if the headers fulfil a predicate", ALL)
def _ifheaders(stack: Stack, call: Call, predicate: Callable[[list[str]], bool]) -> None:
    if predicate([s.header for s in stack]):
        _call(stack, call)


@define("ifheaderselse", "combinators", "Runs the top quotation if the headers fulfil a predicate, else the second", ALL)
def _ifheaderselse(stack: Stack, call: Call, predicate: Callable[[list[str]], bool]) -> None:
    call.quotations(2)[0 if predicate([s.header for s in stack]) else 1].run(stack)


@define("partial", "combinators", "Puts the selected columns before a quotation's own", TOP, quotes=True)
def _partial(stack: Stack, call: Call) -> None:
    bound = stack[:]
    stack.clear()
    put = Definition("bound", "combinators", "Columns bound to a quotation", NONE, lambda own, _: own.extend(s.copy() for s in bound))
    call.push(Program((Step(put, select=NONE),)) + call.take(1)[0])


@define("compose", "combinators", "Joins the quotations before it to one", ALL, quotes=True)
def _compose(stack: Stack, call: Call, num_quotations: int = 2) -> None:
    joined = Program()
    for program in reversed(call.take(num_quotations)):
        joined = joined + program
    call.push(joined)


# Clean-up


add("fill", "clean-up", "Missing values become a value", ALL, lambda stack, call, value: derive(stack, "fill", value=value))
add("ffill", "clean-up", "Missing values become the last valid one, from `lookback` slots before the range on", ALL, lambda stack, call, lookback=10, leave_end=True: derive(stack, "ffill", lookback=int(lookback), leave_end=leave_end))
add("fillfirst", "clean-up", "The first row becomes the last one of valid columns within `lookback` slots", TOP, lambda stack, call, lookback=5: derive(stack, "fillfirst", lookback=abs(lookback)))
add("sync", "clean-up", "Rows with a missing value become missing in all columns", ALL, lambda stack, call: derive(stack, "sync"))
add("zero_first", "clean-up", "The first row becomes 0", TOP, lambda stack, call: derive(stack, "zero_first"))
add("zero_to_na", "clean-up", "Zeros become missing", TOP, lambda stack, call: derive(stack, "function", name="zero_to_na"))
add("join", "clean-up", "The first column before a date, the second from it on", TOP_TWO, lambda stack, call, date: combine(stack, "join", date=parse_date(date)))

# Resampling

for _name, _doc in (
    ("sum", "sum of the period"),
    ("last", "last valid value up to the period's end"),
    ("avg", "mean of the period"),
    ("lastnofill", "value of the period's last slot"),
    ("first", "first valid value from the period's start"),
    ("firstnofill", "value of the period's first slot"),
    ("min", "least of the period"),
    ("max", "greatest of the period"),
):

    def _resample(stack: Stack, call: Call, method: str = _name) -> None:
        for slot in stack:
            slot.resampler = method

    add(f"resample_{_name}", "resampling", f"Changes of calendar take the {_doc}", ALL, _resample)


@define("set_periodicity", "resampling", "Evaluates on another calendar, then resamples", TOP)
def _set_periodicity(stack: Stack, call: Call, period: str | Periodicity) -> None:
    for slot in stack:
        slot.node = Node("period", {"periodicity": periodicity(period)}, [slot.input])
        slot.resampler = "last"


add("set_start", "resampling", "Evaluates from another start, a date or a number of slots from the first", TOP, lambda stack, call, start: derive(stack, "start", start=start if isinstance(start, int) else parse_date(start)))

# Reductions and functions


def reducing(name: str, doc: str, ignores: bool) -> None:
    def run(stack: Stack, call: Call, ignore_nans: bool = ignores) -> None:
        combine(stack, "reduction", name=name, ignore=ignore_nans)

    add("n" * ignores + name, "reductions ignoring missing values" if ignores else "reductions", doc, TOP_TWO, run)


for _name, (_doc, _, _) in REDUCTIONS.items():
    reducing(_name, f"{_doc}, missing if any value is", False)
    reducing(_name, f"{_doc} of the valid values", True)

for _name, (_doc, _) in FUNCTIONS.items():
    if _name not in VOCABULARY:
        add(_name, "functions", _doc, TOP, lambda stack, call, name=_name: derive(stack, "function", name=name))
add("rank", "functions", "Place of each value in its row, from 0, missing last", ALL, lambda stack, call: derive(stack, "rank", fixed=True))

add("apply", "functions", "A function of a Spark column, given as a Python callable", TOP, lambda stack, call, function: derive(stack, "apply", function=function))

# Windows

for _name, (_doc, _) in ROLLING.items():
    add(f"r{_name}", "rolling", _doc, TOP, lambda stack, call, window=2, name=_name: derive(stack, "rolling", name=name, window=window))
for _name, _doc in (("rcov", "Rolling covariance of the population"), ("rcor", "Rolling covariance over the product of variances")):
    add(_name, "rolling", _doc, TOP_TWO, lambda stack, call, window=2, name=_name: combine(stack, "rolling_pair", name=name, window=window))
for _name in ("mean", "var", "std"):
    add(f"ewm_{_name}", "rolling", f"Exponentially weighted {dict(mean='mean', var='variance', std='standard deviation')[_name]}", TOP, lambda stack, call, window=2, name=_name: derive(stack, "exponential", name=name, window=window))
for _name, (_doc, _) in CUMULATIVE.items():
    add(f"c{_name}", "cumulative", _doc, TOP, lambda stack, call, name=_name: derive(stack, "cumulative", name=name, reverse=False))
    add(f"rc{_name}", "reverse cumulative", f"{_doc}, from the end", TOP, lambda stack, call, name=_name: derive(stack, "cumulative", name=name, reverse=True))


def resolve(name: str) -> Program | None:
    """A word, or a literal: c10, c1_5, c_2 and r5."""
    if m := re.match(r"c(_?)(\d[_\d]*)", name):
        value = float(m[2].replace("_", "."))
        return Program((Step(VOCABULARY["c"], select=NONE),))(-value if m[1] else value)
    if m := re.match(r"r(\d+)", name):
        return Program((Step(VOCABULARY["c"], select=NONE),))(*range(int(m[1])))
    found = VOCABULARY.get(name)
    if found is None or isinstance(found, Program):
        return found
    return Program((Step(found, select=found.select),))


class Definitions:
    """define['name'] = program adds a word."""

    def __setitem__(self, name: str, program: Program) -> None:
        VOCABULARY[name] = program

    def __getitem__(self, name: str) -> Program:
        if (found := resolve(name)) is None:
            raise KeyError(name)
        return found

    def __delitem__(self, name: str) -> None:
        del VOCABULARY[name]


def vocabulary_rows() -> list[tuple[str, str, str, str]]:
    """(category, word, default columns, description) of every word."""
    rows = []
    for name, found in VOCABULARY.items():
        if isinstance(found, Program):
            rows.append(("defined", name, "", str(found)))
        else:
            s = found.select.part
            shown = "none" if found.select == NONE else f"[{'' if s.start is None else s.start}:{'' if s.stop is None else s.stop}]"
            rows.append((found.category, name, shown, found.doc))
    return rows


def vocabulary_text() -> str:
    """The words as a table for each category."""
    out, last = [], ""
    for category, name, columns, doc in sorted(vocabulary_rows(), key=lambda r: r[0]):
        if category != last:
            out += ["", f"### {category}", "", "word | columns | description", ":---|:---|:---"]
            last = category
        out.append(f"{name} | {columns} | {doc}")
    return "\n".join(out[1:])


