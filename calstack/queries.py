"""Registered queries, one for each word or part of the engine, with DuckDB SQL.

Most run over the orders table, aggregated by business day: u and l are the price
sums of urgent and of low-priority orders, n the number of urgent ones less 2, so
there are gaps, zeros and negative values. They cover all rows of their tables, but for
those whose subject is a range. Results are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import calstack as cs
from calstack.functions.calendar import CALENDARS, Range
from calstack.functions.sorted_set import SortedSet
from calstack.operators.windows import CUMULATIVE, ROLLING
from calstack.plans.program import Program
from calstack.sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: All slots of the orders, and a part of them for what is about ranges.
FIRST, LAST = "1995-01-02", "2001-08-04"
PART = ("1996-01-02", "2000-12-30")
#: Ends the longest period that holds an order.
PERIODS = "2002-01-05"
B = CALENDARS["B"]
START, STOP = B.ordinal(FIRST), B.ordinal(LAST)
PART_START, PART_STOP = map(B.ordinal, PART)
WINDOW = 5
BACK = max(5, int(WINDOW * 1.25))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def priced(priority: str):
    return F.when(F.col("o_orderpriority") == priority, F.col("o_totalprice"))


def orders(spark: SparkSession, sf_dir: str, *columns: str) -> Program:
    """The stack u, l, n, or some of it."""
    made = {
        "u": ("sum", priced("1-URGENT") / 99991),
        "l": ("sum", priced("5-LOW") / 99991),
        "n": ("sum", F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)),
    }
    program = cs.facts(table(spark, sf_dir, "orders"), "o_orderdate", {c: made[c] for c in (columns or ("u", "l"))})
    return program + cs.c(2) + cs.sub.cols[[r"n", r"c2"]] if "n" in columns else program


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    return frame.select(*(F.round(F.col(f"`{c}`"), digits).__add__(F.lit(0.0)).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in frame.dtypes))


def base(start: int = START, stop: int = STOP) -> str:
    """CTEs f, t (o, u, l, n for every slot) in SQL."""
    k = "date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 3"
    return f"""f AS (
  SELECT (({k}) // 7) * 5 + least(({k}) % 7, 5) - 3 AS o,
    sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice / 99991 END) AS u,
    sum(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice / 99991 END) AS l,
    CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS DOUBLE) - 2 AS n
  FROM orders GROUP BY 1),
t AS (SELECT c.o, DATE '1970-01-01' + CAST(((c.o + 3) // 5) * 7 + (c.o + 3) % 5 - 3 AS INTEGER) AS date, u, l, n
  FROM (SELECT unnest(range({start}, {stop})) AS o) c LEFT JOIN f ON f.o = c.o)"""


def r(expression: str, digits: int = 6) -> str:
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0"


def select(columns: dict[str, str], start: int = START, stop: int = STOP, more: str = "", source: str = "t", windows: str = "", within: tuple[int, int] = (START, STOP)) -> str:
    """SQL over slots start to stop whose result is cut to those within a range."""
    made = ", ".join(f'{r(e)} AS "{c}"' for c, e in columns.items())
    inner = f"SELECT o, date, {made} FROM {source} {windows}"
    return f"WITH RECURSIVE {base(start, stop)}{more} SELECT * EXCLUDE (o) FROM ({inner}) WHERE o BETWEEN {within[0]} AND {within[1] - 1}"


def query(name: str, program: Callable[[SparkSession, str], Program], sql: str | None, wanted: tuple[str, str] = (FIRST, LAST)) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(program(spark, sf_dir).rows[wanted[0] : wanted[1]])
    if sql is not None:
        SQL[name] = sql


# The headline program: how far each day is from its moving average.

QUERIES["moving_average_deviation"] = lambda spark, sf_dir: rounded((cs.facts(table(spark, sf_dir, "orders"), "o_orderdate", {"total": ("sum", F.col("o_totalprice") / 99991)}) + ~(cs.dup + cs.ravg(20) + cs.sub) + cs.map).rows[:])
SQL["moving_average_deviation"] = """WITH f AS (SELECT ((date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 3) // 7) * 5 + least((date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 3) % 7, 5) - 3 AS o, sum(o_totalprice / 99991) AS x FROM orders GROUP BY 1),
t AS (SELECT c.o, x, x IS NOT NULL AS ok FROM (SELECT unnest(range(min(o), max(o) + 1)) AS o FROM f) c LEFT JOIN f ON f.o = c.o)
SELECT DATE '1970-01-01' + CAST(((o + 3) // 5) * 7 + (o + 3) % 5 - 3 AS INTEGER) AS date,
  round(CASE WHEN ok AND row_number() OVER (PARTITION BY ok ORDER BY o) > 1 THEN x - avg(x) OVER (PARTITION BY ok ORDER BY o ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END, 6) + 0.0 AS total FROM t"""

# Rolling, cumulative and reverse cumulative words, on two columns that share a mask.

OK = "(u IS NOT NULL AND l IS NOT NULL)"


def masked(x: str) -> str:
    return f"CASE WHEN {OK} THEN {x} END"


def windows_sql(n: int = WINDOW) -> str:
    p = f"PARTITION BY {OK} ORDER BY o"
    return (
        f"WINDOW w AS ({p}), sofar AS ({p} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), roll AS ({p} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), "
        f"rest AS ({p} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )


ROLLING_SQL = {
    "add": "sum({x}) OVER roll",
    "avg": "CASE WHEN row_number() OVER w > 1 THEN avg({x}) OVER roll END",
    "std": "stddev_pop({x}) OVER roll",
    "var": "var_pop({x}) OVER roll",
    "min": "min({x}) OVER roll",
    "max": "max({x}) OVER roll",
    "med": "median({x}) OVER roll",
    "lag": "lag({x}, {m}) OVER w",
    "dif": "{x} - lag({x}, {m}) OVER w",
    "ret": "{x} / lag({x}, {m}) OVER w - 1",
    "zsc": "CASE WHEN row_number() OVER w > 1 AND stddev_pop({x}) OVER roll <> 0 THEN ({x} - avg({x}) OVER roll) / stddev_pop({x}) OVER roll END",
}
FULL = {"add", "std", "var", "min", "max", "med"}
for _name in ROLLING:

    def _rolling(spark: SparkSession, sf_dir: str, name: str = _name) -> Program:
        return orders(spark, sf_dir) + cs.resolve(f"r{name}")(WINDOW).cols[:]

    def _sql(x: str, name: str = _name) -> str:
        made = ROLLING_SQL[name].format(x=x, m=WINDOW - 1)
        return masked(f"CASE WHEN row_number() OVER w >= {WINDOW} THEN {made} END" if name in FULL else made)

    query(f"r{_name}", _rolling, select({"u": _sql("u"), "l": _sql("l")}, START - BACK, windows=windows_sql()))

query("rcov", lambda s, d: orders(s, d) + cs.rcov(WINDOW), select({"u": masked(f"CASE WHEN row_number() OVER w >= {WINDOW} THEN avg(u * l) OVER roll - avg(u) OVER roll * avg(l) OVER roll END")}, START - BACK, windows=windows_sql()))
query("rcor", lambda s, d: orders(s, d) + cs.rcor(WINDOW), select({"u": masked(f"CASE WHEN row_number() OVER w >= {WINDOW} THEN (avg(u * l) OVER roll - avg(u) OVER roll * avg(l) OVER roll) / (var_pop(u) OVER roll * var_pop(l) OVER roll) END")}, START - BACK, windows=windows_sql()))

CUMULATIVE_SQL = {
    "add": "sum({x}) OVER {w}",
    "sub": "2 * first_value({x}) OVER {w} - sum({x}) OVER {w}",
    "mul": "product({x}) OVER {w}",
    "avg": "avg({x}) OVER {w}",
    "std": "CASE WHEN count({x}) OVER {w} > 1 THEN stddev_samp({x}) OVER {w} END",
    "var": "CASE WHEN count({x}) OVER {w} > 1 THEN var_samp({x}) OVER {w} END",
    "min": "min({x}) OVER {w}",
    "max": "max({x}) OVER {w}",
    "lag": "first_value({x}) OVER {w}",
    "dif": "{x} - first_value({x}) OVER {w}",
    "ret": "{x} / first_value({x}) OVER {w} - 1",
}
for _name in CUMULATIVE:
    for _prefix, _w in (("c", "sofar"), ("rc", "rest")):

        def _cumulative(spark: SparkSession, sf_dir: str, name: str = _prefix + _name) -> Program:
            near_one = ~(cs.c(0.01) + cs.mul + cs.inc) + cs.map if name.endswith("mul") else cs.id
            return orders(spark, sf_dir) + near_one + cs.resolve(name).cols[:]

        _column = {c: CUMULATIVE_SQL[_name].format(x=f"(0.01 * {c} + 1)" if _name == "mul" else c, w=_w) for c in "ul"}
        query(_prefix + _name, _cumulative, select({c: masked(e) for c, e in _column.items()}, windows=windows_sql()))

# Products grow beyond what a fixed number of decimals can compare: their logarithms do not.
for _prefix, _w in (("c", "sofar"), ("rc", "rest")):
    query(f"{_prefix}mul", lambda s, d, name=f"{_prefix}mul": orders(s, d) + ~(cs.c(0.01) + cs.mul + cs.inc) + cs.map + cs.resolve(name).cols[:] + cs.log.cols[:], select({c: masked(f"ln(product(0.01 * {c} + 1) OVER {_w})") for c in "ul"}, windows=windows_sql()))

# Exponentially weighted words: the recurrence itself, row by row, in SQL.

ALPHA = 2 / (WINDOW + 1)
EWM = f""", v AS (SELECT o, date, u AS x, row_number() OVER (ORDER BY o) - 1 AS k FROM t WHERE u IS NOT NULL),
e AS (SELECT k, x, x AS y, CAST(0 AS DOUBLE) AS s FROM v WHERE k = 0 UNION ALL
  SELECT v.k, v.x, {ALPHA!r} * v.x + (1 - {ALPHA!r}) * e.y,
    {ALPHA!r} * pow(v.x - ({ALPHA!r} * v.x + (1 - {ALPHA!r}) * e.y), 2) + (1 - {ALPHA!r}) * e.s
  FROM e JOIN v ON v.k = e.k + 1),
b AS (SELECT v.o, e.*, (1 - pow(1 - {ALPHA!r}, least(e.k + 1, {WINDOW}))) / {ALPHA!r} AS one, (1 - pow(1 - {ALPHA!r}, 2 * least(e.k + 1, {WINDOW}))) / (1 - pow(1 - {ALPHA!r}, 2)) AS two FROM e JOIN v ON v.k = e.k),
j AS (SELECT t.o, t.date, b.* EXCLUDE (o), CASE WHEN k > 0 THEN s * one * one / (one * one - two) END AS var FROM t LEFT JOIN b ON b.o = t.o)"""
for _name, _column in (("mean", "y"), ("var", "var"), ("std", "sqrt(var)")):
    query(f"ewm_{_name}", lambda s, d, name=f"ewm_{_name}": orders(s, d, "u") + cs.resolve(name)(WINDOW), select({"u": _column}, START - BACK, more=EWM, source="j"))

# Wide windows, from running totals.

for _name in ("add", "avg", "std", "var", "zsc"):

    def _wide(spark: SparkSession, sf_dir: str, name: str = _name) -> Program:
        return orders(spark, sf_dir) + cs.resolve(f"r{name}")(300).cols[:]

    def _wide_sql(x: str, name: str = _name) -> str:
        made = ROLLING_SQL[name].format(x=x, m=299)
        return masked(f"CASE WHEN row_number() OVER w >= 300 THEN {made} END" if name in FULL else made)

    query(f"r{_name}_wide", _wide, select({"u": _wide_sql("u"), "l": _wide_sql("l")}, START - 375, windows=windows_sql(300)))

# Wide windows over outliers: each spoils the windows that hold it, and no other.


def spiked(spark: SparkSession, sf_dir: str) -> Program:
    spike = F.when(F.dayofyear("o_orderdate") == 100, 1e12).otherwise(F.col("o_totalprice") / 99991)
    return cs.facts(table(spark, sf_dir, "orders"), "o_orderdate", {"u": ("sum", spike)})


SPIKED = "s AS (SELECT t.o, t.date, g.u FROM t LEFT JOIN (SELECT (({k}) // 7) * 5 + least(({k}) % 7, 5) - 3 AS o, sum(CASE WHEN dayofyear(o_orderdate) = 100 THEN 1e12 ELSE o_totalprice / 99991 END) AS u FROM orders GROUP BY 1) g ON g.o = t.o)".format(k="date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 3")
for _n in (257, 300):
    for _name in ("std", "avg"):
        _window = f"WINDOW w AS (PARTITION BY u IS NOT NULL ORDER BY o), roll AS (PARTITION BY u IS NOT NULL ORDER BY o ROWS BETWEEN {_n - 1} PRECEDING AND CURRENT ROW)"
        # on windows without an outlier: the others have lost these decimals on either side
        _made = f"CASE WHEN u IS NOT NULL AND max(u) OVER roll < 1e9 AND row_number() OVER w >= {_n} THEN {'stddev_pop' if _name == 'std' else 'avg'}(u) OVER roll END"
        QUERIES[f"r{_name}_{_n}_outliers"] = lambda spark, sf_dir, n=_n, name=_name: rounded((spiked(spark, sf_dir) + cs.dup + cs.hset("m,u") + cs.resolve(f"r{name}")(n) + cs.rmax(n).cols["m"]).rows[FIRST:LAST].selectExpr("date", "CASE WHEN m < 1e9 THEN u END AS u"))
        SQL[f"r{_name}_{_n}_outliers"] = select({"u": _made}, START - int(1.25 * _n), more=", " + SPIKED, source="s", windows=_window)

# Row-wise reductions, plain and ignoring missing values.

FOLDS = {"sub": "{a} - {b}", "mul": "{a} * {b}", "div": "{a} / {b}", "pow": "pow({a}, {b})", "mod": "CASE WHEN {b} <> 0 THEN {a} - floor({a} / {b}) * {b} END"}
SETS = {"add": "list_sum({s})", "avg": "list_avg({s})", "std": "list_stddev_pop({s})", "var": "list_var_pop({s})", "min": "list_min({s})", "max": "list_max({s})", "med": "list_median({s})"}


def reduction_sql(name: str, ignoring: bool) -> str:
    if name in SETS:
        made = SETS[name].format(s="[u, l]")
    elif not ignoring:
        return FOLDS[name].format(a="u", b="l")
    else:
        return f"CASE WHEN u IS NULL THEN l WHEN l IS NULL THEN u ELSE {FOLDS[name].format(a='u', b='l')} END"
    return made if ignoring else masked(made)


for _name in (*SETS, *FOLDS):
    for _prefix in ("", "n"):
        _made = reduction_sql(_name, bool(_prefix))
        if _name == "pow":  # beyond a fixed number of decimals
            query(_prefix + _name, lambda s, d, name=_prefix + _name: orders(s, d) + cs.resolve(name) + cs.log, select({"u": f"ln({_made})"}))
        else:
            query(_prefix + _name, lambda s, d, name=_prefix + _name: orders(s, d) + cs.resolve(name), select({"u": _made}))

# Functions of one column: n has zeros and negative values.

FUNCTION_SQL = {
    "neg": "-n",
    "inv": "CASE WHEN n = 0 THEN CAST('inf' AS DOUBLE) ELSE 1 / n END",
    "abs": "abs(n)",
    "sqrt": "CASE WHEN n >= 0 THEN sqrt(n) END",
    "log": "CASE WHEN n = 0 THEN CAST('-inf' AS DOUBLE) WHEN n > 0 THEN ln(n) END",
    "exp": "exp(n)",
    "lnot": "CASE WHEN n = 0 THEN 1 ELSE 0 END",
    "expm1": "exp(n) - 1",
    "log1p": "CASE WHEN n = -1 THEN CAST('-inf' AS DOUBLE) WHEN n > -1 THEN ln(1 + n) END",
    "sign": "sign(n)",
    "inc": "n + 1",
    "dec": "n - 1",
    "zero_to_na": "nullif(n, 0)",
}
for _name, _expression in FUNCTION_SQL.items():
    query(_name, lambda s, d, name=_name: orders(s, d, "n") + cs.resolve(name), select({"n": _expression}))

EVENT_TYPES_SQL = "e AS (SELECT ((date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) + 3) // 7) * 5 + least((date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) + 3) % 7, 5) - 3 AS o, event_type AS h, sum(value) / 97 AS x FROM events GROUP BY ALL)"


def events(spark: SparkSession, sf_dir: str) -> Program:
    """A column for each of the five types of event, named in order."""
    frame = table(spark, sf_dir, "events")
    types = ["click", "error", "purchase", "signup", "view"]
    return cs.facts(frame, "ts", {t: ("sum", F.when(F.col("event_type") == t, F.col("value")) / 100) for t in types})


QUERIES["rank"] = lambda spark, sf_dir: (events(spark, sf_dir) + cs.rank).rows["2024-01-01":"2024-01-31"]
SQL["rank"] = f"""WITH {EVENT_TYPES_SQL},
g AS (SELECT c.o, h, x, CAST(rank() OVER (PARTITION BY c.o ORDER BY x NULLS LAST) + 0 AS DOUBLE) - 1 AS k, row_number() OVER (PARTITION BY c.o ORDER BY x NULLS LAST, h) - 1 AS p
  FROM (SELECT o, h FROM (SELECT unnest(range(14087, 14109)) AS o), (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS h)) c LEFT JOIN e USING (o, h))
SELECT DATE '1970-01-01' + CAST(((o + 3) // 5) * 7 + (o + 3) % 5 - 3 AS INTEGER) AS date, {", ".join(f"CAST(max(CASE WHEN h = '{t}' THEN p END) AS DOUBLE) AS {t}" for t in ("click", "error", "purchase", "signup", "view"))} FROM g GROUP BY o"""

# Creation: every calendar's own columns.

for _code, _p in CALENDARS.items():
    _range = Range(_p.ordinal("1999-11-15"), _p.ordinal("2001-03-15"), _p)
    QUERIES[f"calendar_{_code}"] = lambda spark, sf_dir, wanted=_range: rounded((cs.timestamp + cs.period_ordinal + cs.day_count + cs.year_frac).rows[wanted])
    if _code == "B":
        _end = "DATE '1970-01-01' + CAST((({o} + 3) // 5) * 7 + ({o} + 3) % 5 - 3 AS INTEGER)"
    elif _p.step == 7:
        _end = f"DATE '1970-01-01' + CAST({{o}} * 7 + ({_p.anchor}) AS INTEGER)"
    else:
        _last = f"CAST(DATE '1970-01-01' + to_months(CAST(({{o}} + 1) * {_p.step} AS INTEGER)) AS DATE) - 1"
        _end = f"({_last}) - CAST(greatest(0, isodow({_last}) - 5) AS INTEGER)"
    _days = "date_diff('day', make_date(year({d}), 1, 1), make_date(year({d}) + 1, 1, 1))"
    SQL[f"calendar_{_code}"] = f"""WITH t AS (SELECT o, {_end.format(o="o")} AS e, {_end.format(o="(o - 1)")} AS b FROM (SELECT unnest(range({_range.start}, {_range.stop})) AS o))
SELECT CAST(e AS DATE) AS date, date_diff('day', DATE '1970-01-01', e) * 86400e9 AS timestamp, CAST(o AS DOUBLE) AS period_ordinal, CAST(date_diff('day', b, e) AS DOUBLE) AS day_count,
  round(CASE WHEN year(b) = year(e) THEN date_diff('day', b, e) / {_days.format(d="b")} ELSE date_diff('day', b, make_date(year(e), 1, 1)) / {_days.format(d="b")} + date_diff('day', make_date(year(e), 1, 1), e) / {_days.format(d="e")} END, 6) + 0.0 AS year_frac FROM t"""

query("constants", lambda s, d: cs.c(1, -2.5) + cs.r(2) + cs.nan + cs.c10 + cs.c_1_5 + 4, select({"c1": "1", "c_2_5": "-2.5", "c0": "0", "c1_1": "1", "nan": "NULL", "c10_0": "10", "c_1_5": "-1.5", "c4": "4"}))
query("from_spark", lambda s, d: cs.from_spark(table(s, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.sum("o_totalprice").alias("x")).where("weekday(day) < 5"), "day", ["x"]) + cs.c(99991) + cs.div, f"WITH {base()}, g AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) / 99991 AS x FROM orders GROUP BY 1) SELECT t.date, {r('g.x')} AS x FROM t LEFT JOIN g ON g.date = t.date")

# Stack, headers and combinators.

query("stack_words", lambda s, d: orders(s, d, "u", "l") + cs.swap + cs.dup + cs.rev + cs.roll + cs.interleave.cols[-2:] + cs.pull.cols[0] + cs.drop.cols[0] + cs.hsort, select({"l": "l", "u": "u"}))
query("selectors", lambda s, d: orders(s, d, "u", "l") + cs.add.cols[["u", "l"]].copy + cs.hset("u,l,s") + cs.pull.cols["u"].copy + cs.hset("v") + cs.keep.cols["[lsv]"] + cs.nip.cols[:] + cs.id, select({"l": "l", "s": masked("u + l"), "v": "u"}))
query("headers", lambda s, d: orders(s, d) + cs.halpha + cs.hformat("{0}_x") + cs.hreplace("_x", "_y") + cs.happly(str.upper) + cs.dup.cols[:] + cs.hsetall("p,q").cols[-2:], select({"A_Y": "u", "B_Y": "l", "p": "u", "q": "l"}))
query("map", lambda s, d: orders(s, d) + ~(cs.dup + cs.mul) + cs.map, select({"u": "u * u", "l": "l * l"}))
query("hmap", lambda s, d: orders(s, d) + cs.dup.cols[:] + ~cs.add.cols[:] + cs.hmap, select({"u": "2 * u", "l": "2 * l"}))
query("cleave", lambda s, d: orders(s, d, "u") + ~cs.neg + ~cs.sqrt + ~(cs.inc + cs.hset("v")) + cs.cleave, select({"u": "-u", "u_1": "sqrt(u)", "v": "u + 1"}))
query("repeat_call", lambda s, d: orders(s, d) + ~cs.inc.cols[:] + cs.repeat(3) + ~cs.add + cs.call + (cs.c(2) + cs.dup + cs.mul).local + cs.mul + ~cs.c(1) + cs.call0 + cs.add, select({"u": "(u + l + 6) * 4 + 1"}))
query("partial_compose", lambda s, d: orders(s, d) + ~cs.mul + cs.partial + cs.map + ~cs.inc + ~cs.neg + cs.compose + cs.map, select({"u": "-(l * u + 1)"}))
query("conditionals", lambda s, d: orders(s, d) + ~cs.inc.cols[:] + cs.ifexists(2) + ~cs.neg.cols[:] + ~cs.dec.cols[:] + cs.ifexistselse(3) + ~cs.inc + cs.ifheaders(lambda h: "u" in h) + ~cs.neg.cols[:] + ~cs.inc.cols[:] + cs.ifheaderselse(lambda h: len(h) > 2), select({"u": "u + 1", "l": "l"}))
cs.define["squared"] = cs.dup + cs.mul
query("define", lambda s, d: orders(s, d, "u") + cs.squared, select({"u": "u * u"}))

# Clean-up and range control.

query("fill", lambda s, d: orders(s, d) + cs.fill(0.5), select({"u": "coalesce(u, 0.5)", "l": "coalesce(l, 0.5)"}))
query("ffill", lambda s, d: orders(s, d) + cs.ffill(10), select({c: f"CASE WHEN o <= max(CASE WHEN {c} IS NOT NULL THEN o END) OVER () THEN last_value({c} IGNORE NULLS) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END" for c in "ul"}, PART_START - 10, PART_STOP, within=(PART_START, PART_STOP)), PART)
query("ffill_whole", lambda s, d: orders(s, d) + cs.ffill(10, leave_end=False), select({c: f"last_value({c} IGNORE NULLS) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" for c in "ul"}, START - 10))
query("fillfirst", lambda s, d: orders(s, d) + cs.fillfirst(5).cols[:], select({c: f"CASE WHEN o = {PART_START} THEN last_value(CASE WHEN {OK} THEN {c} END IGNORE NULLS) OVER (ORDER BY o ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) ELSE {c} END" for c in "ul"}, PART_START - 5, PART_STOP, within=(PART_START, PART_STOP)), PART)
query("sync", lambda s, d: orders(s, d) + cs.sync, select({"u": masked("u"), "l": masked("l")}))
CUT = B.ordinal("1998-06-15")
query("join", lambda s, d: orders(s, d) + cs.cadd.cols[:] + cs.join("1998-06-15"), select({"u": masked(f"sum(CASE WHEN {OK} THEN CASE WHEN o < {CUT} THEN u ELSE l END END) OVER (PARTITION BY o < {CUT} ORDER BY o)")}))
query("zero_first", lambda s, d: orders(s, d, "u") + cs.zero_first, select({"u": f"CASE WHEN o = {PART_START} THEN 0 ELSE u END"}, PART_START, PART_STOP, within=(PART_START, PART_STOP)), PART)
query("set_start", lambda s, d: orders(s, d, "u") + cs.cadd + cs.set_start("1995-06-01"), select({"u": "CASE WHEN u IS NOT NULL THEN sum(u) OVER (ORDER BY o) END"}, B.ordinal("1995-06-01"), PART_STOP, within=(PART_START, PART_STOP)), PART)
query("set_start_offset", lambda s, d: orders(s, d, "u") + cs.cadd + cs.set_start(20), select({"u": f"CASE WHEN o >= {START + 20} AND u IS NOT NULL THEN sum(CASE WHEN o >= {START + 20} THEN u END) OVER (ORDER BY o) END"}))

# Resampling: business days to every other calendar, by every method.

RESAMPLING = {
    "sum": "coalesce(sum(u), 0)",
    "avg": "avg(u)",
    "min": "min(u)",
    "max": "max(u)",
    "last": "last(up ORDER BY o)",
    "lastnofill": "last(u ORDER BY o)",
    "first": "first(down ORDER BY o)",
    "firstnofill": "first(u ORDER BY o)",
}


def resampling_sql(code: str, method: str, start: str = FIRST, stop: str = PERIODS) -> str:
    p = CALENDARS[code]
    wanted = Range(p.ordinal(start), p.ordinal(stop), p)
    daily = wanted.change_periodicity("B")
    if p.step == 7:
        slot, end = f"(date_diff('day', DATE '1970-01-01', date) - ({p.anchor}) + 6) // 7", f"DATE '1970-01-01' + CAST(g * 7 + ({p.anchor}) AS INTEGER)"
    else:
        last = f"CAST(DATE '1970-01-01' + to_months(CAST((g + 1) * {p.step} AS INTEGER)) AS DATE) - 1"
        slot, end = f"((year(date) - 1970) * 12 + month(date) - 1) // {p.step}", f"({last}) - CAST(greatest(0, isodow({last}) - 5) AS INTEGER)"
    return f"""WITH {base(daily.start, daily.stop)},
s AS (SELECT *, {slot} AS g, last_value(u IGNORE NULLS) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up, first_value(u IGNORE NULLS) OVER (ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS down FROM t)
SELECT CAST({end} AS DATE) AS date, {r("x")} AS u FROM (SELECT g, {RESAMPLING[method]} AS x FROM s GROUP BY g) WHERE g BETWEEN {wanted.start} AND {wanted.stop - 1}"""


for _method in RESAMPLING:

    def _resample(spark: SparkSession, sf_dir: str, method: str = _method) -> DataFrame:
        return rounded((orders(spark, sf_dir, "u") + cs.resolve(f"resample_{method}") + cs.set_periodicity("B")).rows[FIRST:PERIODS:"M"])

    QUERIES[f"resample_{_method}"] = _resample
    SQL[f"resample_{_method}"] = resampling_sql("M", _method)
for _code in "NTWHFQY":
    QUERIES[f"resample_sum_{_code}"] = lambda spark, sf_dir, code=_code: rounded((orders(spark, sf_dir, "u") + cs.resample_sum).rows[FIRST:PERIODS:code])
    SQL[f"resample_sum_{_code}"] = resampling_sql(_code, "sum")


# Another calendar in between: a day that ends one of its periods has that period's sum.
for _code in "NTWHFMQY":
    QUERIES[f"set_periodicity_{_code}"] = lambda spark, sf_dir, code=_code: rounded((orders(spark, sf_dir, "u") + cs.resample_sum + cs.set_periodicity(code)).rows[FIRST:LAST])
    SQL[f"set_periodicity_{_code}"] = f"WITH s AS ({resampling_sql(_code, 'sum')}), {base()} SELECT t.date, s.u FROM t LEFT JOIN s ON s.date = t.date"

# Lineitem by month: a parallel aggregation straight to the calendar.

QUERIES["monthly_lineitem"] = lambda spark, sf_dir: rounded((cs.facts(table(spark, sf_dir, "lineitem"), "l_shipdate", {"quantity": ("sum", "l_quantity"), "discount": ("avg", "l_discount"), "lines": ("count", "l_linenumber")}, "M") + ~cs.rdif(13) + cs.map).rows["1995-01-01":"2001-12-01"])
SQL["monthly_lineitem"] = """WITH f AS (SELECT (year(l_shipdate) - 1970) * 12 + month(l_shipdate) - 1 AS o, CAST(sum(l_quantity) AS DOUBLE) AS quantity, avg(l_discount) AS discount, CAST(count(l_linenumber) AS DOUBLE) AS lines FROM lineitem GROUP BY 1),
t AS (SELECT c.o, quantity, discount, lines FROM (SELECT unnest(range(300 - 16, 383)) AS o) c LEFT JOIN f ON f.o = c.o)
SELECT date, round(quantity, 6) + 0.0 AS quantity, round(discount, 6) + 0.0 AS discount, round(lines, 6) + 0.0 AS lines FROM (
  SELECT o, CAST(CAST(DATE '1970-01-01' + to_months(CAST(o + 1 AS INTEGER)) AS DATE) - 1 - CAST(greatest(0, isodow(CAST(DATE '1970-01-01' + to_months(CAST(o + 1 AS INTEGER)) AS DATE) - 1) - 5) AS INTEGER) AS DATE) AS date,
    CASE WHEN quantity IS NOT NULL THEN quantity - lag(quantity, 12) OVER (PARTITION BY quantity IS NOT NULL ORDER BY o) END AS quantity,
    CASE WHEN quantity IS NOT NULL THEN discount - lag(discount, 12) OVER (PARTITION BY quantity IS NOT NULL ORDER BY o) END AS discount,
    CASE WHEN quantity IS NOT NULL THEN lines - lag(lines, 12) OVER (PARTITION BY quantity IS NOT NULL ORDER BY o) END AS lines
  FROM t) WHERE o >= 300"""

# A program for every user at once.


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = cs.facts(table(spark, sf_dir, "events"), "ts", {"x": ("sum", "value")}, keys=("user_id",)) + cs.dup + cs.hset("x,mean") + cs.ravg(3) + cs.dup + cs.hset("total") + cs.cadd
    return rounded(program.over("user_id").rows["2024-01-01":"2024-01-31"], 4)


QUERIES["panel"] = panel
SQL["panel"] = """WITH f AS (SELECT user_id, ((date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) + 3) // 7) * 5 + least((date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) + 3) % 7, 5) - 3 AS o, sum(value) AS x FROM events GROUP BY ALL),
t AS (SELECT u.user_id, c.o, x, x IS NOT NULL AS ok FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(14087, 14109)) AS o) c LEFT JOIN f ON f.o = c.o AND f.user_id = u.user_id),
m AS (SELECT *, CASE WHEN ok AND row_number() OVER (PARTITION BY user_id, ok ORDER BY o) > 1 THEN avg(x) OVER (PARTITION BY user_id, ok ORDER BY o ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS mean FROM t)
SELECT user_id, DATE '1970-01-01' + CAST(((o + 3) // 5) * 7 + (o + 3) % 5 - 3 AS INTEGER) AS date, round(x, 4) + 0.0 AS x, round(mean, 4) + 0.0 AS mean,
  round(CASE WHEN mean IS NOT NULL THEN sum(mean) OVER (PARTITION BY user_id, mean IS NOT NULL ORDER BY o) END, 4) + 0.0 AS total FROM m"""

# The store: written, appended to, and loaded on another calendar.


def stored(spark: SparkSession, sf_dir: str) -> Store:
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="calstack-query-")
    store = Store(f"{shared}/query-store-{uuid.uuid4().hex}")
    store.write("orders", orders(spark, sf_dir).rows[FIRST:"1998-01-01"])
    store.write("orders", orders(spark, sf_dir).rows["1997-12-01":LAST])
    return store


QUERIES["store_read"] = lambda spark, sf_dir: rounded(stored(spark, sf_dir)["orders", slice(FIRST, LAST)])
SQL["store_read"] = select({"u": "u", "l": "l"})
QUERIES["load"] = lambda spark, sf_dir: rounded((cs.load("orders#u", stored(spark, sf_dir)) + cs.resample_max).rows[FIRST:PERIODS:"M"])
SQL["load"] = resampling_sql("M", "max")
QUERIES["sorted_set"] = lambda spark, sf_dir: SortedSet(table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("element")).agg(F.count("*").cast("double").alias("score"))).increment("1-URGENT", 1).add(new=1).ranked().select("element", "score", F.col("rank").cast("long").alias("rank"))
SQL["sorted_set"] = "SELECT element, score, row_number() OVER (ORDER BY score, element) - 1 AS rank FROM (SELECT o_orderpriority AS element, CAST(count(*) AS DOUBLE) + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS score FROM orders GROUP BY o_orderpriority UNION ALL SELECT 'new', 1)"
QUERIES["row_range"] = lambda spark, sf_dir: rounded(orders(spark, sf_dir).rows[-30:-10])
SQL["row_range"] = f"WITH {base(START, STOP + 300)}, b AS (SELECT max(o) AS m FROM f) SELECT date, {r('u')} AS u, {r('l')} AS l FROM t, b WHERE o BETWEEN m + 1 - 30 AND m - 10"


# What Python sees of a program: sizes, single rows, texts.


def told(spark: SparkSession, facts: dict[str, float | int | bool | None]) -> DataFrame:
    return spark.createDataFrame([(k, None if v is None else round(float(v), 6)) for k, v in facts.items()], "name string, value double")


def told_sql(facts: dict[str, str], source: str = "") -> str:
    return source + " UNION ALL ".join(f"SELECT '{k}' AS name, round(CAST({v} AS DOUBLE), 6) + 0.0 AS value" for k, v in facts.items())


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = orders(spark, sf_dir)
    last = program.last
    values = program.values[FIRST:LAST]
    return told(spark, {
        "columns": len(program.columns),
        "stack": len(program.stack),
        "all": program.all.count(),
        "last": None if last["l"] != last["l"] else last["l"],
        "values": values.agg(F.sum("u")).first()[0],
        "width": len(values.columns),
    })


QUERIES["views"] = views
SQL["views"] = told_sql({"columns": "2", "stack": "2", "all": "(SELECT max(o) - min(o) + 1 FROM f)", "last": "(SELECT l FROM f ORDER BY o DESC LIMIT 1)", "values": "(SELECT sum(u) FROM f)", "width": "2"}, f"WITH {base()} ")
query("row_of_a_date", lambda s, d: orders(s, d), select({"u": "u", "l": "l"}, within=(B.ordinal("1997-03-05"), B.ordinal("1997-03-06"))))
QUERIES["row_of_a_date"] = lambda spark, sf_dir: rounded(orders(spark, sf_dir).rows["1997-03-05"])
query("from_pandas", lambda s, d: cs.from_pandas(orders(s, d).pandas[FIRST:LAST]), select({"u": "u", "l": "l"}))
query("quotation", lambda s, d: orders(s, d) + cs.q(cs.dup + cs.mul) + cs.map, select({"u": "u * u", "l": "l * l"}))
query("literal_r5", lambda s, d: orders(s, d, "u") + cs.r5 + cs.add.cols[-2:], select({"u": "u", "c0": "0", "c1": "1", "c2": "2", "c3": "7"}))
query("apply", lambda s, d: orders(s, d) + cs.apply(lambda x: F.sqrt(x) * 2 + 1).cols[:], select({"u": "2 * sqrt(u) + 1", "l": "2 * sqrt(l) + 1"}))


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = cs.randn(seed=11).rows[0:20_000].agg(F.avg("randn").alias("m"), F.stddev("randn").alias("s")).first()
    same = (cs.randn(seed=3) + cs.dup + cs.sub).rows[0:1000].where("randn <> 0").count()
    return told(spark, {"mean near 0": abs(x.m) < 0.05, "deviation near 1": abs(x.s - 1) < 0.05, "copies that differ": same})


QUERIES["randn"] = draws
SQL["randn"] = told_sql({"mean near 0": "1", "deviation near 1": "1", "copies that differ": "0"})


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = cs.c(2) + cs.dup + cs.mul + cs.ravg(3)
    found = {r[1]: r[0] for r in cs.vocabulary_rows()}
    rows = [("str", str(program)), ("repr", repr(program)), *((f"line {i}", line) for i, line in enumerate(program.describe().split("\n")))]
    rows += [(w, found[w]) for w in ("ravg", "cadd", "rcadd", "navg", "resample_sum", "dup", "ffill", "q")]
    rows += [("heading", line) for line in cs.vocabulary_text().split("\n") if line == "### rolling"]
    return spark.createDataFrame(rows, "name string, value string")


QUERIES["texts"] = texts
SQL["texts"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', '{v}')"
    for k, v in [
        ("str", "c(2) + dup.copy + mul + ravg(3)"),
        ("repr", "Program[c(2) + dup.copy + mul + ravg(3)]"),
        ("line 0", "c2: rolling{''name'': ''avg'', ''window'': 3} (group of 1)"),
        ("line 1", "  reduction{''name'': ''mul'', ''ignore'': False} (group of 1)"),
        ("line 2", "    constant{''value'': 2} (group of 1)"),
        ("line 3", "    constant{''value'': 2} (group of 1)"),
        ("ravg", "rolling"), ("cadd", "cumulative"), ("rcadd", "reverse cumulative"), ("navg", "reductions ignoring missing values"), ("resample_sum", "resampling"), ("dup", "stack"), ("ffill", "clean-up"), ("q", "quotation"), ("heading", "### rolling"),
    ]
) + ") AS v(name, value)"

# The store's catalog, its checks, deletion, the diagonal, and the default store.


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = stored(spark, sf_dir)
    store.write("whole", orders(spark, sf_dir).rows[FIRST:LAST])
    rows = [(m.key, m.col, m.type, m.calendar, m.start, m.stop, m.created is not None and m.updated >= m.created) for m in store.all_series if m.frame in store.keys]
    return spark.createDataFrame(rows, "key string, col string, type string, calendar string, start long, stop long, stamped boolean")


QUERIES["store_catalog"] = catalog
#: A new series begins and ends with a value; an update reaches as far as it was written.
SQL["store_catalog"] = f"WITH {base()} " + " UNION ALL ".join(f"SELECT '{k}#{c}' AS key, '{c}' AS col, 'F' AS type, 'B' AS calendar, min(o) AS start, {stop} AS stop, true AS stamped FROM f WHERE {c} IS NOT NULL" for k, stop in (("orders", STOP), ("whole", "max(o) + 1")) for c in "ul")


def refused(action: Callable[[], object], kind: type[Exception]) -> bool:
    try:
        action()
    except kind:
        return True
    return False


def store_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    store = stored(spark, sf_dir)
    days = orders(spark, sf_dir).pandas[FIRST:"1995-03-01"]
    later = days.set_axis(pd.bdate_range("2030-01-01", periods=len(days)))
    return told(spark, {
        "two columns of a name": refused(lambda: store.write("orders", pd.concat([days, days], axis=1)), ValueError),
        "gap": refused(lambda: store.write("orders", later), ValueError),
        "type": refused(lambda: store.write("orders", days.fillna(0).astype("int64")), ValueError),
        "calendar": refused(lambda: store.write("orders", days.iloc[:12].set_axis(pd.date_range("1995-01-31", periods=12, freq="ME")), "M"), ValueError),
        "no such key": refused(lambda: store["none"], KeyError),
        "no such column": refused(lambda: cs.load("orders#none", store).rows[FIRST:LAST], KeyError),
        "still there": store["orders"].where("u IS NOT NULL").count(),
    })


QUERIES["store_checks"] = store_checks
SQL["store_checks"] = told_sql({"two columns of a name": "1", "gap": "1", "type": "1", "calendar": "1", "no such key": "1", "no such column": "1", "still there": "(SELECT count(u) FROM f)"}, f"WITH {base()} ")


def store_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = stored(spark, sf_dir)
    store.write("other", orders(spark, sf_dir, "u").rows[FIRST:"1996-01-01"])
    facts = {"keys": len(store.keys), "with prefix": len(store.keys_for_prefix("or"))}
    del store["orders#l"]
    facts |= {"columns": len(store.columns("orders")), "values": store["orders"].where("u IS NOT NULL").count(), "gone": refused(lambda: store["orders#l"], KeyError)}
    store.delete_all()
    return told(spark, facts | {"left": len(store.keys)})


QUERIES["store_delete"] = store_delete
SQL["store_delete"] = told_sql({"keys": "2", "with prefix": "1", "columns": "1", "values": "(SELECT count(u) FROM f)", "gone": "1", "left": "0"}, f"WITH {base()} ")


def diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = stored(spark, sf_dir)
    rows = orders(spark, sf_dir).rows[FIRST:LAST]
    both = rows.select("date", F.lit("u").alias("label"), "u", (F.col("l") * 2).alias("l")).union(rows.select("date", F.lit("l"), F.col("u") * 3, "l"))
    store.write("square", both, labels="label")
    return rounded(store.diags("square"))


QUERIES["store_diags"] = diagonal
SQL["store_diags"] = select({"u": "u", "l": "l"}) + " AND (u IS NOT NULL OR l IS NOT NULL)"


def default(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calstack.sources import store as stores

    before = stores._default
    try:
        stores.use_store(stored(spark, sf_dir).path)
        cs.db["again"] = cs.load("orders#u").rows[FIRST:LAST]
        return rounded(cs.load("again").rows[FIRST:LAST])
    finally:
        stores._default = before


QUERIES["default_store"] = default
SQL["default_store"] = select({"u": "u"})


def set_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements are customers' numbers, scores their numbers of orders."""
    scores = SortedSet(table(spark, sf_dir, "orders").groupBy(F.format_string("c%07d", "o_custkey").alias("element")).agg(F.count("*").cast("double").alias("score")))
    names = SortedSet(scores.frame.withColumn("score", F.lit(0.0)))
    parts = {"rank": scores.range_by_rank(5, 24), "first": scores.range_by_rank(-10, -1, True), "last": scores.range_by_rank(0, 9, True), "score": scores.range_by_score(3, 4), "some": scores.range_by_score(2, 9, 3, 7), "lex": names.range_by_lex("[c0000010", "(c0000050"), "from": names.range_by_lex("(c0000020", "+", 2, 5)}
    found = [f.select(F.lit(k).alias("part"), "element", "score") for k, f in parts.items()]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


QUERIES["sorted_set_ranges"] = set_ranges
SQL["sorted_set_ranges"] = """WITH s AS (SELECT format('c{:07d}', o_custkey) AS element, CAST(count(*) AS DOUBLE) AS score FROM orders GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY score, element) - 1 AS k, count(*) OVER () AS n FROM s)
SELECT 'rank' AS part, element, score FROM r WHERE k BETWEEN 5 AND 24 UNION ALL SELECT 'last', element, score FROM r WHERE k >= n - 10 UNION ALL SELECT 'first', element, score FROM r WHERE k < 10 UNION ALL SELECT 'score', element, score FROM s WHERE score BETWEEN 3 AND 4
UNION ALL (SELECT 'some', element, score FROM s WHERE score BETWEEN 2 AND 9 ORDER BY score, element LIMIT 7 OFFSET 3) UNION ALL SELECT 'lex', element, 0.0 FROM s WHERE element >= 'c0000010' AND element < 'c0000050'
UNION ALL (SELECT 'from', element, 0.0 FROM s WHERE element > 'c0000020' ORDER BY element LIMIT 5 OFFSET 2)"""
QUERIES["sorted_set_ranks"] = lambda spark, sf_dir: SortedSet(table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("element")).agg(F.count("*").cast("double").alias("score"))).ranked().select("element", "score", F.col("rank").cast("long").alias("rank"))
SQL["sorted_set_ranks"] = "SELECT element, score, row_number() OVER (ORDER BY score, element) - 1 AS rank FROM (SELECT CAST(o_custkey AS VARCHAR) AS element, CAST(count(*) AS DOUBLE) AS score FROM orders GROUP BY 1)"


def dated(made: Query) -> Query:
    """Dates as text, which all clients compare alike."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = made(spark, sf_dir)
        return frame.select(*(F.col(f"`{c}`").cast("string").alias(c) if kind == "date" else F.col(f"`{c}`") for c, kind in frame.dtypes))

    return run


QUERIES = {name: dated(made) for name, made in QUERIES.items()}
UNDATED = {"sorted_set", "sorted_set_ranges", "sorted_set_ranks", "views", "randn", "texts", "store_catalog", "store_checks", "store_delete"}
SQL = {name: text if name in UNDATED else f"SELECT * REPLACE (CAST(CAST(date AS DATE) AS VARCHAR) AS date) FROM ({text})" for name, text in SQL.items()}
