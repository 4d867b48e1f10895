"""Nine regular calendars: slots numbered from 1970, in Python and as Column expressions.

A slot covers days and is labelled by its last one. Business days (B) roll weekends
forward to Monday; N, T, W, H, F are weeks that end on Monday to Friday; M, Q and Y
end on their last weekday. There are no holidays.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = datetime.date(1970, 1, 1)
DateLike = str | datetime.date

_as_of: datetime.date | None = None


def set_as_of(date: DateLike | None) -> None:
    """Fixes what "now" means for open ranges; None goes back to the clock."""
    global _as_of
    _as_of = None if date is None else parse_date(date)


def parse_date(value: DateLike) -> datetime.date:
    if isinstance(value, datetime.datetime):
        return value.date()
    if isinstance(value, datetime.date):
        return value
    return datetime.date.fromisoformat(value[:10])


def is_date(value: object) -> bool:
    return isinstance(value, str | datetime.date)


def today() -> datetime.date:
    """The New York date, which turns at 17:00."""
    if _as_of is not None:
        return _as_of
    clock = datetime.datetime.now(ZoneInfo("America/New_York"))
    return (clock + datetime.timedelta(hours=7)).date()


def _day(date: datetime.date) -> int:
    return (date - EPOCH).days


def _date(day: int) -> datetime.date:
    return EPOCH + datetime.timedelta(days=day)


def _month_end(month: int) -> int:
    """Day number of the last weekday of a month, months counted from 1970."""
    year, m = divmod(month + 1, 12)
    last = datetime.date(1970 + year, m + 1, 1) - datetime.timedelta(days=1)
    return _day(last) - max(0, last.weekday() - 4)


@dataclass(frozen=True)
class Periodicity:
    """One calendar. `step` is days of a week or months of a longer slot; a week's
    `anchor` is the day number of slot 0's end."""

    code: str
    annualization: int
    offset_code: str
    bloomberg: str
    label: str
    step: int = 0
    anchor: int = 0

    @property
    def name(self) -> str:
        return self.code

    def ordinal(self, date: DateLike) -> int:
        """The slot that a date falls in."""
        d = parse_date(date)
        if self.code == "B":
            week, weekday = divmod(_day(d) + 3, 7)
            return week * 5 + min(weekday, 5) - 3
        if self.step == 7:
            return (_day(d) - self.anchor + 6) // 7
        return ((d.year - 1970) * 12 + d.month - 1) // self.step

    def end(self, ordinal: int) -> datetime.date:
        """The last day of a slot, its label."""
        if self.code == "B":
            week, weekday = divmod(ordinal + 3, 5)
            return _date(week * 7 + weekday - 3)
        if self.step == 7:
            return _date(self.anchor + 7 * ordinal)
        return _date(_month_end((ordinal + 1) * self.step - 1))

    def ordinal_column(self, date: Column) -> Column:
        """`ordinal` of a DATE column."""
        if self.code == "B":
            k = F.unix_date(date) + F.lit(3)
            return (F.floor(k / 7) * 5 + F.least(F.pmod(k, F.lit(7)), F.lit(5)) - 3).cast("long")
        if self.step == 7:
            return F.floor((F.unix_date(date) - F.lit(self.anchor - 6)) / 7).cast("long")
        return F.floor(((F.year(date) - 1970) * 12 + F.month(date) - 1) / self.step).cast("long")

    def end_column(self, ordinal: Column) -> Column:
        """`end` of an ordinal column, as a DATE."""
        if self.code == "B":
            j = ordinal + 3
            return F.date_from_unix_date((F.floor(j / 5) * 7 + F.pmod(j, F.lit(5)) - 3).cast("int"))
        if self.step == 7:
            return F.date_from_unix_date((ordinal * 7 + self.anchor).cast("int"))
        month = (ordinal + 1) * self.step
        last = F.date_sub(F.add_months(F.lit(EPOCH), month.cast("int")), 1)
        return F.date_sub(last, F.greatest(F.lit(0), F.weekday(last) - 4))

    def __getitem__(self, key: DateLike | int | Period | slice) -> Period | Range:
        if isinstance(key, slice):
            if key.step is not None:
                raise TypeError("a range has no step")
            return Range(self._bound(key.start, 0), self._bound(key.stop, self.next().ordinal), self)
        return Period(self._bound(key, 0), self)

    def _bound(self, key: DateLike | int | Period | None, default: int) -> int:
        if key is None:
            return default
        if isinstance(key, Period):
            return key.ordinal if key.periodicity == self else self.ordinal(key[-1])
        if isinstance(key, int):
            return key if key >= 0 else self.next().ordinal + key
        return self.ordinal(key)

    def current(self) -> Period:
        """The last slot that has ended or ends today."""
        return self.next() - 1

    def next(self) -> Period:
        """The first slot that has not ended yet."""
        now = self.ordinal(today())
        return Period(now + 1 if self.end(now) == today() else now, self)

    def __repr__(self) -> str:
        return f"Periodicity[{self.code}]"


#: The calendars' codes, yearly slots, pandas and Bloomberg names.
CALENDARS = {
    p.code: p
    for p in (
        Periodicity("B", 260, "B", "DAILY", "business days"),
        Periodicity("N", 52, "W-MON", "WEEKLY", "weeks ending Monday", 7, -3),
        Periodicity("T", 52, "W-TUE", "WEEKLY", "weeks ending Tuesday", 7, -2),
        Periodicity("W", 52, "W-WED", "WEEKLY", "weeks ending Wednesday", 7, -1),
        Periodicity("H", 52, "W-THU", "WEEKLY", "weeks ending Thursday", 7, 0),
        Periodicity("F", 52, "W-FRI", "WEEKLY", "weeks ending Friday", 7, 1),
        Periodicity("M", 12, "BME", "MONTHLY", "months", 1),
        Periodicity("Q", 4, "BQE-DEC", "QUARTERLY", "quarters", 3),
        Periodicity("Y", 1, "BYE-DEC", "YEARLY", "years", 12),
    )
}


def periodicity(code: str | Periodicity) -> Periodicity:
    return code if isinstance(code, Periodicity) else CALENDARS[code]


def from_offset_code(code: str) -> Periodicity:
    """The calendar of a pandas frequency."""
    older = {"BM": "BME", "BQ": "BQE-DEC", "BQ-DEC": "BQE-DEC", "BQE": "BQE-DEC", "BY": "BYE-DEC", "BA-DEC": "BYE-DEC", "BYE": "BYE-DEC", "ME": "BME", "QE-DEC": "BQE-DEC", "YE-DEC": "BYE-DEC", "D": "B", "W": "W-FRI", "W-SUN": "W-FRI"}
    code = older.get(code, code)
    return next(p for p in CALENDARS.values() if p.offset_code == code)


@dataclass(frozen=True, order=True)
class Period:
    """One slot of a calendar."""

    ordinal: int
    periodicity: Periodicity

    @cached_property
    def _days(self) -> tuple[int, int]:
        return _day(self.periodicity.end(self.ordinal - 1)) + 1, _day(self.periodicity.end(self.ordinal)) + 1

    def __len__(self) -> int:
        return self._days[1] - self._days[0]

    def __getitem__(self, i: int) -> datetime.date:
        return _date(range(*self._days)[i])

    def __add__(self, n: int) -> Period:
        return Period(self.ordinal + n, self.periodicity)

    def __sub__(self, n: int) -> Period:
        return self + -n

    def __str__(self) -> str:
        return self[-1].isoformat()

    def to_range(self) -> Range:
        return Range(self.ordinal, self.ordinal + 1, self.periodicity)


@dataclass(frozen=True)
class Range:
    """Slots from `start` up to, not including, `stop`."""

    start: int
    stop: int
    periodicity: Periodicity

    def __len__(self) -> int:
        return max(0, self.stop - self.start)

    def __iter__(self) -> Iterator[Period]:
        return (Period(i, self.periodicity) for i in range(self.start, self.stop))

    def __getitem__(self, key: int | slice) -> Period | Range:
        found = range(self.start, self.stop)[key]
        if isinstance(found, range):
            if found.step != 1:
                raise TypeError("a range has no step")
            return Range(found.start, max(found.start, found.stop), self.periodicity)
        return Period(found, self.periodicity)

    def offset(self, n: int) -> Range:
        return Range(self.start + n, self.stop + n, self.periodicity)

    __add__ = offset

    def __sub__(self, n: int) -> Range:
        return self.offset(-n)

    def expand(self, n: int = 1) -> Range:
        """Wider by n slots at the end, or at the start if n is negative."""
        return Range(self.start + min(0, n), self.stop + max(0, n), self.periodicity)

    def change_periodicity(self, to: str | Periodicity) -> Range:
        """The slots of another calendar from the first to the last day of this one."""
        to = periodicity(to)
        if to == self.periodicity or not len(self):
            return Range(self.start, self.stop, to) if to == self.periodicity else Range(to.ordinal(self.first_day), to.ordinal(self.first_day), to)
        return Range(to.ordinal(self.first_day), to.ordinal(self.periodicity.end(self.stop - 1)) + 1, to)

    @property
    def first_day(self) -> datetime.date:
        """First weekday of the first slot: weekend days before it belong to it too,
        but not always on another calendar."""
        day = _day(self.periodicity.end(self.start - 1)) + 1
        return _date(day + (2 if _date(day).weekday() == 5 else 1 if _date(day).weekday() == 6 else 0)) if self.periodicity.code != "B" else self.periodicity.end(self.start)

    def matches(self, other: Range, round_: bool = False) -> list[tuple[int, int]]:
        """(position in `other`, position here) of slots that end on the same day, or
        (round_) of each of `other`'s slots and the one here that its end falls in."""
        found = []
        for i, period in enumerate(other):
            end = period[-1]
            at = self.periodicity.ordinal(end)
            if self.start <= at < self.stop and (round_ or self.periodicity.end(at) == end):
                found.append((i, at - self.start))
        return found

    def dates(self) -> list[datetime.date]:
        return [self.periodicity.end(i) for i in range(self.start, self.stop)]

    def day_counts(self) -> list[int]:
        """Days from the slot before to each slot."""
        return [(self.periodicity.end(i) - self.periodicity.end(i - 1)).days for i in range(self.start, self.stop)]

    def to_index(self):
        import pandas as pd

        return pd.DatetimeIndex(self.dates())

    @classmethod
    def from_index(cls, index) -> Range:
        """The range of a pandas index that has a known frequency."""
        import pandas as pd

        code = index.freqstr or (pd.infer_freq(index) if len(index) > 2 else None) or "B"
        p = from_offset_code(code)
        return cls(p.ordinal(index[0].date()), p.ordinal(index[-1].date()) + 1, p)


def now() -> datetime.date:
    """The last day of the current business day slot."""
    return CALENDARS["B"].current()[-1]
