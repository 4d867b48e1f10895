import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import calstack as cs
from calstack.functions.calendar import CALENDARS, Range, from_offset_code, parse_date

DATES = st.dates(datetime.date(1950, 1, 1), datetime.date(2080, 12, 31))
CODES = st.sampled_from(sorted(CALENDARS))


@given(DATES, CODES)
def test_a_slot_ends_on_a_weekday_that_is_in_it(date, code):
    p = CALENDARS[code]
    o = p.ordinal(date)
    assert p.end(o).weekday() < 5
    assert p.ordinal(p.end(o)) == o
    assert p.end(o - 1) < p.end(o)
    if p.step == 7 or code == "B":
        assert p.end(o - 1) < date <= p.end(o) or (code == "B" and date.weekday() > 4)


@given(DATES, CODES)
def test_days_of_neighbouring_slots_meet(date, code):
    a = CALENDARS[code][date]
    b = a + 1
    assert a[-1] + datetime.timedelta(days=1) == b[0]
    assert len(a) == (a[-1] - a[0]).days + 1


def test_columns_agree_with_python(spark):
    days = spark.range(-8000, 26000, 13).select(F.date_from_unix_date(F.col("id").cast("int")).alias("d"))
    for p in CALENDARS.values():
        rows = days.select("d", p.ordinal_column(F.col("d")).alias("o")).withColumn("e", p.end_column(F.col("o"))).collect()
        assert all(p.ordinal(r.d) == r.o and p.end(r.o) == r.e for r in rows), p


def test_known_slots():
    b, m = CALENDARS["B"], CALENDARS["M"]
    assert len(b["1969-12-15":"1970-01-08"]) == 18
    assert len(b[:"1970-01-08"]) == 5
    assert b[:5].day_counts() == [1, 1, 3, 1, 1]
    assert m[0][-1] == datetime.date(1970, 1, 30)
    assert b.ordinal("2024-01-06") == b.ordinal("2024-01-08")
    assert [CALENDARS[c].end(0).strftime("%a") for c in "NTWHF"] == ["Mon", "Tue", "Wed", "Thu", "Fri"]
    assert str(CALENDARS["Y"]["2024-05-01"]) == "2024-12-31"
    assert CALENDARS["Q"][0].to_range().dates() == [datetime.date(1970, 3, 31)]


def test_ranges():
    r = CALENDARS["B"][10:20]
    assert (len(r), len(r.offset(3)), (r + 1).start, (r - 1).start) == (10, 10, 11, 9)
    assert (r.expand(-2).start, r.expand(-2).stop, r.expand(2).stop) == (8, 20, 22)
    assert (r[2].ordinal, r[-1].ordinal, r[2:4].start, r[2:4].stop) == (12, 19, 12, 14)
    assert [p.ordinal for p in r[:2]] == [10, 11]
    assert r == Range(10, 20, CALENDARS["B"])
    assert hash(r) == hash(Range(10, 20, CALENDARS["B"]))
    january = CALENDARS["M"][0:1].change_periodicity("B")
    assert (january.start, january.stop) == (0, 22)
    assert CALENDARS["B"][0:22].change_periodicity("M") == CALENDARS["M"][0:1]
    days, months = CALENDARS["B"][0:42], CALENDARS["M"][0:3]
    assert days.matches(months) == [(0, 21), (1, 41)]
    assert months.matches(days) == [(21, 0), (41, 1)]
    assert months.matches(days, round_=True) == [(i, i // 22) for i in range(42)]


def test_now_is_what_it_is_set_to():
    cs.set_as_of("2024-03-15")  # a Friday
    try:
        assert CALENDARS["B"].current()[-1] == datetime.date(2024, 3, 15)
        assert CALENDARS["B"][-1] == CALENDARS["B"].current()
        assert cs.now() == datetime.date(2024, 3, 15)
        assert CALENDARS["M"].current()[-1] == datetime.date(2024, 2, 29)
    finally:
        cs.set_as_of(None)
    assert CALENDARS["B"].next().ordinal > 14000


def test_dates_and_codes():
    assert parse_date(datetime.datetime(2020, 1, 2, 3)) == datetime.date(2020, 1, 2)
    assert parse_date("2020-01-02T03:04") == datetime.date(2020, 1, 2)
    assert {from_offset_code(p.offset_code).code for p in CALENDARS.values()} == set(CALENDARS)
    with pytest.raises(StopIteration):
        from_offset_code("13min")
