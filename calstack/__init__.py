"""Programs of words over stacks of columns of regular time series, run by Spark.

Every word of the vocabulary is an attribute of this module:

    import calstack as cs
    program = cs.load("prices") + ~(cs.dup + cs.ravg(20) + cs.sub) + cs.map
    frame = program.rows["2021-06-01":]
"""

from __future__ import annotations

from typing import Any

from calstack.functions import calendar as calendars
from calstack.functions.calendar import CALENDARS, Period, Periodicity, Range, now, periodicity, set_as_of
from calstack.plans.program import Program
from calstack.plans.vocabulary import VOCABULARY, Definitions, resolve, vocabulary_rows, vocabulary_text

define = Definitions()

__all__ = ["CALENDARS", "VOCABULARY", "Period", "Periodicity", "Program", "Range", "calendars", "define", "now", "periodicity", "set_as_of", "vocabulary_rows", "vocabulary_text"]


def __getattr__(name: str) -> Any:
    if name == "db":
        from calstack.sources.store import default_store

        return default_store()
    found = None if name.startswith("__") else resolve(name)
    if found is None:
        raise AttributeError(name)
    return found


def __dir__() -> list[str]:
    return sorted([*globals(), *VOCABULARY, "db"])
