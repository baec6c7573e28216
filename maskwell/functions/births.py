"""Dates of birth in the form they were written, and the same form with another day."""

from __future__ import annotations

import calendar
import datetime as dt
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Two-digit years of birth above this one belong to the last century.
PIVOT = 30
_NUMERIC = re.compile(r"\s*(\d{1,2})([./-])(\d{1,2})\2(\d{4}|\d{2})\s*")
_ISO = re.compile(r"\s*(\d{4})-(\d{2})-(\d{2})\s*")
_DAY_FIRST = re.compile(r"\s*(\d{1,2})(st|nd|rd|th)?( of)? ([A-Za-z]{3,9})(\.?,?) (\d{4})\s*")
_MONTH_FIRST = re.compile(r"\s*([A-Za-z]{3,9})(\.?) (\d{1,2})(st|nd|rd|th)?(,?) (\d{4})\s*")


@dataclass(frozen=True)
class Written:
    """A day and a pattern of the pieces it was written with."""

    day: dt.date
    pattern: str


def _month(word: str) -> int:
    for i in range(1, 13):
        name = calendar.month_name[i].lower()
        if word.lower() == name or (len(word) in (3, 4) and name.startswith(word.lower())):
            return i
    return 0


def _style(word: str) -> str:
    kind = "full" if word.lower() in [m.lower() for m in calendar.month_name[1:]] else "short"
    return f"{{{kind}{'|upper' if word.isupper() else '|lower' if word.islower() else ''}}}"


def _width(digits: str) -> str:
    return "2" if len(digits) == 2 else ""


def parsed(text: str | None) -> Written | None:
    """The day and form of a written date of birth, or None."""
    try:
        if m := _ISO.fullmatch(text or ""):
            return Written(dt.date(*map(int, m.groups())), "{y4}-{m2}-{d2}")
        if m := _NUMERIC.fullmatch(text or ""):
            d, s, mo, y = m.groups()
            year = int(y) if len(y) == 4 else int(y) + (1900 if int(y) > PIVOT else 2000)
            wide = lambda x: "2" if x[0] == "0" or len(d) == len(mo) == 2 else ""
            return Written(dt.date(year, int(mo), int(d)), f"{{d{wide(d)}}}{s}{{m{wide(mo)}}}{s}{{y{len(y)}}}")
        if m := _DAY_FIRST.fullmatch(text or ""):
            d, o, of, mon, tail, y = m.groups()
            return Written(dt.date(int(y), _month(mon), int(d)), f"{{d{_width(d) if d[0] == '0' else ''}}}{'{ord}' if o else ''}{of or ''} {_style(mon)}{tail} {{y4}}")
        if m := _MONTH_FIRST.fullmatch(text or ""):
            mon, dot, d, o, comma, y = m.groups()
            return Written(dt.date(int(y), _month(mon), int(d)), f"{_style(mon)}{dot} {{d{_width(d) if d[0] == '0' else ''}}}{'{ord}' if o else ''}{comma} {{y4}}")
    except ValueError:
        return None
    return None


def ordinal(n: int) -> str:
    return "th" if 10 <= n % 100 <= 20 else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")


def rendered(form: str, day: dt.date) -> str:
    """``day`` with the pieces of ``form``."""

    def piece(m: re.Match) -> str:
        name, _, case = m.group(1).partition("|")
        full = calendar.month_name[day.month]
        out = {
            "d": str(day.day), "d2": f"{day.day:02d}", "m": str(day.month), "m2": f"{day.month:02d}", "y4": f"{day.year:04d}", "y2": f"{day.year % 100:02d}", "ord": ordinal(day.day), "full": full, "short": full[:3],
        }[name]
        return out.upper() if case == "upper" else out.lower() if case == "lower" else out

    return re.sub(r"\{([^}]+)\}", piece, form)


FORMS = ["{d2}/{m2}/{y4}", "{d}/{m}/{y4}", "{d2}-{m2}-{y4}", "{d2}.{m2}.{y4}", "{y4}-{m2}-{d2}", "{d} {full} {y4}", "{d} {short} {y4}", "{d}{ord} {full} {y4}", "{full} {d}, {y4}", "{full} {d}{ord}, {y4}", "{d2}/{m2}/{y2}"]


def form_pairs(real: dt.date, surrogate: dt.date) -> list[tuple[str, str]]:
    """(surrogate form, real form) of a pair of days in every common form."""
    return [(rendered(f, surrogate), rendered(f, real)) for f in FORMS]


@F.pandas_udf(T.StringType())
def rewritten(text: pd.Series, day: pd.Series) -> pd.Series:
    """Another day in the form a date of birth was written in; null where it is no date or there is no day."""
    out = []
    for t, d in zip(text, day):
        w = parsed(t) if d is not None and not pd.isna(d) else None
        out.append(rendered(w.pattern, pd.Timestamp(d).date()) if w else None)
    return pd.Series(out, dtype=object)
