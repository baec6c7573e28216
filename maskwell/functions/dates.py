"""Dates as people write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-digit years up to this one belong to this century.
PIVOT = 40


def parsed(col: Column | str) -> Column:
    """The day a written date names, or null: d/m/y, d.m.y, d-m-y, y-m-d, yyyymmdd, 3rd of March 2024, March 3, 2024."""
    t = F.trim(F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"\s+", " "))
    num = r"^(\d{1,2})([./-])(\d{1,2})\2(\d{4}|\d{2})$"
    yy = F.regexp_extract(t, num, 4)
    year = F.when(F.length(yy) == 4, yy.try_cast("int")).otherwise(yy.try_cast("int") + F.when(yy.try_cast("int") <= PIVOT, 2000).otherwise(1900))
    numeric = F.try_to_date(F.concat_ws("-", year.cast("string"), F.lpad(F.regexp_extract(t, num, 3), 2, "0"), F.lpad(F.regexp_extract(t, num, 1), 2, "0")), "yyyy-MM-dd")
    words = F.regexp_replace(F.initcap(F.lower(t)), r"(?i)(?<=\d)(st|nd|rd|th)\b|\bof\b|[,.]", " ")
    words = F.trim(F.regexp_replace(words, r"\s+", " "))
    first = r"^(\d{1,2}) ([A-Z][a-z]{2})[a-z]* (\d{4})$"
    second = r"^([A-Z][a-z]{2})[a-z]* (\d{1,2}) (\d{4})$"
    a = F.concat_ws(" ", F.regexp_extract(words, first, 1), F.regexp_extract(words, first, 2), F.regexp_extract(words, first, 3))
    b = F.concat_ws(" ", F.regexp_extract(words, second, 2), F.regexp_extract(words, second, 1), F.regexp_extract(words, second, 3))
    return (
        F.when(t.rlike(num), numeric)
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))
        .when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd"))
        .when(words.rlike(first), F.try_to_date(a, "d MMM yyyy"))
        .when(words.rlike(second), F.try_to_date(b, "d MMM yyyy"))
    )


def forms(day: Column) -> Column:
    """The ways a day is commonly written, for needles of a leak scan."""
    return F.array_distinct(F.array(*[F.date_format(day, f) for f in ("dd/MM/yyyy", "d/M/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyy-MM-dd", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy")]))
