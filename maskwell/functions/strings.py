"""String functions of replacement and evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a scanner confuses, folded for comparisons.
CONFUSED, MEANT = "015|", "olsl"


def collapsed(col: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"\s+", " "))


def comparable(col: Column | str) -> Column:
    """Lower case, single blanks, confusions folded."""
    return F.translate(F.lower(collapsed(col)), CONFUSED, MEANT)


def like_case(surrogate: Column, original: Column) -> Column:
    """``surrogate`` in the case pattern of ``original``: upper, lower or as is."""
    letters = F.regexp_replace(original, r"[^\p{L}]", "")
    return (
        F.when((F.length(letters) > 1) & (letters == F.upper(letters)), F.upper(surrogate))
        .when((letters != "") & (letters == F.lower(letters)), F.lower(surrogate))
        .otherwise(surrogate)
    )


def phone_class(col: Column | str) -> Column:
    """mobile, landline, 1300, 1800, 13 or null, from the national digits."""
    d = F.regexp_replace(F.col(col) if isinstance(col, str) else col, "[^0-9]", "")
    d = F.when((F.length(d) == 11) & d.startswith("61"), F.concat(F.lit("0"), F.substring(d, 3, 9))).otherwise(d)
    return (
        F.when((F.length(d) == 10) & d.startswith("04"), "mobile")
        .when((F.length(d) == 10) & d.rlike("^0[2378]"), "landline")
        .when((F.length(d) == 10) & d.startswith("1300"), "1300")
        .when((F.length(d) == 10) & d.startswith("1800"), "1800")
        .when((F.length(d) == 6) & d.startswith("13"), "13")
    )


def into_layout(layout: Column, digits: Column) -> Column:
    """``layout`` with its digits replaced, in order, by those of ``digits``."""
    chars = F.split(layout, "")
    step = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
        lambda acc, c: F.when(
            c.rlike("^[0-9]$"), F.struct(F.concat(acc["out"], F.substring(digits, acc["k"], F.lit(1))).alias("out"), (acc["k"] + 1).alias("k"))
        ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["k"].alias("k"))),
    )
    return step["out"]


def completed_years(born: Column, on: Column) -> Column:
    """Age on a day; a 29 February birthday is reached on 1 March in common years."""
    before = (F.month(on) < F.month(born)) | ((F.month(on) == F.month(born)) & (F.dayofmonth(on) < F.dayofmonth(born)))
    return F.year(on) - F.year(born) - F.when(before, 1).otherwise(0)
