"""Check-digit predicates as column expressions; nulls give null, wrong lengths false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the published check-digit schemes.
TFN_9 = [1, 4, 3, 7, 5, 8, 6, 9, 10]
TFN_8 = [10, 7, 8, 4, 6, 3, 5, 1]
ABN = [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19]
ACN = [8, 7, 6, 5, 4, 3, 2, 1]
MEDICARE = [1, 3, 7, 9, 1, 3, 7, 9]
PROVIDER = [3, 5, 8, 4, 2, 1]
PROVIDER_PLACES = "0123456789ABCDEFGHJKLMNPQRTUVWXY"
PROVIDER_CHECKS = "YXWTLKJHFBA"


def digits_only(col: Column | str) -> Column:
    return F.regexp_replace(F.col(col) if isinstance(col, str) else col, "[^0-9]", "")


def _weighted(d: Column, weights: list[int], less: int = 0) -> Column:
    total = F.lit(-less * weights[0])
    for i, w in enumerate(weights):
        total = total + F.substring(d, i + 1, 1).try_cast("int") * w
    return total


def tfn_valid(col: Column | str) -> Column:
    d = digits_only(col)
    nine = (F.length(d) == 9) & (_weighted(d, TFN_9) % 11 == 0)
    eight = (F.length(d) == 8) & (_weighted(d, TFN_8) % 11 == 0)
    return F.coalesce(nine, F.lit(False)) | F.coalesce(eight, F.lit(False))


def abn_valid(col: Column | str) -> Column:
    d = digits_only(col)
    return F.coalesce((F.length(d) == 11) & (F.substring(d, 1, 1) != "0") & (_weighted(d, ABN, 1) % 89 == 0), F.lit(False))


def acn_valid(col: Column | str) -> Column:
    d = digits_only(col)
    check = (10 - _weighted(d, ACN) % 10) % 10
    return F.coalesce((F.length(d) == 9) & (check == F.substring(d, 9, 1).try_cast("int")), F.lit(False))


def medicare_valid(col: Column | str) -> Column:
    d = digits_only(col)
    ok = F.length(d).isin(10, 11) & F.substring(d, 1, 1).between("2", "6")
    return F.coalesce(ok & (_weighted(d, MEDICARE) % 10 == F.substring(d, 9, 1).try_cast("int")), F.lit(False))


def provider_valid(col: Column | str) -> Column:
    c = F.upper(F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"\s", ""))
    place = F.instr(F.lit(PROVIDER_PLACES), F.substring(c, 7, 1)) - 1
    total = _weighted(c, PROVIDER) + place * 6
    want = F.substring(F.lit(PROVIDER_CHECKS), (total % 11 + 1).cast("int"), F.lit(1))
    return F.coalesce(c.rlike(r"^\d{6}[0-9A-HJ-NP-RT-Y][A-HJKLTWXY]$") & (want == F.substring(c, 8, 1)), F.lit(False))


def luhn_valid(col: Column | str) -> Column:
    d = digits_only(col)
    return F.when(d == "", F.lit(False)).otherwise(F.call_function("luhn_check", d))


def ihi_valid(col: Column | str) -> Column:
    d = digits_only(col)
    return (F.length(d) == 16) & d.startswith("800360") & F.call_function("luhn_check", d)


VALIDATORS = {"tfn": tfn_valid, "abn": abn_valid, "acn": acn_valid, "medicare": medicare_valid, "provider_number": provider_valid, "ihi": ihi_valid}


def valid_kinds(col: Column | str) -> Column:
    """Names of all schemes a value satisfies, in alphabetical order."""
    return F.array_compact(F.array(*[F.when(f(col), F.lit(k)) for k, f in sorted(VALIDATORS.items())]))
