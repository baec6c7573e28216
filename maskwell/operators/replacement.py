"""Surrogates of names, organisations and addresses, part by part.

Every part (a surname, a given name, a street, a suburb) has one surrogate in
its matter, issued by rank, so that one person keeps one surrogate however the
name is written. Surfaces are read and put together in Arrow batches; the parts
meet their surrogates in joins, so no matter is ever held in one task.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.functions.keyed import hmac_hex
from maskwell.operators.detector import ENDINGS, STATES
from maskwell.operators.outputs import worded_case
from maskwell.operators.surrogates import issue, letter_permutation

_PART = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("role", T.StringType()), T.StructField("value", T.StringType())]))
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
HONORIFICS = {"mr", "mrs", "ms", "miss", "mx", "dr", "prof", "professor", "sir", "dame", "judge", "justice"}


def name_parts(surface: str, surnames: frozenset = frozenset(), given: frozenset = frozenset(), titled: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, role) of the words of a name: surname, given or initial.

    "SURNAME, Given" and "SURNAME Given" put the surname first; a single word is
    what is known of it, a surname after a title and else; otherwise the last
    word is the surname.
    """
    words = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(surface)]
    lead = [w for w in words if w[2].lower() in HONORIFICS]
    words = [w for w in words if w[2].lower() not in HONORIFICS]
    if not words:
        return []
    initial = lambda w: len(w) == 1 or (len(w) <= 3 and w.isupper() and len(words) > 1 and not any(c in "AEIOUY" for c in w))
    comma = surface.find(",")
    if len(words) == 1:
        w = words[0]
        low = w[2].lower()
        role = "initial" if len(w[2]) <= 2 and w[2].isupper() else "given" if low in given and low not in surnames and not (lead or titled) else "surname"
        return [(w[0], w[1], role)]
    if comma > 0 and any(w[0] > comma for w in words) and any(w[0] < comma for w in words):
        family = [w for w in words if w[0] < comma]
    elif words[0][2].isupper() and len(words[0][2]) > 2 and not words[-1][2].isupper():
        family = words[:1]
    else:
        family = words[-1:]
    return [(a, b, "surname" if (a, b, w) in family else "initial" if initial(w) else "given") for a, b, w in words]


@F.pandas_udf(_PART)
def _name_parts(surface: pd.Series) -> pd.Series:
    return surface.map(lambda s: [{"start": a, "end": b, "role": r, "value": s[a:b].lower()} for a, b, r in name_parts(s)], na_action="ignore")


@F.pandas_udf(T.StringType())
def _put(surface: pd.Series, parts: pd.Series) -> pd.Series:
    """Each surface with its parts replaced, from the right, in the case of what they replace."""
    out = []
    for s, ps in zip(surface, parts):
        for p in sorted((dict(p) for p in ps), key=lambda p: -p["start"]):
            s = s[: p["start"]] + worded_case(s[p["start"] : p["end"]], p["new"]) + s[p["end"] :]
        out.append(s)
    return pd.Series(out, dtype=object)


def _assembled(opened: DataFrame, scope: str, surface: str) -> DataFrame:
    """(scope, surface, surrogate) of parts (start, end, new)."""
    per = opened.groupBy(scope, surface).agg(F.array_sort(F.collect_set(F.struct("start", "end", "new"))).alias("_p"))
    return per.select(scope, surface, _put(F.col(surface), F.col("_p")).alias("surrogate"))


def name_surrogates(names: DataFrame, pool: DataFrame, key: bytes, scope: str = "matter_id", surface: str = "text", gender: str | None = None) -> DataFrame:
    """(scope, surface, surrogate): each name with every word replaced, order, capitals and punctuation kept.

    ``pool`` (kind, surrogate) has the kinds surname and given, or given_female
    and given_male where ``gender`` names a column. Initials go through the
    scope's permutation of letters. Nulls give nothing; a surface without a
    letter stays as it is.
    """
    cols = [scope, surface] + ([gender] if gender else [])
    rows = names.select(*cols).dropna(subset=[scope, surface]).distinct()
    opened = rows.withColumn("_x", F.explode(_name_parts(surface))).select(*cols, "_x.*")
    kind = F.when(F.col("role") != "given", F.col("role")).otherwise(F.concat(F.lit("given"), F.when(F.col(gender).isin("female", "male"), F.concat(F.lit("_"), F.col(gender))).otherwise("")) if gender else F.lit("given"))
    opened = opened.withColumn("kind", kind)
    if gender:
        # Names of unknown gender share the pool of both.
        pool = pool.union(pool.filter("kind LIKE 'given_%'").select(F.lit("given"), "surrogate")).distinct()
    issued = issue(opened.filter("role <> 'initial'").select(scope, "kind", "value"), pool, key, scope)
    whole = opened.join(issued, [scope, "kind", "value"]).withColumnRenamed("surrogate", "new").select(scope, surface, "start", "end", "new")
    turned = letter_permutation(rows, scope, key)
    ini = opened.filter("role = 'initial'").withColumn("letter", F.upper(F.substring("value", 1, 1))).join(turned, [scope, "letter"]).select(scope, surface, "start", "end", F.col("turned").alias("new"))
    done = _assembled(whole.union(ini), scope, surface)
    return rows.select(scope, surface).distinct().join(done, [scope, surface], "left").select(scope, surface, F.coalesce("surrogate", F.col(surface)).alias("surrogate"))


_ENDING = "(" + "|".join(sorted((re.escape(e) for e in ENDINGS), key=len, reverse=True)) + ")$"


def organisation_surrogates(names: DataFrame, pool: DataFrame, key: bytes, scope: str = "matter_id", surface: str = "text") -> DataFrame:
    """(scope, surface, surrogate): another name with the same ending, one each within the scope.

    ``pool``: kind organisation, surrogate. Case and blanks make no other name.
    """
    tidy = F.trim(F.regexp_replace(surface, r"\s+", " "))
    rows = names.select(scope, surface).dropna().distinct().withColumn("_e", F.regexp_extract(tidy, _ENDING, 1)).withColumn("value", F.lower(F.trim(F.regexp_replace(tidy, _ENDING, "")))).withColumn("kind", F.lit("organisation"))
    issued = issue(rows.select(scope, "kind", "value"), pool, key, scope)
    return rows.join(issued, [scope, "kind", "value"]).select(scope, surface, F.trim(F.concat_ws(" ", "surrogate", F.when(F.col("_e") != "", F.col("_e")))).alias("surrogate"))


_KINDS = "Street|St|Road|Rd|Avenue|Ave|Court|Ct|Crescent|Cres|Drive|Dr|Lane|Ln|Parade|Pde|Place|Pl|Terrace|Tce|Close|Cl|Way|Highway|Hwy|Grove|Square"
_ADDRESS = re.compile(
    rf"(?P<head>(?:(?:Unit|Level|Suite|Flat|Apartment|Shop)\s+)?[\dA-Za-z]*\d[\dA-Za-z]*,?\s+(?:\d+[A-Za-z]?/)?)??(?P<number>\d+[A-Za-z]?(?:[/-]\d+[A-Za-z]?)?)\s+(?P<street>[A-Z][\w'’-]*(?:\s[A-Z][\w'’-]*){{0,2}}?)\s+(?P<kind>{_KINDS})\b"
)
_BOX = re.compile(r"(?:G?\.?P\.?O\.?\s+Box|Locked\s+Bag|PMB)\s+(?P<box>\d+)", re.I)
_PLACE = re.compile(rf"(?P<suburb>[A-Z][\w'’-]*(?:\s[A-Z][\w'’-]*){{0,2}}),?\s+(?P<state>{'|'.join(STATES)})(?:\s+(?P<code>\d{{4}}))?\s*$|(?P<suburb2>[A-Z][\w'’-]*(?:\s[A-Z][\w'’-]*){{0,1}})\s+(?P<code2>\d{{4}})\s*$")


def address_parts(text: str) -> list[tuple[int, int, str]]:
    """(start, end, role) of the parts of an address: number, street, box, suburb, code."""
    out = []
    pos = 0
    if m := _ADDRESS.search(text):
        if m.group("head"):
            out.append((*m.span("head"), "number"))
        out += [(*m.span("number"), "number"), (*m.span("street"), "street")]
        pos = m.end()
    elif m := _BOX.search(text):
        out.append((*m.span("box"), "number"))
        pos = m.end()
    if m := _PLACE.search(text, pos):
        x = "" if m.group("suburb") else "2"
        out.append((*m.span("suburb" + x), "suburb"))
        if m.group("code" + x):
            out.append((*m.span("code" + x), "code"))
    return out


@F.pandas_udf(_PART)
def _address_parts(text: pd.Series) -> pd.Series:
    return text.map(lambda s: [{"start": a, "end": b, "role": r, "value": s[a:b].lower()} for a, b, r in address_parts(s)], na_action="ignore")


def state_of(text: Column | str) -> Column:
    """The state of an address by its abbreviation, its name, or the first digit of its postcode; else null."""
    c = F.col(text) if isinstance(text, str) else text
    short = F.regexp_extract(c, rf"\b({'|'.join(STATES)})\b", 1)
    named = F.coalesce(*[F.when(F.lower(c).contains(n.lower()), k) for k, n in STATES.items()])
    # First digits of postcodes.
    first = F.create_map(*[F.lit(x) for kv in {"2": "NSW", "3": "VIC", "4": "QLD", "5": "SA", "6": "WA", "7": "TAS", "0": "NT"}.items() for x in kv])
    return F.coalesce(F.nullif(short, F.lit("")), named, first[F.regexp_extract(c, r"\b(\d)\d{3}\s*$", 1)])


def address_surrogates(addresses: DataFrame, pool: DataFrame, key: bytes, scope: str = "matter_id", surface: str = "text") -> DataFrame:
    """(scope, surface, surrogate): numbers, street, suburb and postcode replaced; street kind, state and layout kept.

    ``pool``: kinds street and suburb. A street or suburb has one surrogate in
    its scope, suburbs of different states different ones. The first digit of a
    postcode stays, as it tells the state. What has no part stays as it is.
    """
    rows = addresses.select(scope, surface).dropna().distinct()
    opened = rows.withColumn("_s", F.coalesce(state_of(surface), F.lit(""))).withColumn("_x", F.explode(_address_parts(surface))).select(scope, surface, "_s", "_x.*")
    named = opened.filter("role IN ('street', 'suburb')").withColumn("kind", F.col("role")).withColumn("value", F.when(F.col("role") == "suburb", F.concat_ws("|", "value", "_s")).otherwise(F.col("value")))
    issued = issue(named.select(scope, "kind", "value"), pool, key, scope)
    words = named.join(issued, [scope, "kind", "value"]).select(scope, surface, "start", "end", F.col("surrogate").alias("new"))
    h = hmac_hex(key, F.col(scope).cast("string"), "role", "value")
    pick = lambda i: F.conv(F.substring(h, i, F.lit(2)), 16, 10).cast("int")
    digit = lambda i, ch: F.when(ch.rlike("^[1-9]$"), (1 + pick(2 * i - 1) % 9).cast("string")).when(ch == "0", (pick(2 * i - 1) % 10).cast("string")).otherwise(ch)
    text = F.substring(F.col(surface), F.col("start") + 1, F.col("end") - F.col("start"))
    new = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.length("_v")), lambda i: digit(i, F.substring(F.col("_v"), i, F.lit(1)))))
    code = F.concat(F.substring("_v", 1, 1), F.substring(new, 2, 3))
    nums = opened.filter("role IN ('number', 'code')").withColumn("_v", text).select(scope, surface, "start", "end", F.when(F.col("role") == "code", code).otherwise(new).alias("new"))
    done = _assembled(words.union(nums), scope, surface)
    return rows.join(done, [scope, surface], "left").select(scope, surface, F.coalesce("surrogate", F.col(surface)).alias("surrogate"))
