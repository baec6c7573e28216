"""Output texts with their edit log, the proof of the log, and restoration of surrogates.

Edits of a unit must not overlap (see ``spans.keep_best``). Nulls in a
replacement count as the empty string.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.functions.keyed import hmac_hex
from maskwell.operators.spans import edited_texts


def output_offsets(edits: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """``edits`` with out_start and out_end: where each replacement stands in the output."""
    w = Window.partitionBy(*key).orderBy(*(order or ["start_off", "end_off", "replacement"])).rowsBetween(Window.unboundedPreceding, -1)
    gain = F.length(F.coalesce("replacement", F.lit(""))) - (F.col("end_off") - F.col("start_off"))
    at = (F.col("start_off") + F.coalesce(F.sum(gain).over(w), F.lit(0))).cast("int")
    return edits.withColumn("out_start", at).withColumn("out_end", F.col("out_start") + F.length(F.coalesce("replacement", F.lit(""))))


def edit_log(units: DataFrame, edits: DataFrame, key: list[str], secret: bytes, text: str = "text") -> DataFrame:
    """(key..., out_start, out_end, start_off, end_off, replacement, proof): the log, with the keyed hash of what was replaced instead of the value."""
    was = F.substring(F.col("_t"), F.col("start_off") + 1, F.col("end_off") - F.col("start_off"))
    both = output_offsets(edits, key).join(units.select(*key, F.col(text).alias("_t")), key)
    return both.select(*key, "out_start", "out_end", "start_off", "end_off", "replacement", hmac_hex(secret, was).alias("proof"))


def log_complete(units: DataFrame, outputs: DataFrame, log: DataFrame, key: list[str], secret: bytes, text: str = "text") -> DataFrame:
    """(key..., complete): whether the log alone explains the output.

    The replacements must stand where the log says, the source without the
    logged spans must equal the output without the replacements, and the source
    must hold what the log's hashes say.
    """
    per = log.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start_off", "end_off", "out_start", "out_end", "replacement", "proof"))).alias("e"))
    both = units.select(*key, F.col(text).alias("_t")).join(outputs.select(*key, "output"), key).join(per, key, "left")
    e = F.coalesce("e", F.array().cast(per.schema["e"].dataType))

    def rest(col: str, a: str, b: str) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
        fold = F.aggregate(e, start, lambda acc, x: F.struct(F.concat(acc["out"], F.substring(F.col(col), acc["at"] + 1, x[a] - acc["at"]), F.lit("\x1f")).alias("out"), x[b].alias("at")))
        return F.concat(fold["out"], F.substring(F.col(col), fold["at"] + 1, F.length(F.col(col))))

    placed = F.forall(e, lambda x: F.substring(F.col("output"), x["out_start"] + 1, x["out_end"] - x["out_start"]) == F.coalesce(x["replacement"], F.lit("")))
    known = F.forall(e, lambda x: hmac_hex(secret, F.substring(F.col("_t"), x["start_off"] + 1, x["end_off"] - x["start_off"])) == x["proof"])
    return both.select(*key, (placed & known & (rest("_t", "start_off", "end_off") == rest("output", "out_start", "out_end"))).alias("complete"))


@lru_cache(maxsize=64)
def _alternation(forms: tuple[str, ...]) -> re.Pattern | None:
    # Longest first, so that a full name goes before its parts.
    return re.compile(r"(?<!\w)(?:" + "|".join(re.escape(f) for f in sorted(forms, key=lambda f: (-len(f), f))) + r")(?!\w)", re.I) if forms else None


def worded_case(model: str, real: str) -> str:
    """``real`` in the case of ``model``, word by word; surplus words follow the last."""
    ms = model.split(" ")
    out = []
    for i, w in enumerate(real.split(" ")):
        m = ms[min(i, len(ms) - 1)]
        out.append(w.upper() if len(m) > 1 and m.isupper() else w.lower() if m.islower() else w)
    return " ".join(out)


def restore(text: str, forms: dict[str, list[str]]) -> tuple[str, int, int]:
    """(restored text, restored places, ambiguous places); ``forms`` by lower-case form the real values it may stand for."""
    rx = _alternation(tuple(sorted(forms)))
    done = [0, 0]

    def one(m: re.Match) -> str:
        real = forms[m.group().lower()]
        if len({r.casefold() for r in real}) != 1:
            done[1] += 1
            return m.group()
        done[0] += 1
        return worded_case(m.group(), real[0])

    return (rx.sub(one, text) if rx else text), done[0], done[1]


_RESTORED = T.StructType([T.StructField("restored", T.StringType()), T.StructField("places", T.IntegerType()), T.StructField("ambiguous", T.IntegerType())])


@F.pandas_udf(_RESTORED)
def _restored(text: pd.Series, forms: pd.Series, reals: pd.Series) -> pd.DataFrame:
    out = []
    for t, fs, rs in zip(text, forms, reals):
        if t is None or fs is None:
            out.append((t, 0, 0))
            continue
        known: dict[str, list[str]] = {}
        for f, r in zip(fs, rs):
            known.setdefault(f.lower(), []).append(r)
        out.append(restore(t, known))
    return pd.DataFrame(out, columns=["restored", "places", "ambiguous"])


def restored_texts(texts: DataFrame, vault: DataFrame, ident: str, text: str = "text", scope: str = "matter_id") -> DataFrame:
    """(ident, restored, places, ambiguous): surrogates of ``vault`` (scope, value, surrogate) turned back in free texts.

    A form of two values stays as it is and is counted. A text meets the forms
    of its scope whose first word it holds, so no text waits for a whole vault.
    Typed placeholders stand for no single value and are never turned back.
    """
    word = r"[\p{L}\p{N}]+"
    t = texts.select(ident, scope, F.col(text).alias("_t")).distinct()
    first = t.filter("_t IS NOT NULL").select(ident, scope, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("_t"), F.lit(word), F.lit(0)))).alias("_w"))
    forms = vault.select(scope, F.col("surrogate").alias("f"), F.col("value").alias("v")).dropna().distinct().withColumn("_w", F.regexp_extract(F.lower("f"), word, 0)).filter("_w <> ''")
    met = first.join(forms, [scope, "_w"]).groupBy(ident).agg(F.array_sort(F.collect_set(F.struct("f", "v"))).alias("m"))
    both = t.join(met, ident, "left")
    return both.select(ident, _restored("_t", F.col("m.f"), F.col("m.v")).alias("r")).select(ident, "r.*")


def unmatched_words(texts: DataFrame, vault: DataFrame, pool: DataFrame, ident: str, text: str = "text", scope: str = "matter_id") -> DataFrame:
    """(ident, unmatched): words of a text that are names of the pool (name) but no surrogate of its scope."""
    word = r"[\p{L}][\p{L}'’-]*"
    t = texts.select(ident, scope, F.explode(F.regexp_extract_all(text, F.lit(word), F.lit(0))).alias("_w"))
    names = pool.select(F.lower("name").alias("_k")).dropna().distinct()
    issued = vault.select(scope, F.explode(F.split(F.lower("surrogate"), r"[\s-]+")).alias("_k")).distinct()
    like = t.filter(F.substring("_w", 1, 1) == F.upper(F.substring("_w", 1, 1))).withColumn("_k", F.lower("_w")).join(names, "_k", "left_semi")
    return like.join(issued, [scope, "_k"], "left_anti").groupBy(ident).agg(F.count("*").alias("unmatched"))


def restoration_class(source: Column, expected: Column, got: Column) -> Column:
    """exact, partial (some words right, none wrong), wrong, or unchanged."""
    a, e, g = (F.split(c, r"\s+") for c in (source, expected, got))
    right = F.size(F.filter(F.zip_with(e, g, lambda x, y: x.eqNullSafe(y)), lambda b: b))
    stray = F.exists(F.zip_with(F.zip_with(e, g, lambda x, y: F.struct(x.alias("e"), y.alias("g"))), a, lambda p, s: ~p["g"].eqNullSafe(p["e"]) & ~p["g"].eqNullSafe(s)), lambda b: b)
    return F.when(got == expected, "exact").when(got == source, "unchanged").when(stray | (right == 0), "wrong").otherwise("partial")


def round_trip(units: DataFrame, edits: DataFrame, vault: DataFrame, key: str, scope: str = "matter_id", text: str = "text") -> DataFrame:
    """(key, exact): whether replacing and restoring gives the text back."""
    out = edited_texts(units.select(key, text), edits, [key], text)
    back = restored_texts(out.join(units.select(key, scope), key), vault, key, "output", scope)
    return units.select(key, F.col(text).alias("_t")).join(back, key).select(key, F.col("restored").eqNullSafe(F.col("_t")).alias("exact"))


def stale_exports(exports: DataFrame, epochs: DataFrame, scope: str = "matter_id") -> DataFrame:
    """Exports (scope, document_id, epoch) older than the epoch (scope, current) of their vault."""
    return exports.join(epochs, scope).filter(F.col("epoch") < F.col("current")).select(*exports.columns)
