"""Span-relational operators: scans, overlap joins, merges, greedy choice.

Spans are half-open code-point intervals on a text unit. Keys may hold nulls;
comparisons on them are null-safe. Spans with a null bound take no part.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = ["document_id", "page", "field", "text_source_id"]


def placed(matches: Column, gaps: Column) -> Column:
    """array<struct<start_off, text>> of matches from the pieces around them, in one fold.

    ``matches`` and ``gaps`` (one more) must be columns, not expressions, or the
    pattern would run once a match.
    """
    none = F.array().cast("array<struct<start_off:int,text:string>>")
    start = lambda acc, x: acc["at"] + F.length(x["g"])
    step = lambda acc, x: F.when(x["m"].isNull(), acc).otherwise(
        F.struct((start(acc, x) + F.length(x["m"])).alias("at"), F.array_append(acc["out"], F.struct(start(acc, x).alias("start_off"), x["m"].alias("text"))).alias("out"))
    )
    both = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    return F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]


def regex_spans(df: DataFrame, text: str, pattern: str, *keep: str, trim: str = "") -> DataFrame:
    """(keep..., start_off, end_off, text) of every match of ``pattern``.

    Offsets are rebuilt from the pieces around the matches, so the scan stays in
    the JVM. The pattern must not match the empty string. ``trim`` names
    characters cut off the end of a match.
    """
    t = F.col(text)
    # RE split drops nothing at limit -1; element i is the gap before match i.
    cols = df.select(*keep, F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("_m"), F.split(t, pattern, -1).alias("_g")).filter(F.size("_m") > 0)
    out = cols.select(*keep, F.explode(placed(F.col("_m"), F.col("_g"))).alias("s")).select(*keep, "s.start_off", "s.text")
    if trim:
        out = out.withColumn("text", F.rtrim(F.col("text"), F.lit(trim)))
    return out.select(*keep, "start_off", (F.col("start_off") + F.length("text")).alias("end_off"), "text")


def same_unit(a: DataFrame, b: DataFrame, key: list[str] = UNIT) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in key])


def overlaps(a: DataFrame, b: DataFrame, start: str = "start_off", end: str = "end_off") -> Column:
    return (a[start] < b[end]) & (b[start] < a[end])


def overlap_join(a: DataFrame, b: DataFrame, how: str = "inner", key: list[str] = UNIT) -> DataFrame:
    """Join on the text unit and overlapping intervals; equi-keys carry the shuffle."""
    return a.join(b, same_unit(a, b, key) & overlaps(a, b), how)


def merged(df: DataFrame, key: list[str] = UNIT, start: str = "start_off", end: str = "end_off") -> DataFrame:
    """Islands of overlapping or touching intervals per key."""
    spans = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    w = Window.partitionBy(*key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    run = Window.partitionBy(*key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    new = F.coalesce(F.col(start) > F.max(end).over(w), F.lit(True)).cast("int")
    marked = spans.select(*key, start, end, new.alias("_new"))
    return marked.withColumn("_isle", F.sum("_new").over(run)).groupBy(*key, "_isle").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_isle")


def covered_length(target: DataFrame, ident: str, cover: DataFrame, key: list[str] = UNIT) -> DataFrame:
    """(ident, covered): characters of each target span inside the union of ``cover``."""
    isles = merged(cover, key)
    t = target.select(ident, *key, "start_off", "end_off").filter("start_off IS NOT NULL AND end_off IS NOT NULL")
    hit = overlap_join(t, isles, "left", key)
    part = F.least(t["end_off"], isles["end_off"]) - F.greatest(t["start_off"], isles["start_off"])
    # least and greatest skip nulls, so an unmatched target needs its own case.
    part = F.when(isles["start_off"].isNotNull(), part).otherwise(F.lit(0))
    return hit.groupBy(t[ident]).agg(F.sum(part).alias("covered"))


def without_overlap(a: DataFrame, b: DataFrame, key: list[str] = UNIT) -> DataFrame:
    return overlap_join(a, b, "left_anti", key)


def touching(a: DataFrame, b: DataFrame, key: list[str] = UNIT) -> DataFrame:
    return overlap_join(a, b, "left_semi", key)


def neighbour_overlaps(df: DataFrame, key: list[str] = UNIT) -> DataFrame:
    """Spans that run into the next one of their unit, in order of start."""
    w = Window.partitionBy(*key).orderBy("start_off", "end_off")
    return df.withColumn("_next", F.lead("start_off").over(w)).filter("_next < end_off").drop("_next")


def keep_best(df: DataFrame, order: list[Column], key: list[str] = UNIT) -> DataFrame:
    """Greedy choice per unit: by ``order``, a span is kept if it meets no kept one.

    The spans of one text unit are folded in one array; a unit is a page or a
    field, never a corpus-wide group. Equal spans are kept once.
    """
    cols = [c for c in df.columns if c not in key]
    spans = df.filter("start_off < end_off").dropDuplicates(key + cols)
    packed = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *cols)
    rows = spans.groupBy(*key).agg(F.array_sort(F.collect_list(packed)).alias("s"))
    none = F.slice("s", 1, 0)
    kept = F.aggregate(
        "s", none, lambda acc, x: F.when(F.exists(acc, lambda y: (x["start_off"] < y["end_off"]) & (y["start_off"] < x["end_off"])), acc).otherwise(F.array_append(acc, x))
    )
    return rows.select(*key, F.explode(kept).alias("k")).select(*key, *[F.col(f"k.{c}") for c in cols])


def match_one_to_one(a: DataFrame, b: DataFrame, a_id: str, b_id: str, key: list[str] = UNIT, allowed: Callable[[DataFrame, DataFrame], Column] | None = None) -> DataFrame:
    """Greedy one-to-one pairs by falling overlap, then IoU, then position.

    Returns (a_id, b_id, overlap). Each unit is decided in one array of its
    overlapping pairs, of those that ``allowed`` admits.
    """
    on = same_unit(a, b, key) & overlaps(a, b)
    both = a.join(b, on & allowed(a, b) if allowed else on)
    inter = F.least(a["end_off"], b["end_off"]) - F.greatest(a["start_off"], b["start_off"])
    iou = F.round(inter / (F.greatest(a["end_off"], b["end_off"]) - F.least(a["start_off"], b["start_off"])), 6)
    pair = F.struct(
        (-inter).alias("o"), (-iou).alias("i"), a["start_off"].alias("s"), b["start_off"].alias("t"), a[a_id].cast("string").alias("a"), b[b_id].cast("string").alias("b")
    )
    rows = both.groupBy(*[a[k] for k in key]).agg(F.array_sort(F.collect_set(pair)).alias("p"))
    none = F.slice("p", 1, 0)
    kept = F.aggregate("p", none, lambda acc, x: F.when(F.exists(acc, lambda y: (x["a"] == y["a"]) | (x["b"] == y["b"])), acc).otherwise(F.array_append(acc, x)))
    return rows.select(F.explode(kept).alias("k")).select(F.col("k.a").alias(a_id), F.col("k.b").alias(b_id), (-F.col("k.o")).alias("overlap"))


def edited_texts(units: DataFrame, edits: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key..., output): each text with its edits applied.

    Edits of a unit must not overlap (see ``keep_best``). Units without edits
    stay as they are.
    """
    per = edits.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start_off", "end_off", "replacement"))).alias("e"))
    cond = reduce(lambda x, y: x & y, [units[k].eqNullSafe(per[k]) for k in key])
    both = units.join(per, cond, "left").select(*[units[k] for k in key], units[text].alias("t"), "e")
    fold = F.aggregate(
        "e",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(
            F.concat(acc["out"], F.substring(F.col("t"), acc["at"] + 1, x["start_off"] - acc["at"]), F.coalesce(x["replacement"], F.lit(""))).alias("out"), x["end_off"].alias("at")
        ),
    )
    rest = F.concat(fold["out"], F.substring(F.col("t"), fold["at"] + 1, F.length("t")))
    return both.select(*key, F.when(F.col("e").isNull(), F.col("t")).otherwise(rest).alias("output"))


def votes(spans: DataFrame, detector: str = "detector", key: list[str] = UNIT) -> DataFrame:
    """Each span with the number of detectors that have an overlapping span of its type."""
    other = spans.select(*[F.col(c).alias(f"_{c}") for c in [*key, "start_off", "end_off", "entity_type", detector]])
    cond = reduce(lambda x, y: x & y, [spans[k].eqNullSafe(other[f"_{k}"]) for k in key])
    cond = cond & (spans["start_off"] < other["_end_off"]) & (other["_start_off"] < spans["end_off"]) & (spans["entity_type"] == other["_entity_type"])
    return spans.join(other, cond).groupBy(*spans.columns).agg(F.countDistinct(f"_{detector}").alias("votes"))
