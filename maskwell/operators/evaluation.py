"""Measures of detection and protection over whole documents.

Mentions: mention_id, text unit, start_off, end_off, entity_type, role, action,
attributes. Predictions and edits: the same with their own id. Undefined ratios
are null.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.operators import policy
from maskwell.operators.metrics import edit_distance, prf, ratio
from maskwell.operators.spans import UNIT, covered_length, match_one_to_one, overlap_join

SCHEMES = ["strict", "exact", "overlap_typed", "overlap_any"]


def matched(gold: DataFrame, found: DataFrame, scheme: str, gold_id: str, found_id: str) -> DataFrame:
    """(gold_id, found_id): greedy one-to-one pairs that a scheme allows."""
    pick = lambda c: lambda g, p: policy.eligible(scheme, g["start_off"], g["end_off"], g["entity_type"], p["start_off"], p["end_off"], p["entity_type"])
    return match_one_to_one(gold, found, gold_id, found_id, allowed=pick(scheme)).select(gold_id, found_id)


def event_rows(gold: DataFrame, found: DataFrame, gold_id: str, found_id: str, schemes: list[str] = SCHEMES) -> DataFrame:
    """(scheme, outcome, document_id, gold_type, found_type): one row per pair, missed mention and false find."""
    g = gold.select(F.col(gold_id).cast("string").alias(gold_id), "document_id", F.col("entity_type").alias("gold_type"))
    p = found.select(F.col(found_id).cast("string").alias(found_id), F.col("document_id").alias("_d"), F.col("entity_type").alias("found_type"))
    out = None
    for scheme in schemes:
        pairs = matched(gold, found, scheme, gold_id, found_id)
        all_g = g.join(pairs, gold_id, "left").join(p.drop("_d"), found_id, "left")
        rows = all_g.select(F.lit(scheme).alias("scheme"), F.when(F.col(found_id).isNull(), "fn").otherwise("tp").alias("outcome"), "document_id", "gold_type", "found_type")
        lost = p.join(pairs, found_id, "left_anti").select(F.lit(scheme), F.lit("fp"), F.col("_d"), F.lit(None).cast("string"), "found_type")
        out = rows.union(lost) if out is None else out.union(rows).union(lost)
    return out


def detection_metrics(events: DataFrame) -> DataFrame:
    """(scheme, level, name, tp, fp, fn, precision, recall, f1): micro, per type, per group of types and per document."""
    kind = F.coalesce("gold_type", "found_type")
    levels = F.array(
        F.struct(F.lit("micro").alias("level"), F.lit("all").alias("name")), F.struct(F.lit("type").alias("level"), kind.alias("name")),
        F.struct(F.lit("group").alias("level"), policy.type_facts(kind)["group"].alias("name")), F.struct(F.lit("document").alias("level"), F.col("document_id").alias("name")),
    )
    n = lambda o: F.sum((F.col("outcome") == o).cast("long")).alias(o)
    return prf(events.select("scheme", "outcome", F.explode(levels).alias("l")).groupBy("scheme", "l.level", "l.name").agg(n("tp"), n("fp"), n("fn")))


def macro(metrics: DataFrame) -> DataFrame:
    """(scheme, types, precision, recall, f1): means over the types that have mentions; an undefined value counts as 0."""
    has = metrics.filter("level = 'type' AND tp + fn > 0")
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 4).alias(c)
    return has.groupBy("scheme").agg(F.count("*").alias("types"), mean("precision"), mean("recall"), mean("f1"))


def protection(gold: DataFrame, edits: DataFrame, mode: str) -> DataFrame:
    """One row: mentions to protect, protected (covered whole), characters, critical ones missed, KEEP mentions touched, for a mode."""
    hide = edits.filter(policy.protects("action", mode))
    cover = covered_length(gold, "mention_id", hide)
    rows = gold.join(cover, "mention_id").withColumn("size", F.col("end_off") - F.col("start_off")).withColumn("want", policy.protects("action"))
    want, full = F.col("want"), F.col("covered") >= F.col("size")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    got = rows.agg(
        n(want).alias("mentions"), n(want & full).alias("protected"), F.coalesce(F.sum(F.when(want, F.col("size"))), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.when(want, F.col("covered"))), F.lit(0)).alias("covered_chars"),
        n(want & ~full & policy.critical("entity_type", "role")).alias("critical_missed"), n((F.col("action") == "KEEP") & (F.col("covered") > 0)).alias("keep_violations"),
    )
    return got.select(F.lit(mode).alias("mode"), "*", ratio(F.col("protected"), F.col("mentions")).alias("mention_recall"), ratio(F.col("covered_chars"), F.col("chars")).alias("char_recall"))


def attribution(gold: DataFrame, found: DataFrame, edits: DataFrame) -> DataFrame:
    """(mention_id, outcome) of each mention to protect: OK, or what lost it.

    DETECTOR_MISS: nothing found there; BOUNDARY: found, not covered whole by any
    find; POLICY_MISS: found whole, yet no protecting edit covers it.
    """
    want = gold.filter(policy.protects("action"))
    size = F.col("end_off") - F.col("start_off")
    hidden = covered_length(want, "mention_id", edits.filter(policy.protects("action"))).withColumnRenamed("covered", "hidden")
    seen = covered_length(want, "mention_id", found).withColumnRenamed("covered", "seen")
    both = want.join(hidden, "mention_id").join(seen, "mention_id")
    outcome = F.when(F.col("hidden") >= size, "OK").when(F.col("seen") == 0, "DETECTOR_MISS").when(F.col("seen") < size, "BOUNDARY").otherwise("POLICY_MISS")
    return both.select("mention_id", "entity_type", outcome.alias("outcome"))


def attribution_summary(rows: DataFrame) -> DataFrame:
    """(entity_type, outcome, n): by type, and null for all."""
    return rows.groupingSets([["outcome"], ["entity_type", "outcome"]], "entity_type", "outcome").agg(F.count("*").alias("n"))


def token_labels(words: DataFrame, mentions: DataFrame, key: list[str]) -> DataFrame:
    """(key..., idx, label): the type of the first mention that meets a word, else O."""
    m = mentions.select(*key, F.col("start_off").alias("_s"), F.col("end_off").alias("_e"), "entity_type", "mention_id")
    w = words.select(*key, "idx", "start_off", "end_off").distinct()
    hit = w.join(m, key).filter("start_off < _e AND _s < end_off").groupBy(*key, "idx").agg(F.min_by("entity_type", F.struct("_s", "_e", "mention_id")).alias("label"))
    return w.select(*key, "idx").distinct().join(hit, [*key, "idx"], "left").select(*key, "idx", F.coalesce("label", F.lit("O")).alias("label"))


def untouched_text(units: DataFrame, gold: DataFrame, edits: DataFrame, ident: str) -> DataFrame:
    """(ident, chars, touched): characters outside all mentions, and those of them that an edit covers."""
    from maskwell.operators.spans import merged

    u = units.select(ident, *UNIT, F.length("text").alias("_n")).distinct()
    whole = u.withColumn("start_off", F.lit(0)).withColumn("end_off", F.col("_n")).filter("_n > 0")
    names = covered_length(whole, ident, gold).withColumnRenamed("covered", "_g")
    hits = covered_length(whole, ident, edits).withColumnRenamed("covered", "_e")
    both = overlap_join(a := merged(gold), b := merged(edits)).select(*[a[k] for k in UNIT], F.greatest(a["start_off"], b["start_off"]).alias("start_off"), F.least(a["end_off"], b["end_off"]).alias("end_off"))
    shared = covered_length(whole, ident, both).withColumnRenamed("covered", "_b")
    rows = whole.select(ident, "_n").join(names, ident).join(hits, ident).join(shared, ident)
    return rows.select(ident, (F.col("_n") - F.col("_g")).alias("chars"), (F.col("_e") - F.col("_b")).alias("touched"))


def _normal(t: str | None, fold: bool) -> str:
    out = " ".join(unicodedata.normalize("NFKC", t or "").split())
    return out.casefold() if fold else out


def _rate(r, h) -> float | None:
    return round(edit_distance(r, h) / len(r), 4) if len(r) else 1.0 if len(h) else None


def _tokens_as_letters(a: str, b: str) -> tuple[str, str]:
    number: dict[str, str] = {}
    return tuple("".join(number.setdefault(w, chr(0xF0000 + len(number))) for w in t.split()) for t in (a, b))


_TEXT_METRICS = T.StructType([T.StructField(c, T.DoubleType()) for c in ("cer", "cer_ci", "wer", "wer_ci", "bow_f1")])


@F.pandas_udf(_TEXT_METRICS)
def page_text_metrics(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Character and word error rates with and without case, and the bag-of-words F1, of whole texts."""
    out = []
    for r, h in zip(ref, hyp):
        row = []
        for fold in (False, True):
            a, b = _normal(r, fold), _normal(h, fold)
            row += [_rate(a, b), _rate(*_tokens_as_letters(a, b))]
        wa, wb = pd.Series(a.split(), dtype=object).value_counts(), pd.Series(b.split(), dtype=object).value_counts()
        common = int(pd.concat([wa, wb], axis=1).fillna(0).min(axis=1).sum()) if len(wa) and len(wb) else 0
        total = int(wa.sum() + wb.sum())
        out.append((row[0], row[2], row[1], row[3], round(2 * common / total, 4) if total else None))
    return pd.DataFrame(out, columns=["cer", "cer_ci", "wer", "wer_ci", "bow_f1"])


def recovery_class(gold: Column, read: Column, near: float = 0.2) -> Column:
    """exact, near (error rate up to ``near``), degraded or missing, of a value as it was read."""
    far = F.levenshtein(gold, read) / F.length(gold)
    return F.when(read.isNull() | (F.trim(read) == ""), "missing").when(gold == read, "exact").when(far <= near, "near").otherwise("degraded")


def page_states(gold: DataFrame, edits: DataFrame) -> DataFrame:
    """(document_id, page, state): BLOCKED where a mention to protect is not covered, REVIEW where one waits, else PASS."""
    cover = covered_length(gold, "mention_id", edits.filter(policy.protects("action")))
    rows = gold.join(cover, "mention_id")
    open_ = policy.protects("action") & (F.col("covered") < F.col("end_off") - F.col("start_off"))
    per = rows.groupBy("document_id", "page").agg(F.max(open_).alias("b"), F.max(F.col("action") == "REVIEW").alias("r"))
    return per.select("document_id", "page", F.when(F.col("b"), "BLOCKED").when(F.col("r"), "REVIEW").otherwise("PASS").alias("state"))


def hit_islands(hits: DataFrame, rank: dict[str, int], key: list[str] = UNIT) -> DataFrame:
    """(key..., start_off, end_off, method): hits that overlap, as one with the most specific method."""
    order = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    w = Window.partitionBy(*key).orderBy("start_off", "end_off", "method")
    before = F.max("end_off").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("start_off") >= before, F.lit(True)).cast("int")
    marked = hits.withColumn("_new", new).withColumn("_isle", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*key, "_isle").agg(F.min("start_off").alias("start_off"), F.max("end_off").alias("end_off"), F.min_by("method", F.struct(F.coalesce(order[F.col("method")], F.lit(999)), "method")).alias("method")).drop("_isle")


def first_divergences(a: DataFrame, b: DataFrame, key: list[str], order: list[str], n: int = 20) -> DataFrame:
    """(position, change): the first ``n`` places where two runs differ; a report, so the limit is its purpose."""
    w = Window.partitionBy(*key).orderBy(*order)
    cols = [c for c in a.columns if c not in key]
    x = a.withColumn("_p", F.row_number().over(w)).select(*key, "_p", F.struct(*cols).alias("_a"))
    y = b.withColumn("_p", F.row_number().over(w)).select(*key, "_p", F.struct(*cols).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return x.join(y, [*key, "_p"], "full_outer").select(*key, F.col("_p").alias("position"), change.alias("change")).filter("change IS NOT NULL").orderBy(*key, "position").limit(n)
