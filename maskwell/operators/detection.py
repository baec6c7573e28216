"""Context rules, form checks and combination of detectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.operators.spans import UNIT, overlaps, regex_spans, same_unit

# Words that announce a number, and the shape of the number.
CONTEXT = {
    "ctx.passport": ("PASSPORT", r"(?:Passport|passport)(?: number| numbered| no\.)?:? ", r"[A-Z]{1,2}[0-9]{7}"),
    "ctx.licence": ("DRIVER_LICENCE", r"[Ll]icence(?:,? number| no\.)? ", r"[A-Z]?[0-9]{6,8}"),
    "ctx.claim": ("CLAIM_NUMBER", r"[Cc]laim number:? ", r"[A-Z]{2}[0-9]{7}"),
    "ctx.tfn": ("TFN", r"(?:TFN|T\.F\.N\.|[Tt]ax file (?:number|no\.)):? ", r"[0-9]{3}[ \-]?[0-9]{3}[ \-]?[0-9]{3}"),
    "ctx.medicare": ("MEDICARE", r"Medicare(?: card)?(?: number| no\.)?:? ", r"[2-6][0-9]{3}[ \-]?[0-9]{5}[ \-]?[0-9]"),
    "ctx.file": ("COURT_FILE_NUMBER", r"(?:file number|reference|File ref:) ", r"[0-9]{4}/[0-9]{2}-[0-9]{2}"),
}


def context_spans(df: DataFrame, ident: str, text: str, *names: str) -> DataFrame:
    """(ident, rule, entity_type, start_off, end_off, text) of values that follow their announcement.

    The announcement and the value are matched together; the span is the value.
    """
    parts = []
    for name in names or CONTEXT:
        kind, before, value = CONTEXT[name]
        both = regex_spans(df, text, f"{before}{value}\\b", ident)
        v = F.regexp_extract("text", f"({value})$", 1)
        parts.append(both.select(ident, F.lit(name).alias("rule"), F.lit(kind).alias("entity_type"), (F.col("end_off") - F.length(v)).alias("start_off"), "end_off", v.alias("text")))
    return reduce(DataFrame.union, parts)


def nearest_before(df: DataFrame, spans: DataFrame, ident: str, text: str, phrases: dict[str, list[str]], reach: int = 60, default: str = "other") -> DataFrame:
    """``spans`` with ``role``: the role whose phrase stands last within ``reach`` characters before.

    Ties go to the role named first.
    """
    low = F.lower(F.substring(F.col("_t"), F.greatest(F.col("start_off") - reach, F.lit(0)) + 1, F.least(F.col("start_off"), F.lit(reach))))
    with_text = spans.join(df.select(ident, F.col(text).alias("_t")).dropDuplicates([ident]), ident).withColumn("_w", low)
    found = []
    for k, (role, words) in enumerate(phrases.items()):
        at = F.greatest(*[F.length("_w") - F.instr(F.reverse("_w"), F.lit(w[::-1])) for w in words], F.lit(-1))
        hit = reduce(lambda a, b: a | b, [F.col("_w").contains(w) for w in words])
        found.append(F.when(hit, F.struct(at.alias("at"), F.lit(-k).alias("k"), F.lit(role).alias("role"))))
    best = F.array_max(F.array_compact(F.array(*found)))
    return with_text.withColumn("role", F.coalesce(best["role"], F.lit(default))).drop("_t", "_w")


def combined(spans: DataFrame, detector: str, need: int, key: list[str] = UNIT) -> DataFrame:
    """Spans at least ``need`` detectors agree on (overlap and equal type), with ``votes``."""
    from maskwell.operators.spans import votes

    return votes(spans, detector, key).filter(F.col("votes") >= need)


def disagreements(a: DataFrame, b: DataFrame, key: list[str] = UNIT, slack: int = 0) -> DataFrame:
    """(key..., start_off, end_off, entity_type, kind) of spans of two passes that do not agree.

    missed: only in ``a``; extra: only in ``b``; type: same place, other type;
    boundary: same type, bounds more than ``slack`` apart.
    """
    cols = [*key, "start_off", "end_off", "entity_type"]
    x, y = a.select(*cols), b.select(*[F.col(c).alias(c) for c in cols])
    on = same_unit(x, y, key) & overlaps(x, y)
    missed = x.join(y, on, "left_anti").withColumn("kind", F.lit("missed"))
    extra = y.join(x, on, "left_anti").withColumn("kind", F.lit("extra"))
    both = x.join(y, on)
    far = (F.abs(x["start_off"] - y["start_off"]) > slack) | (F.abs(x["end_off"] - y["end_off"]) > slack)
    kind = F.when(x["entity_type"] != y["entity_type"], "type").when(far, "boundary")
    other = both.select(*[x[c] for c in cols], kind.alias("kind")).filter("kind IS NOT NULL")
    return missed.union(extra).union(other).distinct()


def page_class(chars: Column, alnum: Column, bad: Column, covered: Column, paths: Column) -> Column:
    """born_digital, hybrid, scanned, vector, blank or unknown from page signals."""
    usable = (chars >= 50) & (alnum >= 0.6) & (bad <= 0.01)
    return (
        F.when(usable & (covered >= 0.1), "hybrid").when(usable, "born_digital").when(covered >= 0.85, "scanned")
        .when((paths >= 300) & (covered < 0.5), "vector").when((chars == 0) & (covered == 0) & (paths == 0), "blank").otherwise("unknown")
    )


def joined_sources(first: DataFrame, second: DataFrame, page: list[str], most: float = 0.5) -> DataFrame:
    """Words of ``first`` and those of ``second`` it covers by less than ``most``.

    Both have ``page`` columns and a ``bbox``. This merges a text layer with the
    words recognised in the pictures of a page.
    """
    from maskwell.functions.boxes import overlap_fraction

    a = first.select(*page, F.col("bbox").alias("_a"))
    b = second.withColumn("_row", F.monotonically_increasing_id())
    near = b.join(a, page).filter(overlap_fraction(F.col("bbox"), F.col("_a")) >= most).select("_row").distinct()
    return first.unionByName(b.join(near, "_row", "left_anti").drop("_row"))


def ladder(attempts: DataFrame, key: list[str], low: float) -> DataFrame:
    """The attempt to keep per page: the first rung that is good enough, else the best mean."""
    ok = F.col("mean_conf") >= low
    first = F.min_by(F.struct("rung", "mean_conf"), F.when(ok, F.col("rung")))
    best = F.max_by(F.struct("rung", "mean_conf"), F.struct("mean_conf", -F.col("rung")))
    return attempts.groupBy(*key).agg(F.coalesce(first, best).alias("k"), F.max(ok).alias("rescued")).select(*key, "k.rung", "k.mean_conf", "rescued")
