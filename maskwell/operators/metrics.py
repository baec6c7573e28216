"""Evaluation metrics; undefined ratios are null."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    return F.when(b != 0, F.round(a / b, digits))


def prf(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to rows with tp, fp, fn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two labellings; perfect chance agreement gives 1 only if they agree."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    rows = cells.groupBy(F.col(a).alias("v")).agg(F.sum("n").alias("ra"))
    cols = cells.groupBy(F.col(b).alias("v")).agg(F.sum("n").alias("cb"))
    chance = rows.join(cols, "v").agg(F.sum(F.col("ra").cast("double") * F.col("cb")).alias("e"))
    both = total.crossJoin(F.broadcast(chance))
    po, pe = F.col("same") / F.col("total"), F.coalesce("e", F.lit(0.0)) / (F.col("total").cast("double") * F.col("total"))
    k = F.when(pe >= 1, F.when(po >= 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    return both.select(F.col("total").alias("n"), F.round(po, 6).alias("observed"), F.round(pe, 6).alias("expected"), F.round(k, 6).alias("kappa"))


def b_cubed(df: DataFrame, truth: str, found: str) -> DataFrame:
    """B-cubed precision, recall and F1 of a clustering, from contingency counts."""
    cell = df.groupBy(truth, found).agg(F.count("*").alias("n"))
    t = cell.groupBy(truth).agg(F.sum("n").alias("nt"))
    f = cell.groupBy(found).agg(F.sum("n").alias("nf"))
    sq = F.col("n").cast("double") * F.col("n")
    agg = cell.join(t, truth).join(f, found).agg((F.sum(sq / F.col("nf")) / F.sum("n")).alias("p"), (F.sum(sq / F.col("nt")) / F.sum("n")).alias("r"))
    return agg.select(F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")), 6).alias("f1"))


def pairwise(df: DataFrame, truth: str, found: str) -> DataFrame:
    """Pairwise precision, recall and F1 of a clustering without listing pairs."""
    two = lambda c: (F.sum(F.col(c).cast("double") * (F.col(c) - 1)) / 2)
    cell = df.groupBy(truth, found).agg(F.count("*").alias("n"))
    same = cell.agg(two("n").alias("tp"))
    t = cell.groupBy(truth).agg(F.sum("n").alias("n")).agg(two("n").alias("pt"))
    f = cell.groupBy(found).agg(F.sum("n").alias("n")).agg(two("n").alias("pf"))
    one = same.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(f))
    return one.select("tp", "pt", "pf", ratio(F.col("tp"), F.col("pf"), 6).alias("precision"), ratio(F.col("tp"), F.col("pt"), 6).alias("recall"), ratio(2 * F.col("tp"), F.col("pt") + F.col("pf"), 6).alias("f1"))


def bag_of_words(df: DataFrame, a: str, b: str, ident: str) -> DataFrame:
    """(ident, common, words_a, words_b, f1): multiset overlap of the words of two texts."""
    word = lambda c: F.filter(F.split(F.lower(F.col(c)), r"\s+"), lambda w: w != "")
    wa = df.select(ident, F.explode(word(a)).alias("w")).groupBy(ident, "w").agg(F.count("*").alias("na"))
    wb = df.select(ident, F.explode(word(b)).alias("w")).groupBy(ident, "w").agg(F.count("*").alias("nb"))
    both = wa.join(wb, [ident, "w"], "full_outer").fillna(0, ["na", "nb"])
    agg = both.groupBy(ident).agg(F.sum(F.least("na", "nb")).alias("common"), F.sum("na").alias("words_a"), F.sum("nb").alias("words_b"))
    return agg.withColumn("f1", ratio(2 * F.col("common"), F.col("words_a") + F.col("words_b"), 6))


def bootstrap_interval(groups: DataFrame, num: str, den: str, rounds: int = 1000, seed: str = "0", level: float = 0.95) -> DataFrame:
    """(estimate, low, high) of sum(num) / sum(den) resampled over rows.

    Draws follow SHA-256 of seed, round and slot, so every run gives the same
    interval. Rounds and slots are rows, hashed and summed in the cluster; only
    the ``rounds`` results are ranked. An empty table gives one row of nulls.
    """
    from maskwell.operators.curation import dense_positions
    from maskwell.runtime import stage

    plain = groups.select(F.coalesce(num, F.lit(0)).alias("_a"), F.coalesce(den, F.lit(0)).alias("_b"), F.monotonically_increasing_id().alias("_u"))
    rows, _ = stage(dense_positions(stage(plain, "groups")[0], "_a", "_b", "_u", out="_i"), "slots")
    total = rows.agg(F.count("*").alias("_k"), F.sum("_a").alias("_sa"), F.sum("_b").alias("_sb"))
    slots = rows.select((F.col("_i") - 1).alias("_s")).crossJoin(F.broadcast(total.select("_k"))).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    drawn = slots.select("_r", (F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col("_r").cast("string"), F.col("_s").cast("string")), 256), 1, 12), 16, 10).cast("long") % F.col("_k") + 1).alias("_i"))
    # A row is drawn many times; its draws are counted before the join.
    drawn = drawn.groupBy("_r", "_i").agg(F.count("*").alias("_n")).join(rows.select("_i", "_a", "_b"), "_i")
    values = drawn.groupBy("_r").agg((F.sum(F.col("_n") * F.col("_a")) / F.nullif(F.sum(F.col("_n") * F.col("_b")), F.lit(0))).alias("v")).filter("v IS NOT NULL")
    ranked = values.agg(F.array_sort(F.collect_list("v")).alias("v"))
    pick = lambda q: F.get("v", F.least(F.size("v") - 1, F.floor(F.lit(q) * F.size("v"))).cast("int"))
    tail = (1 - level) / 2
    return ranked.crossJoin(F.broadcast(total)).select((F.col("_sa") / F.nullif(F.col("_sb"), F.lit(0))).cast("double").alias("estimate"), pick(round(tail, 12)).alias("low"), pick(round(1 - tail, 12)).alias("high"))


def page_quality(words: DataFrame, key: list[str], low: float = 60.0) -> DataFrame:
    """Words, mean confidence and share of weak words per page; null confidences are left out."""
    return words.groupBy(*key).agg(
        F.count("*").alias("n_words"),
        F.round(F.avg("conf"), 2).alias("mean_conf"),
        F.round(F.sum((F.col("conf") < low).cast("int")) / F.count("conf"), 4).alias("low_frac"),
    )


def error_rate(ref: Column, hyp: Column) -> Column:
    """Character error rate; an empty reference gives null for an empty text, else 1."""
    return F.when(F.length(ref) == 0, F.when(F.length(hyp) > 0, 1.0)).otherwise(F.round(F.levenshtein(ref, hyp) / F.length(ref), 6))


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, bit-parallel: one step a character of ``b``."""
    if not a or not b:
        return len(a) + len(b)
    m = len(a)
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | (1 << i)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    for c in b:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ((ph << 1) | 1) & mask
        mh = (mh << 1) & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
    return score


def text_error_rate(ref: Column | str, hyp: Column | str) -> Column:
    """Character error rate of whole texts in NFKC with blanks and line ends collapsed.

    Null counts as empty; an empty reference gives null for an empty text, else 1.
    """

    @F.pandas_udf("double")
    def rate(refs: pd.Series, hyps: pd.Series) -> pd.Series:
        out: list[float | None] = []
        for a, b in zip(refs, hyps):
            r, h = (" ".join(unicodedata.normalize("NFKC", t or "").split()) for t in (a, b))
            out.append(round(edit_distance(r, h) / len(r), 4) if r else 1.0 if h else None)
        return pd.Series(out, dtype="float64")

    return rate(ref, hyp)


def running_rank(df: DataFrame, key: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
