"""Page text from words, lines and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page_words(pages: DataFrame, *keep: str) -> DataFrame:
    """One row per recognised word of pages that carry them."""
    return pages.select(*keep, F.explode("words").alias("w")).select(*keep, "w.*")


def assembled(words: DataFrame, key: list[str]) -> DataFrame:
    """(key..., text): words joined by blanks, lines by line ends, empty words skipped."""
    w = Window.partitionBy(*key).orderBy("idx")
    kept = words.filter("text IS NOT NULL AND trim(text) <> ''").withColumn("_t", F.trim("text"))
    new = F.lag(F.struct("block", "line")).over(w)
    sep = F.when(F.row_number().over(w) == 1, "").when(new.eqNullSafe(F.struct("block", "line")), " ").otherwise("\n")
    cut = kept.withColumn("_p", F.concat(sep, F.col("_t")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "_p"))), lambda x: x["_p"])
    return cut.groupBy(*key).agg(F.concat_ws("", parts).alias("text"))


def offsets(words: DataFrame, key: list[str]) -> DataFrame:
    """Adds start_at and end_at: running code-point offsets of each word."""
    w = Window.partitionBy(*key).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0))
    return words.withColumn("start_at", before).withColumn("end_at", before + F.length("text"))


def line_boxes(words: DataFrame, key: list[str]) -> DataFrame:
    """One box per line: the smallest that holds its words."""
    b = F.col("bbox")
    return words.groupBy(*key, "block", "line").agg(
        F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1"), F.count("*").alias("n_words")
    )


def cells(words: DataFrame, key: list[str], gap: float) -> DataFrame:
    """Runs of words of a line without a gap wider than ``gap``."""
    w = Window.partitionBy(*key, "block", "line").orderBy("idx")
    far = F.coalesce(F.col("bbox")["x0"] - F.lag(F.col("bbox")["x1"]).over(w) > gap, F.lit(True))
    marked = words.withColumn("_new", far.cast("int")).withColumn("cell", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*key, "block", "line", "cell").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
