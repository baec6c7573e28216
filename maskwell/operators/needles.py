"""Leak scans: known values (needles) in output texts.

Exact and name needles meet the texts through word n-grams: texts emit the
n-grams of the lengths that occur among the needles, needles their word key,
and an equi-join on the key replaces every needle-by-text comparison.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.runtime import spread, stage

MOST_WORDS = 6
# Characters that recognition confuses, and punctuation around words.
CONFUSED = ("01i|58", "olllsb")
OUTER_MARKS = """.,;:()"'"""
OUTER = f"^[{OUTER_MARKS}]+|[{OUTER_MARKS}]+$"


def words(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def scan_exact(texts: DataFrame, ident: str, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """(ident, needle, hits): whole-word occurrences of each needle.

    Case, blanks and punctuation between words do not matter. Texts emit the runs
    of words of the lengths that occur among the needles, of up to ``MOST_WORDS``
    words; longer needles meet on their first words and are compared whole,
    with as many words of the text as they have.
    """
    n = needles.select(F.col(needle).alias("_needle")).dropna().distinct().withColumn("_nw", words(F.col("_needle"))).filter(F.size("_nw") > 0)
    n = n.withColumn("_k", F.least(F.size("_nw"), F.lit(MOST_WORDS))).withColumn("_n", F.size("_nw")).withColumn("_key", F.xxhash64(F.concat_ws(" ", F.slice("_nw", F.lit(1), F.col("_k")))))
    # At most MOST_WORDS lengths of runs; the longest needle decides how many words go along.
    lengths = sorted(r["_k"] for r in n.select("_k").distinct().collect())
    most = n.agg(F.max("_n")).first()[0] or 0
    n = n.withColumn("_whole", F.concat_ws(" ", "_nw"))
    t = spread(texts.select(F.col(ident).alias("_id"), F.col(text).alias("_t"))).select("_id", words(F.col("_t")).alias("_tw")).filter(F.size("_tw") > 0)

    def runs(k: int) -> Column:
        take = k if k < MOST_WORDS else max(most, k)
        at = F.sequence(F.lit(1), F.size("_tw") - (k - 1))
        made = F.transform(at, lambda i: F.struct(F.lit(k).alias("_k"), F.xxhash64(F.concat_ws(" ", F.slice("_tw", i, F.lit(k)))).alias("_key"), F.concat_ws(" ", F.slice("_tw", i, F.lit(take))).alias("_here")))
        return F.when(F.size("_tw") >= k, made).otherwise(F.array().cast("array<struct<_k:int,_key:bigint,_here:string>>"))

    every = F.flatten(F.array(*[runs(k) for k in lengths])) if lengths else F.array().cast("array<struct<_k:int,_key:bigint,_here:string>>")
    pos = t.select("_id", F.explode(every).alias("_g")).select("_id", "_g.*")
    hit = pos.join(n, ["_k", "_key"]).filter(F.concat(F.col("_here"), F.lit(" ")).startswith(F.concat(F.col("_whole"), F.lit(" "))))
    return hit.groupBy(F.col("_id").alias(ident), F.col("_needle").alias("needle")).agg(F.count("*").alias("hits"))


def scan_digits(texts: DataFrame, ident: str, text: str, needles: DataFrame, needle: str, least: int = 6) -> DataFrame:
    """(ident, needle): needles whose digits stand inside a digit run, separators removed.

    Runs emit their substrings of the lengths that occur among the needles.
    """
    d = F.regexp_replace(F.col(needle), "[^0-9]", "")
    n = needles.select(d.alias("_d")).filter(F.length("_d") >= least).distinct()
    lengths = sorted(r["_k"] for r in n.select(F.length("_d").alias("_k")).distinct().collect())
    found = F.regexp_extract_all(F.col(text), F.lit(r"\d[\d \-/.]{" + str(max(0, least - 2)) + r",}\d"), F.lit(0))
    runs = F.array_distinct(F.transform(found, lambda r: F.regexp_replace(r, "[^0-9]", "")))
    t = texts.select(F.col(ident).alias("_id"), F.explode(runs).alias("_run"))

    def parts(k: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length("_run") - (k - 1)), lambda i: F.substring(F.col("_run"), i, F.lit(k)))
        return F.when(F.length("_run") >= k, cut).otherwise(F.array().cast("array<string>"))

    every = F.array_distinct(F.flatten(F.array(*[parts(k) for k in lengths]))) if lengths else F.array().cast("array<string>")
    t = t.select("_id", F.explode(every).alias("_d"))
    return t.join(n, "_d").select(F.col("_id").alias(ident), F.col("_d").alias("needle")).distinct()


_FOLD = str.maketrans(*CONFUSED)
_BLANK, _WORD = re.compile(r"[ \t\n\x0b\f\r]+"), re.compile(r"[^\W_]+")
KEPT_WORDS = 200_000


def near_keys(c: str) -> Column:
    """Keys on which strings at most one edit apart meet: the folded string, and it without each of its characters."""
    f = F.translate(F.col(c), *CONFUSED)
    cut = F.transform(F.sequence(F.lit(1), F.length(f)), lambda i: F.concat(F.substring(f, F.lit(1), i - 1), F.substring(f, i + 1, F.length(f))))
    return F.array_distinct(F.array_append(cut, f))


class NearRuns:
    """Finds the runs of words that share a key with a needle, by the keys' 32-bit hashes; where hashes coincide by chance, a run too many.

    ``known`` has the hashes of the needles' keys and, for needles of more words,
    of their first and last words: runs of as many words one edit apart are equal
    in one of the two.
    """

    def __init__(self, known: np.ndarray, lengths: list[int], least: int) -> None:
        self.known, self.lengths, self.least = np.unique(known.astype(np.uint32)), lengths, least
        self.marks: dict[str, int] = {}
        self.runs: dict[str, bool] = {}

    def _any(self, keys: list[list[str]]) -> list[bool]:
        """Whether one key of each list, none of them empty, is known."""
        if not keys or not len(self.known):
            return [False] * len(keys)
        h = np.fromiter((crc32(k.encode()) for ks in keys for k in ks), np.uint32)
        at = np.searchsorted(self.known, h)
        at[at == len(self.known)] = 0
        starts = np.cumsum([0, *(len(ks) for ks in keys[:-1])])
        return np.logical_or.reduceat(self.known[at] == h, starts).tolist()

    def _near(self, strings: list[str]) -> list[bool]:
        folded = [x.translate(_FOLD) for x in strings]
        return self._any([[f, *(f[:i] + f[i + 1 :] for i in range(len(f)))] for f in folded])

    def _learn(self, new: set[str]) -> None:
        every = list(new)
        marks = dict.fromkeys(every, 0)
        if 1 in self.lengths:
            long = [x for x in every if len(x) >= self.least - 1]
            marks.update(zip(long, map(int, self._near(long))))
        if any(k > 1 for k in self.lengths):
            folded = [x.translate(_FOLD) for x in every]
            for mark, side in ((2, "< "), (4, "> ")):
                for x, yes in zip(every, self._any([[side + f] for f in folded])):
                    marks[x] |= mark * yes
        self.marks.update(marks)

    def __call__(self, texts: list[str | None]) -> list[set[tuple[int, str]]]:
        """(words, run) of each text in small letters, read both between blanks and as letters and digits."""
        read = []
        for t in texts:
            between = [y for x in _BLANK.split(t or "") if (y := x.strip(OUTER_MARKS))]
            read.append((between, _WORD.findall(t or "")))
        seen = {x for both in read for tokens in both for x in tokens}
        if len(self.marks) + len(self.runs) > KEPT_WORDS:
            self.marks, self.runs = {}, {}
        self._learn(seen - self.marks.keys())
        marks, more = self.marks, [k for k in self.lengths if k > 1]
        found: list[set[tuple[int, str]]] = []
        for both in read:
            here: set[tuple[int, str]] = set()
            for tokens in both:
                m = [marks[x] for x in tokens]
                if not any(m):
                    continue
                here.update((1, x) for x, y in zip(tokens, m) if y & 1)
                for k in more:
                    at = {i for i, y in enumerate(m) if y & 2} | {i - k + 1 for i, y in enumerate(m) if y & 4}
                    runs = (" ".join(tokens[i : i + k]) for i in at if 0 <= i <= len(m) - k)
                    here.update((k, x) for x in runs if len(x) >= self.least - 1)
            found.append(here)
        new = list({x for here in found for k, x in here if k > 1} - self.runs.keys())
        self.runs.update(zip(new, self._near(new)))
        return [{(k, x) for k, x in here if k == 1 or self.runs[x]} for here in found]


def scan_fuzzy(texts: DataFrame, ident: str, text: str, needles: DataFrame, needle: str, least: int = 6) -> DataFrame:
    """(ident, needle, word): k-word runs at most one edit away from a k-word needle, but not equal to it.

    Confusable characters count as equal. Texts are read once, both as runs between
    blanks, outer punctuation removed, and as runs of letters and digits. Both
    sides meet on their single-character deletes. The tasks get the hashes of the
    needles' keys, four bytes each and some ten a needle, and keep of the texts
    only runs that share one; these are joined and compared exactly.
    """

    def blanks(col: Column) -> Column:
        return F.filter(F.transform(F.split(F.lower(col), r"\s+"), lambda x: F.regexp_replace(x, OUTER, "")), lambda x: x != "")

    whole = F.trim(F.regexp_replace(F.lower(needle), r"\s+", " "))
    n = needles.select(needle).distinct().select(whole.alias("_n"), F.explode(F.array(F.split(whole, " "), blanks(F.col(needle)), words(F.col(needle)))).alias("_w")).filter(F.length("_n") >= least)
    n = n.select("_n", F.concat_ws(" ", "_w").alias("_f"), F.size("_w").alias("_k")).filter(F.length("_f") >= least).distinct()
    n, _ = stage(n, "needles")
    lengths = sorted(r["_k"] for r in n.select("_k").distinct().collect())
    left = n.withColumn("_key", F.explode(near_keys("_f")))
    f = F.translate("_f", *CONFUSED)
    ends = n.filter("_k > 1").select(F.explode(F.array(F.concat(F.lit("< "), F.substring_index(f, " ", 1)), F.concat(F.lit("> "), F.substring_index(f, " ", -1)))).alias("_key"))
    hashes = left.select("_key").union(ends).select((F.crc32(F.col("_key").cast("binary")) - (1 << 31)).cast("int").alias("h")).distinct()
    runs = NearRuns(hashes.toArrow()["h"].to_numpy().astype(np.int64) + (1 << 31), lengths, least)
    shared = texts.sparkSession.sparkContext.broadcast(runs)

    def read(batches):
        runs = shared.value
        for b in batches:
            found = runs(b.column(1).to_pylist())
            rows = [(i, k, x) for i, here in enumerate(found) for k, x in here]
            if rows:
                i, k, x = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), pa.array(k, pa.int32()), pa.array(x, pa.string())], ["_id", "_k", "_w"])

    t = spread(texts.select(F.col(ident).alias("_id"), F.col(text).alias("_t"))).select("_id", F.lower("_t").alias("_t")).filter("_t IS NOT NULL")
    w, _ = stage(t.mapInArrow(read, f"_id {t.schema['_id'].dataType.simpleString()}, _k int, _w string").distinct(), "runs")
    right = w.select("_k", "_w").distinct().withColumn("_key", F.explode(near_keys("_w")))
    close = F.levenshtein(F.translate("_f", *CONFUSED), F.translate("_w", *CONFUSED), 1) >= 0
    near = left.join(right, ["_k", "_key"]).filter(close).select("_n", "_k", "_w").distinct()
    # What equals a form of the needle is an exact hit, not a near one.
    near = near.join(n.select("_n", F.col("_f").alias("_w")), ["_n", "_w"], "left_anti")
    return w.join(near, ["_k", "_w"]).select(F.col("_id").alias(ident), F.col("_n").alias("needle"), F.col("_w").alias("word"))
