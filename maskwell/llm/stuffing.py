"""Keyword-stuffed pages and link lists.

Method: words of distinct texts are counted over the whole corpus, alone and as
neighbours ``REACH`` words apart, and give the pointwise mutual information of
every neighbour pair, ln(1 + P(ab) / P(a)P(b)). The coherence of a text is the
mean PMI of its neighbours in the order found less that of the same neighbours
turned round: prose has a direction, strung-together keywords have none once
the pair reaches beyond one keyword phrase. The text's own pairs are left out of
the counts it is judged by, so that a text does not vouch for itself.

Only texts below ``COHERENCE`` come further. There an exact check of their form
follows: the share of their characters in

* word salad (little grammar, in texts below ``SALAD``),
* excessively repeated collocations (pairs with a content word that recur inside
  a sentence or run of items cover ``REPEATED`` of it),
* runs of bare items (menu entries, tags, price lines), and addresses of links.

A document is found where that share exceeds ``SHARE``. Ordinary sentences that
recur whole, form fields with labels, bullet lists and single links are no part
of it.

Copies of a text are judged once. Null and empty texts are never found; a text
too short for a pair counts as incoherent, so its form alone decides.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.runtime import stage

SHARE = 0.5
REPEATED = 0.4
RECURS = 3
#: Neighbours are this many words apart: further than a keyword phrase is long.
REACH = 4
COHERENCE = 1.8
SALAD = 0.8
SALAD_WORDS = 12
#: Pairs above this share of all pairs (so fewer than 1 / HOT) are joined by broadcast.
HOT = 1 / 4096
RUN_ITEMS = 5
ITEM_WORDS = 7
KEYWORD_STRING = 40
GRAMMAR = 0.2

# Words that carry grammar, not topic.
FUNCTION_WORDS = set(
    "the of and to in a an was is are were be been for on with that at by from as or not this these those it its his her he she "
    "we you your our their they will would can could may has have had do does did no any all if which who when while but than then "
    "there here into over under after before during about more most i me my "
    "de la el en los las un una que por se con del y o es su al lo para "
    "der die das und den dem des ein eine ist im zu von mit auf für nicht war wird sich bei nach "
    "le les et du une est au aux pour dans sur par ce cette il elle ne pas".split()
)
_LINK = re.compile(
    r"<a\b[^>]*>.*?</a>|\[[^\]\n]*\]\([^)\s]+\)|(?:https?://|www\.)[^\s<>\")\]]+|\b(?:[a-z0-9\-]+\.)+[a-z]{2,}/[^\s<>\")\]]+",
    re.I | re.S,
)
_CUT = re.compile(r"\n+|\s[|»›•·>→–—]+\s|\s{2,}|\t+")
_SENTENCE = re.compile(r"(?<=[.!])\s+(?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+")
_MIX = np.int64(-7046029254386353131)
_HASH = re.compile(r"#\w+")
_LABEL = re.compile(r"^\s*[^\W\d_][\w '’./\-]{0,30}:\s*\S")
_BULLET = re.compile(r"^\s*(?:[-*•·]|\d+[.)])\s+")
_PRICE = re.compile(r"[$€£]\s?\d")


def repeated_share(words: list[str]) -> float:
    """Share of words inside word pairs with a content word that occur ``RECURS`` times or more."""
    n = len(words)
    if n < 4:
        return 0.0
    pairs = [None if a in FUNCTION_WORDS and b in FUNCTION_WORDS else (a, b) for a, b in zip(words, words[1:])]
    seen = Counter(p for p in pairs if p)
    hit = [False] * n
    for i, p in enumerate(pairs):
        if p and seen[p] >= RECURS:
            hit[i] = hit[i + 1] = True
    return sum(hit) / n


def _is_item(piece: str, words: list[str]) -> bool:
    if not words or len(words) > ITEM_WORDS or _LABEL.match(piece) or _BULLET.match(piece):
        return False
    return piece.rstrip()[-1:] not in ".;:!?" and not (piece[:1].isdigit() and len(words) < 2)


def segments_of(text: str) -> list[tuple[int, bool, str]]:
    """(characters, is stuffing by form, words of what is not)."""
    out: list[tuple[int, bool, str]] = []

    def link(m: re.Match) -> str:
        out.append((len(m.group()), True, ""))
        return " \x00 "

    # One link is a reference; links that crowd each other are a list.
    rest = _LINK.sub(link, text)
    if len(out) < RUN_ITEMS:
        out = []
        rest = text
    run: list[tuple[str, list[str]]] = []

    def flush() -> None:
        if not run:
            return
        chars = sum(len(p) for p, _ in run)
        words = [w for _, ws in run for w in ws]
        # Prose in a narrow column also has short lines, but with grammar in them.
        grammar = sum(w in FUNCTION_WORDS for w in words) / max(1, len(words))
        if (len(run) >= RUN_ITEMS and grammar < GRAMMAR + 0.05) or repeated_share(words) >= REPEATED:
            out.append((chars, True, ""))
        else:
            for p, ws in run:
                out.append((len(p), False, " ".join(ws)))
        run.clear()

    for piece in _CUT.split(rest):
        linked = "\x00" in piece
        piece = piece.replace("\x00", " ").strip()
        if not piece.strip(" |:;,-"):
            continue
        words = [w.lower() for w in _WORD.findall(piece)]
        tags = _HASH.findall(piece)
        if len(tags) >= 3 and sum(map(len, tags)) > 0.6 * len(piece):
            flush()
            out.append((len(piece), True, ""))
            continue
        if linked and len(words) <= ITEM_WORDS:
            run.append((piece, words))
            continue
        if _PRICE.search(piece) and len(words) <= ITEM_WORDS and piece[-1:] not in ".;":
            run.append((piece, words))
            continue
        if _is_item(piece, words):
            run.append((piece, words))
            continue
        flush()
        for sent in _SENTENCE.split(piece):
            ws = [w.lower() for w in _WORD.findall(sent)]
            if len(ws) < 4:
                out.append((len(sent), False, ""))
                continue
            commas = re.split(r"[,;|]", sent)
            bare = [c for c in commas if 0 < len(c.split()) <= ITEM_WORDS]
            grammar = sum(w in FUNCTION_WORDS for w in ws) / len(ws)
            listed = len(commas) >= 10 and len(bare) >= 0.9 * len(commas) and grammar < GRAMMAR / 2
            strung = len(ws) >= KEYWORD_STRING and grammar < GRAMMAR / 4
            out.append((len(sent), listed or strung or repeated_share(ws) >= REPEATED, " ".join(ws)))
    flush()
    return out


_SHAPE = "h string, t string, pairs int, key array<long>, lo array<long>, hi array<long>, ahead array<int>, back array<int>, words array<long>, times array<int>"


def _word_hashes(text: str, memo: dict[str, int]) -> np.ndarray:
    out = []
    for w in _LETTERS.findall(text.lower()):
        k = memo.get(w)
        if k is None:
            k = memo[w] = xxhash.xxh64_intdigest(w) - (1 << 63)
        out.append(k)
    return np.array(out, dtype=np.int64)


def neighbour_counts(ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, lo, hi, ahead, back): unordered neighbour pairs with how often lo or hi comes first."""
    a, b = ids[:-REACH], ids[REACH:]
    keep = a != b
    a, b = a[keep], b[keep]
    if not len(a):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    key, first, at = np.unique(lo * _MIX + hi, return_index=True, return_inverse=True)
    ahead = np.bincount(at, weights=a < b, minlength=len(key)).astype(np.int64)
    return key, lo[first], hi[first], ahead, np.bincount(at, minlength=len(key)) - ahead


def _read(batches):
    """Words and neighbours of each text, counted."""
    memo: dict[str, int] = {}
    for b in batches:
        if len(memo) > 500_000:
            memo.clear()
        out = []
        for h, t in zip(b["h"], b["t"]):
            ids = _word_hashes(t, memo)
            key, lo, hi, ahead, back = neighbour_counts(ids)
            words, times = np.unique(ids, return_counts=True)
            out.append((h, t, int(ahead.sum() + back.sum()), key, lo, hi, ahead, back, words, times))
        yield pd.DataFrame(out, columns=["h", "t", "pairs", "key", "lo", "hi", "ahead", "back", "words", "times"])


@F.pandas_udf(T.DoubleType())
def _stuffed_share(text: pd.Series, coherence: pd.Series) -> pd.Series:
    """Share of the characters that is stuffing by form; without grammar counts where the whole text is salad."""
    out = []
    for t, c in zip(text, coherence):
        chars = bad = 0
        for n, form, words in segments_of(t):
            w = words.split()
            chars += n
            bad += n * (form or (c < SALAD and len(w) > SALAD_WORDS and sum(x in FUNCTION_WORDS for x in w) < GRAMMAR * len(w)))
        out.append(bad / max(1, chars))
    return pd.Series(out, dtype="float64")


def neighbour_information(read: DataFrame) -> DataFrame:
    """(key, ahead, back, unit) over all texts: counts of each pair and total / (count(lo) * count(hi))."""
    words = read.select(F.explode(F.arrays_zip("words", "times")).alias("x")).groupBy("x.words").agg(F.sum("x.times").cast("double").alias("n"))
    total = words.agg(F.sum("n").alias("total"))
    pairs = read.select(F.explode(F.arrays_zip("key", "lo", "hi", "ahead", "back")).alias("x")).groupBy("x.key").agg(F.min("x.lo").alias("lo"), F.min("x.hi").alias("hi"), F.sum("x.ahead").alias("ahead"), F.sum("x.back").alias("back"))
    both = pairs.join(words.select(F.col("words").alias("lo"), F.col("n").alias("n1")), "lo").join(words.select(F.col("words").alias("hi"), F.col("n").alias("n2")), "hi")
    return both.crossJoin(F.broadcast(total)).select("key", "ahead", "back", (F.col("total") / (F.col("n1") * F.col("n2"))).alias("unit"))


def text_coherence(read: DataFrame) -> DataFrame:
    """(h, coherence): mean PMI of the neighbours as found less that in reverse order."""
    info, _ = stage(neighbour_information(read), "pmi")
    every = info.agg(F.sum(F.col("ahead") + F.col("back")).alias("every"))
    hot = info.crossJoin(F.broadcast(every)).withColumn("hot", F.col("ahead") + F.col("back") > HOT * F.col("every")).drop("every")
    rows = read.select("h", F.explode(F.arrays_zip("key", "ahead", "back")).alias("x")).select("h", "x.key", F.col("x.ahead").alias("a"), F.col("x.back").alias("b")).filter("a <> b")
    # At most 1 / HOT pairs are hot by definition; the others have no row that many texts wait for.
    few = F.broadcast(hot.filter("hot").drop("hot"))
    near = rows.join(few, "key")
    rest = rows.join(few.select("key"), "key", "left_anti").join(hot.filter("NOT hot").drop("hot"), "key")
    pmi = lambda n, own: F.ln(1 + (F.col(n) - F.col(own)) * F.col("unit"))
    gain = ((F.col("a") - F.col("b")) * (pmi("ahead", "a") - pmi("back", "b"))).alias("gain")
    sums = near.select("h", gain).union(rest.select("h", gain)).groupBy("h").agg(F.sum("gain").alias("gain"))
    return read.select("h", "pairs").join(sums, "h", "left").select("h", F.when(F.col("pairs") > 0, F.coalesce("gain", F.lit(0.0)) / F.col("pairs")).otherwise(F.lit(0.0)).alias("coherence"))


def stuffing_share(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, coherence, share): of each distinct text, by md5, its coherence and the share of characters of stuffed form.

    The form of coherent texts is not looked at; their share is 0.
    """
    texts = docs.select(F.col(text).alias("t")).filter("t IS NOT NULL AND trim(t) <> ''").select(F.md5("t").alias("h"), "t")
    texts = texts.groupBy("h").agg(F.first("t").alias("t"))
    read, _ = stage(texts.mapInPandas(_read, _SHAPE), "neighbours")
    coherence, _ = stage(text_coherence(read), "coherence")
    low = coherence.filter(F.col("coherence") < COHERENCE)
    form = read.select("h", "t").join(low, "h").select("h", "coherence", _stuffed_share("t", "coherence").alias("share"))
    return form.union(coherence.filter(~(F.col("coherence") < COHERENCE)).select("h", "coherence", F.lit(0.0)))


def stuffed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, coherence, share) of the documents that are incoherent and more stuffing than text."""
    bad = stuffing_share(docs, text).filter(F.col("share") > SHARE)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.md5(F.col(text)).alias("h")).dropna().distinct()
    return rows.join(bad, "h").select("doc_id", "coherence", "share")
