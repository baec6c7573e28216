"""Evaluation passages inside a training corpus.

Method: prefix-filtered set join. Words are compared in their consistent form,
lower case, without punctuation. Of every window of ``MIN_WORDS`` item words at
most one word in ten may differ, so at least ``needed`` of its five-word
shingles survive whole. Shingles are ordered by rarity over all documents; a
document that holds a window must hold one of the window's rarest
``shingles - needed + 1`` (its prefix). One pass over the texts writes the item
shingles each document holds, where they stand, and its words as numbers; texts
with fewer item shingles than a window needs leave no row. What was written gives
the rarity of every shingle and is joined with the prefixes; then a length bound
(enough surviving shingles inside one window) and a positional bound (the words
of the document span they point at) leave few pairs, which are verified exactly
with a bit-parallel edit distance over words.

Items are the stated query set: they are sent to the tasks in blocks of at most
``BLOCK_WORDS`` words, each block against all rows. Documents are never joined
with each other. How many documents hold a shingle orders the prefixes and
decides nothing else, so a passage is found however often it was copied. Stock
phrases make no case because they are shorter than a window less the words that
may differ; one of that length or more would count as a passage.

Null texts hold nothing; an empty table gives an empty result; repeated rows
count once. Items under ``MIN_WORDS`` words must be held whole (one word in ten
may differ); items under ``SHINGLE`` words never lead to a case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.llm.glyphs import settle_text
from maskwell.runtime import stage

SHINGLE = 5
MIN_WORDS = 30
BLOCK_WORDS = 1_000_000

_WORDS = re.compile(r"[^\W_]+")
_APOSTROPHE = re.compile(r"(?<=\w)['’ʼ](?=\w)")


def words_of(text: str) -> list[str]:
    """Comparable words of a text."""
    if not text.isascii():
        text = settle_text(text)
    if "'" in text or not text.isascii():
        text = _APOSTROPHE.sub("", text)
    return _WORDS.findall(text.casefold())


def shingles_of(words: list) -> list[tuple]:
    return [tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


def allowed(n: int) -> int:
    return n // 10


def needed(n: int) -> int:
    """Five-word shingles of an n-word window that survive the allowed changes."""
    return max(1, n - SHINGLE + 1 - SHINGLE * allowed(n))


def within(pattern: list, text: list, most: int) -> bool:
    """Whether a substring of ``text`` is within ``most`` word edits of ``pattern``."""
    m = len(pattern)
    peq: dict = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | (1 << i)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score <= most:
            return True
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
    return False


class Items:
    """The words and shingles of a block of items, as numbers."""

    def __init__(self, rows: list[tuple]):
        self.vocabulary: dict[str, int] = {}
        self.shingles: dict[tuple, int] = {}
        self.words: dict[int, list[int]] = {}
        self.where: dict[int, dict[int, list[int]]] = {}
        self.ids: list = []
        number = self.vocabulary.setdefault
        for ident, text in rows:
            words = [number(w, len(self.vocabulary)) for w in words_of(text)]
            if len(words) < SHINGLE:
                continue
            item = len(self.ids)
            self.ids.append(ident)
            self.words[item] = words
            at = self.where.setdefault(item, {})
            for i, s in enumerate(shingles_of(words)):
                at.setdefault(self.shingles.setdefault(s, len(self.shingles)), []).append(i)
        #: The fewest item shingles of a text that holds any item of the block.
        self.least = min((needed(min(MIN_WORDS, len(w))) for w in self.words.values()), default=1)
        self.prefix: dict[int, list[int]] = {}

    def read(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """(words as numbers, -1 for words of no item; item shingles; their places)."""
        known = self.vocabulary.get
        words = [known(w, -1) for w in words_of(text)]
        found, at, run = [], [], 0
        get = self.shingles.get
        for i, w in enumerate(words):
            run = run + 1 if w >= 0 else 0
            if run >= SHINGLE:
                s = get(tuple(words[i - SHINGLE + 1 : i + 1]))
                if s is not None:
                    found.append(s)
                    at.append(i - SHINGLE + 1)
        return words, found, at

    def order(self, df: dict[int, int]) -> None:
        """Choose the prefix of every window: its rarest shingles by ``df``, documents each stands in."""
        lead: dict[int, set[int]] = {}
        for item, words in self.words.items():
            place = {i: s for s, at in self.where[item].items() for i in at}
            n = min(MIN_WORDS, len(words))
            per = n - SHINGLE + 1
            keep = per - needed(n) + 1
            for p in range(len(words) - n + 1):
                for s in sorted((place[i] for i in range(p, p + per)), key=lambda s: (df.get(s, 0), s))[:keep]:
                    lead.setdefault(s, set()).add(item)
        self.prefix = {s: sorted(v) for s, v in lead.items()}

    def held(self, words: list[int], found: list[int], places: list[int]) -> list:
        """Items whose passage, or a long stretch of it, stands in ``words``."""
        at: dict[int, list[int]] = {}
        for s, d in zip(found, places):
            at.setdefault(s, []).append(d)
        leads = {item for s in at if s in self.prefix for item in self.prefix[s]}
        return sorted(self.ids[item] for item in leads if self._stands(item, words, at))

    def _stands(self, item: int, words: list[int], at: dict[int, list[int]]) -> bool:
        mine = self.words[item]
        size = min(MIN_WORDS, len(mine))
        where = self.where[item]
        both = where.keys() & at.keys()
        if sum(len(where[s]) for s in both) < needed(size):
            return False
        hits = sorted((i, d) for s in both for i in where[s] for d in at[s])
        count = [0] * (len(mine) + 1)
        for i, _ in hits:
            count[i + 1] = 1
        for i in range(len(mine)):
            count[i + 1] += count[i]
        while True:
            least = needed(size)
            for p in range(len(mine) - size + 1):
                e = p + size - SHINGLE + 1
                if count[e] - count[p] < least:
                    continue
                # Positional bound: matches of one copy lie near one diagonal.
                shifts = [h[1] - h[0] for h in hits if p <= h[0] < e]
                part = mine[p : p + size]
                for a, b in self._spans(shifts, p, size, len(words)):
                    span = words[a:b]
                    # Every word the span lacks is an edit.
                    if len(part) - sum(map(set(span).__contains__, part)) <= allowed(size) and within(part, span, allowed(size)):
                        return True
            if size == len(mine) or count[-1] < needed(size + 10):
                return False
            size = min(size + 10, len(mine))

    @staticmethod
    def _spans(shifts: list[int], p: int, size: int, n: int) -> list[tuple[int, int]]:
        slack = allowed(size) + 1
        out: list[tuple[int, int]] = []
        for s in sorted(set(shifts)):
            a, b = max(0, p + s - 2 * slack), min(n, p + s + size + 2 * slack)
            if out and a <= out[-1][0] + 2 * slack:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out


def _blocks(items: DataFrame, ident: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks that are safe to send to every task."""
    block, n = [], 0
    for r in items.select(ident, text).dropna().distinct().orderBy(ident, text).toLocalIterator():
        size = r[1].count(" ") + 1
        if block and n + size > BLOCK_WORDS:
            yield block
            block, n = [], 0
        block.append((r[0], r[1]))
        n += size
    if block:
        yield block


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id), distinct, for every document that holds an item."""
    spark = docs.sparkSession
    corpus = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("t")).dropna()
    kind_d, kind_i = docs.schema[doc_id].dataType, items.schema[item_id].dataType
    out_schema = T.StructType([T.StructField("doc_id", kind_d), T.StructField("item_id", kind_i)])
    held_schema = T.StructType([T.StructField("doc", kind_d), *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("words", "found", "places")]])
    result = spark.createDataFrame([], out_schema)
    for block in _blocks(items, item_id, item_text):
        own = Items(block)
        shared = spark.sparkContext.broadcast(own)

        def read(batches, shared=shared):
            own = shared.value
            for b in batches:
                out = []
                for doc, t in zip(b["doc"], b["t"]):
                    words, found, places = own.read(t)
                    if len(found) >= own.least:
                        out.append((doc, words, found, places))
                if out:
                    yield pd.DataFrame(out, columns=["doc", "words", "found", "places"])

        held, _ = stage(corpus.mapInPandas(read, held_schema), "held")
        counts = held.select(F.explode(F.array_distinct("found")).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
        # At most one row per shingle of the block, so BLOCK_WORDS rows.
        own.order({r["s"]: r["n"] for r in counts.toLocalIterator()})
        ordered = spark.sparkContext.broadcast(own)

        def find(batches, ordered=ordered):
            own = ordered.value
            for b in batches:
                out = [(doc, item) for doc, w, f, p in zip(b["doc"], b["words"], b["found"], b["places"]) for item in own.held(w.tolist(), f.tolist(), p.tolist())]
                if out:
                    yield pd.DataFrame(out, columns=["doc_id", "item_id"])

        result = result.union(held.mapInPandas(find, out_schema))
    return result.distinct()
