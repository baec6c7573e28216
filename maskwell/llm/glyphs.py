"""One consistent form for text that looks the same.

Method: characters whose normalisation quick-check is not YES, or that have a
look-alike, invisible or blank role, mark *unstable* segments. Each segment is
widened to the letters around it (the boundary context a composition or a
mixed-script decision needs), normalised alone and spliced back. Text outside
the segments is never touched, and ASCII text is returned as it is.

The form folds full-width and joined letters, composed and decomposed accents,
kinds of blank, invisible characters, and letters of another script with the
same shape. Case, accents, punctuation, line breaks and ASCII stay distinct, and so do circled,
raised, lowered and squared characters, which are seen to differ.
Null stays null and the empty text stays empty.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.runtime import stage

# Letters of other scripts with the shape of a Latin letter.
CYRILLIC_SHAPES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "ԝ": "w", "х": "x", "у": "y", "ү": "y", "ѵ": "v", "ɡ": "g",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ѵ": "V", "Ӏ": "I",
}
GREEK_SHAPES = {
    "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "υ": "u", "κ": "k", "χ": "x", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ϲ": "c", "Ϲ": "C", "ϳ": "j",
}
ARMENIAN_SHAPES = {"օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "Օ": "O", "Ս": "U", "Լ": "L"}
# Code point ranges that show nothing.
INVISIBLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xE0001, 0xE007F),
]

TO_LATIN = {**CYRILLIC_SHAPES, **GREEK_SHAPES, **ARMENIAN_SHAPES}


def _to_script(shapes: dict[str, str]) -> dict[int, str]:
    back: dict[int, str] = {}
    for foreign, latin in shapes.items():
        back.setdefault(ord(latin), foreign)
    return back


def _char_class(points: set[int]) -> str:
    """The inside of a character class, runs written as ranges."""
    out, run = [], []
    for c in [*sorted(points), -1]:
        if run and c != run[-1] + 1:
            out.append(re.escape(chr(run[0])) + (f"-{re.escape(chr(run[-1]))}" if len(run) > 1 else ""))
            run = []
        run.append(c)
    return "".join(out)


def _marked_points() -> Iterator[int]:
    """All code points from U+00A0 on, less blocks of 256 without a decomposition, a combining mark or a blank."""
    for block in range(0, sys.maxunicode + 1, 256):
        if 0xD800 <= block < 0xE000:
            continue
        # After the mark of the highest class any other mark is out of order.
        probe = np.stack([np.full(256, 0x345, "<u4"), np.arange(block, block + 256, dtype="<u4")], axis=1).tobytes().decode("utf-32-le")
        if not unicodedata.is_normalized("NFKD", probe) or len(probe.split()) > 1:
            yield from range(max(block, 0xA0), block + 256)


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[int, str], re.Pattern, dict[str, dict[int, str]]]:
    """(single-character folds, unstable character class, Latin to script)."""
    fold: dict[int, str] = {}
    unstable: list[int] = [ord(c) for c in TO_LATIN]
    for a, b in INVISIBLE:
        fold.update(dict.fromkeys(range(a, b + 1), ""))
    for cp in _marked_points():
        ch = chr(cp)
        if cp in fold:
            continue
        parts = unicodedata.decomposition(ch)
        if not parts:
            if unicodedata.combining(ch):
                unstable.append(cp)
            elif unicodedata.category(ch) == "Zs":
                fold[cp] = " "
            continue
        if unicodedata.category(ch) == "Zs":
            fold[cp] = " "
        elif parts.startswith(("<wide>", "<narrow>", "<font>")):
            fold[cp] = unicodedata.normalize("NFKC", ch)
        elif parts.startswith("<compat>"):
            whole = unicodedata.normalize("NFKC", ch)
            if len(whole) > 1 and whole.isalpha():
                fold[cp] = whole
        elif parts[0] != "<":
            if unicodedata.combining(ch) or not unicodedata.is_normalized("NFC", ch):
                unstable.append(cp)
            elif unicodedata.normalize("NFD", ch)[0] in TO_LATIN:
                unstable.append(cp)
            # Quick-check MAYBE: what a composition ends in, also if it has no combining class.
            last = int(parts.split()[-1], 16)
            if last > 0x7F:
                unstable.append(last)
    unstable += [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]
    # A narrow form may stand for what shows nothing.
    fold = {cp: w.translate(fold) for cp, w in fold.items()}
    unstable += fold
    cls = _char_class(set(unstable))
    back = {"CYRILLIC": _to_script(CYRILLIC_SHAPES), "GREEK": _to_script(GREEK_SHAPES), "ARMENIAN": _to_script(ARMENIAN_SHAPES)}
    return fold, re.compile(f"[{cls}]+"), back


_TAIL = re.compile(r"[^\W\d_]*")
_LETTERS = re.compile("(?:[^\\W\\d_][\u0300-\u036f]*)+")
_LATIN_SHAPE = str.maketrans(TO_LATIN)


def _script(ch: str) -> str:
    name = unicodedata.name(ch, "")
    return name.split(" ", 1)[0]


def _one_script(m: re.Match) -> str:
    """Write a run of letters in one script: Latin if it can be, else its own."""
    run = m.group()
    if run.isascii():
        return run
    latin = run.translate(_LATIN_SHAPE)
    own = [_script(c) for c in latin if not c.isascii() and not unicodedata.combining(c)]
    own = [s for s in own if s in ("CYRILLIC", "GREEK", "ARMENIAN")]
    if not own:
        return latin
    return latin.translate(_tables()[2][own[0]])


def _settle(segment: str) -> str:
    fold = _tables()[0]
    # A soft hyphen shows at a line end, so it stays there.
    plain = segment.replace("\u00ad\n", "\ue000\n").translate(fold).replace("\ue000", "\u00ad")
    if plain.isascii():
        return plain
    parts = unicodedata.normalize("NFD", plain)
    return unicodedata.normalize("NFC", _LETTERS.sub(_one_script, parts))


def settle_text(text: str | None) -> str | None:
    """The consistent form of one text."""
    if text is None or text.isascii():
        return text
    unstable = _tables()[1]
    out, done = [], 0
    n = len(text)
    for m in unstable.finditer(text):
        if m.start() < done:
            continue
        a, b = m.span()
        while a > done and (text[a - 1].isalpha() or unicodedata.combining(text[a - 1])):
            a -= 1
        # The character a composition may start with need not be a letter.
        if a > done and not text[a - 1].isascii():
            a -= 1
        while b < n:
            e = _TAIL.match(text, b).end()
            more = unstable.match(text, e)
            if more:
                e = more.end()
            if e == b:
                break
            b = e
        if b < n and text[b] == "\n":
            b += 1
        out.append(text[done:a])
        out.append(_settle(text[a:b]))
        done = b
    out.append(text[done:])
    return "".join(out)


@F.pandas_udf(T.StringType())
def _settled(s: pd.Series) -> pd.Series:
    return s.map(settle_text, na_action="ignore")


def settled(col: Column | str) -> Column:
    """Column in its consistent form; null stays null."""
    return _settled(col)


def consistent_text(df: DataFrame, text: str = "text", out: str = "consistent_text") -> DataFrame:
    """``df`` with ``out`` added: the one form of ``text``. Other columns stay."""
    return df.withColumn(out, settled(F.col(text)))


def same_look_pairs(df: DataFrame, group: list[str], ident: str, text: str) -> DataFrame:
    """Pairs of ids within ``group`` whose texts look the same but differ.

    Result: group columns, id_a < id_b (compared as strings). Rows with a null
    group column, id or text take no part; repeated rows count once. Copies of a
    text are joined only through pairs of *variants*, so a heavily repeated text
    costs no more than the pairs it really has.
    """
    g = [F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]
    keys = [f"_g{i}" for i in range(len(group))]
    rows = df.select(*g, F.col(ident).cast("string").alias("_id"), F.col(text).alias("_t")).dropna()
    rows = rows.select(*keys, "_id", F.md5("_t").alias("_h"), F.md5(settled("_t")).alias("_c")).distinct()
    # Read four times below; the Python stage before it must run once.
    rows, _ = stage(rows, "looks")
    mixed = (
        rows.groupBy(*keys, "_c").agg(F.min("_h").alias("_lo"), F.max("_h").alias("_hi")).filter("_lo <> _hi").select(*keys, "_c")
    )
    rows = rows.join(mixed, [*keys, "_c"], "left_semi")
    kinds = rows.select(*keys, "_c", "_h").distinct()
    pairs = kinds.withColumnRenamed("_h", "_ha").join(kinds.withColumnRenamed("_h", "_hb"), [*keys, "_c"]).filter("_ha < _hb")
    left = rows.select(*keys, "_c", F.col("_h").alias("_ha"), F.col("_id").alias("_ia"))
    right = rows.select(*keys, "_c", F.col("_h").alias("_hb"), F.col("_id").alias("_ib"))
    both = pairs.join(left, [*keys, "_c", "_ha"]).join(right, [*keys, "_c", "_hb"]).filter("_ia <> _ib")
    return both.select(
        *[F.col(k).alias(c) for k, c in zip(keys, group)],
        F.least("_ia", "_ib").alias("id_a"),
        F.greatest("_ia", "_ib").alias("id_b"),
    ).distinct()
