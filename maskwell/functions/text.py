"""Text functions that need Python, in Arrow batches, and the plain functions behind them."""

from __future__ import annotations

import json
import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def folded(text: str | None, casefold: bool = True) -> str | None:
    """NFKC, single blanks, and without case where asked; null stays null."""
    if text is None:
        return None
    out = " ".join(unicodedata.normalize("NFKC", text).split())
    return out.casefold() if casefold else out


def normalised(col: Column | str, casefold: bool = True) -> Column:
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: folded(t, casefold), na_action="ignore")

    return run(F.col(col) if isinstance(col, str) else col)


def code_point_offset(text: str, utf16: int) -> int:
    """The code-point offset of a UTF-16 offset; one inside a pair counts as before the character."""
    seen = 0
    for i, ch in enumerate(text):
        width = 2 if ord(ch) > 0xFFFF else 1
        if seen + width > utf16:
            return i
        seen += width
    return len(text)


@F.pandas_udf(T.IntegerType())
def from_utf16(text: pd.Series, offset: pd.Series) -> pd.Series:
    """Code-point offsets of UTF-16 offsets; null where either is null."""
    return pd.Series([None if t is None or pd.isna(o) else code_point_offset(t, int(o)) for t, o in zip(text, offset)], dtype="Int32")


def sentence_bounds(text: Column | str, at: Column | str) -> Column:
    """struct(start, end) of the sentence a position stands in: after the last . ! ? or line end before it, up to the next."""
    t, p = (F.col(c) if isinstance(c, str) else c for c in (text, at))
    head = F.substring(t, F.lit(1), p)
    start = F.length(head) - F.length(F.regexp_extract(head, r"([^.!?\n]*)\z", 1))
    tail = F.regexp_extract(F.substring(t, p + 1, F.length(t)), r"^([^.!?\n]*[.!?]?)", 1)
    return F.struct(start.alias("start"), (p + F.length(tail)).alias("end"))


def stands_alone(text: str, a: int, b: int) -> bool:
    """Whether neither neighbour of a span goes on with the word it ends with."""
    left = a > 0 and (text[a - 1].isalnum() or text[a - 1] == "_") and text[a : a + 1].isalnum()
    right = b < len(text) and (text[b].isalnum() or text[b] == "_") and text[b - 1 : b].isalnum()
    return not left and not right


def located(text: str, surface: str, line: int | None = None, occurrence: int = 1, every: bool = False) -> list[tuple[int, int]]:
    """Spans of a surface that stand alone, on one line (from 0) or anywhere; the n-th of them or all."""
    if not surface:
        return []
    lo, hi = 0, len(text)
    if line is not None:
        lines = text.split("\n")
        if not 0 <= line < len(lines):
            return []
        lo = sum(len(x) + 1 for x in lines[:line])
        hi = lo + len(lines[line])
    hits, at = [], text.find(surface, lo, hi)
    while at >= 0:
        if stands_alone(text, at, at + len(surface)):
            hits.append((at, at + len(surface)))
        at = text.find(surface, at + 1, hi)
    return hits if every else hits[occurrence - 1 : occurrence]


def canonical(obj, digits: int = 4):
    """Plain data with floats rounded, no minus zero, sets as sorted lists; not-a-number fails."""
    if isinstance(obj, float):
        if not math.isfinite(obj):
            raise ValueError("no canonical form of a number that is not finite")
        return round(obj, digits) + 0.0
    if isinstance(obj, dict):
        return {str(k): canonical(v, digits) for k, v in obj.items()}
    if isinstance(obj, (set, frozenset)):
        return sorted((canonical(v, digits) for v in obj), key=lambda v: json.dumps(v, sort_keys=True))
    return [canonical(v, digits) for v in obj] if isinstance(obj, (list, tuple)) else obj


def canonical_json(obj) -> str:
    """JSON with sorted keys and no blanks, so that equal data give equal text."""
    return json.dumps(canonical(obj), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


_DIGEST = re.compile(r"[0-9a-f]{40,}")


def string_values(obj) -> list[str]:
    """All strings of a document in order, except digests."""
    if isinstance(obj, str):
        return [] if _DIGEST.fullmatch(obj) else [obj]
    if isinstance(obj, dict):
        return [s for k in sorted(obj) for s in string_values(obj[k])]
    return [s for v in obj for s in string_values(v)] if isinstance(obj, list) else []


@F.pandas_udf(T.StringType())
def json_strings(body: pd.Series) -> pd.Series:
    """The strings of JSON documents, one a line, for leak scans of artifacts; malformed ones fail."""
    return body.map(lambda b: "\n".join(string_values(json.loads(b))), na_action="ignore")
