"""Values of forms, found by where they stand to their labels.

A page is a list of lines of words with boxes; a line is cut into cells at gaps
wider than a few characters. A label is the longest known label that the first
words of a cell spell, allowing for misread letters. Its value is the rest of
the cell, else the next cell of the line if near, else the cell right below.
Pages are folded one at a time where they are read; no wider group is made, and
words are never shuffled.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.functions import digits

# Labels of common forms with the type of their value.
LABELS = {
    "surname": "PERSON", "family name": "PERSON", "given names": "PERSON", "given name": "PERSON", "first name": "PERSON", "full name": "PERSON", "patient name": "PERSON", "date of birth": "DATE_OF_BIRTH", "dob": "DATE_OF_BIRTH",
    "telephone": "PHONE", "phone": "PHONE", "mobile": "PHONE", "email": "EMAIL", "address": "ADDRESS", "residential address": "ADDRESS", "medicare number": "MEDICARE", "tfn": "TFN", "tax file number": "TFN",
    "claim number": "CLAIM_NUMBER", "passport number": "PASSPORT",
}
_MISREAD = str.maketrans({"0": "o", "1": "l", "5": "s", "|": "l"})
_DATE = re.compile(r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{2}-\d{2}|\d{1,2}\w{0,2} [A-Za-z]{3,9} \d{4}")
MOST_WORDS, FAR, BELOW, LIKE = 8, 260.0, 28.0, 0.88


def label_text(text: str) -> str:
    """A label as it is compared: small letters, misread digits as letters, no outer marks."""
    return re.sub(r"\s+", " ", re.sub(r"[^a-z ]", " ", text.lower().translate(_MISREAD))).strip()


@lru_cache(1 << 15)
def _plain(word: str) -> str:
    return label_text(word)


@lru_cache(16)
def _shapes(labels: tuple[str, ...]) -> tuple[list[tuple[str, int, frozenset[str]]], float]:
    """Labels with their lengths and letters; the length of the longest text that can be alike to one."""
    return [(x, len(x), frozenset(x)) for x in labels], max(map(len, labels), default=0) * (2 / LIKE - 1) + 1


@lru_cache(1 << 15)
def _alike(text: str, labels: tuple[str, ...]) -> str | None:
    """The label most like a text, if they are alike and it has six letters; compared only where lengths and letters allow it."""
    n, chars = len(text), set(text)
    best = (0.0, "")
    for x, m, other in _shapes(labels)[0]:
        if 2.0 * min(n, m) / (n + m) < LIKE or 2.0 * min(n - len(chars - other), m - len(other - chars)) / (n + m) < LIKE:
            continue
        ratio = SequenceMatcher(None, text, x).ratio()
        if ratio >= LIKE:
            best = max(best, (ratio, x))
    return best[1] if len(best[1]) >= 6 else None


def matched_label(words: list[str], labels: dict[str, str] = LABELS) -> tuple[int, str] | None:
    """(words taken, label) of the longest label the first five words spell, alike from six letters on."""
    known = tuple(labels)
    longest, text, texts = _shapes(known)[1], "", []
    for w in words[:5]:
        part = _plain(w)
        text = f"{text} {part}" if text and part else text or part
        if len(text) > longest:
            break
        texts.append(text)
    for k in range(len(texts), 0, -1):
        text = texts[k - 1]
        if text in labels:
            return k, text
        if len(text) >= 6 and (best := _alike(text, known)):
            return k, best
    return None


def valid_value(kind: str, text: str) -> bool:
    """Whether a value can be of a type: shape of dates, numbers and addresses, letters of names."""
    d = digits.only(text)
    if kind == "DATE_OF_BIRTH":
        return bool(_DATE.search(text))
    if kind == "PHONE":
        return 6 <= len(d) <= 12
    if kind == "EMAIL":
        return "@" in text
    if kind in ("MEDICARE", "TFN"):
        return digits.VALID[kind.lower()](text)
    if kind in ("CLAIM_NUMBER", "PASSPORT"):
        return len(d) >= 4
    if kind == "ADDRESS":
        return bool(d) and bool(re.search("[A-Za-z]{3}", text))
    return bool(re.fullmatch(r"[^\d]*[^\W\d_]{2}[^\d]*", text))


# A word: its number, text, box, block, line and offsets.
IDX, TEXT, X0, X1, Y0, BLOCK, LINE, START, END = range(9)
_FIELDS = ("idx", "text", "bbox.x0", "bbox.x1", "bbox.y0", "block", "line", "start_off", "end_off")
_NEEDED = (IDX, TEXT, X0, X1, Y0, START, END)
_VALUES = pa.list_(pa.struct([("start_off", pa.int32()), ("end_off", pa.int32()), ("entity_type", pa.string()), ("label", pa.string()), ("run", pa.int32()), ("confidence", pa.float64())]))


def value_words(lines: list[list[list[tuple]]], hits: list[list[tuple[int, str] | None]], li: int, ci: int, k: int) -> list[tuple]:
    """The words that answer the label of cell ``ci`` of line ``li``, which took ``k`` words; at most eight. ``hits`` has the labels of all cells."""
    cell = lines[li][ci]
    rest = [w for w in cell[k:] if re.search(r"\w", w[TEXT])]
    if rest:
        return rest[:MOST_WORDS]
    right = cell[-1][X1]
    for other, hit in zip(lines[li][ci + 1 :], hits[li][ci + 1 :]):
        if other[0][X0] - right > FAR:
            break
        if not hit:
            return other[:MOST_WORDS]
        break
    for below, found in zip(lines[li + 1 : li + 3], hits[li + 1 : li + 3]):
        for other, hit in zip(below, found):
            near = 0 <= other[0][Y0] - cell[0][Y0] <= BELOW and abs(other[0][X0] - cell[0][X0]) <= 12
            if near and not hit:
                return other[:MOST_WORDS]
    return []


def page_values(words: list[tuple], labels: dict[str, str] = LABELS, gap: float = 2.5) -> list[tuple[int, int, str, str, int]]:
    """(start, end, type, label, run) of the values of one page; words apart in the text make runs of one value."""
    words = sorted((w for w in words if w[TEXT]), key=lambda w: w[IDX])
    if not words:
        return []
    width = sorted([(w[X1] - w[X0]) / len(w[TEXT]) for w in words])[len(words) // 2] or 5.0
    by_line: dict[tuple, list[tuple]] = {}
    for w in words:
        by_line.setdefault((w[BLOCK], w[LINE]), []).append(w)
    lines = []
    for row in by_line.values():
        cells = [[row[0]]]
        for w in row[1:]:
            if w[X0] - cells[-1][-1][X1] > gap * width:
                cells.append([])
            cells[-1].append(w)
        lines.append(cells)
    hits = [[matched_label([w[TEXT] for w in cell[:5]], labels) for cell in cells] for cells in lines]
    out = []
    for li, found in enumerate(hits):
        for ci, hit in enumerate(found):
            if not hit:
                continue
            value = value_words(lines, hits, li, ci, hit[0])
            kind = labels[hit[1]]
            if not value or not valid_value(kind, " ".join(w[TEXT] for w in value)):
                continue
            run = 0
            start = value[0]
            last = value[0]
            for w in value[1:]:
                if w[IDX] != last[IDX] + 1:
                    out.append((start[START], last[END], kind, hit[1], run))
                    run, start = run + 1, w
                last = w
            out.append((start[START], last[END], kind, hit[1], run))
    return sorted(set(out))


def _page_words(lists: list[pa.ListArray]) -> list[list[tuple]]:
    """The words of each row, from one list a field; words without number, text, box or offsets have no place and are passed over."""
    columns, holes = [], False
    for i, x in enumerate(lists):
        flat = x.flatten()
        holes |= bool(flat.null_count) and i in _NEEDED
        columns.append(flat.to_pylist() if flat.null_count else flat.to_numpy(zero_copy_only=False).tolist())
    every, out, at = list(zip(*columns)), [], 0
    for n in lists[0].value_lengths().to_pylist():
        out.append(every[at : at + n])
        at += n
    return [[w for w in ws if all(w[i] is not None for i in _NEEDED)] for ws in out] if holes else out


def form_values(pages: DataFrame, ident: str, at: str | None = None) -> DataFrame:
    """(ident, start_off, end_off, entity_type, label, run, confidence) of pages that carry ``words``; others give nothing.

    Of rows of one ident only the last by ``at`` counts, if given; of those of one
    time the one whose values sort last. Every row is read and the choice is made
    among the values, so that no words move.
    """
    rows = pages.filter("words IS NOT NULL").select(F.col(ident), (F.col(at) if at else F.lit(0)).alias("_at"), *[F.col(f"words.{x}").alias(f"_w{i}") for i, x in enumerate(_FIELDS)])

    def read(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                values = [[(*v, 0.65 if v[2] == "PERSON" else 0.85) for v in page_values(ws)] for ws in _page_words(b.columns[2:])]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(values, _VALUES)], [ident, "_at", "_v"])

    kind = {c: rows.schema[c].dataType.simpleString() for c in (ident, "_at")}
    read_rows = rows.mapInArrow(read, f"`{ident}` {kind[ident]}, _at {kind['_at']}, _v array<struct<start_off:int,end_off:int,entity_type:string,label:string,run:int,confidence:double>>")
    if at is None:
        return read_rows.select(ident, F.explode("_v").alias("_v")).select(ident, "_v.*").distinct()
    last = read_rows.groupBy(ident).agg(F.max(F.struct("_at", "_v")).alias("_r"))
    return last.select(ident, F.explode("_r._v").alias("_v")).select(ident, "_v.*")


def with_form_values(kept: DataFrame, values: DataFrame, key: list[str]) -> DataFrame:
    """Detected spans and form values: a value gives way to a span of tier 3 or more it meets, else takes the place of what it meets."""
    on = lambda a, b: [a[k].eqNullSafe(b[k]) for k in key] + [(a["start_off"] < b["end_off"]) & (b["start_off"] < a["end_off"])]
    strong = kept.filter("tier >= 3")
    new = values.join(strong, on(values, strong), "left_anti").select(*key, "start_off", "end_off", "entity_type", F.concat(F.lit("kv:"), F.col("label")).alias("rule"), F.lit(2).alias("tier"))
    old = kept.select(*key, "start_off", "end_off", "entity_type", "rule", "tier")
    return old.join(new, on(old, new), "left_anti").union(new)
