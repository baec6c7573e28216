"""Noise in text from scanned pages.

Method. A frequency lexicon is counted over all pages (words of scanned and of
typed pages apart). Every lexicon word is indexed under its *shape*, in which
characters and pairs a scanner confuses fall together, and under the shape's
single-character deletes (symmetric delete). Words that meet in the index are
compared with a weighted edit distance whose only cheap steps are confusion
pairs; a rare word that a much more frequent one explains is a misreading,
unless typed pages attest it. Among several repairs the word before and the
word after decide (bigram counts). Digits inside letters, and letters that
stand for digits inside numbers, are misreadings of themselves.

Line hyphens are judged by the lexicon: the joined word against the hyphenated
one. Running lines are edge lines that recur on other pages of the document,
lines whose opening or closing words do so in other documents, and page marks.

A null or empty text gives no rows; rows that repeat a page give its cases
once; words null or missing make no difference, as the text is what is read.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.llm.glyphs import settle_text
from maskwell.runtime import stage

# Fixed values: (seen on the scan, meant), the usual confusions of optical recognition.
CONFUSIONS = [
    ("c", "e"), ("e", "c"), ("!", "i"), ("l", "i"), ("i", "l"), ("1", "l"), ("1", "i"), ("f", "t"), ("t", "f"), ("5", "s"),
    ("o", "a"), ("a", "o"), ("0", "o"), ("9", "g"), ("b", "h"), ("h", "b"), ("6", "b"), ("v", "y"), ("y", "v"),
    ("ri", "n"), ("n", "ri"), ("cl", "d"), ("d", "cl"), ("rn", "m"), ("m", "rn"), ("ii", "u"), ("u", "ii"), ("vv", "w"),
    ("h", "ti"), ("li", "h"), ("8", "b"), ("4", "a"), ("3", "e"), ("2", "z"), ("7", "t"), ("|", "l"), ("|", "i"), ("q", "g"), ("g", "q"),
]
#: How many more times the meant word must occur than the misread one.
RATIO = 3.0
LEAST = 3
#: A word on typed pages at least twice and this often, per word read, is no misreading.
ATTESTED = 0.3
MOST_STEPS = 3
#: The most frequent words, which need no look-up; a bound on what is sent to the tasks.
COMMON = 20_000
SAME_SHARE = 0.3
SAME_LEAST = 3

_FOLD = str.maketrans({"c": "e", "!": "i", "l": "i", "1": "i", "|": "i", "5": "s", "0": "a", "o": "a", "9": "g", "q": "g", "b": "h", "6": "h", "8": "h", "v": "y", "f": "t", "7": "t", "4": "a", "3": "e", "2": "z"})
_HYPHENS = "-‐‑¬­"
_EDGE = " .,;:?()[]{}\"'“”‘’«»<>*•…"
_WORD = re.compile(r"(?=.*[a-zà-öø-ÿğı])[a-zà-öø-ÿğı0-9!|'’\-]{2,}$")
_LETTERED = re.compile(r"^[A-Za-zÀ-ÖØ-öø-ÿğı'’\-0-9!|]+$")
_ORDINAL = re.compile(r"^\d+(?:st|nd|rd|th|ST|ND|RD|TH|am|pm|AM|PM|mg|ml|kg|cm|mm|km|hrs?|yrs?|x|s|k|m|g|h)$")
_NUMBER = re.compile(r"^(?=.*\d)[$(+]?(?:[A-Z]{1,3}(?=\d))?[\dOolISBZ|]+(?:[./,:\-][\dOolISBZ|]+)*[A-Z]?$")
_PAGE_MARK = re.compile(
    r"^[\s\-–—\[(|]*(?:p[aou]g[ecs]s?\.?\s*|p[.,]\s*)?(?:[\dOolISB|!]{1,3}|[ivxl!1]{1,6})(?:\s*(?:/|[o0]f|0f)\s*[\dOolISB|!]{1,3})?[\s\-–—\])|]*$", re.I
)
_TAIL_MARK = re.compile(
    r"(?:\s+|^)(?:[-–\[(]\s*[\dOolIi|!]{1,4}\s*[-–\])]|p[aou]g[ec]\s+[\dOolISB|!]{1,4}(?:\s+[o0]f\s+[\dOolISB|!]{1,4})?|p[.,]\s*[\dOolISB|!]{1,4}|[\dOolISB|!]{1,3}/[\dOolISB|!]{1,3}|[\dl|]{1,3}|[ivx!l]{1,5})$",
    re.I,
)
_CLOSING = re.compile(r"^\W*(yours|signed|singed|sincerely|faithfully|kind regards|regards|with thanks|[a-z]+ regards)\b", re.I)
_OPENING = re.compile(r"^\W*(re|dear|to|attention|attn|cc|from|subject)\b\s*[:,]?", re.I)


@lru_cache(maxsize=300_000)
def shapes(w: str) -> tuple[str, ...]:
    """Shape keys: confusable characters folded, pairs merged in two orders."""
    s = w.translate(_FOLD)
    out = []
    for order in (("ei", "d"), ("rn", "m"), ("ri", "n"), ("yy", "w"), ("ti", "h"), ("ii", "u")), (("ii", "u"), ("ti", "h"), ("ri", "n"), ("rn", "m"), ("yy", "w"), ("ei", "d")):
        t = s
        for a, b in order:
            t = t.replace(a, b)
        out.append(t)
    return tuple(dict.fromkeys(out))


def index_keys(w: str) -> list[str]:
    keys = set(shapes(w))
    for s in shapes(w):
        if len(s) > 4:
            keys.update(s[:i] + s[i + 1 :] for i in range(len(s)))
    return sorted(keys)


def misread_steps(seen: str, meant: str) -> int:
    """Confusions that turn ``meant`` into ``seen``; MOST_STEPS + 1 if none do."""
    reach = {(0, 0): 0}
    order = [(0, 0)]
    best = MOST_STEPS + 1
    while order:
        i, j = order.pop()
        k = reach[i, j]
        if i == len(seen) and j == len(meant):
            best = min(best, k)
            continue
        steps = []
        if i < len(seen) and j < len(meant) and seen[i] == meant[j]:
            steps.append((i + 1, j + 1, k))
        if k < min(best - 1, MOST_STEPS):
            for a, b in CONFUSIONS:
                if seen.startswith(a, i) and meant.startswith(b, j):
                    steps.append((i + len(a), j + len(b), k + 1))
        for a, b, c in steps:
            if c < reach.get((a, b), 99):
                reach[a, b] = c
                order.append((a, b))
    return best


def core_of(token: str) -> str:
    """The word inside its punctuation, case kept; a leading or inner ! stays."""
    t = token.strip(_EDGE)
    t = re.sub(r"(?<=\w)!+$", "", t) if t.count("!") == 1 and len(t) > 3 else t
    if t[-2:] in ("'s", "’s"):
        t = t[:-2]
    return t.strip(_EDGE + "-")


def odd_digits(core: str) -> bool:
    """Digits or marks inside a word, or letters for digits inside a number."""
    if len(core) < 2 or "@" in core:
        return False
    if _NUMBER.match(core):
        if re.fullmatch(r"O\d{2,3}|S\d\d", core):
            return True
        body = re.sub(r"^[$(+]?[A-Z]{1,3}(?=\d)", "", core)
        if not re.search(r"[OolISBZ|]", body):
            return False
        if re.fullmatch(r"\d{1,3}[ABZI]", body) or _ORDINAL.match(body):
            return False
        return bool(re.search(r"\d", body)) and sum(ch.isdigit() for ch in body) >= sum(ch.isalpha() for ch in body)
    if not _LETTERED.match(core) or _ORDINAL.match(core):
        return False
    if re.search(r"(?<![A-Za-z])[A-Z]{1,4}\d+$", core):
        return False
    if re.fullmatch(r"[^\W\d_]{3,}\d{2,}", core):
        return False
    letters = sum(ch.isalpha() for ch in core)
    marks = sum(ch.isdigit() or ch in "!|" for ch in core)
    low = sum(ch.islower() for ch in core)
    if not marks or letters < 2 or marks > letters:
        return False
    if core.isupper() or low == 0:
        return bool(re.search(r"[A-Z][015!|][A-Z]", core)) and letters >= 4
    return low >= 1 and letters >= marks


def stem_of(line: str) -> str:
    """Shape of a running line without its page mark."""
    s = settle_text(line).strip()
    s = _TAIL_MARK.sub("", s).strip()
    return " ".join("9" if w.isdigit() else shapes(w)[0] for w in re.findall(r"[^\W_]+", s.lower()))


def _lexicon_rows(batches):
    """Count whole tokens first; the word inside is looked for once per distinct token."""
    typed, scanned = Counter(), Counter()
    for b in batches:
        for method, text in zip(b["method"], b["text"]):
            (scanned if method in ("ocr", "hybrid") else typed).update(text.split())
        if len(typed) + len(scanned) > 400_000:
            yield from _counted(typed, scanned)
            typed, scanned = Counter(), Counter()
    yield from _counted(typed, scanned)


def _counted(typed: Counter, scanned: Counter):
    total: dict[str, list[int]] = {}
    for which, tokens in enumerate((typed, scanned)):
        for t, n in tokens.items():
            w = core_of(settle_text(t)).lower()
            if len(w) >= 2 and _WORD.match(w):
                total.setdefault(w, [0, 0])[which] += n
    if total:
        yield pd.DataFrame({"w": list(total), "typed": [v[0] for v in total.values()], "scanned": [v[1] for v in total.values()]})


def lexicon(pages: DataFrame) -> DataFrame:
    """(w, typed, scanned): occurrences over all pages, pre-aggregated per task."""
    return (
        pages.select("method", "text").mapInPandas(_lexicon_rows, "w string, typed long, scanned long").groupBy("w").agg(F.sum("typed").alias("typed"), F.sum("scanned").alias("scanned"))
    )


def _indexed(words: DataFrame) -> DataFrame:
    """(w, n, k): every key of every word of (w, n)."""

    def rows(batches):
        for b in batches:
            out = [(w, n, k) for w, n in zip(b["w"], b["n"]) for k in index_keys(w)]
            if out:
                yield pd.DataFrame(out, columns=["w", "n", "k"])

    return words.mapInPandas(rows, "w string, n long, k string")


@F.pandas_udf(T.IntegerType())
def _steps(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([misread_steps(x, y) for x, y in zip(a, b)], dtype="int32")


def repairs(lex: DataFrame) -> DataFrame:
    """(w, repair, steps, weight): misread words and what may repair them.

    Buckets hold the few words of one shape; only words occurring on scanned
    pages look for a repair.
    """
    total = F.col("typed") + F.col("scanned")
    sums = lex.agg(F.sum("typed").alias("tt"), F.sum("scanned").alias("ts"))
    plain = lex.crossJoin(F.broadcast(sums)).filter(F.length("w") >= 3).select("w", "typed", "scanned", total.alias("n"), (F.col("ts") / F.greatest("tt", F.lit(1))).alias("per"))
    doubt = plain.filter("scanned > 0").filter((F.col("typed") < 2) | (F.col("typed") * F.col("per") < ATTESTED * F.col("scanned")) | F.col("w").rlike(r"[0-9!|]"))
    probe = _indexed(doubt.select("w", "n"))
    index = plain.filter(F.col("n") >= LEAST).filter(~F.col("w").rlike(r"[0-9!|]")).select("w", "n")
    index = _indexed(index).select(F.col("w").alias("c"), F.col("n").alias("nc"), "k")
    pairs = probe.join(index, "k").filter((F.col("w") != F.col("c")) & (F.col("nc") >= F.greatest(F.lit(LEAST), RATIO * F.col("n")))).select("w", "n", "c", "nc").distinct()
    pairs = pairs.withColumn("steps", _steps("w", "c")).filter(F.col("steps") <= MOST_STEPS)
    return pairs.select("w", F.col("c").alias("repair"), "steps", (F.ln("nc") - 2.0 * F.col("steps")).alias("weight"))


def read_page(text: str, common: frozenset, memo: dict) -> list[tuple]:
    """Flat rows (kind, line, pos, s, s2, yes, mark) of one page.

    Kind r: rare word s at pos, s2 its neighbours, yes if it holds odd digits; b: line break with a
    hyphen, s joined, s2 dashed, yes if it goes on in upper case; e: edge line,
    s its stem, yes at the top, mark if a bare page mark.
    """
    raw = text.split("\n")
    lines = raw if text.isascii() else [settle_text(x) for x in raw]
    rows: list[tuple] = []
    pos = 0
    halves = {no for no in range(len(raw) - 1) if len(raw[no].rstrip()) > 1 and raw[no].rstrip()[-1] in _HYPHENS and raw[no].rstrip()[-2].isalpha()}
    for no, line in enumerate(raw):
        toks = line.split()
        for i, t in enumerate(toks):
            known = memo.get(t)
            if known is None:
                core = core_of(settle_text(t))
                w = core.lower()
                odd = odd_digits(core)
                known = (w, odd) if odd or (w not in common and len(w) >= 3 and _WORD.match(w)) else ()
                memo[t] = known
            if not known:
                continue
            w, odd = known
            if odd and i + 1 < len(toks) and (toks[i + 1][:1] in "([@" or (re.fullmatch(r"\d{1,3}b", w) and toks[i + 1][:1].isupper())):
                odd = False
            half = (no in halves and i == len(toks) - 1) or (no - 1 in halves and i == 0)
            if odd or not half:
                near = [core_of(settle_text(x)).lower() for x in (toks[i - 1 : i] or [""]) + (toks[i + 1 : i + 2] or [""])]
                rows.append(("r", no, pos + i, w, " ".join(near), odd, False))
        pos += len(toks)
    n = len(lines)
    for no in range(n - 1):
        end = raw[no].rstrip()
        if len(end) < 2 or end[-1] not in _HYPHENS:
            continue
        a, b = lines[no].rstrip(_HYPHENS + " ").split(), lines[no + 1].split()
        if not a or not b:
            continue
        left, right = a[-1].lstrip(_EDGE), b[0]
        m = re.match(r"[^\W_]+(?:['’][^\W_]+)*", right)
        if not left or not m or not left[-1].isalpha() or not m.group()[0].isalpha():
            continue
        if re.search(r"[@/\d]", left) and not odd_digits(left) or "@" in right:
            continue
        r = m.group().lower()
        l = left.lower()
        rows.append(("b", no, 0, l + r, l + "-" + r, m.group()[0].isupper(), False))
    filled = [i for i, x in enumerate(lines) if x.strip()]
    for top, at in ((True, filled[:2]), (False, filled[::-1][:2])):
        for depth, i in enumerate(at):
            if len(filled) < 3 and depth:
                continue
            line = lines[i].strip()
            before = lines[filled[filled.index(i) - 1]].strip() if filled.index(i) else ""
            label = not top and before.endswith(":")
            mark = bool(_PAGE_MARK.match(line)) and not label
            guard = bool(_OPENING.match(line)) or (not top and bool(_CLOSING.match(before) or _CLOSING.match(line)))
            stem = None if depth else "" if guard else stem_of(line)
            rows.append(("e", i, 0, stem, None, top, mark))
    return rows


def running_lines(edges: DataFrame) -> DataFrame:
    """(page_id, line) of running headers, footers and page marks.

    ``edges``: page_id, document_id, page, pages, line, top, mark, stem.
    """
    lines = edges.filter("stem IS NOT NULL AND size(split(stem, ' ')) >= 2")
    again = lines.groupBy("document_id", "top", "stem").agg(F.countDistinct("page").alias("k")).filter("k >= 2").select("document_id", "top", "stem", F.lit(True).alias("again"))
    lines = lines.join(again, ["document_id", "top", "stem"], "left").withColumn("again", F.coalesce("again", F.lit(False)))
    w = F.split("stem", " ")
    openings = F.concat_ws(" ", F.lit("^"), F.get(w, 0), F.get(w, 1))
    closings = F.concat_ws(" ", F.element_at(w, -2), F.element_at(w, -1), F.lit("$"))
    lines = lines.withColumn("parts", F.array_distinct(F.array(openings, closings)))
    part = lines.select("document_id", "pages", "again", F.explode("parts").alias("part"))
    # Of the documents with several pages that show such a line, in how many it recurs.
    taught = (
        part.filter("pages >= 2")
        .groupBy("part", "document_id")
        .agg(F.max("again").alias("again"))
        .groupBy("part")
        .agg(F.sum(F.col("again").cast("int")).alias("yes"), F.count("*").alias("all"))
        .filter((F.col("yes") >= SAME_LEAST) & (F.col("yes") >= SAME_SHARE * F.col("all")))
        .select("part")
    )
    by_part = lines.select("page_id", "line", F.explode("parts").alias("part")).join(taught, "part", "left_semi").select("page_id", "line")
    marks = edges.filter("mark").join(
        edges.groupBy("page_id", "top").agg(F.max(F.struct(F.col("stem").isNotNull(), "line")).alias("_")).select("page_id", "top"), ["page_id", "top"]
    )
    outer = marks.filter("stem IS NOT NULL").select("page_id", "line")
    found = lines.filter("again").select("page_id", "line").union(by_part).union(outer).distinct()
    # A page mark just inside a running line is one too.
    inner = marks.filter("stem IS NULL").select("page_id", "top", F.col("line").alias("l"))
    near = inner.join(found, "page_id").filter(F.abs(F.col("l") - F.col("line")) == 1).select("page_id", F.col("l").alias("line"))
    return found.union(near).distinct()


def read_scans(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(furniture, hyphens, misreadings, repairs) of scanned pages.

    ``pages``: page_id, document_id, page, method, text. The first three are
    keyed by page_id: (line), (line, joined), (pos, line, w, near, repair); the
    last has every repair of a word with its weight.
    """
    spark = pages.sparkSession
    pages = pages.filter("text IS NOT NULL AND text <> '' AND page_id IS NOT NULL")
    lex, _ = stage(lexicon(pages), "lexicon")
    bad, _ = stage(repairs(lex), "repairs")
    best = bad.groupBy("w").agg(F.max_by("repair", F.struct("weight", "repair")).alias("repair"))
    known = lex.join(bad.select("w").distinct(), "w", "left_anti").orderBy(F.desc(F.col("typed") + F.col("scanned")), "w").limit(COMMON)
    common = spark.sparkContext.broadcast(frozenset(r["w"] for r in known.select("w").collect() if not re.search(r"[0-9!|]", r["w"])))

    fields = ["kind", "line", "pos", "s", "s2", "yes", "mark"]

    def read(batches):
        memo: dict = {}
        for b in batches:
            if len(memo) > 500_000:
                memo = {}
            out = [(p, d, n, *r) for p, d, n, t in zip(b["page_id"], b["document_id"], b["page"], b["text"]) for r in read_page(t, common.value, memo)]
            if out:
                yield pd.DataFrame(out, columns=["page_id", "document_id", "page", *fields])

    scans = pages.filter(F.col("method").isin("ocr", "hybrid")).select("page_id", "document_id", "page", "text").dropDuplicates(["page_id", "text"])
    kind = {f.name: f.dataType.simpleString() for f in scans.schema.fields}
    schema = f"page_id {kind['page_id']}, document_id string, page {kind['page']}, kind string, line int, pos int, s string, s2 string, yes boolean, mark boolean"
    done, _ = stage(scans.mapInPandas(read, schema), "scans")
    edges = done.filter("kind = 'e'").select("page_id", "document_id", "page", "line", F.col("yes").alias("top"), "mark", F.col("s").alias("stem"))
    count = edges.groupBy("document_id").agg(F.countDistinct("page").alias("pages"))
    edges = edges.join(count, "document_id")
    furniture, _ = stage(running_lines(edges), "furniture")
    brk = done.filter("kind = 'b'").select("page_id", "line", F.col("s").alias("joined"), F.col("s2").alias("dashed"), F.col("yes").alias("upper"))
    joined = lex.select(F.col("w").alias("joined"), (F.col("typed") + F.col("scanned")).alias("nj"))
    dashed = lex.select(F.col("w").alias("dashed"), (F.col("typed") + F.col("scanned")).alias("nd"))
    brk = brk.join(joined, "joined", "left").join(dashed, "dashed", "left").fillna(0, ["nj", "nd"])
    broken = F.when((F.col("nj") == 0) & (F.col("nd") == 0), ~F.col("upper")).otherwise(F.col("nj") > F.col("nd"))
    hyphens = brk.filter(broken).join(furniture, ["page_id", "line"], "left_anti").select("page_id", "line", "joined").distinct()
    rare = done.filter("kind = 'r'").select("page_id", "line", "pos", F.col("s").alias("w"), F.col("s2").alias("near"), F.col("yes").alias("odd"))
    wrong = rare.join(best, "w", "left").filter("odd OR repair IS NOT NULL").join(furniture, ["page_id", "line"], "left_anti")
    return furniture, hyphens, wrong.select("page_id", "pos", "line", "w", "near", "repair").distinct(), bad


def _pair_rows(batches):
    pairs: Counter = Counter()
    for b in batches:
        for text in b["text"]:
            w = [core_of(t).lower() for t in settle_text(text).split()]
            pairs.update(zip(w, w[1:]))
        if len(pairs) > 400_000:
            yield pd.DataFrame([(x, y, n) for (x, y), n in pairs.items()], columns=["a", "b", "n"])
            pairs = Counter()
    if pairs:
        yield pd.DataFrame([(x, y, n) for (x, y), n in pairs.items()], columns=["a", "b", "n"])


def chosen_repairs(pages: DataFrame, wrong: DataFrame, bad: DataFrame) -> DataFrame:
    """(page_id, pos, repair): the repair the words around it speak for."""
    pairs = pages.filter("text IS NOT NULL").select("text").mapInPandas(_pair_rows, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    cand = wrong.select("page_id", "pos", "w", F.element_at(F.split("near", " "), 1).alias("prev"), F.element_at(F.split("near", " "), -1).alias("next")).join(bad, "w")
    left = pairs.select(F.col("a").alias("prev"), F.col("b").alias("repair"), F.col("n").alias("n1"))
    right = pairs.select(F.col("a").alias("repair"), F.col("b").alias("next"), F.col("n").alias("n2"))
    seen = cand.join(left, ["prev", "repair"], "left").join(right, ["repair", "next"], "left").fillna(0, ["n1", "n2"])
    score = F.col("weight") + F.log1p("n1") + F.log1p("n2")
    return seen.groupBy("page_id", "pos").agg(F.max_by("repair", F.struct(score, F.col("repair"))).alias("repair"))


def repaired(text: str, furniture: set[int], broken: set[int], fixes: dict[int, str]) -> str:
    """Continuous paragraphs: running lines gone, words joined and repaired.

    A paragraph ends where a line closes a sentence well short of the widest
    line, or before and after a line that is a heading or a label.
    """
    lines = text.split("\n")
    width = max((len(x) for i, x in enumerate(lines) if i not in furniture), default=0)
    rows: list[tuple[int, list[str]]] = []
    pos = 0
    for no, line in enumerate(lines):
        toks = line.split()
        out = []
        for i, t in enumerate(toks):
            fix = fixes.get(pos + i)
            core = core_of(t)
            if fix and core:
                fix = fix.upper() if core.isupper() and len(core) > 1 else fix[:1].upper() + fix[1:] if core[:1].isupper() else fix
                t = t.replace(core, fix, 1)
            out.append(t)
        pos += len(toks)
        if no not in furniture and out:
            rows.append((no, out))
    paragraphs: list[str] = []
    current = ""
    for k, (no, toks) in enumerate(rows):
        piece = " ".join(toks)
        glue = " "
        if current:
            if current.endswith("\0"):
                current, glue = current[:-1], ""
            elif current[-1] in _HYPHENS and len(current) > 1 and current[-2].isalpha():
                glue = ""
        current = current + glue + piece if current else piece
        if no in broken:
            current = current.rstrip(_HYPHENS) + "\0"
            continue
        short = len(lines[no]) < 0.75 * width
        heading = len(lines[no]) < 0.5 * width and len(toks) <= 6 and piece[-1:] not in ".,;-" and (k + 1 == len(rows) or rows[k + 1][1][0][:1].isupper())
        if heading or (short and piece[-1:] in ".:!?"):
            paragraphs.append(current)
            current = ""
    if current:
        paragraphs.append(current.rstrip("\0"))
    return "\n\n".join(paragraphs)


@F.pandas_udf(T.StringType())
def _repaired(text: pd.Series, furniture: pd.Series, broken: pd.Series, pos: pd.Series, repair: pd.Series) -> pd.Series:
    some = lambda v: [] if v is None else list(v)
    return pd.Series([repaired(t, set(some(f)), set(some(b)), dict(zip(some(p), some(r)))) for t, f, b, p, r in zip(text, furniture, broken, pos, repair)], dtype=object)


def repaired_pages(pages: DataFrame) -> DataFrame:
    """(page_id, repaired_text) of every scanned page."""
    furniture, hyphens, wrong, bad = read_scans(pages)
    fixes = chosen_repairs(pages, wrong, bad)
    scans = pages.filter(F.col("method").isin("ocr", "hybrid") & F.col("text").isNotNull() & F.col("page_id").isNotNull()).select("page_id", "text").distinct()
    per = scans.join(furniture.groupBy("page_id").agg(F.collect_set("line").alias("f")), "page_id", "left")
    per = per.join(hyphens.groupBy("page_id").agg(F.collect_set("line").alias("b")), "page_id", "left")
    one = F.collect_list(F.struct("pos", "repair"))
    per = per.join(fixes.groupBy("page_id").agg(one.alias("x")), "page_id", "left")
    return per.select("page_id", _repaired("text", "f", "b", F.col("x.pos"), F.col("x.repair")).alias("repaired_text"))
