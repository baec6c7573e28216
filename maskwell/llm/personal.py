"""Personal information inside free text.

Method: anchor expansion. Aho-Corasick automata find cues in one pass each:
at-signs and their evasions, identifier labels, street kinds and box words in a
folded alphabet in which the usual scanner confusions coincide (so a misread
label still leads to its number), and dial prefixes as written. Deterministic
parsers start at the cues only: they expand a label to the number after it, an
at-sign to both sides, a street kind back to its house number and on through
suburb, state and postcode, and validate the boundaries.
Names of people have no cue of their own: they are read from a token grammar
(titles, initials, particles, either order) over a lexicon of given names and
surnames counted from the annotated mentions, with unknown words admitted where
a known given name or a title stands before them.

Offsets count code points of the text as delivered. Invisible and look-alike
characters are folded for matching only. Null and empty texts hold nothing;
repeated rows give their cases once. Placeholders are never cases.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.llm import glyphs, names
from maskwell.llm.scans import shapes
from maskwell.runtime import stage

TYPES = ["EMAIL", "PHONE", "ADDRESS", "PERSON", "TFN", "MEDICARE", "DRIVER_LICENCE", "PASSPORT"]
#: Most frequent lexicon entries of each role sent to every task; the others are joined to the texts that hold them.
LEXICON_BOUND = 200_000
#: A word that makes up this share of all words is no misread name.
FREQUENT = 1e-4

# Street kinds, states and words that head or end an organisation's name.
STREET_KINDS = "street st road rd avenue ave court ct crescent cres lane ln parade pde place pl drive terrace tce close cl boulevard blvd highway hwy circuit cct grove way esplanade square".split()
STATES = "nsw vic qld sa wa tas nt act".split()
ORG_WORDS = set(
    "lawyers lawyer legal solicitors law foundation clinic hospital physiotherapy medical imaging insurance logistics building cleaning "
    "rehabilitation occupational community freight haulage pain group partners associates services company registry railway trust institute "
    "university college school council consulting holdings contractors practice centre center limited pty ltd brothers bros industries health".split()
)
# Given names that are also ordinary words; alone they name nobody.
DOUBLE_WORDS = set(
    "will may mark rose grace pat sue bill dot ray drew rich art hope faith joy guy jo dale lee grant chuck kit penny dick rob rick ant len gail "
    "sandy frank jack chris gene dean wade june april august summer autumn page paige ford miles harry tom vin marg flo ross neil anne jean jude "
    "mae faye john paul marie john".split()
) - {"anne", "jean", "john", "paul", "marie", "ross", "neil", "jude", "faye", "harry", "tom", "chris"}
TITLES = set("mr mrs ms miss mx master dr doctor prof professor sir dame lord lady rev reverend hon justice judge magistrate senator constable sergeant nurse sister".split())
SHORT_TITLES = set("mr mrs ms dr prof rev hon".split())
NOT_NAMES = set(
    "re dear the a an and or of for to from in on at by with this that these those his her their our your my i we he she it they as is was were "
    "patient client claimant plaintiff name names surname given telephone phone tel email address medicare passport driver drivers licence license "
    "tax file number claim report assessment independent confidential page form score summary history background opinion examination employment "
    "investigations signed yours sincerely faithfully level unit box po further statements mail mr mrs ms dr prof "
    "january february march april june july august september october november december monday tuesday wednesday thursday friday saturday sunday "
    "person address phone email tfn medicare driver_licence passport nsw vic qld sa wa tas nt act".split()
)

_FOLD_1 = {ord(a): b for a, b in (("ø", "o"), ("Ø", "O"), ("ı", "i"), ("ł", "l"), ("Ł", "L"), ("đ", "d"), ("ß", "s"), ("æ", "a"), ("œ", "o"), ("’", "'"), ("‘", "'"), ("ʼ", "'"), ("´", "'"), ("`", "'"), ("‐", "-"), ("‑", "-"), ("–", "-"), ("—", "-"), ("−", "-"))}


_BROKEN = re.compile("(?<=[^\\W\\d_])[-\u2010\u2011\u00ac\u00ad]\n(?=[^\\W\\d_A-Z])")


@lru_cache(maxsize=1)
def _folds() -> tuple[dict[int, str], re.Pattern]:
    """(character folds, class of characters whose fold changes the length)."""
    fold = dict(glyphs._tables()[0])
    for a, b in glyphs.TO_LATIN.items():
        fold[ord(a)] = b
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0x370, 0x530)]:
        d = unicodedata.normalize("NFD", chr(cp))
        if len(d) > 1 and cp not in fold:
            fold[cp] = fold.get(ord(d[0]), d[0])
    for cp in range(0x300, 0x370):
        fold[cp] = ""
    fold.update(_FOLD_1)
    odd = "".join(re.escape(chr(c)) for c, s in sorted(fold.items()) if len(s) != 1)
    return fold, re.compile(f"[{odd}]")


def plain_form(text: str) -> tuple[str, list[int] | None]:
    """Folded text, and for each of its characters the offset in ``text``.

    The map is None where offsets agree. Hyphens that break a word at a line end
    are left out with the line end, so that the word is whole.
    """
    broken = {i for m in _BROKEN.finditer(text) for i in (m.start(), m.start() + 1)} if "\n" in text else set()
    if text.isascii() and not broken:
        return text, None
    fold, odd = _folds()
    if not broken and not odd.search(text):
        return text.translate(fold), None
    out: list[str] = []
    at: list[int] = []
    for i, ch in enumerate(text):
        if i in broken:
            continue
        s = fold.get(ord(ch), ch)
        for c in s:
            out.append(c)
            at.append(i)
    at.append(len(text))
    return "".join(out), at


_CUE_FOLD = str.maketrans({"c": "e", "l": "i", "1": "i", "!": "i", "|": "i", "f": "t", "5": "s", "o": "a", "0": "a", "9": "g", "b": "h", "6": "h", "v": "y", "-": " ", "\n": " "})
_PAIRS = [("m", "rn"), ("d", "cl"), ("u", "ii"), ("n", "ri"), ("w", "vv"), ("ti", "h"), ("h", "ti"), ("h", "li")]


def _cue_forms(cue: str) -> set[str]:
    forms = {cue}
    for a, b in _PAIRS:
        forms |= {cue[: m.start()] + b + cue[m.end() :] for m in re.finditer(re.escape(a), cue)}
    return {f.translate(_CUE_FOLD) for f in forms}


_DIGITS = "0123456789OolISBZ|"
# Cues of the parsers.
CUES = {
    "TFN": ["tfn", "t.f.n", "tax file"],
    "MEDICARE": ["medicare"],
    "DRIVER_LICENCE": ["licence", "license"],
    "PASSPORT": ["passport"],
    "EMAIL": ["@", "(at)", "[at]", "{at}", "<at>", "( at", "[ at", "{ at", "< at", " at "],
    "STREET": STREET_KINDS,
    "BOX": ["box", "bax", "bag", "pmb"],
}
#: Dial prefixes are digits, which confusions change too much to be folded.
DIAL = ["+", *[o + d for o in "0O" for d in _DIGITS], *["(" + o for o in "0O"], *[i + d for i in "1lI" for d in "38"]]


@lru_cache(maxsize=1)
def _automata():
    import ahocorasick

    folded, dial = ahocorasick.Automaton(), ahocorasick.Automaton()
    kinds: dict[str, set[str]] = {}
    for kind, cues in CUES.items():
        for cue in cues:
            for form in {cue.translate(_CUE_FOLD)} if kind in ("STREET", "BOX") else _cue_forms(cue):
                kinds.setdefault(form, set()).add(kind)
    for form, ks in kinds.items():
        folded.add_word(form, (len(form), sorted(ks)))
    for cue in DIAL:
        dial.add_word(cue, len(cue))
    folded.make_automaton()
    dial.make_automaton()
    return folded, dial


_D = f"[{_DIGITS}]"
# In the folded alphabet: card, number in any state of repair, is, was.
_AFTER_LABEL = re.compile(r"(?:s\b)?(?:[\s,:.#'()\-]*(?:eard|n[a-z]{0,11}|r[il]umh[a-z]{0,8}|is|was)\b)*[\s,:.#'()\-]*")
_ID_VALUE = {
    "TFN": re.compile(rf"{_D}{{3}}[ \n.\-]?{_D}{{3}}[ \n.\-]?{_D}{{2,3}}(?![0-9A-Za-z])"),
    "MEDICARE": re.compile(rf"{_D}{{4}}[ \n.\-]?{_D}{{5}}[ \n.\-]?{_D}(?:[ /\-]{_D}(?![0-9A-Za-z]))?(?![0-9A-Za-z])"),
    "DRIVER_LICENCE": re.compile(rf"(?:[A-Z]{{0,2}}{_D}{{5,10}}|{_D}{{3}}[ \n\-]{_D}{{3}}[ \n\-]{_D}{{2,3}}|{_D}{{2}}[ \n\-]{_D}{{3}}[ \n\-]{_D}{{3}})(?![0-9A-Za-z])"),
    "PASSPORT": re.compile(rf"[A-Z]{{1,2}}[ \-]?{_D}{{7,8}}(?![0-9A-Za-z])"),
}
_PHONE = re.compile(
    rf"(?<![\w+/])(?:"
    rf"\(?\+\s?[6b][1lI|]\)?[\s.\-]*(?:\(0\)[\s]*)?{_D}(?:[\s.\-]?{_D}){{8}}"
    rf"|\([0O]{_D}\)[\s.\-]*{_D}{{4}}[\s.\-]?{_D}{{4}}"
    rf"|[0O][4]{_D}{{2}}[\s.\-]?{_D}{{3}}[\s.\-]?{_D}{{3}}"
    rf"|[0O][2378][\s.\-]?{_D}{{4}}[\s.\-]?{_D}{{4}}"
    rf"|[1lI][38][0O]{{2}}[\s.\-]?{_D}{{3}}[\s.\-]?{_D}{{3}}"
    rf"|[0O]{_D}{{3}}[\s.\-]{_D}{{3}}[\s.\-]{_D}{{3}}"
    rf")(?![\w/])"
)
_AT = r"(?:\s?@\s?|\s*[\[({<]\s*(?:at|AT|At)\s*[\])}>]\s*)"
_DOT = r"(?:\.|\s?[\[({<]\s*(?:dot|DOT|Dot)\s*[\])}>]\s?)"
_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9](?:[A-Za-z0-9_%+\-'!|]|{_DOT}(?=[A-Za-z0-9]))*{_AT}[A-Za-z0-9\-!|]+(?:{_DOT}[A-Za-z0-9\-!|]+)+")
_EMAIL_WORDS = re.compile(r"(?<![\w.+\-])[A-Za-z0-9](?:[\w+\-]|\.(?=\w)| dot (?=\w))*\s(?:at|AT)\s[A-Za-z0-9\-]+(?:\s(?:dot|DOT)\s[A-Za-z0-9\-]+)+")
_KIND = "|".join(sorted({k for k in STREET_KINDS}, key=len, reverse=True))
_STATE = "|".join(STATES)
_N = r"[0-9OlISB]"
_TAIL = (
    rf"(?:(?:,\s?|,?\s)(?!(?i:mr|mrs|ms|miss|dr|prof)\b)(?P<sub>[A-Z][\w'!\-]*(?:\s[A-Z][\w'!\-]*)??)(?=,?\s(?i:{_STATE})\b|,?\s{_N}{{4}}(?!\w)))?"
    rf"(?:,?\s(?P<st>(?i:{_STATE}))\b)?(?:,?\s(?P<pc>{_N}{{4}})(?![\w/\-]))?"
)
_ADDRESS = re.compile(
    rf"(?<![\w/\-])(?:(?:(?:(?i:unit|level|suite|flat|apt|apartment|shop|lot|villa|house))\s{_N}+[A-Z]?,?\s)?(?:{_N}+[A-Z]?\s?/\s?)?(?=\w*\d){_N}+[A-Z]?(?:\s?-\s?\d+[A-Z]?)?,?\s"
    rf"(?:[A-Z][\w'!\-]*\s){{1,3}}?(?i:{_KIND})\b\.?)"
    rf"(?:{_TAIL})"
)
_SUBURB_ONLY = re.compile(r",\s?(?!(?i:mr|mrs|ms|miss|dr|prof|who|was|with)\b)([A-Z][\w'!\-]+)")
_BOX = re.compile(rf"(?<!\w)(?i:g?\.?p\.?\s?[o0]\.?\s+b[o0a]x|locked\s+bag|pmb)\s{_N}+{_TAIL}")
_PLACEHOLDER = re.compile(r"[\[<({]\s*[A-Z]+(?:_[A-Z]+)*(?:_?\d+)?\s*[\]>)}]")
_HEADS = ("o'", "mac", "mc", "van", "de")
_TOKEN = re.compile(r"[A-Za-z][A-Za-z0-9!|]*(?:['\-][A-Za-z][A-Za-z0-9!|]*)*")


class Either:
    """A set and a small addition to it, for look-up only."""

    def __init__(self, a, b):
        self.a, self.b = a, b

    def __contains__(self, w: str) -> bool:
        return w in self.a or w in self.b


class Lexicon:
    """Given names, surnames and ordinary words, for look-up in the tasks.

    ``rest`` (w, r) is the table of entries that are not in the sets, or None.
    """

    rest: DataFrame | None = None

    def __init__(self, given: set[str], surnames: set[str], common: set[str], middle: set[str] = frozenset(), frequent: set[str] = frozenset()):
        self.given, self.surnames, self.common, self.middle, self.frequent = given, surnames, common, middle, frequent
        self.given_shape = {s for w in given if len(w) > 4 for s in shapes(w)}
        self.surname_shape = {s for w in surnames if len(w) > 4 for s in shapes(w)}
        self.memo: dict[str, tuple] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("rest", "memo")} | {"memo": {}}

    def wider(self, extra: list[tuple[str, str]]) -> Lexicon:
        """This lexicon with entries (role, word) beyond its sets, for one text."""
        own: dict[str, set[str]] = {r: {w for q, w in extra if q == r} for r in "gsmcq"}
        out = Lexicon.__new__(Lexicon)
        out.given, out.surnames, out.middle = Either(self.given, own["g"]), Either(self.surnames, own["s"]), Either(self.middle, own["m"])
        out.common, out.frequent = Either(self.common, own["c"]), Either(self.frequent, own["q"])
        out.given_shape = Either(self.given_shape, {x for w in own["g"] if len(w) > 4 for x in shapes(w)})
        out.surname_shape = Either(self.surname_shape, {x for w in own["s"] if len(w) > 4 for x in shapes(w)})
        out.memo = {}
        return out

    def unknown_keys(self, text: str) -> set[str]:
        """Keys under which entries beyond the sets may concern ``text``: words, their parts, shapes of misread ones."""
        keys: set[str] = set()
        for m in _TOKEN.finditer(plain_form(text)[0]):
            w = re.sub(r"'s$", "", m.group().lower())
            if len(w) < 2:
                continue
            parts = {w, *w.split("-")}
            for x in list(parts):
                parts |= {x[len(h) :] for h in _HEADS if x.startswith(h)}
            keys |= {"w" + x for x in parts if len(x) > 1 and not (x in self.given and x in self.surnames)}
            keys |= {"s" + k for x in parts if len(x) > 2 for k in shapes(x)}
        return keys

    def known_surname(self, w: str) -> bool:
        if w in self.surnames:
            return True
        for head in _HEADS:
            if w.startswith(head) and w[len(head) :] in self.surnames:
                return True
        return "-" in w and all(p in self.surnames or self.known_surname(p) for p in w.split("-"))

    def look(self, tok: str) -> tuple[bool, bool, bool, str]:
        """(given, surname, ordinary word, case: T title, U upper, l lower, i initial)."""
        got = self.memo.get(tok)
        if got is None:
            w = tok.lower()
            if len(tok) == 1:
                got = (False, False, False, "i" if tok.isupper() else "l")
            elif 3 * sum(c.isdigit() for c in tok) > len(tok):
                got = (False, False, True, "l")
            else:
                case = "U" if tok.isupper() else "T" if tok[0].isupper() else "l"
                g, s = w in self.given, self.known_surname(w)
                if not g and not s and w not in self.common and w not in self.frequent and len(w) > 4:
                    own = shapes(w)
                    g = any(k in self.given_shape for k in own)
                    s = any(k in self.surname_shape for k in own) or ("-" in w and all(any(k in self.surname_shape for k in shapes(p)) or p in self.surnames for p in w.split("-")))
                got = (g, s, w in self.common or w in NOT_NAMES, case)
            if len(self.memo) > 500_000:
                self.memo.clear()
            self.memo[tok] = got
        return got


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


class Taken:
    """Spans that do not overlap, by start; what meets one already taken is refused."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.spans: list[tuple[int, int, str]] = []

    def add(self, a: int, b: int, kind: str) -> None:
        k = bisect.bisect_left(self.starts, b)
        if not k or self.spans[k - 1][1] <= a:
            at = bisect.bisect_left(self.starts, a)
            self.starts.insert(at, a)
            self.spans.insert(at, (a, b, kind))


_BLANKS = " \n\t\r\f\v"


def _tokens_back(t: str, at: int, n: int) -> int:
    """Start of the n-th run between blanks before ``at``."""
    while n and at > 0:
        while at > 0 and t[at - 1] in _BLANKS:
            at -= 1
        while at > 0 and t[at - 1] not in _BLANKS:
            at -= 1
        n -= 1
    return at


def _at_cues(rx: re.Pattern, t: str, cues: list[int], back: int):
    """Matches of ``rx`` that begin up to ``back`` runs before a cue."""
    done = 0
    for cue in cues:
        lo = max(done, _tokens_back(t, cue, back))
        while lo <= cue:
            m = rx.search(t, lo)
            if not m:
                return
            if m.start() > cue:
                # No match begins before it, so earlier cues have none either.
                done = m.start()
                break
            yield m
            done = lo = max(m.end(), m.start() + 1)


def contact_spans(t: str, kind_hint: str | None = None) -> list[tuple[int, int, str]]:
    """Spans with cues: placeholders (type ""), numbers, mail and street addresses."""
    taken = Taken()
    for m in _PLACEHOLDER.finditer(t):
        taken.add(m.start(), m.end(), "")
    low = t.lower().translate(_CUE_FOLD)
    folded, dial = _automata()
    cues: dict[str, list[int]] = {}
    labels: list[tuple[int, int, str]] = []
    size = len(t)
    for end, (n, kinds) in folded.iter(low):
        a = end - n + 1
        for k in kinds:
            if k in _ID_VALUE:
                labels.append((a, end + 1, k))
            elif k != "STREET" or (a and not low[a - 1].isalnum() and (end + 1 == size or not low[end + 1].isalnum())):
                cues.setdefault(k, []).append(a)
    for a, b, kind in labels:
        if a and t[a - 1].isalnum():
            continue
        m = _AFTER_LABEL.match(low, b)
        v = _ID_VALUE[kind].match(t, m.end()) or _ID_VALUE[kind].match(t, b)
        if v and _digits(v.group()) >= 0.6 * len(re.sub(r"[\s.\-/]", "", v.group())):
            taken.add(v.start(), v.end(), kind)
    for rx in (_EMAIL, _EMAIL_WORDS):
        for m in _at_cues(rx, t, cues.get("EMAIL", []), 12):
            taken.add(m.start(), m.end(), "EMAIL")
    done = 0
    for end, n in dial.iter(t):
        a = end - n + 1
        # A plus sign may stand in a bracket, and so may the prefix.
        a -= a > 0 and t[a - 1] == "("
        if a < done or (a and (t[a - 1].isalnum() or t[a - 1] in "_+/")):
            continue
        m = _PHONE.match(t, a) or (t[a] == "(" and _PHONE.match(t, a + 1))
        if m and _digits(m.group()) >= 7:
            taken.add(m.start(), m.end(), "PHONE")
            done = m.end()
    if kind_hint in _ID_VALUE:
        for m in re.finditer(r"(?<![\w+])[A-Z]{0,2}[0-9][0-9OolISBZ \-]{4,}[0-9A-Z](?!\w)", t):
            v = _ID_VALUE[kind_hint].fullmatch(m.group())
            if v:
                taken.add(m.start(), m.end(), kind_hint)
    for rx, cue, back in ((_ADDRESS, "STREET", 10), (_BOX, "BOX", 4)):
        for m in _at_cues(rx, t, cues.get(cue, []), back):
            b = m.end()
            if not (m.group("sub") or m.group("st") or m.group("pc")):
                more = _SUBURB_ONLY.match(t, b)
                if more and not t[more.end() : more.end() + 2].lower().startswith("'s"):
                    b = more.end()
            s = t[m.start() : b]
            taken.add(m.start(), m.start() + len(s.rstrip(" ,\n")) if not s.endswith(".") or m.group("sub") else m.start() + len(s.rstrip(" ,\n.")), "ADDRESS")
    return taken.spans


_GAP = re.compile(r"(?:\.?[ ]?\n?[ ]?|\.)$")


def person_spans(t: str, taken: list[tuple[int, int, str]], lex: Lexicon) -> list[tuple[int, int, str]]:
    """Names of people outside the spans already taken."""
    blocked = [(a, b) for a, b, _ in taken]
    toks = []
    bi = 0
    for m in _TOKEN.finditer(t):
        a, b = m.span()
        while bi < len(blocked) and blocked[bi][1] <= a:
            bi += 1
        if bi < len(blocked) and blocked[bi][0] < b:
            continue
        w = m.group()
        if w[-2:] in ("'s", "'S"):
            w = w[:-2]
            b -= 2
        toks.append((a, b, w))
    n = len(toks)
    info = [lex.look(w) for _, _, w in toks]
    out: list[tuple[int, int, str]] = []

    def gap(i: int, j: int) -> str:
        return t[toks[i][1] : toks[j][0]]

    def joined(i: int) -> bool:
        """Token i + 1 goes on right after token i: blanks, or a full stop after an initial."""
        if i + 1 >= n:
            return False
        g = gap(i, i + 1)
        if g in (" ", "\n"):
            return True
        return len(toks[i][2]) == 1 and g in (".", ". ", ".\n")

    def comma(i: int) -> bool:
        return i + 1 < n and gap(i, i + 1) in (", ", ",\n", ",")

    def surname_at(i: int, strict: bool) -> int:
        """Index after a surname with its particles at i, or -1."""
        k = i
        while k < n and toks[k][2].lower() in names.PARTICLES and joined(k):
            k += 1
        if k >= n:
            return -1
        g, s, common, case = info[k]
        if s and len(toks[k][2]) > 1:
            if case == "l" and not strict and k == i:
                return k + 1 if not common else -1
            return k + 1
        if not strict and case in "TU" and not common and len(toks[k][2]) > 2:
            return k + 1
        if k > i and case in "TU" and not common:
            return k + 1
        return -1

    def organisation(k: int) -> bool:
        """What follows token k - 1 makes it part of an organisation or a street."""
        if k >= n or k == 0 or not joined(k - 1):
            return False
        nxt = toks[k][2].lower()
        if nxt in ORG_WORDS and toks[k][2][0].isupper():
            return True
        if nxt in STREET_KINDS and toks[k][2][0].isupper():
            return True
        if nxt in ("and", "&") and k + 1 < n and toks[k + 1][2].lower() in ("sons", "co", "partners", "associates", "sans", "daughters"):
            return True
        return t[toks[k - 1][1] : toks[k - 1][1] + 3] == " & "

    i = 0
    while i < n:
        a, b, w = toks[i]
        g, s, common, case = info[i]
        low = w.lower()
        end = -1
        if low in TITLES and case != "i" and i + 1 < n and (joined(i) or (low in SHORT_TITLES and gap(i, i + 1) in (". ", ".\n", "."))):
            i += 1
            titled = True
            a, b, w = toks[i]
            g, s, common, case = info[i]
            low = w.lower()
            if low in TITLES:
                continue
        else:
            titled = False
        upper = case in "TU" or case == "i"
        # Initials and surname.
        if case == "i" and (joined(i)):
            k = i
            while k < n and info[k][3] == "i" and joined(k):
                k += 1
            e = surname_at(k, strict=not titled and gap(k - 1, k) == " ")
            if e < 0 and not titled and k < n and info[k][3] in "TU" and not info[k][2] and len(toks[k][2]) > 3 and (w not in ("A", "I") or t[b : b + 1] == "."):
                e = k + 1
            if e > 0 and (w not in ("A", "I") or t[b : b + 1] == "." or info[e - 1][1]):
                end = e
        # Given name first.
        if end < 0 and g and (upper or s or not common):
            k = i + 1 if joined(i) else i
            best = -1
            mids = 0
            while k > i and k < n and mids <= 3:
                if case == "l" and info[k][3] != "l":
                    break
                e = surname_at(k, strict=True)
                if e > 0 and (info[e - 1][3] != "l" or case == "l" or e - 1 > k):
                    if not ((info[e - 1][0] or toks[e - 1][2].lower() in lex.middle) and joined(e - 1) and surname_at(e, strict=True) > 0 and e - 1 == k):
                        best = e
                        break
                middle = info[k][0] or info[k][3] == "i" or toks[k][2].lower() in lex.middle
                if not middle or not joined(k):
                    break
                k += 1
                mids += 1
            if best < 0 and upper and joined(i):
                # A known given name vouches for the unknown word after it.
                k = i + 1
                while k < n - 1 and (info[k][3] == "i" or toks[k][2].lower() in lex.middle or (info[k][0] and not info[k][1])) and joined(k) and k - i < 3:
                    k += 1
                e = surname_at(k, strict=False)
                if e > 0 and info[e - 1][3] in "TU" and not info[e - 1][2] and toks[e - 1][2].lower() not in ORG_WORDS:
                    best = e
            if best > 0:
                end = best
        # Surname first.
        if end < 0 and (upper or low in names.PARTICLES or s):
            e = surname_at(i, strict=True)
            if e > 0:
                k = e
                has_comma = comma(e - 1)
                if k < n and (has_comma or joined(e - 1)) and (info[k][0] or (has_comma and info[k][3] == "i" and k + 1 <= n)):
                    ok = has_comma or info[k][3] != "l" or case == "l"
                    follows = joined(k) and surname_at(k + 1, strict=True) > 0
                    if ok and info[k][3] == "l" and case in "TU" and not has_comma:
                        ok = False
                    if ok and has_comma and info[k][3] == "l" and case != "l":
                        ok = False
                    if ok and not (follows and not has_comma):
                        k += 1
                        while k < n and joined(k - 1) and (info[k][3] == "i" or info[k][0] or toks[k][2].lower() in lex.middle) and k - e < 3:
                            if info[k][3] == "i" and toks[k][2] in ("A", "I") and not (t[toks[k][1] : toks[k][1] + 1] in (".", "\n", ",", "")):
                                break
                            if info[k][3] == "l" and case != "l":
                                break
                            k += 1
                        end = k
                elif has_comma and case in "TU" and k < n and info[k][3] in "TU" and not info[k][2] and w.isupper() and not toks[k][2].isupper():
                    end = k + 1
        # An unknown word before a given name: with a comma, or in capitals.
        if end < 0 and case in "TU" and not common and len(w) > 3 and low not in lex.frequent and i + 1 < n and info[i + 1][0] and info[i + 1][3] in "TU":
            if comma(i) or (case == "U" and joined(i) and not toks[i + 1][2].isupper()):
                end = i + 2
                while end < n and joined(end - 1) and end - i < 4 and info[end][3] in "TU" and toks[end][2].lower() in lex.middle:
                    end += 1
        # Title and surname.
        if end < 0 and titled:
            e = surname_at(i, strict=False)
            if e > 0:
                end = e
                while end < n and joined(end - 1) and end - i < 4:
                    f = surname_at(end, strict=True)
                    if f > 0 and info[end - 1][0]:
                        end = f
                    else:
                        break
        # One bare name.
        if end < 0 and upper and case != "i" and not common and low not in DOUBLE_WORDS and len(w) > 2:
            if g and not s or (g and s):
                end = i + 1
            elif s and w not in ("May",):
                end = i + 1
        elif end < 0 and upper and case != "i" and g and low not in DOUBLE_WORDS and low not in NOT_NAMES and len(w) > 3:
            end = i + 1
        if end > 0:
            if organisation(end):
                i = end + 1
                continue
            if end == i + 1 and i and not titled and info[i - 1][3] in "TU" and joined(i - 1) and toks[i - 1][2].lower() in ORG_WORDS:
                i = end
                continue
            stop = toks[end - 1][1]
            out.append((a, stop, "PERSON"))
            i = end
        else:
            i += 1
    return out


def find_personal(text: str, lex: Lexicon, kind_hint: str | None = None) -> list[tuple[int, int, str]]:
    """(start, end, type) of every case in ``text``, by start."""
    t, at = plain_form(text)
    taken = contact_spans(t, kind_hint)
    spans = [s for s in taken if s[2]] + person_spans(t, taken, lex)
    if at is not None:
        spans = [(at[a], at[b - 1] + 1, k) for a, b, k in spans]
        full = []
        for a, b, k in spans:
            while b < len(text) and unicodedata.combining(text[b]):
                b += 1
            full.append((a, b, k))
        spans = full
    return sorted(spans)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with ``[TYPE]`` in place of each span."""
    out, done = [], 0
    for a, b, k in spans:
        out += [text[done:a], f"[{k}]"]
        done = b
    return "".join([*out, text[done:]])


def _name_words(batches):
    counts: dict[tuple[str, str], int] = {}
    for b in batches:
        for text, n in zip(b["t"], b["n"]):
            ps = names.person_parses(plain_form(glyphs.settle_text(text))[0])
            if not ps:
                continue
            # Count a word under a role only where the written form leaves no doubt.
            raw = plain_form(text)[0]
            sure = len(ps) == 1
            g, mid, s = ps[0][0], ps[0][1], ps[0][2]
            parts = [w.lower() for w in _TOKEN.findall(raw)]
            if len(g) > 1 and (sure or ps[0][4] == 3):
                counts["g" if sure else "f", g] = counts.get(("g" if sure else "f", g), 0) + n
            if sure:
                for w in mid.split():
                    if len(w) > 1:
                        counts["g", w] = counts.get(("g", w), 0) + n
            for w in mid.split():
                if len(w) > 1 and not sure:
                    counts["m", w] = counts.get(("m", w), 0) + n
            if s and (sure or ps[0][4] == 3):
                role = "s" if sure else "e"
                for w in parts:
                    core = re.sub(r"^(o'|mac|mc)(?=\w{4})", "", w)
                    for piece in core.split("-"):
                        if len(piece) > 2 and piece in s:
                            counts[role, piece] = counts.get((role, piece), 0) + n
    if counts:
        yield pd.DataFrame([(r, w, c) for (r, w), c in counts.items()], columns=["role", "w", "n"])


def _lower_words(batches):
    from collections import Counter

    seen: Counter = Counter()
    for b in batches:
        for text in b["text"]:
            seen.update(text.split())
    found: dict[str, list[int]] = {}
    for t, n in seen.items():
        w = t.strip(".,;:()?!\"'")
        if len(w) > 1 and w.isalpha():
            c = found.setdefault(w.lower(), [0, 0])
            c[0] += n * w.islower()
            c[1] += n
    if found:
        yield pd.DataFrame({"w": list(found), "n": [c[0] for c in found.values()], "every": [c[1] for c in found.values()]})


def name_lexicon(mentions: DataFrame, pages: DataFrame, bound: int = LEXICON_BOUND) -> Lexicon:
    """Given names and surnames counted over all ``mentions`` (text), ordinary words over all ``pages``.

    The ``bound`` most frequent entries of each role go to the tasks; where a
    role has more, the others stay a table (``rest``) that is joined to the texts.
    """
    texts = mentions.select(F.col("text").alias("t")).dropna().groupBy("t").agg(F.count("*").alias("n"))
    words = texts.mapInPandas(_name_words, "role string, w string, n long").groupBy("w").pivot("role", ["g", "s", "f", "e", "m"]).agg(F.sum("n")).fillna(0)
    # One role each: the one a word is written in far more often.
    g_all, s_all = F.col("g") + 0.1 * F.col("f"), F.col("s") + 0.1 * F.col("e")
    role = lambda r, weight: (F.lit(r).alias("r"), weight.cast("double").alias("weight"))
    given = words.filter(((F.col("g") >= 1) & (g_all > 2 * s_all)) | ((F.col("f") >= 5) & (F.col("f") > 3 * F.col("e")) & (F.col("s") == 0))).select("w", *role("g", g_all))
    sur = words.filter(((F.col("s") >= 1) & (s_all > 2 * g_all)) | ((F.col("e") >= 1) & (F.col("e") > F.col("f")) & (F.col("g") == 0))).select("w", *role("s", s_all))
    mid = words.filter((F.col("m") >= 3) & (F.col("m") > 0.2 * F.col("s"))).select("w", *role("m", F.col("m")))
    low = pages.select("text").dropna().mapInPandas(_lower_words, "w string, n long, every long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("every").alias("every"))
    total = low.agg(F.sum("every").alias("total"))
    low = low.crossJoin(F.broadcast(total)).join(words.filter((g_all >= 3) | (s_all >= 3)).select("w"), "w", "left_anti")
    # Ordinary words are mostly written small; a name now and then.
    common = low.filter("n >= 0.3 * every AND n > 0").select("w", *role("c", F.col("n")))
    frequent = low.filter(F.col("every") >= FREQUENT * F.col("total")).select("w", *role("q", F.col("every")))
    every, _ = stage(given.union(sur).union(mid).union(common).union(frequent), "lexicon")
    sets: dict[str, set[str]] = {"g": set(), "s": set(), "m": set(), "c": set(), "q": set()}
    beyond = False
    for r, n in [(x["r"], x["n"]) for x in every.groupBy("r").agg(F.count("*").alias("n")).collect()]:
        beyond |= n > bound
        # At most ``bound`` rows of each of five roles.
        top = every.filter(F.col("r") == r)
        sets[r].update(x["w"] for x in (top.orderBy(F.desc("weight"), "w").limit(bound) if n > bound else top).select("w").toLocalIterator())
    nick = {n for v in names.NICKNAMES.values() for n in v.split()} | set(names.NICKNAMES)
    lex = Lexicon(sets["g"] | nick, sets["s"] - nick, sets["c"] - nick, sets["m"], sets["q"])
    if beyond:
        w = Window.partitionBy("r", F.pmod(F.xxhash64("w"), F.lit(64))).orderBy(F.desc("weight"), "w")
        # Only the first ``bound`` of each salt can be among the first ``bound`` of a role.
        head = every.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= bound)
        taken = head.withColumn("k", F.row_number().over(Window.partitionBy("r").orderBy(F.desc("weight"), "w"))).filter(F.col("k") <= bound)
        lex.rest = every.join(taken.select("w", "r"), ["w", "r"], "left_anti").filter(~((F.col("r") != "g") & F.col("w").isin(sorted(nick)))).select("w", "r")
    return lex


def _with_rest(rows: DataFrame, lex: Lexicon) -> DataFrame:
    """``rows`` (..., t) with ``extra``: what the rest of the lexicon says of the words of each text, null if nothing."""
    none = F.lit(None).cast("array<struct<r:string,w:string>>")
    if lex.rest is None:
        return rows.withColumn("extra", none)
    shared = rows.sparkSession.sparkContext.broadcast(lex)

    @F.pandas_udf("array<string>")
    def keys(s: pd.Series) -> pd.Series:
        return s.map(lambda t: sorted(shared.value.unknown_keys(t)))

    @F.pandas_udf("array<string>")
    def forms(s: pd.Series) -> pd.Series:
        return s.map(lambda w: ["w" + w] + (["s" + k for k in shapes(w)] if len(w) > 4 else []))

    table = lex.rest.select("r", "w", F.explode(forms("w")).alias("k")).filter("k LIKE 'w%' OR r IN ('g', 's')")
    held = rows.select(F.md5("t").alias("h"), "t").dropDuplicates(["h"]).select("h", F.explode(keys("t")).alias("k"))
    extra = held.join(table, "k").groupBy("h").agg(F.collect_set(F.struct("r", "w")).alias("extra"))
    return rows.withColumn("h", F.md5("t")).join(extra, "h", "left").drop("h")


def _reader(lex: Lexicon, extra) -> Lexicon:
    return lex if extra is None or not len(extra) else lex.wider([(x["r"], x["w"]) for x in extra])


def personal_spans(df: DataFrame, ident: str, text: str, lex: Lexicon, hint: Column | None = None) -> DataFrame:
    """(record_id, start_off, end_off, entity_type), distinct, of every row of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(lex)
    rows = df.select(F.col(ident).cast("long").alias("record_id"), F.col(text).alias("t"), (hint if hint is not None else F.lit(None).cast("string")).alias("hint"))
    rows = _with_rest(rows.filter("record_id IS NOT NULL AND t IS NOT NULL AND t <> ''"), lex)

    def find(batches):
        for b in batches:
            out = [(r, *s) for r, t, h, x in zip(b["record_id"], b["t"], b["hint"], b["extra"]) for s in find_personal(t, _reader(shared.value, x), h)]
            if out:
                yield pd.DataFrame(out, columns=["record_id", "start_off", "end_off", "entity_type"])

    return rows.mapInPandas(find, "record_id long, start_off int, end_off int, entity_type string").distinct()


def masked_text(df: DataFrame, text: str, lex: Lexicon, out: str = "masked_text") -> DataFrame:
    """``df`` with ``out``: the text with typed placeholders, all else unchanged; null stays null."""
    shared = df.sparkSession.sparkContext.broadcast(lex)

    @F.pandas_udf(T.StringType())
    def mask(s: pd.Series, extra: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else masked(t, find_personal(t, _reader(shared.value, x))) for t, x in zip(s, extra)], dtype=object)

    if lex.rest is None:
        return df.withColumn(out, mask(F.col(text), F.lit(None).cast("array<struct<r:string,w:string>>")))
    # Distinct texts are masked once and joined back.
    once = _with_rest(df.select(F.col(text).alias("t")).dropna().distinct(), lex)
    once = once.select(F.md5("t").alias("_h"), mask("t", "extra").alias(out)).dropDuplicates(["_h"])
    return df.withColumn("_h", F.md5(F.col(text))).join(once, "_h", "left").drop("_h")
