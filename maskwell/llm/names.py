"""Variant spellings of names typed by people.

Method: noisy-channel attribution. Inside one matter every distinct spelling is
parsed once; spellings are ranked as candidate canonical forms by how complete
and how frequent they are (in the matter and over the corpus). Each spelling is
attached to the candidate of higher rank that maximises log prior plus log
likelihood of the typing channel: edits, transpositions, sound-alike letters,
nicknames, initials, abbreviations, acronyms, dropped words, reordered parts.
A spelling no candidate explains stays its own entity. Attachments are followed
to their roots with hash-to-min components.

The words of a matter that are near each other are found once, through
symmetric-delete keys that carry the matter; spellings then meet on a whole word
near their own and an initial, so that a spelling costs a few rows and no matter
is ever gathered in one task. No two spellings meet that share no such word.
Which word is a surname, and which nickname stands for which given name, is
counted over all rows ("Katherine (Kathy) ..." and "Surname, Given" forms).

Rows with a null matter, type, id or text, or with no letters, name nobody and
take no part. Identical spellings are one node, so ties and repeated rows cost
nothing; order of equal candidates is fixed by spelling.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.llm.glyphs import settled
from maskwell.llm.splits import hash_to_min
from maskwell.runtime import stage

# Words before or after a name that are no part of it.
HONORIFICS = set(
    "mr mrs ms miss mx master dr doctor prof professor assoc sir dame lord lady rev reverend fr father hon justice "
    "judge magistrate senator cr capt captain sgt const constable nurse sister jr snr sr ii iii am ao oam qc kc sc md phd".split()
)
# Surname particles written apart from the name they belong to.
PARTICLES = set("van von der den de del della di da dos du la le el al bin ibn ter ten st abu".split())
# Legal forms that end an organisation's name.
LEGAL_FORMS = set("pty ltd limited inc incorporated llc llp plc corp gmbh pl proprietary".split())
# Short forms of given names, the given names first.
NICKNAMES = {
    "abigail": "abby gail", "alexander": "alex sandy xander sasha", "alexandra": "alex lexie sasha sandra", "andrew": "andy drew",
    "anthony": "tony ant", "barbara": "barb babs", "benjamin": "ben benny", "catherine": "cathy cate kate katie", "charles": "charlie chuck",
    "christina": "chris tina", "christine": "chris chrissie", "christopher": "chris kit topher", "cynthia": "cindy", "daniel": "dan danny",
    "david": "dave davey", "deborah": "deb debbie", "dorothy": "dot dottie dolly", "edward": "ed eddie ned ted teddy",
    "eleanor": "ellie nell nora", "elizabeth": "liz lizzie beth betty eliza bess", "florence": "flo florrie", "francis": "frank fran",
    "frederick": "fred freddie", "gabrielle": "gabby", "george": "georgie", "geraldine": "gerry", "gregory": "greg", "harold": "harry hal",
    "henry": "harry hank", "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny", "john": "jack johnny", "jonathan": "jon jonno jonny",
    "joseph": "joe joey", "josephine": "jo josie", "katherine": "kathy kate katie kit", "kenneth": "ken kenny", "lawrence": "larry loz laurie",
    "leonard": "len lenny leo", "margaret": "marg maggie peggy meg", "matthew": "matt", "michael": "mick mike mikey", "nicholas": "nick nico",
    "pamela": "pam", "patricia": "pat patty trish tricia", "patrick": "pat paddy", "penelope": "penny", "peter": "pete", "philip": "phil",
    "raymond": "ray", "rebecca": "bec becky", "richard": "rick dick rich", "robert": "bob bobby rob robbie bert", "ronald": "ron",
    "samuel": "sam sammy", "samantha": "sam", "stephanie": "steph", "stephen": "steve", "steven": "steve", "susan": "sue susie",
    "theodore": "ted teddy theo", "thomas": "tom tommy", "timothy": "tim", "victoria": "vicki tori vic", "vincent": "vin vinnie",
    "william": "bill billy will liam", "zachary": "zac zach",
}
# Letters that sound alike in names.
SOUNDS = [("ph", "f"), ("ck", "k"), ("c", "k"), ("q", "k"), ("z", "s"), ("y", "i"), ("w", "v"), ("h", ""), ("j", "i")]

TOO_FAR = -1e9
#: Log likelihoods of the typing channel.
EDIT, SECOND_EDIT, SOUND_ALIKE, NICKNAME, INITIAL, MISSING, SHORTENED, ACRONYM = -2.5, -4.5, -1.5, -1.0, -0.7, -1.2, -0.7, -2.0
#: A spelling stays its own entity unless the best attachment beats this.
THRESHOLD = -5.5


def bare(s: str) -> str:
    """Lower case without accents."""
    s = s.replace("ø", "o").replace("Ø", "O").replace("ß", "ss").replace("ł", "l").replace("æ", "ae").replace("œ", "oe")
    return "".join(c for c in unicodedata.normalize("NFD", s.casefold()) if not unicodedata.combining(c))


def sound(w: str) -> str:
    for a, b in SOUNDS:
        w = w[:1].replace("j", "j") + w[1:].replace(a, b) if a == "j" else w.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", w)


@lru_cache(maxsize=200_000)
def edits(a: str, b: str, most: int = 2) -> int:
    """Optimal string alignment distance, or ``most`` + 1 beyond ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            cur.append(d)
        if min(cur) > most:
            return most + 1
        prev2, prev = prev, cur
    return min(prev[-1], most + 1)


def word_ll(v: str, c: str) -> float:
    """Log likelihood that ``c`` was typed as ``v``."""
    if v == c:
        return 0.0
    d = edits(v, c)
    if d == 1 and min(len(v), len(c)) >= 4:
        return EDIT
    if len(v) > 2 and sound(v) == sound(c):
        return SOUND_ALIKE
    if d == 1 and min(len(v), len(c)) == 3:
        return EDIT - 1.5
    if d == 2 and min(len(v), len(c)) >= 6:
        return SECOND_EDIT
    return TOO_FAR


def shortens(v: str, c: str) -> bool:
    """``v`` abbreviates ``c``: same first letter, the rest in order."""
    if not 2 <= len(v) < len(c) or v[0] != c[0]:
        return False
    if c.startswith(v):
        return len(v) < len(c) - 1 or len(c) > 6
    it = iter(c)
    return all(ch in it for ch in v) and sum(ch in "aeiou" for ch in v) < sum(ch in "aeiou" for ch in c) and len(v) <= len(c) - 2


_PAREN = re.compile(r"[(\[\"“]\s*([^)\]\"”]+?)\s*[)\]\"”]")
_WORD = re.compile(r"[^\W\d_]+(?:['’`´\-‐‑][^\W\d_]+)*|\d+")
_JOINERS = str.maketrans("", "", "'’`´-‐‑")


def person_parses(text: str) -> list[tuple]:
    """Possible readings (given, middles, surname, nickname, level, penalty).

    Level 3 has a given name and a surname, 2 an initial and a surname, 1 a
    surname, 0 one bare word that may be either.
    """
    nick = ""
    m = _PAREN.search(text)
    if m:
        nick = bare(m.group(1)).translate(_JOINERS)
        text = text[: m.start()] + " " + text[m.end() :]
    text = re.sub(r"['’]s\b", "", text)
    comma = text.find(",")
    left_words = 0
    toks: list[str] = []
    titled = False
    carry = ""
    for w in _WORD.finditer(text):
        raw = bare(w.group()).translate(_JOINERS)
        if raw in HONORIFICS and not (comma >= 0 and w.start() < comma and not toks and text[comma + 1 :].strip() == ""):
            titled = True
            continue
        if raw in PARTICLES and not (toks and comma < 0 and w.end() == len(text.rstrip())):
            carry += raw
            continue
        toks.append(carry + raw)
        carry = ""
        if comma >= 0 and w.start() < comma:
            left_words = len(toks)
    if carry:
        toks.append(carry)
    if not toks:
        return []
    if comma >= 0 and 0 < left_words < len(toks):
        sur, rest = "".join(toks[:left_words]), toks[left_words:]
        full = len(rest[0]) > 1
        return [(rest[0], " ".join(rest[1:]), sur, nick, 3 if full else 2, 0.0)]
    k = len(toks)
    if k == 1:
        return [("", "", toks[0], nick, 1, 0.0)] if titled else [("", "", toks[0], nick, 1, -0.7), (toks[0], "", "", nick, 0, -0.7)]
    ini = [len(t) == 1 for t in toks]
    lead = 0
    while lead < k and ini[lead]:
        lead += 1
    if lead == k:
        return []
    if lead:
        return [(toks[0], " ".join(toks[1:lead]), "".join(toks[lead:]), nick, 2, 0.0)]
    if all(ini[1:]):
        return [(toks[1], " ".join(toks[2:]), toks[0], nick, 2, -0.3)]
    if k == 2:
        return [(toks[0], "", toks[1], nick, 3, 0.0), (toks[1], "", toks[0], nick, 3, -1.5)]
    mid = toks[1:-1]
    out = [(toks[0], " ".join(mid), toks[-1], nick, 3, 0.0), (toks[1], " ".join(toks[2:]), toks[0], nick, 3, -1.5)]
    if not ini[-2] and not ini[-1]:
        out.append((toks[0], " ".join(toks[1:-2]), toks[-2] + toks[-1], nick, 3, -0.8))
    if k == 3 and not ini[1] and not ini[2]:
        out.append((toks[2], "", toks[0] + toks[1], nick, 3, -2.0))
    return out


def org_words(text: str) -> tuple[list[str], bool]:
    """(words in natural order, whether it is an acronym)."""
    text = re.sub(r"\bp\s*/\s*l\b\.?", " pty ltd ", text, flags=re.I).replace("&", " and ").replace("＆", " and ")
    dotted = re.fullmatch(r"\s*(?:[^\W\d_]\.\s*){2,6}", text)
    if dotted:
        return [bare(re.sub(r"[\s.]", "", text))], True
    comma = text.find(",")
    head, tail = (text[:comma], text[comma + 1 :]) if comma > 0 else (text, "")
    words = []
    for part in (tail, head):
        ws = [bare(w.group()).translate(_JOINERS) for w in re.finditer(r"[\w'’\-]+", part)]
        words.append([w for w in ws if w and w not in LEGAL_FORMS])
    if ws_the := (words[0] or words[1]):
        if ws_the[0] == "the":
            ws_the.pop(0)
    if words[1][:1] == ["the"]:
        words[1].pop(0)
    ws = words[0] + words[1]
    raw = re.sub(r"\W", "", text)
    acronym = len(ws) == 1 and 2 <= len(ws[0]) <= 5 and (raw.isupper() or sum(c in "aeiou" for c in ws[0]) == 0)
    return ws, acronym


def keys_of(etype: str, level: int, given: str, surname: str, formals: list[str] | None) -> tuple[list[tuple], list[tuple]]:
    """(index, probe): keys (kind, role, word, tail) a spelling is found under and looks for.

    Words meet words near them of the same role, the rest of a key must be equal.
    Role A (acronyms) takes equal words only.
    """
    if etype != "PERSON":
        ws = surname.split(" ")
        if level == 1:
            return [], [("A", "A", surname, "")]
        own = [("O", "O", ws[0], ws[1][0] if len(ws) > 1 else "")]
        if len(ws) > 2 and len(ws[1]) > 3:
            own.append(("T", "T", ws[1], ws[0][0]))
        full = "".join(w[0] for w in ws)
        short = "".join(w[0] for w in ws if w not in ("and", "of", "the", "for"))
        return own + [("A", "A", x, "") for x in sorted({full, short})], own
    if level == 0:
        return [("Q", "N", given, "")], [("Q", "N", given, "")]
    if level == 1:
        return [("P", "S", surname, "")], [("P", "S", surname, "")]
    heads = [("S", "S", surname, i) for i in sorted({given[0], *(f[0] for f in formals or [])})]
    if level == 2:
        return [*heads, ("P", "S", surname, "")], heads
    names = sorted({given, *(formals or [])})
    tails = [("G", "N", g, surname[:1]) for g in names] if len(given) > 3 else []
    return [*heads, *tails, ("P", "S", surname, ""), *(("Q", "N", g, "") for g in names)], [*heads, *tails]


def _cuts(role: Column, word: Column) -> Column:
    """The word and, if it is long enough to have slips, the word less one letter."""
    less = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.when((role != "A") & (F.length(word) > 3), F.array_distinct(F.array_append(less, word))).otherwise(F.array(word))


def given_ll(v: str, c: str, vf: list[str], cf: list[str]) -> float:
    if not v or not c:
        return MISSING
    if len(v) == 1 or len(c) == 1:
        firsts = {c[0], *(f[0] for f in cf)} if len(v) == 1 else {v[0], *(f[0] for f in vf)}
        return INITIAL if (v[0] if len(v) == 1 else c[0]) in firsts else TOO_FAR
    best = word_ll(v, c)
    for a in vf:
        best = max(best, NICKNAME + word_ll(a, c))
    for b in cf:
        best = max(best, NICKNAME + word_ll(v, b))
    for a in vf:
        if a in cf:
            best = max(best, 2 * NICKNAME)
    return best


def middle_ll(v: str, c: str) -> float:
    a, b = v.split(), c.split()
    if not a or not b:
        return 0.0
    return 0.3 if a[0][0] == b[0][0] else -1.5


def org_ll(v: list[str], c: list[str], v_acronym: bool) -> float:
    if v_acronym:
        a = "".join(w[0] for w in c)
        b = "".join(w[0] for w in c if w not in ("and", "of", "the", "for"))
        return ACRONYM if v[0] in (a, b) and len(c) > 1 else TOO_FAR
    short, long = (v, c) if len(v) <= len(c) else (c, v)
    gone = len(long) - len(short)
    if gone > 2 or (gone and len(short) < 2):
        return TOO_FAR
    total = SHORTENED * (gone > 0)
    for i, w in enumerate(short):
        x = long[i]
        a, b = (w, x) if short is v else (x, w)
        ll = word_ll(a, b)
        if i and (shortens(a, b) or shortens(b, a)):
            ll = max(ll, SHORTENED / 2)
        total += ll
    return total


def attach_ll(etype: str, v: tuple, c: tuple) -> float:
    """Log likelihood of spelling ``v`` given canonical ``c``.

    Each is (level, given, middles, surname, formals, word frequencies).
    """
    if etype != "PERSON":
        return org_ll(v[3].split(" "), c[3].split(" "), v[0] == 1)
    sur = word_ll(v[3], c[3]) if v[3] and c[3] else MISSING
    giv = given_ll(v[1], c[1], v[4], c[4])
    if not (v[3] and c[3]) and (not v[1] or not c[1]):
        return TOO_FAR
    return sur + giv + middle_ll(v[2], c[2])


_PARSE = T.ArrayType(
    T.StructType(
        [
            T.StructField("given", T.StringType()),
            T.StructField("mid", T.StringType()),
            T.StructField("sur", T.StringType()),
            T.StructField("nick", T.StringType()),
            T.StructField("level", T.IntegerType()),
            T.StructField("penalty", T.DoubleType()),
        ]
    )
)


@F.pandas_udf(_PARSE)
def _parses(etype: pd.Series, text: pd.Series) -> pd.Series:
    out = []
    for e, t in zip(etype, text):
        if e == "PERSON":
            rows = person_parses(t)
        else:
            ws, acronym = org_words(t)
            rows = [("", "", " ".join(ws), "", 1 if acronym else 3, 0.0)] if ws else []
        out.append([dict(zip(("given", "mid", "sur", "nick", "level", "penalty"), r)) for r in rows])
    return pd.Series(out)


_KEY = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "role", "word", "tail")]))
_KEYS = T.StructType([T.StructField("index", _KEY), T.StructField("probe", _KEY)])


@F.pandas_udf(_KEYS)
def _keys(etype: pd.Series, level: pd.Series, given: pd.Series, sur: pd.Series, formals: pd.Series) -> pd.DataFrame:
    named = lambda ks: [dict(zip(("kind", "role", "word", "tail"), k)) for k in ks]
    rows = [tuple(map(named, keys_of(e, lv, g, s, list(f) if f is not None else []))) for e, lv, g, s, f in zip(etype, level, given, sur, formals)]
    return pd.DataFrame(rows, columns=["index", "probe"])


@F.pandas_udf(T.DoubleType())
def _score(etype: pd.Series, v: pd.DataFrame, c: pd.DataFrame) -> pd.Series:
    out = []
    vs = zip(v["level"], v["given"], v["mid"], v["sur"], v["formals"], v["df_s"], v["df_g"])
    cs = zip(c["level"], c["given"], c["mid"], c["sur"], c["formals"], c["df_s"], c["df_g"])
    for e, a, b in zip(etype, vs, cs):
        ll = attach_ll(e, (*a[:4], list(a[4]) if a[4] is not None else []), (*b[:4], list(b[4]) if b[4] is not None else []))
        if ll > TOO_FAR and e == "PERSON":
            # A word as well attested as the other is a name of its own, no slip of it.
            for i, f in ((3, 5), (1, 6)):
                x, y = a[i], b[i]
                if len(x) > 1 and len(y) > 1 and x != y and sound(x) != sound(y) and edits(x, y) <= 2:
                    if min(a[f], b[f]) >= 3 and min(a[f], b[f]) >= 0.12 * max(a[f], b[f]):
                        if not (i == 1 and set(a[4]).intersection([y, *b[4]]) | set(b[4]).intersection([x])):
                            ll -= 6.0
        out.append(ll)
    return pd.Series(out)


def _short_forms(spellings: DataFrame) -> DataFrame:
    """(nick, formals): the fixed short forms and those the corpus explains in brackets."""
    spark = spellings.sparkSession
    fixed = [(n, g) for g, ns in NICKNAMES.items() for n in ns.split()]
    known = spark.createDataFrame(fixed, "nick string, formal string")
    seen = (
        spellings.filter("etype = 'PERSON'")
        .select(F.explode("parses").alias("p"), "n", "matter")
        .filter("length(p.nick) > 1 AND length(p.given) > 1 AND p.penalty = 0")
        .groupBy(F.col("p.nick").alias("nick"), F.col("p.given").alias("formal"))
        .agg(F.countDistinct("matter").alias("m"))
        .filter("m >= 2 AND nick <> formal")
        .select("nick", "formal")
    )
    return known.union(seen).groupBy("nick").agg(F.sort_array(F.collect_set("formal")).alias("formals"))


def spelling_entities(mentions: DataFrame) -> DataFrame:
    """(matter, etype, id, entity): ``mentions`` (matter, etype, id, text) resolved.

    ``entity`` is the smallest spelling id of its entity, unique within matter
    and type.
    """
    base = mentions.select("matter", "etype", F.col("id").cast("string").alias("id"), settled("text").alias("t")).dropna()
    base = base.select("matter", "etype", "id", F.trim(F.regexp_replace("t", r"\s+", " ")).alias("t")).filter(F.col("t").rlike(r"\p{L}")).distinct()
    base = base.withColumn("sid", F.md5(F.concat_ws("\x1f", "matter", "etype", F.when(F.col("etype") == "PERSON", F.lower("t")).otherwise(F.col("t")))))
    base, _ = stage(base, "mention")
    spell = base.groupBy("sid", "matter", "etype").agg(F.min("t").alias("t"), F.countDistinct("id").alias("n"))
    spell = spell.withColumn("parses", _parses("etype", "t")).filter(F.size("parses") > 0)
    spell, _ = stage(spell, "spelling")
    # Role counts over the corpus, from spellings with one reading only.
    sure = spell.filter("etype = 'PERSON' AND size(parses) = 1").select("n", F.col("parses")[0].alias("p"))
    # One pass over unambiguous readings; counts per word, pre-aggregated.
    roles = (
        sure.select(
            "n",
            F.explode(
                F.array(
                    F.struct(F.col("p.sur").alias("w"), F.lit(1).alias("s"), F.lit(0).alias("g")),
                    F.struct(F.when(F.length("p.given") > 1, F.col("p.given")).alias("w"), F.lit(0).alias("s"), F.lit(1).alias("g")),
                    F.struct(F.when(F.length("p.mid") > 1, F.col("p.mid")).alias("w"), F.lit(0).alias("s"), F.lit(1).alias("g")),
                )
            ).alias("r"),
        )
        .filter("r.w IS NOT NULL AND r.w <> ''")
        .groupBy("r.w")
        .agg(F.sum(F.col("r.s") * F.col("n")).alias("ns"), F.sum(F.col("r.g") * F.col("n")).alias("ng"))
    )
    opened = spell.select("sid", "matter", "etype", "t", "n", F.explode("parses").alias("p")).select("sid", "matter", "etype", "t", "n", "p.*")

    def odds(frame: DataFrame, word: str, out: str, sign: int) -> DataFrame:
        r = roles.select(F.col("w").alias(word), (sign * F.ln((F.col("ns") + 0.5) / (F.col("ng") + 0.5))).alias(out))
        return frame.join(r, word, "left").fillna(0.0, [out])

    opened = odds(odds(odds(opened, "sur", "o_s", 1), "given", "o_g", -1), "mid", "o_m", -1)
    opened = opened.withColumn("fit", F.col("penalty") + F.col("o_s") + F.col("o_g") + F.col("o_m"))
    one = opened.groupBy("sid").agg(F.max_by(F.struct("matter", "etype", "t", "n", "given", "mid", "sur", "level"), F.struct("fit", "sur")).alias("x"))
    one = one.select("sid", "x.*")
    # Word frequencies in matters, over the corpus.
    df_s = one.filter("sur <> ''").groupBy("sur").agg(F.countDistinct("matter").cast("double").alias("df_s"))
    df_g = one.filter("length(given) > 1").groupBy("given").agg(F.countDistinct("matter").cast("double").alias("df_g"))
    nick = _short_forms(spell)
    one = (
        one.join(df_s, "sur", "left")
        .join(df_g, "given", "left")
        .join(nick.withColumnRenamed("nick", "given"), "given", "left")
        .fillna(0.0, ["df_s", "df_g"])
        .withColumn("formals", F.coalesce("formals", F.array().cast("array<string>")))
    )
    # The rank of a candidate: completeness, then the frequency prior, then spelling.
    prior = F.log1p("n") + 0.5 * F.log1p("df_s") + 0.5 * F.log1p("df_g")
    words = F.when(F.col("etype") == "PERSON", F.lit(0)).otherwise(F.size(F.split("sur", " ")))
    full = F.length(F.regexp_replace("sur", " ", "")).cast("double") / 100
    one = one.withColumn("rank", F.struct("level", words.alias("words"), (F.round(prior + F.when(F.col("etype") == "PERSON", 0.0).otherwise(full), 6)).alias("prior"), "sid"))
    one = one.withColumn("k", _keys("etype", "level", "given", "sur", "formals"))
    one, _ = stage(one, "reading")
    body = F.struct("level", "given", "mid", "sur", "formals", "df_s", "df_g")
    whose = F.concat_ws("\x1f", "matter", "etype")
    # Of the words of a matter, which are near which: one row a word, not a spelling.
    key = lambda side, who: one.select(F.col("sid").alias(who), F.col("rank").alias(f"{who}r"), F.xxhash64(whose).alias("w"), F.explode(f"k.{side}").alias("k")).select(who, f"{who}r", "w", "k.*")
    probe, index = key("probe", "v"), key("index", "c")
    cuts = F.explode(_cuts(F.col("role"), F.col("word"))).alias("cut")
    near = lambda df, name: df.select("w", "role", "word").distinct().withColumn("cut", cuts).withColumn("h", F.xxhash64("w", "role", "cut")).drop("cut").withColumnRenamed("word", name)
    words = near(probe, "word").join(near(index, "other").drop("w", "role"), "h").select("w", "role", "word", "other").distinct()
    probe = probe.join(words, ["w", "role", "word"]).select("v", "vr", F.xxhash64("w", "kind", "other", "tail").alias("h"))
    pairs = probe.join(index.select("c", "cr", F.xxhash64("w", "kind", "word", "tail").alias("h")), "h")
    pairs = pairs.filter("cr > vr").select("v", "c").distinct()
    va = one.select(F.col("sid").alias("v"), "etype", F.col("matter").alias("vm"), body.alias("vb"))
    ca = one.select(F.col("sid").alias("c"), F.col("matter").alias("cm"), body.alias("cb"), F.col("rank.prior").alias("prior"))
    scored = pairs.join(va, "v").join(ca, "c").filter("vm = cm").withColumn("ll", _score("etype", "vb", "cb"))
    best = (
        scored.filter(F.col("ll") > THRESHOLD)
        .groupBy("v")
        .agg(F.max_by("c", F.struct(F.col("ll") + 0.6 * F.col("prior"), F.col("c"))).alias("c"))
    )
    edges = one.select(F.col("sid").alias("a")).join(best, F.col("a") == F.col("v"), "left").select("a", F.coalesce("c", "a").alias("b"))
    roots = hash_to_min(edges)
    return base.join(roots, base["sid"] == roots["node"]).select("matter", "etype", "id", F.col("component").alias("entity"))


def same_entity_pairs(resolved: DataFrame, *extra: str) -> DataFrame:
    """(id_a, id_b) with id_a < id_b for ids of one entity."""
    keys = ["matter", "etype", "entity", *extra]
    one = resolved.select(*keys, "id").distinct()
    many = one.groupBy(*keys).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select(*keys)
    one = one.join(many, keys, "left_semi")
    return one.withColumnRenamed("id", "id_a").join(one.withColumnRenamed("id", "id_b"), keys).filter("id_a < id_b").select("id_a", "id_b").distinct()


def group_entities(groups: DataFrame, resolved: DataFrame) -> DataFrame:
    """(matter, etype, id, entity) of link groups: the entity most members name.

    Groups none of whose members is known fall out; ties take the smaller entity.
    """
    member = groups.select("group_id", F.col("matter_id").alias("matter"), F.explode("members").alias("id")).dropna().distinct()
    votes = member.join(resolved.filter("etype = 'PERSON'"), ["matter", "id"]).groupBy("group_id", "matter", "etype", "entity").agg(F.count("*").alias("votes"))
    lead = votes.groupBy("group_id", "matter", "etype").agg(F.min_by("entity", F.struct(-F.col("votes"), F.col("entity"))).alias("entity"))
    return lead.select("matter", "etype", F.col("group_id").alias("id"), "entity")
