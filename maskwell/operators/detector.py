"""The rule detector: every text rule in one pass over a text, names and bodies by dictionary.

A candidate is (start, end, type, rule, tier, confidence, attributes). Tiers: 4
number with a check digit, 3 announced value, 2 pattern, 1 word list. Texts are
read whole in Arrow batches; what a pattern cannot state alone (announcements,
real dates, check digits) is decided beside it. Names found in one text of a
matter are looked for in all its texts by an equi-join on their first word.

Null and empty texts give nothing. Repeated rows give their spans once.
"""

from __future__ import annotations

import calendar
import datetime as dt
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.functions import digits as dg
from maskwell.operators.spans import keep_best
from maskwell.runtime import spread

Cand = tuple[int, int, str, str, int, float, dict]

_MONTH = "|".join(f"{n[:3]}(?:{n[3:]}|{n[3]})?" if n[:3] == "Sep" else f"{n[:3]}(?:{n[3:]})?" if n[3:] else n for n in calendar.month_name[1:])
_ORD = r"(?:st|nd|rd|th)?"
DATES = {
    "date.dmy_numeric": re.compile(r"(?<![\d./-])(?P<d>\d{1,2})(?P<sep>[./-])(?P<m>\d{1,2})(?P=sep)(?P<y>\d{4}|\d{2})(?![\d./-]*\d)"),
    "date.d_month_y": re.compile(rf"\b(?P<d>\d{{1,2}}){_ORD}(?:\s+of)?\s+(?P<mon>{_MONTH})\.?,?\s+(?P<y>\d{{4}})\b", re.I),
    "date.month_d_y": re.compile(rf"\b(?P<mon>{_MONTH})\.?\s+(?P<d>\d{{1,2}}){_ORD},?\s+(?P<y>\d{{4}})\b", re.I),
    "date.month_y": re.compile(rf"\b(?P<mon>{_MONTH})\.?,?\s+(?P<y>(?:19|20)\d{{2}})\b", re.I),
    "date.iso": re.compile(r"\b(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})\b"),
    "date.yyyymmdd": re.compile(r"(?<!\d)(?P<y>(?:19|20)\d{2})(?P<m>0[1-9]|1[0-2])(?P<d>[0-3]\d)(?!\d)"),
}
PHONES = {
    "mobile": re.compile(r"(?<![\d+])(?:\+61[ -]?4|04)\d{2}[ -]?\d{3}[ -]?\d{3}(?!\d)"),
    "landline": re.compile(r"(?<![\d+])(?:\+61[ -]?[2378]|\(0[2378]\)|0[2378])[ -]?\d{4}[ -]?\d{4}(?!\d)"),
    "1300": re.compile(r"(?<!\d)1300[ -]?\d{3}[ -]?\d{3}(?!\d)"),
    "1800": re.compile(r"(?<!\d)1800[ -]?\d{3}[ -]?\d{3}(?!\d)"),
    "13": re.compile(r"(?<![\d-])13[ -]?\d{2}[ -]?\d{2}(?![ -]?\d)"),
}
EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}")
URL = re.compile(r"\b(?:https?://|www\.)[^\s<>\"]*[^\s<>\".,;:!?)]")
# Prefixes of the public registers of health professions.
AHPRA = re.compile(r"\b(?:ATS|CHM|CHI|DEN|MED|MRP|NMW|OCC|OPT|OST|PAR|PHA|PHY|POD|PSY)\d{10}\b")
AGES = {
    "age.year_old": re.compile(r"\b(\d{1,3})[ -]years?[ -]old\b", re.I),
    "age.years_of_age": re.compile(r"\b(\d{1,3}) years of age\b", re.I),
    "age.aged": re.compile(r"(?<=\baged )(\d{1,3})\b", re.I),
    "age.label": re.compile(r"(?<=\bage: )(\d{1,3})\b", re.I),
}
_STREET = "Street|St|Road|Rd|Avenue|Ave|Court|Ct|Crescent|Cres|Drive|Dr|Lane|Ln|Parade|Pde|Place|Pl|Terrace|Tce|Close|Cl|Way|Highway|Hwy|Boulevard|Circuit|Grove|Square"
# States and territories with their names.
STATES = {"NSW": "New South Wales", "VIC": "Victoria", "QLD": "Queensland", "SA": "South Australia", "WA": "Western Australia", "TAS": "Tasmania", "NT": "Northern Territory", "ACT": "Australian Capital Territory"}
_STATE = "|".join(STATES)
_LOCALITY = rf"[A-Z][a-z]+(?: [A-Z][a-z]+){{0,2}},? (?:{_STATE}) \d{{4}}\b"
ADDRESSES = {
    "address.street": re.compile(rf"\b(?:(?:Unit|Level|Suite|Flat|Apartment) \w+,? )?\d+[A-Za-z]?(?:[/-]\d+[A-Za-z]?)? (?:[A-Z][\w'-]+ ){{1,3}}(?:{_STREET})\b\.?(?:,?\s{_LOCALITY})?"),
    "address.po_box": re.compile(rf"\b(?:G?\.?P\.?O\.? Box|Locked Bag|PMB) \d+(?:,?\s{_LOCALITY})?"),
    "address.locality": re.compile(rf"\b{_LOCALITY}"),
}
# What announces a number, and its shape.
ANNOUNCED = {
    "ctx.claim_number": ("CLAIM_NUMBER", r"claim\s+(?:number|no\.?|ref(?:erence)?)", r"[A-Z]{0,4}[-/]?\d[\dA-Z/-]{3,}"),
    "ctx.court_file": ("COURT_FILE_NUMBER", r"(?:court\s+)?file\s+(?:number|no\.?|ref)|proceedings?\s+(?:number|no\.?)", r"[A-Z]{0,3}\s?\d{1,6}[/-]\d{2,4}(?:-\d+)?|\d{3,}"),
    "ctx.passport": ("PASSPORT", r"passport(?:\s+(?:number|no\.?))?", r"[A-Z]{1,2}\d{7,8}"),
    "ctx.driver_licence": ("DRIVER_LICENCE", r"(?:driver'?s?|driving)?\s*licen[cs]e(?:\s+(?:number|no\.?))?", r"[A-Z]?\d{6,10}|\d{2,3} \d{3} \d{3}"),
    "ctx.policy": ("POLICY_NUMBER", r"policy\s+(?:number|no\.?)", r"[A-Z]{0,4}\d[\dA-Z-]{4,}"),
    "ctx.crn": ("CENTRELINK_CRN", r"(?:centrelink\s+)?(?:crn|customer\s+reference\s+number)", r"\d{3} ?\d{3} ?\d{3}[A-Z]"),
    "ctx.mrn": ("MEDICAL_RECORD_NUMBER", r"(?:mrn|urn|ur\s+number|medical\s+record\s+(?:number|no\.?))", r"[A-Z]{0,2}\d{5,10}"),
    "ctx.rego": ("VEHICLE_REGISTRATION", r"(?:vehicle\s+)?(?:registration|rego)(?:\s+(?:number|no\.?))?", r"(?=[A-Z\d ]*\d)[A-Z\d]{2,4}[ -]?[A-Z\d]{2,4}"),
    "ctx.dva": ("DVA_NUMBER", r"(?:dva|veterans'?\s+affairs)(?:\s+(?:number|no\.?|file))?", r"[A-Z]{1,4}\d{4,8}[A-Z]?"),
    "ctx.bsb": ("ACCOUNT_NUMBER", r"bsb", r"\d{3}-?\d{3}"),
    "ctx.account": ("ACCOUNT_NUMBER", r"account\s+(?:number|no\.?)", r"\d[\d -]{4,}\d"),
}
_ANNOUNCED = {k: (t, re.compile(rf"\b(?:{a})\b", re.I), re.compile(rf"(?:{v})(?!\w)")) for k, (t, a, v) in ANNOUNCED.items()}
_SEPARATORS = re.compile(r"(?:\s|[:.#(\-–]|\b(?:is|was|number|no)\b)*", re.I)
CHECKED = {
    "cs.tfn": ("TFN", "tfn", re.compile(r"(?<![\d.])\d{3}[ -]?\d{3}[ -]?\d{2,3}(?![\d.]*\d)"), re.compile(r"\btfn\b|tax file", re.I)),
    "cs.abn": ("ABN", "abn", re.compile(r"(?<!\d)\d{2}[ -]?\d{3}[ -]?\d{3}[ -]?\d{3}(?!\d)"), None),
    "cs.acn": ("ACN", "acn", re.compile(r"(?<!\d)\d{3}[ -]?\d{3}[ -]?\d{3}(?!\d)"), re.compile(r"\ba\.?c\.?n\b|company number", re.I)),
    "cs.medicare": ("MEDICARE", "medicare", re.compile(r"(?<!\d)[2-6]\d{3}[ -]?\d{5}[ -]?\d(?:[ /-]?\d)?(?!\d)"), re.compile(r"medicare", re.I)),
    "cs.provider": ("PROVIDER_NUMBER", "provider_number", re.compile(r"(?<!\w)\d{6} ?\d?[0-9A-Y] ?[A-Y](?!\w)"), None),
    "cs.ihi": ("IHI", "ihi", re.compile(r"(?<!\d)800360[ -]?(?:\d[ -]?){9}\d(?!\d)"), None),
}
BORN = re.compile(r"\b(?:date of birth|d\.?o\.?b\.?|born(?: on)?)\b", re.I)
DATE_ROLES = {"examination": ["examined", "seen on", "assessed on", "reviewed on"], "date_of_injury": ["date of injury", "injured on", "accident on"], "document": ["dated", "report of"]}

_TITLE = r"(?:Mrs|Mr|Ms|Miss|Mx|Dr|Prof|Professor|Sir|Judge|Justice|Magistrate)"
_NAME = r"(?:[A-Z](?:['’][A-Z])?[a-zà-ž]+(?:[-'’][A-Z]?[a-zà-ž]+)*|[A-Z]{2,}(?:[-'’][A-Z]+)*|[A-Z]\.)"
HONORIFIC = re.compile(rf"\b{_TITLE}\.? +({_NAME}(?: +{_NAME}){{0,2}})")
LABEL = re.compile(rf"(?:^|\n)[ \t]*(?:Name|Patient|Client|Claimant|Plaintiff|Worker|Full name|Witness)[ \t]*[:–-][ \t]*({_NAME}(?:,? +{_NAME}){{0,3}})")
RE_LINE = re.compile(rf"(?:^|\n)[ \t]*Re:[ \t]*(?:{_TITLE}\.? )?({_NAME}(?: +{_NAME}){{1,3}})")
CLOSING = re.compile(r"(?:^|\n)[ \t]*(?:Yours (?:faithfully|sincerely|truly)|Kind regards|Regards)[, \t]*(?=\n)", re.I)
NOT_NAMES = set("re dear the and of for to from in on at by with report letter date claim number road street court yours faithfully sincerely i he she they it was is".split())
# Public bodies with their role, and endings that tell an organisation's.
BODIES = {
    "Australian Taxation Office": "statutory_body", "WorkCover Queensland": "statutory_body", "Services Australia": "government", "Centrelink": "government", "Department of Home Affairs": "government",
    "Supreme Court of Queensland": "court_tribunal", "District Court of Queensland": "court_tribunal", "Fair Work Commission": "court_tribunal",
}
ENDINGS = {
    "Lawyers": "law_firm", "Solicitors": "law_firm", "Legal": "law_firm", "Medical Centre": "medical_practice", "Medical Practice": "medical_practice", "Physiotherapy": "medical_practice", "Clinic": "medical_practice",
    "Hospital": "hospital", "Pty Ltd": "employer", "Limited": "employer", "Group": "employer", "Logistics": "employer",
}
_ENDING = "|".join(sorted(map(re.escape, ENDINGS), key=len, reverse=True))
ORGANISATION = re.compile(rf"(?<![\w'])(?:[A-Z][\w'’&-]+ ){{1,4}}(?:{_ENDING})(?!\w)")
BODY = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, BODIES), key=len, reverse=True)) + r")(?!\w)")
# Countries with the word for their people.
PEOPLES = {
    "Australia": "Australian", "Vietnam": "Vietnamese", "India": "Indian", "China": "Chinese", "Italy": "Italian", "Greece": "Greek", "Germany": "German", "France": "French", "Ireland": "Irish", "Scotland": "Scottish",
    "England": "English", "Poland": "Polish", "Lebanon": "Lebanese", "Turkey": "Turkish", "Iran": "Iranian", "Iraq": "Iraqi", "Pakistan": "Pakistani", "Nepal": "Nepalese", "Japan": "Japanese", "Korea": "Korean",
    "Thailand": "Thai", "Indonesia": "Indonesian", "Malaysia": "Malaysian", "Fiji": "Fijian", "Samoa": "Samoan", "Tonga": "Tongan", "Sudan": "Sudanese", "Ethiopia": "Ethiopian", "Chile": "Chilean", "Brazil": "Brazilian",
}
_PEOPLE, _COUNTRY = "|".join(sorted(PEOPLES.values(), key=len, reverse=True)), "|".join(PEOPLES)
WORD_LISTS = {
    "lex.gender": ("GENDER", re.compile(r"(?<!\w)(?:female|male|woman|man|non-binary)(?!\w)", re.I), {}),
    "lex.sex_label": ("GENDER", re.compile(r"(?<=\bSex: )[MF]\b"), {}),
    "lex.citizenship": ("NATIONALITY", re.compile(rf"\b(?:{_PEOPLE})(?= (?:citizen|national|passport holder)\b)"), {}),
    "lex.demonym": ("NATIONALITY", re.compile(rf"\b(?:{_PEOPLE})\b(?! [A-Z])"), {}),
    "lex.country_of_origin": ("NATIONALITY", re.compile(rf"(?:(?<=born in )|(?<=migrated from )|(?<=arrived from )|(?<=citizen of ))(?:{_COUNTRY})\b"), {}),
    "lex.state": ("LOCATION", re.compile(rf"(?<!\w)(?:{'|'.join(STATES.values())}|{_STATE})(?!\w)"), {"granularity": "state"}),
}


def real_date(m: re.Match) -> tuple[str, str] | None:
    """(iso, granularity) of a matched date; two-digit years up to 40 are of this century; None if no such day."""
    g = m.groupdict()
    y = int(g["y"])
    if len(g["y"]) == 2:
        y += 2000 if y <= 40 else 1900
    month = int(g["m"]) if g.get("m") else [n[:3].lower() for n in calendar.month_name].index(g["mon"][:3].lower())
    if not g.get("d"):
        return (f"{y:04d}-{month:02d}", "month")
    try:
        return (dt.date(y, month, int(g["d"])).isoformat(), "day")
    except ValueError:
        return None


def date_candidates(t: str) -> list[Cand]:
    out = []
    for rule, rx in DATES.items():
        for m in rx.finditer(t):
            if found := real_date(m):
                out.append((m.start(), m.end(), "DATE", rule, 2, 0.9, {"iso": found[0], "granularity": found[1]}))
    return out


def pattern_candidates(t: str) -> list[Cand]:
    """Phone numbers, addresses of mail, web and streets, registrations, ages."""
    out = [(*m.span(), "PHONE", f"phone.{k}", 2, 0.9, {"number_class": k}) for k, rx in PHONES.items() for m in rx.finditer(t)]
    out += [(*m.span(), kind, kind.lower(), 2, c, {}) for kind, rx, c in (("EMAIL", EMAIL, 0.95), ("URL", URL, 0.9)) for m in rx.finditer(t)]
    out += [(*m.span(), "AHPRA_REGISTRATION", "ahpra", 2, 0.95, {}) for m in AHPRA.finditer(t)]
    out += [(*m.span(), "AGE", rule, 2, 0.85, {"years": m.group(1)}) for rule, rx in AGES.items() for m in rx.finditer(t) if 0 < int(m.group(1)) < 120]
    return out + [(m.start(), m.start() + len(m.group().rstrip(" ,\n")), "ADDRESS", rule, 2, 0.8, {}) for rule, rx in ADDRESSES.items() for m in rx.finditer(t)]


def value_window(t: str, pos: int, reach: int = 48) -> tuple[int, int]:
    """Where a value announced before ``pos`` may stand: the rest of the line, or the next line if the rest is blank."""
    end = t.find("\n", pos)
    end = len(t) if end < 0 else end
    if not t[pos:end].strip(" \t:.#-"):
        nxt = t.find("\n", end + 1)
        return pos, min(len(t) if nxt < 0 else nxt, end + 1 + reach)
    return pos, min(end, pos + reach)


def announced_candidates(t: str) -> list[Cand]:
    """Values after their announcement with nothing but separators between."""
    out = []
    for rule, (kind, rx, value) in _ANNOUNCED.items():
        for m in rx.finditer(t):
            a, b = value_window(t, m.end())
            gap = _SEPARATORS.match(t, a, b)
            v = value.match(t, gap.end(), b)
            if v:
                out.append((*v.span(), kind, rule, 3, 0.85, {}))
    return out


def checked_candidates(t: str) -> list[Cand]:
    """Numbers that satisfy their check digit; some schemes also need their name before them."""
    out = []
    for rule, (kind, check, rx, label) in CHECKED.items():
        for m in rx.finditer(t):
            if not dg.VALID[check](m.group()):
                continue
            line = t.rfind("\n", 0, m.start()) + 1
            before = t[line : m.start()]
            if not before.strip():
                before = t[t.rfind("\n", 0, max(0, line - 1)) + 1 : line]
            near = bool((label or re.compile(check.replace("_", " "), re.I)).search(before))
            if near or label is None:
                out.append((*m.span(), kind, rule, 4, 0.97 if near else 0.8, {"checksum": "valid"}))
    return out


def birth_candidates(t: str, dates: list[Cand]) -> list[Cand]:
    """The first date of the announcing words' window with only separators between; rule order, then position."""
    rank = {r: i for i, r in enumerate(DATES)}
    out = []
    for m in BORN.finditer(t):
        a, b = value_window(t, m.end())
        for d in sorted(dates, key=lambda d: (rank[d[3]], d[0])):
            if a <= d[0] and d[1] <= b and _SEPARATORS.fullmatch(t, a, d[0]):
                out.append((d[0], d[1], "DATE_OF_BIRTH", "ctx.dob", 3, 0.95, d[6]))
                break
    return out


def date_role(t: str, start: int, phrases: dict[str, list[str]] = DATE_ROLES, reach: int = 60) -> str:
    """The role whose phrase stands last before ``start``; ties go to the role named first."""
    before = t[max(0, start - reach) : start].lower()
    best = max(((before.rfind(w), -i, role) for i, (role, ws) in enumerate(phrases.items()) for w in ws), default=(-1, 0, ""))
    return best[2] if best[0] >= 0 else "other"


def cleaned_name(t: str, a: int, b: int) -> tuple[int, int] | None:
    """A name without the words of no name at its ends; None if nothing of two letters is left."""
    words = [m.span() for m in re.finditer(r"[^\s,]+", t[a:b])]
    keep = [not (t[a + x : a + y].strip(".").lower() in NOT_NAMES) for x, y in words]
    while words and not keep[0]:
        words.pop(0), keep.pop(0)
    while words and not keep[-1]:
        words.pop(), keep.pop()
    if not any(y - x >= 2 and t[a + x : a + y].rstrip(".").isalpha() or "-" in t[a + x : a + y] or "'" in t[a + x : a + y] for x, y in words):
        return None
    end = a + words[-1][1]
    return a + words[0][0], end - 2 if t[end - 2 : end] in ("'s", "’s") else end


def name_candidates(t: str) -> list[Cand]:
    """Names after a title, a label or Re:, and the first line with a name under a closing formula."""
    found = [(m.span(1), rule, tier) for rule, rx, tier in (("names.honorific", HONORIFIC, 2), ("names.label", LABEL, 3), ("names.re", RE_LINE, 3)) for m in rx.finditer(t)]
    conf = {"names.signature": 0.8}
    for m in CLOSING.finditer(t):
        pos = m.end() + 1
        for line in t[pos:].split("\n", 3)[:3]:
            if line.strip():
                s = re.match(rf"[ \t]*(?:{_TITLE}\.? )?({_NAME}(?: +{_NAME}){{1,3}})[ \t]*$", line)
                if s:
                    found.append(((pos + s.start(1), pos + s.end(1)), "names.signature", 2))
                break
            pos += len(line) + 1
    out = []
    for (a, b), rule, tier in found:
        span = cleaned_name(t, a, b)
        if span:
            out.append((*span, "PERSON", rule, tier, conf.get(rule, 0.85), {}))
    return out


def organisation_candidates(t: str) -> list[Cand]:
    out = [(*m.span(), "ORGANIZATION", "orgs.gazetteer", 3, 0.95, {"role": BODIES[m.group()]}) for m in BODY.finditer(t)]
    for m in ORGANISATION.finditer(t):
        a = m.start()
        words = m.group().split(" ")
        while len(words) > 1 and words[0].lower() in NOT_NAMES:
            a += len(words.pop(0)) + 1
        if len(words) > 1:
            out.append((a, m.end(), "ORGANIZATION", "orgs.suffix", 2, 0.75, {"role": organisation_role(m.group())}))
    return out


def organisation_role(name: str) -> str:
    return next((r for e, r in sorted(ENDINGS.items(), key=lambda x: -len(x[0])) if name.endswith(e)), "other")


def word_candidates(t: str) -> list[Cand]:
    return [(*m.span(), kind, rule, 1, 0.7, dict(attrs)) for rule, (kind, rx, attrs) in WORD_LISTS.items() for m in rx.finditer(t)]


def text_candidates(t: str) -> list[Cand]:
    """All rules on one text, unresolved."""
    dates = date_candidates(t)
    return [*dates, *pattern_candidates(t), *announced_candidates(t), *checked_candidates(t), *birth_candidates(t, dates), *name_candidates(t), *organisation_candidates(t), *word_candidates(t)]


_CAND = "start_off int, end_off int, entity_type string, rule string, tier int, confidence double, attributes string"


def candidates(texts: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(keep..., start_off, end_off, entity_type, rule, tier, confidence, attributes as JSON, text): one pass over the texts."""
    rows = spread(texts.select(*keep, F.col(text).alias("_t")).filter("_t IS NOT NULL AND _t <> ''"))
    schema = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep) + f", {_CAND}, text string"
    names = [*keep, "start_off", "end_off", "entity_type", "rule", "tier", "confidence", "attributes", "text"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for *key, t in zip(*[b[c] for c in keep], b["_t"]):
                out += [(*key, *c[:6], json.dumps(c[6], sort_keys=True), t[c[0] : c[1]]) for c in text_candidates(t)]
            if out:
                yield pd.DataFrame(out, columns=names)

    # Repeated rows are told by what was found in them, so that no text is shuffled.
    return rows.mapInPandas(read, schema).distinct()


def name_seeds(found: DataFrame, scope: str) -> DataFrame:
    """(scope, form): full names, surnames of 3 letters or more and given names of 2 or more, as written and in capitals."""
    w = F.filter(F.split(F.regexp_replace("text", "[.,]", " "), r"\s+"), lambda x: F.length(x) > 1)
    one = found.filter("entity_type = 'PERSON' AND rule LIKE 'names.%'").select(scope, "text", w.alias("w")).filter(F.size("w") > 0)
    last, first = F.element_at("w", -1), F.element_at("w", 1)
    forms = F.array_compact(F.array(F.regexp_replace("text", r"\s+", " "), F.when(F.length(last) >= 3, last), F.when((F.size("w") > 1) & (F.length(first) >= 2), first)))
    one = one.select(scope, F.explode(forms).alias("form"))
    return one.union(one.select(scope, F.upper("form"))).distinct()


def propagated(texts: DataFrame, keep: list[str], scope: str, seeds: DataFrame, text: str = "text") -> DataFrame:
    """Every whole-word place of a seed in the texts of its scope (tier 1).

    Words of texts meet the first words of seeds; what follows is compared then.
    """
    token = r"[\p{L}\p{N}'’-]+"
    cols = list(dict.fromkeys([*keep, scope]))
    src = texts.select(*cols, F.col(text).alias("_t")).dropna(subset=["_t", scope]).distinct()
    split = src.select(*cols, "_t", F.regexp_extract_all("_t", F.lit(token), F.lit(0)).alias("_m"), F.split("_t", token, -1).alias("_g"))
    none = F.array().cast("array<struct<at:int,w:string>>")
    step = lambda acc, x: F.when(x["_m"].isNull(), acc).otherwise(F.struct((acc["at"] + F.length(x["_g"]) + F.length(x["_m"])).alias("at"), F.array_append(acc["out"], F.struct((acc["at"] + F.length(x["_g"])).alias("at"), x["_m"].alias("w"))).alias("out")))
    placed = F.aggregate(F.arrays_zip("_g", "_m"), F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
    words = split.select(*cols, "_t", placed.alias("p")).select(*cols, "_t", F.explode("p").alias("p")).select(*cols, "_t", "p.at", F.regexp_replace("p.w", r"['’]s$", "").alias("_w"))
    forms = seeds.select(scope, "form", F.regexp_extract("form", token, 0).alias("_w")).filter("_w <> ''")
    hit = words.join(forms, [scope, "_w"])
    end = F.col("at") + F.length("form")
    hit = hit.filter((F.substring("_t", F.col("at") + 1, F.length("form")) == F.col("form")) & ~F.substring("_t", end + 1, F.lit(1)).rlike(r"^[\p{L}\p{N}]"))
    return hit.select(
        *keep, F.col("at").cast("int").alias("start_off"), end.cast("int").alias("end_off"), F.lit("PERSON").alias("entity_type"), F.lit("names.propagated").alias("rule"), F.lit(1).alias("tier"), F.lit(0.6).alias("confidence"),
        F.lit("{}").alias("attributes"), F.col("form").alias("text"),
    ).distinct()


def resolved(cands: DataFrame, key: list[str]) -> DataFrame:
    """Non-overlapping candidates: higher tier, then longer, earlier, type, rule."""
    order = [-F.col("tier"), -(F.col("end_off") - F.col("start_off")), F.col("start_off"), F.col("entity_type"), F.col("rule")]
    return keep_best(cands, order, key)


def detected(texts: DataFrame, keep: list[str], scope: str, text: str = "text") -> DataFrame:
    """The whole detector: candidates, names carried through their scope, overlaps resolved.

    ``keep`` is the key of a text, ``scope`` (a matter) the texts that share names.
    """
    cols = list(dict.fromkeys([*keep, scope]))
    found = candidates(texts, cols, text)
    everywhere = propagated(texts, cols, scope, name_seeds(found, scope), text)
    return resolved(found.unionByName(everywhere), cols)


_RUN = re.compile(r"\d[\d \-]{6,}\d")
_CAPITAL = re.compile(r"(?<![.!?:]\s)(?<![.!?:]\n)(?<=[a-z,;] )[A-Z][a-z]{2,}\b")


def audit_scan(texts: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(keep..., start_off, end_off, rule, text): wide scans that only fill an audit pool.

    Digit runs that satisfy a check digit (the first scheme by name), and
    capitalised words inside sentences.
    """
    rows = spread(texts.select(*keep, F.col(text).alias("_t")).filter("_t IS NOT NULL AND _t <> ''"))
    schema = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep) + ", start_off int, end_off int, rule string, text string"

    def read(batches):
        for b in batches:
            out = []
            for *key, t in zip(*[b[c] for c in keep], b["_t"]):
                for m in _RUN.finditer(t):
                    kind = next((k for k in sorted(dg.VALID) if dg.VALID[k](m.group())), None)
                    if kind:
                        out.append((*key, *m.span(), f"scan.checksum.{kind}", m.group()))
                out += [(*key, *m.span(), "scan.capitalised", m.group()) for m in _CAPITAL.finditer(t) if m.group().lower() not in NOT_NAMES]
            if out:
                yield pd.DataFrame(out, columns=[*keep, "start_off", "end_off", "rule", "text"])

    # Repeated rows are told by what was found in them, so that no text is shuffled.
    return rows.mapInPandas(read, schema).distinct()
