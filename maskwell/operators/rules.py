"""Text rules: each names a type, a tier and a pattern.

Fixed values: the public shapes of Australian numbers, dates and addresses.
Patterns use no look-around, so that the same text can be scanned anywhere.
"""

from __future__ import annotations

import calendar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.operators.spans import placed
from maskwell.runtime import spread

# Full names before their short forms, of three letters and for September also four.
MONTHS = "|".join([*calendar.month_name[1:], "Sept", *(a for a, n in zip(calendar.month_abbr[1:], calendar.month_name[1:]) if a != n)])
RULES = {
    "email": ("EMAIL", 2, r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"),
    "url": ("URL", 2, r"\b(?:https?://|www\.)[A-Za-z0-9./%_\-]*[A-Za-z0-9/]"),
    "date.dmy": ("DATE", 2, r"\b(?:0?[1-9]|[12][0-9]|3[01])/(?:0?[1-9]|1[0-2])/(?:19|20)[0-9]{2}\b"),
    "date.iso": ("DATE", 2, r"\b(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])\b"),
    "date.words": ("DATE", 2, rf"\b(?:0?[1-9]|[12][0-9]|3[01]) (?:{MONTHS}) (?:19|20)[0-9]{{2}}\b"),
    "phone.mobile": ("PHONE", 2, r"\b04[0-9]{2}[ \-]?[0-9]{3}[ \-]?[0-9]{3}\b"),
    "phone.landline": ("PHONE", 2, r"\(0[2378]\) [0-9]{4} [0-9]{4}\b"),
    "phone.1300": ("PHONE", 2, r"\b1300[ \-]?[0-9]{3}[ \-]?[0-9]{3}\b"),
    "phone.1800": ("PHONE", 2, r"\b1800[ \-]?[0-9]{3}[ \-]?[0-9]{3}\b"),
    "address.box": ("ADDRESS", 2, r"\bPO Box [0-9]+\b"),
    "address.street": ("ADDRESS", 2, r"\b[0-9]{1,4}[A-Z]? [A-Z][a-z]+ (?:Street|Road|Avenue|Court|Crescent|Lane|Parade|St|Rd|Ave|Ct|Cres|Ln|Pde)\b"),
    "claim": ("CLAIM_NUMBER", 3, r"\b(?:WC|CL|MV)[0-9]{7}\b"),
    "abn": ("ABN", 4, r"\bABN [0-9]{2} [0-9]{3} [0-9]{3} [0-9]{3}\b"),
    "passport": ("PASSPORT", 3, r"\b(?:PA|RB|[NE])[0-9]{7}\b"),
    "titled": ("PERSON", 2, r"\b(?:Dr|Mr|Mrs|Ms|Miss|Prof) [A-Z][A-Za-z\x{C0}-\x{24F}]+"),
}


def rule_spans(df: DataFrame, ident: str, text: str, *names: str) -> DataFrame:
    """(ident, rule, entity_type, tier, start_off, end_off, text) of the named rules, all by default, in one scan."""
    names = names or tuple(RULES)
    t = F.col(text)
    cols = []
    for i, name in enumerate(names):
        cols += [F.regexp_extract_all(t, F.lit(RULES[name][2]), F.lit(0)).alias(f"_m{i}"), F.split(t, RULES[name][2], -1).alias(f"_g{i}")]
    one = lambda i, n: F.transform(
        placed(F.col(f"_m{i}"), F.col(f"_g{i}")), lambda s: F.struct(F.lit(n).alias("rule"), F.lit(RULES[n][0]).alias("entity_type"), F.lit(RULES[n][1]).alias("tier"), s["start_off"].alias("start_off"), s["text"].alias("text"))
    )
    found = spread(df.select(ident, text).filter(t.isNotNull())).select(ident, *cols).select(ident, F.explode(F.flatten(F.array(*[one(i, n) for i, n in enumerate(names)]))).alias("s"))
    return found.select(ident, "s.rule", "s.entity_type", "s.tier", "s.start_off", (F.col("s.start_off") + F.length("s.text")).alias("end_off"), "s.text")
