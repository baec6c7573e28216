"""What is done with a mention, as one compiled CASE over type, role and attributes.

The table of rules is a parameter; ``RULES`` and ``DEFAULTS`` below are what is
used where none is given. The first rule that matches wins; an attribute or role
that is null matches nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (conditions, action, strategy), first match wins.
RULES: list[tuple[dict[str, list[str]], str, str | None]] = [
    ({"entity_type": ["ORGANIZATION"], "role": ["statutory_body", "court_tribunal", "government"]}, "KEEP", None),
    ({"entity_type": ["ORGANIZATION"], "role": ["employer", "medical_practice", "hospital", "law_firm"]}, "SYNTHETIC", "org_name"),
    ({"entity_type": ["PERSON"], "role": ["court_officer"]}, "KEEP", None),
    ({"entity_type": ["LOCATION"], "granularity": ["country", "state"]}, "KEEP", None),
    ({"entity_type": ["LOCATION"], "granularity": ["city", "suburb", "street", "incident_site"]}, "SYNTHETIC", None),
    ({"entity_type": ["PHONE"], "number_class": ["13", "1300", "1800"]}, "KEEP", None),
]
# Actions of types without a rule, validators of identifier types, and types whose loss is critical.
DEFAULTS = {
    "PERSON": "SYNTHETIC", "ADDRESS": "SYNTHETIC", "EMAIL": "SYNTHETIC", "PHONE": "SYNTHETIC", "URL": "SYNTHETIC", "DATE_OF_BIRTH": "SYNTHETIC",
    "TFN": "REDACT", "NATIONALITY": "REDACT", "SIGNATURE": "REDACT", "PHOTO": "REDACT", "DATE": "KEEP", "AGE": "KEEP", "GENDER": "KEEP", "ORGANIZATION": "REVIEW", "LOCATION": "REVIEW", "OTHER": "REVIEW",
}
VALIDATORS = {"TFN": "tfn", "ABN": "abn", "ACN": "acn", "MEDICARE": "medicare", "PROVIDER_NUMBER": "provider_number", "IHI": "ihi"}
IDENTIFIERS = [
    "ABN", "ACN", "MEDICARE", "PROVIDER_NUMBER", "IHI", "AHPRA_REGISTRATION", "CLAIM_NUMBER", "COURT_FILE_NUMBER", "PASSPORT", "DRIVER_LICENCE", "POLICY_NUMBER", "CENTRELINK_CRN", "MEDICAL_RECORD_NUMBER",
    "VEHICLE_REGISTRATION", "DVA_NUMBER", "ACCOUNT_NUMBER",
]
CRITICAL_ROLES = {"PERSON": ["plaintiff", "plaintiff_family"]}
CRITICAL_TYPES = ["DATE_OF_BIRTH", "ADDRESS", "PHONE", "EMAIL", "MEDICARE", "TFN", "PASSPORT", "DRIVER_LICENCE", "ACCOUNT_NUMBER", "CLAIM_NUMBER"]
COMPATIBLE = [("DATE", "DATE_OF_BIRTH"), ("ADDRESS", "LOCATION")]
GROUPS = {"PERSON": "name", "ORGANIZATION": "name", "ADDRESS": "place", "LOCATION": "place", "EMAIL": "contact", "PHONE": "contact", "URL": "contact", "DATE": "date", "DATE_OF_BIRTH": "date", "AGE": "trait", "GENDER": "trait", "NATIONALITY": "trait"}
REGION_ONLY = ["SIGNATURE", "PHOTO"]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def rule_matches(when: dict[str, list[str]], entity_type: Column | str, role: Column | str, attributes: Column | str) -> Column:
    """Whether all conditions of a rule hold; conditions other than type and role are on attributes."""
    value = lambda k: _c(entity_type) if k == "entity_type" else _c(role) if k == "role" else F.try_element_at(_c(attributes), F.lit(k))
    return reduce(lambda a, b: a & b, [F.coalesce(value(k).isin(vs), F.lit(False)) for k, vs in when.items()])


def decided(entity_type: Column | str, role: Column | str, attributes: Column | str, rules=None, defaults=None) -> Column:
    """struct(action, strategy, rule): the first matching rule, the type's default, identifiers, else REVIEW."""
    made = lambda a, s, r: F.struct(F.lit(a).alias("action"), F.lit(s).cast("string").alias("strategy"), F.lit(r).alias("rule"))
    out = None
    for i, (when, action, strategy) in enumerate(RULES if rules is None else rules):
        hit = rule_matches(when, entity_type, role, attributes)
        out = F.when(hit, made(action, strategy, f"rule[{i}]")) if out is None else out.when(hit, made(action, strategy, f"rule[{i}]"))
    for kind, action in (DEFAULTS if defaults is None else defaults).items():
        hit = _c(entity_type) == kind
        out = F.when(hit, made(action, None, "default")) if out is None else out.when(hit, made(action, None, "default"))
    out = out.when(_c(entity_type).isin([k for k in IDENTIFIERS if k in VALIDATORS]), made("SYNTHETIC", "checksum_invalid", "identifier"))
    out = out.when(_c(entity_type).isin([k for k in IDENTIFIERS if k not in VALIDATORS]), made("SYNTHETIC", "format_preserving", "identifier"))
    return out.otherwise(made("REVIEW", None, "fallback"))


def critical(entity_type: Column | str, role: Column | str) -> Column:
    by_role = reduce(lambda a, b: a | b, [(_c(entity_type) == k) & _c(role).isin(v) for k, v in CRITICAL_ROLES.items()])
    return F.coalesce(by_role, F.lit(False)) | F.coalesce(_c(entity_type).isin(CRITICAL_TYPES), F.lit(False))


def compatible(a: Column | str, b: Column | str) -> Column:
    """Equal types, or a pair that may stand for each other."""
    pair = reduce(lambda x, y: x | y, [((_c(a) == p) & (_c(b) == q)) | ((_c(a) == q) & (_c(b) == p)) for p, q in COMPATIBLE])
    return F.coalesce((_c(a) == _c(b)) | pair, F.lit(False))


def type_facts(entity_type: Column | str) -> Column:
    """struct(group, validator, region_only); unknown types are of group other, identifiers of group identifier."""
    k = _c(entity_type)
    group = F.coalesce(F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv])[k], F.when(k.isin([*IDENTIFIERS, "TFN"]), "identifier"), F.lit("other"))
    return F.struct(group.alias("group"), F.create_map(*[F.lit(x) for kv in VALIDATORS.items() for x in kv])[k].alias("validator"), k.isin(REGION_ONLY).alias("region_only"))


def protects(action: Column | str, mode: str = "pessimistic") -> Column:
    """Whether an action hides the value: replaced or removed; in mode with_review also what waits for review."""
    return _c(action).isin(["REDACT", "SYNTHETIC"] + (["REVIEW"] if mode == "with_review" else []))


def exclusion(region_only: Column, certainty: Column, action: Column, complete: Column, ignored: Column) -> Column:
    """Why a mention is left out of the measures; the first reason that holds, else null."""
    return F.when(region_only, "region_only").when(certainty == "uncertain", "uncertain").when(action == "REVIEW", "review").when(~complete, "not_complete").when(ignored, "ignore_region")


def eligible(scheme: str, gs: Column, ge: Column, gt: Column, ps: Column, pe: Column, pt: Column) -> Column:
    """Whether a mention and a prediction may be paired under a scheme: strict, exact, overlap_typed, overlap_any."""
    same, meets = (gs == ps) & (ge == pe), (gs < pe) & (ps < ge)
    return {"strict": same & compatible(gt, pt), "exact": same, "overlap_typed": meets & compatible(gt, pt), "overlap_any": meets}[scheme]
