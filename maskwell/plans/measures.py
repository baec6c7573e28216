"""Queries of detection, policy, geometry, protection and outputs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.functions import births, text
from maskwell.operators import curation, detection, detector, evaluation, forms, geometry, layout, outputs, policy, replacement, spans, surrogates
from maskwell.plans.registry import _E, _G, _ISLES, KEY, _edits, _gold, _hmac_sql, query
from maskwell.sources.tables import table

_U = "document_id, page, field, text_source_id"


def _mentions(spark: SparkSession, base: str) -> DataFrame:
    """Placed mentions with what decides their action; deliveries of one record that differ count as rows of their own."""
    g = table(spark, base, "gold_mention", "mention_id", "document_id", "page", "field", "text_source_id", "start_off", "end_off", "entity_type", "role", "action", "text")
    one = g.filter("start_off IS NOT NULL").groupBy("mention_id").agg(F.min(F.struct("start_off", "end_off", "document_id", "page", "field", "text_source_id", "entity_type", "role", "action", "text")).alias("r"))
    return one.select("mention_id", "r.*")


_M = (
    "(SELECT mention_id, r.* FROM (SELECT mention_id, min({'start_off': start_off, 'end_off': end_off, 'document_id': document_id, 'page': page, 'field': field, 'text_source_id': text_source_id, 'entity_type': entity_type, 'role': role, "
    "'action': action, 'text': text}) AS r FROM gold_mention WHERE start_off IS NOT NULL GROUP BY mention_id))"
)


def _words(spark: SparkSession, base: str) -> DataFrame:
    """Words of all deliveries, each once."""
    p = table(spark, base, "page_extraction", "document_id", "page", "text_source_id", "words").filter("words IS NOT NULL")
    return layout.page_words(p, "document_id", "page", "text_source_id").select("document_id", "page", "text_source_id", "idx", "text", "bbox", "block", "line", "start_off", "end_off").distinct()


_W = "(SELECT DISTINCT document_id, page, text_source_id, w.idx AS idx, w.text AS text, w.bbox AS bbox, w.block AS block, w.line AS line, w.start_off AS start_off, w.end_off AS end_off FROM (SELECT document_id, page, text_source_id, unnest(words) AS w FROM page_extraction WHERE words IS NOT NULL))"


# Policy --------------------------------------------------------------------------


def _policy_sql() -> str:
    def cond(when: dict) -> str:
        col = lambda k: k if k in ("entity_type", "role") else f"element_at(attributes, '{k}')[1]"
        return " AND ".join("{} IN ({})".format(col(k), ", ".join(f"'{v}'" for v in vs)) for k, vs in when.items())

    ids = [k for k in policy.IDENTIFIERS if k in policy.VALIDATORS], [k for k in policy.IDENTIFIERS if k not in policy.VALIDATORS]
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)

    def case(pick) -> str:
        parts = [f"WHEN {cond(w)} THEN {pick(a, s, f'rule[{i}]')}" for i, (w, a, s) in enumerate(policy.RULES)]
        parts += [f"WHEN entity_type = '{k}' THEN {pick(a, None, 'default')}" for k, a in policy.DEFAULTS.items()]
        parts += [f"WHEN entity_type IN ({quoted(x)}) THEN {pick('SYNTHETIC', s, 'identifier')}" for x, s in zip(ids, ("checksum_invalid", "format_preserving"))]
        return "CASE " + " ".join(parts) + f" ELSE {pick('REVIEW', None, 'fallback')} END"

    text = lambda x: "NULL" if x is None else f"'{x}'"
    crit = " OR ".join(f"(entity_type = '{k}' AND role IN ({quoted(v)}))" for k, v in policy.CRITICAL_ROLES.items())
    return (
        f"SELECT DISTINCT mention_id, {case(lambda a, s, r: text(a))} AS action, {case(lambda a, s, r: text(s))} AS strategy, {case(lambda a, s, r: text(r))} AS rule, "
        f"coalesce({crit}, false) OR coalesce(entity_type IN ({quoted(policy.CRITICAL_TYPES)}), false) AS critical FROM gold_mention"
    )


@query(_policy_sql())
def policy_actions(spark: SparkSession, base: str) -> DataFrame:
    g = table(spark, base, "gold_mention", "mention_id", "entity_type", "role", "attributes")
    return g.select("mention_id", policy.decided("entity_type", "role", "attributes").alias("d"), policy.critical("entity_type", "role").alias("critical")).select("mention_id", "d.action", "d.strategy", "d.rule", "critical").distinct()


@query(
    "SELECT DISTINCT a.entity_type AS type_a, b.entity_type AS type_b FROM (SELECT DISTINCT entity_type FROM gold_mention) a, (SELECT DISTINCT entity_type FROM gold_mention) b WHERE a.entity_type = b.entity_type OR "
    + " OR ".join(f"(a.entity_type = '{x}' AND b.entity_type = '{y}')" for p in policy.COMPATIBLE for x, y in (p, p[::-1]))
)
def compatible_types(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of the few entity types that may stand for each other."""
    one = table(spark, base, "gold_mention", "entity_type").distinct()
    other = one.select(F.col("entity_type").alias("type_b"))
    return one.select(F.col("entity_type").alias("type_a")).join(other, policy.compatible("type_a", "type_b"))


@query(
    "SELECT DISTINCT entity_type, coalesce(CASE "
    + " ".join(f"WHEN entity_type = '{k}' THEN '{v}'" for k, v in policy.GROUPS.items())
    + " WHEN entity_type IN ("
    + ", ".join(f"'{k}'" for k in [*policy.IDENTIFIERS, "TFN"])
    + ") THEN 'identifier' END, 'other') AS type_group, CASE "
    + " ".join(f"WHEN entity_type = '{k}' THEN '{v}'" for k, v in policy.VALIDATORS.items())
    + " END AS validator, entity_type IN ('SIGNATURE', 'PHOTO') AS region_only FROM gold_mention"
)
def type_facts(spark: SparkSession, base: str) -> DataFrame:
    g = table(spark, base, "gold_mention", "entity_type").distinct().withColumn("f", policy.type_facts("entity_type"))
    return g.select("entity_type", F.col("f.group").alias("type_group"), "f.validator", "f.region_only")


@query("""
SELECT entity_type, count(*) AS mentions, count_if(critical) AS critical, count_if(excluded IS NOT NULL) AS excluded, count_if(start_off IS NULL) AS unplaced, count_if(action IN ('REDACT', 'SYNTHETIC')) AS protect
FROM (SELECT DISTINCT mention_id, entity_type, critical, excluded, start_off, action FROM gold_mention) GROUP BY entity_type""")
def gold_summary(spark: SparkSession, base: str) -> DataFrame:
    g = table(spark, base, "gold_mention", "mention_id", "entity_type", "critical", "excluded", "start_off", "action").distinct()
    return g.groupBy("entity_type").agg(
        F.count("*").alias("mentions"), F.count_if("critical").alias("critical"), F.count_if(F.col("excluded").isNotNull()).alias("excluded"), F.count_if(F.col("start_off").isNull()).alias("unplaced"),
        F.count_if(policy.protects("action")).alias("protect"),
    )


# Detection -----------------------------------------------------------------------


@query()
def detected_pages(spark: SparkSession, base: str) -> DataFrame:
    """The whole rule detector over all pages, names carried through each matter."""
    p = table(spark, base, "page_extraction", "page_id", "matter_id", "text")
    return detector.detected(p, ["page_id"], "matter_id").select("page_id", "start_off", "end_off", "entity_type", "rule", "tier", "attributes", "text")


@query()
def audit_candidates(spark: SparkSession, base: str) -> DataFrame:
    return detector.audit_scan(table(spark, base, "page_extraction", "page_id", "text"), ["page_id"])


@query()
def detection_metrics(spark: SparkSession, base: str) -> DataFrame:
    """One-to-one detection metrics of the edits against the mentions, four schemes."""
    return evaluation.detection_metrics(evaluation.event_rows(_mentions(spark, base), _edits(spark, base), "mention_id", "edit_id"))


@query(f"""
SELECT 'missed' AS kind, g.mention_id AS ident FROM {_G} g WHERE NOT EXISTS (SELECT 1 FROM {_E} e WHERE g.document_id = e.document_id AND g.page IS NOT DISTINCT FROM e.page AND g.field IS NOT DISTINCT FROM e.field AND g.text_source_id IS NOT DISTINCT FROM e.text_source_id AND g.start_off < e.end_off AND e.start_off < g.end_off)
UNION ALL SELECT 'extra', CAST(e.edit_id AS VARCHAR) FROM {_E} e WHERE NOT EXISTS (SELECT 1 FROM {_G} g WHERE g.document_id = e.document_id AND g.page IS NOT DISTINCT FROM e.page AND g.field IS NOT DISTINCT FROM e.field AND g.text_source_id IS NOT DISTINCT FROM e.text_source_id AND g.start_off < e.end_off AND e.start_off < g.end_off)""")
def missed_and_extra(spark: SparkSession, base: str) -> DataFrame:
    g, e = _gold(spark, base), _edits(spark, base)
    return spans.without_overlap(g, e).select(F.lit("missed").alias("kind"), F.col("mention_id").alias("ident")).union(spans.without_overlap(e, g).select(F.lit("extra"), F.col("edit_id").cast("string")))


@query(f"""
WITH a AS (SELECT DISTINCT {_U}, start_off, end_off, entity_type FROM {_G}), b AS (SELECT DISTINCT {_U}, start_off, end_off, entity_type FROM {_E}),
j AS (SELECT a.*, b.start_off AS bs, b.end_off AS be, b.entity_type AS bt FROM a JOIN b ON a.document_id IS NOT DISTINCT FROM b.document_id AND a.page IS NOT DISTINCT FROM b.page AND a.field IS NOT DISTINCT FROM b.field AND a.text_source_id IS NOT DISTINCT FROM b.text_source_id AND a.start_off < b.end_off AND b.start_off < a.end_off)
SELECT DISTINCT {_U}, start_off, end_off, entity_type, kind FROM (SELECT *, CASE WHEN entity_type <> bt THEN 'type' WHEN start_off <> bs OR end_off <> be THEN 'boundary' END AS kind FROM j) WHERE kind IS NOT NULL
UNION ALL SELECT *, 'missed' FROM a WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.document_id IS NOT DISTINCT FROM a.document_id AND j.page IS NOT DISTINCT FROM a.page AND j.field IS NOT DISTINCT FROM a.field AND j.text_source_id IS NOT DISTINCT FROM a.text_source_id AND j.start_off = a.start_off AND j.end_off = a.end_off AND j.entity_type = a.entity_type)
UNION ALL SELECT *, 'extra' FROM b WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.document_id IS NOT DISTINCT FROM b.document_id AND j.page IS NOT DISTINCT FROM b.page AND j.field IS NOT DISTINCT FROM b.field AND j.text_source_id IS NOT DISTINCT FROM b.text_source_id AND j.bs = b.start_off AND j.be = b.end_off AND j.bt = b.entity_type)""")
def pass_disagreements(spark: SparkSession, base: str) -> DataFrame:
    """Where the annotations and the edits of a run do not agree, and how."""
    return detection.disagreements(_gold(spark, base).drop("mention_id").distinct(), _edits(spark, base).drop("edit_id").distinct())


# Geometry ------------------------------------------------------------------------

_MET = f"(SELECT s.mention_id, s.document_id, s.page, s.text_source_id, s.start_off AS ss, s.end_off AS se, w.* EXCLUDE (document_id, page, text_source_id) FROM (SELECT DISTINCT mention_id, document_id, page, text_source_id, start_off, end_off FROM {_M} WHERE start_off < end_off) s JOIN {_W} w ON s.document_id = w.document_id AND s.page = w.page AND s.text_source_id = w.text_source_id AND w.start_off < s.end_off AND s.start_off < w.end_off)"
_BOX = f"SELECT mention_id, document_id, page, text_source_id, block, line, min(bbox.x0) AS x0, min(bbox.y0) AS y0, max(bbox.x1) AS x1, max(bbox.y1) AS y1 FROM {_MET} GROUP BY ALL"


def _rounded(df: DataFrame, digits: int = 3) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in ("x0", "y0", "x1", "y1") else c for c in df.columns])


@query(f"SELECT mention_id, document_id, page, text_source_id, block, line, round(x0, 3) AS x0, round(y0, 3) AS y0, round(x1, 3) AS x1, round(y1, 3) AS y1 FROM ({_BOX})")
def span_line_boxes(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(geometry.span_boxes(_mentions(spark, base), "mention_id", _words(spark, base)))


@query(f"""
SELECT mention_id, document_id, page, text_source_id, block, line, round(min(bbox.x0 + (bbox.x1 - bbox.x0) * greatest(0, ss - start_off) / greatest(end_off - start_off, 1)), 3) AS x0, round(min(bbox.y0), 3) AS y0,
 round(max(bbox.x1 - (bbox.x1 - bbox.x0) * greatest(0, end_off - se) / greatest(end_off - start_off, 1)), 3) AS x1, round(max(bbox.y1), 3) AS y1 FROM {_MET} GROUP BY mention_id, document_id, page, text_source_id, block, line""")
def span_part_boxes(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(geometry.span_boxes(_mentions(spark, base), "mention_id", _words(spark, base), whole=False))


@query(f"SELECT DISTINCT mention_id, idx FROM {_MET}")
def words_of_spans(spark: SparkSession, base: str) -> DataFrame:
    return geometry.span_words(_mentions(spark, base), "mention_id", _words(spark, base)).select("mention_id", "idx").distinct()


@query(f"""
WITH b AS ({_BOX}), j AS (SELECT b.mention_id, w.document_id, w.page, w.text_source_id, w.start_off, w.end_off, greatest(0, least(w.bbox.x1, b.x1) - greatest(w.bbox.x0, b.x0)) * greatest(0, least(w.bbox.y1, b.y1) - greatest(w.bbox.y0, b.y0)) AS i, (w.bbox.x1 - w.bbox.x0) * (w.bbox.y1 - w.bbox.y0) AS a
 FROM b JOIN {_W} w ON b.document_id = w.document_id AND b.page = w.page)
SELECT mention_id, document_id, page, text_source_id, min(start_off) AS start_off, max(end_off) AS end_off FROM j WHERE a > 0 AND i / a >= 0.5 GROUP BY ALL""")
def projected_spans(spark: SparkSession, base: str) -> DataFrame:
    """Where the boxes of each mention lie in every source of its page."""
    w = _words(spark, base)
    return geometry.projected(geometry.span_boxes(_mentions(spark, base), "mention_id", w), "mention_id", w)


@query(f"""
WITH w AS (SELECT *, median(CASE WHEN length(text) > 0 THEN (bbox.x1 - bbox.x0) / length(text) END) OVER (PARTITION BY document_id, page, text_source_id) AS cw FROM {_W}),
n AS (SELECT *, CASE WHEN bbox.x0 - lag(bbox.x1) OVER (PARTITION BY document_id, page, text_source_id, block, line ORDER BY idx) <= 1.5 * coalesce(cw, 5.0) THEN 0 ELSE 1 END AS fresh FROM w),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY document_id, page, text_source_id, block, line ORDER BY idx ROWS UNBOUNDED PRECEDING) AS cell FROM n)
SELECT document_id, page, text_source_id, block, line, CAST(cell AS BIGINT) AS cell, min(idx) AS first_idx, max(idx) AS last_idx FROM c GROUP BY 1, 2, 3, 4, 5, 6""")
def width_cells(spark: SparkSession, base: str) -> DataFrame:
    return geometry.width_cells(_words(spark, base), geometry.SOURCE, 1.5)


@query()
def visual_rows(spark: SparkSession, base: str) -> DataFrame:
    return geometry.visual_lines(_words(spark, base), geometry.SOURCE).select(*geometry.SOURCE, "idx", "row")


# Measures ------------------------------------------------------------------------

_EA = "(SELECT DISTINCT edit_id, document_id, page, field, text_source_id, start_off, end_off, entity_type, action FROM edit)"


def _acting(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "edit", "edit_id", "document_id", "page", "field", "text_source_id", "start_off", "end_off", "entity_type", "action").distinct()


def _cover_sql(modes: str) -> str:
    return (
        f"SELECT g.*, coalesce(c.covered, 0) AS covered FROM {_M} g LEFT JOIN (SELECT g.mention_id, sum(least(g.end_off, e.end_off) - greatest(g.start_off, e.start_off)) AS covered FROM {_M} g JOIN ("
        + _ISLES.format(t=f"(SELECT * FROM {_EA} WHERE action IN ({modes}))")
        + ") e ON g.document_id IS NOT DISTINCT FROM e.document_id AND g.page IS NOT DISTINCT FROM e.page AND g.field IS NOT DISTINCT FROM e.field AND g.text_source_id IS NOT DISTINCT FROM e.text_source_id AND g.start_off < e.end_off AND e.start_off < g.end_off GROUP BY 1) c ON g.mention_id = c.mention_id"
    )


def _protection_sql(mode: str, modes: str) -> str:
    crit = f"(coalesce(entity_type = 'PERSON' AND role IN ('plaintiff', 'plaintiff_family'), false) OR entity_type IN ({', '.join(repr(x) for x in policy.CRITICAL_TYPES)}))"
    return (
        f"SELECT '{mode}' AS mode, *, CASE WHEN mentions <> 0 THEN round(protected / mentions, 4) END AS mention_recall, CASE WHEN chars <> 0 THEN round(covered_chars / chars, 4) END AS char_recall FROM ("
        f"SELECT count_if(w)::BIGINT AS mentions, count_if(w AND f)::BIGINT AS protected, coalesce(sum(CASE WHEN w THEN n END), 0)::BIGINT AS chars, coalesce(sum(CASE WHEN w THEN covered END), 0)::BIGINT AS covered_chars, count_if(w AND NOT f AND {crit})::BIGINT AS critical_missed, "
        f"count_if(action = 'KEEP' AND covered > 0)::BIGINT AS keep_violations FROM (SELECT *, end_off - start_off AS n, covered >= end_off - start_off AS f, action IN ('REDACT', 'SYNTHETIC') AS w FROM ({_cover_sql(modes)})))"
    )


@query(_protection_sql("pessimistic", "'REDACT', 'SYNTHETIC'") + " UNION ALL " + _protection_sql("with_review", "'REDACT', 'SYNTHETIC', 'REVIEW'"))
def protection_metrics(spark: SparkSession, base: str) -> DataFrame:
    g, e = _mentions(spark, base), _acting(spark, base)
    return evaluation.protection(g, e, "pessimistic").union(evaluation.protection(g, e, "with_review"))


@query(f"""
SELECT document_id, page, CASE WHEN bool_or(action IN ('REDACT', 'SYNTHETIC') AND covered < end_off - start_off) THEN 'BLOCKED' WHEN bool_or(action = 'REVIEW') THEN 'REVIEW' ELSE 'PASS' END AS state
FROM ({_cover_sql("'REDACT', 'SYNTHETIC'")}) GROUP BY document_id, page""")
def page_states(spark: SparkSession, base: str) -> DataFrame:
    return evaluation.page_states(_mentions(spark, base), _acting(spark, base))


@query(f"""
WITH h AS ({_cover_sql("'REDACT', 'SYNTHETIC'")}), s AS ({_cover_sql("'REDACT', 'SYNTHETIC', 'REVIEW', 'KEEP'")}),
o AS (SELECT h.mention_id, h.entity_type, CASE WHEN h.covered >= h.end_off - h.start_off THEN 'OK' WHEN s.covered = 0 THEN 'DETECTOR_MISS' WHEN s.covered < h.end_off - h.start_off THEN 'BOUNDARY' ELSE 'POLICY_MISS' END AS outcome FROM h JOIN s ON h.mention_id = s.mention_id WHERE h.action IN ('REDACT', 'SYNTHETIC'))
SELECT entity_type, outcome, count(*) AS n FROM o GROUP BY GROUPING SETS ((outcome), (entity_type, outcome))""")
def attribution_summary(spark: SparkSession, base: str) -> DataFrame:
    e = _acting(spark, base).filter(F.col("action").isin("REDACT", "SYNTHETIC", "REVIEW", "KEEP"))
    return evaluation.attribution_summary(evaluation.attribution(_mentions(spark, base), e, e))


@query(f"""
WITH w AS (SELECT DISTINCT document_id, page, text_source_id, idx, start_off, end_off FROM {_W}),
h AS (SELECT w.document_id, w.page, w.text_source_id, w.idx, m.entity_type, row_number() OVER (PARTITION BY w.document_id, w.page, w.text_source_id, w.idx ORDER BY m.start_off, m.end_off, m.mention_id) AS n FROM w JOIN {_M} m ON w.document_id = m.document_id AND w.page = m.page AND w.text_source_id = m.text_source_id AND w.start_off < m.end_off AND m.start_off < w.end_off)
SELECT w.document_id, w.page, w.text_source_id, w.idx, coalesce(h.entity_type, 'O') AS label FROM (SELECT DISTINCT document_id, page, text_source_id, idx FROM w) w LEFT JOIN (SELECT * FROM h WHERE n = 1) h USING (document_id, page, text_source_id, idx)""")
def token_labels(spark: SparkSession, base: str) -> DataFrame:
    return evaluation.token_labels(_words(spark, base), _mentions(spark, base), geometry.SOURCE)


@query()
def page_text_metrics(spark: SparkSession, base: str) -> DataFrame:
    """Error rates of characters and words of every pair of sources of a page."""
    p = table(spark, base, "page_extraction", "page_id", "document_id", "page", "text").distinct()
    b = p.select("document_id", "page", F.col("page_id").alias("other"), F.col("text").alias("hyp"))
    both = p.join(b, ["document_id", "page"]).filter("page_id < other")
    return both.select("page_id", "other", evaluation.page_text_metrics("text", "hyp").alias("m")).select("page_id", "other", "m.*")


_ASCII = "regexp_replace({}, '[^ -~]', '?', 'g')"


@query(f"""
WITH b AS ({_BOX}), j AS (SELECT b.mention_id, w.document_id, w.page, w.text_source_id, w.start_off, w.end_off, greatest(0, least(w.bbox.x1, b.x1) - greatest(w.bbox.x0, b.x0)) * greatest(0, least(w.bbox.y1, b.y1) - greatest(w.bbox.y0, b.y0)) AS i, (w.bbox.x1 - w.bbox.x0) * (w.bbox.y1 - w.bbox.y0) AS a
 FROM b JOIN {_W} w ON b.document_id = w.document_id AND b.page = w.page),
p AS (SELECT mention_id, document_id, page, text_source_id, min(start_off) AS s, max(end_off) AS e FROM j WHERE a > 0 AND i / a >= 0.5 GROUP BY ALL),
t AS (SELECT document_id, page, text_source_id, min(text) AS unit FROM page_extraction GROUP BY 1, 2, 3),
r AS (SELECT p.mention_id, p.text_source_id, {_ASCII.format('m.text')} AS g, {_ASCII.format('substr(t.unit, p.s + 1, p.e - p.s)')} AS x FROM p JOIN t USING (document_id, page, text_source_id) JOIN {_M} m ON p.mention_id = m.mention_id)
SELECT mention_id, text_source_id, CASE WHEN x IS NULL OR trim(x) = '' THEN 'missing' WHEN g = x THEN 'exact' WHEN levenshtein(g, x) / length(g) <= 0.2 THEN 'near' ELSE 'degraded' END AS recovery FROM r WHERE length(g) > 0""")
def recovery_classes(spark: SparkSession, base: str) -> DataFrame:
    """How well each mention was read in every source of its page; letters beyond ASCII count as one sign."""
    ascii_ = lambda c: F.regexp_replace(c, "[^ -~]", "?")
    p = projected_spans(spark, base).withColumnsRenamed({"start_off": "s", "end_off": "e"})
    t = table(spark, base, "page_extraction", "document_id", "page", "text_source_id", "text").groupBy("document_id", "page", "text_source_id").agg(F.min("text").alias("unit"))
    m = _mentions(spark, base).select("mention_id", ascii_(F.col("text")).alias("g")).filter("length(g) > 0")
    both = p.join(t, geometry.SOURCE).join(m, "mention_id").withColumn("x", ascii_(F.substring(F.col("unit"), F.col("s") + 1, F.col("e") - F.col("s"))))
    return both.select("mention_id", "text_source_id", evaluation.recovery_class(F.col("g"), F.col("x")).alias("recovery"))


@query(f"""
WITH h AS (SELECT {_U}, start_off, end_off, 'annotated' AS method FROM {_G} UNION ALL SELECT {_U}, start_off, end_off, 'edited' FROM {_E}),
n AS (SELECT *, CASE WHEN start_off >= max(end_off) OVER (PARTITION BY {_U} ORDER BY start_off, end_off, method ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE THEN 1 ELSE 0 END AS fresh FROM h),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY {_U} ORDER BY start_off, end_off, method ROWS UNBOUNDED PRECEDING) AS isle FROM n)
SELECT {_U}, min(start_off) AS start_off, max(end_off) AS end_off, CASE WHEN bool_or(method = 'edited') THEN 'edited' ELSE 'annotated' END AS method FROM i GROUP BY {_U}, isle""")
def hit_islands(spark: SparkSession, base: str) -> DataFrame:
    cols = [*spans.UNIT, "start_off", "end_off"]
    hits = _gold(spark, base).select(*cols, F.lit("annotated").alias("method")).union(_edits(spark, base).select(*cols, F.lit("edited")))
    return evaluation.hit_islands(hits, {"edited": 0, "annotated": 1})


@query("""
WITH w AS (SELECT DISTINCT document_id, page, text_source_id, u.idx AS idx, u.conf AS conf FROM (SELECT document_id, page, text_source_id, unnest(words) AS u FROM page_extraction WHERE words IS NOT NULL)),
p AS (SELECT document_id, page, text_source_id, avg(conf) AS mean_conf, CASE WHEN count(conf) > 0 THEN count_if(conf < 60) / count(conf) END AS low_frac FROM w GROUP BY 1, 2, 3),
g AS (SELECT a AS t_mean, b AS t_frac FROM unnest([75, 80, 85, 90, 95]) x(a), unnest([0.02, 0.05, 0.1, 0.2]) y(b))
SELECT CAST(t_mean AS INTEGER) AS t_mean, CAST(t_frac AS DOUBLE) AS t_frac, count_if(coalesce(mean_conf < t_mean, false) OR coalesce(low_frac > t_frac, false))::BIGINT AS flagged, count(*) AS pages FROM p, g GROUP BY 1, 2""")
def gate_grid(spark: SparkSession, base: str) -> DataFrame:
    """Pages that a pair of thresholds on mean confidence and share of weak words flags, over a grid of both."""
    p = table(spark, base, "page_extraction", "document_id", "page", "text_source_id", "words").filter("words IS NOT NULL")
    w = layout.page_words(p, *geometry.SOURCE).select(*geometry.SOURCE, "idx", "conf").distinct()
    q = w.groupBy(*geometry.SOURCE).agg(F.avg("conf").alias("mean_conf"), F.when(F.count("conf") > 0, F.count_if(F.col("conf") < 60) / F.count("conf")).alias("low_frac"))
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("t_mean"), F.lit(b).alias("t_frac")) for a in (75, 80, 85, 90, 95) for b in (0.02, 0.05, 0.1, 0.2)])).alias("g")
    low = F.coalesce(F.col("mean_conf") < F.col("g.t_mean"), F.lit(False)) | F.coalesce(F.col("low_frac") > F.col("g.t_frac"), F.lit(False))
    return q.select("mean_conf", "low_frac", cells).groupBy("g.t_mean", "g.t_frac").agg(F.count_if(low).alias("flagged"), F.count("*").alias("pages"))


# Outputs -------------------------------------------------------------------------


@query("""
SELECT edit_id, start_off, CAST(start_off + coalesce(sum(length(coalesce(replacement, '')) - (end_off - start_off)) OVER (PARTITION BY document_id, page, text_source_id ORDER BY start_off, end_off, edit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS out_start
FROM (SELECT DISTINCT edit_id, document_id, page, text_source_id, start_off, end_off, replacement FROM edit WHERE field IS NULL)""")
def output_offsets(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "edit", "edit_id", "document_id", "page", "text_source_id", "field", "start_off", "end_off", "replacement").filter("field IS NULL").drop("field").distinct()
    return outputs.output_offsets(e, geometry.SOURCE, ["start_off", "end_off", "edit_id"]).select("edit_id", "start_off", "out_start")


@query()
def complete_logs(spark: SparkSession, base: str) -> DataFrame:
    """Whether the edit log of every edited page explains its output."""
    units = table(spark, base, "page_extraction", *geometry.SOURCE, "text").groupBy(*geometry.SOURCE).agg(F.min("text").alias("text"))
    e = table(spark, base, "edit", *geometry.SOURCE, "field", "start_off", "end_off", "replacement", "edit_id").filter("field IS NULL").drop("field").distinct()
    kept = spans.keep_best(e, [-(F.col("end_off") - F.col("start_off")), F.col("start_off"), F.col("edit_id")], geometry.SOURCE)
    log = outputs.edit_log(units, kept, geometry.SOURCE, KEY)
    return outputs.log_complete(units, spans.edited_texts(units, kept, geometry.SOURCE), log, geometry.SOURCE, KEY)


@query()
def restored_mentions(spark: SparkSession, base: str) -> DataFrame:
    """Spellings written with the surrogates of their surnames, restored as free text."""
    from maskwell.plans.registry import issued_surnames

    vault = issued_surnames(spark, base).select("matter_id", "value", "surrogate")
    texts = vault.select("matter_id", F.concat(F.lit("Dr "), F.col("surrogate"), F.lit(" and "), F.upper("surrogate"), F.lit("'s file")).alias("text"), "value")
    return outputs.restored_texts(texts.withColumn("ident", F.concat_ws("/", "matter_id", "value")), vault, "ident")


# Keyed and kept ------------------------------------------------------------------


@query(f"""
SELECT matter_id, chr(CAST(64 + row_number() OVER (PARTITION BY matter_id ORDER BY {_hmac_sql("matter_id || chr(31) || turned")}, turned) AS INTEGER)) AS letter, turned
FROM (SELECT DISTINCT matter_id FROM link_group), (SELECT chr(CAST(64 + i AS INTEGER)) AS turned FROM range(1, 27) t(i))""")
def letter_permutations(spark: SparkSession, base: str) -> DataFrame:
    return surrogates.letter_permutation(table(spark, base, "link_group", "matter_id"), "matter_id", KEY)


@query("""
WITH g AS (SELECT DISTINCT group_id, honorifics FROM link_group), h AS (SELECT group_id, list_transform(honorifics, lambda x: lower(replace(x, '.', ''))) AS l FROM g),
c AS (SELECT group_id, len(list_filter(l, lambda x: x IN ('mrs', 'ms', 'miss', 'dame'))) AS f, len(list_filter(l, lambda x: x IN ('mr', 'sir'))) AS m FROM h)
SELECT group_id, CASE WHEN f > 0 AND f >= m THEN 'female' WHEN m > 0 THEN 'male' ELSE 'unknown' END AS gender FROM c""")
def group_genders(spark: SparkSession, base: str) -> DataFrame:
    g = table(spark, base, "link_group", "group_id", "honorifics").distinct().withColumn("given", F.array().cast("array<string>"))
    return surrogates.group_gender(g, "group_id", "honorifics", "given")


@query("SELECT DISTINCT document_id, regexp_replace(x, '[^0-9]', '', 'g') AS token FROM (SELECT document_id, unnest(regexp_extract_all(text, '[0-9](?:[ \\-]?[0-9]){4,}')) AS x FROM page_extraction)")
def identifier_tokens(spark: SparkSession, base: str) -> DataFrame:
    """Digit runs of five or more in the texts of a document, which no surrogate may repeat."""
    p = table(spark, base, "page_extraction", "document_id", "text")
    return p.select("document_id", F.explode(F.regexp_extract_all("text", F.lit(r"[0-9](?:[ \-]?[0-9]){4,}"), F.lit(0))).alias("x")).select("document_id", F.regexp_replace("x", "[^0-9]", "").alias("token")).distinct()


@query(f"SELECT mention_id, document_id || '/m_' || CASE WHEN r < 1000 THEN lpad(CAST(r AS VARCHAR), 3, '0') ELSE CAST(r AS VARCHAR) END AS new_id FROM (SELECT mention_id, document_id, row_number() OVER (PARTITION BY document_id ORDER BY coalesce(page, -1), coalesce(field, ''), start_off, end_off, entity_type, mention_id) AS r FROM {_M})")
def renumbered_mentions(spark: SparkSession, base: str) -> DataFrame:
    return curation.renumbered(_mentions(spark, base))


@query("""
SELECT DISTINCT m.mention_id, regexp_extract(right(substr(u.unit, 1, m.start_off), 14), '(Mrs|Mr|Ms|Miss|Dr|Prof)[.]?[ ]$', 1) AS honorific FROM (SELECT DISTINCT mention_id, document_id, page, text_source_id, start_off FROM gold_mention WHERE entity_type = 'PERSON' AND start_off IS NOT NULL) m
JOIN (SELECT document_id, page, text_source_id, min(text) AS unit FROM page_extraction GROUP BY 1, 2, 3) u ON m.document_id = u.document_id AND m.page = u.page AND m.text_source_id = u.text_source_id""")
def honorifics_before(spark: SparkSession, base: str) -> DataFrame:
    m = table(spark, base, "gold_mention", "mention_id", "document_id", "page", "text_source_id", "start_off", "entity_type").filter("entity_type = 'PERSON' AND start_off IS NOT NULL").drop("entity_type").distinct()
    u = table(spark, base, "page_extraction", *geometry.SOURCE, "text").groupBy(*geometry.SOURCE).agg(F.min("text").alias("unit"))
    before = F.expr("right(substring(unit, 1, start_off), 14)")
    return m.join(u, geometry.SOURCE).select("mention_id", F.regexp_extract(before, "(Mrs|Mr|Ms|Miss|Dr|Prof)[.]?[ ]$", 1).alias("honorific")).distinct()


@query(f"SELECT DISTINCT doc_id, x AS url, regexp_extract(x, '^(https?://)?', 0) || CASE WHEN regexp_matches(x, '^(https?://)?www\\.') THEN 'www.' ELSE '' END || 'example.com/' || substr({_hmac_sql('x')}, 1, 10) AS surrogate FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'https?://[A-Za-z0-9./%_\\-]*[A-Za-z0-9/]')) AS x FROM documents)")
def url_surrogates(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "documents", "doc_id", "text")
    x = d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"https?://[A-Za-z0-9./%_\-]*[A-Za-z0-9/]"), F.lit(0))).alias("url")).distinct()
    return x.withColumn("surrogate", surrogates.url_surrogate("url", KEY))


@query("""
SELECT coalesce(matter_id, 'matter_001') AS matter_id, lower(trim(split)) AS split, count(DISTINCT document_id) AS documents FROM manifest_document GROUP BY 1, 2""")
def documents_by_matter(spark: SparkSession, base: str) -> DataFrame:
    m = table(spark, base, "manifest_document", "document_id", "matter_id", "split")
    return m.groupBy(F.coalesce("matter_id", F.lit("matter_001")).alias("matter_id"), F.lower(F.trim("split")).alias("split")).agg(F.countDistinct("document_id").alias("documents"))


@query("""
SELECT source_name_sha256, document_id, 'doc_' || CASE WHEN r < 1000 THEN lpad(CAST(r AS VARCHAR), 3, '0') ELSE CAST(r AS VARCHAR) END AS registered_id, n AS hashes FROM (
 SELECT source_name_sha256, document_id, n, row_number() OVER (ORDER BY source_name_sha256, document_id) AS r FROM (SELECT source_name_sha256, min(document_id) AS document_id, count(DISTINCT sha256) AS n FROM manifest_document WHERE source_name_sha256 IS NOT NULL GROUP BY 1))""")
def registered_names(spark: SparkSession, base: str) -> DataFrame:
    """Sources in order of name, one each, with the number of different contents delivered under it."""
    m = table(spark, base, "manifest_document", "document_id", "source_name_sha256", "sha256").filter("source_name_sha256 IS NOT NULL")
    return curation.registered(m, "source_name_sha256", "document_id", "sha256")


# Parts of values -----------------------------------------------------------------


@query()
def form_values(spark: SparkSession, base: str) -> DataFrame:
    """Values of forms by where they stand to their labels, over the last words of every page."""
    p = table(spark, base, "page_extraction", "page_id", "words", "delivered_at")
    return forms.form_values(p.withColumn("at", F.coalesce("delivered_at", F.expr("timestamp '1970-01-01 00:00:00'"))), "page_id", "at")


def _pool(spark: SparkSession) -> DataFrame:
    """Invented names made by rule: heads and endings for each kind."""
    heads = ["Ard", "Bel", "Cor", "Dal", "Ester", "Fal", "Gar", "Hol", "Ing", "Jor", "Kel", "Lor", "Mor", "Nor", "Orm", "Pel"]
    tails = {"surname": ["amere", "bourne", "combe", "enwick"], "given": ["an", "elle", "ix", "o"], "organisation": ["mark", "bridge", "gate"], "street": ["wren", "low", "fern"], "suburb": ["vale", "ton", "beach"]}
    return spark.createDataFrame([(k, h + t) for k, ts in tails.items() for h in heads for t in ts], "kind string, surrogate string")


@query()
def name_surrogates(spark: SparkSession, base: str) -> DataFrame:
    s = table(spark, base, "syn_hybrid", "matter_id", "entity_type", "text").filter("entity_type = 'PERSON'")
    return replacement.name_surrogates(s, _pool(spark), KEY)


@query()
def organisation_surrogates(spark: SparkSession, base: str) -> DataFrame:
    s = table(spark, base, "syn_hybrid", "matter_id", "entity_type", "text").filter("entity_type = 'ORGANIZATION'")
    return replacement.organisation_surrogates(s, _pool(spark), KEY)


def _addresses(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "gold_mention", "document_id", "entity_type", "text").filter("entity_type = 'ADDRESS' AND text IS NOT NULL").select("document_id", "text").distinct()


@query()
def address_surrogates(spark: SparkSession, base: str) -> DataFrame:
    return replacement.address_surrogates(_addresses(spark, base), _pool(spark), KEY, "document_id")


_SHORT = "|".join(detector.STATES)


@query(
    "SELECT DISTINCT document_id, text, coalesce(nullif(regexp_extract(text, '\\b(" + _SHORT + ")\\b', 1), ''), CASE "
    + " ".join(f"WHEN contains(lower(text), '{n.lower()}') THEN '{k}'" for k, n in detector.STATES.items())
    + " END, CASE regexp_extract(text, '\\b(\\d)\\d{3}\\s*$', 1) WHEN '2' THEN 'NSW' WHEN '3' THEN 'VIC' WHEN '4' THEN 'QLD' WHEN '5' THEN 'SA' WHEN '6' THEN 'WA' WHEN '7' THEN 'TAS' WHEN '0' THEN 'NT' END) AS state FROM gold_mention WHERE entity_type = 'ADDRESS' AND text IS NOT NULL"
)
def address_states(spark: SparkSession, base: str) -> DataFrame:
    return _addresses(spark, base).withColumn("state", replacement.state_of("text"))


@query()
def rewritten_births(spark: SparkSession, base: str) -> DataFrame:
    """Dates of birth with a keyed day of the same year and age, in the form they were written."""
    g = table(spark, base, "gold_mention", "document_id", "entity_type", "text").filter("entity_type IN ('DATE_OF_BIRTH', 'DATE') AND text IS NOT NULL").select("document_id", "text").distinct()
    from maskwell.functions import dates

    day = g.withColumn("born", dates.parsed("text")).filter("born IS NOT NULL")
    new = surrogates.issued_birth_day(F.col("born"), F.array().cast("array<date>"), KEY, "document_id")
    return day.withColumn("day", new).select("document_id", "text", "day", births.rewritten("text", "day").alias("surrogate"))


@query()
def folded_names(spark: SparkSession, base: str) -> DataFrame:
    s = table(spark, base, "syn_hybrid", "entity_id", "text").distinct()
    return s.select("entity_id", "text", text.normalised("text").alias("folded"))


@query(r"""
WITH u AS (SELECT document_id, page, text_source_id, min(text) AS unit FROM page_extraction GROUP BY 1, 2, 3), m AS (SELECT DISTINCT mention_id, document_id, page, text_source_id, start_off AS p FROM gold_mention WHERE start_off IS NOT NULL)
SELECT mention_id, p - length(regexp_extract(substr(unit, 1, p), '([^.!?
]*)$', 1)) AS s_start, p + length(regexp_extract(substr(unit, p + 1), '^([^.!?
]*[.!?]?)', 1)) AS s_end FROM m JOIN u USING (document_id, page, text_source_id)""")
def mention_sentences(spark: SparkSession, base: str) -> DataFrame:
    m = table(spark, base, "gold_mention", "mention_id", *geometry.SOURCE, "start_off").filter("start_off IS NOT NULL").distinct()
    u = table(spark, base, "page_extraction", *geometry.SOURCE, "text").groupBy(*geometry.SOURCE).agg(F.min("text").alias("unit"))
    return m.join(u, geometry.SOURCE).select("mention_id", text.sentence_bounds("unit", "start_off").alias("b")).select("mention_id", F.col("b.start").alias("s_start"), F.col("b.end").alias("s_end"))
