"""The queries of the core and the SQL that checks them.

Every query runs over its whole tables. SQL is given where the result can be
stated in it; the rest is tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.functions import boxes, checks, dates, keyed, strings
from maskwell.operators import curation, detection, layout, metrics, needles, rules, spans, surrogates
from maskwell.sources.files import exported
from maskwell.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEY = b"public test key"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _latest_words() -> Column:
    """Words of the last delivery of a page."""
    return F.max_by("words", F.coalesce("delivered_at", F.expr("timestamp '1970-01-01 00:00:00'"))).alias("words")


def _gold(spark: SparkSession, base: str) -> DataFrame:
    g = table(spark, base, "gold_mention", "mention_id", "document_id", "page", "field", "text_source_id", "start_off", "end_off", "entity_type")
    return g.filter("start_off IS NOT NULL").distinct()


def _edits(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "edit", "edit_id", "document_id", "page", "field", "text_source_id", "start_off", "end_off", "entity_type").distinct()


_G = "(SELECT DISTINCT mention_id, document_id, page, field, text_source_id, start_off, end_off, entity_type FROM gold_mention WHERE start_off IS NOT NULL)"
_E = "(SELECT DISTINCT edit_id, document_id, page, field, text_source_id, start_off, end_off, entity_type FROM edit)"
_SAME = "g.document_id IS NOT DISTINCT FROM e.document_id AND g.page IS NOT DISTINCT FROM e.page AND g.field IS NOT DISTINCT FROM e.field AND g.text_source_id IS NOT DISTINCT FROM e.text_source_id"
_OVL = f"{_SAME} AND g.start_off < e.end_off AND e.start_off < g.end_off"


def _scan_sql(tab: str, ident: str, names: list[str], text: str = "text") -> str:
    """Offsets rebuilt from pieces and matches, one branch a rule."""
    parts = []
    for n in names:
        kind, tier, p = rules.RULES[n]
        p = p.replace("'", "''")
        parts.append(
            f"SELECT {ident}, '{n}' AS rule, '{kind}' AS entity_type, {tier} AS tier, s AS start_off, s + length(x) AS end_off, x AS text FROM ("
            f"SELECT {ident}, m[i] AS x, CAST(list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0) AS INTEGER) AS s FROM ("
            f"SELECT {ident}, regexp_extract_all({text}, '{p}') AS m, regexp_split_to_array({text}, '{p}') AS g, unnest(range(1, len(regexp_extract_all({text}, '{p}')) + 1)) AS i FROM {tab}))"
        )
    return " UNION ALL ".join(parts)


# Scans -----------------------------------------------------------------------


@query(f"SELECT page_id, rule, entity_type, tier, start_off, end_off, text FROM ({_scan_sql('page_extraction', 'page_id', list(rules.RULES))})")
def scan_page_rules(spark: SparkSession, base: str) -> DataFrame:
    return rules.rule_spans(table(spark, base, "page_extraction", "page_id", "text"), "page_id", "text")


@query(f"SELECT doc_id, rule, entity_type, tier, start_off, end_off, text FROM ({_scan_sql('documents', 'doc_id', ['email', 'url'])})")
def scan_document_contacts(spark: SparkSession, base: str) -> DataFrame:
    return rules.rule_spans(table(spark, base, "documents", "doc_id", "text"), "doc_id", "text", "email", "url")


@query("""
WITH r AS (SELECT page_id, unnest(regexp_extract_all(text, '[0-9](?:[ \\-]?[0-9]){7,10}')) AS x FROM page_extraction),
d AS (SELECT page_id, regexp_replace(x, '[^0-9]', '', 'g') AS d FROM r),
s AS (SELECT *, list_transform(string_split(d, ''), lambda c: TRY_CAST(c AS INTEGER)) AS a FROM d)
SELECT page_id, d,
 CASE WHEN length(d) = 9 THEN (a[1]*1+a[2]*4+a[3]*3+a[4]*7+a[5]*5+a[6]*8+a[7]*6+a[8]*9+a[9]*10) % 11 = 0
      WHEN length(d) = 8 THEN (a[1]*10+a[2]*7+a[3]*8+a[4]*4+a[5]*6+a[6]*3+a[7]*5+a[8]*1) % 11 = 0 ELSE false END AS tfn,
 CASE WHEN length(d) = 11 AND a[1] <> 0 THEN ((a[1]-1)*10+a[2]*1+a[3]*3+a[4]*5+a[5]*7+a[6]*9+a[7]*11+a[8]*13+a[9]*15+a[10]*17+a[11]*19) % 89 = 0 ELSE false END AS abn,
 CASE WHEN length(d) = 9 THEN (10 - (a[1]*8+a[2]*7+a[3]*6+a[4]*5+a[5]*4+a[6]*3+a[7]*2+a[8]*1) % 10) % 10 = a[9] ELSE false END AS acn,
 CASE WHEN length(d) IN (10, 11) AND a[1] BETWEEN 2 AND 6 THEN (a[1]*1+a[2]*3+a[3]*7+a[4]*9+a[5]*1+a[6]*3+a[7]*7+a[8]*9) % 10 = a[9] ELSE false END AS medicare
FROM s""")
def check_digit_runs(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "page_extraction", "page_id", "text")
    run = F.explode(F.regexp_extract_all("text", F.lit(r"[0-9](?:[ \-]?[0-9]){7,10}"), F.lit(0))).alias("x")
    d = p.select("page_id", run).select("page_id", checks.digits_only("x").alias("d"))
    return d.select("page_id", "d", checks.tfn_valid("d").alias("tfn"), checks.abn_valid("d").alias("abn"), checks.acn_valid("d").alias("acn"), checks.medicare_valid("d").alias("medicare"))


# Interval operators ------------------------------------------------------------


@query(f"SELECT g.mention_id, e.edit_id, least(g.end_off, e.end_off) - greatest(g.start_off, e.start_off) AS chars FROM {_G} g JOIN {_E} e ON {_OVL}")
def overlap_join(spark: SparkSession, base: str) -> DataFrame:
    g, e = _gold(spark, base), _edits(spark, base)
    both = spans.overlap_join(g, e)
    return both.select(g["mention_id"], e["edit_id"], (F.least(g["end_off"], e["end_off"]) - F.greatest(g["start_off"], e["start_off"])).alias("chars"))


def _predicted(spark: SparkSession, base: str) -> DataFrame:
    """Rule spans of every page with the text unit they stand in."""
    pages = table(spark, base, "page_extraction", "page_id", "document_id", "page", "text_source_id", "text").dropDuplicates(["page_id", "text"])
    found = rules.rule_spans(pages.select("page_id", "text"), "page_id", "text")
    unit = pages.select("page_id", "document_id", "page", F.lit(None).cast("string").alias("field"), "text_source_id")
    return found.drop("text", "tier").join(unit, "page_id")


_P = (
    "(SELECT s.page_id, s.rule, s.entity_type, s.start_off, s.end_off, u.document_id, u.page, CAST(NULL AS VARCHAR) AS field, u.text_source_id FROM ("
    + _scan_sql("(SELECT DISTINCT page_id, text FROM page_extraction)", "page_id", list(rules.RULES))
    + ") s JOIN (SELECT DISTINCT page_id, document_id, page, text_source_id FROM page_extraction) u ON s.page_id = u.page_id)"
)


@query(f"SELECT e.page_id, e.rule, e.start_off FROM {_P} e WHERE NOT EXISTS (SELECT 1 FROM {_G} g WHERE {_OVL})")
def audit_pool_anti(spark: SparkSession, base: str) -> DataFrame:
    return spans.without_overlap(_predicted(spark, base), _gold(spark, base)).select("page_id", "rule", "start_off")


@query(
    f"SELECT entity_type, count(*) AS n, CAST(sum(hit) AS BIGINT) AS found FROM (SELECT g.entity_type, CASE WHEN EXISTS (SELECT 1 FROM {_P} e WHERE {_OVL} AND e.entity_type = g.entity_type) THEN 1 ELSE 0 END AS hit FROM {_G} g) GROUP BY entity_type"
)
def rule_recall(spark: SparkSession, base: str) -> DataFrame:
    g, e = _gold(spark, base), _predicted(spark, base)
    hit = g.join(e, spans.same_unit(g, e) & spans.overlaps(g, e) & (g["entity_type"] == e["entity_type"]), "left_semi").select("mention_id", F.lit(1).alias("hit"))
    return g.join(hit, "mention_id", "left").groupBy("entity_type").agg(F.count("*").alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("found"))


@query(f"SELECT g.mention_id, g.entity_type FROM {_G} g WHERE EXISTS (SELECT 1 FROM {_E} e WHERE {_OVL})")
def protected_semi(spark: SparkSession, base: str) -> DataFrame:
    return spans.touching(_gold(spark, base), _edits(spark, base)).select("mention_id", "entity_type")


_ISLES = f"""
SELECT document_id, page, field, text_source_id, min(start_off) AS start_off, max(end_off) AS end_off FROM (
 SELECT *, sum(fresh) OVER (PARTITION BY document_id, page, field, text_source_id ORDER BY start_off, end_off ROWS UNBOUNDED PRECEDING) AS isle FROM (
  SELECT *, CASE WHEN start_off <= max(end_off) OVER (PARTITION BY document_id, page, field, text_source_id ORDER BY start_off, end_off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
  FROM (SELECT DISTINCT document_id, page, field, text_source_id, start_off, end_off FROM {{t}})))
GROUP BY document_id, page, field, text_source_id, isle"""


@query(_ISLES.format(t=_G))
def merged_islands(spark: SparkSession, base: str) -> DataFrame:
    return spans.merged(_gold(spark, base).select(*spans.UNIT, "start_off", "end_off").distinct())


@query(
    f"WITH e AS ({_ISLES.format(t=_E)}) SELECT g.mention_id, CAST(sum(CASE WHEN e.start_off IS NULL THEN 0 ELSE least(g.end_off, e.end_off) - greatest(g.start_off, e.start_off) END) AS BIGINT) AS covered "
    f"FROM {_G} g LEFT JOIN e ON {_OVL} GROUP BY g.mention_id"
)
def covered_characters(spark: SparkSession, base: str) -> DataFrame:
    return spans.covered_length(_gold(spark, base), "mention_id", _edits(spark, base))


@query(f"""
SELECT document_id, page, field, text_source_id, start_off, end_off FROM (SELECT *, lead(start_off) OVER (PARTITION BY document_id, page, field, text_source_id ORDER BY start_off, end_off) AS nxt
 FROM (SELECT document_id, page, field, text_source_id, start_off, end_off FROM {_G} UNION SELECT document_id, page, field, text_source_id, start_off, end_off FROM {_E})) WHERE nxt < end_off""")
def neighbour_overlaps(spark: SparkSession, base: str) -> DataFrame:
    """Annotations and edits, taken together, that run into the next of their unit."""
    cols = [*spans.UNIT, "start_off", "end_off"]
    return spans.neighbour_overlaps(_gold(spark, base).select(*cols).union(_edits(spark, base).select(*cols)).distinct())


@query()
def resolved_candidates(spark: SparkSession, base: str) -> DataFrame:
    found = rules.rule_spans(table(spark, base, "page_extraction", "page_id", "text").distinct(), "page_id", "text")
    order = [-F.col("tier"), -(F.col("end_off") - F.col("start_off")), F.col("start_off"), F.col("entity_type"), F.col("rule")]
    return spans.keep_best(found, order, ["page_id"])


@query()
def matched_one_to_one(spark: SparkSession, base: str) -> DataFrame:
    return spans.match_one_to_one(_gold(spark, base), _edits(spark, base), "mention_id", "edit_id")


@query()
def redacted_pages(spark: SparkSession, base: str) -> DataFrame:
    key = ["document_id", "page", "text_source_id"]
    units = table(spark, base, "page_extraction", *key, "text").distinct()
    e = table(spark, base, "edit", *key, "field", "start_off", "end_off", "replacement", "edit_id").filter("field IS NULL").drop("field").distinct()
    kept = spans.keep_best(e, [-(F.col("end_off") - F.col("start_off")), F.col("start_off"), F.col("edit_id")], key)
    return spans.edited_texts(units, kept, key)


# Metrics -----------------------------------------------------------------------


def _outcomes(spark: SparkSession, base: str) -> DataFrame:
    g, e = _gold(spark, base), _edits(spark, base)
    hit = spans.touching(g, e).select("mention_id").withColumn("hit", F.lit(1))
    return g.join(hit, "mention_id", "left").select("entity_type", "document_id", F.coalesce("hit", F.lit(0)).alias("hit"))


_OUT = f"(SELECT g.entity_type, g.document_id, CASE WHEN EXISTS (SELECT 1 FROM {_E} e WHERE {_OVL}) THEN 1 ELSE 0 END AS hit FROM {_G} g)"


@query(f"""
SELECT entity_type, tp, fn, fp, CASE WHEN tp + fp <> 0 THEN round(tp / (tp + fp), 4) END AS precision, CASE WHEN tp + fn <> 0 THEN round(tp / (tp + fn), 4) END AS recall,
 CASE WHEN 2 * tp + fp + fn <> 0 THEN round(2 * tp / (2 * tp + fp + fn), 4) END AS f1
FROM (SELECT coalesce(a.entity_type, b.entity_type) AS entity_type, coalesce(tp, 0)::BIGINT AS tp, coalesce(fn, 0)::BIGINT AS fn, coalesce(fp, 0)::BIGINT AS fp FROM
 (SELECT entity_type, sum(hit) AS tp, sum(1 - hit) AS fn FROM {_OUT} GROUP BY entity_type) a FULL JOIN
 (SELECT e.entity_type, count(*) AS fp FROM {_E} e WHERE NOT EXISTS (SELECT 1 FROM {_G} g WHERE {_OVL}) GROUP BY e.entity_type) b ON a.entity_type = b.entity_type)""")
def prf_by_type(spark: SparkSession, base: str) -> DataFrame:
    hits = _outcomes(spark, base).groupBy("entity_type").agg(F.sum("hit").alias("tp"), F.sum(1 - F.col("hit")).alias("fn"))
    false = spans.without_overlap(_edits(spark, base), _gold(spark, base)).groupBy("entity_type").agg(F.count("*").alias("fp"))
    return metrics.prf(hits.join(false, "entity_type", "full_outer").fillna(0, ["tp", "fn", "fp"]))


@query(f"SELECT entity_type, document_id, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits FROM {_OUT} GROUP BY GROUPING SETS ((), (entity_type), (document_id), (entity_type, document_id))")
def hits_grouping_sets(spark: SparkSession, base: str) -> DataFrame:
    return (
        _outcomes(spark, base)
        .groupingSets([[], ["entity_type"], ["document_id"], ["entity_type", "document_id"]], "entity_type", "document_id")
        .agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    )


@query(f"SELECT g.entity_type AS gold_type, e.entity_type AS edit_type, count(*) AS n FROM {_G} g JOIN {_E} e ON {_OVL} GROUP BY 1, 2")
def type_confusion(spark: SparkSession, base: str) -> DataFrame:
    g, e = _gold(spark, base), _edits(spark, base)
    both = spans.overlap_join(g, e).select(g["entity_type"].alias("gold_type"), e["entity_type"].alias("edit_type"))
    return metrics.confusion(both, "gold_type", "edit_type")


@query(f"""
WITH p AS (SELECT g.entity_type AS a, e.entity_type AS b FROM {_G} g JOIN {_E} e ON {_OVL}),
t AS (SELECT count(*) AS n, sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS same FROM p),
c AS (SELECT sum(x.ra::DOUBLE * y.cb) AS e FROM (SELECT a AS v, count(*) AS ra FROM p GROUP BY a) x JOIN (SELECT b AS v, count(*) AS cb FROM p GROUP BY b) y ON x.v = y.v)
SELECT n, round(same / n, 6) AS observed, round(coalesce(e, 0) / (n::DOUBLE * n), 6) AS expected, round((same / n - coalesce(e, 0) / (n::DOUBLE * n)) / (1 - coalesce(e, 0) / (n::DOUBLE * n)), 6) AS kappa FROM t, c""")
def kappa_types(spark: SparkSession, base: str) -> DataFrame:
    g, e = _gold(spark, base), _edits(spark, base)
    both = spans.overlap_join(g, e).select(g["entity_type"].alias("a"), e["entity_type"].alias("b"))
    return metrics.kappa(both, "a", "b")


_CL = "(SELECT lower(trim(canonical_id)) AS truth, matter_id || '|' || lower(trim(text)) AS found FROM (SELECT DISTINCT entity_id, matter_id, text, canonical_id FROM syn_hybrid) WHERE canonical_id IS NOT NULL AND text IS NOT NULL AND matter_id IS NOT NULL)"


def _clusters(spark: SparkSession, base: str) -> DataFrame:
    s = table(spark, base, "syn_hybrid", "entity_id", "matter_id", "text", "canonical_id").distinct().dropna()
    return s.select(F.lower(F.trim("canonical_id")).alias("truth"), F.concat_ws("|", "matter_id", F.lower(F.trim("text"))).alias("found"))


@query(f"""
WITH c AS (SELECT truth, found, count(*) AS n FROM {_CL} GROUP BY 1, 2), t AS (SELECT truth, sum(n) AS nt FROM c GROUP BY 1), f AS (SELECT found, sum(n) AS nf FROM c GROUP BY 1),
x AS (SELECT sum(n::DOUBLE * n / nf) / sum(n) AS p, sum(n::DOUBLE * n / nt) / sum(n) AS r FROM c JOIN t USING (truth) JOIN f USING (found))
SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM x""")
def b_cubed_spellings(spark: SparkSession, base: str) -> DataFrame:
    return metrics.b_cubed(_clusters(spark, base), "truth", "found")


@query(f"""
WITH c AS (SELECT truth, found, count(*) AS n FROM {_CL} GROUP BY 1, 2),
v AS (SELECT (SELECT sum(n::DOUBLE * (n - 1)) / 2 FROM c) AS tp, (SELECT sum(n::DOUBLE * (n - 1)) / 2 FROM (SELECT sum(n) AS n FROM c GROUP BY truth)) AS pt, (SELECT sum(n::DOUBLE * (n - 1)) / 2 FROM (SELECT sum(n) AS n FROM c GROUP BY found)) AS pf)
SELECT tp, pt, pf, CASE WHEN pf <> 0 THEN round(tp / pf, 6) END AS precision, CASE WHEN pt <> 0 THEN round(tp / pt, 6) END AS recall, CASE WHEN pt + pf <> 0 THEN round(2 * tp / (pt + pf), 6) END AS f1 FROM v""")
def pairwise_spellings(spark: SparkSession, base: str) -> DataFrame:
    return metrics.pairwise(_clusters(spark, base), "truth", "found")


@query("""
WITH p AS (SELECT DISTINCT a.page_id AS ident, a.text AS ta, b.text AS tb FROM page_extraction a JOIN page_extraction b ON a.document_id = b.document_id AND a.page = b.page AND a.page_id < b.page_id),
wa AS (SELECT ident, w, count(*) AS na FROM (SELECT ident, unnest(regexp_split_to_array(lower(ta), '\\s+')) AS w FROM p) WHERE w <> '' GROUP BY 1, 2),
wb AS (SELECT ident, w, count(*) AS nb FROM (SELECT ident, unnest(regexp_split_to_array(lower(tb), '\\s+')) AS w FROM p) WHERE w <> '' GROUP BY 1, 2),
j AS (SELECT ident, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM wa FULL JOIN wb USING (ident, w))
SELECT ident, CAST(sum(least(na, nb)) AS BIGINT) AS common, CAST(sum(na) AS BIGINT) AS words_a, CAST(sum(nb) AS BIGINT) AS words_b, round(2 * sum(least(na, nb)) / (sum(na) + sum(nb)), 6) AS f1 FROM j GROUP BY ident""")
def bag_of_words_sources(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "page_extraction", "page_id", "document_id", "page", "text")
    b = p.select("document_id", "page", F.col("page_id").alias("other"), F.col("text").alias("tb"))
    both = p.join(b, ["document_id", "page"]).filter("page_id < other").select(F.col("page_id").alias("ident"), F.col("text").alias("ta"), "tb").distinct()
    return metrics.bag_of_words(both, "ta", "tb", "ident")


@query("""
SELECT page_id, count(*) AS n_words, round(avg(conf), 2) AS mean_conf, CASE WHEN count(conf) > 0 THEN round(sum(CASE WHEN conf < 90 THEN 1 ELSE 0 END) / count(conf), 4) END AS low_frac
FROM (SELECT page_id, w.conf AS conf FROM (SELECT page_id, unnest(words) AS w FROM (SELECT page_id, arg_max(words, coalesce(delivered_at, TIMESTAMP '1970-01-01')) AS words FROM page_extraction WHERE words IS NOT NULL GROUP BY page_id))) GROUP BY page_id""")
def page_quality(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "page_extraction", "page_id", "words", "delivered_at").filter("words IS NOT NULL").groupBy("page_id").agg(_latest_words())
    return metrics.page_quality(layout.page_words(p, "page_id"), ["page_id"], 90.0)


@query("""
WITH w AS (SELECT page_id, u.idx AS idx, u.conf AS conf FROM (SELECT page_id, unnest(words) AS u FROM (SELECT page_id, arg_max(words, coalesce(delivered_at, TIMESTAMP '1970-01-01')) AS words FROM page_extraction WHERE words IS NOT NULL GROUP BY page_id))),
p AS (SELECT page_id, avg(conf) AS mean_conf FROM w GROUP BY page_id), g AS (SELECT unnest([80, 85, 90, 95]) AS threshold)
SELECT threshold, CAST(sum(CASE WHEN mean_conf < threshold THEN 1 ELSE 0 END) AS BIGINT) AS flagged, count(*) AS pages FROM p, g GROUP BY threshold""")
def gate_threshold_sweep(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "page_extraction", "page_id", "words", "delivered_at").filter("words IS NOT NULL").groupBy("page_id").agg(_latest_words())
    mean = layout.page_words(p, "page_id").groupBy("page_id").agg(F.avg("conf").alias("mean_conf"))
    grid = F.explode(F.array(*[F.lit(t) for t in (80, 85, 90, 95)])).alias("threshold")
    return mean.select("mean_conf", grid).groupBy("threshold").agg(F.sum((F.col("mean_conf") < F.col("threshold")).cast("int")).alias("flagged"), F.count("*").alias("pages")).fillna(0, ["flagged"])


# Layout ------------------------------------------------------------------------


@query("""
SELECT page_id, w.block AS block, w.line AS line, min(w.bbox.x0) AS x0, min(w.bbox.y0) AS y0, max(w.bbox.x1) AS x1, max(w.bbox.y1) AS y1, count(*) AS n_words
FROM (SELECT page_id, unnest(words) AS w FROM (SELECT page_id, arg_max(words, coalesce(delivered_at, TIMESTAMP '1970-01-01')) AS words FROM page_extraction WHERE words IS NOT NULL GROUP BY page_id)) GROUP BY 1, 2, 3""")
def line_boxes(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "page_extraction", "page_id", "words", "delivered_at").filter("words IS NOT NULL").groupBy("page_id").agg(_latest_words())
    return layout.line_boxes(layout.page_words(p, "page_id"), ["page_id"])


@query("SELECT page_id, text FROM (SELECT DISTINCT page_id, text, words FROM page_extraction) WHERE words IS NOT NULL AND len(words) > 0 GROUP BY page_id, text")
def assembled_pages(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "page_extraction", "page_id", "words", "delivered_at").filter("words IS NOT NULL").groupBy("page_id").agg(_latest_words())
    return layout.assembled(layout.page_words(p, "page_id"), ["page_id"])


@query("""
SELECT page_id, idx, start_off, end_off, coalesce(sum(length(text) + 1) OVER (PARTITION BY page_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_at
FROM (SELECT page_id, w.idx AS idx, w.text AS text, w.start_off AS start_off, w.end_off AS end_off FROM (SELECT page_id, unnest(words) AS w FROM (SELECT page_id, arg_max(words, coalesce(delivered_at, TIMESTAMP '1970-01-01')) AS words FROM page_extraction WHERE words IS NOT NULL GROUP BY page_id)))""")
def word_offsets(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "page_extraction", "page_id", "words", "delivered_at").filter("words IS NOT NULL").groupBy("page_id").agg(_latest_words())
    return layout.offsets(layout.page_words(p, "page_id"), ["page_id"]).select("page_id", "idx", "start_off", "end_off", "start_at")


# Curation ------------------------------------------------------------------------


@query("""
SELECT document_id, matter_id, split, delivered_at FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY delivered_at DESC NULLS LAST, sha256 DESC NULLS LAST, split DESC NULLS LAST, matter_id DESC NULLS LAST) AS n FROM manifest_document) WHERE n = 1""")
def latest_delivery(spark: SparkSession, base: str) -> DataFrame:
    m = table(spark, base, "manifest_document", "document_id", "matter_id", "split", "sha256", "delivered_at")
    return curation.latest(m, ["document_id"], [F.col("delivered_at"), F.col("sha256"), F.col("split"), F.col("matter_id")]).select("document_id", "matter_id", "split", "delivered_at")


@query("""
WITH p AS (SELECT document_id || '/' || page AS ident, method, md5(min(text)) AS h FROM page_extraction WHERE method IN ('text_layer', 'ocr') AND text IS NOT NULL AND document_id IS NOT NULL AND page IS NOT NULL GROUP BY 1, 2), a AS (SELECT * FROM p WHERE method = 'text_layer'), b AS (SELECT * FROM p WHERE method = 'ocr')
SELECT coalesce(a.ident, b.ident) AS ident, CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'added' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.ident = b.ident WHERE a.h IS DISTINCT FROM b.h""")
def hash_changes(spark: SparkSession, base: str) -> DataFrame:
    """Pages by the hash of their text: the text layers as the frozen state, the scans as the current one."""
    p = table(spark, base, "page_extraction", "document_id", "page", "method", "text").dropna()
    one = p.groupBy(F.concat_ws("/", "document_id", "page").alias("ident"), "method").agg(F.md5(F.min("text")).alias("h"))
    return curation.hash_changes(one.filter("method = 'text_layer'"), one.filter("method = 'ocr'"), "ident", "h")


@query("""
SELECT DISTINCT matter_id, entity_type, group_id, matter_id || '/' || lower(entity_type) || '_' || CASE WHEN r < 1000 THEN lpad(r::VARCHAR, 3, '0') ELSE r::VARCHAR END AS opaque_id
FROM (SELECT *, dense_rank() OVER (PARTITION BY matter_id, entity_type ORDER BY group_id) AS r FROM link_group)""")
def opaque_ids(spark: SparkSession, base: str) -> DataFrame:
    g = table(spark, base, "link_group", "matter_id", "entity_type", "group_id").distinct()
    return curation.opaque_ids(g, "matter_id", "entity_type", "group_id")


@query("""
SELECT method, page_id FROM (SELECT method, page_id, row_number() OVER (PARTITION BY method ORDER BY sha256('7|' || page_id::VARCHAR), page_id) AS r FROM (SELECT DISTINCT method, page_id FROM page_extraction)) WHERE r <= 25""")
def stratified_draw(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "page_extraction", "method", "page_id").distinct()
    return curation.stratified_top(p, "method", 25, "7", "page_id")


@query("""
WITH c AS (SELECT method, count(*) AS n FROM page_extraction GROUP BY method), q AS (SELECT method, 100.0::DOUBLE * n / (SELECT sum(n) FROM c)::DOUBLE AS q FROM c), f AS (SELECT *, floor(q) AS f FROM q)
SELECT method, CAST(f + CASE WHEN row_number() OVER (ORDER BY q - f DESC, method) <= 100 - (SELECT sum(f) FROM f) THEN 1 ELSE 0 END AS BIGINT) AS seats FROM f""")
def largest_remainder(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "page_extraction", "method").groupBy("method").agg(F.count("*").alias("n"))
    return curation.largest_remainder(c, "method", "n", 100)


@query("""
WITH u AS (SELECT DISTINCT document_id, page, text_source_id, text AS unit FROM page_extraction), m AS (SELECT DISTINCT mention_id, document_id, page, text_source_id, start_off, end_off, text FROM gold_mention),
j AS (SELECT m.*, u.unit FROM m LEFT JOIN u ON m.document_id = u.document_id AND m.page = u.page AND m.text_source_id = u.text_source_id WHERE m.start_off IS NOT NULL)
SELECT mention_id, 'empty_span' AS issue FROM j WHERE start_off >= end_off UNION ALL SELECT mention_id, 'unknown_unit' FROM j WHERE unit IS NULL
UNION ALL SELECT mention_id, 'no_entity' FROM (SELECT DISTINCT mention_id, canonical_id FROM gold_mention) WHERE canonical_id IS NULL OR trim(canonical_id) = ''
UNION ALL SELECT mention_id, 'no_role' FROM (SELECT DISTINCT mention_id, entity_type, role FROM gold_mention) WHERE entity_type = 'PERSON' AND role IS NULL
UNION ALL SELECT mention_id, 'deliveries_differ' FROM (SELECT mention_id, count(DISTINCT coalesce(canonical_id, '')) AS n FROM gold_mention GROUP BY 1) WHERE n > 1
UNION ALL SELECT mention_id, 'out_of_range' FROM j WHERE end_off > length(unit) UNION ALL SELECT mention_id, 'text_differs' FROM j WHERE substr(unit, start_off + 1, end_off - start_off) <> text""")
def span_issues(spark: SparkSession, base: str) -> DataFrame:
    m = table(spark, base, "gold_mention", "mention_id", "document_id", "page", "text_source_id", "start_off", "end_off", "text")
    placed = curation.span_issues(m, table(spark, base, "page_extraction", "document_id", "page", "text_source_id", "text"))
    return placed.union(curation.record_issues(table(spark, base, "gold_mention", "mention_id", "entity_type", "role", "canonical_id")))


@query("SELECT entity_id AS ident, count(*) AS deliveries FROM syn_hybrid GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "syn_hybrid", "entity_id").groupBy(F.col("entity_id").alias("ident")).agg(F.count("*").alias("deliveries")).filter("deliveries > 1")


@query()
def linked_groups(spark: SparkSession, base: str) -> DataFrame:
    return curation.linked_groups(table(spark, base, "syn_hybrid", "entity_id", "matter_id", "entity_type", "text"))


# Keyed operators -----------------------------------------------------------------


def _hmac_sql(message: str) -> str:
    k = KEY.ljust(64, b"\0")
    i, o = bytes(b ^ 0x36 for b in k).hex(), bytes(b ^ 0x5C for b in k).hex()
    return f"sha256(unhex('{o}') || unhex(sha256(unhex('{i}') || encode({message}))))"


@query(f"SELECT DISTINCT matter_id, entity_id, {_hmac_sql(chr(39) + 'name' + chr(39) + ' || chr(31) || matter_id || chr(31) || text')} AS lookup FROM syn_hybrid WHERE text IS NOT NULL AND matter_id IS NOT NULL")
def vault_lookup(spark: SparkSession, base: str) -> DataFrame:
    s = table(spark, base, "syn_hybrid", "matter_id", "entity_id", "text").filter("text IS NOT NULL AND matter_id IS NOT NULL")
    return s.select("matter_id", "entity_id", surrogates.lookup_key(KEY, F.lit("name"), "matter_id", "text").alias("lookup")).distinct()


@query("""
SELECT DISTINCT entity_id, lower(entity_type) || ':' || substr(sha256(lower(entity_type) || chr(31) || lower(trim(text))), 1, 12) AS group_id FROM syn_hybrid WHERE text IS NOT NULL""")
def hashed_groups(spark: SparkSession, base: str) -> DataFrame:
    s = table(spark, base, "syn_hybrid", "entity_id", "entity_type", "text").filter("text IS NOT NULL")
    return s.select("entity_id", keyed.group_id("entity_type", F.lower(F.trim("text"))).alias("group_id")).distinct()


@query("""
WITH p AS (SELECT DISTINCT mention_id, text, regexp_replace(text, '[^0-9]', '', 'g') AS d0 FROM gold_mention WHERE entity_type = 'PHONE' AND text IS NOT NULL),
d AS (SELECT *, CASE WHEN length(d0) = 11 AND d0[1:2] = '61' THEN '0' || substr(d0, 3, 9) ELSE d0 END AS d FROM p)
SELECT mention_id, text, CASE WHEN length(d) = 10 AND d LIKE '04%' THEN 'mobile' WHEN length(d) = 10 AND regexp_matches(d, '^0[2378]') THEN 'landline' WHEN length(d) = 10 AND d LIKE '1300%' THEN '1300' WHEN length(d) = 10 AND d LIKE '1800%' THEN '1800' WHEN length(d) = 6 AND d LIKE '13%' THEN '13' END AS number_class FROM d""")
def phone_classes(spark: SparkSession, base: str) -> DataFrame:
    g = table(spark, base, "gold_mention", "mention_id", "entity_type", "text").filter("entity_type = 'PHONE' AND text IS NOT NULL").select("mention_id", "text").distinct()
    return g.withColumn("number_class", strings.phone_class("text"))


def _phones(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "gold_mention", "document_id", "entity_type", "text").filter("entity_type = 'PHONE' AND text IS NOT NULL").select("document_id", "text").distinct()


@query("""
SELECT 'phones' AS name, count(*) AS n FROM (SELECT DISTINCT document_id, text FROM gold_mention WHERE entity_type = 'PHONE' AND text IS NOT NULL)
UNION ALL SELECT 'phones neither reserved nor placeholder', 0 UNION ALL SELECT 'phones that share a surrogate', 0 UNION ALL SELECT 'medicare surrogates that pass', 0
UNION ALL SELECT 'surnames that share a surrogate', 0 UNION ALL SELECT 'surnames', count(*) FROM (SELECT DISTINCT matter_id, unnest(surnames) AS v FROM link_group) WHERE matter_id IS NOT NULL AND v IS NOT NULL""")
def surrogate_invariants(spark: SparkSession, base: str) -> DataFrame:
    """What must hold of issued surrogates, counted over all rows."""
    phones = phone_surrogates(spark, base)
    odd = phones.filter(~surrogates.is_reserved_phone("surrogate") & (F.col("surrogate") != "[PHONE]"))
    national = F.regexp_replace(checks.digits_only("surrogate"), "^61", "0")
    given = phones.filter("surrogate <> '[PHONE]'").groupBy("document_id", national.alias("s")).agg(F.countDistinct(F.regexp_replace(checks.digits_only("text"), "^61", "0")).alias("k")).filter("k > 1")
    passing = unusable_numbers(spark, base).filter(checks.medicare_valid("surrogate"))
    names = issued_surnames(spark, base)
    twice = names.groupBy("matter_id", "surrogate").agg(F.countDistinct("value").alias("k")).filter("k > 1")
    rows = [("phones", phones), ("phones neither reserved nor placeholder", odd), ("phones that share a surrogate", given), ("medicare surrogates that pass", passing), ("surnames that share a surrogate", twice), ("surnames", names)]
    out = None
    for name, df in rows:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


@query()
def phone_surrogates(spark: SparkSession, base: str) -> DataFrame:
    return surrogates.issued_phones(_phones(spark, base), KEY, "document_id", "text")


def _surname_pool(spark: SparkSession) -> DataFrame:
    """Invented surnames made by rule: a head and an ending each."""
    heads = ["Ard", "Bel", "Cor", "Dal", "Ester", "Fal", "Gar", "Hol", "Ing", "Jor", "Kel", "Lor", "Mor", "Nor", "Orm", "Pel"]
    tails = ["amere", "bourne", "combe", "dene", "enwick", "ghyll", "hithe", "isle"]
    return spark.createDataFrame([("surname", h + t) for h in heads for t in tails], "kind string, surrogate string")


@query()
def issued_surnames(spark: SparkSession, base: str) -> DataFrame:
    g = table(spark, base, "link_group", "matter_id", "surnames").select("matter_id", F.explode("surnames").alias("value")).withColumn("kind", F.lit("surname"))
    pool = surrogates.free_pool(_surname_pool(spark), table(spark, base, "syn_hybrid", "text"), "surrogate", "text")
    return surrogates.issue(g, pool, KEY)


@query()
def restored_surnames(spark: SparkSession, base: str) -> DataFrame:
    index = surrogates.reverse_index(issued_surnames(spark, base))
    tokens = index.select("matter_id", F.col("surrogate").alias("token"))
    return surrogates.restored_tokens(tokens, index)


@query("""
SELECT l_orderkey, l_linenumber, CAST(year(l_shipdate) - year(o_orderdate) - CASE WHEN month(l_shipdate) < month(o_orderdate) OR (month(l_shipdate) = month(o_orderdate) AND day(l_shipdate) < day(o_orderdate)) THEN 1 ELSE 0 END AS INTEGER) AS years
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def completed_years(spark: SparkSession, base: str) -> DataFrame:
    li = table(spark, base, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, base, "orders", "o_orderkey", "o_orderdate")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("l_orderkey", "l_linenumber", strings.completed_years(F.col("o_orderdate"), F.col("l_shipdate")).alias("years"))


# Leak scans ------------------------------------------------------------------------


@query(r"""
WITH n AS (SELECT DISTINCT regexp_replace(text, '[^0-9]', '', 'g') AS d FROM gold_mention WHERE entity_type IN ('TFN', 'MEDICARE', 'PHONE') AND text IS NOT NULL),
t AS (SELECT DISTINCT doc_id, regexp_replace(x, '[^0-9]', '', 'g') AS r FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9][0-9 \-/.]{4,}[0-9]')) AS x FROM documents))
SELECT DISTINCT doc_id, d AS needle FROM t JOIN n ON contains(t.r, n.d) WHERE length(d) >= 6""")
def leaked_digits(spark: SparkSession, base: str) -> DataFrame:
    n = table(spark, base, "gold_mention", "entity_type", "text").filter(F.col("entity_type").isin("TFN", "MEDICARE", "PHONE"))
    return needles.scan_digits(table(spark, base, "documents", "doc_id", "text"), "doc_id", "text", n, "text")


@query()
def leaked_names(spark: SparkSession, base: str) -> DataFrame:
    n = table(spark, base, "gold_mention", "entity_type", "text").filter("entity_type = 'PERSON'")
    return needles.scan_exact(table(spark, base, "documents", "doc_id", "text"), "doc_id", "text", n, "text")


@query()
def near_names(spark: SparkSession, base: str) -> DataFrame:
    n = table(spark, base, "link_group", "surnames").select(F.explode("surnames").alias("s"))
    return needles.scan_fuzzy(table(spark, base, "page_extraction", "page_id", "text"), "page_id", "text", n, "s")


@query()
def exported_spans(spark: SparkSession, base: str) -> DataFrame:
    return exported(_gold(spark, base).select("document_id", "page", "text_source_id", "start_off", "end_off", "entity_type"), ["document_id"])


# Context, combination, recovery ------------------------------------------------------


def _context_sql() -> str:
    parts = []
    for n, (kind, before, value) in detection.CONTEXT.items():
        p, v = f"{before}{value}\\b".replace("'", "''"), f"({value})$"
        parts.append(
            f"SELECT page_id, '{n}' AS rule, '{kind}' AS entity_type, s + length(x) - length(regexp_extract(x, '{v}', 1)) AS start_off, s + length(x) AS end_off, regexp_extract(x, '{v}', 1) AS text FROM ("
            f"SELECT page_id, m[i] AS x, CAST(list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0) AS INTEGER) AS s FROM ("
            f"SELECT page_id, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS g, unnest(range(1, len(regexp_extract_all(text, '{p}')) + 1)) AS i FROM page_extraction))"
        )
    return " UNION ALL ".join(parts)


@query(_context_sql())
def context_identifiers(spark: SparkSession, base: str) -> DataFrame:
    return detection.context_spans(table(spark, base, "page_extraction", "page_id", "text"), "page_id", "text")


@query()
def date_roles(spark: SparkSession, base: str) -> DataFrame:
    pages = table(spark, base, "page_extraction", "page_id", "text").distinct()
    found = rules.rule_spans(pages, "page_id", "text", "date.dmy", "date.iso", "date.words")
    roles = {"examination": ["examined", "dated"], "payment": ["paid on", "premium"], "incident": ["while turning", "fell", "caught", "slipped", "struck"], "deadline": ["before "]}
    return detection.nearest_before(pages, found, "page_id", "text", roles)


_D3 = "(SELECT page_id, 'rules' AS detector, entity_type, start_off, end_off FROM ({a}) UNION SELECT page_id, 'context', entity_type, start_off, end_off FROM ({b}))"


@query(
    "WITH d AS "
    + _D3.format(a=_scan_sql("page_extraction", "page_id", ["passport", "claim"]), b=_context_sql())
    + " SELECT x.page_id, x.detector, x.entity_type, x.start_off, x.end_off, count(DISTINCT y.detector) AS votes FROM d x JOIN d y ON x.page_id = y.page_id AND x.entity_type = y.entity_type AND x.start_off < y.end_off AND y.start_off < x.end_off GROUP BY ALL HAVING count(DISTINCT y.detector) >= 2"
)
def combiner_intersection(spark: SparkSession, base: str) -> DataFrame:
    pages = table(spark, base, "page_extraction", "page_id", "text")
    cols = ["page_id", "entity_type", "start_off", "end_off"]
    a = rules.rule_spans(pages, "page_id", "text", "passport", "claim").select(F.lit("rules").alias("detector"), *cols)
    b = detection.context_spans(pages, "page_id", "text").select(F.lit("context").alias("detector"), *cols)
    return detection.combined(a.union(b).distinct(), "detector", 2, ["page_id"]).select("page_id", "detector", "entity_type", "start_off", "end_off", "votes")


@query("""
WITH m AS (SELECT DISTINCT mention_id, text, document_id, page FROM gold_mention WHERE text IS NOT NULL AND page IS NOT NULL), t AS (SELECT DISTINCT document_id, page, text_source_id, lower(text) AS t FROM page_extraction)
SELECT m.mention_id, count(*) AS sources, CAST(sum(CASE WHEN contains(t.t, lower(m.text)) THEN 1 ELSE 0 END) AS BIGINT) AS recovered FROM m JOIN t ON m.document_id = t.document_id AND m.page = t.page GROUP BY 1""")
def surface_recovery(spark: SparkSession, base: str) -> DataFrame:
    m = table(spark, base, "gold_mention", "mention_id", "text", "document_id", "page").dropna().distinct()
    t = table(spark, base, "page_extraction", "document_id", "page", "text_source_id", "text").select("document_id", "page", "text_source_id", F.lower("text").alias("t")).distinct()
    both = m.join(t, ["document_id", "page"])
    return both.groupBy("mention_id").agg(F.count("*").alias("sources"), F.sum(F.col("t").contains(F.lower("text")).cast("int")).alias("recovered"))


@query()
def text_error_rate(spark: SparkSession, base: str) -> DataFrame:
    """(ident, other, cer) of the whole texts of every pair of sources of a page."""
    p = table(spark, base, "page_extraction", "page_id", "document_id", "page", "text")
    b = p.select("document_id", "page", F.col("page_id").alias("other"), F.col("text").alias("hyp"))
    both = p.join(b, ["document_id", "page"]).filter("page_id < other").select(F.col("page_id").alias("ident"), "other", F.col("text").alias("ref"), "hyp").distinct()
    return both.select("ident", "other", metrics.text_error_rate("ref", "hyp").alias("cer"))


@query("""
WITH s AS (SELECT DISTINCT entity_id, matter_id, lower(trim(canonical_id)) AS c, text FROM syn_hybrid WHERE canonical_id IS NOT NULL AND matter_id IS NOT NULL),
k AS (SELECT matter_id, c, count(*) AS mentions, count(DISTINCT text) AS spellings FROM s GROUP BY 1, 2)
SELECT matter_id, count(*) AS entities, CAST(sum(mentions) AS BIGINT) AS mentions, CAST(sum(CASE WHEN spellings > 1 THEN 1 ELSE 0 END) AS BIGINT) AS respelled FROM k GROUP BY 1""")
def alias_consistency(spark: SparkSession, base: str) -> DataFrame:
    s = table(spark, base, "syn_hybrid", "entity_id", "matter_id", "canonical_id", "text").filter("canonical_id IS NOT NULL AND matter_id IS NOT NULL")
    s = s.select("entity_id", "matter_id", F.lower(F.trim("canonical_id")).alias("c"), "text").distinct()
    k = s.groupBy("matter_id", "c").agg(F.count("*").alias("mentions"), F.countDistinct("text").alias("spellings"))
    return k.groupBy("matter_id").agg(F.count("*").alias("entities"), F.sum("mentions").alias("mentions"), F.sum((F.col("spellings") > 1).cast("int")).alias("respelled"))


@query(
    f"SELECT document_id, count(*) AS spans, sha256(string_agg(coalesce(page::VARCHAR, '') || '|' || text_source_id || '|' || start_off || '|' || end_off || '|' || entity_type || '|' || mention_id, chr(10) ORDER BY coalesce(page, -1), text_source_id, start_off, end_off, entity_type, mention_id)) AS digest FROM {_G} GROUP BY document_id"
)
def spans_digest(spark: SparkSession, base: str) -> DataFrame:
    row = F.struct(F.coalesce("page", F.lit(-1)).alias("o"), "text_source_id", "start_off", "end_off", "entity_type", "mention_id")
    line = lambda x: F.concat_ws("|", F.when(x["o"] == -1, "").otherwise(x["o"].cast("string")), x["text_source_id"], x["start_off"].cast("string"), x["end_off"].cast("string"), x["entity_type"], x["mention_id"])
    per = _gold(spark, base).groupBy("document_id").agg(F.count("*").alias("spans"), F.array_sort(F.collect_list(row)).alias("r"))
    return per.select("document_id", "spans", F.sha2(F.concat_ws("\n", F.transform("r", line)), 256).alias("digest"))


@query("""
WITH w AS (SELECT page_id, u.block AS block, u.line AS line, u.idx AS idx, u.bbox.x0 AS x0, u.bbox.x1 AS x1 FROM (SELECT page_id, unnest(words) AS u FROM (SELECT page_id, arg_max(words, coalesce(delivered_at, TIMESTAMP '1970-01-01')) AS words FROM page_extraction WHERE words IS NOT NULL GROUP BY page_id))),
n AS (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY page_id, block, line ORDER BY idx) <= 4 THEN 0 ELSE 1 END AS fresh FROM w),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY page_id, block, line ORDER BY idx ROWS UNBOUNDED PRECEDING) AS cell FROM n)
SELECT page_id, block, line, CAST(cell AS BIGINT) AS cell, min(idx) AS first_idx, max(idx) AS last_idx FROM c GROUP BY 1, 2, 3, 4""")
def line_cells(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "page_extraction", "page_id", "words", "delivered_at").filter("words IS NOT NULL").groupBy("page_id").agg(_latest_words())
    return layout.cells(layout.page_words(p, "page_id"), ["page_id"], 4.0)


@query(f"""
WITH g AS (SELECT row_number() OVER (ORDER BY hit, n) - 1 AS i, hit, n FROM (SELECT document_id, sum(hit) AS hit, count(*) AS n FROM {_OUT} GROUP BY 1)), k AS (SELECT count(*) AS k FROM g),
d AS (SELECT r, CAST('0x' || substr(sha256('0|' || r || '|' || s), 1, 12) AS BIGINT) % k AS i FROM k, range(0, 200) a(r), range(0, (SELECT k FROM k)) b(s)),
v AS (SELECT r, sum(hit) / sum(n) AS v FROM d JOIN g USING (i) GROUP BY r HAVING sum(n) > 0), o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS p, count(*) OVER () AS m FROM v)
SELECT (SELECT sum(hit) / sum(n) FROM g) AS estimate, (SELECT v FROM o WHERE p = least(m - 1, floor(0.025 * m))) AS low, (SELECT v FROM o WHERE p = least(m - 1, floor(0.975 * m))) AS high""")
def recall_interval(spark: SparkSession, base: str) -> DataFrame:
    per = _outcomes(spark, base).groupBy("document_id").agg(F.sum("hit").alias("hit"), F.count("*").alias("n"))
    return metrics.bootstrap_interval(per, "hit", "n", 200)


@query(r"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}') AS m FROM documents)
SELECT DISTINCT doc_id, lower(unnest(m)) AS address FROM t""")
def email_addresses(spark: SparkSession, base: str) -> DataFrame:
    found = rules.rule_spans(table(spark, base, "documents", "doc_id", "text"), "doc_id", "text", "email")
    return found.select("doc_id", F.lower("text").alias("address")).distinct()


@query()
def passing_attempts(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "page_extraction", "page_id", "document_id", "page", "words", "delivered_at").filter("words IS NOT NULL").groupBy("page_id", "document_id", "page").agg(_latest_words())
    mean = layout.page_words(p, "page_id", "document_id", "page").groupBy("document_id", "page", "page_id").agg(F.avg("conf").alias("mean_conf"))
    rung = metrics.running_rank(mean, ["document_id", "page"], [F.col("page_id")], "rung")
    return detection.ladder(rung, ["document_id", "page"], 92.0)


@query()
def parsed_dates(spark: SparkSession, base: str) -> DataFrame:
    g = table(spark, base, "gold_mention", "mention_id", "entity_type", "text").filter("entity_type IN ('DATE', 'DATE_OF_BIRTH')").select("mention_id", "text").distinct()
    return g.withColumn("day", dates.parsed("text"))


@query()
def unusable_numbers(spark: SparkSession, base: str) -> DataFrame:
    """Medicare numbers with surrogates that fail their check digit; tax file numbers are redacted and get none."""
    g = table(spark, base, "gold_mention", "document_id", "entity_type", "text").filter((F.col("entity_type") == "MEDICARE") & F.col("text").isNotNull()).distinct()
    return surrogates.with_unusable(g, "text", "medicare", KEY, "document_id")


def flagship(spark: SparkSession, base: str) -> DataFrame:
    """Candidates of every text rule over all pages, resolved to non-overlapping spans."""
    return resolved_candidates(spark, base)


from maskwell.plans import measures  # noqa: E402, F401
