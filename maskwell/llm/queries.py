"""Queries p1_ to p8_ and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm import glyphs, leaks, mixing, names, personal, scans, splits, stuffing
from maskwell.runtime import stage
from maskwell.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def p3_found(spark: SparkSession, base: str) -> DataFrame:
    manifest = table(spark, base, "manifest_document", "document_id", "matter_id", "source_name_sha256")
    mentions = table(spark, base, "gold_mention", "document_id", "canonical_id")
    return splits.groups_across_matters(manifest, splits.related_documents(manifest, mentions))


@query
def p3_split(spark: SparkSession, base: str) -> DataFrame:
    manifest = table(spark, base, "manifest_document", "document_id", "matter_id", "source_name_sha256")
    mentions = table(spark, base, "gold_mention", "document_id", "canonical_id")
    return splits.assign_splits(splits.related_documents(manifest, mentions))


@query
def p3_shares(spark: SparkSession, base: str) -> DataFrame:
    return splits.split_report(p3_split(spark, base))


@query
def p4_found(spark: SparkSession, base: str) -> DataFrame:
    pages = table(spark, base, "page_extraction", "page_id", "document_id", "page", "text")
    names = table(spark, base, "syn_hybrid", "entity_id", "matter_id", "text")
    a = glyphs.same_look_pairs(pages, ["document_id", "page"], "page_id", "text")
    b = glyphs.same_look_pairs(names, ["matter_id"], "entity_id", "text")
    return a.select(F.lit("page").alias("record_kind"), "id_a", "id_b").union(b.select(F.lit("mention"), "id_a", "id_b"))


@query
def p4_consistent(spark: SparkSession, base: str) -> DataFrame:
    pages = table(spark, base, "page_extraction", "page_id", "text")
    names = table(spark, base, "syn_hybrid", "entity_id", "text")
    a = glyphs.consistent_text(pages).select(F.lit("page").alias("record_kind"), F.col("page_id").cast("string").alias("record_id"), "consistent_text")
    b = glyphs.consistent_text(names).select(F.lit("mention"), "entity_id", "consistent_text")
    return a.union(b).distinct()


def _resolved(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "syn_hybrid", "entity_id", "matter_id", "entity_type", "text")
    named = rows.select(F.col("matter_id").alias("matter"), F.col("entity_type").alias("etype"), F.col("entity_id").alias("id"), "text")
    return names.spelling_entities(named)


@query
def p1_found(spark: SparkSession, base: str) -> DataFrame:
    resolved, _ = stage(_resolved(spark, base), "resolved")
    groups = table(spark, base, "link_group", "group_id", "matter_id", "members")
    mention = names.same_entity_pairs(resolved).select(F.lit("mention").alias("record_kind"), "id_a", "id_b")
    group = names.same_entity_pairs(names.group_entities(groups, resolved)).select(F.lit("group"), "id_a", "id_b")
    return mention.union(group)


@query
def p1_entities(spark: SparkSession, base: str) -> DataFrame:
    return _resolved(spark, base).select(F.col("matter").alias("matter_id"), F.col("etype").alias("entity_type"), F.col("id").alias("entity_id"), "entity").distinct()


@query
def p6_found(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents", "doc_id", "text")
    items = table(spark, base, "eval_item", "item_id", "text")
    return leaks.leaked_items(docs, items)


@query
def p6_items(spark: SparkSession, base: str) -> DataFrame:
    return p6_found(spark, base).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"))


@query
def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return stuffing.stuffed_documents(table(spark, base, "documents", "doc_id", "text")).select("doc_id").distinct()


@query
def p8_coherence(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents", "doc_id", "text")
    return stuffing.stuffing_share(docs).select(F.col("h").alias("text_md5"), "coherence", "share")


@query
def p5_found(spark: SparkSession, base: str) -> DataFrame:
    pages = table(spark, base, "page_extraction", "page_id", "document_id", "page", "method", "text")
    furniture, hyphens, wrong, _ = scans.read_scans(pages)
    out = furniture.select("page_id", F.lit("furniture").alias("noise_kind"), F.col("line").alias("pos"))
    out = out.union(hyphens.select("page_id", F.lit("hyphen"), "line")).union(wrong.select("page_id", F.lit("misread"), "pos"))
    return out.distinct()


def _lexicon(spark: SparkSession, base: str) -> personal.Lexicon:
    gold = table(spark, base, "gold_mention", "text", "entity_type").filter("entity_type = 'PERSON'").select("text")
    syn = table(spark, base, "syn_hybrid", "text", "entity_type").filter("entity_type = 'PERSON'").select("text")
    return personal.name_lexicon(gold.union(syn), table(spark, base, "page_extraction", "text"))


@query
def p2_found(spark: SparkSession, base: str) -> DataFrame:
    lex = _lexicon(spark, base)
    pages = personal.personal_spans(table(spark, base, "page_extraction", "page_id", "text"), "page_id", "text", lex)
    edits = table(spark, base, "edit", "edit_id", "replacement", "entity_type")
    edits = personal.personal_spans(edits, "edit_id", "replacement", lex, F.col("entity_type"))
    return pages.select(F.lit("page").alias("record_kind"), "*").union(edits.select(F.lit("edit"), "*"))


@query
def p2_masked(spark: SparkSession, base: str) -> DataFrame:
    pages = table(spark, base, "page_extraction", "page_id", "text")
    return personal.masked_text(pages, "text", _lexicon(spark, base)).select("page_id", "masked_text").distinct()


@query
def p7_mix(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents", "doc_id", "source", "text")
    return mixing.mix_sources(docs, table(spark, base, "mix_target"))


@query
def p7_shares(spark: SparkSession, base: str) -> DataFrame:
    return mixing.mix_report(p7_mix(spark, base), table(spark, base, "mix_target"))


@query
def p5_repaired(spark: SparkSession, base: str) -> DataFrame:
    return scans.repaired_pages(table(spark, base, "page_extraction", "page_id", "document_id", "page", "method", "text"))
