"""Splits that keep related records together.

Method: documents and the keys they share form a graph. Every key contributes
edges to its smallest document only (a star, never all pairs), so a key held by
a third of all rows costs one row per holder. Components come from hash-to-min:
each node sends its cluster to the cluster's minimum and the minimum to the
cluster, held as (node, member) rows, until nothing changes. Components then
go to splits by weighted rendezvous hashing with the stated weights, each by its
own name alone, so that no component moves because another one appears or grows.

A component that holds a large part of the documents can take the shares away
from their targets. ``split_report`` shows it; it can be answered, once and for
all rows alike, by naming the split of that component in ``pins`` or by other
``weights``, both stated by the caller and kept for later runs.

Null and placeholder keys relate nothing. Keys differ neither by case nor by
outer blanks. Repeated deliveries add their keys; a document counts once.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.runtime import drop_staged, stage

# Spellings that stand for no key at all.
PLACEHOLDERS = [
    "", "-", "--", "?", "n/a", "na", "nan", "nil", "none", "null", "tba", "tbd", "unassigned", "unknown", "undefined",
    "not available", "not known", "missing", "redacted", "xxx",
]
# Digests of empty input.
EMPTY_DIGESTS = [
    "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
    "d41d8cd98f00b204e9800998ecf8427e",
    "da39a3ee5e6b4b0d3255bfef95601890afd80709",
]
DEFAULT_WEIGHTS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def clean_key(col: Column | str) -> Column:
    """Lower case without outer blanks; null where the value stands for nothing."""
    k = F.lower(F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"^[\s ]+|[\s ]+$", ""))
    bare = F.regexp_replace(k, r"^[<\[({]|[>\])}]$", "")
    nothing = (
        bare.isin(PLACEHOLDERS)
        | k.isin(EMPTY_DIGESTS)
        | k.rlike(r"^([0f])\1{15,}$")
        | k.rlike(r"(^|[/_:.\- ])(unassigned|unknown|unidentified|none|null|n/a|placeholder)$")
    )
    return F.when(~nothing, k)


def hash_to_min(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components: (node, component), component the smallest node.

    A row with a = b names a lone node. Rows with nulls are ignored. Raises if
    ``max_rounds`` is reached, never returns unfinished components.
    """
    spark = edges.sparkSession
    ab = edges.select(F.col(a).alias("node"), F.col(b).alias("member")).dropna()
    ba = ab.select(F.col("member").alias("node"), F.col("node").alias("member"))
    own = ab.select("node", F.col("node").alias("member"))
    own2 = ba.select("node", F.col("node").alias("member"))
    state, path = stage(ab.union(ba).union(own).union(own2).distinct(), "hm")
    seen = None
    for _ in range(max_rounds):
        low = state.groupBy("node").agg(F.min("member").alias("low"))
        both = state.join(low, "node")
        nxt = both.select(F.explode(F.array(F.struct(F.col("low").alias("node"), "member"), F.struct(F.col("member").alias("node"), F.col("low").alias("member")))).alias("r"))
        nxt, new_path = stage(nxt.select("r.*").distinct(), "hm")
        sign = nxt.agg(F.count("*"), F.sum(F.xxhash64("node", "member").cast("decimal(38,0)"))).first()
        drop_staged(spark, path)
        state, path = nxt, new_path
        if sign == seen:
            return state.groupBy("node").agg(F.min("member").alias("component"))
        seen = sign
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def relation_edges(documents: DataFrame, key_sources: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Star edges (a, b): each document with the smallest holder of each of its keys.

    ``key_sources`` holds (frame, document column, key column, kind).
    """
    held = None
    for df, doc, key, kind in key_sources:
        one = df.select(F.col(doc).alias("d"), F.lit(kind).alias("kind"), clean_key(key).alias("k")).dropna().distinct()
        held = one if held is None else held.union(one)
    hubs = held.groupBy("kind", "k").agg(F.min("d").alias("b"))
    lone = documents.select(F.col("d").alias("a"), F.col("d").alias("b"))
    return held.join(hubs, ["kind", "k"]).select(F.col("d").alias("a"), "b").union(lone).distinct()


def related_documents(manifest: DataFrame, mentions: DataFrame) -> DataFrame:
    """(document_id, component) for every document of the manifest."""
    docs = manifest.select(F.col("document_id").alias("d")).dropna().distinct()
    known = mentions.join(docs, mentions["document_id"] == docs["d"], "left_semi")
    edges = relation_edges(
        docs,
        [
            (manifest, "document_id", "matter_id", "matter"),
            (manifest, "document_id", "source_name_sha256", "source"),
            (known, "document_id", "canonical_id", "entity"),
        ],
    )
    return hash_to_min(edges).select(F.col("node").alias("document_id"), "component")


def groups_across_matters(manifest: DataFrame, components: DataFrame) -> DataFrame:
    """(document_id, group_matter_id) where the related set holds two matters or more."""
    keyed = manifest.select("document_id", clean_key("matter_id").alias("m")).dropna().distinct()
    spans = (
        components.join(keyed, "document_id")
        .groupBy("component")
        .agg(F.min("m").alias("group_matter_id"), F.max("m").alias("hi"))
        .filter("group_matter_id <> hi")
        .select("component", "group_matter_id")
    )
    return components.join(spans, "component").select("document_id", "group_matter_id")


def assign_splits(components: DataFrame, weights: Mapping[str, float] = DEFAULT_WEIGHTS, pins: Mapping[str, str] | None = None) -> DataFrame:
    """(document_id, component, split); a component is never divided.

    Of all splits a component takes the one with the greatest -weight / ln(u),
    u its hash with the split in (0, 1). ``pins`` names the split of single
    components and moves no other. Splits of no weight get nothing; an empty
    input gives an empty result.
    """
    score = []
    for s, w in sorted(weights.items()):
        if w > 0:
            bits = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", "component", F.lit(s)), 256), 1, 14), 16, 10).cast("double")
            score.append(F.struct((-F.lit(float(w)) / F.ln((bits + 0.5) / 2.0**56)).alias("v"), F.lit(s).alias("s")))
    best = F.sort_array(F.array(*score), asc=False)[0]["s"]
    for component, split in sorted((pins or {}).items()):
        best = F.when(F.col("component") == component, F.lit(split)).otherwise(best)
    return components.select("document_id", "component", best.alias("split"))


def split_report(assigned: DataFrame) -> DataFrame:
    """(split, documents, share, components, largest): what each split got, and the share of its largest component."""
    per = assigned.groupBy("split", "component").agg(F.count("*").alias("n"))
    got = per.groupBy("split").agg(F.sum("n").alias("documents"), F.count("*").alias("components"), F.max("n").alias("most"))
    total = got.agg(F.sum("documents").alias("total"))
    return got.crossJoin(F.broadcast(total)).select("split", "documents", (F.col("documents") / F.col("total")).alias("share"), "components", (F.col("most") / F.col("total")).alias("largest"))
