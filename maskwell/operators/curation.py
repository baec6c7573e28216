"""Dataset keeping: registration, verification, sampling, identifiers, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last delivery of each record; ties fall to the later columns of ``order``."""
    w = Window.partitionBy(*key).orderBy(*[o.desc_nulls_last() for o in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def hash_changes(frozen: DataFrame, current: DataFrame, ident: str, digest: str) -> DataFrame:
    """(ident, change): missing, added or changed records between two states."""
    a = frozen.select(F.col(ident), F.col(digest).alias("_a"), F.lit(True).alias("_ha"))
    b = current.select(F.col(ident), F.col(digest).alias("_b"), F.lit(True).alias("_hb"))
    both = a.join(b, ident, "full_outer")
    change = F.when(F.col("_hb").isNull(), "missing").when(F.col("_ha").isNull(), "added").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(ident, change.alias("change")).filter("change IS NOT NULL")


def opaque_ids(df: DataFrame, scope: str, kind: str, ident: str) -> DataFrame:
    """Adds ``opaque_id``: scope/kind_NNN by the order of ids within scope and kind; more digits from the 1,000th on."""
    w = Window.partitionBy(scope, kind).orderBy(ident)
    return df.withColumn("opaque_id", F.concat(F.col(scope), F.lit("/"), F.lower(F.col(kind)), F.lit("_"), F.format_string("%03d", F.dense_rank().over(w))))


def stratified_top(df: DataFrame, stratum: str, n: int, seed: str, *ident: str) -> DataFrame:
    """``n`` rows of each stratum by hash rank: a repeatable draw, a sampling operator."""
    rank = F.sha2(F.concat_ws("|", F.lit(seed), *ident), 256)
    w = Window.partitionBy(stratum).orderBy(rank, *ident)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def largest_remainder(counts: DataFrame, ident: str, weight: str, seats: int) -> DataFrame:
    """(ident, seats): proportional whole numbers that add up to ``seats``."""
    total = counts.agg(F.sum(weight).alias("_t"))
    q = counts.crossJoin(F.broadcast(total)).withColumn("_q", F.lit(float(seats)) * F.col(weight) / F.col("_t"))
    q = q.withColumn("_f", F.floor("_q"))
    used = q.agg(F.sum("_f").alias("_u"))
    w = Window.orderBy((F.col("_q") - F.col("_f")).desc(), F.col(ident))
    q = q.crossJoin(F.broadcast(used)).withColumn("_n", F.row_number().over(w))
    return q.select(ident, (F.col("_f") + (F.col("_n") <= F.lit(seats) - F.col("_u")).cast("long")).cast("long").alias("seats"))


def sample_size(n: Column, rate: float, least: int) -> Column:
    """All rows of a small set, else the rate of it, never fewer than ``least``."""
    return F.when(n <= least, n).otherwise(F.greatest(F.lit(least), F.ceil(n * rate))).cast("long")


def span_issues(mentions: DataFrame, units: DataFrame) -> DataFrame:
    """(mention_id, issue): one row per failed check of an annotation."""
    key = ["document_id", "page", "text_source_id"]
    u = units.select(*key, F.length("text").alias("_len"), F.col("text").alias("_unit")).dropDuplicates(key)
    m = mentions.select("mention_id", *key, "start_off", "end_off", "text").distinct()
    both = m.join(u, key, "left")
    placed = F.col("start_off").isNotNull()
    checks = F.array_compact(
        F.array(
            F.when(placed & (F.col("start_off") >= F.col("end_off")), "empty_span"),
            F.when(placed & F.col("_len").isNull(), "unknown_unit"),
            F.when(placed & (F.col("end_off") > F.col("_len")), "out_of_range"),
            F.when(placed & (F.substring(F.col("_unit"), F.col("start_off") + 1, F.col("end_off") - F.col("start_off")) != F.col("text")), "text_differs"),
        )
    )
    return both.select("mention_id", F.explode(checks).alias("issue"))


def record_issues(mentions: DataFrame) -> DataFrame:
    """(mention_id, issue) of the record itself: no entity, a person without a role, deliveries that name different entities."""
    nobody = mentions.select("mention_id", "canonical_id").distinct().filter(F.col("canonical_id").isNull() | (F.trim("canonical_id") == ""))
    plain = mentions.select("mention_id", "entity_type", "role").distinct().filter("entity_type = 'PERSON' AND role IS NULL")
    differ = mentions.groupBy("mention_id").agg(F.countDistinct(F.coalesce("canonical_id", F.lit(""))).alias("n")).filter("n > 1")
    parts = [(nobody, "no_entity"), (plain, "no_role"), (differ, "deliveries_differ")]
    return reduce(DataFrame.union, [df.select("mention_id", F.lit(issue).alias("issue")) for df, issue in parts])


def linked_groups(mentions: DataFrame) -> DataFrame:
    """(matter_id, entity_type, link_key, mention ids): the plain linker.

    People meet on surname and first initial; a single word joins the one group
    of its matter that has it as surname, if only one has. Everything else
    meets on its normalised text.
    """
    t = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    plain = F.regexp_replace(t, r"^(mr|mrs|ms|miss|dr|prof)\.? ", "")
    w = F.when(plain.contains(","), F.concat_ws(" ", F.trim(F.element_at(F.split(plain, ","), 2)), F.trim(F.element_at(F.split(plain, ","), 1)))).otherwise(plain)
    words = F.filter(F.split(w, " "), lambda x: x != "")
    m = mentions.filter("text IS NOT NULL AND matter_id IS NOT NULL").select("matter_id", "entity_type", "entity_id", t.alias("t"), words.alias("w")).filter(F.size("w") > 0)
    person = F.col("entity_type") == "PERSON"
    m = m.withColumn("sur", F.element_at("w", -1)).withColumn("ini", F.substring(F.get("w", F.lit(0)), 1, 1)).withColumn("k", F.size("w"))
    full = m.filter(person & (F.col("k") >= 2)).withColumn("link_key", F.concat_ws("|", "sur", "ini"))
    owner = full.groupBy("matter_id", F.col("sur").alias("s")).agg(F.min("link_key").alias("lo"), F.max("link_key").alias("hi")).filter("lo = hi").select("matter_id", "s", F.col("lo").alias("one"))
    single = m.filter(person & (F.col("k") == 1)).join(owner.withColumnRenamed("s", "sur"), ["matter_id", "sur"], "left").withColumn("link_key", F.coalesce("one", "sur"))
    rest = m.filter(~person).withColumn("link_key", F.col("t"))
    cols = ["matter_id", "entity_type", "entity_id", "link_key"]
    return full.select(*cols).union(single.select(*cols)).union(rest.select(*cols)).distinct()


def renumbered(mentions: DataFrame) -> DataFrame:
    """(mention_id, new_id): document/m_NNN by page, field, place and type; more digits from the 1,000th on."""
    w = Window.partitionBy("document_id").orderBy(F.coalesce("page", F.lit(-1)), F.coalesce("field", F.lit("")), "start_off", "end_off", "entity_type", "mention_id")
    return mentions.select("mention_id", F.concat(F.col("document_id"), F.lit("/m_"), F.format_string("%03d", F.row_number().over(w))).alias("new_id"))


def dense_positions(df: DataFrame, *order: str, out: str = "r") -> DataFrame:
    """``df`` with its place from 1 in the whole order, without one task for all rows: range partitions, their sizes, places inside."""
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row a partition.
    before = sizes.join(sizes.select(F.col("_part").alias("_q"), F.col("_n").alias("_m")), F.col("_q") < F.col("_part"), "left").groupBy("_part").agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_part").orderBy(*order)
    return parts.withColumn("_place", F.row_number().over(w)).join(F.broadcast(before), "_part").withColumn(out, (F.col("_before") + F.col("_place")).cast("long")).drop("_part", "_place", "_before")


def registered(files: DataFrame, name: str, ident: str, digest: str) -> DataFrame:
    """(name, ident, registered_id, hashes): names in order, one row each, with how many contents came under it."""
    from maskwell.runtime import stage

    one, _ = stage(files.groupBy(name).agg(F.min(ident).alias(ident), F.countDistinct(digest).alias("hashes")), "names")
    return dense_positions(one, name, ident).select(name, ident, F.concat(F.lit("doc_"), F.format_string("%03d", F.col("r"))).alias("registered_id"), "hashes")
