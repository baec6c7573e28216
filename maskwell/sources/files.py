"""File scans and sinks with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TSV = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height")]
    + [T.StructField("conf", T.DoubleType()), T.StructField("text", T.StringType())]
)
DECISION = T.StructType([T.StructField(n, T.StringType()) for n in ("item_id", "decision", "reason", "payload", "reviewer", "time")])


def recognised_words(spark: SparkSession, path: str, dpi: int, block_base: int = 0) -> DataFrame:
    """Words of recogniser TSV files: word rows only, boxes in points, confidence < 0 as null."""
    rows = spark.read.csv(path, sep="\t", quote="", header=True, schema=TSV).filter("level = 5")
    k = 72.0 / dpi
    box = F.struct((F.col("left") * k).alias("x0"), (F.col("top") * k).alias("y0"), ((F.col("left") + F.col("width")) * k).alias("x1"), ((F.col("top") + F.col("height")) * k).alias("y1"))
    return rows.select(
        F.input_file_name().alias("file"), F.col("page_num").alias("page"), (F.lit(block_base) + F.col("block_num") * 100 + F.col("par_num")).alias("block"), F.col("line_num").alias("line"),
        "text", box.alias("bbox"), F.when(F.col("conf") >= 0, F.col("conf")).alias("conf"),
    )


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """Append-only decision log, one JSON object a line; malformed lines fail."""
    return spark.read.schema(DECISION).option("mode", "FAILFAST").json(path)


def registered_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size_bytes) of files that begin like a PDF."""
    files = spark.read.format("binaryFile").load(path)
    return files.filter(F.substring("content", 1, 5) == F.lit(b"%PDF-")).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def exported(spans: DataFrame, key: list[str]) -> DataFrame:
    """(key..., body): one canonical JSON document per key, spans in total order."""
    cols = [c for c in spans.columns if c not in key]
    items = F.array_sort(F.collect_list(F.struct(*cols)))
    return spans.groupBy(*key).agg(F.to_json(F.struct(items.alias("spans"))).alias("body"))
