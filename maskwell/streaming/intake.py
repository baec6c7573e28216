"""Streaming intake: text units in, contact spans out, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.operators.spans import regex_spans


def text_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    schema = "page_id bigint, document_id string, text string, delivered_at timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def span_stream(units: DataFrame, pattern: str, *keep: str) -> DataFrame:
    """Stateless: the batch scan operator works on a stream as it is."""
    return regex_spans(units, "text", pattern, *keep)


def deliveries(units: DataFrame, late: str = "1 day", every: str = "1 hour") -> DataFrame:
    """Documents delivered per window; rows later than ``late`` are dropped by the watermark."""
    return units.withWatermark("delivered_at", late).groupBy(F.window("delivered_at", every)).agg(F.approx_count_distinct("document_id").alias("documents"), F.count("*").alias("pages"))
