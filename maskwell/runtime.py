"""Session defaults and shared-storage staging.

Lineage is cut with tables written to the folder all executors share
(``spark.checkpoint.dir``). Only where a local session names none, as in tests,
a private folder is made and set; a cluster must name one.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "maskwell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a private one is set only in local sessions that name none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import atexit

        folder = tempfile.mkdtemp(prefix="maskwell-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        named = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stage(df: DataFrame, name: str = "t") -> tuple[DataFrame, str]:
    """Write ``df`` once to shared storage and read it back without lineage.

    Returns the re-read frame and its path. The table goes when it is dropped,
    when the ``scratch`` block around it ends, or with the driver's JVM.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/maskwell/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_staged(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no live frame reads any more."""
    p, fs = _path(spark, path)
    fs.delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drops what is staged inside when the block ends; results must be written or collected within it."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            drop_staged(spark, path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer partitions than there are; large inputs stay as they are read.

    Frames that are more than a scan stay too, as asking for their partitions would run them.
    """
    if df.isStreaming or "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
