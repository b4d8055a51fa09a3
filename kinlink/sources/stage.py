"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether shuffle files go when the execution that wrote them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; only on one machine, where that
    is unset, in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_kinlink_stage", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark._kinlink_stage = "file://" + tempfile.mkdtemp(prefix="kinlink-stage-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: computed once, however often it is used,
    and safe when executors are lost.  The shuffles that made it go at once."""
    spark = df.sparkSession
    path, before = fresh(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
