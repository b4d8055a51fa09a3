"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the
    cluster names one, else a temporary folder of the one machine that runs
    all; on a cluster the setting must be there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(spark, "_kinlink_dir", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="kinlink-")
            spark._kinlink_dir = base
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Whether shuffle files go when the execution that wrote them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: The share of the driver's largest heap above which its garbage is collected once a table is written.
HEAP_SHARE = 0.4


def tidied(spark: SparkSession) -> None:
    """Collect the driver's garbage, plans of finished queries for the most part,
    where the heap has grown: else it grows to its limit before it is collected."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > HEAP_SHARE * heap.maxMemory():
        spark._jvm.System.gc()


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage
    and survives the loss of executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    staged(spark).append(path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # the shuffles that made the table aren't needed once it is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    tidied(spark)
    return spark.read.schema(df.schema).parquet(path)


def staged(spark: SparkSession) -> list[str]:
    """Paths of the tables that ``materialised`` has written and nobody has discarded."""
    if not hasattr(spark, "_kinlink_staged"):
        spark._kinlink_staged = []
    return spark._kinlink_staged


def roots(df: DataFrame) -> list[str]:
    """The paths that the files which ``df`` reads were listed from."""
    leaves, found = df._jdf.queryExecution().optimizedPlan().collectLeaves(), []
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            found += leaf.relation().location().rootPaths().mkString("\n").split("\n")
    return found


def discard(spark: SparkSession, paths: list[str], keep: DataFrame) -> None:
    """Delete staged tables, but those that ``keep`` reads."""
    names = [r.rstrip("/").rsplit("/", 1)[-1] for r in roots(keep)]
    for path in [p for p in paths if p.rsplit("/", 1)[-1] not in names]:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
        if path in staged(spark):
            staged(spark).remove(path)


def appended(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The columns of ``batch`` that aren't named like a new one, then the new ones."""
    keep = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in new]
    return pa.RecordBatch.from_arrays([c for _, c in keep] + list(new.values()), names=[n for n, _ in keep] + list(new))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def utf8_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column, a single aggregate; sizes partitions only."""
    row = df.agg(F.sum(F.octet_length(F.col(column)).cast("long")).alias("n")).first()
    return int(row["n"] or 0)


def quiet_tokenizer(path: str):
    """A tokenizers.Tokenizer on one thread that reads special strings as text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return tok
