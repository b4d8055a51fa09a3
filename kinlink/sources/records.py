"""Readers, writers and codecs of record tables.

All columns are strings at rest; a table has entity_id, business_name,
business_address and country.  Lists are comma-joined strings outside and
arrays inside.  The spine is one row for every query record, so that records
without candidates or matches stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

RECORD = StructType([StructField(c, StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
LISTS = StructType([StructField(c, StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
SCORES = "source1_entity_id string, candidate_entity_id string, probability double"
SCORE_KEEP = 20


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A TSV of records, all columns strings, no quoting; the id's prefix is its source."""
    return spark.read.csv(path, sep="\t", header=True, schema=RECORD, quote="").withColumn("source", F.substring("entity_id", 1, 2))


def filled(records: DataFrame) -> DataFrame:
    """Missing names and addresses as empty text."""
    return records.withColumns({c: F.coalesce(c, F.lit("")) for c in ("business_name", "business_address")})


def pool(*sources: DataFrame) -> DataFrame:
    """All candidate sources; of a repeated entity_id the last source counts."""
    rows = None
    for k, s in enumerate(sources):
        s = s.withColumn("_order", F.lit(k))
        rows = s if rows is None else rows.unionByName(s)
    others = [c for c in rows.columns if c not in ("entity_id", "_order")]
    best = rows.groupBy("entity_id").agg(F.max(F.struct("_order", *others)).alias("r"))
    return best.select("entity_id", *(F.col("r")[c].alias(c) for c in others))


def parse_list(column: Column) -> Column:
    """A comma list as an array; null and empty are the empty array."""
    return F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """s1_id, cand_id and rank (from 0) of a list file; empty lists give no row."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=LISTS, quote="")
    return explode_lists(rows, "source1_entity_id", "matched_entity_ids")


def explode_lists(rows: DataFrame, key: str, lists: str) -> DataFrame:
    return rows.select(F.col(key).alias("s1_id"), F.posexplode(parse_list(F.col(lists))).alias("rank", "cand_id"))


def lists_of(pairs: DataFrame, spine: DataFrame, order: list[str] | None = None, name: str = "matched_entity_ids") -> DataFrame:
    """One row for every s1_id of ``spine``: its candidates joined, by
    ``order`` columns and then id; none gives the empty text."""
    keys = [F.col(c) for c in order or []]
    at = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), F.col("cand_id").alias("id"))
    joined = pairs.groupBy("s1_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(at)), lambda x: x["id"]), ",").alias(name))
    return spine.select("s1_id").distinct().join(joined, "s1_id", "left").select("s1_id", F.coalesce(name, F.lit("")).alias(name))


def write_lists(lists: DataFrame, path: str) -> None:
    lists.withColumnRenamed("s1_id", "source1_entity_id").write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="", quote="")


def score_rows(scored: DataFrame, keep: int = SCORE_KEEP) -> DataFrame:
    """The ``keep`` best candidates of each record, six decimals."""
    from ..operators.decide import ranked

    rows = ranked(scored).where(F.col("rank") <= keep)
    return rows.select(F.col("s1_id").alias("source1_entity_id"), F.col("cand_id").alias("candidate_entity_id"), F.round("p", 6).alias("probability"))


def write_partition(rows: DataFrame, path: str, by: str = "country") -> None:
    """Replace only the partitions that ``rows`` has, so a run can resume."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_scores(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """s1_id, cand_id, p of a score table."""
    rows = spark.read.schema(SCORES).csv(path, sep="\t", header=True) if fmt == "csv" else spark.read.parquet(path)
    return rows.select(F.col("source1_entity_id").alias("s1_id"), F.col("candidate_entity_id").alias("cand_id"), F.col("probability").alias("p"))


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``; where there is none it is made by
    ``make()`` and written first."""
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def census(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows and bytes of text of each file."""
    out = None
    for name, path in paths.items():
        lines = spark.read.text(path)
        row = lines.agg((F.count(F.lit(1)) - 1).alias("rows"), F.sum(F.octet_length("value") + 1).alias("bytes")).select(F.lit(name).alias("name"), "rows", "bytes")
        out = row if out is None else out.unionByName(row)
    return out
