"""Checks of the output contract as tables of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.records import parse_list

PREFIXES = ["S2-", "S3-"]


def header(spark: SparkSession, path: str, expected: list[str]) -> list[str]:
    """V1: problems of a file's first line; empty if it is right."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return ["empty file"]
    line = first[0]["value"]
    if line.split("\t") == expected:
        return []
    return ["comma instead of tab" if line.split(",") == expected else f"header {line!r}"]


def malformed(lines: DataFrame) -> DataFrame:
    """V2: lines (column value) without a tab."""
    return lines.where(~F.contains("value", F.lit("\t")))


def violations(lists: DataFrame, spine: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """V3-V7 of ``lists`` (s1_id, ids): check, s1_id, detail."""
    rows = lists.select("s1_id", parse_list(F.col("ids")).alias("a"))
    each = rows.select("s1_id", F.explode("a").alias("id"))
    right = F.lit(False)
    for p in PREFIXES:
        right = right | F.startswith("id", F.lit(p))
    row = lambda d, check, detail: d.select(F.lit(check).alias("check"), "s1_id", detail.alias("detail"))
    parts = [
        row(rows.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "duplicate_row", F.col("n").cast("string")),
        row(rows.where(F.size("a") != F.size(F.array_distinct("a"))), "repeated_id", (F.size("a") - F.size(F.array_distinct("a"))).cast("string")),
        row(each.where(F.startswith("id", F.lit("S1-"))), "self_match", F.col("id")),
        row(each.where(~F.startswith("id", F.lit("S1-")) & ~right), "wrong_prefix", F.col("id")),
        row(spine.select("s1_id").join(rows.select("s1_id"), "s1_id", "left_anti"), "missing", F.lit("")),
        row(rows.join(spine.select("s1_id"), "s1_id", "left_anti"), "extra", F.lit("")),
    ]
    if known is not None:
        parts.append(row(each.join(known.select(F.col("cand_id").alias("id")).distinct(), "id", "left_anti"), "unknown_id", F.col("id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def outside_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """V8: s1_id and the matches (ids) that aren't among its candidates."""
    rows = matches.select("s1_id", parse_list(F.col("ids")).alias("m")).join(candidates.select("s1_id", parse_list(F.col("ids")).alias("c")), "s1_id", "left")
    gone = F.array_except("m", F.coalesce("c", F.array().cast("array<string>")))
    return rows.where(F.size(gone) > 0).select("s1_id", F.array_join(F.array_sort(gone), ",").alias("ids"))


def cross_country(pairs: DataFrame, spine: DataFrame, pool: DataFrame) -> DataFrame:
    """V9: per country pairs, records with a match, and pairs that leave the country."""
    rows = pairs.join(spine.select("s1_id", "country"), "s1_id").join(pool.select(F.col("entity_id").alias("cand_id"), F.col("country").alias("theirs")), "cand_id", "left")
    leak = F.count_if(F.col("theirs").isNotNull() & (F.col("theirs") != F.col("country")))
    return rows.groupBy("country").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("s1_id").alias("records"), leak.alias("leaks"))


def examples(found: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` offenders (a report)."""
    return found.orderBy("s1_id").limit(k)
