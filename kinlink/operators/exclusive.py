"""One query record for each target, and set operations on match lists.

A query record has no capacity, so a greedy pass by descending score is the
best claimer of each target: one aggregation by target, combined before the
shuffle.  Every tie-break is explicit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.fuzzy import sorted_ratio

DEFAULT_CONFIDENCE, CAP = 0.5, 11


def _winner(claims: DataFrame, *order: Column) -> DataFrame:
    """Per target the claim that sorts first."""
    rest = [c for c in claims.columns if c != "cand_id"]
    best = claims.groupBy("cand_id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("w"))
    return best.select(F.col("w.s1_id").alias("s1_id"), "cand_id", *(F.col("w")[c].alias(c) for c in rest if c != "s1_id"))


def by_confidence(claims: DataFrame, default: float = DEFAULT_CONFIDENCE) -> DataFrame:
    """The claimer of greatest p (missing: ``default``), ties to the least s1_id."""
    return _winner(claims, -F.coalesce(F.col("p"), F.lit(default)), F.col("s1_id"))


def by_score(claims: DataFrame) -> DataFrame:
    """As X1, but a claim without score loses to any with one; ties by list position."""
    return _winner(claims, F.col("p").isNull(), -F.col("p"), F.col("position"), F.col("s1_id"))


def by_rank(claims: DataFrame) -> DataFrame:
    """The claimer that ranks the target highest, ties by line, then s1_id."""
    return _winner(claims, F.col("rank"), F.col("line"), F.col("s1_id"))


def violations(claims: DataFrame) -> DataFrame:
    """Targets with several claimers: cand_id, n and the sorted claimers."""
    return claims.groupBy("cand_id").agg(F.count_distinct("s1_id").alias("n"), F.array_join(F.array_sort(F.collect_set("s1_id")), ",").alias("claimers")).where(F.col("n") > 1)


def conflict_stats(claims: DataFrame) -> DataFrame:
    """H6: claims, targets, targets in conflict and claims that lose, in one row."""
    per = claims.groupBy("cand_id").agg(F.count_distinct("s1_id").alias("n"))
    return per.agg(F.sum("n").alias("claims"), F.count(F.lit(1)).alias("targets"), F.count_if(F.col("n") > 1).alias("conflicts"), F.sum(F.col("n") - 1).alias("lost"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of ``a`` whose pair ``b`` has."""
    return a.join(b.select("s1_id", "cand_id").distinct(), ["s1_id", "cand_id"], "left_semi")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of ``a`` whose pair ``b`` doesn't have."""
    return a.join(b.select("s1_id", "cand_id").distinct(), ["s1_id", "cand_id"], "left_anti")


def replace_country(base: DataFrame, scored: DataFrame, country: str, tau: float = 0.95) -> DataFrame:
    """X11: the matches of one country taken from ``scored`` at p >= tau."""
    new = scored.where((F.col("country") == country) & (F.col("p") >= tau))
    return base.where(F.col("country") != country).select("s1_id", "cand_id", "country").unionByName(new.select("s1_id", "cand_id", "country"))


def hybrid(base: DataFrame, other: DataFrame, cap: int = CAP) -> DataFrame:
    """``base`` with the new pairs of ``other`` up to ``cap`` for a record, by id."""
    new = subtract(other, base).select("s1_id", "cand_id").distinct()
    both = base.select("s1_id", "cand_id", F.lit(0).alias("added")).distinct().unionByName(new.withColumn("added", F.lit(1)))
    order = Window.partitionBy("s1_id").orderBy("added", "cand_id")
    return both.withColumn("k", F.row_number().over(order)).where((F.col("added") == 0) | (F.col("k") <= cap)).drop("k")


def prune_distractors(pairs: DataFrame, least: float = 0.25) -> DataFrame:
    """Without pairs whose raw names (name1, name2) are far apart, unless
    one is Indic or an acronym of the other."""
    a, b = F.lower(F.coalesce("name1", F.lit(""))), F.lower(F.coalesce("name2", F.lit("")))
    spared = text.is_indic(a) | text.is_indic(b) | text.acronym_match(a, b) | text.acronym_match(b, a)
    return pairs.where(spared | (sorted_ratio(a, b) >= least))


def capped_additions(base: DataFrame, extra: DataFrame, most: int = 6) -> DataFrame:
    """Additions (s1_id, cand_id, position) of unclaimed targets, each
    target once by position, while a record has fewer than ``most`` matches."""
    free = extra.join(base.select("cand_id").distinct(), "cand_id", "left_anti")
    once = _winner(free, F.col("position"), F.col("s1_id"))
    have = base.groupBy("s1_id").agg(F.count_distinct("cand_id").alias("have"))
    order = Window.partitionBy("s1_id").orderBy("position", "cand_id")
    rows = once.join(have, "s1_id", "left").withColumn("k", F.row_number().over(order))
    return rows.where(F.coalesce("have", F.lit(0)) + F.col("k") <= most).select("s1_id", "cand_id", "position")


def assemble(matches: DataFrame, cap: int = CAP) -> DataFrame:
    """The first ``cap`` distinct candidates of each list (rank order)."""
    once = matches.groupBy("s1_id", "cand_id").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("s1_id").orderBy("rank", "cand_id")
    return once.withColumn("k", F.row_number().over(order)).where(F.col("k") <= cap).drop("k")


def collisions(matches: DataFrame) -> DataFrame:
    """Targets, and the matches beyond the first of each, in one row."""
    per = matches.groupBy("cand_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("targets"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("collisions"))


def sync_candidates(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """The candidates with every match among them."""
    return candidates.select("s1_id", "cand_id").unionByName(matches.select("s1_id", "cand_id")).distinct()


def kept_or_submitted(decided: DataFrame, submitted: DataFrame, scored_countries: DataFrame) -> DataFrame:
    """The decided pairs, and for countries without scores the submitted ones."""
    rest = submitted.join(scored_countries.select("country").distinct(), "country", "left_anti")
    return decided.select("s1_id", "cand_id", "country").unionByName(rest.select("s1_id", "cand_id", "country"))
