"""Macro F0.5 and its breakdowns.

A record with no truth and no prediction scores 1; with exactly one of them 0.
Metrics run over the spine, so records without candidates count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def f_half(tp: Column, n_true: Column, n_pred: Column) -> Column:
    """5 TP / (T + 4 P), with the rules for empty sides."""
    return F.when((n_true == 0) & (n_pred == 0), 1.0).when((n_true == 0) | (n_pred == 0), 0.0).otherwise(5.0 * tp / (n_true + 4 * n_pred))


def with_scores(rows: DataFrame) -> DataFrame:
    """Append precision, recall and f to tp, n_pred, n_true."""
    tp, p, t = F.col("tp"), F.col("n_pred"), F.col("n_true")
    share = lambda n: F.when((t == 0) & (p == 0), 1.0).when(n == 0, 0.0).otherwise(tp / n)
    return rows.withColumns({"precision": share(p), "recall": share(t), "f": f_half(tp, t, p)})


def entity_report(pred: DataFrame, truth: DataFrame, spine: DataFrame) -> DataFrame:
    """A1, A3: per record its counts, precision, recall, f and whether it is a singleton."""
    p, t = (d.select("s1_id", "cand_id").distinct() for d in (pred, truth))
    both = p.withColumn("p", F.lit(1)).join(t.withColumn("t", F.lit(1)), ["s1_id", "cand_id"], "full_outer")
    per = both.groupBy("s1_id").agg(F.count(F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), 1)).alias("tp"), F.count("p").alias("n_pred"), F.count("t").alias("n_true"))
    rows = spine.select("s1_id", F.coalesce("country", F.lit("unknown")).alias("country")).join(per, "s1_id", "left").na.fill(0, ["tp", "n_pred", "n_true"])
    return with_scores(rows).withColumn("is_singleton", F.col("n_true") == 0)


def breakdown(report: DataFrame) -> DataFrame:
    """Macro means, singleton share, mean kept and empty predictions in one row."""
    mean = lambda c: F.avg(c).alias(f"macro_{c}")
    return report.agg(F.count(F.lit(1)).alias("n"), mean("precision"), mean("recall"), mean("f"), F.avg(F.col("is_singleton").cast("double")).alias("singleton_rate"), F.avg("n_pred").alias("mean_kept"), F.count_if(F.col("n_pred") == 0).alias("empty"))


def by_country(report: DataFrame) -> DataFrame:
    """A4: per country the means, singletons and how many of those are right."""
    single = F.col("is_singleton")
    right = F.avg(F.when(single, (F.col("n_pred") == 0).cast("double")))
    return report.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f").alias("f"), F.count_if(single).alias("singletons"), F.coalesce(right, F.lit(0.0)).alias("singleton_accuracy"))


def by_source(pred: DataFrame, truth: DataFrame, spine: DataFrame, sources: list[str]) -> DataFrame:
    """A5: every record is scored against each source by itself."""
    out = None
    for s in sources:
        only = lambda d: d.where(F.startswith("cand_id", F.lit(s)))  # noqa: B023, E731
        part = entity_report(only(pred), only(truth), spine).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f").alias("f")).select(F.lit(f"S1-{s.rstrip('-')}").alias("pair"), "precision", "recall", "f")
        out = part if out is None else out.unionByName(part)
    return out


def error_patterns(report: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` records of each kind of error, ties by id (a report, so limited)."""
    fp, fn = F.col("n_pred") - F.col("tp"), F.col("n_true") - F.col("tp")
    kinds = {
        "false_positives": (fp > 0, F.desc("fp")),
        "false_negatives": (fn > 0, F.desc("fn")),
        "low_precision": (F.col("precision") < 0.5, F.asc("precision")),
        "low_recall": (F.col("recall") < 0.5, F.asc("recall")),
        "worst_f": (F.lit(True), F.asc("f")),
        "anomaly": ((fp / (F.col("tp") + 1) > 2) | (fn / (F.col("tp") + 1) > 2), F.desc(fp + fn)),
    }
    rows, out = report.withColumns({"fp": fp, "fn": fn}), None
    for kind, (test, order) in kinds.items():
        part = rows.where(test).orderBy(order, "s1_id").limit(top).select(F.lit(kind).alias("kind"), "s1_id", "fp", "fn", "precision", "recall", "f")
        out = part if out is None else out.unionByName(part)
    return out


def evaluate(pred: DataFrame, truth: DataFrame, spine: DataFrame, sources: list[str]) -> dict[str, DataFrame]:
    """H7: every report of a prediction by name."""
    report = entity_report(pred, truth, spine)
    return {"overall": breakdown(report), "country": by_country(report), "source": by_source(pred, truth, spine, sources), "errors": error_patterns(report), "micro": micro(report)}


def oracle_ceiling(candidates: DataFrame, truth: DataFrame, spine: DataFrame) -> DataFrame:
    """The breakdown of a perfect classifier on the candidates."""
    from .exclusive import intersect

    return breakdown(entity_report(intersect(truth, candidates), truth, spine))


def loss_attribution(candidates: DataFrame, kept: DataFrame, truth: DataFrame) -> DataFrame:
    """A10: true pairs lost before the candidates, and lost by the rule (which counts the former too)."""
    mark = lambda d, name: d.select("s1_id", "cand_id").distinct().withColumn(name, F.lit(1))
    rows = truth.join(mark(candidates, "c"), ["s1_id", "cand_id"], "left").join(mark(kept, "k"), ["s1_id", "cand_id"], "left")
    return rows.agg(F.count(F.lit(1)).alias("true_pairs"), F.count_if(F.col("c").isNull()).alias("lost_blocking"), F.count_if(F.col("k").isNull()).alias("lost_rule"))


def element_quantiles(kept: DataFrame, spine: DataFrame) -> DataFrame:
    """The element at position int(n * p) of the sorted counts, from a histogram."""
    per = spine.select("s1_id").join(kept.groupBy("s1_id").agg(F.count(F.lit(1)).alias("k")), "s1_id", "left").select(F.coalesce("k", F.lit(0)).alias("k"))
    hist = per.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    rows = hist.withColumns({"upto": F.sum("n").over(Window.orderBy("k")), "total": F.sum("n").over(Window.partitionBy())})
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("total") * p), F.col("k")))
    return rows.agg(at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.max("k").alias("max"))


def micro(report: DataFrame) -> DataFrame:
    """Micro precision, recall and F0.5."""
    sums = report.agg(F.sum("tp").alias("tp"), F.sum("n_pred").alias("p"), F.sum("n_true").alias("t"))
    pr, rc = F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(0.0), F.when(F.col("t") > 0, F.col("tp") / F.col("t")).otherwise(0.0)
    rows = sums.select("tp", "p", "t", pr.alias("precision"), rc.alias("recall"))
    total = 0.25 * F.col("precision") + F.col("recall")
    return rows.withColumn("f", F.when(total > 0, 1.25 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def profile(records: DataFrame) -> DataFrame:
    """Per country rows, missing names and addresses, length percentiles."""
    missing = lambda c: 100 * F.avg((F.trim(F.coalesce(c, F.lit(""))) == "").cast("double"))
    q = lambda c, p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY length(coalesce({c}, '')))").cast("long")
    return records.groupBy("country").agg(F.count(F.lit(1)).alias("n"), missing("name").alias("missing_name_pct"), missing("address").alias("missing_address_pct"), q("name", 0.5).alias("name_p50"), q("name", 0.99).alias("name_p99"), q("address", 0.5).alias("address_p50"))


def top_words(records: DataFrame, k: int = 12) -> DataFrame:
    """The k most frequent words of the names (a top-k report)."""
    words = records.select(F.explode(F.filter(F.split(F.lower(F.coalesce("name", F.lit(""))), r"\s+"), lambda w: w != "")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(k)


def degrees(truth: DataFrame, spine: DataFrame) -> DataFrame:
    """Records by number of true matches."""
    per = spine.select("s1_id").join(truth.groupBy("s1_id").agg(F.count_distinct("cand_id").alias("d")), "s1_id", "left")
    return per.groupBy(F.coalesce("d", F.lit(0)).alias("degree")).agg(F.count(F.lit(1)).alias("n"))
