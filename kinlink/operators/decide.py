"""Decision rules over scored candidates (s1_id, cand_id, p and more columns).

All rules look at a record's candidates by (-p, cand_id) and keep a prefix, so
one window per record serves every rule and every point of a grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CAP, EPS, UNSEEN_EXTRA = 11, 1e-6, 0.10


def ranked(scored: DataFrame) -> DataFrame:
    """Each pair once (its greatest p), with rank, max_p and size."""
    rest = [c for c in scored.columns if c not in ("s1_id", "cand_id", "p")]
    once = scored.groupBy("s1_id", "cand_id").agg(F.max("p").alias("p"), *(F.max(c).alias(c) for c in rest))
    of = Window.partitionBy("s1_id")
    return once.withColumns({"rank": F.row_number().over(of.orderBy(F.desc("p"), "cand_id")), "max_p": F.max("p").over(of), "size": F.count(F.lit(1)).over(of)})


def threshold(rows: DataFrame, tau: float, margin: float = 0.0) -> DataFrame:
    """P >= tau; nothing if the best is below margin."""
    return rows.where((F.col("p") >= tau) & (F.col("max_p") >= margin))


def relative(rows: DataFrame, tau: float, alpha: float, margin: float = 0.0) -> DataFrame:
    """P >= max(tau, alpha * best); nothing if the best is below margin."""
    return rows.where((F.col("p") >= F.greatest(F.lit(tau), alpha * F.col("max_p"))) & (F.col("max_p") >= margin))


def shifted(p: Column, shift: float) -> Column:
    """H1: the probability moved by ``shift`` on the logit scale."""
    q = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return q if shift == 0 else 1 / (1 + F.exp(-(F.log(q / (1 - q)) + shift)))


def expected(rows: DataFrame, shift: float = 0.0, tau: float = 0.0, cap: int | None = None, strict: bool = True) -> DataFrame:
    """The prefix of greatest expected F0.5, against the chance that
    nothing matches; of equal prefixes the shortest.  cap comes first; not
    strict: a tie with nothing is nothing too."""
    of = Window.partitionBy("s1_id")
    upto = of.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.where(F.col("rank") <= cap) if cap else rows
    rows = rows.withColumn("_q", shifted(F.col("p"), shift))
    rows = rows.withColumns({"_s": F.sum("_q").over(upto), "_t": F.sum("_q").over(of), "_none": F.exp(F.sum(F.log(1 - F.col("_q"))).over(of))})
    rows = rows.withColumn("_e", 1.25 * F.col("_s") / (0.25 * F.col("_t") + F.col("rank")))
    rows = rows.withColumn("_best", F.max(F.struct("_e", (-F.col("rank")).alias("k"))).over(of))
    # Both variants keep only what beats nothing; the strict one compares E_k > E_0.
    beats = F.col("_best._e") > F.col("_none") if strict else ~(F.col("_none") >= F.col("_best._e"))
    kept = rows.where(beats & (F.col("rank") <= -F.col("_best.k")) & (F.col("p") >= tau))
    return kept.drop("_q", "_s", "_t", "_none", "_e", "_best")


def inference(rows: DataFrame, tau: float, alpha: float, margin: float, seen: list[str], cap: int = CAP, extra: float = UNSEEN_EXTRA) -> DataFrame:
    """The relative rule with a higher floor for unseen countries, capped."""
    floor = F.greatest(F.lit(tau), alpha * F.col("max_p")) + F.when(F.col("country").isin(seen), 0.0).otherwise(extra)
    return rows.where((F.col("p") >= floor) & (F.col("max_p") >= margin) & (F.col("rank") <= cap))


def flat(rows: DataFrame, tau: float, cap: int = CAP) -> DataFrame:
    """A fixed threshold and cap."""
    return rows.where((F.col("p") >= tau) & (F.col("rank") <= cap))


def flat_exclusive(rows: DataFrame, tau: float, cap: int = CAP) -> DataFrame:
    """A fixed threshold and cap, then one record for each target."""
    from .exclusive import by_confidence

    return by_confidence(flat(rows, tau, cap).select("s1_id", "cand_id", "p"))


def entity_scores(kept: DataFrame, truth: DataFrame, spine: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A1: per record of the spine (and grid point of ``keys``): tp, n_pred, n_true, precision, recall, f."""
    from .metrics import with_scores

    by = ["s1_id", *(keys or [])]
    marked = kept.join(truth.select("s1_id", "cand_id").distinct().withColumn("_t", F.lit(1)), ["s1_id", "cand_id"], "left")
    got = marked.groupBy(*by).agg(F.count("_t").alias("tp"), F.count(F.lit(1)).alias("n_pred"))
    want = truth.groupBy("s1_id").agg(F.count_distinct("cand_id").alias("n_true"))
    rows = spine.join(got, by, "left").join(want, "s1_id", "left").na.fill(0, ["tp", "n_pred", "n_true"])
    return with_scores(rows)


def grid(spark: SparkSession, **axes: list[float]) -> DataFrame:
    """All points of the axes, numbered in order."""
    from itertools import product

    names = list(axes)
    rows = [(i, *map(float, p)) for i, p in enumerate(product(*axes.values()))]
    return spark.createDataFrame(rows, ", ".join(["point int", *(f"{n} double" for n in names)]))


def search_relative(rows: DataFrame, truth: DataFrame, spine: DataFrame, points: DataFrame) -> DataFrame:
    """Macro F0.5 of every point (tau, margin, alpha; alpha 0 is the
    threshold rule), best first, ties by number.

    A rule keeps a prefix, so per record and point only its length is found,
    and the hits below it come from one running sum; the grid is broadcast."""
    of = Window.partitionBy("s1_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.join(truth.select("s1_id", "cand_id").distinct().withColumn("_t", F.lit(1)), ["s1_id", "cand_id"], "left")
    cum = marked.withColumn("_c", F.count("_t").over(of))
    pts = F.broadcast(points)
    floor = F.greatest(F.col("tau"), F.col("alpha") * F.col("max_p"))
    kept = cum.join(pts, (F.col("p") >= floor) & (F.col("max_p") >= F.col("margin")))
    got = kept.groupBy("s1_id", "point").agg(F.max("rank").alias("n_pred"), F.max("_c").alias("tp"))
    return _macro(got, truth, spine, points)


def _macro(got: DataFrame, truth: DataFrame, spine: DataFrame, points: DataFrame) -> DataFrame:
    """Macro F0.5 of every point, from (s1_id, point, n_pred, tp) of the records that keep something."""
    want = truth.groupBy("s1_id").agg(F.count_distinct("cand_id").alias("n_true"))
    # Records that keep nothing score 1 without truth, else 0: counted, not listed.
    scored = got.join(want, "s1_id", "left").na.fill(0, ["n_true"])
    f = F.when(F.col("n_true") == 0, 0.0).otherwise(5.0 * F.col("tp") / (F.col("n_true") + 4 * F.col("n_pred")))
    sums = scored.groupBy("point").agg(F.sum(f).alias("f"), F.count_if(F.col("n_true") == 0).alias("wrong"))
    totals = spine.join(want, "s1_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_true").isNull()).alias("single"))
    out = points.join(sums, "point", "left").na.fill(0, ["f", "wrong"]).join(totals)
    return out.select(*points.columns, F.round((F.col("f") + F.col("single") - F.col("wrong")) / F.col("n"), 9).alias("macro_f"))


def search_expected(rows: DataFrame, truth: DataFrame, spine: DataFrame, points: DataFrame) -> DataFrame:
    """Macro F0.5 of the expected rule at every point (shift, tau).

    The prefix of a shift is found once for all its thresholds; a row is
    repeated for each shift of the grid, and for each threshold it passes."""
    of = Window.partitionBy("shift", "s1_id")
    upto = of.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.join(truth.select("s1_id", "cand_id").distinct().withColumn("_t", F.lit(1)), ["s1_id", "cand_id"], "left")
    q = F.least(F.greatest("p", F.lit(EPS)), F.lit(1 - EPS))
    each = marked.join(F.broadcast(points.select("shift").distinct()))
    each = each.withColumn("_q", F.when(F.col("shift") == 0, q).otherwise(1 / (1 + F.exp(-(F.log(q / (1 - q)) + F.col("shift"))))))
    each = each.withColumns({"_s": F.sum("_q").over(upto), "_all": F.sum("_q").over(of), "_none": F.exp(F.sum(F.log(1 - F.col("_q"))).over(of))})
    each = each.withColumn("_e", 1.25 * F.col("_s") / (0.25 * F.col("_all") + F.col("rank")))
    each = each.withColumn("_best", F.max(F.struct("_e", (-F.col("rank")).alias("k"))).over(of))
    kept = each.where((F.col("_best._e") > F.col("_none")) & (F.col("rank") <= -F.col("_best.k")))
    hits = kept.join(F.broadcast(points.withColumnRenamed("shift", "_shift")), (F.col("shift") == F.col("_shift")) & (F.col("p") >= F.col("tau")))
    return _macro(hits.groupBy("s1_id", "point").agg(F.count(F.lit(1)).alias("n_pred"), F.count("_t").alias("tp")), truth, spine, points)


def search_all(rows: DataFrame, truth: DataFrame, spine: DataFrame, tau: list[float], margin: list[float], alpha: list[float], shift: list[float], expected_tau: list[float]) -> DataFrame:
    """The three rules' grids: point (in the order threshold, relative,
    expected), rule, tau, margin, alpha, shift and macro_f; ``best_point``
    takes the first of the best."""
    spark = rows.sparkSession
    flat = grid(spark, tau=tau, alpha=[0.0], margin=margin)
    bent = grid(spark, tau=tau, alpha=[a for a in alpha if a], margin=margin)
    moved = grid(spark, shift=shift, tau=expected_tau)
    n = [len(tau) * len(margin), len(tau) * len([a for a in alpha if a]) * len(margin)]
    none = F.lit(None).cast("double")
    named = lambda d, rule, before, **gone: d.withColumns({"rule": F.lit(rule), "point": F.col("point") + before, **{k: none for k in gone}}).select("point", "rule", "tau", *(none.alias(c) if c in gone else F.col(c) for c in ("margin", "alpha", "shift")), "macro_f")
    one = named(search_relative(rows, truth, spine, flat), "threshold", 0, alpha=1, shift=1)
    two = named(search_relative(rows, truth, spine, bent), "relative", n[0], shift=1)
    return one.unionByName(two).unionByName(named(search_expected(rows, truth, spine, moved), "expected", sum(n), margin=1, alpha=1))


def incumbent(new: DataFrame, old: DataFrame) -> DataFrame:
    """Two searches on the same rows: the best of each, and which wins (a tie: the new one)."""
    best = lambda d, name: best_point(d).select(F.struct(*d.columns).alias(name))
    both = best(new, "new").join(best(old, "old"))
    return both.select("new", "old", F.when(F.col("new.macro_f") >= F.col("old.macro_f"), "new").otherwise("old").alias("winner"), (F.col("new.macro_f") - F.col("old.macro_f")).alias("margin"))


def micro_threshold(rows: DataFrame, taus: list[float]) -> DataFrame:
    """Micro F0.5 over labelled pairs (p, label) for p > tau, by tau:
    one pass, as sums of each interval between thresholds."""
    points = grid(rows.sparkSession, tau=taus)
    hits = rows.join(F.broadcast(points), F.col("p") > F.col("tau")).groupBy("point").agg(F.sum("label").alias("tp"), F.count(F.lit(1)).alias("n"))
    out = points.join(hits, "point", "left").na.fill(0, ["tp", "n"]).join(rows.agg(F.sum("label").alias("t")))
    out = out.withColumns({"precision": F.when(F.col("n") > 0, F.col("tp") / F.col("n")).otherwise(0.0), "recall": F.when(F.col("t") > 0, F.col("tp") / F.col("t")).otherwise(0.0)})
    total = 0.25 * F.col("precision") + F.col("recall")
    return out.select("point", "tau", "precision", "recall", F.when(total > 0, 1.25 * F.col("precision") * F.col("recall") / total).otherwise(0.0).alias("f"))


def best_point(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("macro_f"), "point").limit(1)


def target_threshold(rows: DataFrame, spine: DataFrame, mean: float) -> DataFrame:
    """Per country the greatest score that keeps ``mean`` candidates per
    record of the spine: the ceil(mean * records)-th largest, found from a
    histogram of scores, so no country's scores meet in one task."""
    sizes = spine.groupBy("country").agg(F.ceil(F.count(F.lit(1)) * mean).alias("want"))
    hist = rows.groupBy("country", "p").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("country").orderBy(F.desc("p")))
    reached = hist.withColumn("upto", upto).join(sizes, "country")
    return reached.groupBy("country").agg(F.coalesce(F.max(F.when(F.col("upto") >= F.col("want"), F.col("p"))), F.min("p")).alias("tau"), F.first("want").alias("want"))


def count_distribution(kept: DataFrame, spine: DataFrame, cap: int = CAP) -> DataFrame:
    """Mean, quantiles of the number kept, share empty and at the cap."""
    per = spine.select("s1_id").join(kept.groupBy("s1_id").agg(F.count(F.lit(1)).alias("k")), "s1_id", "left").select(F.coalesce("k", F.lit(0)).alias("k"))
    q = lambda x: F.expr(f"percentile_disc({x}) WITHIN GROUP (ORDER BY k)").cast("long")
    share = lambda test: 100 * F.avg(test.cast("double"))
    return per.agg(F.count(F.lit(1)).alias("n"), share(F.col("k") == 0).alias("empty_pct"), F.avg("k").alias("mean"), q(0.5).alias("p50"), q(0.9).alias("p90"), q(0.99).alias("p99"), F.max("k").cast("long").alias("max"), share(F.col("k") >= cap).alias("at_cap_pct"))


def prior_penalty(dist: DataFrame, mean: float = 3.46, p90: float = 6.0) -> DataFrame:
    """Distance of a distribution from the training prior."""
    pen = 4 * F.abs(F.col("mean") - mean) / mean + 2 * F.abs(F.col("p90") - p90) / p90 + 0.5 * F.col("at_cap_pct") / 10
    return dist.withColumn("penalty", pen)


def count_histogram(kept: DataFrame, spine: DataFrame) -> DataFrame:
    """Records by number kept."""
    per = spine.select("s1_id").join(kept.groupBy("s1_id").agg(F.count(F.lit(1)).alias("k")), "s1_id", "left")
    return per.groupBy(F.coalesce("k", F.lit(0)).alias("k")).agg(F.count(F.lit(1)).alias("n"))


def prior_sweep(rows: DataFrame, spine: DataFrame, taus: list[float], alphas: list[float], seen: list[str], margin: float = 0.01, cap: int = CAP, extra: float = UNSEEN_EXTRA) -> DataFrame:
    """The distribution and penalty of rule D10 at every point, from one
    histogram of the number kept for each; the least penalty is nearest to the prior."""
    points = grid(rows.sparkSession, tau=taus, alpha=alphas)
    floor = F.greatest(F.col("tau"), F.col("alpha") * F.col("max_p")) + F.when(F.col("country").isin(seen), 0.0).otherwise(extra)
    kept = rows.where((F.col("max_p") >= margin) & (F.col("rank") <= cap)).join(F.broadcast(points), F.col("p") >= floor)
    some = kept.groupBy("point", "s1_id").agg(F.count(F.lit(1)).alias("k")).groupBy("point", "k").agg(F.count(F.lit(1)).alias("n"))
    sizes = points.select("point").join(spine.agg(F.count(F.lit(1)).alias("n")))
    none = sizes.join(some.groupBy("point").agg(F.sum("n").alias("used")), "point", "left").select("point", F.lit(0).cast("long").alias("k"), (F.col("n") - F.coalesce("used", F.lit(0))).alias("n"))
    hist = some.unionByName(none).where("n > 0")
    of = Window.partitionBy("point")
    hist = hist.withColumns({"share": F.sum("n").over(of.orderBy("k")) / F.sum("n").over(of)})
    q = lambda x: F.min(F.when(F.col("share") >= x, F.col("k")))
    part = lambda test: 100 * F.sum(F.when(test, F.col("n")).otherwise(0)) / F.sum("n")
    dist = hist.groupBy("point").agg(F.sum("n").alias("n"), part(F.col("k") == 0).alias("empty_pct"), (F.sum(F.col("k") * F.col("n")) / F.sum("n")).alias("mean"), q(0.5).alias("p50"), q(0.9).alias("p90"), q(0.99).alias("p99"), part(F.col("k") == cap).alias("at_cap_pct"))
    return prior_penalty(points.join(dist, "point"))
