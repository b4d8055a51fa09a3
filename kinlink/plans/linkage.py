"""The whole linkage: normalise, block, score, decide, claim, measure."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.features import featurize, jaccard, number_set, token_set
from ..operators import blocking, exclusive, metrics, model
from ..operators.blocks import ARRAYS, dealt, features_of_lists, streamed, texts_of_lists, token_pairs
from ..sources.stage import staged


#: Records of a block where a task returns few of the pairs that it compares.
LINK_BLOCKS = {"query_block": 100_000, "pool_block": 200_000}


def simple_candidates(s1: DataFrame, pool: DataFrame, keep: Callable | None = None, **blocks: int) -> DataFrame:
    """B13 with B8: pairs that share a country and a token that at most
    max(200, 0.5 % of the country's pool) records have, with token similarities;
    those that keep(nj, aj) says, arrays in a task.  Tokens are dropped by count
    before the join, and blocks of both sides are compared as arrays, so that
    no pair is shuffled.  Every block is sent to those it meets, its tokens
    joined to one string, which is a third of an array of them."""
    prepared = lambda d: d.select("entity_id", "country", text.simple_tokens(F.col("name")).alias("nt"), text.simple_tokens(F.col("address")).alias("at"))
    a, b = prepared(s1), prepared(pool)
    keys = lambda d: d.select("entity_id", "country", F.explode(F.array_union("nt", "at")).alias("token"))
    rare = keys(b).groupBy("country", "token").agg(F.count(F.lit(1)).alias("n"))
    rare = staged(rare.join(blocking.most_frequent(pool), "country").where(F.col("n") <= F.col("most")).select("country", "token"), "rare-tokens")

    def side(d: DataFrame, name: str) -> DataFrame:
        own = keys(d).join(rare, ["country", "token"], "left_semi").groupBy("entity_id", "country").agg(F.collect_list("token").alias("keys"))
        joined = lambda *names: [F.array_join(c, " ").alias(c) for c in names]
        return staged(d.join(own, ["entity_id", "country"]).select(F.col("entity_id").alias(name), "country", *joined("nt", "at", "keys")), "simple")

    left, right = side(a, "s1_id"), side(b, "cand_id")
    return dealt(left, right, "country", token_pairs(keep), "s1_id string, cand_id string, country string, nj double, aj double", **blocks)


def simple_link(s1: DataFrame, pool: DataFrame, tau: float = 0.5) -> DataFrame:
    """The matches (s1_id, cand_id, p) of a scorer with fixed weights, one record
    for each target.  A pair below the threshold claims nothing, so it leaves no task."""
    weights, bias = {"nj": 8.0, "aj": 4.0}, -5.0
    least = math.log(tau / (1 - tau)) if 1e-4 < tau < 0.9999 else -math.inf  # p is rounded: beyond, all pairs are kept for it

    def near(nj, aj):
        return weights["nj"] * nj + weights["aj"] * aj + bias >= least - 1e-3

    pairs = simple_candidates(s1, pool, near, **LINK_BLOCKS).withColumn("p", F.round(model.closed_form(weights, bias), 9))
    return exclusive.by_confidence(pairs.where(F.col("p") >= tau).select("s1_id", "cand_id", "p"))


def normalised(records: DataFrame) -> DataFrame:
    """Normalised texts, staged: every channel reads them again.  Records are
    dealt first, since few files or a small join before would leave cores idle."""
    rows = records.select("entity_id", "country", "name", "address").repartition("entity_id").select("entity_id", "country", text.normalize_name(F.col("name")).alias("name"), text.normalize_address(F.col("address")).alias("address"))
    return staged(rows, "normalised")


def pair_texts(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """``pairs`` with the normalised texts of both sides; unknown ids drop out."""
    side = lambda d, key, k: d.select(F.col("entity_id").alias(key), F.col("name").alias(f"name{k}"), F.col("address").alias(f"addr{k}"))
    return pairs.join(side(s1, "s1_id", 1), "s1_id").join(side(pool, "cand_id", 2), "cand_id")


#: Records of a block whose texts meet lists of candidates.
TEXT_BLOCKS = {"query_block": 60_000, "pool_block": 1_000_000}


def _labelled(pairs: DataFrame, truth: DataFrame, s1: DataFrame, pool: DataFrame, meet: Callable, kinds: str, query_block: int, pool_block: int) -> DataFrame:
    """What ``meet`` makes of blocks of records with their lists of candidates
    and label (M4) and blocks of the pool; other columns of both go along."""
    lists = pairs.groupBy("s1_id").agg(F.collect_list("cand_id").alias("cands"))
    marks = truth.groupBy("s1_id").agg(F.collect_set("cand_id").alias("true"))
    label = lambda c: F.coalesce(F.array_contains("true", c), F.lit(False)).cast("double")
    rows = s1.withColumnRenamed("entity_id", "s1_id").join(lists, "s1_id").join(marks, "s1_id", "left")
    own_columns = [c for c in s1.columns if c != "entity_id"]
    rows = staged(rows.select("s1_id", *own_columns, F.transform("cands", lambda c: F.struct(c.alias("c"), label(c).alias("label"))).alias("cands")), "candidate-lists")
    parts = max(1, -(-pool.count() // pool_block))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    own = lambda d: d.withColumn("cands", F.filter("cands", lambda x: part(x["c"]) == F.col("_p")))
    sides = pool.withColumnRenamed("entity_id", "cand_id").withColumn("_p", part("cand_id"))
    return streamed(rows, sides, "country", meet, kinds, query_block, own)


def labelled_texts(pairs: DataFrame, truth: DataFrame, s1: DataFrame, pool: DataFrame, query_block: int = TEXT_BLOCKS["query_block"], pool_block: int = TEXT_BLOCKS["pool_block"]) -> DataFrame:
    """``pairs`` of one country with label (M4) and the normalised texts of both
    sides.  A record's candidates are one list until a task holds its block and
    the pool's, so that no pair is shuffled with texts."""
    kinds = "s1_id string, name1 string, addr1 string, cand_id string, name2 string, addr2 string, label double"
    s1, pool = (d.select("entity_id", "country", "name", "address") for d in (s1, pool))
    return _labelled(pairs, truth, s1, pool, texts_of_lists(), kinds, query_block, pool_block)


def labelled_features(pairs: DataFrame, truth: DataFrame, s1: DataFrame, pool: DataFrame, names: list[str], n: int = 3, query_block: int = TEXT_BLOCKS["query_block"], pool_block: int = TEXT_BLOCKS["pool_block"]) -> DataFrame:
    """``pairs`` with label, the features ``names``, fold (M2) and whether the
    record is held for early stopping.  Features that arrays can make come from
    the task in which records and candidates meet; what they need of one
    record is computed once a record."""
    if not set(names) <= set(ARRAYS):
        rows = featurize(labelled_texts(pairs, truth, s1, pool, query_block, pool_block), names)
        return model.folds(rows, n).withColumn("_held", model.held()).select("s1_id", "cand_id", "label", "fold", "_held", *names)
    name, address = F.coalesce("name", F.lit("")), F.coalesce("address", F.lit(""))
    parts = {"tokens": F.array_join(token_set(name, address), " "), "numbers": F.array_join(number_set(address), " "), "postal": text.postal_code(address)}
    s1, pool = (d.select("entity_id", "country", "name", "address", *(v.alias(k) for k, v in parts.items())) for d in (s1, pool))
    of = s1.withColumnRenamed("entity_id", "s1_id")
    of = model.folds(of, n).withColumn("_held", model.held()).withColumnRenamed("s1_id", "entity_id")
    kinds = "s1_id string, cand_id string, label double, fold long, _held boolean, " + ", ".join(f"{c} double" for c in names)
    return _labelled(pairs, truth, of, pool, features_of_lists(names), kinds, query_block, pool_block)


def train(s1: DataFrame, pool: DataFrame, truth: DataFrame, names: list[str], n: int = 3) -> DataFrame:
    """Blocked, featurised and labelled pairs with out-of-fold probabilities.
    The features ``names`` are computed once and staged: every model of every
    fold reads them."""
    a, b = normalised(s1), normalised(pool)
    rows = labelled_features(blocking.multi_channel(a, b), truth, a, b, names, n)
    return model.out_of_fold(staged(rows, "features"), names, n=n)


def rescore(submitted: DataFrame, s1: DataFrame, pool: DataFrame, models: dict, names: list[str]) -> DataFrame:
    """A probability for the matched pairs of ``submitted`` alone; nothing is added."""
    pairs = submitted.select("s1_id", "cand_id").distinct()
    rows = featurize(pair_texts(pairs, normalised(s1), normalised(pool)), names)
    return model.predict(models, staged(rows.select("s1_id", "cand_id", *names), "rescored")).select("s1_id", "cand_id", F.round("p", 6).alias("p"))


def measure(matches: DataFrame, truth: DataFrame, spine: DataFrame) -> DataFrame:
    return metrics.breakdown(metrics.entity_report(matches, truth, spine))
