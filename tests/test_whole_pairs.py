"""Operators on pairs do the whole job on tables that used to be too large."""

from pathlib import Path

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinlink.functions import features, fuzzy
from kinlink.operators import blocking, blocks, model
from kinlink.plans import linkage
from kinlink.plans.queries import QUERIES
from kinlink.sources import stage


def test_all_pairs_of_more_than_a_million(spark):
    queries, pool = (spark.range(n).selectExpr("concat('e', id) AS entity_id") for n in (3, 400_000))
    assert blocking.all_pairs(queries, pool).count() == 1_200_000


def test_link_shuffles_no_pairs(spark):
    """Records that all share a rare address: their pairs stay in a task, and the right ones come out."""
    n = 200
    name = "concat('alpha', id, ' beta', id, ' gamma', id)"
    s1 = spark.range(n).selectExpr("concat('S1-', id) AS entity_id", f"{name} AS name", "'7 lane' AS address", "'x' AS country")
    pool = spark.range(n).selectExpr("concat('S2-', id) AS entity_id", f"concat({name}, ' ltd') AS name", "'7 lane' AS address", "'x' AS country")
    links = linkage.simple_link(s1, pool)
    assert {(r.s1_id, r.cand_id) for r in links.collect()} == {(f"S1-{k}", f"S2-{k}") for k in range(n)}
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("FlatMapCoGroups")[0]  # nothing is joined to the pairs


def test_long_records_are_compared_as_sets(spark):
    words = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    kinds = "entity_id string, name string, address string, country string"
    s1 = spark.createDataFrame([("S1-1", words(0, 60), "", "x"), ("S1-2", "w1 w2", "", "x")], kinds)
    pool = spark.createDataFrame([("S2-1", words(30, 90), "", "x"), ("S2-2", "w2 w3", "", "x")], kinds)
    got = {(r.s1_id, r.cand_id): (r.nj, r.aj) for r in linkage.simple_candidates(s1, pool).collect()}
    assert got == {("S1-1", "S2-1"): (30 / 90, 1.0), ("S1-1", "S2-2"): (2 / 60, 1.0), ("S1-2", "S2-2"): (1 / 3, 1.0)}


def test_best_of_blocks_are_those_of_all_pairs(spark):
    rows = ["concat('word', id % 7, ' name', id % 5, ' word', id % 3) AS name", "concat(id % 4, '00 street ', 10000 + id % 6) AS address", "if(id % 2 = 0, 'x', 'y') AS country"]
    s1 = spark.range(40).selectExpr("concat('S1-', id) AS entity_id", *rows)
    pool = spark.range(90).selectExpr("concat('S2-', id) AS entity_id", *rows)
    summed = blocking.channel_pairs(s1, pool).groupBy("s1_id", "cand_id").agg(F.sum("score").alias("score"))
    want = {tuple(r) for r in blocking.ranked(summed, 4).select("s1_id", "cand_id", "score", "rank").collect()}
    assert {tuple(r) for r in blocking.multi_channel(s1, pool, 4, query_block=7, pool_block=11).collect()} == want and len(want) == 160


def test_reach_is_that_of_all_pairs(spark):
    name = "concat('common word', id % 7, ' name', id % 5, if(id % 9 = 0, ' rare', ''))"
    s1 = spark.range(70).selectExpr("concat('S1-', id) AS entity_id", f"if(id = 3, 'alone', {name}) AS name", "concat(id, ' lane') AS address", "if(id % 2 = 0, 'x', 'y') AS country")
    pool = spark.range(300).selectExpr("concat('S2-', id) AS entity_id", f"if(id % 3 = 0, concat('other', id), {name}) AS name", "concat(id, if(id % 4 = 0, ' lane', '')) AS address", "if(id % 2 = 0, 'x', 'y') AS country")
    check = F.crc32(F.col("cand_id").cast("binary"))
    pairs = blocking.country_tokens(s1, pool, hot=50).groupBy("s1_id").agg(F.count(F.lit(1)), F.min("cand_id"), F.max("cand_id"), F.sum(check))
    want = {tuple(r) for r in pairs.collect()}
    for blocks in ({}, {"query_block": 9, "pool_block": 70}):
        assert {tuple(r) for r in blocking.country_reach(s1, pool, check, **blocks).collect()} == want
    assert len(want) >= 69


def test_equal_records_are_one_class(spark):
    """Equal texts, more of them than candidates are wanted: one row of each class meets the pool."""
    s1 = spark.range(60).selectExpr("concat('S1-', id) AS entity_id", "'x' AS country", "concat('name', id % 3, ' common') AS name", "concat(id % 2, '00 lane') AS address")
    pool = s1.selectExpr("replace(entity_id, 'S1', 'S2') AS entity_id", "country", "name", "address")
    rows = blocking.tfidf_weights(s1, "combo")[0]
    assert rows.select("class").distinct().count() == 6 and rows.select("terms", "weights").distinct().count() == 6
    got = {}
    for r in blocking.tfidf_pairs(s1, pool, "combo", 4, query_block=2, pool_block=5).collect():
        got.setdefault(r.s1_id, []).append((r.rank, r.cand_id))
    same = {k: sorted(f"S2-{j}" for j in range(60) if j % 6 == k) for k in range(6)}
    assert all([c for _, c in sorted(got[f"S1-{i}"])] == same[i % 6][:4] for i in range(60))


def test_link_metrics_rank_no_pairs(spark, data):
    report = QUERIES["link_metrics"](spark, data)
    assert "Window" not in report._jdf.queryExecution().optimizedPlan().toString()
    assert report.first().n == spark.read.parquet(f"{data}/customer.parquet").count()


def test_staged_tables_leave_no_shuffles(spark, tmp_path):
    """The shuffles that made a staged table are deleted with its execution, not when the driver collects garbage."""
    def files():
        return {f.name for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for f in Path(d).rglob("shuffle_*.data")}

    before = files()
    table = stage.staged(spark.range(5000).groupBy((F.col("id") % 977).alias("k")).count(), "counts")
    assert not files() - before
    assert table.count() == 977


def test_words_joined_by_blanks_are_lists():
    """Records of a block are sent as strings; an empty one is no word."""
    import pyarrow as pa

    lists = [["a", "b"], [], ["b"]], [[], ["c", "a"]]
    as_lists = blocks._lists([pa.table({"t": pa.array(x, pa.list_(pa.string()))}) for x in lists], "t")
    as_words = blocks._lists([pa.table({"t": [" ".join(w) for w in x]}) for x in lists], "t")
    assert [[y.tolist() for y in x] for x in as_lists[:2]] == [[y.tolist() for y in x] for x in as_words[:2]] and as_words[2] == 3


def test_channel_ranks_shuffle_no_pairs(spark):
    """Ranks of all pairs, with ties across blocks of the pool, as by a window over the pairs; none is ranked or grouped."""
    rows = ["concat('word', id % 7, ' name', id % 5, ' word', id % 3) AS name", "concat(id % 4, '00 street ', 10000 + id % 6) AS address", "if(id % 2 = 0, 'x', 'y') AS country"]
    s1 = spark.range(40).selectExpr("concat('S1-', id) AS entity_id", *rows)
    pool = spark.range(90).selectExpr("concat('S2-', id) AS entity_id", *rows)
    order = Window.partitionBy("s1_id", "channel").orderBy(F.desc("score"), "cand_id")
    ranked = blocking.channel_pairs(s1, pool).withColumn("r", F.row_number().over(order) - 1)
    ranked = ranked.groupBy("s1_id", "cand_id").pivot("channel", ["name_tokens", "addr_tokens", "street_number", "postal"]).agg(F.min("r"))
    want = {tuple(r) for r in ranked.collect()}
    for size in ({}, {"query_block": 7, "pool_block": 11}):
        got = blocking.channel_ranks(s1, pool, **size)
        assert got.dtypes == ranked.dtypes and {tuple(r) for r in got.collect()} == want and got.count() == len(want) > 1000
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]
    assert not any(x in plan for x in ("Aggregate", "Window", "Join"))  # nothing is done to the pairs


def test_texts_of_candidates_shuffle_no_pairs(spark):
    """Pairs with their texts and labels as by joins; the texts meet the lists of candidates in a task."""
    rows = ["concat('name', id % 11) AS name", "if(id % 6 = 0, NULL, concat(id, ' lane')) AS address", "if(id % 2 = 0, 'x', 'y') AS country"]
    s1 = spark.range(30).selectExpr("concat('S1-', id) AS entity_id", *rows)
    pool = spark.range(80).selectExpr("concat('S2-', id) AS entity_id", *rows)
    pairs = s1.select(F.col("entity_id").alias("s1_id"), "country").join(pool.select(F.col("entity_id").alias("cand_id"), "country"), "country").where("crc32(concat(s1_id, cand_id)) % 5 < 2").drop("country")
    truth = pairs.where("crc32(cand_id) % 3 = 0").unionByName(pairs.limit(3))
    names = ["s1_id", "cand_id", "name1", "addr1", "name2", "addr2", "label"]
    want = {tuple(r) for r in model.labelled(linkage.pair_texts(pairs, s1, pool), truth).select(*names).collect()}
    for size in ({}, {"query_block": 4, "pool_block": 9}):
        got = linkage.labelled_texts(pairs, truth, s1, pool, **size).select(*names)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) > 400
    assert len({r[-1] for r in want}) == 2
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]


def test_channel_features_are_made_with_the_pairs(spark, data):
    """No expression is evaluated for a row once its task has written it: as columns, features cost more than the pairs."""
    found = QUERIES["features_channels"](spark, data)
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("FlatMapGroupsInArrow")


def test_channel_arrays_are_the_columns(spark):
    """Ranks with ties of the seventh digit (512 = 2 ** 9: 0.1953125), absent channels and none at all."""
    some = [-1, 0, 1, 28, 412, 924, 7]
    ranks = np.array(np.meshgrid(some, some, some, [-1, 0, 412])).reshape(4, -1)
    rows = spark.createDataFrame([tuple(None if x < 0 else x for x in r) for r in ranks.T.tolist()], "a int, b int, c int, d int")
    columns = features.channel_features(dict(zip(features.CHANNELS, map(F.col, "abcd"), strict=True)))
    want = rows.coalesce(1).select(*(F.round(v, 6).alias(k) for k, v in columns.items())).toPandas()
    got = features.channel_arrays(ranks, 6)
    assert list(got) == list(want.columns) and 0.195313 in got["ch1_rank"]
    for k, v in got.items():
        assert (v == want[k].to_numpy()).all(), k


def test_records_of_one_id_are_merged(spark):
    """Keys of rows that share an id count together, as they did when keys were rows."""
    kinds = "entity_id string, name string, address string, country string"
    s1 = spark.createDataFrame([("S1-1", "alpha beta", "", "x"), ("S1-1", "alpha", "", "x"), ("S1-2", "", "", "x")], kinds)
    pool = spark.createDataFrame([("S2-1", "alpha gamma", "", "x"), ("S2-1", "alpha", "", "x"), ("S2-2", "beta", "", "x")], kinds)
    sides = [{(r[0], tuple(sorted(zip(r.terms, r.weights, strict=True)))) for r in d.collect()} for d in blocking.channel_sides(s1, pool)]
    assert sides[0] == {("S1-1", (("core_name:alpha", 3.0), ("core_name:alpha beta", 3.0), ("name_tokens:alpha", 2.0), ("name_tokens:beta", 1.0)))}
    gamma = [(("core_name:alpha", 1.0), ("core_name:alpha gamma", 1.0), ("name_tokens:alpha", 2.0), ("name_tokens:gamma", 1.0))]
    assert sides[1] == {("S2-1", *gamma), ("S2-2", (("core_name:beta", 1.0), ("name_tokens:beta", 1.0)))}


def test_measures_of_arrays_are_those_of_pairs():
    """Empty, equal, long, accented and null-character texts too."""
    one = ["", "a", "abc lane", "crème brûlée", "x" * 64, "ab" * 40, "a\0b", "12 oak street 20037", "martha"]
    two = [*one, "marhta", "oak street 12", "y" * 70, "abc  lane", "brulee creme"]
    i, j = (x.ravel() for x in np.meshgrid(range(len(one)), range(len(two))))
    got = fuzzy.pair_measures(one, two, i, j, ["ratio", "jaro_winkler"])
    want = [fuzzy.similarities(one[a], two[b], ["ratio", "jaro_winkler"]) for a, b in zip(i, j, strict=True)]
    assert list(zip(*(g.tolist() for g in got), strict=True)) == want


def test_features_are_made_where_candidates_meet(spark):
    """Features, labels and folds as by columns over the pairs' texts, and none of these expressions is left for a pair."""
    rows = ["concat('name', id % 11, if(id % 7 = 0, repeat(' long word', 9), ' co')) AS name", "if(id % 6 = 0, NULL, concat(id, ' lane, ', 10000 + id % 4)) AS address", "if(id % 2 = 0, 'x', 'y') AS country"]
    s1 = spark.range(30).selectExpr("concat('S1-', id) AS entity_id", *rows)
    pool = spark.range(80).selectExpr("concat('S2-', id) AS entity_id", *rows)
    pairs = s1.select(F.col("entity_id").alias("s1_id"), "country").join(pool.select(F.col("entity_id").alias("cand_id"), "country"), "country").drop("country")
    truth = pairs.where("crc32(cand_id) % 3 = 0")
    names = blocks.ARRAYS
    columns = model.folds(features.featurize(linkage.labelled_texts(pairs, truth, s1, pool), names), 3).withColumn("_held", model.held())
    want = {tuple(r) for r in columns.select("s1_id", "cand_id", "label", "fold", "_held", *names).collect()}
    for size in ({}, {"query_block": 4, "pool_block": 9}):
        got = linkage.labelled_features(pairs, truth, s1, pool, names, **size)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) == 1200
    assert got._jdf.queryExecution().optimizedPlan().toString().startswith("FlatMapGroupsInArrow")


def test_trees_learn_from_groups_of_equal_bins(spark, monkeypatch):
    """A value of one row in a hundred has a bin, and the trees are fitted on the groups, whose weights are all rows'."""
    rows = spark.range(4000).selectExpr("concat('S1-', id) AS s1_id", "cast(id % 500 AS double) AS x", "cast(id % 100 = 0 AS double) AS y", "cast(id % 100 = 0 OR id % 500 > 400 AS double) AS label")
    assert model.bins(rows, ["x", "y"]).getSplitsArray()[1] == [float("-inf"), 0.5, float("inf")]
    made, write = [], model.staged
    monkeypatch.setattr(model, "staged", lambda d, name: made.append(write(d, name)) or made[-1])
    fitted = model.fit(rows, ["x", "y"])
    weight = model.class_weight(rows).first()["weight"]
    n, w = made[0].agg(F.sum("_n"), F.sum("_w")).first()
    assert made[0].count() < 250 and n == 4000 and abs(w - 4000 - (weight - 1) * rows.where("label = 1").count()) < 1e-6
    wrong = model.predict(fitted, rows).where("(p_gbt > 0.5) <> (label = 1)").count()
    assert wrong <= 128  # the border crosses one bin of x, 16 values of 8 rows


def test_calibration_of_groups_is_that_of_rows(spark):
    rows = spark.range(900).selectExpr("cast(id % 37 AS double) / 37 AS p", "cast((id * 7) % 37 > 20 OR id % 37 > 30 AS double) AS label")
    from pyspark.ml.regression import IsotonicRegression

    want = IsotonicRegression(featuresCol="p", labelCol="label").fit(rows)
    got = model.calibrator(rows)
    assert np.allclose(got.boundaries.toArray(), want.boundaries.toArray()) and np.allclose(got.predictions.toArray(), want.predictions.toArray())
