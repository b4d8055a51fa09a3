from kinlink.plans import linkage


def test_limit_of_a_token_grows_with_the_pool(spark):
    """Names of frequent tokens alone: 210 records of 44,000 share one."""
    records = "entity_id string, name string, address string, country string"
    s1 = spark.createDataFrame([("S1-1", "common", "", "x"), ("S1-2", "often", "", "x"), ("S1-3", "common", "", "y")], records)
    name = "CASE WHEN id < 210 THEN 'common' WHEN id < 431 THEN 'often' ELSE concat('other', id) END"
    pool = spark.range(44000).selectExpr("concat('S2-', id) AS entity_id", f"{name} AS name", "'' AS address", "'x' AS country")
    got = linkage.simple_candidates(s1, pool).groupBy("s1_id").count().collect()
    assert [tuple(r) for r in got] == [("S1-1", 210)]  # 220 is the limit; 221 have the other
