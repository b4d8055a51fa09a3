import __spark_entry__ as driver
from pyspark.sql import functions as F

from kinlink.plans import linkage
from kinlink.plans.fixtures import BIZ, frames
from kinlink.streaming.incremental import link_stream


def test_entry(spark):
    assert driver.entry(spark).count() == 1
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_stream_links_each_batch_once(spark, data, tmp_path):
    s1, pool = frames(spark, data, BIZ, "s1", "pool")
    s1 = s1.select("entity_id", "name", "address", "country")
    source, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    for part in (0, 1):
        s1.where(F.pmod(F.xxhash64("entity_id"), F.lit(2)) == part).coalesce(1).write.mode("append").parquet(source)
        link_stream(spark, source, "entity_id string, name string, address string, country string", pool, out, state).awaitTermination()
    got = spark.read.parquet(out)
    assert got.select("batch").distinct().count() == 2
    batch = {(r.s1_id, r.cand_id) for r in linkage.simple_link(s1, pool).collect()}
    assert batch <= {(r.s1_id, r.cand_id) for r in got.collect()}
