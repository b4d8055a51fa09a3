"""Linkage tables derived from the test tables, as SQL that Spark and DuckDB
both run: the same text makes a query's input and its oracle's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["customer", "part", "nation", "region", "embeddings"]

#: Records of businesses: s1 from customers; copies of two thirds of them in
#: S2 and of four fifths in S3, with other suffixes, word orders and a lost
#: character; parts without a customer as decoys; the truth by construction.
BIZ = """
np AS (SELECT count(*) AS n FROM {part}),
nc AS (SELECT count(*) AS n FROM {customer}),
base AS (
  SELECT c_custkey AS k, p_name AS pn, p_brand AS pb, n_name AS nn, r_name AS country,
    (c_custkey * 7) % 900 + 1 AS num, (c_custkey * 37) % 90000 + 10000 AS code,
    CASE c_custkey % 7 WHEN 0 THEN 'Corporation' WHEN 1 THEN 'Private Limited' WHEN 2 THEN 'Incorporated' WHEN 3 THEN 'Limited' WHEN 4 THEN 'LLC' WHEN 5 THEN 'Company' ELSE '& Sons' END AS form,
    CASE c_custkey % 7 WHEN 0 THEN 'Corp' WHEN 1 THEN 'Pvt Ltd' WHEN 2 THEN 'Inc' WHEN 3 THEN 'Ltd' WHEN 4 THEN 'LLC' WHEN 5 THEN 'Co' ELSE 'and Sons' END AS short_form,
    CASE c_custkey % 5 WHEN 0 THEN 'Oak' WHEN 1 THEN 'Maple' WHEN 2 THEN 'Station' WHEN 3 THEN 'Hill Gate' ELSE 'Lake' END AS street,
    CASE c_custkey % 3 WHEN 0 THEN 'Street' WHEN 1 THEN 'Road' ELSE 'Avenue' END AS way,
    CASE c_custkey % 3 WHEN 0 THEN 'St' WHEN 1 THEN 'Rd' ELSE 'Ave' END AS short_way
  FROM {customer} CROSS JOIN np JOIN {part} ON p_partkey = c_custkey % np.n
  JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey),
s1 AS (SELECT concat('S1-', k) AS entity_id, concat(pn, ' ', pb, ' ', form) AS name, concat(num, ' ', street, ' ', way, ', ', nn, ' ', code) AS address, country, k FROM base),
pool AS (
  SELECT concat('S2-', k) AS entity_id, CASE WHEN k % 4 = 0 THEN concat(pb, ' ', pn, ' ', short_form) ELSE concat(pn, ' ', pb, ' ', short_form) END AS name,
    CASE WHEN k % 30 = 1 THEN '' ELSE concat(num, ' ', street, ' ', way, ' ', code) END AS address, country FROM base WHERE k % 3 <> 0
  UNION ALL
  SELECT concat('S3-', base.k), concat(substr(s1.name, 1, CAST(base.k % length(s1.name) AS INT)), substr(s1.name, CAST(base.k % length(s1.name) AS INT) + 2)),
    concat(num, ' ', street, ' ', short_way, ', ', nn, ' ', code), base.country FROM base JOIN s1 ON base.k = s1.k WHERE base.k % 5 <> 0
  UNION ALL
  SELECT concat('S2-d', p_partkey), concat(p_name, ' ', p_brand), concat(p_partkey % 97 + 1, ' Harbour Road'), r_name
  FROM {part} CROSS JOIN nc JOIN {region} ON r_regionkey = p_partkey % 5 WHERE p_partkey >= nc.n),
truth AS (
  SELECT concat('S1-', k) AS s1_id, concat('S2-', k) AS cand_id FROM base WHERE k % 3 <> 0
  UNION ALL SELECT concat('S1-', k), concat('S3-', k) FROM base WHERE k % 5 <> 0),
spine AS (SELECT entity_id AS s1_id, country FROM s1)
"""

#: Scored candidates by integer arithmetic on keys, with ties, targets that
#: several records claim, records without candidates, and truth without candidates.
PROB = """
spine AS (
  SELECT concat('S1-', c_custkey) AS s1_id, r_name AS country, c_custkey AS k
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey),
sz AS (SELECT count(*) AS n FROM {customer}),
slots AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12)) AS v(j)),
raw AS (SELECT s1_id, country, k, j, (k * 3 + j * 5) % sz.n AS c FROM spine CROSS JOIN sz JOIN slots ON j < k % 14),
prob AS (
  SELECT DISTINCT s1_id, country, concat(CASE WHEN c % 2 = 0 THEN 'S2-' ELSE 'S3-' END, c) AS cand_id,
    CAST((k * 7919 + c * 104729) % 1009 AS DOUBLE) / 1009 AS p FROM raw),
truth AS (
  SELECT DISTINCT s1_id, concat(CASE WHEN c % 2 = 0 THEN 'S2-' ELSE 'S3-' END, c) AS cand_id FROM raw WHERE (k + c) % 4 = 0
  UNION ALL SELECT s1_id, concat('S2-x', k) FROM spine WHERE k % 11 = 0)
"""

ORACLE_NAMES = {t: t for t in TABLES}


def frames(spark: SparkSession, sf_dir: str, ctes: str, *names: str) -> list[DataFrame]:
    """The named CTEs as DataFrames."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in ctes}
    return [spark.sql(f"WITH {ctes} SELECT * FROM {n}", **used) for n in names]


def oracle(ctes: str, body: str) -> str:
    """DuckDB SQL: the CTEs, then ``body`` (more CTEs, or a SELECT)."""
    return f"WITH {ctes.format(**ORACLE_NAMES)}{body}"
