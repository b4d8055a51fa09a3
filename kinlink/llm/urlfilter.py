"""URL filters by a temporal list join (operator 1), DataFrame functions only.

Dated list entries (list_name, kind, pattern, action, dated_at) become
validity intervals: of a pattern's entries each holds from its date to the
next one's, and those that add are kept.  Every capture is evaluated against
the entries active at its fetch time: an equi-join on host, domain and path
keys with the interval as a range, so that each key meets at most one interval
of a list.  kind is ``host`` (the very host), ``domain`` (the host and all
below it) or ``prefix`` (host and leading path segments).

Captures are joined once for each distinct (url, time).  A host with a third
of all captures is a skewed side of the join, which Spark splits; the side of
the intervals holds one row for each entry.

Defined results: a null or malformed url has a null host and no match; on one
date an addition outweighs a removal; an entry dated at the fetch time is
active; entries with a null field never match; repeated captures each get
their row; empty tables give empty tables; further columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"


def host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dots; null if there is none."""
    authority = F.regexp_extract(url, SCHEME + r"([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""), r"[.]+$", "")
    return F.when(bare != "", F.lower(bare))


def segments(url: Column) -> Column:
    """The path's segments that aren't empty."""
    path = F.regexp_extract(url, SCHEME + r"[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def intervals(entries: DataFrame) -> DataFrame:
    """(key, depth, list_name, since, until): when each pattern is on its list."""
    first = F.lower(F.regexp_extract("pattern", "^([^/]*)", 1))
    path = F.filter(F.split(F.regexp_replace("pattern", "^[^/]*", ""), "/"), lambda s: s != "")
    key = F.when(F.col("kind") == "host", F.concat(F.lit("h:"), F.lower("pattern"))).when(F.col("kind") == "domain", F.concat(F.lit("d:"), F.lower("pattern"))).when(F.col("kind") == "prefix", F.concat(F.lit("p:"), F.array_join(F.concat(F.array(first), path), "/")))
    depth = F.when(F.col("kind") == "prefix", F.size(path)).otherwise(0)
    rows = entries.select(key.alias("key"), depth.alias("depth"), "list_name", F.col("dated_at").alias("since"), (F.col("action") == "add").alias("on")).na.drop()
    dated = rows.groupBy("key", "depth", "list_name", "since").agg(F.bool_or("on").alias("on"))
    until = F.lead("since").over(Window.partitionBy("key", "depth", "list_name").orderBy("since"))
    return dated.withColumn("until", until).where("on").drop("on")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, blocked, n_matches, lists and since (the earliest date of
    an active entry) of ``captures`` (page_id, url, fetched_at)."""
    held = intervals(entries)
    # Lengths of the patterns, in labels and segments: keys of other lengths, such
    # as the last label that most hosts share, match nothing and aren't made.
    kind, length = F.substring("key", 1, 1), F.when(F.col("key").startswith("d:"), F.size(F.split("key", "[.]"))).otherwise(F.col("depth"))
    sizes = {k: sorted(v) for k, v in held.groupBy(kind.alias("kind")).agg(F.collect_set(length).alias("n")).collect()}
    depth = max(sizes.get("p", [0]))
    seen = captures.select("url", "fetched_at").where(F.col("url").isNotNull()).distinct()
    parts = seen.withColumns({"host": host(F.col("url")), "segs": F.slice(segments(F.col("url")), 1, max(1, depth)) if depth else F.array().cast("array<string>")}).where(F.col("host").isNotNull())
    labels = F.split("host", "[.]")
    lengths = lambda k, most: F.filter(F.array(*map(F.lit, sizes[k])), lambda n: n <= most) if k in sizes else F.array().cast("array<int>")
    domains = F.transform(lengths("d", F.size(labels)), lambda n: F.concat(F.lit("d:"), F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")))
    prefixes = F.transform(lengths("p", F.size("segs")), lambda n: F.concat(F.lit("p:"), F.array_join(F.concat(F.array("host"), F.slice("segs", F.lit(1), n)), "/")))
    keyed = parts.select("url", "fetched_at", F.explode(F.concat(F.array(F.concat(F.lit("h:"), F.col("host"))), domains, prefixes)).alias("key"))
    hits = keyed.join(held.drop("depth"), "key").where((F.col("fetched_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until"))))
    found = hits.groupBy("url", "fetched_at").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("list_name")), ",").alias("lists"), F.min("since").alias("since"))
    rows = captures.select("page_id", "url", "fetched_at").join(found, ["url", "fetched_at"], "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return rows.select("page_id", host(F.col("url")).alias("host"), (n > 0).alias("blocked"), n.alias("n_matches"), F.coalesce("lists", F.lit("")).alias("lists"), F.date_format("since", "yyyy-MM-dd").alias("since"))


def capture_times(pages: DataFrame) -> DataFrame:
    """``pages`` has no fetch times: a minute of 2024 follows from page_id."""
    minute = (F.col("page_id") * 7919) % 525600
    return pages.select("page_id", "url", F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("t"), minute.alias("m")).select("page_id", "url", F.expr("t + make_dt_interval(0, 0, cast(m as int))").alias("fetched_at"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """There is no list table: entries follow from the md5 of every host of ``pages``."""
    hosts = pages.select(host(F.col("url")).alias("host")).where("host is not null").distinct()
    m = F.conv(F.substring(F.md5(F.col("host").cast("binary")), 1, 6), 16, 10).cast("long")
    rows = hosts.withColumn("m", m)
    entry = lambda name, kind, pattern, action, day: F.struct(F.lit(name).alias("list_name"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), day.cast("int").alias("day"))
    h, day = F.col("host"), F.col("m")
    domain, below = F.regexp_extract("host", r"([^.]+[.][^.]+[.][^.]+)$", 1), F.concat(F.col("host"), F.lit("/en"))
    none = F.array().cast("array<struct<list_name:string,kind:string,pattern:string,action:string,day:int>>")
    lists = [
        F.when(day % 3 == 0, F.array(entry("malware", "host", h, "add", day % 200), entry("malware", "host", h, "remove", day % 200 + 60), entry("malware", "host", h, "add", day % 200 + 150))).otherwise(none),
        F.when(day % 4 == 1, F.array(entry("spam", "domain", domain, "add", day % 180))).otherwise(none),
        F.when(day % 8 == 1, F.array(entry("spam", "domain", domain, "remove", day % 180 + 120))).otherwise(none),
        F.when(day % 2 == 0, F.array(entry("language", "prefix", below, "add", F.lit(100)), entry("language", "prefix", below, "remove", F.lit(220)))).otherwise(none),
    ]
    flat = rows.select(F.explode(F.concat(*lists)).alias("e")).select("e.*")
    dated = flat.withColumn("t", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    return dated.select("list_name", "kind", "pattern", "action", F.expr("t + make_dt_interval(day)").alias("dated_at"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_minutes((page_id * 7919) % 525600) AS t,
    lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '[.]+$', '')) AS h,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS segs FROM pages),
hosts AS (
  SELECT h, CAST('0x' || substr(md5(h), 1, 6) AS BIGINT) AS m, regexp_extract(h, '([^.]+[.][^.]+[.][^.]+)$', 1) AS d
  FROM (SELECT DISTINCT h FROM p WHERE h <> '')),
e AS (
  SELECT 'malware' AS list_name, 'h:' || h AS key, TRUE AS on_, m % 200 AS day FROM hosts WHERE m % 3 = 0
  UNION ALL SELECT 'malware', 'h:' || h, FALSE, m % 200 + 60 FROM hosts WHERE m % 3 = 0
  UNION ALL SELECT 'malware', 'h:' || h, TRUE, m % 200 + 150 FROM hosts WHERE m % 3 = 0
  UNION ALL SELECT 'spam', 'd:' || d, TRUE, m % 180 FROM hosts WHERE m % 4 = 1
  UNION ALL SELECT 'spam', 'd:' || d, FALSE, m % 180 + 120 FROM hosts WHERE m % 8 = 1
  UNION ALL SELECT 'language', 'p:' || h || '/en', TRUE, 100 FROM hosts WHERE m % 2 = 0
  UNION ALL SELECT 'language', 'p:' || h || '/en', FALSE, 220 FROM hosts WHERE m % 2 = 0),
g AS (SELECT list_name, key, TIMESTAMP '2024-01-01' + to_days(day::INTEGER) AS since, bool_or(on_) AS on_ FROM e GROUP BY ALL),
v AS (SELECT *, lead(since) OVER (PARTITION BY list_name, key ORDER BY since) AS until FROM g),
k AS (
  SELECT page_id, t, 'h:' || h AS key FROM p WHERE h <> ''
  UNION ALL SELECT page_id, t, 'd:' || array_to_string(string_split(h, '.')[i:], '.') FROM p, unnest(range(1, len(string_split(h, '.')) + 1)) AS u(i) WHERE h <> ''
  UNION ALL SELECT page_id, t, 'p:' || h || '/' || segs[1] FROM p WHERE h <> '' AND len(segs) > 0),
f AS (
  SELECT page_id, count(*) AS n, string_agg(DISTINCT list_name, ',' ORDER BY list_name) AS lists, min(since) AS since
  FROM k JOIN v USING (key) WHERE on_ AND t >= since AND (until IS NULL OR t < until) GROUP BY page_id)
SELECT page_id, nullif(h, '') AS host, coalesce(n, 0) > 0 AS blocked, coalesce(n, 0)::BIGINT AS n_matches,
  coalesce(lists, '') AS lists, strftime(since, '%Y-%m-%d') AS since
FROM p LEFT JOIN f USING (page_id)
"""
