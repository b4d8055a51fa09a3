"""The near-duplicate stage against every pair's exact similarity."""

import corpus_pipeline as cp
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlink.llm import shingles


def brute_kept(rows):
    """The ids that stay: of each component of similar texts the least."""
    sets = [set(shingles.shingles(t, cp.SHINGLE)) for _, t in rows]
    name = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if name[a] != name[b] and (not sets[a] and not sets[b] or 5 * both >= 4 * len(sets[a] | sets[b]) > 0):
                x, y = sorted((name[a], name[b]))
                name = [x if n == y else n for n in name]
    return sorted(min(rows[k][0] for k in range(len(rows)) if name[k] == n) for n in set(name))


def varied(r, words, changes):
    words = list(words)
    for k in r.choice(len(words), changes, replace=False):
        words[k] = f"x{r.integers(10**9)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def made():
    r = np.random.default_rng(7)
    out = ["", " \n", "one", "One", "one two three four five"]
    for _ in range(30):  # pairs around the threshold
        words = [f"w{k}" for k in r.integers(0, 10**6, int(r.integers(60, 400)))]
        out += [" ".join(words), varied(r, words, int(len(words) * r.uniform(0.005, 0.04)))]
    base = [f"b{k}" for k in r.integers(0, 10**6, 150)]  # one large group of copies of many degrees
    out += [varied(r, base, int(r.integers(0, 14))) for _ in range(150)]
    passage = " ".join(f"p{k}" for k in range(40))  # a common passage in texts that aren't similar
    out += [passage + " " + " ".join(f"w{k}" for k in r.integers(0, 10**6, 40)) for _ in range(60)]
    return list(enumerate(r.permutation(np.array(out, object)).tolist()))


def test_stage_is_exact(spark, data, made):
    rows = spark.createDataFrame(made, "doc_id long, text string").withColumn("source", F.lit("s"))
    got = cp.near_duplicates(spark, rows, data)
    assert got.columns == rows.columns
    assert sorted(r.doc_id for r in got.collect()) == brute_kept(made)


def test_filter_alone_is_exact(spark, made, monkeypatch):
    """Without the index's candidates and with an order by a full count."""
    monkeypatch.setattr(shingles, "SAMPLE", 1)
    monkeypatch.setattr(shingles.simhash, "links", lambda fps: fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0))
    rows = spark.createDataFrame(made, "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.one_of_each(rows, "doc_id", "text", cp.SHINGLE).collect()) == brute_kept(made)


def test_bucket_pairs(monkeypatch):
    """Every pair of different roots, in small and in large buckets; or neighbours."""
    monkeypatch.setattr(shingles, "LARGE", 6)
    monkeypatch.setattr(shingles, "PAIRS", 7)
    r = np.random.default_rng(2)
    sizes = [1, 2, 5, 6, 7, 30, 1, 12]
    ends = np.repeat(np.cumsum(sizes), sizes)
    root = r.integers(0, 3, len(ends))
    root[21:51] = np.where(np.arange(30) % 9 == 4, 1, 2)
    pairs = lambda every: sorted((int(x), int(y)) for i, j in shingles._bucket_pairs(ends, root, every) for x, y in zip(i, j))
    want = [(i, j) for i in range(len(ends)) for j in range(i + 1, int(ends[i])) if root[i] != root[j]]
    assert pairs(True) == want and pairs(False) == [(i, j) for i, j in want if j == i + 1]
    assert list(shingles._bucket_pairs(ends[:0], root[:0], True)) == []
