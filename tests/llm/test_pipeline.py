"""The pipeline's stages, each on its own input."""

import collections
import zlib

import corpus_pipeline as cp
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlink.llm import langid, quality, queries
from kinlink.llm.common import materialised, quiet_tokenizer

from .test_operators import brute_counts, brute_distances, brute_language, brute_vector
from .test_shingles import brute_kept


#: Names that operators use inside, and one that isn't a plain word.
CLASHES = ["kept", "my col", "grp", "scale", "deal", "data", "spans", "_row", "_uid", "_fp", "x0", "par", "root", "score", "rejected", "ids", "h"]


@pytest.fixture(scope="module")
def steps(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet")
    extra = rows.limit(2).select((F.col("doc_id") + 10**6).alias("doc_id"), "text", "lang", "source", "n_chars")
    none = spark.range(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    out = [rows.unionByName(extra).unionByName(none).withColumns({c: F.lit("clash") for c in CLASHES})]
    for name, stage in cp.STAGES:
        out.append(materialised(stage(spark, out[-1], data), name))
    return out


def test_stages(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    counts = [s.count() for s in steps]
    assert counts[0] > counts[1] >= counts[2] > counts[3] == counts[4] > 0
    left = {r.doc_id for r in steps[3].select("doc_id").collect()}
    assert left <= {r.doc_id for r in steps[2].select("doc_id").collect()}
    assert steps[3].select("text").distinct().count() == counts[3]
    assert steps[4].where(F.length("text") != F.col("n_chars")).count() == 0
    assert {r.doc_id for r in steps[5].select("doc_id").distinct().collect()} == left
    cut = steps[3].alias("a").join(steps[4].alias("b"), "doc_id").where(F.length("b.text") > F.length("a.text"))
    assert cut.count() == 0


def test_empty(spark, steps, data):
    rows = steps[0].limit(0)
    for _, stage in cp.STAGES:
        rows = materialised(stage(spark, rows, data), "empty")
    assert rows.count() == 0


def cut_text(rows, n=50):
    """Texts without the bytes of a repeat of an earlier document; characters cut in part stay."""
    least = {}
    for i, b in rows:
        for k in range(len(b) - n + 1):
            least[b[k : k + n]] = min(least.get(b[k : k + n], i), i)
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if least[b[k : k + n]] < i:
                gone[k : k + n] = b"\1" * n
        out, at = [], 0
        for c in b.decode():
            size = len(c.encode())
            if not all(gone[at : at + size]):
                out.append(c)
            at += size
        yield i, "".join(out)


def test_run_against_brute_force(spark, data):
    """run() over the whole small table against every stage by plain loops."""
    rows = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    model = langid.learn(spark.read.parquet(f"{data}/documents.parquet").where(~langid.held_out(F.col("doc_id"))))
    found = {i: brute_language(r.text, model) for i, r in rows.items()}
    rows = {i: r for i, r in rows.items() if found[i][0] != "und" and found[i][1] >= langid.MIN_SCORE}
    counts = {i: brute_counts(r.text) for i, r in rows.items()}
    rows = {i: r for i, r in rows.items() if counts[i][0] >= 50 and 100 * counts[i][4] <= 50 * counts[i][0]}
    far = brute_distances(np.array([brute_vector(r.text) for r in rows.values()]), [(r.lang or "", r.source or "") for r in rows.values()])
    rows = {i: r for (i, r), d in zip(rows.items(), far) if d <= quality.CUTOFF}
    stay = set(brute_kept([(i, r.text) for i, r in rows.items()]))
    left = dict(cut_text([(i, r.text.encode()) for i, r in rows.items() if i in stay]))
    tok = quiet_tokenizer(queries.PIECES)
    want = {i: np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in left.items()}
    got, at = cp.run(spark, data).collect(), collections.defaultdict(int)
    assert {r.doc_id for r in got} == set(want) and len(want) > 20
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        ids = want[r.doc_id]
        assert r.offset == at[r.sequence_id] and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        at[r.sequence_id] += r.length
    assert sum(at.values()) == sum(map(len, want.values())) and max(at.values()) <= 1024


def test_near_copies_at_the_stated_similarity(spark, steps, data):
    """Every pair of five-word Jaccard similarity 0.8 and more loses one, in planted near copies of all degrees."""
    base = [r for r in steps[2].where(F.length("text") > 800).orderBy("doc_id").limit(40).collect()]
    r, made = np.random.default_rng(3), []
    for k, x in enumerate(base):
        words = x.text.split()
        for j, at in enumerate(sorted(r.choice(len(words), max(1, int(len(words) * 0.02 * (k % 3 + 1) / 2)), replace=False))):
            words[at] = f"near{k}x{j}"
        made.append((10**7 + k, " ".join(words)))
    rows = spark.createDataFrame([(x.doc_id, x.text) for x in base] + made, "doc_id long, text string")
    got = {x.doc_id for x in cp.near_duplicates(spark, rows, data).collect()}
    every = [(x.doc_id, x.text) for x in base] + made
    assert sorted(got) == brute_kept(every) and len(got) < len(every)
