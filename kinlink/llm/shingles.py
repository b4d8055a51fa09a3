"""Near-duplicates by exact similarity of word shingles, for the pipeline.

Two texts are linked where the Jaccard similarity of their sets of word
shingles is at least SIMILAR, counted on the shingles themselves; linked texts
form components.  Candidates come two ways:

- links of the SimHash Gray-order index at simhash.MAX_BITS, which join close
  copies cheaply but miss many pairs near the threshold;
- a prefix filter, which misses none: in any fixed order of all shingles, two
  sets of similarity t share one of the first n - ceil(t n) + 1 of each.  The
  order puts the shingles that are frequent in a sample last, so the sample
  decides only the work.

Texts of equal words are one node from the start.  Within a bucket of a shared
shingle a pair is passed over where sizes or parity sketches (one bit for the
parity of the shingles of each of SKETCH classes, so that sets differ in at
least as many shingles as sketches differ in bits) exclude the similarity.
First neighbours by size are compared and contracted, then every pair that is
still in two components, so that a large group of copies never makes all its
pairs.

Defined results: null or empty text and text without words are one node; fewer
words than a shingle are one shingle; null doc_id is a row like any other;
empty tables give empty tables; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import appended, materialised

#: Least similarity as a fraction, bits of a sketch, the share of texts whose
#: shingles are counted (one in SAMPLE), and the shingles that are put last.
SIMILAR, SKETCH, SAMPLE, FREQUENT = (4, 5), 1024, 16, 200_000
#: Sets of shingles that a comparison keeps at a time.
HELD = 64


def shingles(text: str | None, shingle: int) -> list[bytes]:
    """All shingles, with repeats; words as for the fingerprint."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    return list(map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle)), strict=False))) or [b" ".join(words)]


def similar(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def _hashes(parts: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(p, simhash.SEED) for p in parts), dtype=np.uint64, count=len(parts))


def _majority(hashes: np.ndarray) -> int:
    """The SimHash fingerprint of all shingles' hashes."""
    ones, big = np.zeros(64, np.int64), hashes.astype(">u8")
    for a in range(0, len(big), 1 << 16):
        ones += np.unpackbits(big[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(big)).tobytes(), "big")


def prefix(distinct: np.ndarray, late: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The hashes of a set (ascending) that must meet those of any similar set;
    late (ascending) are put last, by rank."""
    n = len(distinct)
    if not n:
        return distinct
    at = np.minimum(np.searchsorted(late, distinct), max(len(late) - 1, 0))
    last = np.where(late[at] == distinct, rank[at], 0) if len(late) else np.zeros(n, np.int64)
    return distinct[np.argsort(last, kind="stable")[: n + 1 + (-SIMILAR[0] * n) // SIMILAR[1]]]


def frequent(df: DataFrame, text: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent shingles of a sample, ascending, and their
    ranks from 1, the rarest first: at most FREQUENT of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_hashes(shingles(t, shingle))).view(np.int64))], names=["h"])

    some = df.select(text).where(F.pmod(F.xxhash64(text), F.lit(SAMPLE)) == 0)
    most = some.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(FREQUENT)
    found = np.array([r["h"] for r in most.select("h").collect()], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], (len(found) - np.arange(len(found)))[order]


def with_shingles(df: DataFrame, text: str, shingle: int) -> DataFrame:
    """Append _fp, _digest of the words, _n (different shingles), _sketch and _prefix."""
    handle = df.sparkSession.sparkContext.broadcast(frequent(df, text, shingle))
    types = {"_fp": pa.int64(), "_digest": pa.binary(), "_n": pa.int64(), "_sketch": pa.binary(), "_prefix": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, rank = handle.value
        for full in batches:
            for a in range(0, full.num_rows, 512):
                batch, out = full.slice(a, 512), []
                for t in batch.column(text).to_pylist():
                    hashes = _hashes(shingles(t, shingle))
                    distinct = np.unique(hashes)
                    parity = np.bincount((distinct % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
                    fp = _majority(hashes)
                    digest = xxhash.xxh3_128_digest(b" ".join((t or "").encode().lower().split()))
                    out.append((simhash._signed(fp), digest, len(distinct), np.packbits(parity.astype(np.uint8)).tobytes(), prefix(distinct, late, rank).view(np.int64)))
                new = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), types.values(), strict=True)]
                yield appended(batch, dict(zip(types, new, strict=True)))

    kinds = (T.LongType(), T.BinaryType(), T.LongType(), T.BinaryType(), T.ArrayType(T.LongType()))
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(n, k) for n, k in zip(types, kinds, strict=True))]))


def shared(keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` (key, id, n) whose key another row has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, met = None, False  # the last row so far, and whether the one before it has its key
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([np.asarray(c) for c in batch.columns], 1)
            rows = rows if held is None else np.concatenate([held, rows])
            same = rows[1:, 0] == rows[:-1, 0]
            keep = np.concatenate([[met], same]) | np.concatenate([same, [False]])
            held, met = rows[-1:], bool(keep[-1])
            if (found := rows[:-1][keep[:-1]]).size:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.T.copy()], names=["key", "id", "n"])
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.T.copy()], names=["key", "id", "n"])

    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, id long, n long")


#: Rows of a bucket above which the pairs inside its largest component are never made, and pairs at a time.
LARGE, PAIRS = 256, 1 << 18


def _may_be_similar(n: np.ndarray, sketch: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """False only where the sets of rows i and j can't be similar."""
    num, den = SIMILAR
    low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    keep = den * low >= num * high
    differ = np.bitwise_count(sketch[i[keep]] ^ sketch[j[keep]]).sum(1, dtype=np.int64)
    keep[keep] = (den + num) * differ <= (den - num) * (low + high)[keep]
    return keep


def _bucket_pairs(ends: np.ndarray, root: np.ndarray, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of one bucket with different roots, i < j; ends: of
    each row's bucket.  Not every: neighbours."""
    rows, step = np.arange(len(ends)), 1
    if every:
        starts = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]])) if len(ends) else rows
        for a in starts[ends[starts] - starts > LARGE].tolist():
            b = int(ends[a])
            names, group = np.unique(root[a:b], return_inverse=True)
            most = group == np.argmax(np.bincount(group))
            if len(names) == 1:
                continue
            inner, others = a + np.flatnonzero(most), a + np.flatnonzero(~most)
            for k, i in enumerate(others.tolist()):
                later = others[k + 1 :]
                j = np.concatenate([inner, later[root[later] != root[i]]])
                for c in range(0, len(j), PAIRS):
                    some = j[c : c + PAIRS]
                    yield np.minimum(i, some), np.maximum(i, some)
        rows = rows[ends - np.repeat(starts, np.diff(np.append(starts, len(ends)))) <= LARGE] if len(ends) else rows
    while len(rows):
        rows = rows[rows + step < ends[rows]]
        for c in range(0, len(rows), PAIRS):
            i = rows[c : c + PAIRS]
            i = i[root[i] != root[i + step]]
            if len(i):
                yield i, i + step
        step += 1
        if not every:
            break


def candidates(met: DataFrame, every: bool) -> DataFrame:
    """Pairs (a, b) of ids in buckets of ``met`` (key, id, n, root, sketch)
    that have different roots and aren't excluded: neighbours by size, or every pair."""

    def pairs(key: np.ndarray, n: np.ndarray, id_: np.ndarray, root: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.diff(key)) + 1
        ends = np.repeat(np.append(cuts, len(key)), np.diff(np.concatenate([[0], cuts, [len(key)]])))
        for i, j in _bucket_pairs(ends, root, every):
            keep = _may_be_similar(n, sketch, i, j)
            if keep.any():
                x, y = id_[i[keep]], id_[j[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(batch.column(c)) for c in ("key", "n", "id", "root")]
            cols.append(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(batch.num_rows, -1))
            cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            whole = int(np.searchsorted(cols[0], cols[0][-1]))  # the last bucket may go on
            if whole:
                yield from pairs(*(c[:whole] for c in cols))
            held = [c[whole:] for c in cols]
        if held is not None:
            yield from pairs(*held)

    dealt = met.repartition("key").sortWithinPartitions("key", "n", "id")
    return dealt.mapInArrow(run, "a long, b long").distinct()


#: Ids of rows up to which they are broadcast; beyond, the rows are shuffled.
SMALL_IDS = 1_000_000


def verified(pairs: DataFrame, rows: DataFrame, text: str, shingle: int) -> DataFrame:
    """The pairs (a, b) of _uid of ``rows`` whose texts are similar."""
    pairs = materialised(pairs, "shingle-pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, set[bytes]] = {}

        def of(id_: int, t: str) -> set[bytes]:
            if id_ not in held:
                if len(held) >= HELD:
                    held.clear()
                held[id_] = set(shingles(t, shingle))
            return held[id_]

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")), strict=True)
            keep = [similar(of(a, x), of(b, y)) for a, b, x, y in rows]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # Only texts that a pair has are dealt: by a semi-join that needs no shuffle, if the ids are few.
    ids = materialised(pairs.select(F.explode(F.array("a", "b")).alias("_uid")).distinct(), "shingle-ids")
    few = ids.limit(SMALL_IDS + 1).count() <= SMALL_IDS
    asked = rows.select("_uid", text).join(F.broadcast(ids), "_uid", "left_semi") if few else rows.select("_uid", text)
    one, two = (asked.select(F.col("_uid").alias(k), F.col(text).alias(f"t{k}")) for k in "ab")
    return materialised(pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long"), "shingle-edges")


def one_of_each(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row
    of least doc_id stays, of equal ids one.  ``docs`` is read twice."""
    df = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    others = [f"_row.`{c}`" for c in docs.columns if c != text]  # the text is written once
    df = df.withColumns({"_row": F.struct(*map(F.col, others)) if others else F.struct(F.lit(None).alias("none")), "_uid": F.monotonically_increasing_id()})
    rows = materialised(with_shingles(df, "_text", shingle), "shingle-rows")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_uid", "_fp", "_n", "_sketch")).alias("at")
    nodes = materialised(rows.groupBy("_digest").agg(first).select("at.*"), "shingle-nodes")

    fps = materialised(nodes.groupBy("_fp").agg(F.min("_uid").alias("own")), "shingle-fps")
    own = lambda k: fps.select(F.col("_fp").alias(k), F.col("own").alias(f"_{k}"))
    index = simhash.links(fps.select(F.col("_fp").alias("fp"))).distinct().join(own("a"), "a").join(own("b"), "b")
    equal = nodes.join(fps, "_fp").where("_uid <> own").select(F.col("own").alias("a"), F.col("_uid").alias("b"))
    index = index.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).unionByName(equal)

    keys = rows.join(nodes.select("_uid"), "_uid", "left_semi").select(F.explode("_prefix").alias("key"), F.col("_uid").alias("id"), F.col("_n").alias("n"))
    met = materialised(shared(keys), "shingle-shared")
    sketches = nodes.select(F.col("_uid").alias("id"), F.col("_sketch").alias("sketch"))
    near = candidates(met.withColumn("root", F.col("id")).join(sketches, "id"), every=False)
    sure = verified(near.unionByName(index).distinct(), rows, "_text", shingle)

    roots = materialised(simhash.components(sure), "shingle-roots")
    named = lambda d, k, r: d.join(r.withColumnRenamed("node", k), k, "left").withColumn("root", F.coalesce("root", k))
    rest = verified(candidates(named(met, "id", roots).join(sketches, "id"), every=True), rows, "_text", shingle)
    roots = simhash.components(sure.unionByName(rest))
    # A node without a link stays; of the others the least of each component, by a partial aggregation.
    linked = materialised(nodes.select("none", "_id", "_uid").join(roots.withColumnRenamed("node", "_uid"), "_uid"), "shingle-linked")
    least = linked.groupBy("root").agg(F.min(F.struct("none", "_id", "_uid")).alias("least")).select(F.col("least._uid").alias("_uid"))
    copies = rows.select("_uid").join(nodes.select("_uid"), "_uid", "left_anti")
    drop = materialised(copies.unionByName(linked.select("_uid").join(least, "_uid", "left_anti")), "shingle-drop")
    few = drop.limit(SMALL_IDS + 1).count() <= SMALL_IDS
    stay = rows.join(F.broadcast(drop) if few else drop, "_uid", "left_anti")
    return stay.select(*(F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
