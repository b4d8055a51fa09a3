"""SimHash near-duplicates over a Gray-order hierarchical index (operator 5).

A fingerprint has one bit for each of 64 positions: set in over half of the
XXH64 values of the text's word shingles.  Distinct fingerprints are linked at
MAX_BITS or fewer differing bits, and linked fingerprints form components.

The index: fingerprints are sorted by Gray rank and cut into ranges of about
GROUP.  A range is a node that holds the bits all its fingerprints share; FAN
neighbours at a time become the nodes above, and what a parent holds is
factored out of its children.  The ranges' nodes with those above them are the
directory, at most about DIRECTORY entries.  A search walks down with the
differences so far and drops a node, with all below it, beyond max_bits: first
every range through the directory, which leaves the pairs of ranges that may
hold a link, then within such a pair one range's fingerprints through the
nodes of the other.  Both are exact.  A pair of ranges emits a spanning forest
of its links, never all of them, and nodes whose members are already one
component with the searcher are dropped too.

Components are found by contraction to least neighbours, with the tables
written to the shared folder each round; nothing is gathered on the driver but
the directory.

Defined results: null or empty text, and text without words, has fingerprint
zero; fewer words than a shingle are one shingle; equal fingerprints are one
component; null doc_id is a row like any other but no component's name unless
it is alone; empty tables give empty tables; further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import appended, materialised

MAX_BITS, SHINGLE, SEED = 3, 3, 42
FAN = 8
#: Fingerprints of a range and the least number of ranges, entries of the
#: directory, and searchers that are in memory at a time.
GROUP, RANGES, DIRECTORY, SEARCHERS = 1 << 16, 16, 1 << 20, 256
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Rows that the least of a component is dealt to, against large components.
SALTS = 16


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.encode().lower().split()  # bytes: A-Z alone, and the six ASCII spaces
    if not words:
        return 0
    parts = list(map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle)), strict=False))) or [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in parts), dtype=">u8", count=len(parts))
    ones = np.zeros(64, np.int64)
    for a in range(0, len(parts), 1 << 16):  # bounded memory for long texts
        ones += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(parts)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (long, the 64 bits as signed)."""
    return with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "fp", "text", shingle, seed).select("doc_id", "fp")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each word in the reflected Gray sequence."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


def rank_column(fp: Column) -> Column:
    """``gray_rank`` of a long column, as a long of the same order."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def shared_bits(pattern: np.ndarray, mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, mask) of the bits that all of each run from ``at`` on holds alike."""
    ones, any_ = np.bitwise_and.reduceat(pattern, at), np.bitwise_or.reduceat(pattern, at)
    common = np.bitwise_and.reduceat(mask, at) & ~(ones ^ any_)
    return ones & common, common


class GrayIndex:
    """Nodes over leaves (pattern, mask) that are in Gray order, top level last."""

    def __init__(self, pattern: np.ndarray, mask: np.ndarray | None = None):
        mask = np.full(len(pattern), FULL) if mask is None else mask
        self.size, levels = len(pattern), [(pattern, mask)]
        while len(pattern) > 1:
            pattern, mask = shared_bits(pattern, mask, np.arange(0, len(pattern), FAN))
            levels.append((pattern, mask))
        # A child keeps only what its parent doesn't hold.
        self.levels = []
        for k, (pattern, mask) in enumerate(levels):
            above = np.repeat(levels[k + 1][1], FAN)[: len(mask)] if k + 1 < len(levels) else np.zeros(1, np.uint64)
            own = mask & ~above
            self.levels.append((pattern & own, own))

    def search(self, pattern: np.ndarray, mask: np.ndarray | None, first: np.ndarray, most: int, joined=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, leaf) of at most ``most`` differing bits among those
        that both hold, with leaves from first[query] on.  joined(level, nodes,
        queries): True where nothing below can add to the components."""
        for a in range(0, len(pattern) if self.size else 0, SEARCHERS):
            q = np.arange(a, min(a + SEARCHERS, len(pattern)))
            node, diff = np.zeros(len(q), np.int64), np.zeros(len(q), np.uint8)
            for level in range(len(self.levels) - 1, -1, -1):
                held, own = self.levels[level]
                if level < len(self.levels) - 1:
                    q, diff = np.repeat(q, FAN), np.repeat(diff, FAN)
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    live = node < len(held)
                    q, node, diff = q[live], node[live], diff[live]
                apart = (pattern[q] ^ held[node]) & own[node]
                diff = diff + np.bitwise_count(apart if mask is None else apart & mask[q])
                keep = (diff <= most) & ((node + 1) * FAN**level > first[q])
                if joined is not None and level:
                    keep &= ~joined(level, node, q)
                q, node, diff = q[keep], node[keep], diff[keep]
            yield q, node


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def forest(fps: np.ndarray, most: int, others: np.ndarray | None = None) -> np.ndarray:
    """Edges (rows of two fingerprints) of a spanning forest of the links among
    distinct fingerprints, or between them and ``others``."""
    leaves = fps if others is None else others
    leaves = leaves[np.argsort(gray_rank(leaves), kind="stable")]
    queries = leaves if others is None else fps[np.argsort(gray_rank(fps), kind="stable")]
    n, index = len(leaves), GrayIndex(leaves)
    shift, first = (0, np.arange(1, n + 1)) if others is None else (n, np.zeros(len(queries), np.int64))
    label = np.arange(shift + len(queries))  # of leaves, then of queries that aren't leaves
    ends: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def joined(level: int, node: np.ndarray, q: np.ndarray) -> np.ndarray:
        if level not in ends:
            at = np.arange(0, n, FAN**level)
            ends[level] = np.minimum.reduceat(label[:n], at), np.maximum.reduceat(label[:n], at)
        low, high = ends[level]
        return (low[node] == high[node]) & (low[node] == label[shift + q])

    edges = [np.zeros((0, 2), np.uint64)]
    for q, leaf in index.search(queries, None, first, most, joined):
        if not len(q):
            continue
        order = np.argsort(q, kind="stable")
        each, cut = np.unique(q[order], return_index=True)
        for x, near in zip(each.tolist(), np.split(leaf[order], cut[1:]), strict=True):
            names, at = np.unique(label[near], return_index=True)
            new = names != label[shift + x]
            if new.any():
                edges.append(np.stack([np.full(int(new.sum()), queries[x]), leaves[near[at[new]]]], 1))
                every = np.append(names, label[shift + x])
                label[np.isin(label, every)] = every.min()
                ends.clear()
    return np.concatenate(edges)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ranges(fps: DataFrame, group: int = GROUP) -> DataFrame:
    """(grp, pattern, mask, data): the ranges of distinct fingerprints ``fp`` in
    Gray order, each with its node and its fingerprints (u64)."""
    n = fps.count()
    size = max(group, -(-n // DIRECTORY))
    dealt = fps.select("fp", rank_column(F.col("fp")).alias("rank")).repartitionByRange(max(RANGES, -(-n // size)), "rank").sortWithinPartitions("rank").select("fp")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found = TaskContext.get().partitionId(), [np.asarray(b.column("fp")).view(np.uint64) for b in batches]
        every = np.concatenate(found) if found else np.zeros(0, np.uint64)
        for k, a in enumerate(range(0, len(every), 2 * size)):  # ranges are cut by a sample
            mine = every[a : a + 2 * size]
            pattern, mask = shared_bits(mine, np.full(len(mine), FULL), np.array([0]))
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | k]), pa.array(pattern.view(np.int64)), pa.array(mask.view(np.int64)), pa.array([mine.tobytes()], pa.binary())], names=["grp", "pattern", "mask", "data"])

    return materialised(dealt.mapInArrow(gather, "grp long, pattern long, mask long, data binary"), "simhash-ranges")


def near_ranges(held: DataFrame, max_bits: int) -> DataFrame:
    """Pairs (a, b) of ranges that may hold a link, by a search of the
    directory; each range also with itself."""
    nodes = sorted(tuple(r) for r in held.select("grp", "pattern", "mask").collect())  # at most about DIRECTORY
    grp, pattern, mask = (np.array(x, np.int64) for x in (zip(*nodes, strict=True) if nodes else ((), (), ())))
    handle = held.sparkSession.sparkContext.broadcast((grp, pattern.view(np.uint64), mask.view(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, pattern, mask = handle.value
        index = GrayIndex(pattern, mask)
        for batch in batches:
            at = np.searchsorted(grp, np.asarray(batch.column("grp")))
            for q, leaf in index.search(pattern[at], mask[at], at, max_bits):
                one, two = at[q], leaf
                turn = (one + two) % 2 == 1  # so that each range meets about half of its partners as b
                yield pa.RecordBatch.from_arrays([pa.array(grp[np.where(turn, two, one)]), pa.array(grp[np.where(turn, one, two)])], names=["a", "b"])

    return held.select("grp").repartition("grp").mapInArrow(run, "a long, b long")


def links(fps: DataFrame, max_bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints ``fp`` of
    ``fps`` that links connect; a forest for each pair of ranges."""
    held = ranges(fps, group)
    pairs = materialised(near_ranges(held, max_bits), "simhash-pairs")
    side = lambda key, where: pairs.where(where).join(held.select(F.col("grp").alias(key), "data"), key).select("a", "b", F.lit(key).alias("side"), "data")
    met = side("a", "true").unionByName(side("b", "a <> b"))

    def join(pair: pa.Table) -> pa.Table:
        data = {s: np.frombuffer(d, np.uint64) for s, d in zip(pair.column("side").to_pylist(), pair.column("data").to_pylist(), strict=True)}
        found = forest(data["a"], max_bits, data.get("b")).view(np.int64)
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    return met.groupBy("a", "b").applyInArrow(join, "a long, b long")


#: Edges that one task finishes alone; more are contracted first.
FINISH_EDGES = 100_000


def components(edges: DataFrame, finish: int = FINISH_EDGES) -> DataFrame:
    """(node, root): the least node reachable, for every node of ``edges`` (a, b).

    Each round every node of the contracted graph takes its least neighbour,
    and two steps of pointer jumping follow.  Once at most ``finish`` edges
    are left, one task joins them."""
    edges = materialised(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels = None
    while edges.limit(finish + 1).count() > finish:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hop = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        hop = materialised(hop, "cc-hop")
        for _ in range(2):
            up = hop.select(F.col("a").alias("m"), F.col("m").alias("mm"))
            hop = materialised(hop.join(up, "m").select("a", F.col("mm").alias("m")), "cc-hop")
        labels = hop.withColumnsRenamed({"a": "node", "m": "root"}) if labels is None else labels.join(hop.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("m", "root").alias("root"))
        labels = materialised(labels, "cc-labels")
        moved = edges.join(hop.withColumnRenamed("m", "x"), "a").select("b", "x").join(hop.select(F.col("a").alias("b"), F.col("m").alias("y")), "b")
        edges = materialised(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, flat = np.unique(frame[["a", "b"]].to_numpy().ravel(), return_inverse=True)
        parent = list(range(len(nodes)))
        for x, y in flat.reshape(-1, 2).tolist():
            x, y = _root(parent, x), _root(parent, y)
            parent[max(x, y)] = min(x, y)
        return pd.DataFrame({"node": nodes, "root": nodes[[_root(parent, i) for i in range(len(nodes))]]})

    last = edges.groupBy(F.lit("all").alias("one")).applyInPandas(join, "node long, root long")
    if labels is None:
        return last
    ends = materialised(last, "cc-last")  # at most two nodes for each of ``finish`` edges
    return labels.join(F.broadcast(ends.select(F.col("node").alias("root"), F.col("root").alias("r"))), "root", "left").select("node", F.coalesce("r", "root").alias("root"))


def with_fingerprint(df: DataFrame, name: str = "fp", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Append the fingerprint of ``text`` as ``name`` (long) to all columns of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in batches:
            for a in range(0, full.num_rows, 512):
                batch = full.slice(a, 512)
                fps = np.array([fingerprint(t or "", shingle, seed) for t in batch.column(text).to_pylist()], np.uint64)
                yield appended(batch, {name: pa.array(fps.view(np.int64))})

    kept = df.drop(name)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(name, T.LongType())]))


def least_of_components(fps: DataFrame, value: str, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, least): of every distinct ``fp`` the least ``value`` (null last)
    among the rows of its component."""
    distinct = materialised(fps.groupBy("fp").agg(F.min(value).alias("own")), "simhash-distinct")
    roots = materialised(components(links(distinct.select("fp"), max_bits)), "simhash-roots")
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    alone = named.where("root IS NULL").select("fp", F.col("own").alias("least"))
    several = named.where("root IS NOT NULL")
    least = several.groupBy("root").agg(F.min("own").alias("least")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    several = several.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(least, ["root", "salt"])
    return alone.unionByName(several.select("fp", "least"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id: the least doc_id reachable."""
    fps = materialised(fingerprints(docs, shingle, seed), "simhash-fps")
    least = least_of_components(fps, "doc_id", max_bits).withColumnRenamed("least", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return fps.join(least, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")
