"""The k best of a pool for each query, by blocks in arrays.

Queries and pool are dealt to blocks of their key (country, label) by a hash
of their ids; every block of queries meets every block of the pool in one
task, which holds no more than the two.  A task returns k candidates a query,
and those of all blocks are merged by (-score, cand_id), so the result is that
of comparing all pairs, which are never made as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import pair_measures

QUERY_BLOCK, POOL_BLOCK = 10_000, 50_000


#: Postings or pairs that a task holds as arrays at once.
HELD = 1_000_000
#: Tokens of a record that are compared as columns; longer records are compared as sets.
WIDE = 24


def dealt(queries: DataFrame, pool: DataFrame, key: str, meet: Callable[[pa.Table, pa.Table], pa.Table], kinds: str, query_block: int = QUERY_BLOCK, pool_block: int = POOL_BLOCK) -> DataFrame:
    """What ``meet`` makes of every block of ``queries`` (s1_id, ``key``) with
    every block of ``pool`` (cand_id, ``key``).  Both are read twice."""
    queries, pool = (d.toDF(*d.columns) for d in (queries, pool))  # columns of their own, where both come of one table
    count = lambda d, n, each: d.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / each).cast("int").alias(n))
    blocks = count(queries, "_qs", query_block).join(count(pool, "_ps", pool_block), key)
    side = lambda d, own, of, other: d.join(blocks, key).withColumns({own: F.pmod(F.xxhash64("s1_id" if own == "_q" else "cand_id"), F.col(f"{own}s")).cast("int"), of: F.explode(F.sequence(F.lit(0), F.col(other) - 1))}).drop("_qs", "_ps")
    left, right = side(queries, "_q", "_p", "_ps"), side(pool, "_p", "_q", "_qs")
    return left.groupBy(key, "_q", "_p").cogroup(right.groupBy(key, "_q", "_p")).applyInArrow(meet, kinds)


def streamed(queries: DataFrame, pool: DataFrame, key: str, meet: Callable[[pa.Table, pa.Table], Iterator[pa.Table]], kinds: str, query_block: int, narrow: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """What ``meet`` yields for every block of ``queries`` (s1_id, ``key``) and
    each block of ``pool`` (cand_id, ``key``, _p: its block).  Unlike those of
    ``dealt`` the results leave a task piece by piece, so they may be many.
    narrow: what a query's row is for one block ``_p``."""
    blocks = queries.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("_qs"))
    left = queries.join(blocks, key).withColumn("_q", F.pmod(F.xxhash64("s1_id"), F.col("_qs")).cast("int")).drop("_qs")
    left = narrow(left.join(pool.select(key, "_p").distinct(), key))
    right = pool.join(blocks, key).withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_qs") - 1))).drop("_qs")
    own = [[c for c in d.columns if c not in ("_q", "_p")] for d in (left, right)]
    sides = [d.select(key, "_q", "_p", F.struct(*names).alias(s)) for d, names, s in zip((left, right), own, ("_l", "_r"), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, found = pa.Table.from_batches(list(batches)), []
        for s, names in zip(("_l", "_r"), own, strict=True):
            rows = both.filter(pc.is_valid(both.column(s))).column(s).combine_chunks()
            rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
            found.append(pa.Table.from_arrays(rows.flatten(), names=names))
        del both
        if len(found[0]) and len(found[1]):
            for table in meet(*found):
                yield from table.to_batches(max_chunksize=10_000)

    return sides[0].unionByName(sides[1], allowMissingColumns=True).groupBy(key, "_q", "_p").applyInArrow(run, kinds)


def _kinds(queries: DataFrame, pool: DataFrame, rest: str) -> str:
    return f"s1_id {queries.schema['s1_id'].dataType.simpleString()}, cand_id {pool.schema['cand_id'].dataType.simpleString()}, {rest}"


def top_k(queries: DataFrame, pool: DataFrame, key: str, k: int, meet: Callable[[pa.Table, pa.Table], pa.Table], query_block: int = QUERY_BLOCK, pool_block: int = POOL_BLOCK) -> DataFrame:
    """s1_id, cand_id, score and rank (from 1) of the k best candidates of each
    query.  ``queries`` has s1_id and ``key``, ``pool`` cand_id and ``key``;
    meet(block of queries, block of the pool): a table of s1_id, cand_id and
    score.  Both are read twice."""
    each = dealt(queries, pool, key, meet, _kinds(queries, pool, "score double"), query_block, pool_block)
    order = Window.partitionBy("s1_id").orderBy(F.desc("score"), "cand_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def counted(batches):
    """Batches of records with ``terms`` (a list, repeats kept), for mapInArrow:
    the different terms of each record and how often it has each (``tfs``)."""
    for batch in batches:
        (codes, _), (sizes, _), n = _lists([pa.Table.from_batches([batch])] * 2, "terms")
        names = batch.column("terms").flatten().dictionary_encode().dictionary
        row = np.repeat(np.arange(len(sizes)), sizes)
        pair, times = np.unique(row * max(n, 1) + codes, return_counts=True)
        row, code = np.divmod(pair, max(n, 1))
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))]).astype(np.int32))
        terms, tfs = pa.ListArray.from_arrays(ends, names.take(pa.array(code))), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int64)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "terms"), terms, tfs], names=[*(c for c in batch.schema.names if c != "terms"), "terms", "tfs"])


def top_k_of_classes(queries: DataFrame, pool: DataFrame, key: str, k: int, meet: Callable[[pa.Table, pa.Table], pa.Table], query_block: int = QUERY_BLOCK, pool_block: int = POOL_BLOCK) -> DataFrame:
    """``top_k`` where rows with equal ``class`` (a string, of one ``key``) are
    alike: a class of queries is compared once, and of a class of the pool only
    the k least ids can be among the best.  The result is that of all rows."""
    once = queries.drop("s1_id").dropDuplicates([key, "class"]).withColumnRenamed("class", "s1_id")
    few = pool.withColumn("_n", F.row_number().over(Window.partitionBy(key, "class").orderBy("cand_id"))).where(F.col("_n") <= k).drop("_n", "class")
    found = top_k(once, few, key, k, meet, query_block, pool_block).withColumnRenamed("s1_id", "class")
    return queries.select("s1_id", "class").join(found, "class").select("s1_id", "cand_id", "score", "rank")


def best(scores: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k greatest scores, ties by ``order``."""
    at = np.arange(len(scores))
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    return at[np.lexsort((order[at], -scores[at]))][:k]


def _found(queries: pa.ChunkedArray, pool: pa.ChunkedArray, at: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    if not at:
        return pa.table({"s1_id": pa.array([], queries.type), "cand_id": pa.array([], pool.type), "score": pa.array([], pa.float64())})
    who = np.repeat([q for q, _, _ in at], [len(c) for _, c, _ in at])
    return pa.table({"s1_id": queries.take(pa.array(who)), "cand_id": pool.take(pa.array(np.concatenate([c for _, c, _ in at]))), "score": pa.array(np.concatenate([s for _, _, s in at]), pa.float64())})


def _order(ids: pa.ChunkedArray) -> np.ndarray:
    """The place of each id in ascending order."""
    out = np.empty(len(ids), np.int64)
    out[np.argsort(np.array(ids.to_pylist(), object), kind="stable")] = np.arange(len(ids))
    return out


def _lists(tables: list[pa.Table], name: str) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Codes of the strings in a column of lists (or of words joined by blanks)
    of all tables, each table's list sizes, and the number of codes."""
    flat, sizes = zip(*(_words(t.column(name)) for t in tables), strict=True)
    terms = pa.concat_arrays(flat).dictionary_encode()
    codes = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(codes, [len(flat[0])]), list(sizes), len(terms.dictionary)


def _words(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All strings of a column of lists, or of words joined by one blank, and how many each row has."""
    column = column.combine_chunks()
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.zeros(len(column), np.int64)
    some = np.ones(len(column), bool)
    if pa.types.is_string(column.type):
        some = np.asarray(pc.not_equal(column, "").to_numpy(zero_copy_only=False), bool)
        column = pc.split_pattern(column.filter(pa.array(some)), " ")
    sizes[some] = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten(), sizes


class Postings:
    """The rows of a pool that have each term, and where a row's terms stand."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, n: int) -> None:
        self.by_term = np.argsort(codes, kind="stable")
        self.rows = np.repeat(np.arange(len(sizes)), sizes)[self.by_term]
        self.counts = np.bincount(codes, minlength=n)
        self.starts = np.cumsum(self.counts) - self.counts

    def batches(self, codes: np.ndarray, sizes: np.ndarray, held: int = HELD, most: int | None = None):
        """(queries from, to, term places, positions in ``rows``) of runs of
        queries (``most`` at most) that have ``held`` postings, or one query each."""
        have = self.counts[codes]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        total = np.concatenate([[0], np.cumsum(have)])[upto]
        a = 0
        while a < len(sizes):
            b = max(int(np.searchsorted(total, total[a] + held, side="right")) - 1, a + 1)
            b = b if most is None else min(b, a + most)
            part = slice(upto[a], upto[b])
            n = have[part]
            ends = np.cumsum(n)
            if len(ends) and ends[-1]:
                at = np.repeat(self.starts[codes[part]] - (ends - n), n) + np.arange(ends[-1])
                yield a, b, np.repeat(np.arange(upto[a], upto[b]), n), at
            a = b


#: A query's postings are summed by sorting where a pool has so many times more rows.
SPARSE = 200


def sparse_product(k: int, digits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Dot products of sparse rows (terms array<string>, weights array<double>),
    rounded; rows without a common term aren't paired."""

    def meet(queries: pa.Table, pool: pa.Table) -> pa.Table:
        if not len(queries) or not len(pool):
            return _found(queries.column("s1_id"), pool.column("cand_id"), [])
        (mine, theirs), sizes, n = _lists([queries, pool], "terms")
        weight = [_lists_of_numbers(t, "weights") for t in (queries, pool)]
        index, order, size = Postings(theirs, sizes[1], n), _order(pool.column("cand_id")), len(pool)
        weights, who, found = weight[1][index.by_term], np.repeat(np.arange(len(queries)), sizes[0]), []
        total = np.bincount(who, index.counts[mine], len(queries))
        many = total * SPARSE > size  # their sums are an array over the pool
        upto = np.concatenate([[0], np.cumsum(sizes[0])])
        for q in np.flatnonzero(many):
            part = slice(upto[q], upto[q + 1])
            spans = [slice(index.starts[c], index.starts[c] + index.counts[c]) for c in mine[part]]
            each = np.concatenate([weights[s] * w for s, w in zip(spans, weight[0][part], strict=True)])
            sums = np.bincount(np.concatenate([index.rows[s] for s in spans]), each, size)
            some = np.flatnonzero(sums)
            scores = np.round(sums[some], digits)
            top = best(scores, order[some], k)
            found.append((np.full(len(top), q), some[top], scores[top]))
        few = ~many[who]
        who, mine, own, sizes[0] = who[few], mine[few], weight[0][few], np.where(many, 0, sizes[0])
        for _, _, term, at in index.batches(mine, sizes[0]):
            pair, where = np.unique(who[term] * size + index.rows[at], return_inverse=True)
            sums = np.bincount(where, weights[at] * own[term], len(pair))
            some = np.flatnonzero(sums)
            scores, (q, c) = np.round(sums[some], digits), np.divmod(pair[some], size)
            by = np.lexsort((order[c], -scores, q))
            q = q[by]
            first = np.flatnonzero(np.diff(q, prepend=-1))
            place = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q)))
            top = by[place < k]
            found.append((q[place < k], c[top], scores[top]))
        return _rows_found(queries.column("s1_id"), pool.column("cand_id"), found)

    return meet


def _lists_of_numbers(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    return np.asarray((column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten())


def _rows_found(queries: pa.ChunkedArray, pool: pa.ChunkedArray, found: list[tuple[np.ndarray, ...]], names: tuple[str, ...] = ("score",)) -> pa.Table:
    """A table of ids and numbers from (places of queries, places in the pool, numbers ...)."""
    if not found:
        return pa.table({"s1_id": pa.array([], queries.type), "cand_id": pa.array([], pool.type)} | {c: pa.array([], pa.float64()) for c in names})
    q, c, *rest = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"s1_id": queries.take(pa.array(q)), "cand_id": pool.take(pa.array(c))} | {n: pa.array(x, pa.float64()) for n, x in zip(names, rest, strict=True)})


class Sets:
    """Lists of different codes, to count what two of them share."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, absent: int) -> None:
        self.sizes, self.codes, self.upto = sizes, codes, np.concatenate([[0], np.cumsum(sizes)])
        self.long = sizes > WIDE
        width = int(sizes[~self.long].max(initial=0))
        self.columns = np.full((width, len(sizes)), absent, np.int32)
        row = np.repeat(np.arange(len(sizes)), sizes)
        place, short = np.arange(len(codes)) - self.upto[row], ~self.long[row]
        self.columns[place[short], row[short]] = codes[short]

    def of(self, i: int) -> set:
        return set(self.codes[self.upto[i] : self.upto[i + 1]].tolist())


def jaccards(x: Sets, y: Sets, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Jaccard similarities of the sets i of x and j of y; of two empty sets 1."""
    common = np.zeros(len(i), np.int64)
    for a in range(0, len(i), 1 << 15):
        part = slice(a, a + (1 << 15))
        left, right, n = x.columns[:, i[part]], y.columns[:, j[part]], np.zeros(len(i[part]), np.int8)
        for u in left:
            for v in right:
                n += u == v
        common[part] = n
    for at in np.flatnonzero(x.long[i] | y.long[j]):
        common[at] = len(x.of(i[at]) & y.of(j[at]))
    union = x.sizes[i] + y.sizes[j] - common
    return np.divide(common, union, out=np.ones(len(i)), where=union > 0)


def token_pairs(keep: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Pairs of rows (country; keys, nt, at: arrays of strings, or words joined by blanks) with a common
    key: the Jaccard similarities nj of nt and aj of at.  keep(nj, aj): which are returned."""

    def meet(queries: pa.Table, pool: pa.Table) -> pa.Table:
        found = []
        if len(queries) and len(pool):
            (mine, theirs), sizes, n = _lists([queries, pool], "keys")
            index, who, sides = Postings(theirs, sizes[1], n), np.repeat(np.arange(len(queries)), sizes[0]), []
            for c in ("nt", "at"):
                (one, two), lengths, _ = _lists([queries, pool], c)
                sides.append((Sets(one, lengths[0], -1), Sets(two, lengths[1], -2)))
            for _, _, term, at in index.batches(mine, sizes[0]):
                q, c = np.divmod(np.unique(who[term] * len(pool) + index.rows[at]), len(pool))
                nj, aj = (jaccards(x, y, q, c) for x, y in sides)
                kept = keep(nj, aj) if keep else np.ones(len(q), bool)
                found.append((q[kept], c[kept], nj[kept], aj[kept]))
        out = _rows_found(queries.column("s1_id"), pool.column("cand_id"), found, ("nj", "aj"))
        country = queries.column("country")[:1].combine_chunks() if len(out) else queries.column("country")[:0].combine_chunks()
        return out.add_column(2, "country", country.take(pa.array(np.zeros(len(out), np.int64))))

    return meet


#: Queries whose bits a task holds at once.
BIT_ROWS = 64


def reach(queries: pa.Table, pool: pa.Table) -> pa.Table:
    """For each query how many rows of the pool share a key with it, the first
    and last of them and the sum of their ``check`` (0 to 2 ** 32 - 1).  A
    query's rows are the union of its keys' bits, so that frequent keys cost no pairs."""
    ids, found = pool.column("cand_id"), []
    if len(queries) and len(pool):
        (mine, theirs), sizes, n = _lists([queries, pool], "keys")
        order, width = _order(ids), -(-len(pool) // 64) * 8
        at = np.argsort(order)
        index = Postings(theirs, sizes[1], n)
        rows = order[index.rows]
        often = np.flatnonzero(index.counts > len(pool) / 64)
        dense, number = np.zeros((len(often) + 1, width), np.uint8), np.full(n, len(often))
        number[often] = np.arange(len(often))
        for d, key in enumerate(often):
            one = np.zeros(width * 8, np.uint8)
            one[rows[index.starts[key] : index.starts[key] + index.counts[key]]] = 1
            dense[d] = np.packbits(one)
        check = np.zeros(width * 8)
        check[order] = np.asarray(pool.column("check").combine_chunks())
        table = (check.reshape(width, 8) @ np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).T.astype(float)).astype(np.int64)
        offset, upto = np.arange(width) * 256, np.concatenate([[0], np.cumsum(sizes[0])])
        rare = np.where(number[mine] == len(often), index.counts[mine], 0)
        for a in range(0, len(queries), BIT_ROWS):
            b = min(a + BIT_ROWS, len(queries))
            part = slice(upto[a], upto[b])
            who, bits = np.repeat(np.arange(b - a), sizes[0][a:b]), np.zeros((b - a, width), np.uint8)
            place = np.arange(len(who)) - (upto[a:b] - upto[a])[who]
            for r in range(int(sizes[0][a:b].max(initial=0))):
                some = (place == r) & (number[mine[part]] < len(often))
                bits[who[some]] |= dense[number[mine[part][some]]]
            have = rare[part]
            ends = np.cumsum(have)
            if len(ends) and ends[-1]:
                to = rows[np.repeat(index.starts[mine[part]] - (ends - have), have) + np.arange(ends[-1])]
                np.bitwise_or.at(bits, (np.repeat(who, have), to >> 3), (128 >> (to & 7)).astype(np.uint8))
            count = np.bitwise_count(bits.view(np.uint64)).sum(axis=1, dtype=np.int64)
            q = np.flatnonzero(count)
            bits = bits[q]
            head, tail = (bits != 0).argmax(axis=1), width - 1 - (bits[:, ::-1] != 0).argmax(axis=1)
            each = np.arange(len(q))
            first = head * 8 + 7 - np.log2(bits[each, head]).astype(np.int64)
            low = bits[each, tail]
            last = tail * 8 + 7 - np.log2(low & (~low + 1)).astype(np.int64)
            found.append((q + a, count[q], at[first], at[last], table.ravel()[offset + bits].sum(axis=1)))
    q, count, first, last, total = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 5
    return pa.table({"s1_id": queries.column("s1_id").take(pa.array(q)), "n": pa.array(count), "first": ids.take(pa.array(first)), "last": ids.take(pa.array(last)), "checksum": pa.array(total)})


def dense_product(k: int, digits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Dot products of rows of one length (v array<double>), rounded; a row isn't paired with its own id."""

    def meet(queries: pa.Table, pool: pa.Table) -> pa.Table:
        if not len(queries) or not len(pool):
            return _found(queries.column("s1_id"), pool.column("cand_id"), [])
        rows = [np.asarray(t.column("v").combine_chunks().flatten()).reshape(len(t), -1) for t in (queries, pool)]
        mine, theirs, found = np.asarray(queries.column("s1_id")), np.asarray(pool.column("cand_id")), []
        order = np.argsort(np.argsort(theirs, kind="stable"), kind="stable")
        for a in range(0, len(queries), 256):
            scores = np.round(rows[0][a : a + 256] @ rows[1].T, digits)
            for q in range(len(scores)):
                some = np.flatnonzero(theirs != mine[a + q])
                top = best(scores[q][some], order[some], k)
                found.append((a + q, some[top], scores[q][some[top]]))
        return _found(queries.column("s1_id"), pool.column("cand_id"), found)

    return meet


#: Queries and postings of a run of ``ChannelRanks``, whose pairs are sorted as single numbers.
RANK_RUN, RANK_HELD = 1024, 250_000


def _bits(n: int) -> int:
    return int(n).bit_length()


class ChannelRanks:
    """Ranks of pairs in channels; rows have ``terms`` (channel:key), queries
    their ``weights`` too.  A channel's score of a pair is the sum of the weights
    of its common terms; greater scores come first, then smaller ids.  A rank is
    the number of pairs before its (score, block) and its place among the
    block's equals.  Where a key's pool is several blocks, they are ranges of
    its ids, and the pairs before come from ``counts``.  Pairs are sorted as
    numbers of 63 bits: a block of the pool has 2 ** 19 rows at most."""

    def __init__(self, names: list[str], shown: list[str], derive: Callable[[np.ndarray], dict[str, np.ndarray]] | None = None) -> None:
        """derive: columns in place of the ranks, from an array of them (-1: none) for each of ``shown``."""
        self.names, self.shown, self.derive = names, [names.index(c) for c in shown], derive

    def runs(self, queries: pa.Table, pool: pa.Table) -> Iterator[tuple]:
        """Of runs of queries, for the shown channels: (first query, entries,
        pairs, pairs of other channels).  An entry is a score of a query in a
        channel: its group (query of the run and channel), score and number of pairs, by (group, -score).
        Pairs are (query of the run, channel, place in the pool, entry, place among the entry's)."""
        (mine, theirs), sizes, n = _lists([queries, pool], "terms")
        terms = _words(queries.column("terms"))[0].dictionary_encode()
        channel = np.array([self.names.index(t.split(":", 1)[0]) for t in terms.dictionary.to_pylist()], np.int64)[terms.indices.to_numpy(zero_copy_only=False)]
        index, own, wide = Postings(theirs, sizes[1], n), _lists_of_numbers(queries, "weights"), len(self.names)
        who = np.repeat(np.arange(len(queries)), sizes[0])
        group, upto = who * wide + channel, np.concatenate([[0], np.cumsum(sizes[0])])
        met = index.counts[mine] > 0
        alone = np.bincount(group[met], minlength=len(queries) * wide)[group] == 1  # the pairs of such a group have one score
        ranked = np.isin(channel, self.shown)
        row_bits = _bits(len(pool))
        for a, b, term, at in index.batches(mine, sizes[0], RANK_HELD, RANK_RUN):
            one, rows = alone[term], index.rows[at]
            seen = ranked[term]
            other = (who[term[~seen]] - a, rows[~seen])
            lone = np.flatnonzero(seen & one)
            some = np.flatnonzero(met[upto[a] : upto[b]] & alone[upto[a] : upto[b]] & ranked[upto[a] : upto[b]]) + upto[a]
            entries = [(group[some] - a * wide, own[some], index.counts[mine[some]])]
            entry = np.zeros(upto[b] - upto[a], np.int64)
            entry[some - upto[a]] = np.arange(len(some))
            pairs = [(term[lone], rows[lone], entry[term[lone] - upto[a]], at[lone] - index.starts[mine[term[lone]]])]
            many = np.flatnonzero(seen & ~one)
            if len(many):
                bits = _bits(upto[b] - upto[a])
                t = term[many]
                key = np.sort((((group[t] - a * wide) << row_bits | rows[many]) << bits) | (t - upto[a]))
                t, key = (key & ((1 << bits) - 1)) + upto[a], key >> bits
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                score, t, key = np.add.reduceat(own[t], first), t[first], key[first]
                scores = np.unique(-score)
                g, c = key >> row_bits, key & ((1 << row_bits) - 1)
                bits = _bits(len(scores))
                key = np.sort(((g << bits | np.searchsorted(scores, -score)) << row_bits) | c)
                c, key = key & ((1 << row_bits) - 1), key >> row_bits
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                each = np.diff(first, append=len(key))
                entries.append((key[first] >> bits, -scores[key[first] & ((1 << bits) - 1)], each))
                pairs.append((key >> bits, c, np.repeat(np.arange(len(first)) + len(some), each), np.arange(len(key)) - np.repeat(first, each)))
            entries = [np.concatenate(x) for x in zip(*entries, strict=True)]
            order = np.argsort(entries[0], kind="stable")  # those of a group of several terms are by -score
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            pairs[0] = (group[pairs[0][0]] - a * wide, *pairs[0][1:])
            g, c, e, within = (np.concatenate(x) for x in zip(*pairs, strict=True))
            yield a, [x[order] for x in entries], (g // wide, g % wide, c, place[e], within), other

    def counts(self, queries: pa.Table, pool: pa.Table) -> Iterator[pa.Table]:
        """s1_id, p, channel, score and the block's pairs that have it."""
        for a, (g, score, n), _, _ in self.runs(queries, pool):
            q, channel = np.divmod(g, len(self.names))
            p = pool.column("p").take(pa.array(np.zeros(len(q), np.int64)))
            yield pa.table({"s1_id": queries.column("s1_id").take(pa.array(q + a)), "p": p, "channel": pa.array(channel), "score": pa.array(score), "n": pa.array(n)})

    def ranks(self, queries: pa.Table, pool: pa.Table) -> Iterator[pa.Table]:
        """s1_id, cand_id and the rank (from 0) in each of the shown channels, or
        what is derived from them.  Where blocks were counted, queries have
        ``before``, the pairs before each (channel, -score) of the block in this order."""
        pool = pool.take(pa.array(np.argsort(np.array(pool.column("cand_id").to_pylist(), object), kind="stable")))
        counted, done = "before" in queries.column_names, 0
        given = _lists_of_numbers(queries, "before") if counted else None
        row_bits, ids = _bits(len(pool)), [queries.column("s1_id").combine_chunks(), pool.column("cand_id").combine_chunks()]
        for a, (g, _, n), (q, channel, c, entry, within), other in self.runs(queries, pool):
            if counted:
                before = given[done : done + len(g)]
                done += len(g)
            else:
                before = np.cumsum(n) - n
                first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                before = before - np.repeat(before[first], np.diff(first, append=len(g)))
            rank = before[entry] + within
            bits = _bits(rank.max(initial=0))
            key = np.concatenate([((q << row_bits | c) << 3 | channel) << bits | rank, ((other[0] << row_bits | other[1]) << 3 | 7) << bits])
            key.sort()
            pair = key >> (bits + 3)
            new = np.concatenate([[True], pair[1:] != pair[:-1]])
            where, pair = np.cumsum(new) - 1, pair[new]
            channel, rank = (key >> bits) & 7, (key & ((1 << bits) - 1)).astype(np.int32)
            table = np.full((len(self.shown), len(pair)), -1, np.int32)
            for k, own in enumerate(self.shown):
                some = channel == own
                table[k, where[some]] = rank[some]
            found = self.derive(table) if self.derive else {self.names[k]: pa.array(x, mask=x < 0) for k, x in zip(self.shown, table, strict=True)}
            yield pa.table({"s1_id": ids[0].take(pa.array((pair >> row_bits) + a)), "cand_id": ids[1].take(pa.array(pair & ((1 << row_bits) - 1)))} | found)


def weighed(kinds: dict[str, float] | None = None) -> Callable:
    """For mapInArrow, records with ``terms`` (channel:key, repeats kept): the
    different terms of each, and as ``weights`` how often it has them, times its channel's in ``kinds``."""

    def run(batches):
        for batch in counted(batches):
            times = np.asarray(batch.column("tfs").flatten()).astype(float)
            if kinds:
                terms = batch.column("terms").flatten().dictionary_encode()
                times *= np.array([kinds[t.split(":", 1)[0]] for t in terms.dictionary.to_pylist()])[terms.indices.to_numpy(zero_copy_only=False)]
            lists = pa.ListArray.from_arrays(batch.column("terms").offsets, pa.array(times))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "weights"])

    return run


def texts_of_lists(pairs: int = 20_000) -> Callable[[pa.Table, pa.Table], Iterator[pa.Table]]:
    """Rows of queries (s1_id, name, address, cands: structs of c and label) and
    their candidates in the pool (cand_id, name, address), ``pairs`` and more at a time."""

    def meet(queries: pa.Table, pool: pa.Table) -> Iterator[pa.Table]:
        lists = queries.column("cands").combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
        who, (cand, label) = np.repeat(np.arange(len(queries)), sizes), flat.flatten()
        place = pc.index_in(cand, value_set=pool.column("cand_id").combine_chunks())
        for a in range(0, len(who), pairs):
            at = place.slice(a, pairs)
            some = np.flatnonzero(np.asarray(at.is_valid()))
            q, c = pa.array(who[a : a + pairs][some]), at.take(pa.array(some))
            left = {n: queries.column(m).take(q) for n, m in (("s1_id", "s1_id"), ("name1", "name"), ("addr1", "address"))}
            right = {n: pool.column(m).take(c) for n, m in (("cand_id", "cand_id"), ("name2", "name"), ("addr2", "address"))}
            yield pa.table(left | right | {"label": label.slice(a, pairs).take(pa.array(some))})

    return meet


def features_of_lists(names: list[str], pairs: int = 20_000) -> Callable[[pa.Table, pa.Table], Iterator[pa.Table]]:
    """Rows of queries (s1_id, fold, _held, name, address, cands: structs of c and
    label) and of the pool (cand_id, name, address) with what features of one
    record need (tokens, numbers: words joined by blanks; postal): the pairs
    with the features ``names``, of ``ARRAYS``."""

    def meet(queries: pa.Table, pool: pa.Table) -> Iterator[pa.Table]:
        lists = queries.column("cands").combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
        who, (cand, label) = np.repeat(np.arange(len(queries)), sizes), flat.flatten()
        place = pc.index_in(cand, value_set=pool.column("cand_id").combine_chunks())
        sets = {}
        for feature, column in (("token_jaccard_sim", "tokens"), ("number_overlap", "numbers")):
            if feature in names:
                (x, y), lengths, _ = _lists([queries, pool], column)
                sets[feature] = Sets(x, lengths[0], -1), Sets(y, lengths[1], -2)
        for a in range(0, len(who), pairs):
            at = place.slice(a, pairs)
            some = np.flatnonzero(np.asarray(at.is_valid()))
            q, c = who[a : a + pairs][some], np.asarray(at.take(pa.array(some))).astype(np.int64)
            found = {}
            (ones, i), (twos, j) = (np.unique(x, return_inverse=True) for x in (q, c))
            for p, column in (("name", "name"), ("addr", "address")):
                measures = [m for m in ("ratio", "jaro_winkler") if f"{p}_{m}" in names]
                if measures:
                    texts = [pc.fill_null(t.column(column), "").take(pa.array(x)).to_pylist() for t, x in ((queries, ones), (pool, twos))]
                    found |= {f"{p}_{m}": v for m, v in zip(measures, pair_measures(*texts, i, j, measures), strict=True)}
            for feature, (x, y) in sets.items():
                found[feature] = jaccards(x, y, q, c)
            q, c = pa.array(q), pa.array(c)
            if "postal_exact" in names:
                x, y = queries.column("postal").take(q), pool.column("postal").take(c)
                found["postal_exact"] = pc.and_(pc.not_equal(x, ""), pc.equal(x, y)).cast(pa.int8()).cast(pa.float64())
            ids = {"s1_id": queries.column("s1_id").take(q), "cand_id": pool.column("cand_id").take(c), "label": label.slice(a, pairs).take(pa.array(some))}
            yield pa.table(ids | {n: queries.column(n).take(q) for n in ("fold", "_held")} | {n: found[n] for n in names})

    return meet


#: Features of pairs that ``features_of_lists`` makes.
ARRAYS = ["name_ratio", "name_jaro_winkler", "addr_ratio", "addr_jaro_winkler", "token_jaccard_sim", "number_overlap", "postal_exact"]
