"""Removal of repeated substrings (operator 7): threshold-bounded interval
expansion on a Burrows-Wheeler transform.

A byte goes if a string of LENGTH bytes that covers it also starts in a
document with a smaller doc_id.  Strings are judged on the input.

1. Every string of LENGTH bytes has an anchor: the least hash of the strings
   of GRAM bytes inside it.  Anchors that two documents have are found by a
   shuffle of anchors alone (``_shared``); nothing else can repeat.
2. Documents, dealt by a hash of doc_id and text, cut out the segments between changes
   of such an anchor: equal strings of LENGTH bytes lie in segments of equal
   anchors.  Equal segments of a deal are sent once, with the least and
   greatest doc_id, to the shard of their anchor (``_segments``).
3. A shard builds the Burrows-Wheeler transform of its segments, sorted by
   LENGTH bytes at least, and expands intervals breadth first: those of cw
   follow from those of w.  A boundary first met by a string of length l + 1
   has the common prefix l, so values come in increasing order, and the
   expansion stops at LENGTH.  What is between the boundaries left is one
   string; its least doc_id goes back to the deals (``_answers``).
4. Documents look their segments up and cut (``dedup``).

A passage that a third of all documents hold is one row for each deal in step
3, and no task holds more than a deal of documents or a shard of segments.

Defined results: null text is the empty text; texts under LENGTH bytes lose
nothing; rows with the same doc_id don't remove from each other; a null doc_id
counts as the greatest; of exact copies the least doc_id stays whole; empty
tables give empty tables; the input's other columns are passed through, except
``spans`` and ``kept``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import utf8_bytes

LENGTH, GRAM = 50, 16
#: Text bytes of a deal, of an anchor bucket and of a shard of segments, and
#: the bytes that are indexed at a time.
DEAL_BYTES, BUCKET_BYTES, SHARD_BYTES, INDEX_BYTES = 6 << 20, 12 << 20, 4 << 20, 1 << 20
FLUSH_BYTES = 12 << 20
LAST = np.iinfo(np.int64).max
#: Anchors have 48 bits: two that are equal by chance only cost work.
MASK, ANCHOR_BYTES = np.uint64((1 << 48) - 1), 6


def packed(values: np.ndarray) -> bytes:
    """Anchors as bytes."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :ANCHOR_BYTES].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // ANCHOR_BYTES, 8), np.uint8)
    out[:, :ANCHOR_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, ANCHOR_BYTES)
    return out.reshape(-1).view("<u8")


def squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def joined(column: pa.ChunkedArray, squeezed_: bool = True) -> bytes:
    """The bytes of all rows of a column, one after the other."""
    if not squeezed_:
        return b"".join(column.to_pylist())
    back = zstandard.ZstdDecompressor()
    return b"".join(back.decompress(x) for x in column.to_pylist())


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each position, the anchor of the string of ``length`` bytes there."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, power, size = np.frombuffer(data, np.uint8).astype(np.uint64), np.uint64(0x9E3779B97F4A7C15), 1
    while size < gram:  # gram is a power of two
        h = h[:-size] * power + h[size:]
        power, size = np.uint64(int(power) ** 2 & (2**64 - 1)), 2 * size
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h &= MASK
    width, want = 1, length - gram + 1
    while 2 * width <= want:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (want - width)], h[want - width :]) if want > width else h


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of equal values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(values)]])


def _sorted_places(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in ascending order of ``key``, the key at each), for keys of ``bits`` bits.

    Where a key and a place fit one word, words are sorted instead of places."""
    width = len(key).bit_length()
    if bits + width > 64:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    words = np.sort((key << np.uint64(width)) | np.arange(len(key), dtype=np.uint64))
    return (words & np.uint64((1 << width) - 1)).astype(np.int64), words >> np.uint64(width)


def bounded_suffix_order(symbols: np.ndarray, length: int) -> np.ndarray:
    """Cyclic positions sorted by their next ``length`` symbols at least (symbols under 512)."""
    key, size = symbols.astype(np.uint64), 1
    while size < 4 and size < length:
        key = (key << np.uint64(9 * size)) | np.roll(key, -size)
        size *= 2
    order, ascending = _sorted_places(key, 9 * size)
    width = len(key).bit_length()
    while size < length:
        rank = np.empty(len(key), np.uint64)
        rank[order] = np.cumsum(np.concatenate([[False], ascending[1:] != ascending[:-1]])).astype(np.uint64)
        if int(rank[order[-1]]) == len(key) - 1:
            return order
        if 2 * width <= 64:
            key = (rank << np.uint64(width)) | np.roll(rank, -size)
        else:
            key = rank * np.uint64(len(key)) + np.roll(rank, -size)
        order, ascending = _sorted_places(key, 2 * width)
        size *= 2
    return order


def prefix_classes(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, class): positions in suffix order, and the class of each, equal
    for positions whose next ``length`` symbols are equal.  Symbol 0 is the
    separator; positions with one among those symbols may share a class."""
    n = len(symbols)
    order = bounded_suffix_order(symbols, length)
    bwt = symbols[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")  # the row that step i of the last-to-first map comes from
    first = np.empty(n, np.int64)  # last-to-first map
    first[by_symbol] = np.arange(n)
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    after, before = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    low, high = np.array([0]), np.array([n])
    for l in range(length):  # common prefixes of l symbols are met in this round  # noqa: E741
        width = high - low
        ends_at = np.cumsum(width)
        at = np.arange(ends_at[-1] if len(width) else 0) + np.repeat(low - ends_at + width, width)
        begins, stops = before[at] < np.repeat(low, width), after[at] >= np.repeat(high, width)
        if l:
            text = bwt[at] > 0
            begins &= text
            stops &= text
        starts, ends = np.sort(first[at[begins]]), np.sort(first[at[stops]]) + 1
        new = ~known[ends]
        low, high = starts[new], ends[new]
        known[high] = True
        if not len(low):
            break
    return order, np.cumsum(known[:n]) - 1


def least_documents(segments: list[bytes], docs: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each segment and each string of ``length`` bytes in it, the least of
    ``docs`` among all segments that hold that string."""
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    symbols = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    ends = np.cumsum(lengths + 1)
    symbols[ends - 1] = 0
    order, group = prefix_classes(symbols, length)
    starts = ends - lengths - 1
    counts = np.maximum(lengths - length + 1, 0)
    owner = np.full(len(symbols), LAST, np.int64)
    whole = np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)
    owner[whole] = np.repeat(docs, counts)
    least = np.minimum.reduceat(owner[order], np.flatnonzero(np.diff(group, prepend=-1)))
    found = np.empty(len(symbols), np.int64)
    found[order] = least[group]
    return np.split(found[whole], np.cumsum(counts)[:-1])


def _numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array([LAST if x is None else x for x in column.to_pylist()], np.int64)


def _members(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """True where a value is in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _shared(rows: DataFrame, buckets: int) -> DataFrame:
    """(deal, found binary): the anchors of a deal that two documents have, in parts."""

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values: list[np.ndarray] = []
        deals: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            v, d = np.concatenate(values), np.concatenate(deals)
            order = np.lexsort((v, d))
            v, d = v[order], d[order]
            equal = np.concatenate([[False], (v[1:] == v[:-1]) & (d[1:] == d[:-1])])
            third = np.concatenate([[False], equal[1:] & equal[:-1]])
            v, d = v[~third], d[~third]  # twice stands for twice or more
            bucket = (v % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            b, cut = np.unique(bucket[order], return_index=True)
            parts = [(packed(v[x]), squeezed(d[x].astype("<i4").tobytes())) for x in np.split(order, cut[1:])]
            return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array([x for x, _ in parts], pa.binary()), pa.array([x for _, x in parts], pa.binary())], names=["bucket", "v", "d"])

        held = 0
        for full in batches:
            for a in range(0, full.num_rows, 512):
                batch = full.slice(a, 512)
                for deal, text in zip(batch.column("deal").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    found = np.unique(anchors(text))
                    if len(found):
                        values.append(found)
                        deals.append(np.full(len(found), deal, np.int32))
                        held += len(text)
                if held >= FLUSH_BYTES:
                    yield flush()
                    values, deals, held = [], [], 0
        if values:
            yield flush()

    def meet(group: pa.Table) -> pa.Table:
        v = unpacked(joined(group.column("v"), False))
        d = np.frombuffer(joined(group.column("d")), "<i4")
        order = np.lexsort((d, v))
        v, d = v[order], d[order]
        next_ = v[1:] == v[:-1]
        twice = np.concatenate([[False], next_]) | np.concatenate([next_, [False]])
        v, d = v[twice], d[twice]
        once = np.concatenate([[True], (v[1:] != v[:-1]) | (d[1:] != d[:-1])]) if len(v) else np.zeros(0, bool)
        v, d = v[once], d[once]
        order = np.argsort(d, kind="stable")
        deals, cut = np.unique(d[order], return_index=True)
        return pa.table({"deal": pa.array(deals, pa.int32()), "found": pa.array([packed(v[x]) for x in np.split(order, cut[1:])] if len(deals) else [], pa.binary())})

    noted = rows.select("deal", "data").mapInArrow(note, "bucket int, v binary, d binary")
    return noted.groupBy("bucket").applyInArrow(meet, "deal int, found binary")


def _cut(data: bytes, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchors, starts, ends) of the segments of a document whose anchor is known."""
    values = anchors(data)
    a, b = runs(values)
    held = _members(values[a], known)
    return values[a][held], a[held], b[held] + LENGTH - 1


def _segments(rows: DataFrame, shared: DataFrame, shards: int) -> DataFrame:
    """(shard, deal, v, lengths, least, greatest, data): the distinct segments of a deal by shard."""

    def cut(docs: pa.Table, found: pa.Table) -> pa.Table:
        known = np.unique(unpacked(joined(found.column("found"), False)))
        seen: dict[bytes, list[int]] = {}
        if len(known):
            ids = _numbers(docs.column("doc_id"))
            for doc, text in zip(ids.tolist(), docs.column("data"), strict=True):
                data = text.as_py()
                for v, a, b in zip(*(x.tolist() for x in _cut(data, known)), strict=True):
                    s = data[a:b]
                    old = seen.get(s)
                    if old is None:
                        seen[s] = [v, doc, doc]
                    elif doc < old[1]:
                        old[1] = doc
                    elif doc > old[2]:
                        old[2] = doc
        names = ["shard", "deal", "v", "lengths", "least", "greatest", "data"]
        if not seen:
            return pa.table({n: pa.array([], t) for n, t in zip(names, [pa.int32()] * 2 + [pa.binary()] * 5, strict=True)})
        keys = list(seen)
        numbers = np.array(list(seen.values()), np.int64)
        v = numbers[:, 0].astype(np.uint64)
        shard = ((v >> np.uint64(12)) % np.uint64(shards)).astype(np.int32)
        order = np.lexsort((v, shard))
        each, first = np.unique(shard[order], return_index=True)
        parts = np.split(order, first[1:])
        deal = docs.column("deal")[0].as_py()
        pack = lambda f: pa.array([f(x) for x in parts], pa.binary())
        columns = [pack(lambda x: packed(v[x])), pack(lambda x: squeezed(np.array([len(keys[i]) for i in x], "<i4").tobytes())), *(pack(lambda x, k=k: squeezed(numbers[x, k].astype("<i8").tobytes())) for k in (1, 2)), pack(lambda x: squeezed(b"".join(keys[i] for i in x)))]
        return pa.table([pa.array(each, pa.int32()), pa.array([deal] * len(each), pa.int32()), *columns], names=names)

    out = "shard int, deal int, v binary, lengths binary, least binary, greatest binary, data binary"
    return rows.groupBy("deal").cogroup(shared.groupBy("deal")).applyInArrow(cut, out)


def _answers(segments: DataFrame) -> DataFrame:
    """(deal, v, key, sizes, widths, docs): by segment of a deal that loses
    something, its digest and the runs of least doc_ids over its strings."""

    def index(group: pa.Table) -> pa.Table:
        v, lengths = unpacked(joined(group.column("v"), False)), np.frombuffer(joined(group.column("lengths")), "<i4").astype(np.int64)
        least, greatest = (np.frombuffer(joined(group.column(c)), "<i8") for c in ("least", "greatest"))
        deals = np.repeat(_numbers(group.column("deal")), [len(x) // ANCHOR_BYTES for x in group.column("v").to_pylist()])
        ends = np.cumsum(lengths)
        data = joined(group.column("data"))
        distinct: dict[bytes, int] = {}
        of, anchor, low = np.empty(len(v), np.int64), [], []
        for i, (a, b) in enumerate(zip((ends - lengths).tolist(), ends.tolist(), strict=True)):
            s = data[a:b]
            k = distinct.setdefault(s, len(distinct))
            of[i] = k
            if k == len(low):
                anchor.append(v[i])
                low.append(least[i])
            elif least[i] < low[k]:
                low[k] = least[i]
        keys, low, anchor = list(distinct), np.array(low, np.int64), np.array(anchor, np.uint64)
        answer: list[np.ndarray] = [None] * len(keys)  # type: ignore[list-item]
        order = np.argsort(anchor, kind="stable")
        # The strings of an anchor's only segment are in no other segment: their
        # least document is the segment's, which the index would give as well.
        near = anchor[order][1:] == anchor[order][:-1]
        alone = ~np.concatenate([[False], near]) & ~np.concatenate([near, [False]])
        for i in order[alone].tolist():
            answer[i] = np.full(len(keys[i]) - LENGTH + 1, low[i])
        order = order[~alone]
        sizes = np.array([len(keys[i]) for i in order], np.int64)
        a = 0
        while a < len(order):  # whole anchors, about INDEX_BYTES at a time
            b = a + max(1, int(np.searchsorted(np.cumsum(sizes[a:]), INDEX_BYTES)))
            while b < len(order) and anchor[order[b]] == anchor[order[b - 1]]:
                b += 1
            some = order[a:b]
            for i, x in zip(some.tolist(), least_documents([keys[i] for i in some], low[some]), strict=True):
                answer[i] = x
            a = b
        floor = np.array([x.min() for x in answer], np.int64)
        live = np.flatnonzero(floor[of] < greatest)
        replies: dict[int, list] = {}
        short = [None] * len(keys)
        for i in live.tolist():
            k = int(of[i])
            if short[k] is None:
                x = answer[k]
                s, e = runs(x)
                short[k] = (int(anchor[k]).to_bytes(ANCHOR_BYTES, "little"), xxhash.xxh128_digest(keys[k]), len(s), (e - s).astype("<i4").tobytes(), x[s].astype("<i8").tobytes())
            replies.setdefault(int(deals[i]), []).append(short[k])
        rows_ = [(d, *(b"".join(r[j] for r in x) for j in (0, 1)), *map(squeezed, (np.array([r[2] for r in x], "<i4").tobytes(), *(b"".join(r[j] for r in x) for j in (3, 4))))) for d, x in replies.items()]
        names, kinds = ["deal", "v", "key", "sizes", "widths", "docs"], [pa.int32()] + [pa.binary()] * 5
        return pa.table({n: pa.array([r[j] for r in rows_], t) for j, (n, t) in enumerate(zip(names, kinds, strict=True))})

    return segments.groupBy("shard").applyInArrow(index, "deal int, v binary, key binary, sizes binary, widths binary, docs binary")


def _whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the characters that they cover in part."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b < len(data) and b > a and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def dedup(docs: DataFrame, text: str = "text", whole_characters: bool = False) -> DataFrame:
    """Append spans (array of start and end bytes removed) and kept (the bytes
    left) to ``docs``.  whole_characters: keep a character that a span covers
    in part, so that what is left is UTF-8."""
    size = utf8_bytes(docs, text)
    count = lambda each: max(1, -(-size // each))
    base = docs.drop("spans", "kept")
    others = [f for f in base.schema.fields if f.name != text]
    passed = F.struct(*(F.col(f"`{f.name}`") for f in others)) if others else F.lit(None).cast("struct<none:string>")
    deal = F.pmod(F.xxhash64("doc_id", text), F.lit(count(DEAL_BYTES))).cast("int")
    rows = base.select(passed.alias("passed"), F.col("doc_id").cast("long").alias("doc_id"), deal.alias("deal"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    answers = _answers(_segments(rows, _shared(rows, count(BUCKET_BYTES)), count(SHARD_BYTES)))

    def apply(group: pa.Table, found: pa.Table) -> pa.Table:
        cat = {c: joined(found.column(c), c not in ("v", "key")) for c in ("v", "key", "sizes", "widths", "docs")}
        known = np.unique(unpacked(cat["v"]))
        sizes, widths, least = np.frombuffer(cat["sizes"], "<i4"), np.frombuffer(cat["widths"], "<i4"), np.frombuffer(cat["docs"], "<i8")
        to = np.cumsum(sizes).tolist()
        place = {cat["key"][16 * i : 16 * i + 16]: i for i in range(len(sizes))}
        spans, kept = [], []
        for doc, value in zip(_numbers(group.column("doc_id")).tolist(), group.column("data"), strict=True):
            data = value.as_py()
            gone = np.zeros(max(0, len(data) - LENGTH + 1) + 1, bool)
            if place:
                for _, a, b in zip(*(x.tolist() for x in _cut(data, known)), strict=True):
                    i = place.get(xxhash.xxh128_digest(data[a:b]))
                    if i is not None:
                        j, k = to[i] - sizes[i], to[i]
                        gone[a : b - LENGTH + 1] = np.repeat(least[j:k] < doc, widths[j:k])
            a, b = runs(gone)
            mine: list[tuple[int, int]] = []
            for s, e in zip(a[gone[a]].tolist(), b[gone[a]].tolist(), strict=True):
                if mine and s <= mine[-1][1]:
                    mine[-1] = (mine[-1][0], e + LENGTH - 1)
                else:
                    mine.append((s, e + LENGTH - 1))
            if whole_characters:
                mine = _whole_characters(data, mine)
            at, left = 0, []
            for s, e in mine:
                left.append(data[at:s])
                at = e
            left.append(data[at:])
            kept.append(b"".join(left))
            spans.append([{"start": s, "end": e} for s, e in mine])
        out = group.select(["passed"])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return out.append_column("spans", pa.array(spans, kind)).append_column("kept", pa.array(kept, pa.binary()))

    schema = T.StructType([rows.schema["passed"], T.StructField("spans", T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in ("start", "end")]))), T.StructField("kept", T.BinaryType())])
    cut = rows.groupBy("deal").cogroup(answers.groupBy("deal")).applyInArrow(apply, schema)
    return cut.select(*(F.col(f"passed.`{f.name}`").alias(f.name) for f in others), "spans", "kept")


def digests(cut: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    left = F.octet_length("kept").cast("long")
    return cut.select("doc_id", (left + removed).alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
