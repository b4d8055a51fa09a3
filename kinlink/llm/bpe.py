"""Byte-level BPE encoding and decoding (operator 3).

Each match of the split pattern is encoded by itself.  A segment tree over its
byte positions holds the least (rank, position) of the live pairs; a merge
takes the root, joins the pair at that position with its live neighbour and
renews the pairs that changed, each by an update from leaf to root.  Matches
of like lengths are merged together: their trees are the columns of one array,
and a step takes every column's root.

Defined results: null text is the empty text with no ids; empty tables give
empty tables; repeated rows and ties stay as they are; input columns other
than the text are passed through, except those named like an output.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import BatchEncoder, batched, pieces_of, ragged
from .common import appended

#: Matches whose trees are in one array, and the longest match that goes there.
COLUMNS, LONGEST = 8192, 64


class BytePairCodec:
    """Ranks by token bytes, as in a tiktoken rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.never = ranks, max(ranks.values(), default=0) + 1
        self.pattern = regex.compile(pattern)
        self.text = BatchEncoder(self._words, lambda t: (i for p in self.pattern.findall(t) for i in self.encode_piece(p)))
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = {(ranks[t[:k]], ranks[t[k:]]): i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        keys = np.array([a * self.never + b for a, b in pairs] or [-1], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(pairs.values()) or [self.never], np.int64)[order]
        size = np.zeros(self.never, np.int64)
        for t, i in ranks.items():
            size[i] = len(t)
        self.token_sizes, self.token_starts = size, np.cumsum(size) - size
        self.token_bytes = np.frombuffer(b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, or never."""
        key = a * self.never + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], self.never)

    def encode_piece(self, piece: str | bytes) -> tuple[int, ...]:
        """The ids of one match."""
        data = piece.encode() if isinstance(piece, str) else piece
        if (whole := self.ranks.get(data)) is not None:
            return (whole,)
        n = len(data)
        if not n:
            return ()
        return tuple(self._merged(np.frombuffer(data, np.uint8)[:, None], np.array([n]))[0].tolist())

    def _merged(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, counts) of matches: column k of ``data`` is match k's bytes, padded."""
        width, columns = data.shape
        size, never = 1, self.never
        while size < width:
            size *= 2
        bound = never * size  # a node holds rank * size + position: its minimum is the leftmost least rank
        token = self.byte_ids[data]
        tree = np.full((2 * size, columns), bound, np.int64)
        if width > 1:
            rows = np.arange(width - 1)[:, None]
            rank = self._pair(token[:-1], token[1:])
            tree[size : size + width - 1] = np.where((rows + 1 < sizes) & (rank < never), rank * size + rows, bound)
        for k in range(size - 1, 0, -1):
            np.minimum(tree[2 * k], tree[2 * k + 1], out=tree[k])
        end = np.repeat(np.arange(1, width + 2)[:, None], columns, 1)  # of the token that starts here
        before = np.repeat(np.arange(-1, width)[:, None], columns, 1)  # start of the live token to the left

        def renew(at: np.ndarray, column: np.ndarray, value: np.ndarray) -> None:
            node = at + size
            tree[node, column] = value
            while node[0] > 1:  # all leaves are at one depth
                node = node >> 1
                tree[node, column] = np.minimum(tree[2 * node, column], tree[2 * node + 1, column])

        live = np.flatnonzero(tree[1] < bound)
        while len(live):
            root = tree[1, live]
            i = root % size
            j = end[i, live]  # the right half of the pair
            k = end[j, live]
            end[i, live], token[i, live], token[j, live] = k, root // size, -1
            inner = k < sizes[live]
            after = np.full(len(live), bound)
            col, right = live[inner], k[inner]
            before[right, col] = i[inner]
            rank = self._pair(token[i[inner], col], token[right, col])
            after[inner] = np.where(rank < never, rank * size + i[inner], bound)
            renew(j, live, np.full(len(live), bound))
            renew(i, live, after)
            p = before[i, live]
            has = p >= 0
            if has.any():
                col, p = live[has], p[has]
                rank = self._pair(token[p, col], token[i[has], col])
                renew(p, col, np.where(rank < never, rank * size + p, bound))
            live = live[tree[1, live] < bound]
        token[np.arange(width)[:, None] >= sizes] = -1
        flat = token.T.ravel()
        kept = flat >= 0
        return flat[kept].astype(np.int32), kept.reshape(columns, width).sum(1)

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, counts) of the matches data[starts[k] : starts[k] + sizes[k]], none of them empty."""
        order = np.argsort(sizes, kind="stable")
        held: list[np.ndarray] = []
        counts = np.ones(len(sizes), np.int64)
        a, raw = 0, data.tobytes()
        while a < len(order):
            b = min(a + COLUMNS, len(order))
            wide = 1 << int(sizes[order[a]] - 1).bit_length()  # widths of one power of two
            b = a + int(np.searchsorted(sizes[order[a:b]], wide, "right"))
            if wide > LONGEST:
                b = a + 1
            some = order[a:b]
            width = int(sizes[some[-1]])
            at = np.minimum(starts[some] + np.arange(width)[:, None], len(data) - 1)
            ids, n = self._merged(data[at], sizes[some])
            # A match that is itself a token is that token, whatever its merges make.
            several = np.flatnonzero(n > 1)
            whole = [self.ranks.get(raw[s : s + w], -1) for s, w in zip(starts[some[several]].tolist(), sizes[some[several]].tolist(), strict=True)]
            if (tokens := np.array(whole, np.int64)).size and tokens.max() >= 0:
                first = np.cumsum(n) - n
                ids[first[several[tokens >= 0]]] = tokens[tokens >= 0]
                one = n.copy()
                one[several[tokens >= 0]] = 1
                ids, n = ragged(ids, first, one), one
            counts[some] = n
            held.append(ids)
            a = b
        flat = np.concatenate(held) if held else np.zeros(0, np.int32)
        begin = np.empty(len(sizes), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        return ragged(flat, begin, counts), counts

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, counts) of marked words: those of a blank and letters are one match."""
        words = words.cast(pa.large_string())
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        easy = pc.and_(pc.starts_with(words, " "), pc.utf8_is_alpha(pc.utf8_slice_codeunits(words, 1))).to_numpy(zero_copy_only=False)
        hard = np.flatnonzero(~easy)
        cut = [pieces_of(self.pattern, w) for w in words.take(pa.array(hard)).to_pylist()]
        pieces = pa.chunked_array([words.filter(pa.array(easy)), pa.array([p for x in cut for p in x], pa.large_string())]).combine_chunks()
        owner = np.concatenate([np.flatnonzero(easy), np.repeat(hard, [len(x) for x in cut])])
        _, offsets, data = pieces.buffers()
        edges = np.frombuffer(offsets, np.int64, len(pieces) + 1 + pieces.offset)[pieces.offset :]
        flat, counts = self.encode_pieces(np.frombuffer(data, np.uint8), edges[:-1], np.diff(edges))
        order = np.argsort(owner, kind="stable")
        total = np.bincount(owner, weights=counts, minlength=len(words)).astype(np.int64)
        return ragged(flat, (np.cumsum(counts) - counts)[order], counts[order]), total

    def encode(self, text: str) -> list[int]:
        return self.text.encode(text)

    def decode_flat(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each row of ids."""
        ends = np.cumsum(self.token_sizes[ids]) if len(ids) else np.zeros(0, np.int64)
        rows = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        parts = (ragged(self.token_bytes, self.token_starts[x], self.token_sizes[x]).tobytes() for x in np.split(ids, range(1 << 20, len(ids), 1 << 20)))
        data = b"".join(parts)
        return [data[a:b] for a, b in zip(rows, rows[1:], strict=False)]

    def decode(self, ids) -> bytes:
        ids = np.asarray(ids, np.int64)
        return self.decode_flat(ids, np.array([len(ids)]))[0]


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> BytePairCodec:
    """The codec of a rank file; one for each Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return BytePairCodec(ranks, pattern)


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", data: str | None = None) -> DataFrame:
    """Append ``ids`` array<int>: the token ids of the whole text; the text
    column stays.  data: in its place a binary column of that name, the bytes
    that the ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for full in batches:
            for a, b, flat, counts in batched(c.text, full.column(text).to_pylist()):
                batch, new = full.slice(a, b - a), {ids: pa.ListArray.from_arrays(_offsets(counts), pa.array(flat))}
                if data is not None:
                    batch, new = batch.drop_columns([text]), new | {data: pa.array(c.decode_flat(flat, counts), pa.binary())}
                yield appended(batch, new)

    kept = df.drop(ids) if data is None else df.drop(ids, data)
    fields = [f for f in kept.schema.fields if data is None or f.name != text]
    fields.append(T.StructField(ids, T.ArrayType(T.IntegerType())))
    if data is not None:
        fields.append(T.StructField(data, T.BinaryType()))
    return kept.mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """Append ``data`` binary: the bytes of the ids; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for full in batches:
            column = full.column(ids)
            counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
            yield appended(full, {data: pa.array(c.decode_flat(pc.list_flatten(column).to_numpy(), counts), pa.binary())})

    kept = df.drop(data)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(data, T.BinaryType())]))


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded and decoded rows."""
    numbers = F.array_join(F.col("ids").cast("array<string>"), " ")
    return df.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(numbers.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
