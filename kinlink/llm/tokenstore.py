"""Token ids in directly addressable codes (operator 9).

A shard holds the ids of some documents in doc_id order.  Every id is cut into
chunks of CHUNK_BITS bits, least first; level k holds chunk k of the ids that
have one, a bitmap telling which go on, and a rank directory, so that any id
is reached with one rank a level and no other id is decoded.  The store is
Parquet without compression or dictionaries, one shard a row group, so that a
shard's bytes lie in one piece: ``token_at`` reads a few ranges of the file.

Layout of a shard, little-endian: magic "DAC1", u32 levels, u64 ids; then for
each level u64 chunks, the chunks (u8), the bitmap (u64 words) and the
directory (u64 set bits before each block of BLOCK_WORDS words).

Defined results: null text is the empty text, which has the end id alone; a
null doc_id sorts first; repeated ids are separate documents, ordered by text;
empty tables give an empty store; further columns of the input aren't read.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import BatchEncoder, batched, word_encoder
from .common import quiet_tokenizer, text_or_empty, utf8_bytes

CHUNK_BITS, BLOCK_WORDS = 8, 8
#: Ids of a shard after which a new one begins, and text bytes of a partition.
SHARD_IDS, PARTITION_BYTES = 1 << 20, 24 << 20


class DirectlyAddressable:
    """Read access to the bytes of one shard."""

    def __init__(self, data: bytes):
        magic, levels, self.n = struct.unpack_from("<4sIQ", data)
        if magic != b"DAC1":
            raise ValueError("not a DAC1 shard")
        at, self.levels = 16, []
        for _ in range(levels):
            (m,) = struct.unpack_from("<Q", data, at)
            words = -(-m // 64)
            blocks = -(-words // BLOCK_WORDS) + 1
            chunks = np.frombuffer(data, np.uint8, m, at + 8)
            bits = np.frombuffer(data, "<u8", words, at + 8 + m)
            ranks = np.frombuffer(data, "<u8", blocks, at + 8 + m + 8 * words)
            self.levels.append((chunks, bits, ranks))
            at += 8 + m + 8 * (words + blocks)

    @staticmethod
    def pack(ids: np.ndarray) -> bytes:
        left, out = np.asarray(ids, dtype=np.uint64), []
        while len(left) or not out:
            more = left >> np.uint64(CHUNK_BITS)
            on = more > 0
            words = -(-len(left) // 64)
            bits = np.packbits(np.pad(on, (0, words * 64 - len(left))), bitorder="little").view("<u8")
            counts = np.pad(np.bitwise_count(bits).astype(np.uint64), (0, -words % BLOCK_WORDS))
            ranks = np.concatenate([[0], np.cumsum(counts.reshape(-1, BLOCK_WORDS).sum(1))]).astype("<u8")
            out.append(struct.pack("<Q", len(left)) + (left & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
            left = more[on]
        return struct.pack("<4sIQ", b"DAC1", len(out), len(ids)) + b"".join(out)

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before bit i."""
        w = i // 64
        first = w // BLOCK_WORDS * BLOCK_WORDS
        n = int(ranks[w // BLOCK_WORDS]) + int(np.bitwise_count(bits[first:w]).sum())
        return n + (int(bits[w]) & ((1 << i % 64) - 1)).bit_count() if i % 64 else n

    def __getitem__(self, i: int) -> int:
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (k * CHUNK_BITS)
            if not int(bits[i // 64]) >> (i % 64) & 1:
                break
            i = self._rank(bits, ranks, i)
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a to b, b excluded: at each level they are a range of chunks."""
        out, at = np.zeros(b - a, np.uint32), np.arange(b - a)
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            if a == b:
                break
            out[at] |= chunks[a:b].astype(np.uint32) << np.uint32(k * CHUNK_BITS)
            word = a // 64
            on = np.unpackbits(bits[word : -(-b // 64)].view(np.uint8), bitorder="little")[a - word * 64 : b - word * 64].astype(bool)
            at, first = at[on], self._rank(bits, ranks, a)
            a, b = first, first + len(at)
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> BatchEncoder:
    return word_encoder(quiet_tokenizer(path))


#: Shards up to which their offsets are broadcast.
SMALL_SHARDS = 100_000
STORE = "part int, seq int, n_ids long, first_id long, last_id long, doc_ids array<bigint>, lengths array<bigint>, data binary"
#: One row a row group, its bytes as they are.
PLAIN = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.block.size": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.page.size.row.check.min": "1"}


def write_store(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> None:
    """Write the shards of ``docs`` in ascending doc_id order below ``path``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    parts = max(1, -(-utf8_bytes(rows) // PARTITION_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        docs_: list[int | None] = []
        lengths: list[np.ndarray] = []

        def shard() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            numbers = [pa.array([x], pa.int64()) for x in (len(flat), docs_[0], docs_[-1])]
            cols = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), *numbers, pa.array([docs_], pa.list_(pa.int64())), pa.array([np.concatenate(lengths)], pa.list_(pa.int64())), pa.array([DirectlyAddressable.pack(flat)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["part", "seq", "n_ids", "first_id", "last_id", "doc_ids", "lengths", "data"])

        held = 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, b, flat, counts in batched(enc, batch.column(1).to_pylist()):
                docs_ += doc_ids[a:b]
                ids.append(np.insert(flat, np.cumsum(counts), end_id))
                lengths.append(counts + 1)
                held += len(ids[-1])
                if held >= SHARD_IDS:
                    yield shard()
                    ids, docs_, lengths, held, seq = [], [], [], 0, seq + 1
        if ids:
            yield shard()

    ordered.mapInArrow(run, STORE).write.options(**PLAIN).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``first``: ids in all shards before each.  Sums by
    partition go through one small window; shards, through one by partition."""
    store = spark.read.schema(STORE).parquet(path)
    sums = store.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    firsts = store.select("part", "seq", inside.alias("inside")).join(bases, "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("first"))
    small = firsts.limit(SMALL_SHARDS + 1).count() <= SMALL_SHARDS  # else the shards are shuffled
    return store.join(F.broadcast(firsts) if small else firsts, ["part", "seq"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the ids (little-endian u32 bytes), read from the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                doc_ids, lengths, first, data = (batch.column(c)[r].as_py() for c in ("doc_ids", "lengths", "first", "data"))
                store, ends = DirectlyAddressable(data), np.cumsum([0, *lengths])
                for a in range(0, len(doc_ids), 512):
                    some = range(a, min(a + 512, len(doc_ids)))
                    ids = [store.slice(int(ends[i]), int(ends[i + 1])).astype("<u4").tobytes() for i in some]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a : a + 512], pa.int64()), pa.array(first + ends[some.start : some.stop], pa.int64()), pa.array(lengths[a : a + 512], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return read_store(spark, path).select("doc_ids", "lengths", "first", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


class SharedFile(io.RawIOBase):
    """A file of any store that Spark reaches, read by ranges on the driver."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path(path)
        store = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.size, self.stream, self.jvm = store.getFileStatus(self.path).getLen(), store.open(self.path), jvm
        self.at = self.bytes_read = 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = to + (0, self.at, self.size)[whence]
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = max(0, min(n if n >= 0 else self.size, self.size - self.at))
        if not n:
            return b""
        self.stream.seek(self.at)
        data = bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(self.stream, n))
        self.at += n
        self.bytes_read += n
        return data

    def close(self) -> None:
        if not self.closed:
            self.stream.close()
        super().close()


def token_in(read, i: int) -> int:
    """Id i of a shard by ranges: read(first byte, bytes)."""
    _, levels, _ = struct.unpack("<4sIQ", read(0, 16))
    at, value = 16, 0
    for k in range(levels):
        (m,) = struct.unpack("<Q", read(at, 8))
        words = -(-m // 64)
        bits, ranks = at + 8 + m, at + 8 + m + 8 * words
        value |= read(at + 8 + i, 1)[0] << (k * CHUNK_BITS)
        block = i // 64 // BLOCK_WORDS
        before = i // 64 - block * BLOCK_WORDS
        near = np.frombuffer(read(bits + 64 * block, 8 * (before + 1)), "<u8")
        word = int(near[-1])
        if not word >> (i % 64) & 1:
            break
        (rank,) = struct.unpack("<Q", read(ranks + 8 * block, 8))
        i = rank + int(np.bitwise_count(near[:-1]).sum()) + (word & ((1 << i % 64) - 1)).bit_count()
        at = ranks + 8 * (-(-words // BLOCK_WORDS) + 1)
    return value


def token_at(spark: SparkSession, path: str, doc_id: int, i: int) -> int:
    """Id i of a document of the store, its end id included: the shard is found
    by the ids of its documents, and of its codes only the few bytes that hold
    the id are read.  Of equal doc_ids the first counts; IndexError where there is no such id."""
    store = spark.read.schema(STORE).parquet(path).where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    place = F.array_position("doc_ids", F.lit(doc_id).cast("long"))
    found = store.where(place > 0).select("part", "seq", F.slice("lengths", F.lit(1), place.cast("int")).alias("lengths"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).orderBy("part", "seq").limit(1).collect()
    if not found or not 0 <= i < found[0]["lengths"][-1]:
        raise IndexError(f"document {doc_id} has no id {i}")
    shard, i = found[0], i + sum(found[0]["lengths"][:-1])
    with SharedFile(spark, shard["file"]) as f:
        meta, row = pq.read_metadata(f), shard["row"]
        group = next(g for g in range(meta.num_row_groups) if (row := row - meta.row_group(g).num_rows) < 0)
        if meta.row_group(group).num_rows != 1:
            raise ValueError("a row group holds several shards")
        chunk = meta.row_group(group).column(meta.num_columns - 1)
        begin = chunk.data_page_offset

        def read(a: int, n: int) -> bytes:
            f.seek(first + a)
            return f.read(n)

        # Header of the page, levels and the length come before the codes.
        f.seek(begin)
        first = begin + f.read(256).index(b"DAC1")
        return token_in(read, i)


def checked(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids' bytes."""
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


__all__ = ["DirectlyAddressable", "checked", "read_documents", "read_store", "token_at", "write_store"]
