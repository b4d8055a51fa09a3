"""Sequence packing (operator 8).

Documents are dealt to tasks and put in order by a seeded hash; a task cuts
its documents into groups of about GROUP_TOKENS tokens.  A document's ids and
its end id are cut at multiples of the sequence length; in each group the
pieces are packed by first-fit decreasing.  A tournament tree over the bins
keeps the greatest free capacity below each node; the leftmost bin that a
piece fits is found by one walk from the root.  Texts cross the network once,
and ids never do: they are made where they are packed.

Defined results: null text is the empty text (the end id alone); repeated
doc_ids are separate documents with the same doc_id; ties in length go by the
order of their documents; a null doc_id is an id like any other; empty tables
give no pieces; further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import BatchEncoder, batched, byte_level_encoder
from .common import quiet_tokenizer, text_or_empty, utf8_bytes

SEQUENCE, GROUP_TOKENS, SEED = 1024, 4 << 20, 17
#: Text bytes of a task; bits of a sequence_id below the task's number.
PARTITION_BYTES, BINS_BITS = 24 << 20, 40


class Tournament:
    """Free capacities of bins in order; each node keeps the most below it."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1
        while self.size < max(1, bins):
            self.size *= 2
        self.most = [capacity] * (2 * self.size)

    def place(self, length: int) -> tuple[int, int]:
        """Put a piece into the leftmost bin that fits; the bin and its free capacity before."""
        most, k = self.most, 1
        while k < self.size:
            k *= 2
            if most[k] < length:
                k += 1
        free = most[k]
        bin_, most[k] = k - self.size, free - length
        while k > 1:
            k //= 2
            top = max(most[2 * k], most[2 * k + 1])
            if most[k] == top:
                break
            most[k] = top
        return bin_, free


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; equal lengths keep their order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int((lengths == capacity).sum())  # each has a bin of its own, the first ones
    bins[order[:full]] = np.arange(full)
    tree = Tournament(len(lengths) - full, capacity)
    for i in order[full:].tolist():
        bin_, free = tree.place(int(lengths[i]))
        bins[i], offsets[i] = full + bin_, capacity - free
    return bins, offsets


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> BatchEncoder:
    return byte_level_encoder(quiet_tokenizer(path), regex.compile(pattern))


def packed_group(doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray, sequence: int, first: int) -> tuple[pa.RecordBatch, int]:
    """The pieces of a group of documents in sequences from number ``first`` on,
    and the number of sequences.  ids: of all documents, one after the other."""
    n = -(-counts // sequence)
    doc = np.repeat(np.arange(len(counts)), n)
    start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * sequence
    length = np.minimum(counts[doc] - start, sequence)
    bins, offsets = first_fit_decreasing(length, sequence)
    at = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * 4)
    data = pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, at.buffers()[1], pa.py_buffer(ids.astype("<u4").tobytes())])
    names = pa.array(doc_ids, pa.int64()).take(pa.array(doc))
    columns = [names, *(pa.array(x, pa.int64()) for x in (start, length, counts[doc])), data, pa.array(bins + first, pa.int64()), pa.array(offsets, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]), int(bins.max(initial=-1)) + 1


def pack(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 0, sequence: int = SEQUENCE, group_tokens: int = GROUP_TOKENS, seed: int = SEED) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (little-endian
    u32 bytes), and where it lies: sequence_id and offset."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    parts = max(1, -(-utf8_bytes(rows) // PARTITION_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text")).repartition(parts, "h").sortWithinPartitions("h", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base, bins = encoder(tokenizer, pattern), TaskContext.get().partitionId() << BINS_BITS, 0
        names: list[int | None] = []
        flat: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        held = 0
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for a, b, ids, counts in batched(enc, batch.column("text").to_pylist()):
                names += doc_ids[a:b]
                flat.append(np.insert(ids, np.cumsum(counts), end_id))
                lengths.append(counts + 1)
                held += len(flat[-1])
                if held >= group_tokens:
                    out, n = packed_group(names, np.concatenate(flat), np.concatenate(lengths), sequence, base + bins)
                    yield out
                    bins, names, flat, lengths, held = bins + n, [], [], [], 0
        if names:
            yield packed_group(names, np.concatenate(flat), np.concatenate(lengths), sequence, base + bins)[0]

    return dealt.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long")


def checked(packed: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids' bytes in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
