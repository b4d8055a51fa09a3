"""Chroma audio fingerprints of a media column (operator 6).

A recording (WAV bytes) becomes frames of 12 pitch-class energies; filters
over an integral image of the frames give two bits each, FILTERS of them an
unsigned 32-bit integer for each frame.  Two recordings are aligned by the
histogram of the offsets between equal codes (their leading ALIGN_BITS bits);
the share of differing bits over the overlap tells whether they match, at the
fullest offset that passes.

Searches take the recordings whose id is divisible by QUERY_EVERY against all
rows.  Queries are dealt to blocks and rows to chunks of bounded bytes, and
every block meets every chunk in one task, where an inverted index from codes
to places in the block's queries makes the histograms; nothing reaches the
driver.  A row has all its matches as one list, the best first, so no table of
pairs is made; the lists of a group of copies still hold copies x queries entries.

Defined results: null, undecodable or too short recordings have no codes and
no match; a recording isn't matched with its own id; ties go to the smaller
query id, then the smaller offset; repeated ids are rows of their own; empty
tables give empty tables; further columns aren't read.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised

RATE, FRAME, HOP, CLASSES = 8000, 2048, 512, 12
LOWEST, HIGHEST = 65.0, 2000.0
#: Filters: kind, first pitch class, pitch classes, frames; by a rule.
FILTERS = [(k % 6, (5 * k) % 12 // 2, 3 + k % 4, 4 + (3 * k) % 12) for k in range(16)]
SPAN = max(f[3] for f in FILTERS)
THRESHOLD = 0.1
ALIGN_BITS, MIN_VOTES, MIN_OVERLAP, MAX_ERRORS = 20, 3, 16, 0.25
QUERY_EVERY = 100
#: Bytes of fingerprints in a block of queries and in a chunk of rows.
BLOCK_BYTES, CHUNK_BYTES = 2 << 20, 8 << 20
MATCHES = pa.list_(pa.struct([("errors", pa.float64()), ("id", pa.int64()), ("offset", pa.int64())]))


def read_wave(data: bytes | None) -> np.ndarray | None:
    """Mono samples at RATE of 8- or 16-bit PCM; None if the bytes aren't such."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            channels, width, rate, raw = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return None
    if width not in (1, 2) or not rate:
        return None
    x = np.frombuffer(raw[: len(raw) // (width * channels) * width * channels], "<i2" if width == 2 else np.uint8).astype(np.float64)
    x = (x if width == 2 else (x - 128) * 256).reshape(-1, channels).mean(1)
    return x if rate == RATE else np.interp(np.arange(0, len(x), rate / RATE), np.arange(len(x)), x) if len(x) else x


def _folding() -> np.ndarray:
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hz), CLASSES))
    used = np.flatnonzero((hz >= LOWEST) & (hz <= HIGHEST))
    out[used, np.round(12 * np.log2(hz[used] / 440)).astype(int) % CLASSES] = 1
    return out


FOLDING, HANN = _folding(), np.hanning(FRAME)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames of pitch-class energies, each of unit length (silence: zero)."""
    if len(samples) < FRAME:
        return np.zeros((0, CLASSES))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.empty((len(frames), CLASSES))
    for a in range(0, len(frames), 256):  # bounded memory for long recordings
        out[a : a + 256] = np.abs(np.fft.rfft(frames[a : a + 256] * HANN, axis=1)) ** 2 @ FOLDING
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-9)


def codes(frames: np.ndarray) -> np.ndarray:
    """Packed unsigned 32-bit integers, one for each position of the filters."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(frames) + 1, CLASSES + 1))
    total[1:, 1:] = frames.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return total[at + t1, y1] - total[at + t0, y1] - total[at + t1, y0] + total[at + t0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        whole, ym, tm = area(0, w, y, y + h), y + h // 2, w // 2
        if kind == 0:
            part = whole / 2 - h * w * 0.05
        elif kind == 1:
            part = area(0, w, y, ym)
        elif kind == 2:
            part = area(0, tm, y, y + h)
        elif kind == 3:
            part = area(0, tm, y, ym) + area(tm, w, ym, y + h)
        elif kind == 4:
            part = area(0, w, y + h // 3, y + h - h // 3)
        else:
            part = area(w // 3, w - w // 3, y, y + h)
        response = np.log((1 + np.maximum(part, 0)) / (1 + np.maximum(whole - part, 0)))
        level = (response > -THRESHOLD).astype(np.uint32) + (response > 0) + (response > THRESHOLD)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return out


def fingerprint(data: bytes | None) -> np.ndarray:
    samples = read_wave(data)
    return np.zeros(0, np.uint32) if samples is None else codes(chroma(samples))


class Searcher:
    """Alignment of one recording with a block of queries."""

    def __init__(self, queries: list[tuple[int, np.ndarray]]):
        self.queries = sorted(queries, key=lambda q: (q[0], q[1].tobytes()))
        keys = [c >> np.uint32(32 - ALIGN_BITS) for _, c in self.queries]
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint32)
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        place = np.concatenate([np.arange(len(k)) for k in keys]) if keys else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.keys, self.owner, self.place = flat[order], owner[order], place[order]

    def matches(self, id_: int | None, mine: np.ndarray) -> list[tuple[float, int, int]]:
        """(share of differing bits, query id, offset of this recording in the
        query) of every query that matches, the best first."""
        key = mine >> np.uint32(32 - ALIGN_BITS)
        a, b = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        n = b - a
        if not n.sum():
            return []
        at = np.arange(n.sum()) + np.repeat(a - np.cumsum(n) + n, n)
        wide = 1 << 32
        votes, counts = np.unique(self.owner[at] * wide + (self.place[at] - np.repeat(np.arange(len(mine)), n)) + wide // 2, return_counts=True)
        votes, counts = votes[counts >= MIN_VOTES], counts[counts >= MIN_VOTES]
        owner, offset = votes // wide, votes % wide - wide // 2
        order = np.lexsort((offset, -counts, owner))
        found, done = [], -1
        for k, o in zip(owner[order].tolist(), offset[order].tolist(), strict=True):
            q, theirs = self.queries[k]
            if k == done or q == id_:
                continue
            x, y = theirs[max(0, o) :], mine[max(0, -o) :]
            m = min(len(x), len(y))
            if m < MIN_OVERLAP:
                continue
            errors = float(np.bitwise_count(x[:m] ^ y[:m]).sum()) / (32 * m)
            if errors <= MAX_ERRORS:
                found.append((errors, q, o))
                done = k
        return sorted(found)

    def best(self, id_: int | None, mine: np.ndarray) -> tuple[int, int, float] | None:
        """(query id, offset, share of differing bits) of the best match."""
        found = self.matches(id_, mine)
        return (found[0][1], found[0][2], found[0][0]) if found else None


def fingerprints(recordings: DataFrame) -> DataFrame:
    """vec_id and codes (little-endian u32 bytes) of ``recordings`` (vec_id, audio)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in batches:
            for a in range(0, full.num_rows, 128):
                batch = full.slice(a, 128)
                found = [fingerprint(x.as_py()).astype("<u4").tobytes() for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["vec_id", "codes"])

    return recordings.select(F.col("vec_id").cast("long").alias("vec_id"), "audio").mapInArrow(run, "vec_id long, codes binary")


def search(prints: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """vec_id, n_codes, codes_crc32, the best match among the queries of
    ``prints`` (a written table): match_id, match_offset, match_errors; and all
    of them, the best first: n_matches, matches (errors, id, offset)."""
    rows = materialised(prints.withColumn("uid", F.monotonically_increasing_id()), "audio-prints")
    wanted = rows.where((F.col("vec_id") % QUERY_EVERY == 0) & (F.octet_length("codes") > 0))
    size = lambda d, each: max(1, -(-int(d.agg(F.sum(F.octet_length("codes").cast("long")).alias("n")).first()["n"] or 0) // each))
    blocks, chunks = size(wanted, block_bytes), max(size(rows, CHUNK_BYTES), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    deal = lambda d, n: F.pmod(F.xxhash64(F.lit(1), "uid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = wanted.select(F.col("vec_id").alias("query"), F.col("codes").alias("theirs"), deal(wanted, blocks).alias("block"), every(chunks).alias("chunk"))
    met = rows.where(F.octet_length("codes") > 0).select("uid", "vec_id", "codes", deal(rows, chunks).alias("chunk"), every(blocks).alias("block"))

    def meet(some: pa.Table, block: pa.Table) -> pa.Table:
        searcher = Searcher([(q, np.frombuffer(c, "<u4")) for q, c in zip(block.column("query").to_pylist(), block.column("theirs").to_pylist(), strict=True)])
        found = [(u, m) for u, i, c in zip(*(some.column(x).to_pylist() for x in ("uid", "vec_id", "codes")), strict=True) if (m := searcher.matches(i, np.frombuffer(c, "<u4")))]
        lists = pa.array([[dict(zip(("errors", "id", "offset"), x, strict=True)) for x in m] for _, m in found], MATCHES)
        return pa.table({"uid": pa.array([u for u, _ in found], pa.int64()), "part": lists})

    out = met.groupBy("chunk", "block").cogroup(queries.groupBy("chunk", "block")).applyInArrow(meet, "uid long, part array<struct<errors: double, id: bigint, offset: bigint>>")
    every = out.groupBy("uid").agg(F.array_sort(F.flatten(F.collect_list("part"))).alias("matches"))
    joined = rows.join(every, "uid", "left").withColumn("m", F.get("matches", F.lit(0)))
    best = [F.col("m.id").alias("match_id"), F.col("m.offset").alias("match_offset"), F.col("m.errors").alias("match_errors")]
    every = [F.coalesce(F.size("matches"), F.lit(0)).cast("long").alias("n_matches"), F.coalesce("matches", F.array().cast(out.schema["part"].dataType)).alias("matches")]
    return joined.select("vec_id", (F.octet_length("codes") / 4).cast("long").alias("n_codes"), F.crc32("codes").alias("codes_crc32"), *best, *every)


def synthesise(vector: list[float] | None, turn: int) -> bytes | None:
    """The tables hold no audio: a vector is played as notes of 0.1 s, from note ``turn`` on."""
    if not vector:
        return None
    v = np.roll(np.nan_to_num(np.array([0.0 if x is None else x for x in vector])), -turn)
    pitch = np.floor(v / (np.sqrt(np.mean(v**2)) + 1e-12) * 4).astype(int) % 24
    hz = np.repeat(220 * 2 ** (pitch / 12), RATE // 10)
    phase = np.cumsum(2 * np.pi * hz / RATE)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes((9000 * np.sin(phase) + 4000 * np.sin(2 * phase)).astype("<i2").tobytes())
    return out.getvalue()


def recordings(embeddings: DataFrame) -> DataFrame:
    """vec_id and audio of every row of ``embeddings``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in batches:
            for a in range(0, full.num_rows, 64):
                batch = full.slice(a, 64)
                ids, vectors = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([synthesise(v, (i or 0) % 8) for i, v in zip(ids, vectors, strict=True)], pa.binary())], names=["vec_id", "audio"])

    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, audio binary")


__all__ = ["Searcher", "chroma", "codes", "fingerprint", "fingerprints", "read_wave", "recordings", "search", "synthesise"]
