"""Language identification by compression (operator 10).

For each language a zstandard raw-content dictionary is taken from a bounded
sample of labelled texts.  A text is cut into chunks of CHUNK_BYTES bytes;
every chunk is compressed with each dictionary, and the language with the
smallest sum is chosen.  The score is the margin to the second: one less the
ratio of the two sums.  A text is rejected when its score is below MIN_SCORE
or it has no letters.

The sample is bounded: SAMPLE_DOCS rows of each of the LANGUAGES most frequent
labels, whole texts, those of up to SAMPLE_BYTES first and then by (hash,
doc_id), so it doesn't depend on partitioning.  Predictions read whole texts
and nothing but the text.

Defined results: null text, or text without letters, is ``und`` with score 0
and rejected; with no labelled texts every text is ``und``; equal sums go to
the language that sorts first; repeated rows are rows; further columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import appended

SAMPLE_DOCS, SAMPLE_BYTES, LANGUAGES, LEVEL, CHUNK_BYTES = 96, 2048, 256, 9, 1024
MIN_SCORE = 0.01
UNKNOWN = "und"


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionary content by language from the bounded sample of ``labelled``
    (columns doc_id, text, lang).  At most SAMPLE_DOCS rows of LANGUAGES languages reach the driver."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    first = rows.select(F.col(lang).alias("lang"), (F.octet_length(text) > SAMPLE_BYTES).alias("long"), F.xxhash64("doc_id").alias("h"), "doc_id", F.col(text).alias("text"))
    most = first.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang")
    order = Window.partitionBy("lang").orderBy("long", "h", "doc_id", "text")
    sample = first.join(F.broadcast(most), "lang", "left_semi").withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_DOCS)
    found: dict[str, list[tuple]] = {}
    for r in sample.select("lang", "n", "text").collect():
        found.setdefault(r["lang"], []).append((r["n"], r["text"]))
    return {k: "\n".join(t for _, t in sorted(v, reverse=True)).encode() for k, v in sorted(found.items())}


@lru_cache(maxsize=4)
def _compressors(model: tuple[tuple[str, bytes], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, content in model:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)))
    return out


def classify(text: str | None, model: tuple[tuple[str, bytes], ...]) -> tuple[str, float]:
    """The language and score of one text."""
    if not text or not model or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0
    data = text.encode()
    chunks = [data[a : a + CHUNK_BYTES] for a in range(0, len(data), CHUNK_BYTES)]
    sizes = sorted((sum(len(c.compress(x)) for x in chunks), lang) for lang, c in _compressors(model))
    return sizes[0][1], 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0


def predict(df: DataFrame, model: dict[str, bytes], text: str = "text") -> DataFrame:
    """Append lang_pred, score and rejected; columns of those names are replaced."""
    parts = tuple(sorted(model.items()))
    handle = df.sparkSession.sparkContext.broadcast(parts)  # bounded by the sample
    new = ["lang_pred", "score", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in batches:
            for a in range(0, full.num_rows, 512):
                batch = full.slice(a, 512)
                found = [classify(t, handle.value) for t in batch.column(text).to_pylist()]
                more = [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array([x == UNKNOWN or s < MIN_SCORE for x, s in found], pa.bool_())]
                yield appended(batch, dict(zip(new, more, strict=True)))

    kept = df.drop(*new)
    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *(T.StructField(n, k) for n, k in zip(new, kinds, strict=True))]))


def held_out(doc_id: Column) -> Column:
    """True for the fold that isn't learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
