"""The training-data pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  ``run`` writes every stage to the
shared folder and reads it again for the next.  A stage's temporary tables are
deleted when the next stage begins, so its result must be written by then.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm import langid, packing, quality, queries, shingles, substrings
from kinlink.llm.common import discard, materialised, staged, table

#: Words of a near-duplicate's shingle; texts decide (shingles.SIMILAR).
SHINGLE = 5


def _stage(run):
    """A stage whose temporary tables go when the next stage begins: its result
    is written by then.  Tables that the next stage's input reads stay."""

    @functools.wraps(run)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, getattr(spark, "_kinlink_stage_tables", []), docs)
        before = len(staged(spark))
        out = run(spark, docs, sf_dir)
        spark._kinlink_stage_tables = staged(spark)[before:]
        return out

    return stage


def _rows(docs: DataFrame, *names: str) -> DataFrame:
    """All columns as ``_row`` beside those that an operator reads, so that no
    name of the input meets a name of the operator."""
    return docs.select(F.struct("*").alias("_row"), *names)


def _unpacked(rows: DataFrame, names: list[str], new: dict | None = None) -> DataFrame:
    """The columns ``names`` of ``_row``, or of ``new`` where it has one."""
    return rows.select(*((new[c] if new and c in new else F.col(f"_row.`{c}`")).alias(c) for c in names))


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the language classifier rejects."""
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return _unpacked(langid.predict(_rows(docs, "text"), model).where(~F.col("rejected")), docs.columns)


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject."""
    counted = quality.with_counts(_rows(docs, "text", "lang", "source")).drop("text")
    return _unpacked(quality.assess(materialised(counted, "quality-counts")).where("kept"), docs.columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: the least doc_id."""
    return shingles.one_of_each(docs, "doc_id", "text", SHINGLE)


@_stage
def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that a document of smaller doc_id has; n_chars follows."""
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))  # the text is sent once
    cut = substrings.dedup(docs.select(others.alias("_row"), "doc_id", "text"), whole_characters=True)
    text = F.decode("kept", "UTF-8")
    return _unpacked(cut, docs.columns, {"text": text, "n_chars": F.length(text).cast("long")})


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return packing.checked(packing.pack(docs, queries.PIECES, queries.PATTERN, end_id=0))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_substrings", repeated_substrings),
    ("packing", pack),
]

#: Classifier, robust estimates and tokenizer aren't SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialised(docs, name)
            discard(spark, written, docs)
            written = staged(spark)[-1:]
    return docs
