"""The corpus pipeline: documents -> packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.  All but the last return the
columns of ``documents``; texts that a stage shortens keep their other columns
(``n_chars`` describes the original).

1. quality   documents whose score is under 0.3 go (labels of the held-out fifth are never used)
2. lines     lines that more than six documents share (up to one edit from 24 characters on, equal below) stay
             only where they stand first; a document that loses its last word, or half of its characters, goes
3. near      one document of each group of near-duplicates stays (runs of five words, similarity 0.8)
4. leaks     documents that hold ten consecutive words of a benchmark item go
5. packing   the rest is encoded, joined and cut into sequences of 2048 ids

Null texts count as empty; rows without a doc_id, and rows that repeat one with
another text, are documents of their own; equal rows are one from stage 3 on;
extra columns stay; empty tables give empty results.  Tokenizers and trained models do not exist in SQL, so the stages are
tested against brute-force versions instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from carelens.llm import decontaminate, lines, minhash, packing, quality
from carelens.llm.queries import table, vocabulary
from carelens.session import checkpoint_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), least=0.3)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.remove_repeats(docs, edits=1, least_docs=7, drop_emptied=True, short=True, most_cut=0.5)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_first(docs, shingle=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10, remove="documents")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, vocabulary(), end_id=1, length=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality), ("lines", dedup_lines), ("near", dedup_documents), ("leaks", drop_leaks), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
