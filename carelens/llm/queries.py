"""The registered queries of this package: one per operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from carelens.llm import (decontaminate, embeddings, filter_audit, lines, minhash, oracle_sql, packing, pieces, quality, substring, token_files,
                          toxicity, trie, url_filter)
from carelens.llm.shared import held_out, pick
from carelens.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file, by the package that installs it."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, vocabulary(), end_id=2)
    rows = token_files.read_token_files(spark, folder)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary(), end_id=1, length=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


@query("op9_decontamination", oracle_sql.OP9)
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="long", text="string")
    rows = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), window=10)
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return rows.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"),
                       F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
                       (F.size("hits") > 0).alias("contaminated"))


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality")
    return (quality.score(pick(docs, doc_id="long", text="string"), model)
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= 0.3).cast("int").alias("predicted")))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Domain rules of op1 (fixed values).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query("op1_url_filter")
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pick(table(spark, sf_dir, "pages"), page_id="long", url="string")
    rows = url_filter.judge(pages, RULES, url_filter.train(url_filter.labelled_urls(spark)))
    return rows.select("page_id", "host", "path", "rule", "verdict")


@query("op5_minhash_near_dedup", oracle_sql.OP5)
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


@query("op8_substring_dedup", oracle_sql.OP8)
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.remove_repeats(table(spark, sf_dir, "documents"), window=13)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_embedding_near_dedup", oracle_sql.OP3)
def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


@query("op4_line_dedup")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="long", text="string")
    docs = docs.withColumn("n_lines", F.size(F.split("text", "\n")).cast("long"))
    rows = lines.remove_repeats(docs, least_docs=1, short=True)
    left = F.when(F.col("text") == "", F.lit(0)).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return rows.select("doc_id", "n_lines", left.alias("n_left"), F.sha2("text", 256).alias("text_sha256"))


@query("op12_sentencepiece")
def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = vocabulary("piece_bpe_32k.model")
    rows = pieces.encode(table(spark, sf_dir, "documents"), model, decoded=True)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"),
                       F.sha2(F.concat("begins", "ends"), 256).alias("spans_sha256"))


@query("op13_filter_audit", oracle_sql.OP13)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


@query("op11_conversation_trie", oracle_sql.OP11)
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trie.shared_heads(trie.sequences(table(spark, sf_dir, "conversations")), every=20, most=4)
    return trie.prefixes(rows).drop("ended")
