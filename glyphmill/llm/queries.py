"""The registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, extract, fingerprint, minhash, mixing, quality, repeats, secrets, toxicity
from .common import table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_probe(table(spark, sf_dir, "conversations"))
    return chat.digest(chat.format_chats(turns.withColumn("content", chat.text_part(turns["text"]))))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.digest(toxicity.score_toxicity(docs, model))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels")))


def op9_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.digest(extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {
    f.__name__: f
    for f in (op1_near_duplicates, op2_fingerprint, op3_decontaminate, op4_chat_format, op5_quality, op6_toxicity, op7_secret_scan, op8_mix_sources, op9_extract, op10_repeats)
}
ORACLES = {"op4_chat_format": chat.ORACLE, "op8_mix_sources": mixing.ORACLE}
