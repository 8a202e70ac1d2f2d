"""One registered query per training-data operator, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, ctw, decontaminate, languages, lines, negatives, orcids, packing, phrases, quality, simhash, warc, wordpiece


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(_table(spark, sf_dir, "documents"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(_table(spark, sf_dir, "documents"))


def op3_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(_table(spark, sf_dir, "pages"))


def op6_wordpiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(_table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_report(_table(spark, sf_dir, "conversations"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op10_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orcids.orc_round_trip(_table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.document_languages(_table(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_ctw": op1_ctw,
    "op2_lines": op2_lines,
    "op3_leaks": op3_leaks,
    "op4_quality": op4_quality,
    "op5_warc": op5_warc,
    "op6_wordpiece": op6_wordpiece,
    "op7_chat": op7_chat,
    "op8_simhash": op8_simhash,
    "op9_packing": op9_packing,
    "op10_orc": op10_orc,
    "op11_phrases": op11_phrases,
    "op12_languages": op12_languages,
    "op13_negatives": op13_negatives,
}
ORACLE: dict[str, str] = {"op2_lines": lines.REPORT_SQL, "op4_quality": quality.report_sql(), "op7_chat": chat.REPORT_SQL, "op11_phrases": phrases.REPORT_SQL, "op13_negatives": negatives.REPORT_SQL}
