"""The queries of this folder: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from medloom.llm import decontam, langid, licenses, linededup, media, pfp, pii, secrets, simhash, spm
from medloom.llm.common import documents
from medloom.runtime import table


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode_documents(documents(spark, sf_dir))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(documents(spark, sf_dir))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfp.remove_repeats(documents(spark, sf_dir))


def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 on raw pages: sequences of text and media, resolved by digest."""
    return media.illustrated_pages(table(spark, sf_dir, "pages"), documents(spark, sf_dir))


QUERIES = {
    "op1_media": op1_media,
    "op2_pii": op2_pii,
    "op3_decontamination": op3_decontamination,
    "op4_language": op4_language,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_secrets": op6_secrets,
    "op7_simhash": op7_simhash,
    "op8_licenses": op8_licenses,
    "op9_lines": op9_lines,
    "op10_repeats": op10_repeats,
    "media_pages": media_pages,
}

ORACLE_SQL: dict[str, str] = {
    "op6_secrets": secrets.oracle(),
    "op9_lines": linededup.oracle(),
}
