"""The queries of the ten training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from terrane.llm import bpe, lm, media, mixing, pii, quality, simhash, tokenfile, toxicity, urls
from terrane.llm.runtime import documents


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op1(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op2(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op3(documents(spark, sf_dir))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.op4(documents(spark, sf_dir))


def op5_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.op5(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op6(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op7(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op8(documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op9(documents(spark, sf_dir))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.op10(documents(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_bpe, op3_media, op4_lm, op5_tokenfile, op6_pii, op7_quality, op8_mixing, op9_simhash, op10_urls)}
ORACLE_SQL = {"op10_urls": urls.ORACLE}
