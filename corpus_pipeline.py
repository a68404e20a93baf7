"""A training-data pipeline over documents: quality rules, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result
as Parquet to the shared folder and reads it again for the next. All stages but the last
return the columns of documents. The same inputs give the same rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import bpe, mixing, pii, quality, simhash
from terrane.llm.runtime import documents, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the row with the least doc_id stays, and of several such the one with the least hash.

    Rows are told apart by a hash of all their columns, not by doc_id, which may be null or shared."""
    names = docs.columns
    cols = [*names, *(F.col(c).isNull() for c in names)]
    docs = docs.withColumns({"_a": F.xxhash64(*cols), "_b": F.xxhash64(F.lit(7), *cols)})
    rows = simhash.near_duplicates(docs.select("doc_id", "text", "_a", "_b"), keep=("_a", "_b"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_a", "_b"))
    lead = written(rows.groupBy("label").agg(least.alias("least")).select("least._a", "least._b"), "leads")
    # only rows that agree in all columns are left to drop
    return docs.join(lead, ["_a", "_b"], "left_semi").dropDuplicates(["_a", "_b"]).select(*names)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are masked in the texts."""
    return pii.redacted(docs, pii.trained(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, each as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, token_offsets and n_tokens."""
    return bpe.encoded(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("tokens", to_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return written(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
