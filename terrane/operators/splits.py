"""Splits and folds by hashed ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.functions.draws import draw


#: Ranges that draws of a stratum are cut to, as a power of two: a task ranks one of them, not a stratum.
RANGES = 12


def ranked(rows: DataFrame, key: str, strata: tuple[str, ...], seed: int) -> DataFrame:
    """key, strata, n (rows of the stratum) and rank from 1 by draw and key; null strata are one.

    Draws are even, so ranges of them are too: rows are ranked within a range, and a range's offset
    is the count of those before, of which a stratum has at most 2^RANGES."""
    drawn = rows.select(key, *strata, draw(seed, key).alias("_d")).withColumn("_p", F.shiftright("_d", 32 - RANGES))
    by = W.partitionBy(*strata)
    sizes = drawn.groupBy(*strata, "_p").count()
    before = F.coalesce(F.sum("count").over(by.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(c).alias(f"_s{k}") for k, c in enumerate(strata)], F.col("_p").alias("_q"), before.alias("_b"), F.sum("count").over(by).alias("n"))
    placed = drawn.withColumn("_r", F.row_number().over(W.partitionBy(*strata, "_p").orderBy("_d", key)))
    on = F.col("_p") == F.col("_q")
    for k, c in enumerate(strata):
        on = on & F.col(c).eqNullSafe(F.col(f"_s{k}"))
    return placed.join(sizes, on).select(key, *strata, "n", (F.col("_b") + F.col("_r")).alias("rank"))


def stratified_split(rows: DataFrame, key: str, strata: tuple[str, ...], share: float, seed: int) -> DataFrame:
    """key and is_test: ceil(share n) rows of each stratum, at least one and at most n - 1; none of a single row."""
    n = F.col("n")
    take = F.when(n > 1, F.least(n - 1, F.greatest(F.lit(1), F.ceil(F.lit(share) * n)))).otherwise(0)
    return ranked(rows, key, strata, seed).select(key, (F.col("rank") <= take).alias("is_test"))


def holdout_split(rows: DataFrame, key: str, strata: tuple[str, ...], share: float, seed: int) -> DataFrame:
    """key and is_valid: floor(share n) rows of each stratum of three or more, and at least two stay."""
    n = F.col("n")
    return ranked(rows, key, strata, seed).select(key, ((F.col("rank") <= F.least(n - 2, F.floor(n * share))) & (n >= 3)).alias("is_valid"))


def stratified_folds(rows: DataFrame, key: str, stratum: str, folds: int, seed: int) -> DataFrame:
    """key and fold from 1: as many folds as asked for, or as the smallest stratum has rows."""
    least = rows.groupBy(stratum).count().agg(F.min("count").alias("m"))
    placed = ranked(rows, key, (stratum,), seed).crossJoin(F.broadcast(least))  # one row
    return placed.select(key, ((F.col("rank") - 1) % F.least(F.lit(folds), F.col("m")) + 1).cast("int").alias("fold"))


def block_folds(blocks: DataFrame, block: str, stratum: str, folds: int, seed: int) -> DataFrame:
    """block and fold from 1: blocks of one stratum in turn, going on where the stratum before stopped."""
    sizes = blocks.groupBy(stratum).count()
    before = F.coalesce(F.sum("count").over(W.orderBy(stratum).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(W.partitionBy(stratum).orderBy(draw(seed, block), block))
    ranked = blocks.select(block, stratum, rank.alias("_r")).join(sizes.select(stratum, before.alias("_b")), stratum)
    return ranked.select(block, ((F.col("_b") + F.col("_r") - 1) % folds + 1).cast("int").alias("fold"))
