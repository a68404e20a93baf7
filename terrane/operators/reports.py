"""Study reports: summaries, selection, agreement, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.functions.draws import draw

#: 0.975 quantiles of Student's t by degrees of freedom (fixed values).
T975 = {1: 12.706205, 2: 4.302653, 3: 3.182446, 4: 2.776445, 5: 2.570582, 6: 2.446912, 7: 2.364624, 8: 2.306004, 9: 2.262157, 10: 2.228139}


def t975(df: Column) -> Column:
    """The 0.975 t quantile: the table up to 10, the Cornish-Fisher expansion beyond."""
    z = 1.959963984540054
    v = df.cast("double")
    tail = z + (z**3 + z) / 4 / v + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / (v * v) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / (v * v * v)
    out = tail
    for k, q in T975.items():
        out = F.when(df == k, F.lit(q)).otherwise(out)
    return F.when(df >= 1, out)


def summary(rows: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """Per key and numeric column: finite count, mean, standard error and t interval."""
    long = rows.unpivot(list(keys), list(columns), "metric", "value").where("value IS NOT NULL AND NOT isnan(value) AND abs(value) <> double('inf')")
    out = long.groupBy(*keys, "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("mcse"))
    half = t975(F.col("n") - 1) * F.col("mcse")
    return out.withColumns({"low": F.col("mean") - half, "high": F.col("mean") + half})


def frequency(rows: DataFrame, keys: tuple[str, ...], item: str) -> DataFrame:
    """Count of each item within keys and its share of the keys' rows."""
    n = rows.groupBy(*keys, item).agg(F.count("*").alias("n"))
    total = rows.groupBy(*keys).agg(F.count("*").alias("total"))
    return n.join(total, list(keys), "left").withColumn("share", F.col("n") / F.col("total"))


def best_groups(runs: DataFrame, keys: tuple[str, ...], requested: int) -> DataFrame:
    """The least finite criterion of each key for which every requested G is eligible; ties go to the smaller G."""
    finite = runs.where("criterion IS NOT NULL AND NOT isnan(criterion) AND abs(criterion) <> double('inf')")
    whole = finite.groupBy(*keys).agg(F.countDistinct("G").alias("_n")).where(F.col("_n") == requested).drop("_n")
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("criterion", "G"))
    return finite.join(whole, list(keys), "left_semi").withColumn("_r", rank).where("_r = 1").drop("_r")


def largest_lambda(path: DataFrame, keys: tuple[str, ...], tol: float) -> DataFrame:
    """The largest lambda whose loss is within tol of the least."""
    least = F.min("loss").over(W.partitionBy(*keys))
    return path.withColumn("_m", least).where(F.col("loss") <= F.col("_m") + tol).groupBy(*keys).agg(F.max("lambda").alias("lambda"))


def paired_difference(rows: DataFrame, key: str, method: str, value: str, baseline: str) -> DataFrame:
    """Mean difference to the baseline over shared keys, and its standard error (null for one key)."""
    base = rows.where(F.col(method) == baseline).select(key, F.col(value).alias("_b"))
    d = F.col(value) - F.col("_b")
    return rows.where(F.col(method) != baseline).join(base, key).groupBy(method).agg(F.avg(d).alias("mean"), (F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n"))


def bootstrap(stats: DataFrame, cluster: str, value: str, size: str, draws: int, seed: int) -> DataFrame:
    """Percentile interval of sum(value) / sum(size) when clusters are drawn with replacement.

    stats has one row a cluster, so a draw moves sums and not rows; clusters are numbered
    and draw (b, k) takes the one at hash(b, k) modulo their number."""
    numbered = stats.withColumn("_no", F.row_number().over(W.orderBy(cluster)) - 1)
    n = stats.count()
    plan = stats.sparkSession.range(draws * n).select((F.col("id") / n).cast("long").alias("b"), F.pmod(F.col("id"), F.lit(n)).alias("k"))
    plan = plan.select("b", F.pmod(draw(seed, "b", "k"), F.lit(max(n, 1))).cast("int").alias("_no"))
    each = plan.join(numbered, "_no").groupBy("b").agg((F.sum(value) / F.sum(size)).alias("stat"))
    return each.agg(F.percentile("stat", 0.025).alias("low"), F.percentile("stat", 0.975).alias("high"), F.avg((F.col("stat") > 0).cast("double")).alias("positive"))


def allocate(rows: DataFrame, key: str, share: str, total: int) -> DataFrame:
    """Whole counts by the largest remainder; ties by key."""
    raw = F.lit(float(total)) * F.col(share) / F.sum(share).over(W.partitionBy())
    out = rows.withColumn("_raw", raw).withColumn("_floor", F.floor("_raw"))
    rank = F.row_number().over(W.orderBy(F.desc(F.round(F.col("_raw") - F.col("_floor"), 9)), key))
    left = F.lit(total) - F.sum("_floor").over(W.partitionBy())
    return out.withColumn("_r", rank).select(key, (F.col("_floor") + (F.col("_r") <= left).cast("long")).alias("count"))


def study_grid(spark, settings: dict[str, tuple], unused: dict[str, tuple[str, ...]]) -> DataFrame:
    """Cells of a study: all combinations, those a scenario tells no difference between once, and a seed from their hash.

    unused: for a scenario the settings it doesn't use, which take their first value. Two cells with one seed are an error."""
    grid = None
    for name, values in settings.items():
        one = spark.createDataFrame([(v,) for v in values], f"{name} {'string' if isinstance(values[0], str) else 'double' if isinstance(values[0], float) else 'int'}")
        grid = one if grid is None else grid.crossJoin(F.broadcast(one))  # a handful of settings each
    for scenario, names in unused.items():
        for name in names:
            grid = grid.withColumn(name, F.when(F.col("scenario") == scenario, F.lit(settings[name][0])).otherwise(F.col(name)))
    text = F.concat_ws("|", *[(F.col(n) * 10).cast("int").cast("string") if isinstance(v[0], float) else F.col(n).cast("string") for n, v in settings.items()])
    grid = grid.distinct().withColumn("seed", F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long"))
    if grid.select("seed").distinct().count() != grid.count():
        raise ValueError("two cells of the study have one seed")
    return grid
