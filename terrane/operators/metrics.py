"""Classification metrics, agreement and losses as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-15


def divide(a: Column, b: Column) -> Column:
    """a / b, null where b isn't positive."""
    return F.when(b > 0, a / b)


def class_metrics(rows: DataFrame, classes: tuple[str, ...], keys: tuple[str, ...] = (), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """One-vs-rest counts and rates of each class, within keys; undefined rates are null."""
    cells = rows.groupBy(*keys, F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(F.count("*").alias("n"))  # at most classes squared a key
    each = cells.withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes])))
    is_y, is_p = F.col("y") == F.col("class"), F.col("yhat") == F.col("class")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    out = each.groupBy(*keys, "class").agg(count(is_y & is_p).alias("tp"), count(~is_y & is_p).alias("fp"), count(is_y & ~is_p).alias("fn"), count(~is_y & ~is_p).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    out = out.withColumns({"precision": divide(tp, tp + fp), "recall": divide(tp, tp + fn), "specificity": divide(tn, tn + fp)})
    f1 = F.when(F.col("tp") + F.col("fn") == 0, None).otherwise(divide(2 * tp, 2 * tp + fp + fn))
    return out.withColumns({"f1": f1, "balanced": (F.col("recall") + F.col("specificity")) / 2, "support": F.col("tp") + F.col("fn")})


def kappa(rows: DataFrame, keys: tuple[str, ...] = (), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Cohen's kappa within keys; null without rows or with a degenerate expectation."""
    cells = rows.groupBy(*keys, F.col(y).alias("a"), F.col(yhat).alias("b")).agg(F.count("*").alias("n"))
    name = [F.col(k) for k in keys]
    total = cells.groupBy(*name).agg(F.sum("n").cast("double").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    ma, mb = cells.groupBy(*name, F.col("a").alias("c")).agg(F.sum("n").alias("na")), cells.groupBy(*name, F.col("b").alias("c")).agg(F.sum("n").alias("nb"))
    chance = ma.join(mb, [*keys, "c"]).groupBy(*name).agg(F.sum(F.col("na") * F.col("nb")).cast("double").alias("e"))
    joined = total.join(chance, list(keys), "left") if keys else total.crossJoin(chance)  # one row each without keys
    po, pe = F.col("same") / F.col("t"), F.coalesce(F.col("e"), F.lit(0.0)) / (F.col("t") * F.col("t"))
    return joined.select(*keys, F.when(F.abs(1 - pe) >= 1e-12, (po - pe) / (1 - pe)).alias("kappa"))


def true_prob(y: str, classes: tuple[str, ...], probs: tuple[str, ...]) -> Column:
    out = F.lit(None).cast("double")
    for c, p in zip(classes, probs):
        out = F.when(F.col(y) == c, F.col(p)).otherwise(out)
    return F.greatest(out, F.lit(FLOOR))


def losses(classes: tuple[str, ...], probs: tuple[str, ...], y: str = "y") -> tuple[Column, Column]:
    """Aggregates: log-loss, and Brier score summed over classes."""
    brier = sum(((F.col(p) - (F.col(y) == c).cast("double")) * (F.col(p) - (F.col(y) == c).cast("double")) for c, p in zip(classes, probs)), F.lit(0.0))
    return -F.avg(F.log(true_prob(y, classes, probs))), F.avg(brier)


def overall_metrics(rows: DataFrame, classes: tuple[str, ...], probs: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """N, accuracy, kappa, log-loss, Brier, macro F1 (undefined skipped) and weighted precision (undefined counts 0).

    Rows are read once: counts and sums of losses by key, class and prediction, at most classes squared a key, give all."""
    own = F.log(true_prob("y", classes, probs))
    brier = sum(((F.col(p) - (F.col("y") == c).cast("double")) * (F.col(p) - (F.col("y") == c).cast("double")) for c, p in zip(classes, probs)), F.lit(0.0))
    sums = rows.groupBy(*keys, "y", "yhat").agg(F.count("*").alias("n"), F.sum(own).alias("ll"), F.sum(brier).alias("br"))
    cells = sums.groupBy(*keys).agg(F.collect_list(F.struct("y", "yhat", "n", "ll", "br")).alias("cells"))
    total = lambda f: F.aggregate("cells", F.lit(0.0), lambda acc, x: acc + f(x))
    count = lambda f: F.aggregate("cells", F.lit(0.0), lambda acc, x: acc + F.when(f(x), x.n).otherwise(0))
    n = count(lambda x: F.lit(True))
    f1s, precisions, weighted, chance = [], [], F.lit(0.0), F.lit(0.0)
    for c in classes:
        tp = count(lambda x, c=c: (x.y == c) & (x.yhat == c))
        of_y, of_p = count(lambda x, c=c: x.y == c), count(lambda x, c=c: x.yhat == c)
        precision = divide(tp, of_p)
        f1s.append(F.when(of_y > 0, 2 * tp / (of_y + of_p)))
        precisions.append(precision)
        weighted = weighted + F.coalesce(precision, F.lit(0.0)) * of_y
        chance = chance + of_y * of_p
    mean = lambda xs: sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0)) / F.nullif(sum((x.isNotNull().cast("double") for x in xs), F.lit(0.0)), F.lit(0.0))
    out = cells.select(*keys, n.alias("n"), (count(lambda x: x.y == x.yhat) / n).alias("accuracy"), (-total(lambda x: x.ll) / n).alias("logloss"), (total(lambda x: x.br) / n).alias("brier"), chance.alias("_c"), mean(f1s).alias("macro_f1"), mean(precisions).alias("macro_precision"), (weighted / n).alias("weighted_precision"))
    po, pe = F.col("accuracy"), F.col("_c") / (F.col("n") * F.col("n"))
    return out.withColumn("kappa", F.when(F.abs(1 - pe) >= 1e-12, (po - pe) / (1 - pe))).withColumn("n", F.col("n").cast("long")).drop("_c")


def adjusted_rand(rows: DataFrame, a: str, b: str, degenerate: str = "identity") -> DataFrame:
    """Adjusted Rand index of two labellings; a degenerate denominator gives 1 or 0 by identity, or null."""
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    ij = cells.agg(F.sum(pairs("n")).alias("ij"), F.sum("n").cast("double").alias("t"), F.count("*").alias("cells"))
    sa = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias("sa"), F.count("*").alias("ca"))
    sb = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias("sb"), F.count("*").alias("cb"))
    one = ij.crossJoin(sa).crossJoin(sb)  # one row each
    expected = F.when(F.col("t") > 1, F.col("sa") * F.col("sb") / (F.col("t") * (F.col("t") - 1) / 2)).otherwise(0.0)
    low = (F.col("sa") + F.col("sb")) / 2 - expected
    same = ((F.col("cells") == F.col("ca")) & (F.col("cells") == F.col("cb"))).cast("double")
    return one.select(F.when(F.abs(low) > 1e-12, (F.col("ij") - expected) / low).otherwise(same if degenerate == "identity" else F.lit(None).cast("double")).alias("ari"))
