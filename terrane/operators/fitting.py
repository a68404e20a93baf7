"""Entry points of fits: one model of all rows, one for each value of a column, and cross-validated paths of penalties."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators import distributed, model
from terrane.operators.metrics import FLOOR


def fit(rows: DataFrame, features: Sequence[str], classes: Sequence[str], penalty: str = "elastic_net", alpha: float | None = None, lam: float = 0.0, cluster: str | None = None, grouped: bool = True) -> model.Model:
    """A global model, or with cluster one for each value of that column (few; they are listed on the driver).

    rows: y, the features and cluster. Each fit standardises by its own rows; rows without a cluster count for none."""
    mixing = model.penalty_alphas(penalty, alpha if penalty == "elastic_net" else None)[1]
    lam = 0.0 if penalty == "none" else lam
    names, groups, places = list(features), 1, None
    if cluster:
        rows = rows.where(F.col(cluster).isNotNull()).withColumn("unit", F.col(cluster))
        values = sorted(r[0] for r in rows.select("unit").distinct().collect())  # one a cluster
        groups, places = len(values), distributed.Places(values, np.arange(len(values)))
    center, scale = _standards(rows, names, values if cluster else None)
    fits = distributed.fit(rows, places, groups, names, tuple(classes), mixing or 0.0, lam, grouped, center, scale)
    return model.Model(
        "fixed_clusters" if cluster else "global", [e.coef.tolist() for e, _ in fits], tuple(classes), tuple(names),
        tuple(map(str, values)) if cluster else (), penalty, float(sum(df for _, df in fits)), rows.count(), all(e.converged for e, _ in fits),
    )


def _standards(rows: DataFrame, features: list[str], units: list | None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population standard deviation of each feature, a row for each unit; 1 for a constant one."""
    stats = [f(c) for c in features for f in (F.avg, F.stddev_pop)]
    found = {r[0]: list(r)[1:] for r in rows.groupBy(F.col("unit") if units else F.lit("all")).agg(*stats).collect()}  # one row a fit
    each = np.array([found.get(u, [0.0, 1.0] * len(features)) for u in (units or ["all"])], float)
    mean, sd = each[:, 0::2], each[:, 1::2]
    return mean, np.where(sd <= 1e-12, 1.0, sd)


@dataclass(frozen=True)
class Path:
    """trials: (alpha, lambda, deviance, standard error); the choice, and the model of each fold at it."""

    trials: list[tuple[float, float, float, float]]
    alpha: float
    lambda_min: float
    lambda_1se: float
    folds: model.Model

    def out_of_fold(self, rows: DataFrame) -> DataFrame:
        """The rows with the probabilities of the model that didn't see them."""
        return self.folds.predict(rows, cluster="fold")


def _own(coef: Sequence, rows_class: Sequence[str], features: Sequence[str]) -> Column:
    """Log of the probability of a row's class under the model that left its fold out."""
    m = model.Model("fixed_clusters", coef, rows_class, features, tuple(str(g + 1) for g in range(len(coef))))
    p = F.lit(None).cast("double")
    for g in range(len(coef)):
        for c, v in zip(rows_class, m.local(g)):
            p = F.when((F.col("fold") == g + 1) & (F.col("y") == c), v).otherwise(p)
    return F.log(F.greatest(p, F.lit(FLOOR)))


def cross_validated(rows: DataFrame, features: Sequence[str], classes: Sequence[str], alphas: Sequence[float], lambdas: Sequence[float], rule: str = "min", grouped: bool = True) -> Path:
    """A path of penalties for each alpha, by deviance on folds. rows: y, the features and fold from 1 to their number.

    All folds are fitted in the same passes: a row counts for every fold but its own. Paths go from the
    greatest lambda down, each fit from the one before. lambda_1se: the greatest within a standard error of
    the least deviance. The best alpha has the least deviance at the rule's lambda, the first of ties."""
    if rule not in ("min", "1se"):
        raise ValueError("the rule is min or 1se")
    names, k = list(features), int(rows.agg(F.max("fold")).first()[0] or 0)
    if k < 2:
        raise ValueError("two folds or more are needed")
    others = F.explode(F.array_except(F.sequence(F.lit(1), F.lit(k)), F.array("fold"))).alias("unit")
    train = rows.select("y", *names, F.col("fold").cast("int").alias("fold")).select("y", *names, others)
    places = distributed.Places(list(range(1, k + 1)), np.arange(k))
    center, scale = _standards(train, names, list(range(1, k + 1)))
    trials, kept = [], {}
    for alpha in alphas:
        start, path = None, sorted(set(lambdas), reverse=True)
        for lam in path:
            start = [e for e, _ in distributed.fit(train, places, k, names, tuple(classes), alpha, lam, grouped, center, scale, start)]
            kept[alpha, lam] = [e.coef.tolist() for e in start]
        losses = [F.avg(-2 * _own(kept[alpha, lam], classes, names)).alias(f"l{i}") for i, lam in enumerate(path)]
        by_fold = rows.groupBy("fold").agg(F.count("*").alias("n"), *losses).collect()  # one row a fold
        n = np.array([r["n"] for r in by_fold], float)
        for i, lam in enumerate(path):
            dev = np.array([r[f"l{i}"] for r in by_fold], float)
            mean = float(np.average(dev, weights=n))
            trials.append((float(alpha), float(lam), mean, float(np.sqrt(np.average((dev - mean) ** 2, weights=n) / (k - 1)))))
    choices = []
    for alpha in alphas:
        own = [t for t in trials if t[0] == alpha]
        best = min(own, key=lambda t: (t[2], -t[1]))
        wide = max(t[1] for t in own if t[2] <= best[2] + best[3])
        at = best[1] if rule == "min" else wide
        choices.append((next(t[2] for t in own if t[1] == at), alpha, best[1], wide, at))
    _, alpha, least, wide, at = min(choices, key=lambda c: c[0])
    folds = model.Model("fixed_clusters", kept[alpha, at], tuple(classes), tuple(names), tuple(str(f + 1) for f in range(k)))
    return Path(trials, alpha, least, wide, folds)
