"""The model's interface: checks of its inputs, and predictions, coefficients and likelihoods of a fitted model.

A fitted model is a small table of coefficients (clusters by classes by terms) and, for each
unit, membership weights over the clusters. Predictions are mixtures of the clusters'
probabilities; they are expressions over the coefficients as literals, so rows are scanned
once and never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-15


def matched_features(rows: DataFrame, features: Sequence[str], others: Sequence[str] = ()) -> DataFrame:
    """The rows with the fitted predictors in fitted order behind the others; names must match as a set, and all values be finite."""
    given = [c for c in rows.columns if c not in others]
    if len(set(given)) != len(given) or set(given) != set(features):
        raise ValueError("predictor names do not match the model")
    bad = F.lit(False)
    for c in features:
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c)) == float("inf"))
    checked = F.when(bad, F.raise_error("predictors must be finite"))
    cols = [F.coalesce(checked.cast("double"), F.col(c).cast("double")).alias(c) for c in features]
    return rows.select(*others, *cols)


def normalised(probs: Mapping[str, Column], classes: Sequence[str]) -> dict[str, Column]:
    """Probability columns in the order of classes: classes not given are 0, rows sum to one.

    Unknown classes are an error, and so are negative or undefined values and rows without mass."""
    if len(set(classes)) != len(classes) or any(c is None for c in classes):
        raise ValueError("class labels must be given and unique")
    if unknown := set(probs) - set(classes):
        raise ValueError(f"probability columns of unknown classes: {sorted(unknown)}")
    every = {c: probs.get(c, F.lit(0.0)) for c in classes}
    total = sum(every.values(), F.lit(0.0))
    fine = F.lit(True)
    for p in every.values():
        fine = fine & p.isNotNull() & (p >= 0) & (p < float("inf"))
    wrong = F.when(~F.coalesce(fine, F.lit(False)) | ~(total > 0), F.raise_error("probabilities must be finite, nonnegative and have mass").cast("double"))
    return {c: F.coalesce(wrong, p / total).alias(c) for c, p in every.items()}


def penalty_alphas(penalty: str, alpha: float | None = None, grid: Sequence[float] | None = None) -> tuple[list[float], float | None]:
    """The grid of mixing values of a penalty, sorted, and its default, the grid's median."""
    if penalty not in ("elastic_net", "lasso", "ridge", "none"):
        raise ValueError("penalty is elastic_net, lasso, ridge or none")
    if penalty == "none":
        if alpha is not None:
            raise ValueError("alpha is not used without a penalty")
        return [], None
    if penalty in ("ridge", "lasso"):
        fixed = 0.0 if penalty == "ridge" else 1.0
        if alpha is not None and abs(alpha - fixed) > 1e-8:
            raise ValueError(f"the alpha of {penalty} is {fixed:g}")
        return [fixed], fixed
    own = sorted(set([alpha] if alpha is not None else grid if grid is not None else (0.25, 0.5, 0.75, 1.0)))
    if not own or any(not 0 < a <= 1 for a in own):
        raise ValueError("alphas lie above 0 and up to 1")
    return list(map(float, own)), float(median(own))


def least_per_class(least: int | Sequence[int] | Mapping[str, int], classes: Sequence[str]) -> dict[str, int]:
    """The least number of rows of each class, from one number, one a class in their order, or by name."""
    if isinstance(least, int):
        return dict.fromkeys(classes, least)
    if len(least) != len(classes):
        raise ValueError("one number, or one for each class")
    if isinstance(least, Mapping):
        if set(least) != set(classes):
            raise ValueError("names must match the classes")
        return {c: int(least[c]) for c in classes}
    return {c: int(n) for c, n in zip(classes, least)}


def check_lag_columns(lags: Sequence[str], features: Sequence[str], classes: Sequence[str]) -> None:
    if len(lags) != len(classes) or not set(lags) <= set(features):
        raise ValueError("lag columns name one fitted column for each class, in their order")


@dataclass(frozen=True)
class Model:
    """Coefficients clusters x classes x (1 + features), on the original scale."""

    kind: str
    coef: Sequence[Sequence[Sequence[float]]]
    classes: Sequence[str]
    features: Sequence[str]
    fixed: Sequence[str] = field(default_factory=tuple)  # labels of fixed clusters, in the order of coef
    penalty: str = "elastic_net"
    df: float = 0.0
    rows: int = 0
    converged: bool = True

    def __post_init__(self) -> None:
        if self.kind not in ("global", "fixed_clusters", "scmr"):
            raise ValueError("a model is global, fixed_clusters or scmr")

    def local(self, g: int) -> list[Column]:
        """The classes' probabilities in a cluster, from the features' columns."""
        etas = [sum((F.lit(float(b)) * F.col(f) for b, f in zip(row[1:], self.features)), F.lit(float(row[0]))) for row in self.coef[g]]
        top = F.greatest(*etas) if len(etas) > 1 else etas[0]
        parts = [F.exp(e - top) for e in etas]
        return [p / sum(parts, F.lit(0.0)) for p in parts]

    def membership(self, rows: DataFrame, weights: DataFrame | None = None, cluster: str | None = None) -> DataFrame:
        """The rows with weights over the clusters, w0, w1, ...: all one, by a fixed cluster's column, or joined by unit."""
        n = len(self.coef)
        if self.kind == "global":
            return rows.withColumns({f"w{g}": F.lit(1.0) for g in range(n)})
        if self.kind == "fixed_clusters":
            if cluster is None:
                raise ValueError("name the column of fixed clusters")
            known = F.when(F.col(cluster).isNull() | ~F.col(cluster).cast("string").isin(list(self.fixed)), F.raise_error("unknown fixed cluster").cast("double"))
            return rows.withColumns({f"w{g}": F.coalesce(known, (F.col(cluster).cast("string") == c).cast("double")) for g, c in enumerate(self.fixed)})
        wide = weights.groupBy("unit").agg(*[F.sum(F.when(F.col("g") == g, F.col("weight")).otherwise(0.0)).alias(f"w{g}") for g in range(n)])
        return rows.join(wide, "unit")

    def predict(self, rows: DataFrame, weights: DataFrame | None = None, cluster: str | None = None, kind: str = "prob") -> DataFrame:
        """kind membership: weights w0, ...; prob: also p_<class>; class: also yhat, the first best class."""
        out = self.membership(rows, weights, cluster)
        if kind == "membership":
            return out
        if self.kind == "fixed_clusters":  # one cluster a row: its coefficients are picked, not all clusters mixed
            own = F.array_position(F.array(*[F.lit(c) for c in self.fixed]), F.col(cluster).cast("string"))
            own = F.when(own > 0, own).otherwise(F.raise_error("unknown fixed cluster").cast("long"))
            table = F.array(*[F.array(*[F.lit(float(b)) for row in c for b in row]) for c in self.coef])
            out = out.withColumn("_own", F.element_at(table, own.cast("int")))
            q = len(self.features) + 1
            etas = [sum((F.col("_own")[j * q + 1 + t] * F.col(f) for t, f in enumerate(self.features)), F.col("_own")[j * q]) for j in range(len(self.classes))]
            out = out.withColumns({f"_e{j}": e for j, e in enumerate(etas)}).withColumn("_top", F.greatest(*[f"_e{j}" for j in range(len(etas))]))
            mixed = {c: F.exp(F.col(f"_e{j}") - F.col("_top")) for j, c in enumerate(self.classes)}
            out = out.withColumns({f"p_{c}": p for c, p in normalised(mixed, self.classes).items()}).drop("_own", "_top", *[f"_e{j}" for j in range(len(etas))])
            return out if kind == "prob" else self._best(out)
        locals_ = [self.local(g) for g in range(len(self.coef))]
        mixed = {c: sum((F.col(f"w{g}") * locals_[g][j] for g in range(len(locals_))), F.lit(0.0)) for j, c in enumerate(self.classes)}
        out = out.withColumns({f"p_{c}": p for c, p in normalised(mixed, self.classes).items()})
        return out if kind == "prob" else self._best(out)

    def _best(self, out: DataFrame) -> DataFrame:
        best = F.lit(self.classes[-1])
        for j in range(len(self.classes) - 2, -1, -1):
            rest = F.greatest(*[F.col(f"p_{c}") for c in self.classes[j:]])
            best = F.when(F.col(f"p_{self.classes[j]}") >= rest, self.classes[j]).otherwise(best)
        return out.withColumn("yhat", best)

    def coefficients(self, centred: bool = True) -> list[tuple[int, str, str, float]]:
        """(cluster, class, term, value); centred: summing to zero over the classes."""
        out = []
        for g, rows in enumerate(self.coef):
            for t, term in enumerate(("(Intercept)", *self.features)):
                mean = sum(r[t] for r in rows) / len(rows) if centred else 0.0
                out += [(g, c, term, float(r[t] - mean)) for c, r in zip(self.classes, rows)]
        return out

    def log_likelihood(self, rows: DataFrame, weights: DataFrame | None = None, cluster: str | None = None) -> DataFrame:
        """One row: the log-likelihood of column y, degrees of freedom and rows."""
        own = F.lit(None).cast("double")
        for c in self.classes:
            own = F.when(F.col("y") == c, F.col(f"p_{c}")).otherwise(own)
        return self.predict(rows, weights, cluster).agg(F.sum(F.log(F.greatest(own, F.lit(FLOOR)))).alias("loglik"), F.lit(float(self.df)).alias("df"), F.count("*").alias("nobs"))

    def __str__(self) -> str:
        return f"{self.kind} model, penalty {self.penalty}, {len(self.coef)} clusters, classes {', '.join(self.classes)}, {'converged' if self.converged else 'not converged'}"


# Tuning over tables of losses; undefined losses count as infinite.


def _loss(c: str) -> Column:
    return F.when(F.col(c).isNull() | F.isnan(c), F.lit(float("inf"))).otherwise(F.col(c))


def path_losses(rows: DataFrame, model: Model, lambdas: Sequence[float], shrink) -> DataFrame:
    """(lambda, loss): mean log-loss of a path of models, shrink(coef, lambda), in one scan; failures are infinite."""
    from terrane.operators.metrics import true_prob

    cols = []
    for i, lam in enumerate(lambdas):
        own = Model("global", [[[shrink(b, t, lam) for t, b in enumerate(row)] for row in model.coef[0]]], model.classes, model.features)
        probs = dict(zip(model.classes, own.local(0)))
        p = F.lit(None).cast("double")
        for c in model.classes:
            p = F.when(F.col("y") == c, probs[c]).otherwise(p)
        cols.append((-F.avg(F.log(F.greatest(p, F.lit(FLOOR))))).alias(f"l{i}"))
    wide = rows.agg(*cols)
    each = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("lambda"), F.col(f"l{i}").alias("loss")) for i, x in enumerate(lambdas)])).alias("r")
    return wide.select(each).select("r.lambda", _loss("r.loss").alias("loss"))


def shared_alpha(trials: DataFrame) -> DataFrame:
    """One row, the alpha of least mean loss over clusters, the least of ties. trials: cluster, alpha, loss; a failed cluster rules its alpha out."""
    score = trials.groupBy("alpha").agg(F.avg(_loss("loss")).alias("score")).where(F.col("score") < float("inf"))
    return score.agg(F.min_by("alpha", F.struct("score", "alpha")).alias("alpha"), F.min("score").alias("score"))


def local_lambdas(trials: DataFrame, tol: float) -> DataFrame:
    """(cluster, before, after): the lambda of a cluster moves to the best tried only if that gains more than tol.

    trials: cluster, lambda, loss, before (the cluster's own lambda, among those tried)."""
    best = F.min_by(F.struct("lambda", _loss("loss").alias("loss")), F.struct(_loss("loss"), -F.col("lambda"))).alias("best")
    own = F.min(F.when(F.col("lambda") == F.col("before"), _loss("loss"))).alias("own")
    out = trials.groupBy("cluster", "before").agg(best, own)
    return out.select("cluster", "before", F.when(F.col("best.loss") < F.coalesce("own", F.lit(float("inf"))) - tol, F.col("best.lambda")).otherwise(F.col("before")).alias("after"))


def final_alphas(alpha: Column, delta: Sequence[float], low: float = 0.05) -> Column:
    """Sorted distinct alphas around one, within [low, 1]."""
    return F.array_sort(F.array_distinct(F.array(*[F.greatest(F.lit(low), F.least(F.lit(1.0), alpha + x)) for x in (0.0, *delta)])))
