"""Synthetic data: location fields, regimes and panels. Draws are seeded by unit, so any partitioning gives the same data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.draws import uniform

# Fixed values of the generators.
DOMAIN_X, DOMAIN_Y, EXCLUDED = (-1.0, 1.0), (0.0, 2.0), (1.0, 0.5, 0.5)
BREAKS_Y, SPLIT_X = (0.0, 2 / 3, 4 / 3, 2.0), 0.0
BALANCED = {"R11": 1 / 6, "R12": 1 / 6, "R13": 1 / 6, "R21": 1 / 6, "R22": 1 / 6, "R23": 1 / 6}
IMBALANCED = {"R11": 5 / 18, "R12": 4 / 18, "R13": 4 / 18, "R21": 3 / 18, "R22": 1 / 18, "R23": 1 / 18}
STAY_OTHER, TO_OTHER, BASE_LOGIT = 2.0, -2.5, -4.0


def inside(x, y):
    a, b, r = EXCLUDED
    return a * x * x + b * y * y > r * r


def locations(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """n units with coordinates in the irregular domain: over-sampled, filtered and numbered by their draw."""
    x = uniform(seed, "id") * (DOMAIN_X[1] - DOMAIN_X[0]) + DOMAIN_X[0]
    y = uniform(seed + 1, "id") * (DOMAIN_Y[1] - DOMAIN_Y[0]) + DOMAIN_Y[0]
    pool = spark.range(2 * n + 200).select("id", x.alias("cx"), y.alias("cy"))
    return pool.where(inside(F.col("cx"), F.col("cy"))).orderBy("id").limit(n).select(F.col("id").alias("unit"), "cx", "cy")


def region(x, y):
    """Label of the six regions, as columns."""
    k = F.when(y <= BREAKS_Y[1], 1).when(y <= BREAKS_Y[2], 2).otherwise(3)
    return F.concat(F.lit("R"), F.when(x <= SPLIT_X, 1).otherwise(2).cast("string"), k.cast("string"))


def regimes(units: DataFrame, pattern: str, groups: int, grid: tuple[int, int] = (2, 3)) -> DataFrame:
    """units with regime from 1: global, grid (rectangles of the bounding box) or irregular (a Latin square of tiles)."""
    if pattern == "global":
        return units.withColumn("regime", F.lit(1))
    box = units.agg(F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1"))
    r = units.crossJoin(F.broadcast(box))  # one row
    across = (F.col("cx") - F.col("x0")) / F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-12))
    up = (F.col("cy") - F.col("y0")) / F.greatest(F.col("y1") - F.col("y0"), F.lit(1e-12))
    a, b = grid if pattern == "grid" else (groups, groups)
    col, row = F.least(F.floor(across * a), F.lit(a - 1)), F.least(F.floor(up * b), F.lit(b - 1))
    out = col * b + row if pattern == "grid" else (row + col) % groups
    return r.select(*units.columns, (out + 1).cast("int").alias("regime"))


def transition_logits(classes: int, stay: float, advance: float = 1.0) -> np.ndarray:
    """from by to: stages follow one another in a cycle; the last class is apart."""
    cycle = classes - 1
    out = np.full((classes, classes), BASE_LOGIT)
    for k in range(cycle):
        out[k, k] = stay
        out[k, (k + 1) % cycle] = advance
        out[k, -1] = TO_OTHER
    out[-1, -1], out[-1, 0] = STAY_OTHER, 0.0
    return out


def panel(units: DataFrame, times: int, classes: int, features: int, seed: int, delta: float = 1.0, stay: tuple[float, float] = (1.0, 3.0), groups: int = 3) -> DataFrame:
    """(unit, regime, t, y, x1, ...): a Markov chain a unit whose transitions depend on its regime and predictors."""
    rng = np.random.default_rng(seed)
    centre = lambda b: b - b.mean(1, keepdims=True)
    base = centre(rng.normal(0, 0.6, (features, classes)))
    effects = [base + delta * centre(rng.normal(size=(features, classes))) for _ in range(groups)]
    logits = [transition_logits(classes, s) for s in np.linspace(*stay, groups)]
    names = [f"x{i + 1}" for i in range(features)]

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for unit, g in zip(pdf["unit"], pdf["regime"]):
            own = np.random.default_rng([seed, int(unit)])
            x, state, y = own.normal(size=(times, features)), int(own.integers(classes)), []
            for t in range(times):
                z = logits[g - 1][state] + x[t] @ effects[g - 1]
                p = np.exp(z - z.max())
                state = int(min((own.random() > (p / p.sum()).cumsum()).sum(), classes - 1))
                y.append(str(state + 1))
            parts.append(pd.DataFrame({"unit": unit, "regime": g, "t": np.arange(1, times + 1), "y": y, **{n: x[:, i] for i, n in enumerate(names)}}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["unit", "regime", "t", "y", *names])

    return units.select("unit", "regime").mapInPandas(lambda it: (chain(p) for p in it), "unit long, regime int, t long, y string, " + ", ".join(f"{n} double" for n in names))


def gaussian_field(xy: np.ndarray, reach: float, seed: int, nugget: float = 1e-8) -> np.ndarray:
    """A draw with exponential covariance at points; dense, for driver-sized sets only."""
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    return np.linalg.cholesky(np.exp(-d / reach) + nugget * np.eye(len(xy))) @ np.random.default_rng(seed).normal(size=len(xy))


def ratio_sample(points, key: str, counts: dict[str, int], seed: int):
    """So many points of each region, the first by a hash; regions with fewer give all. points: key and region."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    from terrane.functions.draws import draw

    need = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])
    ranked = points.withColumn("_d", draw(seed, key)).withColumn("_rn", F.row_number().over(W.partitionBy("region").orderBy("_d", key)))
    return ranked.where(F.col("_rn") <= need[F.col("region")]).select(key, "region")


def correlated_predictors(ids, key: str, active: int, inactive: int, rho: float, seed: int = 91):
    """x1, x2, ...: each sqrt(rho) of a field shared by the active or the inactive ones, and the rest its own; scaled to
    mean 0 and population standard deviation 1."""
    from pyspark.sql import functions as F

    from terrane.functions.draws import uniform

    n = active + inactive
    raw = ids.select(key, *[(rho**0.5 * (uniform(seed if j < active else seed + 1, key) - 0.5) + (1 - rho) ** 0.5 * (uniform(seed + 9 + j, key) - 0.5)).alias(f"v{j}") for j in range(n)])
    one = raw.agg(*[f(f"v{j}").alias(f"{name}{j}") for j in range(n) for name, f in (("m", F.avg), ("s", F.stddev_pop))])
    return raw.crossJoin(F.broadcast(one)).select(key, *[((F.col(f"v{j}") - F.col(f"m{j}")) / F.col(f"s{j}")).alias(f"x{j + 1}") for j in range(n)])  # one row
