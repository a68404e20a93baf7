"""Estimated spatial clusters: alternation of local fits and a sequential label sweep.

Row work is Spark's: one projection and one aggregation give every unit's log-likelihood
under every cluster; passes of small sums fit all clusters (``distributed``). The sweep
itself is sequential, so that a unit sees the moves of those before it; it works on units
by clusters, in numpy: the driver holds that and the edges, a few hundred bytes a unit.

In "sum" scale features are standardised once over all rows and a cluster's penalty is the
same whatever its members, so that each step can only raise the objective; in "mean" scale
each cluster standardises its own rows and scales the penalty with them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators import distributed, graph, solver


@dataclass(frozen=True)
class Control:
    """Settings of the alternation; values outside their ranges are errors."""

    phi: float = 1.0
    k_neighbors: int = 5
    max_iter: int = 10
    min_units: int = 10
    min_per_class: int = 5
    alpha: float = 0.7
    lam: float = 0.01
    grouped: bool = True
    gamma: float = 1.0
    phi_update: str = "fixed"
    lambda_scale: str = "sum"

    def __post_init__(self) -> None:
        if self.lambda_scale not in ("mean", "sum") or self.phi_update not in ("fixed", "pl"):
            raise ValueError("lambda_scale is mean or sum, phi_update is fixed or pl")
        if not 0 <= self.alpha <= 1 or self.lam < 0 or self.phi < 0 or min(self.k_neighbors, self.min_units, self.max_iter) < 1:
            raise ValueError("a setting is out of its range")


@dataclass
class Fit:
    engines: list[solver.Engine]
    units: list
    labels: np.ndarray
    loglik: np.ndarray
    rows: np.ndarray
    edf: np.ndarray
    trace: list[float] = field(default_factory=list)
    phi: float = 1.0
    bonus: float = 0.0
    logpl: float = 0.0


Neighbours = list[list[tuple[int, float]]]


def supports(label: np.ndarray, neighbours: Neighbours, groups: int) -> np.ndarray:
    out = np.zeros((len(label), groups))
    for i, near in enumerate(neighbours):
        for j, w in near:
            out[i, label[j]] += w
    return out


def log_sum(a: np.ndarray) -> np.ndarray:
    m = a.max(-1, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(-1, keepdims=True)))[..., 0]


def pseudo_loglik(support: np.ndarray, label: np.ndarray, phi: float) -> float:
    a = phi * support
    return float((a[np.arange(len(label)), label] - log_sum(a)).sum())


def pseudo_change(u: int, support: np.ndarray, label: np.ndarray, near: list[tuple[int, float]], phi: float) -> np.ndarray:
    """Of unit u's move to every cluster: its own term, and those of its neighbours, whose support the move changes."""
    groups, old = support.shape[1], label[u]
    out = phi * (support[u] - support[u, old])
    if near:
        j, w = np.array([x for x, _ in near]), np.array([x for _, x in near])
        new = np.repeat(support[j][:, None], groups, 1)  # neighbour, target, cluster
        new[:, :, old] -= w[:, None]
        new[:, np.arange(groups), np.arange(groups)] += w[:, None]
        mine = np.take_along_axis(new, label[j][:, None, None], 2)[:, :, 0] - support[j, label[j]][:, None]
        out = out + (phi * mine - (log_sum(phi * new) - log_sum(phi * support[j])[:, None])).sum(0)
    out[old] = 0
    return out


def estimated_phi(support: np.ndarray, label: np.ndarray, top: float = 20.0) -> float:
    """Maximum of the concave log pseudo-likelihood within [0, top]: Newton steps within a shrinking bracket."""

    def slopes(phi: float) -> tuple[float, float]:
        a = phi * support
        p = np.exp(a - log_sum(a)[:, None])
        mean = (p * support).sum(1)
        return float((support[np.arange(len(label)), label] - mean).sum()), float(((p * support**2).sum(1) - mean**2).sum())

    low, high = 0.0, top
    if slopes(low)[0] <= 0:
        return low
    if slopes(high)[0] >= 0:
        return high
    phi = 1.0
    for _ in range(200):
        score, information = slopes(phi)
        low, high = (phi, high) if score > 0 else (low, phi)
        step = phi + score / information if information > 1e-300 else (low + high) / 2
        new = step if low < step < high else (low + high) / 2
        if abs(new - phi) < 1e-10:
            return new
        phi = new
    return phi


def sweep(ll: np.ndarray, label: np.ndarray, neighbours: Neighbours, phi: float, counts: np.ndarray, control: Control, order: np.ndarray | None = None) -> int:
    """One pass over units in order; each moves to the feasible cluster of most gain, at once. Returns the moves.

    counts: class counts of each unit. Only the cluster that a unit leaves can become infeasible. The label's part of the
    gain is phi times the support gained, or, with phi_update "pl", the change of the log pseudo-likelihood."""
    groups = ll.shape[1]
    support = supports(label, neighbours, groups)
    size = np.bincount(label, minlength=groups)
    mass = np.stack([counts[label == g].sum(0) for g in range(groups)])
    moves = 0
    for u in range(len(label)) if order is None else order:
        old = label[u]
        if size[old] - 1 < control.min_units or (mass[old] - counts[u] < control.min_per_class).any():
            continue
        gain = ll[u] - ll[u, old] + (pseudo_change(u, support, label, neighbours[u], phi) if control.phi_update == "pl" else phi * (support[u] - support[u, old]))
        new = int(np.argmax(gain))
        if new == old or gain[new] <= 1e-10:
            continue
        label[u] = new
        size[old], size[new] = size[old] - 1, size[new] + 1
        mass[old], mass[new] = mass[old] - counts[u], mass[new] + counts[u]
        for j, w in neighbours[u]:
            support[j, old] -= w
            support[j, new] += w
        moves += 1
    return moves


def fit_groups(rows: DataFrame, names: list, label: np.ndarray, features: list[str], classes: tuple[str, ...], control: Control, total: int, groups: int, unit_rows: np.ndarray | None, whole: tuple[np.ndarray, np.ndarray], start: list[solver.Engine] | None) -> list[tuple[solver.Engine, float]]:
    """Engines of all clusters and their degrees of freedom. In sum scale the penalty of a cluster's mean loss is kappa / its rows."""
    places = distributed.Places(names, label)
    if control.lambda_scale == "sum":
        size = np.bincount(label, weights=unit_rows, minlength=groups)
        lams = control.lam * total / groups / np.maximum(size, 1)
        center, scale = (np.tile(v, (groups, 1)) for v in whole)
    else:
        lams = np.full(groups, control.lam)
        where = rows.sparkSession.createDataFrame([(int(u), int(g)) for u, g in zip(names, label)], "unit long, g int")
        own = rows.join(where, "unit").groupBy("g").agg(*[f(c) for c in features for f in (F.avg, F.stddev_pop)]).orderBy("g").collect()  # one row a cluster
        center = np.array([r[1::2] for r in own], float)
        scale = np.array([r[2::2] for r in own], float)
        scale = np.where(scale <= 1e-12, 1.0, scale)
    return distributed.fit(rows, places, groups, features, classes, control.alpha, lams, control.grouped, center, scale, start)


def unit_loglik(rows: DataFrame, engines: list[solver.Engine], features: list[str], classes: tuple[str, ...]) -> DataFrame:
    """(unit, ll_0, ..., rows and class counts) by expressions over coefficient literals."""
    cols = []
    for g, e in enumerate(engines):
        eta = [F.lit(float(c[0])) + sum((F.lit(float(b)) * F.col(f) for b, f in zip(c[1:], features)), F.lit(0.0)) for c in e.coef]
        top = F.greatest(*eta)
        own = F.lit(None).cast("double")
        for c, x in zip(classes, eta):
            own = F.when(F.col("y") == c, x).otherwise(own)
        logp = own - top - F.log(sum((F.exp(x - top) for x in eta), F.lit(0.0)))
        cols.append(F.sum(F.greatest(logp, F.lit(float(np.log(solver.FLOOR))))).alias(f"ll_{g}"))
    return rows.groupBy("unit").agg(*cols, F.count("*").alias("n"), *[F.count_if(F.col("y") == c).alias(f"n_{i}") for i, c in enumerate(classes)])


def fit_partition(rows: DataFrame, units: DataFrame, features: list[str], classes: tuple[str, ...], start: pd.DataFrame, control: Control) -> Fit:
    """Alternates fits and sweeps from the start labels (unit, g from 0) until no unit moves. State is units by clusters."""
    rows = rows.select("unit", "y", *features).cache()
    edge = graph.edges(units, control.k_neighbors).toPandas()
    start = start.sort_values("unit").reset_index(drop=True)
    names, label = start["unit"].tolist(), start["g"].to_numpy(int).copy()
    groups, place = int(label.max()) + 1, {u: i for i, u in enumerate(names)}
    neighbours: list[list[tuple[int, float]]] = [[] for _ in names]
    for i, j, w in edge.itertuples(index=False):
        neighbours[place[i]].append((place[j], w))
    sizes = {r["unit"]: r["count"] for r in rows.groupBy("unit").count().collect()}  # one row a unit
    n_u = np.array([sizes.get(u, 0) for u in names], float)
    total, phi, trace, engines = int(n_u.sum()), control.phi, [], None
    whole = distributed.standards(rows, features)
    for step in range(control.max_iter + 1):
        fitted = fit_groups(rows, names, label, features, classes, control, total, groups, n_u, whole, engines)
        engines = [e for e, _ in fitted]
        table = unit_loglik(rows, engines, features, classes).toPandas().set_index("unit").reindex(names).fillna(0.0)
        ll = table[[f"ll_{g}" for g in range(groups)]].to_numpy()
        counts = table[[f"n_{i}" for i in range(len(classes))]].to_numpy()

        def label_term() -> float:
            support = supports(label, neighbours, groups)
            return pseudo_loglik(support, label, phi) if control.phi_update == "pl" else phi * float(support[np.arange(len(label)), label].sum()) / 2

        def objective() -> float:
            size = np.bincount(label, weights=n_u, minlength=groups)
            # in sum scale a cluster's rows times its penalty are kappa, whoever its members are
            weight = np.full(groups, control.lam * total / groups) if control.lambda_scale == "sum" else size * control.lam
            return float(ll[np.arange(len(label)), label].sum() + label_term() - sum(w * e.penalty() for w, e in zip(weight, engines)))

        trace.append(objective())
        if step == control.max_iter or not sweep(ll, label, neighbours, phi, counts, control):
            break
        if control.phi_update == "pl":
            phi = estimated_phi(supports(label, neighbours, groups), label)
        trace.append(objective())
    rows.unpersist()
    own = ll[np.arange(len(label)), label]
    support = supports(label, neighbours, groups)
    bonus = float(support[np.arange(len(label)), label].sum()) / 2
    logpl = pseudo_loglik(support, label, phi)
    return Fit(engines, names, label, np.bincount(label, weights=own, minlength=groups), np.bincount(label, weights=n_u, minlength=groups), np.array([d for _, d in fitted]), trace, phi, bonus, logpl)


def criteria(loglik: np.ndarray, rows: np.ndarray, units: np.ndarray, edf: np.ndarray, classes: int, predictors: int, gamma: float = 1.0, logpl: float = 0.0, label_df: int = 0) -> dict[str, float]:
    """The information criteria of a partition."""
    n, groups, ll, d = rows.sum(), len(rows), loglik.sum(), edf.sum()
    a = (units.mean() / units) ** gamma
    w = n * a / (a * rows).sum()
    d0 = groups * (classes - 1) * (predictors + 1)
    cb = (-2 * w * loglik).sum()
    cb_bic = cb + (np.log(np.maximum(units, 2)) * edf).sum()
    return {
        "bic_original": -2 * ll + np.log(n) * d0, "bic_effective": -2 * ll + np.log(n) * d, "aic_effective": -2 * ll + 2 * d, "cb_bic": cb_bic, "cb_aic": cb + 2 * d,
        "cb_ubic": cb_bic, "plic_bic": -2 * ll - 2 * logpl + np.log(n) * (d + label_df), "plic_aic": -2 * ll - 2 * logpl + 2 * (d + label_df), "weighted_n": (w * rows).sum(),
    }


def simultaneous(ll: np.ndarray, label: np.ndarray, neighbours: list[list[tuple[int, float]]], phi: float) -> np.ndarray:
    """The label update of the original algorithm: all units at once, first best cluster."""
    support = np.zeros_like(ll)
    for i, near in enumerate(neighbours):
        for j, w in near:
            support[i, label[j]] += w
    return (ll + phi * support).argmax(1)


def geographic_weights(d: np.ndarray) -> np.ndarray:
    """Adaptive bisquare weights from distances to the k nearest, with mean 1."""
    h = d.max() * 1.0001 + 1e-12
    w = np.where(d < h, (1 - (d / h) ** 2) ** 2, 0.0)
    return w / w.mean()
