"""Penalised multinomial fits of many clusters at once over distributed rows.

Each pass reads every row once and sends no row anywhere: a partition adds up, for each
cluster, the loss, its gradient and its Hessian at the current coefficients, and one small
aggregation joins the partitions. The driver holds clusters x (classes x terms)^2 numbers
and each unit's label; it minimises the quadratic model with the penalty (accelerated
proximal steps) and halves the step while the objective, as the next pass measures it,
rises. A handful of passes fit all clusters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators import solver


def standards(rows: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population standard deviation of each feature over all rows; a constant one has scale 1."""
    r = rows.agg(*[f(c) for c in features for f in (F.avg, F.stddev_pop)]).first()
    mean, sd = (np.array([0.0 if v is None else v for v in r[k::2]], float) for k in (0, 1))
    return mean, np.where(sd <= 1e-12, 1.0, sd)


class Places:
    """Labels of units, for a kernel: units sorted, and the cluster of each. 12 bytes a unit go with every task."""

    def __init__(self, units: list, labels: np.ndarray) -> None:
        order = np.argsort(np.asarray(units, np.int64))
        self.units, self.labels = np.asarray(units, np.int64)[order], np.asarray(labels, np.int32)[order]

    def of(self, unit: np.ndarray) -> np.ndarray:
        return self.labels[np.searchsorted(self.units, unit)]


def passes_over(rows: DataFrame, places: Places | None, features: list[str], classes: tuple[str, ...], center: np.ndarray, scale: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each cluster the number of rows, and the sums of loss, gradient and Hessian at b (clusters, classes, terms) of standardised features."""
    groups, k, q = b.shape
    columns = rows.select(*(["unit"] if places else []), F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("y")).cast("int").alias("y"), *[F.col(f).cast("double") for f in features])
    size = 2 + k * q + (k * q) ** 2

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((groups, size))
        for batch in batches:
            at = 1 if places else 0
            of = places.of(batch.column(0).to_numpy()) if places else np.zeros(batch.num_rows, np.int64)
            y = batch.column(at).to_numpy() - 1
            x = np.column_stack([batch.column(at + 1 + i).to_numpy() for i in range(len(features))])
            for g in np.unique(of).tolist():
                own = of == g
                z = np.c_[np.ones(own.sum()), (x[own] - center[g]) / scale[g]]
                p = solver.softmax(z @ b[g].T)
                mine = p[np.arange(len(z)), y[own]]
                r = p.copy()
                r[np.arange(len(z)), y[own]] -= 1
                row = total[g]
                row[0] += len(z)
                row[1] -= np.log(np.maximum(mine, solver.FLOOR)).sum()
                row[2 : 2 + k * q] += (r.T @ z).ravel()
                row[2 + k * q :] += solver.hessian(z, p, np.ones(len(z))).ravel()
        g, pos = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(total[g, pos])], names=["g", "pos", "value"])

    out = np.zeros((groups, size))
    for r in columns.mapInArrow(kernel, "g int, pos int, value double").groupBy("g", "pos").agg(F.sum("value")).collect():  # clusters x size rows
        out[r[0], r[1]] = r[2]
    return out[:, 0], out[:, 1], out[:, 2 : 2 + k * q].reshape(groups, k, q), out[:, 2 + k * q :].reshape(groups, k * q, k * q)


def penalty(b: np.ndarray, alpha: float, grouped: bool) -> float:
    body = b[:, 1:]
    one = np.sqrt((body**2).sum(0)).sum() if grouped else np.abs(body).sum()
    return float(alpha * one + (1 - alpha) / 2 * (body**2).sum())


def quadratic_step(b: np.ndarray, grad: np.ndarray, hess: np.ndarray, alpha: float, lam: float, grouped: bool, steps: int = 2000) -> np.ndarray:
    """Minimiser of the loss's quadratic model at b plus lam times the penalty."""
    k, q = b.shape
    bound = max(np.linalg.eigvalsh(hess)[-1], 1e-12) + lam * (1 - alpha)
    new = m = b.copy()
    t, cut = 1.0, lam * alpha / bound
    for _ in range(steps):
        g = grad + (hess @ (m - b).ravel()).reshape(k, q)
        g[:, 1:] += lam * (1 - alpha) * m[:, 1:]
        step = m - g / bound
        body = step[:, 1:]
        if grouped:
            norm = np.sqrt((body**2).sum(0))
            step[:, 1:] = body * np.maximum(1 - cut / np.maximum(norm, 1e-300), 0)
        else:
            step[:, 1:] = np.sign(body) * np.maximum(np.abs(body) - cut, 0)
        if ((m - step) * (step - new)).sum() > 0:
            t = 1.0
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        moved = np.abs(step - new).max()
        m, new, t = step + (t - 1) / u * (step - new), step, u
        if moved < 1e-12:
            break
    return new


def fit(rows: DataFrame, places: Places | None, groups: int, features: list[str], classes: tuple[str, ...], alpha: float, lams: np.ndarray | float, grouped: bool = True, center: np.ndarray | None = None, scale: np.ndarray | None = None, start: list[solver.Engine] | None = None, passes: int = 60, tol: float = 1e-11) -> list[tuple[solver.Engine, float]]:
    """(engine, effective degrees of freedom) of each cluster. center, scale: (clusters, features), global ones if not given.

    lams: the penalty of each cluster's mean loss."""
    k, q = len(classes), len(features) + 1
    if center is None:
        mean, sd = standards(rows, features)
        center, scale = np.tile(mean, (groups, 1)), np.tile(sd, (groups, 1))
    lams = np.broadcast_to(np.asarray(lams, float), (groups,))
    b = np.zeros((groups, k, q))
    if start is not None:
        for g, e in enumerate(start):
            b[g, :, 1:] = e.coef[:, 1:] * scale[g]
            b[g, :, 0] = e.coef[:, 0] + e.coef[:, 1:] @ center[g]
    at, done, last = b.copy(), np.zeros(groups, bool), np.full(groups, np.inf)
    kept: list[tuple | None] = [None] * groups
    for _ in range(passes):
        n, loss, grad, hess = passes_over(rows, places, features, classes, center, scale, at)
        n = np.maximum(n, 1)
        for g in range(groups):
            if done[g]:
                continue
            now = loss[g] / n[g] + lams[g] * penalty(at[g], alpha, grouped)
            if now > last[g] + 1e-13 * abs(last[g]):
                at[g] = (at[g] + b[g]) / 2  # the step was too long
                if np.abs(at[g] - b[g]).max() < 1e-12:
                    done[g] = True
                continue
            small = last[g] - now <= tol * max(1.0, abs(now))
            b[g], last[g], kept[g] = at[g].copy(), now, (n[g], hess[g])
            new = quadratic_step(b[g], grad[g] / n[g], hess[g] / n[g], alpha, lams[g], grouped)
            done[g] = small and np.abs(new - b[g]).max() < 1e-6
            at[g] = new
        if done.all():
            break
    out = []
    for g in range(groups):
        coef = np.c_[b[g][:, :1], b[g][:, 1:] / scale[g]]
        coef[:, 0] -= coef[:, 1:] @ center[g]
        engine = solver.Engine(coef - (coef.mean(0) if lams[g] == 0 else 0), classes, alpha, float(lams[g]), scale[g], grouped, bool(done[g]))
        out.append((engine, solver.effective_df_of(engine, kept[g][1], int(kept[g][0])) if kept[g] else 0.0))
    return out
