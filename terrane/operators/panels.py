"""Unit-by-time operators: lag design, gaps, carry-forward, forward filter and forward-backward imputation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TINY = np.finfo(float).tiny


def lag_design(panel: DataFrame, classes: tuple[str, ...], prefix: str = "lag_") -> DataFrame:
    """The panel with the class of the unit's previous time point, its one-hot columns and whether it is known.

    An equality join on time - 1, so that a gap gives null. Duplicate (unit, time) rows are an error."""
    twice = panel.groupBy("unit", "t").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("each unit may appear once at a time point")
    prev = panel.select("unit", (F.col("t") + 1).alias("t"), F.col("y").alias("lag"))
    out = panel.join(prev, ["unit", "t"], "left").withColumn("available", F.col("lag").isNotNull())
    return out.withColumns({prefix + c: F.when(F.col("available"), (F.col("lag") == c).cast("double")) for c in classes})


def segments(panel: DataFrame) -> DataFrame:
    """The panel with restart (first row, or a gap before it) and the number of the gapless segment."""
    by = W.partitionBy("unit").orderBy("t")
    restart = F.coalesce(F.col("t") - F.lag("t").over(by) != 1, F.lit(True))
    return panel.withColumn("restart", restart).withColumn("segment", F.sum(F.col("restart").cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)))


def carry_forward(panel: DataFrame, fallback: Column) -> DataFrame:
    """The panel with the latest earlier class of the same unit, or the fallback."""
    by = W.partitionBy("unit").orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    return panel.withColumn("carried", F.coalesce(F.last("y", ignorenulls=True).over(by), fallback))


def by_unit(rows: DataFrame, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work on chunks of whole units, in order of unit and t: one shuffle by unit, and a chunk is an Arrow
    batch or one unit's rows, if those are more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last unit, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = batch.column("unit")
            head = unit.index(unit[batch.num_rows - 1]).as_py()
            if held and (head or held[-1].column("unit")[0] != unit[0]):
                yield from work(pa.Table.from_batches([*held, batch.slice(0, head)]))
                held = []
            elif head:
                yield from work(pa.Table.from_batches([batch.slice(0, head)]))
            held.append(batch.slice(head))
        if held:
            yield from work(pa.Table.from_batches(held))

    return rows.repartition("unit").sortWithinPartitions("unit", "t").mapInArrow(run, schema)


def _chunk(table: pa.Table, arrays: list[str], restart: bool = True) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts and lengths of the segments, longest first, and the array columns as matrices."""
    unit, t = table.column("unit").to_numpy(), table.column("t").to_numpy()
    new = unit[1:] != unit[:-1]
    starts = np.flatnonzero(np.r_[True, new | (np.diff(t) != 1) if restart else new])
    size = np.diff(np.r_[starts, len(unit)])
    order = np.argsort(-size, kind="stable")
    flat = [table.column(c).combine_chunks() for c in arrays]
    return starts[order], size[order], [(f.chunk(0) if isinstance(f, pa.ChunkedArray) else f).flatten().to_numpy().reshape(len(unit), -1) for f in flat]


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def filter_states(rows: DataFrame, transition: str, n: int, initial: list[float], restart: bool = True) -> DataFrame:
    """(unit, t, prob): the forward filter a <- P_t a, normalised, of each gapless segment (of each unit without restart).

    rows: unit, t and transition, an array of n * n doubles, to-class by from-class. Segments of a
    chunk go side by side, a time point at once."""
    first = np.array(initial, float)

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        starts, size, (m,) = _chunk(table, [transition], restart)
        p, out, a = m.reshape(-1, n, n), np.empty((len(m), n)), np.tile(first, (len(starts), 1))
        for k in range(size[0]):
            at = starts[: np.searchsorted(-size, -k, "left")] + k
            b = np.einsum("sij,sj->si", p[at], a[: len(at)])
            out[at] = a = b / b.sum(1, keepdims=True)
        yield from pa.table({"unit": table.column("unit"), "t": table.column("t"), "prob": _lists(out)}).combine_chunks().to_batches()

    types = dict(rows.dtypes)
    return by_unit(rows.select("unit", "t", transition), work, f"unit {types['unit']}, t {types['t']}, prob array<double>")


def forward(p: np.ndarray, initial: np.ndarray, evidence: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filtered states of all rows and log-likelihoods of the segments (longest first), side by side."""
    out, loglik, a = np.empty_like(evidence), np.zeros(len(starts)), np.tile(initial, (len(starts), 1))
    for k in range(size[0]):
        at = starts[: np.searchsorted(-size, -k, "left")] + k
        b = evidence[at] * np.einsum("sij,sj->si", p[at], a[: len(at)])
        total = b.sum(1, keepdims=True)
        out[at] = a = np.where(total > 0, b / np.where(total > 0, total, 1), 1 / b.shape[1])
        loglik[: len(at)] += np.log(np.where(total > 0, total, TINY))[:, 0]
    return out, loglik


def backward(p: np.ndarray, evidence: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What comes after each row says of its state, scaled to one."""
    out = np.ones_like(evidence)
    for k in range(1, size[0]):
        own = np.searchsorted(-size, -k, "left")
        at = starts[:own] + size[:own] - 1 - k
        b = np.einsum("sij,si->sj", p[at + 1], evidence[at + 1] * out[at + 1])
        total = b.sum(1, keepdims=True)
        out[at] = np.where(total > 0, b / np.where(total > 0, total, 1), 1 / b.shape[1])
    return out


def _evidence(seen: np.ndarray, c: int) -> np.ndarray:
    return np.where(seen[:, None] >= 0, seen[:, None] == np.arange(c), True).astype(float)


def _marginals(f: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = f * b
    total = both.sum(1, keepdims=True)
    return np.where(total > 0, both / np.where(total > 0, total, 1), 1 / f.shape[1])


def forward_backward(p: np.ndarray, initial: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, float]:
    """Marginals (T, C) and log-likelihood of a chain: p[t, to, from], classes seen or -1."""
    e, one = _evidence(seen, p.shape[1]), (np.zeros(1, np.int64), np.array([len(p)]))
    f, loglik = forward(p, initial, e, *one)
    return _marginals(f, backward(p, e, *one)), float(loglik[0])


def impute(rows: DataFrame, transitions: list[str], classes: tuple[str, ...], initial: list[float], prior: list[float]) -> DataFrame:
    """(unit, t, prob, posterior): marginals of every row of the panel given all observed classes of its block,
    mixed over clusters by the block's posterior.

    rows: block, unit, t, y (null where missing) and for each cluster a transition array. Two passes over
    chunks of units: likelihoods, summed by block in the engine, then marginals with the block's posterior."""
    n, start, clusters = len(classes), np.array(initial, float), len(transitions)
    types = dict(rows.dtypes)
    code = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("y")) - 1, F.lit(-1)).cast("long")
    coded = rows.select("block", "unit", "t", code.alias("seen"), *transitions)

    def chunk(table: pa.Table, extra: list[str]) -> tuple:
        starts, size, arrays = _chunk(table, transitions + extra)
        return starts, size, [a.reshape(-1, n, n) for a in arrays[:clusters]], _evidence(table.column("seen").to_numpy(), n), arrays[clusters:]

    def likelihoods(table: pa.Table) -> Iterator[pa.RecordBatch]:
        starts, size, ps, e, _ = chunk(table, [])
        block = table.column("block").combine_chunks().take(pa.array(starts))
        each = {f"l{g}": pa.array(forward(p, start, e, starts, size)[1]) for g, p in enumerate(ps)}
        summed = pa.table({"block": block, **each}).group_by("block").aggregate([(c, "sum") for c in each])
        yield from summed.select(["block", *(f"{c}_sum" for c in each)]).rename_columns(["block", *each]).combine_chunks().to_batches()

    logs = by_unit(coded, likelihoods, ", ".join([f"block {types['block']}", *(f"l{g} double" for g in range(clusters))]))
    floor = [float(np.log(max(x, TINY))) for x in prior]
    logs = logs.groupBy("block").agg(*[(F.sum(f"l{g}") + floor[g]).alias(f"l{g}") for g in range(clusters)])
    top = F.greatest(*[F.col(f"l{g}") for g in range(clusters)]) if clusters > 1 else F.col("l0")
    odds = [F.exp(F.col(f"l{g}") - top) for g in range(clusters)]
    post = logs.select(F.col("block").alias("_block"), F.array(*[o / sum(odds[1:], odds[0]) for o in odds]).alias("posterior"))

    def marginals(table: pa.Table) -> Iterator[pa.RecordBatch]:
        starts, size, ps, e, (weight,) = chunk(table, ["posterior"])
        mixed = np.zeros_like(e)
        for g, p in enumerate(ps):
            mixed += weight[:, g : g + 1] * _marginals(forward(p, start, e, starts, size)[0], backward(p, e, starts, size))
        yield from pa.table({"unit": table.column("unit"), "t": table.column("t"), "prob": _lists(mixed), "posterior": _lists(weight)}).combine_chunks().to_batches()

    both = coded.join(post, F.col("block").eqNullSafe(F.col("_block"))).drop("_block")
    return by_unit(both, marginals, f"unit {types['unit']}, t {types['t']}, prob array<double>, posterior array<double>")


def plug_in(rows: DataFrame, transition: str, classes: tuple[str, ...], start: str) -> DataFrame:
    """(unit, t, yhat): at each time point the best class given the one predicted before, the first of ties; from start.

    The class before picks a column of the transition array, so each row first becomes a map from class to class;
    rows of a unit meet in one array of those, C numbers a row, and a fold follows it."""
    n = len(classes)
    best = [F.array_position(F.array(*[F.col(transition)[j * n + k] for j in range(n)]), F.greatest(*[F.col(transition)[j * n + k] for j in range(n)])) - 1 for k in range(n)]
    steps = rows.select("unit", "t", F.array(*[b.cast("int") for b in best]).alias("to"))
    ordered = steps.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("t", "to"))).alias("steps"))
    first = F.struct(F.lit(classes.index(start)).alias("k"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        k = x.to[acc.k]
        return F.struct(k.alias("k"), F.array_append(acc.out, k).alias("out"))

    done = ordered.select("unit", F.explode(F.arrays_zip(F.col("steps.t").alias("t"), F.aggregate("steps", first, step, lambda acc: acc.out).alias("k"))).alias("r"))
    return done.select("unit", "r.t", F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("r.k") + 1).alias("yhat"))
