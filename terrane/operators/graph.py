"""Spatial graph: exact nearest neighbours by grid cells, weights, support and Potts terms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _cell(c: str, low: float, size: float) -> Column:
    return F.floor((F.col(c) - low) / size).cast("long")


def nearest(queries: DataFrame, points: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(i, j, d2, rn): the k nearest points (unit, cx, cy) of each query, ties by unit.

    Points lie in square cells of about k points. A query looks at the cells within r of
    its own by an equality join on cells; it is done when its k-th neighbour is nearer than
    the edge of what it has seen, else r doubles. So no pair of far units ever meets, and
    the result is that of comparing all pairs.
    """
    spark = queries.sparkSession
    b = points.agg(F.count("*"), F.min("cx"), F.max("cx"), F.min("cy"), F.max("cy")).first()
    q = queries.agg(F.min("cx"), F.max("cx"), F.min("cy"), F.max("cy")).first()
    n = b[0]
    low_x, low_y = (min(x for x in pair if x is not None) if any(x is not None for x in pair) else 0.0 for pair in ((b[1], q[0]), (b[3], q[2])))
    high_x, high_y = (max(x for x in pair if x is not None) if any(x is not None for x in pair) else 0.0 for pair in ((b[2], q[1]), (b[4], q[3])))
    wide = max(high_x - low_x, high_y - low_y, 1e-12)
    size = wide / max(1, math.isqrt(max(1, n // max(k, 1))))
    most = math.ceil(wide / size) + 1
    p = points.select(F.col("unit").alias("j"), F.col("cx").alias("px"), F.col("cy").alias("py"), _cell("cx", low_x, size).alias("a"), _cell("cy", low_y, size).alias("b"))
    todo = queries.select(F.col("unit").alias("i"), "cx", "cy", _cell("cx", low_x, size).alias("qa"), _cell("cy", low_y, size).alias("qb"))
    want = min(k, n - 1 if exclude_self else n)
    done, r = [], 1
    while True:
        reach = F.sequence(F.lit(-r), F.lit(r))
        around = todo.withColumn("da", F.explode(reach)).withColumn("db", F.explode(reach)).withColumn("a", F.col("qa") + F.col("da")).withColumn("b", F.col("qb") + F.col("db"))
        pairs = around.join(p, ["a", "b"])
        if exclude_self:
            pairs = pairs.where("i <> j")
        pairs = pairs.withColumn("d2", (F.col("cx") - F.col("px")) * (F.col("cx") - F.col("px")) + (F.col("cy") - F.col("py")) * (F.col("cy") - F.col("py")))
        rn = F.row_number().over(W.partitionBy("i").orderBy("d2", "j"))
        found = pairs.withColumn("rn", rn).where(F.col("rn") <= k)
        # beyond the seen cells nothing is nearer than r whole cells
        sure = found.withColumn("n", F.count("*").over(W.partitionBy("i"))).withColumn("far", F.max("d2").over(W.partitionBy("i")))
        ok = (F.col("n") >= want) & (F.col("far") < (r * size) * (r * size)) if r < most else F.lit(True)
        part = sure.where(ok).select("i", "j", "d2", "rn")
        done.append(part)
        if r >= most:
            break
        todo = todo.join(part.select("i").distinct(), "i", "left_anti")
        if todo.isEmpty():
            break
        r *= 2
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def edges(units: DataFrame, k: int = 5, kind: str = "binary", bandwidth: float | None = None, symmetrize: bool = True, row_standardize: bool = False) -> DataFrame:
    """(i, j, w) of the nearest-neighbour graph, both directions."""
    near = nearest(units, units, k, exclude_self=True)
    if kind == "binary":
        w = near.select("i", "j", F.lit(1.0).alias("w"))
    else:
        band = near.sparkSession.createDataFrame([(float(bandwidth),)], "bw double") if bandwidth else median_bandwidth(near)
        w = near.crossJoin(F.broadcast(band)).select("i", "j", F.exp(-F.col("d2") / (F.col("bw") * F.col("bw"))).alias("w"))  # one row
    if symmetrize:
        w = w.union(w.select("j", "i", "w")).groupBy("i", "j").agg(F.max("w").alias("w"))
    if row_standardize:
        total = w.groupBy("i").agg(F.sum("w").alias("total"))
        w = w.join(total, "i").select("i", "j", F.expr("CASE WHEN total = 0 THEN w ELSE w / total END w"))
        if symmetrize:
            w = w.union(w.select("j", "i", "w")).groupBy("i", "j").agg((F.sum("w") / 2).alias("w"))
    return w


def median_bandwidth(near: DataFrame) -> DataFrame:
    """One row bw: the median distance to the last neighbour; the least positive distance, or 1, if that is 0."""
    kth = near.groupBy("i").agg(F.sqrt(F.max("d2")).alias("d"))
    least = near.where("d2 > 0").agg(F.sqrt(F.min("d2")).alias("least"))
    return kth.agg(F.percentile("d", 0.5).alias("m")).crossJoin(least).select(F.expr("CASE WHEN m > 0 THEN m ELSE coalesce(least, 1D) END bw"))  # one row


def support(edge: DataFrame, labels: DataFrame, groups: tuple[int, ...]) -> DataFrame:
    """(unit, h, s): the weight of each unit's neighbours with each label, zeros included."""
    summed = edge.join(labels.select(F.col("unit").alias("j"), F.col("g").alias("h")), "j").groupBy(F.col("i").alias("unit"), "h").agg(F.sum("w").alias("s"))
    full = labels.select("unit", F.explode(F.array(*[F.lit(g) for g in groups])).alias("h"))
    return full.join(summed, ["unit", "h"], "left").select("unit", "h", F.coalesce("s", F.lit(0.0)).alias("s"))


def spatial_bonus(edge: DataFrame, labels: DataFrame) -> DataFrame:
    a, b = labels.select(F.col("unit").alias("i"), F.col("g").alias("gi")), labels.select(F.col("unit").alias("j"), F.col("g").alias("gj"))
    return edge.join(a, "i").join(b, "j").agg((F.sum(F.when(F.col("gi") == F.col("gj"), F.col("w")).otherwise(0.0)) / 2).alias("bonus"))


def log_sum_exp(x: Column) -> Column:
    top = F.array_max(x)
    return top + F.log(F.aggregate(F.transform(x, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v))


def potts(sup: DataFrame, labels: DataFrame, phi: float) -> DataFrame:
    """One row: log pseudo-likelihood of the labels at phi, its score and its information."""
    rows = sup.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("h", "s"))).alias("a")).join(labels, "unit")
    s = F.transform("a", lambda v: v.s)
    z = log_sum_exp(F.transform(s, lambda v: v * phi))
    own = F.filter("a", lambda v: v.h == F.col("g"))[0].s
    rows = rows.select("unit", s.alias("s"), own.alias("own"), z.alias("z")).withColumn("p", F.transform("s", lambda v: F.exp(v * phi - F.col("z"))))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    rows = rows.withColumn("mean", dot(F.col("p"), F.col("s"))).withColumn("square", dot(F.col("p"), F.transform("s", lambda v: v * v)))
    return rows.agg(F.sum(F.col("own") * phi - F.col("z")).alias("logpl"), F.sum(F.col("own") - F.col("mean")).alias("score"), F.sum(F.col("square") - F.col("mean") * F.col("mean")).alias("information"))


def potts_phi(sup: DataFrame, labels: DataFrame, phi_max: float = 20.0, tol: float = 1e-8, steps: int = 100) -> float:
    """The maximiser of the concave log pseudo-likelihood on [0, phi_max], by safeguarded Newton steps on three sums."""
    m, low, high, phi = labels.count(), 0.0, phi_max, 1.0
    if potts(sup, labels, 0.0).first()["score"] <= 0:
        return 0.0
    if potts(sup, labels, phi_max).first()["score"] >= 0:
        return phi_max
    for _ in range(steps):
        r = potts(sup, labels, phi).first()
        if abs(r["score"]) < tol * max(1, m):
            break
        low, high = (phi, high) if r["score"] > 0 else (low, phi)
        step = phi + r["score"] / r["information"] if r["information"] > 0 else high + 1
        phi = step if low < step < high else (low + high) / 2
    return phi


def membership(near: DataFrame, labels: DataFrame, groups: tuple[int, ...], rule: str = "proportion", phi: float = 1.0) -> DataFrame:
    """(i, h, weight) of query units from their neighbours' labels: shares, Potts conditional, or all on the largest."""
    count = near.join(labels.select(F.col("unit").alias("j"), F.col("g").alias("h")), "j").groupBy("i", "h").agg(F.count("*").cast("double").alias("s"))
    full = near.select("i").distinct().withColumn("h", F.explode(F.array(*[F.lit(g) for g in groups])))
    full = full.join(count, ["i", "h"], "left").fillna(0.0, ["s"])
    by = W.partitionBy("i")
    if rule == "proportion":
        weight = F.col("s") / F.sum("s").over(by)
    elif rule == "potts":
        a = F.exp(phi * (F.col("s") - F.max("s").over(by)))
        return full.withColumn("a", a).select("i", "h", (F.col("a") / F.sum("a").over(by)).alias("weight"))
    else:
        weight = (F.row_number().over(by.orderBy(F.desc("s"), "h")) == 1).cast("double")
    return full.select("i", "h", weight.alias("weight"))


def label_changes(edges: DataFrame, support_: DataFrame, labels: DataFrame, groups: tuple[int, ...], phi: float) -> DataFrame:
    """(unit, h, delta): the change of the log pseudo-likelihood when a unit alone moves to cluster h.

    A move changes the unit's own term and, through their support, those of its neighbours."""
    wide = support_.groupBy("unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "s"))), lambda x: x.s).alias("s"))  # one entry a cluster
    own = labels.join(wide, "unit").withColumn("h", F.explode(F.array(*[F.lit(g) for g in groups]))).where("h <> g")
    place = F.create_map(*[F.lit(x) for i, g in enumerate(groups) for x in (g, i)])
    near = edges.join(labels.select(F.col("unit").alias("j"), F.col("g").alias("gj")), "j").join(wide.select(F.col("unit").alias("j"), F.col("s").alias("sj")), "j")
    moved = own.select("unit", "g", "h").join(near, F.col("unit") == F.col("i"))
    new = F.transform("sj", lambda v, k: v + F.col("w") * ((k == place[F.col("h")]).cast("double") - (k == place[F.col("g")]).cast("double")))
    term = phi * F.col("w") * ((F.col("gj") == F.col("h")).cast("double") - (F.col("gj") == F.col("g")).cast("double"))
    norm = log_sum_exp(F.transform(new, lambda v: v * phi)) - log_sum_exp(F.transform("sj", lambda v: v * phi))
    others = moved.groupBy("unit", "h").agg(F.sum(term - norm).alias("x"))
    at = lambda c: F.col("s")[place[F.col(c)]]
    return own.join(others, ["unit", "h"], "left").select("unit", "h", (phi * (at("h") - at("g")) + F.coalesce("x", F.lit(0.0))).alias("delta"))
