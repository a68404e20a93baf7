"""Derived tables over which the operators run: units, observations, panel and fixed coefficients.

Each has a DataFrame builder here and the same definition as a SQL common table
expression in ``CTE``, for comparison by an independent engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.ship import ship

CLASSES = ("A", "N", "R")
EVENTS = ("click", "error", "purchase", "signup", "view")
GROUPS = (1, 2, 3)
TERMS = ("1", "z1", "z2", "z3")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coef(g: int | str, j: int, t: int) -> str:
    """Fixed coefficient of term t for class j in cluster g, as SQL."""
    return f"(CAST((({7 * t + 3 * j} + 5 * {g}) % 11) - 5 AS DOUBLE) / 10)"


def eta(g: int | str, j: int, terms: tuple[str, ...] = TERMS) -> str:
    """Linear predictor of class j in cluster g, as SQL."""
    return " + ".join(coef(g, j, t) if x == "1" else f"{coef(g, j, t)} * {x}" for t, x in enumerate(terms))


def softmax_sql(etas: list[str]) -> list[str]:
    """Max-shifted softmax of scalar SQL expressions that are column names."""
    top = f"greatest({', '.join(etas)})"
    total = " + ".join(f"exp({e} - {top})" for e in etas)
    return [f"exp({e} - {top}) / ({total})" for e in etas]


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("unit"), ((k * 7919 % 1009).cast("double") / 1009).alias("cx"), ((k * 104729 % 997).cast("double") / 997).alias("cy"),
        F.col("s_nationkey").cast("int").alias("stratum"), (F.col("s_nationkey") % 3 + 1).cast("int").alias("g0"),
    )


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("unit"), F.col("l_returnflag").alias("y"), F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"), F.col("l_tax").alias("x3"),
    )


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with unit columns, probabilities p0..p2 under their unit's fixed cluster, and the first best class."""
    rows = obs(spark, sf_dir).join(units(spark, sf_dir), "unit").selectExpr("*", "x1 / 50 z1", "x2 * 10 z2", "x3 * 10 z3")
    rows = rows.selectExpr("*", *[f"{eta('g0', j)} e{j}" for j in range(3)])
    rows = rows.selectExpr("*", *[f"{p} p{j}" for j, p in enumerate(softmax_sql(["e0", "e1", "e2"]))])
    return rows.withColumn("yhat", F.expr(BEST))


BEST = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'A' WHEN p1 >= p2 THEN 'N' ELSE 'R' END"


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a user and day: the class of the day's last event and two daily predictors."""
    e = table(spark, sf_dir, "events").withColumn("t", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long"))
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    return e.groupBy(F.col("user_id").alias("unit"), "t").agg(
        last.alias("y"), F.avg("value").alias("x1"), F.count("*").cast("double").alias("x2"), F.first((F.col("user_id") % 50).cast("long")).alias("block"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")


_E = [f"{eta('g0', j)} e{j}" for j in range(3)]
CTE = {
    "units": "units AS (SELECT s_suppkey AS unit, CAST(s_suppkey * 7919 % 1009 AS DOUBLE) / 1009 AS cx, CAST(s_suppkey * 104729 % 997 AS DOUBLE) / 997 AS cy, CAST(s_nationkey AS INTEGER) AS stratum, CAST(s_nationkey % 3 + 1 AS INTEGER) AS g0 FROM supplier)",
    "obs": "obs AS (SELECT l_suppkey AS unit, l_returnflag AS y, l_quantity AS x1, l_discount AS x2, l_tax AS x3 FROM lineitem)",
    "pred": "p1 AS (SELECT o.*, u.cx, u.cy, u.stratum, u.g0, x1 / 50 AS z1, x2 * 10 AS z2, x3 * 10 AS z3 FROM obs o JOIN units u USING (unit)), p2 AS (SELECT *, "
    + ", ".join(_E) + " FROM p1), p3 AS (SELECT *, " + ", ".join(f"{p} p{j}" for j, p in enumerate(softmax_sql(["e0", "e1", "e2"]))) + f" FROM p2), pred AS (SELECT *, {BEST} AS yhat FROM p3)",
    "panel": "panel AS (SELECT user_id AS unit, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS t, arg_max(event_type, (ts, event_id)) AS y, avg(value) AS x1, CAST(count(*) AS DOUBLE) AS x2, CAST(any_value(user_id % 50) AS BIGINT) AS block FROM events GROUP BY 1, 2)",
    "edges": "dd AS (SELECT a.unit AS i, b.unit AS j, (a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy) AS d2 FROM units a JOIN units b ON a.unit <> b.unit), nn AS (SELECT i, j, d2 FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS rn FROM dd) WHERE rn <= 5), edges AS (SELECT DISTINCT i, j, CAST(1 AS DOUBLE) AS w FROM (SELECT i, j FROM nn UNION ALL SELECT j, i FROM nn))",
    "support": "gs AS (SELECT unnest([1, 2, 3]) AS h), support AS (SELECT u.unit, gs.h, CAST(coalesce(sum(CASE WHEN v.g0 = gs.h THEN e.w END), 0) AS DOUBLE) AS s FROM units u CROSS JOIN gs LEFT JOIN edges e ON e.i = u.unit LEFT JOIN units v ON v.unit = e.j GROUP BY 1, 2)",
}


def with_ctes(names: str, body: str) -> str:
    """WITH the named tables; body goes on with a comma and more tables, or with SELECT."""
    return "WITH " + ", ".join(CTE[n] for n in names.split()) + ("" if body.startswith(",") else " ") + body
