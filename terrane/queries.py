"""One query for each operator, over the derived tables, with DuckDB SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.functions.draws import draw, draw_sql
from terrane.operators import graph, metrics, panels, reports, splits
from terrane.plans import fixtures as fx
from terrane.plans.fixtures import CLASSES, EVENTS, GROUPS, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PROBS = ("p0", "p1", "p2")


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})


def r6(*cols: str) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in cols)


def big(*cols: str) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in cols)


def labels(spark: SparkSession, d: str) -> DataFrame:
    return fx.units(spark, d).select("unit", F.col("g0").alias("g"))


_CLASS = "c AS (SELECT unnest(['A','N','R']) AS class)"
_CM = f"""{_CLASS}, m AS (SELECT stratum, class, count(*) FILTER (WHERE y = class AND yhat = class) tp, count(*) FILTER (WHERE y <> class AND yhat = class) fp,
 count(*) FILTER (WHERE y = class AND yhat <> class) fn, count(*) FILTER (WHERE y <> class AND yhat <> class) tn FROM pred CROSS JOIN c GROUP BY 1, 2),
 r AS (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) END AS recall,
 CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) END AS specificity, CASE WHEN tp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS f1, tp + fn AS support FROM m)"""
_KAPPA = """cell AS (SELECT stratum, y, yhat, count(*) n FROM pred GROUP BY 1, 2, 3), tot AS (SELECT stratum, CAST(sum(n) AS DOUBLE) t, sum(n) FILTER (WHERE y = yhat) same FROM cell GROUP BY 1),
 ma AS (SELECT stratum, y c, sum(n) na FROM cell GROUP BY 1, 2), mb AS (SELECT stratum, yhat c, sum(n) nb FROM cell GROUP BY 1, 2), ch AS (SELECT stratum, CAST(sum(na * nb) AS DOUBLE) e FROM ma JOIN mb USING (stratum, c) GROUP BY 1),
 kp AS (SELECT stratum, CASE WHEN abs(1 - e / (t * t)) >= 1e-12 THEN (coalesce(same, 0) / t - e / (t * t)) / (1 - e / (t * t)) END AS kappa FROM tot JOIN ch USING (stratum))"""
_TRUE = "greatest(CASE y WHEN 'A' THEN p0 WHEN 'N' THEN p1 ELSE p2 END, CAST(1e-15 AS DOUBLE))"
_BRIER = " + ".join(f"(p{j} - CAST(y = '{c}' AS INTEGER)) * (p{j} - CAST(y = '{c}' AS INTEGER))" for j, c in enumerate(CLASSES))


@query(with_ctes("units obs pred", f", {_CM} SELECT stratum, class, {big('tp', 'fp', 'fn', 'tn')}, {r6('precision', 'recall', 'specificity', 'f1')}, {big('support')}, round((recall + specificity) / 2, 6) AS balanced FROM r"))
def a01_class_metrics(spark, d):
    return rounded(metrics.class_metrics(fx.predicted(spark, d), CLASSES, ("stratum",)), "precision", "recall", "specificity", "f1", "balanced")


@query(with_ctes("units obs pred", f", {_KAPPA} SELECT stratum, {r6('kappa')} FROM kp"))
def a02_kappa(spark, d):
    return rounded(metrics.kappa(fx.predicted(spark, d), ("stratum",)), "kappa")


@query(with_ctes("units obs pred", f"SELECT stratum, round(-avg(ln({_TRUE})), 6) AS logloss FROM pred GROUP BY 1"))
def a03_logloss(spark, d):
    return rounded(fx.predicted(spark, d).groupBy("stratum").agg(metrics.losses(CLASSES, PROBS)[0].alias("logloss")), "logloss")


@query(with_ctes("units obs pred", f"SELECT stratum, round(avg({_BRIER}), 6) AS brier FROM pred GROUP BY 1"))
def a04_brier(spark, d):
    return rounded(fx.predicted(spark, d).groupBy("stratum").agg(metrics.losses(CLASSES, PROBS)[1].alias("brier")), "brier")


@query(with_ctes("units obs pred", f""", {_CM}, {_KAPPA}, mn AS (SELECT stratum, CAST(count(*) AS BIGINT) AS n, avg(CAST(y = yhat AS INTEGER)) AS accuracy, -avg(ln({_TRUE})) AS logloss, avg({_BRIER}) AS brier FROM pred GROUP BY 1),
 ec AS (SELECT stratum, avg(f1) AS macro_f1, avg(precision) AS macro_precision, sum(coalesce(precision, 0) * support) / sum(support) AS weighted_precision FROM r GROUP BY 1)
 SELECT stratum, n, {r6('accuracy', 'logloss', 'brier', 'kappa', 'macro_f1', 'macro_precision', 'weighted_precision')} FROM mn JOIN kp USING (stratum) JOIN ec USING (stratum)"""))
def a05_overall_metrics(spark, d):
    return rounded(metrics.overall_metrics(fx.predicted(spark, d), CLASSES, PROBS, ("stratum",)), "accuracy", "logloss", "brier", "kappa", "macro_f1", "macro_precision", "weighted_precision")


@query(with_ctes("obs", "SELECT unit, CAST(count(*) AS BIGINT) AS n, " + ", ".join(f"CAST(count(*) FILTER (WHERE y = '{c}') AS BIGINT) AS n_{c}" for c in CLASSES) + " FROM obs GROUP BY 1"))
def a06_unit_contributions(spark, d):
    return fx.obs(spark, d).groupBy("unit").agg(F.count("*").alias("n"), *[F.count_if(F.col("y") == c).alias(f"n_{c}") for c in CLASSES])


@query(with_ctes("units obs", "SELECT gs.g, CAST(count(DISTINCT u.unit) AS BIGINT) AS units, CAST(count(o.unit) AS BIGINT) AS n, " + ", ".join(f"CAST(count(*) FILTER (WHERE y = '{c}') AS BIGINT) AS n_{c}" for c in CLASSES) + " FROM (SELECT unnest([1, 2, 3, 4]) AS g) gs LEFT JOIN units u ON u.g0 = gs.g LEFT JOIN obs o ON o.unit = u.unit GROUP BY 1"))
def a07_cluster_counts(spark, d):
    per = a06_unit_contributions(spark, d).join(labels(spark, d), "unit").groupBy("g").agg(F.count("*").alias("units"), F.sum("n").alias("n"), *[F.sum(f"n_{c}").alias(f"n_{c}") for c in CLASSES])
    return spark.range(1, 5).select(F.col("id").cast("int").alias("g")).join(per, "g", "left").fillna(0)


@query(with_ctes("units obs", "SELECT min(CASE WHEN units >= 3 AND least(a, b, c) >= 5 THEN 1 ELSE 0 END) = 1 AS feasible FROM (SELECT g0, count(DISTINCT unit) units, count(*) FILTER (WHERE y='A') a, count(*) FILTER (WHERE y='N') b, count(*) FILTER (WHERE y='R') c FROM units JOIN obs USING (unit) GROUP BY 1)"))
def a08_feasible(spark, d):
    return a07_cluster_counts(spark, d).where("g <= 3").agg(F.bool_and((F.col("units") >= 3) & (F.least(*[F.col(f"n_{c}") for c in CLASSES]) >= 5)).alias("feasible"))


def _ll(g: int) -> str:
    e = [f"({fx.eta(g, j)})" for j in range(3)]
    top = f"greatest({', '.join(e)})"
    return f"(CASE y WHEN 'A' THEN {e[0]} WHEN 'N' THEN {e[1]} ELSE {e[2]} END) - {top} - ln({' + '.join(f'exp({x} - {top})' for x in e)})"


@query(with_ctes("obs", "SELECT unit, " + ", ".join(f"round(sum({_ll(g)}), 4) AS ll{g}" for g in GROUPS) + " FROM (SELECT *, x1 / 50 z1, x2 * 10 z2, x3 * 10 z3 FROM obs) GROUP BY 1"))
def a09_unit_loglik(spark, d):
    z = fx.obs(spark, d).selectExpr("unit", "y", "x1 / 50 z1", "x2 * 10 z2", "x3 * 10 z3")
    return z.groupBy("unit").agg(*[F.round(F.sum(F.expr(_ll(g))), 4).alias(f"ll{g}") for g in GROUPS])


@query(with_ctes("units edges", "SELECT i, j, w FROM edges"))
def j06_knn_edges(spark, d):
    return graph.edges(fx.units(spark, d))


@query(with_ctes("units edges", "SELECT round(sum(CASE WHEN a.g0 = b.g0 THEN w ELSE 0 END) / 2, 6) AS bonus FROM edges JOIN units a ON a.unit = i JOIN units b ON b.unit = j"))
def a10_spatial_bonus(spark, d):
    return rounded(graph.spatial_bonus(graph.edges(fx.units(spark, d)), labels(spark, d)), "bonus")


@query(with_ctes("units edges support", "SELECT unit, h, s FROM support"))
def a12_potts_support(spark, d):
    return graph.support(graph.edges(fx.units(spark, d)), labels(spark, d), GROUPS)


_POTTS = "q AS (SELECT unit, max(s) AS m FROM support GROUP BY 1), e AS (SELECT s.unit, h, s, exp(s - m) AS x, m FROM support s JOIN q USING (unit)), t AS (SELECT unit, sum(x) AS z, sum(x * s) / sum(x) AS mean, sum(x * s * s) / sum(x) AS sq, any_value(m) AS m FROM e GROUP BY 1), o AS (SELECT u.unit, s AS own FROM units u JOIN support s ON s.unit = u.unit AND s.h = u.g0)"


@query(with_ctes("units edges support", f", {_POTTS} SELECT round(sum(own - m - ln(z)), 6) AS logpl, round(sum(own - mean), 6) AS score, round(sum(sq - mean * mean), 6) AS information FROM t JOIN o USING (unit)"))
def a11_potts_logpl(spark, d):
    return rounded(graph.potts(a12_potts_support(spark, d), labels(spark, d), 1.0), "logpl", "score", "information")


@query("SELECT true AS bounded, true AS stationary")
def m18_potts_phi(spark, d):
    s, g = a12_potts_support(spark, d).cache(), labels(spark, d).cache()
    phi = graph.potts_phi(s, g)
    score = graph.potts(s, g, phi).first()["score"]
    good = abs(score) < 1e-6 * max(1, g.count()) or (phi == 0 and score <= 0) or (phi == 20 and score >= 0)
    return spark.createDataFrame([(0 <= phi <= 20, bool(good))], "bounded boolean, stationary boolean")


@query(with_ctes("units edges", ", near AS (SELECT *, sqrt(d2) d FROM nn), bw AS (SELECT quantile_cont(d, 0.5) bw FROM (SELECT i, max(d) d FROM near GROUP BY 1)) SELECT i, j, round(max(exp(-d2 / (bw * bw))), 6) AS w FROM (SELECT i, j, d2 FROM nn UNION ALL SELECT j, i, d2 FROM nn), bw GROUP BY 1, 2"))
def m20_exponential_weights(spark, d):
    return rounded(graph.edges(fx.units(spark, d), kind="exp"), "w")


@query(with_ctes("units edges", ", t AS (SELECT i, sum(w) t FROM edges GROUP BY 1), s AS (SELECT e.i, e.j, w / t AS w FROM edges e JOIN t USING (i)) SELECT i, j, round(sum(w) / 2, 6) AS w FROM (SELECT i, j, w FROM s UNION ALL SELECT j, i, w FROM s) GROUP BY 1, 2"))
def m20_row_standardized(spark, d):
    return rounded(graph.edges(fx.units(spark, d), row_standardize=True), "w")


@query(with_ctes("units", "SELECT unit, cx, cy FROM units"))
def m21_unit_coords(spark, d):
    return fx.units(spark, d).select("unit", "cx", "cy").distinct()


_KNEW = ", q AS (SELECT c_custkey AS i, CAST(c_custkey * 7907 % 1013 AS DOUBLE) / 1013 AS qx, CAST(c_custkey * 7901 % 991 AS DOUBLE) / 991 AS qy FROM customer), kq AS (SELECT * FROM (SELECT i, unit AS j, g0, (qx - cx) * (qx - cx) + (qy - cy) * (qy - cy) AS d2, row_number() OVER (PARTITION BY i ORDER BY (qx - cx) * (qx - cx) + (qy - cy) * (qy - cy), unit) AS rn FROM q, units) WHERE rn <= 5)"


def _query_units(spark, d):
    k = F.col("c_custkey")
    return fx.table(spark, d, "customer").select(k.alias("unit"), ((k * 7907 % 1013).cast("double") / 1013).alias("cx"), ((k * 7901 % 991).cast("double") / 991).alias("cy"))


def _near(spark, d):
    return graph.nearest(_query_units(spark, d), fx.units(spark, d), 5)


@query(with_ctes("units", f"{_KNEW} SELECT i, j, round(d2, 9) AS d2, CAST(rn AS INTEGER) AS rn FROM kq"))
def j07_knn_queries(spark, d):
    return _near(spark, d).withColumn("d2", F.round("d2", 9))


@query(with_ctes("units", f"{_KNEW} SELECT i, j FROM kq WHERE rn = 1"))
def j08_nearest_anchor(spark, d):
    return graph.nearest(_query_units(spark, d), fx.units(spark, d), 1).select("i", "j")


_SHARE = f"{_KNEW}, f AS (SELECT i, h, CAST(count(*) FILTER (WHERE g0 = h) AS DOUBLE) AS s FROM kq CROSS JOIN (SELECT unnest([1, 2, 3]) AS h) GROUP BY 1, 2)"


@query(with_ctes("units", f"{_SHARE} SELECT i, h, round(s / sum(s) OVER (PARTITION BY i), 6) AS weight FROM f"))
def m29_membership_proportion(spark, d):
    return rounded(graph.membership(_near(spark, d), labels(spark, d), GROUPS), "weight")


@query(with_ctes("units", f"{_SHARE} SELECT i, h, round(exp(s) / sum(exp(s)) OVER (PARTITION BY i), 6) AS weight FROM f"))
def m29_membership_potts(spark, d):
    return rounded(graph.membership(_near(spark, d), labels(spark, d), GROUPS, "potts"), "weight")


@query(with_ctes("units", f"{_SHARE} SELECT i, h, CASE WHEN row_number() OVER (PARTITION BY i ORDER BY s DESC, h) = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS weight FROM f"))
def m29_membership_majority(spark, d):
    return graph.membership(_near(spark, d), labels(spark, d), GROUPS, "majority")


@query(with_ctes("units", "SELECT round((SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*)::DOUBLE n FROM units GROUP BY g0, stratum % 4)), 6) AS ij"))
def a16_pair_sums(spark, d):
    n = fx.units(spark, d).groupBy("g0", F.expr("stratum % 4 AS s")).count()
    return rounded(n.agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("ij")), "ij")


_ARI = ", c AS (SELECT g0 a, stratum % 4 b, count(*)::DOUBLE n FROM units GROUP BY 1, 2), v AS (SELECT (SELECT sum(n*(n-1)/2) FROM c) ij, (SELECT sum(n) FROM c) t, (SELECT sum(n*(n-1)/2) FROM (SELECT sum(n) n FROM c GROUP BY a)) sa, (SELECT sum(n*(n-1)/2) FROM (SELECT sum(n) n FROM c GROUP BY b)) sb) SELECT round((ij - sa*sb/(t*(t-1)/2)) / ((sa+sb)/2 - sa*sb/(t*(t-1)/2)), 6) AS ari FROM v"


@query(with_ctes("units", _ARI))
def a16_adjusted_rand(spark, d):
    return rounded(metrics.adjusted_rand(fx.units(spark, d).withColumn("b", F.expr("stratum % 4")), "g0", "b"), "ari")


@query(with_ctes("units", _ARI))
def a17_adjusted_rand_null(spark, d):
    return rounded(metrics.adjusted_rand(fx.units(spark, d).withColumn("b", F.expr("stratum % 4")), "g0", "b", "null"), "ari")


_T = " ".join(f"WHEN {k} THEN {v}" for k, v in reports.T975.items())
_Z = 1.959963984540054
_TAIL = f"({_Z} + {(_Z**3 + _Z) / 4!r} / v + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96!r} / (v * v) + {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384!r} / (v * v * v))"


@query(f"WITH l AS (SELECT c_nationkey AS nation, 'c_acctbal' AS metric, c_acctbal AS value FROM customer UNION ALL SELECT c_nationkey, 'c_custkey', CAST(c_custkey AS DOUBLE) FROM customer), a AS (SELECT nation, metric, CAST(count(*) AS BIGINT) n, avg(value) mean, stddev_samp(value) / sqrt(count(*)) mcse, CAST(count(*) - 1 AS DOUBLE) v FROM l GROUP BY 1, 2), b AS (SELECT *, (CASE CAST(v AS INTEGER) {_T} ELSE {_TAIL} END) * mcse AS half FROM a) SELECT nation, metric, n, round(mean, 4) AS mean, round(mcse, 4) AS mcse, round(mean - half, 4) AS low, round(mean + half, 4) AS high FROM b")
def a18_summary(spark, d):
    c = fx.table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_acctbal", F.col("c_custkey").cast("double").alias("c_custkey"))
    out = reports.summary(c, ("nation",), ("c_acctbal", "c_custkey"))
    return out.withColumns({k: F.round(k, 4) for k in ("mean", "mcse", "low", "high")})


@query("SELECT CAST(count(*) FILTER (WHERE s AND a) AS BIGINT) tp, CAST(count(*) FILTER (WHERE s AND NOT a) AS BIGINT) fp, CAST(count(*) FILTER (WHERE NOT s AND a) AS BIGINT) fn, CAST(count(*) FILTER (WHERE NOT s AND NOT a) AS BIGINT) tn, round(count(*) FILTER (WHERE s AND a) / nullif(CAST(count(*) FILTER (WHERE a) AS DOUBLE), 0), 6) AS tpr, round(2 * count(*) FILTER (WHERE s AND a) / nullif(CAST(count(*) FILTER (WHERE s) + count(*) FILTER (WHERE a) AS DOUBLE), 0), 6) AS f1 FROM (SELECT p_size > 25 AS s, p_retailprice > 500 AS a FROM part)")
def a19_selection_support(spark, d):
    p = fx.table(spark, d, "part").select((F.col("p_size") > 25).alias("s"), (F.col("p_retailprice") > 500).alias("a"))
    s, a = F.col("s"), F.col("a")
    out = p.agg(F.count_if(s & a).alias("tp"), F.count_if(s & ~a).alias("fp"), F.count_if(~s & a).alias("fn"), F.count_if(~s & ~a).alias("tn"))
    return rounded(out.withColumns({"tpr": F.expr("try_divide(tp, tp + fn)"), "f1": F.expr("try_divide(2 * tp, 2 * tp + fp + fn)")}), "tpr", "f1")


@query(with_ctes("panel", "SELECT y, CAST(count(*) AS BIGINT) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM panel GROUP BY y").replace("SELECT y, CAST", "SELECT 0 AS k, y, CAST"))
def a24_frequency(spark, d):
    return rounded(reports.frequency(fx.panel(spark, d).withColumn("k", F.lit(0)), ("k",), "y"), "share")


@query(with_ctes("panel", "SELECT b, m, y, CAST(n AS BIGINT) AS n, round(n / CAST(nullif(sum(n) OVER (PARTITION BY b, m), 0) AS DOUBLE), 6) AS share FROM (SELECT k.b, k.m, k.y, count(p.y) n FROM (SELECT * FROM (SELECT DISTINCT block % 5 AS b, t // 10 AS m FROM panel) CROSS JOIN (SELECT unnest(['click','error','purchase','signup','view']) AS y)) k LEFT JOIN panel p ON p.block % 5 = k.b AND p.t // 10 = k.m AND p.y = k.y GROUP BY 1, 2, 3)"))
def a25_phase_calendar(spark, d):
    p = fx.panel(spark, d).selectExpr("block % 5 b", "t div 10 m", "y")
    wide = p.groupBy("b", "m").agg(*[F.count_if(F.col("y") == c).alias(c) for c in EVENTS])
    long = wide.unpivot(["b", "m"], list(EVENTS), "y", "n")
    return rounded(long.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("b", "m"))), "share")


@query(with_ctes("units", "SELECT g0, " + ", ".join(f"CAST(count(*) FILTER (WHERE stratum % 5 = {s}) AS BIGINT) AS r{s}" for s in range(5)) + " FROM units GROUP BY 1"))
def a26_crosstab(spark, d):
    out = fx.units(spark, d).withColumn("r", F.expr("stratum % 5")).groupBy("g0").pivot("r", [0, 1, 2, 3, 4]).count().fillna(0)
    return out.select("g0", *[F.col(str(s)).alias(f"r{s}") for s in range(5)])


@query(with_ctes("units", "SELECT stratum, round(avg(cx), 6) AS cx, round(avg(cy), 6) AS cy, CAST(count(*) AS BIGINT) AS n FROM (SELECT stratum, unit % 7 AS sub, avg(cx) cx, avg(cy) cy FROM units GROUP BY 1, 2) GROUP BY 1"))
def a27_two_level_mean(spark, d):
    sub = fx.units(spark, d).groupBy("stratum", F.expr("unit % 7 AS sub")).agg(F.avg("cx").alias("cx"), F.avg("cy").alias("cy"))
    return rounded(sub.groupBy("stratum").agg(F.avg("cx").alias("cx"), F.avg("cy").alias("cy"), F.count("*").alias("n")), "cx", "cy")


_FOLD_ROWS = "r AS (SELECT o_orderkey % 5 AS fold, o_orderpriority AS method, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)"


@query(f"WITH {_FOLD_ROWS} SELECT a.method, round(avg(a.v - b.v), 4) AS mean, round(stddev_samp(a.v - b.v) / sqrt(count(*)), 4) AS se, CAST(count(*) AS BIGINT) AS n FROM r a JOIN r b ON a.fold = b.fold AND b.method = (SELECT min(o_orderpriority) FROM orders) WHERE a.method <> (SELECT min(o_orderpriority) FROM orders) GROUP BY 1")
def a28_paired_difference(spark, d):
    o = fx.table(spark, d, "orders")
    base = o.agg(F.min("o_orderpriority")).first()[0]
    r = o.groupBy((F.col("o_orderkey") % 5).alias("fold"), F.col("o_orderpriority").alias("method")).agg(F.avg("o_totalprice").alias("v"))
    out = reports.paired_difference(r, "fold", "method", "v", base)
    return out.withColumns({"mean": F.round("mean", 4), "se": F.round("se", 4)})


@query(with_ctes("panel", f", s AS (SELECT block, sum(x1 - 40) v, CAST(count(*) AS DOUBLE) n, row_number() OVER (ORDER BY block) - 1 AS no FROM panel GROUP BY 1), c AS (SELECT count(*) m FROM s), pl AS (SELECT b, k, {draw_sql(7, 'b', 'k')} % m AS no FROM (SELECT unnest(range(200)) AS b), c, LATERAL (SELECT unnest(range(m)) AS k)), e AS (SELECT b, sum(v) / sum(n) AS stat FROM pl JOIN s USING (no) GROUP BY 1) SELECT round(quantile_cont(stat, 0.025), 6) AS low, round(quantile_cont(stat, 0.975), 6) AS high, round(avg(CASE WHEN stat > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive FROM e"))
def a29_cluster_bootstrap(spark, d):
    s = fx.panel(spark, d).groupBy("block").agg(F.sum(F.col("x1") - 40).alias("v"), F.count("*").cast("double").alias("n"))
    return rounded(reports.bootstrap(s, "block", "v", "n", 200, 7), "low", "high", "positive")


@query(with_ctes("units edges", ", a AS (SELECT e.i, avg(CASE WHEN u.g0 = v.g0 THEN CAST(1 AS DOUBLE) ELSE 0 END) s FROM edges e JOIN units u ON u.unit = e.i JOIN units v ON v.unit = e.j GROUP BY 1) SELECT round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 6) AS median, round(min(s), 6) AS least, round(avg(CASE WHEN s < 0.5 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS below FROM a"))
def a30_coherence(spark, d):
    g = labels(spark, d)
    e = graph.edges(fx.units(spark, d)).join(g.select(F.col("unit").alias("i"), F.col("g").alias("gi")), "i").join(g.select(F.col("unit").alias("j"), F.col("g").alias("gj")), "j")
    a = e.groupBy("i").agg(F.avg((F.col("gi") == F.col("gj")).cast("double")).alias("s"))
    return rounded(a.agg(F.avg("s").alias("mean"), F.median("s").alias("median"), F.min("s").alias("least"), F.avg((F.col("s") < 0.5).cast("double")).alias("below")), "mean", "median", "least", "below")


@query(with_ctes("panel", "SELECT unit, bool_and(coalesce(t > p, true)) AS monotone FROM (SELECT unit, t, lag(t) OVER (PARTITION BY unit ORDER BY t) p FROM panel) GROUP BY 1"))
def a31_monotone(spark, d):
    p = fx.panel(spark, d).withColumn("p", F.lag("t").over(W.partitionBy("unit").orderBy("t")))
    return p.groupBy("unit").agg(F.bool_and(F.coalesce(F.col("t") > F.col("p"), F.lit(True))).alias("monotone"))


@query(with_ctes("units edges", "SELECT round(avg(s), 6) AS share FROM (SELECT e.i, avg(CASE WHEN u.stratum = v.stratum THEN CAST(1 AS DOUBLE) ELSE 0 END) s FROM edges e JOIN units u ON u.unit = e.i JOIN units v ON v.unit = e.j GROUP BY 1)"))
def a33_within_block(spark, d):
    u = fx.units(spark, d)
    e = graph.edges(u).join(u.select(F.col("unit").alias("i"), F.col("stratum").alias("si")), "i").join(u.select(F.col("unit").alias("j"), F.col("stratum").alias("sj")), "j")
    return rounded(e.groupBy("i").agg(F.avg((F.col("si") == F.col("sj")).cast("double")).alias("s")).agg(F.avg("s").alias("share")), "share")


_LAGC = ", ".join(f"CASE WHEN q.y IS NOT NULL THEN CAST(q.y = '{c}' AS INTEGER)::DOUBLE END AS lag_{c}" for c in EVENTS)


@query(with_ctes("panel", f"SELECT p.unit, p.t, p.y, q.y AS lag, q.y IS NOT NULL AS available, {_LAGC} FROM panel p LEFT JOIN panel q ON q.unit = p.unit AND q.t = p.t - 1"))
def w01_lag_design(spark, d):
    return panels.lag_design(fx.panel(spark, d).select("unit", "t", "y"), EVENTS)


@query(with_ctes("panel", "SELECT unit, t, restart, CAST(sum(CASE WHEN restart THEN 1 ELSE 0 END) OVER (PARTITION BY unit ORDER BY t) AS BIGINT) AS segment FROM (SELECT unit, t, coalesce(t - lag(t) OVER (PARTITION BY unit ORDER BY t) <> 1, true) AS restart FROM panel)"))
def w03_segments(spark, d):
    return panels.segments(fx.panel(spark, d).select("unit", "t"))


@query(with_ctes("panel", "SELECT unit, t, coalesce(last_value(CASE WHEN t % 3 <> 0 THEN y END IGNORE NULLS) OVER (PARTITION BY unit ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'view') AS carried FROM panel"))
def j09_carry_forward(spark, d):
    p = fx.panel(spark, d).selectExpr("unit", "t", "CASE WHEN t % 3 <> 0 THEN y END y")
    return panels.carry_forward(p, F.lit("view")).select("unit", "t", "carried")


def _rank_sql(seed: int, key: str, by: str) -> str:
    return f"row_number() OVER (PARTITION BY {by} ORDER BY {draw_sql(seed, key)}, {key})"


@query(f"SELECT event_id, rk <= CASE WHEN n > 1 THEN least(n - 1, greatest(1, ceil(CAST(0.3 AS DOUBLE) * n))) ELSE 0 END AS is_test FROM (SELECT event_id, {_rank_sql(11, 'event_id', 'event_type')} AS rk, count(*) OVER (PARTITION BY event_type) AS n FROM events)")
def f01_stratified_split(spark, d):
    return splits.stratified_split(fx.events(spark, d), "event_id", ("event_type",), 0.3, 11)


@query(f"SELECT event_id, CAST((rk - 1) % least(10, m) + 1 AS INTEGER) AS fold FROM (SELECT event_id, {_rank_sql(12, 'event_id', 'event_type')} AS rk FROM events), (SELECT min(c) m FROM (SELECT count(*) c FROM events GROUP BY event_type))")
def f02_stratified_folds(spark, d):
    return splits.stratified_folds(fx.events(spark, d), "event_id", "event_type", 10, 12)


@query(with_ctes("units", f", z AS (SELECT stratum, count(*) n FROM units GROUP BY 1), o AS (SELECT stratum, coalesce(sum(n) OVER (ORDER BY stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM z) SELECT unit, CAST((b + rk - 1) % 5 + 1 AS INTEGER) AS fold FROM (SELECT unit, stratum, {_rank_sql(13, 'unit', 'stratum')} AS rk FROM units) JOIN o USING (stratum)"))
def f03_block_folds(spark, d):
    return splits.block_folds(fx.units(spark, d), "unit", "stratum", 5, 13)


@query(with_ctes("panel", "SELECT unit, t, CASE WHEN t <= 20 THEN 'train' ELSE 'test' END AS part FROM panel WHERE t <= 26"))
def f04_temporal_split(spark, d):
    return fx.panel(spark, d).where("t <= 26").select("unit", "t", F.when(F.col("t") <= 20, "train").otherwise("test").alias("part"))


@query(with_ctes("panel", f", m AS (SELECT unit, t, {draw_sql(14, 'unit', 't')} % 10 < 3 AS masked FROM panel) SELECT unit, t FROM m WHERE NOT masked AND NOT EXISTS (SELECT 1 FROM m p WHERE p.unit = m.unit AND p.t = m.t - 1 AND p.masked)"))
def f05_random_mask(spark, d):
    m = fx.panel(spark, d).select("unit", "t", (draw(14, "unit", "t") % 10 < 3).alias("masked"))
    bad = m.where("masked").select("unit", F.col("t")).union(m.where("masked").select("unit", F.col("t") + 1)).distinct()
    return m.select("unit", "t").join(bad, ["unit", "t"], "left_anti")


@query(with_ctes("units obs", f", h AS (SELECT unit FROM units WHERE {draw_sql(15, 'unit')} % 5 = 0) SELECT CAST(count(*) FILTER (WHERE unit IN (SELECT unit FROM h)) AS BIGINT) AS test, CAST(count(*) FILTER (WHERE unit NOT IN (SELECT unit FROM h)) AS BIGINT) AS train FROM obs"))
def f06_holdout_units(spark, d):
    held = fx.units(spark, d).where(draw(15, "unit") % 5 == 0).select("unit", F.lit(1).alias("h"))
    return fx.obs(spark, d).join(held, "unit", "left").agg(F.count_if(F.col("h") == 1).alias("test"), F.count_if(F.col("h").isNull()).alias("train"))


@query("SELECT CAST(count(*) FILTER (WHERE l_quantity IS NULL OR isnan(l_quantity)) AS BIGINT) AS bad, CAST(count(DISTINCT l_returnflag) AS BIGINT) AS levels, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS units FROM lineitem")
def p01_validate(spark, d):
    return fx.obs(spark, d).agg(F.count_if(F.col("x1").isNull() | F.isnan("x1")).alias("bad"), F.countDistinct("y").alias("levels"), F.countDistinct("unit").alias("units"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'browse' ELSE event_type END AS phase FROM events WHERE event_type <> 'error' AND value IS NOT NULL")
def p04_recode_filter(spark, d):
    e = fx.events(spark, d).where("event_type <> 'error'").dropna(subset=["value"])
    return e.select("event_id", F.when(F.col("event_type").isin("click", "view"), "browse").otherwise(F.col("event_type")).alias("phase"))


@query("SELECT CAST(stddev_samp(x1) > 0 AS BOOLEAN) AS x1, CAST(stddev_samp(k) > 0 AS BOOLEAN) AS k FROM (SELECT l_quantity x1, 1 k FROM lineitem)")
def p05_constant_columns(spark, d):
    return fx.obs(spark, d).withColumn("k", F.lit(1)).agg((F.stddev_samp("x1") > 0).alias("x1"), (F.stddev_samp("k") > 0).alias("k"))


@query("SELECT event_id, " + ", ".join(f"CAST(event_type = '{c}' AS INTEGER)::DOUBLE AS is_{c}" for c in EVENTS) + " FROM events")
def p07_one_hot(spark, d):
    return fx.events(spark, d).select("event_id", *[(F.col("event_type") == c).cast("double").alias(f"is_{c}") for c in EVENTS])


@query("SELECT round(avg(l_quantity), 6) AS center, round(CASE WHEN stddev_pop(l_quantity) <= 1e-12 THEN 1 ELSE stddev_pop(l_quantity) END, 6) AS scale FROM lineitem")
def p09_pre_transform(spark, d):
    sd = F.stddev_pop("x1")
    return rounded(fx.obs(spark, d).agg(F.avg("x1").alias("center"), F.when(sd <= 1e-12, 1.0).otherwise(sd).alias("scale")), "center", "scale")


@query("SELECT event_id, round((value - m) / s, 6) AS z FROM events, (SELECT avg(value) m, stddev_pop(value) s FROM events)")
def p10_apply_transform(spark, d):
    e = fx.events(spark, d)
    s = e.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return rounded(e.crossJoin(F.broadcast(s)).select("event_id", ((F.col("value") - F.col("m")) / F.col("s")).alias("z")), "z")  # one row


@query("SELECT c_custkey, n_name, s.n FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, CAST(count(*) AS BIGINT) n FROM orders GROUP BY 1) s ON o_custkey = c_custkey")
def j02_left_join(spark, d):
    n = fx.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    nation = fx.table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return fx.table(spark, d, "customer").join(nation, "c_nationkey").join(n, "c_custkey", "left").select("c_custkey", "n_name", "n")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def j03_natural_join(spark, d):
    return fx.table(spark, d, "nation").withColumnRenamed("n_regionkey", "k").join(fx.table(spark, d, "region").withColumnRenamed("r_regionkey", "k"), "k").select("n_name", "r_name")


@query("SELECT g, k, row_number() OVER (ORDER BY k, g) AS place FROM (SELECT unnest([1, 2, 3]) AS g), (SELECT unnest([5, 10]) AS k)")
def j10_expand_grid(spark, d):
    g, k = spark.createDataFrame([(1,), (2,), (3,)], "g int"), spark.createDataFrame([(5,), (10,)], "k int")
    return g.crossJoin(k).withColumn("place", F.row_number().over(W.orderBy("k", "g")).cast("long"))  # a grid of settings


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def j11_semi_join(spark, d):
    c = fx.table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return fx.table(spark, d, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT stratum, g, v FROM (SELECT s_nationkey AS stratum, CAST(s_suppkey AS BIGINT) AS g, s_acctbal AS v, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS rn FROM supplier) WHERE rn = 1")
def t02_argmin(spark, d):
    s = fx.table(spark, d, "supplier")
    return s.groupBy(F.col("s_nationkey").alias("stratum")).agg(F.min_by("s_suppkey", F.struct("s_acctbal", "s_suppkey")).alias("g"), F.min("s_acctbal").alias("v"))


_RUNS = "SELECT o_orderpriority AS k, CAST(o_orderkey % 4 + 1 AS INTEGER) AS \"G\", round(avg(o_totalprice), 2) AS criterion FROM orders GROUP BY 1, 2"


@query(f"SELECT k, \"G\", criterion FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY criterion, \"G\") rn, count(*) OVER (PARTITION BY k) c FROM ({_RUNS})) WHERE rn = 1 AND c = 4")
def t04_best_groups(spark, d):
    runs = fx.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("G")).agg(F.round(F.avg("o_totalprice"), 2).alias("criterion"))
    return reports.best_groups(runs, ("k",), 4)


@query("WITH p AS (SELECT o_orderpriority AS k, CAST(o_orderkey % 20 AS DOUBLE) AS lambda_, avg(o_totalprice) AS loss FROM orders GROUP BY 1, 2) SELECT k, max(lambda_) AS \"lambda\" FROM (SELECT *, min(loss) OVER (PARTITION BY k) m FROM p) WHERE loss <= m + 2000 GROUP BY 1")
def t06_lambda_1se(spark, d):
    p = fx.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k"), (F.col("o_orderkey") % 20).cast("double").alias("lambda")).agg(F.avg("o_totalprice").alias("loss"))
    return reports.largest_lambda(p, ("k",), 2000.0)


@query("SELECT y, CAST(f + CASE WHEN row_number() OVER (ORDER BY round(raw - f, 9) DESC, y) <= 100 - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS count FROM (SELECT y, 100.0::DOUBLE * n / sum(n) OVER () AS raw, floor(100.0::DOUBLE * n / sum(n) OVER ()) AS f FROM (SELECT event_type y, CAST(count(*) AS DOUBLE) n FROM events GROUP BY 1))")
def t08_allocate(spark, d):
    n = fx.events(spark, d).groupBy(F.col("event_type").alias("y")).agg(F.count("*").cast("double").alias("n"))
    return reports.allocate(n, "y", "n", 100)


@query(with_ctes("units", "SELECT stratum, CAST(dense_rank() OVER (ORDER BY first) AS INTEGER) AS label FROM (SELECT stratum, min(unit) AS first FROM units GROUP BY 1)"))
def t09_relabel(spark, d):
    f = fx.units(spark, d).groupBy("stratum").agg(F.min("unit").alias("first"))
    return f.select("stratum", F.dense_rank().over(W.orderBy("first")).alias("label"))


@query("SELECT 'c' AS kind, c_custkey AS id, c_acctbal AS bal, NULL::BIGINT AS suppkey FROM customer UNION ALL SELECT 's', NULL, s_acctbal, s_suppkey FROM supplier")
def u01_row_bind(spark, d):
    c = fx.table(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    s = fx.table(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("suppkey"))
    return c.unionByName(s, allowMissingColumns=True)


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey % 2 = 0")
def u02_setdiff(spark, d):
    return fx.table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).subtract(fx.table(spark, d, "supplier").where("s_nationkey % 2 = 0").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def u03_intersect(spark, d):
    return fx.table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(fx.table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT DISTINCT p_brand, p_size FROM part")
def u04_unique(spark, d):
    return fx.table(spark, d, "part").select("p_brand", "p_size").distinct()


_Z5 = ("1", "x2s", "x1s")
_TR = [[f"{fx.coef(1, j, 0)} + {fx.coef(1, j, 1)} * x1s + {fx.coef(1, j, 2 + k)}" for k in range(5)] for j in range(5)]


def _transition_cols() -> list[str]:
    """Flat to-by-from transition probabilities of the fixed cluster 1 as SQL, from columns l{j}_{k}."""
    out = []
    for j in range(5):
        for k in range(5):
            col = [f"l{i}_{k}" for i in range(5)]
            out.append(f"exp(l{j}_{k} - greatest({', '.join(col)})) / ({' + '.join(f'exp({c} - greatest({chr(44).join(col)}))' for c in col)})")
    return out


def transition_rows(spark, d):
    p = fx.panel(spark, d).selectExpr("unit", "t", "y", "block", "x1 / 100 x1s")
    p = p.selectExpr("*", *[f"{_TR[j][k]} l{j}_{k}" for j in range(5) for k in range(5)])
    return p.select("unit", "t", "y", "block", F.array(*[F.expr(c) for c in _transition_cols()]).alias("m"))


@query(with_ctes("panel", ", a AS (SELECT unit, t, x1 / 100 AS x1s FROM panel), b AS (SELECT *, " + ", ".join(f"{_TR[j][k]} AS l{j}_{k}" for j in range(5) for k in range(5)) + " FROM a) SELECT unit, t, " + ", ".join(f"round({c}, 6) AS m{i}" for i, c in enumerate(_transition_cols())) + " FROM b"))
def l01_transition_array(spark, d):
    return transition_rows(spark, d).select("unit", "t", *[F.round(F.col("m")[i], 6).alias(f"m{i}") for i in range(25)])


_MV = ", ".join(f"({' + '.join(f'm{j * 5 + k} * a{k}' for k in range(5))}) AS b{j}" for j in range(5))


@query(with_ctes("panel", ", a AS (SELECT unit, t, x1 / 100 AS x1s FROM panel), b AS (SELECT *, " + ", ".join(f"{_TR[j][k]} AS l{j}_{k}" for j in range(5) for k in range(5)) + " FROM a), tr AS (SELECT unit, t, " + ", ".join(f"{c} AS m{i}" for i, c in enumerate(_transition_cols())) + f" FROM b), s AS (SELECT tr.*, coalesce(t - lag(t) OVER (PARTITION BY unit ORDER BY t) <> 1, true) AS restart FROM tr), f AS (SELECT unit, t, {', '.join(f'b{j} / (b0+b1+b2+b3+b4) AS a{j}' for j in range(5))} FROM (SELECT unit, t, {_MV} FROM (SELECT *, {', '.join(f'CAST(0.2 AS DOUBLE) AS a{k}' for k in range(5))} FROM s WHERE restart)) UNION ALL SELECT unit, t, {', '.join(f'b{j} / (b0+b1+b2+b3+b4) AS a{j}' for j in range(5))} FROM (SELECT s.unit, s.t, {_MV} FROM s JOIN f ON f.unit = s.unit AND f.t = s.t - 1 WHERE NOT s.restart)) SELECT unit, t, {', '.join(f'round(a{j}, 6) AS p{j}' for j in range(5))} FROM f").replace("WITH panel", "WITH RECURSIVE panel"))
def l04_forward_filter(spark, d):
    f = panels.filter_states(transition_rows(spark, d), "m", 5, [0.2] * 5)
    return f.select("unit", "t", *[F.round(F.col("prob")[j], 6).alias(f"p{j}") for j in range(5)])


def _impute_sql() -> str:
    """Forward and backward recursions of both clusters, and their mixture by the block's posterior."""
    r5, states = range(5), lambda c: ", ".join(f"{c}{j}" for j in range(5))
    sums = lambda c: " + ".join(f"{c}{j}" for j in r5)
    tr = "a AS (SELECT unit, t, block, CASE WHEN t % 4 <> 0 THEN y END AS y, x1 / 100 AS x1s FROM panel), b AS (SELECT *, " + ", ".join(f"{_TR[j][k]} AS l{j}_{k}" for j in r5 for k in r5) + " FROM a)"
    seen = ", ".join(f"CASE WHEN y IS NULL OR y = '{c}' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS e{j}" for j, c in enumerate(EVENTS))
    tr += ", c0 AS (SELECT unit, t, block, " + seen + ", " + ", ".join(f"{c} AS m{i}" for i, c in enumerate(_transition_cols())) + " FROM b)"
    tr += ", c AS (SELECT 0 AS g, * FROM c0 UNION ALL SELECT 1 AS g, unit, t, block, " + states("e") + ", " + ", ".join(f"m{i} * 0.5 + 0.1" for i in range(25)) + " FROM c0)"
    tr += ", s AS MATERIALIZED (SELECT *, coalesce(t - lag(t) OVER w <> 1, true) AS restart, coalesce(lead(t) OVER w - t <> 1, true) AS final FROM c WINDOW w AS (PARTITION BY g, unit ORDER BY t))"
    step = ", ".join(f"e{j} * ({' + '.join(f'm{j * 5 + k} * a{k}' for k in r5)}) AS b{j}" for j in r5)
    norm = ", ".join(f"b{j} / ({sums('b')}) AS a{j}" for j in r5)
    fwd = f"f AS (SELECT g, unit, t, ln({sums('b')}) AS ll, {norm} FROM (SELECT g, unit, t, {step} FROM (SELECT *, {', '.join(f'CAST(0.2 AS DOUBLE) AS a{k}' for k in r5)} FROM s WHERE restart)) UNION ALL SELECT g, unit, t, ln({sums('b')}), {norm} FROM (SELECT s.g, s.unit, s.t, {step} FROM s JOIN f ON f.g = s.g AND f.unit = s.unit AND f.t = s.t - 1 WHERE NOT s.restart))"
    back = ", ".join("(" + " + ".join(f"m{j * 5 + k} * e{j} * z{j}" for j in r5) + f") AS b{k}" for k in r5)
    scaled = ", ".join(f"b{j} / ({sums('b')}) AS z{j}" for j in r5)
    bwd = f"k AS (SELECT g, unit, t, {', '.join(f'CAST(1 AS DOUBLE) AS z{j}' for j in r5)} FROM s WHERE final UNION ALL SELECT g, unit, t, {scaled} FROM (SELECT s.g, s.unit, s.t - 1 AS t, {back} FROM s JOIN k ON k.g = s.g AND k.unit = s.unit AND k.t = s.t WHERE NOT s.restart))"
    post = "bl AS (SELECT block, g, sum(ll) AS ll FROM f JOIN s USING (g, unit, t) GROUP BY 1, 2), po AS (SELECT block, g, exp(ll - max(ll) OVER (PARTITION BY block)) AS o FROM bl), pw AS (SELECT block, g, o / sum(o) OVER (PARTITION BY block) AS w FROM po)"
    both = " + ".join(f"a{j} * z{j}" for j in r5)
    return f"{tr}, {fwd}, {bwd}, {post} SELECT unit, t, " + ", ".join(f"round(sum(w * a{j} * z{j} / ({both})), 6) AS p{j}" for j in r5) + ", round(max(CASE g WHEN 0 THEN w END), 6) AS first FROM f JOIN k USING (g, unit, t) JOIN s USING (g, unit, t) JOIN pw USING (block, g) GROUP BY 1, 2"


@query(with_ctes("panel", ", " + _impute_sql()).replace("WITH panel", "WITH RECURSIVE panel"))
def l05_impute_waves(spark, d):
    """Every fourth wave masked: marginals of all rows, mixed over two clusters by the block's posterior."""
    rows = transition_rows(spark, d).withColumn("y", F.when(F.col("t") % 4 != 0, F.col("y"))).withColumn("m2", F.transform("m", lambda v: v * 0.5 + 0.1))
    out = panels.impute(rows, ["m", "m2"], EVENTS, [0.2] * 5, [0.5, 0.5])
    return out.select("unit", "t", *[F.round(F.col("prob")[j], 6).alias(f"p{j}") for j in range(5)], F.round(F.col("posterior")[0], 6).alias("first"))


@query(with_ctes("panel", ", s AS (SELECT y, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM panel GROUP BY 1) SELECT u.unit, s.y, round(CASE WHEN u.unit % 3 = 0 THEN CAST(s.y = 'view' AS INTEGER)::DOUBLE ELSE p END, 6) AS p FROM (SELECT DISTINCT unit FROM panel) u, s"))
def l02_initial_distribution(spark, d):
    p = fx.panel(spark, d)
    s = p.groupBy("y").count().withColumn("p", F.col("count") / F.sum("count").over(W.partitionBy()))
    u = p.select("unit").distinct().crossJoin(F.broadcast(s))  # one row a class
    return rounded(u.select("unit", "y", F.when(F.col("unit") % 3 == 0, (F.col("y") == "view").cast("double")).otherwise(F.col("p")).alias("p")), "p")


_DOM = "x * x + CAST(0.5 AS DOUBLE) * y * y > CAST(0.25 AS DOUBLE)"
_XY = "CAST(event_id * 7919 % 2003 AS DOUBLE) / 2003 * 2 - 1 AS x, CAST(event_id * 104729 % 1999 AS DOUBLE) / 1999 * 2 AS y"


@query(f"SELECT event_id, {_DOM} AS inside, concat('R', CASE WHEN x <= 0 THEN 1 ELSE 2 END, CASE WHEN y <= 2.0 / 3 THEN 1 WHEN y <= 4.0 / 3 THEN 2 ELSE 3 END) AS region, CAST((CASE WHEN x <= -1.0/3 THEN 0 WHEN x <= 1.0/3 THEN 1 ELSE 2 END + CASE WHEN y <= 2.0/3 THEN 0 WHEN y <= 4.0/3 THEN 1 ELSE 2 END) % 3 AS INTEGER) AS regime FROM (SELECT event_id, {_XY} FROM events)")
def d03_domain_regions(spark, d):
    e = fx.table(spark, d, "events").selectExpr("event_id", *_XY.split(", "))
    tile = lambda c, a, b: F.when(F.col(c) <= a, 0).when(F.col(c) <= b, 1).otherwise(2)
    row, col = tile("y", 2 / 3, 4 / 3), tile("x", -1 / 3, 1 / 3)
    return e.select("event_id", F.expr(_DOM).alias("inside"), F.concat(F.lit("R"), F.when(F.col("x") <= 0, 1).otherwise(2), tile("y", 2 / 3, 4 / 3) + 1).alias("region"), ((row + col) % 3).cast("int").alias("regime"))


@query(f"SELECT event_id, CASE WHEN u < CAST(0.5 AS DOUBLE) THEN 'k1' WHEN u < CAST(0.8 AS DOUBLE) THEN 'k2' ELSE 'k3' END AS y FROM (SELECT event_id, {draw_sql(21, 'event_id')} / 4294967296.0::DOUBLE AS u FROM events)")
def d10_sample_class(spark, d):
    u = draw(21, "event_id") / F.lit(4294967296.0)
    return fx.events(spark, d).select("event_id", F.when(u < 0.5, "k1").when(u < 0.8, "k2").otherwise("k3").alias("y"))


def _fit(spark, d, groups: int = 2):
    """A partition fit on a tenth of the units' rows of the derived tables, from labels by place."""
    import pandas as pd

    from terrane.operators import partition

    u = fx.units(spark, d)
    rows = fx.obs(spark, d).selectExpr("unit", "y", "x1 / 50 z1", "x2 * 10 z2", "x3 * 10 z3")
    start = u.select("unit", F.expr(f"cast(pmod(unit, {groups}) as int) g")).toPandas()
    control = partition.Control(min_units=3, max_iter=3, lam=0.002)
    return partition.fit_partition(rows, u, ["z1", "z2", "z3"], CLASSES, pd.DataFrame(start), control), control


@query("SELECT true AS monotone, true AS feasible, true AS converged")
def m16_partition(spark, d):
    f, control = _fit(spark, d)
    import numpy as np

    gains = np.diff(f.trace)
    good = bool((gains >= -1e-6 * np.abs(f.trace[0])).all())
    sizes = np.bincount(f.labels, minlength=len(f.engines))
    return spark.createDataFrame([(good, bool((sizes >= control.min_units).all()), all(e.converged for e in f.engines))], "monotone boolean, feasible boolean, converged boolean")


@query("SELECT true AS weighted_n, true AS finite, true AS ordered")
def a15_criteria(spark, d):
    import numpy as np

    from terrane.operators import partition

    f, _ = _fit(spark, d)
    units = np.bincount(f.labels, minlength=len(f.engines)).astype(float)
    c = partition.criteria(f.loglik, f.rows, units, f.edf, 3, 3)
    row = (abs(c["weighted_n"] - f.rows.sum()) < 1e-6, bool(np.isfinite(list(c.values())).all()), bool(c["aic_effective"] <= c["bic_effective"]))
    return spark.createDataFrame([tuple(map(bool, row))], "weighted_n boolean, finite boolean, ordered boolean")


_PEN = "WITH c AS (SELECT g, j, t, ((7 * t + 3 * j + 5 * g) % 11 - 5) / 10.0::DOUBLE AS b FROM (SELECT unnest([1,2,3]) g), (SELECT unnest([0,1,2]) j), (SELECT unnest([0,1,2,3]) t))"


def _coefs(spark):
    grid = [(g, j, t, ((7 * t + 3 * j + 5 * g) % 11 - 5) / 10) for g in GROUPS for j in range(3) for t in range(4)]
    return spark.createDataFrame(grid, "g int, j int, t int, b double")


@query(_PEN + " SELECT g, round(sum(0.7 * abs(b) + 0.15 * b * b), 6) AS plain, round((SELECT sum(0.7 * sqrt(s)) FROM (SELECT sum(b * b) s FROM c d WHERE d.g = c.g AND t > 0 GROUP BY t)) + sum(0.15 * b * b), 6) AS grouped FROM c WHERE t > 0 GROUP BY g")
def m11_penalty(spark, d):
    c = _coefs(spark).where("t > 0")
    norm = c.groupBy("g", "t").agg(F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("n"), F.sum(F.abs("b")).alias("a"), F.sum(F.col("b") * F.col("b")).alias("s"))
    return rounded(norm.groupBy("g").agg(F.sum(0.7 * F.col("a") + 0.15 * F.col("s")).alias("plain"), F.sum(0.7 * F.col("n") + 0.15 * F.col("s")).alias("grouped")), "plain", "grouped")


@query(_PEN + " SELECT g, CAST(count(DISTINCT t) AS BIGINT) AS active FROM c WHERE t > 0 AND abs(b) > 0.25 GROUP BY g")
def m13_active_predictors(spark, d):
    return _coefs(spark).where("t > 0 AND abs(b) > 0.25").groupBy("g").agg(F.countDistinct("t").alias("active"))


@query(_PEN + " SELECT g, j, t, round(b - avg(b) OVER (PARTITION BY g, t), 6) + 0.0::DOUBLE AS b FROM c")
def m10_sum_to_zero(spark, d):
    return _coefs(spark).withColumn("b", F.round(F.col("b") - F.avg("b").over(W.partitionBy("g", "t")), 6) + F.lit(0.0))


@query(_PEN + ", f AS (SELECT g, t, greatest(max(b), 0) - least(min(b), 0) AS reach FROM c WHERE t > 0 GROUP BY 1, 2) SELECT g, t, round(reach, 6) AS reach FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY reach DESC, t) rn FROM f) WHERE rn <= 2")
def a34_top_features(spark, d):
    f = _coefs(spark).where("t > 0").groupBy("g", "t").agg((F.greatest(F.max("b"), F.lit(0.0)) - F.least(F.min("b"), F.lit(0.0))).alias("reach"))
    rn = F.row_number().over(W.partitionBy("g").orderBy(F.desc("reach"), "t"))
    return f.withColumn("rn", rn).where("rn <= 2").select("g", "t", F.round("reach", 6).alias("reach"))


@query(_PEN + ", k AS (SELECT unit, stratum FROM (SELECT s_suppkey AS unit, s_nationkey AS stratum FROM supplier)), w AS (SELECT unit, g, CASE WHEN g = stratum % 3 + 1 THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS w FROM k, (SELECT unnest([1,2,3]) AS g)) SELECT unit, j, t, round(sum(w * b), 6) AS b FROM w JOIN c USING (g) GROUP BY 1, 2, 3")
def a21_local_coef(spark, d):
    u = fx.units(spark, d).select("unit", "g0", F.explode(F.array(*[F.lit(g) for g in GROUPS])).alias("g"))
    w = u.withColumn("w", F.when(F.col("g") == F.col("g0"), 0.8).otherwise(0.1))
    return rounded(w.join(_coefs(spark), "g").groupBy("unit", "j", "t").agg(F.sum(F.col("w") * F.col("b")).alias("b")), "b")


@query(with_ctes("units obs pred", "SELECT stratum, yhat, CAST(count(*) AS BIGINT) AS n, " + ", ".join(f"round(avg({p}), 6) AS {p}" for p in PROBS) + " FROM pred GROUP BY 1, 2"))
def m30_predict_mixture(spark, d):
    return rounded(fx.predicted(spark, d).groupBy("stratum", "yhat").agg(F.count("*").alias("n"), *[F.avg(p).alias(p) for p in PROBS]), *PROBS)


_GWK = ", k AS (SELECT i, j, d2, max(d2) OVER (PARTITION BY i) m FROM nn)"


@query(with_ctes("units edges", f"{_GWK}, h AS (SELECT *, sqrt(m) * 1.0001 + 1e-12 AS h FROM k) SELECT i, j, round((1 - d2 / (h * h)) * (1 - d2 / (h * h)), 6) AS w FROM h"))
def m26_bisquare_weights(spark, d):
    u = fx.units(spark, d)
    near = graph.nearest(u, u, 5, exclude_self=True).withColumn("h", F.sqrt(F.max("d2").over(W.partitionBy("i"))) * 1.0001 + 1e-12)
    r = F.col("d2") / (F.col("h") * F.col("h"))
    return near.select("i", "j", F.round((1 - r) * (1 - r), 6).alias("w"))


@query(with_ctes("units", "SELECT 'r' AS run, unit, h AS cluster, CASE WHEN g0 = h THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS weight FROM units, (SELECT unnest([1, 2, 3]) AS h)"))
def s04_membership_long(spark, d):
    from terrane.sources.tables import membership_long

    compact = labels(spark, d).select(F.lit("r").alias("run"), "unit", F.array(*[(F.col("g") == g).cast("double") for g in GROUPS]).alias("weights"))
    return membership_long(compact)


@query("SELECT true AS inside, CAST(300 AS BIGINT) AS n, CAST(3 AS BIGINT) AS regimes")
def d01_locations(spark, d):
    from terrane.operators import simulate as sim

    u = sim.regimes(sim.locations(spark, 300, 5), "irregular", 3)
    return u.agg(F.bool_and(sim.inside(F.col("cx"), F.col("cy"))).alias("inside"), F.count("*").alias("n"), F.countDistinct("regime").alias("regimes"))


@query("SELECT CAST(60 * 8 AS BIGINT) AS n, true AS classes, true AS stays")
def d11_panel(spark, d):
    from terrane.operators import simulate as sim

    p = sim.panel(sim.regimes(sim.locations(spark, 60, 5), "irregular", 3), 8, 4, 3, 9)
    lag = panels.lag_design(p.select("unit", "t", "y"), ("1", "2", "3", "4")).agg(F.avg((F.col("y") == F.col("lag")).cast("double")).alias("s"))
    return p.agg(F.count("*").alias("n"), F.bool_and(F.col("y").isin("1", "2", "3", "4")).alias("classes")).crossJoin(lag.select((F.col("s") > 0.25).alias("stays")))  # one row each


@query(with_ctes("units", ", b AS (SELECT min(cx) x0, max(cx) x1, min(cy) y0, max(cy) y1 FROM units) SELECT unit, CAST(least(floor((cx - x0) / greatest(x1 - x0, 1e-12) * 2), 1) * 3 + least(floor((cy - y0) / greatest(y1 - y0, 1e-12) * 3), 2) + 1 AS INTEGER) AS regime FROM units, b"))
def d12_grid_regimes(spark, d):
    from terrane.operators import simulate as sim

    return sim.regimes(fx.units(spark, d).select("unit", "cx", "cy"), "grid", 6).select("unit", "regime")


@query(with_ctes("units obs", "SELECT o.unit, o.y, u.g0 AS g, CAST(count(*) AS BIGINT) AS n FROM obs o JOIN units u USING (unit) GROUP BY 1, 2, 3"))
def j01_unit_lookup(spark, d):
    return fx.obs(spark, d).groupBy("unit", "y").agg(F.count("*").alias("n")).join(labels(spark, d), "unit").select("unit", "y", "g", "n")


@query("SELECT o_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def j04_inner_join(spark, d):
    li = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return fx.table(spark, d, "orders").select("o_orderkey").join(li, "o_orderkey").groupBy("o_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query(with_ctes("panel", "SELECT p.unit, p.t, p.y, q.y AS prev FROM panel p LEFT JOIN panel q ON q.unit = p.unit AND q.t + 1 = p.t"))
def j05_self_lag_join(spark, d):
    p = fx.panel(spark, d).select("unit", "t", "y")
    return p.join(p.select("unit", (F.col("t") + 1).alias("t"), F.col("y").alias("prev")), ["unit", "t"], "left")


@query("SELECT a.event_id, a.value AS v1, b.o_totalprice AS v2 FROM events a JOIN orders b ON b.o_orderkey = a.event_id JOIN customer c ON c.c_custkey = a.event_id")
def j13_key_intersection(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("v2"))
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("event_id"))
    return fx.events(spark, d).select("event_id", F.col("value").alias("v1")).join(o, "event_id").join(c, "event_id")


@query(with_ctes("panel", "SELECT unit, t, CAST(row_number() OVER (PARTITION BY unit ORDER BY t) AS INTEGER) AS place FROM panel"))
def w02_panel_order(spark, d):
    return fx.panel(spark, d).select("unit", "t", F.row_number().over(W.partitionBy("unit").orderBy("t")).alias("place"))


@query(f"SELECT event_id, CAST({_rank_sql(31, 'event_id', 'event_type')} AS INTEGER) AS place FROM events")
def w06_hashed_rank(spark, d):
    return splits.ranked(fx.events(spark, d), "event_id", ("event_type",), 31).select("event_id", F.col("rank").cast("int").alias("place"))


@query(with_ctes("panel", "SELECT unit, t, round(x2 - lag(x2) OVER (PARTITION BY unit ORDER BY t), 6) AS moved FROM panel"))
def w07_trace_differences(spark, d):
    return rounded(fx.panel(spark, d).select("unit", "t", (F.col("x2") - F.lag("x2").over(W.partitionBy("unit").orderBy("t"))).alias("moved")), "moved")


@query("SELECT k, g FROM (SELECT o_orderpriority AS k, CAST(o_orderkey % 6 AS BIGINT) AS g, avg(CASE WHEN o_orderkey % 6 = 2 THEN NULL ELSE o_totalprice END) AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY avg(CASE WHEN o_orderkey % 6 = 2 THEN NULL ELSE o_totalprice END) NULLS LAST, o_orderkey % 6) rn FROM orders GROUP BY 1, o_orderkey % 6) WHERE rn = 1")
def t03_argmin_skipping_null(spark, d):
    v = fx.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k"), (F.col("o_orderkey") % 6).alias("g")).agg(F.avg(F.when(F.col("o_orderkey") % 6 != 2, F.col("o_totalprice"))).alias("v"))
    return v.where("v IS NOT NULL AND NOT isnan(v)").groupBy("k").agg(F.min_by("g", F.struct("v", "g")).alias("g"))


@query("SELECT fold, method, g FROM (SELECT o_orderkey % 3 AS fold, o_orderpriority AS method, o_orderkey % 4 AS g, row_number() OVER (PARTITION BY o_orderkey % 3, o_orderpriority ORDER BY avg(o_totalprice), o_orderkey % 4) AS rn FROM orders GROUP BY 1, 2, 3) WHERE rn = 1")
def t05_choice_per_fold(spark, d):
    v = fx.table(spark, d, "orders").groupBy((F.col("o_orderkey") % 3).alias("fold"), F.col("o_orderpriority").alias("method"), (F.col("o_orderkey") % 4).alias("g")).agg(F.avg("o_totalprice").alias("v"))
    return v.groupBy("fold", "method").agg(F.min_by("g", F.struct("v", "g")).alias("g"))


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_nationkey, c_acctbal DESC, c_custkey) AS BIGINT) AS place FROM customer")
def t10_order_by_keys(spark, d):
    """Places of a total order by several keys, by a count within each first key and offsets of those before."""
    c = fx.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    size = c.groupBy("c_nationkey").count().withColumn("base", F.coalesce(F.sum("count").over(W.orderBy("c_nationkey").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return c.withColumn("r", within).join(size, "c_nationkey").select("c_custkey", (F.col("base") + F.col("r")).alias("place"))


@query("SELECT 'run-1' AS run, n_nationkey, n_name FROM nation")
def u05_replicate_metadata(spark, d):
    one = spark.createDataFrame([("run-1",)], "run string")
    return fx.table(spark, d, "nation").select("n_nationkey", "n_name").crossJoin(F.broadcast(one))  # one row


_TRUTH = ", c AS (SELECT g, j, t, ((7 * t + 3 * j + 5 * g) % 11 - 5) / 10.0::DOUBLE AS b, ((7 * t + 3 * j + 5 * g + 1) % 11 - 5) / 10.0::DOUBLE AS e FROM (SELECT unnest([1,2,3]) g), (SELECT unnest([0,1,2]) j), (SELECT unnest([0,1,2,3]) t))"


@query("WITH x AS (SELECT 1)" + _TRUTH + " SELECT g, CASE WHEN t = 0 THEN 'intercept' WHEN abs(b) > 0 THEN 'active' ELSE 'inactive' END AS role, round(avg(e - b), 6) AS bias, round(avg((e - b) * (e - b)), 6) AS mse FROM c GROUP BY 1, 2")
def a20_parameter_recovery(spark, d):
    grid = [(g, t, ((7 * t + 3 * j + 5 * g) % 11 - 5) / 10, ((7 * t + 3 * j + 5 * g + 1) % 11 - 5) / 10) for g in GROUPS for j in range(3) for t in range(4)]
    c = spark.createDataFrame(grid, "g int, t int, b double, e double")
    role = F.when(F.col("t") == 0, "intercept").when(F.abs("b") > 0, "active").otherwise("inactive")
    diff = F.col("e") - F.col("b")
    return rounded(c.groupBy("g", role.alias("role")).agg(F.avg(diff).alias("bias"), F.avg(diff * diff).alias("mse")), "bias", "mse")


@query(with_ctes("units", _TRUTH + " SELECT unit, round(avg((e - b) * (e - b)), 6) AS mse FROM units u JOIN c ON c.g = u.g0 GROUP BY 1"))
def a22_unit_beta_mse(spark, d):
    grid = [(g, ((7 * t + 3 * j + 5 * g) % 11 - 5) / 10, ((7 * t + 3 * j + 5 * g + 1) % 11 - 5) / 10) for g in GROUPS for j in range(3) for t in range(4)]
    c = spark.createDataFrame(grid, "g int, b double, e double").withColumn("q", (F.col("e") - F.col("b")) * (F.col("e") - F.col("b")))
    return rounded(labels(spark, d).join(c, "g").groupBy("unit").agg(F.avg("q").alias("mse")), "mse")


@query("SELECT s_nationkey AS region, CAST(count(*) AS BIGINT) AS n, round(count(*) / CAST((SELECT count(*) FROM supplier) AS DOUBLE), 6) AS share, (SELECT round(corr(s_acctbal, s_suppkey), 6) FROM supplier) AS r FROM supplier GROUP BY 1")
def a23_region_diagnostics(spark, d):
    s = fx.table(spark, d, "supplier")
    one = s.agg(F.count("*").alias("t"), F.corr("s_acctbal", "s_suppkey").alias("r"))
    out = s.groupBy(F.col("s_nationkey").alias("region")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(one))  # one row
    return rounded(out.select("region", "n", (F.col("n") / F.col("t")).alias("share"), "r"), "share", "r")


@query(with_ctes("units obs", ", m AS (SELECT g0, CAST(count(DISTINCT unit) AS DOUBLE) AS m, CAST(count(*) AS DOUBLE) AS n FROM units JOIN obs USING (unit) GROUP BY 1), a AS (SELECT *, avg(m) OVER () / m AS a FROM m) SELECT abs(sum(w * n) - sum(n)) < 1e-6 AS exact, bool_and(w > 0) AS finite FROM (SELECT *, sum(n) OVER () * a / sum(a * n) OVER () AS w FROM a)"))
def a32_criterion_audit(spark, d):
    per = a06_unit_contributions(spark, d).join(labels(spark, d), "unit").groupBy("g").agg(F.count("*").cast("double").alias("m"), F.sum("n").cast("double").alias("n"))
    every = W.partitionBy()
    per = per.withColumn("a", F.avg("m").over(every) / F.col("m"))
    per = per.withColumn("w", F.sum("n").over(every) * F.col("a") / F.sum(F.col("a") * F.col("n")).over(every))
    return per.agg((F.abs(F.sum(F.col("w") * F.col("n")) - F.sum("n")) < 1e-6).alias("exact"), F.bool_and(F.col("w") > 0).alias("finite"))


_KEEP = r"^o_(order|total)"


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def p03_regex_projection(spark, d):
    import re

    o = fx.table(spark, d, "orders")
    return o.select(*[c for c in o.columns if re.search(_KEEP, c)])


@query("SELECT event_id, value FROM events WHERE event_id IN (SELECT event_id FROM events WHERE event_id % 4 = 1)")
def p06_subset_by_rows(spark, d):
    e = fx.events(spark, d)
    return e.select("event_id", "value").join(e.where("event_id % 4 = 1").select("event_id"), "event_id", "left_semi")


@query(with_ctes("panel", "SELECT unit, t, " + ", ".join(f"CASE WHEN t % 5 = {k} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS d{k}" for k in range(1, 5)) + " FROM panel"))
def p08_period_dummies(spark, d):
    return fx.panel(spark, d).select("unit", "t", *[(F.col("t") % 5 == k).cast("double").alias(f"d{k}") for k in range(1, 5)])


@query(with_ctes("panel", "SELECT unit, t, " + ", ".join(f"CAST(CASE WHEN '{c}' = 'click' THEN 1 ELSE 0 END AS DOUBLE) AS lag_{c}" for c in EVENTS) + " FROM panel"))
def p14_set_lag(spark, d):
    p = w01_lag_design(spark, d)
    return p.withColumns({f"lag_{c}": F.lit(1.0 if c == "click" else 0.0) for c in EVENTS}).select("unit", "t", *[f"lag_{c}" for c in EVENTS])


@query(with_ctes("units obs edges support", ", l AS (SELECT unit, " + ", ".join(f"sum({_ll(g)}) AS ll{g}" for g in GROUPS) + " FROM (SELECT *, x1 / 50 z1, x2 * 10 z2, x3 * 10 z3 FROM obs) GROUP BY 1), s AS (SELECT unit, h, s + CASE h WHEN 1 THEN ll1 WHEN 2 THEN ll2 ELSE ll3 END AS v FROM support JOIN l USING (unit)) SELECT unit, CAST(h AS INTEGER) AS g FROM (SELECT unit, h, row_number() OVER (PARTITION BY unit ORDER BY v DESC, h) rn FROM s) WHERE rn = 1"))
def m28_simultaneous_labels(spark, d):
    """The label step of the earlier algorithm: unit log-likelihood plus neighbour support, first best cluster, all units at once."""
    z = fx.obs(spark, d).selectExpr("unit", "y", "x1 / 50 z1", "x2 * 10 z2", "x3 * 10 z3")
    ll = z.groupBy("unit").agg(*[F.sum(F.expr(_ll(g))).alias(f"ll{g}") for g in GROUPS]).unpivot("unit", [f"ll{g}" for g in GROUPS], "name", "ll")
    ll = ll.select("unit", F.substring("name", 3, 1).cast("int").alias("h"), "ll")
    v = a12_potts_support(spark, d).join(ll, ["unit", "h"]).withColumn("v", F.col("s") + F.col("ll"))
    return v.groupBy("unit").agg(F.max_by("h", F.struct("v", -F.col("h"))).alias("g"))


@query(f"SELECT event_id, rk <= least(n - 2, floor(CAST(0.3 AS DOUBLE) * n)) AND n >= 3 AS is_valid FROM (SELECT event_id, {_rank_sql(41, 'event_id', 'event_type')} AS rk, count(*) OVER (PARTITION BY event_type) AS n FROM events)")
def m33_holdout_split(spark, d):
    return splits.holdout_split(fx.events(spark, d), "event_id", ("event_type",), 0.3, 41)


@query(with_ctes("units edges support", ", w AS (SELECT unit, h, exp(2 * s) / sum(exp(2 * s)) OVER (PARTITION BY unit) AS p FROM support) SELECT w.unit, round(p, 6) AS own FROM w JOIN units u ON u.unit = w.unit AND u.g0 = w.h"))
def m42_own_regime_weight(spark, d):
    s = a12_potts_support(spark, d)
    p = F.exp(2 * F.col("s")) / F.sum(F.exp(2 * F.col("s"))).over(W.partitionBy("unit"))
    return rounded(s.withColumn("own", p).join(labels(spark, d), "unit").where("h = g").select("unit", "own"), "own")


_BETA = "CASE WHEN x <= 0 THEN CAST(-0.25 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END"


@query(f"SELECT event_id, round(b1 - (b1 + b2) / 3, 6) AS c1, round(b2 - (b1 + b2) / 3, 6) AS c2, round(-(b1 + b2) / 3, 6) AS c3 FROM (SELECT event_id, 0.9::DOUBLE + {_BETA} AS b1, -0.8::DOUBLE - {_BETA} AS b2 FROM (SELECT event_id, {_XY} FROM events))")
def d08_clustered_coefficients(spark, d):
    e = fx.table(spark, d, "events").selectExpr("event_id", *_XY.split(", "))
    shift = F.when(F.col("x") <= 0, -0.25).otherwise(0.25)
    e = e.select("event_id", (F.lit(0.9) + shift).alias("b1"), (F.lit(-0.8) - shift).alias("b2")).withColumn("m", (F.col("b1") + F.col("b2")) / 3)
    return rounded(e.select("event_id", (F.col("b1") - F.col("m")).alias("c1"), (F.col("b2") - F.col("m")).alias("c2"), (-F.col("m")).alias("c3")), "c1", "c2", "c3")
