"""More queries of the operators: the model's interface, tuning, label changes, predictions over time and study tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.functions.draws import draw_sql, uniform
from terrane.operators import graph, metrics, model, panels
from terrane.plans import fixtures as fx
from terrane.plans.fixtures import CLASSES, EVENTS, GROUPS, with_ctes
from terrane.queries import _ll, _transition_cols, _TR, _XY, a12_potts_support, a09_unit_loglik, labels, query, r6, rounded, transition_rows
from terrane.queries import _BRIER, _CM, _KAPPA, _TRUE

FEATURES = ("z1", "z2", "z3")
COEF = [[[((7 * t + 3 * j + 5 * g) % 11 - 5) / 10 for t in range(4)] for j in range(3)] for g in GROUPS]


def _scaled(spark, d):
    return fx.obs(spark, d).selectExpr("unit", "y", "x1 / 50 z1", "x2 * 10 z2", "x3 * 10 z3")


def _mixture(spark, d):
    u = labels(spark, d).select("unit", F.explode(F.array(*[F.struct(F.lit(g - 1).alias("g"), F.when(F.col("g") == g, 0.8).otherwise(0.1).alias("weight")) for g in GROUPS])).alias("r"))
    return u.select("unit", "r.g", "r.weight")


# probabilities under every cluster, in SQL
_PG = "z AS (SELECT o.unit, y, x1 / 50 AS z1, x2 * 10 AS z2, x3 * 10 AS z3, g0, stratum FROM obs o JOIN units USING (unit)), ee AS (SELECT *, " + ", ".join(f"{fx.eta(g, j)} AS e{g}{j}" for g in GROUPS for j in range(3)) + " FROM z), pg AS (SELECT *, " + ", ".join(f"{p} AS q{g}{j}" for g in GROUPS for j, p in enumerate(fx.softmax_sql([f"e{g}0", f"e{g}1", f"e{g}2"]))) + " FROM ee)"
_MIX = ", mx AS (SELECT *, " + ", ".join("(" + " + ".join(f"CASE WHEN g0 = {g} THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END * q{g}{j}" for g in GROUPS) + f") AS m{j}" for j in range(3)) + " FROM pg)"


@query(with_ctes("units obs", f", {_PG}{_MIX} SELECT unit, round(avg(m0), 6) AS p_A, round(avg(m1), 6) AS p_N, round(avg(m2), 6) AS p_R, CAST(count(*) FILTER (WHERE m0 >= m1 AND m0 >= m2) AS BIGINT) AS best_A FROM mx GROUP BY 1"))
def m30_predict_weighted_mixture(spark, d):
    out = model.Model("scmr", COEF, CLASSES, FEATURES).predict(_scaled(spark, d), _mixture(spark, d), kind="class")
    return rounded(out.groupBy("unit").agg(*[F.avg(f"p_{c}").alias(f"p_{c}") for c in CLASSES], F.count_if(F.col("yhat") == "A").alias("best_A")), "p_A", "p_N", "p_R")


@query(with_ctes("units obs", f", {_PG} SELECT round(sum(ln(greatest(CASE y WHEN 'A' THEN CASE g0 WHEN 1 THEN q10 WHEN 2 THEN q20 ELSE q30 END WHEN 'N' THEN CASE g0 WHEN 1 THEN q11 WHEN 2 THEN q21 ELSE q31 END ELSE CASE g0 WHEN 1 THEN q12 WHEN 2 THEN q22 ELSE q32 END END, 1e-15))), 3) AS loglik, CAST(24 AS DOUBLE) AS df, CAST(count(*) AS BIGINT) AS nobs FROM pg"))
def m31_log_likelihood(spark, d):
    rows = _scaled(spark, d).join(labels(spark, d), "unit")
    m = model.Model("fixed_clusters", COEF, CLASSES, FEATURES, tuple(map(str, GROUPS)), df=24.0)
    return m.log_likelihood(rows, cluster="g").withColumn("loglik", F.round("loglik", 3))


@query("SELECT CAST(g - 1 AS INTEGER) AS cluster, class, term, round(b - avg(b) OVER (PARTITION BY g, term), 6) + 0.0::DOUBLE AS value FROM (SELECT g, ['A', 'N', 'R'][j + 1] AS class, ['(Intercept)', 'z1', 'z2', 'z3'][t + 1] AS term, ((7 * t + 3 * j + 5 * g) % 11 - 5) / 10.0::DOUBLE AS b FROM (SELECT unnest([1,2,3]) g), (SELECT unnest([0,1,2]) j), (SELECT unnest([0,1,2,3]) t))")
def m31_coefficients(spark, d):
    rows = model.Model("scmr", COEF, CLASSES, FEATURES).coefficients()
    return spark.createDataFrame(rows, "cluster int, class string, term string, value double").withColumn("value", F.round("value", 6) + F.lit(0.0))


@query(with_ctes("units obs", f", {_PG} SELECT stratum, " + ", ".join(f"round(avg(CASE g0 WHEN 1 THEN q1{j} WHEN 2 THEN q2{j} ELSE q3{j} END), 6) AS p_{c}" for j, c in enumerate(CLASSES)) + " FROM pg GROUP BY 1"))
def m40_stratum_models(spark, d):
    """Clusters fixed by a column: each stratum has the model of its own label."""
    u = fx.units(spark, d).select("unit", "stratum")
    m = model.Model("fixed_clusters", [COEF[s % 3] for s in range(25)], CLASSES, FEATURES, tuple(map(str, range(25))))
    out = m.predict(_scaled(spark, d).join(u, "unit"), cluster="stratum")
    return rounded(out.groupBy("stratum").agg(*[F.avg(f"p_{c}").alias(f"p_{c}") for c in CLASSES]), *[f"p_{c}" for c in CLASSES])


@query(with_ctes("obs", "SELECT unit, round(sum(x2), 4) AS z2, round(sum(x3), 4) AS z3, round(sum(x1), 4) AS z1 FROM obs GROUP BY 1"))
def p02_matched_features(spark, d):
    rows = fx.obs(spark, d).selectExpr("x3 z3", "unit", "x1 z1", "x2 z2")
    out = model.matched_features(rows, FEATURES, ("unit",))
    return out.groupBy("unit").agg(*[F.round(F.sum(c), 4).alias(c) for c in FEATURES])


@query("SELECT event_id, round(a / (a + b), 9) AS click, round(b / (a + b), 9) AS view, CAST(0 AS DOUBLE) AS error FROM (SELECT event_id, abs(value) + 1 AS a, CAST(event_id % 7 AS DOUBLE) AS b FROM events)")
def sf4_normalised_probabilities(spark, d):
    e = fx.events(spark, d)
    p = model.normalised({"view": (F.col("event_id") % 7).cast("double"), "click": F.abs("value") + 1}, ("click", "error", "view"))
    return e.select("event_id", *p.values()).select("event_id", *[F.round(c, 9).alias(c) for c in p])


@query("SELECT * FROM (VALUES ('elastic_net', 0.25::DOUBLE, 0.5::DOUBLE), ('elastic_net', 0.5, 0.5), ('elastic_net', 0.9, 0.5), ('ridge', 0.0, 0.0), ('lasso', 1.0, 1.0)) AS t(penalty, alpha, chosen)")
def p11_penalty_alphas(spark, d):
    rows = [(p, a, chosen) for p, grid in (("elastic_net", (0.9, 0.25, 0.5, 0.5)), ("ridge", None), ("lasso", None)) for alphas, chosen in [model.penalty_alphas(p, grid=grid)] for a in alphas]
    return spark.createDataFrame(rows, "penalty string, alpha double, chosen double")


@query(with_ctes("obs", "SELECT y, CAST(count(*) AS BIGINT) AS n, count(*) >= CASE y WHEN 'A' THEN 100 WHEN 'N' THEN 200 ELSE 1000000000 END AS enough FROM obs GROUP BY 1"))
def p13_least_per_class(spark, d):
    least = model.least_per_class({"R": 10**9, "A": 100, "N": 200}, CLASSES)
    need = F.create_map(*[F.lit(x) for kv in least.items() for x in kv])
    return fx.obs(spark, d).groupBy("y").agg(F.count("*").alias("n")).withColumn("enough", F.col("n") >= need[F.col("y")])


# label changes

_LSE = "greatest(a1, a2, a3) + ln(exp(a1 - greatest(a1, a2, a3)) + exp(a2 - greatest(a1, a2, a3)) + exp(a3 - greatest(a1, a2, a3)))"
_WIDE = ", sw AS (SELECT unit, max(CASE h WHEN 1 THEN s END) s1, max(CASE h WHEN 2 THEN s END) s2, max(CASE h WHEN 3 THEN s END) s3 FROM support GROUP BY 1)"


@query(with_ctes("units edges support", f"{_WIDE}, mv AS (SELECT u.unit, u.g0, gs.h FROM units u, gs WHERE gs.h <> u.g0), nb AS (SELECT mv.unit, mv.h, v.g0 AS gr, mv.g0 AS old, e.w, s1, s2, s3, "
    + ", ".join(f"s{k} + e.w * (CAST(mv.h = {k} AS INTEGER) - CAST(mv.g0 = {k} AS INTEGER)) AS n{k}" for k in GROUPS)
    + " FROM mv JOIN edges e ON e.i = mv.unit JOIN sw ON sw.unit = e.j JOIN units v ON v.unit = e.j), dl AS (SELECT unit, h, sum(w * (CAST(gr = h AS INTEGER) - CAST(gr = old AS INTEGER)) - (nn - oo)) AS x FROM (SELECT *, (SELECT "
    + _LSE.replace("a1", "n1").replace("a2", "n2").replace("a3", "n3") + ") AS nn, (SELECT " + _LSE.replace("a1", "s1").replace("a2", "s2").replace("a3", "s3")
    + ") AS oo FROM nb) GROUP BY 1, 2) SELECT mv.unit, CAST(mv.h AS INTEGER) AS h, round(a.s - b.s + coalesce(x, 0), 6) + 0.0::DOUBLE AS delta FROM mv JOIN support a ON a.unit = mv.unit AND a.h = mv.h JOIN support b ON b.unit = mv.unit AND b.h = mv.g0 LEFT JOIN dl ON dl.unit = mv.unit AND dl.h = mv.h"))
def m19_label_changes(spark, d):
    """What each unit's move to each other cluster changes in the pseudo-likelihood, phi 1."""
    out = graph.label_changes(graph.edges(fx.units(spark, d)), a12_potts_support(spark, d), labels(spark, d), GROUPS, 1.0)
    return out.select("unit", "h", (F.round("delta", 6) + F.lit(0.0)).alias("delta"))


@query(with_ctes("units obs edges support", ", l AS (SELECT unit, " + ", ".join(f"sum({_ll(g)}) AS ll{g}" for g in GROUPS) + " FROM (SELECT *, x1 / 50 z1, x2 * 10 z2, x3 * 10 z3 FROM obs) GROUP BY 1), ph AS (SELECT unnest([0.0::DOUBLE, 1.0, 5.0]) AS phi), s AS (SELECT unit, h, phi, phi * s + CASE h WHEN 1 THEN ll1 WHEN 2 THEN ll2 ELSE ll3 END AS v FROM support JOIN l USING (unit), ph), b AS (SELECT unit, phi, h, row_number() OVER (PARTITION BY unit, phi ORDER BY v DESC, h) rn FROM s) SELECT phi, CAST(count(*) AS BIGINT) AS units, round(avg(CASE WHEN h = g0 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END), 6) AS wrong FROM b JOIN units USING (unit) WHERE rn = 1 GROUP BY 1"))
def m41_misassignment(spark, d):
    """Share of units whose best cluster by likelihood plus phi times support isn't their own, by phi."""
    z = _scaled(spark, d).groupBy("unit").agg(*[F.sum(F.expr(_ll(g))).alias(f"ll{g}") for g in GROUPS]).unpivot("unit", [f"ll{g}" for g in GROUPS], "name", "ll")
    z = z.select("unit", F.substring("name", 3, 1).cast("int").alias("h"), "ll")
    v = a12_potts_support(spark, d).join(z, ["unit", "h"]).withColumn("phi", F.explode(F.array(*[F.lit(x) for x in (0.0, 1.0, 5.0)])))
    best = v.groupBy("unit", "phi").agg(F.max_by("h", F.struct(F.col("phi") * F.col("s") + F.col("ll"), -F.col("h"))).alias("h"))
    out = best.join(labels(spark, d), "unit").groupBy("phi").agg(F.count("*").alias("units"), F.avg((F.col("h") != F.col("g")).cast("double")).alias("wrong"))
    return rounded(out, "wrong")


@query(with_ctes("units edges", "SELECT a.g0 AS g, b.g0 AS other, CAST(sum(w) AS DOUBLE) AS weight, CAST(count(*) AS BIGINT) AS n FROM edges JOIN units a ON a.unit = i JOIN units b ON b.unit = j GROUP BY 1, 2"))
def j14_edge_labels(spark, d):
    """Edges joined with the labels at both ends."""
    lab = labels(spark, d)
    e = graph.edges(fx.units(spark, d)).join(lab.select(F.col("unit").alias("i"), "g"), "i").join(lab.select(F.col("unit").alias("j"), F.col("g").alias("other")), "j")
    return e.groupBy("g", "other").agg(F.sum("w").alias("weight"), F.count("*").alias("n"))


@query(with_ctes("units obs", ", c AS (SELECT unit, " + ", ".join(f"count(*) FILTER (WHERE y = '{c}') AS n{c}" for c in CLASSES) + " FROM obs GROUP BY 1), m AS (SELECT g0, count(*) AS units, " + ", ".join(f"sum(n{c}) AS m{c}" for c in CLASSES) + " FROM units JOIN c USING (unit) GROUP BY 1) SELECT u.unit, m.units - 1 >= 3 AND " + " AND ".join(f"m{c} - n{c} >= 400" for c in CLASSES) + " AS feasible FROM units u JOIN c USING (unit) JOIN m ON m.g0 = u.g0"))
def m23_move_feasible(spark, d):
    """May a unit leave its cluster: enough units and enough rows of each class stay there."""
    u = fx.obs(spark, d).groupBy("unit").agg(*[F.count_if(F.col("y") == c).alias(f"n{c}") for c in CLASSES]).join(labels(spark, d), "unit")
    m = u.groupBy("g").agg(F.count("*").alias("units"), *[F.sum(f"n{c}").alias(f"m{c}") for c in CLASSES])
    ok = F.col("units") - 1 >= 3
    for c in CLASSES:
        ok = ok & (F.col(f"m{c}") - F.col(f"n{c}") >= 400)
    return u.join(m, "g").select("unit", ok.alias("feasible"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000 AND o_custkey IS NOT NULL)")
def j12_anti_join(spark, d):
    o = fx.table(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return fx.table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


_FIXED_LL = ", f AS (SELECT u.g0 AS g, CAST(count(DISTINCT u.unit) AS DOUBLE) AS units, CAST(count(*) AS DOUBLE) AS n, sum(ll) AS ll FROM units u JOIN (SELECT unit, CASE (SELECT g0 FROM units v WHERE v.unit = o.unit) WHEN 1 THEN {0} WHEN 2 THEN {1} ELSE {2} END AS ll FROM (SELECT *, x1 / 50 z1, x2 * 10 z2, x3 * 10 z3 FROM obs) o) USING (unit) GROUP BY 1)".format(*(_ll(g) for g in GROUPS))


@query(with_ctes("units obs", _FIXED_LL + ", a AS (SELECT *, avg(units) OVER () / units AS a, CAST(8 AS DOUBLE) AS df FROM f), w AS (SELECT *, sum(n) OVER () * a / sum(a * n) OVER () AS w, sum(n) OVER () AS total FROM a) SELECT round(-2 * sum(ll) + ln(any_value(total)) * 24, 3) AS bic, round(-2 * sum(ll) + 48, 3) AS aic, round(sum(-2 * w * ll) + sum(ln(greatest(units, 2)) * df), 3) AS cb_bic, round(sum(-2 * w * ll) + 48, 3) AS cb_aic, round(sum(w * n), 3) AS weighted_n FROM w"))
def a15_criteria_of_fixed_clusters(spark, d):
    """The information criteria of the fixed coefficients, 8 degrees of freedom a cluster."""
    import numpy as np

    from terrane.operators import partition

    rows = _scaled(spark, d).join(labels(spark, d), "unit")
    own = F.lit(None).cast("double")
    for g in GROUPS:
        own = F.when(F.col("g") == g, F.expr(_ll(g))).otherwise(own)
    per = rows.groupBy("g").agg(F.countDistinct("unit").cast("double").alias("units"), F.count("*").cast("double").alias("n"), F.sum(own).alias("ll")).orderBy("g").collect()  # one row a cluster
    units, n, ll = (np.array([r[c] for r in per]) for c in ("units", "n", "ll"))
    c = partition.criteria(ll, n, units, np.full(len(per), 8.0), 3, 3)
    row = [round(float(c[k]), 3) for k in ("bic_effective", "aic_effective", "cb_bic", "cb_aic", "weighted_n")]
    return spark.createDataFrame([tuple(row)], "bic double, aic double, cb_bic double, cb_aic double, weighted_n double")


# predictions over time

_TRCTE = ", a AS (SELECT unit, t, x1 / 100 AS x1s FROM panel), b AS (SELECT *, " + ", ".join(f"{_TR[j][k]} AS l{j}_{k}" for j in range(5) for k in range(5)) + " FROM a), tr AS (SELECT unit, t, " + ", ".join(f"{c} AS m{i}" for i, c in enumerate(_transition_cols())) + " FROM b), s AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY t) AS rn FROM tr)"


def _argmax_sql(cols: list[str]) -> str:
    top = f"greatest({', '.join(cols)})"
    return "CASE " + " ".join(f"WHEN {c} >= {top} THEN {i}" for i, c in enumerate(cols[:-1])) + f" ELSE {len(cols) - 1} END"


_PLUG = "CASE k " + " ".join(f"WHEN {k} THEN {_argmax_sql([f'm{j * 5 + k}' for j in range(5)])}" for k in range(4)) + f" ELSE {_argmax_sql([f'm{j * 5 + 4}' for j in range(5)])} END"


@query(with_ctes("panel", f"{_TRCTE}, f AS (SELECT unit, t, rn, {_PLUG} AS k FROM (SELECT *, 4 AS k FROM s WHERE rn = 1) UNION ALL SELECT unit, t, rn, {_PLUG} FROM (SELECT s.*, f.k FROM s JOIN f ON f.unit = s.unit AND s.rn = f.rn + 1)) SELECT unit, t, ['click', 'error', 'purchase', 'signup', 'view'][k + 1] AS yhat FROM f").replace("WITH panel", "WITH RECURSIVE panel"))
def w08_plug_in_prediction(spark, d):
    return panels.plug_in(transition_rows(spark, d), "m", EVENTS, "view")


_MV = ", ".join(f"({' + '.join(f'm{j * 5 + k} * a{k}' for k in range(5))}) AS b{j}" for j in range(5))
_NORM = ", ".join(f"b{j} / (b0+b1+b2+b3+b4) AS a{j}" for j in range(5))


@query(with_ctes("panel", f"{_TRCTE}, f AS (SELECT unit, t, rn, {_NORM} FROM (SELECT unit, t, rn, {_MV} FROM (SELECT *, {', '.join(f'CAST(0.2 AS DOUBLE) AS a{k}' for k in range(5))} FROM s WHERE rn = 1)) UNION ALL SELECT unit, t, rn, {_NORM} FROM (SELECT s.unit, s.t, s.rn, {_MV} FROM s JOIN f ON f.unit = s.unit AND s.rn = f.rn + 1)) SELECT unit, t, {', '.join(f'round(a{j}, 6) AS p{j}' for j in range(5))} FROM f").replace("WITH panel", "WITH RECURSIVE panel"))
def w09_filter_through_gaps(spark, d):
    f = panels.filter_states(transition_rows(spark, d), "m", 5, [0.2] * 5, restart=False)
    return f.select("unit", "t", *[F.round(F.col("prob")[j], 6).alias(f"p{j}") for j in range(5)])


# tuning

_SHRUNK = [[f"{fx.coef(1, j, 0)} + " + " + ".join(f"{fx.coef(1, j, t)} / (1 + lam) * z{t}" for t in (1, 2, 3))] for j in range(3)]
_LAMBDAS = (0.0, 0.1, 0.5, 2.0)


@query(with_ctes("obs", ", z AS (SELECT y, x1 / 50 AS z1, x2 * 10 AS z2, x3 * 10 AS z3, lam FROM obs, (SELECT unnest([0.0::DOUBLE, 0.1, 0.5, 2.0]) AS lam)), e AS (SELECT *, " + ", ".join(f"{_SHRUNK[j][0]} AS e{j}" for j in range(3)) + " FROM z), p AS (SELECT y, lam, " + ", ".join(f"{p} AS p{j}" for j, p in enumerate(fx.softmax_sql(["e0", "e1", "e2"]))) + f" FROM e) SELECT lam AS \"lambda\", round(-avg(ln({_TRUE})), 6) AS loss FROM p GROUP BY 1"))
def m34_path_losses(spark, d):
    m = model.Model("global", COEF[:1], CLASSES, FEATURES)
    return rounded(model.path_losses(_scaled(spark, d), m, _LAMBDAS, lambda b, t, lam: b if t == 0 else b / (1 + lam)), "loss")


_TRIALS = "SELECT CAST(o_orderkey % 3 AS INTEGER) AS cluster, CAST(o_custkey % 5 AS DOUBLE) / 5 + 0.2::DOUBLE AS alpha, CASE WHEN o_orderkey % 3 = 1 AND o_custkey % 5 = 2 THEN NULL ELSE avg(o_totalprice) END AS loss FROM orders GROUP BY 1, 2, o_orderkey % 3, o_custkey % 5"


def _trials(spark, d):
    o = fx.table(spark, d, "orders").groupBy((F.col("o_orderkey") % 3).cast("int").alias("cluster"), (F.col("o_custkey") % 5).alias("k")).agg(F.avg("o_totalprice").alias("loss"))
    return o.select("cluster", (F.col("k").cast("double") / 5 + 0.2).alias("alpha"), F.when(~((F.col("cluster") == 1) & (F.col("k") == 2)), F.col("loss")).alias("loss"))


@query(f"WITH t AS ({_TRIALS}), s AS (SELECT alpha, avg(loss) AS score FROM t GROUP BY 1 HAVING count(*) = count(loss)) SELECT round(alpha, 6) AS alpha, round(score, 6) AS score FROM s ORDER BY s.score, s.alpha LIMIT 1")
def m35_shared_alpha(spark, d):
    return rounded(model.shared_alpha(_trials(spark, d)), "alpha", "score")


@query(f"WITH t AS ({_TRIALS.replace('alpha', 'lam')}), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY coalesce(loss, CAST('inf' AS DOUBLE)), lam DESC) rn, max(CASE WHEN lam = 0.2::DOUBLE THEN loss END) OVER (PARTITION BY cluster) AS own FROM t) SELECT cluster, CAST(0.2 AS DOUBLE) AS \"before\", round(CASE WHEN loss < own - 300 THEN lam ELSE 0.2::DOUBLE END, 6) AS \"after\" FROM r WHERE rn = 1")
def m36_local_lambdas(spark, d):
    t = _trials(spark, d).withColumnRenamed("alpha", "lambda").withColumn("before", F.lit(0.2))
    return rounded(model.local_lambdas(t, 300.0), "before", "after")


@query("SELECT k, round(a, 6) AS alpha FROM (SELECT DISTINCT n_nationkey AS k, greatest(0.05::DOUBLE, least(1.0::DOUBLE, n_nationkey / 20.0::DOUBLE + x)) AS a FROM nation, (SELECT unnest([0.0::DOUBLE, -0.2, -0.1, 0.1, 0.2]) AS x))")
def m37_final_alphas(spark, d):
    n = fx.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") / 20.0).alias("a"))
    return rounded(n.select("k", F.explode(model.final_alphas(F.col("a"), (-0.2, -0.1, 0.1, 0.2))).alias("alpha")), "alpha")


@query("WITH t AS (SELECT CAST(o_orderkey % 4 AS INTEGER) AS block, [0.5::DOUBLE, 1.0, 2.0, 4.0][o_custkey % 4 + 1] AS multiplier, avg(o_totalprice) AS loss FROM orders GROUP BY 1, 2), s AS (SELECT multiplier, avg(loss) AS loss FROM t GROUP BY 1) SELECT multiplier, round(loss, 6) AS loss FROM s ORDER BY s.loss, s.multiplier LIMIT 1")
def m38_penalty_multiplier(spark, d):
    """The multiplier of the penalty with the least mean loss over held-out blocks."""
    o = fx.table(spark, d, "orders").groupBy((F.col("o_orderkey") % 4).alias("cluster"), F.element_at(F.array(*[F.lit(x) for x in (0.5, 1.0, 2.0, 4.0)]), (F.col("o_custkey") % 4 + 1).cast("int")).alias("alpha")).agg(F.avg("o_totalprice").alias("loss"))
    return rounded(model.shared_alpha(o).select(F.col("alpha").alias("multiplier"), F.col("score").alias("loss")), "multiplier", "loss")


# study tables

_SCENARIO, _ETA, _REP = ("global", "clustered", "smooth"), (0.0, 0.5), 4


@query("SELECT scenario, eta, replicate, CAST('0x' || substr(md5(concat_ws('|', scenario, CAST(CAST(eta * 10 AS INTEGER) AS VARCHAR), CAST(replicate AS VARCHAR))), 1, 7) AS BIGINT) AS seed FROM (SELECT unnest(['global', 'clustered', 'smooth']) AS scenario), (SELECT unnest([0.0::DOUBLE, 0.5]) AS eta), (SELECT CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS replicate) WHERE NOT (scenario = 'global' AND eta > 0)")
def r02_study_grid(spark, d):
    """Every cell of a study once (settings that a scenario doesn't use fall together), with a seed of its own."""
    from terrane.operators import reports

    return reports.study_grid(spark, {"scenario": _SCENARIO, "eta": _ETA, "replicate": tuple(range(1, _REP + 1))}, {"global": ("eta",)})


_DATASET = f"CASE WHEN {draw_sql(71, 'unit')} % 10 < 6 THEN 'Train' WHEN {draw_sql(71, 'unit')} % 10 < 9 THEN 'Test' ELSE 'New' END"


@query(with_ctes("units obs", f", {fx.CTE['pred']}, ds AS (SELECT pred.* EXCLUDE (stratum), {_DATASET} AS stratum FROM pred), {_CM}, {_KAPPA}, mn AS (SELECT stratum, count(*) n, avg(CASE WHEN y = yhat THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS accuracy, -avg(ln({_TRUE})) AS logloss, avg({_BRIER}) AS brier FROM ds GROUP BY 1), ea AS (SELECT stratum, avg(f1) AS macro_f1 FROM r GROUP BY 1) SELECT stratum AS dataset, CAST(n AS BIGINT) AS n, {r6('accuracy', 'logloss', 'brier', 'kappa', 'macro_f1')} FROM mn JOIN kp USING (stratum) JOIN ea USING (stratum)".replace("FROM pred CROSS JOIN c", "FROM ds CROSS JOIN c").replace("count(*) n FROM pred", "count(*) n FROM ds")))
def r05_evaluation_by_dataset(spark, d):
    from terrane.functions.draws import draw

    k = draw(71, "unit") % 10
    rows = fx.predicted(spark, d).withColumn("dataset", F.when(k < 6, "Train").when(k < 9, "Test").otherwise("New"))
    out = metrics.overall_metrics(rows, CLASSES, ("p0", "p1", "p2"), ("dataset",))
    return rounded(out, "accuracy", "logloss", "brier", "kappa", "macro_f1").select("dataset", "n", "accuracy", "logloss", "brier", "kappa", "macro_f1")


# generators

_REGION = "concat('R', CASE WHEN x <= 0 THEN 1 ELSE 2 END, CASE WHEN y <= 2.0 / 3 THEN 1 WHEN y <= 4.0 / 3 THEN 2 ELSE 3 END)"


@query(f"WITH e AS (SELECT event_id, {_REGION} AS region FROM (SELECT event_id, {_XY} FROM events)), q AS (SELECT * FROM (VALUES ('R11', 25), ('R12', 20), ('R13', 20), ('R21', 15), ('R22', 5), ('R23', 5)) AS t(region, n)) SELECT event_id, region FROM (SELECT e.*, n, row_number() OVER (PARTITION BY region ORDER BY {draw_sql(81, 'event_id')}, event_id) AS rn FROM e JOIN q USING (region)) WHERE rn <= n")
def d05_ratio_sample(spark, d):
    """A fixed number of points of each region, drawn by hashed ranks."""
    from terrane.operators import simulate

    e = fx.table(spark, d, "events").selectExpr("event_id", *_XY.split(", ")).select("event_id", F.expr(_REGION).alias("region"))
    return simulate.ratio_sample(e, "event_id", {"R11": 25, "R12": 20, "R13": 20, "R21": 15, "R22": 5, "R23": 5}, 81)


def _usql(seed: int) -> str:
    return f"({draw_sql(seed, 'event_id')} / CAST(4294967296 AS DOUBLE) - 0.5)"


@query("WITH r AS (SELECT event_id, " + ", ".join(f"sqrt(0.3::DOUBLE) * {_usql(91 if j < 2 else 92)} + sqrt(0.7::DOUBLE) * {_usql(100 + j)} AS v{j}" for j in range(4)) + " FROM events) SELECT event_id, " + ", ".join(f"round((v{j} - (SELECT avg(v{j}) FROM r)) / (SELECT stddev_pop(v{j}) FROM r), 6) AS x{j + 1}" for j in range(4)) + " FROM r")
def d07_correlated_predictors(spark, d):
    """Two active and two inactive predictors, each pair with a shared field (correlation 0.3), scaled."""
    from terrane.operators import simulate

    return rounded(simulate.correlated_predictors(fx.events(spark, d).select("event_id"), "event_id", 2, 2, 0.3), "x1", "x2", "x3", "x4")


# fits; their values are checked against single-machine solvers in the tests


def _vectors(spark, d, n: int):
    return fx.table(spark, d, "embeddings").select(F.col("label").cast("string").alias("y"), *[F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(n)]), [f"v{i}" for i in range(n)]


def _embedding_classes(rows) -> tuple[str, ...]:
    return tuple(r[0] for r in rows.select("y").distinct().orderBy(F.col("y").cast("int")).collect())  # the classes


@query()
def m05_elastic_net(spark, d):
    """Coefficients of a grouped elastic net of the embeddings' labels on six of their dimensions, over all rows."""
    from terrane.operators import distributed

    rows, features = _vectors(spark, d, 6)
    classes = _embedding_classes(rows)
    e, _ = distributed.fit(rows, None, 1, features, classes, 0.6, 0.01)[0]
    return spark.createDataFrame([(c, t, float(e.coef[j, i])) for j, c in enumerate(classes) for i, t in enumerate(("(Intercept)", *features))], "class string, term string, coef double")


@query()
def m12_effective_df(spark, d):
    """Effective degrees of freedom of ridge fits along a path of penalties, over all rows."""
    from terrane.operators import distributed

    rows, features = _vectors(spark, d, 4)
    rows = rows.cache()
    classes = _embedding_classes(rows)
    out = [(lam, float(distributed.fit(rows, None, 1, features, classes, 0.0, lam)[0][1])) for lam in (0.0, 0.01, 0.1, 1.0)]
    rows.unpersist()
    return spark.createDataFrame(out, "lambda double, df double")


@query()
def m24_local_coefficients(spark, d):
    """Of every unit the centred coefficients of an elastic net on its 10 nearest units."""
    from terrane.operators import gw

    u = fx.units(spark, d)
    coef = gw.nearest_coefficients(u, gw.fit_anchors(_scaled(spark, d), u, u, list(FEATURES), CLASSES, 10, 0.2, 0.05, False, False))
    return coef.select("unit", F.posexplode("coef").alias("place", "coef"))


@query()
def m25_gw_predict(spark, d):
    """Mean predicted probabilities of every unit from locally weighted fits at every fourth unit."""
    from terrane.operators import gw

    u, rows = fx.units(spark, d), _scaled(spark, d)
    fitted = gw.fit_anchors(rows, u, u.where("unit % 4 = 0"), list(FEATURES), CLASSES, 8, 0.5, 0.01)
    p = gw.predict(rows, gw.nearest_coefficients(u, fitted), list(FEATURES), CLASSES)
    return p.groupBy("unit").agg(*[F.avg(F.col("prob")[j]).alias(f"p_{c}") for j, c in enumerate(CLASSES)])


_MOMENTS = "CAST(count(*) AS BIGINT) AS n, " + ", ".join(f"round(avg(CASE WHEN y = '{c}' THEN {v} ELSE CAST(0 AS DOUBLE) END), 9) + 0.0::DOUBLE AS {c}_{t}" for c in CLASSES for t, v in (("share", "CAST(1 AS DOUBLE)"), ("z1", "x1 / 50"), ("z2", "x2 * 10"), ("z3", "x3 * 10")))


def _moments(out, *keys):
    """Means of the probabilities and of their products with the predictors, which at the optimum are those of the classes."""
    each = [(F.round(F.avg(F.col(f"p_{c}") * v), 9) + F.lit(0.0)).alias(f"{c}_{t}") for c in CLASSES for t, v in (("share", F.lit(1.0)), *((f, F.col(f)) for f in FEATURES))]
    return out.groupBy(*keys).agg(F.count("*").alias("n"), *each)


@query(with_ctes("obs", f"SELECT {_MOMENTS} FROM obs"))
def m01_fit_global(spark, d):
    """An unpenalised model of all rows: its moments are those of the classes, which only the optimum has."""
    from terrane.operators import fitting

    rows = _scaled(spark, d)
    return _moments(fitting.fit(rows, FEATURES, CLASSES, "none").predict(rows))


@query(with_ctes("units obs", f"SELECT g0 AS g, {_MOMENTS} FROM obs JOIN units USING (unit) GROUP BY 1"))
def m02_fit_fixed_clusters(spark, d):
    """An unpenalised model of each cluster."""
    from terrane.operators import fitting

    rows = _scaled(spark, d).join(labels(spark, d), "unit")
    return _moments(fitting.fit(rows, FEATURES, CLASSES, "none", cluster="g").predict(rows, cluster="g"), "g")


@query()
def m06_cross_validated_path(spark, d):
    """Deviance and its standard error along paths of penalties for two alphas, over three folds; the values are checked in the tests."""
    from terrane.functions.draws import draw
    from terrane.operators import fitting

    rows = _scaled(spark, d).withColumn("fold", (draw(51, "unit") % 3 + 1).cast("int")).select("y", "fold", *FEATURES)
    path = fitting.cross_validated(rows, FEATURES, CLASSES, (0.5, 1.0), (0.1, 0.01, 0.001))
    return spark.createDataFrame([(*t, t[0] == path.alpha and t[1] == path.lambda_min) for t in path.trials], "alpha double, lambda double, deviance double, error double, chosen boolean")


# sources and sinks


@query("SELECT lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS id, CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS name, n_nationkey / 8.0::DOUBLE AS v FROM nation")
def s01_csv_round_trip(spark, d):
    """Ids stay strings with their zeros, and nulls nulls, through a CSV file."""
    from terrane.sources import tables

    n = fx.table(spark, d, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("id"), F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name")).alias("name"), (F.col("n_nationkey") / 8.0).alias("v"))
    path = tables.shared_path(spark, "nation")
    tables.write_csv(n, path)
    return tables.read_csv(spark, path, "id string, name string, v double")


@query("SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS run, CAST(s_suppkey AS BIGINT) AS unit, CAST(g AS INTEGER) AS cluster, CASE g WHEN 1 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END AS weight FROM supplier, (SELECT unnest([1, 2]) AS g)")
def s03_membership_files(spark, d):
    """All membership files of a folder, as one long table."""
    from terrane.sources import tables

    u = fx.table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "even").otherwise("odd").alias("run"), F.col("s_suppkey").cast("long").alias("unit"), F.array(F.lit(0.25), F.lit(0.75)).alias("weights"))
    path = tables.shared_path(spark, "members")
    for run in ("even", "odd"):
        u.where(F.col("run") == run).write.mode("append").parquet(path)
    return tables.membership_long(tables.read_membership(spark, path))


@query("SELECT r_name AS run_id, r_regionkey > 2 AS pending, CASE WHEN r_regionkey <= 2 THEN CAST((SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS BIGINT) END AS n FROM region")
def s06_study_resumed(spark, d):
    """Runs that a study has yet to do; a run done twice counts once."""
    from terrane.sources import tables

    study = tables.Study(spark, tables.shared_path(spark, "study"), {"grid": "regions"}, code="v1")
    n = fx.table(spark, d, "nation")
    runs = fx.table(spark, d, "region").select(F.col("r_name").alias("run_id"), "r_regionkey")
    for k in (0, 1, 2, 1):
        study.save(runs.where(F.col("r_regionkey") == k).first()[0], "result", n.where(F.col("n_regionkey") == k).select("n_nationkey"))
    done = study.report("result").groupBy("run_id").agg(F.count("*").alias("n"))
    left = study.pending(runs).select("run_id", F.lit(True).alias("pending"))
    return runs.join(left, "run_id", "left").join(done, "run_id", "left").select("run_id", F.coalesce("pending", F.lit(False)).alias("pending"), "n")


@query("SELECT 'result' AS name, CAST(n_regionkey AS VARCHAR) AS run_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation GROUP BY 2 UNION ALL SELECT 'timing', CAST(r_regionkey AS VARCHAR), CAST(1 AS BIGINT), CAST(r_regionkey * 10 AS BIGINT) FROM region")
def s08_report_files(spark, d):
    """Every table of a study as one CSV file, read again."""
    from terrane.sources import tables

    study, n = tables.Study(spark, tables.shared_path(spark, "study"), {"grid": "regions"}), fx.table(spark, d, "nation")
    for k in range(5):
        study.save(str(k), "result", n.where(F.col("n_regionkey") == k).select(F.col("n_nationkey").cast("long").alias("v")))
        study.save(str(k), "timing", spark.range(1).select((F.col("id") + 10 * k).alias("v")))
    out = tables.shared_path(spark, "csv")
    read = [tables.read_csv(spark, f"{out}/{t}", "v long, run_id string").withColumn("name", F.lit(t)) for t in study.write_reports(out)]
    return read[0].unionByName(read[1]).groupBy("name", "run_id").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
