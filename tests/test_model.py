"""The model's interface, distributed fits, label changes and tuning against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import distributed, model, panels, partition, solver

CLASSES = ("a", "b", "c")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3)) * [1, 5, 0.2] + [0, 2, 1]
    beta = np.array([[1, -0.3, 0], [0, 0.2, 0], [-1, 0.1, 0]])
    p = solver.softmax(x @ beta.T)
    y = np.array([rng.choice(3, p=q) for q in p])
    unit = np.arange(600) % 40
    rows = spark.createDataFrame([(int(u), CLASSES[k], *map(float, v)) for u, k, v in zip(unit, y, x)], "unit long, y string, f1 double, f2 double, f3 double").repartition(3)
    return x, y, unit, rows.cache()


@pytest.mark.parametrize("alpha, lam, grouped", [(0.6, 0.02, True), (1.0, 0.05, False), (0.0, 0.1, True), (0.5, 0.0, True)])
def test_distributed_fit_equals_the_plain_solver(data, alpha, lam, grouped):
    x, y, _, rows = data
    want = solver.fit(x, y, CLASSES, alpha, lam, grouped, steps=20_000, tol=1e-13)
    got, df = distributed.fit(rows, None, 1, ["f1", "f2", "f3"], CLASSES, alpha, lam, grouped)[0]
    assert got.converged and np.abs(got.predict(x) - want.predict(x)).max() < 1e-5
    assert np.abs(got.centred()[:, 1:] - want.centred()[:, 1:]).max() < 1e-4
    assert df == pytest.approx(solver.effective_df(want, x), abs=1e-2)


def test_distributed_fit_of_clusters(data):
    x, y, unit, rows = data
    label = (np.arange(40) % 2).astype(int)
    fitted = distributed.fit(rows, distributed.Places(list(range(40)), label), 2, ["f1", "f2", "f3"], CLASSES, 0.5, np.array([0.01, 0.03]), center=np.tile(x.mean(0), (2, 1)), scale=np.tile(x.std(0), (2, 1)))
    for g, (e, _) in enumerate(fitted):
        own = label[unit] == g
        z = (x[own] - x.mean(0)) / x.std(0)
        b = np.c_[e.coef[:, :1] + e.coef[:, 1:] @ x.mean(0)[:, None], e.coef[:, 1:] * x.std(0)]
        grad = (solver.softmax(np.c_[np.ones(len(z)), z] @ b.T) - np.eye(3)[y[own]]).T @ np.c_[np.ones(len(z)), z] / own.sum()
        lam, norm = (0.01, 0.03)[g], np.sqrt((b[:, 1:] ** 2).sum(0))
        assert np.abs(grad[:, 0]).max() < 1e-6
        for j in range(3):
            slope = grad[:, 1 + j] + lam * 0.5 * b[:, 1 + j]
            assert np.abs(slope + lam * 0.5 * b[:, 1 + j] / norm[j]).max() < 1e-5 if norm[j] > 0 else np.sqrt((slope**2).sum()) <= lam * 0.5 + 1e-7


def graph_of(n, rng):
    near = [[] for _ in range(n)]
    for i in range(n):
        for j in rng.choice(n, 3, replace=False).tolist():
            if i != j and all(j != k for k, _ in near[i]):
                w = float(rng.random())
                near[i].append((j, w))
                near[j].append((i, w))
    return near


def test_pseudo_likelihood_changes_equal_recomputing():
    rng = np.random.default_rng(5)
    near, label = graph_of(25, rng), rng.integers(0, 3, 25)
    s = partition.supports(label, near, 3)
    for u in range(25):
        change = partition.pseudo_change(u, s, label, near[u], 1.7)
        for h in range(3):
            new = label.copy()
            new[u] = h
            want = partition.pseudo_loglik(partition.supports(new, near, 3), new, 1.7) - partition.pseudo_loglik(s, label, 1.7)
            assert change[h] == pytest.approx(want, abs=1e-10)


def test_estimated_phi_is_the_maximum():
    rng = np.random.default_rng(6)
    for _ in range(5):
        near, label = graph_of(40, rng), rng.integers(0, 3, 40)
        s = partition.supports(label, near, 3)
        phi = partition.estimated_phi(s, label)
        grid = np.linspace(0, 20, 4001)
        assert partition.pseudo_loglik(s, label, phi) >= max(partition.pseudo_loglik(s, label, x) for x in grid) - 1e-9


@pytest.mark.parametrize("update", ["fixed", "pl"])
def test_partition_is_monotone(spark, data, update):
    import pandas as pd

    x, y, unit, rows = data
    xy = np.random.default_rng(1).random((40, 2))
    units = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "unit long, cx double, cy double")
    start = pd.DataFrame({"unit": range(40), "g": np.arange(40) % 2})
    f = partition.fit_partition(rows, units, ["f1", "f2", "f3"], CLASSES, start, partition.Control(phi_update=update, max_iter=3, min_units=3, min_per_class=1, lam=0.01))
    assert (np.diff(f.trace) >= -1e-6 * abs(f.trace[0])).all() and len(f.trace) > 1
    assert np.isfinite(f.logpl) and (f.phi != 1.0) == (update == "pl")


def test_checks_of_the_interface(spark):
    rows = spark.createDataFrame([(1, 2.0, 3.0)], "id long, b double, a double")
    assert model.matched_features(rows, ("a", "b"), ("id",)).columns == ["id", "a", "b"]
    with pytest.raises(ValueError):
        model.matched_features(rows, ("a", "c"), ("id",))
    with pytest.raises(Exception, match="finite"):
        model.matched_features(rows.withColumn("a", F.lit(float("nan"))), ("a", "b"), ("id",)).collect()
    for bad in ({"a": F.lit(-1.0)}, {"a": F.lit(0.0)}, {"a": F.lit(None).cast("double")}):
        with pytest.raises(Exception, match="mass"):
            rows.select(*model.normalised(bad, ("a", "z")).values()).collect()
    with pytest.raises(ValueError):
        model.normalised({"q": F.lit(1.0)}, ("a",))
    assert model.penalty_alphas("none") == ([], None) and model.penalty_alphas("elastic_net", 0.3) == ([0.3], 0.3)
    for args in (("ridge", 0.5), ("lasso", 0.5), ("none", 0.5), ("other",), ("elastic_net", 0.0)):
        with pytest.raises(ValueError):
            model.penalty_alphas(*args)
    assert model.least_per_class(2, "xy") == {"x": 2, "y": 2} and model.least_per_class([1, 2], "xy") == {"x": 1, "y": 2}
    for least in ([1], {"x": 1, "z": 2}):
        with pytest.raises(ValueError):
            model.least_per_class(least, "xy")
    model.check_lag_columns(["lag_x", "lag_y"], ["lag_x", "lag_y", "v"], "xy")
    with pytest.raises(ValueError):
        model.check_lag_columns(["lag_x"], ["lag_x"], "xy")


def test_predictions_of_the_three_kinds(data):
    x, _, unit, rows = data
    spark = rows.sparkSession
    rng = np.random.default_rng(2)
    coef = rng.normal(size=(2, 3, 4)).tolist()
    each = np.array([solver.softmax(np.c_[np.ones(600), x] @ np.array(c).T) for c in coef])
    one = model.Model("global", coef[:1], CLASSES, ("f1", "f2", "f3"))
    weights = spark.createDataFrame([(int(u), g, w) for u in range(40) for g, w in ((0, 0.3), (1, 0.7))], "unit long, g int, weight double")
    mixed = model.Model("scmr", coef, CLASSES, ("f1", "f2", "f3"))
    fixed = model.Model("fixed_clusters", coef, CLASSES, ("f1", "f2", "f3"), ("0", "1"))
    own = rows.withColumn("c", F.col("unit") % 2)
    for out, want in ((one.predict(rows, kind="class"), lambda i: each[0][i]), (mixed.predict(rows, weights, kind="class"), lambda i: 0.3 * each[0][i] + 0.7 * each[1][i]), (fixed.predict(own, cluster="c", kind="class"), lambda i: each[unit[i] % 2][i])):
        place = {tuple(np.round(v, 9)): i for i, v in enumerate(x)}
        for r in out.collect():
            p = want(place[tuple(np.round([r.f1, r.f2, r.f3], 9))])
            assert np.allclose([r.p_a, r.p_b, r.p_c], p, atol=1e-9) and r.yhat == CLASSES[int(np.argmax(p))]
    with pytest.raises(Exception, match="unknown fixed cluster"):
        fixed.predict(rows.withColumn("c", F.lit("7")), cluster="c").collect()
    assert "fixed_clusters" in str(fixed)


def test_tuning_tables(spark):
    t = spark.createDataFrame([(0, 0.2, 1.0), (1, 0.2, 3.0), (0, 0.5, 1.0), (1, 0.5, None), (0, 0.9, 2.0), (1, 0.9, 2.0)], "cluster int, alpha double, loss double")
    assert tuple(model.shared_alpha(t).first()) == (0.2, 2.0)  # the least of ties; a failed cluster rules 0.5 out
    lam = spark.createDataFrame([(0, 1.0, 5.0, 1.0), (0, 2.0, 4.9, 1.0), (1, 1.0, 5.0, 1.0), (1, 2.0, 4.0, 1.0), (2, 1.0, None, 1.0), (2, 2.0, 3.0, 1.0)], "cluster int, lambda double, loss double, before double")
    assert {r.cluster: r.after for r in model.local_lambdas(lam, 0.5).collect()} == {0: 1.0, 1: 2.0, 2: 2.0}
    got = spark.range(1).select(model.final_alphas(F.lit(0.95), (-0.1, 0.1)).alias("a")).first()["a"]
    assert got == pytest.approx([0.85, 0.95, 1.0])


def test_plug_in_prediction(spark):
    rng = np.random.default_rng(9)
    m = rng.random((2, 6, 3, 3))
    rows = spark.createDataFrame([(u, 2 * t, m[u, t].ravel().tolist()) for u in range(2) for t in range(6)], "unit long, t long, m array<double>")
    got = {(r.unit, r.t): r.yhat for r in panels.plug_in(rows, "m", CLASSES, "b").collect()}
    for u in range(2):
        k = 1
        for t in range(6):
            k = int(m[u, t][:, k].argmax())
            assert got[u, 2 * t] == CLASSES[k]


def test_cross_validation_equals_fits_without_the_fold(spark):
    from terrane.operators import distributed, fitting

    rng = np.random.default_rng(21)
    x = rng.normal(size=(300, 2))
    y = np.array(["a", "b", "c"])[(x @ rng.normal(size=(2, 3)) + rng.gumbel(size=(300, 3))).argmax(1)]
    rows = spark.createDataFrame([(str(c), i % 3 + 1, float(v), float(w)) for i, (c, (v, w)) in enumerate(zip(y, x))], "y string, fold int, u double, w double").cache()
    path = fitting.cross_validated(rows, ("u", "w"), ("a", "b", "c"), (0.5, 1.0), (0.2, 0.01))
    assert len(path.trials) == 4 and path.lambda_1se >= path.lambda_min
    for alpha, lam, deviance, _ in path.trials[:2]:
        total = 0.0
        for f in (1, 2, 3):
            e, _ = distributed.fit(rows.where(f"fold <> {f}"), None, 1, ["u", "w"], ("a", "b", "c"), alpha, lam)[0]
            own = np.arange(300) % 3 + 1 == f
            total -= 2 * np.log(e.predict(x[own])[np.arange(100), np.searchsorted(["a", "b", "c"], y[own])]).sum()
        assert abs(total / 300 - deviance) < 1e-5
    assert path.out_of_fold(rows).count() == 300
    with pytest.raises(ValueError):
        fitting.cross_validated(rows.where("fold = 1"), ("u", "w"), ("a", "b", "c"), (0.5,), (0.1,))
