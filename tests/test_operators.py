"""Hand calculations, brute force and invariants of the operators."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrane.operators import graph, metrics, panels, partition, reports, solver, splits


def test_bonus_of_three_nodes(spark):
    w = [[0, 2, 1], [2, 0, 3], [1, 3, 0]]
    e = spark.createDataFrame([(i, j, float(w[i][j])) for i in range(3) for j in range(3) if i != j], "i int, j int, w double")
    g = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "unit int, g int")
    assert graph.spatial_bonus(e, g).first()["bonus"] == 2


def test_pseudo_likelihood_of_three_nodes(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (0, 2, 1.0), (2, 0, 1.0)], "i int, j int, w double")
    g = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "unit int, g int")
    got = graph.potts(graph.support(e, g, (1, 2)), g, 1.0).first()["logpl"]
    assert got == pytest.approx(-np.log(2) + 1 - 2 * np.log(np.e + 1), abs=1e-12)


def test_nearest_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    xy = np.r_[rng.random((60, 2)), rng.random((5, 2)) * 0.01 + 3]
    u = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "unit long, cx double, cy double")
    got = {(r.i, r.j) for r in graph.nearest(u, u, 7, exclude_self=True).collect()}
    d = ((xy[:, None] - xy[None]) ** 2).sum(2) + np.diag(np.full(65, np.inf))
    assert got == {(i, int(j)) for i in range(65) for j in np.argsort(d[i], kind="stable")[:7]}


def test_lag_design_with_gap(spark):
    p = spark.createDataFrame([("1", 1, "a"), ("1", 2, "b"), ("1", 4, "b"), ("2", 1, "a"), ("2", 2, "c")], "unit string, t long, y string")
    got = [r.available for r in panels.lag_design(p, ("a", "b", "c")).orderBy("unit", "t").collect()]
    assert got == [False, True, False, False, True]
    with pytest.raises(ValueError):
        panels.lag_design(p.union(p), ("a",))


def brute(p, a0, seen):
    steps, c = p.shape[0], p.shape[1]
    out, total = np.zeros((steps, c)), 0.0
    for path in itertools.product(range(c), repeat=steps + 1):
        w = a0[path[0]]
        for t in range(steps):
            w *= p[t, path[t + 1], path[t]] * (seen[t] < 0 or seen[t] == path[t + 1])
        total += w
        for t in range(steps):
            out[t, path[t + 1]] += w
    return out / total, np.log(total)


def test_forward_backward_equals_path_enumeration():
    rng = np.random.default_rng(2)
    p = rng.random((5, 3, 3))
    p /= p.sum(1, keepdims=True)
    a0, seen = np.array([0.2, 0.3, 0.5]), np.array([-1, 1, -1, -1, 0])
    got, ll = panels.forward_backward(p, a0, seen)
    want, wl = brute(p, a0, seen)
    assert np.abs(got - want).max() < 1e-10 and abs(ll - wl) < 1e-10


def test_filter_equals_matrix_products(spark):
    rng = np.random.default_rng(3)
    m = rng.random((4, 2, 2))
    m /= m.sum(1, keepdims=True)
    rows = spark.createDataFrame([(1, t, m[i].ravel().tolist()) for i, t in enumerate((1, 2, 3, 5))], "unit long, t long, m array<double>")
    got = {r.t: r.prob for r in panels.filter_states(rows, "m", 2, [0.4, 0.6]).collect()}
    a = np.array([0.4, 0.6])
    for i, t in enumerate((1, 2, 3)):
        a = m[i] @ a
        assert got[t] == pytest.approx(a.tolist(), abs=1e-10)
    assert got[5] == pytest.approx((m[3] @ [0.4, 0.6]).tolist(), abs=1e-10)


def test_metrics_edges(spark):
    r = spark.createDataFrame([("a", "a"), ("b", "c"), ("c", "b")], "y string, yhat string")
    f1 = {x["class"]: x.f1 for x in metrics.class_metrics(r, ("a", "b", "c", "d")).collect()}
    assert f1 == {"a": 1.0, "b": 0.0, "c": 0.0, "d": None}
    one = spark.createDataFrame([("a", "a")] * 4, "y string, yhat string")
    assert metrics.kappa(one).first()["kappa"] is None
    same = spark.createDataFrame([(1, 1)] * 3, "a int, b int")
    assert metrics.adjusted_rand(same, "a", "b").first()[0] == 1 and metrics.adjusted_rand(same, "a", "b", "null").first()[0] is None


def test_split_keeps_one_row_of_each_class(spark):
    r = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c")], "k int, y string")
    kept = splits.stratified_split(r, "k", ("y",), 0.99, 1).where("not is_test").join(r, "k")
    assert sorted(x.y for x in kept.collect()) == ["a", "b", "c"]


def test_allocation(spark):
    r = spark.createDataFrame([(c, w) for c, w in zip("abcdef", (5.0, 4.0, 4.0, 3.0, 1.0, 1.0))], "k string, w double")
    assert [x["count"] for x in reports.allocate(r, "k", "w", 90).orderBy("k").collect()] == [25, 20, 20, 15, 5, 5]


def test_solver_optimum_and_shrinkage():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4))
    y = solver.softmax(x[:, :3] * 1.5).cumsum(1)
    y = (rng.random((300, 1)) > y).sum(1).clip(0, 2)
    for grouped in (True, False):
        fits = [solver.fit(x, y, ("a", "b", "c"), 0.5, lam, grouped) for lam in (0.001, 0.05, 5.0)]
        assert all(e.converged for e in fits) and fits[2].active() == 0
        df = [solver.effective_df(e, x) for e in fits]
        assert df[0] >= df[1] >= df[2]
    plain = solver.fit(x, y, ("a", "b", "c"))
    g = (plain.predict(x) - np.eye(3)[y]).T @ np.c_[np.ones(300), x]
    assert np.abs(g).max() < 1e-5 and np.abs(plain.coef.sum(0)).max() < 1e-10


def test_sweep_only_gains_and_stays_feasible():
    rng = np.random.default_rng(5)
    n, control = 40, partition.Control(min_units=5, min_per_class=1)
    ll, label, counts = rng.normal(size=(n, 3)), rng.integers(0, 3, n), rng.integers(1, 4, (n, 2))
    near = [[((i + 1) % n, 1.0), ((i - 1) % n, 1.0)] for i in range(n)]

    def total():
        return ll[np.arange(n), label].sum() + sum(w for i in range(n) for j, w in near[i] if label[i] == label[j]) / 2

    before = total()
    while partition.sweep(ll, label, near, 1.0, counts, control):
        assert total() > before
        before = total()
    assert np.bincount(label).min() >= 5
    with pytest.raises(ValueError):
        partition.Control(lambda_scale="other")


def test_partition_recovers_two_regimes(spark):
    rng = np.random.default_rng(6)
    xy = rng.random((60, 2))
    rows = []
    for u, (cx, _) in enumerate(xy):
        for _ in range(12):
            x = rng.normal(size=3)
            b = np.array([1.5, -1, 0]) if cx < 0.5 else np.array([-1.5, 1, 0])
            p = solver.softmax((x[0] * b + x[1] * np.roll(b, 1))[None])[0]
            rows.append((u, str(rng.choice(list("abc"), p=p)), *map(float, x)))
    obs = spark.createDataFrame(pd.DataFrame(rows, columns=["unit", "y", "z1", "z2", "z3"]))
    units = spark.createDataFrame(pd.DataFrame({"unit": range(60), "cx": xy[:, 0], "cy": xy[:, 1]}))
    start = pd.DataFrame({"unit": range(60), "g": (xy[:, 0] + rng.normal(0, 0.25, 60) > 0.5).astype(int)})
    f = partition.fit_partition(obs, units, ["z1", "z2", "z3"], ("a", "b", "c"), start, partition.Control(max_iter=4, lam=0.005))
    truth = (xy[:, 0] >= 0.5).astype(int)
    assert max((f.labels == truth).mean(), (f.labels != truth).mean()) > 0.9
    assert (np.diff(f.trace) > -1e-6 * abs(f.trace[0])).all()


def test_entry_imports_without_the_llm_package(tmp_path):
    import subprocess
    import sys
    from pathlib import Path
    from shutil import copytree, ignore_patterns

    root = Path(__file__).resolve().parents[1]
    copytree(root, tmp_path / "r", ignore=ignore_patterns(".git", "llm", "corpus_pipeline.py"))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path / "r", capture_output=True, text=True)
    assert out.returncode == 0 and out.stdout.split()[1] == "False", out.stderr


def test_stream_filter_equals_batch(spark, tmp_path):
    from terrane.streaming.filtering import stream_filter

    rng = np.random.default_rng(9)
    m = rng.random((6, 2, 2))
    m /= m.sum(1, keepdims=True)
    rows = [(u, t, m[(u + t) % 6].ravel().tolist()) for u in (1, 2) for t in (1, 2, 3, 6, 7)]
    schema = "unit long, t long, m array<double>"
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "in"))
    q = stream_filter(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 2, [0.4, 0.6]).writeStream.format("memory").queryName("filtered").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.unit, r.t): r.prob for r in spark.table("filtered").collect()}
    want = {(r.unit, r.t): r.prob for r in panels.filter_states(df, "m", 2, [0.4, 0.6]).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_study_resumes_and_guards(spark, tmp_path):
    from terrane.sources.tables import Study, read_csv, read_membership, write_csv

    s = Study(spark, f"file://{tmp_path}/s", {"a": 1})
    runs = spark.createDataFrame([("r1",), ("r2",)], "run_id string")
    assert s.pending(runs).count() == 2
    s.save("r1", "result", spark.createDataFrame([(1.0,)], "loss double"))
    again = Study(spark, f"file://{tmp_path}/s", {"a": 1})
    assert [r.run_id for r in again.pending(runs).collect()] == ["r2"] and again.report("result").count() == 1
    with pytest.raises(ValueError):
        Study(spark, f"file://{tmp_path}/s", {"a": 2})
    with pytest.raises(ValueError):
        Study(spark, f"file://{tmp_path}/s", {"a": 1}, resume=False)
    assert read_membership(spark, f"file://{tmp_path}/none").count() == 0
    write_csv(spark.createDataFrame([("01", None)], "id string, v double"), f"file://{tmp_path}/csv")
    assert read_csv(spark, f"file://{tmp_path}/csv", "id string, v double").first()[0] == "01"


def test_start_labels_and_original_algorithm():
    from terrane.operators import gw

    rng = np.random.default_rng(10)
    xy = np.r_[rng.normal(0, 0.2, (20, 2)), rng.normal(3, 0.2, (20, 2))]
    control = partition.Control(min_units=5, min_per_class=1)
    label = gw.start_labels(xy, 2, np.ones((40, 2)), control)
    assert len(set(label[:20])) == len(set(label[20:])) == 1
    ll = np.where(np.arange(40)[:, None] < 20, [[0.0, -5.0]], [[-5.0, 0.0]])
    out = gw.original_algorithm(lambda _: ll, rng.integers(0, 2, 40), [[] for _ in range(40)], 1.0)
    assert (out == (np.arange(40) >= 20)).all()
    with pytest.raises(ValueError):
        gw.start_labels(xy, 2, np.zeros((40, 2)), control, tries=4)
