"""Models fitted by passes against the same problem solved on one machine."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstat.core import EmptyInput, InvalidParameter
from quillstat.operators import iterative, passes
from quillstat.streaming import incremental

X = ["a", "b"]


def data(seed, n, classes=2, d=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, d)) + rng.integers(0, 2, (n, 1))
    z = x @ np.arange(1, d + 1) + rng.normal(0, 0.7, n)
    y = np.digitize(z, np.quantile(z, np.arange(1, classes) / classes)).astype(float)
    return x, y, z


def frame(spark, x, y, parts=5):
    names = [chr(97 + k) for k in range(x.shape[1])]
    rows = [(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in names) + ", y double").repartition(parts), names


def dual_descent(x, y, c=1.0, rounds=2000):
    """The hinge problem's optimum by coordinate descent in row order."""
    z = np.column_stack([x, np.ones(len(x))])
    q, w, a = (z * z).sum(1), np.zeros(z.shape[1]), np.zeros(len(z))
    for _ in range(rounds):
        for i in range(len(z)):
            new = min(max(a[i] - (y[i] * (w @ z[i]) - 1) / q[i], 0.0), c)
            w += (new - a[i]) * y[i] * z[i]
            a[i] = new
    return w


def hinge(x, y, w, c=1.0):
    return 0.5 * w @ w + c * np.maximum(0, 1 - y * (x @ w[:-1] + w[-1])).sum()


@pytest.mark.parametrize("classes", [2, 3])
def test_linear_svc_reaches_the_optimum(spark, classes):
    x, y, _ = data(1, 150, classes)
    df, names = frame(spark, x, y)
    m = iterative.LinearSvc().fit(df, names, "y")
    for k, v in enumerate(m.labels[1:] if classes == 2 else m.labels):
        t = np.where(y == v, 1.0, -1.0)
        best = hinge(x, t, dual_descent(x, t, rounds=400))
        assert hinge(x, t, np.append(m.weights[k], m.bias[k])) <= best * (1 + 1e-3)


def test_linear_svr_reaches_the_optimum(spark):
    x, _, z = data(2, 200)
    df, names = frame(spark, x, z)
    m = iterative.LinearSvr(alpha=1e-3).fit(df, names, "y")
    value = lambda w: np.maximum(0, np.abs(x @ w[:2] + w[2] - z) - 0.1).mean() + 5e-4 * w[:2] @ w[:2]
    w, best = np.zeros(3), np.inf
    for t in range(60_000):  # subgradient descent with a falling step
        g = np.sign(r := x @ w[:2] + w[2] - z) * (np.abs(r) > 0.1) / len(z)
        w = w - 0.5 / (1 + t) ** 0.6 * (np.append(x.T @ g, g.sum()) + 1e-3 * np.append(w[:2], 0))
        best = min(best, value(w)) if t % 50 == 0 else best
    assert value(np.append(m.weights[0], m.bias[0])) <= best + 1e-3


def test_gradient_of_a_network_by_differences():
    x, y, z = data(3, 40, 3, 4)
    for regression, target in ((False, y), (True, z)):
        m = iterative.MlpClassifier([5, 3], "tanh", regression=regression)
        sizes, labels = [4, 5, 3, 1 if regression else 3], None if regression else [0.0, 1.0, 2.0]
        flat = np.random.default_rng(1).normal(0, 0.5, sum(a * b + b for a, b in zip(sizes[:-1], sizes[1:], strict=True)))
        of = lambda f, m=m, sizes=sizes, labels=labels, target=target: m.gradient(m.network(["a"] * 4, f, sizes, labels), x, target)
        g = of(flat)[1:]
        for k in range(0, len(flat), 7):
            e = np.zeros_like(flat)
            e[k] = 1e-6
            assert abs((of(flat + e)[0] - of(flat - e)[0]) / 2e-6 - g[k]) < 1e-4 * max(1, abs(g[k]))


@pytest.mark.parametrize("solver", ["lbfgs", "adam", "sgd"])
def test_networks_learn_and_do_not_depend_on_partitions(spark, solver):
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (300, 2))
    y = ((x[:, 0] * x[:, 1]) > 0).astype(float)
    make = lambda: iterative.MlpClassifier([8], "tanh", solver, rate={"adam": 0.1}.get(solver, 0.3), epochs=60)
    m = make().fit(*frame(spark, x, y), "y")
    assert (m.predict_array(x) == y).mean() > (0.9 if solver != "sgd" else 0.45)
    if solver == "adam":
        other = make().fit(*frame(spark, x, y, 2), "y")
        assert np.allclose(m.weights[0], other.weights[0], atol=1e-5)


def test_network_regression(spark):
    x, _, z = data(5, 300)
    m = iterative.MlpRegressor([6], "tanh", epochs=30).fit(*frame(spark, x, z), "y")
    assert ((m.predict_array(x) - z) ** 2).mean() < 0.7


@pytest.mark.parametrize("loss", ["hinge", "log", "modified_huber", "perceptron"])
def test_sgd_in_blocks(spark, monkeypatch, loss):
    monkeypatch.setattr(passes, "BLOCK_ROWS", 60)
    x, y, _ = data(6, 400, 3)
    make = lambda parts: iterative.SgdClassifier(loss, epochs=8, eta0=0.3).fit(*frame(spark, x, y, parts), "y")
    m = make(5)
    assert (m.predict_array(x) == y).mean() > 0.6
    assert np.allclose(m.weights, make(2).weights, atol=1e-9)
    more = iterative.SgdClassifier(loss, epochs=2).partial_fit(m, frame(spark, x, y)[0], X, "y")
    assert more.labels == m.labels and more.weights.shape == m.weights.shape


def test_sgd_in_blocks_is_plain_descent_in_one_block(spark):
    x, _, z = data(7, 80)
    m = iterative.SgdRegressor(epochs=1, eta0=0.05, batch=1).fit(*frame(spark, x, z), "y")
    s = spark.createDataFrame([(list(map(float, v)), float(t)) for v, t in zip(x, z, strict=True)], "x array<double>, y double")
    order = [r[0] for r in s.select("x", "y", F.xxhash64("x", "y", F.lit(1)).alias("h")).orderBy("h").select(F.struct("x", "y")).collect()]
    w, b, _ = iterative.SgdRegressor(epochs=1, eta0=0.05)._walk(np.array([r["x"] for r in order]), np.array([r["y"] for r in order]), np.zeros(2), 0.0, 0)
    assert np.allclose(m.weights[0], w, atol=2e-4) and abs(m.bias[0] - b) < 2e-4


def driver_nmf(x, w, h, rounds):
    for _ in range(rounds):
        h = h * (w.T @ x / np.maximum(w.T @ w @ h, 1e-12))
        w = w * (x @ h.T / np.maximum(w @ h @ h.T, 1e-12))
    return w, h


def test_nmf_equals_updates_in_memory(spark):
    rng = np.random.default_rng(8)
    x = rng.random((90, 2)) @ rng.random((2, 4)) + 0.05 * rng.random((90, 4))
    df, names = frame(spark, x, np.zeros(90))
    got = iterative.NMF(2, max_iter=20, tol=0.0).fit(df, names, "id")
    u, s, v = np.linalg.svd(x, full_matrices=False)
    w, h = np.zeros((90, 2)), np.zeros((2, 4))
    for j in range(2):
        a, b = u[:, j], v[j]
        p, q = max(((np.maximum(g * a, 0), np.maximum(g * b, 0)) for g in (1, -1)), key=lambda z: np.linalg.norm(z[0]) * np.linalg.norm(z[1]))
        na, nb = np.linalg.norm(p), np.linalg.norm(q)
        w[:, j], h[j] = np.sqrt(s[j] * na * nb) * p / na, np.sqrt(s[j] * na * nb) * q / nb
    w, h = driver_nmf(x, np.maximum(w, 1e-6), np.maximum(h, 1e-6), got.rounds)
    rows = np.array([r["w"] for r in got.w.orderBy("id").collect()])
    assert np.allclose(rows, w, rtol=1e-4, atol=1e-6) and np.allclose(got.h, h, rtol=1e-4, atol=1e-6)
    assert abs(got.error - np.linalg.norm(x - w @ h)) < 1e-6
    with pytest.raises(InvalidParameter):
        iterative.NMF(2).fit(df.withColumn("a", -F.col("a") - 1), names, "id")
    with pytest.raises(EmptyInput):
        iterative.NMF(2).fit(df.limit(0), names, "id")
    assert iterative.NMF(3, "random", 8).fit(df, names, "id").error < 3.0


def test_ica_separates_sources(spark):
    rng = np.random.default_rng(9)
    s = np.column_stack([rng.uniform(-1, 1, 800), rng.laplace(0, 1, 800)])
    x = s @ np.array([[1.0, 0.6], [0.4, 1.0]]) + [3, -2]
    df, names = frame(spark, x, np.zeros(800))
    m = iterative.FastICA(2).fit(df, names)
    c = np.abs(np.corrcoef(m.decision(x).T, s.T)[:2, 2:])
    assert (c.max(0) > 0.97).all() and sorted(c.argmax(0).tolist()) == [0, 1]
    assert np.allclose(np.cov(m.decision(x).T, bias=True), np.eye(2), atol=1e-8)


def test_ransac_and_theil_sen(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(0, 1, (300, 2))
    z = x @ [2.0, -1.0] + 0.5 + rng.normal(0, 0.02, 300)
    z[::5] += rng.uniform(5, 20, 60)
    df, names = frame(spark, x, z)
    m = iterative.RansacRegressor(50, 0.2).fit(df, names, "y", "id")
    assert np.allclose(m.coef, [2, -1], atol=0.02) and abs(m.intercept - 0.5) < 0.02 and m.extra["inliers"] == 240
    marked = {r["id"] for r in m.inliers(df, "y").filter("inlier").collect()}
    assert marked == set(range(300)) - set(range(0, 300, 5))
    again = iterative.RansacRegressor(50, 0.2).fit(df.repartition(2), names, "y", "id")
    assert np.allclose(again.coef, m.coef, atol=1e-9)
    up = lambda v: np.sort(v)[len(v) // 2]
    assert abs(iterative.RansacRegressor(5).fit(df, names, "y", "id").threshold - up(np.abs(z - up(z)))) < 1e-9
    t = iterative.TheilSenRegressor(300).fit(df, names, "y", "id")
    assert np.allclose(t.coef, [2, -1], atol=0.1)


def test_few_rows_and_classes(spark):
    df, names = frame(spark, np.array([[1.0, 2.0], [3.0, 1.0]]), np.array([1.0, 1.0]))
    for m in (iterative.LinearSvc(), iterative.SgdClassifier()):
        with pytest.raises(InvalidParameter):
            m.fit(df, names, "y")
        with pytest.raises(EmptyInput):
            m.fit(df.limit(0), names, "y")
    assert iterative.RansacRegressor(3, 1.0).fit(df, names, "y", "id").extra["inliers"] == 2


def test_a_stream_of_steps(spark, tmp_path):
    x, y, _ = data(6, 600, 3)
    df = frame(spark, x, y)[0]
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    path = f"file://{tmp_path}/state.json"

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = incremental.StreamingSgdClassifier(X, "y", iterative.SgdClassifier("log", epochs=4, eta0=0.3), sorted(set(y.tolist())), path=path)
        got.writer(stream).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return got

    first = run()
    assert first.last == 2 and (first.state.predict_array(x) == y).mean() > 0.6
    # Rows of an unknown class change nothing, and a restarted stream goes on from the weights it had.
    df.limit(40).withColumn("y", F.lit(99.0)).write.mode("append").parquet(str(tmp_path / "in"))
    again = run()
    assert again.last > 2 and np.array_equal(again.state.weights, first.state.weights)
    again.update(df, again.last)
    assert np.array_equal(again.state.weights, first.state.weights)
