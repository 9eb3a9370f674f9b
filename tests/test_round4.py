"""Methods on all pairs beyond the rows of their dense fits: the same results, in passes."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from quillstat.catalog import base
from quillstat.operators import cluster, iterative, kernels, lowrank, metrics, neighbors, passes, spatial

XY = ["a", "b"]
RBF = kernels.Kernel("rbf", 2.0)


def frame(spark, n=90, seed=0, copies=2):
    """Rows in two dimensions, some of them twice, with a number and two classes."""
    x = np.random.default_rng(seed).random((n, 2))
    x = np.vstack([x, x[: n // 3]])[: n if copies == 1 else None]
    rows = [(i, float(a), float(b), float(2 * a - b), "yes" if a > b else "no") for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "id long, a double, b double, y double, k string"), x


@pytest.fixture(params=["on the driver", "in passes"])
def wide(request, monkeypatch):
    """Turns the fits of more rows on for small tables."""

    def on():
        monkeypatch.setattr(kernels, "DENSE", 10)
        if request.param == "in passes":
            monkeypatch.setattr(lowrank, "HOLD", 10)

    return on


# F11


def test_kernel_ridge_of_many_rows(spark, wide):
    df, x = frame(spark)
    dense = kernels.KernelRidge(0.1, RBF).fit(df, XY, "y").predict_array(x)
    wide()
    model = kernels.KernelRidge(0.1, RBF).fit(df, XY, "y")
    assert len(model.support) < 90
    assert np.abs(model.predict_array(x) - dense).max() < 1e-9


def test_kernel_ridge_takes_more_rows_than_a_dense_fit(spark):
    df = spark.range(5001).selectExpr("id", "double(id) / 5001 AS a", "sin(id / 800.0) AS y")
    model = kernels.KernelRidge(1e-3, kernels.Kernel("rbf", 20.0)).fit(df, ["a"], "y")
    x = np.arange(5001.0) / 5001
    assert np.abs(model.predict_array(x[:, None]) - np.sin(np.arange(5001) / 800)).max() < 0.01


def test_kernel_of_full_rank_keeps_all_pivots(spark, wide):
    df, x = frame(spark, 40)
    make = lambda: kernels.KernelRidge(0.1, kernels.Kernel("matern", length=0.01, nu=0.5)).fit(df, XY, "y")
    dense = make().predict_array(x)
    wide()
    assert len(make().support) == 40 and np.abs(make().predict_array(x) - dense).max() < 1e-9
# F9


@pytest.mark.parametrize("alpha", [1e-4, 1e-8])
def test_process_regression_of_many_rows(spark, wide, alpha):
    df, x = frame(spark)
    make = lambda: kernels.GaussianProcessRegressor(RBF, alpha).fit(df, XY, "y")
    dense = make()
    wide()
    model = make()
    assert np.abs(model.predict_array(x) - dense.predict_array(x)).max() < 1e-6
    assert np.abs(model.std_array(x) - dense.std_array(x)).max() < 1e-6
    again = kernels.WideProcessModel.from_json(model.to_json())
    assert np.array_equal(again.predict_array(x), model.predict_array(x))
# F8


@pytest.mark.parametrize("classes", [2, 3])
def test_process_classes_of_many_rows(spark, wide, classes):
    df, x = frame(spark)
    df = df if classes == 2 else df.selectExpr("id", "a", "b", "CASE WHEN a > 0.6 THEN 'far' ELSE k END AS k")
    make = lambda: kernels.GaussianProcessClassifier(RBF).fit(df, XY, "k")
    dense = make()
    wide()
    model = make()
    assert model.labels == dense.labels
    assert np.abs(model.predict_proba(x) - dense.predict_proba(x)).max() < 1e-6
# F10


def test_kernel_components_of_many_rows(spark, wide):
    df, x = frame(spark)
    make = lambda: kernels.KernelPCA(2, RBF).fit(df, XY)
    dense = make()
    wide()
    model = make()
    a, b = dense.project(x), model.project(x)
    sign = np.sign((a * b).sum(0))
    assert np.abs(a - b * sign).max() < 1e-8 and np.abs(model.values - dense.values).max() < 1e-8
    assert np.abs(model.inverse(b) - dense.inverse(a)).max() < 1e-8
# F20


@pytest.mark.parametrize("classes", [2, 3])
def test_support_vectors_of_many_rows(spark, wide, classes):
    df, x = frame(spark)
    df = df if classes == 2 else df.selectExpr("id", "a", "b", "CASE WHEN a > 0.6 THEN 'far' ELSE k END AS k")
    make = lambda: kernels.Svc(1.0, RBF).fit(df, XY, "k")
    dense = make()
    wide()
    model = make()
    assert model.labels == dense.labels
    assert np.abs(model.decision(x) - dense.decision(x)).max() < 1e-3
# F19


def test_support_vector_regression_of_many_rows(spark, wide):
    df, x = frame(spark)
    make = lambda: kernels.Svr(1.0, 0.1, RBF).fit(df, XY, "y").predict_array(x)
    dense = make()
    wide()
    assert np.abs(make() - dense).max() < 1e-3
# F18


def test_one_class_of_many_rows(spark, wide):
    df, x = frame(spark)
    make = lambda: kernels.OneClassSvm(0.2, RBF).fit(df, XY)
    dense = make().decision(x)[:, 0]
    wide()
    model = make()
    assert np.abs(model.decision(x)[:, 0] - dense).max() < 1e-3
    assert set(model.predict_array(x)) == {-1.0, 1.0}
# F16


def test_share_of_support_vectors_by_classes_of_many_rows(spark, monkeypatch):
    df, x = frame(spark, copies=1)
    make = lambda: kernels.NuSvc(0.5, RBF).fit(df, XY, "k")
    dense = make().decision(x)[:, 0]
    monkeypatch.setattr(kernels, "DENSE", 10)
    got = make().decision(x)[:, 0]
    assert np.abs(got - dense).max() < 0.05 * np.abs(dense).max()
    assert ((got > 0) == (dense > 0))[np.abs(dense) > 0.01].all()
# F17


def test_share_of_support_vectors_by_numbers_of_many_rows(spark, monkeypatch):
    df, x = frame(spark, copies=1)
    make = lambda: kernels.NuSvr(0.5, 1.0, RBF).fit(df, XY, "y").predict_array(x)
    dense = make()
    monkeypatch.setattr(kernels, "DENSE", 10)
    assert np.abs(make() - dense).max() < 0.02
# F21


def test_silhouette_in_blocks(spark, monkeypatch):
    df, x = frame(spark, 60)
    c = np.where(np.arange(len(x)) == 5, 3, np.arange(len(x)) % 3)
    df = df.select("id", "a", "b", F.when(F.col("id") == 5, F.lit(3)).otherwise(F.col("id") % 3).alias("c"))
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    scores = []
    for i in range(len(x)):
        mine = c == c[i]
        a, b = gap[i, mine].sum() / max(mine.sum() - 1, 1), min(gap[i, c == o].mean() for o in set(c) - {c[i]})
        scores.append(1.0 if mine.sum() == 1 else (b - a) / max(a, b))
    monkeypatch.setattr(metrics, "SILHOUETTE_ROWS", 7)
    assert abs(metrics.silhouette_score(df, XY, "c", "id").first()[0] - np.mean(scores)) < 1e-9


def test_silhouette_of_more_than_20_000_rows(spark):
    df = spark.range(20_001).selectExpr("id", "double(id % 3) AS a", "id % 3 AS c")
    assert metrics.silhouette_score(df, ["a"], "c", "id").first()[0] == 1.0
# F22


def test_fast_rounding_is_the_same(spark):
    values = np.concatenate([np.random.default_rng(0).normal(0, 10.0**k, 400) for k in range(-8, 16)])
    near = [0.5e-6, 1.5e-6, -2.5e-6, 0.1234565, 1.0000005, 2.675, -1e-9, 0.0, 1e300, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(float(v),) for v in values] + [((k + 0.5) / 1e6,) for k in range(-300, 300)] + [(v,) for v in near], "v double")
    for digits in (1, 4, 6):
        got = df.select((base.round_half_up(F.col("v"), digits) + 0.0).alias("a"), (F.round("v", digits) + 0.0).alias("b"))
        assert got.filter(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()


def test_pairs_are_made_on_all_cores(spark):
    df, _ = frame(spark, 30)
    got = neighbors.pairwise_distances(df.coalesce(1), df.coalesce(1), "id", XY)
    assert got.count() == 40 * 40 and got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
# F14


def test_scaling_of_many_rows(spark, monkeypatch):
    df, _ = frame(spark)
    read = lambda: np.array(kernels.ClassicalMDS(3).fit_transform(df, "id", XY).orderBy("id").select("e_0", "e_1", "e_2").collect())
    dense = read()
    monkeypatch.setattr(kernels, "DENSE", 10)
    assert np.abs(read() - dense).max() < 1e-6
# F1


def test_linear_classes_of_equal_rows_read_them_once(spark, monkeypatch):
    df = spark.range(4000).selectExpr("double(id % 5) AS a", "double(id % 7) AS b", "CASE WHEN id % 5 + id % 7 > 5 OR id % 35 = 3 THEN 1.0 ELSE 0.0 END AS k")
    with passes.Table(df, XY, "k", equal=True) as table:
        assert table.n == 4000 and len(table.held[0]) == 35 and table.weighted_sums(lambda x, y, w: np.array([w.sum()]))[0] == 4000
    equal = iterative.LinearSvc().fit(df, XY, "k")
    each = spark.range(4000).selectExpr("double(id % 5) + id * 1e-13 AS a", "double(id % 7) AS b", "CASE WHEN id % 5 + id % 7 > 5 OR id % 35 = 3 THEN 1.0 ELSE 0.0 END AS k")
    plain = iterative.LinearSvc().fit(each, XY, "k")
    assert np.abs(equal.weights - plain.weights).max() < 1e-3
    monkeypatch.setattr(iterative, "START_ROWS", 100)
    started = iterative.LinearSvc().fit(each, XY, "k")
    assert np.abs(started.weights - plain.weights).max() < 1e-3 and np.abs(started.bias - plain.bias).max() < 1e-3
# F6


@pytest.mark.parametrize("way", ["in tasks", "through the index"])
def test_modes_by_whole_cells(spark, monkeypatch, way):
    df, _ = frame(spark, 150)
    read = lambda: [r[1] for r in sorted(cluster.MeanShift(0.3).fit_predict(df, "id", XY).collect())]
    one_cell = read()
    monkeypatch.setattr(spatial, "ONE_CELL", 10)
    monkeypatch.setattr(cluster, "MODE_CELL", 4)
    if way != "in tasks":
        monkeypatch.setattr(cluster, "MODE_NUMBERS", 0)
        monkeypatch.setattr(spatial, "CELL_ROWS", 4)
    assert read() == one_cell
# F7


def test_spectral_clusters_of_many_rows(spark, monkeypatch):
    x = np.random.default_rng(3).normal(0, 0.05, (60, 2)) + np.repeat([[0, 0], [1, 0], [0, 1]], 20, axis=0)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(np.vstack([x, x[::3]]))], "id long, a double, b double")
    read = lambda: [r[1] for r in sorted(cluster.SpectralClustering(3, gamma=10.0).fit_predict(df, "id", XY).collect())]
    dense = read()
    monkeypatch.setattr(cluster, "SPECTRAL_DENSE", 10)
    assert read() == dense and len(set(dense)) == 3
# F3


@pytest.mark.parametrize("linkage", ["ward", "single", "complete", "average"])
def test_linkage_without_a_matrix(spark, monkeypatch, linkage):
    df, _ = frame(spark, 120)
    read = lambda k: [r[1] for r in sorted(cluster.AgglomerativeClustering(k, linkage).fit_predict(df, "id", XY).collect())]
    dense = {k: read(k) for k in (1, 3, 9)}
    monkeypatch.setattr(cluster, "LINKAGE_DENSE", 10)
    assert {k: read(k) for k in dense} == dense
# F4


def test_density_tree_of_many_rows(spark):
    df = spark.range(5200).selectExpr("id", "double(id % 4) * 10 + sin(id * 12.9898) AS a", "cos(id * 78.233) AS b")
    got = df.join(cluster.Hdbscan(5).fit_predict(df, "id", XY), "id")
    assert got.count() == 5200 and got.filter("cluster >= 0").groupBy("cluster").agg(F.count_distinct(F.expr("id % 4")).alias("n")).agg(F.max("n")).first()[0] == 1
# F5


def test_ordering_of_many_rows(spark):
    df = spark.range(5200).selectExpr("id", "double(id % 4) * 10 + sin(id * 12.9898) AS a", "cos(id * 78.233) AS b")
    got = cluster.Optics(4, eps=3.0).fit_predict(df, "id", XY).join(df, "id").selectExpr("`order`", "cluster", "id % 4 AS part").collect()
    assert sorted(r["order"] for r in got) == list(range(5200)) and len({(r["cluster"], r["part"]) for r in got}) == 4
# F15


def test_neighbour_embedding_of_many_rows(spark, monkeypatch):
    df, _ = frame(spark, 60)
    read = lambda: np.array(kernels.TSne(n_iter=4).fit_transform(df, "id", XY).orderBy("id").select("e_0", "e_1").collect())
    dense = read()
    monkeypatch.setattr(kernels, "DENSE", 10)
    assert np.abs(read() - dense).max() < 1e-6 * np.abs(dense).max()
# F13


def test_shortest_ways_of_many_rows(spark, monkeypatch):
    df, _ = frame(spark, 60, copies=1)
    read = lambda: np.array(kernels.Isomap().fit_transform(df, "id", XY).orderBy("id").select("e_0", "e_1").collect())
    dense = read()
    monkeypatch.setattr(kernels, "DENSE", 10)
    assert np.abs(read() - dense).max() < 1e-6
