"""The neighbour index, joins by nearness and density clusters against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstat.operators import cluster, neighbors, spatial


def points(seed, n, d, kind="blobs"):
    rng = np.random.default_rng(seed)
    if kind == "grid":
        return rng.integers(0, 6, (n, d)).astype(float)
    centre = rng.normal(0, 4, (12, d))
    return centre[rng.integers(0, 12, n)] + rng.normal(0, 0.5, (n, d))


def frame(spark, x, ids=None):
    names = [f"f{k}" for k in range(x.shape[1])]
    rows = [(int(i), *map(float, v)) for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in names)).repartition(5), names


@pytest.fixture(autouse=True)
def small_cells(monkeypatch):
    monkeypatch.setattr(spatial, "ONE_CELL", 60)


def build(df, names, metric="euclidean", **more):
    return spatial.Index(df, "id", names, metric, cell_rows=40, **more)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
@pytest.mark.parametrize("kind", ["blobs", "grid"])
@pytest.mark.parametrize("own", [True, False])
def test_nearest_equals_all_pairs(spark, metric, kind, own):
    x, k = points(1, 900, 3, kind), 4
    df, names = frame(spark, x)
    index = build(df, names, metric, most_equal=k + 1)
    rows = spatial.usable(df, "id", names)
    if metric == "cosine":
        rows = rows.filter(F.exists("x", lambda v: v != 0))
    got = {}
    for r in spatial.search(index, rows, k, exclude_self=own).collect():
        got.setdefault(r["q_id"], []).append((r["rank"], r["t_id"], r["distance"]))
    gap = spatial.gaps(x, x, metric)
    if own:
        np.fill_diagonal(gap, np.inf)
    for i, found in got.items():
        order = np.lexsort((np.arange(len(x)), gap[i]))[:k]
        found.sort()
        if metric == "cosine":  # rounding may order near ties otherwise
            assert np.allclose([f[2] for f in found], gap[i][order], atol=1e-12)
        else:
            assert [f[1] for f in found] == order.tolist() and np.allclose([f[2] for f in found], gap[i][order])
    assert len(got) == (np.abs(x).sum(1) > 0).sum() if metric == "cosine" else len(x)
    if kind == "blobs" and metric != "cosine":
        assert index.compared.value < 0.35 * len(x) ** 2


def test_one_point_with_a_third_of_all_rows(spark):
    x = points(2, 600, 2)
    x[::3] = 1.25
    df, names = frame(spark, x)
    index = build(df, names, most_equal=6)
    got = spatial.search(index, spatial.usable(df, "id", names), 5, exclude_self=True).filter("q_id % 3 = 0").collect()
    want = {i: [j for j in range(0, 600, 3) if j != i][:5] for i in range(0, 600, 3)}
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["q_id"], []).append(r["t_id"])
    assert found == want
    assert index.rows == 400 + 6


def test_queries_far_from_all_and_more_neighbours_than_rows(spark):
    x = points(3, 300, 2)
    df, names = frame(spark, x)
    far, _ = frame(spark, np.array([[1e6, -1e6], [0.0, 0.0], [np.nan, 1.0]]))
    got = neighbors.k_nearest(far, df, "id", names, 400).collect()
    assert sorted({r["q_id"] for r in got}) == [0, 1] and len(got) == 600


def test_cosine_with_zero_rows(spark):
    x = points(4, 200, 2)
    x[[3, 50]] = 0
    df, names = frame(spark, x)
    near = neighbors.k_nearest(df, df, "id", names, 3, "cosine", exclude_self=True).filter("q_id = 3").orderBy("rank").collect()
    assert [(r["t_id"], r["distance"]) for r in near] == [(0, 1.0), (1, 1.0), (2, 1.0)]


@pytest.mark.parametrize("eps", [0.0, 0.4])
def test_eps_join_equals_all_pairs(spark, eps):
    x, y = points(5, 400, 3), points(6, 300, 3)
    y[:20] = x[:20]
    a, names = frame(spark, x)
    b, _ = frame(spark, y)
    got = {(r["a_id"], r["b_id"]) for r in spatial.eps_join(a, b, "id", names, eps).collect()}
    assert got == set(zip(*(v.tolist() for v in np.nonzero(spatial.gaps(x, y, "euclidean") <= eps)), strict=True))
    assert spatial.eps_join(a, b.limit(0), "id", names, eps).collect() == []


def brute_dbscan(x, eps, least):
    near = spatial.gaps(x, x, "euclidean") <= eps
    core, label, c = near.sum(1) >= least, np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            label[i], todo = c, [i]
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & (label < 0)):
                    label[j] = c
                    todo += [j] if core[j] else []
            c += 1
    return label


@pytest.mark.parametrize("n,d,kind,eps,least", [(900, 2, "blobs", 0.25, 5), (500, 3, "blobs", 0.5, 4), (400, 2, "grid", 0.5, 6), (50, 2, "blobs", 0.6, 3)])
def test_dbscan_equals_all_pairs(spark, n, d, kind, eps, least):
    x = points(7, n, d, kind)
    df, names = frame(spark, x)
    got = dict(cluster.Dbscan(eps, least).fit_predict(df, "id", names).collect())
    assert [got[i] for i in range(n)] == brute_dbscan(x, eps, least).tolist()


def test_dbscan_of_a_large_offset_and_of_noise(spark):
    x = points(8, 200, 2) + 1.6e9
    df, names = frame(spark, x)
    got = dict(cluster.Dbscan(0.5, 4).fit_predict(df, "id", names).collect())
    assert [got[i] for i in range(200)] == brute_dbscan(x, 0.5, 4).tolist()
    assert {r["cluster"] for r in cluster.Dbscan(1e-9, 2).fit_predict(df, "id", names).collect()} == {-1}


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(300, 310), (310, 305), (400, 400)]
    nodes = spark.createDataFrame([(i,) for i in [*range(201), 300, 305, 310, 400, 500]], "id long")
    got = dict(spatial.components(spark.createDataFrame(edges, "a long, b long"), nodes).collect())
    assert got == {**dict.fromkeys(range(201), 0), 300: 300, 305: 300, 310: 300, 400: 400, 500: 500}


def brute_mean_shift(x, width):
    m = x.copy()
    for _ in range(300):
        near = (spatial.gaps(m, x, "euclidean") <= width).astype(float)
        new = near @ x / near.sum(1, keepdims=True)
        if np.abs(new - m).max() < 1e-9:
            break
        m = new
    modes = []
    for v in m[np.argsort(-(spatial.gaps(m, x, "euclidean") <= width).sum(1), kind="stable")]:
        if not modes or np.sqrt(((np.array(modes) - v) ** 2).sum(1)).min() >= width / 2:
            modes.append(v)
    return spatial.gaps(x, np.array(modes), "euclidean").argmin(1)


@pytest.mark.parametrize("n", [50, 240])
def test_mean_shift_equals_all_pairs(spark, n):
    x = points(11, n, 2)
    x[1] = x[0]
    df, names = frame(spark, x)
    got = dict(cluster.MeanShift(1.5).fit_predict(df, "id", names).collect())
    assert [got[i] for i in range(n)] == brute_mean_shift(x, 1.5).tolist()
