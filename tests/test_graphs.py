"""Affinity propagation along a graph of nearest rows; inputs from kernel projections."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstat.core import EmptyInput, InvalidParameter, ShapeMismatch
from quillstat.operators import cluster, kernels


def blobs(n, seed=0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.4, (n, 2)) for c in ((0, 0), (6, 1), (2, 7))])
    return [(int(i), float(a), float(b)) for i, (a, b) in enumerate(x)]


def labels(frame):
    return {r["id"]: r["cluster"] for r in frame.collect()}


def test_whole_graph_equals_all_pairs(spark):
    rows = blobs(6)
    df = spark.createDataFrame(rows, "id long, a double, b double").repartition(3)
    make = {"damping": 0.5, "max_iter": 8, "stable": 3, "preference": -15.0}
    dense = labels(cluster.AffinityPropagation(**make).fit_predict(df, "id", ["a", "b"]))
    graph = labels(cluster.AffinityPropagation(**make, n_neighbors=len(rows) - 1).fit_predict(df, "id", ["a", "b"]))
    assert graph == dense and len(set(graph.values())) == 3


def dense_round(e, damping):
    """One round over a dictionary of edges, as it is written in the method."""
    out = {}
    for (i, k), (s, r, _) in e.items():
        other = max((v[0] + v[2] for (p, q), v in e.items() if p == i and q != k), default=0.0)
        out[i, k] = (s, damping * r + (1 - damping) * (s - other))
    new = {}
    for (i, k), (s, r) in out.items():
        gains = sum(max(v[1], 0) for (p, q), v in out.items() if q == k and p not in (i, k))
        a = gains if i == k else min(0.0, out[k, k][1] + gains)
        new[i, k] = (s, r, damping * e[i, k][2] + (1 - damping) * a)
    return new


def test_rounds_along_edges(spark):
    model = cluster.AffinityPropagation(damping=0.5, n_neighbors=2)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate([0, 1, 1, 1, 2, 9, 10])], "id long, a double")
    rows = df.select(F.col("id").alias("q_id"), F.array("a").alias("x"))
    edges = model._messages(rows, df.select(F.col("id").alias("q_id"), F.col("a").alias("x0")), ["x0"])
    want = {(r["i"], r["k"]): (r["s"], r["r"], r["a"]) for r in edges.collect()}
    assert all((k, i) in want for i, k in want) and sum(i == k for i, k in want) == 7
    off = sorted(v[0] for (i, k), v in want.items() if i != k)
    assert want[0, 0][0] == off[len(off) // 2]
    for _ in range(2):
        edges, want = model._round(edges), dense_round(want, 0.5)
    got = {(r["i"], r["k"]): (r["s"], r["r"], r["a"]) for r in edges.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[e], want[e]) for e in got)


def test_graph_edges_of_use(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 0.0), (2, 0.0), (3, 5.0), (None, 1.0), (4, None), (5, float("nan"))], "id long, a double")
    got = labels(cluster.AffinityPropagation(max_iter=1, n_neighbors=1).fit_predict(df, "id", ["a"]))
    assert sorted(got) == [1, 2, 3]
    with pytest.raises(InvalidParameter):
        cluster.AffinityPropagation(n_neighbors=0).fit_predict(df, "id", ["a"])
    with pytest.raises(EmptyInput):
        cluster.AffinityPropagation(n_neighbors=1).fit_predict(df.limit(0), "id", ["a"])


def test_inputs_from_linear_projections(spark):
    df = spark.createDataFrame(blobs(10), "id long, a double, b double")
    m = kernels.KernelPCA(2, kernels.Kernel("linear")).fit(df, ["a", "b"])
    x = np.array([[1.0, 2.0], [-3.0, 0.5], [7.0, 7.0]])
    assert np.allclose(m.inverse(m.project(x)), x)
    with pytest.raises(ShapeMismatch):
        m.inverse(np.zeros((1, 3)))
