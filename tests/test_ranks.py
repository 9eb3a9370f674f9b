"""Ranks, splits and curves on skewed orders; starts and distances of clusterings."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstat.operators import cluster, metrics, model_selection, ranks


def test_ranges_stay_even_and_keep_all_rows(spark):
    rng = random.Random(1)
    values = [10**15, None, None, *[5] * 400, *[rng.random() for _ in range(800)]]
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in enumerate(values)], "id long, v double").repartition(5)
    got = ranks.in_ranges(df, [F.col("v")]).collect()
    sizes = Counter(r["__piece"] for r in got)
    assert len(got) == len(values) and max(sizes.values()) <= 2 * len(values) / 8
    placed = ranks.positions(df, [F.col("v"), F.col("id")], "at").orderBy("at").collect()
    assert [r["at"] for r in placed] == list(range(len(values))) and {r["at_n"] for r in placed} == {len(values)}
    assert [r["id"] for r in placed] == [k for _, k in sorted(((v is not None, v or 0.0), k) for k, v in enumerate(values))]


def test_splits_keep_null_and_text_ids(spark):
    rows = [("a", 1, "x"), (None, 2, "x"), ("b", 1, None), ("c", 2, None), ("zz", 1, "y"), (None, 1, "x")]
    df = spark.createDataFrame(rows, "id string, k int, g string")
    splits = [
        model_selection.k_fold(df, "id", 3), model_selection.cv_fold(df, "id", 3), model_selection.leave_one_out(df, "id"), model_selection.stratified_k_fold(df, "id", "g", 2),
        model_selection.train_test_split(df, "id"), model_selection.group_k_fold(df, "g", 2),
    ]
    for s in splits:
        assert Counter((r["id"], r["k"], r["g"]) for r in s.collect()) == Counter(rows)
    folds = {r["id"]: r["fold"] for r in splits[0].filter("id IS NOT NULL").collect()}
    assert folds == {"a": 1, "b": 1, "c": 2, "zz": 2}
    strata = Counter((r["g"], r["fold"]) for r in splits[3].collect())
    assert strata == Counter({("x", 0): 2, ("x", 1): 1, (None, 0): 1, (None, 1): 1, ("y", 0): 1})
    assert {(r["g"], r["fold"]) for r in splits[5].collect()} == {(None, 0), ("x", 1), ("y", 0)}


def test_curve_of_scores_close_to_nothing(spark):
    rng = np.random.default_rng(2)
    s = np.concatenate([rng.random(500) * 1e-9, [1.0]])
    y = (rng.random(501) < 0.3 + 4e8 * s.clip(0, 1e-9)).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y int, s double").repartition(4)
    order = np.argsort(-s)
    tp, fp = np.cumsum(y[order]), np.cumsum(1 - y[order])
    want = np.trapezoid(np.concatenate([[0], tp]) / tp[-1], np.concatenate([[0], fp]) / fp[-1])
    assert abs(metrics.roc_auc_score(df, "y", "s").first()[0] - want) < 1e-12


def test_kmeans_on_few_distinct_rows(spark):
    df = spark.range(20_000).select((F.col("id") % 4).cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("b"))
    m = cluster.KMeans(4, start_rows=100).fit(df, ["a", "b"])
    assert sorted(map(tuple, m.centroids.round(9).tolist())) == [(0, 0), (1, 1), (2, 0), (3, 1)] and m.inertia < 1e-9
    x, w = cluster.hashed_sample(df, ["a", "b"], 100, 0)
    assert sorted(w.tolist()) == [5000.0] * 4 and len(x) == 4
    x, w = cluster.hashed_sample(spark.range(5000).select(F.when(F.col("id") < 2500, 0).otherwise(F.col("id")).cast("double").alias("a")), ["a"], 50, 0)
    assert len(x) == 50 and (x == 0).any() and (w == 1).all()


def test_clusters_at_a_large_offset(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 1, (200, 2)) for c in (0, 20, 60)]) + 1.6e9
    df = spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double").repartition(4)
    truth = np.repeat([0, 1, 2], 200)
    assert cluster.distances(np.array([[1.6e9, 0.0]]), np.array([[1.6e9 + 1, 0.0], [1.6e9 + 20, 0.0]])).tolist() == [[1.0, 20.0]]
    for m in (cluster.KMeans(3, seed=1), cluster.GaussianMixture(3, seed=1)):
        got = m.fit(df, ["a", "b"]).predict_array(x)
        assert len({(t, int(g)) for t, g in zip(truth, got, strict=True)}) == 3


@pytest.mark.parametrize("k", [1, 3])
def test_kmeans_with_weights_equals_repeated_rows(spark, k):
    rng = np.random.default_rng(4)
    x, w = rng.normal(0, 1, (60, 2)) + np.repeat([[0, 0], [9, 0], [0, 9]], 20, 0), rng.integers(1, 4, 60)
    one = spark.createDataFrame([(*map(float, v), int(n)) for v, n in zip(x, w, strict=True)], "a double, b double, n int")
    many = spark.createDataFrame([tuple(map(float, v)) for v in np.repeat(x, w, 0)], "a double, b double")
    a, b = cluster.KMeans(k).fit(one, ["a", "b"], "n"), cluster.KMeans(k).fit(many, ["a", "b"])
    assert np.allclose(sorted(a.centroids.tolist()), sorted(b.centroids.tolist())) and abs(a.inertia - b.inertia) < 1e-6
