"""Leaf-wise boosting: missing values, categories and column shares, against searches of all splits."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstat import core
from quillstat.core import EmptyInput
from quillstat.operators import trees


def stump(df, features, **more):
    return trees.LgbmRegressor(1, rate=1.0, max_leaves=2, min_leaf=1, **more).fit(df, features, "y", "id")


def squares(y, side):
    return sum(((y[s] - y[s].mean()) ** 2).sum() for s in (side, ~side))


def table(spark, *columns):
    names = ["a", "b"][: len(columns) - 1]
    rows = [(i, *[None if v != v else float(v) for v in r]) for i, r in enumerate(zip(*columns, strict=True))]
    return spark.createDataFrame(rows, f"id long, {''.join(n + ' double, ' for n in names)}y double").repartition(5)


@pytest.mark.parametrize("level", [-4.0, 4.0, 40.0])
def test_missing_values_take_the_better_side(spark, level):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, 120).astype(float)
    y = np.where(x < 5, -4.0, 4.0) + rng.normal(size=120)
    x[:30], y[:30] = np.nan, level + rng.normal(size=30)
    model = stump(table(spark, x, y), ["a"])
    got = model.predict_array(x[:, None])
    best = min(squares(y, side) for c in [*np.arange(11) + 0.5, np.inf] for side in ((x <= c), (x <= c) | np.isnan(x)) if 0 < side.sum() < 120)
    assert np.isclose(((y - got) ** 2).sum(), best)
    assert np.array_equal(core.Model.from_json(model.to_json()).predict_array(x[:, None]), got)


def test_missing_stays_right_where_not_learned(spark):
    x = np.array([1.0, 2.0, 3.0, 4.0, np.nan])
    y = np.array([0.0, 0.0, 9.0, 9.0, 0.0])
    got = stump(table(spark, x, y), ["a"], missing=False).predict_array(x[:, None])
    assert np.allclose(got, [0, 0, 6, 6, 6])
    got = stump(table(spark, x, y), ["a"]).predict_array(x[:, None])
    assert np.allclose(got, [0, 0, 9, 9, 0])


def test_categories_split_by_the_best_subset(spark):
    rng = np.random.default_rng(2)
    c = rng.integers(0, 7, 200).astype(float)
    y = np.array([3.0, -1.0, 5.0, 0.0, -2.0, 4.0, 1.0])[c.astype(int)] + rng.normal(size=200)
    c[:20] = np.nan
    model = stump(table(spark, c, y), ["a"], categorical=["a"])
    got = model.predict_array(c[:, None])
    subsets = [set(s) for n in range(8) for s in combinations(range(7), n)]
    sides = [np.isin(c, list(s)) | (np.isnan(c) & left) for s in subsets for left in (False, True)]
    assert np.isclose(((y - got) ** 2).sum(), min(squares(y, s) for s in sides if 0 < s.sum() < 200))
    # a value that was not seen goes right
    tree = model.rounds[0][0]
    assert tree.leaf(np.array([[99.0]]))[0] == tree.right[0]
    assert np.array_equal(core.Model.from_bytes(model.to_bytes()).predict_array(c[:, None]), got)


def test_more_leaves_and_mixed_features(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=400), rng.integers(0, 9, 400).astype(float)
    y = a + np.where(np.isin(b, [1, 4, 8]), 10.0, 0.0)
    a[::7] = np.nan
    df = table(spark, a, b, y)
    model = trees.LgbmRegressor(25, rate=0.3, max_leaves=8, min_leaf=5, categorical=["b"]).fit(df, ["a", "b"], "y", "id")
    seen = np.column_stack([a, b])
    assert 1 - ((y - model.predict_array(seen)) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.97
    few = trees.LgbmRegressor(6, max_leaves=4, min_leaf=5, max_features=1).fit(df, ["a", "b"], "y", "id")
    assert all(len(t.gain) <= 1 for r in few.rounds for t in r)
    heavy = trees.LgbmRegressor(1, max_leaves=31, min_leaf=1, min_hessian=150.0).fit(df, ["a", "b"], "y", "id")
    assert sum(f < 0 for f in heavy.rounds[0][0].feature) <= 2


def test_what_is_refused(spark):
    df = table(spark, np.arange(30.0), np.arange(30.0))
    for bad in ({"categorical": ["nope"]}, {"categorical": ["a"], "monotone": [1]}, {"categorical": ["a"], "max_bins": 8}):
        with pytest.raises(core.InvalidParameter):
            stump(df, ["a"], **bad)
    assert stump(table(spark, np.full(9, np.nan), np.arange(9.0)), ["a"]).predict_array(np.array([[1.0]]))[0] == 4.0


def test_options_of_leafwise_boosting(spark):
    rng = np.random.default_rng(11)
    x, base = rng.integers(0, 12, 400) / 2.0, rng.normal(0, 1, 400)
    y = np.where(x > 3, 4.0, 0.0) + base + rng.normal(0, 0.1, 400)
    df = spark.createDataFrame([(int(i), float(a), float(b), float(t), 1.0 + i % 2) for i, (a, b, t) in enumerate(zip(x, base, y, strict=True))], "id long, x double, base double, y double, w double").repartition(3)
    make = lambda **k: trees.LgbmRegressor(**{"n_rounds": 1, "rate": 1.0, "max_leaves": 2, "min_leaf": 1} | k)
    # Scores to start from: the tree fits what is left of them.
    m = make().fit(df, ["x"], "y", "id", init_score="base")
    rest, left = y - base, x <= 3
    assert m.init == [0.0] and np.allclose(m.raw(x[:, None])[:, 0], np.where(left, rest[left].mean(), rest[~left].mean()))
    # What a split must gain: the best one gains the fall of the squared error.
    r = y - y.mean()
    gain = max(r[x <= c].sum() ** 2 / (x <= c).sum() + r[x > c].sum() ** 2 / (x > c).sum() for c in np.unique(x)[:-1])
    assert len(make(min_gain=gain * 1.01).fit(df, ["x"], "y", "id").rounds[0][0].feature) == 1
    assert len(make(min_gain=gain * 0.99).fit(df, ["x"], "y", "id").rounds[0][0].feature) == 3
    # Bins of few rows take their neighbours in.
    v, n = np.unique(x, return_counts=True)
    for least in (1, 50, 150):
        (edges,) = trees.bin_edges(df, ["x"], 255, least)
        held = np.histogram(x, np.concatenate(([-1], edges, [99])))[0]
        assert held.min() >= least and (least > 1 or len(edges) == len(v) - 1)
    # Weights of the held-out rows: the error stops where they say.
    valid = df.withColumn("y", F.when(F.col("w") > 1, F.col("y")).otherwise(F.lit(1e3)))
    free = make(n_rounds=6, early_stopping=1).fit(df, ["x"], "y", "id", valid=valid.withColumn("w", F.when(F.col("w") > 1, 1.0).otherwise(0.0)), valid_weight="w")
    same = make(n_rounds=6, early_stopping=1).fit(df, ["x"], "y", "id", valid=valid.filter("w > 1"))
    assert len(free.rounds) == len(same.rounds) and np.allclose(free.raw(x[:, None]), same.raw(x[:, None]))


def test_bins_of_many_values_and_of_none(spark):
    df = spark.range(5000).select((F.col("id") % 7).cast("double").alias("few"), F.col("id").cast("double").alias("many"), F.lit(None).cast("double").alias("none"), F.lit(-0.0).alias("one"))
    few, many, none, one = trees.bin_edges(df.repartition(6), ["few", "many", "none", "one"], 32)
    assert few.tolist() == [k + 0.5 for k in range(6)] and 25 <= len(many) <= 32 and not len(none) and not len(one)
    with pytest.raises(EmptyInput):
        trees.bin_edges(df.limit(0), ["few"], 32)
