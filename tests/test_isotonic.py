"""Isotonic regression by passes and as a table against pooling in one piece."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstat.core import EmptyInput
from quillstat.operators import isotonic


def minmax(y, w):
    """The fit by its max-min formula."""
    n, s, c = len(y), np.concatenate(([0], np.cumsum(w * y))), np.concatenate(([0], np.cumsum(w)))
    mean = np.array([[(s[k + 1] - s[i]) / (c[k + 1] - c[i]) if k >= i else np.inf for k in range(n)] for i in range(n)])
    return np.array([max(mean[i, k:].min() for i in range(k + 1)) for k in range(n)])


def test_pooling_equals_the_formula():
    rng = np.random.default_rng(0)
    y, w = rng.normal(size=60), rng.integers(1, 5, 60).astype(float)
    assert np.allclose(isotonic.pava(y, w), minmax(y, w))


SHAPES = {
    "noise": lambda x, rng: rng.normal(size=len(x)),
    "rising": lambda x, rng: x + rng.normal(size=len(x)) * 20,
    "falling": lambda x, rng: -x,
    "steep": lambda x, rng: np.exp(x / 40) + rng.normal(size=len(x)),
    "steps": lambda x, rng: np.floor(x / 100),
    "far": lambda x, rng: 1e9 + x + rng.normal(size=len(x)) * 50,
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
@pytest.mark.parametrize("increasing", [True, False])
def test_passes_equal_one_piece(spark, shape, increasing):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 900, 2000).astype(float)
    y = SHAPES[shape](x, rng)
    df = spark.createDataFrame([*zip(range(2000), x.tolist(), y.tolist(), strict=True), (-1, None, 5.0), (-2, 3.0, None)], "id long, x double, y double").repartition(3)
    whole = isotonic.IsotonicRegressor(increasing).fit(df, "x", "y")
    parts = isotonic.IsotonicRegressor(increasing, cap=40).fit(df, "x", "y")
    assert isinstance(whole, isotonic.StepModel)
    at = df.unionByName(spark.createDataFrame([(-3, -7.5, 0.0), (-4, 2000.0, 0.0), (-5, 55.25, 0.0)], df.schema))
    a = {r["id"]: r["prediction"] for r in whole.transform(at).collect()}
    b = {r["id"]: r["prediction"] for r in parts.transform(at).collect()}
    assert a.keys() == b.keys() and b[-1] is None
    ids = [i for i in a if i != -1]
    assert np.allclose([a[i] for i in ids], [b[i] for i in ids], rtol=1e-9, atol=1e-9)


def test_many_points_stay_a_table(spark, tmp_path):
    df = spark.range(3000).select("id", (F.col("id") % 1500).cast("double").alias("x"), (F.col("id") % 1500 * 2).cast("double").alias("y"))
    got = isotonic.IsotonicRegressor(cap=100).fit(df, "x", "y")
    assert isinstance(got, isotonic.StepTable)
    got.write(str(tmp_path / "curve"))
    back = isotonic.StepTable.read(spark, str(tmp_path / "curve"), "x")
    out = back.transform(df.withColumn("point", F.lit("a name that clashes")), "fitted")
    assert out.columns == ["id", "x", "y", "point", "fitted"] and out.count() == 3000
    assert out.filter(F.abs(F.col("fitted") - F.col("y")) > 1e-9).isEmpty()


def test_no_rows(spark):
    with pytest.raises(EmptyInput):
        isotonic.IsotonicRegressor().fit(spark.createDataFrame([(None, 1.0)], "x double, y double"), "x", "y")
