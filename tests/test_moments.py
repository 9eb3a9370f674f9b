"""Moments of many columns in one pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstat.core import EmptyInput
from quillstat.operators import moments, preprocessing


def table(spark, n, d, offset=0.0):
    rng = np.random.default_rng(n + d)
    x = rng.normal(0, 1, (n, d)) * np.arange(1, d + 1) + offset
    x[rng.random((n, d)) < 0.1] = np.nan
    return spark.createDataFrame([tuple(map(float, v)) for v in x], ", ".join(f"c{k} double" for k in range(d))), x


@pytest.mark.parametrize("offset", [0.0, 1.6e9])
@pytest.mark.parametrize("gather", [1 << 20, 100])
def test_moments_equal_numpy(spark, monkeypatch, offset, gather):
    monkeypatch.setattr(moments, "GATHER", gather)
    df, x = table(spark, 300, 20, offset)
    df = df.withColumn("none", F.lit(None).cast("double")).repartition(7)
    n, mean, var = moments.moments(df, df.columns)
    assert n[:, 0].tolist() == [*(~np.isnan(x)).sum(0), 0]
    assert np.allclose(mean[:-1, 0], np.nanmean(x, 0), rtol=1e-14) and np.allclose(var[:-1, 0], np.nanvar(x, 0), rtol=1e-5 if offset else 1e-10)
    with pytest.raises(EmptyInput):
        moments.moments(df.limit(0), df.columns)


def test_wide_scaler_equals_the_narrow_one(spark):
    df, _ = table(spark, 200, 20)
    wide = preprocessing.StandardScaler().fit(df, df.columns)
    for k in range(0, 20, 10):
        narrow = preprocessing.StandardScaler().fit(df, df.columns[k : k + 10])
        assert np.allclose(wide.center[k : k + 10], narrow.center) and np.allclose(wide.scale[k : k + 10], narrow.scale)
