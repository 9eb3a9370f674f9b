"""Exact quantiles against the built-in aggregate, with few and many passes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstat.operators import quantiles


@pytest.fixture(scope="module")
def awkward(spark):
    rng = np.random.default_rng(3)
    wide = np.concatenate([rng.normal(size=700) * 10.0 ** rng.integers(-300, 300, 700), [0.0, -0.0, math.inf, -math.inf, 5e-324], np.full(900, 7.25)])
    few = [None if i % 3 else float(i % 5) for i in range(len(wide))]
    return spark.createDataFrame([(float(a), b, i - 800, None) for i, (a, b) in enumerate(zip(wide, few, strict=True))], "wide double, few double, whole long, none double")


@pytest.mark.parametrize(("cells", "gather"), [(1 << 18, 1 << 17), (1 << 18, 0), (64, 0), (1, 40)])
def test_equal_to_the_aggregate(awkward, monkeypatch, cells, gather):
    monkeypatch.setattr(quantiles, "CELLS", cells)
    monkeypatch.setattr(quantiles, "GATHER", gather)
    shares = [0.0, 0.003, 0.25, 1 / 3, 0.5, 0.75, 0.99, 1.0]
    names = ["wide", "few", "none", "whole"]
    got = quantiles.exact_quantiles(awkward.repartition(9), [F.col(c) for c in names], shares)
    want = awkward.agg(*[F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in names]).first()
    for c, q in zip(names, got, strict=True):
        assert q == want[c]


def test_no_rows_and_nan(spark):
    empty = spark.createDataFrame([], "x double")
    assert quantiles.exact_quantiles(empty, [F.col("x")], [0.5]) == [None]
    assert quantiles.exact_quantiles(empty, [], [0.5]) == []
    some = spark.createDataFrame([(1.0,), (math.nan,), (2.0,)], "x double")
    low, top = quantiles.exact_quantiles(some, [F.col("x")], [0.5, 1.0])[0]
    assert low == 2.0 and math.isnan(top)
