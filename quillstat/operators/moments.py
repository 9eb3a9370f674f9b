"""Counts, means and variances of many columns in one pass over Arrow batches, merged pairwise."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..core import EmptyInput, num
from .passes import GATHER, STEP


def _merged(a, b):
    """Chan's merge of (count, mean, centred squares); empty sides change nothing."""
    if a is None:
        return b
    n = a[0] + b[0]
    gap, share = b[1] - a[1], np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    return n, a[1] + gap * share, a[2] + b[2] + gap * gap * a[0] * share


def _batch(state) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v.ravel()], pa.list_(pa.float64())) for v in state], ["n", "mean", "m2"])


def _merge(batches):
    state = None
    for b in batches:
        for row in zip(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("n", "mean", "m2")), strict=True):
            state = _merged(state, tuple(np.asarray(v, float) for v in row))
    if state is not None:
        yield _batch(state)


def moments(df: DataFrame, features: list[str], expand: Callable[[np.ndarray], np.ndarray] | None = None, width: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, mean, population variance) of each feature, shaped (features, width); missing values are left out.

    ``expand`` turns a feature's values into ``width`` columns. Tasks keep sums around their own means and merge them, so
    nothing cancels; what reaches the driver is bounded by merging on executors first where there are many tasks.
    """
    d = len(features)

    def part(batches):
        state, any_rows = None, False
        for b in batches:
            any_rows = any_rows or b.num_rows > 0
            for a in range(0, b.num_rows, STEP):
                n, mean, m2 = np.zeros((d, width)), np.zeros((d, width)), np.zeros((d, width))
                for k in range(d):
                    v = b.column(k).slice(a, STEP).drop_null().to_numpy(zero_copy_only=False)
                    if len(v):
                        z = v[:, None] if expand is None else expand(v)
                        n[k], mean[k] = len(v), z.mean(0)
                        m2[k] = ((z - mean[k]) ** 2).sum(0)
                state = _merged(state, (n, mean, m2))
        if any_rows:
            yield _batch(state)

    schema = "n array<double>, mean array<double>, m2 array<double>"
    parts = df.select(*[num(c).alias(f"f{k}") for k, c in enumerate(features)]).mapInArrow(part, schema)
    tasks = parts.rdd.getNumPartitions()
    while 3 * d * width * tasks > GATHER and tasks > 1:
        tasks = -(-tasks // 16)
        parts = parts.repartition(tasks).mapInArrow(_merge, schema)
    state = None
    for row in parts.collect():
        state = _merged(state, tuple(np.array(v, float) for v in row))
    if state is None:
        raise EmptyInput("no rows")
    n, mean, m2 = (v.reshape(d, width) for v in state)
    return n, mean, np.divide(m2, n, out=np.zeros_like(m2), where=n > 0)
