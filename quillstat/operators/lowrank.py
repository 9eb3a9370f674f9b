"""Kernels on any number of rows: pivots whose kernel values span those of all rows, and passes over what the rows are in them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import EmptyInput, InvalidParameter, Model, require, vector
from . import passes

#: What pivots may leave of any row's k(x, x), relative to the largest: no entry of the kernel matrix is farther off than that.
TOL = 1e-12
#: Distinct rows that are kept on the driver instead of being read from executors in each pass.
HOLD = 1 << 13
#: Rows that compete for the next pivots.
POOL = 2048


def fits(df: DataFrame, cap: int, kernel=None) -> bool:
    """Whether a fit takes the dense way: few rows, or a white kernel, which is of full rank."""
    return (kernel is not None and kernel.has("white")) or df.limit(cap + 1).count() <= cap


@dataclass
class Factor(Model):
    """phi(x) with phi(x) phi(z)' = k(x, z) for all fitted rows, within TOL: the rows' part of a pivoted Cholesky factor."""

    kernel: Model
    pivots: np.ndarray
    back: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x, self.pivots) @ self.back.T

    def rest(self, x: np.ndarray) -> np.ndarray:
        """What the pivots leave of k(x, x)."""
        f = self(x)
        return self.kernel.diagonal(x) - (f * f).sum(1)

    def dual(self, w: np.ndarray) -> np.ndarray:
        """Coefficients of k(x, pivots) that say the same as weights of phi."""
        return w @ self.back


def _extended(kernel, pivots: np.ndarray, chol: np.ndarray, rows: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(pivots, Cholesky factor) with more of them out of some rows, the one with most left first, until none has more than ``limit``."""
    f = np.linalg.solve(chol, kernel(pivots, rows)).T if len(pivots) else np.zeros((len(rows), 0))
    left, new, picked = kernel.diagonal(rows) - (f * f).sum(1), np.zeros((len(rows), len(rows))), []
    for j in range(len(rows)):
        i = int(left.argmax())
        if left[i] <= limit:
            break
        column = kernel(rows, rows[i : i + 1].copy())[:, 0] - f @ f[i] - new[:, :j] @ new[i, :j]
        new[:, j] = column / np.sqrt(left[i])
        left = left - new[:, j] ** 2
        picked.append(i)
        left[picked] = -np.inf
    k, m = len(pivots), len(picked)
    out = np.zeros((k + m, k + m))
    out[:k, :k], out[k:, :k], out[k:, k:] = chol, f[picked], np.tril(new[picked][:, :m])
    return np.vstack([pivots, rows[picked]]), out


class Rows:
    """Distinct (x, y) with the weight of each, and their phi: what fits on kernels read in passes.

    Rows with a missing number or label are left out. Equal rows are one with the sum of their weights, so copies cost nothing. Pivots are
    chosen from rows by a hash first, then from those of which most is left in a pass over all, until TOL holds for every row.
    """

    def __init__(self, df: DataFrame, features: list[str], kernel, label: str | None = None, weight: str | None = None):
        require(df, [*features, *(c for c in (label, weight) if c)])
        if kernel.has("white"):
            raise InvalidParameter("a white kernel has no pivots: at most the rows of the dense fit")
        y, w = F.col(f"`{label}`") if label else F.lit(0.0), F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
        rows = df.select(vector(features).alias("x"), y.alias("y"), w.alias("w"))
        rows = rows.filter(~F.exists("x", lambda v: v.isNull() | F.isnan(v)) & F.col("y").isNotNull() & F.col("w").isNotNull())
        rows = rows.groupBy("x", "y").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
        self.d_in, self.held, self.made = len(features), None, None
        self.distinct, self.n = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not self.distinct:
            rows.unpersist()
            raise EmptyInput("no rows")
        if self.distinct <= HOLD:
            got = rows.select("x", "y", "w").orderBy("x", "y").toArrow().combine_chunks().to_batches()
            self.held = [np.concatenate(v) for v in zip(*(_numbers(b, self.d_in) for b in got), strict=True)]
            rows.unpersist()
            self.rows = rows
        else:
            self.rows = rows.select("x", "y", "w").repartition(int(min(4096, -(-self.distinct // 4096))), "x", "y").persist(StorageLevel.MEMORY_AND_DISK)
            self.rows.count()
            rows.unpersist()
        self.factor, self.kernel = None, kernel
        self._choose()
        self.d, self.longest = len(self.factor.pivots), 0

    def __enter__(self) -> Rows:
        return self

    def __exit__(self, *_) -> None:
        self.rows.unpersist()

    def _choose(self) -> None:
        kernel, d = self.kernel, self.d_in
        if self.held:
            x = np.unique(self.held[0], axis=0)
            first, most = x[np.random.default_rng(0).permutation(len(x))[:POOL]], float(kernel.diagonal(x).max())
        else:
            got = self.rows.select("x", F.xxhash64("x").alias("h")).distinct().orderBy("h", "x").limit(POOL).toArrow().column("x").combine_chunks()
            first = got.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)

            def largest(batches):
                for b in batches:
                    if b.num_rows:
                        yield pa.RecordBatch.from_arrays([pa.array([float(kernel.diagonal(passes.arrays(b, d)[0]).max())])], ["m"])

            most = self.rows.select("x", "y").mapInArrow(largest, "m double").agg(F.max("m")).first()[0]
        pivots, chol = _extended(kernel, np.zeros((0, d)), np.zeros((0, 0)), first, TOL * most)
        while True:
            self.factor = Factor(kernel, pivots, np.linalg.solve(chol, np.eye(len(chol))))
            more = self._poorest(x if self.held else None, TOL * most, most)
            if not len(more):
                return
            before = len(pivots)
            pivots, chol = _extended(kernel, pivots, chol, more, TOL * most)
            if len(pivots) == before:  # what is left is rounding
                return

    def _poorest(self, x: np.ndarray | None, limit: float, most: float) -> np.ndarray:
        """Rows of which more than ``limit`` is left, those with most first, at most POOL."""
        factor, d = self.factor, self.d_in

        def poor(x):
            left = factor.rest(x)
            if left.min(initial=0) < -1e-6 * most:
                raise InvalidParameter("the kernel is not positive semidefinite")
            at = np.flatnonzero(left > limit)
            at = at[np.argsort(-left[at], kind="stable")[:POOL]]
            return left[at], x[at]

        if x is not None:
            parts = [poor(x[a : a + passes.STEP]) for a in range(0, len(x), passes.STEP)]
            left, rows = (np.concatenate(v) for v in zip(*parts, strict=True))
            return rows[np.argsort(-left, kind="stable")[:POOL]]

        def part(batches):
            for b in batches:
                left, rows = poor(passes.arrays(b, d)[0])
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(list(rows), pa.list_(pa.float64()))], ["left", "x"])

        found = self.rows.select("x", "y").mapInArrow(part, "left double, x array<double>").orderBy(F.desc("left"), "x").limit(POOL).toArrow()
        return found.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)

    def labels(self, most: int = 10_000) -> list:
        got = sorted(set(self.held[1].tolist())) if self.held else [r[0] for r in self.rows.select("y").distinct().limit(most + 1).collect()]
        if len(got) > most:
            raise InvalidParameter(f"more than {most} classes")
        return sorted(got)

    def weighted_sums(self, compute: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all distinct rows of what ``compute(phi, y, weights)`` gives for some of them: one pass."""
        return self.sums_of(lambda x, f, y, w: compute(f, y, w))

    def sums_of(self, compute: Callable) -> np.ndarray:
        """As weighted_sums(), of ``compute(x, phi, y, weights)``."""
        return np.sum(self.parts_of(compute), axis=0)

    def parts_of(self, compute: Callable, fold: Callable | None = None) -> list[np.ndarray]:
        """What ``compute(x, phi, y, weights)`` gives for pieces of the rows, folded by ``fold`` (their sum) in each task."""
        factor, fold = self.factor, fold or (lambda a, b: a + b)
        step = max(64, min(passes.STEP, (1 << 21) // max(1, len(factor.pivots))))

        def folded(total, x, y, w, made=None):
            for a in range(0, len(x), step):
                v = compute(x[a : a + step], factor(x[a : a + step]) if made is None else made[a : a + step], y[a : a + step], w[a : a + step])
                total = v if total is None else fold(total, v)
            return total

        if self.held:
            if self.made is None and len(self.held[0]) * len(factor.pivots) <= 1 << 22:
                self.made = factor(self.held[0])
            return [np.asarray(folded(None, *self.held, self.made), float)]
        d = self.d_in

        def part(batches):
            total = None
            for b in batches:
                total = folded(total, *_numbers(b, d))
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(total, float).ravel()], pa.list_(pa.float64()))], ["m"])

        return [np.array(r[0]) for r in self.rows.mapInArrow(part, "m array<double>").collect()]


def _numbers(b: pa.RecordBatch, d: int):
    return *passes.arrays(b, d), b.column("w").to_numpy(zero_copy_only=False).astype(float)


def ridge(rows: Rows, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(weights of phi, triangle R with R'R = phi'W phi + alpha): least of sum w (y - phi v)^2 + alpha v^2, by orthogonal steps.

    Tasks keep the triangle of their rows, triangles are stacked: no squared condition numbers, so small alphas lose no digits.
    """
    d = rows.d

    def triangle(x, f, y, w):
        s = np.sqrt(w)[:, None]
        return _square(np.linalg.qr(np.column_stack([f, y.astype(float)]) * s, mode="r"), d + 1).ravel()

    join = lambda a, b: _square(np.linalg.qr(np.vstack([a.reshape(-1, d + 1), b.reshape(-1, d + 1)]), mode="r"), d + 1).ravel()
    parts = [p.reshape(d + 1, d + 1) for p in rows.parts_of(triangle, join)]
    r = np.linalg.qr(np.vstack([*parts, np.column_stack([np.sqrt(alpha) * np.eye(d), np.zeros(d)])]), mode="r")
    return np.linalg.solve(r[:d, :d], r[:d, d]), r[:d, :d]


def _square(r: np.ndarray, n: int) -> np.ndarray:
    return np.vstack([r, np.zeros((n - len(r), n))]) if len(r) < n else r
