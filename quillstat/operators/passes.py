"""Loops of passes over a table: sums made in every task and added up on executors, a small state on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import EmptyInput, InvalidParameter, require, summed, vector

#: Rows that one task turns into numbers at once.
STEP = 1 << 14
#: Different rows that are kept on the driver.
HOLD = 1 << 13


class Table:
    """Rows (x, y) that many passes read: kept on executors, made again from the source where an executor is lost.

    Rows with a missing number are left out. ``close`` gives the memory back; as a context manager it is called at the end. With ``equal``
    rows that are equal in x and y are kept once with their number ``w``, where that leaves a quarter of them or less; up to HOLD such
    rows stay on the driver.
    """

    def __init__(self, df: DataFrame, features: list[str], label: str | None = None, *more: str, equal: bool = False):
        require(df, [*features, *([label] if label else []), *more])
        self.d = len(features)
        y = F.col(f"`{label}`") if label else F.lit(0.0)
        rows = df.select(vector(features).alias("x"), y.alias("y"), *[F.col(f"`{c}`") for c in more])
        rows, self.weighed, self.held = rows.filter(~F.exists("x", lambda v: v.isNull() | F.isnan(v)) & F.col("y").isNotNull()), False, None
        if equal:
            self.n, different = rows.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64("x", "y"))).first()
            self.weighed = 4 * different <= self.n
            if self.weighed:
                rows = rows.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))
        self.rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        kept = self.rows.count()
        self.n = self.n if equal else kept
        if self.weighed and kept and kept <= HOLD:
            got = [(*arrays(b, self.d), b.column("w").to_numpy()) for b in self.rows.orderBy("x", "y").toArrow().to_batches() if b.num_rows]
            self.held = [np.concatenate(v) for v in zip(*got, strict=True)]
        self.parts, self.longest = self.rows.rdd.getNumPartitions(), 0
        if not self.n:
            self.close()
            raise EmptyInput("no rows")

    def __enter__(self) -> Table:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.rows.unpersist()

    def labels(self, most: int = 10_000) -> list:
        """The distinct labels in order; they are classes, so there are few."""
        got = [r[0] for r in self.rows.select("y").distinct().limit(most + 1).collect()]
        if len(got) > most:
            raise InvalidParameter(f"more than {most} classes")
        return sorted(got)

    def drawn(self, most: int) -> Held:
        """At most ``most`` kept rows, the first by a hash of their values."""
        rows = self.rows if self.weighed else self.rows.withColumn("w", F.lit(1.0))
        got = rows.select("x", "y", "w", F.xxhash64("x", "y").alias("h")).orderBy("h", "x", "y").limit(most).toArrow().combine_chunks().to_batches()[0]
        return Held(*arrays(got, self.d), got.column("w").to_numpy())

    def sums(self, compute: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all rows of the vector that ``compute(x, y)`` gives for some of them: one pass."""
        return self._sums(lambda x, y, w: compute(x, y), False)

    def weighted_sums(self, compute: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all kept rows of the vector that ``compute(x, y, weights)`` gives for some of them: one pass."""
        return self._sums(compute, self.weighed)

    def _sums(self, compute: Callable, weighed: bool) -> np.ndarray:
        d = self.d

        def added(total, x, y, w):
            for a in range(0, len(x), STEP):
                v = compute(x[a : a + STEP], y[a : a + STEP], w[a : a + STEP])
                total = v if total is None else total + v
            return total

        if self.held and weighed:
            return np.asarray(added(None, *self.held), float).ravel()

        def part(batches):
            total = None
            for b in batches:
                x, y = arrays(b, d)
                total = added(total, x, y, b.column("w").to_numpy() if weighed else np.ones(len(x)))
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(total, float).ravel()], pa.list_(pa.float64()))], ["m"])

        got = total(self.rows.select("x", "y", *(["w"] if weighed else [])).mapInArrow(part, "m array<double>"), self.parts * self.longest if self.longest else None)
        self.longest = max(self.longest, len(got))
        return got


class Held:
    """Some rows of a table on the driver, with weights."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray):
        self.x, self.y, self.w, self.n, self.d = x, y, w, float(w.sum()), x.shape[1]

    def weighted_sums(self, compute: Callable) -> np.ndarray:
        return np.sum([compute(self.x[a : a + STEP], self.y[a : a + STEP], self.w[a : a + STEP]) for a in range(0, len(self.x), STEP)], axis=0)


#: Numbers that tasks may send to the driver to be added up there; more are added up on executors.
GATHER = 1 << 20


def total(parts: DataFrame, numbers: int | None) -> np.ndarray:
    """The sum of the arrays in column m; ``numbers`` is how many there are in all, if that is known."""
    if numbers is None or numbers > GATHER:
        return summed(parts)
    return np.sum([np.array(r[0]) for r in parts.collect()], axis=0)


def arrays(b: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of a batch, without an object for each row."""
    x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
    return x, b.column("y").to_numpy(zero_copy_only=False)


def lbfgs(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, max_iter: int, tol: float, memory: int = 10) -> tuple[np.ndarray, float, int]:
    """Limited-memory quasi-Newton descent: (point, value, rounds). Each value and gradient is one pass.

    Steps are halved until the value falls enough (Armijo) and doubled while the slope says they are too short; it stops when the
    value falls by less than ``tol``, relatively, or no step makes it fall.
    """
    x, (f, g), pairs = start.astype(float), objective(start), []
    rounds = 0
    for rounds in range(1, max_iter + 1):
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            alphas.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        step, slope = 1.0 if pairs else min(1.0, 1 / max(np.abs(g).sum(), 1e-300)), -(g @ q)
        if slope >= 0:
            q, slope, pairs = g.copy(), -(g @ g), []
        found = None
        for _ in range(30):
            new = x - step * q
            fn, gn = objective(new)
            if np.isfinite(fn) and fn <= f + 1e-4 * step * slope:
                found = new, fn, gn
                if -(gn @ q) < 0.9 * slope and step < 64 and not pairs:
                    step *= 2
                    continue
                break
            if found:
                break
            step /= 2
        if not found:
            break
        new, fn, gn = found
        s, y = new - x, gn - g
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            pairs = [*pairs, (s, y)][-memory:]
        done = f - fn <= tol * max(abs(f), abs(fn), 1.0)
        x, f, g = new, fn, gn
        if done:
            break
    return x, f, rounds


def _ramp(u: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """max(0, u) rounded off within ``width`` of 0: value, slope, curvature. It is at most width / 4 off."""
    inner = np.clip((u + width) / (2 * width), 0, 1)
    value = np.where(u >= width, u, np.where(u <= -width, 0.0, (u + width) ** 2 / (4 * width)))
    return value, inner, np.where(np.abs(u) < width, 1 / (2 * width), 0.0)


def newton_ramps(table, ramps: Callable, models: int, weight: float, penalty: np.ndarray, widths=(1.0, 0.3, 0.1, 0.03, 0.01, 0.003, 0.001), max_iter: int = 30, tol: float = 1e-6, start: np.ndarray | None = None, linear: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Least of penalty * w^2 / 2 + linear * w + weight * sum of max(0, u): (weights with the bias last, values), for several models at once.

    ``ramps(y)`` lists, for every model, the pairs (sign, offset) of its terms u = sign * z + offset at z = w x + bias.
    Kinks are rounded off, by less and less; at each width Newton steps sum gradient and curvature in one pass, and are damped where
    the value rises.
    """
    p = table.d + 1
    w, value = np.zeros((models, p)) if start is None else start.astype(float), np.full(models, np.inf)

    def measure(at: np.ndarray, width: float):
        def compute(x, y, of):
            z1, out = np.column_stack([x, np.ones(len(x))]), []
            for k, terms in enumerate(ramps(y)):
                z = z1 @ at[k]
                loss, g, h = 0.0, np.zeros(len(x)), np.zeros(len(x))
                for sign, offset in terms:
                    v, s, c = _ramp(sign * z + offset, width)
                    loss, g, h = loss + v @ of, g + s * sign * of, h + c * of
                out += [[loss], z1.T @ g, ((z1 * h[:, None]).T @ z1).ravel()]
            return np.concatenate(out)

        m = table.weighted_sums(compute).reshape(models, -1) * weight
        loss = m[:, 0] + (0.5 * penalty * at * at + linear * at).sum(1)
        return loss, m[:, 1 : 1 + p] + penalty * at + linear, m[:, 1 + p :].reshape(models, p, p) + np.diag(penalty + 1e-10)

    # Where a step makes the value rise, curvature is added until it falls: rows on one side of all kinks say nothing of a free bias.
    damp, most = np.zeros(models), max(table.n * weight, 1e-12)
    for width in widths:
        value, g, h = measure(w, width)
        scale = most / (2 * width)
        for _ in range(max_iter):
            new, open_, f = w.copy(), np.ones(models, bool), value
            for _ in range(20):
                for k in np.flatnonzero(open_):
                    new[k] = w[k] - np.linalg.lstsq(h[k] + damp[k] * scale * np.eye(p), g[k], rcond=None)[0]
                f, gn, hn = measure(new, width)
                open_ = open_ & ~(f <= value + 1e-12 * np.abs(value))
                if not open_.any():
                    break
                damp[open_] = np.maximum(damp[open_] * 8, 1e-6)
            else:
                new[open_] = w[open_]
                f, gn, hn = measure(new, width)
            damp = np.where(damp > 1e-6, damp / 8, 0.0)
            done = (value - f <= tol * np.maximum(np.abs(f), 1e-12)).all() and not damp.any()
            w, value, g, h = new, f, gn, hn
            if done:
                break
    return w, value


#: Rows of a block that one task walks by itself in an epoch of averaged descent.
BLOCK_ROWS = 1 << 16


def averaged_descent(table: Table, walk: Callable, start: np.ndarray, epochs: int, done: Callable[[float], bool]) -> np.ndarray:
    """Stochastic descent in blocks: an epoch walks every block of about BLOCK_ROWS rows from the shared weights and averages.

    Rows are dealt to blocks and ordered inside them by a hash of their values, so results don't depend on how the
    table is partitioned; rows that are all equal share a block. ``walk(x, y, weights, epoch, seen)`` walks the next rows of a block, of which it
    has ``seen`` some, and gives new weights and the sum of their losses.
    """
    blocks, d = max(1, -(-table.n // BLOCK_ROWS)), table.d
    h = F.xxhash64("x", "y")
    dealt = table.rows.select("x", "y", F.pmod(h, F.lit(blocks)).cast("int").alias("block"), F.xxhash64("x", "y", F.lit(1)).alias("spot"))
    dealt = dealt.repartition(min(blocks, 4096), "block").sortWithinPartitions("block", "spot").persist(StorageLevel.MEMORY_AND_DISK)
    w = start.astype(float)
    try:
        for epoch in range(epochs):

            def part(batches, w=w, epoch=epoch):
                block, held, total = None, None, np.zeros(w.size + 2)

                def close():
                    new, loss = held
                    total[:-2] += new.ravel() * count
                    total[-2:] += loss, count

                for b in batches:
                    x, y = arrays(b, d)
                    at = b.column("block").to_numpy()
                    edges = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)])) if len(at) else [0]
                    for a, z in zip(edges[:-1], edges[1:], strict=True):
                        if at[a] != block:
                            if block is not None:
                                close()
                            block, held, count = at[a], (w.copy(), 0.0), 0
                        new, loss = walk(x[a:z], y[a:z], held[0], epoch, count)
                        held, count = (new, held[1] + loss), count + int(z - a)
                if block is not None:
                    close()
                    yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["m"])

            m = summed(dealt.select("x", "y", "block").mapInArrow(part, "m array<double>"))
            w = (m[:-2] / m[-1]).reshape(start.shape)
            if done(m[-2] / m[-1]):
                break
    finally:
        dealt.unpersist()
    return w
