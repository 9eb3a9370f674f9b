"""Iterated models: stochastic gradients, linear support vectors, networks, factorisations, robust regression."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import ROW_CAP, ArrayModel, EmptyInput, InvalidParameter, linear_form, matrix, require, vector, written
from . import passes
from .linear import LinearModel
from .quantiles import exact_quantiles

#: Rows that fits of many more rows start from.
START_ROWS = 1 << 15
#: Rows that sequential methods walk on the driver.
WALK = 20 * ROW_CAP


@dataclass
class ScoreModel(ArrayModel):
    """Linear scores, one row of weights each; two labels take the sign."""

    features: list[str]
    weights: np.ndarray
    bias: np.ndarray
    labels: list | None = None

    def decision(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights.T + self.bias

    def predict_array(self, x: np.ndarray) -> np.ndarray:
        z = self.decision(x)
        if self.labels is None:
            return z[:, 0]
        return np.array(self.labels)[(z[:, 0] > 0).astype(int) if len(self.labels) == 2 else z.argmax(1)]


def _ordered(df, features, label, order):
    x, got = matrix(df, features, order, WALK, (label,))
    return x, got[label].to_numpy()


def _targets(y):
    labels = sorted(set(y.tolist()))
    if len(labels) < 2:
        raise InvalidParameter("fewer than two classes")
    return labels, [np.where(y == v, 1.0, -1.0) for v in (labels[1:] if len(labels) == 2 else labels)]


@dataclass
class _Sgd:
    """Stochastic gradients; stops when the mean loss of an epoch falls below ``tol``.

    With ``order`` rows are walked one by one in the order of that column, on the driver (at most WALK rows). Without it
    any number of rows is walked in mini-batches of ``batch`` rows, in blocks whose weights are averaged after each epoch
    (see passes.averaged_descent).
    """

    loss: str = "hinge"
    penalty: str = "l2"
    alpha: float = 1e-4
    l1_ratio: float = 0.15
    schedule: str = "invscaling"
    eta0: float = 0.01
    power: float = 0.25
    epochs: int = 20
    tol: float = 1e-3
    epsilon: float = 0.1
    batch: int = 16

    classes = False

    def _rate(self, t: int) -> float:
        if self.schedule == "constant":
            return self.eta0
        return 1 / (self.alpha * (t + 1 / max(self.alpha * self.eta0, 1e-12))) if self.schedule == "optimal" else self.eta0 / (t + 1) ** self.power

    def _slope(self, z: float, y: float) -> tuple[float, float]:
        m, r = y * z, z - y
        if self.loss == "hinge":
            return (max(0.0, 1 - m), -y if m < 1 else 0.0)
        if self.loss == "perceptron":
            return (max(0.0, -m), -y if m <= 0 else 0.0)
        if self.loss == "log":
            return (float(np.logaddexp(0, -m)), -y / (1 + np.exp(min(m, 500))))
        if self.loss == "modified_huber":
            return (0.0, 0.0) if m >= 1 else ((1 - m) ** 2, -2 * y * (1 - m)) if m >= -1 else (-4 * m, -4 * y)
        if self.loss == "squared":
            return 0.5 * r * r, r
        if self.loss == "huber":
            return (0.5 * r * r, r) if abs(r) <= self.epsilon else (self.epsilon * (abs(r) - self.epsilon / 2), self.epsilon * np.sign(r))
        if self.loss == "epsilon_insensitive":
            return (max(0.0, abs(r) - self.epsilon), np.sign(r) if abs(r) > self.epsilon else 0.0)
        raise InvalidParameter(self.loss)

    def _slopes(self, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Losses and slopes of many rows: _slope() on arrays."""
        m, r = y * z, z - y
        if self.loss == "hinge":
            return np.maximum(0, 1 - m), np.where(m < 1, -y, 0.0)
        if self.loss == "perceptron":
            return np.maximum(0, -m), np.where(m <= 0, -y, 0.0)
        if self.loss == "log":
            return np.logaddexp(0, -m), -y / (1 + np.exp(np.minimum(m, 500)))
        if self.loss == "modified_huber":
            return np.where(m >= 1, 0.0, np.where(m >= -1, (1 - m) ** 2, -4 * m)), np.where(m >= 1, 0.0, np.where(m >= -1, -2 * y * (1 - m), -4 * y))
        if self.loss == "squared":
            return 0.5 * r * r, r
        big = np.abs(r) > self.epsilon
        if self.loss == "huber":
            return np.where(big, self.epsilon * (np.abs(r) - self.epsilon / 2), 0.5 * r * r), np.where(big, self.epsilon * np.sign(r), r)
        if self.loss == "epsilon_insensitive":
            return np.maximum(0, np.abs(r) - self.epsilon), np.where(big, np.sign(r), 0.0)
        raise InvalidParameter(self.loss)

    def _passes(self, df: DataFrame, features, label, labels: list | None, start: np.ndarray | None, first: int = 0) -> tuple[np.ndarray, list | None]:
        """(weights with the bias last, labels) of all classes by mini-batches inside blocks, averaged after each epoch."""
        with passes.Table(df, features, label) as table:
            if labels is None and self.classes:
                labels = table.labels()
                if len(labels) < 2:
                    raise InvalidParameter("fewer than two classes")
            targets = (lambda y: np.stack([np.where(y == v, 1.0, -1.0) for v in (labels[1:] if len(labels) == 2 else labels)], 1)) if self.classes else (lambda y: y.astype(float)[:, None])
            models, block = (1 if len(labels) == 2 else len(labels)) if self.classes else 1, min(table.n, passes.BLOCK_ROWS)

            def walk(x, y, w, epoch, seen):
                t, total = targets(y), 0.0
                for a in range(0, len(x), self.batch):
                    v, y1 = x[a : a + self.batch], t[a : a + self.batch]
                    loss, g = self._slopes(v @ w[:, :-1].T + w[:, -1], y1)
                    total += float(loss.sum()) / models
                    eta = self._rate(first + epoch * block + seen + a)
                    share = 1.0 if self.penalty == "l2" else 1 - self.l1_ratio if self.penalty == "elasticnet" else 0.0
                    w[:, :-1] *= max(0.0, 1 - eta * self.alpha * share)
                    w -= eta * np.column_stack([g.T @ v, g.sum(0)]) / len(v)
                    if self.penalty in ("l1", "elasticnet"):
                        cut = eta * self.alpha * (1.0 if self.penalty == "l1" else self.l1_ratio)
                        w[:, :-1] = np.sign(w[:, :-1]) * np.maximum(np.abs(w[:, :-1]) - cut, 0)
                return w, total

            begin = np.zeros((models, table.d + 1)) if start is None else start
            return passes.averaged_descent(table, walk, begin, self.epochs, lambda loss: loss < self.tol), labels

    def _walk(self, x, y, w, b, t):
        for _ in range(self.epochs):
            total = 0.0
            for v, target in zip(x, y, strict=True):
                loss, g = self._slope(float(v @ w + b), float(target))
                total += loss
                eta = self._rate(t)
                t += 1
                if self.penalty == "l2":
                    w *= max(0.0, 1 - eta * self.alpha)
                elif self.penalty == "elasticnet":
                    w *= max(0.0, 1 - eta * self.alpha * (1 - self.l1_ratio))
                if g:
                    w -= eta * g * v
                    b -= eta * g
                if self.penalty in ("l1", "elasticnet"):
                    cut = eta * self.alpha * (1.0 if self.penalty == "l1" else self.l1_ratio)
                    w[:] = np.sign(w) * np.maximum(np.abs(w) - cut, 0)
            if total / len(x) < self.tol:
                break
        return w, b, t


@dataclass
class SgdClassifier(_Sgd):
    classes = True

    def fit(self, df: DataFrame, features, label, order=None) -> ScoreModel:
        if order is None:
            w, labels = self._passes(df, features, label, None, None)
            return ScoreModel(features, w[:, :-1], w[:, -1], labels)
        x, y = _ordered(df, features, label, order)
        labels, targets = _targets(y)
        got = [self._walk(x, t, np.zeros(x.shape[1]), 0.0, 0) for t in targets]
        return ScoreModel(features, np.array([g[0] for g in got]), np.array([g[1] for g in got]), labels)

    def partial_fit(self, model: ScoreModel | None, df: DataFrame, features, label, order=None) -> ScoreModel:
        """Goes on from a model with more rows, at the rate of the 1,000th step; labels stay those of the first fit."""
        if model is None:
            return self.fit(df, features, label, order)
        if order is None:
            w, _ = self._passes(df, features, label, model.labels, np.column_stack([model.weights, model.bias]), 1000)
            return ScoreModel(features, w[:, :-1], w[:, -1], model.labels)
        x, y = _ordered(df, features, label, order)
        targets = [np.where(y == v, 1.0, -1.0) for v in (model.labels[1:] if len(model.labels) == 2 else model.labels)]
        got = [self._walk(x, t, model.weights[k].copy(), float(model.bias[k]), 1000) for k, t in enumerate(targets)]
        return ScoreModel(features, np.array([g[0] for g in got]), np.array([g[1] for g in got]), model.labels)


@dataclass
class SgdRegressor(_Sgd):
    loss: str = "squared"

    def fit(self, df: DataFrame, features, label, order=None) -> ScoreModel:
        if order is None:
            w, _ = self._passes(df, features, label, None, None)
            return ScoreModel(features, w[:, :-1], w[:, -1])
        x, y = _ordered(df, features, label, order)
        w, b, _ = self._walk(x, y.astype(float), np.zeros(x.shape[1]), 0.0, 0)
        return ScoreModel(features, w[None], np.array([b]))


@dataclass
class LinearSvr(SgdRegressor):
    """The epsilon-insensitive loss: with ``order`` primal descent in row order, else the least of the mean loss and
    alpha * w^2 / 2 by Newton steps, each one pass over any number of rows."""

    loss: str = "epsilon_insensitive"
    epochs: int = 100

    def fit(self, df: DataFrame, features, label, order=None) -> ScoreModel:
        if order is not None:
            return super().fit(df, features, label, order)
        with passes.Table(df, features, label) as table:
            penalty = np.append(np.full(table.d, self.alpha if self.penalty == "l2" else 0.0), 0.0)
            ramps = lambda y: [[(1.0, -y.astype(float) - self.epsilon), (-1.0, y.astype(float) - self.epsilon)]]
            w, _ = passes.newton_ramps(table, ramps, 1, 1 / table.n, penalty)
        return ScoreModel(features, w[:, :-1], w[:, -1])


@dataclass
class PassiveAggressiveClassifier:
    """variant 0, 1 or 2: the step is loss / |x|^2, capped by C, or softened by 1 / (2C)."""

    c: float = 1.0
    variant: int = 1
    epochs: int = 10
    epsilon: float | None = None

    def _step(self, loss, n):
        t = loss / max(n, 1e-12)
        return t if self.variant == 0 else min(self.c, t) if self.variant == 1 else loss / (n + 1 / (2 * self.c))

    def fit(self, df: DataFrame, features, label, order) -> ScoreModel:
        x, y = _ordered(df, features, label, order)
        labels = None
        if self.epsilon is None:
            labels, targets = _targets(y)
            if len(labels) != 2:
                raise InvalidParameter("two classes only")
            y = targets[0]
        w = np.zeros(x.shape[1] + 1)
        for _ in range(self.epochs):
            for v, t in zip(np.column_stack([x, np.ones(len(x))]), y.astype(float), strict=True):
                z = v @ w
                loss, sign = (max(0.0, 1 - t * z), t) if self.epsilon is None else (max(0.0, abs(t - z) - self.epsilon), np.sign(t - z))
                w += self._step(loss, v @ v) * sign * v
        return ScoreModel(features, w[None, :-1], w[-1:], labels)


@dataclass
class PassiveAggressiveRegressor(PassiveAggressiveClassifier):
    epsilon: float | None = 0.1


@dataclass
class LinearSvc:
    """Hinge loss and squared weights (the bias among them), one class against the rest: the least of w^2 / 2 + C * losses.

    Newton steps on the loss with its kink rounded off by less and less, all classes in the same passes; any number of rows.
    """

    c: float = 1.0
    max_iter: int = 30
    tol: float = 1e-6

    def fit(self, df: DataFrame, features, label) -> ScoreModel:
        with passes.Table(df, features, label, equal=True) as table:
            labels = table.labels()
            if len(labels) < 2:
                raise InvalidParameter("fewer than two classes")
            heads = labels[1:] if len(labels) == 2 else labels
            ramps = lambda y: [[(-1.0 * t, 1.0)] for t in (np.where(y == v, 1.0, -1.0) for v in heads)]
            solve = lambda rows, c, **how: passes.newton_ramps(rows, ramps, len(heads), c, np.ones(table.d + 1), max_iter=self.max_iter, tol=self.tol, **how)[0]
            if table.n <= START_ROWS or table.held:
                w = solve(table, self.c)
            else:  # some rows by a hash give where to start, all rows the result
                some = table.drawn(START_ROWS)
                w = solve(table, self.c, start=solve(some, self.c * table.n / some.n), widths=(0.01, 0.003, 0.001))
        return ScoreModel(features, w[:, :-1], w[:, -1], labels)


_ACT = {
    "relu": (lambda z: np.maximum(z, 0), lambda a: (a > 0).astype(float)),
    "tanh": (np.tanh, lambda a: 1 - a * a),
    "sigmoid": (lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500))), lambda a: a * (1 - a)),
    "identity": (lambda z: z, np.ones_like),
}


@dataclass
class NetworkModel(ArrayModel):
    features: list[str]
    weights: list
    biases: list
    activation: str
    labels: list | None = None

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for k, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            z = out[-1] @ w + b
            out.append(_ACT[self.activation][0](z) if k < len(self.weights) - 1 else z)
        return out

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        z = self.forward(x)[-1]
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def predict_array(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[-1][:, 0] if self.labels is None else np.array(self.labels)[self.predict_proba(x).argmax(1)]


@dataclass
class MlpClassifier:
    """A network fitted by passes over any number of rows: each step takes the gradient of the mean loss of all rows.

    ``solver`` is ``lbfgs`` (quasi-Newton, the default), ``adam`` or ``sgd`` (momentum 0.9); weights stay on the driver. The loss is
    cross-entropy or half the squared error, plus alpha / (2 rows) times the squared weights. Stops after ``epochs`` steps or when ten steps (lbfgs: one)
    gain less than ``tol``.
    """

    hidden: list[int] = field(default_factory=lambda: [100])
    activation: str = "relu"
    solver: str = "lbfgs"
    rate: float = 1e-2
    alpha: float = 1e-4
    epochs: int = 200
    tol: float = 1e-5
    seed: int = 0
    regression: bool = False

    def network(self, features, flat: np.ndarray, sizes: list[int], labels) -> NetworkModel:
        weights, biases, at = [], [], 0
        for a, b in zip(sizes[:-1], sizes[1:], strict=True):
            weights.append(flat[at : at + a * b].reshape(a, b))
            biases.append(flat[at + a * b : at + a * b + b])
            at += a * b + b
        return NetworkModel(features, weights, biases, self.activation, labels)

    def gradient(self, net: NetworkModel, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The sum of losses of some rows, then its gradient by weights and biases, layer by layer."""
        t = y.astype(float)[:, None] if self.regression else np.eye(len(net.labels))[np.searchsorted(net.labels, y)]
        out = net.forward(x)
        if self.regression:
            d = out[-1] - t
            loss = 0.5 * float((d * d).sum())
        else:
            top = out[-1].max(1, keepdims=True)
            log = out[-1] - top - np.log(np.exp(out[-1] - top).sum(1, keepdims=True))
            d, loss = np.exp(log) - t, -float((t * log).sum())
        parts = []
        for k in range(len(net.weights) - 1, -1, -1):
            parts[:0] = [(out[k].T @ d).ravel(), d.sum(0)]
            if k:
                d = (d @ net.weights[k].T) * _ACT[self.activation][1](out[k])
        return np.concatenate([[loss], *parts])

    def fit(self, df: DataFrame, features, label) -> NetworkModel:
        with passes.Table(df, features, label) as table:
            labels = None if self.regression else table.labels()
            sizes = [table.d, *self.hidden, 1 if self.regression else len(labels)]
            rng = np.random.default_rng(self.seed)
            x = np.concatenate([np.concatenate([(rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))).ravel(), np.zeros(b)]) for a, b in zip(sizes[:-1], sizes[1:], strict=True)])
            decay = np.concatenate([np.concatenate([np.ones(a * b), np.zeros(b)]) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]) * self.alpha / table.n

            def objective(flat):
                net = self.network(features, flat, sizes, labels)
                m = table.sums(lambda x, y: self.gradient(net, x, y)) / table.n
                return m[0] + 0.5 * float((decay * flat * flat).sum()), m[1:] + decay * flat

            if self.solver == "lbfgs":
                x, _, _ = passes.lbfgs(objective, x, self.epochs, self.tol)
                return self.network(features, x, sizes, labels)
            m, v, best, still = np.zeros_like(x), np.zeros_like(x), np.inf, 0
            for step in range(1, self.epochs + 1):
                loss, g = objective(x)
                if self.solver == "adam":
                    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                    x = x - self.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                else:
                    m = 0.9 * m - self.rate * g
                    x = x + m
                still = 0 if loss < best - self.tol else still + 1
                best = min(best, loss)
                if still >= 10:
                    break
            return self.network(features, x, sizes, labels)


@dataclass
class MlpRegressor(MlpClassifier):
    regression: bool = True


@dataclass
class Factors:
    """W as a table (id, w array), H (components by features), the error |X - WH|, and the rounds it took."""

    w: DataFrame
    h: np.ndarray
    error: float
    rounds: int


@dataclass
class NMF:
    """Multiplicative updates from a non-negative double SVD (or random) start; any number of rows.

    Rows of W lie beside those of X; a round changes H by the sums of the round before, and its one pass
    changes each row's w and sums W'X, W'W and the squared error anew. The start's singular vectors come from X'X. The rows' state is written
    every eighth round.
    """

    n_components: int = 2
    start: str = "nndsvd"
    max_iter: int = 200
    tol: float = 1e-4
    seed: int = 0

    def fit(self, df: DataFrame, features, id_col) -> Factors:
        require(df, [id_col, *features])
        k, d = self.n_components, len(features)
        rows = df.select(F.col(f"`{id_col}`").alias("id"), vector(features).alias("x"))
        first = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.array_min("x")).alias("least"), F.bool_or(F.exists("x", lambda v: v.isNull() | F.isnan(v))).alias("lost")).first()
        if not first["n"]:
            raise EmptyInput("no rows")
        if first["lost"] or first["least"] < 0:
            raise InvalidParameter("negative or missing values")

        if self.start == "nndsvd":
            gram = self._sums(rows, lambda x, w: (x.T @ x).ravel(), d).reshape(d, d)
            s2, v = np.linalg.eigh(gram)
            order = np.argsort(-s2)[:k]
            s, v = np.sqrt(np.maximum(s2[order], 0)), v[:, order].T
            norms = self._sums(rows, lambda x, w: np.concatenate([(np.maximum(u, 0) ** 2).sum(0) for u in (x @ v.T, -(x @ v.T))]), d).reshape(2, -1)
            norms = np.sqrt(norms) / np.maximum(s, 1e-300)
            scale, h, sign = np.zeros(k), np.full((k, d), 1e-6), np.ones(k)
            for j in range(len(order)):
                sides = [(norms[i, j] * np.linalg.norm(np.maximum(g * v[j], 0)), g) for i, g in enumerate((1.0, -1.0))]
                size, sign[j] = max(sides, key=lambda p: p[0])
                part = np.maximum(sign[j] * v[j], 0)
                nb, na = np.linalg.norm(part), norms[0 if sign[j] > 0 else 1, j]
                scale[j], h[j] = np.sqrt(s[j] * size) / max(na, 1e-12) / max(s[j], 1e-300), np.maximum(np.sqrt(s[j] * size) * part / max(nb, 1e-12), 1e-6)
            full = np.zeros((k, d))
            full[: len(order)] = v
            begin = lambda x, ids: np.maximum(np.maximum(x @ full.T * sign, 0) * scale, 1e-6)
        else:
            h = np.random.default_rng(self.seed).random((k, d))
            begin = None
        if begin is None:  # a hash of id and component: the same for any partitioning
            state = rows.withColumn("w", F.array(*[(F.pmod(F.xxhash64("id", F.lit(j), F.lit(self.seed)), F.lit(1 << 30)) + 1) / float(1 << 30) for j in range(k)]))
        else:
            state = self._mapped(rows, begin, d)
        state = written(state, "nmf")
        wx, ww, old = self._measure(state, h, k, d)
        error, rounds = old, 0
        for rounds in range(1, self.max_iter + 1):
            h = h * (wx / np.maximum(ww @ h, 1e-12))
            step = lambda x, w, h=h: w * (x @ h.T / np.maximum(w @ (h @ h.T), 1e-12))
            new = self._mapped(state, step, d, True)
            new = written(new, "nmf") if rounds % 8 == 0 else new.persist(StorageLevel.MEMORY_AND_DISK)
            wx, ww, error = self._measure(new, h, k, d)
            state.unpersist()
            state = new
            if old - error < self.tol * max(old, 1e-12):
                break
            old = error
        return Factors(state.select(F.col("id").alias(id_col), "w"), h, error, rounds)

    @staticmethod
    def _sums(rows: DataFrame, compute, d: int, k: int = 0) -> np.ndarray:
        def part(batches):
            total = 0.0
            for b in batches:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
                w = b.column("w").flatten().to_numpy(zero_copy_only=False).reshape(-1, k) if k else None
                for a in range(0, len(x), passes.STEP):
                    total = total + compute(x[a : a + passes.STEP], w[a : a + passes.STEP] if k else None)
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["m"])

        numbers = (k + 1) * (d + k + 1) * rows.rdd.getNumPartitions() if k else None
        return passes.total(rows.select("x", *(["w"] if k else [])).mapInArrow(part, "m array<double>"), numbers)

    @classmethod
    def _measure(cls, state: DataFrame, h: np.ndarray, k: int, d: int):
        m = cls._sums(state, lambda x, w: np.concatenate([(w.T @ x).ravel(), (w.T @ w).ravel(), [((x - w @ h) ** 2).sum()]]), d, k)
        return m[: k * d].reshape(k, d), m[k * d : -1].reshape(k, k), float(np.sqrt(m[-1]))

    @staticmethod
    def _mapped(rows: DataFrame, make, d: int, has_w: bool = False) -> DataFrame:
        kind = rows.schema["id"].dataType.simpleString()

        def part(batches):
            for b in batches:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
                other = b.column("w").flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if has_w and len(x) else None
                w = make(x, other) if len(x) else np.zeros((0, 1))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(list(w), pa.list_(pa.float64()))], ["id", "x", "w"])

        return rows.mapInArrow(part, f"id {kind}, x array<double>, w array<double>")


@dataclass
class FastICA:
    """Whitening, then one unit at a time with the log-cosh contrast; any number of rows.

    Means and covariances are one pass, each fixed-point step is another: rows are whitened as they are read.
    """

    n_components: int = 2
    max_iter: int = 200
    tol: float = 1e-4
    seed: int = 0

    def fit(self, df: DataFrame, features) -> ScoreModel:
        with passes.Table(df, features) as table:
            n, d = table.n, table.d
            mean = table.sums(lambda x, y: x.sum(0)) / n
            cov = table.sums(lambda x, y: ((x - mean).T @ (x - mean)).ravel()).reshape(d, d) / n
            s, u = np.linalg.eigh(cov)
            order = np.argsort(-s)[: self.n_components]
            white = u[:, order] / np.sqrt(np.maximum(s[order], 1e-12))
            rng, units = np.random.default_rng(self.seed), []
            for _ in range(len(order)):
                w = rng.normal(size=len(order))
                w /= np.linalg.norm(w)
                for _ in range(self.max_iter):

                    def step(x, y, w=w):
                        z = (x - mean) @ white
                        g = np.tanh(z @ w)
                        return np.append((z * g[:, None]).sum(0), (1 - g * g).sum())

                    m = table.sums(step) / n
                    new = m[:-1] - m[-1] * w
                    for r in units:
                        new = new - (new @ r) * r
                    new /= max(np.linalg.norm(new), 1e-12)
                    done = abs(abs(new @ w) - 1) < self.tol
                    w = new
                    if done:
                        break
                units.append(w)
        unmix = np.array(units) @ white.T
        return ScoreModel(features, unmix, -unmix @ mean)


def _upper_median(df: DataFrame, column, n: int) -> float:
    return exact_quantiles(df, [column], [(n // 2) / (n - 1) if n > 1 else 0.0])[0][0]


def _least_squares(x, y):
    return np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]


def _drawn(table: passes.Table, order: str, rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of at most ``rows`` rows, the first by a hash of their id: bounded, and the same for any partitioning."""
    got = table.rows.select("x", "y", F.xxhash64(F.col(f"`{order}`"), F.lit(seed)).alias("h")).orderBy("h", "y", "x").limit(rows).toArrow().combine_chunks()
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, table.d)
    return x, got.column("y").to_numpy().astype(float)


@dataclass
class RansacModel(LinearModel):
    """A linear model with the distance up to which a row is an inlier."""

    threshold: float = 0.0

    def inliers(self, df: DataFrame, label: str, output: str = "inlier") -> DataFrame:
        """Marks rows no farther from the best candidate's prediction than the threshold."""
        coef, intercept = self.extra["candidate"][1:], self.extra["candidate"][0]
        return df.withColumn(output, F.abs(F.col(f"`{label}`").cast("double") - linear_form(self.features, coef, intercept)) <= self.threshold)


@dataclass
class RansacRegressor:
    """Least squares on the inliers of the candidate that has most; any number of rows.

    Candidates go through rows drawn by a hash of their id; one pass counts the inliers of all candidates, and one
    sums what the last fit needs. The threshold is the median absolute deviation of the label, with upper medians, unless given. Of
    candidates with as many inliers the first is taken.
    """

    trials: int = 100
    threshold: float | None = None
    seed: int = 0

    def fit(self, df: DataFrame, features, label, order) -> RansacModel:
        with passes.Table(df, features, label, order) as table:
            k, rng = table.d + 1, np.random.default_rng(self.seed)
            limit = self.threshold
            if limit is None:
                y = F.col("y").cast("double")
                middle = _upper_median(table.rows, y, table.n)
                limit = _upper_median(table.rows, F.abs(y - F.lit(middle)), table.n)
            x, y = _drawn(table, order, self.trials * k, self.seed)
            models = np.array([_least_squares(x[p], y[p]) for p in (rng.choice(len(x), min(k, len(x)), replace=False) for _ in range(self.trials))])
            close = lambda x, y, b: np.abs(y.astype(float)[:, None] - b[:, 0] - x @ b[:, 1:].T) <= limit
            counts = table.sums(lambda x, y: close(x, y, models).sum(0).astype(float))
            best = models[int(counts.argmax())]

            def gram(x, y):
                z = np.column_stack([np.ones(len(x)), x, y.astype(float)])
                z = z[close(x, y, best[None])[:, 0]] if counts.max() >= k else z
                return (z.T @ z).ravel()

            m = table.sums(gram).reshape(k + 1, k + 1)
            b = np.linalg.lstsq(m[:k, :k], m[:k, k], rcond=None)[0]
        return RansacModel(features, b[1:], float(b[0]), {"inliers": int(counts.max()), "candidate": best.tolist()}, float(limit))


@dataclass
class TheilSenRegressor:
    """The spatial median (Weiszfeld) of least-squares fits to random subsets of rows drawn by a hash of their id.

    The subsets, draws * (features + 1) rows at most, are all that reaches the driver, however many rows there are.
    """

    draws: int = 1000
    seed: int = 0

    def fit(self, df: DataFrame, features, label, order) -> LinearModel:
        with passes.Table(df, features, label, order) as table:
            k = table.d + 1
            x, y = _drawn(table, order, self.draws * k, self.seed)
        rng = np.random.default_rng(self.seed)
        z = np.array([_least_squares(x[p], y[p]) for p in (rng.choice(len(x), min(k, len(x)), replace=False) for _ in range(self.draws))])
        m = np.median(z, axis=0)
        for _ in range(300):
            w = 1 / np.maximum(np.linalg.norm(z - m, axis=1), 1e-12)
            new = (z * w[:, None]).sum(0) / w.sum()
            if np.abs(new - m).max() < 1e-10:
                break
            m = new
        return LinearModel(features, m[1:], float(m[0]))
