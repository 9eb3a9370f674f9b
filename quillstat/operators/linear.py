"""Linear models from sums of products: one distributed aggregate, then a small solve on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import EmptyInput, InvalidParameter, Model, linear_form, require, vector, wide


@dataclass
class Gram:
    """Centred sums over rows (weighted): count, means and comoments of the features and, last, the target.

    Comoments are taken around means from the start and merged pairwise, so that large values lose no digits.
    """

    n: float
    means: np.ndarray
    moments: np.ndarray

    def __add__(self, o: Gram) -> Gram:
        n, gap = self.n + o.n, o.means - self.means
        if not n:
            return self
        return Gram(n, self.means + gap * (o.n / n), self.moments + o.moments + np.outer(gap, gap) * (self.n * o.n / n))

    def __sub__(self, o: Gram) -> Gram:
        n = self.n - o.n
        if n <= 0:
            return Gram(0.0, np.zeros_like(self.means), np.zeros_like(self.moments))
        means = self.means + (self.means - o.means) * (o.n / n)
        gap = o.means - means
        return Gram(n, means, self.moments - o.moments - np.outer(gap, gap) * (n * o.n / self.n))

    @property
    def mean(self):
        return self.means[:-1]

    @property
    def label_mean(self) -> float:
        return float(self.means[-1])

    @property
    def sx(self):
        return self.n * self.mean

    @property
    def sxx(self):
        return self.moments[:-1, :-1] + self.n * np.outer(self.mean, self.mean)

    def covariance(self, ddof: int = 1):
        return self.moments[:-1, :-1] / max(self.n - ddof, 1e-300)

    def centred(self, intercept: bool = True):
        """(X'X, X'y, y'y) around the means, or around 0 without an intercept."""
        m = self.moments if intercept else self.moments + self.n * np.outer(self.means, self.means)
        return m[:-1, :-1], m[:-1, -1], m[-1, -1]

    def squared_error(self, coef: np.ndarray, intercept: float) -> float:
        """The (weighted) sum of squared residuals of a linear form on these rows."""
        a, c, yy = self.centred()
        off = self.label_mean - float(self.mean @ coef) - intercept
        return float(yy - 2 * coef @ c + coef @ a @ coef + self.n * off * off)

    @staticmethod
    def of(z: np.ndarray, w: np.ndarray) -> Gram:
        n = float(w.sum())
        means = (w @ z) / n if n else np.zeros(z.shape[1])
        gap = z - means
        return Gram(n, means, (gap * w[:, None]).T @ gap)


#: Tasks' sums are merged in so many parts on executors before the driver merges the rest.
MERGE_PARTS = 32


def grams(df: DataFrame, features: list[str], label: str | None = None, weight: str | None = None, by: str | None = None) -> dict:
    """Gram of each group (``by``; else one under None), from one pass.

    Tasks sum their Arrow batches, executors merge the tasks' sums, the driver gets MERGE_PARTS rows a group at most.
    Rows with a null or NaN value are left out; a null, NaN or negative weight is an error.
    """
    require(df, [*features, *([label] if label else []), *([weight] if weight else [])])
    d = len(features) + 1
    cols = [vector(features).alias("x"), (F.col(f"`{label}`").cast("double") if label else F.lit(0.0)).alias("y"), (F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)).alias("w"), (F.col(f"`{by}`").cast("string") if by else F.lit("")).alias("g")]

    def frame(got: dict, part: int) -> pd.DataFrame:
        rows = [(g, part, bad, m.n, m.means.tolist(), m.moments.ravel().tolist()) for g, (bad, m) in got.items()]
        return pd.DataFrame(rows, columns=["g", "part", "bad", "n", "means", "moments"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            z = np.column_stack([wide(b.column("x"), d - 1), b.column("y").to_numpy(zero_copy_only=False)]).astype(float)
            w = b.column("w").to_numpy(zero_copy_only=False).astype(float)
            bad, whole = ~(w >= 0), ~np.isnan(z).any(axis=1)
            group = b.column("g").dictionary_encode(null_encoding="encode")
            code, names = group.indices.to_numpy(), group.dictionary.to_pylist()
            for k, g in enumerate(names):
                at = code == k if len(names) > 1 else np.ones(len(code), bool)
                use = at & whole & ~bad
                old = total.get(g, (0, Gram(0.0, np.zeros(d), np.zeros((d, d)))))
                total[g] = (old[0] + int((at & bad).sum()), old[1] + Gram.of(z[use], w[use]))
        if total:
            yield pa.RecordBatch.from_pandas(frame(total, TaskContext.get().partitionId() % MERGE_PARTS), schema=kinds, preserve_index=False)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total = Gram(0.0, np.zeros(d), np.zeros((d, d)))
        for n, means, moments in zip(rows["n"], rows["means"], rows["moments"], strict=True):
            total = total + Gram(n, np.array(means), np.array(moments).reshape(d, d))
        return frame({rows["g"].iloc[0]: (int(rows["bad"].sum()), total)}, int(rows["part"].iloc[0]))

    schema = "g string, part int, bad bigint, n double, means array<double>, moments array<double>"
    numbers = pa.list_(pa.float64())
    kinds = pa.schema([("g", pa.string()), ("part", pa.int32()), ("bad", pa.int64()), ("n", pa.float64()), ("means", numbers), ("moments", numbers)])
    found = df.select(*cols).mapInArrow(sums, schema).groupBy("g", "part").applyInPandas(merge, schema).collect()
    got: dict = {}
    for r in sorted(found, key=lambda r: (r["g"] or "", r["part"])):
        if r["bad"]:
            raise InvalidParameter(f"weights in {weight} must be numbers of at least 0")
        one = Gram(r["n"], np.array(r["means"]), np.array(r["moments"]).reshape(d, d))
        got[r["g"]] = got[r["g"]] + one if r["g"] in got else one
    got = {g: m for g, m in got.items() if m.n > 0}
    if not got:
        raise EmptyInput("no rows")
    return got if by else {None: got[""]}


def gram(df: DataFrame, features: list[str], label: str | None = None, weight: str | None = None) -> Gram:
    return grams(df, features, label, weight)[None]


@dataclass
class LinearModel(Model):
    features: list[str]
    coef: np.ndarray
    intercept: float
    extra: dict = field(default_factory=dict)

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        require(df, self.features)
        return df.withColumn(output, linear_form(self.features, self.coef, self.intercept))

    def predict_std(self, df: DataFrame, output: str = "std") -> DataFrame:
        """Predictive deviation of Bayesian fits: noise plus the coefficients' covariance around the mean."""
        s, mean = np.array(self.extra["sigma"]), np.array(self.extra["mean"])
        v = F.lit(1.0 / float(self.extra["alpha"]))
        xs = [F.col(f"`{c}`").cast("double") - float(m) for c, m in zip(self.features, mean, strict=True)]
        for i in range(len(xs)):
            for j in range(len(xs)):
                v = v + xs[i] * xs[j] * float(s[i, j])
        return df.withColumn(output, F.sqrt(v))


def _model(features, g: Gram, coef, intercept: bool, **extra) -> LinearModel:
    coef = np.asarray(coef, float)
    b = float(g.label_mean - g.mean @ coef) if intercept else 0.0
    a, c, yy = g.centred(intercept)
    rss = float(yy - 2 * coef @ c + coef @ a @ coef)
    _, _, total = g.centred(True)
    extra["r_squared"] = 1 - rss / total if total > 0 else 0.0
    return LinearModel(features, coef, b, extra)


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


@dataclass
class OlsRegressor:
    intercept: bool = True
    confidence: float = 0.95

    def fit(self, df: DataFrame, features: list[str], label: str, weight: str | None = None) -> LinearModel:
        g = gram(df, features, label, weight)
        a, c, yy = g.centred(self.intercept)
        w = solve(a, c)
        m = _model(features, g, w, self.intercept)
        free = max(1.0, g.n - len(features) - self.intercept)
        s2 = max(0.0, float(yy - w @ c)) / free
        m.extra |= {"std_err": np.sqrt(np.maximum(np.diag(np.linalg.pinv(a)) * s2, 0)).tolist(), "confidence": self.confidence}
        return m


@dataclass
class WlsRegressor:
    weight: str
    intercept: bool = True

    def fit(self, df, features, label) -> LinearModel:
        return OlsRegressor(self.intercept).fit(df, features, label, self.weight)


@dataclass
class RidgeRegressor:
    """Least squares plus lam * |b|^2, not scaled by the number of rows; the intercept is free."""

    lam: float = 1.0
    intercept: bool = True

    def from_gram(self, g: Gram, features) -> LinearModel:
        a, c, _ = g.centred(self.intercept)
        return _model(features, g, solve(a + self.lam * np.eye(len(c)), c), self.intercept)

    def fit(self, df, features, label, weight: str | None = None) -> LinearModel:
        if self.lam < 0:
            raise InvalidParameter("lam")
        return self.from_gram(gram(df, features, label, weight), features)


@dataclass
class ElasticNetRegressor:
    """Least squares plus lam * (alpha |b|_1 + (1 - alpha) |b|^2), by coordinate descent on the sums."""

    lam: float = 1.0
    alpha: float = 0.5
    intercept: bool = True
    max_iter: int = 1000
    tol: float = 1e-8

    def from_gram(self, g: Gram, features) -> LinearModel:
        a, c, _ = g.centred(self.intercept)
        w, l1, l2 = np.zeros(len(c)), self.lam * self.alpha / 2, self.lam * (1 - self.alpha)
        for _ in range(self.max_iter):
            most = 0.0
            for j in range(len(c)):
                r = c[j] - a[j] @ w + a[j, j] * w[j]
                new = np.sign(r) * max(abs(r) - l1, 0) / (a[j, j] + l2) if a[j, j] + l2 > 0 else 0.0
                most, w[j] = max(most, abs(new - w[j])), new
            if most < self.tol:
                break
        return _model(features, g, w, self.intercept)

    def fit(self, df, features, label, weight: str | None = None) -> LinearModel:
        return self.from_gram(gram(df, features, label, weight), features)


@dataclass
class LassoRegressor(ElasticNetRegressor):
    alpha: float = 1.0


def _cross_validated(df, features, label, fold: str, makers: list) -> tuple[LinearModel, int, list[float]]:
    """Best of several penalties by mean R^2 over folds; all folds' sums come from one pass, folds by subtraction."""
    parts = grams(df, features, label, by=fold)
    zero = sum(list(parts.values())[1:], next(iter(parts.values())))
    means = []
    for m in makers:
        scores = []
        for p in parts.values():
            fit = m.from_gram(zero - p, features)
            total = p.centred()[2]
            scores.append(1 - p.squared_error(fit.coef, fit.intercept) / total if total > 0 else 0.0)
        means.append(float(np.mean(scores)))
    best = int(np.argmax(means))
    return makers[best].from_gram(zero, features), best, means


ALPHAS = (1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0)


@dataclass
class RidgeCrossValidated:
    alphas: tuple = ALPHAS

    def fit(self, df, features, label, fold: str) -> LinearModel:
        m, k, scores = _cross_validated(df, features, label, fold, [RidgeRegressor(a) for a in self.alphas])
        m.extra |= {"best_lam": self.alphas[k], "scores": scores}
        return m


@dataclass
class LassoCrossValidated:
    alphas: tuple = ALPHAS

    def fit(self, df, features, label, fold: str) -> LinearModel:
        m, k, scores = _cross_validated(df, features, label, fold, [LassoRegressor(a) for a in self.alphas])
        m.extra |= {"best_lam": self.alphas[k], "scores": scores}
        return m


@dataclass
class ElasticNetCrossValidated:
    alphas: tuple = ALPHAS
    l1_ratios: tuple = (0.1, 0.3, 0.5, 0.7, 0.9)

    def fit(self, df, features, label, fold: str) -> LinearModel:
        every = [(a, r) for r in self.l1_ratios for a in self.alphas]
        m, k, scores = _cross_validated(df, features, label, fold, [ElasticNetRegressor(a, r) for a, r in every])
        m.extra |= {"best_lam": every[k][0], "best_l1_ratio": every[k][1], "scores": scores}
        return m


@dataclass
class BayesianRidge:
    """Evidence maximisation; all iterations run on the sums."""

    max_iter: int = 300
    tol: float = 1e-3
    a: float = 1e-6

    def fit(self, df, features, label) -> LinearModel:
        g = gram(df, features, label)
        A, c, yy = g.centred()
        s, u = np.linalg.eigh(A)
        alpha, lam, old = 1.0 / max(yy / g.n, 1e-300), 1.0, None
        for _ in range(self.max_iter):
            w = u @ ((u.T @ c) / (s + lam / alpha))
            gamma = float((alpha * s / (lam + alpha * s)).sum())
            rss = max(float(yy - 2 * w @ c + w @ A @ w), 0.0)
            lam = (gamma + 2 * self.a) / (float(w @ w) + 2 * self.a)
            alpha = (g.n - gamma + 2 * self.a) / (rss + 2 * self.a)
            if old is not None and np.abs(w - old).sum() < self.tol:
                break
            old = w
        sigma = np.linalg.pinv(alpha * A + lam * np.eye(len(c)))
        return _model(features, g, w, True, alpha=alpha, lam=lam, sigma=sigma.tolist(), mean=g.mean.tolist())


@dataclass
class ARDRegression:
    """One precision a coefficient; those above the threshold are pruned."""

    max_iter: int = 300
    tol: float = 1e-3
    threshold: float = 1e4
    a: float = 1e-6

    def fit(self, df, features, label) -> LinearModel:
        g = gram(df, features, label)
        A, c, yy = g.centred()
        d = len(c)
        alpha, lam, w, old = 1.0 / max(yy / g.n, 1e-300), np.ones(d), np.zeros(d), None
        keep = np.ones(d, bool)
        sigma = np.zeros((d, d))
        for _ in range(self.max_iter):
            i = np.flatnonzero(keep)
            S = np.linalg.pinv(alpha * A[np.ix_(i, i)] + np.diag(lam[i]))
            w = np.zeros(d)
            w[i] = alpha * S @ c[i]
            sigma = np.zeros((d, d))
            sigma[np.ix_(i, i)] = S
            gamma = 1 - lam[i] * np.diag(S)
            rss = max(float(yy - 2 * w @ c + w @ A @ w), 0.0)
            lam[i] = (gamma + 2 * self.a) / (w[i] ** 2 + 2 * self.a)
            alpha = (g.n - gamma.sum() + 2 * self.a) / (rss + 2 * self.a)
            keep = lam < self.threshold
            w[~keep] = 0
            if old is not None and np.abs(w - old).sum() < self.tol:
                break
            old = w.copy()
        return _model(features, g, w, True, alpha=alpha, lam=lam.tolist(), sigma=sigma.tolist(), mean=g.mean.tolist())


def _path(A: np.ndarray, c: np.ndarray, scale: np.ndarray, lasso: bool, steps: int):
    """Least-angle path on standardised sums: list of (largest correlation, coefficients)."""
    A, c = A / np.outer(scale, scale), c / scale
    d = len(c)
    w, active, out = np.zeros(d), [], [(float(np.abs(c).max(initial=0)), np.zeros(d))]
    for _ in range(8 * d if lasso else d):
        r = c - A @ w
        top = np.abs(r).max()
        if top < 1e-12 or (not lasso and len(active) == min(steps, d)):
            break
        for j in range(d):
            if j not in active and abs(abs(r[j]) - top) < 1e-9 * max(1, top) and len(active) < steps:
                active.append(j)
        if not active:
            break
        s = np.sign(r[active])
        u = solve(A[np.ix_(active, active)], s)
        slope = A[:, active] @ u
        gamma, leave = top, None
        for j in set(range(d)) - set(active):
            for g in ((top - r[j]) / (1 - slope[j]) if slope[j] != 1 else -1, (top + r[j]) / (1 + slope[j]) if slope[j] != -1 else -1):
                if 1e-12 < g < gamma:
                    gamma = g
        if lasso:
            for i, j in enumerate(active):
                g = -w[j] / u[i] if u[i] != 0 else -1
                if 1e-12 < g < gamma:
                    gamma, leave = g, j
        w = w.copy()
        w[active] += gamma * u
        if leave is not None:
            w[leave] = 0.0
            active.remove(leave)
        out.append((top - gamma, w / scale))
        if gamma == top:
            break
    return out


def _scales(A: np.ndarray) -> np.ndarray:
    s = np.sqrt(np.diag(A))
    return np.where(s > 0, s, 1.0)


@dataclass
class Lars:
    n_nonzero: int = 500

    def fit(self, df, features, label) -> LinearModel:
        g = gram(df, features, label)
        A, c, _ = g.centred()
        return _model(features, g, _path(A, c, _scales(A), False, self.n_nonzero)[-1][1], True)


@dataclass
class LassoLars:
    """The lasso path stopped where the largest correlation, over the number of rows, meets alpha."""

    alpha: float = 1.0

    def fit(self, df, features, label) -> LinearModel:
        g = gram(df, features, label)
        A, c, _ = g.centred()
        path, want = _path(A, c, np.ones(len(c)), True, len(c)), self.alpha * g.n
        w = path[-1][1] if path[-1][0] > want else np.zeros(len(c))
        for (a, u), (b, v) in zip(path[:-1], path[1:], strict=True):
            if b <= want <= a:
                w = u + (v - u) * ((a - want) / (a - b) if a > b else 0)
                break
        return _model(features, g, w, True)


@dataclass
class LassoLarsIC:
    """The point of the path with the least n ln(rss / n) + k (2, or ln n for ``bic``)."""

    criterion: str = "aic"

    def fit(self, df, features, label) -> LinearModel:
        if self.criterion not in ("aic", "bic"):
            raise InvalidParameter(self.criterion)
        g = gram(df, features, label)
        A, c, yy = g.centred()
        best, at = None, np.inf
        for _, w in _path(A, c, np.ones(len(c)), True, len(c)):
            rss = max(float(yy - 2 * w @ c + w @ A @ w), 1e-300)
            cost = g.n * np.log(rss / g.n) + (2 if self.criterion == "aic" else np.log(g.n)) * int((np.abs(w) > 1e-12).sum())
            if cost < at:
                best, at = w, cost
        return _model(features, g, best, True, criterion=float(at))


@dataclass
class OrthogonalMatchingPursuit:
    """Greedy choice by correlation, least squares refit; ``tol`` is compared with the squared residual norm."""

    n_nonzero: int | None = None
    tol: float | None = None

    def fit(self, df, features, label) -> LinearModel:
        g = gram(df, features, label)
        A, c, yy = g.centred()
        d, scale, active, w = len(c), _scales(A), [], np.zeros(len(c))
        most = self.n_nonzero or (d if self.tol is not None else max(1, int(np.ceil(0.1 * d))))
        while len(active) < min(most, d):
            r = np.abs(c - A @ w) / scale
            r[active] = -1
            active.append(int(r.argmax()))
            w = np.zeros(d)
            w[active] = solve(A[np.ix_(active, active)], c[active])
            if self.tol is not None and yy - 2 * w @ c + w @ A @ w <= self.tol:
                break
        return _model(features, g, w, True)


@dataclass
class PrincipalModel(Model):
    """Projection on components after centring."""

    features: list[str]
    mean: np.ndarray
    components: np.ndarray
    values: np.ndarray

    def transform(self, df: DataFrame, prefix: str = "pc_") -> DataFrame:
        require(df, self.features)
        return df.withColumns({f"{prefix}{k}": linear_form(self.features, v, -float(v @ self.mean)) for k, v in enumerate(self.components)})

    def inverse_transform(self, df: DataFrame, prefix: str = "pc_") -> DataFrame:
        names = [f"{prefix}{k}" for k in range(len(self.components))]
        return df.withColumns({c: linear_form(names, self.components[:, j], float(self.mean[j])) for j, c in enumerate(self.features)})


def _signed(v: np.ndarray) -> np.ndarray:
    """Component signs by the dot product with (1, 2, ..., d)."""
    s = np.sign(v @ np.arange(1, v.shape[1] + 1))
    return v * np.where(s == 0, 1, s)[:, None]


@dataclass
class PCA:
    n_components: int

    def fit(self, df, features) -> PrincipalModel:
        g = gram(df, features)
        if not 1 <= self.n_components <= len(features):
            raise InvalidParameter("n_components")
        s, u = np.linalg.eigh(g.covariance(1))
        order = np.argsort(-s)[: self.n_components]
        return PrincipalModel(features, g.mean, _signed(u[:, order].T), s[order])


@dataclass
class TruncatedSVD:
    n_components: int

    def fit(self, df, features) -> PrincipalModel:
        g = gram(df, features)
        s, u = np.linalg.eigh(g.sxx)
        order = np.argsort(-s)[: self.n_components]
        return PrincipalModel(features, np.zeros(len(features)), _signed(u[:, order].T), np.sqrt(np.maximum(s[order], 0)))


@dataclass
class PLSRegression:
    """One-target NIPALS on population-standardised columns, by deflating the sums."""

    n_components: int = 2

    def fit(self, df, features, label) -> LinearModel:
        g = gram(df, features, label)
        A, c, yy = g.centred()
        sx, sy = np.sqrt(np.diag(A) / g.n), np.sqrt(yy / g.n)
        sx = np.where(sx > 1e-15, sx, 1.0)
        sy = sy if sy > 1e-15 else 1.0
        S, r = A / np.outer(sx, sx), c / (sx * sy)
        W, P, Q = [], [], []
        for _ in range(min(self.n_components, len(c))):
            norm = np.linalg.norm(r)
            if norm < 1e-12:
                break
            w = r / norm
            tt = float(w @ S @ w)
            p, q = S @ w / tt, float(w @ r) / tt
            S = S - tt * np.outer(p, p)
            r = r - tt * p * q
            W.append(w)
            P.append(p)
            Q.append(q)
        if not W:
            return _model(features, g, np.zeros(len(c)), True)
        W, P = np.array(W).T, np.array(P).T
        b = W @ solve(P.T @ W, np.array(Q))
        return _model(features, g, b * sy / sx, True)


@dataclass
class CCAModel(Model):
    x: PrincipalModel
    y: PrincipalModel
    correlations: np.ndarray

    def transform_x(self, df):
        return self.x.transform(df, "cx_")

    def transform_y(self, df):
        return self.y.transform(df, "cy_")


@dataclass
class CCA:
    n_components: int = 2
    reg: float = 1e-9

    def fit(self, df, x: list[str], y: list[str]) -> CCAModel:
        g = gram(df, [*x, *y])
        C, p = g.covariance(1), len(x)

        def root(m):
            s, u = np.linalg.eigh(m + self.reg * np.eye(len(m)))
            return u @ np.diag(1 / np.sqrt(np.maximum(s, 1e-12))) @ u.T

        wx, wy = root(C[:p, :p]), root(C[p:, p:])
        u, s, v = np.linalg.svd(wx @ C[:p, p:] @ wy)
        k = self.n_components
        return CCAModel(PrincipalModel(x, g.mean[:p], (wx @ u[:, :k]).T, s[:k]), PrincipalModel(y, g.mean[p:], (wy @ v[:k].T).T, s[:k]), s[:k])
