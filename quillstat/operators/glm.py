"""Generalised and robust linear models: reweighted sums of products, one pass over the data for each step."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import EmptyInput, InvalidParameter, Model, linear_form, require, summed, vector, wide
from ..functions import numeric
from .isotonic import IsotonicRegressor, StepModel, pava  # noqa: F401
from .linear import LinearModel, solve
from .quantiles import exact_quantiles


def reweighted(df: DataFrame, features: list[str], label: str, step, max_iter: int, tol: float, penalty: float = 0.0, start: np.ndarray | None = None) -> np.ndarray:
    """Coefficients (intercept first) by iteration: ``step(z, y, eta)`` gives weights and working targets of a batch.

    Each round is one pass that sums X'WX and X'Wz in every task and adds them up on executors.
    """
    require(df, [*features, label])
    rows = df.select(vector(features).alias("x"), F.col(f"`{label}`").cast("double").alias("y")).filter("y IS NOT NULL").cache()
    d = len(features) + 1
    b = np.zeros(d) if start is None else start
    try:
        if rows.isEmpty():
            raise EmptyInput("no rows")
        for _ in range(max_iter):

            def sums(batches, b=b):
                total = np.zeros((d, d + 1))
                for part in batches:
                    if not part.num_rows:
                        continue
                    x = np.column_stack([np.ones(part.num_rows), wide(part.column("x"), d - 1)])
                    y = part.column("y").to_numpy()
                    w, z = step(x, y, x @ b)
                    total += (x * w[:, None]).T @ np.column_stack([x, z])
                yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], ["m"])

            m = summed(rows.mapInArrow(sums, "m array<double>")).reshape(d, d + 1)
            a = m[:, :d] + penalty * np.diag([0.0] + [1.0] * (d - 1))
            new = solve(a + 1e-12 * np.eye(d), m[:, d])
            if not np.isfinite(new).all():
                break
            done = np.abs(new - b).max() < tol * max(1.0, np.abs(new).max())
            b = new
            if done:
                break
    finally:
        rows.unpersist()
    return b


@dataclass
class LogisticModel(Model):
    features: list[str]
    coef: np.ndarray
    intercept: float
    threshold: float = 0.5

    def transform(self, df: DataFrame, output: str = "prediction", probability: str = "probability", decision: str = "decision") -> DataFrame:
        z = linear_form(self.features, self.coef, self.intercept)
        p = numeric.sigmoid(z)
        return df.withColumns({decision: z, probability: p, output: F.when(p >= self.threshold, 1.0).otherwise(0.0)})


@dataclass
class LogisticRegressor:
    """Binary 0/1; no penalty unless ``c`` (1 / penalty) or ``lam`` is given."""

    lam: float = 0.0
    c: float | None = None
    threshold: float = 0.5
    max_iter: int = 100
    tol: float = 1e-8

    def fit(self, df, features, label) -> LogisticModel:
        def step(x, y, eta):
            p = 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
            w = np.maximum(p * (1 - p), 1e-10)
            return w, eta + (y - p) / w

        b = reweighted(df, features, label, step, self.max_iter, self.tol, 1 / self.c if self.c else self.lam)
        return LogisticModel(features, b[1:], float(b[0]), self.threshold)


@dataclass
class ExpModel(LinearModel):
    """Predictions through an inverse link: ``log`` or ``logit`` or ``identity``."""

    link: str = "log"

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        z = linear_form(self.features, self.coef, self.intercept)
        return df.withColumn(output, F.exp(z) if self.link == "log" else numeric.sigmoid(z) if self.link == "logit" else z)


@dataclass
class TweedieRegressor:
    """Variance mu^power; log link, or identity when power is 0. ``lam`` is not divided by the number of rows."""

    power: float = 1.5
    lam: float = 0.0
    max_iter: int = 100
    tol: float = 1e-8

    def fit(self, df, features, label) -> ExpModel:
        if 0 < self.power < 1:
            raise InvalidParameter("power")
        if self.power == 0:
            b = reweighted(df, features, label, lambda x, y, e: (np.ones(len(y)), y), 1, self.tol, self.lam)
            return ExpModel(features, b[1:], float(b[0]), {}, "identity")
        mean = df.agg(F.avg(F.col(f"`{label}`").cast("double"))).first()[0]
        if mean is None:
            raise EmptyInput("no rows")

        def step(x, y, eta):
            mu = np.exp(np.clip(eta, -30, 30))
            return mu ** (2 - self.power), eta + (y - mu) / mu

        start = np.zeros(len(features) + 1)
        start[0] = np.log(max(mean, 1e-12))
        b = reweighted(df, features, label, step, self.max_iter, self.tol, self.lam, start)
        return ExpModel(features, b[1:], float(b[0]), {}, "log")


@dataclass
class PoissonRegressor(TweedieRegressor):
    power: float = 1.0


@dataclass
class GammaRegressor(TweedieRegressor):
    power: float = 2.0


@dataclass
class BinomialRegressor:
    max_iter: int = 100

    def fit(self, df, features, label) -> ExpModel:
        m = LogisticRegressor(max_iter=self.max_iter).fit(df, features, label)
        return ExpModel(features, m.coef, m.intercept, {}, "logit")


@dataclass
class HuberRegressor:
    """Huber weights with the residuals' median absolute deviation as scale; rows beyond epsilon are outliers."""

    epsilon: float = 1.35
    alpha: float = 1e-4
    max_iter: int = 50
    tol: float = 1e-6

    def fit(self, df, features, label) -> LinearModel:
        b, scale = reweighted(df, features, label, lambda x, y, e: (np.ones(len(y)), y), 1, 1.0, self.alpha), 1.0
        for _ in range(self.max_iter):
            r = F.abs(F.col(f"`{label}`") - linear_form(features, b[1:], b[0]))
            scale = max(exact_quantiles(df, [r], [0.5])[0][0] / 0.6744897501960817, 1e-12)

            def step(x, y, eta, s=scale):
                u = np.abs(y - eta) / s
                return np.where(u <= self.epsilon, 1.0, self.epsilon / np.maximum(u, 1e-12)), y

            new = reweighted(df, features, label, step, 1, 1.0, self.alpha, b)
            done = np.abs(new - b).max() < self.tol * max(1.0, np.abs(new).max())
            b = new
            if done:
                break
        return LinearModel(features, b[1:], float(b[0]), {"scale": scale, "epsilon": self.epsilon})

    @staticmethod
    def outliers(model: LinearModel, df: DataFrame, label: str, output: str = "outlier") -> DataFrame:
        r = F.abs(F.col(f"`{label}`") - linear_form(model.features, model.coef, model.intercept))
        return df.withColumn(output, r > model.extra["epsilon"] * model.extra["scale"])


@dataclass
class QuantileRegressor:
    """Pinball loss by reweighting residuals, smoothed near zero."""

    quantile: float = 0.5
    max_iter: int = 60
    tol: float = 1e-6

    def fit(self, df, features, label) -> LinearModel:
        if not 0 < self.quantile < 1:
            raise InvalidParameter("quantile")

        def step(x, y, eta):
            r = y - eta
            return np.where(r >= 0, self.quantile, 1 - self.quantile) / np.maximum(np.abs(r), 1e-6), y

        start = reweighted(df, features, label, lambda x, y, e: (np.ones(len(y)), y), 1, 1.0)
        b = reweighted(df, features, label, step, self.max_iter, self.tol, start=start)
        return LinearModel(features, b[1:], float(b[0]))
