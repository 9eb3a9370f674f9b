"""Linear and quadratic discriminants from sums by class."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from ..core import ArrayModel, InvalidParameter
from .linear import Gram, PrincipalModel, grams


@dataclass
class GaussianDiscriminant(ArrayModel):
    features: list[str]
    labels: list
    log_prior: np.ndarray
    means: np.ndarray
    precisions: np.ndarray
    log_dets: np.ndarray

    def decision(self, x: np.ndarray) -> np.ndarray:
        out = []
        for k in range(len(self.labels)):
            d = x - self.means[k]
            out.append(self.log_prior[k] - 0.5 * self.log_dets[k] - 0.5 * np.einsum("ij,jk,ik->i", d, self.precisions[k], d))
        return np.column_stack(out)

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        z = self.decision(x)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict_array(self, x: np.ndarray) -> np.ndarray:
        """The class's position among the sorted labels; transform() maps it back."""
        return self.decision(x).argmax(axis=1)

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        from pyspark.sql import functions as F

        out = super().transform(df, "__k")
        return out.withColumn(output, F.element_at(F.array(*[F.lit(x) for x in self.labels]), F.col("__k").cast("int") + 1)).drop("__k")


def _classes(df, features, label) -> tuple[list, list[Gram]]:
    parts = {k: g for k, g in grams(df, features, by=label).items() if k is not None}
    labels = sorted(parts)
    if len(labels) < 2:
        raise InvalidParameter("fewer than two classes")
    kept = df.schema[label].dataType.typeName()
    cast = {"double": float, "float": float, "integer": int, "long": int, "short": int}.get(kept, str)
    labels = sorted(labels, key=cast)
    return [cast(x) for x in labels], [parts[x] for x in labels]


@dataclass
class LinearDiscriminantAnalysis:
    """Pooled covariance over n - K (optionally shrunk towards its mean diagonal) plus 1e-9."""

    shrinkage: float | None = None
    reg: float = 1e-9

    def fit(self, df: DataFrame, features: list[str], label: str) -> GaussianDiscriminant:
        labels, gs = _classes(df, features, label)
        n, d = sum(g.n for g in gs), len(features)
        pooled = sum(g.covariance(0) * g.n for g in gs) / max(n - len(gs), 1)
        if self.shrinkage:
            pooled = (1 - self.shrinkage) * pooled + self.shrinkage * np.trace(pooled) / d * np.eye(d)
        p = np.linalg.pinv(pooled + self.reg * np.eye(d))
        k = len(gs)
        model = GaussianDiscriminant(features, labels, np.log([g.n / n for g in gs]), np.array([g.mean for g in gs]), np.array([p] * k), np.zeros(k))
        self._axes(model, gs, pooled + self.reg * np.eye(d), n)
        return model

    def _axes(self, model, gs, within, n) -> None:
        mean = sum(g.sx for g in gs) / n
        between = sum(g.n * np.outer(g.mean - mean, g.mean - mean) for g in gs) / n
        s, u = np.linalg.eigh(within)
        root = u @ np.diag(1 / np.sqrt(np.maximum(s, 1e-12))) @ u.T
        v, w = np.linalg.eigh(root @ between @ root)
        order = np.argsort(-v)[: min(len(gs) - 1, len(mean))]
        self.projection = PrincipalModel(model.features, mean, (root @ w[:, order]).T, v[order])


@dataclass
class QuadraticDiscriminantAnalysis:
    reg: float = 1e-9

    def fit(self, df: DataFrame, features: list[str], label: str) -> GaussianDiscriminant:
        labels, gs = _classes(df, features, label)
        n, d = sum(g.n for g in gs), len(features)
        cov = [g.covariance(1) + self.reg * np.eye(d) for g in gs]
        return GaussianDiscriminant(features, labels, np.log([g.n / n for g in gs]), np.array([g.mean for g in gs]), np.array([np.linalg.pinv(c) for c in cov]), np.array([np.linalg.slogdet(c)[1] for c in cov]))
