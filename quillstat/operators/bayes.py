"""Naive Bayes classifiers: class sums by one grouped aggregate, prediction as one expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import EmptyInput, InvalidParameter, Model, num, require
from ..functions import numeric


class JointModel(Model):
    """Argmax of per-class joint log-likelihood expressions; ties go to the lowest label."""

    features: list[str]
    labels: list

    def joint(self) -> list[Column]:
        raise NotImplementedError

    def transform(self, df: DataFrame, output: str = "prediction", probability: str | None = None, log_probability: str | None = None) -> DataFrame:
        require(df, self.features)
        out = df.withColumn("__joint", F.array(*self.joint()))
        place = F.array_position("__joint", F.array_max("__joint")).cast("int")
        out = out.withColumn(output, F.element_at(F.array(*[F.lit(x) for x in self.labels]), place))
        parts = [F.col("__joint")[k] for k in range(len(self.labels))]
        if probability:
            out = out.withColumn(probability, F.array(*numeric.softmax(parts)))
        if log_probability:
            out = out.withColumn(log_probability, F.array(*[F.ln(p) for p in numeric.softmax(parts)]))
        return out.drop("__joint")


@dataclass
class GaussianState(JointModel):
    """(count, mean, variance) by class; states of parts of the data merge into the state of all."""

    features: list[str]
    labels: list
    count: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    smoothing: float = 1e-9

    def joint(self) -> list[Column]:
        prior = np.log(self.count / self.count.sum())
        out = []
        for k in range(len(self.labels)):
            x = F.lit(float(prior[k]))
            for j, c in enumerate(self.features):
                v = float(self.var[k, j] + self.smoothing)
                d = F.col(f"`{c}`").cast("double") - float(self.mean[k, j])
                x = x - 0.5 * float(np.log(2 * np.pi * v)) - d * d / (2 * v)
            out.append(x)
        return out

    def merge(self, other: GaussianState) -> GaussianState:
        """Pairwise update of counts, means and sums of squares."""
        labels = sorted(set(self.labels) | set(other.labels))
        n, m, s = np.zeros(len(labels)), np.zeros((len(labels), len(self.features))), np.zeros((len(labels), len(self.features)))
        for state in (self, other):
            for k, y in enumerate(state.labels):
                i = labels.index(y)
                total = n[i] + state.count[k]
                d = state.mean[k] - m[i]
                s[i] += state.var[k] * state.count[k] + d * d * n[i] * state.count[k] / total
                m[i] += d * state.count[k] / total
                n[i] = total
        return GaussianState(self.features, labels, n, m, s / n[:, None], self.smoothing)


@dataclass
class GaussianNB:
    """Variances get 1e-9 added, absolutely. ``weight`` names a column of row weights."""

    smoothing: float = 1e-9

    def fit(self, df: DataFrame, features: list[str], label: str, weight: str | None = None) -> GaussianState:
        require(df, [*features, label])
        w = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
        first = df.groupBy(F.col(f"`{label}`").alias("y")).agg(
            F.sum(w).alias("n"), *[(F.sum(w * num(c)) / F.sum(w)).alias(f"m{j}") for j, c in enumerate(features)],
            *[(F.var_pop(num(c)) if not weight else F.greatest(F.sum(w * num(c) * num(c)) / F.sum(w) - F.pow(F.sum(w * num(c)) / F.sum(w), F.lit(2)), F.lit(0.0))).alias(f"v{j}") for j, c in enumerate(features)],
        )
        rows = sorted(first.filter("y IS NOT NULL").collect(), key=lambda r: r["y"])
        if not rows:
            raise EmptyInput("no labelled rows")
        each = range(len(features))
        return GaussianState(
            features, [r["y"] for r in rows], np.array([r["n"] for r in rows], float),
            np.array([[r[f"m{j}"] for j in each] for r in rows], float), np.array([[r[f"v{j}"] for j in each] for r in rows], float), self.smoothing,
        )

    def partial_fit(self, state: GaussianState | None, df: DataFrame, features: list[str], label: str) -> GaussianState:
        new = self.fit(df, features, label)
        return state.merge(new) if state else new


@dataclass
class LinearJoint(JointModel):
    """Joint log-likelihoods that are linear in (possibly binarized) features."""

    features: list[str]
    labels: list
    bias: list[float]
    weights: list[list[float]]
    binarize: float | None = None

    def joint(self) -> list[Column]:
        xs = [F.col(f"`{c}`").cast("double") for c in self.features]
        if self.binarize is not None:
            xs = [F.when(x > self.binarize, 1.0).otherwise(0.0) for x in xs]
        out = []
        for b, w in zip(self.bias, self.weights, strict=True):
            x = F.lit(float(b))
            for v, c in zip(w, xs, strict=True):
                x = x + c * float(v)
            out.append(x)
        return out


def _class_sums(df: DataFrame, features: list[str], label: str, values: list[Column]):
    rows = df.groupBy(F.col(f"`{label}`").alias("y")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"s{j}") for j, v in enumerate(values)], *[F.min(num(c)).alias(f"l{j}") for j, c in enumerate(features)])
    rows = sorted(rows.filter("y IS NOT NULL").collect(), key=lambda r: r["y"])
    if not rows:
        raise EmptyInput("no labelled rows")
    each = range(len(features))
    return [r["y"] for r in rows], np.array([r["n"] for r in rows], float), np.array([[r[f"s{j}"] for j in each] for r in rows], float), min(r[f"l{j}"] for r in rows for j in each)


@dataclass
class MultinomialNB:
    alpha: float = 1.0

    def fit(self, df: DataFrame, features: list[str], label: str) -> LinearJoint:
        require(df, [*features, label])
        labels, n, s, low = _class_sums(df, features, label, [num(c) for c in features])
        if low < 0:
            raise InvalidParameter("negative counts")
        w = np.log((s + self.alpha) / (s.sum(axis=1, keepdims=True) + self.alpha * len(features)))
        return LinearJoint(features, labels, np.log(n / n.sum()).tolist(), w.tolist())


@dataclass
class BernoulliNB:
    alpha: float = 1.0
    binarize: float = 0.0

    def fit(self, df: DataFrame, features: list[str], label: str) -> LinearJoint:
        require(df, [*features, label])
        labels, n, s, _ = _class_sums(df, features, label, [F.when(num(c) > self.binarize, 1.0).otherwise(0.0) for c in features])
        p = (s + self.alpha) / (n[:, None] + 2 * self.alpha)
        bias = np.log(n / n.sum()) + np.log(1 - p).sum(axis=1)
        return LinearJoint(features, labels, bias.tolist(), (np.log(p) - np.log(1 - p)).tolist(), self.binarize)
