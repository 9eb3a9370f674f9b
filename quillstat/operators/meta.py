"""Models of models: voting, stacking, calibration, several targets, transformed targets.

A base learner is an estimator whose ``fit(df, features, label)`` gives a model with ``transform(df, output)``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import InvalidParameter, Model
from ..functions.numeric import sigmoid
from . import glm


def _each(models: list[Model], df: DataFrame, prefix: str) -> tuple[DataFrame, list[str]]:
    names = [f"{prefix}{k}" for k in range(len(models))]
    for m, n in zip(models, names, strict=True):
        df = m.transform(df, n)
    return df, names


@dataclass
class Voting(Model):
    models: list
    weights: list[float] | None = None
    hard: bool = True

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        out, names = _each(self.models, df, "__v")
        w = self.weights or [1.0] * len(names)
        if self.hard:
            # The label with the most weight; ties to the smallest.
            votes = F.array(*[F.struct(F.col(n).alias("y"), F.lit(float(x)).alias("w")) for n, x in zip(names, w, strict=True)])
            total = F.transform(votes, lambda v: F.struct((-F.aggregate(F.filter(votes, lambda u: u["y"] == v["y"]), F.lit(0.0), lambda a, u: a + u["w"])).alias("w"), v["y"].alias("y")))
            value = F.array_min(total)["y"]
        else:
            value = sum((F.col(n) * float(x) for n, x in zip(names, w, strict=True)), F.lit(0.0)) / float(sum(w))
        return out.withColumn(output, value).drop(*names)


@dataclass
class VotingClassifier:
    bases: list
    weights: list[float] | None = None

    def fit(self, df, features, label) -> Voting:
        return Voting([b.fit(df, features, label) for b in self.bases], self.weights, True)


@dataclass
class VotingRegressor:
    bases: list
    weights: list[float] | None = None

    def fit(self, df, features, label) -> Voting:
        return Voting([b.fit(df, features, label) for b in self.bases], self.weights, False)


@dataclass
class Stack(Model):
    models: list
    meta: Model

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        out, names = _each(self.models, df, "stack_")
        return self.meta.transform(out, output).drop(*names)


@dataclass
class StackingRegressor:
    """Out-of-fold predictions of the bases train the meta learner; bases are then fitted on all rows."""

    bases: list
    meta: object

    def fit(self, df: DataFrame, features: list[str], label: str, fold: str) -> Stack:
        parts = []
        for k in sorted(r[0] for r in df.select(fold).distinct().collect()):
            train = df.filter(F.col(fold) != k)
            out, names = _each([b.fit(train, features, label) for b in self.bases], df.filter(F.col(fold) == k), "stack_")
            parts.append(out)
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return Stack([b.fit(df, features, label) for b in self.bases], self.meta.fit(every, names, label))


@dataclass
class StackingClassifier(StackingRegressor):
    pass


@dataclass
class Calibrated(Model):
    base: Model
    kind: str
    a: float = 0.0
    b: float = 0.0
    steps: glm.StepModel | None = None

    def transform(self, df: DataFrame, output: str = "prediction", probability: str = "probability") -> DataFrame:
        out = self.base.transform(df, "__s")
        if self.kind == "sigmoid":
            out = out.withColumn(probability, sigmoid(F.col("__s") * self.a + self.b))
        else:
            out = self.steps.transform(out, probability)
        return out.withColumn(output, (F.col(probability) >= 0.5).cast("double")).drop("__s")


@dataclass
class CalibratedClassifierCV:
    """Out-of-fold predictions of the base are the scores; a logistic curve or isotonic steps make probabilities."""

    base: object
    method: str = "sigmoid"

    def fit(self, df: DataFrame, features: list[str], label: str, fold: str) -> Calibrated:
        if self.method not in ("sigmoid", "isotonic"):
            raise InvalidParameter(self.method)
        every = None
        for k in sorted(r[0] for r in df.select(fold).distinct().collect()):
            part = self.base.fit(df.filter(F.col(fold) != k), features, label).transform(df.filter(F.col(fold) == k), "__s")
            every = part if every is None else every.unionByName(part)
        base = self.base.fit(df, features, label)
        if self.method == "isotonic":
            return Calibrated(base, "isotonic", steps=glm.IsotonicRegressor().fit(every, "__s", label))
        m = glm.LogisticRegressor(lam=1e-3).fit(every, ["__s"], label)
        return Calibrated(base, "sigmoid", float(m.coef[0]), m.intercept)


@dataclass
class MultiOutput(Model):
    models: list
    outputs: list[str]
    chain: bool = False

    def transform(self, df: DataFrame, prefix: str = "prediction_") -> DataFrame:
        """In a chain, earlier predictions stand in for the targets the later models were trained on."""
        for m, y in zip(self.models, self.outputs, strict=True):
            df = m.transform(df, f"{prefix}{y}")
        return df


@dataclass
class MultiOutputRegressor:
    base: object

    def fit(self, df: DataFrame, features: list[str], labels: list[str]) -> MultiOutput:
        return MultiOutput([self.base.fit(df, features, y) for y in labels], labels)


@dataclass
class MultiOutputClassifier(MultiOutputRegressor):
    pass


@dataclass
class RegressorChain:
    base: object

    def fit(self, df: DataFrame, features: list[str], labels: list[str], prefix: str = "prediction_") -> MultiOutput:
        models, use = [], list(features)
        for y in labels:
            models.append(self.base.fit(df, use, y))
            df, use = df.withColumn(f"{prefix}{y}", F.col(y)), [*use, f"{prefix}{y}"]
        return MultiOutput(models, labels, True)


@dataclass
class ClassifierChain(RegressorChain):
    pass


@dataclass
class TransformedTargetRegressor:
    """The base is fitted on func(target); predictions go through inverse_func."""

    base: object
    func: Callable[[Column], Column] = field(default=lambda c: c)
    inverse_func: Callable[[Column], Column] = field(default=lambda c: c)
    check_inverse: bool = True

    def fit(self, df: DataFrame, features: list[str], label: str):
        if self.check_inverse:
            off = df.agg(F.max(F.abs(self.inverse_func(self.func(F.col(label))) - F.col(label)) / (1 + F.abs(F.col(label))))).first()[0]
            if off is not None and off > 1e-6:
                raise InvalidParameter("inverse_func does not undo func")
        model, back = self.base.fit(df.withColumn("__t", self.func(F.col(label))), features, "__t"), self.inverse_func

        class Fitted:
            def transform(self, data: DataFrame, output: str = "prediction") -> DataFrame:
                return model.transform(data, output).withColumn(output, back(F.col(output)))

        return Fitted()
