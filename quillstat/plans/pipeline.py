"""Chaining transformers and estimators; each fit is a job, each transform a lazy column expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..core import InvalidParameter, NotFitted


@dataclass
class FittedPipeline:
    steps: list[tuple[str, object]]
    estimator: object | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        for _, s in self.steps:
            df = s.transform(df)
        return df

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        if self.estimator is None:
            raise NotFitted("no estimator")
        return self.estimator.transform(self.transform(df), output)

    def step(self, name: str):
        for n, s in self.steps:
            if n == name:
                return s
        raise InvalidParameter(name)


@dataclass
class Pipeline:
    steps: list[tuple[str, object]] = field(default_factory=list)
    estimator: object | None = None

    def push_transformer(self, name: str, step) -> Pipeline:
        self.steps.append((name, step))
        return self

    def set_estimator(self, estimator) -> Pipeline:
        self.estimator = estimator
        return self

    def fit(self, df: DataFrame, features: list[str], label: str | None = None) -> FittedPipeline:
        done = []
        for name, s in self.steps:
            m = s.fit(df, features) if hasattr(s, "fit") else Stateless(s, features)
            df = m.transform(df)
            done.append((name, m))
        return FittedPipeline(done, self.estimator.fit(df, features, label) if self.estimator else None)


@dataclass
class Stateless:
    step: object
    features: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.step.transform(df, self.features)


@dataclass
class FunctionTransformer:
    """A stateless function of the whole frame."""

    func: Callable[[DataFrame], DataFrame]

    def fit(self, df: DataFrame, features: list[str] | None = None) -> FunctionTransformer:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.transform(self.func)


@dataclass
class ColumnTransformer:
    """Branches on column subsets, outputs named branch__column in branch order; other columns drop or pass through."""

    branches: list[tuple[str, object, list[str]]]
    remainder: str = "drop"

    def fit(self, df: DataFrame, features: list[str]) -> FittedColumns:
        if self.remainder not in ("drop", "passthrough"):
            raise InvalidParameter(self.remainder)
        fitted = [(n, t.fit(df, cols) if hasattr(t, "fit") else Stateless(t, cols), cols) for n, t, cols in self.branches]
        used = {c for _, _, cols in self.branches for c in cols}
        return FittedColumns(fitted, [c for c in features if c not in used] if self.remainder == "passthrough" else [])


@dataclass
class FittedColumns:
    branches: list
    rest: list[str]

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Transforms see copies of their columns, so that one column may go through several branches."""
        outputs = []
        for name, model, cols in self.branches:
            before = set(df.columns)
            saved = {c: f"__keep_{c}" for c in cols}
            held = df.withColumns({s: df[c] for c, s in saved.items()})
            got = model.transform(held)
            new = [c for c in got.columns if c in cols or c not in before and c not in saved.values()]
            got = got.withColumns({f"{name}__{c}": got[c] for c in new})
            got = got.drop(*[c for c in new if c not in before]).withColumns({c: got[s] for c, s in saved.items()}).drop(*saved.values())
            outputs += [f"{name}__{c}" for c in new]
            df = got
        return df.select(*(keep or []), *outputs, *self.rest)


@dataclass
class FeatureUnion:
    """All transformers on all features, side by side."""

    transformers: list[tuple[str, object]]

    def fit(self, df: DataFrame, features: list[str]) -> FittedColumns:
        return ColumnTransformer([(n, t, features) for n, t in self.transformers]).fit(df, features)


def select_rows(df: DataFrame, id_col: str, wanted: DataFrame) -> DataFrame:
    """The rows whose id is in ``wanted``."""
    return df.join(wanted.select(id_col).distinct(), id_col, "left_semi")
