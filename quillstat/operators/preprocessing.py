"""Scalers, encoders, imputation and feature expansion: one aggregate to fit, column expressions to transform."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations, combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import EmptyInput, InvalidParameter, Model, NotFitted, num, require, stats
from ..functions import numeric
from .moments import moments
from .quantiles import exact_quantiles

TINY = 1e-15
#: Columns up to which two aggregates each stay in generated code; more are summed in Arrow batches.
WIDE = 16


def _replaced(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.withColumns(new)


@dataclass
class ScalerModel(Model):
    """(x - center) / scale for each feature, then * gain + shift."""

    features: list[str]
    center: list[float]
    scale: list[float]
    gain: float = 1.0
    shift: float = 0.0

    def transform(self, df: DataFrame) -> DataFrame:
        require(df, self.features)
        return _replaced(df, {c: (F.col(f"`{c}`") - m) / s * self.gain + self.shift for c, m, s in zip(self.features, self.center, self.scale, strict=True)})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return _replaced(df, {c: (F.col(f"`{c}`") - self.shift) / self.gain * s + m for c, m, s in zip(self.features, self.center, self.scale, strict=True)})


@dataclass
class StandardScaler:
    """Mean 0, population deviation 1; a constant column is only centred."""

    def fit(self, df: DataFrame, features: list[str]) -> ScalerModel:
        require(df, features)
        if len(features) > WIDE:
            _, mean, var = moments(df, features)
            dev = np.sqrt(var[:, 0])
            return ScalerModel(features, mean[:, 0].tolist(), [float(s) if s > TINY else 1.0 for s in dev])
        r = stats(df, *[f(num(c)).alias(f"{n}{k}") for k, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
        dev = [r[f"s{k}"] or 0.0 for k in range(len(features))]
        return ScalerModel(features, [r[f"m{k}"] or 0.0 for k in range(len(features))], [s if s > TINY else 1.0 for s in dev])


@dataclass
class MinMaxModel(Model):
    features: list[str]
    low: list[float]
    high: list[float]
    to: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        a, b = self.to
        return _replaced(df, {c: (F.col(f"`{c}`") * 0 + a if h - x <= TINY else (F.col(f"`{c}`") - x) / (h - x) * (b - a) + a) for c, x, h in zip(self.features, self.low, self.high, strict=True)})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        a, b = self.to
        return _replaced(df, {c: (F.col(f"`{c}`") - a) / (b - a) * (h - x) + x for c, x, h in zip(self.features, self.low, self.high, strict=True)})


@dataclass
class MinMaxScaler:
    """To a range; a constant column becomes the range's lower end, and its inverse the constant."""

    feature_min: float = 0.0
    feature_max: float = 1.0

    def fit(self, df: DataFrame, features: list[str]) -> MinMaxModel:
        if self.feature_min >= self.feature_max:
            raise InvalidParameter("feature_min must be below feature_max")
        require(df, features)
        r = stats(df, *[f(num(c)).alias(f"{n}{k}") for k, c in enumerate(features) for n, f in (("a", F.min), ("b", F.max))])
        each = range(len(features))
        return MinMaxModel(features, [r[f"a{k}"] for k in each], [r[f"b{k}"] for k in each], [self.feature_min, self.feature_max])


@dataclass
class MaxAbsScaler:
    def fit(self, df: DataFrame, features: list[str]) -> ScalerModel:
        require(df, features)
        r = stats(df, *[F.max(F.abs(num(c))).alias(f"m{k}") for k, c in enumerate(features)])
        most = [r[f"m{k}"] or 0.0 for k in range(len(features))]
        return ScalerModel(features, [0.0] * len(features), [m if m > TINY else 1.0 for m in most])


def _quantiles(df: DataFrame, features: list[str], shares: list[float]) -> list[list[float]]:
    """Exact quantiles of columns; a column without values is an error."""
    found = exact_quantiles(df, [num(c) for c in features], shares)
    if None in found:
        raise EmptyInput(f"no values in {features[found.index(None)]}")
    return found


@dataclass
class RobustScaler:
    """Median and interquartile range, quantiles interpolated linearly."""

    def fit(self, df: DataFrame, features: list[str]) -> ScalerModel:
        require(df, features)
        q = _quantiles(df, features, [0.25, 0.5, 0.75])
        return ScalerModel(features, [x[1] for x in q], [x[2] - x[0] if x[2] - x[0] > TINY else 1.0 for x in q])


@dataclass
class Normalizer:
    """Each row to unit L1, L2 or largest absolute value; rows of zeros stay."""

    norm: str = "l2"

    def transform(self, df: DataFrame, features: list[str]) -> DataFrame:
        require(df, features)
        xs = [F.col(f"`{c}`").cast("double") for c in features]
        if self.norm == "l1":
            size = sum((F.abs(x) for x in xs[1:]), F.abs(xs[0]))
        elif self.norm == "l2":
            size = F.sqrt(sum((x * x for x in xs[1:]), xs[0] * xs[0]))
        elif self.norm == "max":
            size = F.greatest(*[F.abs(x) for x in xs]) if len(xs) > 1 else F.abs(xs[0])
        else:
            raise InvalidParameter(self.norm)
        return df.withColumns({c: F.when(size <= TINY, x).otherwise(x / F.when(size <= TINY, F.lit(None)).otherwise(size)) for c, x in zip(features, xs, strict=True)})


@dataclass
class Binarizer:
    threshold: float = 0.0

    def transform(self, df: DataFrame, features: list[str]) -> DataFrame:
        require(df, features)
        return df.withColumns({c: F.when(F.col(f"`{c}`") > self.threshold, 1.0).otherwise(0.0) for c in features})


@dataclass
class KBinsModel(Model):
    features: list[str]
    edges: list[list[float]]
    encode: str

    def transform(self, df: DataFrame) -> DataFrame:
        """Bins are open on the right; values outside go to the end bins."""
        bins = {}
        for c, e in zip(self.features, self.edges, strict=True):
            place = sum((F.when(F.col(f"`{c}`") >= x, 1).otherwise(0) for x in e[1:-1]), F.lit(0)).cast("double")
            if self.encode == "ordinal":
                bins[c] = place
            else:
                bins |= {f"{c}_{k}": (place == k).cast("double") for k in range(len(e) - 1)}
        out = df.withColumns(bins)
        return out if self.encode == "ordinal" else out.drop(*self.features)


@dataclass
class KBinsDiscretizer:
    n_bins: int = 5
    strategy: str = "quantile"
    encode: str = "ordinal"

    def fit(self, df: DataFrame, features: list[str]) -> KBinsModel:
        if self.n_bins < 2 or self.strategy not in ("uniform", "quantile") or self.encode not in ("ordinal", "onehot"):
            raise InvalidParameter("n_bins, strategy or encode")
        require(df, features)
        share = [k / self.n_bins for k in range(self.n_bins + 1)]
        if self.strategy == "quantile":
            edges = _quantiles(df, features, share)
        else:
            r = stats(df, *[f(num(c)).alias(f"{n}{k}") for k, c in enumerate(features) for n, f in (("a", F.min), ("b", F.max))])
            edges = [[r[f"a{k}"] + (r[f"b{k}"] - r[f"a{k}"]) * s for s in share] for k in range(len(features))]
        return KBinsModel(features, edges, self.encode)


@dataclass
class PolynomialFeatures:
    """Products up to a degree: bias, then by degree in column order; ``interaction_only`` leaves out powers."""

    degree: int = 2
    interaction_only: bool = False

    def terms(self, n: int) -> list[tuple[int, ...]]:
        pick = combinations if self.interaction_only else combinations_with_replacement
        return [t for d in range(self.degree + 1) for t in pick(range(n), d)]

    def transform(self, df: DataFrame, features: list[str], prefix: str = "poly_") -> DataFrame:
        require(df, features)
        new = {}
        for k, term in enumerate(self.terms(len(features))):
            x = F.lit(1.0)
            for i in term:
                x = x * F.col(f"`{features[i]}`").cast("double")
            new[f"{prefix}{k}"] = x
        return df.withColumns(new)


@dataclass
class PowerModel(Model):
    features: list[str]
    lambdas: list[float]
    scaler: ScalerModel | None

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumns({c: numeric.yeo_johnson(F.col(f"`{c}`").cast("double"), x) for c, x in zip(self.features, self.lambdas, strict=True)})
        return self.scaler.transform(out) if self.scaler else out

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        out = self.scaler.inverse_transform(df) if self.scaler else df
        return out.withColumns({c: numeric.inverse_yeo_johnson(F.col(f"`{c}`"), x) for c, x in zip(self.features, self.lambdas, strict=True)})


def _yeo_johnson(x: np.ndarray, power: float) -> np.ndarray:
    """numeric.yeo_johnson() on an array."""
    up, down = np.log1p(np.maximum(x, 0)), np.log1p(np.maximum(-x, 0))
    above = up if power == 0 else np.expm1(power * up) / power
    below = -down if power == 2 else -np.expm1((2 - power) * down) / (2 - power)
    return np.where(x >= 0, above, below)


@dataclass
class PowerTransformer:
    """Yeo-Johnson with the exponent of a grid from -2 to 2 by 0.1 that has the least negative log-likelihood."""

    standardize: bool = True

    def fit(self, df: DataFrame, features: list[str]) -> PowerModel:
        require(df, features)
        grid = [round(-2 + 0.1 * k, 10) for k in range(41)]
        grid = [0.0 if abs(x) < 1e-9 else x for x in grid]
        # One pass: for every column 41 variances, and the mean log-Jacobian as the last of its sums.
        _, mean, var = moments(df, features, lambda x: np.column_stack([*(_yeo_johnson(x, g) for g in grid), np.sign(x) * np.log1p(np.abs(x))]), len(grid) + 1)
        lambdas = []
        for m, v in zip(mean, var, strict=True):
            cost = [0.5 * np.log(v[k]) - (g - 1) * m[-1] if v[k] > 0 else np.inf for k, g in enumerate(grid)]
            lambdas.append(grid[int(np.argmin(cost))] if min(cost) < np.inf else 1.0)
        model = PowerModel(features, lambdas, None)
        if self.standardize:
            model.scaler = StandardScaler().fit(model.transform(df), features)
        return model


@dataclass
class QuantileModel(Model):
    features: list[str]
    quantiles: list[list[float]]
    output: str

    def transform(self, df: DataFrame) -> DataFrame:
        """Linear interpolation between the two quantiles around a value, found by halving in Arrow batches; a value equal
        to quantiles takes the middle of their places."""
        new = {}
        for c, q in zip(self.features, self.quantiles, strict=True):
            u = _places(np.array(q, float))(F.col(f"`{c}`").cast("double"))
            if self.output == "normal":
                u = numeric.normal_quantile(F.greatest(F.least(u, F.lit(1 - 1e-7)), F.lit(1e-7)))
            new[c] = u
        return df.withColumns(new)


def _places(q: np.ndarray):
    """A column function: where a value lies among sorted quantiles, from 0 to 1."""

    @F.pandas_udf("double")
    def at(v: pd.Series) -> pd.Series:
        x = v.to_numpy(float)
        lo, hi = np.searchsorted(q, x, "left"), np.searchsorted(q, x, "right")
        a = np.clip(lo, 1, len(q) - 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            inside = a - 1 + (x - q[a - 1]) / (q[a] - q[a - 1])
        u = np.where(hi > lo, (lo + hi - 1) / 2.0, inside) / (len(q) - 1)
        u = np.where(x <= q[0], 0.0, np.where(x >= q[-1], 1.0, u))
        return pd.Series(u).where(v.notna().to_numpy(), None)

    return at


@dataclass
class QuantileTransformer:
    n_quantiles: int = 1000
    output: str = "uniform"

    def fit(self, df: DataFrame, features: list[str]) -> QuantileModel:
        if self.output not in ("uniform", "normal"):
            raise InvalidParameter(self.output)
        require(df, features)
        n = max(2, min(self.n_quantiles, df.count()))
        return QuantileModel(features, _quantiles(df, features, [k / (n - 1) for k in range(n)]), self.output)


@dataclass
class ImputerModel(Model):
    features: list[str]
    values: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(num(c), F.lit(v)) for c, v in zip(self.features, self.values, strict=True)})


@dataclass
class SimpleImputer:
    """Nulls and NaN to the mean, median, most frequent value (ties: the smallest) or a constant."""

    strategy: str = "mean"
    fill_value: float = 0.0

    def fit(self, df: DataFrame, features: list[str]) -> ImputerModel:
        require(df, features)
        if self.strategy == "constant":
            return ImputerModel(features, [float(self.fill_value)] * len(features))
        if self.strategy == "mean":
            r = stats(df, *[F.avg(num(c)).alias(f"v{k}") for k, c in enumerate(features)])
            values = [r[f"v{k}"] for k in range(len(features))]
        elif self.strategy == "median":
            values = [q and q[0] for q in exact_quantiles(df, [num(c) for c in features], [0.5])]
        elif self.strategy == "most_frequent":
            long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), num(c).alias("v")) for k, c in enumerate(features)])).alias("x")).select("x.*").filter("v IS NOT NULL")
            best = long.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).groupBy("k").agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("v"))
            got = {r["k"]: r["v"] for r in best.collect()}
            values = [got.get(k) for k in range(len(features))]
        else:
            raise InvalidParameter(self.strategy)
        if None in values:
            if df.isEmpty():
                raise EmptyInput("no rows")
            raise InvalidParameter(f"no values in {features[values.index(None)]}")
        return ImputerModel(features, values)


@dataclass
class OneHotModel(Model):
    features: list[str]
    widths: list[int]

    def transform(self, df: DataFrame) -> DataFrame:
        """A 0/1 column for each code; a code beyond those fitted is an error when rows are read."""
        new = {}
        for c, w in zip(self.features, self.widths, strict=True):
            x = F.when((F.col(f"`{c}`") < 0) | (F.col(f"`{c}`") >= w), F.raise_error(F.lit(f"unseen code in {c}")).cast("int")).otherwise(F.col(f"`{c}`"))
            new |= {f"{c}_{k}": (x == k).cast("double") for k in range(w)}
        return df.withColumns(new)


@dataclass
class OneHotEncoder:
    def fit(self, df: DataFrame, features: list[str]) -> OneHotModel:
        require(df, features)
        r = stats(df, *[F.max(F.col(f"`{c}`")).alias(f"m{k}") for k, c in enumerate(features)])
        return OneHotModel(features, [int(r[f"m{k}"]) + 1 for k in range(len(features))])


@dataclass
class OrdinalModel:
    """Codes as a table (feature, value, code): joined, as vocabularies may be large."""

    features: list[str]
    vocabulary: DataFrame
    small: bool

    def _side(self, c: str) -> DataFrame:
        side = self.vocabulary.filter(F.col("feature") == c).select(F.col("value").alias("__v"), F.col("code").alias("__c"))
        return F.broadcast(side) if self.small else side

    def transform(self, df: DataFrame) -> DataFrame:
        for c in self.features:
            joined = df.join(self._side(c), F.col(f"`{c}`") == F.col("__v"), "left")
            unseen = F.raise_error(F.concat(F.lit(f"unseen value in {c}: "), F.coalesce(F.col(f"`{c}`"), F.lit("null")))).cast("bigint")
            df = joined.withColumn(c, F.coalesce("__c", unseen)).drop("__v", "__c")
        return df

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        for c in self.features:
            joined = df.join(self._side(c), F.col(f"`{c}`") == F.col("__c"), "left")
            df = joined.withColumn(c, F.coalesce("__v", F.raise_error(F.lit(f"unknown code in {c}")))).drop("__v", "__c")
        return df


@dataclass
class OrdinalEncoder:
    """String columns to the rank of each value in byte order."""

    def fit(self, df: DataFrame, features: list[str]) -> OrdinalModel:
        require(df, features)
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("string").alias("value")) for c in features])).alias("x")).select("x.*")
        words = long.filter("value IS NOT NULL").distinct()
        vocabulary = words.withColumn("code", F.row_number().over(Window.partitionBy("feature").orderBy("value")).cast("bigint") - 1)
        if vocabulary.isEmpty():
            raise EmptyInput("no values")
        return OrdinalModel(features, vocabulary, vocabulary.limit(100_001).count() <= 100_000)


@dataclass
class LabelEncoder:
    """One string column to codes; ``classes``, at most ``most`` of them, is known after fit."""

    most: int = 100_000
    model: OrdinalModel | None = field(default=None, repr=False)

    def fit(self, df: DataFrame, column: str) -> OrdinalModel:
        self.model = OrdinalEncoder().fit(df, [column])
        return self.model

    @property
    def classes(self) -> list[str]:
        if self.model is None:
            raise NotFitted("fit first")
        rows = self.model.vocabulary.select("value", "code").limit(self.most + 1).collect()
        if len(rows) > self.most:
            raise InvalidParameter(f"more than {self.most} classes: read model.vocabulary, a table")
        return [r["value"] for r in sorted(rows, key=lambda r: r["code"])]
