"""Choosing features: by variance, mutual information, univariate scores, importances, elimination."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import InvalidParameter, Model, num, require, stats


@dataclass
class Selected(Model):
    """The kept features, in their old order, and the score of each candidate."""

    features: list[str]
    candidates: list[str]
    scores: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in self.candidates if c not in self.features])


def _long(df: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    """(feature number, value[, y]): the frame unpivoted."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), num(c).alias("v")) for k, c in enumerate(features)])).alias("x")
    return df.select(*([F.col(f"`{label}`").alias("y")] if label else []), cells).select(*(["y"] if label else []), "x.*")


def _top(features: list[str], scores: list[float], k: int) -> Selected:
    best = sorted(range(len(features)), key=lambda i: (-scores[i], i))[:k]
    return Selected([features[i] for i in sorted(best)], features, scores)


@dataclass
class VarianceThreshold:
    threshold: float = 0.0

    def fit(self, df: DataFrame, features: list[str]) -> Selected:
        require(df, features)
        r = stats(df, *[F.var_pop(num(c)).alias(f"v{k}") for k, c in enumerate(features)])
        v = [r[f"v{k}"] or 0.0 for k in range(len(features))]
        keep = [c for c, x in zip(features, v, strict=True) if x > self.threshold]
        if not keep:
            raise InvalidParameter("no feature varies enough")
        return Selected(keep, features, v)


def mutual_information(df: DataFrame, features: list[str], label: str, bins: int = 10) -> DataFrame:
    """(k, mi): plug-in mutual information in nats of each feature, in equal-width bins, with the label."""
    long = _long(df, features, label).filter("v IS NOT NULL")
    ends = long.groupBy("k").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count(F.lit(1)).cast("double").alias("n"))
    cell = F.when(F.col("b") <= F.col("a"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("a")) / F.nullif(F.col("b") - F.col("a"), F.lit(0.0)) * bins), F.lit(bins - 1)))
    joint = long.join(F.broadcast(ends), "k").groupBy("k", "n", "y", cell.alias("c")).agg(F.count(F.lit(1)).cast("double").alias("m"))
    by_y = joint.groupBy("k", "y").agg(F.sum("m").alias("my"))
    by_c = joint.groupBy("k", "c").agg(F.sum("m").alias("mc"))
    return joint.join(by_y, ["k", "y"]).join(by_c, ["k", "c"]).groupBy("k").agg(F.greatest(F.lit(0.0), F.sum(F.expr("m / n * ln(m * n / (my * mc))"))).alias("mi"))


@dataclass
class MutualInformationSelector:
    k: int = 10
    bins: int = 10

    def fit(self, df: DataFrame, features: list[str], label: str) -> Selected:
        require(df, [*features, label])
        got = {r["k"]: r["mi"] for r in mutual_information(df, features, label, self.bins).collect()}
        return _top(features, [got.get(k, 0.0) for k in range(len(features))], self.k)


def f_classif(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(k, f): one-way ANOVA F of each feature over the classes; 1e12 where classes differ but don't vary within."""
    g = _long(df, features, label).groupBy("k", "y").agg(F.count("v").cast("double").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    t = g.groupBy("k").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("c"), (F.sum(F.expr("n * m")) / F.sum("n")).alias("mean"), F.sum(F.expr("n * s")).alias("within"))
    between = g.join(t, "k").groupBy("k").agg(F.sum(F.expr("n * (m - mean) * (m - mean)")).alias("between"))
    f = F.expr("CASE WHEN within < 1e-15 THEN CASE WHEN between > 1e-15 THEN 1e12 ELSE 0D END ELSE (between / (c - 1)) / (nullif(within, 0D) / (total - c)) END")
    return t.join(between, "k").select("k", f.alias("f"))


def f_regression(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(k, f): r^2 (n - 2) / (1 - r^2) of each feature with the target."""
    r = _long(df, features, label).groupBy("k").agg(F.corr("v", "y").alias("r"), F.count("v").alias("n"))
    return r.select("k", F.expr("CASE WHEN r IS NULL THEN 0D WHEN 1 - r * r < 1e-15 THEN 1e12 ELSE r * r * (n - 2) / (1 - r * r) END").alias("f"))


@dataclass
class SelectKBest:
    """score: ``f_classif``, ``f_regression`` or ``variance``; ties keep the earlier feature."""

    k: int = 10
    score: str = "f_classif"

    def fit(self, df: DataFrame, features: list[str], label: str | None = None) -> Selected:
        require(df, [*features, *([label] if label else [])])
        if self.score == "variance":
            r = stats(df, *[F.var_pop(num(c)).alias(f"v{k}") for k, c in enumerate(features)])
            return _top(features, [r[f"v{k}"] or 0.0 for k in range(len(features))], self.k)
        if self.score not in ("f_classif", "f_regression") or not label:
            raise InvalidParameter(f"{self.score} needs a label")
        got = {r["k"]: r["f"] for r in (f_classif if self.score == "f_classif" else f_regression)(df, features, label).collect()}
        return _top(features, [got.get(k) or 0.0 for k in range(len(features))], self.k)


@dataclass
class SelectFromModel:
    """Features whose importance reaches the threshold, of those at most max_features."""

    threshold: float = 0.0
    max_features: int | None = None

    def fit(self, features: list[str], importances) -> Selected:
        s = [float(x) for x in importances]
        keep = sorted((i for i in range(len(s)) if s[i] >= self.threshold), key=lambda i: (-s[i], i))[: self.max_features]
        return Selected([features[i] for i in sorted(keep)], features, s)


Importance = Callable[[DataFrame, list[str]], list[float]]


@dataclass
class RFE:
    """Drops the ``step`` features of least absolute importance until n are left; ranking as the number active when dropped."""

    n_features: int
    step: int = 1

    def fit(self, df: DataFrame, features: list[str], importance: Importance) -> Selected:
        if not 1 <= self.n_features <= len(features) or self.step < 1:
            raise InvalidParameter("n_features or step")
        active, rank = list(features), dict.fromkeys(features, 1.0)
        while len(active) > self.n_features:
            w = [abs(x) for x in importance(df, active)]
            worst = sorted(range(len(active)), key=lambda i: (w[i], i))[: min(self.step, len(active) - self.n_features)]
            for i in worst:
                rank[active[i]] = float(len(active))
            active = [c for i, c in enumerate(active) if i not in worst]
        return Selected(active, features, [rank[c] for c in features])


@dataclass
class RFECV:
    """RFE on each training fold, scored on its test fold; the last of the best sizes wins."""

    min_features: int = 1
    step: int = 1

    def fit(self, df: DataFrame, features: list[str], importance: Importance, score: Callable[[DataFrame, list[str]], float], fold: str) -> Selected:
        folds = sorted(r[0] for r in df.select(fold).distinct().collect())
        total: dict[int, float] = {}
        for k in folds:
            train, test = df.filter(F.col(fold) != k), df.filter(F.col(fold) == k)
            for n in range(self.min_features, len(features) + 1):
                keep = RFE(n, self.step).fit(train, features, importance).features
                total[n] = total.get(n, 0.0) + score(test, keep) / len(folds)
        best = max(total, key=lambda n: (total[n], n))
        return RFE(best, self.step).fit(df, features, importance)


@dataclass
class SequentialFeatureSelector:
    """Forward selection by a score of (frame, features)."""

    n_features: int

    def fit(self, df: DataFrame, features: list[str], score: Callable[[DataFrame, list[str]], float]) -> Selected:
        chosen: list[str] = []
        while len(chosen) < min(self.n_features, len(features)):
            rest = [c for c in features if c not in chosen]
            values = [score(df, [*chosen, c]) for c in rest]
            chosen.append(rest[max(range(len(rest)), key=lambda i: (values[i], -i))])
        return Selected([c for c in features if c in chosen], features, [float(c in chosen) for c in features])
