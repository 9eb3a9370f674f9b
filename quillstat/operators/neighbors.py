"""Nearest neighbours through a space-partitioning index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import InvalidParameter, require, vector, written
from ..functions import numeric
from . import spatial
from .quantiles import exact_quantiles

def _side(df: DataFrame, id_col: str, features: list[str], name: str, *more: str) -> DataFrame:
    return df.select(F.col(id_col).alias(f"{name}_id"), *[F.col(f"`{c}`").cast("double").alias(f"{name}_{k}") for k, c in enumerate(features)], *[F.col(c).alias(f"{name}_{c}") for c in more])


def pairwise_distances(a: DataFrame, b: DataFrame, id_col: str, features: list[str], metric: str = "euclidean") -> DataFrame:
    """(a_id, b_id, distance) of all pairs: the rows of a are dealt to all cores, whatever their files, and meet b there."""
    x, y, d = _side(a, id_col, features, "a"), _side(b, id_col, features, "b"), len(features)
    gap = numeric.distance([F.col(f"a_{k}") for k in range(d)], [F.col(f"b_{k}") for k in range(d)], metric)
    x = x.repartition(4 * a.sparkSession.sparkContext.defaultParallelism)
    return x.crossJoin(F.broadcast(y)).select("a_id", "b_id", gap.alias("distance"))


def k_nearest(queries: DataFrame, train: DataFrame, id_col: str, features: list[str], k: int, metric: str = "euclidean", exclude_self: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(q_id, t_id, distance, rank, t_<keep>...): the k nearest reference rows of each query; ties by id.

    The reference becomes a space-partitioning index (see spatial.Index), of rows at one point the first k + 1 by id.
    Queries meet only cells that can hold one of their k nearest; neither side is collected or broadcast. A row with a missing
    number is nobody's neighbour and has none.
    """
    if metric not in spatial.METRICS or k < 1:
        raise InvalidParameter("k or metric")
    require(queries, [id_col, *features])
    index = spatial.Index(train, id_col, features, metric, keep, most_equal=k + 1)
    rows = spatial.usable(queries, id_col, features)
    if metric != "cosine":
        return spatial.search(index, rows, k, exclude_self)
    # A row of zeros is 1 away from all: the first k rows by id are its nearest.
    zero = ~F.exists("x", lambda v: v != 0)
    found = spatial.search(index, rows.filter(~zero), k, exclude_self)
    first = train.select(F.col(id_col).alias("t_id"), vector(features).alias("t_x"), *[F.col(c).alias(f"t_{c}") for c in keep])
    first = first.filter(F.col("t_id").isNotNull() & ~F.exists("t_x", lambda v: v.isNull() | F.isnan(v))).orderBy("t_id").limit(k + 1).drop("t_x")
    near = rows.filter(zero).crossJoin(F.broadcast(first))  # k + 1 rows
    near = near.filter(~F.col("q_id").eqNullSafe(F.col("t_id"))) if exclude_self else near
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("t_id"))).filter(F.col("rank") <= k)
    return found.unionByName(near.select("q_id", "t_id", F.lit(1.0).alias("distance"), "rank", *[f"t_{c}" for c in keep]))


def _weight(weights: str):
    return F.lit(1.0) if weights == "uniform" else F.when(F.col("distance") < 1e-15, 1e15).otherwise(1 / F.when(F.col("distance") < 1e-15, F.lit(None)).otherwise(F.col("distance")))


@dataclass
class KNN:
    """A fitted neighbour model is its reference table."""

    train: DataFrame
    id_col: str
    features: list[str]
    label: str
    k: int
    metric: str
    weights: str
    regression: bool

    def transform(self, df: DataFrame) -> DataFrame:
        """(id, prediction): the (weighted) mean, or the label with the most weight (ties: smallest)."""
        near = k_nearest(df, self.train, self.id_col, self.features, self.k, self.metric, keep=(self.label,)).withColumn("w", _weight(self.weights))
        if self.regression:
            out = near.groupBy("q_id").agg((F.sum(F.col("w") * F.col(f"t_{self.label}")) / F.sum("w")).alias("prediction"))
        else:
            votes = near.groupBy("q_id", F.col(f"t_{self.label}").alias("y")).agg(F.sum("w").alias("w"))
            out = votes.groupBy("q_id").agg(F.min_by("y", F.struct(-F.col("w"), F.col("y"))).alias("prediction"))
        return out.withColumnRenamed("q_id", self.id_col)


@dataclass
class KnnClassifier:
    k: int = 5
    metric: str = "euclidean"
    weights: str = "uniform"

    def fit(self, df: DataFrame, id_col: str, features: list[str], label: str) -> KNN:
        return KNN(df, id_col, features, label, self.k, self.metric, self.weights, False)


@dataclass
class KnnRegressor:
    k: int = 5
    metric: str = "euclidean"
    weights: str = "uniform"

    def fit(self, df: DataFrame, id_col: str, features: list[str], label: str) -> KNN:
        return KNN(df, id_col, features, label, self.k, self.metric, self.weights, True)


@dataclass
class LocalOutlierFactor:
    """Neighbours without the row itself; local reachability density is 1 where the mean reach is 0."""

    k: int = 20
    contamination: float = 0.1

    def fit_transform(self, df: DataFrame, id_col: str, features: list[str]) -> DataFrame:
        """(id, lof, prediction): -1 for the ``contamination`` share of largest factors, else 1."""
        near = written(k_nearest(df, df, id_col, features, self.k, exclude_self=True), "neighbours")
        reach = near.groupBy("q_id").agg(F.max("distance").alias("kd"))
        both = near.join(reach.select(F.col("q_id").alias("t_id"), "kd"), "t_id")
        lrd = both.groupBy("q_id").agg(F.avg(F.greatest("distance", "kd")).alias("m")).select("q_id", F.when(F.col("m") == 0, 1.0).otherwise(1 / F.nullif(F.col("m"), F.lit(0.0))).alias("lrd"))
        other = lrd.select(F.col("q_id").alias("t_id"), F.col("lrd").alias("o"))
        lof = near.join(other, "t_id").groupBy("q_id").agg(F.avg("o").alias("o")).join(lrd, "q_id").select("q_id", (F.col("o") / F.col("lrd")).alias("lof"))
        lof = written(lof, "factors")
        cut = exact_quantiles(lof, [F.col("lof")], [1 - self.contamination])[0]
        return lof.select(F.col("q_id").alias(id_col), "lof", F.when(F.col("lof") > F.lit(cut[0] if cut else None), -1).otherwise(1).alias("prediction"))
