"""Ranks and running sums over a whole order: ranges of about equal size, positions inside them, totals of those before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..core import written


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """df dealt by ranges of ``order`` and written, with ``__piece`` (the range) and ``__spot`` (the place in it, from 0).

    Ranges come from a sample of the order itself, so one outlying value or many close ones leave no range with much
    more than its share; rows equal in ``order`` are told apart by a hash of all their columns. Nulls come first.
    """
    n = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    rows = df.withColumn("__h", F.xxhash64(*plain))
    keys = [*order, F.col("__h")]
    cut = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("__h").withColumn("__at", F.monotonically_increasing_id())
    return written(cut, "ranges").withColumns({"__piece": F.shiftright("__at", 33), "__spot": F.col("__at").bitwiseAND((1 << 33) - 1)}).drop("__at")


def before(pieces: DataFrame, **sums: Column) -> DataFrame:
    """pieces with ``<name>`` (the sum over all ranges before) and ``<name>_all``; there is one row of totals a range."""
    totals = pieces.groupBy("__piece").agg(*[v.alias(f"__{k}") for k, v in sums.items()])
    upto = Window.partitionBy(F.lit(0)).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    columns = [c for k in sums for c in (F.coalesce(F.sum(f"__{k}").over(upto), F.lit(0)).alias(k), F.sum(f"__{k}").over(every).alias(f"{k}_all"))]
    return pieces.join(F.broadcast(totals.select("__piece", *columns)), "__piece")


def positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with ``name``, the place of each row in the whole order from 0, and ``name``_n, the number of rows."""
    placed = before(in_ranges(df, order), **{name: F.count(F.lit(1))})
    return placed.withColumn(name, F.col(name) + F.col("__spot")).withColumnRenamed(f"{name}_all", f"{name}_n").drop("__piece", "__spot")


def numbered(df: DataFrame, column: str) -> DataFrame:
    """(column, number): the rank from 0 of each row of distinct values."""
    return positions(df.select(column), [F.col(column)], "number").select(column, "number")
