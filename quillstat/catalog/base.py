"""Tables and roundings that the queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def round_half_up(c: Column, digits: int) -> Column:
    """F.round() on doubles, bit for bit, without a decimal for each value.

    Where the scaled value is small enough to be exact to a thousandth and not that near to a half, its nearest integer over the scale is
    the double nearest to the rounded decimal; all else goes through F.round().
    """
    scaled = c * F.lit(float(10**digits))
    plain = (F.abs(scaled) < float(1 << 40)) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(plain, F.rint(scaled) / F.lit(float(10**digits))).otherwise(F.round(c, digits))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles to so many digits: engines add in different orders. -0 becomes 0."""
    return df.select(*[(round_half_up(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def lineitem(spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


LI = "(SELECT *, l_orderkey * 10 + l_linenumber AS id FROM lineitem)"
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
