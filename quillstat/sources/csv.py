"""Reading numeric CSV files, and seeded toy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import DataIOError, EmptyInput, InvalidParameter


def read_csv(spark: SparkSession, path: str, header: bool = True, delimiter: str = ",", target: str | int | None = None) -> tuple[DataFrame, list[str], str | None]:
    """(frame, feature columns, target column): every field is trimmed and must be a number, every row complete.

    A bad field or a ragged row fails when the frame is read. Without a header columns are c0, c1, ...; the target
    is named, or given by position.
    """
    try:
        raw = spark.read.option("header", header).option("sep", delimiter).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    except Exception as e:
        raise DataIOError(str(e)) from e
    if not raw.columns:
        raise EmptyInput(path)
    names = [c.strip() for c in raw.columns] if header else [f"c{k}" for k in range(len(raw.columns))]
    schema = ", ".join(f"`{n}` double" for n in names)
    df = spark.read.schema(schema).option("header", header).option("sep", delimiter).option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    strict = [F.when(F.col(f"`{n}`").isNull(), F.raise_error(F.lit(f"no number in {n}")).cast("double")).otherwise(F.col(f"`{n}`")).alias(n) for n in names]
    df = df.select(*strict)
    if df.isEmpty():
        raise EmptyInput(path)
    name = names[target] if isinstance(target, int) else target
    if name is not None and name not in names:
        raise InvalidParameter(f"no column {name}")
    return df, [n for n in names if n != name], name


def read_csv_with_header(spark: SparkSession, path: str, target: str | None = None):
    return read_csv(spark, path, True, ",", target)


def make_regression(spark: SparkSession, n: int, d: int, seed: int = 0, noise: float = 0.1) -> DataFrame:
    """(id, x0.., y): y is a fixed linear form plus noise."""
    df = spark.range(n).select("id", *[(F.rand(seed * 1000 + k) * 2 - 1).alias(f"x{k}") for k in range(d)])
    y = sum((F.col(f"x{k}") * float(k + 1) for k in range(d)), F.lit(0.0))
    return df.withColumn("y", y + F.randn(seed * 1000 + d) * noise)


def make_classification(spark: SparkSession, n: int, d: int, classes: int = 2, seed: int = 0) -> DataFrame:
    """(id, x0.., y): one cloud a class, around points 3 apart on the diagonal."""
    df = spark.range(n).withColumn("y", (F.col("id") % classes).cast("double"))
    return df.select("id", *[(F.randn(seed * 1000 + k) + F.col("y") * 3 * (1 if k % 2 == 0 else -1)).alias(f"x{k}") for k in range(d)], "y")
