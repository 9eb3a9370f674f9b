"""Vectorising text: counts, tf-idf and signed hashing, as long tables (document, column, value)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import InvalidParameter
from ..functions import strings


def _terms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    words = df.select(F.col(id_col).alias("row_id"), F.explode(strings.tokenize(F.coalesce(F.col(text_col), F.lit("")))).alias("term"))
    return words.groupBy("row_id", "term").agg(F.count(F.lit(1)).cast("double").alias("value"))


def _unit(long: DataFrame) -> DataFrame:
    """Rows to length 1 (lengths below 1e-12 count as that)."""
    size = long.groupBy("row_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("size"))
    return long.join(size, "row_id").select(*[c for c in long.columns if c != "value"], (F.col("value") / F.greatest("size", F.lit(1e-12))).alias("value"))


@dataclass
class Vocabulary:
    """Terms with their column (in code-point order) and document frequency; ``n`` documents were fitted."""

    terms: DataFrame
    n: int
    idf: bool = False
    normalize: bool = False

    def transform(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(row_id, term, column, value); documents without known terms have no rows. Spark picks the join."""
        long = _terms(df, id_col, text_col).join(self.terms, "term")
        if self.idf:
            long = long.withColumn("value", F.col("value") * (F.log((1.0 + F.lit(self.n)) / (1.0 + F.col("df"))) + 1.0))
        long = long.select("row_id", "term", "column", "value")
        return _unit(long) if self.normalize else long


@dataclass
class CountVectorizer:
    """Counts of tokens whose document frequency is from min_df to max(floor(max_df_frac * n), min_df)."""

    min_df: int = 1
    max_df_frac: float = 1.0

    def fit(self, df: DataFrame, id_col: str, text_col: str) -> Vocabulary:
        if self.min_df < 1 or not 0 < self.max_df_frac <= 1:
            raise InvalidParameter("min_df or max_df_frac")
        n = df.count()
        most = max(int(self.max_df_frac * n), self.min_df)
        words = df.select(F.explode(F.array_distinct(strings.tokenize(F.coalesce(F.col(text_col), F.lit(""))))).alias("term"))
        kept = words.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df").between(self.min_df, most))
        # Columns number the sorted vocabulary; ranks are taken by first letter, then added up.
        kept = kept.withColumn("head", F.substring("term", 1, 2))
        inner = F.row_number().over(Window.partitionBy("head").orderBy("term"))
        before = kept.groupBy("head").agg(F.count(F.lit(1)).alias("m")).withColumn("b", F.sum("m").over(Window.orderBy("head")) - F.col("m"))
        terms = kept.withColumn("r", inner).join(before.select("head", "b"), "head").select("term", "df", (F.col("r") + F.col("b") - 1).alias("column"))
        return Vocabulary(terms, n)


@dataclass
class TfidfVectorizer:
    """idf = ln((1 + n) / (1 + df)) + 1; rows to unit length unless ``normalize`` is off."""

    min_df: int = 1
    max_df_frac: float = 1.0
    normalize: bool = True

    def fit(self, df: DataFrame, id_col: str, text_col: str) -> Vocabulary:
        v = CountVectorizer(self.min_df, self.max_df_frac).fit(df, id_col, text_col)
        return Vocabulary(v.terms, v.n, True, self.normalize)


@dataclass
class HashingVectorizer:
    """FNV-1a of each token modulo n_features; the sign is + where the hash is even. No fit."""

    n_features: int = 1024
    normalize: bool = True

    def transform(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        long = _terms(df, id_col, text_col)
        words = long.select("term").distinct().withColumn("h", strings.fnv1a_64(F.col("term")))
        words = words.select("term", (F.col("h") % self.n_features).cast("bigint").alias("column"), F.when(F.col("h") % 2 == 0, 1.0).otherwise(-1.0).alias("sign"))
        out = long.join(words, "term").groupBy("row_id", "column").agg(F.sum(F.col("value") * F.col("sign")).alias("value"))
        return _unit(out) if self.normalize else out


# Sparse matrices are long tables (row_id, column, value).


def from_triplets(long: DataFrame) -> DataFrame:
    return long.groupBy("row_id", "column").agg(F.sum("value").alias("value"))


def density(long: DataFrame, n_rows: int, n_columns: int) -> float:
    return long.count() / (n_rows * n_columns)


def matvec(long: DataFrame, vector: DataFrame) -> DataFrame:
    """(row_id, value) of the product with a vector given as (column, x)."""
    return long.join(vector, "column").groupBy("row_id").agg(F.sum(F.col("value") * F.col("x")).alias("value"))
