"""Shared plumbing: tables in the shared folder, and ranks that no single task has to compute alone."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: What separates words, in regular-expression form; the same six bytes are used by the byte scanners.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of text whose n-grams or windows make one bucket, about, and the fewest buckets.
BUCKET_BYTES = 1 << 20
LEAST_BUCKETS = 256


#: Tables written by materialize() and not deleted yet.
_TABLES: list[str] = []


def buckets_for(text_bytes: int) -> int:
    """Buckets that hashes of all n-grams are dealt to: as many as keep a bucket's share bounded at any input size."""
    return max(LEAST_BUCKETS, -(-text_bytes // BUCKET_BYTES))


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0])


def need_integers(docs: DataFrame, *columns: str) -> None:
    """Refuses id columns that are no integers, before any job starts."""
    for c in columns:
        if not isinstance(docs.schema[c].dataType, T.IntegralType):
            raise TypeError(f"column {c} must be an integer, not {docs.schema[c].dataType.simpleString()}")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    return next(n for k in range(len(taken) + 1) if (n := f"__{base}{k or ''}") not in taken)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or (local masters only) a folder made for this session."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = getattr(spark, "_quillstat_dir", None)
        if not path:
            path = spark._quillstat_dir = tempfile.mkdtemp(prefix="quillstat-")
    return path.rstrip("/")


def materialize(df: DataFrame, tag: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """Writes df once as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors.

    The table stays until discard() or cleanup(), as results that are read later may be made from it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillstat/{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    _TABLES.append(path)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cleanup(spark: SparkSession) -> None:
    """Deletes all tables that materialize() wrote in this process: call it when results have been read or written."""
    discard(spark, *list(_TABLES))


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables written by materialize() that nothing reads any more."""
    for p in paths:
        if p in _TABLES:
            _TABLES.remove(p)
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash60(column: Column) -> Column:
    """The first 60 bits of a column's MD5 as a long; any SQL engine can compute the same."""
    return F.conv(F.substring(F.md5(column.cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint")


def bucketed_running(df: DataFrame, group: list[str], bucket: str, order: list, sums: dict[str, str]) -> DataFrame:
    """Exclusive running sums of each group in the order (bucket, *order).

    ``bucket`` must be a column whose values cut every group into bounded pieces in the wanted order. Sums
    inside a piece and sums over earlier pieces are taken apart, so that a group with a third of all rows is
    still spread over as many tasks as it has pieces. ``sums`` maps output names to input columns; columns of
    ``group`` and ``bucket`` must not be null.
    """
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outer = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = df.groupBy(*group, bucket).agg(*[F.sum(c).alias(f"__t_{o}") for o, c in sums.items()])
    for o in sums:
        totals = totals.withColumn(f"__b_{o}", F.sum(f"__t_{o}").over(outer) - F.col(f"__t_{o}"))
    totals = totals.drop(*[f"__t_{o}" for o in sums])
    out = df
    for o, c in sums.items():
        out = out.withColumn(f"__i_{o}", F.sum(c).over(inner) - F.col(c))
    out = out.join(totals, [*group, bucket])
    for o in sums:
        out = out.withColumn(o, F.col(f"__i_{o}") + F.col(f"__b_{o}"))
    return out.drop(*[f"__i_{o}" for o in sums], *[f"__b_{o}" for o in sums])


def ranged(df: DataFrame, order: list[str], tag: str) -> tuple[DataFrame, str]:
    """df dealt by ranges of ``order`` and written, with the range number as ``__piece``: pieces for bucketed_running().

    Ranges cut through any group, as rows that are equal in ``order`` are told apart by where they are read; the
    written table keeps the cuts fixed.
    """
    n = max(2 * shuffle_width(df.sparkSession), 8)
    cut = df.withColumn("__read", F.monotonically_increasing_id()).repartitionByRange(n, *order, "__read").drop("__read")
    return materialize(cut.withColumn("__piece", F.spark_partition_id()), tag)


#: Rows that one task may rank or a broadcast may hold (some 50 to 100 bytes each).
FEW = 100_000


def few(df: DataFrame) -> bool:
    return df.limit(FEW + 1).count() <= FEW


def running(df: DataFrame, order: list[str], sums: dict[str, str], alone: bool, tag: str) -> DataFrame:
    """Exclusive running sums over a whole table in order: in one task if it is known to be small, else in pieces."""
    if alone:
        upto = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({o: F.sum(c).over(upto) - F.col(c) for o, c in sums.items()})
    pieces, _ = ranged(df.withColumn("__all", F.lit(0)), order, tag)
    return bucketed_running(pieces, ["__all"], "__piece", order, sums).drop("__all", "__piece")


def beside(df: DataFrame, alone: bool, **totals: Column) -> DataFrame:
    """Totals over a whole table beside each of its rows."""
    if alone:
        return df.withColumns({k: v.over(Window.partitionBy(F.lit(0))) for k, v in totals.items()})
    return df.crossJoin(F.broadcast(df.agg(*[v.alias(k) for k, v in totals.items()])))  # one row
