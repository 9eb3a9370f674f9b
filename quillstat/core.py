"""Estimators and models over DataFrames: validation, errors, fitted state and how it is saved.

An estimator is a dataclass of parameters whose ``fit`` runs one or a few Spark jobs and returns a model; a model is
a dataclass of small fitted state whose ``transform`` adds or replaces columns lazily. Features are named columns.
"""

from __future__ import annotations

import dataclasses
import importlib
import json
import tempfile
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class EngineError(Exception):
    """Base of all errors that the engine raises itself."""


class ShapeMismatch(EngineError):
    """Columns are missing, or their number is not what a model was fitted on."""


class NotFitted(EngineError):
    """An estimator was asked for what only a fitted model knows."""


class InvalidParameter(EngineError):
    """A parameter or label is outside what the method allows."""


class EmptyInput(EngineError):
    """There are no rows to learn from."""


class DataIOError(EngineError):
    """A file could not be read or written."""


class SerializationError(EngineError):
    """Saved state could not be understood."""


#: Rows that methods which need all pairs, or rows in strict order, accept.
ROW_CAP = 5000


def require(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ShapeMismatch(f"columns not found: {missing}")
    for c in columns:
        if not isinstance(df.schema[c].dataType, (T.NumericType, T.StringType, T.BooleanType, T.ArrayType)):
            raise InvalidParameter(f"column {c} is {df.schema[c].dataType.simpleString()}")


def stats(df: DataFrame, *columns: Column):
    """One row of aggregates; an error if the frame is empty."""
    row = df.agg(F.count(F.lit(1)).alias("__n"), *columns).first()
    if not row["__n"]:
        raise EmptyInput("no rows")
    return row


def num(name: str) -> Column:
    """A column as double, NaN made null."""
    c = F.col(f"`{name}`").cast("double")
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def matrix(df: DataFrame, columns: list[str], order: str | None = None, cap: int = ROW_CAP, extra: tuple[str, ...] = ()) -> tuple[np.ndarray, pd.DataFrame]:
    """(values, frame) of a table known to be small: beyond ``cap`` rows it is an error, not a sample."""
    names = [*columns, *extra, *([order] if order else [])]
    require(df, [c for c in names])
    got = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(names)]).limit(cap + 1).toPandas()
    if len(got) > cap:
        raise InvalidParameter(f"more than {cap} rows; this method compares all rows with each other")
    if not len(got):
        raise EmptyInput("no rows")
    if order:
        got = got.sort_values(order, kind="stable", ignore_index=True)
    return got[columns].to_numpy(float), got


class Model:
    """Base of fitted models: state in dataclass fields, saved as JSON (arrays as nested lists)."""

    def to_json(self) -> str:
        return json.dumps({"class": f"{type(self).__module__}:{type(self).__qualname__}", "state": _plain(self)})

    @staticmethod
    def from_json(text: str) -> Model:
        try:
            got = json.loads(text)
            return _build(got)
        except (ValueError, KeyError, TypeError, AttributeError, ImportError) as e:
            raise SerializationError(str(e)) from e

    def to_bytes(self) -> bytes:
        return zlib.compress(self.to_json().encode())

    @staticmethod
    def from_bytes(data: bytes) -> Model:
        try:
            return Model.from_json(zlib.decompress(data).decode())
        except zlib.error as e:
            raise SerializationError(str(e)) from e

    def save(self, path: str, binary: bool = False) -> None:
        """Writes to a local path, or through Spark to any store it knows (a path with a scheme: hdfs://, s3a://, file://)."""
        write_bytes(path, self.to_bytes() if binary else self.to_json().encode())

    @staticmethod
    def load(path: str) -> Model:
        data = read_bytes(path)
        return Model.from_json(data.decode()) if data[:1] == b"{" else Model.from_bytes(data)


def _store(path: str):
    """(file system, path) of a path with a scheme, by way of the active session."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise DataIOError(f"{path} needs a Spark session")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_bytes(path: str, data: bytes) -> None:
    """Replaces a small file; in a store it is written beside its place first and then moved."""
    try:
        if "://" not in path:
            with open(path, "wb") as f:
                f.write(data)
            return
        fs, where = _store(path)
        part = where.suffix(".part")
        out = fs.create(part, True)
        out.write(bytearray(data))
        out.close()
        fs.delete(where, False)
        if not fs.rename(part, where):
            raise DataIOError(f"{path} could not be moved to its place")
    except (OSError, Py4JJavaError) as e:
        raise DataIOError(str(e)) from e


def read_bytes(path: str) -> bytes:
    try:
        if "://" not in path:
            with open(path, "rb") as f:
                return f.read()
        fs, where = _store(path)
        if not fs.exists(where):
            raise DataIOError(f"{path} does not exist")
        return bytes(SparkSession.getActiveSession().read.format("binaryFile").load(path).first()["content"])
    except (OSError, Py4JJavaError) as e:
        raise DataIOError(str(e)) from e


def _plain(x):
    if isinstance(x, np.ndarray):
        return {"array": x.tolist(), "dtype": str(x.dtype)}
    if isinstance(x, np.generic):
        return x.item()
    if dataclasses.is_dataclass(x):
        body = {f.name: _plain(getattr(x, f.name)) for f in dataclasses.fields(x)}
        return {"class": f"{type(x).__module__}:{type(x).__qualname__}", "fields": body}
    if isinstance(x, dict):
        return {"dict": [[_plain(k), _plain(v)] for k, v in x.items()]}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if x is None or isinstance(x, (str, int, float, bool)):
        return x
    raise SerializationError(f"{type(x).__name__} can't be saved")


def _build(x):
    if isinstance(x, list):
        return [_build(v) for v in x]
    if not isinstance(x, dict):
        return x
    if "state" in x:
        return _build(x["state"])
    if "array" in x:
        return np.array(x["array"], dtype=x["dtype"])
    if "dict" in x:
        return {_build(k): _build(v) for k, v in x["dict"]}
    module, name = x["class"].split(":")
    if module.split(".")[0] != __name__.split(".")[0]:
        raise SerializationError(f"{module} is not part of this package")
    return getattr(importlib.import_module(module), name)(**{k: _build(v) for k, v in x["fields"].items()})


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written once as Parquet and read back: cuts lineage and survives lost executors.

    The table lies in the folder that spark.checkpoint.dir names; only local masters may go without one.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_quillstat_work", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise DataIOError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark._quillstat_work = tempfile.mkdtemp(prefix="quillstat-")
    path = f"{folder.rstrip('/')}/quillstat/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillstat_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the table of a frame that written() returned, where nothing reads it any more."""
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._quillstat_path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def vector(features: list[str]) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("double") for c in features])


def linear_form(features: list[str], weights, intercept: float = 0.0) -> Column:
    """intercept + sum of weight * column as one expression."""
    out = F.lit(float(intercept))
    for c, w in zip(features, weights, strict=True):
        out = out + F.col(f"`{c}`").cast("double") * float(w)
    return out


def wide(v: pa.Array, width: int) -> np.ndarray:
    """Rows of numbers as a matrix, without an object for each row; missing ones are NaN."""
    return v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), width)


class ArrayModel(Model):
    """A model whose prediction is numpy code on batches of rows (Arrow batches, never single rows)."""

    features: list[str]

    def predict_array(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        require(df, self.features)
        model = self

        @F.arrow_udf("double")
        def predict(v: pa.Array) -> pa.Array:
            return pa.array(np.asarray(model.predict_array(wide(v, len(model.features))), float), pa.float64())

        return df.withColumn(output, predict(vector(self.features)))

    def transform_vector(self, df: DataFrame, method: str, output: str = "probability") -> DataFrame:
        """Adds an array column made by a method that gives a row of numbers for each row."""
        require(df, self.features)
        model = self

        @F.arrow_udf("array<double>")
        def apply(v: pa.Array) -> pa.Array:
            out = np.asarray(getattr(model, method)(wide(v, len(model.features))), float).reshape(len(v), -1)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))

        return df.withColumn(output, apply(vector(self.features)))


def summed(parts: DataFrame, name: str = "m") -> np.ndarray:
    """Element-wise sum of the arrays in a column of equal lengths, added up on executors."""
    got = parts.select(F.posexplode(name).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(1 + max((r["k"] for r in got), default=-1))
    for r in got:
        out[r["k"]] = r["v"]
    return out


def score_of(frame: DataFrame, name: str = "score") -> float:
    """The one number of a one-row metric frame."""
    return float(frame.select(name).first()[0])
