"""Isotonic regression of any number of rows: neighbours pooled where they lie, segments that don't touch found by passes."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import EmptyInput, InvalidParameter, Model, require, written
from . import ranks

#: Blocks that one task, or the driver, pools; levels that the first pass tries.
SEGMENT_BLOCKS = 1 << 18
FIRST_LEVELS = 31
#: A sum this small beside the sum of its absolute terms is taken for zero.
TINY = 1e-12


def pool(y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pool adjacent violators: (level, weight, size) of the blocks of the closest non-decreasing sequence."""
    level, weight, size = [], [], []
    for v, k in zip(y.tolist(), w.tolist(), strict=True):
        n = 1
        while level and level[-1] > v:
            a = weight.pop()
            v, k, n = (level.pop() * a + v * k) / (a + k), a + k, n + size.pop()
        level.append(v)
        weight.append(k)
        size.append(n)
    return np.array(level), np.array(weight), np.array(size, np.int64)


def pava(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The closest non-decreasing sequence."""
    level, _, size = pool(np.asarray(y, float), np.asarray(w, float))
    return np.repeat(level, size)


@dataclass
class StepModel(Model):
    """Linear interpolation between fitted points, constant outside."""

    feature: str
    x: list[float]
    y: list[float]
    features: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        xs, ys = np.array(self.x), np.array(self.y)

        @F.pandas_udf("double")
        def at(v: pd.Series) -> pd.Series:
            return pd.Series(np.interp(v, xs, ys))

        return df.withColumn(output, at(F.col(f"`{self.feature}`").cast("double")))


@dataclass
class StepTable:
    """The same curve where its points (x, y) are too many for one task: a table, met by the rows in one order."""

    feature: str
    points: DataFrame

    def write(self, path: str) -> None:
        self.points.write.parquet(path)

    @staticmethod
    def read(spark, path: str, feature: str) -> StepTable:
        return StepTable(feature, spark.read.parquet(path))

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """Rows and points are dealt by ranges of x; the nearest point on either side comes from the range or from those beside it."""
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        rows = df.select(F.col(f"`{self.feature}`").cast("double").alias("x"), F.lit(1).alias("kind"), row.alias("row"))
        point = F.struct("x", "y")
        points = self.points.select("x", F.lit(0).alias("kind"), point.alias("point"))
        both = ranks.in_ranges(rows.unionByName(points, allowMissingColumns=True), [F.col("x"), F.col("kind")])
        ends = both.groupBy("__piece").agg(F.min("point").alias("low"), F.max("point").alias("high"))
        pieces = Window.partitionBy(F.lit(0)).orderBy("__piece")  # a row a range
        left = F.last("high", True).over(pieces.rowsBetween(Window.unboundedPreceding, -1))
        right = F.first("low", True).over(pieces.rowsBetween(1, Window.unboundedFollowing))
        both = both.join(F.broadcast(ends.select("__piece", left.alias("left"), right.alias("right"))), "__piece")
        order = Window.partitionBy("__piece").orderBy("__spot")
        inner = both.withColumn("before", F.last("point", True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        # A second window in the other direction: the next point is the last one met from the far end.
        back = Window.partitionBy("__piece").orderBy(F.desc("__spot")).rowsBetween(Window.unboundedPreceding, 0)
        inner = inner.withColumn("after", F.last("point", True).over(back)).filter("kind = 1")
        a, b = F.coalesce("before", "left"), F.coalesce("after", "right")
        slope = (b["y"] - a["y"]) / (b["x"] - a["x"])
        y = F.when(a.isNull(), b["y"]).when(b.isNull() | (a["x"] == F.col("x")), a["y"]).otherwise(slope * (F.col("x") - a["x"]) + a["y"])
        known = F.col("x").isNotNull() & ~F.isnan("x")
        return inner.select("row.*", F.when(known, y).alias(output))


@dataclass
class IsotonicRegressor:
    """The closest monotone curve by weighted squares; rows are averaged by distinct x in Spark first.

    Up to ``cap`` means are pooled on the driver. More are pooled a batch at a time where they lie, then cut: the least prefix sum of
    w (y - t) marks where the fit passes t, for any level t, and what lies on either side doesn't depend on the other. The first
    pass tries some levels at once, later ones the mean of each segment, which is one block if no prefix sum is below zero; segments of at most
    ``cap`` blocks are pooled by a task each. A pass returns a row for each range, segment and level. Rows without x or label are left out.
    """

    increasing: bool = True
    cap: int = SEGMENT_BLOCKS

    def fit(self, df: DataFrame, feature: str, label: str) -> StepModel | StepTable:
        if self.cap < 1:
            raise InvalidParameter("cap")
        require(df, [feature, label])
        s = 1 if self.increasing else -1
        rows = df.select((F.col(f"`{feature}`").cast("double") + 0.0).alias("x"), F.col(f"`{label}`").cast("double").alias("y"))
        rows = rows.filter("x IS NOT NULL AND NOT isnan(x) AND y IS NOT NULL AND NOT isnan(y)")
        means = rows.groupBy("x").agg((F.avg("y") * s).alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
        got = means.limit(self.cap + 1).toPandas().sort_values("x")
        if not len(got):
            raise EmptyInput("no rows")
        if len(got) <= self.cap:
            return StepModel(feature, got["x"].tolist(), (s * pava(got["y"].to_numpy(), got["w"].to_numpy())).tolist())
        fitted = written(self._pooled(means), "levels")
        ends = F.when(F.col("low") < F.col("high"), F.array("low", "high")).otherwise(F.array("low"))
        points = fitted.select(F.explode(ends).alias("x"), (F.col("y") * s).alias("y"))
        if points.limit(self.cap + 1).count() > self.cap:
            return StepTable(feature, points)
        got = points.toPandas().sort_values("x")
        return StepModel(feature, got["x"].tolist(), got["y"].tolist())

    def _pooled(self, means: DataFrame) -> DataFrame:
        """(low, high, y, w): the blocks of the fit to all means."""

        def ahead(batches):
            for b in batches:
                x, y, w = (b.column(c).to_numpy() for c in ("x", "y", "w"))
                level, weight, size = pool(y, w)
                end = np.cumsum(size)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x[end - size], x[end - 1], level, weight)], ["low", "high", "y", "w"])

        n = max(8, int(means.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt = means.repartitionByRange(n, "x").sortWithinPartitions("x").mapInArrow(ahead, "low double, high double, y double, w double")
        blocks = written(dealt.withColumn("at", F.monotonically_increasing_id()), "blocks")
        small, single = self._segments(blocks)
        starts = np.array(sorted([a for a, _ in small] + single), np.int64)
        alone = np.isin(starts, np.array(single, np.int64))
        shared = means.sparkSession.sparkContext.broadcast((starts, alone))

        def place(batches):
            starts, alone = shared.value
            for b in batches:
                k = np.searchsorted(starts, b.column("at").to_numpy(), "right") - 1
                yield b.append_column("part", pa.array(k)).append_column("alone", pa.array(alone[k]))

        def finish(t: pa.Table) -> pa.Table:
            t = t.sort_by("at")
            level, weight, size = pool(t.column("y").to_numpy(), t.column("w").to_numpy())
            end = np.cumsum(size)
            return pa.table({"low": t.column("low").to_numpy()[end - size], "high": t.column("high").to_numpy()[end - 1], "y": level, "w": weight})

        parts = blocks.mapInArrow(place, "low double, high double, y double, w double, at long, part long, alone boolean")
        whole = parts.filter("alone").groupBy("part").agg(F.min("low").alias("low"), F.max("high").alias("high"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("y"), F.sum("w").alias("w")).drop("part")
        return parts.filter("NOT alone").groupBy("part").applyInArrow(finish, "low double, high double, y double, w double").unionByName(whole)

    def _segments(self, blocks: DataFrame) -> tuple[list[tuple[int, int]], list[int]]:
        """Starts, with numbers of blocks, of segments that a task may pool, and starts of those that are one block."""
        levels = sorted(set(blocks.approxQuantile("y", [(k + 1) / (FIRST_LEVELS + 1) for k in range(FIRST_LEVELS)], 0.01)))
        # Open segments: start, end, levels to try, whether the level is the mean.
        todo, small, single = [(0, 1 << 62, levels, False)], [], []
        while todo:
            found, left = self._least(blocks, todo), []
            for k, (start, end, _, mean) in enumerate(todo):
                cuts, total, flat = found[k]
                if mean and (flat or not cuts):
                    single.append(start)
                    continue
                marks = [(start - 1, 0, 0.0, 0.0), *sorted(cuts), (end, *total)]
                for (a, *low), (z, *high) in zip(marks[:-1], marks[1:], strict=True):
                    n, w, wy = (q - p for p, q in zip(low, high, strict=True))
                    if n <= self.cap:
                        small.append((a + 1, n))
                    else:
                        left.append((a + 1, z, [wy / w], True))
            todo = left
        joined, alone = [], set(single)
        for start, n in sorted([*small, *[(a, 0) for a in single]]):
            # Segments side by side that a task can take together are one; none reaches over one that is a block.
            if start not in alone and joined and joined[-1][0] not in alone and joined[-1][1] + n <= self.cap:
                joined[-1] = (joined[-1][0], joined[-1][1] + n)
            else:
                joined.append((start, n))
        return [v for v in joined if v[0] not in alone], single

    @staticmethod
    def _least(blocks: DataFrame, todo: list) -> dict:
        """For each open segment: the cuts (end, blocks, weight, sum before it), its totals, and whether no prefix sum is below zero."""
        starts, ends = np.array([t[0] for t in todo]), np.array([t[1] for t in todo])
        shared = blocks.sparkSession.sparkContext.broadcast((starts, ends, [np.array(t[2], float) for t in todo]))
        names = ["seg", "level", "first", "n", "w", "wy", "total", "size", "best", "at", "best_n", "best_w", "best_wy"]

        def scan(batches):
            starts, ends, levels = shared.value
            run, last = None, None

            def row():
                k = len(run["best"])
                columns = [np.full(k, run["seg"]), np.arange(k), np.full(k, run["first"]), *(np.full(k, run[c]) for c in ("n", "w", "wy")), run["total"], run["size"], run["best"], run["at"], *run["sums"]]
                return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64 if name in ("seg", "level", "first", "n", "at", "best_n") else float)) for c, name in zip(columns, names, strict=True)], names)

            for b in batches:
                if not b.num_rows:
                    continue
                at, y, w = (b.column(c).to_numpy() for c in ("at", "y", "w"))
                seg = np.searchsorted(starts, at, "right") - 1
                seg = np.where((seg >= 0) & (at <= ends[seg]), seg, -1)
                edges = np.concatenate(([0], np.flatnonzero((np.diff(seg) != 0) | (np.diff(at) != 1)) + 1, [len(at)]))
                for a, z in zip(edges[:-1], edges[1:], strict=True):
                    if seg[a] < 0:
                        continue
                    if run is None or run["seg"] != seg[a] or at[a] != last + 1:
                        if run is not None:
                            yield row()
                        k = len(levels[seg[a]])
                        run = {"seg": int(seg[a]), "first": int(at[a]), "n": 0, "w": 0.0, "wy": 0.0, "total": np.zeros(k), "size": np.zeros(k), "best": np.full(k, np.inf), "at": np.zeros(k), "sums": np.zeros((3, k))}
                        run["at"] = np.zeros(k, np.int64)
                    weight, value = w[a:z], y[a:z]
                    cw, cwy = np.cumsum(weight), np.cumsum(weight * value)
                    for j, t in enumerate(levels[seg[a]]):
                        term = weight * (value - t)
                        c = np.cumsum(term)
                        m = int(c.argmin())
                        if run["total"][j] + c[m] < run["best"][j]:
                            run["best"][j], run["at"][j] = run["total"][j] + c[m], at[a + m]
                            run["sums"][:, j] = run["n"] + m + 1, run["w"] + cw[m], run["wy"] + cwy[m]
                        run["total"][j] += c[-1]
                        run["size"][j] += np.abs(term).sum()
                    run["n"], run["w"], run["wy"], last = run["n"] + int(z - a), run["w"] + cw[-1], run["wy"] + cwy[-1], at[z - 1]
            if run is not None:
                yield row()

        whole = {"seg", "level", "first", "n", "at", "best_n"}
        got = blocks.select("at", "y", "w").mapInArrow(scan, ", ".join(f"{c} {'long' if c in whole else 'double'}" for c in names)).toPandas()
        out = {}
        for (k, _), runs in got.sort_values(["seg", "level", "first"]).groupby(["seg", "level"], sort=True):
            cuts, _, flat = out.setdefault(k, [[], None, False])
            upto = {c: runs[c].cumsum().to_numpy() for c in ("n", "w", "wy", "total")}
            base = {c: v - runs[c].to_numpy() for c, v in upto.items()}
            sums = base["total"] + runs["best"].to_numpy()
            r = int(sums.argmin())
            cut = (int(runs["at"].iloc[r]), *(v[r] + runs[f"best_{c}"].iloc[r] for c, v in base.items() if c != "total"))
            total = tuple(upto[c][-1] for c in ("n", "w", "wy"))
            below = sums[r] < -TINY * runs["size"].sum()
            out[k][1], out[k][2] = total, flat or not below
            if below and 0 < cut[1] < total[0] and all(cut[0] != c[0] for c in cuts):
                cuts.append(cut)
        return out
