"""A space-partitioning index as tables: cells cut at medians, searched by exact boxes; joins by nearness on top of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import EmptyInput, InvalidParameter, require, vector, written

#: Rows of a cell, about, and rows of a table that is one cell; numbers that boxes and sample may take.
CELL_ROWS = 2048
ONE_CELL = 2048
BOX_NUMBERS = 1 << 21
SAMPLE_NUMBERS = 1 << 22
#: Queries that meet one copy of a cell, and distances a task holds at once (8 MB).
QUERY_ROWS = 1 << 15
BLOCK_CELLS = 1 << 20
#: Boxes this much farther than the bound, relatively, are still searched: distances are rounded.
SLACK = 1e-9

METRICS = ("euclidean", "manhattan", "cosine")


def gaps(q: np.ndarray, t: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all queries from all reference rows, summed column by column as numeric.distance() does."""
    out = np.zeros((len(q), len(t)))
    if metric == "cosine":
        size = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((t * t).sum(1))[None]
        return np.where(size == 0, 1.0, 1 - q @ t.T / np.where(size == 0, 1.0, size))
    for j in range(q.shape[1]):
        d = q[:, j, None] - t[None, :, j]
        out += d * d if metric == "euclidean" else np.abs(d)
    return np.sqrt(out) if metric == "euclidean" else out


def nearest(gap: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, distance) of the k least of each line, ties by place, in that order."""
    limit = np.partition(gap, min(k, gap.shape[1]) - 1, axis=1)[:, min(k, gap.shape[1]) - 1]
    row, at = np.nonzero((gap <= limit[:, None]) & (gap < np.inf))
    d = gap[row, at]
    order = np.lexsort((at, d, row))
    row, at, d = row[order], at[order], d[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], at[rank < k], d[rank < k]


def placed(x: np.ndarray, metric: str) -> np.ndarray:
    """Where rows lie in the space of the boxes: cosine searches directions."""
    if metric != "cosine":
        return x
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.where(size > 0, x / np.where(size > 0, size, 1.0), 0.0)


class Cells:
    """A k-d tree over a sample, its leaves the cells, with the exact boxes of all rows in each; numpy only.

    Inner nodes cut the widest dimension at the sample's median; where most of the sample is equal there, at the nearest value that cuts.
    """

    def __init__(self, sample: np.ndarray, cells: int):
        self.axis, self.cut, self.down, self.leaf = [], [], [], []
        todo, depth, self.size = [(np.arange(len(sample)), cells, -1, 0)], 0, 0
        while todo:
            rows, share, parent, side = todo.pop()
            node = len(self.axis)
            if parent >= 0:
                self.down[parent][side] = node
            self.axis.append(0), self.cut.append(0.0), self.down.append([-1, -1]), self.leaf.append(-1)
            x = sample[rows]
            wide = x.max(0) - x.min(0) if len(rows) else np.zeros(sample.shape[1])
            if share > 1 and len(rows) > 1 and wide.max() > 0:
                a = int(wide.argmax())
                v = np.sort(x[:, a])
                m = v[(len(v) - 1) // 2]
                cut = m if m < v[-1] else v[np.searchsorted(v, m) - 1]
                low = x[:, a] <= cut
                self.axis[node], self.cut[node] = a, float(cut)
                todo.append((rows[~low], share - share // 2, node, 1))
                todo.append((rows[low], share // 2, node, 0))
            else:
                self.leaf[node], self.size = self.size, self.size + 1
        self.axis, self.cut, self.down, self.leaf = (np.array(v) for v in (self.axis, self.cut, self.down, self.leaf))
        self.counts = np.zeros(self.size, np.int64)

    def cell(self, x: np.ndarray) -> np.ndarray:
        """The cell each row falls in."""
        node = np.zeros(len(x), np.int64)
        while (inner := np.flatnonzero(self.leaf[node] < 0)).size:
            at = node[inner]
            node[inner] = self.down[at, (x[inner, self.axis[at]] > self.cut[at]).astype(int)]
        return self.leaf[node]

    def bound(self, low: np.ndarray, high: np.ndarray, counts: np.ndarray) -> None:
        """Takes the boxes and counts of the cells (infinite boxes, wrong way round, for empty ones) and makes those of inner nodes."""
        self.counts = counts
        self.low, self.high = np.full((len(self.leaf), low.shape[1]), np.inf), np.full((len(self.leaf), low.shape[1]), -np.inf)
        for node in range(len(self.leaf) - 1, -1, -1):
            a, b = self.down[node]
            self.low[node] = low[self.leaf[node]] if a < 0 else np.minimum(self.low[a], self.low[b])
            self.high[node] = high[self.leaf[node]] if a < 0 else np.maximum(self.high[a], self.high[b])

    def _least(self, x: np.ndarray, node: np.ndarray, metric: str) -> np.ndarray:
        """At most the distance of each row from anything in its node's box."""
        d = np.maximum(np.maximum(self.low[node] - x, x - self.high[node]), 0)
        if metric == "manhattan":
            return d.sum(1)
        return np.sqrt((d * d).sum(1)) if metric == "euclidean" else (d * d).sum(1) / 2

    def within(self, x: np.ndarray, reach: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells whose box is not farther from the row than its reach."""
        rows, cells = [], []
        reach = reach * (1 + SLACK) + 1e-300 + (1e-12 if metric == "cosine" else 0)
        for a in range(0, len(x), 4096):
            row, node = np.arange(a, min(a + 4096, len(x))), np.zeros(min(4096, len(x) - a), np.int64)
            while len(row):
                near = self._least(x[row], node, metric) <= reach[row]
                row, node = row[near], node[near]
                end = self.leaf[node] >= 0
                rows.append(row[end]), cells.append(self.leaf[node[end]])
                row, node = np.repeat(row[~end], 2), self.down[node[~end]].reshape(-1)
        return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *cells])

    def summed(self, sums: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """A line of sums for every node, of those of some cells."""
        totals, place = np.zeros((len(self.leaf), sums.shape[1])), np.zeros(self.size, np.int64)
        place[self.leaf[self.leaf >= 0]] = np.flatnonzero(self.leaf >= 0)
        totals[place[cells]] = sums
        for node in range(len(self.leaf) - 1, -1, -1):
            if self.leaf[node] < 0:
                totals[node] = totals[self.down[node][0]] + totals[self.down[node][1]]
        return totals

    def inside(self, x: np.ndarray, reach: float, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sums, row, cell): the totals of all nodes whose box is wholly within reach of each row, and the cells partly within it (Euclidean).

        ``totals`` has a line a node. Boxes near the edge, within rounding, count as partly within.
        """
        sums, rows, cells = np.zeros((len(x), totals.shape[1])), [], []
        for a in range(0, len(x), 4096):
            row, node = np.arange(a, min(a + 4096, len(x))), np.zeros(min(4096, len(x) - a), np.int64)
            while len(row):
                near = self._least(x[row], node, "euclidean") <= reach * (1 + SLACK) + 1e-300
                row, node = row[near], node[near]
                far = np.maximum(np.abs(x[row] - self.low[node]), np.abs(x[row] - self.high[node]))
                whole = np.sqrt((far * far).sum(1)) <= reach * (1 - SLACK)
                for c in range(totals.shape[1]):
                    sums[:, c] += np.bincount(row[whole], totals[node[whole], c], minlength=len(x))
                row, node = row[~whole], node[~whole]
                end = self.leaf[node] >= 0
                rows.append(row[end]), cells.append(self.leaf[node[end]])
                row, node = np.repeat(row[~end], 2), self.down[node[~end]].reshape(-1)
        return sums, np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *cells])

    def reach(self, x: np.ndarray, k: int, metric: str) -> np.ndarray:
        """A distance within which each row surely has k rows: the farthest corners of the nearest boxes that hold as many."""
        leaves = np.flatnonzero(self.leaf >= 0)
        leaves = leaves[self.counts[self.leaf[leaves]] > 0]
        out = np.full(len(x), np.inf)
        for r in range(len(x)):
            far = np.maximum(np.abs(x[r] - self.low[leaves]), np.abs(x[r] - self.high[leaves]))
            d = far.sum(1) if metric == "manhattan" else np.sqrt((far * far).sum(1)) if metric == "euclidean" else np.full(len(leaves), 2.0)
            order = np.argsort(d)
            held = np.cumsum(self.counts[self.leaf[leaves[order]]])
            if held[-1] >= k:
                out[r] = d[order[np.searchsorted(held, k)]]
        return out


class Index:
    """Reference rows dealt to cells: ``table`` (cell, part, t_id, x, t_<keep>...), and the cells for tasks.

    The tree is cut on a sample of at most SAMPLE_NUMBERS numbers, taken in the order of a hash of ids; boxes come from
    all rows, so searches are exact however the sample falls. There are at most BOX_NUMBERS / features cells, so what tasks get is bounded; a cell
    with more than twice its share of rows has several parts, by a hash of the id. Rows with a missing number are left out.
    """

    def __init__(self, df: DataFrame, id_col: str, features: list[str], metric: str = "euclidean", keep: tuple[str, ...] = (), most_equal: int | None = None, cell_rows: int = CELL_ROWS):
        if metric not in METRICS:
            raise InvalidParameter("metric")
        require(df, [id_col, *features])
        self.spark, self.metric, self.d, self.keep = df.sparkSession, metric, len(features), keep
        x = vector(features)
        rows = df.select(F.col(id_col).alias("t_id"), x.alias("x"), *[F.col(c).alias(f"t_{c}") for c in keep])
        rows = rows.filter(F.col("t_id").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
        few = rows.limit(ONE_CELL + 1).count() <= ONE_CELL
        if most_equal is not None and not few:
            # Of rows at one point only the first can be among anyone's nearest: salted first, so no point is one task's.
            part = F.pmod(F.xxhash64("t_id"), F.lit(64))
            first = F.row_number().over(Window.partitionBy("x", "part").orderBy("t_id"))
            rows = rows.withColumn("part", part).withColumn("first", first).filter(F.col("first") <= most_equal)
            rows = rows.withColumn("first", F.row_number().over(Window.partitionBy("x").orderBy("t_id"))).filter(F.col("first") <= most_equal).drop("part", "first")
            rows = written(rows, "points")
        n = rows.count()
        if not n:
            raise EmptyInput("no reference rows")
        self.rows, self.kinds = n, {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
        cells = 1 if few else int(min(-(-n // cell_rows), max(1, BOX_NUMBERS // (2 * self.d))))
        share = -(-n // cells)
        take = min(n, max(1, SAMPLE_NUMBERS // self.d), 64 * cells)
        sample = np.zeros((0, self.d))
        if cells > 1:
            chosen = rows if take == n else rows.filter(F.pmod(F.xxhash64("t_id", F.lit(17)), F.lit(1 << 20)) < int(min(1.0, 1.2 * take / n) * (1 << 20)) + 1)
            sample = placed(_matrix(chosen.select("x").limit(2 * take).toArrow().column("x"), self.d), metric)
        tree = Cells(sample, cells)
        #: Pairs of a query and a reference row that searches have compared so far.
        self.compared = self.spark.sparkContext.accumulator(0)
        #: A table of one cell needs no tree: its rows, ONE_CELL at most, go to all tasks.
        self.only = None
        if few:
            fields = F.struct("t_id", "x", *[f"t_{c}" for c in keep]).alias("r")
            self.only = rows.select(fields).toArrow().column("r").combine_chunks()
            self.only = self.only.take(pa.array(np.lexsort((_order(self.only.field("t_id")),))))
            self.cells, self.parts = tree, np.ones(1, np.int64)
            return
        shared = self.spark.sparkContext.broadcast(tree)  # BOX_NUMBERS at most
        if tree.size > 1:

            def deal(batches):
                for b in batches:
                    at = shared.value.cell(placed(_matrix(b.column("x"), self_d), self_metric))
                    yield b.append_column("cell", pa.array(at, pa.int64()))

            self_d, self_metric = self.d, metric
            dealt = rows.mapInArrow(deal, ", ".join(f"`{c}` {t}" for c, t in self.kinds.items()) + ", cell long")
        else:
            dealt = rows.withColumn("cell", F.lit(0).cast("long"))
        dealt = written(dealt, "cells")
        size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
        spot = F.when(size > 0, F.transform("x", lambda v: v / size)).otherwise(F.transform("x", lambda v: F.lit(0.0))) if metric == "cosine" else F.col("x")
        boxes = dealt.select("cell", F.posexplode(spot).alias("k", "v")).groupBy("cell", "k").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
        low, high, counts = np.full((tree.size, self.d), np.inf), np.full((tree.size, self.d), -np.inf), np.zeros(tree.size, np.int64)
        got = boxes.toArrow()  # BOX_NUMBERS at most
        c, k = got.column("cell").to_numpy(), got.column("k").to_numpy()
        low[c, k], high[c, k], counts[c] = got.column("low").to_numpy(), got.column("high").to_numpy(), got.column("n").to_numpy()
        if metric == "cosine":
            low, high = low - 1e-12, high + 1e-12
        tree.bound(low, high, counts)
        self.cells, self.parts = tree, np.maximum(1, counts // (2 * share))
        part = F.lit(0)
        if (self.parts > 1).any():
            part = F.pmod(F.xxhash64("t_id", F.lit(5)), F.element_at(F.lit(self.parts.tolist()), (F.col("cell") + 1).cast("int")))
        self.table = dealt.withColumn("part", part.cast("int"))
        self.shared = self.spark.sparkContext.broadcast((tree, self.parts))

    def visits(self, queries: DataFrame, how: str, k: int = 1) -> DataFrame:
        """Queries (q_id, x, ...) beside each (cell, part) they must look into.

        A table of one cell is visited by all. By ``how``, ``own``: their own cell; ``near``: all cells within column ``reach``; ``rest``: those but their own. A missing reach (their own
        cell doesn't hold k rows) is put at a distance that surely does.
        """
        if self.only is not None:
            return queries
        shared, metric, d = self.shared, self.metric, self.d

        def expand(batches):
            tree, parts = shared.value
            for b in batches:
                x = placed(_matrix(b.column("x"), d), metric)
                own = tree.cell(x)
                if how == "own":
                    row, cell = np.arange(len(x)), own
                else:
                    reach = b.column("reach").to_numpy(zero_copy_only=False).astype(float)
                    lost = np.flatnonzero(np.isnan(reach))
                    reach[lost] = tree.reach(x[lost], k, metric)
                    row, cell = tree.within(x, reach, metric)
                    if how == "rest":
                        row, cell = row[cell != own[row]], cell[cell != own[row]]
                times = parts[cell]
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                for a in range(0, len(row), 1 << 14):
                    some = b.take(pa.array(row[a : a + (1 << 14)]))
                    yield some.append_column("cell", pa.array(cell[a : a + (1 << 14)], pa.int64())).append_column("part", pa.array(part[a : a + (1 << 14)], pa.int32()))

        fields = ", ".join(f"`{c}` {t}" for c, t in queries.dtypes)
        return queries.mapInArrow(expand, f"{fields}, cell long, part int")

    def apart(self, queries: DataFrame, reach: float, weight: str, schema: str) -> tuple[DataFrame, DataFrame]:
        """(sums, visits): per query the weights, and weighted sums of x, of cells wholly within reach, and the (cell, part) at its edge.

        Sums of the cells are taken once (BOX_NUMBERS at most) and go to all tasks with the tree.
        """
        if getattr(self, "totals", None) is None:
            tree, d = self.cells, self.d
            w = F.col(weight)
            got = self.table.groupBy("cell").agg(F.sum(w), *[F.sum(w * F.get("x", F.lit(k))) for k in range(d)]).toArrow()
            totals = tree.summed(np.column_stack([got.column(k + 1).to_numpy() for k in range(d + 1)]), got.column(0).to_numpy())
            self.totals = self.spark.sparkContext.broadcast(totals)
        shared, totals, d = self.shared, self.totals, self.d
        names = ["q_id", "n", *[f"s{k}" for k in range(d)]]

        def add(batches):
            for b in batches:
                sums, _, _ = shared.value[0].inside(_matrix(b.column("x"), d), reach, totals.value)
                yield pa.RecordBatch.from_arrays([b.column("q_id"), *(pa.array(np.ascontiguousarray(v)) for v in sums.T)], names)

        def expand(batches):
            tree, parts = shared.value
            for b in batches:
                _, row, cell = tree.inside(_matrix(b.column("x"), d), reach, totals.value)
                times = parts[cell]
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                for a in range(0, len(row), 1 << 14):
                    some = b.take(pa.array(row[a : a + (1 << 14)]))
                    yield some.append_column("cell", pa.array(cell[a : a + (1 << 14)], pa.int64())).append_column("part", pa.array(part[a : a + (1 << 14)], pa.int32()))

        fields = ", ".join(f"`{c}` {t}" for c, t in queries.dtypes)
        return queries.mapInArrow(add, schema), queries.mapInArrow(expand, f"{fields}, cell long, part int")

    def meet(self, visits: DataFrame, compare: Callable, schema: str, load: Callable | None = None) -> DataFrame:
        """Runs ``compare(queries, matrix, loaded)`` on batches of queries beside the rows of the cell part they visit.

        Cells are packed into a row each and come before their queries in the sorted stream of a task, which so holds
        one cell at a time; a cell that many queries visit has copies for parts of them. ``load`` turns a cell's rows
        into what ``compare`` gets besides (ids and kept columns, as an Arrow struct array, sorted by id).
        """
        names, d, compared = [c for c in visits.columns if c not in ("cell", "part")], self.d, self.compared
        if self.only is not None:
            alone = self.spark.sparkContext.broadcast(self.only)

            def simply(batches):
                about = alone.value
                t = _matrix(about.field("x"), d)
                loaded = load(about, t) if load else about
                for b in batches:
                    compared.add(len(t) * b.num_rows)
                    yield from compare(b.select(names), t, loaded)

            return visits.mapInArrow(simply, schema)
        visits = written(visits, "visits")
        load_rows = visits.groupBy("cell", "part").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("copies"))
        copies = F.broadcast(load_rows.filter("copies > 1"))  # cells at most
        packed = self.table.groupBy("cell", "part").agg(F.sort_array(F.collect_list(F.struct("t_id", "x", *[f"t_{c}" for c in self.keep]))).alias("rows"))
        packed = packed.join(load_rows, ["cell", "part"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
        q = visits.join(copies, ["cell", "part"], "left").withColumn("copy", F.pmod(F.xxhash64("q_id", F.lit(3)), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
        stream = packed.withColumn("kind", F.lit(0)).unionByName(q.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        key = ["cell", "part", "copy"]
        stream = stream.select(*key, "kind", "rows", *names).repartition(*key).sortWithinPartitions(*key, "kind")

        def run(batches) -> Iterator[pa.RecordBatch]:
            t, about, loaded = None, None, None
            for b in batches:
                kind = b.column("kind").to_numpy()
                edges = np.concatenate((np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])) | (kind == 0)), [len(kind)])) if len(kind) else [0]
                for a, z in zip(edges[:-1], edges[1:], strict=True):
                    if kind[a] == 0:
                        about = b.column("rows").slice(int(a), 1).flatten()
                        t = _matrix(about.field("x"), d)
                        loaded = load(about, t) if load else about
                        continue
                    some = b.select(names).slice(int(a), int(z - a))
                    compared.add(len(t) * some.num_rows)
                    yield from compare(some, t, loaded)

        return stream.mapInArrow(run, schema)


def _matrix(column, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def _order(ids: pa.Array) -> np.ndarray:
    """Ranks of ids, by which they can be sorted whatever their type."""
    import pyarrow.compute as pc

    order = pc.sort_indices(ids).to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def usable(queries: DataFrame, id_col: str, features: list[str], *more: Column) -> DataFrame:
    """(q_id, x, ...) of the rows without missing numbers."""
    rows = queries.select(F.col(id_col).alias("q_id"), vector(features).alias("x"), *more)
    return rows.filter(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))


def search(index: Index, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(q_id, t_id, distance, rank, t_<keep>...): the k nearest rows of the index for each (q_id, x); ties by id.

    Each query looks into its own cell, then into all cells whose box is not farther than the k-th row found there: no other
    can hold a nearer one. Rows that the first look found and rows of the second are ranked together.
    """
    if k < 1:
        raise InvalidParameter("k")
    metric, d, keep = index.metric, index.d, index.keep
    schema = f"q_id {dict(queries.dtypes)['q_id']}, t_id {index.kinds['t_id']}, distance double, rank int" + "".join(f", t_{c} {index.kinds[f't_{c}']}" for c in keep)
    names = ["q_id", "t_id", "distance", "rank", *[f"t_{c}" for c in keep]]

    def compare(some, t, about):
        import pyarrow.compute as pc

        x, ids, step = _matrix(some.column("x"), d), some.column("q_id"), max(1, BLOCK_CELLS // max(1, len(t)))
        own = pc.index_in(ids, value_set=about.field("t_id")).to_numpy(zero_copy_only=False) if exclude_self else None
        for a in range(0, len(x), step):
            gap = gaps(x[a : a + step], t, metric)
            gap[np.isnan(gap)] = np.inf
            if exclude_self:
                mine = own[a : a + step].astype(float)
                hit = np.flatnonzero(~np.isnan(mine))
                gap[hit, mine[hit].astype(int)] = np.inf
            row, at, dist = nearest(gap, k)
            rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
            rows = about.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + a)), rows.field("t_id"), pa.array(dist), pa.array(rank, pa.int32()), *[rows.field(f"t_{c}") for c in keep]], names)

    queries = queries.select("q_id", "x")
    first = index.meet(index.visits(queries, "own"), compare, schema)
    if index.only is not None:
        return first
    top = Window.partitionBy("q_id").orderBy("distance", "t_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)
    first = written(best(first), "near")
    reach = first.filter(F.col("rank") == k).select(F.col("q_id").alias("r_id"), F.col("distance").alias("reach"))
    wide = queries.join(reach, F.col("q_id").eqNullSafe(F.col("r_id")), "left").drop("r_id")
    second = index.meet(index.visits(wide, "rest", k + exclude_self), compare, schema)
    return best(first.unionByName(second))


def within(index: Index, queries: DataFrame, eps: float) -> DataFrame:
    """(q_id, t_id, distance) of all pairs of a query and a row of the index at most ``eps`` apart."""
    metric, d = index.metric, index.d

    def compare(some, t, about):
        x, step = _matrix(some.column("x"), d), max(1, BLOCK_CELLS // max(1, len(t)))
        for a in range(0, len(x), step):
            gap = gaps(x[a : a + step], t, metric)
            row, at = np.nonzero(gap <= eps)
            yield pa.RecordBatch.from_arrays([some.column("q_id").take(pa.array(row + a)), about.field("t_id").take(pa.array(at)), pa.array(gap[row, at])], ["q_id", "t_id", "distance"])

    near = index.visits(queries.select("q_id", "x").withColumn("reach", F.lit(float(eps))), "near")
    return index.meet(near, compare, f"q_id {dict(queries.dtypes)['q_id']}, t_id {index.kinds['t_id']}, distance double")


def eps_join(a: DataFrame, b: DataFrame, id_col: str, features: list[str], eps: float, metric: str = "euclidean") -> DataFrame:
    """(a_id, b_id, distance) of all pairs at most ``eps`` apart: rows of ``a`` meet only cells of ``b`` within reach.

    Rows with a missing number are in no pair; rows that repeat an id are rows of their own.
    """
    if eps < 0:
        raise InvalidParameter("eps")
    try:
        index = Index(b, id_col, features, metric)
    except EmptyInput:
        kind = b.schema[id_col].dataType.simpleString()
        return a.sparkSession.createDataFrame([], f"a_id {a.schema[id_col].dataType.simpleString()}, b_id {kind}, distance double")
    return within(index, usable(a, id_col, features), eps).withColumnsRenamed({"q_id": "a_id", "t_id": "b_id"})


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, root): the least id that each of ``nodes`` (id) is linked with, by ``edges`` (a, b).

    Alternating stars: every node links its larger neighbours to its least one, then its neighbours not larger. Both
    are grouped minima with map-side combine; the number of rounds grows with the logarithm of the longest path.
    """
    e = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = written(large, "large")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select("a", "b", "m")
        new = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        new = written(new, "stars")
        if not new.exceptAll(e).isEmpty() or not e.exceptAll(new).isEmpty():
            e = new
            continue
        return nodes.select("id").distinct().join(new.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def linked(index: Index, queries: DataFrame, eps: float) -> DataFrame:
    """(q_id, t_id): rows of the index within ``eps`` of each query, one for each group of them that a cell shows to hang together.

    A cell's rows are first grouped by links of at most ``eps`` among themselves; a query gets the least id of each
    group that it reaches, so that dense cells give a few rows for each query and not all pairs. Rows of a group are linked by
    rows of the same kind: the index's own rows are queried as well.
    """
    metric, d = index.metric, index.d

    def load(about, t):
        group, todo = np.full(len(t), -1, np.int64), []
        for i in range(len(t)):
            if group[i] >= 0:
                continue
            group[i], todo = i, np.array([i])
            free = np.flatnonzero(group < 0)
            while len(todo) and len(free):
                hit = np.zeros(len(free), bool)
                step = max(1, BLOCK_CELLS // len(free))
                for a in range(0, len(todo), step):
                    hit |= (gaps(t[todo[a : a + step]], t[free], metric) <= eps).any(0)
                todo = free[hit]
                group[todo] = i
                free = free[~hit]
        return about.field("t_id"), group

    def compare(some, t, loaded):
        ids, group = loaded
        heads, number = np.unique(group, return_inverse=True)
        x, step = _matrix(some.column("x"), d), max(1, BLOCK_CELLS // max(1, len(t)))
        for a in range(0, len(x), step):
            row, at = np.nonzero(gaps(x[a : a + step], t, metric) <= eps)
            code = np.unique(row * len(heads) + number[at])
            row, at = code // len(heads), heads[code % len(heads)]
            yield pa.RecordBatch.from_arrays([some.column("q_id").take(pa.array(row + a)), ids.take(pa.array(at))], ["q_id", "t_id"])

    near = index.visits(queries.select("q_id", "x").withColumn("reach", F.lit(float(eps))), "near")
    return index.meet(near, compare, f"q_id {dict(queries.dtypes)['q_id']}, t_id {index.kinds['t_id']}", load)

