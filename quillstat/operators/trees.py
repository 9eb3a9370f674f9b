"""Decision trees, forests and boosting on binned features.

Trees grow from histograms: each pass sums (node, feature, bin) statistics of all open nodes of all trees, of which
only those that occur are kept; executors add them up and choose each node's split, the driver gets one row a node.
Features with at most ``max_bins`` distinct values are cut between each two
of them, so small tables give exact trees; others are cut at quantiles. Rows stay where they are: their node follows
from the trees so far, their bootstrap weight from a hash of the id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import ArrayModel, EmptyInput, InvalidParameter, num, require, vector, written
from ..functions.numeric import average_path
from .quantiles import exact_quantiles


def bin_edges(df: DataFrame, features: list[str], max_bins: int, min_in_bin: int = 1) -> list[np.ndarray]:
    """Thresholds of each feature: midpoints of distinct values, or of quantiles where there are too many.

    A task counts the distinct values it meets of each feature and gives a feature up when they are more than
    ``max_bins``, so what is sent and added up stays small. Neighbouring values share a bin until it has ``min_in_bin`` rows.
    """
    d = len(features)

    def counted(batches):
        found, over = [(np.zeros(0), np.zeros(0, np.int64))] * d, np.zeros(d, bool)
        for b in batches:
            for k in np.flatnonzero(~over):
                v = b.column(int(k)).drop_null().to_numpy(zero_copy_only=False)
                v, at = np.unique(np.concatenate((found[k][0], v + 0.0)), return_inverse=True)
                n = np.bincount(at, np.concatenate((found[k][1], np.ones(len(at) - len(found[k][1])))), minlength=len(v))
                found[k], over[k] = (v, n), len(v) > max_bins
        for k in range(d):
            v, n = (found[k][0][:1], [0.0]) if over[k] else found[k]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(v), pa.int32()), pa.array(v, pa.float64()), pa.array(n, pa.float64()), pa.array([bool(over[k])] * len(v), pa.bool_())], ["k", "v", "n", "over"])

    parts = df.select(*[num(c).alias(f"f{k}") for k, c in enumerate(features)]).mapInArrow(counted, "k int, v double, n double, over boolean")
    each = parts.groupBy("k", "v").agg(F.sum("n").alias("n"), F.bool_or("over").alias("over"))
    pairs = F.slice(F.sort_array(F.collect_list(F.struct("v", "n"))), 1, max_bins + 1).alias("pairs")  # max_bins values a task at most
    got = {r["k"]: r for r in each.groupBy("k").agg(F.bool_or("over").alias("over"), F.count(F.lit(1)).alias("c"), pairs).collect()}
    if not got and df.isEmpty():
        raise EmptyInput("no rows")
    values, many = {c: (np.zeros(0), np.zeros(0)) for c in features}, []
    for k, c in enumerate(features):
        if k in got and (got[k]["over"] or got[k]["c"] > max_bins):
            many.append(c)
        elif k in got:
            values[c] = tuple(np.array([r[q] for r in got[k]["pairs"]], float) for q in ("v", "n"))
    if many:
        share = F.array(*[F.lit(k / max_bins) for k in range(max_bins + 1)])
        cuts = df.agg(*[F.percentile_approx(num(c), share, 20 * max_bins) for c in many]).first()
        values |= {c: (v := np.unique(np.array(cuts[k], float)), np.full(len(v), np.inf)) for k, c in enumerate(many)}
    edges = []
    for c in features:
        v, n = values[c]
        keep, held = [], 0.0
        for i in range(len(v) - 1):
            held += n[i]
            if held >= min_in_bin and n[i + 1 :].sum() >= min_in_bin:
                keep.append((v[i] + v[i + 1]) / 2)
                held = 0.0
        edges.append(np.array(keep))
    return edges


def _categories(df: DataFrame, column: str, most: int) -> np.ndarray:
    """The values of a categorical feature in order."""
    values = np.array(sorted(r[0] for r in df.select(num(column).alias("v")).filter("v IS NOT NULL").distinct().limit(most + 1).collect()), float)
    if len(values) > most:
        raise InvalidParameter(f"{column} has more than {most} categories")
    return values


@dataclass
class Tree:
    """Flat nodes; a leaf has feature -1. ``value`` holds class weights or one number."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[list[float]] = field(default_factory=lambda: [[0.0]])
    depth: list[int] = field(default_factory=lambda: [0])
    gain: dict[int, float] = field(default_factory=dict)
    bounds: dict[int, tuple] = field(default_factory=dict)
    missing_left: list[int] = field(default_factory=list)
    members: dict[int, list[float]] = field(default_factory=dict)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: ``<=``, or a category among the node's ``members``, goes left; a missing value right but
        in nodes of ``missing_left``."""
        at, f = np.zeros(len(x), np.int64), np.array(self.feature)
        cut, left, right = np.array(self.cut), np.array(self.left), np.array(self.right)
        turned = np.isin(np.arange(len(f)), self.missing_left)
        while True:
            go = np.flatnonzero(f[at] >= 0)
            if not len(go):
                return at
            k = at[go]
            v = x[go, f[k]]
            low = v <= cut[k]
            for node, values in self.members.items():
                here = k == node
                low[here] = np.isin(v[here], values)
            at[go] = np.where(low | (np.isnan(v) & turned[k]), left[k], right[k])

    def split(self, node: int, feature: int, cut: float, gain: float, missing_left: bool = False, members: list[float] | None = None) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, float(cut), a, a + 1
        self.gain[feature] = self.gain.get(feature, 0.0) + float(gain)
        if missing_left:
            self.missing_left.append(node)
        if members is not None:
            self.members[node] = members
        for _ in range(2):
            self.feature.append(-1)
            self.cut.append(0.0)
            self.left.append(-1)
            self.right.append(-1)
            self.value.append([0.0])
            self.depth.append(self.depth[node] + 1)
        return a, a + 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf(x)]


def _draws(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """A number from 0 to 1 from a hash of row and tree."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree * 0xBF58476D1CE4E5B9 + seed * 0x94D049BB133111EB) % (1 << 64))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))).astype(np.float64) / 2.0**64


def _times(ids: np.ndarray, tree: int, seed: int, bootstrap: bool, share: float) -> np.ndarray:
    """How often a tree sees each row: Poisson with mean ``share``, or (without bootstrap) a hashed share of them once."""
    u = _draws(ids, tree, seed)
    if not bootstrap:
        return (u < share).astype(float)
    each = np.exp(-share) * np.cumprod(np.concatenate(([1.0], share / np.arange(1, 24))))
    return np.searchsorted(np.cumsum(each), u).astype(float)


class Rows:
    """A batch of rows as arrays: features ``x``, label ``y``, ``id``, weight ``w``, and scores so far ``z``."""

    def __init__(self, batch: pa.RecordBatch):
        wide = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
        self.x, self.z = wide("x"), wide("z")
        self.y, self.id, self.w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "id", "w"))

    def __len__(self) -> int:
        return len(self.y)


@dataclass
class Growth:
    """How trees grow: criterion, limits, randomness."""

    criterion: str = "gini"
    max_depth: int = 30
    min_split: int = 2
    min_leaf: int = 1
    max_leaves: int | None = None
    max_bins: int = 255
    bootstrap: bool = False
    share: float = 1.0
    features: float | str | int | None = None
    random_cut: bool = False
    l1: float = 0.0
    l2: float = 0.0
    seed: int = 0
    stop_at_zero: bool = False
    monotone: list[int] | None = None
    #: Missing values have a bin of their own, and each split sends them to the better side.
    missing: bool = False
    #: Values of the features that are categories.
    categories: dict[int, np.ndarray] = field(default_factory=dict)
    min_hessian: float = 0.0
    #: What a split must gain, beyond nothing.
    min_gain: float = 0.0


def _newton(z: np.ndarray, l1: float, l2: float, low: float = -np.inf, high: float = np.inf) -> np.ndarray:
    """Leaf values of (weight, gradient, hessian) sums, held between the node's bounds."""
    return np.clip(np.sign(z[..., 1]) * np.maximum(np.abs(z[..., 1]) - l1, 0) / np.maximum(z[..., 2] + l2, 1e-300), low, high)


def _columns(mode, d: int, rng) -> np.ndarray:
    n = {None: d, "sqrt": max(1, int(d**0.5)), "log2": max(1, int(np.log2(d)))}.get(mode) if not isinstance(mode, (int, float)) or isinstance(mode, bool) else (mode if isinstance(mode, int) else max(1, int(mode * d)))
    return np.sort(rng.permutation(d)[: min(n, d)])


def _impurity(h: np.ndarray, how: str) -> np.ndarray:
    """Weighted impurity of statistics in the last axis."""
    if how in ("gini", "entropy"):
        n = h.sum(axis=-1)
        p = h / np.maximum(n, 1e-300)[..., None]
        return n * (1 - (p * p).sum(axis=-1) if how == "gini" else -(p * np.log2(np.maximum(p, 1e-300))).sum(axis=-1))
    w, s, q = h[..., 0], h[..., 1], h[..., 2]
    return q - s * s / np.maximum(w, 1e-300)


def _gain(left: np.ndarray, total: np.ndarray, g: Growth) -> np.ndarray:
    """Reduction by each cut, given the sums (..., statistic) on its left; -inf where a side is too small."""
    right = total - left
    if g.criterion == "gradient":
        soft = lambda s: np.sign(s) * np.maximum(np.abs(s) - g.l1, 0)
        score = lambda z: soft(z[..., 1]) ** 2 / np.maximum(z[..., 2] + g.l2, 1e-300)
        gain = score(left) + score(right) - score(total)
    else:
        gain = _impurity(total, g.criterion) - _impurity(left, g.criterion) - _impurity(right, g.criterion)
    size = (lambda z: z.sum(axis=-1)) if g.criterion in ("gini", "entropy") else (lambda z: z[..., 0])
    ok = (size(left) >= max(g.min_leaf, 1e-12)) & (size(right) >= max(g.min_leaf, 1e-12))
    if g.min_hessian:
        ok &= (left[..., 2] >= g.min_hessian) & (right[..., 2] >= g.min_hessian)
    return np.where(ok, gain, -np.inf)


def _by_response(h: np.ndarray, g: Growth) -> np.ndarray:
    """Categories (bin, statistic) by their mean response, those without rows last: some prefix is the best subset."""
    below = h[:, 2 if g.criterion == "gradient" else 0]
    return np.lexsort((h[:, 1] / np.maximum(below, 1e-300), h[:, 0] <= 0))


#: What is known of an open node: its tree, place there, depth, candidate features, and bounds of its value.
Open = tuple[int, int, int, np.ndarray, tuple[float, float]]


def _best(h: np.ndarray, node: Open, g: Growth, edges: list[np.ndarray], seed: list[int]):
    """(statistics, gain, feature, cut, middle, missing left, members) of a node's best split from its histogram (feature,
    bin, statistic); gain is None where it stays a leaf."""
    _, _, depth, columns, (low, high) = node
    h, width = h[columns], h.shape[1]
    total = h[0].sum(axis=0)
    n = total.sum() if g.criterion in ("gini", "entropy") else total[0]
    leaf = (total, None, None, None, None, None, None)
    if depth >= g.max_depth or n < g.min_split or width < 2:
        return leaf
    if g.criterion != "gradient" and _impurity(total, g.criterion) < 1e-12 * max(1.0, n):
        return leaf
    miss, h = (h[:, -1], h[:, :-1]) if g.missing else (None, h)
    order = {r: _by_response(h[r], g) for r, j in enumerate(columns) if j in g.categories}
    for r, o in order.items():
        h[r] = h[r][o]
    left = np.cumsum(h, axis=1)
    # Missing values right, then left; there the last cut parts them from all others.
    left = np.stack([left, left + miss[:, None]]) if g.missing else left[None, :, :-1]
    gain, middle = _gain(left, total, g), np.zeros(left.shape[:-1])
    if g.monotone:  # cuts whose sides would break a feature's direction are no candidates
        sign = np.array([g.monotone[j] for j in columns])[:, None]
        a = _newton(left, g.l1, g.l2, low, high)
        b = _newton(total - left, g.l1, g.l2, low, high)
        gain = np.where(sign * (b - a) < 0, -np.inf, gain)
        middle = (a + b) / 2
    if g.random_cut:  # one cut a feature, uniform between the node's ends
        rng = np.random.default_rng(seed)
        for r in range(len(h)):
            e = edges[columns[r]]
            seen = np.flatnonzero(h[r].sum(axis=1))
            u = rng.random()
            if len(seen) > 1 and len(e):
                u = e[seen[0]] + u * (e[seen[-1] - 1] - e[seen[0]])
                only = min(int(np.searchsorted(e, u)), len(e) - 1)
                gain[:, r, np.arange(gain.shape[2]) != only] = -np.inf
    gain = np.where(np.arange(gain.shape[2])[None, :] < np.array([len(edges[j]) + g.missing for j in columns])[:, None], gain, -np.inf)
    most = gain.max()
    if not np.isfinite(most) or (most <= max(1e-12, g.min_gain) and (g.stop_at_zero or g.criterion == "gradient")):
        return leaf
    # Sums come in any order: what differs by rounding only is equal, and the first of equals is taken.
    way, row, cut = (int(i) for i in np.unravel_index((gain >= most - 1e-9 * abs(most)).argmax(), gain.shape))
    j = int(columns[row])
    members = np.sort(g.categories[j][order[row][: cut + 1]]).tolist() if row in order else None
    at = float(edges[j][cut]) if cut < len(edges[j]) and members is None else np.inf
    return total, float(gain[way, row, cut]), j, at, float(middle[way, row, cut]), bool(way), members


def _node_splits(df: DataFrame, nodes: list[Open], trees: list[Tree], target, k: int, g: Growth, edges: list[np.ndarray], first_tree: int) -> list:
    """The best split of each open node: sparse sums by (node, cell) in Spark, then one histogram a node on executors."""
    d, width = len(edges), max((len(e) for e in edges), default=0) + 1 + g.missing
    place = {t: {n[1]: i for i, n in enumerate(nodes) if n[0] == t} for t in {n[0] for n in nodes}}

    def cells(batches):
        for batch in batches:
            b = Rows(batch)
            if not len(b):
                continue
            bins = np.column_stack([np.searchsorted(edges[j], b.x[:, j], "left") for j in range(d)])
            if g.missing:
                bins[np.isnan(b.x)] = width - 1
            for t, mine in place.items():
                w, s = target(b, first_tree + t)
                w = w * b.w
                if g.bootstrap or g.share < 1:
                    w = w * _times(b.id, first_tree + t, g.seed, g.bootstrap, g.share)
                of = np.full(len(trees[t].feature), -1)
                of[list(mine)] = list(mine.values())
                unit = of[trees[t].leaf(b.x)]
                use = np.flatnonzero((unit >= 0) & (w > 0))
                columns = nodes[next(iter(mine.values()))][3]
                base = ((unit[use, None] * d + columns[None, :]) * width + bins[use][:, columns]) * k
                key, value = [], []
                for q in range(k):
                    v = s[use, q] * w[use]
                    on = np.flatnonzero(v)
                    key.append((base[on] + q).ravel())
                    value.append(np.repeat(v[on], len(columns)))
                key, at = np.unique(np.concatenate(key), return_inverse=True)
                sums = np.bincount(at, np.concatenate(value), minlength=len(key))
                size = d * width * k
                yield pa.RecordBatch.from_arrays([pa.array((key // size).astype(np.int32)), pa.array((key % size).astype(np.int64)), pa.array(sums, pa.float64())], ["unit", "cell", "v"])

    def choose(key: tuple, rows: pa.Table) -> pa.Table:
        h, unit = np.zeros(d * width * k), key[0].as_py()
        h[rows.column("cell").to_numpy()] = rows.column("v").to_numpy()
        total, gain, feature, cut, middle, turned, members = _best(h.reshape(d, width, k), nodes[unit], g, edges, [g.seed, first_tree + nodes[unit][0], nodes[unit][1]])
        return pa.table({"unit": pa.array([unit], pa.int32()), "total": pa.array([total.tolist()], pa.list_(pa.float64())), "gain": pa.array([gain], pa.float64()), "feature": pa.array([feature], pa.int32()), "cut": pa.array([cut], pa.float64()), "middle": pa.array([middle], pa.float64()), "turned": pa.array([turned], pa.bool_()), "members": pa.array([members], pa.list_(pa.float64()))})

    sums = df.mapInArrow(cells, "unit int, cell bigint, v double").groupBy("unit", "cell").agg(F.sum("v").alias("v"))
    return sums.groupBy("unit").applyInArrow(choose, "unit int, total array<double>, gain double, feature int, cut double, middle double, turned boolean, members array<double>").collect()


def grow_forest(df: DataFrame, features: list[str], target, k: int, n_trees: int, g: Growth, edges: list[np.ndarray], first_tree: int = 0) -> list[Tree]:
    """Trees on rows made by _rows(); ``target(rows, tree)`` gives (weights, statistics per row).

    For classes the statistics are one-hot labels; else (1, value, value^2), or (1, gradient, hessian).
    """
    trees, rng = [Tree() for _ in range(n_trees)], np.random.default_rng(g.seed + 977 * first_tree)
    columns = [_columns(g.features, len(features), rng) for _ in range(n_trees)]
    open_: list[set[int]] = [{0} for _ in range(n_trees)]
    waiting: list[list] = [[] for _ in range(n_trees)]  # best-first: (gain, node, feature, cut, middle, missing left, members)
    for tree in trees:
        tree.value[0] = [0.0] * k
    while any(open_):
        nodes: list[Open] = [(t, n, trees[t].depth[n], columns[t], trees[t].bounds.get(n, (-np.inf, np.inf))) for t in range(n_trees) for n in sorted(open_[t])]
        live = [t for t in range(n_trees) if open_[t]]
        open_ = [set() for _ in range(n_trees)]
        for r in sorted(_node_splits(df, nodes, trees, target, k, g, edges, first_tree), key=lambda r: r["unit"]):
            t, node = nodes[r["unit"]][:2]
            trees[t].value[node] = list(r["total"])
            if r["gain"] is not None:
                waiting[t].append((r["gain"], node, r["feature"], r["cut"], r["middle"], r["turned"], r["members"]))
        for t in live:
            tree = trees[t]
            leaves = sum(f < 0 for f in tree.feature)
            room = len(waiting[t]) if g.max_leaves is None else min(1, g.max_leaves - leaves)
            waiting[t].sort(key=lambda w: (-w[0], w[1]))
            for gain, node, feature, cut, middle, turned, members in waiting[t][: max(0, room)]:
                pair = tree.split(node, feature, cut, gain, turned, members)
                open_[t] |= set(pair)
                if g.monotone:  # both sides of a constrained cut stay on their side of its middle, all the way down
                    low, high = tree.bounds.get(node, (-np.inf, np.inf))
                    sides = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
                    tree.bounds |= dict(zip(pair, sides.get(g.monotone[feature], ((low, high), (low, high))), strict=True))
            waiting[t] = waiting[t][max(0, room) :] if g.max_leaves is not None else []
    return trees


def _rows(df: DataFrame, features: list[str], label: str, id_col: str | None, weight: str | None = None, init_score: str | None = None) -> DataFrame:
    require(df, [*features, label, *[c for c in (weight, init_score) if c]])
    z = F.coalesce(F.col(f"`{init_score}`").cast("double"), F.lit(0.0)) if init_score else F.lit(0.0)
    ident = F.xxhash64(F.col(f"`{id_col}`")) if id_col else F.xxhash64(*[F.col(f"`{c}`") for c in [*features, label]])
    w = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    rows = df.select(vector(features).alias("x"), F.col(f"`{label}`").cast("double").alias("y"), ident.alias("id"), w.alias("w"), F.array(z).alias("z")).filter("y IS NOT NULL")
    return rows.filter("w > 0 AND NOT isnan(w)") if weight else rows


#: Rounds of boosting after which the rows' scores are written down, so that a pass evaluates that many trees at most.
KEEP_ROUNDS = 8


def _rescored(rows: DataFrame, scores) -> DataFrame:
    """The rows with ``z`` replaced by ``scores(rows)``, written down, so that a lost executor costs no earlier round; the old ones are let go."""

    def apply(batches):
        for batch in batches:
            z = scores(Rows(batch))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("x", "y", "id", "w")], flat], ["x", "y", "id", "w", "z"])

    new = written(rows.mapInArrow(apply, rows.schema), "scores").persist()
    rows.unpersist()
    return new


@dataclass
class ForestModel(ArrayModel):
    """Trees voting (classes) or averaged (numbers)."""

    features: list[str]
    trees: list[Tree]
    labels: list[float] | None = None
    tree_weights: list[float] | None = None

    def votes(self, x: np.ndarray) -> np.ndarray:
        w = self.tree_weights or [1.0] * len(self.trees)
        out = np.zeros((len(x), len(self.labels)))
        for t, v in zip(self.trees, w, strict=True):
            p = t.predict(x)
            # A leaf's tie goes to the larger label, the forest's to the smaller.
            out[np.arange(len(x)), p.shape[1] - 1 - p[:, ::-1].argmax(axis=1)] += v
        return out

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        if len(self.trees) == 1:
            p = self.trees[0].predict(x)
            return p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
        v = self.votes(x)
        return v / v.sum(axis=1, keepdims=True)

    def predict_array(self, x: np.ndarray) -> np.ndarray:
        if self.labels is not None:
            return np.array(self.labels)[self.votes(x).argmax(axis=1)]
        w = np.array(self.tree_weights or [1.0] * len(self.trees))
        each = []
        for t in self.trees:
            v = t.predict(x)
            each.append(v[:, 1] / np.maximum(v[:, 0], 1e-300))
        return np.column_stack(each) @ (w / w.sum())

    def importances(self) -> np.ndarray:
        out = np.zeros(len(self.features))
        for t in self.trees:
            own = np.zeros(len(self.features))
            for j, v in t.gain.items():
                own[j] += v
            out += own / own.sum() if own.sum() > 0 else 0
        return out / max(out.sum(), 1e-300)


@dataclass
class _TreeEnsemble:
    n_trees: int = 1
    criterion: str = "gini"
    max_depth: int = 30
    min_split: int = 2
    min_leaf: int = 1
    max_features: float | str | int | None = None
    max_bins: int = 255
    seed: int = 0
    class_weight: str | dict | None = None
    bootstrap: bool = False
    random_cut: bool = False
    regression: bool = False
    max_samples: float = 1.0

    def _growth(self, criterion: str) -> Growth:
        if not 0 < self.max_samples <= 1:
            raise InvalidParameter("max_samples must be a share of the rows")
        return Growth(criterion, self.max_depth, self.min_split, self.min_leaf, None, self.max_bins, self.bootstrap, self.max_samples, self.max_features, self.random_cut, seed=self.seed)

    def fit(self, df: DataFrame, features: list[str], label: str, id_col: str | None = None, weight: str | None = None) -> ForestModel:
        """``weight`` names a column of row weights (rows weighing nothing are left out): 2 counts as the row twice."""
        rows = _rows(df, features, label, id_col, weight).cache()
        try:
            edges = bin_edges(df, features, self.max_bins)
            if self.regression:
                target = lambda b, t: (np.ones(len(b)), np.column_stack([np.ones(len(b)), b.y, b.y**2]))
                return ForestModel(features, grow_forest(rows, features, target, 3, self.n_trees, self._growth("mse"), edges))
            seen = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.sum("w").alias("n")).limit(1001).collect()}
            labels = sorted(seen)
            if len(labels) > 1000:
                raise InvalidParameter("more than 1000 classes")
            by_class = np.ones(len(labels))
            if self.class_weight == "balanced":
                by_class = np.array([sum(seen.values()) / (len(labels) * seen[y]) for y in labels])
            elif isinstance(self.class_weight, dict):
                by_class = np.array([self.class_weight.get(y, 1.0) for y in labels])

            def target(b, t):
                k = np.searchsorted(labels, b.y)
                return by_class[k], np.eye(len(labels))[k]

            return ForestModel(features, grow_forest(rows, features, target, len(labels), self.n_trees, self._growth(self.criterion), edges), labels)
        finally:
            rows.unpersist()


@dataclass
class DecisionTreeClassifier(_TreeEnsemble):
    pass


@dataclass
class DecisionTreeRegressor(_TreeEnsemble):
    regression: bool = True


@dataclass
class RandomForestClassifier(_TreeEnsemble):
    n_trees: int = 100
    bootstrap: bool = True


@dataclass
class RandomForestRegressor(RandomForestClassifier):
    regression: bool = True


@dataclass
class ExtraTreesClassifier(_TreeEnsemble):
    n_trees: int = 100
    random_cut: bool = True


@dataclass
class ExtraTreesRegressor(ExtraTreesClassifier):
    regression: bool = True


@dataclass
class BaggingClassifier(_TreeEnsemble):
    n_trees: int = 10
    bootstrap: bool = True


@dataclass
class BaggingRegressor(BaggingClassifier):
    regression: bool = True


def oob_score(model: ForestModel, df: DataFrame, features: list[str], label: str, id_col: str | None, seed: int = 0, max_samples: float = 1.0) -> float:
    """Accuracy (or R^2) of rows by the trees whose bootstrap left them out."""
    rows = _rows(df, features, label, id_col)

    def score(batches):
        for batch in batches:
            b = Rows(batch)
            if not len(b):
                continue
            out = np.column_stack([_times(b.id, t, seed, True, max_samples) == 0 for t in range(len(model.trees))])
            if model.labels is not None:
                votes = np.zeros((len(b), len(model.labels)))
                for t, tree in enumerate(model.trees):
                    p = tree.predict(b.x)
                    votes[np.arange(len(b)), p.argmax(axis=1)] += out[:, t]
                pred = np.array(model.labels)[votes.argmax(axis=1)]
            else:
                each = np.column_stack([(v := t.predict(b.x))[:, 1] / np.maximum(v[:, 0], 1e-300) for t in model.trees])
                pred = (each * out).sum(axis=1) / np.maximum(out.sum(axis=1), 1)
            seen = out.any(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(b.y[seen], pa.float64()), pa.array(pred[seen], pa.float64())], ["y", "p"])

    got = rows.mapInArrow(score, "y double, p double")
    if model.labels is not None:
        return got.agg(F.avg((F.col("y") == F.col("p")).cast("double"))).first()[0]
    r = got.agg(F.avg((F.col("y") - F.col("p")) ** 2), F.var_pop("y")).first()
    return 1 - r[0] / r[1] if r[1] else 0.0


@dataclass
class BoostedModel(ArrayModel):
    """init + rate * trees for each output; classes by sign (two) or the largest score."""

    features: list[str]
    init: list[float]
    rate: float
    rounds: list[list[Tree]]
    labels: list[float] | None = None
    link: str = "identity"

    def raw(self, x: np.ndarray, only: int | None = None) -> np.ndarray:
        out = np.tile(self.init, (len(x), 1)).astype(float)
        for trees in self.rounds:
            for k, t in enumerate(trees):
                if only is None or k == only:
                    out[:, k] += self.rate * t.predict(x)[:, 0]
        return out

    def since(self, rounds: int) -> BoostedModel:
        """What the rounds from a given one on add to the scores."""
        return BoostedModel(self.features, [0.0] * len(self.init), self.rate, self.rounds[rounds:], self.labels)

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        return self.proba_of(self.raw(x))

    def proba_of(self, z: np.ndarray) -> np.ndarray:
        """Chances of the classes by raw scores."""
        if len(self.labels) == 2:
            p = 1 / (1 + np.exp(-np.clip(z[:, 0], -500, 500)))
            return np.column_stack([1 - p, p])
        e = np.exp(z - z.max(axis=1, keepdims=True)) if self.link == "softmax" else 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return e / e.sum(axis=1, keepdims=True)

    def predict_array(self, x: np.ndarray) -> np.ndarray:
        if self.labels is None:
            return self.raw(x)[:, 0]
        return np.array(self.labels)[self.predict_proba(x).argmax(axis=1)]

    def importances(self) -> np.ndarray:
        out = np.zeros(len(self.features))
        for trees in self.rounds:
            for t in trees:
                for j, v in t.gain.items():
                    out[j] += v
        return out


def _steepness(gradient: np.ndarray) -> np.ndarray:
    """A gradient's size as an ordered whole number: sign-free exponent and seven bits of a 32-bit float."""
    return (np.abs(gradient).astype(np.float32).view(np.uint32) >> np.uint32(16)).astype(np.int64)


@dataclass
class _Boosting:
    """Gradient boosting; ``leaf`` says what a leaf adds: the mean residual or a (regularised) Newton step.

    ``monotone`` has 1, 0 or -1 for each feature: the raw score never falls, is free, or never rises with it.
    ``goss`` is (top, other): each tree sees the rows whose gradients are among the largest ``top`` share, and a
    hashed ``other`` share of all rows from the rest, weighted up to stand for it. Gradients are told apart to one
    part in 128. Both need Newton leaves.
    ``missing``: null and NaN go to the side that each split learns (to the right where it saw none), else always right.
    ``categorical`` names features of at most ``max_bins`` values each that are split by subsets, found in the order of
    their mean gradients; a value that is not among a subset (a new one, too) goes right. ``max_features`` is the share
    (or number) of features that each tree sees, ``min_hessian`` the least sum of hessians on a side, ``min_gain`` what a
    split must gain, ``min_in_bin`` the fewest rows of a bin (of features with at most ``max_bins`` values).
    """

    n_rounds: int = 100
    rate: float = 0.1
    max_depth: int = 3
    min_leaf: int = 1
    max_bins: int = 255
    max_leaves: int | None = None
    l1: float = 0.0
    l2: float = 0.0
    subsample: float = 1.0
    seed: int = 0
    leaf: str = "mean"
    loss: str = "l2"
    regression: bool = True
    early_stopping: int | None = None
    delta: float = 1.0
    balanced: bool = False
    monotone: list[int] | None = None
    goss: tuple[float, float] | None = None
    missing: bool = False
    categorical: list[str] | None = None
    max_features: float | str | int | None = None
    min_hessian: float = 0.0
    min_gain: float = 0.0
    min_in_bin: int = 1

    def fit(
        self, df: DataFrame, features: list[str], label: str, id_col: str | None = None, valid: DataFrame | None = None, weight: str | None = None,
        init_score: str | None = None, valid_weight: str | None = None,
    ) -> BoostedModel:
        """``weight`` names a column of row weights; rows weighing nothing are left out. ``valid`` is for early stopping, its
        rows weighted by ``valid_weight``. ``init_score`` names a column of scores to start from (one output only): the model then
        predicts what is to be added to them.
        """
        if init_score and not self.regression and df.select(label).distinct().limit(3).count() > 2:
            raise InvalidParameter("init_score needs one output")
        if (self.monotone or self.goss) and self.leaf == "mean":
            raise InvalidParameter("monotone and goss need Newton leaves")
        if self.monotone and (len(self.monotone) != len(features) or set(self.monotone) - {-1, 0, 1}):
            raise InvalidParameter("monotone needs 1, 0 or -1 for each feature")
        if self.goss and not (0 < self.goss[0] < 1 and 0 < self.goss[1] <= 1 - self.goss[0]):
            raise InvalidParameter("goss needs two shares of at most 1 together")
        if set(self.categorical or []) - set(features) or any(self.monotone and self.monotone[features.index(c)] for c in self.categorical or []):
            raise InvalidParameter("categorical names features, none of them monotone")
        rows = _rows(df, features, label, id_col, weight, init_score).cache()
        try:
            categories = {features.index(c): _categories(df, c, self.max_bins) for c in self.categorical or []}
            edges = bin_edges(df, features, self.max_bins, self.min_in_bin)
            labels = None if self.regression else sorted(r[0] for r in rows.select("y").distinct().limit(1001).collect())
            n = rows.agg(F.sum("w")).first()[0]
            if self.regression:
                init = [rows.agg(F.sum(F.col("y") * F.col("w")) / F.sum("w")).first()[0] if self.loss == "l2" else exact_quantiles(rows, [F.col("y")], [0.5])[0][0]]
                codes = None
            else:
                if not 2 <= len(labels) <= 1000:
                    raise InvalidParameter("needs 2 to 1000 classes")
                share = {r["y"]: r["n"] / n for r in rows.groupBy("y").agg(F.sum("w").alias("n")).collect()}
                codes = labels[1:] if len(labels) == 2 else labels
                init = [float(np.log(share[y] / (1 - share[y]))) for y in codes]
            init = [0.0] * len(init) if init_score else init
            model = BoostedModel(features, init, self.rate, [], labels)
            grow = Growth("mse" if self.leaf == "mean" else "gradient", self.max_depth, 2, self.min_leaf, self.max_leaves, self.max_bins, features=self.max_features, l1=self.l1, l2=self.l2, seed=self.seed, monotone=self.monotone if any(self.monotone or []) else None, missing=self.missing, categories=categories, min_hessian=self.min_hessian, min_gain=self.min_gain)
            best, since, kept = np.inf, 0, 0
            rows = _rescored(rows, lambda b: b.z + np.tile(init, (len(b), 1)).astype(float))
            held_out = _rows(valid, features, label, id_col, valid_weight, init_score) if valid is not None else None
            for r in range(self.n_rounds):
                if r - kept == KEEP_ROUNDS:
                    rows, kept = _rescored(rows, lambda b, recent=model.since(kept): b.z + recent.raw(b.x)), r  # noqa: B023
                trees = []
                for k in range(len(init)):

                    def slopes(b, k=k, recent=model.since(kept)):
                        y, z = b.y, b.z[:, k] + recent.raw(b.x, k)[:, k]
                        if codes is None:
                            res, hess = y - z, np.ones(len(y))
                            if self.loss == "l1":
                                res = np.sign(res)
                            elif self.loss == "huber":
                                res = np.clip(res, -self.delta, self.delta)
                        else:
                            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                            hit = (y == codes[k]).astype(float)
                            res, hess = hit - p, np.maximum(p * (1 - p), 1e-16)
                        return y, res, hess

                    top, rest = self._steep(rows, slopes) if self.goss else (0, 1.0)

                    def target(b, t, slopes=slopes, top=top, rest=rest):
                        y, res, hess = slopes(b)
                        w = np.ones(len(y))
                        if self.balanced and codes is not None:
                            w = np.array([1 / (len(labels) * share[v]) for v in y])
                        if self.subsample < 1:
                            u = ((b.id.astype(np.uint64) * np.uint64(0xD1342543DE82EF95 + 2 * r)) >> np.uint64(40)).astype(float) / 2.0**24  # noqa: B023
                            w = w * (u < self.subsample)
                        one = np.ones(len(y))
                        if self.goss and rest < 1:
                            u = ((b.id.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * r)) >> np.uint64(40)).astype(float) / 2.0**24  # noqa: B023
                            flat = _steepness(res) < top
                            w = np.where(flat, w * (u < rest) / rest, w)
                            one = np.where(flat, rest, 1.0)  # rows are counted as they are
                        return w, np.column_stack([one, res, res * res] if self.leaf == "mean" else [one, res, hess])

                    tree = grow_forest(rows, features, target, 3, 1, grow, edges, first_tree=r)[0]
                    tree.value = [[(v[1] / v[0] if v[0] else 0.0) if self.leaf == "mean" else float(_newton(np.array(v), self.l1, self.l2, *tree.bounds.get(i, ())))] if len(v) == 3 else [0.0] for i, v in enumerate(tree.value)]
                    tree.bounds = {}
                    trees.append(tree)
                model.rounds.append(trees)
                if self.early_stopping and valid is not None:
                    err = self._error(model, held_out)
                    best, since = (err, 0) if err < best - 1e-12 else (best, since + 1)
                    if since >= self.early_stopping:
                        model.rounds = model.rounds[: len(model.rounds) - since]
                        break
            return model
        finally:
            rows.unpersist()

    def _steep(self, rows: DataFrame, slopes) -> tuple[int, float]:
        """The steepness from which on rows are always taken, and the share to take of those below it."""

        def steps(batches):
            for batch in batches:
                if batch.num_rows:
                    key, n = np.unique(_steepness(slopes(Rows(batch))[1]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

        found = rows.mapInArrow(steps, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()  # 32,768 keys at most
        total, above, cut = sum(r["n"] for r in found), 0, 0
        for r in sorted(found, key=lambda r: -r["key"]):
            cut, above = r["key"], above + r["n"]
            if above >= self.goss[0] * total:
                break
        return cut, min(1.0, self.goss[1] * total / max(1, total - above))

    @staticmethod
    def _error(model: BoostedModel, rows: DataFrame) -> float:
        def loss(batches):
            for batch in batches:
                b = Rows(batch)
                if len(b):
                    z = b.z + model.raw(b.x)
                    if model.labels is None:
                        e = (b.y - z[:, 0]) ** 2
                    else:
                        e = -np.log(np.maximum(model.proba_of(z)[np.arange(len(b)), np.searchsorted(model.labels, b.y)], 1e-15))
                    yield pa.RecordBatch.from_arrays([pa.array([float((e * b.w).sum())]), pa.array([float(b.w.sum())])], ["s", "n"])

        r = rows.mapInArrow(loss, "s double, n double").agg(F.sum("s"), F.sum("n")).first()
        return (r[0] or 0.0) / max(1e-300, r[1] or 0.0)


@dataclass
class GradientBoostingRegressor(_Boosting):
    pass


@dataclass
class GradientBoostingClassifier(_Boosting):
    regression: bool = False


@dataclass
class HistGradientBoostingRegressor(_Boosting):
    max_depth: int = 6
    min_leaf: int = 20
    leaf: str = "newton"


@dataclass
class HistGradientBoostingClassifier(HistGradientBoostingRegressor):
    regression: bool = False


@dataclass
class LgbmRegressor(_Boosting):
    """Best-first growth to ``max_leaves``; losses l2, l1 and huber; early stopping keeps the best round only."""

    max_depth: int = 64
    max_leaves: int | None = 31
    min_leaf: int = 20
    leaf: str = "newton"
    missing: bool = True


@dataclass
class LgbmClassifier(LgbmRegressor):
    regression: bool = False


@dataclass
class AdaBoostClassifier:
    """SAMME on weighted stumps: the weights that resampling would draw by are used as they are."""

    n_rounds: int = 50
    rate: float = 1.0
    max_depth: int = 1
    max_bins: int = 255

    def fit(self, df: DataFrame, features: list[str], label: str, id_col: str | None = None) -> ForestModel:
        rows = _rows(df, features, label, id_col).cache()
        try:
            edges = bin_edges(df, features, self.max_bins)
            labels = sorted(r[0] for r in rows.select("y").distinct().limit(1001).collect())
            k, model = len(labels), ForestModel(features, [], labels, [])

            def logs(b, kept):
                z = b.z[:, 0].copy()
                for t, a in zip(model.trees[kept:], model.tree_weights[kept:], strict=True):
                    z += a * (ForestModel(features, [t], labels).predict_array(b.x) != b.y)
                return z

            kept = 0
            for r in range(self.n_rounds):
                if r - kept == KEEP_ROUNDS:
                    rows, kept = _rescored(rows, lambda b, kept=kept: logs(b, kept)[:, None]), r
                weights = lambda b, kept=kept: np.exp(np.minimum(logs(b, kept), 500))
                target = lambda b, t, weights=weights: (weights(b), np.eye(k)[np.searchsorted(labels, b.y)])
                tree = grow_forest(rows, features, target, k, 1, Growth(max_depth=self.max_depth, min_split=0, min_leaf=0), edges, r)[0]

                def errors(batches, tree=tree, weights=weights):
                    for batch in batches:
                        if batch.num_rows:
                            b = Rows(batch)
                            w = weights(b) * b.w
                            bad = ForestModel(features, [tree], labels).predict_array(b.x) != b.y
                            yield pa.RecordBatch.from_arrays([pa.array([float(w[bad].sum())]), pa.array([float(w.sum())])], ["e", "w"])

                e, w = rows.mapInArrow(errors, "e double, w double").agg(F.sum("e"), F.sum("w")).first()
                err = e / w
                if err >= 1 - 1 / k:
                    if not model.trees:
                        model.trees, model.tree_weights = [tree], [1.0]
                    break
                model.trees.append(tree)
                model.tree_weights.append(self.rate * float(np.log((1 - err) / max(err, 1e-10)) + np.log(k - 1)))
                if err <= 1e-12:
                    break
            return model
        finally:
            rows.unpersist()


@dataclass
class AdaBoostRegressor:
    """AdaBoost.R2 with weighted trees; the prediction is the weighted mean. Loss linear, square or exponential."""

    n_rounds: int = 50
    loss: str = "linear"
    max_depth: int = 3
    max_bins: int = 255

    def fit(self, df: DataFrame, features: list[str], label: str, id_col: str | None = None) -> ForestModel:
        rows = _rows(df, features, label, id_col).cache()
        try:
            edges, model, tops = bin_edges(df, features, self.max_bins), ForestModel(features, [], None, []), []

            def losses(t, x, y, top):
                e = np.abs(ForestModel(features, [t]).predict_array(x) - y) / max(top, 1e-300)
                return e if self.loss == "linear" else e * e if self.loss == "square" else 1 - np.exp(-e)

            def logs(b, kept):
                z = b.z[:, 0].copy()
                for t, a, top in zip(model.trees[kept:], model.tree_weights[kept:], tops[kept:], strict=True):
                    z -= (1 - losses(t, b.x, b.y, top)) * a
                return z

            kept = 0
            for r in range(self.n_rounds):
                if r - kept == KEEP_ROUNDS:
                    rows, kept = _rescored(rows, lambda b, kept=kept: logs(b, kept)[:, None]), r
                weights = lambda b, kept=kept: np.exp(logs(b, kept))
                target = lambda b, t, weights=weights: (weights(b), np.column_stack([np.ones(len(b)), b.y, b.y * b.y]))
                tree = grow_forest(rows, features, target, 3, 1, Growth("mse", self.max_depth, 0, 0), edges, r)[0]

                def sums(batches, top=None, tree=tree, weights=weights):
                    for batch in batches:
                        if batch.num_rows:
                            b = Rows(batch)
                            w, e = weights(b) * b.w, np.abs(ForestModel(features, [tree]).predict_array(b.x) - b.y)
                            yield pa.RecordBatch.from_arrays([pa.array([float(e.max())]), pa.array([float((w * (losses(tree, b.x, b.y, top) if top else e)).sum())]), pa.array([float(w.sum())])], ["top", "e", "w"])

                top = rows.mapInArrow(sums, "top double, e double, w double").agg(F.max("top")).first()[0]
                if top <= 0:
                    model.trees.append(tree)
                    model.tree_weights.append(1.0)
                    break
                e, w = rows.mapInArrow(lambda it, top=top, sums=sums: sums(it, top), "top double, e double, w double").agg(F.sum("e"), F.sum("w")).first()
                if e / w >= 0.5:
                    if not model.trees:
                        model.trees, model.tree_weights = [tree], [1.0]
                    break
                model.trees.append(tree)
                model.tree_weights.append(float(np.log((1 - e / w) / max(e / w, 1e-10))))
                tops.append(top)
            return model
        finally:
            rows.unpersist()


@dataclass
class IsolationModel(ArrayModel):
    features: list[str]
    trees: list[Tree]
    size: int
    threshold: float = 0.0

    def score_array(self, x: np.ndarray) -> np.ndarray:
        depth = np.zeros(len(x))
        for t in self.trees:
            leaf = t.leaf(x)
            depth += np.array(t.depth)[leaf] + average_path(np.array(t.value)[leaf, 0])
        return -(2.0 ** (-depth / len(self.trees) / max(float(average_path(self.size)), 1e-300)))

    def predict_array(self, x: np.ndarray) -> np.ndarray:
        return np.where(self.score_array(x) > self.threshold, 1.0, -1.0)


@dataclass
class IsolationForest:
    """Trees on small hashed samples grown on the driver; scores and the contamination cut are distributed."""

    n_trees: int = 100
    max_samples: int = 256
    contamination: float = 0.1
    seed: int = 0

    def fit(self, df: DataFrame, features: list[str], id_col: str) -> IsolationModel:
        require(df, [*features, id_col])
        n = df.count()
        if not n:
            raise EmptyInput("no rows")
        size = min(self.max_samples, n)
        # Each tree's sample is picked by its own hash of the id: a bit more than its share, of which the first go in.
        most = min(1.0, (size + 6 * size**0.5 + 8) / n)
        pick = F.array(*[F.xxhash64(id_col, F.lit(self.seed), F.lit(t)) for t in range(self.n_trees)])
        long = df.select(vector(features).alias("x"), F.posexplode(pick).alias("t", "h")).filter(F.pmod("h", F.lit(1 << 30)) < F.lit(most * (1 << 30)))
        pools: dict[int, list] = {}
        for r in long.collect():  # about n_trees * max_samples rows
            pools.setdefault(r["t"], []).append((r["h"], list(r["x"])))
        rng, trees = np.random.default_rng(self.seed), []
        for t in range(self.n_trees):
            x = np.array([v for _, v in sorted(pools.get(t, []))][:size], float).reshape(-1, len(features))
            tree = Tree()
            todo = [(0, x)] if len(x) else []
            while todo:
                node, part = todo.pop()
                tree.value[node] = [float(len(part))]
                lo, hi = part.min(axis=0), part.max(axis=0)
                can = np.flatnonzero(hi > lo)
                if len(part) <= 1 or tree.depth[node] >= np.ceil(np.log2(max(size, 2))) or not len(can):
                    continue
                j = int(rng.choice(can))
                cut = lo[j] + rng.random() * (hi[j] - lo[j])
                a, b = tree.split(node, j, cut, 0.0)
                todo += [(a, part[part[:, j] <= cut]), (b, part[part[:, j] > cut])]
            trees.append(tree)
        model = IsolationModel(features, trees, size)
        s = model.transform_vector(df, "_column", "__s").select(F.col("__s")[0].alias("s")).persist()
        model.threshold = exact_quantiles(s, [F.col("s")], [self.contamination])[0][0]
        s.unpersist()
        return model


IsolationModel._column = lambda self, x: self.score_array(x)[:, None]
