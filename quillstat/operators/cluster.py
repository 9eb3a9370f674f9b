"""Clustering: k-means and mixtures as passes over the data; all-pairs methods under a row cap."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import ROW_CAP, ArrayModel, EmptyInput, InvalidParameter, forget, matrix, require, summed, vector, written
from ..functions.numeric import digamma, lgamma
from . import lowrank, passes, spatial
from .quantiles import exact_quantiles
from .ranks import numbered


#: Rows of a cell where modes move by themselves, and numbers of different rows that go to all tasks for it.
MODE_CELL = 32
MODE_NUMBERS = 1 << 21
#: Rows up to which distances of clusters that merge are a dense matrix on the driver.
LINKAGE_DENSE = ROW_CAP
#: Rows up to which the affinities of spectral clustering are a dense matrix on the driver.
SPECTRAL_DENSE = 2000


def distances(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """Distances of all rows of a from all of b, from differences column by column: nothing cancels at large offsets."""
    b = a if b is None else b
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        out += np.multiply(gap, gap, out=gap)
    return np.sqrt(out, out=out)


def spread_start(x: np.ndarray, k: int, rng, w: np.ndarray | None = None) -> np.ndarray:
    """k-means++ seeds."""
    w = np.ones(len(x)) if w is None else w
    out = [x[rng.choice(len(x), p=w / w.sum())]]
    near = ((x - out[0]) ** 2).sum(1)
    while len(out) < k:
        p = near * w
        out.append(x[rng.choice(len(x), p=p / p.sum()) if p.sum() > 0 else rng.integers(len(x))])
        near = np.minimum(near, ((x - out[-1]) ** 2).sum(1))
    return np.array(out)


def hashed_sample(df: DataFrame, features: list[str], n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, weights): at most n distinct rows and how many rows each stands for; the same for any partitioning.

    Equal rows are counted first. Where there are more than n distinct ones, n are drawn with chances by their counts, by a hash of
    their values (Efraimidis-Spirakis: the least of -ln(u) / count), and stand for one each. Rows with a missing number are left out.
    """
    require(df, features)
    rows = df.select(vector(features).alias("x")).filter(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    distinct = rows.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    u = (F.pmod(F.xxhash64("x", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    got = distinct.select("x", "c", (-F.log(u) / F.col("c")).alias("key")).orderBy("key", "x").limit(n + 1).toArrow().combine_chunks()
    if not got.num_rows:
        raise EmptyInput("no rows")
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(got.num_rows, -1)
    return (x[:n], np.ones(n)) if len(x) > n else (x, got.column("c").to_numpy().astype(float))


@dataclass
class CentroidModel(ArrayModel):
    features: list[str]
    centroids: np.ndarray
    inertia: float = 0.0
    n_iter: int = 0

    def predict_array(self, x: np.ndarray) -> np.ndarray:
        return distances(x, self.centroids).argmin(axis=1)


@dataclass
class KMeans:
    """Lloyd's iteration: assignment and partial sums in every task, added up on executors.

    Starts from k-means++ on a hashed sample; stops when no centroid moves more than ``tol`` squared; an empty
    cluster keeps its centroid; ties go to the lowest index. ``weight`` names a column of row weights.
    """

    k: int = 8
    max_iter: int = 300
    tol: float = 1e-4
    seed: int = 0
    start_rows: int = 10_000

    def fit(self, df: DataFrame, features: list[str], weight: str | None = None) -> CentroidModel:
        if self.k < 1:
            raise InvalidParameter("k")
        pool, stands = hashed_sample(df, features, self.start_rows, self.seed)
        c, k = spread_start(pool, self.k, np.random.default_rng(self.seed), stands), self.k
        inertia, n, d = 0.0, 0, len(features)
        own = df if weight else df.withColumn("__one", F.lit(1.0))
        with passes.Table(own, features, weight or "__one") as table:
            for n in range(1, self.max_iter + 1):

                def sums(x, w, c=c):
                    w, gap = w.astype(float), distances(x, c)
                    at = gap.argmin(axis=1)
                    z = np.column_stack([w, x * w[:, None], w * gap[np.arange(len(x)), at] ** 2])
                    return np.stack([np.bincount(at, z[:, j], minlength=k) for j in range(d + 2)], 1).ravel()

                m = table.sums(sums).reshape(k, d + 2)
                new = np.where(m[:, :1] > 0, m[:, 1:-1] / np.maximum(m[:, :1], 1e-300), c)
                inertia, moved = float(m[:, -1].sum()), ((new - c) ** 2).sum(1).max()
                c = new
                if moved < self.tol:
                    break
        return CentroidModel(features, c, inertia, n)


@dataclass
class MiniBatchKMeans:
    """Batches are hashed samples; each row moves its centroid by 1 / (rows seen)."""

    k: int = 8
    batch: int = 256
    max_iter: int = 100
    seed: int = 0

    def fit(self, df: DataFrame, features: list[str]) -> CentroidModel:
        pool, stands = hashed_sample(df, features, min(self.batch * self.max_iter, 50_000), self.seed)
        rng = np.random.default_rng(self.seed)
        c, n = spread_start(pool, self.k, rng, stands), np.zeros(self.k)
        for _ in range(self.max_iter):
            x = pool[rng.choice(len(pool), size=self.batch, p=stands / stands.sum())]
            for v, j in zip(x, distances(x, c).argmin(axis=1), strict=True):
                n[j] += 1
                c[j] += (v - c[j]) / n[j]
        return CentroidModel(features, c)


@dataclass
class MixtureModel(ArrayModel):
    features: list[str]
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float = 0.0
    extra: np.ndarray | None = None

    def joint(self, x: np.ndarray) -> np.ndarray:
        out = []
        for k in range(len(self.weights)):
            d, c = x - self.means[k], self.covariances[k]
            p, ld = np.linalg.inv(c), np.linalg.slogdet(c)[1]
            add = 0.0 if self.extra is None else self.extra[k]
            out.append(np.log(max(self.weights[k], 1e-300)) - 0.5 * (len(c) * np.log(2 * np.pi) + ld) - 0.5 * np.einsum("ij,jk,ik->i", d, p, d) + add)
        return np.column_stack(out)

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        z = self.joint(x)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict_array(self, x: np.ndarray) -> np.ndarray:
        return self.joint(x).argmax(axis=1)


@dataclass
class GaussianMixture:
    """EM: responsibilities and weighted moments in every task, added up on executors."""

    k: int = 2
    covariance: str = "full"
    max_iter: int = 100
    tol: float = 1e-3
    reg: float = 1e-6
    n_init: int = 1
    seed: int = 0
    bayes: bool = False

    def fit(self, df: DataFrame, features: list[str]) -> MixtureModel:
        if self.covariance not in ("full", "diag"):
            raise InvalidParameter(self.covariance)
        with passes.Table(df, features) as table:
            fits = [self._one(table, df, features, self.seed + i) for i in range(self.n_init)]
        return max(fits, key=lambda m: m.log_likelihood)

    def _one(self, table, df, features, seed) -> MixtureModel:
        d, k = len(features), self.k
        pool, stands = hashed_sample(df, features, 5000, seed)
        c0 = np.cov(pool.T, aweights=stands).reshape(d, d) + self.reg * np.eye(d) if len(pool) > 1 else np.eye(d)
        if self.covariance == "diag":
            c0 = np.diag(np.diag(c0))
        start = spread_start(pool, k, np.random.default_rng(seed), stands)
        for _ in range(10):
            at = distances(pool, start).argmin(1)
            start = np.array([np.average(pool[at == j], 0, stands[at == j]) if (at == j).any() else start[j] for j in range(k)])
        model, old = MixtureModel(features, np.ones(k) / k, start, np.array([c0] * k), -np.inf), -np.inf
        m0, w0, b0, v0 = np.average(pool, 0, stands), 1.0 / k, 1.0, float(d)
        for _ in range(self.max_iter):

            def sums(x, _, model=model):
                z = model.joint(x)
                top = z.max(axis=1, keepdims=True)
                e = np.exp(z - top)
                r, y = e / e.sum(1, keepdims=True), x - m0
                s = r.T @ np.column_stack([np.ones(len(x)), y, np.einsum("ij,ik->ijk", y, y).reshape(len(x), -1)])
                return np.append(s.ravel(), [(top[:, 0] + np.log(e.sum(1))).sum(), len(x)])

            *s, ll, n = table.sums(sums)
            s = np.array(s).reshape(k, -1)
            nk = np.maximum(s[:, 0], 1e-10)
            mean = s[:, 1 : 1 + d] / nk[:, None]
            cov = s[:, 1 + d :].reshape(k, d, d) / nk[:, None, None] - np.einsum("ij,ik->ijk", mean, mean)
            mean = mean + m0  # moments are taken around one centre, so large offsets don't cancel
            cov = cov + self.reg * np.eye(d)
            if self.covariance == "diag":
                cov = cov * np.eye(d)
            extra, weights = None, nk / nk.sum()
            if self.bayes:  # Dirichlet over weights, Normal-Wishart over components
                a, beta, nu = w0 + nk, b0 + nk, v0 + nk
                m = (b0 * m0 + nk[:, None] * mean) / beta[:, None]
                scale = np.array([np.linalg.inv(c0 * v0 + nk[j] * cov[j] + b0 * nk[j] / beta[j] * np.outer(mean[j] - m0, mean[j] - m0)) for j in range(k)])
                ld = np.array([digamma((nu[j] - np.arange(d)) / 2).sum() + d * np.log(2) + np.linalg.slogdet(scale[j])[1] for j in range(k)])
                cov = np.array([np.linalg.inv(nu[j] * scale[j]) for j in range(k)])
                extra = 0.5 * ld - 0.5 * np.array([-np.linalg.slogdet(c)[1] for c in cov]) - 0.5 * d / beta
                weights, mean = np.exp(digamma(a) - digamma(a.sum())), m
            model = MixtureModel(features, weights, mean, cov, ll / max(n, 1), extra)
            if abs(ll / max(n, 1) - old) < self.tol:
                break
            old = ll / max(n, 1)
        return model


@dataclass
class BayesianGaussianMixture(GaussianMixture):
    """Variational updates; stops on the mean log-likelihood of the data."""

    bayes: bool = True


def log_dirichlet(a: np.ndarray) -> float:
    return float(lgamma(a.sum()) - lgamma(a).sum())


# Below: methods that compare all rows. Rows are taken in id order, at most ROW_CAP; results are (id, label) frames.


def _labelled(df: DataFrame, id_col: str, ids, labels, name: str = "cluster", **more) -> DataFrame:
    out = pd.DataFrame({id_col: ids, name: np.asarray(labels)} | more)
    return df.sparkSession.createDataFrame(out)


@dataclass
class Dbscan:
    """Cores have min_samples rows within eps (themselves included); clusters are numbered by their first core in id
    order; a border row joins the first cluster that reaches it, which is the one with the lowest number; noise is -1."""

    eps: float = 0.5
    min_samples: int = 5

    def fit_predict(self, df: DataFrame, id_col: str, features: list[str]) -> DataFrame:
        """(id, cluster) of any number of rows: no pair is written out and no row passes through the driver.

        Cores are rows whose min_samples-th nearest row is within eps, by the index; they are grouped inside each cell, cells
        are linked by rows that reach several groups, and clusters are the components of those links. Rows without an id, or with a
        missing number, are left out.
        """
        if self.eps < 0 or self.min_samples < 1:
            raise InvalidParameter("eps or min_samples")
        require(df, [id_col, *features])
        rows = written(spatial.usable(df.filter(F.col(id_col).isNotNull()), id_col, features), "points")
        flat = rows.select("q_id", *[F.get("x", F.lit(k)).alias(f"x{k}") for k in range(len(features))])
        names = [f"x{k}" for k in range(len(features))]
        index = spatial.Index(flat, "q_id", names, most_equal=self.min_samples)
        kth = spatial.search(index, rows, self.min_samples).filter((F.col("rank") == self.min_samples) & (F.col("distance") <= self.eps))
        cores = written(kth.select("q_id"), "cores")
        if cores.isEmpty():
            return rows.select(F.col("q_id").alias(id_col), F.lit(-1).cast("long").alias("cluster"))
        index = spatial.Index(flat.join(cores, "q_id", "left_semi"), "q_id", names)
        links = written(spatial.linked(index, rows, self.eps), "links")
        among = links.join(cores, "q_id", "left_semi").select(F.col("q_id").alias("a"), F.col("t_id").alias("b"))
        roots = spatial.components(among, cores.select(F.col("q_id").alias("id")))
        # Clusters go by their first core, so by their root; a row's is the least of those it reaches.
        first = links.join(roots, F.col("t_id") == F.col("id")).groupBy("q_id").agg(F.min("root").alias("root"))
        numbers = numbered(roots.select("root").distinct(), "root")
        out = rows.select("q_id").join(first, "q_id", "left").join(numbers, "root", "left")
        return out.select(F.col("q_id").alias(id_col), F.coalesce("number", F.lit(-1).cast("long")).alias("cluster"))


@dataclass
class Hdbscan:
    """Mutual reachability, minimum spanning tree, then a greedy cut: the first merge (shortest first) whose two sides
    both have min_cluster_size rows freezes both; with no such merge the largest component is cluster 0."""

    min_cluster_size: int = 5
    min_samples: int | None = None

    def fit_predict(self, df: DataFrame, id_col: str, features: list[str]) -> DataFrame:
        x, ids = _rows(df, id_col, features)
        n = len(x)
        k = min(self.min_samples or self.min_cluster_size, n - 1)
        coredist = _core(df, id_col, features, x, ids, max(k, 1)) if n > 1 else np.zeros(n)
        edges = sorted(_spanning(x, coredist))
        root, size, least, frozen = np.arange(n).tolist(), [1] * n, list(range(n)), set()

        def find(i):
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        def join(keep, lose):
            root[lose] = keep
            size[keep] += size[lose]
            least[keep] = min(least[keep], least[lose])

        for _, a, b in edges:
            p, q = find(a), find(b)
            if p in frozen or q in frozen:
                if not (p in frozen and q in frozen) and min(size[p], size[q]) < self.min_cluster_size:
                    join(*((p, q) if p in frozen else (q, p)))
            elif size[p] >= self.min_cluster_size and size[q] >= self.min_cluster_size:
                frozen |= {p, q}
            else:
                join(p, q)
        heads = {find(i) for i in range(n)}
        chosen = sorted((least[g], g) for g in frozen) or sorted((-size[g], g) for g in heads if size[g] >= self.min_cluster_size)[:1]
        number = {g: c for c, (_, g) in enumerate(chosen)}
        return _labelled(df, id_col, ids, [number.get(find(i), -1) for i in range(n)])


def _rows(df: DataFrame, id_col: str, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, ids) in id order: a few numbers a row are what the driver holds, never a number a pair."""
    require(df, [id_col, *features])
    got = df.select(F.col(f"`{id_col}`").alias("i"), *[F.col(f"`{c}`").cast("double").alias(f"x{k}") for k, c in enumerate(features)]).toPandas()
    if not len(got):
        raise EmptyInput("no rows")
    got = got.sort_values("i", kind="stable", ignore_index=True)
    return np.ascontiguousarray(got.iloc[:, 1:].to_numpy(float)), got["i"].to_numpy()


def _gaps(x: np.ndarray, v: int) -> np.ndarray:
    """Distances of one row from all, as distances() gives them."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        gap = x[:, j] - x[v, j]
        out += np.multiply(gap, gap, out=gap)
    return np.sqrt(out, out=out)


def _core(df: DataFrame, id_col: str, features: list[str], x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The distance of each row's k-th nearest other row, infinite where there are fewer: by the index beyond ROW_CAP rows."""
    n = len(x)
    if n <= ROW_CAP or len(np.unique(ids)) < n:
        out = np.full(n, np.inf)
        for v in range(n if k < n else 0):
            gap = _gaps(x, v)
            gap[v] = np.inf
            out[v] = np.partition(gap, k - 1)[k - 1]
        return out
    rows = spatial.usable(df, id_col, features)
    names = [f"x{j}" for j in range(len(features))]
    flat = rows.select("q_id", *[F.get("x", F.lit(j)).alias(c) for j, c in enumerate(names)])
    near = spatial.search(spatial.Index(flat, "q_id", names, most_equal=k + 1), rows, k, exclude_self=True).filter(F.col("rank") == k).select("q_id", "distance").toPandas()
    out = np.full(n, np.inf)
    out[pd.Index(ids).get_indexer(near["q_id"])] = near["distance"].to_numpy()
    return out


def _spanning(x: np.ndarray, core: np.ndarray) -> list[tuple[float, int, int]]:
    """The least spanning tree by mutual reachability, grown from the first row (Prim): the pairs of a row are made when it joins."""
    n = len(x)
    best, parent, open_, edges = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool), []
    best[0] = 0
    for step in range(n):
        v = int(best.argmin())
        if not open_[v]:  # only infinite ones are left
            v = int(open_.argmax())
        if step:
            edges.append((float(best[v]), int(parent[v]), v))
        open_[v], best[v] = False, np.inf
        reach = np.maximum(np.maximum(_gaps(x, v), core), core[v])
        closer = open_ & (reach < best)
        best[closer], parent[closer] = reach[closer], v
    return edges


@dataclass
class Optics:
    min_samples: int = 5
    max_eps: float = np.inf
    eps: float = 0.5

    def fit_predict(self, df: DataFrame, id_col: str, features: list[str]) -> DataFrame:
        """(id, order, reachability, cluster); clusters as DBSCAN would cut the ordering at eps."""
        x, ids = _rows(df, id_col, features)
        n = len(x)
        core = _core(df, id_col, features, x, ids, min(self.min_samples, n)) if n > 1 else np.full(n, np.inf)
        core = np.where(core <= self.max_eps, core, np.inf)
        reach, key, open_, order = np.full(n, np.inf), np.full(n, np.inf), np.ones(n, bool), []
        for _ in range(n):
            v = int(key.argmin())
            if not np.isfinite(key[v]):
                v = int(open_.argmax())
            open_[v], key[v] = False, np.inf
            order.append(v)
            if np.isfinite(core[v]):
                gap = _gaps(x, v)
                new = np.maximum(core[v], gap)
                better = open_ & (gap <= self.max_eps) & (new < reach)
                reach[better] = key[better] = new[better]
        label, c = np.full(n, -1), -1
        for v in order:
            if reach[v] > self.eps:
                if core[v] <= self.eps:
                    c += 1
                    label[v] = c
            else:
                label[v] = max(c, 0)
        place = np.empty(n, int)
        place[order] = np.arange(n)
        return _labelled(df, id_col, ids, label, order=place, reachability=np.where(np.isfinite(reach), reach, None).astype(float))


@dataclass
class Birch:
    """One pass in id order: a row joins the nearest cell within the threshold or starts one; cells go to k-means."""

    k: int = 3
    threshold: float = 0.5
    seed: int = 0

    def fit_predict(self, df: DataFrame, id_col: str, features: list[str]) -> DataFrame:
        x, got = matrix(df, features, id_col, cap=20 * ROW_CAP)
        total, n, at = [], [], []
        for v in x:
            if total:
                gap = ((np.array(total) / np.array(n)[:, None] - v) ** 2).sum(1)
                j = int(gap.argmin())
                if gap[j] <= self.threshold**2:
                    total[j] = total[j] + v
                    n[j] += 1
                    at.append(j)
                    continue
            total.append(v.copy())
            n.append(1)
            at.append(len(total) - 1)
        cells, w = np.array(total) / np.array(n)[:, None], np.array(n, float)
        c = spread_start(cells, min(self.k, len(cells)), np.random.default_rng(self.seed), w)
        for _ in range(100):
            of = distances(cells, c).argmin(1)
            c = np.array([np.average(cells[of == j], axis=0, weights=w[of == j]) if (of == j).any() else c[j] for j in range(len(c))])
        return _labelled(df, id_col, got[id_col], distances(cells, c).argmin(1)[at])


@dataclass
class AgglomerativeClustering:
    k: int = 2
    linkage: str = "ward"

    def fit_predict(self, df: DataFrame, id_col: str, features: list[str]) -> DataFrame:
        if self.linkage not in ("single", "complete", "average", "ward"):
            raise InvalidParameter(self.linkage)
        if not lowrank.fits(df, LINKAGE_DENSE):
            x, ids = _rows(df, id_col, features)
            return _labelled(df, id_col, ids, self._chained(x))
        x, got = matrix(df, features, id_col)
        d = distances(x) ** (2 if self.linkage == "ward" else 1)
        np.fill_diagonal(d, np.inf)
        size, at, left = np.ones(len(x)), np.arange(len(x)), len(x)
        near = d.argmin(1)
        while left > max(1, self.k):
            i = int(d[np.arange(len(x)), near].argmin())
            j = int(near[i])
            i, j = min(i, j), max(i, j)
            a, b, both = d[i].copy(), d[j].copy(), d[i, j]
            new = {"single": np.minimum(a, b), "complete": np.maximum(a, b), "average": (size[i] * a + size[j] * b) / (size[i] + size[j])}.get(self.linkage)
            if new is None:
                with np.errstate(invalid="ignore"):
                    new = ((size[i] + size) * a + (size[j] + size) * b - size * both) / (size[i] + size[j] + size)
            new = np.where(np.isinf(a) | np.isinf(b), np.inf, new)
            new[[i, j]] = np.inf
            d[i], d[:, i] = new, new
            d[j], d[:, j] = np.inf, np.inf
            size[i] += size[j]
            at[at == j] = i
            left -= 1
            stale = (near == i) | (near == j)
            stale[i] = True
            near[stale] = d[stale].argmin(1)
            better = d[i] < d[np.arange(len(x)), near]
            near[better] = i
        return _labelled(df, id_col, got[id_col], np.unique(at, return_inverse=True)[1])


    def _chained(self, x: np.ndarray) -> np.ndarray:
        """Labels by chains of nearest clusters, without a number a pair; merges are cut in the order of their heights.

        Ward's distances come from means, single linkage from the spanning tree, the others from the rows of one cluster at a time. Equal
        rows are one cluster from the start.
        """
        n, k = len(x), max(1, self.k)
        points, of, sizes = np.unique(x, axis=0, return_inverse=True, return_counts=True)
        of = of.ravel()
        if len(points) <= k:
            points, of, sizes = x, np.arange(n), np.ones(n, int)
        if self.linkage == "single":
            merges = _spanning(points, np.zeros(len(points)))
        else:
            merges = self._merges(points, sizes.astype(float))
        root = list(range(len(points)))

        def find(i):
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for _, a, b in sorted(merges, key=lambda m: m[0])[: max(0, len(points) - k)]:
            root[find(b)] = find(a)
        at, first = np.array([find(i) for i in range(len(points))])[of], {}
        return np.array([first.setdefault(int(v), len(first)) for v in at])

    def _merges(self, points: np.ndarray, w: np.ndarray) -> list[tuple[float, int, int]]:
        """(height, a point of one side, one of the other) of all merges."""
        mean, size, height, name = points.copy(), w.copy(), np.zeros(len(points)), np.arange(len(points))
        at, chain, merges, live = np.arange(len(points)), [], [], np.ones(len(points), bool)

        def from_all(i):
            if self.linkage == "ward":
                gap = 0.0
                for j in range(mean.shape[1]):
                    gap = gap + (mean[:, j] - mean[i, j]) ** 2
                d = 2 * gap * (size * size[i] / (size + size[i]))
            else:
                rows, total = np.flatnonzero(at == name[i]), np.zeros(len(points))
                for v in rows:
                    total = total + _gaps(points, v) * w[v] if self.linkage == "average" else np.maximum(total, _gaps(points, v))
                spot = np.searchsorted(name, at)
                d = np.bincount(spot, total * w, minlength=len(name)) / (size * size[i]) if self.linkage == "average" else np.zeros(len(name))
                if self.linkage == "complete":
                    np.maximum.at(d, spot, total)
            d[~live] = np.inf
            d[i] = np.inf
            return d

        for left in range(len(points), 1, -1):
            if len(live) > 64 and 2 * left < len(live):  # forgets merged clusters
                place = np.cumsum(live) - 1
                chain = [int(place[i]) for i in chain]
                mean, size, height, name, live = mean[live], size[live], height[live], name[live], live[live]
            if not chain:
                chain = [int(live.argmax())]
            while True:
                d = from_all(chain[-1])
                j = int(d.argmin())
                if len(chain) > 1 and d[chain[-2]] <= d[j]:
                    break
                chain.append(j)
            b, a = chain.pop(), chain.pop()
            a, b = min(a, b), max(a, b)
            top = max(float(min(d[a], d[b])), height[a], height[b])
            merges.append((top, int(name[a]), int(name[b])))
            if self.linkage != "ward":
                at[at == name[b]] = name[a]
            mean[a] = (mean[a] * size[a] + mean[b] * size[b]) / (size[a] + size[b])
            size[a], height[a], live[b] = size[a] + size[b], top, False
        return merges


@dataclass
class SpectralClustering:
    k: int = 2
    affinity: str = "rbf"
    gamma: float = 1.0
    n_neighbors: int = 10
    seed: int = 0

    def fit_predict(self, df: DataFrame, id_col: str, features: list[str]) -> DataFrame:
        if self.affinity == "rbf" and not lowrank.fits(df, SPECTRAL_DENSE):
            return self._wide(df, id_col, features)
        x, got = matrix(df, features, id_col)
        d = distances(x)
        if self.affinity == "rbf":
            a = np.exp(-self.gamma * d * d)
        else:
            kth = np.sort(d, axis=1)[:, min(self.n_neighbors, len(x) - 1)]
            a = (d <= kth[:, None]).astype(float)
            a = np.maximum(a, a.T)
        root = 1 / np.sqrt(np.maximum(a.sum(1), 1e-12))
        _, u = np.linalg.eigh(a * root[:, None] * root[None])
        z = u[:, -self.k :]
        z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        best = None
        for s in range(5):
            c = spread_start(z, self.k, np.random.default_rng(self.seed + s))
            for _ in range(100):
                at = distances(z, c).argmin(1)
                c = np.array([z[at == j].mean(0) if (at == j).any() else c[j] for j in range(self.k)])
            cost = (distances(z, c).min(1) ** 2).sum()
            if best is None or cost < best[0] - 1e-12:
                best = (cost, at)
        first = {}
        return _labelled(df, id_col, got[id_col], [first.setdefault(v, len(first)) for v in best[1]])


    def _wide(self, df: DataFrame, id_col: str, features: list[str]) -> DataFrame:
        """The same from the kernel values of pivots: degrees are one pass, the leading vectors another, k-means goes over the rows' coordinates.

        Of the k-means from five starts the one with the least cost stays; clusters are numbered by their first id. Rows without an id, or
        with a missing number, are left out.
        """
        from .kernels import Kernel

        with lowrank.Rows(df, features, Kernel("rbf", self.gamma)) as rows:
            total, factor = rows.weighted_sums(lambda f, y, w: w @ f), rows.factor
            degrees = lambda f: np.maximum(f @ total, 1e-12)
            m = rows.weighted_sums(lambda f, y, w: ((f * (w / degrees(f))[:, None]).T @ f).ravel()).reshape(rows.d, rows.d)
        s, u = np.linalg.eigh(m)
        u = u[:, -self.k :] / np.sqrt(np.maximum(s[-self.k :], 1e-300))
        k, d = self.k, len(features)

        def embed(batches):
            for b in batches:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
                step = max(64, (1 << 21) // len(u))
                z = [np.zeros((0, k))]
                for a in range(0, len(x), step):
                    f = factor(x[a : a + step])
                    v = f @ u / np.sqrt(degrees(f))[:, None]
                    z.append(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12))
                z = np.concatenate(z)
                yield pa.RecordBatch.from_arrays([b.column("q_id"), *(pa.array(np.ascontiguousarray(v)) for v in z.T)], ["q_id", *[f"z{j}" for j in range(k)]])

        points = spatial.usable(df.filter(F.col(f"`{id_col}`").isNotNull()), id_col, features)
        names = [f"z{j}" for j in range(k)]
        points = written(points.mapInArrow(embed, f"q_id {points.schema['q_id'].dataType.simpleString()}, " + ", ".join(f"{c} double" for c in names)), "spectral")
        pool, stands = hashed_sample(points, names, 10_000, self.seed)
        c = np.stack([spread_start(pool, k, np.random.default_rng(self.seed + i), stands) for i in range(5)])
        with passes.Table(points, names, equal=True) as table:
            for _ in range(101):

                def sums(x, y, w, c=c):
                    out = []
                    for one in c:
                        gap = distances(x, one)
                        at = gap.argmin(1)
                        z = np.column_stack([w, x * w[:, None], w * gap[np.arange(len(x)), at] ** 2])
                        out.append(np.stack([np.bincount(at, v, minlength=k) for v in z.T], 1))
                    return np.concatenate(out).ravel()

                m = table.weighted_sums(sums).reshape(5, k, k + 2)
                cost, new = m[:, :, -1].sum(1), np.where(m[:, :, :1] > 0, m[:, :, 1:-1] / np.maximum(m[:, :, :1], 1e-300), c)
                if np.abs(new - c).max() < 1e-12:
                    break
                c = new
        best = 0
        for i in range(1, 5):
            best = i if cost[i] < cost[best] * (1 - 1e-9) - 1e-12 else best
        found = CentroidModel(names, c[best]).transform(points, "at")
        first = numbered(found.groupBy("at").agg(F.min("q_id").alias("first")).select("first"), "first")
        heads = found.groupBy("at").agg(F.min("q_id").alias("first")).join(first, "first").select("at", F.col("number").alias("cluster"))
        return found.join(F.broadcast(heads), "at").select(F.col("q_id").alias(id_col), "cluster")


@dataclass
class MeanShift:
    """Flat kernel; modes nearer than half the bandwidth merge, those with most rows first; clusters by size.

    Every distinct row starts a mode. A round joins the modes that still move with the rows within the bandwidth, through the
    index, and adds the rows up: no pair is written out, and modes that rest leave the loop. Modes equal to one part in 10^5 of the bandwidth
    count as one; at most ``most_modes`` may be left for the driver to merge. Rows without an id, or with a missing number, are left out.
    """

    bandwidth: float = 1.0
    max_iter: int = 300
    most_modes: int = 100_000

    def fit_predict(self, df: DataFrame, id_col: str, features: list[str]) -> DataFrame:
        if self.bandwidth <= 0:
            raise InvalidParameter("bandwidth")
        require(df, [id_col, *features])
        d = len(features)
        rows = written(spatial.usable(df.filter(F.col(id_col).isNotNull()), id_col, features), "points")
        names = [f"x{k}" for k in range(d)]
        moving, still = written(rows.groupBy("x").agg(F.min("q_id").alias("q_id"), F.count(F.lit(1)).cast("double").alias("w")), "distinct"), []
        different = moving.count()
        if spatial.ONE_CELL < different <= MODE_NUMBERS // (d + 1):
            still.append(written(self._alone(moving, d), "modes"))
            rounds = 0
        else:
            index = spatial.Index(moving.select("q_id", "w", *[F.get("x", F.lit(k)).alias(n) for k, n in enumerate(names)]), "q_id", names, keep=("w",), cell_rows=spatial.CELL_ROWS)
            moving, rounds = moving.select("q_id", "x"), self.max_iter + 1
        for r in range(rounds):
            near = self._near(index, moving, d)
            gap = F.array_max(F.transform(F.arrays_zip("x", "new"), lambda p: F.abs(p["x"] - p["new"])))
            step = written(moving.join(near, "q_id").withColumn("rests", (gap < 1e-6) | F.lit(r == self.max_iter)), "modes")
            still.append(step.filter("rests").select("q_id", F.col("x").alias("m"), "n"))
            moving = step.filter("NOT rests").select("q_id", F.col("new").alias("x"))
            if moving.isEmpty():
                break
        modes = still[0]
        for more in still[1:]:
            modes = modes.unionByName(more)
        cell = F.transform("m", lambda v: F.round(v / (self.bandwidth * 1e-5)))
        first = F.min_by(F.struct("m", "n", "q_id"), F.struct(-F.col("n"), F.col("q_id"))).alias("f")
        left = modes.groupBy(cell.alias("cell")).agg(first).select("f.*").orderBy(F.desc("n"), "q_id").limit(self.most_modes + 1).toArrow()
        if left.num_rows > self.most_modes:
            raise InvalidParameter(f"more than {self.most_modes} modes: the bandwidth is too small")
        kept = np.zeros((0, d))
        for v in left.column("m").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d):
            if not len(kept) or np.sqrt(((kept - v) ** 2).sum(1)).min() >= self.bandwidth / 2:
                kept = np.vstack([kept, v])

        def nearest_mode(batches):
            for b in batches:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
                step = max(1, spatial.BLOCK_CELLS // len(kept))
                at = [distances(x[a : a + step], kept).argmin(1) for a in range(0, len(x), step)]
                yield pa.RecordBatch.from_arrays([b.column("q_id"), pa.array(np.concatenate([np.zeros(0, np.int64), *at]), pa.int64())], [id_col, "cluster"])

        return rows.mapInArrow(nearest_mode, f"`{id_col}` {rows.schema['q_id'].dataType.simpleString()}, cluster long")

    def _alone(self, points: DataFrame, d: int) -> DataFrame:
        """(q_id, m, n): modes that move until they rest without a shuffle, for at most MODE_NUMBERS numbers of different rows (16 MB).

        Nodes of a tree that lie within the bandwidth as a whole add their sums; only rows of cells along its edge are compared.
        """
        got = points.select("q_id", "x", "w").orderBy("x").toArrow().combine_chunks()
        t, w = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, d), got.column("w").to_numpy()
        tree = spatial.Cells(t, -(-len(t) // MODE_CELL))
        at = tree.cell(t)
        order = np.argsort(at, kind="stable")
        t, tw, at = t[order], np.column_stack([w, t * w[:, None]])[order], at[order]
        begin = np.searchsorted(at, np.arange(tree.size + 1))
        some = np.flatnonzero(np.diff(begin))
        low, high = np.full((tree.size, d), np.inf), np.full((tree.size, d), -np.inf)
        low[some], high[some] = np.minimum.reduceat(t, begin[some]), np.maximum.reduceat(t, begin[some])
        tree.bound(low, high, np.diff(begin))
        shared = points.sparkSession.sparkContext.broadcast((tree, tree.summed(np.add.reduceat(tw, begin[some]), some), t, tw, begin))
        reach, most = float(self.bandwidth), self.max_iter

        def sums_at(x):
            tree, totals, t, tw, begin = shared.value
            sums, row, cell = tree.inside(x, reach, totals)
            size = begin[cell + 1] - begin[cell]
            for a in range(0, len(row), 1 << 14):
                many = size[a : a + (1 << 14)]
                spot = np.arange(many.sum()) + np.repeat(begin[cell[a : a + (1 << 14)]] - np.cumsum(many) + many, many)
                of, gap = np.repeat(row[a : a + (1 << 14)], many), 0.0
                for k in range(d):
                    g = x[of, k] - t[spot, k]
                    gap = gap + g * g
                hit = np.sqrt(gap) <= reach
                of, spot = of[hit], spot[hit]
                for c in range(d + 1):
                    sums[:, c] += np.bincount(of, tw[spot, c], minlength=len(x))
            return sums

        def move(batches):
            for b in batches:
                x, n = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d).copy(), np.zeros(b.num_rows)
                for a in range(0, len(x), 1024):
                    open_ = np.arange(a, min(a + 1024, len(x)))
                    for r in range(most + 1):
                        sums = sums_at(x[open_])
                        new = sums[:, 1:] / np.maximum(sums[:, :1], 1)
                        n[open_] = sums[:, 0]
                        goes = np.abs(new - x[open_]).max(1) >= 1e-6
                        open_, new = open_[goes], new[goes]
                        if r == most or not len(open_):
                            break
                        x[open_] = new
                yield pa.RecordBatch.from_arrays([b.column("q_id"), pa.array(list(x), pa.list_(pa.float64())), pa.array(n)], ["q_id", "m", "n"])

        dealt = points.select("q_id", "x").repartition(int(min(4096, -(-len(t) // 2048))), "q_id")
        return dealt.mapInArrow(move, f"q_id {points.schema['q_id'].dataType.simpleString()}, m array<double>, n double")

    def _near(self, index: spatial.Index, modes: DataFrame, d: int) -> DataFrame:
        """(q_id, n, new): rows within the bandwidth of each mode, and their mean; modes of a table of one cell go on until they rest.

        Of cells that lie within the bandwidth as a whole only the sums are added, without a look at their rows.
        """
        rounds = self.max_iter if index.only is not None else 1

        def compare(some, t, about):
            x, step = some.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d), max(1, spatial.BLOCK_CELLS // max(1, len(t)))
            w = about.field("t_w").to_numpy(zero_copy_only=False)
            tw = np.column_stack([w, t * w[:, None]])
            for a in range(0, len(x), step):
                m = x[a : a + step]
                for _ in range(rounds):
                    sums = (distances(m, t) <= self.bandwidth).astype(float) @ tw
                    m, old = sums[:, 1:] / np.maximum(sums[:, :1], 1), m
                    if not len(m) or np.abs(m - old).max() < 1e-6:
                        break
                columns = [some.column("q_id").slice(a, len(m)), *(pa.array(v) for v in sums.T)]
                yield pa.RecordBatch.from_arrays(columns, ["q_id", "n", *[f"s{k}" for k in range(d)]])

        schema = f"q_id {index.kinds['t_id']}, n double, " + ", ".join(f"s{k} double" for k in range(d))
        if index.only is not None:
            parts = index.meet(modes, compare, schema)
        else:
            inner, edge = index.apart(modes, float(self.bandwidth), "t_w", schema)
            parts = inner.unionByName(index.meet(edge, compare, schema))
        sums = parts.groupBy("q_id").agg(F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(d)])
        return sums.filter("n > 0").select("q_id", "n", F.array(*[F.col(f"s{k}") / F.col("n") for k in range(d)]).alias("new"))


@dataclass
class AffinityPropagation:
    """Messages between all pairs of at most 2,000 rows, or with ``n_neighbors`` along the graph of nearest rows, of any size.

    The graph has an edge both ways between a row and each of its nearest, and one from each row to itself. A round of messages is three
    grouped aggregates of edges with map-side combine, joined back on their keys, so a row that is near to very many is no
    single task's; the edges are written once a round and those of two rounds before deleted. Rows join the nearest exemplar, ties by id, through the
    index; clusters are numbered by the ids of their exemplars, and all are -1 if there is none. Rows without an id, or
    with a missing number, are left out; rows that repeat an id are one.
    """

    damping: float = 0.9
    max_iter: int = 200
    stable: int = 15
    preference: float | None = None
    n_neighbors: int | None = None

    def fit_predict(self, df: DataFrame, id_col: str, features: list[str]) -> DataFrame:
        if self.n_neighbors is not None:
            return self._along(df, id_col, features)
        x, got = matrix(df, features, id_col, cap=2000)
        s = -(distances(x) ** 2)
        n = len(x)
        off = s[~np.eye(n, dtype=bool)]
        np.fill_diagonal(s, (np.median(off) if len(off) else 0.0) if self.preference is None else self.preference)
        r, a, old, same = np.zeros((n, n)), np.zeros((n, n)), None, 0
        for _ in range(self.max_iter):
            z = a + s
            first = z.argmax(1)
            top = z[np.arange(n), first]
            z[np.arange(n), first] = -np.inf
            new = s - top[:, None]
            new[np.arange(n), first] = s[np.arange(n), first] - (z.max(1) if n > 1 else 0)
            r = self.damping * r + (1 - self.damping) * new
            p = np.maximum(r, 0)
            np.fill_diagonal(p, np.diag(r))
            new = p.sum(0)[None] - p
            own = np.diag(new).copy()
            new = np.minimum(new, 0)
            np.fill_diagonal(new, own)
            a = self.damping * a + (1 - self.damping) * new
            ex = np.flatnonzero(np.diag(a) + np.diag(r) > 0)
            same = same + 1 if old is not None and np.array_equal(ex, old) else 0
            old = ex
            if same >= self.stable and len(ex):
                break
        if not len(old):
            return _labelled(df, id_col, got[id_col], np.full(n, -1))
        at = s[:, old].argmax(1)
        at[old] = np.arange(len(old))
        return _labelled(df, id_col, got[id_col], at)

    def _along(self, df: DataFrame, id_col: str, features: list[str]) -> DataFrame:
        if self.n_neighbors < 1 or self.max_iter < 1:
            raise InvalidParameter("n_neighbors or max_iter")
        require(df, [id_col, *features])
        rows = spatial.usable(df.filter(F.col(id_col).isNotNull()), id_col, features).groupBy("q_id").agg(F.min("x").alias("x"))
        rows = written(rows, "points")
        names = [f"x{k}" for k in range(len(features))]
        flat = rows.select("q_id", *[F.get("x", F.lit(k)).alias(n) for k, n in enumerate(names)])
        edges = self._messages(rows, flat, names)
        own = (F.col("i") == F.col("k")) & (F.col("a") + F.col("r") > 0)
        before, old, same = None, None, 0
        for _ in range(self.max_iter):
            new = written(self._round(edges), "messages")
            if before is not None:
                forget(before)
            before, edges = edges, new
            mark = edges.filter(own).agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("i"))).first()
            same = same + 1 if mark == old else 0
            old = mark
            if same >= self.stable and mark[0]:
                break
        heads = edges.filter(own).select(F.col("i").alias("q_id"))
        if not old[0]:
            return rows.select(F.col("q_id").alias(id_col), F.lit(-1).cast("long").alias("cluster"))
        heads = written(flat.join(heads, "q_id", "left_semi"), "exemplars")
        # An exemplar is in its own cluster, whichever other lies at the same point.
        near = spatial.search(spatial.Index(heads, "q_id", names, most_equal=1), rows, 1).select("q_id", "t_id")
        mine = near.join(heads.select("q_id", F.lit(True).alias("head")), "q_id", "left").select("q_id", F.when(F.col("head"), F.col("q_id")).otherwise(F.col("t_id")).alias("head"))
        numbers = numbered(heads.select(F.col("q_id").alias("head")), "head")
        return mine.join(numbers, "head").select(F.col("q_id").alias(id_col), F.col("number").alias("cluster"))

    def _messages(self, rows: DataFrame, flat: DataFrame, names: list[str]) -> DataFrame:
        """(i, k, s, r, a): the edges of the graph, by ids, with messages of nothing."""
        k = self.n_neighbors
        near = spatial.search(spatial.Index(flat, "q_id", names, most_equal=k + 1), rows, k, exclude_self=True)
        s = (-F.col("distance") * F.col("distance")).alias("s")
        pairs = near.select(F.col("q_id").alias("i"), F.col("t_id").alias("k"), s)
        pairs = written(pairs.unionByName(pairs.select(F.col("k").alias("i"), F.col("i").alias("k"), "s")).distinct(), "graph")
        preference = self.preference
        if preference is None:
            n = pairs.count()
            preference = exact_quantiles(pairs, [F.col("s")], [(n // 2) / (n - 1)])[0][0] if n > 1 else 0.0
        own = rows.select(F.col("q_id").alias("i"), F.col("q_id").alias("k"), F.lit(float(preference)).alias("s"))
        return written(pairs.unionByName(own).withColumns({"r": F.lit(0.0), "a": F.lit(0.0)}), "messages")

    def _round(self, edges: DataFrame) -> DataFrame:
        """Responsibilities from the best and second best of each row, then availabilities from the sums at each candidate."""
        z, keep = F.col("a") + F.col("s"), F.lit(self.damping)
        # Of equal best ones the last id stands for all: the second best is then as good, so which one it is changes nothing.
        best = edges.groupBy("i").agg(F.max(F.struct(z.alias("z"), "k")).alias("best"))
        edges = edges.join(best, "i")
        second = edges.filter(F.col("k") != F.col("best.k")).groupBy("i").agg(F.max(z).alias("second"))
        edges = edges.join(second, "i", "left")
        other = F.when(F.col("k") == F.col("best.k"), F.coalesce("second", F.lit(0.0))).otherwise(F.col("best.z"))
        edges = edges.select("i", "k", "s", "a", (keep * F.col("r") + (1 - keep) * (F.col("s") - other)).alias("r"))
        loop, gain = F.col("i") == F.col("k"), F.greatest("r", F.lit(0.0))
        sums = edges.groupBy("k").agg(F.sum(F.when(loop, 0.0).otherwise(gain)).alias("gains"), F.max(F.when(loop, F.col("r"))).alias("own"))
        new = F.when(loop, F.col("gains")).otherwise(F.least(F.lit(0.0), F.col("own") + F.col("gains") - gain))
        return edges.join(sums, "k").select("i", "k", "s", "r", (keep * F.col("a") + (1 - keep) * new).alias("a"))
