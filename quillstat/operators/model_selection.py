"""Splits as columns, cross-validation, search and inspection.

A split never moves rows: it adds a fold (or test) column computed from ranks of an id, or of a seeded hash of it,
so that it doesn't depend on how the table is partitioned. Ranks are taken within ranges and added up.
"""

from __future__ import annotations

import itertools
import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import EmptyInput, InvalidParameter
from .ranks import numbered, positions

def hashed(id_col: str, seed: int = 0) -> Column:
    """60 bits of MD5 of seed and id: a shuffle that any engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(f"`{id_col}`").cast("string")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def _ranked(df: DataFrame, order: Column, id_col: str, by: list[str] | None = None, name: str = "__r") -> DataFrame:
    """0-based rank (``name``) and number of rows (``name``_n), overall or within groups.

    Ids may be of any type that sorts; rows without an id, or without a group, are kept: nulls come first and are a group of their own.
    """
    by = by or []
    keys = [F.col(f"`{c}`") for c in by]
    placed = positions(df.withColumn("__o", order), [*keys, F.col("__o"), F.col(f"`{id_col}`")], name).drop("__o")
    if not by:
        return placed
    # Rows lie group by group: a rank is the place less that of the group's first row.
    groups = placed.groupBy(*[k.alias(f"__g{i}") for i, k in enumerate(keys)]).agg(F.min(name).alias("__first"), F.count(F.lit(1)).alias("__size"))
    same = [placed[f"`{c}`"].eqNullSafe(groups[f"__g{i}"]) for i, c in enumerate(by)]
    out = placed.join(groups, same).withColumns({name: F.col(name) - F.col("__first"), f"{name}_n": F.col("__size")})
    return out.drop("__first", "__size", *[f"__g{i}" for i in range(len(by))])


def _order(id_col: str, seed: int | None) -> Column:
    return F.col(f"`{id_col}`") if seed is None else hashed(id_col, seed)


def _done(df: DataFrame, new: str, value: Column, of: DataFrame) -> DataFrame:
    return df.withColumn(new, value).select(*of.columns, new)


def train_test_split(df: DataFrame, id_col: str, test_fraction: float = 0.25, seed: int = 0, output: str = "is_test") -> DataFrame:
    """Exactly round(n * fraction) test rows, at least 1 and at most n - 1."""
    if not 0 < test_fraction < 1:
        raise InvalidParameter("test_fraction")
    r = _ranked(df, hashed(id_col, seed), id_col)
    m = F.greatest(F.lit(1), F.least(F.round(F.col("__r_n") * test_fraction).cast("bigint"), F.col("__r_n") - 1))
    return _done(r, output, F.col("__r") < m, df)


def k_fold(df: DataFrame, id_col: str, k: int = 5, output: str = "fold") -> DataFrame:
    """Consecutive blocks in id order; the first n mod k folds have one row more."""
    if k < 2:
        raise InvalidParameter("k")
    r, q, m = _ranked(df, F.col(f"`{id_col}`"), id_col), F.floor(F.col("__r_n") / k), F.col("__r_n") % k
    long = m * (q + 1)
    fold = F.when(F.col("__r") < long, F.floor(F.col("__r") / (q + 1))).otherwise(m + F.floor((F.col("__r") - long) / F.greatest(q, F.lit(1))))
    return _done(r, output, fold.cast("int"), df)


def cv_fold(df: DataFrame, id_col: str, k: int = 5, output: str = "fold") -> DataFrame:
    """Blocks of n div k rows in id order, what is left going to the last one."""
    r = _ranked(df, F.col(f"`{id_col}`"), id_col)
    return _done(r, output, F.least(F.floor(F.col("__r") / F.greatest(F.floor(F.col("__r_n") / k), F.lit(1))), F.lit(k - 1)).cast("int"), df)


def stratified_k_fold(df: DataFrame, id_col: str, label: str, k: int = 5, seed: int = 0, output: str = "fold") -> DataFrame:
    r = _ranked(df, hashed(id_col, seed), id_col, [label])
    return _done(r, output, (F.col("__r") % k).cast("int"), df)


def shuffle_split(df: DataFrame, id_col: str, n_splits: int = 3, test_fraction: float = 0.25, seed: int = 0) -> DataFrame:
    """A row for each split: ``split`` and ``is_test``; split i is shuffled with seed + i."""
    parts = [train_test_split(df, id_col, test_fraction, seed + i).withColumn("split", F.lit(i)) for i in range(n_splits)]
    return _union(parts)


def stratified_shuffle_split(df: DataFrame, id_col: str, label: str, n_splits: int = 3, test_fraction: float = 0.25, seed: int = 0) -> DataFrame:
    """ceil(n * fraction) test rows of each class, leaving at least one to train on."""
    parts = []
    for i in range(n_splits):
        r = _ranked(df, hashed(id_col, seed + i), id_col, [label])
        m = F.least(F.ceil(F.col("__r_n") * test_fraction), F.greatest(F.col("__r_n") - 1, F.lit(0)))
        parts.append(_done(r, "is_test", F.col("__r") < m, df).withColumn("split", F.lit(i)))
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leave_one_out(df: DataFrame, id_col: str, output: str = "fold") -> DataFrame:
    r = _ranked(df, F.col(f"`{id_col}`"), id_col)
    return _done(r, output, F.col("__r").cast("bigint"), df)


def leave_p_out(df: DataFrame, id_col: str, p: int = 2) -> DataFrame:
    """(fold ids test_0 < test_1 < ...): all C(n, p) test sets; the number of sets is checked first."""
    n = df.count()
    import math

    if math.comb(n, p) > 1_000_000:
        raise InvalidParameter("more than a million test sets")
    out = df.select(F.col(id_col).alias("test_0"))
    for k in range(1, p):
        nxt = F.broadcast(df.select(F.col(id_col).alias(f"test_{k}")))
        out = out.join(nxt, F.col(f"test_{k - 1}") < F.col(f"test_{k}"))
    return out


def time_series_split(df: DataFrame, id_col: str, n_splits: int = 5) -> DataFrame:
    """(row, split, is_test): test blocks of max(1, n div (k + 1)) rows at the end, training on all rows before."""
    r = _ranked(df, F.col(f"`{id_col}`"), id_col)
    size = F.greatest(F.lit(1), F.floor(F.col("__r_n") / (n_splits + 1)))
    r = r.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    begin = F.col("__r_n") - (n_splits - F.col("split")) * size
    r = r.withColumn("is_test", (F.col("__r") >= begin)).filter((F.col("__r") < begin + size) & (begin > 0))
    return r.select(*df.columns, "split", "is_test")


def repeated_k_fold(df: DataFrame, id_col: str, k: int = 5, repeats: int = 2, seed: int = 0) -> DataFrame:
    parts = []
    for i in range(repeats):
        r = _ranked(df, hashed(id_col, seed + i), id_col)
        parts.append(_done(r, "fold", (F.col("__r") % k).cast("int"), df).withColumn("repeat", F.lit(i)))
    return _union(parts)


def repeated_stratified_k_fold(df: DataFrame, id_col: str, label: str, k: int = 5, repeats: int = 2, seed: int = 0) -> DataFrame:
    return _union([stratified_k_fold(df, id_col, label, k, seed + i).withColumn("repeat", F.lit(i)) for i in range(repeats)])


def group_k_fold(df: DataFrame, group: str, k: int = 5, output: str = "fold") -> DataFrame:
    """Sorted distinct groups dealt in turn; rows without a group are a group of their own, the first."""
    places = numbered(df.select(F.col(f"`{group}`").alias("__g")).distinct(), "__g")
    joined = df.join(places, df[f"`{group}`"].eqNullSafe(places["__g"]))
    return joined.withColumn(output, (F.col("number") % k).cast("int")).select(*[df[f"`{c}`"] for c in df.columns], output)


# Cross-validation and search. A ``run`` takes (train, test) frames and returns test with a prediction column.

Run = Callable[[DataFrame, DataFrame], DataFrame]
Score = Callable[[DataFrame], float]


def _folds(df: DataFrame, fold: str) -> list:
    found = sorted(r[0] for r in df.select(fold).distinct().collect())
    if not found:
        raise EmptyInput("no rows")
    return found


def cross_val_score(df: DataFrame, fold: str, run: Run, score: Score, parallelism: int = 4) -> list[float]:
    """The score of each fold, folds running side by side."""
    one = lambda k: score(run(df.filter(F.col(fold) != k), df.filter(F.col(fold) == k)))
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(one, _folds(df, fold)))


def cross_val_predict(df: DataFrame, fold: str, run: Run) -> DataFrame:
    return _union([run(df.filter(F.col(fold) != k), df.filter(F.col(fold) == k)) for k in _folds(df, fold)])


def cross_validate(df: DataFrame, fold: str, run: Run, scores: dict[str, Score]) -> list[dict]:
    out = []
    for k in _folds(df, fold):
        began = time.time()
        got = run(df.filter(F.col(fold) != k), df.filter(F.col(fold) == k)).cache()
        n = got.count()
        out.append({"fold": k, "rows": n, "seconds": time.time() - began} | {name: s(got) for name, s in scores.items()})
        got.unpersist()
    return out


def grid(space: dict[str, list]) -> list[dict]:
    return [dict(zip(space, v, strict=True)) for v in itertools.product(*space.values())]


def grid_search_cv(df: DataFrame, fold: str, candidates: list[dict], make: Callable[[dict], Run], score: Score) -> tuple[dict, float, list[float]]:
    """(best, its mean score, all mean scores); of equals the last one wins."""
    if not candidates:
        raise EmptyInput("no candidates")
    means = [float(np.mean(cross_val_score(df, fold, make(c), score))) for c in candidates]
    best = max(range(len(means)), key=lambda i: (means[i], i))
    return candidates[best], means[best], means


def randomized_search_cv(df: DataFrame, fold: str, space: dict[str, list], n: int, make, score, seed: int = 0):
    rng, every = random.Random(seed), grid(space)
    return grid_search_cv(df, fold, rng.sample(every, min(n, len(every))), make, score)


def halving_grid_search_cv(df: DataFrame, id_col: str, candidates: list[dict], make, score, factor: int = 3, min_rows: int = 50, seed: int = 0):
    """(best, scores): candidates meet on growing subsets (80/20 split inside), ceil(m / factor) stay each round.

    Scores of those that dropped out are None; a single candidate is scored once.
    """
    if factor < 2 or min_rows < 2 or not candidates:
        raise InvalidParameter("halving needs candidates, a factor of 2 or more and 2 rows or more")
    n, alive, rows = df.count(), list(range(len(candidates))), min_rows
    scores: list[float | None] = [None] * len(candidates)
    while True:
        part = df.filter(F.pmod(hashed(id_col, seed), F.lit(1 << 20)) < F.lit(min(1.0, rows / max(1, n)) * (1 << 20)))
        split = train_test_split(part, id_col, 0.2, seed)
        now = {i: score(make(candidates[i])(split.filter("NOT is_test"), split.filter("is_test"))) for i in alive}
        scores = [now.get(i) for i in range(len(candidates))]
        if len(alive) == 1:
            return candidates[alive[0]], scores
        alive = sorted(sorted(alive, key=lambda i: (-now[i], i))[: -(-len(alive) // factor)])
        rows *= factor


def halving_random_search_cv(df, id_col, space, n, make, score, factor: int = 3, min_rows: int = 50, seed: int = 0):
    every = grid(space)
    return halving_grid_search_cv(df, id_col, random.Random(seed).sample(every, min(n, len(every))), make, score, factor, min_rows, seed)


def learning_curve(df: DataFrame, id_col: str, sizes: list[float], run: Run, score: Score, k: int = 5) -> list[tuple[float, float, float]]:
    """(share, train score, test score), means over folds of training on a share of the training rows."""
    folded, out = k_fold(df, id_col, k), []
    for s in sizes:
        a, b = [], []
        for f in range(k):
            train = folded.filter((F.col("fold") != f) & (F.pmod(hashed(id_col, 7), F.lit(1 << 20)) < F.lit(s * (1 << 20))))
            a.append(score(run(train, train)))
            b.append(score(run(train, folded.filter(F.col("fold") == f))))
        out.append((s, float(np.mean(a)), float(np.mean(b))))
    return out


def validation_curve(df: DataFrame, id_col: str, values: list, make: Callable[[object], Run], score: Score, k: int = 5) -> list[tuple[object, float, float]]:
    folded, out = k_fold(df, id_col, k), []
    for v in values:
        run = make(v)
        a = [score(run(folded.filter(F.col("fold") != f), folded.filter(F.col("fold") != f))) for f in range(k)]
        out.append((v, float(np.mean(a)), float(np.mean(cross_val_score(folded, "fold", run, score)))))
    return out


def permutation_importance(df: DataFrame, id_col: str, features: list[str], predict: Callable[[DataFrame], DataFrame], score: Score, repeats: int = 5, seed: int = 0) -> list[tuple[str, float, float]]:
    """(feature, mean drop, population deviation) of the score when a column is shuffled against the rest."""
    base, out = score(predict(df)), []
    for c in features:
        drops = []
        for r in range(repeats):
            a = _ranked(df, F.col(f"`{id_col}`"), id_col, name="__left")
            b = _ranked(df.select(id_col, c), hashed(id_col, seed + r), id_col, name="__right").select(F.col("__right").alias("__left"), F.col(c).alias("__new"))
            shuffled = a.join(b, "__left").select(*[F.col("__new").alias(x) if x == c else F.col(f"`{x}`") for x in df.columns])
            drops.append(base - score(predict(shuffled)))
        out.append((c, float(np.mean(drops)), float(np.std(drops))))
    return out
