"""Plans, row selection, functions, sparse tables, several outputs and folds: queries of what other operators are put together with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import bayes, cluster, meta, metrics, model_selection, preprocessing, text
from ..operators.linear import RidgeRegressor
from ..plans import pipeline as plans
from .base import LI, lineitem, rounded, table
from .models import X, _data, _orders
from .solved import _D, _S, _all, fold_scores, folds

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, run, sql: str, digits: int = 4) -> None:
    QUERIES[name] = lambda spark, d: rounded(run(spark, d), digits)
    SQL[name] = sql


def _std(c: str) -> str:
    return f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()"


def _unit(c: str) -> str:
    return f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())"


_P = ["l_quantity", "l_tax"]
_union = ", ".join(f"round({f(c)}, 4) + 0.0 AS {n}__{c}" for n, f in (("std", _std), ("mm", _unit)) for c in _P)
_add("plan_feature_union", lambda s, d: plans.FeatureUnion([("std", preprocessing.StandardScaler()), ("mm", preprocessing.MinMaxScaler())]).fit(x := lineitem(s, d), _P).transform(x, ["id"]), f"SELECT id, {_union} FROM {LI}")
_add("plan_function_transformer", lambda s, d: plans.FunctionTransformer(lambda x: x.select("id", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))).fit(x := lineitem(s, d)).transform(x),
     f"SELECT id, round(l_extendedprice * (1 - l_discount), 4) AS net FROM {LI}")
_add("plan_select_rows", lambda s, d: plans.select_rows(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", table(s, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))),
     "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")


def _links(spark, d):
    x = lineitem(spark, d).select("id", (F.col("l_quantity") - 25).alias("u"), (F.col("l_discount") * 100).alias("v"), (F.col("l_returnflag") == "R").cast("double").alias("y"))
    soft = numeric.softmax([F.col("u") / 10, F.col("v"), F.lit(0.0)])
    p = numeric.sigmoid(F.col("u"))
    return x.select("id", p.alias("sigmoid"), *[c.alias(f"soft_{k}") for k, c in enumerate(soft)], numeric.cross_entropy(F.col("y"), p).alias("loss"))


_add("function_links", _links, f"""WITH x AS (SELECT id, l_quantity - 25 AS u, l_discount * 100 AS v, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM {LI}),
e AS (SELECT *, 1 / (1 + exp(-u)) AS p, exp(u / 10) AS e0, exp(v) AS e1 FROM x)
SELECT id, round(p, 4) AS sigmoid, round(e0 / (e0 + e1 + 1), 4) AS soft_0, round(e1 / (e0 + e1 + 1), 4) AS soft_1, round(1 / (e0 + e1 + 1), 4) AS soft_2,
round(-(y * ln(greatest(p, 1e-15)) + (1 - y) * ln(greatest(1 - p, 1e-15))), 4) + 0.0 AS loss FROM e""")


def _product(spark, d):
    """Quantities of parts by order, as a sparse matrix, times the prices of parts."""
    long = text.from_triplets(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("column"), F.col("l_quantity").alias("value")))
    return text.matvec(long, table(spark, d, "part").select(F.col("p_partkey").alias("column"), F.col("p_retailprice").alias("x")))


_add("sparse_product", _product, "SELECT l_orderkey AS row_id, round(sum(l_quantity * p_retailprice), 2) AS value FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey", 2)


def _naive(name: str, label: str, fit: list[str], use: list[str], at: str) -> str:
    """{name} (rid, p): Gaussian naive Bayes of ``label`` on columns ``fit`` of d, predicted for columns ``use`` of ``at``."""
    about = ", ".join(f"avg({c}) AS m{k}, var_pop({c}) + 1e-9 AS v{k}" for k, c in enumerate(fit))
    joint = " ".join(f"- 0.5 * ln(2 * pi() * v{k}) - (x.{c} - m{k}) * (x.{c} - m{k}) / (2 * v{k})" for k, c in enumerate(use))
    return f"""{name}_s AS (SELECT {label} AS cls, ln(count(*) / CAST((SELECT count(*) FROM d) AS DOUBLE)) AS prior, {about} FROM d GROUP BY {label}),
{name} AS (SELECT rid, cls AS p FROM (SELECT rid, cls, row_number() OVER (PARTITION BY rid ORDER BY prior {joint} DESC, cls) AS o FROM {at} x CROSS JOIN {name}_s) WHERE o = 1)"""


_two = "SELECT d.id, g.p AS prediction_bin, h.p AS prediction_k FROM d JOIN g USING (rid) JOIN h USING (rid)"
_out = ["id", "prediction_bin", "prediction_k"]
_add("multi_output_classifier", lambda s, d: meta.MultiOutputClassifier(bayes.GaussianNB()).fit(x := _data(s, d), ["a", "c"], ["bin", "k"]).transform(x).select(*_out),
     f"WITH {_all(_D, _naive('g', 'bin', ['a', 'c'], ['a', 'c'], 'd'), _naive('h', 'k', ['a', 'c'], ['a', 'c'], 'd'))} {_two}")
_add("classifier_chain", lambda s, d: meta.ClassifierChain(bayes.GaussianNB()).fit(x := _data(s, d), ["a", "c"], ["bin", "k"]).transform(x).select(*_out),
     f"WITH {_all(_D, _naive('g', 'bin', ['a', 'c'], ['a', 'c'], 'd'), 'dg AS (SELECT d.*, g.p FROM d JOIN g USING (rid))', _naive('h', 'k', ['a', 'c', 'bin'], ['a', 'c', 'p'], 'dg'))} {_two}")

_r2 = lambda f: metrics.r2_score(f, "y", "prediction").first()[0]


def _ridge(candidate):
    return lambda train, test: RidgeRegressor(candidate["lam"]).fit(train, X, "y").transform(test)


def _validated(spark, d):
    got = model_selection.cross_validate(model_selection.cv_fold(_data(spark, d), "id", 3), "fold", _ridge({"lam": 1.0}), {"r2": _r2})
    return spark.createDataFrame([(g["fold"], g["rows"], float(g["r2"])) for g in got], "fold int, rows long, r2 double")


_add("search_cross_validate", _validated, f"WITH {_all(_D, folds(3, 'cv'), fold_scores('s', 3, [1.0]))} SELECT CAST(t_fold AS INTEGER) AS fold, (SELECT count(*) FROM f WHERE f.fold = t_fold) AS rows, round(score, 4) AS r2 FROM s")


def _random_search(spark, d):
    """All three candidates are drawn, in some order; the best is reported."""
    best, mean, means = model_selection.randomized_search_cv(model_selection.k_fold(_data(spark, d), "id", 3), "fold", {"lam": [0.1, 1e4, 1e6]}, 3, _ridge, _r2, seed=4)
    return spark.createDataFrame([(float(best["lam"]), float(mean), float(min(means)))], "lam double, score double, worst double")


_add("search_randomized", _random_search, f"WITH {_all(_D, folds(3), fold_scores('s', 3, [0.1, 1e4, 1e6]))}, m AS (SELECT lam, avg(score) AS score FROM s GROUP BY lam) SELECT CAST(arg_max(lam, score) AS DOUBLE) AS lam, round(max(score), 4) AS score, round(min(score), 4) AS worst FROM m")


def _propagated(rounds: int, neighbours: int) -> str:
    """Messages along the graph of nearest rows, each round written out."""
    gap = "sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b))"
    ctes = [_S, f"pair AS (SELECT p.id AS i, q.id AS k, {gap} AS dist FROM d p JOIN d q ON p.id <> q.id)", f"near AS (SELECT i, k, -(dist * dist) AS s FROM pair QUALIFY row_number() OVER (PARTITION BY i ORDER BY dist, k) <= {neighbours})",
            "g AS (SELECT i, k, s FROM near UNION SELECT k, i, s FROM near)", "m AS (SELECT s FROM (SELECT s, row_number() OVER (ORDER BY s) AS r, count(*) OVER () AS c FROM g) WHERE r = c // 2 + 1)",
            "e0 AS (SELECT i, k, s, 0.0::DOUBLE AS r, 0.0::DOUBLE AS a FROM g UNION ALL SELECT id, id, m.s, 0.0, 0.0 FROM d, m)"]
    for j in range(1, rounds + 1):
        ctes += [f"t{j} AS (SELECT *, a + s AS z, row_number() OVER (PARTITION BY i ORDER BY a + s DESC, k DESC) AS o FROM e{j - 1})", f"b{j} AS (SELECT i, max(z) FILTER (o = 1) AS z1, max(z) FILTER (o = 2) AS z2 FROM t{j} GROUP BY i)",
                 f"r{j} AS (SELECT i, k, s, a, 0.5 * r + 0.5 * (s - CASE WHEN o = 1 THEN z2 ELSE z1 END) AS r FROM t{j} JOIN b{j} USING (i))",
                 f"u{j} AS (SELECT k, sum(CASE WHEN i = k THEN 0.0 ELSE greatest(r, 0.0) END) AS gains, max(CASE WHEN i = k THEN r END) AS own FROM r{j} GROUP BY k)",
                 f"e{j} AS MATERIALIZED (SELECT i, k, s, r, 0.5 * a + 0.5 * CASE WHEN i = k THEN gains ELSE least(0.0, own + gains - greatest(r, 0.0)) END AS a FROM r{j} JOIN u{j} USING (k))"]
    ctes += [f"h AS (SELECT d.*, row_number() OVER (ORDER BY d.id) - 1 AS c FROM d JOIN e{rounds} ON i = d.id AND e{rounds}.k = d.id AND e{rounds}.a + e{rounds}.r > 0)",
             f"l AS (SELECT p.id, q.c FROM d p CROSS JOIN h q QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY (p.id = q.id) DESC, {gap}, q.id) = 1)"]
    return f"WITH {_all(*ctes)} SELECT d.id, CAST(coalesce(c, -1) AS BIGINT) AS cluster FROM d LEFT JOIN l USING (id)"


_add("cluster_affinity_graph", lambda s, d: cluster.AffinityPropagation(damping=0.5, max_iter=5, n_neighbors=5).fit_predict(_orders(s, d).select("id", "a", "b"), "id", ["a", "b"]), _propagated(5, 5))
