"""Estimators whose results SQL can state exactly: Bayes, neighbours, least squares on few columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bayes, linear, metrics, neighbors, preprocessing, spatial
from .base import lineitem, rounded, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
X = ["l_quantity", "l_discount", "l_tax"]


def _add(name, query, sql, digits=6):
    QUERIES[name] = lambda spark, d: rounded(query(spark, d), digits)
    if sql:
        SQL[name] = sql


def _li(spark, d):
    return lineitem(spark, d).select("id", *X, "l_extendedprice", "l_returnflag")


_GNB = """WITH x AS (SELECT row_number() OVER () AS rid, l_orderkey * 10 + l_linenumber AS id, l_quantity AS a, l_discount AS b, l_tax AS c, l_returnflag AS y FROM lineitem),
s AS (SELECT y, ln(count(*) / CAST((SELECT count(*) FROM x) AS DOUBLE)) AS p, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, var_pop(a) + 1e-9 AS va, var_pop(b) + 1e-9 AS vb, var_pop(c) + 1e-9 AS vc FROM x GROUP BY y),
j AS (SELECT rid, id, x.y AS t, s.y, p - 0.5 * ln(2 * pi() * va) - (a - ma) * (a - ma) / (2 * va) - 0.5 * ln(2 * pi() * vb) - (b - mb) * (b - mb) / (2 * vb) - 0.5 * ln(2 * pi() * vc) - (c - mc) * (c - mc) / (2 * vc) AS l FROM x CROSS JOIN s),
r AS (SELECT id, t, y AS prediction, l, row_number() OVER (PARTITION BY rid ORDER BY l DESC, y) AS rn, sum(exp(l)) OVER (PARTITION BY rid) AS z FROM j)"""
_add("bayes_gaussian", lambda s, d: bayes.GaussianNB().fit(x := _li(s, d), X, "l_returnflag").transform(x, probability="p").select("id", "prediction", F.array_max("p").alias("p")), _GNB + " SELECT id, prediction, round(exp(l) / z, 6) AS p FROM r WHERE rn = 1")


def _flagship(spark, d):
    x = _li(spark, d)
    scaled = preprocessing.StandardScaler().fit(x, X).transform(x)
    return metrics.confusion_matrix(bayes.GaussianNB().fit(scaled, X, "l_returnflag").transform(scaled), "l_returnflag", "prediction")


QUERIES["flagship_scale_bayes_confusion"] = _flagship
SQL["flagship_scale_bayes_confusion"] = _GNB.replace("l_quantity AS a, l_discount AS b, l_tax AS c", "(l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS a, (l_discount - avg(l_discount) OVER ()) / stddev_pop(l_discount) OVER () AS b, (l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER () AS c") + """,
q AS (SELECT t, prediction FROM r WHERE rn = 1), l AS (SELECT t AS v FROM q UNION SELECT prediction FROM q)
SELECT a.v AS y_true, b.v AS y_pred, (SELECT count(*) FROM q WHERE t = a.v AND prediction = b.v) AS n FROM l a CROSS JOIN l b"""
def _partial(spark, d):
    x, nb = _li(spark, d), bayes.GaussianNB()
    state = nb.partial_fit(None, x.filter("id % 2 = 0"), X, "l_returnflag")
    return nb.partial_fit(state, x.filter("id % 2 = 1"), X, "l_returnflag").transform(x).select("id", "prediction")


_add("bayes_gaussian_partial_fit", _partial, _GNB + " SELECT id, prediction FROM r WHERE rn = 1")


def _counts(spark, d):
    return lineitem(spark, d).select("id", F.floor("l_quantity").alias("a"), (F.col("l_linenumber") * 3).alias("b"), F.round(F.col("l_discount") * 100).alias("c"), "l_returnflag")


_CNT = "WITH x AS (SELECT row_number() OVER () AS rid, l_orderkey * 10 + l_linenumber AS id, floor(l_quantity) AS a, l_linenumber * 3 AS b, round(l_discount * 100) AS c, l_returnflag AS y FROM lineitem)"
_pick = "SELECT id, y AS prediction FROM (SELECT id, s.y, row_number() OVER (PARTITION BY rid ORDER BY {l} DESC, s.y) AS rn FROM x CROSS JOIN s) WHERE rn = 1"
_add("bayes_multinomial", lambda s, d: bayes.MultinomialNB().fit(x := _counts(s, d), ["a", "b", "c"], "l_returnflag").transform(x).select("id", "prediction"), _CNT + ", s AS (SELECT y, ln(count(*)) AS p, ln((sum(a) + 1) / (sum(a) + sum(b) + sum(c) + 3)) AS wa, ln((sum(b) + 1) / (sum(a) + sum(b) + sum(c) + 3)) AS wb, ln((sum(c) + 1) / (sum(a) + sum(b) + sum(c) + 3)) AS wc FROM x GROUP BY y) " + _pick.format(l="p + a * wa + b * wb + c * wc"))
_add("bayes_bernoulli", lambda s, d: bayes.BernoulliNB(1.0, 5.0).fit(x := _counts(s, d), ["a", "b", "c"], "l_returnflag").transform(x).select("id", "prediction"), _CNT + """, s AS (SELECT y, ln(count(*)) AS p, (sum(CASE WHEN a > 5 THEN 1 ELSE 0 END) + 1) / (count(*) + 2.0::DOUBLE) AS pa, (sum(CASE WHEN b > 5 THEN 1 ELSE 0 END) + 1) / (count(*) + 2.0::DOUBLE) AS pb, (sum(CASE WHEN c > 5 THEN 1 ELSE 0 END) + 1) / (count(*) + 2.0::DOUBLE) AS pc FROM x GROUP BY y) """ + _pick.format(l="p + CASE WHEN a > 5 THEN ln(pa) ELSE ln(1 - pa) END + CASE WHEN b > 5 THEN ln(pb) ELSE ln(1 - pb) END + CASE WHEN c > 5 THEN ln(pc) ELSE ln(1 - pc) END"))


def _cust(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("a"), F.col("c_nationkey").cast("double").alias("b"), "c_mktsegment")


_KNN = "WITH x AS (SELECT c_custkey AS id, c_acctbal / 1000 AS a, CAST(c_nationkey AS DOUBLE) AS b, c_mktsegment AS y FROM customer), n AS (SELECT q.id, t.id AS t, t.y, t.a AS ta, d, row_number() OVER (PARTITION BY q.id ORDER BY d, t.id) AS rn FROM (SELECT q.id AS qid, t.id AS tid, {m} AS d FROM x q CROSS JOIN x t{w}) z JOIN x q ON q.id = qid JOIN x t ON t.id = tid)"
_e, _m = "sqrt((q.a - t.a) * (q.a - t.a) + (q.b - t.b) * (q.b - t.b))", "abs(q.a - t.a) + abs(q.b - t.b)"
_vote = ", v AS (SELECT id, y, {w} AS w FROM n WHERE rn <= 5 GROUP BY id, y) SELECT id, y AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, y) AS r FROM v) WHERE r = 1"
_add("knn_classifier_uniform", lambda s, d: neighbors.KnnClassifier(5).fit(x := _cust(s, d), "id", ["a", "b"], "c_mktsegment").transform(x), _KNN.format(m=_e, w="") + _vote.format(w="count(*)"))
_add("knn_classifier_manhattan", lambda s, d: neighbors.KnnClassifier(5, "manhattan").fit(x := _cust(s, d), "id", ["a", "b"], "c_mktsegment").transform(x), _KNN.format(m=_m, w="") + _vote.format(w="count(*)"))
_add("knn_classifier_distance", lambda s, d: neighbors.KnnClassifier(5, weights="distance").fit(x := _cust(s, d), "id", ["a", "b"], "c_mktsegment").transform(x), _KNN.format(m=_e, w="") + _vote.format(w="sum(CASE WHEN d < 1e-15 THEN 1e15 ELSE 1 / d END)"))
_c = "CASE WHEN sqrt(q.a * q.a + q.b * q.b) * sqrt(t.a * t.a + t.b * t.b) = 0 THEN 1.0 ELSE 1 - (q.a * t.a + q.b * t.b) / (sqrt(q.a * q.a + q.b * q.b) * sqrt(t.a * t.a + t.b * t.b)) END"
_add("knn_cosine_distances", lambda s, d: neighbors.k_nearest(x := _cust(s, d), x, "id", ["a", "b"], 5, "cosine").select(F.col("q_id").alias("id"), "rank", "distance"),
     _KNN.format(m=_c, w="") + " SELECT id, CAST(rn AS INTEGER) AS rank, round(d, 6) + 0.0 AS distance FROM n WHERE rn <= 5")
_add("eps_range_join", lambda s, d: spatial.eps_join(x := _cust(s, d), x, "id", ["a", "b"], 0.05), f"WITH x AS (SELECT c_custkey AS id, c_acctbal / 1000 AS a, CAST(c_nationkey AS DOUBLE) AS b FROM customer) SELECT q.id AS a_id, t.id AS b_id, round({_e}, 6) + 0.0 AS distance FROM x q CROSS JOIN x t WHERE {_e} <= 0.05")
_add("knn_regressor", lambda s, d: neighbors.KnnRegressor(5).fit(x := _cust(s, d), "id", ["b"], "a").transform(x), "WITH x AS (SELECT c_custkey AS id, c_acctbal / 1000 AS a, CAST(c_nationkey AS DOUBLE) AS b FROM customer), n AS (SELECT q.id, t.a, row_number() OVER (PARTITION BY q.id ORDER BY abs(q.b - t.b), t.id) AS rn FROM x q CROSS JOIN x t) SELECT id, round(avg(a), 6) AS prediction FROM n WHERE rn <= 5 GROUP BY id")
_add("local_outlier_factor", lambda s, d: neighbors.LocalOutlierFactor(10).fit_transform(_cust(s, d), "id", ["a", "b"]), _KNN.format(m=_e, w=" WHERE q.id <> t.id") + """, k AS (SELECT id, t, d FROM n WHERE rn <= 10), kd AS (SELECT id, max(d) AS kd FROM k GROUP BY id),
l AS (SELECT k.id, avg(greatest(d, kd)) AS m FROM k JOIN kd ON kd.id = k.t GROUP BY k.id), r AS (SELECT id, CASE WHEN m = 0 THEN 1.0 ELSE 1 / m END AS lrd FROM l),
f AS (SELECT k.id, avg(o.lrd) / any_value(r.lrd) AS lof FROM k JOIN r o ON o.id = k.t JOIN r ON r.id = k.id GROUP BY k.id)
SELECT id, round(lof, 6) AS lof, CASE WHEN lof > (SELECT quantile_cont(lof, 0.9) FROM f) THEN -1 ELSE 1 END AS prediction FROM f""")
_add("pairwise_distances", lambda s, d: neighbors.pairwise_distances(x := table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 1000).alias("a"), F.col("s_nationkey").cast("double").alias("b")), x, "id", ["a", "b"]), "WITH x AS (SELECT s_suppkey AS id, s_acctbal / 1000 AS a, CAST(s_nationkey AS DOUBLE) AS b FROM supplier) SELECT q.id AS a_id, t.id AS b_id, round(" + _e + ", 6) + 0.0 AS distance FROM x q CROSS JOIN x t")

_one = "WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, count(*) AS n, regr_sxx(l_extendedprice, l_quantity) AS xx, regr_sxy(l_extendedprice, l_quantity) AS xy, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem)"
_pred = " SELECT l_orderkey * 10 + l_linenumber AS id, round({a} + {b} * l_quantity, 3) AS prediction FROM lineitem, s"


def _fit(make):
    return lambda s, d: make().fit(x := _li(s, d), ["l_quantity"], "l_extendedprice").transform(x).select("id", "prediction")


_add("linear_ols", _fit(linear.OlsRegressor), _one + _pred.format(a="a", b="b"), 3)
_add("linear_ridge", _fit(lambda: linear.RidgeRegressor(1000.0)), _one + _pred.format(a="my - mx * (xy / (xx + 1000))", b="(xy / (xx + 1000))"), 3)
_add("linear_lasso", _fit(lambda: linear.LassoRegressor(1e6)), _one + _pred.format(a="my - mx * (sign(xy) * greatest(abs(xy) - 5e5, 0) / xx)", b="(sign(xy) * greatest(abs(xy) - 5e5, 0) / xx)"), 3)
_add("linear_elastic_net", _fit(lambda: linear.ElasticNetRegressor(1e5, 0.5)), _one + _pred.format(a="my - mx * (sign(xy) * greatest(abs(xy) - 2.5e4, 0) / (xx + 5e4))", b="(sign(xy) * greatest(abs(xy) - 2.5e4, 0) / (xx + 5e4))"), 3)


def _wls(spark, d):
    x = _li(spark, d).withColumn("w", F.col("l_tax") + 0.01)
    return linear.WlsRegressor("w").fit(x, ["l_quantity"], "l_extendedprice").transform(x).select("id", "prediction")


_add("linear_wls", _wls, """WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS x, l_extendedprice AS y, l_tax + 0.01 AS w FROM lineitem),
m AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM x), s AS (SELECT mx, my, sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS b FROM x, m GROUP BY mx, my)
SELECT id, round(my + b * (x - mx), 3) AS prediction FROM x, s""", 3)


def _two(spark, d):
    x = _li(spark, d)
    m = linear.OlsRegressor().fit(x, ["l_quantity", "l_discount"], "l_extendedprice")
    return spark.createDataFrame([(float(m.coef[0]), float(m.coef[1]), m.intercept)], "a double, b double, c double")


_add("linear_ols_two_features", _two, """WITH s AS (SELECT covar_pop(l_quantity, l_quantity) AS p, covar_pop(l_discount, l_discount) AS q, covar_pop(l_quantity, l_discount) AS r, covar_pop(l_quantity, l_extendedprice) AS u, covar_pop(l_discount, l_extendedprice) AS v, avg(l_quantity) AS mx, avg(l_discount) AS mz, avg(l_extendedprice) AS my FROM lineitem),
b AS (SELECT *, (u * q - v * r) / (p * q - r * r) AS a, (v * p - u * r) / (p * q - r * r) AS b FROM s) SELECT round(a, 3) AS a, round(b, 3) AS b, round(my - a * mx - b * mz, 3) AS c FROM b""", 3)


def _pca(spark, d):
    x = _li(spark, d)
    m = linear.PCA(2).fit(x, ["l_quantity", "l_extendedprice"])
    return spark.createDataFrame([(float(m.values[0]), float(m.values[1]))], "first double, second double")


_add("pca_variances", _pca, "WITH s AS (SELECT var_samp(l_quantity) AS p, var_samp(l_extendedprice) AS q, covar_samp(l_quantity, l_extendedprice) AS r FROM lineitem) SELECT round((p + q) / 2 + sqrt((p - q) * (p - q) / 4 + r * r), 2) AS first, round((p + q) / 2 - sqrt((p - q) * (p - q) / 4 + r * r), 2) AS second FROM s", 2)
