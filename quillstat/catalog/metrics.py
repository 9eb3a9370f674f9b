"""Evaluation metrics over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as m
from .base import lineitem, rounded, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _multi(spark, d):
    return lineitem(spark, d).select((F.col("l_linenumber") % 3).alias("t"), (F.floor("l_quantity") % 3).cast("int").alias("p"))


def _binary(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return docs.select(F.col("quality").alias("t"), (F.col("n_chars") > 1000).cast("int").alias("p"), (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("s"), F.col("n_chars").cast("double").alias("n"))


def _values(spark, d):
    return lineitem(spark, d).select(F.col("l_extendedprice").alias("t"), (F.col("l_quantity") * 1500).alias("p"))


def _groups(spark, d):
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("a"), (F.col("c_nationkey") % 5).alias("b"))


_M = "WITH d AS (SELECT l_linenumber % 3 AS t, CAST(floor(l_quantity) AS INT) % 3 AS p FROM lineitem)"
_B = "WITH d AS (SELECT quality AS t, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS p, n_chars / (n_chars + 1000.0) AS s, CAST(n_chars AS DOUBLE) AS n FROM documents JOIN labels USING (doc_id))"
_V = "WITH d AS (SELECT l_extendedprice AS t, l_quantity * 1500 AS p FROM lineitem)"
_C = "WITH d AS (SELECT c_mktsegment AS a, c_nationkey % 5 AS b FROM customer)"


def _add(name, data, metric, sql, digits=6):
    QUERIES[name] = lambda spark, d: rounded(metric(data(spark, d)), digits)
    SQL[name] = sql


def _score(name, data, metric, head, expr, digits=6):
    _add(name, data, metric, f"{head} SELECT round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS score FROM d", digits)


_REPORT = _M + """, l AS (SELECT t AS label FROM d UNION SELECT p FROM d),
r AS (SELECT label, CAST((SELECT count(*) FROM d WHERE t = label AND p = label) AS DOUBLE) AS tp, CAST((SELECT count(*) FROM d WHERE t = label) AS DOUBLE) AS support,
      CAST((SELECT count(*) FROM d WHERE p = label) AS DOUBLE) AS pred FROM l),
q AS (SELECT *, coalesce(tp / nullif(pred, 0), 0) AS "precision", coalesce(tp / nullif(support, 0), 0) AS recall FROM r),
c AS (SELECT *, coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0) AS f1 FROM q)"""

_score("metric_accuracy", _multi, lambda x: m.accuracy_score(x, "t", "p"), _M, "avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END)")
_add("metric_confusion_matrix", _multi, lambda x: m.confusion_matrix(x, "t", "p"), _M + """, l AS (SELECT t AS v FROM d UNION SELECT p FROM d)
SELECT a.v AS y_true, b.v AS y_pred, (SELECT count(*) FROM d WHERE t = a.v AND p = b.v) AS n FROM l a CROSS JOIN l b""")
_add("metric_class_report", _multi, lambda x: m.class_report(x, "t", "p").select("label", "precision", "recall", "f1", "support"), _REPORT + """
SELECT label, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM c""")
for _k in ("precision", "recall", "f1"):
    _f = {"precision": m.precision_score, "recall": m.recall_score, "f1": m.f1_score}[_k]
    _add(f"metric_{_k}_macro", _multi, lambda x, f=_f: f(x, "t", "p"), _REPORT + f' SELECT round(avg("{_k}"), 6) AS score FROM c')
    _add(f"metric_{_k}_micro", _multi, lambda x, f=_f: f(x, "t", "p", "micro"), _REPORT + " SELECT round(sum(tp) / sum(support), 6) AS score FROM c")
    _add(f"metric_{_k}_weighted", _multi, lambda x, f=_f: f(x, "t", "p", "weighted"), _REPORT + f' SELECT round(sum("{_k}" * support) / sum(support), 6) AS score FROM c')
_LADDER = _B + """, g AS (SELECT n AS s, sum(t) AS pos, count(*) AS k FROM d GROUP BY n),
r AS (SELECT s, pos, k, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(k) OVER (ORDER BY s DESC) - sum(pos) OVER (ORDER BY s DESC) AS fp,
      sum(pos) OVER () AS np, sum(k) OVER () - sum(pos) OVER () AS nn FROM g)"""
_add("metric_roc_auc", _binary, lambda x: m.roc_auc_score(x, "t", "n"), _LADDER + " SELECT round(CAST(sum((k - pos) * (tp - pos / 2.0)) / max(np * nn) AS DOUBLE), 6) AS score FROM r")
_add("metric_average_precision", _binary, lambda x: m.average_precision_score(x, "t", "n"), _LADDER + " SELECT round(CAST(sum(CAST(pos AS DOUBLE) / np * tp / (tp + fp)) AS DOUBLE), 6) AS score FROM r")
_add("metric_roc_curve", _binary, lambda x: m.roc_curve(x, "t", "n"), _LADDER + """
SELECT s AS threshold, round(CAST(fp AS DOUBLE) / nn, 6) AS fpr, round(CAST(tp AS DOUBLE) / np, 6) AS tpr FROM r UNION ALL SELECT max(s) + 1, 0.0, 0.0 FROM r""")
_add("metric_precision_recall_curve", _binary, lambda x: m.precision_recall_curve(x, "t", "n"), _LADDER + """
SELECT s AS threshold, round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS "precision", round(CAST(tp AS DOUBLE) / np, 6) AS recall FROM r UNION ALL SELECT NULL, 1.0, 0.0""")
_score("metric_matthews_corrcoef", _binary, lambda x: m.matthews_corrcoef(x, "t", "p"), _B, "corr(t, p)")
_score("metric_log_loss", _binary, lambda x: m.log_loss(x, "t", "s"), _B, "avg(CASE WHEN t = 1 THEN -ln(s) ELSE -ln(1 - s) END)")
_score("metric_brier", _binary, lambda x: m.brier_score_loss(x, "t", "s"), _B, "avg((t - s) * (t - s))")
_add("metric_balanced_accuracy", _multi, lambda x: m.balanced_accuracy_score(x, "t", "p"), _REPORT + " SELECT round(avg(recall), 6) AS score FROM c WHERE support > 0")
_add("metric_cohen_kappa", _multi, lambda x: m.cohen_kappa_score(x, "t", "p"), _REPORT + """, k AS (SELECT sum(tp) / sum(support) AS po, sum(support * pred) / sum(support) / sum(support) AS pe FROM c)
SELECT round((po - pe) / (1 - pe), 6) AS score FROM k""")
_score("metric_mse", _values, lambda x: m.mse(x, "t", "p"), _V, "avg((t - p) * (t - p))", 1)
_score("metric_mae", _values, lambda x: m.mae(x, "t", "p"), _V, "avg(abs(t - p))", 4)
_score("metric_r2", _values, lambda x: m.r2_score(x, "t", "p"), _V, "1 - avg((t - p) * (t - p)) / var_pop(t)")
_score("metric_mape", _values, lambda x: m.mean_absolute_percentage_error(x, "t", "p"), _V, "avg(abs((t - p) / t))")
_score("metric_explained_variance", _values, lambda x: m.explained_variance_score(x, "t", "p"), _V, "1 - var_pop(t - p) / var_pop(t)")
_score("metric_max_error", _values, lambda x: m.max_error(x, "t", "p"), _V, "max(abs(t - p))", 4)
_score("metric_median_absolute_error", _values, lambda x: m.median_absolute_error(x, "t", "p"), _V, "quantile_cont(abs(t - p), 0.5)", 4)
_score("metric_msle", _values, lambda x: m.mean_squared_log_error(x, "t", "p"), _V, "avg(pow(ln(1 + t) - ln(1 + p), 2))")
_PAIRS = _C + """, n AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY a, b), r AS (SELECT a, sum(n) AS r FROM n GROUP BY a), c AS (SELECT b, sum(n) AS c FROM n GROUP BY b), z AS (SELECT sum(n) AS z FROM n)"""
_add("metric_adjusted_rand", _groups, lambda x: m.adjusted_rand_score(x, "a", "b"), _PAIRS + """,
q AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM n) AS ij, (SELECT sum(r * (r - 1) / 2) FROM r) AS i, (SELECT sum(c * (c - 1) / 2) FROM c) AS j, z * (z - 1) / 2 AS t FROM z)
SELECT round((ij - i * j / t) / ((i + j) / 2 - i * j / t), 6) AS score FROM q""")
_add("metric_normalized_mutual_info", _groups, lambda x: m.normalized_mutual_info_score(x, "a", "b"), _PAIRS + """,
q AS (SELECT (SELECT sum(n / z * ln(n * z / (r * c))) FROM n JOIN r USING (a) JOIN c USING (b), z) AS mi, (SELECT -sum(r / z * ln(r / z)) FROM r, z) AS h1, (SELECT -sum(c / z * ln(c / z)) FROM c, z) AS h2)
SELECT round(greatest(0, least(1, 2 * mi / (h1 + h2))), 6) AS score FROM q""")


def _silhouette(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") / 25.0).alias("x"), (F.col("s_acctbal") / 10000).alias("y"), (F.col("s_nationkey") % 3).alias("c"))
    return rounded(m.silhouette_score(s, ["x", "y"], "c", "s_suppkey"))


QUERIES["metric_silhouette"] = _silhouette
SQL["metric_silhouette"] = """WITH s AS (SELECT s_suppkey AS i, s_nationkey / 25.0 AS x, s_acctbal / 10000 AS y, s_nationkey % 3 AS c FROM supplier),
g AS (SELECT a.i, a.c AS ac, b.c AS bc, sum(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS s, count(*) AS n FROM s a CROSS JOIN s b GROUP BY ALL),
p AS (SELECT i, max(CASE WHEN ac = bc THEN CASE WHEN n > 1 THEN s / (n - 1) ELSE 0 END END) AS a, max(CASE WHEN ac = bc THEN n END) AS m, min(CASE WHEN ac <> bc THEN s / n END) AS b FROM g GROUP BY i)
SELECT round(avg(CASE WHEN m = 1 THEN 1.0 ELSE (b - a) / greatest(a, b) END), 6) AS score FROM p"""
