"""Feature selection and splits over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import model_selection as ms
from ..operators import selection as sel
from .base import NUMERIC, lineitem, rounded, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name, query, sql, digits=6):
    QUERIES[name] = lambda spark, d: rounded(query(spark, d), digits)
    if sql:
        SQL[name] = sql


def _scores(spark, s):
    return spark.createDataFrame([(c, float(v), c in s.features) for c, v in zip(s.candidates, s.scores, strict=True)], "feature string, score double, kept boolean")


_long = "WITH d AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {k} AS k, {c} AS v, l_returnflag AS y, l_extendedprice AS t FROM lineitem" for k, c in enumerate(NUMERIC)) + ")"
_top = "rank() OVER (ORDER BY s DESC, k) <= 2 AS kept"
_add("select_variance_threshold", lambda s, d: _scores(s, sel.VarianceThreshold(0.01).fit(lineitem(s, d), NUMERIC)), _long + " SELECT feature, round(var_pop(v), 2) AS score, var_pop(v) > 0.01 AS kept FROM d GROUP BY feature", 2)
_add("select_k_best_f_classif", lambda s, d: _scores(s, sel.SelectKBest(2).fit(lineitem(s, d), NUMERIC, "l_returnflag")), _long + f""",
g AS (SELECT feature, k, y, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM d GROUP BY ALL),
t AS (SELECT feature, sum(n) AS nn, count(*) AS c, sum(n * m) / sum(n) AS mean, sum(n * s) AS w FROM g GROUP BY feature),
f AS (SELECT g.feature, k, (sum(n * (m - mean) * (m - mean)) / (max(c) - 1)) / (max(w) / (max(nn) - max(c))) AS s FROM g JOIN t USING (feature) GROUP BY g.feature, k)
SELECT feature, round(s, 4) AS score, {_top} FROM f""", 4)
_add("select_k_best_f_regression", lambda s, d: _scores(s, sel.SelectKBest(2, "f_regression").fit(lineitem(s, d), [c for c in NUMERIC if c != "l_extendedprice"], "l_extendedprice")), _long + f""",
c AS (SELECT feature, k, corr(v, t) AS r, count(*) AS n FROM d WHERE feature <> 'l_extendedprice' GROUP BY ALL), f AS (SELECT feature, k, r * r * (n - 2) / (1 - r * r) AS s FROM c)
SELECT feature, round(s, 3) AS score, {_top} FROM f""", 3)
_add("select_k_best_variance", lambda s, d: _scores(s, sel.SelectKBest(2, "variance").fit(lineitem(s, d), NUMERIC)), _long + f", f AS (SELECT feature, k, var_pop(v) AS s FROM d GROUP BY ALL) SELECT feature, round(s, 2) AS score, {_top} FROM f", 2)
_add("select_mutual_information", lambda s, d: _scores(s, sel.MutualInformationSelector(2).fit(lineitem(s, d), NUMERIC, "l_returnflag")), _long + f""",
e AS (SELECT feature, min(v) AS a, max(v) AS b, CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY feature),
j AS (SELECT feature, k, n, y, least(floor((v - a) / (b - a) * 10), 9) AS c, CAST(count(*) AS DOUBLE) AS m FROM d JOIN e USING (feature) GROUP BY ALL),
f AS (SELECT feature, k, sum(m / n * ln(m * n / (my * mc))) AS s FROM (SELECT *, sum(m) OVER (PARTITION BY feature, y) AS my, sum(m) OVER (PARTITION BY feature, c) AS mc FROM j) GROUP BY feature, k)
SELECT feature, round(s, 6) AS score, {_top} FROM f""")


def _o(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority")


def _h(seed, col="o_orderkey"):
    return f"CAST(concat('0x', substr(md5(concat('{seed}/', CAST({col} AS VARCHAR))), 1, 15)) AS BIGINT)"


_n = "count(*) OVER ()"
_add("split_train_test", lambda s, d: ms.train_test_split(_o(s, d), "o_orderkey", 0.25, 3), f"SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY {_h(3)}, o_orderkey) <= round({_n} * 0.25) AS is_test FROM orders")
_add("split_k_fold", lambda s, d: ms.k_fold(_o(s, d), "o_orderkey", 7), f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, {_n} // 7 AS q, {_n} % 7 AS m FROM orders)
SELECT o_orderkey, o_orderpriority, CAST(CASE WHEN r < m * (q + 1) THEN r // (q + 1) ELSE m + (r - m * (q + 1)) // q END AS INT) AS fold FROM r""")
_add("split_cv_fold", lambda s, d: ms.cv_fold(_o(s, d), "o_orderkey", 7), f"SELECT o_orderkey, o_orderpriority, CAST(least((row_number() OVER (ORDER BY o_orderkey) - 1) // ({_n} // 7), 6) AS INT) AS fold FROM orders")
_add("split_stratified_k_fold", lambda s, d: ms.stratified_k_fold(_o(s, d), "o_orderkey", "o_orderpriority", 5, 1), f"SELECT o_orderkey, o_orderpriority, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_h(1)}, o_orderkey) - 1) % 5 AS INT) AS fold FROM orders")
_add("split_shuffle", lambda s, d: ms.shuffle_split(_o(s, d), "o_orderkey", 2, 0.2, 4), " UNION ALL ".join(f"SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY {_h(4 + i)}, o_orderkey) <= round({_n} * 0.2) AS is_test, {i} AS split FROM orders" for i in range(2)))
_add("split_stratified_shuffle", lambda s, d: ms.stratified_shuffle_split(_o(s, d), "o_orderkey", "o_orderpriority", 2, 0.2, 4), " UNION ALL ".join(f"SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_h(4 + i)}, o_orderkey) <= least(ceil(count(*) OVER (PARTITION BY o_orderpriority) * 0.2), count(*) OVER (PARTITION BY o_orderpriority) - 1) AS is_test, {i} AS split FROM orders" for i in range(2)))
_add("split_leave_one_out", lambda s, d: ms.leave_one_out(table(s, d, "supplier").select("s_suppkey"), "s_suppkey"), "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS fold FROM supplier")
_add("split_leave_p_out", lambda s, d: ms.leave_p_out(table(s, d, "nation"), "n_nationkey", 2), "SELECT a.n_nationkey AS test_0, b.n_nationkey AS test_1 FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
_add("split_time_series", lambda s, d: ms.time_series_split(_o(s, d), "o_orderkey", 3), f"""WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, {_n} AS n, greatest(1, {_n} // 4) AS z FROM orders),
s AS (SELECT *, CAST(unnest(range(3)) AS INT) AS split FROM r) SELECT o_orderkey, o_orderpriority, split, r >= n - (3 - split) * z AS is_test FROM s WHERE r < n - (3 - split) * z + z AND n - (3 - split) * z > 0""")
_add("split_repeated_k_fold", lambda s, d: ms.repeated_k_fold(_o(s, d), "o_orderkey", 4, 2, 5), " UNION ALL ".join(f"SELECT o_orderkey, o_orderpriority, CAST((row_number() OVER (ORDER BY {_h(5 + i)}, o_orderkey) - 1) % 4 AS INT) AS fold, {i} AS repeat FROM orders" for i in range(2)))
_add("split_repeated_stratified_k_fold", lambda s, d: ms.repeated_stratified_k_fold(_o(s, d), "o_orderkey", "o_orderpriority", 4, 2, 5), " UNION ALL ".join(f"SELECT o_orderkey, o_orderpriority, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_h(5 + i)}, o_orderkey) - 1) % 4 AS INT) AS fold, {i} AS repeat FROM orders" for i in range(2)))
_add("split_group_k_fold", lambda s, d: ms.group_k_fold(table(s, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 4), "SELECT c_custkey, c_nationkey, CAST((dense_rank() OVER (ORDER BY c_nationkey) - 1) % 4 AS INT) AS fold FROM customer")
