"""Scalers, encoders and text features over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import preprocessing as p
from ..operators import text as t
from .base import NUMERIC, lineitem, rounded, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _li(spark, d):
    return lineitem(spark, d).select("id", *NUMERIC)


def _add(name, query, sql, digits=6):
    QUERIES[name] = lambda spark, d: rounded(query(spark, d), digits)
    SQL[name] = sql


def _each(form: str, digits: int = 6, head: str = "", tail: str = "") -> str:
    """SELECT of a form over all numeric columns of lineitem; {c} is the column."""
    cells = ", ".join(f"round(CAST({form.format(c=c)} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in NUMERIC)
    return f"{head} SELECT l_orderkey * 10 + l_linenumber AS id, {cells} FROM lineitem {tail}"


_ends = "WITH e AS (SELECT " + ", ".join(f"{f}({c}) AS {n}_{c}" for c in NUMERIC for n, f in (("lo", "min"), ("hi", "max"))) + " FROM lineitem)"
_add("prep_standard_scaler", lambda s, d: p.StandardScaler().fit(x := _li(s, d), NUMERIC).transform(x), _each("({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()"))
_add("prep_standard_scaler_inverse", lambda s, d: (m := p.StandardScaler().fit(x := _li(s, d), NUMERIC)).inverse_transform(m.transform(x)), _each("{c}", 4), 4)
_add("prep_min_max_scaler", lambda s, d: p.MinMaxScaler().fit(x := _li(s, d), NUMERIC).transform(x), _each("({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())"))
_add("prep_max_abs_scaler", lambda s, d: p.MaxAbsScaler().fit(x := _li(s, d), NUMERIC).transform(x), _each("{c} / max(abs({c})) OVER ()"))
_add("prep_robust_scaler", lambda s, d: p.RobustScaler().fit(x := _li(s, d), NUMERIC).transform(x), _each("({c} - q_{c}[2]) / (q_{c}[3] - q_{c}[1])", head="WITH q AS (SELECT " + ", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}" for c in NUMERIC) + " FROM lineitem)", tail=", q"))
_norm = {"l1": "(abs(l_quantity) + abs(l_extendedprice) + abs(l_discount) + abs(l_tax))", "l2": "sqrt(l_quantity * l_quantity + l_extendedprice * l_extendedprice + l_discount * l_discount + l_tax * l_tax)", "max": "greatest(abs(l_quantity), abs(l_extendedprice), abs(l_discount), abs(l_tax))"}
for _k, _v in _norm.items():
    _add(f"prep_normalizer_{_k}", lambda s, d, k=_k: p.Normalizer(k).transform(_li(s, d), NUMERIC), _each("{c} / " + _v, 9), 9)
_add("prep_binarizer", lambda s, d: p.Binarizer(0.05).transform(_li(s, d), NUMERIC), _each("CASE WHEN {c} > 0.05 THEN 1.0 ELSE 0.0 END"))
_bin = "(CASE WHEN {c} >= q_{c}[2] THEN 1 ELSE 0 END + CASE WHEN {c} >= q_{c}[3] THEN 1 ELSE 0 END + CASE WHEN {c} >= q_{c}[4] THEN 1 ELSE 0 END + CASE WHEN {c} >= q_{c}[5] THEN 1 ELSE 0 END)"
_add("prep_kbins_quantile", lambda s, d: p.KBinsDiscretizer().fit(x := _li(s, d), NUMERIC).transform(x), _each(_bin, head="WITH q AS (SELECT " + ", ".join(f"quantile_cont({c}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q_{c}" for c in NUMERIC) + " FROM lineitem)", tail=", q"))
_add("prep_kbins_uniform_onehot", lambda s, d: p.KBinsDiscretizer(3, "uniform", "onehot").fit(x := _li(s, d).select("id", "l_quantity"), ["l_quantity"]).transform(x), """
WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem),
x AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_quantity >= a + (b - a) * (2 / 3.0::DOUBLE) THEN 2 WHEN l_quantity >= a + (b - a) * (1 / 3.0::DOUBLE) THEN 1 ELSE 0 END AS k FROM lineitem, e)
SELECT id, CASE WHEN k = 0 THEN 1.0 ELSE 0.0 END AS l_quantity_0, CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END AS l_quantity_1, CASE WHEN k = 2 THEN 1.0 ELSE 0.0 END AS l_quantity_2 FROM x""")
_add("prep_polynomial_features", lambda s, d: p.PolynomialFeatures(2).transform(_li(s, d), ["l_quantity", "l_discount", "l_tax"]).drop(*NUMERIC), """
SELECT l_orderkey * 10 + l_linenumber AS id, 1.0 AS poly_0, round(l_quantity, 6) AS poly_1, round(l_discount, 6) AS poly_2, round(l_tax, 6) AS poly_3,
 round(l_quantity * l_quantity, 6) AS poly_4, round(l_quantity * l_discount, 6) AS poly_5, round(l_quantity * l_tax, 6) AS poly_6,
 round(l_discount * l_discount, 6) AS poly_7, round(l_discount * l_tax, 6) AS poly_8, round(l_tax * l_tax, 6) AS poly_9 FROM lineitem""")
_add("prep_polynomial_interactions", lambda s, d: p.PolynomialFeatures(2, True).transform(_li(s, d), ["l_quantity", "l_discount", "l_tax"]).drop(*NUMERIC), """
SELECT l_orderkey * 10 + l_linenumber AS id, 1.0 AS poly_0, round(l_quantity, 6) AS poly_1, round(l_discount, 6) AS poly_2, round(l_tax, 6) AS poly_3,
 round(l_quantity * l_discount, 6) AS poly_4, round(l_quantity * l_tax, 6) AS poly_5, round(l_discount * l_tax, 6) AS poly_6 FROM lineitem""")
_add("prep_power_transformer", lambda s, d: p.PowerTransformer().fit(x := _li(s, d).select("id", "l_quantity"), ["l_quantity"]).transform(x), """
WITH g AS (SELECT CASE WHEN k = 20 THEN 0.0 ELSE round(-2 + 0.1 * k, 10) END AS lam, k FROM (SELECT unnest(range(41)) AS k)),
x AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS v FROM lineitem),
y AS (SELECT id, k, lam, v, CASE WHEN v >= 0 THEN CASE WHEN lam = 0 THEN ln(1 + v) ELSE (pow(v + 1, lam) - 1) / lam END ELSE CASE WHEN lam = 2 THEN -ln(1 - v) ELSE -(pow(1 - v, 2 - lam) - 1) / (2 - lam) END END AS t FROM x, g),
c AS (SELECT k, lam, 0.5 * ln(var_pop(t)) - (lam - 1) * avg(sign(v) * ln(1 + abs(v))) AS cost FROM y GROUP BY k, lam),
b AS (SELECT k FROM c ORDER BY cost, k LIMIT 1)
SELECT id, round((t - avg(t) OVER ()) / stddev_pop(t) OVER (), 6) + 0.0 AS l_quantity FROM y WHERE k = (SELECT k FROM b)""")
_add("prep_quantile_transformer", lambda s, d: p.QuantileTransformer(11).fit(x := _li(s, d).select("id", "l_extendedprice"), ["l_extendedprice"]).transform(x), """
WITH q AS (SELECT unnest(quantile_cont(l_extendedprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS q, unnest(range(11)) AS i FROM lineitem),
s AS (SELECT i, q AS a, lead(q) OVER (ORDER BY i) AS b FROM q)
SELECT l_orderkey * 10 + l_linenumber AS id, round(CASE WHEN l_extendedprice >= (SELECT max(q) FROM q) THEN 1.0 ELSE (i + (l_extendedprice - a) / (b - a)) / 10 END, 6) + 0.0 AS l_extendedprice
FROM lineitem JOIN s ON l_extendedprice >= a AND (l_extendedprice < b OR (b IS NULL AND false) OR (i = 9 AND l_extendedprice = b))""")


def _gaps(spark, d):
    return _li(spark, d).select("id", *[F.when(F.col(c) > lim, F.col(c)).alias(c) for c, lim in (("l_quantity", 10), ("l_discount", 0.02), ("l_tax", 0.01))])


_G = "WITH g AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_quantity > 10 THEN l_quantity END AS l_quantity, CASE WHEN l_discount > 0.02 THEN l_discount END AS l_discount, CASE WHEN l_tax > 0.01 THEN l_tax END AS l_tax FROM lineitem)"
_three = ["l_quantity", "l_discount", "l_tax"]


def _fill(form):
    return _G + " SELECT id, " + ", ".join(f"round(coalesce({c}, {form.format(c=c)}), 6) AS {c}" for c in _three) + " FROM g"


_add("prep_imputer_mean", lambda s, d: p.SimpleImputer().fit(x := _gaps(s, d), _three).transform(x), _fill("avg({c}) OVER ()"))
_add("prep_imputer_median", lambda s, d: p.SimpleImputer("median").fit(x := _gaps(s, d), _three).transform(x), _fill("(SELECT quantile_cont({c}, 0.5) FROM g)"))
_add("prep_imputer_most_frequent", lambda s, d: p.SimpleImputer("most_frequent").fit(x := _gaps(s, d), _three).transform(x), _fill("(SELECT {c} FROM g WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"))
_add("prep_imputer_constant", lambda s, d: p.SimpleImputer("constant", -1).fit(x := _gaps(s, d), _three).transform(x), _fill("-1.0"))
_add("prep_one_hot_encoder", lambda s, d: p.OneHotEncoder().fit(x := table(s, d, "nation").select("n_nationkey", "n_regionkey"), ["n_regionkey"]).transform(x), "SELECT n_nationkey, n_regionkey, " + ", ".join(f"CASE WHEN n_regionkey = {k} THEN 1.0 ELSE 0.0 END AS n_regionkey_{k}" for k in range(5)) + " FROM nation")
_add("prep_ordinal_encoder", lambda s, d: p.OrdinalEncoder().fit(x := lineitem(s, d).select("id", "l_returnflag", "l_linestatus"), ["l_returnflag", "l_linestatus"]).transform(x), "SELECT l_orderkey * 10 + l_linenumber AS id, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS l_returnflag, dense_rank() OVER (ORDER BY l_linestatus) - 1 AS l_linestatus FROM lineitem")
_add("prep_ordinal_inverse", lambda s, d: (m := p.OrdinalEncoder().fit(x := lineitem(s, d).select("id", "l_returnflag"), ["l_returnflag"])).inverse_transform(m.transform(x)), "SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag FROM lineitem")
_add("prep_label_encoder", lambda s, d: p.LabelEncoder().fit(x := table(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority").transform(x), "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority FROM orders")


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


_TERMS = """WITH w AS (SELECT doc_id AS row_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{2,}'), lambda t : lower(t))) AS term FROM documents),
n AS (SELECT row_id, term, CAST(count(*) AS DOUBLE) AS value FROM w GROUP BY ALL),
v AS (SELECT term, count(*) AS df FROM n GROUP BY term HAVING count(*) >= 3 AND count(*) <= greatest(CAST(floor(0.5 * (SELECT count(*) FROM documents)) AS BIGINT), 3)),
c AS (SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS "column" FROM v)"""
_add("text_count_vectorizer", lambda s, d: t.CountVectorizer(3, 0.5).fit(x := _docs(s, d), "doc_id", "text").transform(x, "doc_id", "text"), _TERMS + ' SELECT row_id, term, "column", value FROM n JOIN c USING (term)')
_add("text_tfidf_vectorizer", lambda s, d: t.TfidfVectorizer(3, 0.5).fit(x := _docs(s, d), "doc_id", "text").transform(x, "doc_id", "text"), _TERMS + """,
u AS (SELECT row_id, term, "column", value * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS x FROM n JOIN c USING (term))
SELECT row_id, term, "column", round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY row_id)), 1e-12), 6) AS value FROM u""")
_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(term) + 1), lambda i : ascii(substr(term, i, 1))::HUGEINT)), lambda h, b : CAST(((h - h % 256 + xor(CAST(h % 256 AS INT), CAST(b AS INT))) % 16777216 * 1099511627776 + (h - h % 256 + xor(CAST(h % 256 AS INT), CAST(b AS INT))) * 435) % 18446744073709551616::HUGEINT AS HUGEINT))"
_add("text_hashing_vectorizer", lambda s, d: t.HashingVectorizer(256).transform(_docs(s, d), "doc_id", "text"), f"""WITH w AS (SELECT doc_id AS row_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{{2,}}'), lambda t : lower(t))) AS term FROM documents),
n AS (SELECT row_id, term, CAST(count(*) AS DOUBLE) AS value FROM w GROUP BY ALL),
h AS (SELECT term, {_FNV} AS h FROM (SELECT DISTINCT term FROM n)),
s AS (SELECT row_id, CAST(h % 256 AS BIGINT) AS "column", sum(CASE WHEN h % 2 = 0 THEN value ELSE -value END) AS x FROM n JOIN h USING (term) GROUP BY ALL)
SELECT row_id, "column", round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY row_id)), 1e-12), 6) + 0.0 AS value FROM s""")
