"""SQL for fitted models: normal equations by elimination, reweighting unrolled step by step, folds by ranks.

Each text is put together from common table expressions; a matrix is a row with columns m0_0, m0_1, ... (the last
column of a line is its right side), so that all folds and penalties are solved side by side.
"""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}
X = ["a", "b", "c"]
_D = """d AS MATERIALIZED (SELECT *, row_number() OVER () AS rid, CAST(a + b > 1 AS DOUBLE) + CAST(a - c > 0.4 AS DOUBLE) AS k, CAST(a + b > 1 AS DOUBLE) AS bin FROM (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity / 50 AS a, l_discount * 10 AS b, l_tax * 10 AS c, l_extendedprice / 1e5 AS y FROM lineitem))"""
_S = """d AS (SELECT *, a * 2 - b AS y, CAST(a > b AS DOUBLE) AS k FROM (SELECT s_suppkey AS id, s_acctbal / 10000 AS a, s_nationkey / 25.0 AS b FROM supplier))"""


def _all(*parts) -> str:
    return ",\n".join(x for p in parts for x in (p if isinstance(p, list) else [p]))


def _put(name: str, *parts, then: str, base: str = _D) -> None:
    SQL[name] = f"WITH RECURSIVE {_all(base, *parts)}\n{then}"


def _hash(seed: int) -> str:
    """The library's hash of an id: the first 60 bits of an MD5."""
    return f"CAST(concat('0x', substr(md5(concat('{seed}/', CAST(id AS VARCHAR))), 1, 15)) AS BIGINT)"


def solve(rel: str, n: int, keys: list[str], out: str, more: list[str] = ()) -> list[str]:
    """Unknowns x0, x1, ... of each row's equations by elimination; ``more`` columns are handed on."""
    held, ctes, at = [*keys, *more], [], rel
    for p in range(n - 1):
        cols = [f"m{i}_{j}" + (f" - m{i}_{p} / m{p}_{p} * m{p}_{j}" if i > p else "") + f" AS m{i}_{j}" for i in range(n) for j in range(n + 1)]
        ctes.append(f"{out}_e{p} AS (SELECT {', '.join([*held, *cols])} FROM {at})")
        at = f"{out}_e{p}"
    rest = [f"m{i}_{j}" for i in range(n) for j in range(n + 1)]
    for p in range(n - 1, -1, -1):
        known = [f"x{q}" for q in range(p + 1, n)]
        value = " - ".join([f"m{p}_{n}", *[f"m{p}_{q} * x{q}" for q in range(p + 1, n)]])
        ctes.append(f"{out}_b{p} AS (SELECT {', '.join([*held, *(rest if p else []), *known])}, ({value}) / m{p}_{p} AS x{p} FROM {at})")
        at = f"{out}_b{p}"
    return [*ctes, f"{out} AS (SELECT * FROM {at})"]


def least_squares(out: str, rel: str, cols: list[str], target: str, lam: str = "0", keys: list[str] = (), tail: str = "") -> list[str]:
    """Coefficients x0, ... and intercept ``free`` of penalised least squares, one row for each value of the keys."""
    n, names = len(cols), [*cols, target]
    cells = [f"covar_pop({a}, {b}) * count(*)" + (f" + {lam}" if i == j else "") + f" AS m{i}_{j}" for i, a in enumerate(cols) for j, b in enumerate(names)]
    means = [f"avg({c}) AS mean{i}" for i, c in enumerate(names)]
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    got = [f"{out}_m AS (SELECT {', '.join([*keys, *cells, *means])} FROM {rel} {tail}{group})"]
    got += solve(f"{out}_m", n, list(keys), f"{out}_x", [f"mean{i}" for i in range(n + 1)])
    free = " - ".join([f"mean{n}", *[f"x{i} * mean{i}" for i in range(n)]])
    return [*got, f"{out} AS (SELECT {', '.join([*keys, *[f'x{i}' for i in range(n)]])}, {free} AS free FROM {out}_x)"]


def form(cols: list[str], model: str = "") -> str:
    at = f"{model}." if model else ""
    return " + ".join([f"{at}free", *[f"{at}x{i} * {c}" for i, c in enumerate(cols)]])


def folds(k: int, how: str = "k_fold", rel: str = "d", out: str = "f") -> str:
    rank = f"(SELECT *, row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () AS n FROM {rel})"
    if how == "k_fold":
        long = f"(n % {k}) * (n // {k} + 1)"
        fold = f"CASE WHEN r < {long} THEN r // (n // {k} + 1) ELSE n % {k} + (r - {long}) // greatest(n // {k}, 1) END"
    else:
        fold = f"least(r // greatest(n // {k}, 1), {k - 1})"
    return f"{out} AS (SELECT * EXCLUDE (r, n), CAST({fold} AS INTEGER) AS fold FROM {rank})"


def fold_scores(out: str, k: int, lams: list[float], train: str = "", on: str = "t.fold = s.fold") -> list[str]:
    """R^2 on each fold (or, with another ``on``, of the training rows) for each penalty, trained on all other folds."""
    values = ", ".join(f"({x}::DOUBLE)" for x in lams)
    rel = f"f JOIN (SELECT unnest(range({k})) AS t_fold) g ON f.fold <> g.t_fold CROSS JOIN (SELECT col0 AS lam FROM (VALUES {values})) l"
    fit = least_squares(f"{out}_fit", rel, X, "y", "any_value(lam)", ["t_fold", "lam"], train)
    score = f"""{out} AS (SELECT t_fold, lam, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS score FROM (
  SELECT t_fold, lam, y, {form(X, 's')} AS p FROM f t JOIN {out}_fit s ON {on.replace('s.fold', 's.t_fold')} {train}) GROUP BY t_fold, lam)"""
    return [*fit, score]


def reweighted(out: str, cols: list[str], target: str, weight: str, z: str, rounds: int, tol: float, penalty: str = "0", start: str | None = None, before: str = "") -> list[str]:
    """Coefficients x0 (intercept), x1, ... by ``rounds`` of weighted least squares; ``eta`` is the linear form so far.

    Rounds after the one that changes little keep its coefficients, as the loop stops there. ``before`` may add a
    relation of one row made from residuals (name it {out}_s{r}).
    """
    n, ctes = len(cols) + 1, []
    zero = ", ".join(f"{'0.0' if i or not start else start}::DOUBLE AS x{i}" for i in range(n))
    ctes.append(start if start and start.startswith(f"{out}_0 AS") else f"{out}_0 AS (SELECT {zero}, FALSE AS done{' FROM d' if start and '(' in start else ''})")
    design = ["1.0", *cols]
    for r in range(1, rounds + 1):
        eta = " + ".join(f"x{i} * {c}" for i, c in enumerate(design))
        if before:
            ctes.append(before.format(out=out, r=r, last=r - 1, eta=eta))
        scale = f", {out}_s{r}" if before else ""
        cells = [f"sum(w_ * {a} * {b})" + (f" + 1e-12 + {penalty if i else 0}" if i == j else "") + f" AS m{i}_{j}" for i, a in enumerate(design) for j, b in enumerate([*design, "z_"])]
        ctes.append(f"{out}_m{r} AS (SELECT {', '.join(cells)} FROM (SELECT *, {weight} AS w_, {z} AS z_ FROM (SELECT d.*, {eta} AS eta{', scale' if before else ''} FROM d, {out}_{r - 1}{scale})))")
        ctes += solve(f"{out}_m{r}", n, [], f"{out}_n{r}")
        gap, size = (f"greatest({', '.join(f'abs({e})' for e in each)})" for each in ([f"n.x{i} - o.x{i}" for i in range(n)], [f"n.x{i}" for i in range(n)]))
        keep = ", ".join(f"CASE WHEN o.done THEN o.x{i} ELSE n.x{i} END AS x{i}" for i in range(n))
        ctes.append(f"{out}_{r} AS MATERIALIZED (SELECT {keep}, o.done OR {gap} < {tol} * greatest(1, {size}) AS done FROM {out}_{r - 1} o, {out}_n{r} n)")
    return [*ctes, f"{out} AS (SELECT {', '.join(f'x{i}' for i in range(n))} FROM {out}_{rounds})"]


def line(cols: list[str]) -> str:
    return " + ".join(["x0", *[f"x{i + 1} * {c}" for i, c in enumerate(cols)]])


# Least squares on three features, alone and combined.
_put("voting_regressor", least_squares("o", "d", X, "y"), least_squares("p", "d", X, "y", "10.0"), then=f"SELECT id, CAST(round(CAST(y AS DECIMAL(18, 8)), 4) AS DOUBLE) AS y, round((({form(X, 'o')}) + 2 * ({form(X, 'p')})) / 3, 4) AS prediction FROM d, o, p")
_put("multi_output_regressor", least_squares("o", "d", ["a", "b"], "y", "1.0"), least_squares("p", "d", ["a", "b"], "c", "1.0"), then=f"SELECT id, round({form(['a', 'b'], 'o')}, 4) AS prediction_y, round({form(['a', 'b'], 'p')}, 4) AS prediction_c FROM d, o, p")
_put("regressor_chain", least_squares("p", "d", ["a", "b"], "c", "1.0"), least_squares("o", "d", ["a", "b", "c"], "y", "1.0"), f"e AS (SELECT id, a, b, {form(['a', 'b'], 'p')} AS pc FROM d, p)", then=f"SELECT id, round({form(['a', 'b', 'pc'], 'o')}, 4) AS prediction_y, round(pc, 4) AS prediction_c FROM e, o")
_put("transformed_target", "t AS (SELECT *, ln(1 + y) AS v FROM d)", least_squares("o", "t", X, "v"), then=f"SELECT id, round(exp({form(X)}) - 1, 4) AS prediction FROM d, o")
_std = "t AS (SELECT id, y, c AS c0, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in X) + " FROM d)"
_put("pipeline_scale_ridge", _std, least_squares("o", "t", X, "y", "1.0"), then=f"SELECT id, round({form(X)}, 4) AS prediction FROM t, o")
_put("column_transformer", _std, "u AS (SELECT t.*, (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) AS mm FROM t)", then="SELECT id, round(a, 4) AS std__a, round(b, 4) AS std__b, round(mm, 4) AS mm__b, round(c0, 4) AS c FROM u")
_put("stacking_regressor", folds(3), [x for name, lam in (("o", "0"), ("p", "100.0")) for x in least_squares(name, "f JOIN (SELECT unnest(range(3)) AS t_fold) g ON f.fold <> g.t_fold", X, "y", lam, ["t_fold"])],
     f"e AS (SELECT y, {form(X, 'o')} AS s0, {form(X, 'p')} AS s1 FROM f JOIN o ON o.t_fold = f.fold JOIN p ON p.t_fold = f.fold)", least_squares("q", "e", ["s0", "s1"], "y", "1.0"), least_squares("ow", "d", X, "y"), least_squares("pw", "d", X, "y", "100.0"),
     f"h AS (SELECT id, {form(X, 'ow')} AS s0, {form(X, 'pw')} AS s1 FROM d, ow, pw)", then=f"SELECT id, round({form(['s0', 's1'], 'q')}, 4) AS prediction FROM h, q")

# Cross-validation and search.
_put("search_cross_val_score", folds(3, "cv"), fold_scores("s", 3, [1.0]), then="SELECT CAST(t_fold AS INTEGER) AS fold, round(score, 4) AS score FROM s")
_put("search_cross_val_predict", folds(3, "cv"), fold_scores("s", 3, [1.0]), then=f"SELECT id, round({form(X, 's_fit')}, 4) AS prediction FROM f JOIN s_fit ON s_fit.t_fold = f.fold")
_put("search_grid", folds(3), fold_scores("s", 3, [0.1, 10.0, 1000.0]), then="SELECT lam, round(avg(score), 4) AS score FROM s GROUP BY lam")
_put("search_validation_curve", folds(2), fold_scores("s", 2, [0.1, 100.0]), fold_scores("u", 2, [0.1, 100.0], on="t.fold <> s.fold"), then="SELECT lam, round(avg(u.score), 4) AS train, round(avg(s.score), 4) AS test FROM s JOIN u USING (t_fold, lam) GROUP BY lam")
_half = f"WHERE {_hash(7)} % 1048576 < 0.3 * 1048576"
_put("search_learning_curve", folds(2), fold_scores("s", 2, [1.0]), fold_scores("u", 2, [1.0], on="t.fold <> s.fold"), fold_scores("v", 2, [1.0], _half, "t.fold <> s.fold"),
     f"w AS (SELECT t_fold, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS score FROM (SELECT t_fold, y, {form(X, 'v_fit')} AS p FROM f JOIN v_fit ON f.fold = v_fit.t_fold) GROUP BY t_fold)",
     then="SELECT 0.3::DOUBLE AS share, round((SELECT avg(score) FROM v), 4) AS train, round((SELECT avg(score) FROM w), 4) AS test UNION ALL SELECT 1.0, round((SELECT avg(score) FROM u), 4), round((SELECT avg(score) FROM s), 4)")
_ALPHAS = [1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0]
_put("linear_ridge_cv", folds(5), fold_scores("s", 5, _ALPHAS), "best AS (SELECT lam AS alpha FROM (SELECT lam, avg(score) AS m FROM s GROUP BY lam) ORDER BY m DESC, lam LIMIT 1)", least_squares("o", "d, best", X, "y", "any_value(alpha)"), then=f"SELECT id, round({form(X)}, 4) AS prediction FROM d, o")

# Reweighted models.
_CLIP = "greatest(-30.0, least(30.0, eta))"
for _n, _p in (("glm_poisson", 1.0), ("glm_tweedie", 1.5), ("glm_gamma", 2.0)):
    _put(_n, reweighted("g", X, "y", f"pow(exp({_CLIP}), {2 - _p})", f"eta + (y - exp({_CLIP})) / exp({_CLIP})", 8, 1e-8, start="ln(greatest(avg(y), 1e-12))"), then=f"SELECT id, CAST(round(CAST(y AS DECIMAL(18, 8)), 4) AS DOUBLE) AS y, round(exp({line(X)}), 4) AS prediction FROM d, g")
_P = f"(1 / (1 + exp(-{_CLIP})))"
_W = f"greatest({_P} * (1 - {_P}), 1e-10)"
_put("glm_logistic", reweighted("g", X, "bin", _W, f"eta + (bin - {_P}) / {_W}", 15, 1e-8, "1.0"), then=f"SELECT id, bin, CASE WHEN {line(X)} >= 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction FROM d, g")
_put("glm_binomial", reweighted("g", ["c"], "bin", _W, f"eta + (bin - {_P}) / {_W}", 8, 1e-8), then=f"SELECT id, bin, round(1 / (1 + exp(-({line(['c'])}))), 4) AS prediction FROM d, g")
_first = reweighted("i", X, "y", "1.0", "y", 1, 1.0, "1e-4")
_put("glm_huber", _first, reweighted("g", X, "y", "CASE WHEN abs(y - eta) / scale <= 1.35 THEN 1.0 ELSE 1.35 / (abs(y - eta) / scale) END", "y", 5, 1e-6, "1e-4", start="g_0 AS (SELECT x0, x1, x2, x3, FALSE AS done FROM i)", before="{out}_s{r} AS (SELECT greatest(quantile_cont(abs(y - ({eta})), 0.5) / 0.6744897501960817, 1e-12) AS scale FROM d, {out}_{last})"),
     then=f"SELECT id, CAST(round(CAST(y AS DECIMAL(18, 8)), 4) AS DOUBLE) AS y, round({line(X)}, 4) AS prediction FROM d, g")
_put("glm_quantile", reweighted("i", X, "y", "1.0", "y", 1, 1.0), reweighted("g", X, "y", "0.5 / greatest(abs(y - eta), 1e-6)", "y", 8, 1e-6, start="g_0 AS (SELECT x0, x1, x2, x3, FALSE AS done FROM i)"), then=f"SELECT id, CAST(round(CAST(y AS DECIMAL(18, 8)), 4) AS DOUBLE) AS y, round({line(X)}, 4) AS prediction FROM d, g")
_put("glm_isotonic", "g AS (SELECT a, avg(y) AS m, count(*) AS w FROM d GROUP BY a), s AS (SELECT p.a AS lo, q.a AS hi, (SELECT sum(m * w) / sum(w) FROM g WHERE a BETWEEN p.a AND q.a) AS v FROM g p JOIN g q ON p.a <= q.a)",
     "i AS (SELECT g.a, max(v) AS v FROM g JOIN (SELECT g.a, lo, min(v) AS v FROM g JOIN s ON lo <= g.a AND hi >= g.a GROUP BY g.a, lo) z ON z.a = g.a GROUP BY g.a)", then="SELECT id, round(v, 4) AS prediction FROM d JOIN i ON i.a = d.a")

# Discriminants: inverses of three by three matrices by cofactors.
_pairs = [(i, j) for i in range(3) for j in range(i, 3)]


def inverse(rel: str, out: str, keys: str) -> str:
    """Inverse v00 ... v22 and determinant of symmetric matrices with columns c00, c01, c02, c11, c12, c22."""
    c = lambda i, j: f"c{min(i, j)}{max(i, j)}"
    det = "(c00 * (c11 * c22 - c12 * c12) - c01 * (c01 * c22 - c12 * c02) + c02 * (c01 * c12 - c11 * c02))"
    minor = lambda i, j: f"({c((i + 1) % 3, (j + 1) % 3)} * {c((i + 2) % 3, (j + 2) % 3)} - {c((i + 1) % 3, (j + 2) % 3)} * {c((i + 2) % 3, (j + 1) % 3)})"
    return f"{out} AS (SELECT {keys}, {det} AS det, {', '.join(f'{minor(i, j)} / {det} AS v{i}{j}' for i, j in _pairs)} FROM {rel})"


_quad = " + ".join(f"{1 if i == j else 2} * v{i}{j} * ({X[i]} - m{i}) * ({X[j]} - m{j})" for i, j in _pairs)
_means = ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(X))
_within = lambda f: ", ".join(f"{f}({X[i]}, {X[j]}){' * count(*)' if f == 'covar_pop' else ''}{' + 1e-9' if i == j and f == 'covar_samp' else ''} AS c{i}{j}" for i, j in _pairs)
_lda = [f"g AS (SELECT k, count(*) AS n, ln(count(*) / CAST((SELECT count(*) FROM d) AS DOUBLE)) AS p, {_means}, {_within('covar_pop')} FROM d GROUP BY k)",
        "w AS (SELECT " + ", ".join(f"sum(c{i}{j}) / greatest(sum(n) - count(*), 1){' + 1e-9' if i == j else ''} AS c{i}{j}" for i, j in _pairs) + " FROM g)", inverse("w", "v", "0 AS z"),
        f"lda AS (SELECT rid, k_ AS pick FROM (SELECT d.rid, g.k AS k_, row_number() OVER (PARTITION BY d.rid ORDER BY p - 0.5 * ({_quad}) DESC, g.k) AS rn FROM d, g, v) WHERE rn = 1)"]
_qda = [f"q AS (SELECT k, ln(count(*) / CAST((SELECT count(*) FROM d) AS DOUBLE)) AS p, {_means}, {_within('covar_samp')} FROM d GROUP BY k)", inverse("q", "qv", "k, p, m0, m1, m2"),
        f"qda AS (SELECT rid, k_ AS pick FROM (SELECT d.rid, qv.k AS k_, row_number() OVER (PARTITION BY d.rid ORDER BY p - 0.5 * ln(det) - 0.5 * ({_quad}) DESC, qv.k) AS rn FROM d, qv) WHERE rn = 1)"]
_put("discriminant_linear", _lda, then="SELECT d.id, d.k, pick AS prediction FROM d JOIN lda ON lda.rid = d.rid")
_put("discriminant_quadratic", _qda, then="SELECT d.id, d.k, pick AS prediction FROM d JOIN qda ON qda.rid = d.rid")
_put("voting_classifier", _lda, _qda, then="SELECT d.id, d.k, least(lda.pick, qda.pick) AS prediction FROM d JOIN lda ON lda.rid = d.rid JOIN qda ON qda.rid = d.rid")

# Rows in order on a small table: one step of a recursion each.
_rows = "o AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n FROM d)"
_pa = "w AS (SELECT 0 AS step, 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb, 0.0::DOUBLE AS bias UNION ALL SELECT step + 1, wa + t * a, wb + t * b, bias + t FROM (SELECT step, wa, wb, bias, a, b, {t} AS t FROM w JOIN o ON o.pos = step % n WHERE step < 10 * n))"
_f = "(wa * a + wb * b + bias)"
_put("passive_aggressive_classifier", _rows, _pa.format(t=f"least(1.0, greatest(0.0, 1 - (2 * k - 1) * {_f}) / (a * a + b * b + 1)) * (2 * k - 1)"), base=_S, then=f"SELECT d.id, d.k, CASE WHEN {_f} > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction FROM d, (SELECT * FROM w ORDER BY step DESC LIMIT 1)")
_put("passive_aggressive_regressor", _rows, _pa.format(t=f"least(1.0, greatest(0.0, abs(y - {_f}) - 0.1) / (a * a + b * b + 1)) * sign(y - {_f})"), base=_S, then=f"SELECT d.id, round(d.y, 4) + 0.0 AS y, round({_f}, 4) + 0.0 AS prediction FROM d, (SELECT * FROM w ORDER BY step DESC LIMIT 1)")
_sgd = """w AS (SELECT 0 AS step, 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb, 0.0::DOUBLE AS bias, 0.0::DOUBLE AS total, FALSE AS done UNION ALL
  SELECT step + 1, wa * s - eta * g * a, wb * s - eta * g * b, bias - eta * g, total + loss, pos = n - 1 AND (total + loss) / n < 1e-3
  FROM (SELECT *, 1 - eta * 1e-4 AS s FROM (SELECT step, wa, wb, bias, a, b, pos, n, 0.01 / pow(step + 1, 0.25) AS eta, CASE WHEN pos = 0 THEN 0.0 ELSE total END AS total, {loss} AS loss, {g} AS g FROM w JOIN o ON o.pos = step % n WHERE NOT done AND step < {epochs} * n)))"""
_hinge = f"(2 * k - 1) * {_f}"
_put("sgd_classifier", _rows, _sgd.format(loss=f"greatest(0.0, 1 - {_hinge})", g=f"CASE WHEN {_hinge} < 1 THEN -(2 * k - 1) ELSE 0.0 END", epochs=20), base=_S, then=f"SELECT d.id, d.k, CASE WHEN {_f} > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction FROM d, (SELECT * FROM w ORDER BY step DESC LIMIT 1)")
for _n, _loss, _g, _e in (("sgd_regressor", f"0.5 * ({_f} - y) * ({_f} - y)", f"{_f} - y", 20), ("svm_linear_svr", f"greatest(0.0, abs({_f} - y) - 0.1)", f"CASE WHEN abs({_f} - y) > 0.1 THEN sign({_f} - y) ELSE 0.0 END", 100)):
    _put(_n, _rows, _sgd.format(loss=_loss, g=_g, epochs=_e), base=_S, then=f"SELECT d.id, round(d.y, 4) + 0.0 AS y, round({_f}, 4) + 0.0 AS prediction FROM d, (SELECT * FROM w ORDER BY step DESC LIMIT 1)")
_put("cluster_dbscan", "near AS (SELECT p.id AS i, q.id AS j FROM d p, d q WHERE sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)) <= 0.08), core AS (SELECT i FROM near GROUP BY i HAVING count(*) >= 4)",
     "reach(i, low) AS (SELECT i, i FROM core UNION SELECT j, low FROM reach JOIN near ON near.i = reach.i WHERE j IN (SELECT i FROM core) AND low < j), root AS (SELECT i, min(low) AS low FROM reach GROUP BY i)",
     "num AS (SELECT low, row_number() OVER (ORDER BY low) - 1 AS c FROM (SELECT DISTINCT low FROM root)), lab AS (SELECT j, min(c) AS c FROM near JOIN root ON root.i = near.i JOIN num USING (low) GROUP BY j)",
     base=_S, then="SELECT d.id, CAST(coalesce(c, -1) AS BIGINT) AS cluster FROM d LEFT JOIN lab ON lab.j = d.id")

# One boosted split: missing values on either side of each cut; categories in the order of their means.
_one = "m AS (SELECT avg(y) AS mean, count(*) AS total FROM d)"
_best = "best AS (SELECT *, total - nl AS nr, -sl AS sr FROM cut, m WHERE least(nl, total - nl) >= {least} ORDER BY sl * sl / nl + sl * sl / (total - nl) DESC, way, spot LIMIT 1)"
_side = "SELECT id, round(mean + 0.5 * CASE WHEN {left} THEN sl / nl ELSE sr / nr END, 4) + 0.0 AS prediction FROM d, best"
_put("leafwise_boosting_missing", _one, "g AS (SELECT b, count(*) AS n, sum(y - mean) AS s FROM d, m GROUP BY b), gap AS (SELECT coalesce(sum(n), 0) AS n, coalesce(sum(s), 0) AS s FROM g WHERE b IS NULL)",
     "run AS (SELECT b AS spot, sum(n) OVER (ORDER BY b) AS n, sum(s) OVER (ORDER BY b) AS s FROM g WHERE b IS NOT NULL)",
     "cut AS (SELECT spot, way, run.n + way * gap.n AS nl, run.s + way * gap.s AS sl FROM run, gap, (VALUES (0), (1)) AS w(way))", _best.format(least=20),
     base="d AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_discount > 0 THEN l_discount * 10 END AS b, l_extendedprice / 1e5 AS y FROM lineitem)",
     then=_side.format(left="b <= spot OR (b IS NULL AND way = 1)"))
_put("leafwise_boosting_categories", _one, "g AS (SELECT nation, count(*) AS n, sum(y - mean) AS s FROM d, m GROUP BY nation)",
     "run AS (SELECT nation, row_number() OVER o AS spot, sum(n) OVER o AS nl, sum(s) OVER o AS sl FROM g WINDOW o AS (ORDER BY s / n, nation))", "cut AS (SELECT spot, 0 AS way, nl, sl FROM run)", _best.format(least=5),
     base="d AS (SELECT c_custkey AS id, CAST(c_nationkey AS DOUBLE) AS nation, CAST(c_acctbal / 1e4 AS DOUBLE) AS y FROM customer)",
     then=_side.format(left="(SELECT r.spot FROM run AS r WHERE r.nation = d.nation) <= best.spot"))
