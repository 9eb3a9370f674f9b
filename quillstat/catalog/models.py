"""Fitted models over the shared tables: queries whose results SQL can't state (iteration, search, dense solves)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster, discriminant, glm, iterative, kernels, linear, meta, metrics, model_selection, preprocessing, selection, trees
from ..plans import pipeline as plans
from .base import lineitem, rounded, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
X = ["a", "b", "c"]
SMALL = ["a", "b"]
_GRID = [{"lam": 0.1}, {"lam": 10.0}, {"lam": 1000.0}]


def _data(spark, d):
    """lineitem, scaled: three features, a number and a class that depend on them."""
    li = lineitem(spark, d).select("id", "l_linenumber", (F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), (F.col("l_tax") * 10).alias("c"), (F.col("l_extendedprice") / 1e5).alias("y"))
    return li.withColumn("k", ((F.col("a") + F.col("b")) > 1).cast("double") + ((F.col("a") - F.col("c")) > 0.4).cast("double")).withColumn("bin", ((F.col("a") + F.col("b")) > 1).cast("double"))


def _orders(spark, d):
    """suppliers: a table that methods on all pairs may take whole."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 10000).alias("a"), (F.col("s_nationkey") / 25.0).alias("b"))
    return s.withColumn("y", F.col("a") * 2 - F.col("b")).withColumn("k", (F.col("a") > F.col("b")).cast("double"))


def _add(name, run, data=_data, digits=4):
    QUERIES[name] = lambda spark, d: rounded(run(data(spark, d)), digits)


def _predict(name, make, features=X, label="y", data=_data, **fit):
    _add(name, lambda x: make().fit(x, features, label, **fit).transform(x).select("id", label, "prediction"), data)


for _n, _m in {
    "linear_bayesian_ridge": linear.BayesianRidge, "linear_ard": linear.ARDRegression, "linear_lars": lambda: linear.Lars(2), "linear_lasso_lars": lambda: linear.LassoLars(1e-3),
    "linear_lasso_lars_ic": linear.LassoLarsIC, "linear_omp": lambda: linear.OrthogonalMatchingPursuit(2), "linear_pls": lambda: linear.PLSRegression(2),
    "glm_huber": lambda: glm.HuberRegressor(max_iter=5), "glm_quantile": lambda: glm.QuantileRegressor(0.5, 8), "glm_poisson": lambda: glm.PoissonRegressor(max_iter=8),
    "glm_tweedie": lambda: glm.TweedieRegressor(1.5, max_iter=8), "glm_gamma": lambda: glm.GammaRegressor(max_iter=8),
}.items():
    _predict(_n, _m)
for _n, _m in {"linear_ridge_cv": linear.RidgeCrossValidated, "linear_lasso_cv": linear.LassoCrossValidated, "linear_elastic_net_cv": lambda: linear.ElasticNetCrossValidated(l1_ratios=(0.5, 0.9))}.items():
    _add(_n, lambda x, m=_m: m().fit(f := model_selection.k_fold(x, "id", 5), X, "y", "fold").transform(f).select("id", "prediction"))
_predict("glm_logistic", lambda: glm.LogisticRegressor(lam=1.0, max_iter=15), label="bin")
_predict("glm_binomial", lambda: glm.BinomialRegressor(8), ["c"], "bin")
_add("glm_isotonic", lambda x: glm.IsotonicRegressor().fit(x, "a", "y").transform(x).select("id", "prediction"))
_predict("discriminant_linear", discriminant.LinearDiscriminantAnalysis, label="k")
_predict("discriminant_quadratic", discriminant.QuadraticDiscriminantAnalysis, label="k")
_add("decomposition_pca", lambda x: linear.PCA(2).fit(x, X).transform(x).select("id", "pc_0", "pc_1"))
_add("decomposition_truncated_svd", lambda x: linear.TruncatedSVD(2).fit(x, X).transform(x).select("id", "pc_0", "pc_1"))
_add("decomposition_cca", lambda x: linear.CCA(1).fit(x, ["a", "b"], ["c", "y"]).transform_x(x).select("id", "cx_0"))
_add("decomposition_fast_ica", lambda x: iterative.FastICA(2).fit(x, SMALL).transform_vector(x, "decision", "z").select("id", F.get("z", F.lit(0)).alias("s_0"), F.get("z", F.lit(1)).alias("s_1")))


def _nmf(x):
    """Rows of W by id, and those of H by component (numbered from -1 down)."""
    got = iterative.NMF(2, max_iter=20).fit(x, X, "id")
    w = got.w.select("id", F.get("w", F.lit(0)).alias("f_0"), F.get("w", F.lit(1)).alias("f_1"), F.lit(None).cast("double").alias("f_2"))
    h = x.sparkSession.createDataFrame([(-1 - j, *map(float, row)) for j, row in enumerate(got.h)], "id long, f_0 double, f_1 double, f_2 double")
    return w.unionByName(h)


_add("decomposition_nmf", _nmf)
_add("ransac_inliers", lambda x: iterative.RansacRegressor(20, 0.3).fit(x, X, "y", "id").inliers(x, "y").select("id", "inlier"))
_predict("sgd_minibatch_classifier", lambda: iterative.SgdClassifier("log", epochs=5, eta0=0.5), label="k")
_predict("sgd_minibatch_regressor", lambda: iterative.SgdRegressor(epochs=5, eta0=0.1))
_predict("svm_linear_svc_passes", iterative.LinearSvc, label="bin")
_predict("svm_linear_svr_passes", iterative.LinearSvr)
_predict("tree_classifier", lambda: trees.DecisionTreeClassifier(max_depth=5, max_bins=64), label="k")
_predict("tree_regressor", lambda: trees.DecisionTreeRegressor(max_depth=5, max_bins=64))
_predict("forest_classifier", lambda: trees.RandomForestClassifier(n_trees=8, max_depth=4, max_bins=64), label="k", id_col="id")
_predict("forest_regressor", lambda: trees.RandomForestRegressor(n_trees=8, max_depth=4, max_bins=64), id_col="id")
_predict("extra_trees_classifier", lambda: trees.ExtraTreesClassifier(n_trees=8, max_depth=4, max_bins=64), label="k", id_col="id")
_predict("extra_trees_regressor", lambda: trees.ExtraTreesRegressor(n_trees=8, max_depth=4, max_bins=64), id_col="id")
_predict("bagging_classifier", lambda: trees.BaggingClassifier(n_trees=5, max_depth=4, max_bins=64), label="k", id_col="id")
_predict("bagging_regressor", lambda: trees.BaggingRegressor(n_trees=5, max_depth=4, max_bins=64), id_col="id")
_predict("adaboost_classifier", lambda: trees.AdaBoostClassifier(4, max_bins=64), label="k", id_col="id")
_predict("adaboost_regressor", lambda: trees.AdaBoostRegressor(3, max_bins=64), id_col="id")
_predict("boosting_regressor", lambda: trees.GradientBoostingRegressor(4, max_bins=64), id_col="id")
_predict("boosting_classifier", lambda: trees.GradientBoostingClassifier(3, max_bins=64), label="bin", id_col="id")
_predict("hist_boosting_regressor", lambda: trees.HistGradientBoostingRegressor(3, max_depth=4, max_bins=64), id_col="id")
_predict("hist_boosting_classifier", lambda: trees.HistGradientBoostingClassifier(3, max_depth=4, max_bins=64), label="bin", id_col="id")
_predict("leafwise_boosting_regressor", lambda: trees.LgbmRegressor(2, max_leaves=7, max_bins=64), id_col="id")
_predict("leafwise_boosting_classifier", lambda: trees.LgbmClassifier(2, max_leaves=7, max_bins=64), label="bin", id_col="id")
def _gaps(spark, d):
    """lineitem with a discount of nothing taken for unknown."""
    return _data(spark, d).select("id", F.when(F.col("b") > 0, F.col("b")).alias("b"), "y")


def _nations(spark, d):
    """Customers with their nation as a category."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("double").alias("nation"), (F.col("c_acctbal") / 1e4).cast("double").alias("y"))


_add("leafwise_boosting_missing", lambda x: trees.LgbmRegressor(1, rate=0.5, max_leaves=2).fit(x, ["b"], "y", "id").transform(x).select("id", "prediction"), _gaps)
_add("leafwise_boosting_categories", lambda x: trees.LgbmRegressor(1, rate=0.5, max_leaves=2, min_leaf=5, categorical=["nation"]).fit(x, ["nation"], "y", "id").transform(x).select("id", "prediction"), _nations)
_add("isolation_forest", lambda x: trees.IsolationForest(20, 128).fit(x, X, "id").transform(x).select("id", "prediction"))
_add("cluster_kmeans", lambda x: cluster.KMeans(4, 20).fit(x, X).transform(x).select("id", "prediction"))
_add("cluster_mini_batch_kmeans", lambda x: cluster.MiniBatchKMeans(4, 256, 20).fit(x, X).transform(x).select("id", "prediction"))
_add("cluster_gaussian_mixture", lambda x: cluster.GaussianMixture(2, max_iter=5).fit(x, X).transform(x).select("id", "prediction"))
_add("cluster_bayesian_mixture", lambda x: cluster.BayesianGaussianMixture(2, max_iter=5).fit(x, X).transform(x).select("id", "prediction"))
for _n, _c in {
    "dbscan": cluster.Dbscan(0.08, 4), "hdbscan": cluster.Hdbscan(5), "optics": cluster.Optics(4, eps=0.08), "birch": cluster.Birch(3, 0.1), "agglomerative": cluster.AgglomerativeClustering(3),
    "spectral": cluster.SpectralClustering(3, gamma=10.0), "mean_shift": cluster.MeanShift(0.3), "affinity_propagation": cluster.AffinityPropagation(),
}.items():
    _add(f"cluster_{_n}", lambda x, c=_c: c.fit_predict(x, "id", SMALL), _orders)
for _n, _c in {"mds": kernels.ClassicalMDS(), "isomap": kernels.Isomap(), "lle": kernels.LocallyLinearEmbedding(), "tsne": kernels.TSne(n_iter=60)}.items():
    _add(f"manifold_{_n}", lambda x, c=_c: c.fit_transform(x, "id", SMALL), _orders)
_rbf = lambda: kernels.Kernel("rbf", 2.0)
for _n, (_m, _y) in {
    "svm_svc": (lambda: kernels.Svc(1.0, _rbf()), "k"), "svm_svr": (lambda: kernels.Svr(1.0, 0.1, _rbf()), "y"), "svm_nu_svc": (lambda: kernels.NuSvc(0.5, _rbf()), "k"),
    "svm_nu_svr": (lambda: kernels.NuSvr(0.5, 1.0, _rbf()), "y"), "svm_linear_svc": (iterative.LinearSvc, "k"), "kernel_ridge": (lambda: kernels.KernelRidge(0.1, _rbf()), "y"),
    "gp_regressor": (lambda: kernels.GaussianProcessRegressor(_rbf(), 1e-4), "y"), "gp_classifier": (lambda: kernels.GaussianProcessClassifier(_rbf()), "k"),
    "mlp_classifier": (lambda: iterative.MlpClassifier([16], epochs=30), "k"), "mlp_regressor": (lambda: iterative.MlpRegressor([16], epochs=30), "y"),
}.items():
    _predict(_n, _m, SMALL, _y, _orders)
_add("svm_one_class", lambda x: kernels.OneClassSvm(0.2, _rbf()).fit(x, SMALL).transform(x).select("id", "prediction"), _orders)
_add("kernel_pca", lambda x: kernels.KernelPCA(2, _rbf()).fit(x, SMALL).transform_vector(x, "project", "z").select("id", F.col("z")[0].alias("z0"), F.col("z")[1].alias("z1")), _orders)
for _n, (_m, _y) in {
    "sgd_classifier": (iterative.SgdClassifier, "k"), "sgd_regressor": (iterative.SgdRegressor, "y"), "passive_aggressive_classifier": (iterative.PassiveAggressiveClassifier, "k"),
    "passive_aggressive_regressor": (iterative.PassiveAggressiveRegressor, "y"), "svm_linear_svr": (iterative.LinearSvr, "y"), "ransac_regressor": (iterative.RansacRegressor, "y"), "theil_sen_regressor": (iterative.TheilSenRegressor, "y"),
}.items():
    _predict(_n, _m, SMALL, _y, _orders, order="id")
_predict("voting_classifier", lambda: meta.VotingClassifier([discriminant.LinearDiscriminantAnalysis(), discriminant.QuadraticDiscriminantAnalysis()]), label="k")
_predict("voting_regressor", lambda: meta.VotingRegressor([linear.OlsRegressor(), linear.RidgeRegressor(10.0)], [1.0, 2.0]))
_add("stacking_regressor", lambda x: meta.StackingRegressor([linear.OlsRegressor(), linear.RidgeRegressor(100.0)], linear.RidgeRegressor()).fit(f := model_selection.k_fold(x, "id", 3), X, "y", "fold").transform(f).select("id", "prediction"))
_add("stacking_classifier", lambda x: meta.StackingClassifier([discriminant.LinearDiscriminantAnalysis(), discriminant.QuadraticDiscriminantAnalysis()], discriminant.LinearDiscriminantAnalysis(reg=1e-3)).fit(f := model_selection.stratified_k_fold(x, "id", "bin", 3), X, "bin", "fold").transform(f).select("id", "prediction"))
for _k in ("sigmoid", "isotonic"):
    _add(f"calibrated_{_k}", lambda x, k=_k: meta.CalibratedClassifierCV(linear.OlsRegressor(), k).fit(f := model_selection.k_fold(x, "id", 3), X, "bin", "fold").transform(f).select("id", "probability"))
_add("multi_output_regressor", lambda x: meta.MultiOutputRegressor(linear.RidgeRegressor()).fit(x, ["a", "b"], ["y", "c"]).transform(x).select("id", "prediction_y", "prediction_c"))
_add("regressor_chain", lambda x: meta.RegressorChain(linear.RidgeRegressor()).fit(x, ["a", "b"], ["c", "y"]).transform(x).select("id", "prediction_y", "prediction_c"))
_add("transformed_target", lambda x: meta.TransformedTargetRegressor(linear.OlsRegressor(), F.log1p, F.expm1).fit(x, X, "y").transform(x).select("id", "prediction"))
_r2 = lambda f: metrics.r2_score(f, "y", "prediction").first()[0]


def _run(lam):
    return lambda train, test: linear.RidgeRegressor(lam).fit(train, X, "y").transform(test)


def _frame(x, rows, schema):
    return x.sparkSession.createDataFrame(rows, schema)


_add("search_cross_val_score", lambda x: _frame(x, [(k, s) for k, s in enumerate(model_selection.cross_val_score(model_selection.cv_fold(x, "id", 3), "fold", _run(1.0), _r2))], "fold int, score double"))
_add("search_cross_val_predict", lambda x: model_selection.cross_val_predict(model_selection.cv_fold(x, "id", 3), "fold", _run(1.0)).select("id", "prediction"))


def _search(x):
    grid = model_selection.grid({"lam": [0.1, 10.0, 1000.0]})
    _, _, means = model_selection.grid_search_cv(model_selection.k_fold(x, "id", 3), "fold", grid, lambda c: _run(c["lam"]), _r2)
    return _frame(x, [(float(c["lam"]), s) for c, s in zip(grid, means, strict=True)], "lam double, score double")


_add("search_grid", _search)
_add("search_permutation_importance", lambda x: _frame(x, model_selection.permutation_importance(x, "id", X, (m := linear.OlsRegressor().fit(x, X, "y")).transform, _r2, 1), "feature string, drop double, std double"))
_add("pipeline_scale_ridge", lambda x: plans.Pipeline().push_transformer("scale", preprocessing.StandardScaler()).set_estimator(linear.RidgeRegressor()).fit(x, X, "y").predict(x).select("id", "prediction"))
_add("column_transformer", lambda x: plans.ColumnTransformer([("std", preprocessing.StandardScaler(), ["a", "b"]), ("mm", preprocessing.MinMaxScaler(), ["b"])], "passthrough").fit(x, X).transform(x, ["id"]))


def _weights(df, features):
    return linear.RidgeRegressor(1.0).fit(df, features, "y").coef.tolist()


def _fit_score(df, features):
    return metrics.r2_score(linear.RidgeRegressor(1.0).fit(df, features, "y").transform(df), "y", "prediction").first()[0]


def _kept(x, s):
    return _frame(x, [(c, float(v), c in s.features) for c, v in zip(s.candidates, s.scores, strict=True)], "feature string, score double, kept boolean")


_add("select_rfe", lambda x: _kept(x, selection.RFE(1).fit(x, X, _weights)))
_add("select_rfecv", lambda x: _kept(x, selection.RFECV().fit(model_selection.k_fold(x, "id", 3), X, _weights, _fit_score, "fold")))
_add("select_sequential", lambda x: _kept(x, selection.SequentialFeatureSelector(2).fit(x, X, _fit_score)))
_add("select_from_model", lambda x: _kept(x, selection.SelectFromModel(0.1, 2).fit(X, trees.DecisionTreeRegressor(max_depth=3, max_bins=32).fit(x, X, "y").importances())))
_add("search_halving", lambda x: _frame(x, [(float(c["lam"]), s) for c, s in zip(_GRID, model_selection.halving_grid_search_cv(x, "id", _GRID, lambda c: _run(c["lam"]), _r2, 3, 2000)[1], strict=True)], "lam double, score double"))
_add("search_learning_curve", lambda x: _frame(x, model_selection.learning_curve(x, "id", [0.3, 1.0], _run(1.0), _r2, 2), "share double, train double, test double"))
_add("search_validation_curve", lambda x: _frame(x, model_selection.validation_curve(x, "id", [0.1, 100.0], _run, _r2, 2), "lam double, train double, test double"))
