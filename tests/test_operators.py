"""Operators on small tables: known values, errors, round trips, and independence of partitioning."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstat import core
from quillstat.functions import numeric, strings
from quillstat.operators import bayes, cluster, discriminant, glm, iterative, kernels, linear, meta, metrics, model_selection, preprocessing, trees
from quillstat.plans import pipeline
from quillstat.sources import csv
from quillstat.streaming import incremental


@pytest.fixture(scope="module")
def line(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ [2.0, -1.0, 0.5] + 3
    return spark.createDataFrame([(i, *map(float, r), float(v), float(v > 3)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, y double, k double")


X = ["a", "b", "c"]


def score(model, df, y="y"):
    return metrics.r2_score(model.transform(df), y, "prediction").first()[0]


@pytest.mark.parametrize("make", [linear.OlsRegressor, lambda: linear.RidgeRegressor(1e-6), lambda: linear.LassoRegressor(1e-6), linear.BayesianRidge, linear.ARDRegression, linear.Lars, lambda: linear.LassoLars(1e-6), linear.LassoLarsIC, lambda: linear.OrthogonalMatchingPursuit(3), lambda: linear.PLSRegression(3), glm.HuberRegressor, glm.QuantileRegressor])
def test_linear_models_recover_the_line(line, make):
    m = make().fit(line, X, "y")
    assert np.allclose(m.coef, [2, -1, 0.5], atol=0.02) and abs(m.intercept - 3) < 0.02


def test_normal_equations_hold_under_repartitioning(line):
    a, b = (linear.RidgeRegressor(2.0).fit(d, X, "y").coef for d in (line.repartition(1), line.repartition(7)))
    assert np.allclose(a, b)


@pytest.mark.parametrize("make", [lambda: trees.DecisionTreeRegressor(max_depth=6), lambda: trees.RandomForestRegressor(n_trees=10, max_depth=6), lambda: trees.ExtraTreesRegressor(n_trees=10, max_depth=8), lambda: trees.GradientBoostingRegressor(8, rate=0.4), lambda: trees.HistGradientBoostingRegressor(6, rate=0.4, min_leaf=5), lambda: trees.LgbmRegressor(3, rate=0.7, max_leaves=7, min_leaf=5), lambda: trees.AdaBoostRegressor(5)])
def test_tree_regressors_fit(line, make):
    assert score(make().fit(line, X, "y", "id"), line) > 0.7


@pytest.mark.parametrize("make", [lambda: trees.DecisionTreeClassifier(max_depth=6), lambda: trees.DecisionTreeClassifier(criterion="entropy", max_depth=6), lambda: trees.RandomForestClassifier(n_trees=10, max_depth=6), lambda: trees.ExtraTreesClassifier(n_trees=10, max_depth=8), lambda: trees.GradientBoostingClassifier(5, rate=0.4), lambda: trees.LgbmClassifier(2, rate=0.7, max_leaves=6, min_leaf=5), lambda: trees.AdaBoostClassifier(5), lambda: trees.BaggingClassifier(max_depth=5)])
def test_tree_classifiers_fit(line, make):
    m = make().fit(line, X, "k") if isinstance(make(), trees._TreeEnsemble) else make().fit(line, X, "k", "id")
    assert metrics.accuracy_score(m.transform(line), "k", "prediction").first()[0] > 0.85


def test_boosting_keeps_directions(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-2, 2, size=(300, 2))
    y = x[:, 0] + 3 * np.sin(3 * x[:, 0]) - x[:, 1] ** 2 / 4
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, y double")
    grid = np.linspace(-2, 2, 101)
    steps = {}
    for way in (0, 1, -1):
        m = trees.HistGradientBoostingRegressor(2, rate=0.5, max_depth=3, min_leaf=5, monotone=[way, 0]).fit(df, ["a", "b"], "y", "id")
        steps[way] = np.concatenate([np.diff(m.raw(np.column_stack([grid, np.full(101, b)]))[:, 0]) for b in (-1.5, 0.0, 1.2)])
    assert steps[1].min() >= -1e-12 and steps[-1].max() <= 1e-12 and steps[0].min() < 0 < steps[0].max()
    with pytest.raises(core.InvalidParameter):
        trees.LgbmRegressor(monotone=[1]).fit(df, ["a", "b"], "y", "id")


def test_one_sided_sampling(line):
    make = lambda goss: trees.HistGradientBoostingRegressor(3, rate=0.7, max_depth=3, min_leaf=5, goss=goss)
    assert score(make((0.3, 0.3)).fit(line, X, "y", "id"), line) > 0.7
    a, b = (make((0.3, 0.3)).fit(d, X, "y", "id").raw(np.zeros((1, 3))) for d in (line.repartition(1), line.repartition(5)))
    assert np.allclose(a, b)
    whole, plain = (make(g).fit(line, X, "y", "id").raw(np.ones((1, 3))) for g in ((0.5, 0.5), None))
    assert np.allclose(whole, plain, rtol=0.2)  # the hash takes all of the rest where the shares add up to 1
    with pytest.raises(core.InvalidParameter):
        make((0.9, 0.3)).fit(line, X, "y", "id")


@pytest.mark.parametrize("make", [discriminant.LinearDiscriminantAnalysis, discriminant.QuadraticDiscriminantAnalysis, lambda: glm.LogisticRegressor(lam=0.1), iterative.LinearSvc, lambda: kernels.Svc(10.0, kernels.Kernel("linear")), lambda: kernels.GaussianProcessClassifier(kernels.Kernel("rbf", 0.5)), lambda: iterative.MlpClassifier([16], rate=1e-2, epochs=60), bayes.GaussianNB])
def test_classifiers_separate_a_plane(line, make):
    assert metrics.accuracy_score(make().fit(line, X, "k").transform(line), "k", "prediction").first()[0] > 0.9


def test_sequential_learners(line):
    for m in (iterative.SgdRegressor(penalty="none", epochs=50), iterative.RansacRegressor(20, 0.1), iterative.TheilSenRegressor(50)):
        assert score(m.fit(line, X, "y", "id"), line) > 0.95
    assert metrics.accuracy_score(iterative.SgdClassifier().fit(line, X, "k", "id").transform(line), "k", "prediction").first()[0] > 0.85


def test_blobs_are_found(spark):
    rng = np.random.default_rng(1)
    z = np.concatenate([rng.normal(c, 0.2, (30, 2)) for c in ((0, 0), (4, 4), (0, 5))])
    df = spark.createDataFrame([(i, float(a), float(b), i // 30) for i, (a, b) in enumerate(z)], "id long, a double, b double, t int")
    for found in (
        cluster.KMeans(3).fit(df, ["a", "b"]).transform(df).withColumnRenamed("prediction", "cluster"), cluster.GaussianMixture(3).fit(df, ["a", "b"]).transform(df).withColumnRenamed("prediction", "cluster"),
        *(c.fit_predict(df, "id", ["a", "b"]).join(df, "id") for c in (cluster.Dbscan(1.0, 4), cluster.Hdbscan(5), cluster.Optics(4, eps=1.0), cluster.AgglomerativeClustering(3), cluster.MeanShift(1.5), cluster.SpectralClustering(3), cluster.Birch(3, 0.5))),
    ):
        assert metrics.adjusted_rand_score(found, "t", "cluster").first()[0] > 0.95


def test_errors_have_their_kinds(spark, line):
    with pytest.raises(core.ShapeMismatch):
        preprocessing.StandardScaler().fit(line, ["nope"])
    with pytest.raises(core.EmptyInput):
        preprocessing.StandardScaler().fit(line.filter("id < 0"), X)
    with pytest.raises(core.InvalidParameter):
        preprocessing.MinMaxScaler(1.0, 0.0).fit(line, X)
    with pytest.raises(core.NotFitted):
        preprocessing.LabelEncoder().classes  # noqa: B018
    with pytest.raises(core.SerializationError):
        core.Model.from_json('{"class": "os:path", "state": {"class": "os:path", "fields": {}}}')


def test_models_survive_saving(tmp_path, line):
    for m in (preprocessing.StandardScaler().fit(line, X), linear.PCA(2).fit(line, X), trees.DecisionTreeRegressor(max_depth=3).fit(line, X, "y"), bayes.GaussianNB().fit(line, X, "k")):
        for binary in (False, True):
            m.save(str(tmp_path / "m"), binary)
            back = core.Model.load(str(tmp_path / "m"))
            assert sorted(map(str, back.transform(line).collect())) == sorted(map(str, m.transform(line).collect()))


def test_scalers_keep_constant_columns_finite(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in preprocessing.StandardScaler().fit(df, ["a", "b"]).transform(df).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    assert [tuple(r) for r in preprocessing.MinMaxScaler().fit(df, ["a", "b"]).transform(df).orderBy("a").collect()] == [(0.0, 0.0), (1.0, 0.0)]


def test_splits_have_exact_sizes(spark):
    df = spark.range(103)
    assert sorted(r["count"] for r in model_selection.k_fold(df, "id", 5).groupBy("fold").count().collect()) == [20, 20, 21, 21, 21]
    assert model_selection.train_test_split(df, "id", 0.25).filter("is_test").count() == 26
    a, b = (sorted(r["id"] for r in model_selection.train_test_split(d, "id", 0.3, 5).filter("is_test").collect()) for d in (df, df.repartition(9)))
    assert a == b


def test_tokens_and_hash(spark):
    df = spark.createDataFrame([("Don't stopİng 9x abc",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(strings.tokenize(F.col("t"))).collect()] == [["don", "stop", "ng", "abc"], None, []]

    def fnv(s):
        h = strings.FNV_OFFSET
        for c in s.encode():
            h = ((h ^ c) * strings.FNV_PRIME) % 2**64
        return h

    words = ["a", "hello", "zz", "longerword"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(strings.fnv1a_64(F.col("w"))).collect()
    assert [int(r[0]) for r in got] == [fnv(w) for w in words]


def test_normal_quantile(spark):
    got = spark.createDataFrame([(0.5,), (0.975,), (0.001,)], "p double").select(numeric.normal_quantile(F.col("p"))).collect()
    assert np.allclose([r[0] for r in got], [0.0, 1.959964, -3.090232], atol=1e-5)


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x, y\n 1, 2\n3 ,4\n")
    df, features, target = csv.read_csv_with_header(spark, str(tmp_path / "a.csv"), "y")
    assert features == ["x"] and target == "y" and sorted(map(tuple, df.collect())) == [(1.0, 2.0), (3.0, 4.0)]
    (tmp_path / "b.csv").write_text("x,y\n1,oops\n")
    with pytest.raises(Exception):  # noqa: B017
        csv.read_csv(spark, str(tmp_path / "b.csv"))[0].collect()


def test_pipeline_and_columns(line):
    p = pipeline.Pipeline().push_transformer("s", preprocessing.StandardScaler()).push_transformer("b", preprocessing.Binarizer(10.0)).fit(line, X)
    assert p.transform(line).agg(F.sum("a")).first()[0] == 0
    t = pipeline.ColumnTransformer([("s", preprocessing.StandardScaler(), ["a"]), ("m", preprocessing.MinMaxScaler(), ["a", "b"])], "passthrough").fit(line, X)
    assert t.transform(line).columns == ["s__a", "m__a", "m__b", "c"]


def test_meta(line):
    f = model_selection.k_fold(line, "id", 3)
    assert score(meta.StackingRegressor([linear.OlsRegressor(), linear.RidgeRegressor(5.0)], linear.RidgeRegressor(0.1)).fit(f, X, "y", "fold"), f) > 0.99
    assert score(meta.VotingRegressor([linear.OlsRegressor(), linear.RidgeRegressor()]).fit(line, X, "y"), line) > 0.99
    out = meta.RegressorChain(linear.OlsRegressor()).fit(line, ["a", "b"], ["c", "y"]).transform(line)
    assert {"prediction_c", "prediction_y"} <= set(out.columns)


def test_stream_learns_what_a_batch_learns(spark, line, tmp_path):
    line.select(*X, "k").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a double, b double, c double, k double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    nb = incremental.StreamingGaussianNB(X, "k")
    nb.writer(stream).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    whole = bayes.GaussianNB().fit(line, X, "k")
    assert nb.state.count.sum() == 200 and np.allclose(nb.state.mean, whole.mean) and np.allclose(nb.state.var, whole.var)


def test_gaussian_process_interpolates(spark):
    df = spark.createDataFrame([(i / 3, math.sin(i / 3)) for i in range(20)], "x double, y double")
    m = kernels.GaussianProcessRegressor(kernels.Kernel("rbf", 0.5), 1e-8).fit(df, ["x"], "y")
    assert abs(m.predict_array(np.array([[1.5]]))[0] - math.sin(1.5)) < 1e-3
    assert kernels.optimize_rbf_length(m.x, np.sin(m.x[:, 0]), alpha=1e-6) > 0.1


def test_sums_of_products_on_awkward_rows(spark, line):
    few = spark.createDataFrame([(float(i), 0.5 * i + 1, 1.0) for i in range(3)], "a double, y double, w double")
    m = linear.OlsRegressor().fit(few.repartition(50), ["a"], "y")
    assert np.allclose([m.coef[0], m.intercept], [0.5, 1.0])
    with pytest.raises(core.EmptyInput):
        linear.OlsRegressor().fit(few.filter("a > 9"), ["a"], "y")
    gaps = spark.createDataFrame([(float("nan"), 7.0, 50.0), (1.0, 1.5, 1.0), (2.0, 2.0, 2.0), (None, 3.0, 9.0), (4.0, 3.0, 3.0), (5.0, None, 80.0)], "a double, y double, w double")
    m = linear.WlsRegressor("w").fit(gaps.repartition(1), ["a"], "y")
    assert np.allclose([m.coef[0], m.intercept], [0.5, 1.0])
    with pytest.raises(core.InvalidParameter):
        linear.WlsRegressor("w").fit(few.withColumn("w", F.lit(float("nan"))), ["a"], "y")
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 2))
    far = spark.createDataFrame([(1e9 + float(a), 1e9 + float(b), float(2 * a - b)) for a, b in x], "a double, b double, y double").repartition(5)
    m = linear.OlsRegressor().fit(far, ["a", "b"], "y")
    assert np.allclose(m.coef, [2, -1], atol=1e-4) and np.allclose(linear.PCA(2).fit(far, ["a", "b"]).values, sorted(np.linalg.eigvalsh(np.cov(x.T)))[::-1], rtol=1e-4)
    g = linear.grams(line.withColumn("f", F.col("id") % 3), ["a", "b"], "y", by="f")
    whole, rest = linear.gram(line, ["a", "b"], "y"), linear.gram(line.filter("id % 3 <> 1"), ["a", "b"], "y")
    left = whole - g["1"]
    assert np.allclose(left.means, rest.means) and np.allclose(left.moments, rest.moments) and left.n == rest.n


def test_weighted_trees_equal_trees_on_repeated_rows(spark, line):
    weighted = line.withColumn("w", (F.col("id") % 4).cast("double"))
    repeated = weighted.withColumn("again", F.explode(F.sequence(F.lit(1), F.greatest(F.col("w").cast("int"), F.lit(1))))).filter("w > 0")
    for make, y in ((lambda: trees.DecisionTreeClassifier(max_depth=4), "k"), (lambda: trees.DecisionTreeRegressor(max_depth=4, min_leaf=5), "y"), (lambda: trees.HistGradientBoostingRegressor(2, max_depth=3, min_leaf=5), "y")):
        a, b = make().fit(weighted, X, y, "id", weight="w"), make().fit(repeated, X, y, "id")
        assert np.allclose(a.predict_array(np.zeros((1, 3))), b.predict_array(np.zeros((1, 3))))
        x = np.random.default_rng(2).normal(size=(50, 3))
        assert np.allclose(a.predict_array(x), b.predict_array(x))


def test_trees_see_their_share_of_rows(line):
    many = line.sparkSession.range(20_000).select("id", F.lit(1.0).alias("a"), F.lit(2.0).alias("y"))
    for make, mean in ((lambda: trees.BaggingRegressor(4, max_depth=1, max_samples=0.3), 6000), (lambda: trees.BaggingRegressor(4, max_depth=1, max_samples=0.3, bootstrap=False), 6000), (lambda: trees.RandomForestRegressor(4, max_depth=1), 20_000)):
        m = make().fit(many, ["a"], "y", "id")
        assert all(abs(t.value[0][0] - mean) < 600 for t in m.trees) and len({t.value[0][0] for t in m.trees}) > 1
    with pytest.raises(core.InvalidParameter):
        trees.BaggingRegressor(max_samples=1.5).fit(line, X, "y")


def test_trees_do_not_depend_on_partitions(line):
    for make in (lambda: trees.RandomForestRegressor(5, max_depth=4, seed=3), lambda: trees.ExtraTreesRegressor(5, max_depth=4, seed=3), lambda: trees.AdaBoostRegressor(10)):
        x = np.random.default_rng(4).normal(size=(80, 3))
        a, b = (make().fit(d, X, "y", "id").predict_array(x) for d in (line.repartition(1), line.repartition(7)))
        assert np.allclose(a, b)


def test_a_restarted_stream_goes_on(spark, line, tmp_path):
    line.select(*X, "k").repartition(2).write.parquet(str(tmp_path / "in"))
    path = f"file://{tmp_path}/state.json"

    def run():
        stream = spark.readStream.schema("a double, b double, c double, k double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        nb = incremental.StreamingGaussianNB(X, "k", path=path)
        nb.writer(stream).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return nb

    assert run().state.count.sum() == 200
    line.select(*X, "k").limit(50).write.mode("append").parquet(str(tmp_path / "in"))
    again = run()
    assert again.state.count.sum() == 250 and again.last >= 2


def test_models_in_a_store_and_limits(spark, line, tmp_path):
    m = linear.OlsRegressor().fit(line, X, "y")
    m.save(f"file://{tmp_path}/model", binary=True)
    assert np.allclose(core.Model.load(f"file://{tmp_path}/model").coef, m.coef)
    with pytest.raises(core.DataIOError):
        core.Model.load(f"file://{tmp_path}/none")
    with pytest.raises(core.InvalidParameter):
        model_selection.halving_grid_search_cv(line, "id", [{}], None, None, factor=1)
    words = spark.createDataFrame([(w,) for w in "dcba"], "w string")
    e = preprocessing.LabelEncoder(most=3)
    e.fit(words, "w")
    with pytest.raises(core.InvalidParameter):
        e.classes  # noqa: B018
    e.most = 4
    assert e.classes == list("abcd")


def test_quantile_places(spark):
    x = [float(v) for v in (1, 2, 2, 2, 3, 10)]
    df = spark.createDataFrame([(v,) for v in [*x, 0.0, 99.0, 2.5, None]], "a double")
    m = preprocessing.QuantileTransformer(6).fit(spark.createDataFrame([(v,) for v in x], "a double"), ["a"])
    got = [r["a"] for r in m.transform(df.coalesce(1)).collect()]
    assert got[-1] is None and np.allclose(got[:-1], [0, 0.4, 0.4, 0.4, 0.8, 1, 0, 1, 0.7])
