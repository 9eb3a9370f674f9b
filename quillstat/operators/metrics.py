"""Evaluation metrics as aggregates: each function returns a lazy DataFrame (one row with ``score``, or curve rows)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import EmptyInput, InvalidParameter, require, vector, written
from .quantiles import exact_quantiles
from .ranks import before, in_ranges

EPS = 1e-15
#: Points of a block that meets all others in a silhouette.
SILHOUETTE_ROWS = 1 << 12


def _ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / F.when(b == 0, F.lit(None)).otherwise(b))


def _checked(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise EmptyInput("no rows")
    return df


def accuracy_score(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("score"))


def _pairs(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("t"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, y: str, p: str) -> DataFrame:
    """(y_true, y_pred, n) for all pairs of labels of either column, zeros included."""
    n = _pairs(df, y, p)
    labels = n.select(F.col("t").alias("l")).union(n.select("p")).distinct()
    spine = labels.select(F.col("l").alias("y_true")).crossJoin(labels.select(F.col("l").alias("y_pred")))
    joined = spine.join(n, (F.col("y_true") == F.col("t")) & (F.col("y_pred") == F.col("p")), "left")
    return joined.select("y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """(label, precision, recall, f1, support) by class; 0 where a denominator is 0."""
    n = _pairs(df, y, p)
    sides = n.select(F.col("t").alias("label"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("pos"), F.lit(0).alias("pred")).union(
        n.select("p", F.lit(0), F.lit(0), "n")
    )
    s = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("pos").alias("support"), F.sum("pred").alias("pred"))
    s = s.withColumn("precision", _ratio(F.col("tp"), F.col("pred"))).withColumn("recall", _ratio(F.col("tp"), F.col("support")))
    s = s.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return s.select("label", "precision", "recall", "f1", "support", "tp", "pred")


def averaged(df: DataFrame, y: str, p: str, metric: str, average: str = "macro") -> DataFrame:
    """precision, recall or f1 over classes: ``macro``, ``micro`` or ``weighted`` by true support."""
    if metric not in ("precision", "recall", "f1") or average not in ("macro", "micro", "weighted"):
        raise InvalidParameter(f"{metric}, {average}")
    r = class_report(df, y, p)
    if average == "macro":
        return r.agg(F.avg(metric).alias("score"))
    if average == "weighted":
        return r.agg(_ratio(F.sum(F.col(metric) * F.col("support")), F.sum("support")).alias("score"))
    tp, pred, pos = F.sum("tp"), F.sum("pred"), F.sum("support")
    prec, rec = _ratio(tp, pred), _ratio(tp, pos)
    return r.agg({"precision": prec, "recall": rec, "f1": _ratio(2 * prec * rec, prec + rec)}[metric].alias("score"))


def precision_score(df, y, p, average="macro"):
    return averaged(df, y, p, "precision", average)


def recall_score(df, y, p, average="macro"):
    return averaged(df, y, p, "recall", average)


def f1_score(df, y, p, average="macro"):
    return averaged(df, y, p, "f1", average)


def _ladder(df: DataFrame, y: str, s: str) -> DataFrame:
    """Rows of distinct scores, highest first, with running true and false positives and totals.

    Scores are summed before they are ordered. The running sums are taken within ranges of scores and over the
    ranges' totals, so that no task has to hold all distinct scores.
    """
    by = df.groupBy(F.col(s).cast("double").alias("threshold")).agg(
        F.sum((F.col(y) == 1).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    pieces = in_ranges(by.filter("threshold IS NOT NULL"), [F.desc("threshold")])
    inner = Window.partitionBy("__piece").orderBy("__spot").rowsBetween(Window.unboundedPreceding, 0)
    out = before(pieces.withColumns({"ip": F.sum("pos").over(inner), "in_": F.sum("n").over(inner)}), bp=F.sum("pos"), bn=F.sum("n"))
    tp = F.col("bp") + F.col("ip")
    return out.select("threshold", "pos", "n", tp.alias("tp"), (F.col("bn") + F.col("in_") - tp).alias("fp"), F.col("bp_all").alias("all_pos"), (F.col("bn_all") - F.col("bp_all")).alias("all_neg"))


def roc_auc_score(df: DataFrame, y: str, s: str) -> DataFrame:
    """Area under the ROC curve, ties grouped; one class only is an error to the caller (null)."""
    r = _ladder(df, y, s)
    area = (F.col("n") - F.col("pos")) * (F.col("tp") - F.col("pos") / 2.0)
    return r.agg((F.sum(area) / F.max(F.when(F.col("all_pos") * F.col("all_neg") > 0, F.col("all_pos") * F.col("all_neg")))).alias("score"))


def average_precision_score(df: DataFrame, y: str, s: str) -> DataFrame:
    r = _ladder(df, y, s)
    return r.agg(F.sum(F.col("pos") / F.nullif(F.col("all_pos"), F.lit(0)) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("score"))


def roc_curve(df: DataFrame, y: str, s: str) -> DataFrame:
    """(threshold, fpr, tpr), with the sentinel (max + 1, 0, 0)."""
    r = _ladder(df, y, s)
    rows = r.select("threshold", _ratio(F.col("fp"), F.col("all_neg")).alias("fpr"), _ratio(F.col("tp"), F.col("all_pos")).alias("tpr"))
    first = r.agg((F.max("threshold") + 1).alias("threshold")).select("threshold", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return rows.unionByName(first)


def precision_recall_curve(df: DataFrame, y: str, s: str) -> DataFrame:
    """(threshold, precision, recall), aligned, with the sentinel (null, 1, 0)."""
    r = _ladder(df, y, s)
    rows = r.select("threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), _ratio(F.col("tp"), F.col("all_pos")).alias("recall"))
    last = r.agg(F.lit(None).cast("double").alias("threshold")).select("threshold", F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return rows.unionByName(last)


def matthews_corrcoef(df: DataFrame, y: str, p: str) -> DataFrame:
    t, q = F.col(y) == 1, F.col(p) == 1
    count = lambda c: F.sum(c.cast("double"))
    r = df.agg(count(t & q).alias("tp"), count(~t & ~q).alias("tn"), count(~t & q).alias("fp"), count(t & ~q).alias("fn"))
    below = F.sqrt(F.expr("(tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)"))
    return r.select(_ratio(F.expr("tp * tn - fp * fn"), below).alias("score"))


def log_loss(df: DataFrame, y: str, prob: str) -> DataFrame:
    p = F.greatest(F.least(F.col(prob), F.lit(1 - EPS)), F.lit(EPS))
    return df.agg(F.avg(F.when(F.col(y) == 1, -F.ln(p)).otherwise(-F.ln(1 - p))).alias("score"))


def brier_score_loss(df: DataFrame, y: str, prob: str) -> DataFrame:
    return df.agg(F.avg((F.col(y) - F.col(prob)) * (F.col(y) - F.col(prob))).alias("score"))


def balanced_accuracy_score(df: DataFrame, y: str, p: str) -> DataFrame:
    by = df.groupBy(y).agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("recall"))
    return by.agg(F.avg("recall").alias("score"))


def cohen_kappa_score(df: DataFrame, y: str, p: str) -> DataFrame:
    r = class_report(df, y, p).agg(F.sum("tp").alias("a"), F.sum(F.col("support").cast("double") * F.col("pred")).alias("e"), F.sum("support").alias("n"))
    po, pe = F.col("a") / F.col("n"), F.col("e") / F.col("n") / F.col("n")
    return r.select(F.when(1 - pe < EPS, F.lit(1.0)).otherwise((po - pe) / F.when(1 - pe < EPS, F.lit(None)).otherwise(1 - pe)).alias("score"))


def mse(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.avg((F.col(y) - F.col(p)) * (F.col(y) - F.col(p))).alias("score"))


def mae(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.avg(F.abs(F.col(y) - F.col(p))).alias("score"))


def r2_score(df: DataFrame, y: str, p: str) -> DataFrame:
    rest = F.avg((F.col(y) - F.col(p)) * (F.col(y) - F.col(p)))
    return df.agg(rest.alias("r"), F.var_pop(y).alias("v")).select(F.when(F.col("v") == 0, F.lit(0.0)).otherwise(1 - F.col("r") / F.nullif(F.col("v"), F.lit(0.0))).alias("score"))


def mean_absolute_percentage_error(df: DataFrame, y: str, p: str) -> DataFrame:
    if not df.filter(F.abs(F.col(y)) < EPS).isEmpty():
        raise InvalidParameter("a true value is zero")
    return df.agg(F.avg(F.abs((F.col(y) - F.col(p)) / F.col(y))).alias("score"))


def explained_variance_score(df: DataFrame, y: str, p: str) -> DataFrame:
    r = df.agg(F.var_pop(F.col(y) - F.col(p)).alias("r"), F.var_pop(y).alias("v"))
    return r.select(F.when(F.col("v") == 0, F.lit(0.0)).otherwise(1 - F.col("r") / F.nullif(F.col("v"), F.lit(0.0))).alias("score"))


def max_error(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.max(F.abs(F.col(y) - F.col(p))).alias("score"))


def median_absolute_error(df: DataFrame, y: str, p: str) -> DataFrame:
    """Runs at once: the median takes a few passes."""
    middle = exact_quantiles(df, [F.abs(F.col(y) - F.col(p))], [0.5])[0]
    return df.sparkSession.createDataFrame([(middle and middle[0],)], "score double")


def mean_squared_log_error(df: DataFrame, y: str, p: str) -> DataFrame:
    if not df.filter((F.col(y) < 0) | (F.col(p) < 0)).isEmpty():
        raise InvalidParameter("negative values")
    d = F.log1p(F.col(y)) - F.log1p(F.col(p))
    return df.agg(F.avg(d * d).alias("score"))


def adjusted_rand_score(df: DataFrame, a: str, b: str) -> DataFrame:
    """1 for fewer than two rows; 1 or 0 where the denominator vanishes (both trivial or not)."""
    n = _pairs(df, a, b)
    two = lambda c: F.sum(F.expr(f"{c} * ({c} - 1) / 2.0"))
    joint = n.agg(two("n").alias("ij"), F.sum("n").alias("n"))
    rows = n.groupBy("t").agg(F.sum("n").alias("s")).agg(two("s").alias("i"))
    cols = n.groupBy("p").agg(F.sum("n").alias("s")).agg(two("s").alias("j"))
    r = joint.crossJoin(rows).crossJoin(cols)
    total = F.expr("n * (n - 1) / 2.0")
    expected, most = F.col("i") * F.col("j") / F.nullif(total, F.lit(0.0)), (F.col("i") + F.col("j")) / 2
    below = most - expected
    return r.select(F.when(F.col("n") < 2, 1.0).when(F.abs(below) < EPS, F.when(F.abs(F.col("ij") - expected) < EPS, 1.0).otherwise(0.0)).otherwise((F.col("ij") - expected) / F.nullif(below, F.lit(0.0))).alias("score"))


def normalized_mutual_info_score(df: DataFrame, a: str, b: str) -> DataFrame:
    """2 MI / (H + H), natural logs, clamped to 0..1; one cluster on both sides is 1, on one side 0."""
    n = _pairs(df, a, b)
    total = n.agg(F.sum("n").cast("double").alias("total"))
    r, c = n.groupBy("t").agg(F.sum("n").alias("r")), n.groupBy("p").agg(F.sum("n").alias("c"))
    mi = n.join(r, "t").join(c, "p").crossJoin(total).agg(F.sum(F.expr("n / total * ln(n * total / (CAST(r AS DOUBLE) * c))")).alias("mi"))
    h = lambda d, x: d.crossJoin(total).agg(F.sum(F.expr(f"-({x} / total) * ln({x} / total)")).alias(f"h{x}"), F.count(F.lit(1)).alias(f"k{x}"))
    x = mi.crossJoin(h(r, "r")).crossJoin(h(c, "c"))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * F.col("mi") / F.nullif(F.col("hr") + F.col("hc"), F.lit(0.0))))
    one = F.when((F.col("kr") == 1) & (F.col("kc") == 1), 1.0).when((F.col("kr") == 1) | (F.col("kc") == 1), 0.0)
    return x.select(one.otherwise(value).alias("score"))


def silhouette_score(df: DataFrame, features: list[str], cluster: str, id_col: str, singleton: float = 1.0) -> DataFrame:
    """Mean silhouette with Euclidean distances over all pairs, for any number of rows.

    A row alone in its cluster has a = 0, so its value is ``singleton`` (1, or 0 by the other convention). Equal points count once, with how
    many rows each cluster has there; points meet in blocks, each pair of blocks sums distances by cluster, so no pair is written out. Rows
    with a missing number or cluster are left out.
    """
    require(df, features)
    d = len(features)
    rows = df.select(vector(features).alias("x"), F.col(cluster).alias("c")).filter(~F.exists("x", lambda v: v.isNull() | F.isnan(v)) & F.col("c").isNotNull())
    points = rows.groupBy("x", "c").agg(F.count(F.lit(1)).cast("double").alias("w"))
    points = written(points.withColumn("h", F.xxhash64("x", "c")), "silhouette")
    n = points.count()
    if not n:
        raise EmptyInput("no rows")
    blocks = -(-n // SILHOUETTE_ROWS)
    packed = points.groupBy(F.pmod("h", F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("c", "x", "w"))).alias("rows"))
    packed = written(packed, "blocks")
    kind = points.schema["c"].dataType.simpleString()

    def load(rows):
        x = rows.field("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
        c = rows.field("c")
        start = np.flatnonzero(np.concatenate([[True], pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)]))
        return x, c, rows.field("w").to_numpy(), start

    def meet(batches):
        for b in batches:
            for r in range(b.num_rows):
                x, c, w, _ = load(b.column("rows").slice(r, 1).flatten())
                z, e, v, start = load(b.column("others").slice(r, 1).flatten())
                step, sums = max(1, (1 << 20) // len(z)), []
                for a in range(0, len(x), step):
                    gap = np.zeros((len(x[a : a + step]), len(z)))
                    for k in range(d):
                        g = x[a : a + step, k, None] - z[None, :, k]
                        gap += np.multiply(g, g, out=g)
                    sums.append(np.add.reduceat(np.sqrt(gap, out=gap) * v, start, axis=1))
                n, m = len(x), len(start)
                at, of = np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
                place = b.column("block").slice(r, 1).take(pa.array(np.zeros(n * m, int)))
                heads = e.take(pa.array(start))
                count = np.add.reduceat(v, start)
                yield pa.RecordBatch.from_arrays([place, pa.array(at), c.take(pa.array(at)), pa.array(w[at]), heads.take(pa.array(of)), pa.array(np.concatenate(sums).ravel()), pa.array(count[of])], ["block", "i", "ac", "w", "bc", "s", "n"])

    other = packed.select(F.col("block").alias("facing"), F.col("rows").alias("others"))
    # The order in which blocks meet is dealt by a hash of both, each pair a task's step: two blocks are all a task holds.
    pairs = packed.select("block").crossJoin(F.broadcast(packed.select(F.col("block").alias("facing")))).repartition(int(min(4096, blocks * blocks)), "block", "facing")
    met = pairs.join(packed, "block").join(other, "facing").select("block", "rows", "others")
    parts = met.mapInArrow(meet, f"block long, i long, ac {kind}, w double, bc {kind}, s double, n double")
    sums = parts.groupBy("block", "i", "ac", "bc").agg(F.first("w").alias("w"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    own = F.col("ac") == F.col("bc")
    per = sums.groupBy("block", "i").agg(
        F.first("w").alias("w"),
        F.max(F.when(own, F.when(F.col("n") > 1, F.col("s") / F.nullif(F.col("n") - 1, F.lit(0.0))).otherwise(0.0))).alias("a"),
        F.max(F.when(own, F.col("n"))).alias("m"),
        F.min(F.when(~own, F.col("s") / F.col("n"))).alias("b"),
    )
    most = F.greatest("a", "b")
    s = F.when(F.col("m") == 1, F.lit(singleton)).when(most == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(most, F.lit(0.0)))
    return per.agg((F.sum(F.col("w") * s) / F.sum(F.when(s.isNotNull(), F.col("w")))).alias("score"))
