"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chargrams, common

ORDERS = (4, 5)
BUCKETS = 1 << 19
#: Labelled documents of each class that the model is fitted on, about; a hash of the id picks them.
TRAIN_PER_CLASS = 8192
#: Buckets that become features (those whose counts tell the classes apart best), and how many documents have one.
FEATURES = 4096
LEAST_DOCS = 4
SMOOTHING = 1.0
PENALTY = 1e-3
ROUNDS = 300
#: Rows that a step of the fit works on at once.
BLOCK = 512
THRESHOLD = 0.3


def _presence(column, buckets=BUCKETS, wanted: np.ndarray | None = None):
    """(text, bucket) pairs, each once; with ``wanted`` only buckets where it is true."""
    for i, j, grams, owner in chargrams.hashed(column, ORDERS, buckets):
        if wanted is not None:
            hit = np.flatnonzero(wanted[grams])
            grams, owner = grams[hit], owner[hit]
        key = np.unique(owner * buckets + grams)
        yield i, j, key // buckets, key % buckets


def _counts(batches):
    total, docs = np.zeros((2, BUCKETS), np.int32), np.zeros(2, np.int64)
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
        docs += np.bincount(label, minlength=2)
        for i, j, owner, grams in _presence(batch.column("text")):
            of = label[i:j][owner]
            for k in (0, 1):
                total[k] += np.bincount(grams[of == k], minlength=BUCKETS).astype(np.int32)
    yield pa.RecordBatch.from_pydict({"label": pa.array([0, 1], pa.int32()), "docs": pa.array(docs, pa.int64()), "counts": pa.array([x.tobytes() for x in total], pa.binary())})


def _choose(parts: pa.Table) -> pa.Table:
    """The buckets that tell the classes apart best, with their naive Bayes log-count ratios, in bucket order."""
    total, seen = np.zeros((2, BUCKETS)), np.zeros(2, np.int64)
    for k, n, blob in zip(parts.column("label").to_pylist(), parts.column("docs").to_pylist(), parts.column("counts"), strict=True):
        total[k] += np.frombuffer(blob.as_buffer(), np.int32)
        seen[k] += n
    q, p = total
    best = np.zeros(0, np.int64)
    ratio = np.log((p + SMOOTHING) / (p + SMOOTHING).sum()) - np.log((q + SMOOTHING) / (q + SMOOTHING).sum())
    if seen.all():
        a, b = p / seen[1], q / seen[0]
        apart = np.abs(a - b) / np.sqrt((a * (1 - a) + 0.5 / seen[1]) / seen[1] + (b * (1 - b) + 0.5 / seen[0]) / seen[0])
        apart[p + q < LEAST_DOCS] = 0
        best = np.sort(np.argsort(-apart, kind="stable")[:FEATURES])
        best = best[apart[best] > 0]
    return pa.table({"bucket": pa.array(best, pa.int32()), "ratio": pa.array(ratio[best], pa.float64()), "seen0": pa.array([int(seen[0])] * len(best), pa.int64()), "seen1": pa.array([int(seen[1])] * len(best), pa.int64())})


class ToxicityModel:
    """Weights by bucket (0 for buckets that are no features) and an intercept."""

    def __init__(self, weights: np.ndarray | None = None, intercept: float = -np.inf):
        self.weights = np.zeros(BUCKETS, np.float32) if weights is None else weights.astype(np.float32)
        self.intercept = intercept
        self.wanted = self.weights != 0

    def score(self, column) -> np.ndarray:
        total = np.full(len(column), self.intercept)
        for i, j, owner, grams in _presence(column, wanted=self.wanted):
            total[i:j] += np.bincount(owner, self.weights[grams], minlength=j - i)
        return 1 / (1 + np.exp(-np.clip(total, -700, 700)))


def _logistic(first: np.ndarray, cols: np.ndarray, scale: np.ndarray, label: np.ndarray, weight: np.ndarray):
    """Weighted logistic regression on sparse rows of ``scale[col]`` by accelerated gradient steps.

    Row k has the columns ``cols[first[k]:first[k + 1]]``; rows are walked in blocks, so that what a step needs
    beside the lists is a few MB.
    """
    n, d = len(label), len(scale)
    start = float(np.log(max(1e-9, weight[label == 1].sum()) / max(1e-9, weight[label == 0].sum())))
    share, sizes = weight / weight.sum(), np.diff(first)

    def times(v, b):
        each, out = scale * v, np.full(n, b)
        for a in range(0, n, BLOCK):
            z = min(n, a + BLOCK)
            out[a:z] += np.bincount(np.repeat(np.arange(z - a), sizes[a:z]), each[cols[first[a] : first[z]]], minlength=z - a)
        return out

    def back(e):
        out = np.zeros(d)
        for a in range(0, n, BLOCK):
            z = min(n, a + BLOCK)
            out += np.bincount(cols[first[a] : first[z]], np.repeat(e[a:z], sizes[a:z]), minlength=d)
        return out * scale, e.sum()

    v, vb, curve = np.ones(d), 1.0, 1.0
    for _ in range(30):  # the largest curvature, by power iteration
        v, vb = back(share * times(v, vb))
        curve = float(np.sqrt((v * v).sum() + vb * vb))
        v, vb = v / curve, vb / curve
    step = 1 / (0.3 * curve + PENALTY)
    w, b = np.zeros(d), start
    v, vb = w, b
    for t in range(ROUNDS):
        err = (1 / (1 + np.exp(-np.clip(times(v, vb), -500, 500))) - label) * share
        g, gb = back(err)
        nw, nb, pace = v - step * (g + PENALTY * v), vb - step * gb, t / (t + 3)
        v, vb = nw + pace * (nw - w), nb + pace * (nb - b)
        w, b = nw, nb
    return w, b


def train_toxicity_model(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    per_class: int = TRAIN_PER_CLASS,
) -> ToxicityModel:
    """Fits on a bounded sample: about ``per_class`` labelled ids of each class, weighted back to the classes' shares.

    First n-gram buckets are counted by class, and those that tell the classes apart best (FEATURES of those that at
    least LEAST_DOCS documents have) become features scaled by their naive Bayes log-count ratio; then the sample's
    feature lists (a few KB a document, some 30 MB together) are fitted in one task, in id order. The driver gets the
    features' weights only. Rows without a label or id are left out, null texts count as empty; labels other than 0
    count as 1; an id labelled in both ways is two examples, rows equal in id, text and label are one. Other columns
    are ignored. Without both classes among the labels (so with empty tables) the model scores 0.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), (F.col(label_col) != 0).cast("int").alias("label"))
    known = known.filter("label IS NOT NULL AND doc_id IS NOT NULL")
    have = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(have) < 2:
        return ToxicityModel()
    share = F.when(F.col("label") == 1, F.lit(min(1.0, per_class / have[1]))).otherwise(F.lit(min(1.0, per_class / have[0])))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) < share * float(1 << 20)).distinct()
    if chosen.limit(8 * per_class + 1).count() <= 8 * per_class:  # at most 65536 pairs of 12 bytes
        chosen = F.broadcast(chosen)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # Of an id that very many rows have, a share of the rows is picked, by their texts; equal texts teach once.
    rows = texts.select("doc_id").join(chosen, "doc_id").count()
    sample = texts.join(chosen, "doc_id")
    if rows > 8 * per_class:
        sample = sample.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(10)), F.lit(1 << 20)) < F.lit(8 * per_class / rows * (1 << 20)))
    sample = sample.groupBy("doc_id", "label", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).drop("h")
    sample, path = common.materialize(sample.repartition(8, "doc_id", "text"), "toxic-sample")
    counts = sample.select("label", "text").mapInArrow(_counts, "label int, docs bigint, counts binary").withColumn("all", F.lit(0))
    chosen = counts.groupBy("all").applyInArrow(_choose, "bucket int, ratio double, seen0 bigint, seen1 bigint").collect()
    if not chosen:
        common.discard(docs.sparkSession, path)
        return ToxicityModel()
    best = np.array([r["bucket"] for r in chosen])
    ratio = np.array([r["ratio"] for r in chosen])
    seen = (chosen[0]["seen0"], chosen[0]["seen1"])
    place = np.full(BUCKETS, -1, np.int32)
    place[best] = np.arange(len(best))

    def features(batches):
        for batch in batches:
            lists = [np.zeros(0, np.uint16)] * batch.num_rows
            for i, j, owner, grams in _presence(batch.column("text"), wanted=place >= 0):
                cuts = np.searchsorted(owner, np.arange(j - i + 1))
                for k in range(j - i):
                    lists[i + k] = place[grams[cuts[k] : cuts[k + 1]]].astype(np.uint16)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([x.tobytes() for x in lists], pa.binary())], ["doc_id", "label", "features"])

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("features", "ascending")])
        lists = [np.frombuffer(x, np.uint16) for x in rows.column("features").to_pylist()]
        label = rows.column("label").to_numpy()
        first = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
        weight = np.where(label == 1, have[1] / seen[1], have[0] / seen[0])
        w, intercept = _logistic(first, np.concatenate(lists), ratio, label, weight)
        return pa.table({"w": pa.array([[float(intercept), *map(float, w)]], pa.list_(pa.float64()))})

    kind = sample.schema["doc_id"].dataType.simpleString()
    found = sample.mapInArrow(features, f"doc_id {kind}, label int, features binary").withColumn("all", F.lit(0))
    fitted = np.array(found.groupBy("all").applyInArrow(fit, "w array<double>").first()["w"])
    common.discard(docs.sparkSession, path)
    weights = np.zeros(BUCKETS)
    weights[best] = fitted[1:] * ratio
    return ToxicityModel(weights, float(fitted[0]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The id, ``score`` (0 to 1) and ``predicted`` (1 from the threshold on) of each document, from its whole text.

    A null text counts as empty and gets the score of a text without features. Every row is scored by itself, so ids
    may be null or repeated, and a text of any length is scored whole. The weights (2 MB) are broadcast. Other columns
    are ignored, whatever their names; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            p = shared.value.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below the threshold, with all their columns; the rows never leave their task.

    Nulls and long texts are as score_toxicity() has them; repeated rows share their fate, whatever their ids; an
    empty table gives none.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(batch.column(at)) < threshold))

    return docs.mapInArrow(keep, docs.schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from labels whose crc32 of the id mod 4 is not 2: see score_toxicity."""
    docs = common.table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    labels = common.table(spark, sf_dir, "labels").filter(fold != 2)
    model = train_toxicity_model(docs, labels)
    return score_toxicity(docs, model).select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", "predicted")
