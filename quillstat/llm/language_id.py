"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chargrams, common

#: Orders of the n-grams, and buckets that they are hashed to.
ORDERS = (2, 3)
BUCKETS = 1 << 15
SMOOTHING = 0.5
#: Documents of a language that the model is trained on, about: a hash of the id picks them where there are more.
TRAIN_PER_LANG = 8192
#: Languages that are scored together: a matrix of BUCKETS floats for each (64 MB) is broadcast; more take further rounds.
ROUND_LANGS = 512


def _counts(batches):
    """(lang, bucket, n) of the n-grams of each batch."""
    for batch in batches:
        names = batch.column("lang").dictionary_encode()
        of = names.indices.to_numpy()
        for i, j, grams, owner in chargrams.hashed(batch.column("text"), ORDERS, BUCKETS):
            key, n = np.unique(of[i:j][owner] * BUCKETS + grams, return_counts=True)
            lang = names.dictionary.take(pa.array(key // BUCKETS))
            yield pa.RecordBatch.from_arrays([lang, pa.array(key % BUCKETS, pa.int32()), pa.array(n, pa.int64())], ["lang", "bucket", "n"])


def _log_shares(key: tuple, rows: pa.Table) -> pa.Table:
    """A language's smoothed log-probabilities from its buckets' counts."""
    total = np.full(BUCKETS, SMOOTHING)
    total[rows.column("bucket").to_numpy()] += rows.column("n").to_numpy()
    return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "logp": pa.array([np.log(total / total.sum()).astype("<f4").tobytes()], pa.binary())})


class LanguageModel:
    """Log-probabilities of hashed n-grams by language, and the languages' log priors."""

    def __init__(self, langs: list[str], prior: np.ndarray, logp: np.ndarray):
        self.langs, self.prior, self.logp = langs, prior, logp

    def rounds(self, most: int) -> list[LanguageModel]:
        return [LanguageModel(self.langs[k : k + most], self.prior[k : k + most], self.logp[k : k + most]) for k in range(0, max(1, len(self.langs)), most)]

    def score(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(has a letter, place of the likeliest language, its joint log-probability, log of the sum over languages) of each text."""
        n = len(column)
        total = np.zeros((len(self.langs), n))
        letters = np.zeros(n, bool)
        for i, j, grams, owner in chargrams.hashed(column, ORDERS, BUCKETS, letters):
            for k in range(len(self.langs)):
                total[k, i:j] += np.bincount(owner, self.logp[k][grams], minlength=j - i)
        if not self.langs:
            return np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        total += self.prior[:, None]
        top = total.argmax(axis=0)
        most = total[top, np.arange(n)]
        return letters, top, most, most + np.log(np.exp(total - most).sum(axis=0))


def train_language_model(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = TRAIN_PER_LANG
) -> LanguageModel:
    """Counts n-grams of about ``per_lang`` documents of each language, picked by a hash of the text; equal texts of a
    language teach once.

    Counts are summed by language in Spark; the driver gets one vector (128 KB) for each language. Rows without a text
    or language are left out. Language names sort by code point, so equal scores go to the first name. The id plays
    no part, so it may be null or repeated; other columns are ignored. An empty table gives a model without languages.
    """
    known = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    have = known.groupBy("lang").agg(F.count(F.lit(1)).alias("have"))
    pick = F.pmod(F.xxhash64("text", F.lit(4)), F.lit(1 << 20)) < F.least(F.lit(1.0), per_lang / F.col("have")) * float(1 << 20)
    sample = known.join(F.broadcast(have) if common.few(have) else have, "lang").filter(pick)
    sample = sample.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).select("lang", "text")
    counts = sample.mapInArrow(_counts, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counts.groupBy("lang").applyInArrow(_log_shares, "lang string, logp binary").join(have, "lang", "right").collect()
    rows = sorted(rows, key=lambda r: r["lang"])
    even = np.full(BUCKETS, np.log(1 / BUCKETS), "<f4")
    logp = np.array([np.frombuffer(r["logp"], "<f4") if r["logp"] else even for r in rows], np.float32).reshape(len(rows), BUCKETS)
    n = np.array([r["have"] for r in rows], float)
    return LanguageModel([r["lang"] for r in rows], np.log(n / max(1.0, n.sum())), logp)


def identify_language(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", round_langs: int = ROUND_LANGS
) -> DataFrame:
    """The id, ``lang_pred`` and ``score`` (posterior probability) of each document, from its whole text.

    The model's matrix is broadcast in rounds of ``round_langs`` languages, through which the rows are handed on;
    texts are scored in batches as sparse n-gram counts. A null text, or one without any letter, gives ``und`` and 0;
    a learned language of that name has its probability like others. Every row is scored by itself, so ids may be null or repeated. Equal scores go to the first language. Other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(False).alias("letters"), F.lit("und").alias("best"), F.lit(-np.inf).alias("most"), F.lit(-np.inf).alias("total"))
    for part in model.rounds(round_langs):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def score(batches, shared=shared):
            names = np.array([*shared.value.langs, "und"], object)
            for batch in batches:
                letters, top, most, total = shared.value.score(batch.column("text"))
                old, before = batch.column("most").to_numpy(), batch.column("total").to_numpy()
                better = letters & (most > old)
                best = np.where(better, names[top], batch.column("best").to_numpy(zero_copy_only=False))
                total = np.where(letters, np.logaddexp(before, total), before)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(letters), pa.array(best, pa.string()), pa.array(np.where(better, most, old)), pa.array(total)], batch.schema.names)

        rows = rows.mapInArrow(score, rows.schema)
    picked = F.col("letters") & (F.col("most") > -np.inf)
    share = F.when(picked, F.exp(F.col("most") - F.col("total"))).otherwise(0.0)
    return rows.select("doc_id", F.col("best").alias("lang_pred"), F.least(share, F.lit(1.0)).alias("score"))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose crc32 of the id mod 3 is not 1: see identify_language."""
    docs = common.table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = train_language_model(docs.filter((fold != 1) | F.col("doc_id").isNull()))
    held_out = F.coalesce(fold == 1, F.lit(False))
    return identify_language(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
