"""A corpus from documents: toxic ones go, near copies go, contaminated ones go, sources are mixed, the rest is sharded.

Each stage reads the whole table that the one before wrote. All but the last return the columns of documents. Null
texts count as empty, rows without an id are rows of their own, rows that repeat an id share their fate, and an empty
table passes through every stage; further columns are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstat.llm import common, decontamination, mixing, ngram_join, sharding, toxicity

#: SQL can't express the fitted classifier of the first stage; the stages are tested one by one instead.
ORACLE_SQL = None


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores 0.3 or more; it is fitted on its bounded sample of the labelled ones.

    A null or empty text has the score of a text without features. Without labels of both classes nothing goes.
    """
    model = toxicity.train_toxicity_model(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked at 75 hundredths on five-word shingles.

    Texts without words, and rows without an id, are linked with nothing and stay.
    """
    return ngram_join.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item or an edited copy of one; texts without words hold none."""
    return decontamination.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the schedule of source weights asks; texts without words once."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the mix into 24 shards of near equal bytes, equal texts into one; an empty text has 8 bytes."""
    return sharding.shard_by_kd_tree(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir. Tables written on the way stay until common.cleanup()."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, _ = common.materialize(docs, f"stage-{name}")
    return docs
