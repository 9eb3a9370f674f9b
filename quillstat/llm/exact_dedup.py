"""Exact deduplication by distributed most-significant-digit radix partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of the first digit; each further digit is four times as wide.
FIRST_DIGIT = 128
GROWTH = 4


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_digit: int = FIRST_DIGIT, growth: int = GROWTH
) -> DataFrame:
    """One row per document with the group of equal texts that it belongs to.

    Texts are equal when identical after replacing each run of space or 0x09-0x0D by one space; null counts as
    empty. Documents are split by successive bytes of the normalised text: a digit is the next run of bytes, groups
    of one digit value are counted with map-side combine, and only documents whose group holds others and whose
    text has not ended go on to the next, wider digit. The bytes themselves are compared; no digest decides
    equality. A hot group meets no single task: counts are partial sums, and rows meet them in a join that
    adaptive execution splits.

    A group is named by the least (id, SHA-256) of its rows, so groups of unequal texts that hold the same id stay apart;
    the name is never compared across digits that differ.

    Result: the id, ``keep_id`` (smallest id of the group), ``group_size``, ``kept``, ``text_sha256`` (hex of the
    normalised text). A row without an id is a group of its own (keep_id null, kept). Rows that repeat an id and
    its text are members like any other; all rows with the smallest id are kept. An id on several texts is in several groups. A very long text takes about
    log4(its bytes / 128) rounds if others share its beginning, else one. Other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), common.SPACE, " ")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.encode(text, "UTF-8").alias("rest"))
    rows = rows.withColumn("text_sha256", F.sha2("rest", 256))
    lost = rows.filter("doc_id IS NULL").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    row = F.struct("doc_id", F.unhex("text_sha256").alias("sha"))
    todo = rows.filter("doc_id IS NOT NULL").withColumn("group", F.struct(F.lit(0).cast(dict(rows.dtypes)["doc_id"]).alias("doc_id"), F.lit(b"").alias("sha")))
    done, width, last = lost, first_digit, None
    while True:
        todo = todo.select(
            "doc_id",
            "text_sha256",
            "group",
            F.substring("rest", 1, width).alias("digit"),
            (F.octet_length("rest") <= width).alias("ended"),
            F.expr(f"substring(rest, {width + 1})").alias("rest"),
        )
        keys = ["group", "digit", "ended"]
        counts = todo.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("least"))
        open_ = (F.col("n") > 1) & ~F.col("ended")
        step = todo.join(counts, keys).select(
            "doc_id",
            "text_sha256",
            F.col("least").alias("group"),
            "n",
            open_.alias("open"),
            F.when(open_, F.col("rest")).alias("rest"),
        )
        table, path = common.materialize(step, "radix", "open")
        if last:
            common.discard(spark, f"{last}/open=true")
        last = path
        done = done.unionByName(
            table.filter("NOT open").select(
                "doc_id",
                F.col("group.doc_id").alias("keep_id"),
                F.col("n").alias("group_size"),
                (F.col("doc_id") == F.col("group.doc_id")).alias("kept"),
                "text_sha256",
            )
        )
        todo = table.filter("open").select("doc_id", "text_sha256", "group", "rest")
        if todo.isEmpty():
            return done
        width *= growth


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents in groups of equal texts: see exact_groups."""
    return exact_groups(common.table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
