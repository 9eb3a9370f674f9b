"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """(id, label): the smallest id of its component for each id of ``links`` (a, b); and the table's path.

    Every round ties each node's larger neighbours, then its smaller ones, to the smallest neighbour; rounds are
    written to the shared folder until nothing changes, which takes about the logarithm of the longest chain. A
    node with very many neighbours is summed before it is shuffled, and meets them in a join that can be split.
    """
    spark = links.sparkSession
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, path = common.materialize(edges, "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # u's own link to its least neighbour stays: every smaller neighbour sees it as a larger one.
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges, new = common.materialize(small.filter("u <> v").distinct(), "edges")
        common.discard(spark, path)
        path = new
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    labels = edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    out, new = common.materialize(labels.unionByName(roots), "labels")
    common.discard(spark, path)
    return out, new
