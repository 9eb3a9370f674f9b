"""Fixity audit of WARC replicas by Merkle trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of records after which an archive file ends, and bytes of a file whose records make a leaf of its tree.
FILE_BYTES = 64 << 20
LEAF_BYTES = 64 << 10
#: Children of an inner node.
FANOUT = 16


def warc_record(url: Column, payload: Column, record_id: Column) -> Column:
    """A WARC/1.1 resource record as bytes: header lines, a blank line, the payload, two line ends."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.encode(F.concat(head, body, F.lit("\r\n\r\n")), "UTF-8")


def layout(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """(page_id, file_no, offset, length, digest): where each page's record stands, in id order, and its SHA-256.

    Records follow each other by id, then digest; a null id comes first. A record belongs to the file in whose
    ``file_bytes`` stretch of the whole archive it begins, and ``offset`` counts from that stretch's start. Null urls
    and payloads count as empty, repeated rows are records of their own, a record may be longer than a file. Other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    record = warc_record(F.col(url_col), F.col(payload_col), F.col(id_col))
    rows = pages.select(F.col(id_col).alias("page_id"), record.alias("r"))
    rows = rows.select("page_id", F.octet_length("r").cast("bigint").alias("length"), F.sha2("r", 256).alias("digest"))
    pieces, path = common.ranged(rows, ["page_id", "digest"], "warc")
    placed = common.bucketed_running(pieces.withColumn("all", F.lit(0)), ["all"], "__piece", ["page_id", "digest"], {"at": "length"})
    return placed.select("page_id", F.expr(f"at div {file_bytes}L").alias("file_no"), (F.col("at") % file_bytes).alias("offset"), "length", "digest")


def merkle_tree(records: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT, file_bytes: int = FILE_BYTES) -> list[DataFrame]:
    """Levels of a tree over each file's records, leaves first: (file_no, node, hash).

    A leaf is the hash of the ordered (offset, length, digest) of records that begin in one ``leaf_bytes`` stretch;
    a node above is the hash of its children, at most ``fanout`` of them. The last level has one root a file. A leaf
    gathers no more than ``leaf_bytes`` over the shortest record's length, as offsets are distinct. Every level is
    written once and the next one reads it, so that neither is made again when trees are compared.
    """
    entry = F.concat_ws(":", F.lpad(F.col("offset").cast("string"), 20, "0"), F.col("length").cast("string"), "digest")
    level = records.groupBy("file_no", F.expr(f"offset div {leaf_bytes}L").alias("node"))
    level = level.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(entry)), "\n").cast("binary"), 256).alias("hash"))
    level, _ = common.materialize(level, "merkle-0")
    levels, width = [level], -(-file_bytes // leaf_bytes)
    while width > 1:
        child = F.concat_ws(":", F.lpad(F.col("node").cast("string"), 20, "0"), "hash")
        level = level.groupBy("file_no", F.expr(f"node div {fanout}L").alias("node"))
        level = level.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(child)), "\n").cast("binary"), 256).alias("hash"))
        level, _ = common.materialize(level, f"merkle-{len(levels)}")
        levels.append(level)
        width = -(-width // fanout)
    return levels


def audit(primary: DataFrame, replica: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT, file_bytes: int = FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Compares two replicas given as (file_no, offset, length, digest) rows: (bad records, nodes visited by level).

    Roots are compared first; below, only children of nodes that differ, down to the records of differing leaves.
    Each level's comparison is written, so the next one starts from its few differing nodes.
    Bad records are (file_no, offset, status): ``corrupt`` where digest or length differ, ``missing`` where only
    the primary has one, ``extra`` where only the replica has. A file that one side lacks altogether differs at its
    root. Empty inputs give no rows.
    """
    ours, theirs = (merkle_tree(x, leaf_bytes, fanout, file_bytes) for x in (primary, replica))
    suspects, visited = None, None
    for depth in range(len(ours) - 1, -1, -1):
        a = ours[depth].withColumnRenamed("hash", "a")
        b = theirs[depth].withColumnRenamed("hash", "b")
        if suspects is not None:
            parent = F.expr(f"node div {fanout}L")
            a, b = (x.withColumn("parent", parent).join(suspects, ["file_no", "parent"], "left_semi").drop("parent") for x in (a, b))
        both, _ = common.materialize(a.join(b, ["file_no", "node"], "full"), f"merkle-compared-{depth}")
        count = both.agg(F.lit(depth).alias("level"), F.count(F.lit(1)).alias("compared"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differ"))
        visited = count if visited is None else visited.unionByName(count)
        suspects = both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("file_no", F.col("node").alias("parent"))
    leaf = F.expr(f"offset div {leaf_bytes}L")
    mine, other = (x.select("file_no", "offset", "length", "digest").withColumn("parent", leaf).join(suspects, ["file_no", "parent"], "left_semi").drop("parent") for x in (primary, replica))
    mine = mine.select("file_no", "offset", F.struct("length", "digest").alias("a"))
    other = other.select("file_no", "offset", F.struct("length", "digest").alias("b"))
    status = F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").otherwise("corrupt")
    bad = mine.join(other, ["file_no", "offset"], "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    return bad.select("file_no", "offset", status.alias("status")), visited


def rotted(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """A replica of the pages in which about one record in 256, picked by the id's MD5, has its last character changed."""
    hit = F.substring(F.md5(F.col(id_col).cast("string").cast("binary")), 1, 2) == "07"
    body = F.coalesce(F.col(payload_col), F.lit(""))
    changed = F.concat(F.expr(f"substring({payload_col}, 1, length({payload_col}) - 1)"), F.when(body.endswith("#"), "@").otherwise("#"))
    # Only one-byte characters change, so that lengths and offsets stay as they are.
    small = (F.length(body) > 0) & (F.octet_length(F.right(body, F.lit(1))) == 1)
    return pages.withColumn(payload_col, F.when(hit & small, changed).otherwise(F.col(payload_col)))


def op7_warc_fixity(spark, sf_dir: str) -> DataFrame:
    """All pages as records of an archive, audited against a replica with known rot: one row per record.

    Nulls, repeated rows, long payloads, extra columns and empty tables are as layout() has them.
    """
    pages = common.table(spark, sf_dir, "pages")
    primary, _ = common.materialize(layout(pages), "manifest")
    replica, _ = common.materialize(layout(rotted(pages)), "replica")
    bad, _ = audit(primary, replica)
    out = primary.join(bad, ["file_no", "offset"], "left")
    return out.select("page_id", "file_no", "offset", "length", F.col("digest").alias("record_sha256"), F.coalesce("status", F.lit("intact")).alias("status"))


OP7_SQL = r"""
WITH r AS (
  SELECT page_id, coalesce(html, '') AS body, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10),
    'WARC-Record-ID: <urn:page:', coalesce(CAST(page_id AS VARCHAR), 'none'), '>', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10),
    'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', CAST(strlen(coalesce(html, '')) AS VARCHAR), chr(13), chr(10), chr(13), chr(10),
    coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) AS record FROM pages),
d AS (SELECT page_id, body, strlen(record) AS length, sha256(record) AS record_sha256 FROM r),
p AS (SELECT *, CAST(sum(length) OVER (ORDER BY page_id NULLS FIRST, record_sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length AS BIGINT) AS pos FROM d)
SELECT page_id, pos // 67108864 AS file_no, pos % 67108864 AS "offset", length, record_sha256,
       CASE WHEN substr(md5(CAST(page_id AS VARCHAR)), 1, 2) = '07' AND body <> '' AND strlen(right(body, 1)) = 1 THEN 'corrupt' ELSE 'intact' END AS status
FROM p
"""
