"""Substring deduplication: repeated fixed-length word windows, found by Rabin-Karp hashes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textscan

WINDOW = 13
#: Bytes of text of a block of documents, and bytes that a window's hash takes on its way, besides the bucket's bits.
BLOCK_BYTES = 4 << 20
KEY_BYTES = 7
NO_ID = np.iinfo(np.int64).max


def _block_windows(rows: pa.Table, width: int, buckets: int):
    """Scans a block: (ids of texts, slices of words, distinct windows sorted by bucket and key, their first ids, where each occurs).

    Windows of the whole block are numbered as they come; ``inverse`` leads from each to its distinct hash.
    """
    ids = rows.column("doc_id").to_numpy(zero_copy_only=False)
    known = ~np.asarray(rows.column("doc_id").is_null())
    ids = np.where(known, np.nan_to_num(ids, nan=0.0) if ids.dtype.kind == "f" else ids, NO_ID).astype(np.int64)
    if not known.all():  # a float round trip would lose digits
        ids = np.array([NO_ID if x is None else x for x in rows.column("doc_id").to_pylist()], np.int64)
    parts, hashes, texts = [], [], []
    for i, _, data, offsets in textscan.slices(rows.column("text")):
        words = textscan.Words(data, offsets)
        at, hash_ = textscan.windows(words.hashes(), words.first, width)
        parts.append((i, words, at))
        hashes.append(hash_)
        texts.append(i + textscan.owners(words.first)[at])
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    texts = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    distinct, inverse = np.unique(hashes, return_inverse=True)
    least = np.full(len(distinct), NO_ID, np.int64)
    np.minimum.at(least, inverse, ids[texts])
    return ids, parts, distinct, least, inverse, texts


def _bucket_of(distinct: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hash's upper 32 bits, so sorted hashes are sorted by bucket as well."""
    return ((distinct >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """What is left of each document when repeated windows of ``width`` words go.

    Each word covered by a window whose word sequence also starts in a document with a smaller id is removed;
    overlapping windows merge into maximal intervals. Windows are judged on the input. Rows are dealt to blocks;
    blocks send each distinct window hash once, with the smallest id that has it in the block, to the
    bucket of that hash; a bucket finds each hash's smallest id over all blocks and answers a block with one bit for
    each window it sent: whether an earlier document elsewhere has it. So a window that stands in a third of all
    documents costs one entry a block. Texts are shuffled once. Hashes have 64 bits, all compared.

    Result: the id, ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by a space), ``spans`` (removed
    intervals of word positions, end excluded). A null text has no words and gives a row with 0 words. A row without
    an id counts as later than all others, and such rows don't affect each other; rows repeating an id are documents
    of their own, each with a row, and the same id is not a smaller one. Ids must be integers. A text of any length is
    one document of one block. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, spans array<struct<start:int,end:int>>"
    return _removed(docs, id_col, text_col, width, block_bytes, schema, _kept_texts)


def _removed(docs, id_col, text_col, width, block_bytes, schema, finish) -> DataFrame:
    common.need_integers(docs, id_col)
    total = common.text_bytes(docs, text_col)
    blocks = int(max(total // block_bytes, 2 * common.shuffle_width(docs.sparkSession)))
    buckets = common.buckets_for(total)
    # The partition that a row is read in takes part, so that rows of one id (or none) and length don't fill a block.
    where = F.xxhash64(F.col(id_col).cast("bigint"), F.octet_length(text_col), F.spark_partition_id())
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.pmod(where, F.lit(blocks)).cast("int").alias("block"),
    ).repartition("block")

    def send(key: tuple, rows: pa.Table) -> pa.Table:
        ids, _, distinct, least, _, _ = _block_windows(rows, width, buckets)
        bucket = _bucket_of(distinct, buckets)
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, int)
        ends = np.concatenate((cuts[1:], [len(bucket)])) if len(cuts) else cuts
        # An id is sent once; a window names its place among the block's ids in two or four bytes.
        known, place = np.unique(least, return_inverse=True)
        place = place.astype("<u2" if len(known) < 65536 else "<u4")
        low = _low_bytes(distinct)
        blobs = [
            _pack(low[a:b].tobytes(), place[a:b], known)
            for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)
        ]
        return pa.table({
            "block": pa.array([key[0].as_py()] * len(cuts), pa.int32()),
            "bucket": pa.array(bucket[cuts], pa.int32()),
            "blob": pa.array(blobs, pa.binary()),
        })

    def judge(key: tuple, sent: pa.Table) -> pa.Table:
        keys, ids, sizes = [], [], []
        for x in sent.column("blob"):
            k, i = _unpack(x.as_buffer())
            keys.append(k)
            ids.append(i)
            sizes.append(len(k))
        keys, ids = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        least = np.minimum.reduceat(ids[order], np.flatnonzero(new))
        earlier = np.empty(len(keys), bool)
        earlier[order] = least[np.cumsum(new) - 1] < ids[order]
        cuts = np.cumsum([0, *sizes])
        hit = [k for k in range(len(sizes)) if earlier[cuts[k] : cuts[k + 1]].any()]
        return pa.table({
            "block": sent.column("block").take(pa.array(hit, pa.int64())).cast(pa.int32()),
            "bucket": pa.array([key[0].as_py()] * len(hit), pa.int32()),
            "bits": pa.array([zlib.compress(np.packbits(earlier[cuts[k] : cuts[k + 1]]).tobytes(), 1) for k in hit], pa.binary()),
        })

    def apply(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        ids, parts, distinct, least, inverse, texts = _block_windows(rows, width, buckets)
        elsewhere = np.zeros(len(distinct), bool)
        bucket = _bucket_of(distinct, buckets)
        for b, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True):
            a, z = np.searchsorted(bucket, [b, b + 1])
            elsewhere[a:z] = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=z - a).astype(bool)
        gone = elsewhere[inverse] | (least[inverse] < ids[texts])
        return finish(rows, parts, gone, width)

    sent = rows.groupBy("block").applyInArrow(send, "block int, bucket int, blob binary")
    answers = sent.groupBy("bucket").applyInArrow(judge, "block int, bucket int, bits binary")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(apply, schema)


def _low_bytes(distinct: np.ndarray) -> np.ndarray:
    """The hash without its upper byte: a bucket, a range of the upper bits, holds at most 1/256 of all hashes."""
    return distinct.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]


def _pack(low: bytes, place: np.ndarray, known: np.ndarray) -> bytes:
    used, place = np.unique(place, return_inverse=True)
    kind = "<u1" if len(used) <= 256 else "<u2" if len(used) <= 65536 else "<u4"
    place = place.astype(kind)
    head = np.array([len(place), len(used), place.itemsize], "<u4")
    return b"".join((head.tobytes(), known[used].astype("<i8").tobytes(), place.tobytes(), low))


def _unpack(blob) -> tuple[np.ndarray, np.ndarray]:
    n, m, width = np.frombuffer(blob, "<u4", 3)
    known = np.frombuffer(blob, "<i8", m, 12)
    place = np.frombuffer(blob, f"<u{width}", n, 12 + 8 * int(m))
    low = np.frombuffer(blob, np.uint8, int(n) * KEY_BYTES, 12 + 8 * int(m) + int(width) * int(n)).reshape(-1, KEY_BYTES)
    keys = np.zeros((int(n), 8), np.uint8)
    keys[:, :KEY_BYTES] = low
    return keys.view("<u8").ravel(), known[place]


def _intervals(parts: list, gone: np.ndarray, width: int) -> Iterator[tuple[int, textscan.Words, int, np.ndarray]]:
    """For each text: (its index in the block, its slice's words, its place there, which of its words go)."""
    begin = 0
    for i, words, at in parts:
        hit = at[gone[begin : begin + len(at)]]
        begin += len(at)
        mark = np.zeros(len(words.starts) + 1, np.int32)
        np.add.at(mark, hit, 1)
        np.add.at(mark, hit + width, -1)
        covered = np.cumsum(mark[:-1]) > 0
        for k in range(len(words.offsets) - 1):
            yield i + k, words, k, covered[words.first[k] : words.first[k + 1]]


def _result(rows: pa.Table, parts: list, gone: np.ndarray, width: int):
    for _, words, k, covered in _intervals(parts, gone, width):
        a, b = words.first[k], words.first[k + 1]
        kept = ~covered
        yield b - a, int(covered.sum()), textscan.join_words(words.data, words.starts[a:b][kept], words.ends[a:b][kept]), covered


def _kept_texts(rows: pa.Table, parts: list, gone: np.ndarray, width: int) -> pa.Table:
    n, removed, kept, spans = [], [], [], []
    for a, b, text, covered in _result(rows, parts, gone, width):
        edges = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8))).reshape(-1, 2)
        n.append(a)
        removed.append(b)
        kept.append(text.decode("utf-8"))
        spans.append([{"start": int(x), "end": int(y)} for x, y in edges])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.table({"doc_id": rows.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.string()), "spans": pa.array(spans, kind)})


def _kept_digests(rows: pa.Table, parts: list, gone: np.ndarray, width: int) -> pa.Table:
    n, removed, digests = [], [], []
    for a, b, text, _ in _result(rows, parts, gone, width):
        n.append(a)
        removed.append(b)
        digests.append(hashlib.sha256(text).hexdigest())
    return pa.table({"doc_id": rows.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without their repeated 13-word windows, kept words as a digest: see substring_dedup."""
    docs = common.table(spark, sf_dir, "documents")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    return _removed(docs, "doc_id", "text", WINDOW, BLOCK_BYTES, schema, _kept_digests)


OP3_SQL = r"""
WITH w AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS row_no, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT row_no, doc_id, i, sha256(array_to_string(words[i : i + 12], ' ')) AS h
  FROM (SELECT *, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
hit AS (SELECT row_no, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first_id FROM win) WHERE first_id < doc_id),
gone AS (SELECT row_no, list(DISTINCT p) AS g FROM (SELECT row_no, unnest(range(i, i + 13)) AS p FROM hit) GROUP BY row_no)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN g IS NULL THEN array_to_string(words, ' ')
              ELSE coalesce(array_to_string([words[p] FOR p IN range(1, len(words) + 1) IF NOT list_contains(g, p)], ' '), '') END) AS kept_sha256
FROM w LEFT JOIN gone USING (row_no)
"""
