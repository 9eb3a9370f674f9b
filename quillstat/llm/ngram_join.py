"""Similarity join on word n-grams: rare-first prefix filtering with length, positional and suffix filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components, textscan

SHINGLE = 5
#: Similarity, in hundredths, from which two documents are linked.
PERCENT = 75
#: A shingle that more documents of one block have is sent as a count; the block keeps who has it.
HOT = 24
KEY_BYTES = 5
#: Cells of a set's histogram: what two sets share in a cell is at most the smaller count (suffix filter).
CELLS = 64
#: A cell counts up to this; where two sets both reach it in one cell, the cells bound nothing.
FULL_CELL = 65535
#: Members of a list that are paired in one go, and pairs looked at together.
BLOCK = 1024
#: Rows of a shingle's list that join with its head in one part.
LIST_PART = 1024
PAIRS = 1 << 18


def _sets(data: np.ndarray, offsets: np.ndarray, width: int):
    """(text, hash) of the distinct shingles of each text, sorted by text and hash."""
    words = textscan.Words(data, offsets)
    hashes = words.hashes(lower=True)
    at, h = textscan.windows(hashes, words.first, width)
    text = textscan.owners(words.first)[at]
    counts = words.counts
    for k in np.flatnonzero((counts > 0) & (counts < width)):
        a, b = words.first[k], words.first[k + 1]
        _, whole = textscan.windows(hashes[a:b], np.array([0, b - a]), int(b - a), salt=int(b - a))
        text, h = np.append(text, k), np.append(h, whole)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    return text[new], h[new]


def _send(batches, width: int, buckets: int):
    """Blocks of texts send their distinct shingles to the shingles' buckets, and what they keep to themselves.

    kind 0: packed shingles with the texts that have them; kind 1: what only the block needs again, sent along to
    any bucket (ids, set sizes, digests of whole sets, and who has the block's hot shingles).
    """
    serial, part = 0, TaskContext.get().partitionId()
    for batch in batches:
        ids = batch.column("doc_id")
        for i, j, data, offsets in textscan.slices(batch.column("text")):
            block, serial = (part << 32) | serial, serial + 1
            text, h = _sets(data, offsets, width)
            n = np.bincount(text, minlength=j - i).astype(np.int64)
            digest = np.zeros((2, j - i), np.uint64)
            for k in (0, 1):
                cuts = np.concatenate(([0], np.cumsum(n)))
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(textscan.mix(h, 31 + k))))
                digest[k] = total[cuts[1:]] - total[cuts[:-1]]
            known = ~np.asarray(ids.slice(i, j - i).is_null())
            own = known[text]  # texts without an id take no part
            text, h = text[own], h[own]
            order = np.argsort(h, kind="stable")
            text, h = text[order].astype("<u4"), h[order]
            new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(h)))
            token, hot = h[new], times > HOT
            keep = np.repeat(hot, times)
            own = {"hot": token[hot], "hot_times": times[hot], "hot_text": text[keep]}
            yield _rows(block, 1, [int(block % buckets)], [_dump(ids=ids.slice(i, j - i), n=n, digest=digest, **own)])
            bucket = ((token >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            low = token.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 7 - KEY_BYTES : 7]
            cold_end = np.cumsum(np.where(hot, 0, times))
            cold = text[~keep].astype("<u2" if j - i <= 65536 else "<u4")
            sent = np.where(hot, 0, times).astype("<u1")
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
            blobs = []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=False):
                rare = cold[cold_end[a] - int(sent[a]) : cold_end[b - 1]]
                which = np.flatnonzero(hot[a:b]).astype("<u4")
                once = bool((sent[a:b] == 1).all())
                head = np.array([b - a, len(which), len(rare), cold.itemsize, once], "<u4")
                blobs.append(b"".join((head.tobytes(), which.tobytes(), times[a:b][which].astype("<u4").tobytes(), low[a:b].tobytes(), b"" if once else sent[a:b].tobytes(), rare.tobytes())))
            yield _rows(block, 0, bucket[cuts], blobs)


def _rows(block: int, kind: int, bucket, blobs) -> pa.RecordBatch:
    n = len(blobs)
    return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array(bucket, pa.int32()), pa.array(blobs, pa.binary())], ["block", "kind", "bucket", "blob"])


def _dump(ids, n, digest, hot, hot_times, hot_text) -> bytes:
    table = [ids.cast(pa.int64()), n, digest[0].view(np.int64), digest[1].view(np.int64)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in table], ["id", "n", "d0", "d1"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    body = sink.getvalue().to_pybytes()
    return b"".join((np.array([len(body), len(hot), len(hot_text)], "<u8").tobytes(), body, hot.astype("<u8").tobytes(), hot_times.astype("<u4").tobytes(), hot_text.astype("<u4").tobytes()))


def _load(blob: bytes):
    size, m, k = (int(x) for x in np.frombuffer(blob, "<u8", 3))
    table = pa.ipc.open_stream(blob[24 : 24 + size]).read_all()
    at = 24 + size
    return table, np.frombuffer(blob, "<u8", m, at), np.frombuffer(blob, "<u4", m, at + 8 * m), np.frombuffer(blob, "<u4", k, at + 12 * m)


def _count(key: tuple, sent: pa.Table) -> pa.Table:
    """A bucket counts its shingles over all blocks and answers each block with those that more documents have.

    Answers hold (shingle, documents that have it, text) of cold ones, and (shingle, documents) of hot ones.
    """
    out_block, out_kind, out_blob, parts = [], [], [], []
    for block, kind, blob in zip(sent.column("block").to_pylist(), sent.column("kind").to_pylist(), sent.column("blob"), strict=True):
        if kind == 1:
            out_block.append(block)
            out_kind.append(1)
            out_blob.append(blob.as_py())
            continue
        raw = blob.as_buffer()
        n, hot, rare, item, once = (int(x) for x in np.frombuffer(raw, "<u4", 5))
        at = 20
        which, times = np.frombuffer(raw, "<u4", hot, at), np.frombuffer(raw, "<u4", hot, at + 4 * hot)
        at += 8 * hot
        keys = np.zeros((n, 8), np.uint8)
        keys[:, :KEY_BYTES] = np.frombuffer(raw, np.uint8, n * KEY_BYTES, at).reshape(-1, KEY_BYTES)
        at += n * KEY_BYTES
        size = np.ones(n, np.int64) if once else np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
        at += 0 if once else n
        text = np.frombuffer(raw, f"<u{item}", rare, at)
        count = size.copy()
        count[which] = times
        parts.append((block, keys.view("<u8").ravel(), size, count, text))
    if parts:
        keys, count = np.concatenate([x[1] for x in parts]), np.concatenate([x[3] for x in parts])
        order = np.argsort(keys, kind="stable")
        new = np.flatnonzero(np.concatenate(([True], np.diff(keys[order]) != 0)))
        total = np.add.reduceat(count[order], new)
        df = np.empty(len(keys), np.int64)
        df[order] = np.repeat(total, np.diff(np.append(new, len(order))))
        at = 0
        for block, keys, size, _, text in parts:
            mine = df[at : at + len(keys)]
            at += len(keys)
            more = mine > 1
            if not more.any():
                continue
            cold, hot = more & (size > 0), more & (size == 0)
            begin = np.cumsum(size) - size
            times = size[cold]
            spot = np.repeat(begin[cold] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            fields = (keys[cold], mine[cold].astype("<u4"), times.astype("<u1"), text[spot].astype("<u4"), keys[hot], mine[hot].astype("<u4"))
            head = np.array([len(x) for x in (fields[0], fields[3], fields[4])], "<u4")
            out_block.append(block)
            out_kind.append(0)
            out_blob.append(b"".join((np.array([key[0].as_py()], "<u4").tobytes(), head.tobytes(), *[x.tobytes() for x in fields])))
    return pa.table({"block": pa.array(out_block, pa.int64()), "kind": pa.array(out_kind, pa.int32()), "blob": pa.array(out_blob, pa.binary())})


def _collect(key: tuple, rows: pa.Table, buckets: int, percent: int, full: int = FULL_CELL) -> pa.Table:
    """A block puts its documents' repeated shingles together: the rarest that lie in a document's prefix, and all.

    In rare-first order a document's unrepeated shingles come first and meet nobody, so of a prefix only what
    reaches into the repeated ones remains; most documents have none left.
    """
    table, token, df, text, hot_token, hot_times, hot_text = None, [], [], [], None, None, None
    hot_df: dict[int, int] = {}
    for kind, blob in zip(rows.column("kind").to_pylist(), rows.column("blob").to_pylist(), strict=True):
        if kind == 1:
            table, hot_token, hot_times, hot_text = _load(blob)
            continue
        bucket, a, b, c = (int(x) for x in np.frombuffer(blob, "<u4", 4))
        at = 16
        take = lambda kind, n: np.frombuffer(blob, kind, n, at)  # noqa: B023, E731
        keys = take("<u8", a)
        at += 8 * a
        often = take("<u4", a)
        at += 4 * a
        times = take("<u1", a).astype(np.int64)
        at += a
        who = take("<u4", b)
        at += 4 * b
        # A key has the hash's bytes from KEY_BYTES below the top one; with the bucket's range it names the shingle.
        name = _name(keys, bucket)
        token.append(np.repeat(name, times))
        df.append(np.repeat(often, times))
        text.append(who)
        hot_keys = take("<u8", c)
        at += 8 * c
        hot_df.update(zip(_name(hot_keys, bucket).tolist(), take("<u4", c).tolist(), strict=True))
    n = table.column("n").to_numpy()
    if hot_df and len(hot_token):
        bucket = ((hot_token >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        low = np.zeros((len(hot_token), 8), np.uint8)
        low[:, :KEY_BYTES] = hot_token.view(np.uint8).reshape(-1, 8)[:, 7 - KEY_BYTES : 7]
        name = low.view("<u8").ravel() | (bucket.astype(np.uint64) << np.uint64(8 * KEY_BYTES))
        token.append(np.repeat(name, hot_times))
        df.append(np.repeat(np.array([hot_df[x] for x in name.tolist()], np.uint32), hot_times))
        text.append(hot_text)
    if token:
        token, df, text = (np.concatenate(x) for x in (token, df, text))
    else:
        token, df, text = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    order = np.lexsort((token, df, text))
    token, df, text = token[order], df[order], text[order]
    cuts = np.searchsorted(text, np.arange(len(n) + 1))
    repeated = np.diff(cuts)
    prefix = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
    inside = np.clip(prefix - (n - repeated), 0, None)
    prefixes, often, sets, cells = [None] * len(n), [None] * len(n), [None] * len(n), [None] * len(n)
    for k in np.flatnonzero(inside > 0):
        mine = token[cuts[k] : cuts[k + 1]]
        prefixes[k] = mine[: inside[k]].view(np.int64)
        often[k] = df[cuts[k] : cuts[k] + inside[k]].astype(np.int64)
        sets[k] = np.sort(mine).tobytes()
        cells[k] = np.minimum(np.bincount((textscan.mix(mine, 64) >> np.uint64(58)).astype(np.int64), minlength=CELLS), full).astype("<u2").tobytes()
    return pa.table({
        "doc_id": table.column("id"), "n": table.column("n"), "d0": table.column("d0"), "d1": table.column("d1"),
        "skip": pa.array(n - repeated, pa.int64()), "prefix": pa.array(prefixes, pa.list_(pa.int64())), "often": pa.array(often, pa.list_(pa.int64())), "tokens": pa.array(sets, pa.binary()),
        "cells": pa.array(cells, pa.binary()),
    })


def _name(keys: np.ndarray, bucket: int) -> np.ndarray:
    return keys | np.uint64(bucket << 8 * KEY_BYTES)


def _needed(a, b, percent: int):
    """The least intersection of sets of sizes a and b that reaches the similarity."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def _cross(rows: pa.Table, percent: int, full: int = FULL_CELL) -> pa.Table:
    """Pairs of members of one list in different components that could still link, from pairs of blocks of lists."""
    get = lambda c: rows.column(c).to_numpy()
    block, other = get("block"), get("other")
    keys = (np.maximum(block, other), np.minimum(block, other), get("token"))
    order = np.lexsort(keys)
    col = {c: get(c)[order] for c in ("doc_id", "n", "rep", "pos", "label", "low", "high")}
    cells = np.frombuffer(b"".join(rows.column("cells").to_pylist()), "<u2").reshape(-1, CELLS)[order]
    mine, apart = block[order], (block != other)[order]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    stop = np.append(np.flatnonzero(new)[1:], len(order))[np.cumsum(new) - 1] if len(order) else order
    after = stop - np.arange(len(order)) - 1
    most, out, at, upto = 1 - percent / 100 + 1e-9, [], 0, np.cumsum(after)
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        i = np.repeat(np.arange(at, end), after[at:end])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after[at:end]) - after[at:end], after[at:end])
        at = end
        # Two blocks meet here for pairs across them only; a block's own pairs have their own meeting.
        keep = (col["label"][i] != col["label"][j]) & (col["doc_id"][i] != col["doc_id"][j]) & ((mine[i] != mine[j]) | ~apart[i])
        i, j = i[keep], j[keep]
        a, b = col["n"][i], col["n"][j]
        need = _needed(a, b, percent)
        keep = (100 * a >= percent * b) & (100 * b >= percent * a) & (np.minimum(col["rep"][i], col["rep"][j]) >= need)
        keep &= (col["low"][i] - col["high"][j] <= most) & (col["low"][j] - col["high"][i] <= most)
        i, j, need = i[keep], j[keep], need[keep]
        keep = np.zeros(len(i), bool)
        for k in range(0, len(i), 65536):
            both = np.minimum(cells[i[k : k + 65536]], cells[j[k : k + 65536]])
            keep[k : k + 65536] = (both.sum(axis=1, dtype=np.int64) >= need[k : k + 65536]) | (both >= full).any(axis=1)
        i, j = i[keep], j[keep]
        swap = col["doc_id"][i] > col["doc_id"][j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        out.append(np.stack([col["doc_id"][i], col["doc_id"][j], col["n"][i], col["n"][j], col["pos"][i], col["pos"][j]]))
    got = np.concatenate(out, axis=1) if out else np.zeros((6, 0), np.int64)
    if got.shape[1]:  # a pair that met in several lists goes on once, with its least positions
        rank = np.lexsort((got[4], got[1], got[0]))
        got = got[:, rank]
        first = np.flatnonzero(np.concatenate(([True], np.any(got[:2, 1:] != got[:2, :-1], axis=0))))
        got = np.concatenate([got[:4, first], [np.minimum.reduceat(got[4], first), np.minimum.reduceat(got[5], first)]])
    return pa.table({c: pa.array(got[k].astype(np.int64)) for k, c in enumerate(("a", "b", "a_n", "b_n", "a_pos", "b_pos"))})


def _need_sql(a: str, b: str, percent: int) -> str:
    return f"({percent} * ({a} + {b}) + 99 + {percent}) div {100 + percent}"


def _verify(batches, percent: int):
    for batch in batches:
        a_n, b_n = batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy()
        common_ = np.zeros(batch.num_rows, np.int64)
        held, last = None, None
        for k, (x, y) in enumerate(zip(batch.column("a_tokens"), batch.column("b_tokens"), strict=True)):
            bx = x.as_buffer()
            if last is None or not bx.equals(last):
                held, last = np.frombuffer(bx, "<u8"), bx
            other = np.frombuffer(y.as_buffer(), "<u8")
            # Suffix filter: what lies between pivots of one set bounds what it can share there with the other.
            if len(held) > 64 and len(other) > 64:
                pivots = held[len(held) // 8 :: len(held) // 8]
                p, q = np.searchsorted(held, pivots), np.searchsorted(other, pivots)
                least = np.minimum(np.diff(p, prepend=0, append=len(held)), np.diff(q, prepend=0, append=len(other))).sum()
                if least < _needed(int(a_n[k]), int(b_n[k]), percent):
                    common_[k] = -1 - int(least)
                    continue
            small, large = (held, other) if len(held) <= len(other) else (other, held)
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            common_[k] = int((large[at] == small).sum()) if len(large) else 0
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(a_n, pa.int64()), pa.array(b_n, pa.int64()), pa.array(common_, pa.int64())], ["a", "b", "a_n", "b_n", "shared"])


def _linked(percent: int):
    return F.expr(f"shared >= 0 AND 100 * shared >= {percent} * (a_n + b_n - shared)")


def _distance_bounds():
    """Bounds of 1 - similarity: exact where counted, or what the suffix filter left open."""
    most = F.when(F.col("shared") >= 0, F.col("shared")).otherwise(-1 - F.col("shared"))
    low = 1 - most / (F.col("a_n") + F.col("b_n") - most)
    return low, F.when(F.col("shared") >= 0, low).otherwise(F.lit(1.0))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, full: int = FULL_CELL) -> DataFrame:
    """(doc_id, n, d0, d1, skip, prefix, often, tokens, cells) of each row; the last four only where a prefix may meet another.

    ``often`` has how many documents have each shingle of the prefix.
    """
    common.need_integers(docs, id_col)
    buckets = common.buckets_for(common.text_bytes(docs, text_col))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    sent = rows.mapInArrow(lambda it: _send(it, width, buckets), "block bigint, kind int, bucket int, blob binary")
    answers = sent.groupBy("bucket").applyInArrow(_count, "block bigint, kind int, blob binary")
    schema = "doc_id bigint, n bigint, d0 bigint, d1 bigint, skip bigint, prefix array<bigint>, often array<bigint>, tokens binary, cells binary"
    return answers.groupBy("block").applyInArrow(lambda k, t: _collect(k, t, buckets, percent, full), schema)


def _parted(lists: DataFrame) -> DataFrame:
    """A row for each part of a shingle's list (``parts`` of them), to meet the list's rows on (token, part)."""
    return lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def similarity_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT, full: int = FULL_CELL
) -> DataFrame:
    """One row per document: ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    A document's set holds its distinct runs of ``width`` words (A-Z lower-cased; with fewer words the whole
    sequence). Two documents link when their sets' Jaccard similarity is at least ``percent`` hundredths.

    1. Blocks of texts send packed shingle hashes to buckets, which count the documents of each and send back the
       repeated ones; in rare-first order only prefixes made of repeated shingles can meet others.
    2. Equal sets become one class; classes are indexed by their prefix shingles, with positions.
    3. In each shingle's list all members are checked against one, that with the largest repeated part (a star);
       links give components.
    4. Pairs of one list that lie in different components are checked as well, each pair once. Two members whose
       distances to the list's first member differ by more than the allowed distance cannot link (triangle
       inequality), nor can pairs whose repeated parts, counted in cells of hash space, are smaller than what they
       would have to share (suffix filter), or that fail the length and positional filters. So every link between
       components is found, and no group is written out pair by pair.

    A shingle that very many documents have joins with its list's head in parts of about LIST_PART rows.

    Set members are compared by 48 bits of their hashes or more, whole sets by 128. A null text, or one without
    words, has an empty set and links with nothing. A row without an id links with nothing and has a null
    component. Rows that share an id are one node: each gives a row, with its own set size. Ids must be integers.
    A text of any length is one set. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    sets, sets_path = common.materialize(shingle_sets(docs, id_col, text_col, width, percent, full), "sets")
    nodes = sets.filter("prefix IS NOT NULL AND doc_id IS NOT NULL")
    classes = nodes.groupBy("d0", "d1", "n").agg(F.min("doc_id").alias("rep"))
    member = nodes.select("doc_id", "d0", "d1", "n").join(classes, ["d0", "d1", "n"]).select("doc_id", "rep")
    member, member_path = common.materialize(member, "members")
    first = nodes.groupBy("d0", "d1", "n").agg(F.min_by(F.struct("doc_id", "skip", "prefix", "often", "tokens", "cells"), "doc_id").alias("x"))
    reps, reps_path = common.materialize(first.select("x.*", "n"), "classes")
    tokens = reps.select("doc_id", "n", "tokens")

    index = reps.select("doc_id", "n", "skip", F.posexplode(F.arrays_zip("prefix", "often")).alias("pos", "x"))
    index = index.select(F.col("x.prefix").alias("token"), "doc_id", "n", (F.col("n") - F.col("skip")).alias("rep"), (F.col("skip") + F.col("pos")).alias("pos"), F.expr(f"1 + (x.often - 1) div {LIST_PART}").alias("parts"))
    index = index.withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts"))
    # The first member is the one with the largest repeated part: of a text and its edited copies, the text.
    heads = index.withColumn("alone", 1 - F.col("rep") / F.col("n"))
    heads = heads.groupBy("token", "parts").agg(F.count(F.lit(1)).alias("df"), F.min(F.struct("alone", "doc_id", "n", "rep", "pos")).alias("head")).filter("df > 1")
    lists, lists_path = common.materialize(index.join(_parted(heads), ["token", "part"]).select(index["*"], "head"), "lists")

    star = lists.filter("doc_id <> head.doc_id").groupBy(F.col("head.doc_id").alias("a"), F.col("doc_id").alias("b"))
    star = star.agg(F.min("head.n").alias("a_n"), F.min("n").alias("b_n"))
    stars, stars_path = common.materialize(_compared(star, tokens, percent), "stars")
    # An id whose rows have different sets ties their classes together.
    split = member.groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).filter("x < y").select("doc_id")
    tied = member.join(split, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = stars.filter(_linked(percent)).select("a", "b").unionByName(tied)
    labels, labels_path = components.components(links)

    low, high = _distance_bounds()
    near = stars.select("a", "b", low.alias("low"), high.alias("high"))
    with_label = lists.join(labels, lists["doc_id"] == labels["id"], "left")
    with_label = with_label.select(lists["*"], F.coalesce("label", "doc_id").alias("label"))
    open_ = with_label.groupBy("token", "parts").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("m")).filter("x < y AND m > 2")
    open_ = open_.select("token", "parts", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    rest = with_label.filter("doc_id <> head.doc_id").join(_parted(open_), ["token", "part"])
    rest = rest.join(near, (rest["head.doc_id"] == near["a"]) & (rest["doc_id"] == near["b"]), "left")
    rest = rest.select("token", "doc_id", "n", "rep", "pos", "label", "blocks", F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(1.0)).alias("high"))
    rest = rest.join(reps.select("doc_id", "cells"), "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rest, rest_path = common.materialize(rest, "open-lists")
    groups = int(max(2 * common.shuffle_width(spark), rest.count() // 8192))
    met = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("group", F.pmod(F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other")), F.lit(groups)))
    pairs = met.drop("blocks").groupBy("group").applyInArrow(lambda t: _cross(t, percent, full), "a bigint, b bigint, a_n bigint, b_n bigint, a_pos bigint, b_pos bigint")
    pairs = pairs.groupBy("a", "b").agg(*[F.min(c).alias(c) for c in ("a_n", "b_n", "a_pos", "b_pos")])
    across, across_path = common.materialize(_checked(pairs, tokens, percent).filter(_linked(percent)).select("a", "b"), "links")
    if not across.isEmpty():
        common.discard(spark, labels_path)
        labels, labels_path = components.components(links.unionByName(across))
    place = member.join(labels, member["rep"] == labels["id"], "left").select("doc_id", F.coalesce("label", "rep").alias("component_id"))
    place = place.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    common.discard(spark, lists_path, rest_path, reps_path)
    out = sets.select("doc_id", F.col("n").alias("n_shingles")).join(place, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _checked(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs that pass the length and positional filters, with the size of their intersection.

    The least positions at which a pair met are those of its first shared shingle; what follows there bounds the
    intersection.
    """
    need = F.expr(_need_sql("a_n", "b_n", percent))
    bound = 1 + F.least(F.col("a_n") - F.col("a_pos") - 1, F.col("b_n") - F.col("b_pos") - 1)
    return _compared(pairs.filter((bound >= need) & (F.col("a_n") * 100 >= F.col("b_n") * percent) & (F.col("b_n") * 100 >= F.col("a_n") * percent)), tokens, percent)


def _compared(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs with the size of their intersection, each pair compared once."""
    left = tokens.select(F.col("doc_id").alias("a"), F.col("tokens").alias("a_tokens"))
    right = tokens.select(F.col("doc_id").alias("b"), F.col("tokens").alias("b_tokens"))
    both = pairs.select("a", "b", "a_n", "b_n").join(right, "b").join(left, "a")
    return both.mapInArrow(lambda it: _verify(it, percent), "a bigint, b bigint, a_n bigint, b_n bigint, shared bigint")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that have the smallest id of their component, with all their columns (and rows without an id).

    Rows that repeat a kept id all stay. Columns keep their names and types, whatever they are; an empty table gives
    none. Nulls, long texts and ties are as similarity_components() has them.
    """
    name = common.free_name(docs, "gone")
    gone = similarity_components(docs, id_col=id_col, **options).filter("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[id_col] == gone[name], "left_anti")


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    """All documents with their components of linked texts: see similarity_components."""
    return similarity_components(common.table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS g
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 4, CASE WHEN len(ws) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, low) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT e.y, r.low FROM reach r JOIN edges e ON e.x = r.doc_id WHERE r.low < e.y)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(low) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach ON reach.doc_id = w.doc_id GROUP BY w.doc_id
"""
