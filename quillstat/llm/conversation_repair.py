"""Repair of conversations: the cheapest edits that give a dialogue its form, least audit first, by prefix doubling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Edits in the order of their letters, and what they cost; a kept or reroled row that is truncated costs 1 more.
DELETE, INSERT, KEEP, REROLE = range(4)
LETTERS = b"DIKR"
COSTS = {"delete": 3, "insert": 2, "keep": 0, "rerole": 2, "truncated": 1}

#: States of the form (s?(ua)+)?: nothing yet, after s, after u, after a. What a state becomes by u, a, s (-1: nothing).
STATES = 4
NEXT = np.array([[2, -1, 1], [2, -1, -1], [-1, 3, -1], [2, -1, -1]])
#: A state allows one of u and a at any time, so an inserted or reroled row has one role and one state after it.
TURN = np.where(NEXT[:, 0] >= 0, NEXT[:, 0], NEXT[:, 1])
TURN_ROLE = np.where(NEXT[:, 0] >= 0, 0, 1)
ROLES = ("user", "assistant")
#: Cost and letters from a state after the last row to the end.
TAIL = np.array([0, 4, 2, 0])
TAIL_AUDIT = (b"", b"II", b"I", b"")
FAR = 1 << 40

#: Codes of a row: its role's initial (u, a, s, other) and, times 4, its fault.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)


def _row_arcs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cost, next state) of delete, keep and rerole for each row and state, shaped (rows, states, edits); FAR where there is none."""
    initial, fault = codes & 3, codes >> 2
    n = len(codes)
    cost, to = np.full((n, STATES, 4), FAR, np.int64), np.zeros((n, STATES, 4), np.int64)
    states = np.arange(STATES)
    cost[:, :, DELETE], to[:, :, DELETE] = COSTS["delete"], states
    stays = (fault == FINE) | (fault == TRUNCATED)
    more = np.where(fault == TRUNCATED, COSTS["truncated"], 0)
    kept = np.where(initial[:, None] < 3, NEXT[states[None, :], np.minimum(initial, 2)[:, None]], -1)
    fits = stays[:, None] & (kept >= 0)
    cost[:, :, KEEP] = np.where(fits, COSTS["keep"] + more[:, None], FAR)
    to[:, :, KEEP] = np.maximum(kept, 0)
    cost[:, :, REROLE] = np.where(stays, COSTS["rerole"] + more, FAR)[:, None]
    to[:, :, REROLE] = TURN
    return cost, to


def _insertions(cost: np.ndarray) -> np.ndarray:
    """Costs from states (last axis) when rows may be inserted first; two insertions in a row reach every state."""
    for _ in range(2):
        cost = np.minimum(cost, COSTS["insert"] + cost[..., TURN])
    return cost


class Segments:
    """Runs of rows of conversations, flattened: ``codes`` of all rows and ``first``[k]..``first``[k+1] of segment k."""

    def __init__(self, codes: list[np.ndarray]):
        self.sizes = np.array([len(c) for c in codes], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.codes = np.concatenate([np.zeros(0, np.uint8), *codes]).astype(np.int64)
        self.cost, self.to = _row_arcs(self.codes)
        self.by_size = np.argsort(-self.sizes, kind="stable")

    def _backward(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(segments, their row) from each segment's last row to its first."""
        held = self.sizes[self.by_size]
        for back in range(1, int(held[0]) + 1 if len(held) else 1):
            live = self.by_size[: int(np.searchsorted(-held, -back, "right"))]
            yield live, self.first[live + 1] - back

    def crossing(self) -> np.ndarray:
        """Least cost from each state before a segment to each state after it: (segments, from, to)."""
        out = np.full((len(self.sizes), STATES, STATES), FAR, np.int64)
        out[:, np.arange(STATES), np.arange(STATES)] = 0
        for live, row in self._backward():
            after = out[live]
            best = np.full_like(after, FAR)
            for e in (DELETE, KEEP, REROLE):
                via = np.take_along_axis(after, self.to[row, :, e][:, :, None], 1)
                best = np.minimum(best, self.cost[row, :, e][:, :, None] + via)
            out[live] = _insertions(best.swapaxes(1, 2)).swapaxes(1, 2)
        return np.minimum(out, FAR)

    def to_go(self, end: np.ndarray) -> np.ndarray:
        """Cost to the end of the conversation before each row and after the last: (rows + segments, states), by node."""
        out = np.zeros((len(self.codes) + len(self.sizes), STATES), np.int64)
        out[self.first[1:] + np.arange(len(self.sizes))] = end
        for live, row in self._backward():
            node = row + live
            best = np.full((len(live), STATES), FAR, np.int64)
            for e in (DELETE, KEEP, REROLE):
                best = np.minimum(best, self.cost[row, :, e] + np.take_along_axis(out[node + 1], self.to[row, :, e], 1))
            out[node] = _insertions(best)
        return out

    def audits(self, end: np.ndarray) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
        """The least cheapest audit of each segment from each state before it, the state after it, and the cost from nothing.

        Nodes of the ranking are the arcs on some cheapest path, as (place, state, edit). An arc's first rank is its
        edit; its successor is the least arc that leaves where it ends. Doubling: the rank by 2k edits is that of the
        pair (rank by k, rank by k of the arc k steps on), and pointers are doubled alike, until no path is longer. The least
        arc that leaves a state before the segment, by its final rank, begins the least path, which is read by composing
        the doubled pointers. All paths of a segment end in a row's edit, so none is another's beginning.
        """
        n, places = len(self.sizes), len(self.codes) + len(self.sizes)
        togo = self.to_go(end)
        owner = np.repeat(np.arange(n), self.sizes)
        node = np.arange(len(self.codes)) + owner
        target = np.full((places, STATES, 4), -1, np.int64)  # the (place, state) each arc leads to, -1: not on a cheapest path
        for e in (DELETE, KEEP, REROLE):
            ends = (node + 1)[:, None] * STATES + self.to[:, :, e]
            good = (self.cost[:, :, e] < FAR) & (togo[node] < FAR) & (self.cost[:, :, e] + togo.reshape(-1)[ends] == togo[node])
            target[node, :, e] = np.where(good, ends, -1)
        here = togo[node]
        good = (here < FAR) & (COSTS["insert"] + here[:, TURN] == here)
        target[node, :, INSERT] = np.where(good, node[:, None] * STATES + TURN, -1)
        target = target.reshape(-1, 4)
        on = target >= 0
        number = np.full(target.size, -1, np.int64)  # arcs on cheapest paths are renumbered; one more stands for the end
        arcs = np.flatnonzero(on)
        number[arcs] = np.arange(len(arcs))
        number, stop = number.reshape(-1, 4), len(arcs)
        rank = np.concatenate((arcs % 4 + 1, [0]))

        def least(rank):
            """The least arc that leaves each (place, state), the end where none does."""
            key = np.where(on, rank[number], np.iinfo(np.int64).max)
            best = number[np.arange(len(number)), key.argmin(1)]
            return np.where(on.any(1), best, stop)

        lands = target.reshape(-1)[arcs]
        pointers = [np.concatenate((least(rank)[lands], [stop]))]
        # A path holds each row once, with at most two insertions before it.
        longest = 3 * int(self.sizes.max()) if n else 0
        while (1 << (len(pointers) - 1)) < longest and (pointers[-1] != stop).any():
            far = pointers[-1]
            _, rank = np.unique(rank * (rank.max() + 1) + rank[far], return_inverse=True)
            pointers.append(far[far])
        begin = self.first[:-1] + np.arange(n)
        path = least(rank)[begin[:, None] * STATES + np.arange(STATES)].reshape(-1, 1)
        for p in pointers:  # all paths are read at once: columns double
            path = np.concatenate((path, p[path]), 1)
            if (path[:, -1] == stop).all():
                break
        length = (path != stop).sum(1)
        letters = np.append(np.frombuffer(LETTERS, np.uint8)[arcs % 4], 0)[path].astype(np.uint8)
        texts = [letters[k, : length[k]].tobytes() for k in range(len(path))]
        exits = lands[path[np.arange(len(path)), length - 1]] % STATES
        return [texts[STATES * k : STATES * k + STATES] for k in range(n)], exits.reshape(n, STATES), togo[begin, 0]


def _blank(text: Column) -> Column:
    return ~text.rlike(common.WORD)


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations with planted faults, by CRC-32 of ``conversation:turn`` modulo 20: (conv_id, turn, role, text, lost).

    0 loses the row (it stays here with ``lost``, so that its conversation is known), 1 empties its text, 2 takes its
    ``. ! ?`` away, 3 repeats it, 4 makes it the user's. Nulls count as one space.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(text_of(conv_col), F.lit(":"), text_of(turn_col)).cast("binary")) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text_of(text_col), "[.!?]", "")).otherwise(text_of(text_col))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.when(hit == 4, "user").otherwise(text_of(role_col)).alias("role"), text.alias("text"), (hit == 0).alias("lost"), F.when(hit == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("copy", "times")


def _mark() -> Column:
    """What tells equal rows of a conversation: SHA-256 of role and text, the role's length first."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))


def _summaries(batches):
    """Segments of sorted rows: their codes, the costs of crossing them, and their counts."""
    for b in batches:
        if not b.num_rows:
            continue
        rows, seen = b.column("rows"), b.column("firsts").flatten().to_numpy()
        flat, first = rows.flatten(), np.asarray(rows.offsets) - rows.offsets[0].as_py()
        order, initial = flat.field("ord").to_numpy(), flat.field("initial").to_numpy().astype(np.int64)
        blank, cut = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("blank", "cut"))
        again = ~np.isin(order, seen)
        fault = np.where(blank, BLANK, np.where(again, DUPLICATE, np.where(cut, TRUNCATED, FINE)))
        codes = (initial + 4 * fault).astype(np.uint8)
        begins = np.zeros(len(codes), bool)
        begins[first[:-1]] = True
        pair = np.concatenate(([0], initial[:-1] * 4 + initial[1:]))
        illegal = ~np.isin(pair, [2 * 4 + 0, 0 * 4 + 1, 1 * 4 + 0]) & ~begins
        turn = flat.field("turn")
        known = np.asarray(turn.is_valid())
        value = turn.fill_null(0).to_numpy()
        before = np.concatenate(([0], value[:-1])), np.concatenate(([False], known[:-1]))
        new = known & (begins | ~before[1] | (value != before[0]))
        add = lambda x: np.add.reduceat(x.astype(np.int64), first[:-1])
        counts = [add(fault == k) for k in (BLANK, DUPLICATE, TRUNCATED)] + [add(illegal), add(new)]
        ends = first[1:] - 1
        lost = first[:-1] + add(~known)  # nulls come first
        low = pa.array(value[np.minimum(lost, ends)], mask=lost > ends)
        head_turn, tail_turn = pa.array(value[first[:-1]], mask=~known[first[:-1]]), pa.array(value[ends], mask=~known[ends])
        crossing = Segments([codes[a:z] for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]).crossing()
        packed = pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(codes)])
        yield pa.RecordBatch.from_arrays(
            [
                b.column("conv_id"), b.column("piece"), b.column("turn"), b.column("mark"), packed, pa.array(list(crossing.reshape(b.num_rows, -1)), pa.list_(pa.int64())),
                *(pa.array(c) for c in counts), low, pa.array(initial[first[:-1]]), pa.array(initial[ends]), head_turn, tail_turn,
            ],
            ["conv_id", "piece", "turn", "mark", "codes", "crossing", *_COUNTS],
        )


_COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns", "low", "head", "tail", "head_turn", "tail_turn"]


def _ends(batches):
    """Costs to a conversation's end after each segment, from its last segment to its first."""
    conv, end = object(), None
    for b in batches:
        out = []
        for c, crossing in zip(b.column("conv_id").to_pylist(), b.column("crossing").to_numpy(zero_copy_only=False), strict=True):
            if c != conv:
                conv, end = c, TAIL
            out.append(end)
            end = (crossing.reshape(STATES, STATES) + end).min(1)
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("piece"), pa.array(out, pa.list_(pa.int64()))], ["conv_id", "piece", "after"])


def _audits(batches, rows_at_once: int = 1 << 15):
    """Audits of segments from every state before them; segments of like size are ranked together."""
    for b in batches:
        codes = [np.frombuffer(c, np.uint8) for c in b.column("codes").to_pylist()]
        after = np.array(b.column("after").to_pylist(), np.int64).reshape(-1, STATES)
        texts, exits, cost = [None] * len(codes), np.zeros((len(codes), STATES), np.int64), np.zeros(len(codes), np.int64)
        order, a = sorted(range(len(codes)), key=lambda k: len(codes[k])), 0
        while a < len(order):
            z, held = a, 0
            while z < len(order) and (z == a or held + len(codes[order[z]]) <= rows_at_once):
                held += len(codes[order[z]])
                z += 1
            some = order[a:z]
            found, exits[some], cost[some] = Segments([codes[k] for k in some]).audits(after[some])
            for k, t in zip(some, found, strict=True):
                texts[k] = t
            a = z
        made = [pa.array(texts, pa.list_(pa.binary())), pa.array(list(exits), pa.list_(pa.int64())), pa.array(cost)]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "piece", "turn", "mark", *_COUNTS)), *made], ["conv_id", "piece", "turn", "mark", *_COUNTS, "audits", "exits", "cost"])


def _followed(batches) -> Iterator[tuple[str, dict | None, int]]:
    """What happens in sorted conversations, as (event, row, state before it): ``begin``, ``segment``, an edit's letter for each
    row, ``I`` for rows put in, ``end``. Held at a time: one batch of rows, and the segments that begin at one place."""
    queue, audit, at, state, begun = [], b"", 0, 0, False

    def closing():
        s = state
        for _ in TAIL_AUDIT[s]:
            yield "I", None, s
            s = int(TURN[s])
        yield "end", None, s

    for b in batches:
        for row in b.to_pylist():
            if row["kind"] == 0:
                if begun:
                    yield from closing()
                queue, at, state, begun = [], 0, 0, True
                yield "begin", row, state
                continue
            if row["kind"] == 1:
                queue.append(row)
                continue
            if at == 0:
                audit = queue[0]["audits"][state]
                yield "segment", queue[0], state
            while audit[at : at + 1] == b"I":
                yield "I", None, state
                state, at = int(TURN[state]), at + 1
            edit = chr(audit[at])
            yield edit, row, state
            state = int(TURN[state]) if edit == "R" else int(NEXT[state, "uas".index(row["role"][0])]) if edit == "K" else state
            at += 1
            if at == len(audit):
                queue.pop(0)
                at = 0
    if begun:
        yield from closing()


def _reports(batches):
    out, names = [], ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    for event, row, state in _followed(batches):
        if event == "begin":
            conv, sha, lines, audit, last, low, high, turns, cost = row["conv_id"], hashlib.sha256(), 0, [], None, None, None, 0, 0
            counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        elif event == "segment":
            cost = row["cost"] if last is None else cost
            for k in counts:
                counts[k] += row[k]
            if last:
                counts["illegal"] += (last["tail"], row["head"]) not in ((2, 0), (0, 1), (1, 0))
                turns -= row["head_turn"] is not None and last["tail_turn"] == row["head_turn"]
            turns += row["turns"]
            low = row["low"] if low is None else low
            high = row["tail_turn"] if row["tail_turn"] is not None else high
            last = row
        elif event == "end":
            gaps = 0 if low is None else high - low + 1 - turns
            out.append((conv, gaps, *counts.values(), cost, "".join(audit), sha.hexdigest()))
            if len(out) == 4096:
                yield _batch(out, names)
                out = []
        else:
            audit.append(event)
            if event != "D":
                role = row["role"] if event == "K" else ROLES[TURN_ROLE[state]]
                sha.update((("\n" if lines else "") + role + ":" + (row["text"] if row else "")).encode())
                lines += 1
    if out:
        yield _batch(out, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"conv_id": None, "turn": pa.int64(), "text": pa.string(), "role": pa.string(), "edit": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(n)) for k, n in enumerate(names)], names)


def _turns(batches):
    out, names = [], ["conv_id", "position", "role", "text", "edit", "turn"]
    for event, row, state in _followed(batches):
        if event == "begin":
            conv, position = row["conv_id"], 0
        elif event in ("K", "R", "I"):
            role = row["role"] if event == "K" else ROLES[TURN_ROLE[state]]
            out.append((conv, position, role, row["text"] if row else "", event, row["turn"] if row else None))
            position += 1
            if len(out) == 4096:
                yield _batch(out, names)
                out = []
    if out:
        yield _batch(out, names)


#: Rows of a conversation that make a segment at most: 2^SEGMENT_BITS.
SEGMENT_BITS = 16


class Repairs:
    """Cheapest repairs of conversations: ``report`` and ``turns``. Made by plan_repairs."""

    def __init__(self, rows: DataFrame, segments: DataFrame):
        self.rows, self.segments = rows, segments

    def _stream(self) -> DataFrame:
        """All rows by conversation in order, each segment's edits before its first row, a row of the name alone before all."""
        body = self.rows.filter(~F.col("lost")).select("conv_id", F.col("turn").cast("long").alias("turn"), _mark().alias("mark"), F.lit(2).alias("kind"), "role", "text")
        name = self.rows.select("conv_id").distinct().withColumn("kind", F.lit(0))
        stream = self.segments.withColumn("kind", F.lit(1)).unionByName(body, allowMissingColumns=True).unionByName(name, allowMissingColumns=True)
        order = [F.asc_nulls_first("conv_id"), F.col("kind") > 0, F.asc_nulls_first("turn"), "mark", "kind", "piece"]
        return stream.repartition(common.shuffle_width(self.rows.sparkSession), "conv_id").sortWithinPartitions(*order)

    def report(self) -> DataFrame:
        """One row a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (see plan_repairs).

        The digest of a conversation takes its texts in order, so one task reads them, a batch of rows at a time.
        """
        kind = self.rows.schema["conv_id"].dataType.simpleString()
        return self._stream().mapInArrow(_reports, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")

    def turns(self) -> DataFrame:
        """The repaired conversations: (conv_id, position, role, text, edit, turn); rows put in have no turn."""
        kind = self.rows.schema["conv_id"].dataType.simpleString()
        return self._stream().mapInArrow(_turns, f"conv_id {kind}, position long, role string, text string, edit string, turn long")


def plan_repairs(rows: DataFrame, segment_bits: int = SEGMENT_BITS) -> Repairs:
    """The cheapest edits that give each conversation the form (s?(ua)+)? of its roles' initials.

    ``rows`` are (conv_id, turn, role, text, lost); roles and texts are not null, rows ``lost`` only name their conversation.
    A conversation's rows go by turn (nulls first); rows with one turn by the SHA-256 of role and text. A row's first fault counts: blank (no word), duplicate
    (role and text stood earlier), truncated (its last character but for white space is none of . ! ?). Keep costs 0, rerole to
    user or assistant 2, delete 3 (the only edit of blank and duplicate rows), insert an empty row of user or assistant 2;
    truncated rows that stay add 1. Of the cheapest edits those with the ASCII-least audit are taken. A role that doesn't
    begin with s, u or a, or an empty one, can't be kept.

    Rows without texts are dealt by ranges and cut into segments of 2^segment_bits rows at most, so a conversation of any
    length is worked on by many tasks: each segment gives the costs of crossing it from state to state, a scan over segments gives the
    costs after each, and then every segment's least audits are found by prefix doubling (see Segments.audits). A state
    allows one role, so one audit leads to one state and segments join by their states.

    A null conv_id is a conversation of its own, rows repeated in all columns are duplicates, a text of any length is one
    row, other columns are ignored, an empty table gives no rows.
    """
    spark = rows.sparkSession
    initial = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("u", 0, "a", 1, "s", 2)]), F.substring("role", 1, 1)), F.lit(3))
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    thin = rows.filter(~F.col("lost")).select("conv_id", F.col("turn").cast("long").alias("turn"), _mark().alias("mark"), initial.alias("initial"), _blank(F.col("text")).alias("blank"), cut.alias("cut"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("mark")]
    dealt = thin.withColumn("read", F.monotonically_increasing_id()).repartitionByRange(max(2 * common.shuffle_width(spark), 8), *order, "read")
    # Numbers given after sorting rise within a range and from range to range.
    placed, _ = common.materialize(dealt.drop("read").sortWithinPartitions(*order).withColumn("ord", F.monotonically_increasing_id()), "turns")
    piece = F.shiftright("ord", segment_bits).alias("piece")
    firsts = placed.groupBy("conv_id", "mark").agg(F.min("ord").alias("ord")).select("conv_id", piece, F.col("ord").alias("first"))
    entries = placed.select("conv_id", piece, F.struct("ord", "turn", "initial", "blank", "cut").alias("row"), F.struct("ord", "turn", "mark").alias("head"))
    segments = entries.unionByName(firsts, allowMissingColumns=True).groupBy("conv_id", "piece")
    segments = segments.agg(F.sort_array(F.collect_list("row")).alias("rows"), F.collect_list("first").alias("firsts"), F.min("head").alias("head"))
    segments = segments.select("conv_id", "piece", F.col("head.turn").alias("turn"), F.col("head.mark").alias("mark"), "rows", "firsts")
    kind = rows.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    summed, _ = common.materialize(segments.mapInArrow(_summaries, f"conv_id {kind}, piece long, turn long, mark binary, codes binary, crossing array<long>, {counts}"), "segments")
    backward = summed.select("conv_id", "piece", "crossing").repartition(common.shuffle_width(spark), "conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.desc("piece"))
    after = backward.mapInArrow(_ends, f"conv_id {kind}, piece long, after array<long>").withColumnsRenamed({"conv_id": "__conv", "piece": "__piece"})
    joined = summed.join(after, summed["conv_id"].eqNullSafe(after["__conv"]) & (summed["piece"] == after["__piece"])).drop("__conv", "__piece", "crossing")
    audits = joined.mapInArrow(_audits, f"conv_id {kind}, piece long, turn long, mark binary, {counts}, audits array<binary>, exits array<long>, cost long")
    return Repairs(rows, audits)


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """All conversations with planted faults, their cheapest repairs and what they were: see damaged and plan_repairs."""
    return plan_repairs(damaged(common.table(spark, sf_dir, "conversations"))).report()


def _sql() -> str:
    """The same by a recursion over rows: the least (cost, audit, lines) that ends in each state."""

    def step(x, cost, letter, line=None):
        lines = f"list_append({x}.o, {line})" if line else f"{x}.o"
        return f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'a': concat({x}.a, '{letter}'), 'o': {lines}}} END"

    def best(*x):
        return f"list_min([{', '.join(x)}])"

    user, assistant = "'user:'", "'assistant:'"
    to_u = best("s2", *(step(f"s{k}", 2, "I", user) for k in (0, 1, 3)))
    row = "concat(role, ':', text)"
    stays = "fault IN ('', 't')"
    more = "CASE WHEN fault = 't' THEN 1 ELSE 0 END"
    kept = lambda x, i: f"CASE WHEN {stays} AND initial = '{i}' THEN {step(x, more, 'K', row)} END"
    role = lambda x, r: f"CASE WHEN {stays} THEN {step(x, f'2 + {more}', 'R', f'concat({r}, text)')} END"
    return rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS key FROM conversations),
h AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(key, ''), lambda x: ascii(x)::UBIGINT)),
           lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)::UBIGINT[]), lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT) % 20 AS hit FROM k),
d AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(role), ':', role, text))) AS i FROM d),
r AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial,
         CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
              WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 't' ELSE '' END AS fault,
         concat(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i), left(role, 1)) AS pair FROM o),
g AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id),
c AS (SELECT DISTINCT conv_id FROM conversations),
p AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'o': []::VARCHAR[]}} AS s0, NULL::STRUCT(c INTEGER, a VARCHAR, o VARCHAR[]) AS s1,
         NULL::STRUCT(c INTEGER, a VARCHAR, o VARCHAR[]) AS s2, NULL::STRUCT(c INTEGER, a VARCHAR, o VARCHAR[]) AS s3 FROM c
  UNION ALL
  SELECT conv_id, i, {step("x0", 3, "D")}, {best(step("x1", 3, "D"), kept("x0", "s"))},
         {best(step("x2", 3, "D"), *(f("x%d" % k, *a) for k in (0, 1, 3) for f, a in ((kept, ("u",)), (role, (user,)))))},
         {best(step("x3", 3, "D"), kept("x2", "a"), role("x2", assistant))}
  FROM (
    SELECT conv_id, i, role, text, initial, fault, s0 AS x0, s1 AS x1, u2 AS x2, {best("s3", step("u2", 2, "I", assistant))} AS x3
    FROM (SELECT r.*, s0, s1, s3, {to_u} AS u2 FROM p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1))),
e AS (
  SELECT p.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
         coalesce(illegal, 0) AS illegal, s0, s3, {to_u} AS u2
  FROM p LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id WHERE p.i = coalesce(g.n, 0)),
z AS (SELECT *, {best("s0", "s3", step("u2", 2, "I", assistant))} AS f FROM e)
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, CAST(f.c AS BIGINT) AS cost, f.a AS audit, sha256(array_to_string(f.o, chr(10))) AS repaired_sha256
FROM z
"""


OP11_SQL = _sql()
