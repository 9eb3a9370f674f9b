"""Sharding by k-d tree partitioning over document metadata."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHARDS = 24
#: Each metadata dimension is read in this many steps, and so is each digit of a text's or id's hash.
STEPS = 4096
#: Dimensions of a text: the size's logarithm, and the place of its source and language in code-point order.
DIMENSIONS = ("by_size", "by_source", "by_lang")
#: Texts that share a step are told apart by two digits of their hash.
TIES = ("by_text", "by_rest")
#: A text with copies that have more than this part of a shard's bytes (or of all rows over all shards) is placed by name.
LARGE = 1 / 256
#: Parts of a source's or language's rows in which they meet their rank, where there are too many names to broadcast.
SALTS = 16


@dataclass
class Bundle:
    """The copies of one large text, or those of them whose id digit lies in ``lo`` to ``hi``; ``parts`` (bytes by id
    digit) is known of texts that may be cut."""

    key: int
    steps: tuple[int, ...]
    weight: float
    lo: int = 0
    hi: int = STEPS
    parts: np.ndarray | None = None

    def cut(self, most: float) -> tuple[Bundle | None, Bundle | None]:
        """The part that comes nearest to ``most`` bytes, and what is left."""
        if self.parts is None:
            return None, self
        upto = np.cumsum(self.parts[self.lo : self.hi])
        k = int(np.searchsorted(upto, most, "right"))
        if k < len(upto) and most - (upto[k - 1] if k else 0) > upto[k] - most:
            k += 1
        if not 0 < k < len(upto):
            return (self, None) if k else (None, self)
        at, left = self.lo + k, float(upto[k - 1])
        return Bundle(self.key, self.steps, left, self.lo, at, self.parts), Bundle(self.key, self.steps, self.weight - left, at, self.hi, self.parts)


@dataclass
class Node:
    """A leaf of the tree while it grows: it will hold ``shards`` shards, the first of them ``first``."""

    first: int
    shards: int
    bundles: list[Bundle] = field(default_factory=list)
    axis: int = 0
    cut: tuple[int, ...] = ()
    left: Node | None = None
    right: Node | None = None

    def leaves(self) -> list[Node]:
        return [self] if self.left is None else self.left.leaves() + self.right.leaves()

    def below(self) -> Column:
        """Whether a text of this node lies left of its cut."""
        out = F.lit(False)
        for name, value in reversed(list(zip((DIMENSIONS[self.axis], *TIES), self.cut, strict=False))):
            out = (F.col(name) < value) | ((F.col(name) == value) & out)
        return out


def _places(docs: DataFrame, column: str, name: str, salt: Column) -> DataFrame:
    """``docs`` with the step, by rank among the distinct values in code-point order (null last), of a column."""
    names = docs.select(F.col(column).alias("__name")).distinct().withColumns({"__last": F.col("__name").isNull(), "__one": F.lit(1).cast("bigint")})
    alone = common.few(names)
    ranked = common.running(names, ["__last", "__name"], {"__rank": "__one"}, alone, "names")
    ranked = common.beside(ranked, alone, __total=F.count(F.lit(1)))
    if not alone:
        ranked, _ = common.materialize(ranked, "ranks")
    step = F.floor(F.col("__rank") * STEPS / F.col("__total")).cast("int")
    ranked = ranked.select("__name", step.alias(name))
    if alone:
        return docs.join(F.broadcast(ranked), docs[column].eqNullSafe(ranked["__name"])).drop("__name")
    ranked = ranked.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    docs = docs.withColumn("__salt", salt)
    return docs.join(ranked, docs[column].eqNullSafe(ranked["__name"]) & (docs["__salt"] == ranked["__salt"])).drop("__name", "__salt")


def metadata(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """id, size, checksum, the text's hash, steps of source and language, and the row's own hash, written once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        common.hash60(text).alias("key"),
        F.col(source_col).alias("source"),
        F.col(lang_col).alias("lang"),
    )
    salt = F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).cast("int")
    rows = _places(_places(rows, "source", "by_source", salt), "lang", "by_lang", salt)
    # Rows without an id are told apart by where they are written.
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    rows = rows.withColumn("h", common.hash60(F.concat(own, F.lit("/shard"))))
    return common.materialize(rows.select("doc_id", "size", "text_crc32", "key", "by_source", "by_lang", "h"), "metadata")[0]


def _digit(column: str, k: int) -> Column:
    """The k-th run of 12 bits of a 60-bit hash, from the top."""
    return (F.shiftright(column, 48 - 12 * k) % STEPS).cast("int")


def texts(rows: DataFrame) -> DataFrame:
    """One row for each distinct text: its copies' bytes and number, steps, and digits of its hash.

    Copies may have several sources and languages; the text takes the first of each.
    """
    every = rows.groupBy("key").agg(F.min("size").alias("size"), F.min("by_source").alias("by_source"), F.min("by_lang").alias("by_lang"), F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"))
    every, path = common.materialize(every, "texts")
    ends = every.agg(F.min("size"), F.max("size")).first()
    if ends[0] is None or ends[0] == ends[1]:
        step = F.lit(0)
    else:
        lo, hi = float(np.log2(ends[0])), float(np.log2(ends[1]))
        step = F.floor((F.log2(F.col("size").cast("double")) - lo) / (hi - lo) * (STEPS - 1))
    return every.withColumns({"by_size": F.greatest(F.lit(0), F.least(F.lit(STEPS - 1), step)).cast("int"), "by_text": _digit("key", 0), "by_rest": _digit("key", 1)})


def _sides(node: Node, small: np.ndarray, goal: float) -> tuple[list[Bundle], list[Bundle], float]:
    """Which of a node's bundles lie left of its weighted median (those at it, as they fit), and bytes that small texts owe."""
    mine = sorted(node.bundles, key=lambda b: (b.steps[node.axis], -b.weight, b.key, b.lo))
    steps = np.array([b.steps[node.axis] for b in mine], np.int64)
    every = small + np.bincount(steps, [b.weight for b in mine], minlength=STEPS) if mine else small
    at = min(int(np.searchsorted(np.cumsum(every), goal, "right")), STEPS - 1)
    left = [b for b in mine if b.steps[node.axis] < at]
    right = [b for b in mine if b.steps[node.axis] > at]
    room = goal - sum(b.weight for b in left) - float(small[:at].sum())
    for b in (b for b in mine if b.steps[node.axis] == at):
        a, z = (b, None) if b.weight <= room else b.cut(room)
        left, right = left + [a] * (a is not None), right + [z] * (z is not None)
        room -= a.weight if a else 0.0
    owed = goal - sum(b.weight for b in left)
    if owed > small.sum():  # too few small texts are left: more bundles go left where they fit
        spare = owed - float(small.sum())
        for b in sorted(right, key=lambda b: (-b.weight, b.key, b.lo)):
            a, z = (b, None) if b.weight <= spare else b.cut(spare) if spare > 0 else (None, b)
            if a is not None:
                right = [x for x in right if x is not b] + [z] * (z is not None)
                left, spare = [*left, a], spare - a.weight
        _balance(left, right, spare)
        owed = goal - sum(b.weight for b in left)
    return left, right, owed


def _balance(left: list[Bundle], right: list[Bundle], spare: float) -> None:
    """Swaps bundles whose difference comes nearest to what the left side lacks, while that brings it nearer its goal."""
    for _ in range(len(left) + len(right)):
        a = np.array([0.0, *sorted(b.weight for b in left)])
        b = np.array([0.0, *sorted(b.weight for b in right)])
        want = a + spare
        k = np.searchsorted(b, want)
        near = np.stack([np.minimum(k, len(b) - 1), np.maximum(k - 1, 0)])
        off = np.abs(b[near] - want)
        side, at = np.unravel_index(int(off.argmin()), off.shape)
        if off[side, at] >= abs(spare) - 1e-6:
            return
        x = next((v for v in left if a[at] and v.weight == a[at]), None)
        y = next((v for v in right if b[near[side, at]] and v.weight == b[near[side, at]]), None)
        left[:] = [v for v in left if v is not x] + [y] * (y is not None)
        right[:] = [v for v in right if v is not y] + [x] * (x is not None)
        spare += (x.weight if x else 0.0) - (y.weight if y else 0.0)


def grow(small: DataFrame, bundles: list[Bundle], shards: int, share: float) -> tuple[Node, DataFrame]:
    """Splits the widest dimension of every open node at its weighted median, all nodes of a level at once.

    A node for k shards is cut where k div 2 of k parts of its bytes lie below. Histograms of bytes over steps come
    from Spark (at most nodes x dimensions x STEPS rows), the cut's step is refined by the texts' hash digits. Bundles
    are known by name, so they are set to a side first and small texts make up the balance. Returns the tree and the
    small texts with their leaf's first shard as ``node``, a table that every level writes anew.
    """
    root, old = Node(0, shards, bundles), None
    here, path = common.materialize(small.select("key", "w", *DIMENSIONS, *TIES, F.lit(0).alias("node")), "level")
    while todo := {x.first: x for x in root.leaves() if x.shards > 1}:
        if old:
            here, new = common.materialize(here.withColumn("node", _moved(old)), "level")
            common.discard(small.sparkSession, path)
            path = new
        old = todo
        long = here.filter(F.col("node").isin(list(todo))).select("node", "w", F.explode(F.array(*[F.struct(F.lit(k).alias("d"), F.col(c).alias("step")) for k, c in enumerate(DIMENSIONS)])).alias("x"))
        got = long.groupBy("node", "x.d", "x.step").agg(F.sum("w").alias("w")).collect()
        hist = {x: np.zeros((len(DIMENSIONS), STEPS)) for x in todo}
        for r in got:
            hist[r["node"]][r["d"], r["step"]] = r["w"]
        owed: dict[int, float] = {}
        for x in todo.values():
            seen = hist[x.first] > 0
            for b in x.bundles:
                seen[range(len(DIMENSIONS)), b.steps] = True
            wide = [int(np.ptp(np.flatnonzero(s))) if s.any() else 0 for s in seen]
            x.axis = int(np.argmax(wide))
            h = hist[x.first][x.axis]
            half = x.shards // 2
            goal = (float(h.sum()) + sum(b.weight for b in x.bundles)) * half / x.shards
            left, right, owed[x.first] = _sides(x, h, goal)
            x.left, x.right = Node(x.first, half, left), Node(x.first + half, x.shards - half, right)
        tables = {n: hist[n][x.axis] for n, x in todo.items()}
        for depth in range(1 + len(TIES)):
            asked = {}
            for n, h in tables.items():
                x, upto = todo[n], np.cumsum(h)
                at = int(np.searchsorted(upto, owed[n], "right"))
                rest = owed[n] - (float(upto[at - 1]) if at else 0.0)
                if at == len(h) or rest <= 0:
                    x.cut += (at,)
                elif depth == len(TIES) or h[at] <= share / STEPS:
                    x.cut += (at + int(rest > h[at] / 2),)  # the nearer side
                else:
                    x.cut += (at,)
                    asked[n], owed[n] = x, rest
            if not asked:
                break
            names = [(DIMENSIONS[x.axis], *TIES) for x in asked.values()]
            inside, value = F.lit(False), F.lit(None).cast("int")
            for (n, x), mine in zip(asked.items(), names, strict=True):
                at = F.col("node") == n
                for name, v in zip(mine, x.cut, strict=False):
                    at = at & (F.col(name) == v)
                inside, value = inside | at, F.when(F.col("node") == n, F.col(mine[len(x.cut)])).otherwise(value)
            got = here.filter(inside).withColumn("v", value).groupBy("node", "v").agg(F.sum("w").alias("w")).collect()
            tables = {n: np.zeros(STEPS) for n in asked}
            for r in got:
                tables[r["node"]][r["v"]] = r["w"]
    return root, here.withColumn("node", _moved(old)) if old else here


def _moved(nodes: dict[int, Node]) -> Column:
    """The node of a text after the nodes are cut: their left child has their number."""
    out = F.col("node")
    for x in nodes.values():
        out = F.when((F.col("node") == x.first) & ~x.below(), F.lit(x.right.first)).otherwise(out)
    return out


def shard_by_kd_tree(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    shards: int = SHARDS, large_part: float = LARGE,
) -> DataFrame:
    """A shard for each document: leaves of a k-d tree over metadata, near equal in bytes (law ``bytes``).

    Size is the text's UTF-8 bytes (null: none) plus 8. The points of the tree are distinct texts, weighted by their
    copies' bytes, so equal texts lie in one shard; only a text whose copies exceed a shard's share is dealt to several,
    by a hash of the id. Shards are leaves, numbered in tree order; ``slot`` numbers a shard's rows from 0 without
    gaps, in the order of a hash of the id.

    Dimensions are the size's logarithm and the rank of source and language among their distinct names, null last; a
    text takes the first of its copies'. A null text counts as empty. Rows without an id are rows of their own, told
    apart by where they are written; rows repeating an id and a text stay together. A very long text is one point and
    makes its shard as large as itself at least. Other columns are ignored, whatever their names; an empty table
    gives no rows. Only metadata (some 60 bytes a row) is shuffled, never texts. Column functions only, no Python on
    executors; texts with a large share (at most 2 * shards / ``large_part`` of them) are placed on the driver and broadcast.
    """
    spark = docs.sparkSession
    rows = metadata(docs, id_col, text_col, source_col, lang_col)
    every = texts(rows)
    whole = every.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    share, count = (whole["w"] or 0) / shards, whole["n"] or 0
    large = (F.col("w") > share * large_part) | (F.col("n") > count * large_part / shards)
    named = every.filter(large).select("key", "w", "n", *DIMENSIONS).collect()
    bundles = {r["key"]: Bundle(r["key"], tuple(r[d] for d in DIMENSIONS), float(r["w"])) for r in named}
    cut = [r["key"] for r in named if r["w"] > share and r["n"] > 1]
    if cut:
        parts = rows.filter(F.col("key").isin(cut)).groupBy("key", _digit("h", 0).alias("at")).agg(F.sum("size").alias("w")).collect()
        for k in cut:
            bundles[k].parts = np.zeros(STEPS)
        for r in parts:
            bundles[r["key"]].parts[r["at"]] = r["w"]
    tree, small = grow(every.filter(~large), list(bundles.values()), shards, share)
    placed = [(b.key, b.lo, b.hi, leaf.first) for leaf in tree.leaves() for b in leaf.bundles]
    by_name = F.broadcast(spark.createDataFrame(placed, "key bigint, lo int, hi int, shard int"))
    alone = rows.join(F.broadcast(by_name.select("key").distinct()), "key", "left_anti")
    small = small.select("key", F.col("node").alias("shard"))
    at = _digit("h", 0)
    together = rows.join(by_name, "key").filter((at >= F.col("lo")) & (at < F.col("hi"))).drop("lo", "hi")
    placed = alone.join(small, "key").unionByName(together).withColumn("one", F.lit(1).cast("bigint")).withColumn("piece", at)
    placed = common.bucketed_running(placed, ["shard"], "piece", ["h", "doc_id", "text_crc32", "size"], {"slot": "one"})
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_kd_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes: see shard_by_kd_tree."""
    return shard_by_kd_tree(common.table(spark, sf_dir, "documents"))
