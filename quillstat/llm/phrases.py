"""Collocations: frequent phrases counted in tiles of word-rank pairs, scored at their weakest cut."""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, textscan

#: Words of the longest phrase; least count of a candidate; candidates listed for each language.
LONGEST = 5
LEAST = 100
TOP = 2000

#: A tile covers 2^6 x 2^6 ranks; with so many entries or more it is counted in a dense array, else as sorted COO.
SIDE_BITS = 6
CELL_BITS = 2 * SIDE_BITS
DENSE = 1 << (CELL_BITS - 3)
#: Bytes of text scanned together, and of an Arrow batch that Spark hands to a task.
SLICE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
#: Entries a task gathers before it combines them, distinct ones before it sends them on, and those of a batch sent.
GATHER = 1 << 19
FLUSH = 1 << 19
SENT = 1 << 17
#: Distinct words before a task sends them on.
WORDS = 1 << 18
#: Text whose pairs make one bucket, about (a task holds one bucket's distinct pairs), and the fewest buckets.
BUCKET_BYTES = 4 << 20
LEAST_BUCKETS = 256
#: Symbols (words or phrases of one length) that get ranks; all others go by their hashes. Bits of the filter that
#: tells frequent ones among the others.
RANKED = 1 << 20
FILTER_BITS = 27

_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09]] = True
_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BASE = np.uint64(0xA24BAED4963EE407)
_FAR = np.uint64((1 << 32) - 1)


@contextmanager
def small_batches(spark, size: int = BATCH_BYTES):
    """Limits the bytes, not only the rows, of Arrow batches of jobs that start inside; the session's own setting returns after them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Pieces(textscan.Words):
    """Words of a slice as in textscan, with ``linked``[k] telling whether word k + 1 follows word k in the same piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        cut = _CUT[data]
        word = ~(_GAP[data] | cut)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before, after = np.zeros_like(word), np.zeros_like(word)
        before[1:], after[:-1] = word[:-1], word[1:]
        self.starts = np.flatnonzero(word & ~(before & ~edge[:-1]))
        self.ends = np.flatnonzero(word & ~(after & ~edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        cuts = np.zeros(len(cut) + 1, np.int32 if len(cut) < 1 << 31 else np.int64)
        np.cumsum(cut, out=cuts[1:])
        self.linked = np.zeros(len(self.starts), bool)
        self.linked[:-1] = cuts[self.starts[1:]] == cuts[self.ends[:-1]]
        last = self.first[1:] - 1
        self.linked[last[self.counts > 0]] = False

    def texts(self, which: np.ndarray) -> pa.Array:
        """These words in lower case as an Arrow array."""
        size = self.ends[which] - self.starts[which]
        bounds = np.concatenate(([0], np.cumsum(size)))
        data = textscan._LOWER[self.data[np.repeat(self.starts[which] - bounds[:-1], size) + np.arange(bounds[-1])]]
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(which), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
        return whole.cast(pa.large_string()).cast(pa.string())


def _scan(batches, row_cap: int = 0):
    """(Pieces, hashes of its words in their language, language of each text) of every slice of (lang, text) batches."""
    salts: dict[str, int] = {}
    for b in batches:
        langs = b.column("lang").to_pylist()
        for lang in set(langs) - salts.keys():
            salts[lang] = int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")
        salt = np.array([salts[x] for x in langs], np.uint64)
        for i, j, data, offsets in textscan.slices(b.column("text"), SLICE_BYTES):
            pieces = Pieces(data, offsets)
            if len(pieces.starts):
                hashes = textscan.mix(pieces.hashes(lower=True) ^ np.repeat(salt[i:j], pieces.counts), 3)
                yield pieces, hashes, langs[i:j]


def joined_hash(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The symbol of a phrase made of a phrase and a word."""
    return textscan.mix(left * _BASE + word, 5)


def words_of(docs: DataFrame) -> DataFrame:
    """(lang, word, h, f): occurrences of each word of each language; the row without a word has the language's total."""

    def count(batches):
        known, at, counts, out = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        totals: dict[str, int] = {}

        def flush():
            where = np.concatenate([x[2] for x in out]) if out else np.zeros(0, np.uint64)
            langs = pa.concat_arrays([x[0] for x in out] + [pa.array(list(totals), pa.string())])
            texts = pa.concat_arrays([x[1] for x in out] + [pa.nulls(len(totals), pa.string())])
            sums = pa.array(np.concatenate((counts, np.array(list(totals.values()), np.int64))))
            hashes = pa.array(np.concatenate((where.view(np.int64), np.zeros(len(totals), np.int64))))
            return pa.RecordBatch.from_arrays([langs, texts, hashes, sums], ["lang", "word", "h", "f"])

        for pieces, hashes, langs in _scan(batches):
            distinct, where, c = np.unique(hashes, return_index=True, return_counts=True)
            place = np.searchsorted(known, distinct)
            old = known[np.minimum(place, len(known) - 1)] == distinct if len(known) else np.zeros(len(distinct), bool)
            counts[at[place[old]]] += c[old]
            new = ~old
            owner = np.searchsorted(pieces.first, where[new], "right") - 1
            out.append((pa.array([langs[k] for k in owner.tolist()], pa.string()), pieces.texts(where[new]), distinct[new]))
            at = np.insert(at, place[new], len(counts) + np.arange(int(new.sum())))
            counts = np.concatenate((counts, c[new].astype(np.int64)))
            known = np.insert(known, place[new], distinct[new])
            for lang, n in zip(langs, pieces.counts.tolist(), strict=True):
                totals[lang] = totals.get(lang, 0) + n
            if len(known) > WORDS:
                yield flush()
                known, at, counts, out = known[:0], at[:0], counts[:0], []
                totals.clear()
        if out:
            yield flush()

    rows = docs.mapInArrow(count, "lang string, word string, h long, f long")
    return rows.groupBy("lang", "word").agg(F.max("h").alias("h"), F.sum("f").alias("f"))


class Symbols:
    """Frequent words, or phrases of one length, as tasks know them: at most RANKED with ranks, others by a bit filter.

    Ranks go by language, then frequency, so that frequent pairs share few tiles. Both parts are bounded at any
    size of the corpus: where there are more symbols, those of the highest powers of two of frequency get ranks,
    the others are known by a filter of 2^FILTER_BITS bits, which may let infrequent ones through (to be counted and
    found infrequent) but holds none back.
    """

    def __init__(self, table: DataFrame, ranked: int, filter_bits: int):
        self.filter = None
        self.shift = np.uint64(64 - filter_bits)
        power = F.floor(F.log2(F.col("f").cast("double")))
        sizes = sorted(((r[0], r[1]) for r in table.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)  # 64 rows at most
        top, least = 0, None
        for p, c in sizes:
            if top + c > ranked:
                break
            top, least = top + c, p
        got = table.filter(power >= least).select("lang", "f", "h").toArrow() if top else None  # ``ranked`` rows at most
        hashes = np.zeros(0, np.uint64)
        if got is not None:
            langs = got.column("lang").combine_chunks().dictionary_encode()
            langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
            h = got.column("h").to_numpy().view(np.uint64)
            hashes = h[np.lexsort((h, -got.column("f").to_numpy(), langs.indices.to_numpy()))]
        if top < sum(c for _, c in sizes):
            spot = F.shiftrightunsigned("h", 64 - filter_bits)
            bits = table.select(F.shiftright(spot, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - filter_bits}) & 63 as int))").alias("bit"))
            rows = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2^(FILTER_BITS - 6) rows at most
            self.filter = np.zeros(1 << (filter_bits - 6), np.uint64)
            self.filter[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        self.sorted, self.rank = hashes[order], order.astype(np.uint32)

    @property
    def hashes(self) -> np.ndarray:
        """The hashes by rank."""
        out = np.empty_like(self.sorted)
        out[self.rank] = self.sorted
        return out

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(may be frequent, rank or _FAR where it has none)."""
        rank = np.full(len(h), _FAR)
        if len(self.sorted):
            place = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
            hit = self.sorted[place] == h
            rank[hit] = self.rank[place[hit]]
        alive = rank != _FAR
        if self.filter is not None:
            spot = h >> self.shift
            alive |= (self.filter[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
        return alive, rank


def combine(codes: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Adds up the counts of equal tile codes: dense arrays where a tile has many entries, else by sorting."""
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    tile = codes >> np.uint64(CELL_BITS)
    row, column = (tile >> np.uint64(26)).astype(np.int64), (tile & np.uint64((1 << 26) - 1)).astype(np.int64)
    wide = int(column.max()) + 1
    if (int(row.max()) + 1) * wide <= 1 << 21:
        index, names = row * wide + column, None
    else:
        names, index = np.unique(tile, return_inverse=True)
    del tile, row, column
    held = np.bincount(index)
    full = np.flatnonzero(held >= DENSE)
    number = np.full(len(held), -1, np.int32)
    number[full] = np.arange(len(full))
    mine = number[index]
    del held, number, index
    at = np.flatnonzero(mine >= 0)
    got_codes, got_counts = [], []
    for a in range(0, len(full), 512):
        here = at[(mine[at] >= a) & (mine[at] < a + 512)] if len(full) > 512 else at
        cell = ((mine[here].astype(np.int64) - a) << CELL_BITS) | (codes[here] & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)
        sums = np.bincount(cell, None if counts is None else counts[here])  # doubles are exact up to 2^53
        filled = np.flatnonzero(sums)
        which = full[a + (filled >> CELL_BITS)]
        name = names[which] if names is not None else ((which // wide).astype(np.uint64) << np.uint64(26)) | (which % wide).astype(np.uint64)
        got_codes.append((name << np.uint64(CELL_BITS)) | (filled & ((1 << CELL_BITS) - 1)).astype(np.uint64))
        got_counts.append(sums[filled].astype(np.int64))
        del here, cell, sums, filled
    rest = np.flatnonzero(mine < 0)
    del at, mine
    order = rest[np.argsort(codes[rest], kind="stable")]
    del rest
    c = codes[order]
    new = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1]))) if len(c) else np.zeros(0, np.int64)
    got_codes.append(c[new])
    got_counts.append(np.add.reduceat(np.ones(len(c), np.int64) if counts is None else counts[order], new) if len(c) else np.zeros(0, np.int64))
    return np.concatenate(got_codes), np.concatenate(got_counts)


def combine_pairs(a: np.ndarray, b: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adds up the counts of equal pairs of hashes as sorted COO."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
    sums = np.add.reduceat(np.ones(len(a), np.int64) if counts is None else counts[order], new) if len(a) else np.zeros(0, np.int64)
    return a[new], b[new], sums


def _bucket(a: np.ndarray, b: np.ndarray | None, buckets: int) -> np.ndarray:
    key = textscan.mix(a >> np.uint64(CELL_BITS), 11) if b is None else textscan.mix(a ^ textscan.mix(b, 13), 11)
    return (key % np.uint64(buckets)).astype(np.int64)


_MESSAGE = "bucket long, a binary, b binary, n binary"


def _messages(a: np.ndarray, b: np.ndarray | None, counts: np.ndarray, buckets: int):
    """One row a bucket with its entries packed, in batches of about SENT entries: tile codes (b null), or pairs of hashes."""
    bucket = _bucket(a, b, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    bounds = np.concatenate((first, [len(bucket)]))
    step = max(1, SENT * len(first) // len(bucket))

    def packed(x, at, width):
        return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(((at - at[0]) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])

    for k in range(0, len(first), step):
        at = bounds[k : k + step + 1]
        here = order[at[0] : at[-1]]
        columns = [pa.array(bucket[at[:-1]]), packed(a[here], at, 8), pa.nulls(len(at) - 1, pa.binary()) if b is None else packed(b[here], at, 8), packed(counts[here].astype(np.int64), at, 8)]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "a", "b", "n"])


class Gathered:
    """Entries that a task has counted and not sent yet: tile codes and pairs of hashes, each combined a piece at a time."""

    def __init__(self):
        self.near, self.far, self.size = [], [], 0

    def add(self, near: list, far: list) -> None:
        if near:
            self.near.append(combine(np.concatenate(near), None))
            self.size += len(self.near[-1][0])
        if far:
            self.far.append(combine_pairs(*(np.concatenate([x[k] for x in far]) for k in range(2)), None))
            self.size += len(self.far[-1][0])

    def settle(self) -> None:
        """Adds up what the pieces have in common."""
        if len(self.near) > 1:
            self.near = [combine(*(np.concatenate([x[k] for x in self.near]) for k in range(2)))]
        if len(self.far) > 1:
            self.far = [combine_pairs(*(np.concatenate([x[k] for x in self.far]) for k in range(3)))]
        self.size = sum(len(x[0]) for x in self.near + self.far)

    def sent(self, buckets: int):
        for codes, counts in self.near:
            yield from _messages(codes, None, counts, buckets)
        for a, b, counts in self.far:
            yield from _messages(a, b, counts, buckets)
        self.near, self.far, self.size = [], [], 0


def count_pairs(docs: DataFrame, levels: list[Symbols], buckets: int, least: int) -> DataFrame:
    """(left_h, right_h, h, f) of the phrases one word longer than those of the last level that occur ``least`` times.

    A task turns positions into pairs of a frequent phrase and the word after it. Where both have ranks, the pair
    is a cell of a tile, counted there; else it is an entry of a sorted list of hash pairs. What a task has counted is
    dealt to buckets of tiles; a tile met by every task gets one entry a cell from each, however hot it is.
    """
    spark = docs.sparkSession
    known = [spark.sparkContext.broadcast(x) for x in levels]  # bounded: see Symbols
    long = len(levels) + 1

    def tiles(batches):
        near, far, n, done = [], [], 0, Gathered()
        for pieces, words, _ in _scan(batches):
            alive, word_rank = known[0].value.find(words)
            at, h, rank = np.flatnonzero(alive), words[alive], word_rank[alive]
            for k in range(2, long + 1):
                # A phrase may be frequent only if both it without its last word and it without its first word are.
                grows = np.zeros(len(words) + 1, bool)
                grows[at] = True
                go = pieces.linked[at + k - 2] & grows[np.minimum(at + 1, len(words))]
                at, h, rank = at[go], h[go], rank[go]
                right = at + k - 1
                if k < long:
                    h = joined_hash(h, words[right])
                    alive, rank = known[k - 1].value.find(h)
                    at, h, rank = at[alive], h[alive], rank[alive]
            if not len(at):
                continue
            j = word_rank[right]
            both = (rank != _FAR) & (j != _FAR)
            i, j2 = rank[both], j[both]
            side, low = np.uint64(SIDE_BITS), np.uint64((1 << SIDE_BITS) - 1)
            if len(i):
                near.append(((i >> side) << np.uint64(26 + CELL_BITS)) | ((j2 >> side) << np.uint64(CELL_BITS)) | ((i & low) << side) | (j2 & low))
            if not both.all():
                far.append((h[~both], words[right[~both]]))
            n += len(at)
            if n >= GATHER:
                done.add(near, far)
                near, far, n = [], [], 0
                if done.size > FLUSH:
                    done.settle()
                    if done.size > FLUSH // 2:
                        yield from done.sent(buckets)
        done.add(near, far)
        done.settle()
        yield from done.sent(buckets)

    def totals(batches):
        tile, pair = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        held, new_tile, new_pair, last = 0, [], [], None
        left, right = known[-1].value.hashes, known[0].value.hashes

        def settle(done: bool):
            nonlocal tile, pair, held, new_tile, new_pair
            tile = combine(np.concatenate([tile[0], *(x[0] for x in new_tile)]), np.concatenate([tile[1], *(x[1] for x in new_tile)]))
            pair = combine_pairs(*(np.concatenate([pair[k], *(x[k] for x in new_pair)]) for k in range(3)))
            new_tile, new_pair = [], []
            over_t = np.ones(len(tile[0]), bool) if done else _bucket(tile[0], None, buckets) != last
            over_p = np.ones(len(pair[0]), bool) if done else _bucket(pair[0], pair[1], buckets) != last
            t, p = over_t & (tile[1] >= least), over_p & (pair[2] >= least)
            code, side, low = tile[0][t], np.uint64(SIDE_BITS), np.uint64((1 << SIDE_BITS) - 1)
            i = ((code >> np.uint64(26 + CELL_BITS)) << side) | ((code >> side) & low)
            j = (((code >> np.uint64(CELL_BITS)) & np.uint64((1 << 26) - 1)) << side) | (code & low)
            a, b = np.concatenate((left[i], pair[0][p])), np.concatenate((right[j], pair[1][p]))
            f = np.concatenate((tile[1][t], pair[2][p]))
            tile, pair = tuple(x[~over_t] for x in tile), tuple(x[~over_p] for x in pair)
            held = len(tile[0]) + len(pair[0])
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b, joined_hash(a, b), f)], ["left_h", "right_h", "h", "f"])

        for batch in batches:
            if not batch.num_rows:
                continue
            tiled = batch.filter(batch.column("b").is_null())
            paired = batch.filter(batch.column("b").is_valid())
            if tiled.num_rows:
                new_tile.append((_flat(tiled, "a", np.uint64), _flat(tiled, "n", np.int64)))
            if paired.num_rows:
                new_pair.append((_flat(paired, "a", np.uint64), _flat(paired, "b", np.uint64), _flat(paired, "n", np.int64)))
            last = batch.column("bucket")[-1].as_py()
            if sum(len(x[0]) for x in new_tile) + sum(len(x[0]) for x in new_pair) > max(GATHER, held):
                yield settle(False)
        yield settle(True)

    sent = docs.mapInArrow(tiles, _MESSAGE).repartition(common.shuffle_width(spark), "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(totals, "left_h long, right_h long, h long, f long")


def _flat(batch: pa.RecordBatch, name: str, kind) -> np.ndarray:
    column = batch.column(name)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy().view(kind)


def frequent_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST,
    ranked: int = RANKED, filter_bits: int = FILTER_BITS,
) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): every phrase of 1 to ``longest`` words that occurs ``least`` times in its language, and words a language.

    Phrases are rows (lang, words, phrase, m, f): ``words`` are the hashes of its m words, ``f`` counts its contiguous
    occurrences inside pieces, overlaps included; totals are (lang, n). One pass over the texts counts words, and
    one for each further length pairs the frequent phrases of the length before (ranked anew by frequency) with
    the word that follows, in tiles. Lengths end when one has no frequent phrase.

    Texts are lower-cased (A-Z) and split at ``. , ; : ! ?`` and 0x0A-0x0D into pieces, those at space and tab into
    words. A null text counts as empty, a null language as ``und``; rows that repeat count as often as they stand; a
    long text is scanned alone and never cut; other columns are ignored, whatever their names; an empty table gives no rows. Symbols are compared by
    64-bit hashes: of n frequent and candidate symbols about n^2 / 2^65 pairs are taken for equal.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counted = words_of(rows).filter(F.col("word").isNull() | (F.col("f") >= least))
    with small_batches(spark):
        vocabulary, _ = common.materialize(counted, "words")
    totals = vocabulary.filter("word IS NULL").select("lang", F.col("f").alias("n"))
    words = vocabulary.filter("word IS NOT NULL").select("lang", F.array("h").alias("words"), F.col("word").alias("phrase"), F.lit(1).alias("m"), "f", "h")
    buckets = max(LEAST_BUCKETS, -(-common.text_bytes(rows, "text") // BUCKET_BYTES))
    levels, tables = [], [words]
    while len(tables) < longest:
        if tables[-1].isEmpty():
            break
        levels.append(Symbols(tables[-1], ranked, filter_bits))
        left = tables[-1].select("lang", "words", F.col("phrase").alias("before"), F.col("h").alias("left_h"))
        right = words.select(F.col("phrase").alias("word"), F.col("h").alias("right_h"))
        longer = count_pairs(rows, levels, buckets, least).join(left, "left_h").join(right, "right_h")
        longer = longer.select("lang", F.array_append("words", F.col("right_h")).alias("words"), F.concat_ws(" ", "before", "word").alias("phrase"), F.lit(len(tables) + 1).alias("m"), "f", "h")
        with small_batches(spark):
            table, _ = common.materialize(longer, f"phrases-{len(tables) + 1}")
        tables.append(table)
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every.drop("h"), totals


def collocations(phrases: DataFrame, totals: DataFrame, top: int | None = TOP) -> DataFrame:
    """Candidates (phrases of two words or more) scored at their weakest cut: lang, rank, phrase, a, l, r, n, score.

    Cutting after the first k words gives floor(1000 a n / (l r)) in 38-digit decimals; the least counts, ties to
    the smallest k. A candidate whose words lie inside a longer one that is as frequent is left out: it is enough to look one word
    further, as phrases between them are as frequent too. ``top`` candidates of each language are listed (None: all),
    by score, a, then phrase; they are ranked in salted parts first, so a language with most candidates is no one task's.
    """
    many = phrases.filter("m > 1").select("lang", "words", "phrase", "m", F.col("f").alias("a"))
    parts = phrases.select("words", "f")
    cuts = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.withColumns({"lw": F.slice("words", F.lit(1), F.col("k")), "rw": F.slice("words", F.col("k") + 1, F.col("m") - F.col("k"))})
    cuts = cuts.join(parts.select(F.col("words").alias("lw"), F.col("f").alias("l")), "lw").join(parts.select(F.col("words").alias("rw"), F.col("f").alias("r")), "rw")
    cuts = cuts.join(F.broadcast(totals) if common.few(totals) else totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"over": wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)"), "under": wide("l") * wide("r")})
    cuts = cuts.withColumn("score", F.expr("over div under"))
    weakest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "words", "phrase", "m", "a", "n").agg(weakest)
    inner = F.array(F.slice("words", F.lit(1), F.col("m") - 1), F.slice("words", F.lit(2), F.col("m") - 1))
    held = many.filter("m > 2").select(F.explode(inner).alias("words"), F.col("a").alias("longer")).groupBy("words").agg(F.max("longer").alias("longer"))
    kept = scored.join(held, "words", "left").filter(F.coalesce(F.col("longer"), F.lit(-1)) < F.col("a"))
    kept = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        salted = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
        kept = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top).drop("rank", "part")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    """The first collocations of each language over all documents: see frequent_phrases and collocations."""
    return collocations(*frequent_phrases(common.table(spark, sf_dir, "documents")))


OP13_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT d, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT row_number() OVER () AS piece_no, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
u AS (SELECT piece_no, lang, words, unnest(range(1, len(words) + 1)) AS i FROM w WHERE len(words) > 0),
g AS (SELECT lang, words[i:i + m - 1] AS ws FROM u, range(1, 6) AS r(m) WHERE i + m - 1 <= len(words)),
n AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM u GROUP BY lang),
f AS (SELECT lang, ws, len(ws) AS m, count(*) AS f FROM g GROUP BY lang, ws HAVING count(*) >= 100),
c AS (SELECT lang, ws, m, f AS a, unnest(range(1, m)) AS k FROM f WHERE m > 1),
s AS (
  SELECT c.*, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.ws = c.ws[1:c.k] JOIN f r ON r.lang = c.lang AND r.ws = c.ws[c.k + 1:c.m] JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
h AS (
  SELECT lang, ws[i:i + j - 1] AS ws, max(f) AS longer
  FROM f, range(2, 5) AS x(j), range(1, 5) AS y(i) WHERE j < m AND i + j - 1 <= m GROUP BY ALL),
o AS (SELECT b.*, array_to_string(b.ws, ' ') AS phrase FROM b LEFT JOIN h ON h.lang = b.lang AND h.ws = b.ws WHERE coalesce(100 * h.longer, -1) < 100 * b.a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM q WHERE rank <= 2000
"""
