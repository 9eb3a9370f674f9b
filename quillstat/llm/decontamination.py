"""Benchmark decontamination: rare words of items as seeds, then Smith-Waterman alignment."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common, textscan

#: An item of fewer words must stand whole.
WHOLE_WORDS = 3
#: Alignment: a pair of equal words, of unequal words, a word left out on one side.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of an item's greatest possible score from which a document counts as contaminated by it.
THRESHOLD = 0.5
#: Bytes of item texts that are searched for, and broadcast, at once; more items make more rounds.
ROUND_BYTES = 16 << 20
#: Seeds that a stretch of text is asked for at most, and what looking at a stretch costs beside looking at a seed.
MOST_SEEDS, STRETCH_COST = 8, 50
#: Seeds, and words of stretches, that are looked at together.
TOGETHER = 1 << 21


@dataclass
class Items:
    """Benchmark items of a round: word hashes, and after choose() the seeds that are searched for.

    An alignment of an item of L words that scores ``least`` pairs at least half of that many equal words, and spans
    at most ``reach`` words of the text, as every other word in it costs 1. So if of an item's words all but
    ``least / 2 - t`` are seeds, then t seeds at least stand within ``reach`` of each other wherever it is found.
    """

    ids: list = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    @classmethod
    def read(cls, rows: list) -> Items:
        out = cls()
        for _, _, data, offsets in textscan.slices(pa.array([t or "" for _, t in rows], pa.string())):
            words = textscan.Words(*textscan.folded(data, offsets))
            hashes = words.hashes()
            out.words += [hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        out.ids = [i for i, _ in rows]
        if out.words:
            out.vocabulary = np.unique(np.concatenate(out.words))
        return out

    def choose(self, count: np.ndarray, threshold: float) -> Items:
        """Takes the rarest words of each item as seeds, as many as make sure that no alignment is overlooked.

        ``count`` has how often each word of the vocabulary stands in the documents, and last the number of all
        words. It decides only how much is looked at, never what is found.
        """
        size = np.array([len(w) for w in self.words], np.int64)
        least = np.array([max(1, math.ceil(MATCH * n * (threshold if n >= WHOLE_WORDS else max(1, threshold)) - 1e-9)) for n in size.tolist()], np.int64)
        self.least, self.reach, self.times = least, np.maximum(1, 3 * size - least), np.ones(len(size), np.int64)
        place, item = [], []
        for k, w in enumerate(self.words):
            pairs = -(-int(least[k]) // MATCH)
            if pairs > len(w) or not len(w):
                continue
            mine = np.searchsorted(self.vocabulary, w)
            mine = mine[np.lexsort((mine, count[mine]))]
            best = None
            for t in range(1, min(MOST_SEEDS, pairs) + 1):
                seeds = np.unique(mine[: len(w) - pairs + t])
                hits = float(count[seeds].sum())
                near, term, fewer = hits * float(self.reach[k]) / max(1.0, float(count[-1])), 1.0, 0.0
                for x in range(t - 1):
                    fewer, term = fewer + term, term * near / (x + 1)
                cost = hits * (1 + STRETCH_COST * max(0.0, 1 - fewer * math.exp(-near)))
                if best is None or cost < best[0]:
                    best = cost, t, seeds
            self.times[k] = best[1]
            place.append(best[2])
            item.append(np.full(len(best[2]), k))
        place, item = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (place, item))
        order = np.lexsort((item, place))
        self.seeds, at = np.unique(self.vocabulary[place[order]], return_index=True)
        self.items, self.begin = item[order], np.append(at, len(item))
        self.pairs = np.unique(np.concatenate([self._pair(w, np.full(len(w), k)) for k, w in enumerate(self.words)] or [np.zeros(0, np.uint64)]))
        return self

    @staticmethod
    def _pair(words: np.ndarray, item: np.ndarray) -> np.ndarray:
        return textscan.mix(words + textscan.mix(item.astype(np.uint64), 5))

    def within(self, words: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which of the words stand in the item named beside them."""
        found, _ = lookup(self.pairs, self._pair(words, item))
        out = np.zeros(len(words), bool)
        out[found] = True
        return out


def lookup(names: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, place among the sorted names) of those hashes that are among the names."""
    if not len(names):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = np.zeros(1 << 22, bool)
    bits[(names >> np.uint64(42)).astype(np.int64)] = True
    maybe = np.flatnonzero(bits[(hashes >> np.uint64(42)).astype(np.int64)])
    at = np.minimum(np.searchsorted(names, hashes[maybe]), len(names) - 1)
    right = names[at] == hashes[maybe]
    return maybe[right], at[right]


def smith_waterman(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
    """(score, begin, end in the second sequence) of the best local alignment of each pair, all pairs at once.

    Matrices are filled by anti-diagonals; each cell carries where its alignment began.
    """
    out = [(0, 0, 0)] * len(pairs)
    # Pairs of like lengths go together, so that little is padded.
    order = sorted(range(len(pairs)), key=lambda p: (len(pairs[p][0]), len(pairs[p][1])))
    for g in range(0, len(order), 256):
        group = order[g : g + 256]
        m, n = max(len(pairs[p][0]) for p in group), max(len(pairs[p][1]) for p in group)
        x = np.zeros((len(group), m), np.uint64)
        y = np.full((len(group), n), 1, np.uint64)
        okx, oky = np.zeros((len(group), m), bool), np.zeros((len(group), n), bool)
        for r, p in enumerate(group):
            a, b = pairs[p]
            x[r, : len(a)], okx[r, : len(a)] = a, True
            y[r, : len(b)], oky[r, : len(b)] = b, True
        zero = lambda: np.zeros((len(group), m + 1), np.int32)
        last, before = zero(), zero()
        last_from, before_from = zero(), zero()
        best, best_from, best_end = (np.zeros(len(group), np.int32) for _ in range(3))
        for d in range(2, m + n + 1):
            lo, hi = max(1, d - n), min(m, d - 1)
            i = np.arange(lo, hi + 1)
            j = d - i
            same = (x[:, i - 1] == y[:, j - 1]) & okx[:, i - 1] & oky[:, j - 1]
            pair = before[:, i - 1] + np.where(same, MATCH, MISMATCH)
            up, side = last[:, i - 1] + GAP, last[:, i] + GAP
            score = np.maximum(np.maximum(pair, up), np.maximum(side, 0))
            start = np.where(before[:, i - 1] > 0, before_from[:, i - 1], j - 1)
            from_ = np.where(score == pair, start, np.where(score == up, last_from[:, i - 1], last_from[:, i]))
            now, now_from = zero(), zero()
            now[:, i], now_from[:, i] = score, from_
            top = score.argmax(axis=1)
            high = score[np.arange(len(group)), top]
            better = high > best
            best[better] = high[better]
            best_from[better] = from_[np.arange(len(group)), top][better]
            best_end[better] = j[top][better]
            before, before_from, last, last_from = last, last_from, now, now_from
        for r, p in enumerate(group):
            out[p] = (int(best[r]), int(best_from[r]), int(best_end[r]))
    return out


def _word_counts(batches, items: Items):
    count = np.zeros(len(items.vocabulary) + 1, np.int64)
    for batch in batches:
        for _, _, data, offsets in textscan.slices(batch.column("text")):
            hashes = textscan.Words(*textscan.folded(data, offsets)).hashes()
            count[:-1] += np.bincount(lookup(items.vocabulary, hashes)[1], minlength=len(items.vocabulary))
            count[-1] += len(hashes)
    used = np.flatnonzero(count)
    yield pa.RecordBatch.from_pydict({"place": pa.array(used, pa.int64()), "n": pa.array(count[used], pa.int64())})


def _stretches(items: Items, words: textscan.Words, hashes: np.ndarray):
    """(text, item, seeds, from word, to word), as arrays: all stretches of a text where an item could be found."""
    owner = textscan.owners(words.first)
    every, seed = lookup(items.seeds, hashes)
    many = items.begin[seed + 1] - items.begin[seed]
    ends, done = np.cumsum(many), 0
    while done < len(every):
        # As many whole texts as have TOGETHER seeds of items, and one at least.
        stop = int(np.searchsorted(ends, (ends[done - 1] if done else 0) + TOGETHER, "right"))
        text = owner[every[min(stop, len(every) - 1)]]
        cut = int(np.searchsorted(every, words.first[text])) if stop < len(every) else len(every)
        cut = cut if cut > done else int(np.searchsorted(every, words.first[owner[every[done]] + 1]))
        times, first = many[done:cut], items.begin[seed[done:cut]]
        at = np.repeat(every[done:cut], times)
        item = items.items[np.repeat(first, times) + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)]
        done = cut
        key = owner[at] * len(items.words) + item
        order = np.argsort(key, kind="stable")
        at, item, key = at[order], item[order], key[order]
        end = np.arange(len(at)) + items.times[item] - 1
        last = np.minimum(end, len(at) - 1)
        begin = np.flatnonzero((end < len(at)) & (key[last] == key) & (at[last] - at < items.reach[item]))
        if not len(begin):
            continue
        end, item, key = end[begin], item[begin], key[begin]
        low, high = at[end] - items.reach[item] + 1, at[begin] + items.reach[item]
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (low[1:] > high[:-1]))))
        last = np.append(new[1:], len(begin)) - 1
        text, item, seeds = key[new] // len(items.words), item[new], end[last] - begin[new] + 1
        low, high = np.maximum(low[new], words.first[text]), np.minimum(high[last], words.first[text + 1])
        # A long one is cut into stretches of which neighbours share all that an alignment can span.
        step = items.reach[item] + 8
        pieces = np.maximum(1, -(-(high - low - 2 * step) // step) + 1)
        of = np.repeat(np.arange(len(new)), pieces)
        low = low[of] + step[of] * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        yield text[of], item[of], seeds[of], low, np.minimum(high[of], low + 2 * step[of])


def _likely(items: Items, hashes: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which stretches can reach the item's least score: if each of its words there found a partner and all others cost 1."""
    out, size = np.zeros(len(item), bool), high - low
    ends, done = np.cumsum(size), 0
    while done < len(item):
        cut = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + TOGETHER, "right")))
        n = size[done:cut]
        first = np.cumsum(n) - n
        of = np.repeat(np.arange(cut - done), n)
        word = hashes[low[done:cut][of] + np.arange(len(of)) - first[of]]
        gain = np.where(items.within(word, item[done:cut][of]), MATCH, -1)
        # Sums from a stretch's begin; each stretch lies below the one before, so that the running least starts anew.
        total = np.cumsum(gain)
        total += (total[first] - gain[first])[of] * -1 - of * (4 * int(n.max()) + 8)
        rise = total - np.minimum.accumulate(total - gain)
        out[done:cut] = np.maximum.reduceat(rise, first) >= items.least[item[done:cut]]
        done = cut
    return out


def _matches(column, items: Items, threshold: float):
    """(row, item, seeds, score share, begin, end word) of each alignment that reaches the threshold."""
    out: dict[tuple[int, int], tuple] = {}
    for i, _, data, offsets in textscan.slices(column):
        words = textscan.Words(*textscan.folded(data, offsets))
        hashes = words.hashes()
        for text, item, seeds, low, high in _stretches(items, words, hashes):
            keep = _likely(items, hashes, item, low, high)
            todo = list(zip(*(x[keep].tolist() for x in (text, item, seeds, low, high)), strict=True))
            scores = smith_waterman([(items.words[k], hashes[a:b]) for _, k, _, a, b in todo])
            for (row, k, n, a, _), (score, begin, end) in zip(todo, scores, strict=True):
                share = score / (MATCH * len(items.words[k]))
                row += i
                if score >= items.least[k] and share >= threshold and ((row, k) not in out or share > out[row, k][1]):
                    at = a - int(words.first[row - i])
                    out[row, k] = (n, share, at + begin, at + end)
    return [(row, item, *rest) for (row, item), rest in sorted(out.items())]


def _rounds(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, threshold: float, round_bytes: int):
    """Broadcast items of each round, with seeds chosen by how often their words stand in the documents."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).alias("t")).filter("t IS NOT NULL")
    rounds = 1 + int(bench.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]) // round_bytes
    for r in range(rounds):
        mine = bench.filter(F.pmod(F.xxhash64("i", "t"), F.lit(rounds)) == r) if rounds > 1 else bench
        items = Items.read(sorted(((x["i"], x["t"]) for x in mine.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])))
        if not len(items.vocabulary):
            continue
        every = spark.sparkContext.broadcast(items)
        counts = docs.select(F.col(text_col).alias("text")).mapInArrow(lambda it: _word_counts(it, every.value), "place bigint, n bigint")  # noqa: B023
        counts = counts.groupBy("place").agg(F.sum("n").alias("n")).toArrow()
        count = np.zeros(len(items.vocabulary) + 1, np.int64)
        count[counts.column("place").to_numpy()] = counts.column("n").to_numpy()
        yield spark.sparkContext.broadcast(items.choose(count, threshold))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", threshold: float = THRESHOLD, round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """(id, item, seeds, score, first and last word) of each document that holds a benchmark item or an edited copy.

    An item is found where its best local alignment with a document, word by word (case folded by Unicode), scores
    ``threshold`` of the item's greatest possible score, or all of it if it has fewer than WHOLE_WORDS words; the share
    reached is ``score``. The words of an item that are rarest among all documents are its seeds, enough of them that
    each such alignment holds some; only where so many stand together, words are aligned. ``seeds`` counts those about
    the match. Items are broadcast in rounds of at most ``round_bytes``; each round reads the documents twice and
    shuffles only word counts. A null or empty text matches nothing, nor does a null or empty item. Rows repeating an
    id (or without one) are searched one by one; repeated items give rows of their own. Ids of documents and items keep
    their types. Of equally good alignments with one item the first counts, and a text of any length is searched
    whole. Other columns are ignored, whatever their names; an empty table on either side gives no rows.
    """
    out, spark = None, docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = benchmark.schema[item_col].dataType
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {kind.simpleString()}, seeds int, score double, begin_word bigint, end_word bigint"
    kind = to_arrow_type(kind)
    for shared in _rounds(docs, benchmark, text_col, item_col, item_text, threshold, round_bytes):

        def search(batches, shared=shared):
            for batch in batches:
                found = _matches(batch.column("text"), shared.value, threshold)
                ids = batch.column("doc_id").take(pa.array([x[0] for x in found], pa.int64()))
                cols = list(zip(*found, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([ids, pa.array([shared.value.ids[k] for k in cols[1]], kind), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64())], ["doc_id", "item_id", "seeds", "score", "begin_word", "end_word"])

        part = rows.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; the rows never leave their task.

    Nulls, long texts and empty tables are as find_contamination() has them; repeated rows share their fate.
    """
    item_col, item_text = options.get("item_col", "item_id"), options.get("item_text", "text")
    round_bytes = options.get("round_bytes", ROUND_BYTES)
    for shared in _rounds(docs, benchmark, text_col, item_col, item_text, threshold, round_bytes):
        at = docs.columns.index(text_col)

        def keep(batches, shared=shared, at=at):
            for batch in batches:
                bad = np.zeros(batch.num_rows, bool)
                bad[[x[0] for x in _matches(batch.column(at), shared.value, threshold)]] = True
                yield batch.filter(pa.array(~bad))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents searched for all benchmark items: see find_contamination."""
    return find_contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
