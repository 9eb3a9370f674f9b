"""Awkward rows, and brute-force versions of the corpus operators that SQL can't state."""

import math
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import agree  # noqa: E402

import corpus_pipeline  # noqa: E402
from quillstat.llm import chargrams, chat_format, common, decontamination, language_id, mixing, ngram_join, registry, sharding, substring_dedup, toxicity  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string"
LONG = " ".join(f"w{k % 977}" for k in range(60_000))


def prose(rng, n, words=120):
    return " ".join(f"word{rng.randrange(words)}" for _ in range(n))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# op5


def brute_kd(points, shards):
    """The shard of each (weight, steps, ties) point by recursive weighted medians."""
    share, out = sum(p[0] for p in points) / shards, {}

    def split(ids, first, k):
        if k == 1:
            out.update(dict.fromkeys(ids, first))
            return
        wide = [max((points[i][1][d] for i in ids), default=0) - min((points[i][1][d] for i in ids), default=0) for d in range(3)]
        axis, half = wide.index(max(wide)), k // 2
        goal, inside, left = sum(points[i][0] for i in ids) * half / k, list(ids), []
        for depth in range(3):
            value = lambda i, depth=depth: points[i][1][axis] if depth == 0 else points[i][2][depth - 1]
            held, at = 0, None
            for v in sorted({value(i) for i in inside}):
                here = sum(points[i][0] for i in inside if value(i) == v)
                if held + here > goal:
                    at = v
                    break
                held += here
            left += [i for i in inside if at is None or value(i) < at]
            inside, goal = [i for i in inside if at is not None and value(i) == at], goal - held
            size = sum(points[i][0] for i in inside)
            if not inside or goal <= 0:
                break
            if depth == 2 or size <= share / sharding.STEPS:
                left += inside if goal > size / 2 else []
                break
        split(left, first, half)
        split([i for i in ids if i not in set(left)], first + half, k - half)

    split(list(range(len(points))), 0, shards)
    return out


def test_tree_by_brute_force(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(150)]
    docs = spark.createDataFrame([(k, texts[k % 150], rng.choice(["de", "en", None]), f"site-with-one-prefix-{rng.randrange(9)}") for k in range(220)], DOCS)
    got = {r["doc_id"]: r["shard"] for r in sharding.shard_by_kd_tree(docs, shards=7, large_part=1e9).collect()}
    every = sharding.texts(sharding.metadata(docs, "doc_id", "text", "source", "lang")).collect()
    want = brute_kd([(r["w"], [r[d] for d in sharding.DIMENSIONS], [r[t] for t in sharding.TIES]) for r in every], 7)
    shard_of = {r["key"]: want[k] for k, r in enumerate(every)}
    keys = {r["doc_id"]: r["key"] for r in docs.select("doc_id", common.hash60(F.coalesce("text", F.lit(""))).alias("key")).collect()}
    assert got == {i: shard_of[keys[i]] for i in keys}


def check_shards(got, shards, most=1.02):
    sizes, slots = Counter(), {}
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(sizes) == list(range(shards)) and max(sizes.values()) <= most * min(sizes.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_equal_texts_share_a_shard(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randrange(20, 90)) for _ in range(400)]
    rows = [(k, texts[k % 400], "en" if k % 3 else None, f"s{k % 7}") for k in range(900)]
    got = sharding.shard_by_kd_tree(spark.createDataFrame(rows, DOCS), shards=6).collect()
    check_shards(got, 6)
    where = {}
    for r in got:
        where.setdefault(texts[r["doc_id"] % 400], set()).add(r["shard"])
    assert all(len(v) == 1 for v in where.values())


@pytest.mark.parametrize("with_ids", [True, False])
def test_a_text_larger_than_a_shard_is_dealt(spark, with_ids):
    rng = random.Random(5)
    rows = [(k if with_ids else None, "one text that a third of all rows have", "en", "hot") for k in range(3000)]
    rows += [(10_000 + k, prose(rng, rng.randrange(1, 30)), None, None) for k in range(700)]
    got = sharding.shard_by_kd_tree(spark.createDataFrame(rows, DOCS).repartition(6), shards=8).collect()
    assert len(got) == 3700
    check_shards(got, 8)


def test_shards_of_few_or_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b", None, None)] * 40 + [(None, None, "x", "y")] * 40 + [(2, LONG, "x", None)], DOCS).withColumn("shard", F.lit(9)).withColumn("key", F.lit("k"))
    got = sharding.shard_by_kd_tree(docs, shards=4).collect()
    assert len(got) == 81 and {r["shard"] for r in got} <= set(range(4)) and len({(r["shard"], r["slot"]) for r in got}) == 81


# op2, and ranks in pieces


def test_many_names_are_ranked_in_pieces(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    rows = [(k if k % 17 else None, None if k % 29 == 0 else prose(rng, rng.randrange(0, 40)), "en", None if k % 31 == 0 else f"source {rng.randrange(12)}") for k in range(400)]
    rows += [rows[5]] * 3
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    whole = sorted(map(str, sharding.shard_by_kd_tree(docs.filter("doc_id IS NOT NULL"), shards=5).collect()))
    monkeypatch.setattr(common, "FEW", 2)
    agree(spark, tmp_path, mixing.op2_source_mix, mixing.OP2_SQL)
    assert sorted(map(str, sharding.shard_by_kd_tree(docs.filter("doc_id IS NOT NULL"), shards=5).collect())) == whole


def test_reserved_names_and_id_types(spark):
    rng = random.Random(7)
    base = prose(rng, 60)
    names = ["__gone", "__times", "__copy", "__taken_id", "__id", "__copies"]
    docs = spark.createDataFrame([(1, base, "en", "a"), (2, base, "en", "b"), (3, prose(rng, 40), "en", "a")], DOCS).select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    assert sorted(r["doc_id"] for r in ngram_join.drop_near_duplicates(docs).collect()) == [1, 3]
    assert mixing.mixed_documents(docs).columns == docs.columns
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    for call in (ngram_join.similarity_components, substring_dedup.substring_dedup):
        with pytest.raises(TypeError):
            call(named)
    bench = spark.createDataFrame([("q1", base), ("q1", base), (None, None), ("q2", "")], "item_id string, text string")
    found = sorted(map(tuple, decontamination.find_contamination(named, bench).select("doc_id", "item_id", "score").collect()))
    assert found == [("d1", "q1", 1.0)] * 2 + [("d2", "q1", 1.0)] * 2


# op3


def test_windows_of_repeated_and_missing_ids(spark):
    a, b = prose(random.Random(8), 30, 10**6), prose(random.Random(9), 30, 10**6)
    rows = [(4, a), (4, a), (7, a + " " + b), (None, b), (None, a), (9, b), (2, LONG), (3, LONG)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("x"))).collect()
    removed = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in got)
    # Equal ids don't remove each other, a missing id is later than all, missing ids don't affect each other.
    n = len(words_of(LONG))
    assert removed == Counter({(4, 30, 0): 2, (7, 60, 30): 1, (None, 30, 30): 2, (9, 30, 30): 1, (2, n, 0): 1, (3, n, n): 1})


# op10


def brute_components(rows, percent=75):
    sets = {}
    for i, t in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words_of(t)]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    at = {i: i for i in sets}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                at[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("full", [1, 3, ngram_join.FULL_CELL])
def test_links_with_full_cells_and_long_lists(spark, monkeypatch, full):
    monkeypatch.setattr(ngram_join, "LIST_PART", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng, rows = random.Random(10), []
    for family in range(4):
        base = prose(rng, 200).split()
        for _ in range(24):
            w = list(base)
            for _ in range(rng.randrange(14)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(200, LONG), (201, LONG + " and more"), (202, None), (203, "a b"), (204, "A  B")]
    got = ngram_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"), full=full)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(rows)


# op8


def test_conversations_without_id_beside_empty_ones(spark, tmp_path):
    turns = [(None, 1, "ann", "x"), (None, 2, "bob", "y"), ("", 1, "ann", "z"), ("", 2, "bob", "w"), ("c", 1, "ann", "s"), ("c", 1, "ann", "s"), ("c", 1, "bob", None), ("c", 1, "ann", "r"), ("c", None, None, LONG)]
    df = spark.createDataFrame(turns, "conv_id string, turn long, role string, text string").withColumn("conv", F.lit(1)).withColumn("lost", F.lit(2)).withColumn("__piece", F.lit(3))
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    agree(spark, tmp_path, chat_format.op8_chat_perspectives, chat_format.OP8_SQL)


# op4


def brute_grams(text, orders, buckets):
    """Buckets of the n-grams of one text, in plain integers."""
    cs = []
    for c in text:
        if c.isalpha():
            cs.append(ord(c.lower()) if ord(c) < 0x3000 and len(c.lower()) == 1 else ord(c))
        elif not cs or cs[-1] != 32:
            cs.append(32)
    out, bits = [], buckets.bit_length() - 1
    base = 0x100000001B3 * 2654435761 % 2**64 | 1
    for n in orders:
        for k in range(len(cs) - n + 1):
            h = n
            for c in cs[k : k + n]:
                h = (h * base + c) % 2**64
            out.append((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % 2**64 >> (64 - bits))
    return out


TEXTS = [(1, "the cat and the dog", "en"), (2, "the house on the hill", "en"), (3, "die katze und der hund", "de"), (4, "das haus auf dem berg", "de"), (5, "le chat et le chien", "fr"), (6, "猫と犬は家にいる", "ja"), (7, None, "en"), (8, "x", None), (9, "the cat and the dog", "en"), (None, "über den bergen", "de")]


@pytest.mark.parametrize("round_langs", [512, 2])
def test_posteriors_by_brute_force(spark, round_langs):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string").withColumn("best", F.lit(0)).withColumn("letters", F.lit("?"))
    model = language_id.train_language_model(docs)
    have, counts = Counter(l for _, t, l in TEXTS if t is not None and l), {}
    for t, l in {(t, l) for _, t, l in TEXTS if t is not None and l}:
        counts.setdefault(l, Counter()).update(brute_grams(t, language_id.ORDERS, language_id.BUCKETS))
    asked = [(1, "the dog and the house"), (2, "der hund und das haus"), (3, "犬は家に"), (4, None), (5, "12 -- !"), (6, ""), (7, "le chien " * 2000), (7, "le chien"), (None, "ÜBER DIE KATZE")]
    got = language_id.identify_language(spark.createDataFrame(asked, "doc_id long, text string"), model, round_langs=round_langs).collect()
    want = []
    for i, t in asked:
        joint = {}
        for l, c in counts.items():
            total = sum(c.values()) + language_id.SMOOTHING * language_id.BUCKETS
            joint[l] = math.log(have[l] / sum(have.values())) + sum(math.log((c[g] + language_id.SMOOTHING) / total) for g in brute_grams(t or "", language_id.ORDERS, language_id.BUCKETS))
        best = min(joint, key=lambda l: (-joint[l], l))
        share = 1 / sum(math.exp(v - joint[best]) for v in joint.values())
        want.append((i, best, round(share, 4)) if any(c.isalpha() for c in t or "") else (i, "und", 0.0))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(((r["doc_id"], r["lang_pred"], round(r["score"], 4)) for r in got), key=key) == sorted(want, key=key)


def test_more_languages_than_a_round_holds(spark):
    rng = random.Random(11)
    alphabets = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 9)) for _ in range(600)]
    rows = [(k, " ".join("".join(rng.choice(alphabets[k]) for _ in range(5)) for _ in range(60)), f"l{k:03d}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify_language(docs, language_id.train_language_model(docs), round_langs=250)
    assert got.join(docs, "doc_id").filter("lang_pred = lang").count() > 590


def test_letters_of_the_whole_code_space():
    text = "Aé中ア𠀀가 1〇，x"
    data = np.frombuffer(text.encode(), np.uint8)
    folded, letters, at = chargrams.codes(data, np.array([0, len(data)]))
    assert letters.tolist() == [c.isalpha() for c in text] and at.tolist() == [0, len(text)]
    assert [chr(c) for c in folded] == [c.lower() if c.isalpha() else " " for c in text]


# op9


def test_ratios_and_fit_by_brute_force(spark):
    rng = random.Random(12)
    mean, kind = "awful stupid nasty hateful".split(), "lovely gentle sunny thankful".split()
    rows = [(k, " ".join(rng.choice(mean if k % 3 == 0 and rng.random() < 0.7 else kind) if rng.random() < 0.5 else f"filler{rng.randrange(30)}" for _ in range(20))) for k in range(240)]
    labels = [(k, 5 if k % 3 == 0 else 0) for k in range(240)] + [(None, 1), (17, None), (9999, 1), (3, 5)]
    docs = spark.createDataFrame([*rows, (None, "awful"), (500, None)], "doc_id long, text string").withColumn("label", F.lit("z"))
    model = toxicity.train_toxicity_model(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    sets = [set(brute_grams(t, toxicity.ORDERS, toxicity.BUCKETS)) for _, t in rows]
    y = np.array([int(k % 3 == 0) for k in range(240)])
    p, q = (Counter(g for s, v in zip(sets, y, strict=True) if v == c for g in s) for c in (1, 0))
    total = [sum(c.values()) + toxicity.BUCKETS for c in (p, q)]
    ratio = {g: math.log((p[g] + 1) / total[0]) - math.log((q[g] + 1) / total[1]) for g in set(p) | set(q)}
    used = np.flatnonzero(model.weights)
    assert len(used) and all(p[g] + q[g] >= toxicity.LEAST_DOCS for g in used.tolist())
    # The fit is a minimum: with v = w / ratio, the loss's gradient in v and in the intercept is 0.
    x = np.array([[ratio[g] if g in s else 0.0 for g in used.tolist()] for s in sets])
    v = model.weights[used] / np.array([ratio[g] for g in used.tolist()])
    z = x @ v + model.intercept
    weight = np.where(y == 1, 81 / 80, 160 / 160)
    e = (1 / (1 + np.exp(-z)) - y) * weight / weight.sum()
    assert np.abs(x.T @ e + toxicity.PENALTY * v).max() < 2e-3 and abs(e.sum()) < 2e-3
    scored = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert np.allclose([scored[k]["score"] for k in range(240)], 1 / (1 + np.exp(-z)), atol=1e-4)
    assert np.isclose(scored[500]["score"], 1 / (1 + math.exp(-model.intercept))) and scored[None]["predicted"] == int(scored[None]["score"] >= 0.3)
    long = spark.createDataFrame([(1, "awful stupid nasty hateful " * 20_000), (1, "awful stupid nasty hateful")], "doc_id long, text string")
    assert len({r["predicted"] for r in toxicity.score_toxicity(long, model).collect()}) == 1


# op6


def test_spans_hold_their_alignments(spark):
    rng = random.Random(13)
    items = [prose(rng, n, 10**6) for n in (9, 25, 40)]
    cut = lambda t, n: " ".join(w for k, w in enumerate(t.split()) if k % n)
    texts = [prose(rng, 30) + " " + x + " " + prose(rng, 30) for t in items for x in (t, cut(t, 5))] + [LONG + " " + items[1] + " " + LONG, items[0] + " " + prose(rng, 200) + " " + items[0]]
    found = decontamination.find_contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (5, 2), (6, 1), (7, 0)}
    hashes = lambda t: decontamination.Items.read([(0, t)]).words[0]
    for r in found:
        item, part = hashes(items[r["item_id"]]), hashes(texts[r["doc_id"]])[r["begin_word"] : r["end_word"]]
        ((score, begin, end),) = decontamination.smith_waterman([(item, part)])
        assert score == r["score"] * 2 * len(item) and (begin, end) == (0, len(part))
    assert {r["begin_word"] for r in found if r["doc_id"] == 7} == {0}


# pipeline


def test_each_stage_keeps_the_right_rows(spark, tmp_path):
    rng = random.Random(14)
    items = [prose(rng, 20, 10**6) for _ in range(3)]
    base = prose(rng, 80, 10**6).split()
    texts = [prose(rng, rng.randrange(10, 80), 10**6) for _ in range(60)] + [" ".join(base)] * 4
    texts += [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in (10, 40)] + [prose(rng, 20) + " " + t + " " + prose(rng, 9) for t in items] + [None, "", "one two"]
    texts = [f"{t} awful nasty hateful slur" if k < 60 and k % 6 == 0 else t for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(k, t, "en", f"s{k % 4}" if k % 9 else None) for k, t in enumerate(texts)], DOCS)
    spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(60)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages, sf = dict(corpus_pipeline.STAGES), str(tmp_path)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())

    kept = stages["toxicity"](spark, docs, sf)
    model = toxicity.train_toxicity_model(docs, common.table(spark, sf, "labels"))
    clean = {r["doc_id"] for r in toxicity.score_toxicity(docs, model).collect() if r["score"] < 0.3}
    assert rows(kept) == rows(docs.filter(F.col("doc_id").isin(list(clean)))) and clean >= {k for k in range(60) if k % 6} and not clean & {k for k in range(60) if k % 6 == 0}

    kept = stages["ngram_jaccard_join"](spark, docs, sf)
    assert ids(kept) == Counter(i for i, (_, c) in brute_components(list(enumerate(texts))).items() if i == c)

    kept = stages["benchmark_decontamination"](spark, docs, sf)
    hashes = [decontamination.Items.read([(0, t)]).words[0] for t in texts + items]
    pairs = [(d, k) for d in range(len(texts)) for k in range(3)]
    scores = decontamination.smith_waterman([(hashes[len(texts) + k], hashes[d]) for d, k in pairs])
    bad = {d for (d, k), s in zip(pairs, scores, strict=True) if s[0] >= 0.5 * 2 * len(hashes[len(texts) + k])}
    assert ids(kept) == Counter(i for i in range(len(texts)) if i not in bad) and len(bad) == 3

    mixed, size = ids(stages["source_mixing"](spark, docs, sf)), {k: len(words_of(t)) for k, t in enumerate(texts)}
    take = {r["doc_id"]: r for r in mixing.mix_sources(docs, own_blocks=True).collect()}
    assert mixed == Counter({k: n for k in size if (n := 1 if not size[k] else math.floor(take[k]["taken"] / size[k] + 0.5))})
    for source in {f"s{k}" for k in range(4)} | {None}:
        mine = [k for k in size if (f"s{k % 4}" if k % 9 else None) == source]
        words, target = sum(mixed[k] * size[k] for k in mine), take[mine[0]]["target"]
        assert abs(words - target) <= max(size[k] for k in mine) / 2 + 0.01 * target + 1

    out = stages["sharding"](spark, docs, sf).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(size)


def test_tables_can_be_cleaned_up(spark):
    df, path = common.materialize(spark.range(3), "short-lived")
    assert path in common._TABLES and df.count() == 3
    common.cleanup(spark)
    assert not common._TABLES and not Path(path.removeprefix("file:")).exists()


def test_every_operator_has_its_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries() if n != "pipeline") == list(range(1, 11))


def test_a_language_may_be_called_und(spark):
    docs = spark.createDataFrame([(1, "aaa aab aaa", "und"), (2, "zzz zzy zzz", "xx"), (3, "aab aaa aab", "und"), (4, "zzy zzz", "xx")], "doc_id long, text string, lang string")
    model = language_id.train_language_model(docs)
    asked = spark.createDataFrame([(1, "aaa aab"), (2, "zzz"), (3, None), (4, "123 !")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify_language(asked, model).collect()}
    assert got[1][0] == "und" and got[1][1] > 0.5 and got[2][0] == "xx" and got[3] == got[4] == ("und", 0.0)
