"""Corpus operators on a small table of awkward rows: against SQL, brute force, invariants or held-out accuracy."""

import hashlib
import random
import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import agree  # noqa: E402

import corpus_pipeline  # noqa: E402
from quillstat.llm import chat_format, common, components, decontamination, exact_dedup, language_id, mixing, ngram_join, registry, sharding, substring_dedup, textscan, toxicity, warc  # noqa: E402

WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha", "ki", "lo") for b in ("n", "rt", "mo", "xe", "vy", "ss", "él", "ß")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def edited(rng, text, every):
    w = text.split()
    for i in range(rng.randrange(every), len(w), every):
        w[i] = "edit" + str(rng.randrange(10**6))
    return " ".join(w)


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """documents with copies, edited copies, a shared passage, nulls, blanks, short and long texts, many of one source."""
    rng, d = random.Random(5), tmp_path_factory.mktemp("sf")
    base, passage, items = prose(rng, 120), prose(rng, 60), [prose(rng, 30) for _ in range(5)]
    texts = [prose(rng, rng.randrange(6, 200)) for _ in range(60)]
    texts += [base] * 9 + [base.replace(" ", "\t\n ", 7)] + [edited(rng, base, 40) for _ in range(25)]
    texts += [prose(rng, 30) + " " + passage + " " + prose(rng, 30) for _ in range(8)]
    texts += [prose(rng, 20) + " " + items[k] + " " + prose(rng, 20) for k in range(4)] + [prose(rng, 25) + " " + edited(rng, items[4], 9)]
    texts += [None, "", " \t\n", "one", "One  two three four", "one two three four", prose(rng, 5000), "12 34 -- !!", "x" * 5000]
    docs = [(i, t, "en" if i % 3 else "fr", None if i % 11 == 3 else ("hot" if i % 2 else f"s{i % 5}"), len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)) + [(5, None), (6, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(i, f"http://h/{i}", "<p>" + prose(rng, 20 + i % 5)) for i in range(300)] + [(300, None, None), (301, "u", "")], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    turns = [(c, t, r, prose(rng, 5)) for c in range(6) for t, r in enumerate(["system", "ann", "bob", "ann", None][: 3 + c % 3])] + [(9, t, "ann" if t % 2 else "bob", "hé" * (t % 4)) for t in range(200)] + [(10, None, "ann", None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d, docs, items


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, data, name):
    agree(spark, data[0], registry.queries()[name], registry.oracle_sql()[name])


def test_exact_groups_by_brute_force(spark, data):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t, *_ in data[1]}
    first = {}
    for i in sorted(norm):
        first.setdefault(norm[i], i)
    got = exact_dedup.exact_groups(spark.read.parquet(f"{data[0]}/documents.parquet"), first_digit=4, growth=2).collect()
    assert {r["doc_id"]: r["keep_id"] for r in got} == {i: first[t] for i, t in norm.items()}
    assert all(r["text_sha256"] == hashlib.sha256(norm[r["doc_id"]].encode()).hexdigest() for r in got)


def test_rows_without_id_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b", 1), (1, "a b", 2), (1, "a b", 2), (2, "a b", 3), (None, None, 4)], "doc_id long, text string, digit int")
    got = sorted(exact_dedup.exact_groups(df).select("doc_id", "keep_id", "group_size", "kept").collect(), key=str)
    assert [tuple(r) for r in got if r["doc_id"] == 2] == [(2, 1, 3, False)] and sum(r["kept"] for r in got) == 4
    parts = ngram_join.similarity_components(df).collect()
    assert len(parts) == 5 and {r["component_id"] for r in parts if r["doc_id"]} == {1} and all(r["component_id"] is None for r in parts if r["doc_id"] is None)
    assert substring_dedup.substring_dedup(df).count() == 5


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    bench, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train_toxicity_model(docs, labels)
    frames = [exact_dedup.exact_groups(docs), mixing.mix_sources(docs), mixing.mixed_documents(docs), substring_dedup.substring_dedup(docs), language_id.identify_language(docs, language_id.train_language_model(docs)), sharding.shard_by_kd_tree(docs), decontamination.find_contamination(docs, bench), decontamination.drop_contaminated(docs, bench), toxicity.score_toxicity(docs, model), toxicity.drop_toxic(docs, model), ngram_join.similarity_components(docs), ngram_join.drop_near_duplicates(docs)]
    assert [f.count() for f in frames] == [0] * len(frames)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.audit(warc.layout(pages), warc.layout(pages))[0].count() == 0
    assert chat_format.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_extra_columns_with_clashing_names_pass_through(spark, data):
    names = ["block", "group", "token", "size", "place", "piece", "n", "label", "score", "id"]
    docs = spark.read.parquet(f"{data[0]}/documents.parquet").select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    bench = spark.read.parquet(f"{data[0]}/benchmark.parquet")
    for out in (mixing.mixed_documents(docs), ngram_join.drop_near_duplicates(docs), decontamination.drop_contaminated(docs, bench)):
        assert out.columns == docs.columns and out.count() > 0
    assert sharding.shard_by_kd_tree(docs).count() == docs.count() == substring_dedup.substring_dedup(docs).count()


def test_mix_meets_its_targets(spark, data):
    got = mixing.mix_sources(spark.read.parquet(f"{data[0]}/documents.parquet")).collect()
    source, by = {x[0]: x[3] for x in data[1]}, {}
    for r in got:
        by.setdefault((source[r["doc_id"]], r["target"]), []).append(r["taken"])
        assert 0 <= r["taken"] <= 3 * r["size"]
    total = sum(r["size"] for r in got)
    assert len(by) == len(set(source.values()))
    assert [(k, sum(v)) for k, v in by.items() if abs(sum(v) - k[1]) > 0.01 * total] == []


def test_mixed_documents_hold_small_sources_in_full(spark):
    sizes = {"a": [500] * 100, "b": [15] * 10, "c": [70] * 10, "d": [500] * 100}
    rows = [(100 * k + i, " ".join(["w"] * n), s) for k, (s, ns) in enumerate(sizes.items()) for i, n in enumerate(ns)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    # Blocks of 1,024 words, as a corpus of 67 million words has them.
    got = {r["source"]: r["count"] for r in mixing.mixed_documents(docs, min_slots=64).groupBy("source").count().collect()}
    assert got["b"] == got["c"] == 30 and abs(500 * (got["a"] + got["d"]) - (100850 - 3 * 850)) <= 1000


def test_shards_are_even_and_gapless(spark, data):
    docs = spark.read.parquet(f"{data[0]}/documents.parquet")
    many = docs.filter("length(text) < 3000").withColumn("doc_id", F.explode(F.array(*[F.col("doc_id") + 1000 * k for k in range(20)])))
    got = sharding.shard_by_kd_tree(many).collect()
    sizes, slots = {}, {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(sizes) == list(range(24)) and max(sizes.values()) < 1.1 * min(sizes.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_contaminated_documents_are_found_and_no_others(spark, data):
    d, docs, items = data
    have = {i for i, t, *_ in docs for w in items for k in range(len(w.split()) - 7) if t and " ".join(w.split()[k : k + 8]) in t}
    found = decontamination.find_contamination(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")).collect()
    assert {r["doc_id"] for r in found} == have and min(r["score"] for r in found) >= 0.5
    rounds = decontamination.find_contamination(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet"), round_bytes=300).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rounds} == {(r["doc_id"], r["item_id"]) for r in found}


def altered(rng, text, how, every):
    """The text with each ``every``-th word replaced or left out, or with a word put in after it."""
    new = lambda: "edit" + str(rng.randrange(10**6))
    out = []
    for k, w in enumerate(text.split(), 1):
        hit = k % every == 0
        out += {"put in": [w, new()], "replaced": [new()], "left out": []}[how] if hit else [w]
    return " ".join(out)


def found_and_expected(spark, rng, items, copies, **options):
    """(document, item) pairs that are found, and those whose alignment over the whole document reaches the threshold."""
    texts = [prose(rng, 40) + " " + c + " " + prose(rng, 40) for c in copies] + [prose(rng, 150) for _ in range(20)]
    found = decontamination.find_contamination(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), **options
    ).collect()
    words = [decontamination.Items.read([(0, t)]).words[0] for t in texts + items]
    pairs = [(d, k) for d in range(len(texts)) for k in range(len(items))]
    scores = decontamination.smith_waterman([(words[len(texts) + k], words[d]) for d, k in pairs])
    threshold = options.get("threshold", decontamination.THRESHOLD)
    want = {p: s[0] / (2 * len(words[len(texts) + p[1]])) for p, s in zip(pairs, scores, strict=True)}
    return {(r["doc_id"], r["item_id"]): r["score"] for r in found}, {p: s for p, s in want.items() if s >= threshold}


def test_edited_copies_are_found_beside_verbatim_ones(spark):
    rng = random.Random(11)
    items = [prose(rng, 30 + k) for k in range(6)]
    copies = [x for t in items for x in (t, altered(rng, t, "replaced", 4), altered(rng, t, "put in", 3), altered(rng, t, "left out", 4))]
    found, want = found_and_expected(spark, rng, items, copies)
    assert found == want and len(want) == len(copies)


def test_every_alignment_over_the_threshold_is_found(spark):
    rng = random.Random(12)
    items = [prose(rng, n) for n in (3, 5, 12, 31, 44)] + [" ".join(rng.choice(WORDS[:6]) for _ in range(20)), "two words"]
    edits = [("put in", 1), ("put in", 2), ("replaced", 3), ("replaced", 4), ("left out", 3), ("replaced", 2), ("left out", 2)]
    copies = [altered(rng, t, *e) for t in items for e in edits] + ["two other words", "one of two words"]
    copies += [" ".join(rng.choice(WORDS[:6]) for _ in range(300)), " ".join(prose(rng, 9) + " " + altered(rng, items[4], "put in", 2) for _ in range(6))]
    for options in ({}, {"threshold": 0.4}, {"round_bytes": 300}):
        found, want = found_and_expected(spark, rng, items, copies, **options)
        assert found == {p: s for p, s in want.items() if p[1] != 6 or s == 1} and len(want) > 4 * len(items)


def test_upper_cased_copies_are_found(spark):
    rng = random.Random(13)
    items = [" ".join(rng.choice("áñóöüßçøд") + w + rng.choice("éíúäßσ") for w in prose(rng, 20).split()) for _ in range(2)]
    texts = [items[0].upper(), prose(rng, 30) + " " + items[1].upper() + " " + prose(rng, 30), items[1].title(), prose(rng, 50)]
    found = decontamination.find_contamination(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    ).collect()
    assert sorted((r["doc_id"], r["item_id"], r["score"], r["begin_word"]) for r in found) == [(0, 0, 1.0, 0), (1, 1, 1.0, 30), (2, 1, 1.0, 0)]


def test_smith_waterman_by_brute_force():
    rng = random.Random(1)
    import numpy as np

    for _ in range(20):
        a, b = ([rng.randrange(6) + 2 for _ in range(rng.randrange(1, 12))] for _ in range(2))
        h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                best = max(best, h[i][j])
        assert decontamination.smith_waterman([(np.array(a, np.uint64), np.array(b, np.uint64))])[0][0] == best


def test_substrings_round_trip(spark, data):
    texts = {i: (t or "") for i, t, *_ in data[1]}
    for r in substring_dedup.substring_dedup(spark.read.parquet(f"{data[0]}/documents.parquet")).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]])
        gone = {k for s in r["spans"] for k in range(s["start"], s["end"])}
        assert r["kept_text"] == " ".join(w for k, w in enumerate(words) if k not in gone) and r["n_removed"] == len(gone)


def test_languages_held_out(spark):
    got = language_id.op4_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "the thing and that")], "doc_id long, text string")
    model = language_id.train_language_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert [r["lang_pred"] for r in language_id.identify_language(odd, model).orderBy("doc_id").collect()] == ["und", "und", "und", "en"]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    r = {(x["toxic"], x["predicted"]): x["count"] for x in got.groupBy("toxic", "predicted").count().collect()}
    assert r[1, 1] / (r[1, 1] + r.get((1, 0), 0)) > 0.7 and r.get((0, 1), 0) / (r[0, 0] + r.get((0, 1), 0)) < 0.02


def test_audit_finds_changes_losses_and_additions(spark):
    rows = [(k // 50, 1000 * (k % 50), 900, f"d{k}") for k in range(200)]
    other = [(f, o, n, "bad" if k == 17 else d) for k, (f, o, n, d) in enumerate(rows) if k != 60] + [(3, 60000, 10, "new")]
    schema = "file_no long, offset long, length long, digest string"
    bad, visited = warc.audit(spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema), leaf_bytes=4000, fanout=4, file_bytes=64000)
    assert sorted(map(tuple, bad.collect())) == [(0, 17000, "corrupt"), (1, 10000, "missing"), (3, 60000, "extra")]
    assert all(r["differ"] <= 3 and r["compared"] <= 12 + 4 for r in visited.collect())


def test_perspectives_make_whole_renderings(spark, data):
    got = chat_format.op8_chat_perspectives(spark, str(data[0])).filter("conv_id = 9 AND perspective = 'ann'").orderBy("start").collect()
    whole = "".join(r["segment"] for r in got)
    assert len(got) == 200 and all(whole[r["start"] : r["stop"]] == r["segment"] for r in got)
    masked = [whole[r["mask_start"] : r["mask_stop"]] for r in got if r["mask_start"] is not None]
    assert len(masked) == 100 and all(m.endswith("<|im_end|>") for m in masked)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    labels, _ = components.components(links)
    assert {r["id"]: r["label"] for r in labels.collect()} == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def test_word_scanner(spark):
    import pyarrow as pa

    column = pa.array(["a  bb\tc", None, "", " \n", "é\x0bz"])
    ((_, _, raw, offsets),) = textscan.slices(column)
    words = textscan.Words(raw, offsets)
    assert words.counts.tolist() == [3, 0, 0, 0, 2] and words.joined(0) == b"a bb c" and words.joined(4) == "é z".encode()
    h = words.hashes()
    assert len(set(h.tolist())) == 5


def test_pipeline_stages(spark, data):
    docs = common.table(spark, str(data[0]), "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(data[0]))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.schema == docs.schema, name
            docs, _ = common.materialize(out, "test")
    assert {r["shard"] for r in out.collect()} <= set(range(24)) and out.count() == docs.count()
