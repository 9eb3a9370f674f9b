"""Conversation repair, token files and collocations against brute force; ids that repeat in exact_groups."""

import hashlib
import random
import re
import sys
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import agree  # noqa: E402

from quillstat.llm import conversation_repair, exact_dedup, phrases, token_files  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# op1


def test_one_id_on_two_long_texts(spark):
    a, b = "a" * 128, "b" * 128
    rows = [(1, a + "ax"), (2, a + "ax"), (1, b + "bx"), (3, b + "bx"), (1, a + "ay"), (4, "short"), (1, "short"), (5, a + "ax")]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = []
    for i, t in rows:
        group = [j for j, u in rows if u == t]
        want.append((i, min(group), len(group), i == min(group), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(tuple(r) for r in got) == sorted(want)


# op11


def brute_damage(rows):
    out = {}
    for c, t, r, x in rows:
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        out.setdefault(c, [])
        if hit:
            x = "" if hit == 1 else re.sub("[.!?]", "", x) if hit == 2 else x
            out[c] += [(t, "user" if hit == 4 else r, x)] * (2 if hit == 3 else 1)
    return out


def brute_repair(rows):
    """The report and the repaired (role, text) rows of one conversation, by dynamic programming over whole audits."""
    mark = lambda z: hashlib.sha256(f"{len(z[1])}:{z[1]}{z[2]}".encode()).digest()
    rows = sorted(rows, key=lambda z: (z[0] is not None, z[0] or 0, mark(z)))
    seen, faults = set(), []
    for _, r, x in rows:
        chars = re.findall(r"[^\x20\x09-\x0D]", x)
        faults.append("b" if not chars else "d" if (r, x) in seen else "t" if chars[-1] not in ".!?" else "")
        seen.add((r, x))
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    allowed = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    def insertions(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    new = (cost + 2, audit + "I", (*lines, (role, "")))
                    if (state, role[0]) in allowed and (role[0] not in best or new < best[role[0]]):
                        best[role[0]] = new
        return best

    best = insertions({"": (0, "", ())})
    for (_, r, x), fault, initial in zip(rows, faults, initials, strict=True):
        after = {}
        for state, (cost, audit, lines) in best.items():
            arcs = [(state, (cost + 3, audit + "D", lines))]
            if fault in ("", "t"):
                more = cost + (fault == "t")
                arcs += [(initial, (more, audit + "K", (*lines, (r, x))))] if (state, initial) in allowed else []
                arcs += [(role[0], (more + 2, audit + "R", (*lines, (role, x)))) for role in ("user", "assistant") if (state, role[0]) in allowed]
            for to, new in arcs:
                after[to] = min(after.get(to, new), new)
        best = insertions(after)
    cost, audit, lines = min(best[k] for k in ("", "a") if k in best)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest()
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest), list(lines)


def awkward_turns(seed, long=300):
    rng, rows = random.Random(seed), []
    roles = ["user", "assistant", "system", "tool", "", "User", None, "user", "assistant"]
    texts = ["Hi.", "ok", "", "  ", "Really?!\n", "só é.", None, "end. ", "a\nb."]
    for c in range(60):
        for t in range(rng.randrange(1, 25) if c else long):
            rows.append((c if c != 7 else None, rng.choice([None, t, t, t, t // 2]), rng.choice(roles), rng.choice([*texts, f"x{t}", f"y{t}."])))
    return rows


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("bits", [16, 3])
def test_repairs_by_brute_force(spark, bits):
    rows = awkward_turns(1)
    made = conversation_repair.plan_repairs(conversation_repair.damaged(spark.createDataFrame(rows, TURNS).repartition(5)), bits)
    want = {c: brute_repair(v) for c, v in brute_damage(rows).items()}
    assert {r[0]: tuple(r)[1:] for r in made.report().collect()} == {c: w[0] for c, w in want.items()}
    lines = {}
    for r in made.turns().orderBy("conv_id", "position").collect():
        assert r["position"] == len(lines.setdefault(r["conv_id"], []))
        lines[r["conv_id"]].append((r["role"], r["text"]))
    assert lines == {c: w[1] for c, w in want.items() if w[1]}


def test_repair_sql_on_awkward_rows(spark, tmp_path):
    spark.createDataFrame(awkward_turns(2, 40), TURNS).withColumn("mark", F.lit(1)).withColumn("kind", F.lit("x")).write.parquet(f"{tmp_path}/conversations.parquet")
    agree(spark, tmp_path, conversation_repair.op11_conversation_repair, conversation_repair.OP11_SQL)


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert conversation_repair.plan_repairs(conversation_repair.damaged(none)).report().collect() == []
    lost = spark.createDataFrame([(5, 1, "user", "Hi.", True)], TURNS + ", lost boolean")
    assert [tuple(r) for r in conversation_repair.plan_repairs(lost).report().collect()] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_text_in_a_conversation(spark):
    rows = [(1, 0, "user", "word " * 400_000 + ".", False), (1, 1, "assistant", "Yes.", False)]
    got = conversation_repair.plan_repairs(spark.createDataFrame(rows, TURNS + ", lost boolean")).report().collect()[0]
    assert got["audit"] == "KK" and got["repaired_sha256"] == hashlib.sha256(f"user:{rows[0][3]}\nassistant:Yes.".encode()).hexdigest()


# op12

DOCS = "doc_id long, text string, n long, frame string"


def token_rows():
    rng = random.Random(6)
    odd = [None, "", "   ", "It's A-OK, isn't it?! (Yes.)", "É é ça; naïve… 東京 123abc", "<|endoftext|>Hello, World", "x" * 3000, "a.b,c;d:e!f?g", "́a .́b", "İI ΑΣ. Σ,", "tab\tline\nend\x0bmore"]
    rows = [(k, t) for k, t in enumerate(odd)]
    rows += [(100 + k, " ".join(rng.choice(["Alpha", "beta,", "gamma.", "Δelta", "it's", "x1"]) for _ in range(rng.randrange(1, 90)))) for k in range(150)]
    rows += [(None, "no id"), (None, None), (120, "same id again"), (120, "same id again"), (999, "long word " * 60_000)]
    return [(i, t, 1, "clash") for i, t in rows]


def expected_tokens(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return [(i, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x, *_ in rows]


@pytest.mark.parametrize("by_unit,vocabulary", [(True, 49_408), (False, 1 << 32)])
def test_token_files_round_trip(spark, by_unit, vocabulary):
    rows = token_rows()
    files = token_files.write_token_files(spark.createDataFrame(rows, DOCS).repartition(5), TOKENIZER, end_id=2, file_bytes=2000, vocabulary=vocabulary, by_unit=by_unit)
    want = expected_tokens(rows)
    got = files.read().withColumn("start", F.col("before") + F.col("local")).orderBy("start").collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(x), crc(x)) for i, x in want)
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r["start"] for r in got] == np.concatenate(([0], np.cumsum([r["n_tokens"] for r in got])))[:-1].tolist()
    assert files.manifest.count() > 3
    fetched = files.fetch([3, 120, 130, 12345]).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in fetched) == sorted((i, x) for i, x in want if i in (3, 120, 130))


def test_token_files_of_nothing_and_damage(spark):
    none = token_files.write_token_files(spark.createDataFrame([], DOCS), TOKENIZER, end_id=2, by_unit=True)
    assert none.read().collect() == [] and none.fetch([1]).collect() == []
    one = token_files.write_token_files(spark.createDataFrame(token_rows(), DOCS), TOKENIZER, end_id=2, by_unit=True)
    path = one.manifest.first()["path"]
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.Reader(path, one.dictionary + b"x")
    data = bytearray(Path(path).read_bytes())
    data[-token_files.FOOT.size - 3] ^= 1
    Path(path).write_bytes(bytes(data))
    with pytest.raises(ValueError, match="no whole file"):
        token_files.Reader(path, one.dictionary)


def test_ids_beyond_the_vocabulary_are_refused(spark):
    docs = spark.createDataFrame([(1, "a", 1, "")], DOCS)
    with pytest.raises(Exception, match="beyond the stated vocabulary"):
        token_files.write_token_files(docs, TOKENIZER, end_id=70_000, vocabulary=100)


# op13


def brute_phrases(rows, least, top):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, every in counts.items():
        found = []
        for p, a in every.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and f >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, f in every.items() if f >= least):
                continue
            score, _, left, right = min((1000 * a * totals[lang] // (every[p[:k]] * every[p[k:]]), k, every[p[:k]], every[p[k:]]) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), left, right))
        found.sort(key=lambda z: (-z[0], -z[1], z[2].encode()))
        out += [(lang, k + 1, p, a, x, y, totals[lang], s) for k, (s, a, p, x, y) in enumerate(found[:top])]
    return sorted(out)


PHRASES = "lang string, text string, h long, f long, words string"


@pytest.mark.parametrize("ranked,filter_bits,top", [(1 << 20, 27, 2000), (6, 12, 2000), (0, 10, 5)])
def test_collocations_by_brute_force(spark, ranked, filter_bits, top):
    rng = random.Random(9)
    base = ["New York city", "of the", "in New York city hall", "ça et là", "x", "a a a a a a", "the, end", "the\nend"]
    rows = [(rng.choice(["en", "en", "fr", None, "und"]), " ".join(rng.choice(base) for _ in range(rng.randrange(0, 30)))) for _ in range(150)]
    rows += [("en", None), (None, ""), ("en", " ,, \t"), ("en", "long tail " * 20_000)]
    docs = spark.createDataFrame([(*r, 1, 2, "clash") for r in rows], PHRASES).repartition(6)
    got = phrases.collocations(*phrases.frequent_phrases(docs, least=8, ranked=ranked, filter_bits=filter_bits), top=top).collect()
    assert sorted(tuple(r) for r in got) == brute_phrases(rows, 8, top)


def test_collocations_of_nothing(spark):
    none = spark.createDataFrame([], PHRASES)
    assert phrases.collocations(*phrases.frequent_phrases(none)).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    n = 3 * 10**13
    rows = [("en", [1], "a", 1, 10**13 + 7), ("en", [2], "b", 1, 10**13 + 9), ("en", [1, 2], "a b", 2, 10**12 + 3)]
    table = spark.createDataFrame(rows, "lang string, words array<long>, phrase string, m int, f long")
    got = phrases.collocations(table, spark.createDataFrame([("en", n)], "lang string, n long")).collect()
    assert got[0]["score"] == 1000 * (10**12 + 3) * n // ((10**13 + 7) * (10**13 + 9))


def test_dense_and_sparse_tiles_add_up():
    rng = np.random.default_rng(1)
    codes = np.concatenate((rng.integers(0, 4096, 5000), rng.integers(0, 1 << 50, 3000), rng.integers(1 << 38, (1 << 38) + 4096, 4000))).astype(np.uint64)
    counts = rng.integers(1, 9, len(codes))
    want = Counter()
    for c, n in zip(codes.tolist(), counts.tolist(), strict=True):
        want[c] += n
    for given, expect in ((counts, want), (None, Counter(codes.tolist()))):
        c, n = phrases.combine(codes, given)
        assert dict(zip(c.tolist(), n.tolist(), strict=True)) == expect


def _held(run, batches):
    """What a task's function gives, and the most memory (MB) that its arrays took."""
    tracemalloc.start()
    try:
        out = list(run(iter(batches)))
        return out, tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def _number_texts(high, rows, seed):
    ids = np.random.default_rng(seed).integers(0, high, (rows, 300))
    texts = pa.array([" ".join(map(str, x)) for x in ids.tolist()])
    return ids, [pa.RecordBatch.from_arrays([pa.array(["en"] * rows), texts], ["lang", "text"])]


def _word_counter():
    docs = MagicMock()
    phrases.words_of(docs)
    return docs.mapInArrow.call_args.args[0]


def test_counting_words_takes_bounded_memory(spark):
    ids, batches = _number_texts(1 << 19, 8_000, 3)
    out, most = _held(_word_counter(), batches)
    assert most < 100, most
    got = Counter()
    for b in out:
        assert b.nbytes < 16 << 20
        for word, f in zip(b.column("word").to_pylist(), b.column("f").to_pylist(), strict=True):
            got[word] += f
    assert got.pop(None) == ids.size
    assert got == Counter(map(str, ids.ravel().tolist()))


@pytest.mark.parametrize("ranked", [1 << 20, 1000])
def test_counting_pairs_takes_bounded_memory(spark, ranked):
    ids, batches = _number_texts(3000, 8_000, 4)
    words = {}
    for b in _word_counter()(iter(batches)):
        for lang, word, h, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if word is not None:
                words[h] = (lang, h, words.get(h, (0, 0, 0))[2] + f)
    level = phrases.Symbols(spark.createDataFrame(list(words.values()), "lang string, h long, f long"), ranked, 20)
    docs = MagicMock(sparkSession=spark)
    phrases.count_pairs(docs, [level], 256, 1)
    sent, most = _held(docs.mapInArrow.call_args.args[0], batches)
    assert most < 140, most
    assert max(b.nbytes for b in sent) < 8 << 20
    received = pa.Table.from_batches(sent).sort_by("bucket").to_batches(max_chunksize=32)
    totals = docs.mapInArrow.return_value.repartition.return_value.sortWithinPartitions.return_value.mapInArrow.call_args.args[0]
    out, most = _held(totals, received)
    assert most < 140, most
    _, counts = np.unique(ids[:, :-1] * 3000 + ids[:, 1:], return_counts=True)
    assert np.array_equal(np.sort(np.concatenate([b.column("f").to_numpy() for b in out])), np.sort(counts))


def test_batches_are_limited_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    rows = spark.range(0, 2000, 1, 1).selectExpr("repeat('x y. ', 1000) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["size"])

    with phrases.small_batches(spark):
        seen = rows.mapInArrow(sizes, "size long").collect()
    assert max(r["size"] for r in seen) < 2 * phrases.BATCH_BYTES
    assert spark.conf.get(name, None) == before
