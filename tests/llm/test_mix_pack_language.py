"""Mixing, packing and language identification."""

import os
import random
import sys
import unicodedata
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from twinsift.llm import language, mixing, packing, queries  # noqa: E402
from twinsift.llm.text_arrays import BLOCK_CHARS, BLOCK_TEXTS, blocks  # noqa: E402
from twinsift.llm.tokens import ids_of, vocabulary  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(vocabulary())
    loaded.encode_special_tokens = True
    return loaded


# ---- mixing -------------------------------------------------------------------------------


def check_mix(rows, mixed):
    sizes, sources = {}, defaultdict(int)
    for doc, source, text in rows:
        sizes[doc] = brute.size(text)
        sources[source] += sizes[doc]
    want, taken = brute.targets(sources), defaultdict(int)
    of = {doc: source for doc, source, _ in rows}
    assert len(mixed) == len(rows)
    for r in mixed:
        assert r.size == sizes[r.doc_id] and r.source_size == sources[of[r.doc_id]]
        assert r.target == pytest.approx(want[of[r.doc_id]])
        assert r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        if r.target > r.source_size:
            assert r.taken >= r.size  # complete epochs come first
        taken[of[r.doc_id]] += r.taken
    for source, target in want.items():
        largest = max(sizes[d] for d, s, _ in rows if s == source)
        assert abs(taken[source] - target) <= largest / 2 + 1e-6
    return taken


def test_mix_of_documents(spark):
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    one, two = (queries.op7_mix(spark, SF).collect() for _ in range(2))
    check_mix(rows, one)
    assert sorted(one) == sorted(two)


def test_mix_with_hot_empty_and_missing_sources(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["big"] * 8 + ["b", "ä", "Z", "", None]), "w " * rng.randrange(0, 60)) for i in range(400)]
    rows += [(1000, "none", None), (1001, "none", " \x0b\t"), (1002, "spaces", "a b \x1cc")]
    frame = spark.createDataFrame([(d, s, t, 1.0) for d, s, t in rows],
                                  "doc_id long, source string, text string, target double")
    mixed = mixing.mix(frame).withColumnRenamed("id", "doc_id").collect()
    check_mix(rows, mixed)
    again = Counter(r.doc_id for r in mixing.mixed_rows(frame).collect())
    assert again == Counter({r.doc_id: r.times for r in mixed if r.times})


def test_mix_of_repeated_rows_and_nothing(spark):
    frame = spark.createDataFrame([(1, "a", "x y")] * 3 + [(None, None, None)], "doc_id long, source string, text string")
    mixed = mixing.mix(frame)
    assert mixed.count() == 4
    assert mixing.mixed_rows(frame).count() == mixed.agg(F.sum("times")).first()[0]
    assert mixing.mix(frame.limit(0)).count() == 0


def test_quality_raises_the_chance(spark):
    # Sizes 5, 3 and 4 share 18: the first stops at 10, the others split 8 by 2 to 1, so the last is cut to 2.67.
    frame = spark.range(4800).select(F.col("id").alias("doc_id"), F.lit("x y z").alias("text"), F.when(
        F.col("id") % 12 < 5, "a").when(F.col("id") % 12 < 8, "b").otherwise("c").alias("source"))
    quality = spark.range(4800).select("id", F.when(F.col("id") % 8 < 4, 4.0).otherwise(1.0).alias("weight"))
    part = mixing.mix(frame, quality).where("target < source_size").select((F.col("id") % 8 < 4).alias("good"), "taken")
    rates = {r.good: r.t for r in part.groupBy("good").agg(F.avg("taken").alias("t")).collect()}
    assert rates[True] > 1.3 * rates[False]


def test_equal_targets_share_the_level(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 4), ("c", 2), ("d", 10), ("e", 100)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got == pytest.approx(brute.targets({"a": 10, "b": 4, "c": 2, "d": 10, "e": 100}))


# ---- packing ------------------------------------------------------------------------------


def check_packing(pieces, capacity):
    by_sequence = defaultdict(list)
    for r in pieces:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for members in by_sequence.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_of_documents(spark, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.op2_pack(spark, SF).collect()
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.doc_id, r.piece)):
        got[r.doc_id].append((r.start, r.length, r.ids_crc32))
    assert got == {doc: brute.pieces(text, tokenizer) for doc, text in texts.items()}
    sequences = check_packing(found, 2048)
    assert sequences <= brute.fewest([r.length for r in found], 2048) * 1.01 + 1


def test_packing_of_edge_cases(spark, tokenizer):
    rows = [(1, None), (2, ""), (3, "a " * 5000), (3, "a " * 5000), (None, "b"), (4, "<|endoftext|> x")]
    rows += [(10 + i, "hot " * 20) for i in range(500)]
    frame = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, offset long")
    found = packing.pack(frame).collect()
    want = Counter((d, i, *p) for d, t in rows for i, p in enumerate(brute.pieces(t, tokenizer)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    check_packing(found, 2048)
    assert packing.pack(frame.limit(0)).count() == 0


def test_plan_holds_every_length_once():
    rng = random.Random(11)
    for _ in range(200):
        capacity = rng.choice([10, 30, 100])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 80)))
        found = packing.plan(dict(counts), capacity)
        assert all(sum(lengths) <= capacity and times > 0 for lengths, times in found)
        got = Counter()
        for lengths, times in found:
            for n in lengths:
                got[n] += times
        assert got == counts


def fewest_sequences(lengths, capacity):
    """The best packing of a few lengths, by trying all."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for j in {room: j for j, room in enumerate(rooms) if room >= lengths[i]}.values():
            place(i + 1, rooms[:j] + [rooms[j] - lengths[i]] + rooms[j + 1:])
        place(i + 1, rooms + [capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def test_reduction_costs_no_sequence():
    rng = random.Random(5)
    for _ in range(150):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        fixed, left = packing.reduce_by_dominance(dict(Counter(lengths)), 20)
        rest = [n for n, count in left.items() for _ in range(count)]
        assert sum(times for _, times in fixed) + fewest_sequences(rest, 20) == fewest_sequences(lengths, 20)


def test_both_token_libraries_agree(tokenizer):
    codes = [c for c in range(0x3000)] + [c for c in range(0x3000, 0x110000, 97)]
    texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)}  {chr(c)}\n'{chr(c)}" for c in codes if not 0xD800 <= c < 0xE000]
    texts += ["it's I'll we'VE  \n\n x   ", "<|endoftext|>", "x" * 3000, ""]
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids_of(vocabulary(), text).tolist() == want.ids


# ---- language -----------------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = queries.op5_language(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in found if r.held_out]
    assert len(found) == len(truth) and 150 < len(held) < 350
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_learns_from_training_rows_only(spark):
    import zlib

    rows = [(i, "alpha beta gamma delta" if i % 2 else "quick zebra vox jump", "x" if i % 2 else "y") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in frame.where(language.is_training(F.col("doc_id"))).collect()}
    assert kept == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2}


def test_language_edge_cases(spark):
    labelled = spark.createDataFrame(
        [("the cat and the hat", "en")] * 3 + [("der hund und die katze", "de"), (None, "de"), ("x", None)],
        "text string, lang string")
    model = language.learn(labelled)
    rows = [(1, None), (2, ""), (3, "12 !?"), (4, "THE Hat"), (5, "und die"), (6, "жук"), (7, "the " * 300_000), (None, "the")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(
        spark.createDataFrame([(d, t, "?") for d, t in rows], "doc_id long, text string, lang_pred string"), model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[6] == ("en", 0.0)
    assert got[4][0] == got[7][0] == got[None][0] == "en" and got[5][0] == "de"
    kept = language.accepted(spark.createDataFrame(
        [(*r, "old", "1") for r in rows], "doc_id long, text string, lang_pred string, score string"), model)
    assert kept.columns == ["doc_id", "text", "lang_pred", "score"] and {r.score for r in kept.collect()} == {"1"}
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 5, 7]
    nothing = language.learn(labelled.limit(0))
    assert {r.lang_pred for r in language.predict(labelled, nothing, "lang").collect()} == {"und"}


@pytest.mark.parametrize("size", [60, 3_000])
def test_documents_of_large_alphabets_stay(spark, size):
    rng = random.Random(size)

    def text(lang, letters):
        if lang in "de en":
            return " ".join(rng.choice(WORDS[lang]) for _ in range(letters // 5))
        first, kinds = {"zh": (0x4E00, 3_000), "ko": (0xAC00, 2_000)}[lang]
        return "".join(chr(first + min(int(kinds ** rng.random()) - 1, kinds - 1)) for _ in range(letters))

    def rows(n):
        return [(i * 4 + j, text(lang, 200), lang) for i in range(n) for j, lang in enumerate(("de", "en", "ko", "zh"))]

    schema = "doc_id long, text string, lang string"
    model = language.learn(spark.createDataFrame(rows(size), schema))
    assert dict(zip(model.languages, model.by_letter.tolist())) == {"de": False, "en": False, "ko": True, "zh": True}
    new = rows(20)
    assert sorted(r.doc_id for r in language.accepted(spark.createDataFrame(new, schema), model).collect()) == list(range(80))
    found = language.predict(spark.createDataFrame(new, schema), model, carry=["lang"]).collect()
    assert all(r.lang_pred == r.lang for r in found)
    other = spark.createDataFrame([(1, "жук и кот", "ru"), (2, "ქართული ენა", "ka")], schema)
    assert language.accepted(other, model).count() == 0


WORDS = {"en": "the cat and hat with that thing which was there when she would have been".split(),
         "de": "der hund und die katze nicht auch schon über eine zwischen werden würde".split()}


def test_languages_beyond_one_byte_of_bits(spark):
    rows = [(f"{c * 3} {c * 2}q {c}w", f"l{i:02}") for i, c in enumerate("abcdefghijklmnop")]
    model = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert [language.judge(model, [t])[0][0] for t, _ in rows] == [name for _, name in rows]


def test_blocks_cover_all_texts():
    texts = ["a" * n for n in (10, BLOCK_CHARS, 5, 0, BLOCK_CHARS * 2, 1)]
    assert [t for _, block in blocks(texts) for t in block] == texts
    assert [start for start, _ in blocks(texts)] == [0, 1, 2, 4, 5]
    many = ["a"] * (2 * BLOCK_TEXTS + 1)
    assert [len(block) for _, block in blocks(many)] == [BLOCK_TEXTS, BLOCK_TEXTS, 1]
    assert list(blocks([""])) == [(0, [""])] and list(blocks([])) == []


def plain_trigrams(text):
    def fold(char):
        if unicodedata.category(char)[0] not in "LM":
            return ""
        return char.lower() if len(char.lower()) == 1 else char

    codes = ["", *map(fold, text or ""), ""]
    return [(codes[i - 1], codes[i], codes[i + 1]) for i in range(1, len(codes) - 1) if codes[i]]


def test_predictions_equal_those_of_plain_sets(spark):
    """Sets of trigrams per language by the two cuts, in place of the filters."""
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    counts = defaultdict(Counter)
    for doc, text, lang in given:
        if lang is not None and zlib.crc32(str(doc).encode()) % 4 != 2:
            counts[lang].update(plain_trigrams(text))
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    most = Counter()
    for grams in share.values():
        for g, s in grams.items():
            most[g] = max(most[g], s)
    kept = {lang: {g for g, s in grams.items() if s >= 1e-4 and s >= 0.2 * most[g]} for lang, grams in share.items()}
    got = {r.doc_id: r for r in queries.op5_language(spark, SF).collect()}
    assert len(got) == len(given)
    for doc, text, _ in given:
        grams = plain_trigrams(text)
        hits = {lang: sum(g in known for g in grams) for lang, known in kept.items()}
        if not grams:
            assert (got[doc].lang_pred, got[doc].score) == ("und", 0.0)
            continue
        best = max(hits.values())
        assert got[doc].score == pytest.approx(best / len(grams), abs=0.05)
        near = {lang for lang, n in hits.items() if n >= best - 0.02 * len(grams)}
        assert got[doc].lang_pred in near


def test_many_languages_make_a_small_model(spark):
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 6000)]
    rows = [(" ".join("".join(letters[(i * 30 + (j * 7 + k) % 30)] for k in range(4)) for j in range(60)), f"l{i}") for i in range(200)]
    model = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.languages) == 200 and model.slots.nbytes < 10_000_000
    names, _ = language.judge(model, [text for text, _ in rows])
    assert names == [lang for _, lang in rows]
