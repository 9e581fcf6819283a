"""Exact and near duplicates, Merkle fingerprints."""

import hashlib
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from twinsift.llm import exact_dedup, fingerprints, near_dedup, queries  # noqa: E402

SF = "/root/testdata/sf0.001"

ROWS = [
    (1, "a b c.\nd e f"), (2, "abc.def"), (3, None), (4, ""), (5, "  \n\t"), (6, "abc.  d e f   "), (7, "x"),
    (8, "é x"), (9, "éx"), (10, "one. two! three? four\n\nfive. "), (11, "word " * 30_000), (12, "x"),
]


@pytest.fixture
def small(spark):
    return spark.createDataFrame([(d, t, d) for d, t in ROWS], "doc_id long, text string, keep_id long")


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_exact_dedup_matches_brute_force(spark, small):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256)
           for r in exact_dedup.duplicate_report(small).collect()}
    assert got == brute.exact_dedup(ROWS)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256)
           for r in queries.op9_exact_dedup(spark, SF).collect()}
    assert got == brute.exact_dedup(documents(spark))


def test_exact_dedup_deals_out_a_frequent_content(spark):
    """A third of all rows are one text: they are salted, yet are one group."""
    rows = [(i, "same text" + " " * (i % 7)) for i in range(400)] + [(1000 + i, f"text {i}") for i in range(800)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.duplicate_report(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute.exact_dedup(rows)


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (None, "a", "y"), (None, None, None), (2, "b", "z"), (2, "c", "z")]
    kept = exact_dedup.drop_duplicates(spark.createDataFrame(rows, "doc_id long, text string, sha string"))
    assert kept.columns == ["doc_id", "text", "sha"]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(
        [(1, "a", "x"), (None, None, None), (2, "b", "z"), (2, "c", "z")], key=repr)


def test_exact_dedup_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.duplicate_report(empty).count() == 0


def test_fingerprints_match_brute_force(spark, small):
    for rows, found in ((ROWS, fingerprints.edited_fingerprints(small)),
                        (documents(spark), queries.op6_fingerprints(spark, SF))):
        texts, want = {d: t or "" for d, t in rows}, brute.edited(rows)
        for r in found.collect():
            n, edited, after = want[r.doc_id]
            assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
            own, changed, following = (brute.fingerprint(t) for t in (texts[r.doc_id], edited, after))
            assert (r.fingerprint, r.edited_fingerprint) == (own, changed)
            assert r.near_edited == pytest.approx(brute.likeness(own, changed))
            assert r.near_next == pytest.approx(brute.likeness(own, following))


def test_fingerprint_locates_an_edit(spark):
    text = "\n".join(f"Paragraph {i} says something. And more." for i in range(40))
    rows = spark.createDataFrame([(text, text.replace("Paragraph 20 says", "Paragraph 20 said"))], "a string, b string")
    one, two = fingerprints.fingerprint(rows.a), fingerprints.fingerprint(rows.b)
    row = rows.select(fingerprints.changed_paragraphs(one, two).alias("changed"),
                      fingerprints.changed_paragraphs(one, one).alias("same"),
                      fingerprints.likeness(one, two).alias("near")).first()
    assert len(row.changed) == 1 and row.same == [] and 0.95 < row.near < 1


def test_fingerprints_with_repeated_and_missing_ids(spark):
    rows = [(None, "a. b"), (1, "c"), (1, "c"), (2, None)]
    got = fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4
    assert fingerprints.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = fingerprints.edited_fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and alone.near_next == 1.0


def test_near_duplicates_match_brute_force(spark):
    got = {r.doc_id: r.class_id for r in queries.op8_near_dedup(spark, SF).collect()}
    assert got == brute.near_classes(documents(spark))
    assert len(set(got.values())) < len(got)


def near_rows():
    import random

    rng = random.Random(7)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):  # a group of near copies, some of them far from each other
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, rows[5][1].upper()) for i in range(60)]
    rows += [(300 + i, " ".join(base[:60] + [f"u{rng.randrange(10_000)}" for _ in range(240)])) for i in range(60)]
    rows += [(400, None), (401, ""), (402, "!!"), (403, "two words"), (404, "Two  words!"), (405, "long " * 40_000),
             (406, "long " * 39_000)]
    return rows


def test_near_duplicates_in_large_groups(spark):
    rows = near_rows()
    frame = spark.createDataFrame([(d, t, d, True) for d, t in rows], "doc_id long, text string, class_id long, kept boolean")
    got = near_dedup.near_duplicates(frame).collect()
    assert {r.doc_id: r.class_id for r in got} == brute.near_classes(rows)
    assert {r.doc_id for r in got if r.kept} == set(brute.near_classes(rows).values())
    kept = near_dedup.drop_near_duplicates(frame)
    assert kept.columns == frame.columns and kept.count() == sum(r.kept for r in got)


def test_near_duplicates_with_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "x y z"), (2, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id) for r in near_dedup.near_duplicates(frame).collect()), key=repr)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (None, None), (2, 2)], key=repr)
    assert near_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_dart_minhash_estimates_weighted_jaccard():
    import numpy as np

    rng = np.random.default_rng(5)
    names = rng.integers(0, 2**62, 60).astype(np.uint64)
    one, two = rng.uniform(0, 6, 60), rng.uniform(0, 6, 60)
    owner = np.repeat([0, 1], 60)
    values = near_dedup.dart_minhash(owner, np.tile(names, 2), np.concatenate([one, two]), 2, 4000)
    want = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    assert abs((values[0] == values[1]).mean() - want) < 0.03


def test_dart_minhash_of_small_weights():
    import numpy as np

    values = near_dedup.dart_minhash(
        np.array([0, 1, 2]), np.array([5, 5, 6], np.uint64), np.array([0.01, 0.02, 1.0]), 4, 64)
    assert (values[3] == 0).all() and (values[:3] != 0).all()
    assert 0.2 < (values[0] == values[1]).mean() < 0.8 and not (values[1] == values[2]).any()
