import random

import pytest
from pyspark.sql import functions as F

from twinsift.operators.components import connected_components
from twinsift.operators.neighbors import nearest_texts
from twinsift.operators.skew import lookup
from twinsift.operators.text_pairs import similar_texts, text_clusters
from twinsift.operators.tfidf import tfidf_vectors


def corpus(seed=5, texts=90):
    """A third exact copies, a third near copies, the rest unrelated; one blank, one missing."""
    rng = random.Random(seed)
    words = [f"w{n}" for n in range(160)]
    base = rng.choices(words, k=25)
    out = {}
    for n in range(texts):
        if n % 3 == 0:
            text = " ".join(base)
        elif n % 3 == 1:
            text = " ".join(rng.choice(words) if rng.random() < 0.12 else w for w in base)
        else:
            text = "The " + "  ".join(rng.choices(words, k=rng.randint(1, 30))) + "\n"
        out[f"q{n:03d}"] = text
    out["q900"] = " \t "
    return out


def frame(spark, texts):
    return spark.createDataFrame([*texts.items(), ("q901", None)], "question_id string, question_text string")


@pytest.fixture(scope="module")
def questions(spark):
    return frame(spark, corpus()).cache()


@pytest.mark.parametrize("chunk_rows", [4, 1000])
@pytest.mark.parametrize("threshold", [0.5, 0.78])
def test_pairs_match_brute_force(questions, brute, threshold, chunk_rows):
    got = {(r.id1, r.id2): r.similarity for r in similar_texts(questions, threshold, chunk_rows=chunk_rows).collect()}
    want = brute.text_pairs(corpus(), threshold)
    assert got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


@pytest.mark.parametrize("chunk_rows", [4, 1000])
@pytest.mark.parametrize("threshold", [0.4, 0.78])
def test_clusters_match_components_of_all_pairs(questions, brute, threshold, chunk_rows):
    got = {r.id: r.cluster_id for r in text_clusters(questions, threshold, chunk_rows=chunk_rows).collect()}
    assert got == brute.components(brute.text_pairs(corpus(), threshold))


def neighbors_of(pairs, texts, k):
    """(text, rank) -> neighbour: the text itself and its partners, by distance and id; texts without a pair have no list."""
    sided = {}
    for (a, b), similarity in pairs.items():
        sided.setdefault(a, {a: 1.0})[b] = similarity
        sided.setdefault(b, {b: 1.0})[a] = similarity
    return {(i, n + 1): j for i, found in sided.items()
            for n, j in enumerate(sorted(found, key=lambda j: (round(1 - min(found[j], 1.0), 12), j))[:k])}


@pytest.mark.parametrize("k,chunk_rows,sample_rows,hot_rows", [
    (3, 1000, 64, None), (1, 7, 3, 5), (3, 7, 3, 5), (200, 7, 3, 5), (3, 1000, 1, None)])
def test_text_neighbors_match_brute_force(questions, brute, k, chunk_rows, sample_rows, hot_rows):
    got = nearest_texts(questions, k, 0.5, chunk_rows=chunk_rows, sample_rows=sample_rows, hot_rows=hot_rows).collect()
    assert {(r.question_id, r.rank): r.neighbor_id for r in got} == neighbors_of(
        brute.text_pairs(corpus(), 0.5), corpus(), k)


def test_text_neighbors_of_near_copies(spark, brute):
    """Two hundred texts that differ in one word: equal similarities everywhere, ranked by id."""
    base = " ".join(f"b{n}" for n in range(20))
    texts = {n: f"{base} own{n // 2} last{n % 5}" for n in range(200)} | {500 + n: f"x{n} y{n} z{n // 50}" for n in range(300)}
    frame = spark.createDataFrame([*texts.items()], "question_id long, question_text string")
    want = neighbors_of(brute.text_pairs(texts, 0.3), texts, 4)
    for sizes in ((1000, 64), (30, 8)):
        got = nearest_texts(frame, 4, 0.3, chunk_rows=sizes[0], sample_rows=sizes[1]).collect()
        assert {(r.question_id, r.rank): r.neighbor_id for r in got} == want


def test_text_neighbors_of_nothing(spark, questions):
    assert nearest_texts(questions.where("false")).collect() == []
    assert nearest_texts(frame(spark, {"a": "one two", "b": "three four"})).collect() == []


def test_unit_vectors(questions, brute):
    want = {(i, w): u for i, unit in brute.tfidf(corpus()).items() for w, u in unit.items()}
    got = {(r.question_id, r.token): r.u for r in tfidf_vectors(questions).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_text_threshold_must_be_positive(questions):
    with pytest.raises(ValueError):
        similar_texts(questions, 0.0)


def test_empty_input(spark, questions):
    assert similar_texts(questions.where("false")).collect() == []
    assert text_clusters(questions.where("false")).collect() == []


def test_no_pairs(spark):
    lone = frame(spark, {"a": "one two", "b": "three four"})
    assert similar_texts(lone).collect() == [] and text_clusters(lone).collect() == []


@pytest.mark.parametrize("edges", ["chain", "star", "random"])
def test_components(spark, brute, edges):
    rng = random.Random(2)
    ids = list(range(64))
    rng.shuffle(ids)
    pairs = {
        "chain": list(zip(ids, ids[1:])),
        "star": [(ids[0], x) for x in ids[1:40]] + [(ids[50], x) for x in ids[51:]],
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(90)],
    }[edges]
    pairs = [p for p in pairs if p[0] != p[1]]
    want = brute.components(pairs)
    for order in (pairs, [(b, a) for a, b in reversed(pairs)]):
        got = connected_components(spark.createDataFrame(order, "id1 long, id2 long"))
        assert {r.id: r.cluster_id for r in got.collect()} == want


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "id1 string, id2 string")).collect() == []


def test_lookup_spreads_hot_keys(spark, rows):
    big = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    small = big.groupBy("k").agg(F.count("*").alias("n"))
    assert rows(lookup(big, small, "k", "n", hot_rows=100)) == rows(big.join(small, "k"))


def test_scoring_fetches_few_word_lists(spark, brute, monkeypatch):
    """Each text shares a rare word with texts of all other groups, but is near only to its own group."""
    from twinsift.operators import text_pairs as tp

    texts = {40 * g + n: " ".join([*(f"g{g}w{i}" for i in range(25)), f"own{g}n{n // 2}", f"far{n}"])
             for g in range(6) for n in range(40)}
    fetched, by_group = [], tp._by_group

    def counted(tiles, lists, found, schema):
        if "copies" in lists.columns:
            fetched.append(tiles.select("group", F.explode(F.array("id1", "id2"))).distinct().count())
        return by_group(tiles, lists, found, schema)

    monkeypatch.setattr(tp, "_by_group", counted)
    frame = spark.createDataFrame([*texts.items()], "question_id long, question_text string")
    want = brute.text_pairs(texts, 0.78)
    for small in (False, True):
        if small:  # chunks of components and of prefixes, as in large tables
            for name, value in (("TILE_WORDS", 300), ("TILE_PAIRS", 100), ("PREFIX_WORDS", 500), ("LEAST_WORDS", 100)):
                monkeypatch.setattr(tp, name, value)
        got = {(r.id1, r.id2): r.similarity for r in similar_texts(frame, 0.78, chunk_rows=20).collect()}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    assert fetched[0] <= len(texts)


def test_bounds_drop_no_pair_of_an_id_that_comes_twice(spark, rows, monkeypatch):
    from twinsift.operators import text_pairs as tp

    texts = corpus(seed=8, texts=45)
    twice = frame(spark, texts).unionByName(frame(spark, texts).where("question_id in ('q001', 'q004', 'q011')"))
    got = rows(similar_texts(twice, 0.6))
    monkeypatch.setattr(tp, "_within_reach", lambda candidates, packed, threshold: candidates)
    assert got == rows(similar_texts(twice, 0.6))


@pytest.mark.parametrize("rows, chunks", [(20, 1), (60, 3), (4_000, 4), (40_000, 40)])
def test_given_chunks_grow_with_the_word(spark, rows, chunks):
    from twinsift.operators.text_neighbors import _met_chunks

    sizes = spark.createDataFrame([(rows, 1)], "homes long, words long")
    assert sizes.select(_met_chunks("homes", "words", 25)).first()[0] == chunks


@pytest.mark.parametrize("search", [similar_texts, text_clusters])
def test_entries_of_words_with_few_texts_are_not_stored(spark, questions, monkeypatch, search):
    from twinsift.operators import text_pairs as tp

    kept, stage = {}, tp.stage

    def counted(df, name, path=None):
        kept[name] = stage(df, name, path)
        return kept[name]

    monkeypatch.setattr(tp, "stage", counted)
    for chunk_rows, some in ((1000, False), (1, True)):
        assert search(questions, 0.78, chunk_rows=chunk_rows).count()
        assert (kept["prefix"].count() > 0) == some


def test_runs_of_a_word_stay_whole(brute):
    import numpy as np
    import pyarrow as pa
    from twinsift.operators import text_pairs as tp

    token = np.sort(np.random.default_rng(1).integers(0, 9, 60))
    batches = [pa.record_batch({"token_id": token[a:a + 7]}) for a in range(0, 60, 7)]
    parts = [t["token_id"].to_pylist() for t in tp._whole_runs([*batches[:3], batches[0].slice(0, 0), *batches[3:]])]
    assert sum(parts, []) == token.tolist()
    assert all(a[-1] < b[0] for a, b in zip(parts, parts[1:]))
    values = np.array([0.1, 1 / 3, 0.5, 1.0, 0.0])
    assert (tp._above(values) >= values).all() and (tp._above(values) - values < 1e-7).all()


@pytest.mark.parametrize("most", [0, 12])
def test_words_stay_in_the_row_of_their_text(spark, questions, brute, monkeypatch, most):
    from twinsift.operators import text_pairs as tp, tfidf

    kept, staged = [], tfidf.stage

    def counted(df, name, path=None):
        table = staged(df, name, path)
        kept.append((name, table.count()))
        return table

    monkeypatch.setattr(tfidf, "stage", counted)
    monkeypatch.setattr(tfidf, "FREQUENT_WORDS", most)
    packed, _ = tp.text_search(questions, 0.78, "question_id", "question_text", None)
    texts = packed.count()
    # Neither the entries of a text nor words of a single text are stored one by one.
    assert [k[0] for k in kept] == ["lists", "shared"] and kept[0][1] == texts
    assert all(len(r.tokens) == len(r.vs) for r in packed.collect())
    got = {(r.id1, r.id2): r.similarity for r in similar_texts(questions, 0.6).collect()}
    want = brute.text_pairs(corpus(), 0.6)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_contraction_is_bounded_and_goes_on_over_batches(brute, monkeypatch):
    import tracemalloc
    import pyarrow as pa
    from twinsift.operators.components import _contracted

    # Few nodes: one edge per node is left of any number of edges.
    chain = [pa.record_batch({"child": [n + 1], "parent": [n]}) for n in range(9)]
    monkeypatch.setattr("twinsift.operators.components.CONTRACT_ROWS", 40)
    left = [e for b in _contracted(iter(chain * 50)) for e in zip(*b.to_pydict().values())]
    assert sorted(left) == [(n, 0) for n in range(1, 10)]
    monkeypatch.undo()
    # Many nodes: no more than a bounded number of edges is held at once.
    many = (pa.record_batch({"child": [2 * n + 1 for n in range(a, a + 10_000)], "parent": [2 * n for n in range(a, a + 10_000)]})
            for a in range(0, 600_000, 10_000))
    tracemalloc.start()
    edges = sum(b.num_rows for b in _contracted(many))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert edges == 600_000 and most < 100_000_000


def test_texts_that_share_the_next_rarer_word_are_not_listed_again(spark, brute, monkeypatch):
    """Near copies share many words, but are candidates at few of them, and come in few rows."""
    from twinsift.operators import text_pairs as tp

    texts = {n: " ".join([*(f"w{i}" for i in range(40)), f"own{n}", *(f"v{n % 3}x{i}" for i in range(2))]) for n in range(60)}
    texts |= {100 + n: f"other{n} thing{n}" for n in range(200)}
    seen, within_reach = [], tp._within_reach

    def counted(candidates, packed, threshold):
        seen.append((candidates.count(), candidates.agg(F.sum(F.size("id1s"))).first()[0]))
        return within_reach(candidates, packed, threshold)

    monkeypatch.setattr(tp, "_within_reach", counted)
    got = {(r.id1, r.id2) for r in similar_texts(spark.createDataFrame([*texts.items()], "question_id long, question_text string")).collect()}
    assert got == brute.text_pairs(texts, 0.78).keys() and len(got) >= 500
    rows, listed = seen[0]
    assert rows <= 40 and listed < 4 * len(got), (rows, listed, len(got))


def test_neighbours_fetch_few_word_lists(spark, monkeypatch):
    """Each text of a group of near copies is fetched by few groups, not once per word it shares."""
    from twinsift.operators import text_pairs as tp

    texts = {40 * g + n: " ".join([*(f"g{g}w{i}" for i in range(25)), f"own{g}n{n // 2}", f"far{n}"])
             for g in range(6) for n in range(40)}
    fetched, by_group = [], tp._by_group

    def counted(tiles, lists, found, schema):
        if "copies" in lists.columns:
            fetched.append(tiles.select("group", F.explode(F.array("id1", "id2"))).distinct().count())
        return by_group(tiles, lists, found, schema)

    monkeypatch.setattr(tp, "_by_group", counted)
    frame = spark.createDataFrame([*texts.items()], "question_id long, question_text string")
    found = nearest_texts(frame, 2, 0.78, chunk_rows=8, sample_rows=10).collect()
    assert len(found) == 2 * len(texts) and fetched and max(fetched) <= len(texts)


def test_dots_look_up_the_shorter_text(brute):
    import numpy as np
    import pyarrow as pa
    from twinsift.operators import text_pairs as tp

    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(50, size, replace=False)) for size in (3, 40, 7, 30, 1)]
    us = [rng.random(len(r)) for r in rows]
    table = pa.table({"id": list(range(5)), "tokens": [r.tolist() for r in rows], "us": [u.tolist() for u in us]})
    pairs = [(a, b) for a in range(5) for b in range(5) if a != b]
    lists = tp._Lists(pa.table({"id1": [a for a, _ in pairs], "id2": [b for _, b in pairs]}), table)
    dots = np.full(len(pairs), np.nan)
    for part, dot, place1, place2 in lists.products():
        dots[part] = dot
        for p, x, y in zip(part, place1, place2):
            a, b = pairs[p]
            if len(np.intersect1d(rows[a], rows[b])):
                assert lists.start[a] <= x < lists.end[a] and lists.start[b] <= y < lists.end[b]
                assert lists.word[x] == lists.word[y]
    dense = np.zeros((5, 50))
    for i, (r, u) in enumerate(zip(rows, us)):
        dense[i, r] = u
    assert np.allclose(dots, [dense[a] @ dense[b] for a, b in pairs])


def test_shuffle_files_of_ended_steps_are_collected(spark, monkeypatch):
    from twinsift import lineage

    monkeypatch.setattr(lineage, "COLLECT_S", 0.0)
    before = lineage._collected
    lineage.stage(spark.range(3), "three")
    assert lineage._collected > before
