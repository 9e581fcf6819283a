import random

import pytest
from pyspark.sql import functions as F

from twinsift.functions import vectors as fv
from twinsift.operators import blocks
from twinsift.operators.blocks import Blocking
from twinsift.operators.density import density_clusters
from twinsift.operators.neighbors import nearest, neighbor_pairs
from twinsift.operators.vector_pairs import distinct_vectors, place, similar_rows, similar_vectors, vector_clusters

BLOCKINGS = [Blocking(), Blocking(block_rows=7), Blocking(block_rows=9, pivots=5), Blocking(block_rows=2, pivots=3)]


def clustered(seed=3, groups=6, size=12, dim=6, noise=0.25):
    """Vectors around a few directions, with copies, opposite vectors and zeros."""
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    out = {}
    for g in range(groups):
        for n in range(size):
            out[f"q{g}{n:02d}"] = [x + rng.gauss(0, noise) for x in centers[g]]
    for n in range(9):  # a hot group of copies, the first of them not the smallest id
        out[f"c{n}"] = list(out["q100"])
    out["m1"] = [-x for x in out["q100"]]
    out["z1"] = out["z2"] = [0.0] * dim
    return out


def frame(spark, vectors):
    return spark.createDataFrame(list(vectors.items()), "question_id string, embedding array<double>")


@pytest.mark.parametrize("blocking", BLOCKINGS)
@pytest.mark.parametrize("threshold", [0.9, 0.0])
def test_pairs_match_brute_force(spark, brute, blocking, threshold):
    vectors = clustered()
    got = {(r.id1, r.id2): r.similarity for r in similar_vectors(
        frame(spark, vectors), threshold, blocking=blocking).collect()}
    want = brute.vector_pairs(vectors, threshold)
    assert got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_blocks_grow_with_the_table(spark, brute, monkeypatch):
    """Four times the vectors are copied to about as many tasks each."""
    from twinsift.operators import vector_pairs

    monkeypatch.setattr(blocks, "BLOCK_ROWS", 2)
    monkeypatch.setattr(blocks, "BLOCKS", 4)
    monkeypatch.setattr(vector_pairs, "TILE_CELLS", 40)
    per_vector = []
    for size in (10, 40):
        vectors = clustered(groups=4, size=size)
        keepers, _ = distinct_vectors(frame(spark, vectors), "question_id", "embedding")
        blocking = Blocking().suited(keepers)
        tasks = blocks.block_tasks(place(keepers, 0.1, blocking), blocking.block_rows, within_cells=True)
        per_vector.append(tasks.count() / keepers.count())
    assert per_vector[1] < 2 * per_vector[0]
    got = {(r.id1, r.id2): r.similarity for r in similar_vectors(frame(spark, vectors), 0.9).collect()}
    want = brute.vector_pairs(vectors, 0.9)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_witnesses_rule_cells_out(spark, brute, monkeypatch):
    vectors = clustered(groups=12, dim=8, noise=0.05)
    keepers, _ = distinct_vectors(frame(spark, vectors), "question_id", "embedding")
    blocking = Blocking(block_rows=5, pivots=2)

    def comparisons(witnesses):
        monkeypatch.setattr(blocks, "WITNESSES", witnesses)
        placed = place(keepers, 0.95, blocking)
        homes = placed.groupBy("cell").agg(F.count("*").alias("homes"))
        met = placed.select(F.explode("visits").alias("cell")).join(homes, "cell")
        return met.agg(F.coalesce(F.sum("homes"), F.lit(0))).first()[0]

    alone, found = comparisons(0), set(brute.vector_pairs(vectors, 0.95))
    for witnesses in (1, 16):
        assert comparisons(witnesses) < alone
        pairs = similar_vectors(frame(spark, vectors), 0.95, blocking=blocking)
        assert {(r.id1, r.id2) for r in pairs.collect()} == found


@pytest.mark.parametrize("blocking", BLOCKINGS)
def test_clusters_match_components_of_all_pairs(spark, brute, blocking):
    vectors = clustered(noise=0.4)
    got = {r.id: r.cluster_id for r in vector_clusters(frame(spark, vectors), 0.9, blocking=blocking).collect()}
    assert got == brute.components(brute.vector_pairs(vectors, 0.9))


@pytest.mark.parametrize("blocking", BLOCKINGS)
def test_nearest_match_brute_force(spark, brute, blocking):
    vectors = clustered()
    got = {}
    for r in nearest(frame(spark, vectors), 5, blocking=blocking).orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append(r.neighbor_id)
    assert got == brute.nearest(vectors, 5)


def test_fewer_vectors_than_k_and_ties(spark, brute):
    vectors = {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [0.0, -1.0], "d": [1.0, 0.0]}
    got = nearest(frame(spark, vectors), 10).orderBy("question_id", "rank").collect()
    assert [(r.question_id, r.neighbor_id) for r in got if r.question_id == "a"] == [
        ("a", "a"), ("a", "d"), ("a", "b"), ("a", "c")]
    assert len(got) == 16


def test_one_sided_neighbours(spark):
    # b and c are nearest to each other, a is nearest to b: only a's list has the pair (a, b).
    vectors = {"a": [1.0, 0.30], "b": [1.0, 0.0], "c": [1.0, -0.01], "d": [-1.0, 0.0]}
    lists = nearest(frame(spark, vectors), 2)
    forward = {(r.id1, r.id2) for r in neighbor_pairs(lists, 0.5).collect()}
    assert forward == {("a", "b"), ("b", "c")}
    vectors = {"z": vectors["a"], **{k: vectors[k] for k in "bcd"}}
    lists = nearest(frame(spark, vectors), 2)
    assert {(r.id1, r.id2) for r in neighbor_pairs(lists, 0.5).collect()} == {("b", "c")}
    both = {(r.id1, r.id2) for r in neighbor_pairs(lists, 0.5, symmetric=True).collect()}
    assert both == {("b", "c"), ("b", "z")}


def test_symmetric_with_all_neighbours_is_all_pairs(spark, brute):
    vectors = clustered(groups=3, size=5)
    lists = nearest(frame(spark, vectors), len(vectors))
    got = {(r.id1, r.id2) for r in neighbor_pairs(lists, 0.8, symmetric=True).collect()}
    assert got == set(brute.vector_pairs(vectors, 0.8))


@pytest.mark.parametrize("eps,min_samples", [(0.1, 3), (0.1, 1), (0.02, 4), (1.0, 30)])
def test_density_matches_brute_force(spark, brute, eps, min_samples):
    vectors = clustered(noise=0.45)
    got = {r.question_id: r.label for r in density_clusters(
        frame(spark, vectors), eps, min_samples, blocking=Blocking(block_rows=10)).collect()}
    assert got == brute.dbscan(vectors, eps, min_samples)


def test_border_joins_the_lowest_numbered_cluster(spark):
    import math
    angle = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    # Two dense groups at 0 and 40 degrees, x at 20 within reach of one core of each.
    degrees = {"p1": 0, "p2": 2, "p3": 4, "p4": 6, "x": 20, "r1": 34, "r2": 36, "r3": 38, "r4": 40, "n": 180}
    eps = 1 - math.cos(math.radians(14.5))
    got = {r.question_id: (r.label, r.role) for r in density_clusters(
        frame(spark, {k: angle(v) for k, v in degrees.items()}), eps, 4).collect()}
    assert got["x"] == (0, "border") and got["r1"][0] == 1 and got["n"] == (-1, "noise")


def test_bad_arguments(spark):
    vectors = frame(spark, {"a": [1.0]})
    with pytest.raises(ValueError):
        similar_vectors(vectors, 1.2)
    with pytest.raises(ValueError):
        nearest(vectors, 0)
    with pytest.raises(ValueError):
        density_clusters(vectors, 0.0)


def test_empty_input_gives_empty_output(spark):
    empty = frame(spark, {"a": None}).where("false")
    assert similar_vectors(empty).collect() == []
    assert vector_clusters(empty).collect() == []
    assert nearest(empty).collect() == []
    assert density_clusters(empty).collect() == []


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
def test_undefined_numbers_are_an_error(spark, bad):
    vectors = frame(spark, {"a": [1.0, bad], "b": [1.0, 2.0]})
    for search in (similar_vectors, nearest):
        with pytest.raises(Exception, match="missing, undefined or infinite"):
            search(vectors).collect()


def test_parallel_vectors_have_similarity_one(spark):
    rng = random.Random(4)
    base = [rng.gauss(0, 1) for _ in range(7)]
    vectors = frame(spark, {f"v{i}": [x * (i + 1) / 3 for x in base] for i in range(12)})
    pairs = similar_vectors(vectors, 1.0).collect()
    assert len(pairs) == 66 and all(r.similarity <= 1.0 for r in pairs)
    assert all(0.0 <= r.distance <= 1e-9 for r in nearest(vectors, 5).collect())


def test_column_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    row, zero = df.select(
        fv.cosine(F.col("a"), F.col("b")).alias("c"), fv.pair_features(F.col("a"), F.col("b")).alias("f")).collect()
    assert abs(row.c - 1 / 50 ** 0.5) < 1e-12 and row.f == [2.0, 3.0, 3.0, -2.0]
    assert zero.c == 0.0


@pytest.mark.parametrize("blocking", BLOCKINGS[:2])
def test_pairs_bring_columns_of_both_rows(spark, blocking):
    vectors = clustered()
    rows = [(i, v, n % 3 or None) for n, (i, v) in enumerate(vectors.items())] + [("q000", vectors["q000"], 7), (None, vectors["q200"], 8)]
    table = spark.createDataFrame(rows, "question_id string, embedding array<double>, label int")
    want = similar_vectors(table, 0.9, blocking=blocking)
    for s in "12":
        want = want.join(table.toDF(f"id{s}", f"embedding{s}", f"label{s}"), f"id{s}")
    got = similar_rows(table, 0.9, ("label", "embedding"), blocking=blocking)
    assert sorted(map(str, got.select(*want.columns).drop("similarity").collect())) == sorted(
        map(str, want.drop("similarity").collect()))
    # Pairs of rows that stand for themselves meet no join.
    alone = similar_rows(table.where("question_id like 'q1%'"), 0.9, ("label", "embedding"), blocking=blocking)
    plan = alone._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[:plan.index("FlatMapGroupsInArrow")] and alone.count()


def test_given_blocks_grow_with_the_table(spark):
    assert Blocking(block_rows=60).suited(spark.range(600)).block_rows == 60
    assert Blocking(block_rows=60).suited(spark.range(64_000)).block_rows == 1_000


def test_copies_of_a_vector_do_not_grow_with_the_table(spark):
    rows = []
    for size in (16_384, 65_536):
        made = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(2001)) / 1000 - 1)
        keepers = spark.range(size).select(F.col("id").alias("keeper"), F.lit(1).alias("copies"), made.alias("vector")).cache()
        blocking = Blocking().suited(keepers)
        tasks = blocks.block_tasks(place(keepers, 0.3, blocking), blocking.block_rows, within_cells=True)
        rows.append(tasks.count() / size)
    assert rows[1] < 1.5 * rows[0]
