import os

import pytest
from pyspark.sql import functions as F

from twinsift.lineage import shared_folder, stage, temporary
from twinsift.operators import clusters, questions as q, reports, review
from twinsift.operators.order import among_first, cut_after, running_totals, with_position

FEEDBACK = "id1 string, id2 string, similarity double, label string, note string, timestamp string"


def pairs(spark, rows):
    return spark.createDataFrame(rows, "id1 string, id2 string, similarity double")


def test_positions_and_running_totals_span_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"), (F.col("id") % 3 == 0).alias("g"))
    got = with_position(df, ["v"]).orderBy("v").collect()
    assert [r.position for r in got] == list(range(1000))
    hot = with_position(df.withColumn("g", F.lit("same")), ["v"], within=["g"]).orderBy("v").collect()
    assert [r.position for r in hot] == list(range(1000))
    totals, seen = running_totals(df, ["v"], {"before": "v"}, within=["g"]), {True: 0, False: 0}
    for r in totals.orderBy("v").collect():
        assert r.before == seen[r.g]
        seen[r.g] += r.v


def test_staged_tables_live_in_the_shared_folder(spark):
    staged = stage(spark.range(3), "three")
    assert staged.count() == 3
    assert all(shared_folder(spark).removeprefix("file:") in f for f in staged.inputFiles())


def test_blank_missing_and_na_text(spark, rows):
    df = spark.createDataFrame([("a", "NA"), ("b", " \n"), ("c", None), ("d", ""), ("e", "x")],
                               "question_id string, question_text string")
    assert [r[0] for r in rows(q.clean_text(df))] == ["a", "e"]
    assert rows(q.blank_count(df)) == [(5, 3)]


def test_repeated_ids_are_named(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "question_id string")
    with pytest.raises(ValueError, match="a"):
        q.require_unique_ids(df)
    assert q.require_unique_ids(df.distinct()).count() == 2


def test_pair_details_and_order(spark, rows):
    questions = spark.createDataFrame(
        [("b", "tb", "s1", 0), ("a", "ta", "s2", 1)],
        "question_id string, question_text string, survey_name string, place int")
    found = pairs(spark, [("a", "b", 0.87654)])
    swapped = q.in_order_of(found, questions, "place")
    assert rows(swapped) == [("b", "a", 0.87654)]
    assert rows(q.pair_details(swapped, questions, positions=True, order_col="place")) == [
        (0, 1, "b", "a", "tb", "ta", "s1", "s2", 0.8765)]
    assert rows(q.pair_details(found, questions, digits=None)) == [("a", "b", "ta", "tb", "s2", "s1", 0.87654)]


def test_texts_that_are_not_asked_for_are_not_stored(spark, rows, monkeypatch):
    from twinsift.operators import order

    stored, stage = [], order.stage
    monkeypatch.setattr(order, "stage", lambda df, name: stored.append(df.columns) or stage(df, name))
    questions = spark.createDataFrame(
        [("a", "ta", "s2"), ("b", "tb", "s1")], "question_id string, question_text string, survey_name string")
    found = pairs(spark, [("a", "b", 0.5)])
    assert rows(q.pair_details(found, questions, positions=True, columns=["idx1", "idx2", "id2", "survey1"])) == [(0, 1, "b", "s2")]
    assert stored and not any("question" in columns for columns in stored)


def test_stored_pages_read_their_own_range(spark, tmp_path, capsys):
    rows = [(i, i + 1 + j, (i * 7 + j * 3) % 20 / 20) for i in range(15) for j in range(3)]
    found = spark.createDataFrame(rows, "id1 int, id2 int, similarity double")
    path = str(tmp_path / "pages")
    q.store_pages(found, path, block=8)
    page = lambda n: q.stored_page(spark, path, found.schema, n, 10, block=8)
    for n in (1, 2, 5, 99, 0):
        assert sorted(page(n).collect()) == sorted(q.pair_page(found, n, 10).collect())
    page(2).explain()
    assert "block#" in capsys.readouterr().out.split("PartitionFilters: [")[1].split("]")[0]
    assert {f.split("block=")[1][0] for f in page(2).select("_metadata.file_path").distinct().toPandas().file_path} == {"1", "2"}
    q.store_pages(found.where("false"), str(tmp_path / "none"))
    assert q.stored_page(spark, str(tmp_path / "none"), found.schema, 1).count() == 0


def test_pages_concatenate_to_the_whole(spark):
    found = pairs(spark, [(f"a{n}", f"b{n}", (n * 37 % 50) / 50) for n in range(45)])
    counted = lambda n: spark.createDataFrame([(n,)], "pairs long")
    assert q.page_count(counted(45), 10).first().pages == 5
    pages = [q.pair_page(found, p, 10).orderBy("position").collect() for p in range(1, 6)]
    whole = [(r.id1, r.id2) for page in pages for r in page]
    assert whole == [(r.id1, r.id2) for r in found.orderBy(F.desc("similarity"), "id1", "id2").collect()]
    assert q.pair_page(found, 99, 10).count() == 5 and q.pair_page(found, 0, 10).count() == 10
    assert q.page_count(counted(0)).first().pages == 1
    assert q.pair_page(found.where("false"), 1).count() == 0
    with pytest.raises(ValueError):
        q.pair_page(found, 1, 5)


def test_upsert_is_by_ordered_key_and_idempotent(spark, rows):
    stored = spark.createDataFrame([
        ("a", "b", 0.9, "duplicate", "n", "t0"), ("b", "a", 0.9, "different", None, "t0"),
        ("c", "d", 0.8, "needs-review", "", "t0")], FEEDBACK)
    new = spark.createDataFrame([("a", "b", 0.9, "different", ""), ("x", "y", 0.7, "duplicate", "")],
                                "id1 string, id2 string, similarity double, label string, note string")
    once = review.upsert_feedback(stored, new, "t1")
    assert rows(once) == rows(review.upsert_feedback(once, new, "t1"))
    assert {(r.id1, r.id2): (r.label, r.timestamp) for r in once.collect()} == {
        ("a", "b"): ("different", "t1"), ("b", "a"): ("different", "t0"),
        ("c", "d"): ("needs-review", "t0"), ("x", "y"): ("duplicate", "t1")}
    assert review.stamped(new).first().timestamp[:2] == "20"


def test_review_prefill_and_vocabulary(spark):
    stored = spark.createDataFrame([
        ("a", "b", 0.9, "different", "old", "2025-01-01"), ("a", "b", 0.9, "duplicate", "new", "2025-02-01"),
        ("d", "c", 0.9, "duplicate", "", "2025-02-01")], FEEDBACK)
    got = {(r.id1, r.id2): (r.label, r.note) for r in review.pair_review(
        pairs(spark, [("a", "b", 0.9), ("c", "d", 0.9)]), stored).collect()}
    assert got == {("a", "b"): ("duplicate", "new"), ("c", "d"): ("unlabeled", "")}
    assert review.require_valid_labels(stored).count() == 3
    wrong = stored.withColumn("label", F.when(F.col("id1") == "a", "maybe"))
    assert {r.label: r.rows for r in review.invalid_labels(wrong).collect()} == {"maybe": 2, None: 1}
    with pytest.raises(ValueError, match="maybe"):
        review.require_valid_labels(wrong)


@pytest.fixture(scope="module")
def members(spark):
    big = [("m00", f"m{n:02d}") for n in range(25)]
    return spark.createDataFrame(big + [("x1", "x1"), ("x1", "x2")], "cluster_id string, id string").cache()


def test_long_cluster_lists_continue_in_parts(members):
    lists = {(r.cluster_id, r.part): r.members for r in clusters.cluster_lists(members, list_rows=10).collect()}
    assert sorted(lists) == [("m00", 0), ("m00", 1), ("m00", 2), ("x1", 0)]
    assert lists["m00", 0] + lists["m00", 1] + lists["m00", 2] == [f"m{n:02d}" for n in range(25)]
    assert clusters.cluster_lists(members).count() == 2


def test_cluster_detail_and_notes(spark, members, rows):
    questions = spark.createDataFrame(
        [("m01", "one", "s"), ("m02", "two", "s"), ("x1", "ex", "t"), ("x2", "why", "t")],
        "question_id string, question_text string, survey_name string")
    assert rows(clusters.cluster_detail(members, questions))[0] == ("m00", "m01", "one", "s", "")
    assert rows(clusters.canonical_questions(members, questions)) == [("m00", "one"), ("x1", "ex")]
    notes = spark.createDataFrame([("m00", "big", "two"), ("x1", "small", "gone")],
                                  "cluster_id string, cluster_name string, canonical_question string")
    assert rows(clusters.annotated_clusters(members, questions, notes)) == [
        ("m00", 25, "big", "two"), ("x1", 2, "small", "ex")]
    assert rows(clusters.annotated_clusters(members, questions, notes.where("false"))) == [
        ("m00", 25, "", "one"), ("x1", 2, "", "ex")]
    assert clusters.chosen_clusters(members, notes.where("cluster_id = 'x1'")).count() == 2
    assert rows(clusters.cluster_summary(members)) == [(2, 27, 25)]
    assert rows(clusters.cluster_summary(members.where("false"))) == [(0, 0, None)]


def test_surveys_are_compared_without_case(spark, rows):
    detailed = spark.createDataFrame(
        [("a", "b", "Health", "HEALTH ", 0.9), ("a", "c", "Health", "Labour", 0.8), ("d", "a", "labour", "Health", 0.6)],
        "id1 string, id2 string, survey1 string, survey2 string, similarity double")
    assert reports.cross_survey_pairs(detailed).count() == 2


def test_pairs_are_counted_without_being_listed(spark, rows):
    """Keepers a (three copies, two surveys) and d (two copies); e is single."""
    questions = spark.createDataFrame(
        [("a", "Health"), ("b", "HEALTH "), ("c", "Labour"), ("d", "labour"), ("f", "health"), ("e", "Labour")],
        "question_id string, survey_name string")
    members = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("f", "d")], "id string, keeper string")
    copies = spark.createDataFrame([("a", 3, 1.0), ("d", 2, 1.0), ("e", 1, 1.0)], "keeper string, copies long, similarity double")
    found = spark.createDataFrame([("a", "d", 0.8, 3, 2), ("a", "e", 0.9, 3, 1)],
                                  "id1 string, id2 string, similarity double, copies1 long, copies2 long")
    assert rows(reports.pair_count(found, copies)) == [(6 + 3 + 3 + 1,)]
    got = {(a, b): (n, round(m, 6), x) for a, b, n, m, x in rows(
        reports.survey_redundancy(found, copies, members, questions))}
    # a-d: 2 health x (1 labour, 1 health) and 1 labour x the same; a-e: 2 health and 1 labour x labour.
    assert got == {("health", "health"): (3, round((2 * .8 + 1) / 3, 6), 1.0),
                   ("health", "labour"): (8, round((3 * .8 + 2 * .9 + 3) / 8, 6), 1.0),
                   ("labour", "labour"): (2, round((.8 + .9) / 2, 6), 0.9)}


def test_missing_surveys_are_counted_as_in_the_listed_pairs(spark, rows):
    named = {"a": None, "b": None, "c": None, "d": "Health", "e": "labour", "f": "HEALTH ", "g": None, "h": "x", "i": "y", "j": None}
    keeper = {**dict.fromkeys("abcdef", "a"), **dict.fromkeys("gh", "g")}
    questions = spark.createDataFrame(list(named.items()), "question_id string, survey_name string")
    members = spark.createDataFrame(list(keeper.items()), "id string, keeper string")
    copies = spark.createDataFrame([("a", 6, 1.0), ("g", 2, 1.0), ("i", 1, 1.0), ("j", 1, 1.0)],
                                   "keeper string, copies long, similarity double")
    found = spark.createDataFrame([("a", "i", 0.8, 6, 1), ("g", "j", 0.9, 2, 1)],
                                  "id1 string, id2 string, similarity double, copies1 long, copies2 long")
    similar = {("a", "i"): 0.8, ("g", "j"): 0.9}
    listed = [(a, b, named[a], named[b], 1.0 if ka == kb else similar[ka, kb]) for a in named for b in named if a < b
              for ka, kb in [(keeper.get(a, a), keeper.get(b, b))] if ka == kb or (ka, kb) in similar]
    spark.createDataFrame(listed, "id1 string, id2 string, survey1 string, survey2 string, similarity double").createOrReplaceTempView("detailed")
    want = spark.sql("""SELECT least(lower(trim(survey1)), lower(trim(survey2))) AS survey_a,
        greatest(lower(trim(survey1)), lower(trim(survey2))) AS survey_b, count(*) AS pairs,
        round(avg(similarity), 4) AS avg_similarity, round(max(similarity), 4) AS max_similarity FROM detailed GROUP BY 1, 2""")
    got = reports.survey_redundancy(found, copies, members, questions)
    assert rows(got.select("survey_a", "survey_b", "pairs", F.round("avg_similarity", 4), F.round("max_similarity", 4))) == rows(want)


def test_upsert_of_one_key_twice_and_of_an_unknown_label(spark, rows):
    stored = spark.createDataFrame([], FEEDBACK)
    new = spark.createDataFrame([("a", "b", 0.9, "duplicate", ""), ("a", "b", 0.9, "different", "")],
                                "id1 string, id2 string, similarity double, label string, note string")
    assert rows(review.upsert_feedback(stored, new, "t1")) == [("a", "b", 0.9, "different", "", "t1")]
    with pytest.raises(ValueError, match="maybe"):
        review.upsert_feedback(stored, new.withColumn("label", F.lit("maybe")), "t1")


def test_temporary_tables_are_removed(spark):
    with temporary(spark):
        inside = stage(spark.range(3), "short")
        path = inside.inputFiles()[0].removeprefix("file:")
        assert inside.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)
    outside = stage(spark.range(3), "long")
    assert outside.count() == 3


@pytest.mark.parametrize("rows", [0, 418, 1000])
def test_first_rows_are_found_by_counting(spark, rows):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009 % 10).alias("a"), F.expr("if(id % 5 = 0, null, id % 7)").alias("b"))
    marked = among_first(df, [(F.lit(True), cut_after(df, ["a", "b"], rows))], "first")
    in_order = sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1] is not None, r[1] or 0))
    got = marked.where("first").drop("first").collect()
    assert sorted(map(tuple, got), key=str) == sorted(in_order[:rows], key=str) and marked.count() == 1000
