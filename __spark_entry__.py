
from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.lineage import fresh_path, stage
from twinsift.operators import clusters, density, encode, learning, neighbors, questions as q, reports, review, scores
from twinsift.operators.components import connected_components
from twinsift.operators.blocks import Blocking
from twinsift.operators.text_pairs import keeper_text_pairs, similar_texts, text_clusters
from twinsift.operators.tfidf import tfidf_vectors
from twinsift.operators.vector_pairs import keeper_vector_pairs, similar_vectors, vector_clusters
from twinsift.plans import dedup, reviews, tables
from twinsift.sources import files, versions

TEXT_THRESHOLD = 0.78
VECTOR_THRESHOLD = 0.40
LABELLED_THRESHOLD = 0.30
GRID = tuple(round(0.30 + 0.01 * i, 2) for i in range(21))
SAVED_AT = "2025-12-01T11:26:13.126563"


# ---- shared steps -----------------------------------------------------------------------


def _rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _text_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return similar_texts(tables.questions(spark, folder), TEXT_THRESHOLD)


def _text_members(spark: SparkSession, folder: str) -> DataFrame:
    return stage(text_clusters(tables.questions(spark, folder), TEXT_THRESHOLD), "clusters")


def _detailed_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return q.pair_details(_text_pairs(spark, folder), tables.questions(spark, folder), digits=None)


def _vector_pairs(spark: SparkSession, folder: str, threshold: float = VECTOR_THRESHOLD) -> DataFrame:
    return similar_vectors(tables.vectors(spark, folder), threshold)


def _vector_members(spark: SparkSession, folder: str) -> DataFrame:
    return vector_clusters(tables.vectors(spark, folder), VECTOR_THRESHOLD)


def _neighbors(spark: SparkSession, folder: str, k: int) -> DataFrame:
    return neighbors.nearest(tables.vectors(spark, folder), k)


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    pairs = learning.labelled_pairs(tables.labelled_vector_pairs(spark, folder, LABELLED_THRESHOLD, with_vectors=True))
    return learning.pair_scores(pairs.select("id1", "id2", "y", *learning.CARRIED), tables.vectors(spark, folder))


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return learning.labelled_features(
        tables.labelled_vector_pairs(spark, folder, LABELLED_THRESHOLD, with_vectors=True), tables.vectors(spark, folder))


def _split(spark: SparkSession, folder: str, with_vectors: bool = False) -> DataFrame:
    pairs = learning.labelled_pairs(tables.labelled_vector_pairs(spark, folder, LABELLED_THRESHOLD, with_vectors))
    return learning.split_sequential(
        pairs.select("id1", "id2", "y", *(learning.CARRIED if with_vectors else ())), ["id1", "id2"])


def _listed(members: DataFrame, list_rows: int = clusters.LIST_ROWS) -> DataFrame:
    """Cluster lists with the members as text, to compare them as one value."""
    return clusters.cluster_lists(members, list_rows).withColumn(
        "members", F.array_join(F.col("members").cast("array<string>"), ","))


def _with_odd(df: DataFrame, column: str, by: str) -> DataFrame:
    """The column with empty texts, null characters, line breaks and backslashes by turns."""
    odd = F.concat(F.col(column), F.lit("\0\\n\r\n\\"))
    return df.withColumn(column, F.when(F.col(by) % 3 == 0, "").when(F.col(by) % 3 == 1, odd).otherwise(F.col(column)))


def _large(members: DataFrame) -> DataFrame:
    return clusters.cluster_sizes(members).where("size >= 3").select("cluster_id")


def _notes(spark: SparkSession, folder: str, members: DataFrame) -> DataFrame:
    """A note per cluster: a name, and as canonical question the text of the largest member
    where there are three or more, otherwise a text no member has."""
    last = members.groupBy("cluster_id").agg(F.max("id").alias("question_id"), F.count("*").alias("size"))
    text = tables.questions(spark, folder).select("question_id", "question_text")
    return last.join(text, "question_id").select(
        "cluster_id", F.concat(F.lit("group "), F.col("cluster_id")).alias("cluster_name"),
        F.when(F.col("size") >= 3, F.col("question_text")).otherwise("gone").alias("canonical_question"))


# ---- queries ----------------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Clusters of near-identical documents."""
    return text_cluster_lists(spark, "/root/testdata/sf0.001")


def text_cluster_lists(spark, folder):
    return _listed(_text_members(spark, folder))


def text_cluster_members(spark, folder):
    return _text_members(spark, folder)


def text_pairs(spark, folder):
    return q.pair_details(_text_pairs(spark, folder), tables.questions(spark, folder))


def positioned_pairs(spark, folder):
    return q.pair_details(_text_pairs(spark, folder), tables.questions(spark, folder), positions=True,
                          columns=["idx1", "idx2", "id1", "id2", "similarity"])


def pairs_in_length_order(spark, folder):
    questions = tables.questions(spark, folder).withColumn(
        "place", F.struct(F.length("question_text"), "question_id"))
    return _rounded(q.in_order_of(_text_pairs(spark, folder), questions, "place"), "similarity")


def tfidf(spark, folder):
    return _rounded(tfidf_vectors(tables.questions(spark, folder)), "u", digits=6)


def tfidf_dealt(spark, folder):
    """With a low bound for frequent words, so that they are dealt to many join keys."""
    return _rounded(tfidf_vectors(tables.questions(spark, folder), hot_rows=20), "u", digits=6)


def text_pairs_dealt(spark, folder):
    pairs = similar_texts(tables.questions(spark, folder), TEXT_THRESHOLD, chunk_rows=5, hot_rows=10)
    return _rounded(pairs, "similarity")


def text_cluster_lists_dealt(spark, folder):
    """Small chunks, and lists of at most three members per part."""
    members = text_clusters(tables.questions(spark, folder), TEXT_THRESHOLD, chunk_rows=5, hot_rows=10)
    return _listed(members, list_rows=3)


def vector_pairs_blocks(spark, folder):
    """Many small blocks and pivots."""
    pairs = similar_vectors(tables.vectors(spark, folder), VECTOR_THRESHOLD, blocking=Blocking(block_rows=60))
    return _rounded(pairs, "similarity")


def knn_blocks(spark, folder):
    found = neighbors.nearest(tables.vectors(spark, folder), 10, blocking=Blocking(block_rows=60))
    return _rounded(found, "similarity", "distance")


def dbscan_blocks(spark, folder):
    return density.density_clusters(
        tables.vectors(spark, folder), eps=0.60, min_samples=3, blocking=Blocking(block_rows=60))


def text_knn_pairs(spark, folder):
    found = neighbors.nearest_texts(tables.questions(spark, folder), 3, TEXT_THRESHOLD)
    return _rounded(neighbors.neighbor_pairs(found, TEXT_THRESHOLD), "similarity")


def text_knn_pairs_symmetric(spark, folder):
    found = neighbors.nearest_texts(tables.questions(spark, folder), 3, TEXT_THRESHOLD)
    return _rounded(neighbors.neighbor_pairs(found, TEXT_THRESHOLD, symmetric=True), "similarity")


def text_knn_near_copies(spark, folder):
    """Groups of near copies, many of them equally near; small chunks and samples."""
    found = neighbors.nearest_texts(tables.near_copies(spark, folder), 5, TEXT_THRESHOLD, chunk_rows=25, sample_rows=10)
    return _rounded(found.select("question_id", "rank", "neighbor_id", "similarity"), "similarity")


def batch_run(spark, folder):
    """The files of a whole run, read back: pairs, and cluster members as pairs of cluster and member."""
    path = fresh_path(spark, "run")
    dedup.run(tables.questions(spark, folder), path, settings=dedup.Settings(TEXT_THRESHOLD, top_k=3))
    pairs = files.read_pairs(spark, f"{path}/similarity_pairs", own=True).select(
        F.lit("pair").alias("kind"), F.col("id1").cast("bigint").alias("id1"), F.col("id2").cast("bigint").alias("id2"),
        F.round("similarity", 4).alias("similarity"))
    found = spark.read.schema("cluster_id string, part bigint, size bigint, members array<string>").json(f"{path}/clusters")
    smallest = F.array_min(F.transform("members", lambda m: m.cast("bigint")))
    listed = found.select(smallest.alias("id1"), F.explode("members").alias("member"))
    return pairs.unionByName(listed.select(
        F.lit("member").alias("kind"), "id1", F.col("member").cast("bigint").alias("id2"),
        F.lit(None).cast("double").alias("similarity")))


def encoded(spark, folder):
    """A stub model that counts letters: it exercises the way a model is hosted, nothing else."""
    model = encode.choose_model({"letters": tables.letter_counts}, "letters")
    vectors = encode.encode(tables.gappy_questions(spark, folder), model)
    return vectors.select("question_id", F.posexplode("embedding").alias("dim", "value")).withColumn(
        "value", F.col("value").cast("double"))


def vector_pairs(spark, folder):
    return _rounded(_vector_pairs(spark, folder), "similarity")


def knn(spark, folder):
    return _rounded(_neighbors(spark, folder, 10), "similarity", "distance")


def knn_pairs(spark, folder):
    return _rounded(neighbors.neighbor_pairs(_neighbors(spark, folder, 3), LABELLED_THRESHOLD), "similarity")


def knn_pairs_symmetric(spark, folder):
    return _rounded(
        neighbors.neighbor_pairs(_neighbors(spark, folder, 3), LABELLED_THRESHOLD, symmetric=True), "similarity")


def vector_cluster_members(spark, folder):
    return _vector_members(spark, folder)


def pair_list_clusters(spark, folder):
    return connected_components(_vector_pairs(spark, folder))


def cluster_sizes(spark, folder):
    return clusters.cluster_sizes(_vector_members(spark, folder))


def cluster_summary(spark, folder):
    return clusters.cluster_summary(_vector_members(spark, folder))


def vector_cluster_lists(spark, folder):
    return _listed(_vector_members(spark, folder))


def dbscan(spark, folder):
    return density.density_clusters(tables.vectors(spark, folder), eps=0.60, min_samples=3)


def preview(spark, folder):
    return q.preview(tables.questions(spark, folder))


def clean_text(spark, folder):
    return q.clean_text(tables.gappy_questions(spark, folder))


def blank_count(spark, folder):
    return q.blank_count(tables.gappy_questions(spark, folder))


def repeated_ids(spark, folder):
    turns = spark.read.parquet(f"{folder}/conversations.parquet").withColumnRenamed("conv_id", "question_id")
    return q.repeated_ids(turns)


def default_columns(spark, folder):
    return q.with_defaults(tables.questions(spark, folder).drop("survey_name", "directorate"))


def pair_count(spark, folder):
    pairs, _, copies = keeper_text_pairs(tables.questions(spark, folder), TEXT_THRESHOLD)
    return reports.pair_count(pairs, copies)


def pair_review(spark, folder):
    pairs = stage(_text_pairs(spark, folder), "pairs")
    return _rounded(review.pair_review(pairs, tables.document_feedback(spark, folder, pairs)), "similarity")


def latest_feedback(spark, folder):
    """Two rows per rated pair, the second one later and with another label."""
    first = tables.document_feedback(spark, folder, _text_pairs(spark, folder))
    first = stage(first, "feedback")
    second = first.withColumns({"label": F.lit("different"), "timestamp": F.lit(SAVED_AT)}).where(
        "label <> 'needs-review'")
    return _rounded(review.latest_feedback(first.unionByName(second)), "similarity")


def invalid_labels(spark, folder):
    """Feedback in which duplicates carry the note in place of the label."""
    feedback = tables.document_feedback(spark, folder, _text_pairs(spark, folder))
    return review.invalid_labels(feedback.withColumn(
        "label", F.when(F.col("label") == "duplicate", F.col("note")).otherwise(F.col("label"))))


def feedback_upsert(spark, folder):
    """Reviewed cross-source pairs, submitted again as different."""
    questions = tables.questions(spark, folder)
    pairs = stage(_text_pairs(spark, folder), "pairs")
    stored = tables.document_feedback(spark, folder, pairs)
    crossing = reports.cross_survey_pairs(q.pair_details(pairs, questions, digits=None))
    submitted = crossing.select("id1", "id2", "similarity", F.lit("different").alias("label"), F.lit("").alias("note"))
    return _rounded(review.upsert_feedback(stored, submitted, SAVED_AT), "similarity")


def first_pairs(spark, folder):
    return _rounded(q.first_pairs(_vector_pairs(spark, folder, LABELLED_THRESHOLD)), "similarity")


def top_pairs(spark, folder):
    return _rounded(q.first_pairs(_vector_pairs(spark, folder, LABELLED_THRESHOLD), by="similarity"), "similarity")


def page_count(spark, folder):
    pairs, _, copies = keeper_vector_pairs(tables.vectors(spark, folder), LABELLED_THRESHOLD)
    return q.page_count(reports.pair_count(pairs, copies))


def pair_page(spark, folder):
    path, pairs = fresh_path(spark, "pages"), _vector_pairs(spark, folder, LABELLED_THRESHOLD)
    q.store_pages(pairs, path)
    return _rounded(q.stored_page(spark, path, pairs.schema, page=3), "similarity")


def cluster_detail(spark, folder):
    return clusters.cluster_detail(_text_members(spark, folder), tables.questions(spark, folder))


def canonical_question(spark, folder):
    return clusters.canonical_questions(_text_members(spark, folder), tables.questions(spark, folder))


def annotated_clusters(spark, folder):
    members = _text_members(spark, folder)
    return clusters.annotated_clusters(members, tables.questions(spark, folder), _notes(spark, folder, members))


def chosen_clusters(spark, folder):
    members = _text_members(spark, folder)
    return clusters.chosen_clusters(members, _large(members))


def training_pairs(spark, folder):
    """Decided pairs of documents, some undecided ones, and pairs with a text that is missing, empty or blank."""
    pairs = stage(_text_pairs(spark, folder), "pairs")
    decided = tables.document_feedback(spark, folder, pairs).select("id1", "id2", "label")
    odd = tables.gappy_questions(spark, folder).where("question_id < 0").select(
        F.col("question_id").alias("id1"), (-1 - F.col("question_id")).alias("id2"), F.lit("duplicate").alias("label"))
    return learning.training_pairs(decided.unionByName(odd), tables.gappy_questions(spark, folder))


def pair_features(spark, folder):
    return _rounded(_features(spark, folder).select(
        "id1", "id2", "y", F.posexplode("features").alias("dim", "value")), "value", digits=6)


def split_sequential(spark, folder):
    return _split(spark, folder).select("id1", "id2", "split")


def split_counts(spark, folder):
    return learning.split_counts(_split(spark, folder))


def split_stratified(spark, folder):
    pairs = learning.labelled_pairs(tables.labelled_vector_pairs(spark, folder, LABELLED_THRESHOLD))
    return learning.split_stratified(pairs.select("id1", "id2", "y"))


def pair_scores(spark, folder):
    return _rounded(_scored(spark, folder), "score")


def threshold_sweep(spark, folder):
    return _rounded(scores.threshold_sweep(_scored(spark, folder), GRID), "accuracy", digits=8)


def best_threshold(spark, folder):
    return _rounded(scores.best_threshold(_scored(spark, folder), GRID), "best_accuracy", digits=8)


def threshold_report(spark, folder):
    """The report as a run stores it, read back."""
    split = _split(spark, folder, with_vectors=True)
    scored = learning.pair_scores(split.where("split = 'validation'"), tables.vectors(spark, folder))
    report, path = learning.threshold_report(scored, split, GRID), fresh_path(spark, "report-json")
    reviews.save_threshold_report(report, path)
    return _rounded(spark.read.schema(report.schema).json(versions.current(spark, path)), "best_accuracy", digits=8)


def classification_report(spark, folder):
    predicted = _scored(spark, folder).withColumn("prediction", (F.col("score") >= VECTOR_THRESHOLD).cast("int"))
    return _rounded(scores.classification_report(predicted), "precision", "recall", "f1", digits=8)


def roc_auc(spark, folder):
    return _rounded(scores.roc_auc(_scored(spark, folder)), "auc", digits=8)


def classifier(spark, folder):
    """Predictions on the held-out fifth by a model saved and loaded again."""
    path = fresh_path(spark, "classifier")
    fitted, split = reviews.train(_features(spark, folder))
    fitted.write().save(path)
    model = learning.PipelineModel.load(path)
    test = split.where("split = 'test'").drop("split")
    return _rounded(learning.classify(model, test).select("id1", "id2", "y", "prediction", "score"), "score", digits=3)


def classifier_report(spark, folder):
    return _rounded(scores.classification_report(stage(classifier(spark, folder), "predicted")),
                    "precision", "recall", "f1", digits=8)


def heatmap_grid(spark, folder):
    return _rounded(reports.heatmap_grid(tables.vectors(spark, folder)), "avg_similarity", digits=6)


def cross_source_pairs(spark, folder):
    return _rounded(reports.cross_survey_pairs(_detailed_pairs(spark, folder)).select(
        "id1", "id2", "survey1", "survey2", "similarity"), "similarity")


def source_redundancy(spark, folder):
    questions = tables.questions(spark, folder)
    pairs, members, copies = keeper_text_pairs(questions, TEXT_THRESHOLD)
    return _rounded(reports.survey_redundancy(pairs, copies, members, questions), "avg_similarity", "max_similarity")


def group_redundancy(spark, folder):
    return _rounded(reports.directorate_redundancy(
        tables.questions(spark, folder), _text_members(spark, folder)), "share", digits=8)


def csv_questions(spark, folder):
    path = fresh_path(spark, "questions-csv")
    files.write_csv(tables.questions(spark, folder), path, sep=";")
    return files.read_questions(spark, path).withColumn("question_id", F.col("question_id").cast("bigint"))


def csv_any_format(spark, folder):
    path = fresh_path(spark, "questions-csv")
    files.write_csv(tables.questions(spark, folder), path, sep=";")
    read = files.read_questions_any(spark, path, formats=((",", "UTF-8"), (";", "UTF-8")))
    return read.withColumn("question_id", F.col("question_id").cast("bigint"))


def pairs_csv(spark, folder):
    path = fresh_path(spark, "pairs-csv")
    files.write_csv(positioned_pairs(spark, folder), path)
    return files.read_pairs(spark, path).withColumns({c: F.col(c).cast("bigint") for c in ("id1", "id2")})


def feedback_roundtrip(spark, folder):
    """Labels written, replaced by a table read from the same place, and read again; some notes are empty or need escapes."""
    path = fresh_path(spark, "feedback-csv")
    files.replace(_with_odd(tables.document_feedback(spark, folder, _text_pairs(spark, folder)), "note", "id1"), path)
    files.replace(files.read_feedback(spark, path, own=True).where("label <> 'needs-review'"), path)
    read = files.read_feedback(spark, path, own=True).withColumns({
        "id1": F.col("id1").cast("bigint"), "id2": F.col("id2").cast("bigint")})
    return _rounded(read.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")), "similarity")


def notes_roundtrip(spark, folder):
    """Notes saved, some of them saved again, and read."""
    path = fresh_path(spark, "notes-json")
    notes = stage(_notes(spark, folder, _text_members(spark, folder)).withColumn("items", F.array("cluster_name")), "notes")
    reviews.save_notes(notes.withColumn("canonical_question", F.lit("old")), path)
    reviews.save_notes(_with_odd(notes, "cluster_name", "cluster_id"), path)
    return files.read_notes(spark, path).select(
        F.col("cluster_id").cast("bigint").alias("cluster_id"), "cluster_name", "canonical_question")


def vectors_roundtrip(spark, folder):
    path = fresh_path(spark, "vectors")
    files.write_parquet(tables.vectors(spark, folder), path)
    return _rounded(files.read_vectors(spark, path).select(
        "question_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "value")), "value", digits=6)


def clusters_json(spark, folder):
    path = fresh_path(spark, "clusters-json")
    files.write_json(clusters.cluster_lists(_vector_members(spark, folder)), path)
    schema = "cluster_id bigint, part bigint, size bigint, members array<bigint>"
    return spark.read.schema(schema).json(path).withColumn(
        "members", F.array_join(F.col("members").cast("array<string>"), ","))


QUERIES = [
    text_cluster_lists, text_cluster_members, text_pairs, positioned_pairs, pairs_in_length_order, tfidf,
    vector_pairs, knn, knn_pairs, knn_pairs_symmetric, vector_cluster_members, pair_list_clusters,
    cluster_sizes, cluster_summary, vector_cluster_lists, dbscan, preview, clean_text, blank_count,
    repeated_ids, default_columns, pair_count, pair_review, latest_feedback, invalid_labels,
    feedback_upsert, first_pairs, top_pairs, page_count, pair_page, cluster_detail, canonical_question,
    annotated_clusters, chosen_clusters, training_pairs, pair_features, split_sequential, split_counts,
    split_stratified, pair_scores, threshold_sweep, best_threshold, threshold_report,
    classification_report, roc_auc, classifier, classifier_report, heatmap_grid, cross_source_pairs,
    source_redundancy, group_redundancy, csv_questions, csv_any_format, pairs_csv, feedback_roundtrip,
    notes_roundtrip, vectors_roundtrip, clusters_json, tfidf_dealt, text_pairs_dealt, text_cluster_lists_dealt,
    vector_pairs_blocks, knn_blocks, dbscan_blocks, text_knn_pairs, text_knn_pairs_symmetric,
    text_knn_near_copies, batch_run, encoded,
]


try:  # the text preparation operators are a part of their own, which may be absent
    from twinsift.llm.queries import oracle_sql as llm_oracle_sql, queries as llm_queries
    LLM_QUERIES, LLM_ORACLES = llm_queries(), llm_oracle_sql()
except ImportError:
    LLM_QUERIES, LLM_ORACLES = {}, {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES} | LLM_QUERIES


def oracle_sql() -> dict[str, str]:
    from oracles import ORACLES
    return ORACLES | LLM_ORACLES
