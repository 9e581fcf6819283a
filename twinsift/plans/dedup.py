"""The whole run: questions -> vectors -> pairs -> clusters, written to a folder.

Without a model the texts are compared by TF-IDF; with one, by its vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.lineage import temporary
from twinsift.operators.blocks import Blocking
from twinsift.operators.clusters import cluster_lists
from twinsift.operators.components import connected_components
from twinsift.operators.encode import ModelFactory, encode
from twinsift.operators.neighbors import nearest, nearest_texts, neighbor_pairs
from twinsift.operators.questions import clean_text, pair_details, require_unique_ids, with_defaults
from twinsift.operators.reports import entry_heatmap, heatmap_grid
from twinsift.operators.text_pairs import similar_texts
from twinsift.operators.tfidf import tfidf_vectors
from twinsift.operators.vector_pairs import similar_vectors
from twinsift.sources.files import read_pairs, write_json, write_lines, write_parquet

# The defaults of a run.
THRESHOLD = 0.78
TOP_K = 10


@dataclass(frozen=True)
class Settings:
    """``top_k=None`` reports all pairs, a number only pairs from the k nearest neighbours."""

    threshold: float = THRESHOLD
    top_k: int | None = TOP_K
    symmetric: bool = False
    bins: int = 50
    blocking: Blocking = Blocking()


def find_pairs(questions: DataFrame, vectors: DataFrame | None, settings: Settings = Settings()) -> DataFrame:
    """(id1, id2, similarity) by TF-IDF, or by ``vectors`` if given."""
    if settings.top_k is None:
        if vectors is None:
            return similar_texts(questions, settings.threshold)
        return similar_vectors(vectors, settings.threshold, blocking=settings.blocking)
    if vectors is None:
        neighbors = nearest_texts(questions, settings.top_k, settings.threshold)
    else:
        neighbors = nearest(vectors, settings.top_k, blocking=settings.blocking)
    return neighbor_pairs(neighbors, settings.threshold, symmetric=settings.symmetric)


def run_dedup(questions: DataFrame, folder: str, factory: ModelFactory | None = None,
              settings: Settings = Settings()) -> None:
    """Write ``embeddings``, ``similarity_pairs`` and ``heatmap`` below the folder.

    Without a model the embeddings are TF-IDF vectors in long form (id, token, u).
    """
    spark = questions.sparkSession
    questions = clean_text(with_defaults(require_unique_ids(questions)))
    with temporary(spark):
        found = encode(questions, factory) if factory is not None else tfidf_vectors(questions)
        write_parquet(found, f"{folder}/embeddings")
        found = spark.read.parquet(f"{folder}/embeddings")
        if factory is not None:
            vectors, heatmap = found, heatmap_grid(found, settings.bins)
        else:
            entries = found.select("question_id", F.col("token").alias("dim"), F.col("u").alias("value"))
            vectors, heatmap = None, entry_heatmap(questions, entries, settings.bins)
        write_parquet(heatmap, f"{folder}/heatmap")
        pairs = find_pairs(questions, vectors, settings)
        write_lines(pair_details(pairs, questions, digits=None), f"{folder}/similarity_pairs")


def run_clusters(spark: SparkSession, folder: str) -> None:
    """Write ``clusters`` from the pairs of an earlier run: one row per cluster, or per part of a large one."""
    with temporary(spark):
        pairs = read_pairs(spark, f"{folder}/similarity_pairs", own=True)
        write_json(cluster_lists(connected_components(pairs)), f"{folder}/clusters")


def run(questions: DataFrame, folder: str, factory: ModelFactory | None = None,
        settings: Settings = Settings()) -> None:
    run_dedup(questions, folder, factory, settings)
    run_clusters(questions.sparkSession, folder)
