"""Density clustering (DBSCAN) on cosine distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from twinsift.functions.vectors import is_zero
from twinsift.lineage import stage
from twinsift.operators.blocks import Blocking
from twinsift.operators.components import connected_components
from twinsift.operators.copies import expand_groups
from twinsift.operators.order import with_position
from twinsift.operators.vector_pairs import (
    block_scan, border_labels, distinct_vectors, neighbor_counts, place, spanning_pairs_of)

NOISE = -1


def density_clusters(vectors: DataFrame, eps: float = 0.25, min_samples: int = 2,
                     id_col: str = "question_id", vector_col: str = "embedding",
                     blocking: Blocking = Blocking()) -> DataFrame:
    """(id, label, role): cluster number from 0, or -1 for noise.

    A vector is *core* if at least ``min_samples`` vectors, itself included, lie within
    cosine distance ``eps``. Core vectors within eps share a cluster; clusters are
    numbered by their smallest core id. Another vector within eps of a core is *border*
    and joins the lowest-numbered such cluster. Copies count as neighbours of each other,
    so one search over distinct vectors, weighted by copies, gives the same answer.
    """
    if not 0 < eps <= 1:
        raise ValueError(f"eps must lie in (0, 1], got {eps}")
    if min_samples < 1:
        raise ValueError(f"min_samples must be at least 1, got {min_samples}")
    keepers, members = distinct_vectors(vectors, id_col, vector_col)
    # All-zero vectors are near nothing, not even each other; each stays its own row.
    zero = is_zero(F.col("vector"))
    if eps < 1:
        zeros = expand_groups(
            keepers.where(zero).select("keeper", "copies", F.col("keeper").alias("cluster_id")), members
        ).select(F.col("id").alias("keeper"), F.lit(1).cast("bigint").alias("copies"))
        points = keepers.where(~zero).select("keeper", "copies").unionByName(zeros)
    else:
        points = keepers.select("keeper", "copies")
    # Three passes over the blocks, each with one row per vector or spanning edge as result. Vectors are
    # placed once: the later passes read fewer rows, or rows with labels, of the same placement.
    id_type = keepers.schema["keeper"].dataType
    blocking = blocking.suited(keepers)
    placed = place(keepers, 1 - eps, blocking)
    reach = block_scan(placed, blocking, neighbor_counts(1 - eps), StructType().add("id", id_type).add("others", "long"))
    reach = reach.groupBy(F.col("id").alias("keeper")).agg(F.sum("others").alias("others"))
    points = stage(
        points.join(reach, "keeper", "left")
        .withColumn("core", F.col("copies") + F.coalesce("others", F.lit(0)) >= min_samples)
        .select("keeper", "copies", "core"), "points")
    core = points.where("core").select("keeper")
    core_edges = spanning_pairs_of(placed.join(core, "keeper", "left_semi"), 1 - eps, blocking)
    roots = connected_components(core_edges).withColumnRenamed("id", "keeper")
    core_root = core.join(roots, "keeper", "left").select(
        "keeper", F.coalesce("cluster_id", "keeper").alias("root"))
    numbers = with_position(core_root.select("root").distinct(), ["root"], "label")
    core_label = stage(core_root.join(numbers, "root").select("keeper", "label"), "core_labels")
    marked = stage(placed.join(core_label, "keeper", "left").withColumn(
        "label", F.coalesce("label", F.lit(NOISE).cast("bigint"))), "marked")
    border = block_scan(marked, blocking, border_labels(1 - eps), StructType().add("id", id_type).add("label", "long"))
    border = border.groupBy(F.col("id").alias("keeper")).agg(F.min("label").alias("border_label"))
    labelled = (
        points.join(core_label, "keeper", "left").join(border, "keeper", "left")
        .select("keeper", "copies",
                F.coalesce("label", "border_label", F.lit(NOISE)).cast("bigint").alias("label"),
                F.when(F.col("core"), "core").when(F.col("border_label").isNotNull(), "border")
                .otherwise("noise").alias("role"))
    )
    packed = stage(labelled.select("keeper", "copies", F.struct("label", "role").alias("cluster_id")), "density")
    return expand_groups(packed, members).select(
        F.col("id").alias(id_col), "cluster_id.label", "cluster_id.role")
