"""Collapse rows with equal content and expand results back to all rows.

Equal rows have similarity 1 to each other and the same similarity to everything else,
so the search runs once per distinct content, on the smallest id (the *keeper*).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.lineage import stage
from twinsift.operators.skew import CHUNK_ROWS, chunk_count, chunk_of, lookup


def collapse(rows: DataFrame, id_col: str, content: Column, payload: str,
             hot_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Split rows into ``keepers`` (keeper, copies, payload), stored, and ``members`` (id, keeper, copies).

    ``members`` lists every row, the keeper included, of the contents that occur more than once.
    """
    groups, members = content_groups(rows, id_col, content, hot_rows)
    return stage(keepers_of(rows, id_col, groups, payload), "keepers"), members


def content_groups(rows: DataFrame, id_col: str, content: Column,
                   hot_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``groups`` (content, keeper, copies) and ``members`` of repeated contents, both stored.

    ``content`` is a digest of the payload: only digests are grouped. ``copies`` is the number of
    equal rows.
    """
    keyed = rows.select(F.col(id_col).alias("id"), content.alias("content"))
    groups = stage(keyed.groupBy("content").agg(
        F.min("id").alias("keeper"), F.count(F.lit(1)).alias("copies")), "groups")
    repeated = groups.where("copies > 1")
    members = stage(lookup(keyed, repeated, "content", "copies", hot_rows=hot_rows)
                    .select("id", "keeper", "copies"), "members")
    return groups, members


def keepers_of(rows: DataFrame, id_col: str, groups: DataFrame, payload: str) -> DataFrame:
    """(keeper, copies, payload), dealt evenly over all partitions, as what follows costs more than the join."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(F.col(id_col).alias("keeper"), payload).repartition(parts, "keeper")
    return dealt.join(groups.select("keeper", "copies"), "keeper")


def expand_pairs(pairs: DataFrame, members: DataFrame, copy_similarity: DataFrame,
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """All row pairs behind keeper pairs (id1, id2, similarity, copies1, copies2).

    ``copy_similarity`` (keeper, copies, similarity) adds the pairs inside a group of
    copies. Members are cut into chunks, so that one join key yields at most about
    ``chunk_rows`` squared pairs.
    """
    inside = copy_similarity.where("copies > 1").select(
        F.col("keeper").alias("id1"), F.col("keeper").alias("id2"), "similarity",
        F.col("copies").alias("copies1"), F.col("copies").alias("copies2"))
    chunks = {s: F.sequence(F.lit(0), chunk_count(F.col(f"copies{s}"), chunk_rows) - 1) for s in (1, 2)}
    keyed = (
        pairs.select("id1", "id2", "similarity", "copies1", "copies2").unionByName(inside)
        .withColumn("chunk1", F.explode(chunks[1]))
        .withColumn("chunk2", F.explode(chunks[2]))
        .where("id1 <> id2 or chunk1 <= chunk2")
    )
    # Pairs of two single rows are final; only the others go through the joins.
    single = (F.col("copies1") == 1) & (F.col("copies2") == 1)
    chunked = members.select(
        "keeper", "id", chunk_of(F.col("id"), chunk_count(F.col("copies"), chunk_rows)).alias("chunk"))
    grouped = keyed.where(~single)
    for side in ("1", "2"):
        side_members = chunked.select(
            F.col("keeper").alias(f"id{side}"), F.col("chunk").alias(f"chunk{side}"),
            F.col("id").alias(f"member{side}"))
        grouped = grouped.join(side_members, [f"id{side}", f"chunk{side}"], "left")
    # A single row has no entry in members; a chunk without members gives no pair.
    member = {s: F.when(F.col(f"copies{s}") == 1, F.col(f"id{s}")).otherwise(F.col(f"member{s}")) for s in (1, 2)}
    grouped = (
        grouped.withColumns({"row1": member[1], "row2": member[2]})
        .where("row1 is not null and row2 is not null")
        .where("id1 <> id2 or chunk1 < chunk2 or row1 < row2")
        .select(F.least("row1", "row2").alias("id1"), F.greatest("row1", "row2").alias("id2"), "similarity")
    )
    return keyed.where(single).select("id1", "id2", "similarity").unionByName(grouped)


def expand_groups(labelled: DataFrame, members: DataFrame) -> DataFrame:
    """Give every row the label of its keeper: (cluster_id, keeper, copies) -> (cluster_id, id)."""
    alone = labelled.where("copies = 1").select("cluster_id", F.col("keeper").alias("id"))
    groups = labelled.where("copies > 1").select("keeper", "cluster_id", "copies")
    return alone.unionByName(
        lookup(members.select("id", "keeper"), groups, "keeper", "copies").select("cluster_id", "id"))
