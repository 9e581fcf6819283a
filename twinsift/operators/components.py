"""Connected components over a pair list."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, StructField, StructType

from twinsift.lineage import drop, fresh_path, stage
from twinsift.operators.copies import expand_groups
from twinsift.operators.skew import lookup


# Edges that are contracted at once, to bound the memory of a task.
CONTRACT_ROWS = 200_000


def _stars(left: np.ndarray, right: np.ndarray, nodes: int) -> np.ndarray:
    """The smallest connected node of every node, by union-find."""
    parent = list(range(nodes))
    for a, b in zip(left.tolist(), right.tolist()):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a < b:
            parent[b] = a
        else:
            parent[a] = b
    # A parent is never larger than its node, so roots are known before they are asked for.
    for node, up in enumerate(parent):
        parent[node] = parent[up]
    return np.array(parent, np.int64)


def _contracted(batches):
    """Edges of a partition -> one edge per node to the smallest node it is connected to there."""
    def stars(table: pa.Table) -> pa.Table:
        both = pa.concat_arrays([table[c].combine_chunks() for c in ("child", "parent")])
        names = both.unique().sort()
        at = pc.index_in(both, value_set=names).to_numpy()
        roots = _stars(at[:len(table)], at[len(table):], len(names))
        child = np.flatnonzero(roots != np.arange(len(roots)))
        return pa.table({"child": names.take(pa.array(child)), "parent": names.take(pa.array(roots[child]))})

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CONTRACT_ROWS:
            found = stars(pa.Table.from_batches(held))
            held, rows = [], 0
            if len(found) > CONTRACT_ROWS // 2:
                yield from found.to_batches()
            else:  # few nodes: the next edges are contracted together with what is left
                held, rows = found.cast(batch.schema).to_batches(), len(found)
    if rows:
        yield from stars(pa.Table.from_batches(held)).to_batches()


def connected_components(pairs: DataFrame, src: str = "id1", dst: str = "id2") -> DataFrame:
    """(cluster_id, id) for every id that occurs in a pair; cluster_id is the smallest member.

    Edges are contracted first where they are, by union-find inside each partition, which leaves
    at most one edge per node and partition. Then follow alternating large-star and small-star
    steps (Kiveris et al., 2014) on edges that point from the larger id to the smaller. Each round lifts every edge to the least
    parent of its parent, then points the other parents of a node to its least one.
    It ends when a round moves no edge: then no parent is a child and no child has two
    parents. Minima are pre-aggregated before the shuffle and hub nodes go through
    ``lookup``. The edges of each round are stored, which cuts the lineage; the round
    before is then dropped.
    """
    spark = pairs.sparkSession
    path = fresh_path(spark, "edges")
    given = pairs.where(F.col(src) != F.col(dst)).select(
        F.greatest(src, dst).alias("child"), F.least(src, dst).alias("parent"))
    schema = StructType([StructField(f.name, f.dataType) for f in given.schema])
    # Composite ids, which Arrow cannot sort, take the star rounds alone.
    fewer = given.mapInArrow(_contracted, schema) if isinstance(schema["child"].dataType, AtomicType) else given
    edges = stage(fewer.distinct().withColumn("moved", F.lit(True)), "edges", path)
    while True:
        total, moved = edges.agg(F.count(F.lit(1)), F.max("moved")).first()
        if not moved:
            break
        lifted, parents = _lift(edges, total)
        hooked, leasts = _hook(lifted, total)
        next_path = fresh_path(spark, "edges")
        edges = stage(hooked, "edges", next_path)
        for table in (lifted, parents, leasts):
            table.unpersist()
        drop(spark, path)
        path = next_path
    roots = edges.select(F.col("parent").alias("cluster_id"), F.col("parent").alias("id")).distinct()
    return edges.select(F.col("parent").alias("cluster_id"), F.col("child").alias("id")).unionByName(roots)


def _unique(edges: DataFrame) -> DataFrame:
    return edges.groupBy("child", "parent").agg(F.max("moved").alias("moved"))


def _lift(edges: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Large star: each parent becomes its own least parent, if it has one. Both tables are persisted."""
    least = edges.groupBy(F.col("child").alias("parent")).agg(F.min("parent").alias("least"))
    parents = (
        edges.groupBy("parent").agg(F.count(F.lit(1)).alias("edges"))
        .join(least, "parent", "left")
        .select("parent", "edges", F.coalesce("least", "parent").alias("target"))).persist()
    lifted = _unique(lookup(edges.drop("moved"), parents, "parent", "edges", total).select(
        "child", F.col("target").alias("parent"), (F.col("target") != F.col("parent")).alias("moved")))
    return lifted.persist(), parents


def _hook(lifted: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Small star: the other parents of a child point to its least parent. The second table is persisted."""
    least = lifted.groupBy("child").agg(
        F.min("parent").alias("least"), F.count(F.lit(1)).alias("edges"), F.max("moved").alias("moved")).persist()
    pointed = least.select("child", F.col("least").alias("parent"), "moved")
    others = lookup(lifted.drop("moved"), least.where("edges > 1").drop("moved"), "child", "edges", total)
    hooked = others.where("parent <> least").select(
        F.col("parent").alias("child"), F.col("least").alias("parent"), F.lit(True).alias("moved"))
    return _unique(pointed.unionByName(hooked)), least


def clusters_of_keepers(keepers: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster_id, id) from keeper edges; repeated rows without an edge are clusters too."""
    components = connected_components(edges).withColumnRenamed("id", "keeper")
    sized = keepers.select("keeper", "copies")
    labelled = stage(
        sized.join(components, "keeper", "left")
        .where("cluster_id is not null or copies > 1")
        .select(F.coalesce("cluster_id", "keeper").alias("cluster_id"), "keeper", "copies"), "labelled")
    return expand_groups(labelled, members)
