"""Pairs and clusters of dense vectors whose cosine reaches a threshold, exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from twinsift.functions.vectors import is_zero
from twinsift.lineage import stage
from twinsift.operators.blocks import (
    TASK_KEY, Blocking, block_tasks, choose_pivots, matrix, sides, with_cells, with_visits)
from twinsift.operators.components import clusters_of_keepers
from twinsift.operators.copies import collapse, expand_pairs
from twinsift.operators.text_pairs import EQUAL, check_threshold

# Similarities that are computed at once, to bound the memory of the product.
TILE_CELLS = 1_048_576
# Pairs that are returned at once, with what they carry.
CARRY_ROWS = 8_192


def tile_rows(met: int) -> int:
    """Rows of a block that are multiplied at once with ``met`` others."""
    return max(1, TILE_CELLS // max(1, met))


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str,
                     hot_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Keepers (keeper, copies, vector) and members of repeated vectors."""
    known = vectors.where(F.col(vector_col).isNotNull())
    digest = F.struct(F.xxhash64(F.lit(1), vector_col), F.xxhash64(F.lit(2), vector_col))  # 128 bits
    keepers, members = collapse(known.withColumn("vector", F.col(vector_col)), id_col, digest, "vector", hot_rows)
    return keepers, members


def _tiles(table: pa.Table, threshold: float):
    """(home rows, met rows, home positions, met positions, similarities) tile by tile."""
    home, a, meets, b, same = sides(table)
    if not len(b):
        return
    rows = tile_rows(len(b))
    for start in range(0, len(a), rows):
        product = np.clip(a[start:start + rows] @ b.T, -1.0, 1.0)
        hit = product >= threshold - EQUAL
        if same:
            hit &= np.arange(start, start + len(product))[:, None] < np.arange(len(b))
        i, j = hit.nonzero()
        yield home, meets, i + start, j, product[i, j]


def _pair_rows(home, meets, i, j, similarity, carry: tuple[str, ...] = ()) -> pa.Table:
    i, j = pa.array(i), pa.array(j)
    columns = {"id1": home.column("keeper").take(i), "id2": meets.column("keeper").take(j), "similarity": pa.array(similarity)}
    for name in ("copies", *carry):
        columns |= {f"{name}1": home.column(name).take(i), f"{name}2": meets.column(name).take(j)}
    return pa.table(columns)


def _all_pairs(threshold: float, carry: tuple[str, ...] = ()):
    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, meets, i, j, similarity in _tiles(pa.Table.from_batches(list(batches)), threshold):
            for rows in (slice(start, start + CARRY_ROWS) for start in range(0, len(i), CARRY_ROWS)):
                yield from _pair_rows(home, meets, i[rows], j[rows], similarity[rows], carry).to_batches()
    return block


def _spanning_pairs(threshold: float):
    """Pairs that connect what all pairs of the block connect, fewer than its vectors."""
    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, offset = None, 0
        for home, meets, i, j, similarity in _tiles(pa.Table.from_batches(list(batches)), threshold):
            if label is None:
                offset = 0 if meets is home else len(home)
                label = np.arange(offset + len(meets))
            keep = []
            for row in np.unique(i):
                at = np.arange(*np.searchsorted(i, [row, row + 1]))
                groups, first = np.unique(label[offset + j[at]], return_index=True)
                new = groups != label[row]
                if new.any():
                    keep.extend(at[first[new]])
                    label[np.isin(label, groups)] = label[row]
            yield from _pair_rows(home, meets, i[keep], j[keep], similarity[keep]).to_batches()
    return block


def neighbor_counts(threshold: float):
    """(id, others): rows within reach of each vector of the block, copies counted."""
    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list = []
        for home, meets, i, j, _ in _tiles(pa.Table.from_batches(list(batches)), threshold):
            if not found:
                found = [(side, np.zeros(len(side), np.int64), side.column("copies").to_numpy()) for side in (home, meets)]
            (_, at_home, home_copies), (_, met, met_copies) = found
            np.add.at(at_home, i, met_copies[j])
            np.add.at(met, j, home_copies[i])
        for side, others, _ in found:
            yield from pa.table({"id": side.column("keeper"), "others": others}).filter(pa.array(others > 0)).to_batches()
    return block


def border_labels(threshold: float):
    """(id, label): the smallest label within reach of each vector that has none (-1) itself.

    Only vectors with a label are compared with vectors without one.
    """
    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        side, label = table.column("side").to_numpy(), table.column("label").to_numpy()
        own = bool(table.column("own")[0].as_py()) and table.column("x")[0] == table.column("y")[0]
        for at in (0,) if own else (0, 1):
            open_rows = table.filter(pa.array((side == at) & (label < 0)))
            cores = table.filter(pa.array((side == (0 if own else 1 - at)) & (label >= 0)))
            if len(open_rows) and len(cores):
                yield from _smallest_label(open_rows, cores, threshold).to_batches()
    return block


def _smallest_label(open_rows: pa.Table, cores: pa.Table, threshold: float) -> pa.Table:
    none = np.iinfo(np.int64).max
    a, b, label = matrix(open_rows.column("vector")), matrix(cores.column("vector")), cores.column("label").to_numpy()
    least = np.full(len(a), none)
    rows = tile_rows(len(b))
    for start in range(0, len(a), rows):
        near = np.clip(a[start:start + rows] @ b.T, -1.0, 1.0) >= threshold - EQUAL
        least[start:start + rows] = np.where(near, label, none).min(axis=1)
    return pa.table({"id": open_rows.column("keeper"), "label": least}).filter(pa.array(least < none))


def place(keepers: DataFrame, threshold: float, blocking: Blocking) -> DataFrame:
    """Keepers with the cells in which they meet others within the threshold, stored; several scans can read it."""
    if threshold > 0:
        keepers = keepers.where(~is_zero(F.col("vector")))
    pivots = choose_pivots(keepers, blocking)
    homes = with_cells(keepers, pivots).withColumn("radius", F.lit(float(np.arccos(threshold))))
    return stage(with_visits(homes, pivots, both_ways=False), "placed")


def block_scan(placed: DataFrame, blocking: Blocking, block, schema: StructType) -> DataFrame:
    """What ``block`` finds in the chunk pairs in which placed vectors can meet."""
    return (block_tasks(placed, blocking.block_rows, within_cells=True)
            .groupBy(*TASK_KEY).applyInArrow(block, schema))


def _block_search(placed: DataFrame, blocking: Blocking, block, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id1 < id2, similarity, copies1, copies2, carried columns of both) of keepers, by ``block`` on each chunk pair."""
    id_type, names = placed.schema["keeper"].dataType, ("copies", *carry)
    schema = StructType().add("id1", id_type).add("id2", id_type).add("similarity", "double")
    for name in names:
        for side in "12":
            schema = schema.add(f"{name}{side}", placed.schema[name].dataType)
    found = block_scan(placed, blocking, block, schema)
    ordered = F.col("id1") < F.col("id2")
    return found.select(
        F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), "similarity",
        *[F.when(ordered, F.col(name + a)).otherwise(F.col(name + b)).alias(name + a)
          for name in names for a, b in ("12", "21")])


def keeper_pairs(keepers: DataFrame, threshold: float, blocking: Blocking = Blocking(),
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of keepers; ``carry`` names further columns of theirs that come along, as ``name1`` and ``name2``."""
    blocking = blocking.suited(keepers)
    return _block_search(place(keepers, threshold, blocking), blocking, _all_pairs(threshold, carry), carry)


def spanning_pairs(keepers: DataFrame, threshold: float, blocking: Blocking = Blocking()) -> DataFrame:
    """Pairs that connect what all pairs connect, about as many as vectors."""
    blocking = blocking.suited(keepers)
    return spanning_pairs_of(place(keepers, threshold, blocking), threshold, blocking)


def spanning_pairs_of(placed: DataFrame, threshold: float, blocking: Blocking) -> DataFrame:
    return _block_search(placed, blocking, _spanning_pairs(threshold))


def similar_vectors(vectors: DataFrame, threshold: float = 0.78, id_col: str = "question_id",
                    vector_col: str = "embedding", blocking: Blocking = Blocking()) -> DataFrame:
    """All pairs (id1 < id2, similarity) of vectors whose cosine is >= threshold.

    An all-zero vector has similarity 0 to everything.
    """
    return expand_pairs(*keeper_vector_pairs(vectors, threshold, id_col, vector_col, blocking))


def similar_rows(rows: DataFrame, threshold: float, carry: tuple[str, ...], id_col: str = "question_id",
                 vector_col: str = "embedding", blocking: Blocking = Blocking()) -> DataFrame:
    """``similar_vectors`` with columns of both rows: (id1, id2, similarity, alone, name1 and name2 of each carried column).

    The columns travel with the vectors to the blocks, so that a pair of two rows that stand for themselves
    (``alone``) leaves its block complete and is neither stored nor joined. Pairs of copies and of repeated ids are joined.
    """
    check_threshold(threshold)
    keepers, members = distinct_vectors(rows, id_col, vector_col)
    further = [c for c in carry if c != vector_col]
    alone = (rows.groupBy(F.col(id_col).alias("keeper"))
             .agg(F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in further])
             .where("_rows = 1").select("keeper", F.lit(True).alias("alone"), *further))
    keepers = stage(keepers.join(alone, "keeper", "left").withColumn(
        "alone", F.coalesce("alone", F.lit(False)) & (F.col("copies") == 1)), "carrying")
    names = ["vector" if c == vector_col else c for c in carry]
    found = keeper_pairs(keepers, threshold, blocking, ("alone", *names))
    complete = F.col("alone1") & F.col("alone2")
    sides = [(c, name, s) for c, name in zip(carry, names) for s in "12"]
    whole = found.where(complete).select(
        "id1", "id2", "similarity", F.lit(True).alias("alone"),
        *[F.col(f"{name}{s}").alias(f"{c}{s}") for c, name, s in sides])
    if keepers.where("not alone").isEmpty():
        return whole
    joined = expand_pairs(found.where(~complete), members, _copy_groups(keepers, threshold))
    for s in "12":
        joined = joined.join(rows.select(F.col(id_col).alias(f"id{s}"), *[F.col(c).alias(f"{c}{s}") for c in carry]), f"id{s}")
    return whole.unionByName(joined.withColumn("alone", F.lit(False)))


def _copy_groups(keepers: DataFrame, threshold: float) -> DataFrame:
    zero = is_zero(F.col("vector"))
    return (keepers.where(~zero) if threshold > 0 else keepers).select(
        "keeper", "copies", F.when(zero, 0.0).otherwise(1.0).alias("similarity"))


def keeper_vector_pairs(vectors: DataFrame, threshold: float, id_col: str = "question_id",
                        vector_col: str = "embedding", blocking: Blocking = Blocking()):
    """Pairs of distinct vectors (id1, id2, similarity, copies1, copies2), members, and copy groups."""
    check_threshold(threshold)
    keepers, members = distinct_vectors(vectors, id_col, vector_col)
    return keeper_pairs(keepers, threshold, blocking), members, _copy_groups(keepers, threshold)


def vector_clusters(vectors: DataFrame, threshold: float = 0.78, id_col: str = "question_id",
                    vector_col: str = "embedding", blocking: Blocking = Blocking()) -> DataFrame:
    """(cluster_id, id): connected components of ``similar_vectors`` without listing all pairs.

    Every block reports only pairs that connect its vectors, and copies are attached to
    their keeper, so a large group of near copies gives about as many edges as rows.
    """
    check_threshold(threshold)
    keepers, members = distinct_vectors(vectors, id_col, vector_col)
    edges = spanning_pairs(keepers, threshold, blocking)
    similar = keepers.where(~is_zero(F.col("vector"))) if threshold > 0 else keepers
    return clusters_of_keepers(similar, members, edges)
