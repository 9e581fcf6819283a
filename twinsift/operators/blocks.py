"""Spread an all-against-all vector comparison over bounded tasks, exactly.

Vectors are grouped into cells: the nearest of a fixed number of pivots, and a ring of
the angle to it. Two vectors at an angle of at most r have angles to any pivot that
differ by at most r (triangle inequality), so a vector only needs to meet the cells whose
angles to a pivot come within r of its own. That holds for every pivot: a cell is left out
if its own pivot or any of the witnesses, which are further pivots spread far apart, rules it out.
Cells are cut into chunks, and each pair of chunks is one task: a crowded cell gives
more tasks, not larger ones. Pivots and chunks steer the work only; the result does not
depend on them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from twinsift.lineage import stage
from twinsift.operators.skew import chunk_count, chunk_of

BLOCK_ROWS = 2_048
# Blocks grow with the table, so that a vector is copied to about as many tasks at any size, up to this many rows.
BLOCKS = 8
# The same for a given block size, which small tables keep.
GIVEN_BLOCKS = 64
MAX_BLOCK_ROWS = 32_768
# Bounds what is collected and broadcast: MAX_PIVOTS vectors, and two angles for each of
# MAX_PIVOTS * RINGS cells to its own pivot and to WITNESSES others.
MAX_PIVOTS = 512
WITNESSES = 16
RINGS = 18
RING = np.pi / RINGS
SLACK = 1e-6
# Rows compared with all cells at once, to bound the memory of the comparison.
VISIT_ROWS = 1_024


@dataclass(frozen=True)
class Blocking:
    """How to cut the work; ``pivots=None`` takes one per block of vectors, ``block_rows=None`` suits the number of vectors.

    A given ``block_rows`` is the least: tables of more than ``GIVEN_BLOCKS`` such blocks have larger ones.
    """

    block_rows: int | None = None
    pivots: int | None = None

    def suited(self, vectors: DataFrame) -> Blocking:
        """With the block size for stored vectors."""
        least, blocks = (BLOCK_ROWS, BLOCKS) if self.block_rows is None else (self.block_rows, GIVEN_BLOCKS)
        return replace(self, block_rows=max(least, min(vectors.count() // blocks, MAX_BLOCK_ROWS)))


@dataclass(frozen=True)
class Pivots:
    """Unit vectors: those that name the cells, and the witnesses that only rule cells out."""

    homes: np.ndarray
    witnesses: np.ndarray


def matrix(column) -> np.ndarray:
    """Arrow list column -> unit rows in double precision; zero rows stay zero.

    Missing, undefined and infinite numbers have no direction and are an error.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.unique(np.diff(column.offsets.to_numpy()))
    if not len(column):
        return np.zeros((0, 1))
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {lengths.tolist()}")
    # flatten() respects the slice of a sliced column, as the offsets do.
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    if not np.isfinite(rows).all():
        raise ValueError("a vector has a missing, undefined or infinite number")
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths > 0)


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1.0, 1.0))


def _home_cells(angles: np.ndarray) -> np.ndarray:
    nearest = angles.argmin(axis=1)
    ring = np.minimum((angles[np.arange(len(angles)), nearest] / RING).astype(int), RINGS - 1)
    return nearest * RINGS + ring


def _cell_bounds(homes: DataFrame, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(occupied cells, least angles, greatest angles) of the vectors at home in each cell.

    The angles are those to the cell's own pivot, then those to each witness.
    """
    number = 1 + len(pivots.witnesses)

    def bound(batches):
        for batch in (b for b in batches if b.num_rows):
            rows, cell = matrix(batch.column("vector")), batch.column("cell").to_numpy()
            own = _angles(rows, pivots.homes)[np.arange(len(cell)), cell // RINGS]
            angles = np.column_stack([own, _angles(rows, pivots.witnesses)])
            occupied, at = np.unique(cell, return_inverse=True)
            low = np.full((len(occupied), number), np.inf)
            high = -low
            np.minimum.at(low, at, angles)
            np.maximum.at(high, at, angles)
            yield from pa.table({
                "cell": np.repeat(occupied, number), "pivot": np.tile(np.arange(number, dtype=np.int32), len(occupied)),
                "low": low.ravel(), "high": high.ravel()}).to_batches()

    found = (homes.mapInArrow(bound, "cell int, pivot int, low double, high double")
             .groupBy("cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow())
    cell, pivot, low, high = (found[c].to_numpy() for c in ("cell", "pivot", "low", "high"))
    order = np.lexsort((pivot, cell))
    return np.unique(cell), low[order].reshape(-1, number), high[order].reshape(-1, number)


def _visited(rows: np.ndarray, radius: np.ndarray, pivots: Pivots, bounds) -> np.ndarray:
    """Boolean (row, occupied cell): may the cell hold a vector within the row's radius?"""
    occupied, low, high = bounds
    reach = radius[:, None] + SLACK
    to_pivot = _angles(rows, pivots.homes)[:, occupied // RINGS]
    flags = (to_pivot - reach <= high[:, 0]) & (to_pivot + reach >= low[:, 0])
    for n, angle in enumerate(_angles(rows, pivots.witnesses).T, 1):
        flags &= (angle[:, None] - reach <= high[:, n]) & (angle[:, None] + reach >= low[:, n])
    return flags


def _bool_rows_to_lists(flags: np.ndarray, values: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], flags.sum(axis=1).cumsum()]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[flags.nonzero()[1]].astype(np.int32)))


def _spread(rows: np.ndarray, number: int) -> np.ndarray:
    """Up to ``number`` of the rows, each the farthest from those before it."""
    chosen, nearest = [], np.full(len(rows), np.inf)
    for _ in range(min(number, len(rows))):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _angles(rows, rows[chosen[-1:]])[:, 0])
    return rows[chosen]


def choose_pivots(vectors: DataFrame, blocking: Blocking) -> Pivots:
    """Stored vectors, picked by hash: one to MAX_PIVOTS for the cells, WITNESSES spread ones of at least four times as many."""
    blocking = blocking.suited(vectors)
    count = blocking.pivots if blocking.pivots is not None else vectors.count() // blocking.block_rows
    count = max(1, min(count, MAX_PIVOTS))
    picked = vectors.orderBy(F.xxhash64("keeper"), "keeper").limit(max(count, 4 * WITNESSES)).select("vector")
    column = picked.toArrow().column("vector")
    rows = matrix(column) if len(column) else np.zeros((1, 1))
    return Pivots(rows[:count], _spread(rows, WITNESSES))


def with_cells(vectors: DataFrame, pivots: Pivots) -> DataFrame:
    """Add the home cell of every vector."""
    def assign(batches):
        for batch in batches:
            cells = _home_cells(_angles(matrix(batch.column("vector")), pivots.homes)) if batch.num_rows else []
            yield batch.append_column("cell", pa.array(cells, pa.int32()))

    return vectors.mapInArrow(assign, StructType([*vectors.schema, StructField("cell", IntegerType())]))


def with_visits(homes: DataFrame, pivots: Pivots, both_ways: bool) -> DataFrame:
    """Add the cells in which each vector must meet others, within its ``radius``.

    ``both_ways`` lists every such cell, the home cell included. Otherwise two cells that
    see each other are joined in only one of them, and the home cell is left out.
    """
    bounds = _cell_bounds(homes, pivots)
    occupied = bounds[0]

    def visit(batches):
        for batch in (whole.slice(start, VISIT_ROWS) for whole in batches
                      for start in range(0, whole.num_rows, VISIT_ROWS)):
            flags = _visited(matrix(batch.column("vector")), batch.column("radius").to_numpy(), pivots, bounds)
            home = batch.column("cell").to_numpy()[:, None]
            if not both_ways:
                flags &= ((home + occupied) % 2 == 0) == (home < occupied)
                flags &= home != occupied
            yield batch.append_column("visits", _bool_rows_to_lists(flags, occupied))

    return homes.mapInArrow(visit, StructType([*homes.schema, StructField("visits", ArrayType(IntegerType()))]))


def block_tasks(placed: DataFrame, block_rows: int, within_cells: bool) -> DataFrame:
    """Copy every vector to the chunk pairs (cell, own, x, y) in which it takes part.

    ``side`` is 0 for the vectors at home and 1 for the ones they meet. ``within_cells``
    adds the pairs of home chunks (own = true), each unordered pair once; a chunk paired
    with itself has side 0 only.
    """
    # One row per cell, at most MAX_PIVOTS * RINGS.
    homes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("homes"))
    guests = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(
        F.count(F.lit(1)).alias("guests"))
    sizes = F.broadcast(stage(
        homes.join(guests, "cell", "left").select(
            "cell", chunk_count(F.col("homes"), block_rows).alias("nx"),
            chunk_count(F.coalesce("guests", F.lit(0)), block_rows).alias("ny")), "cells"))
    payload = [c for c in placed.columns if c not in ("cell", "visits", "radius")]

    def rows(df: DataFrame, own: bool, x: Column, y: Column, side: Column) -> DataFrame:
        return df.select("cell", F.lit(own).alias("own"), x.alias("x"), y.alias("y"),
                         side.cast("int").alias("side"), *payload)

    at_home = placed.join(sizes, "cell").withColumn("chunk", chunk_of(F.col("keeper"), F.col("nx")))
    meeting = (placed.withColumn("cell", F.explode("visits")).join(sizes, "cell")
               .withColumn("chunk", chunk_of(F.col("keeper"), F.col("ny"))))
    other = F.col("other")
    tasks = rows(
        at_home.where("ny > 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))),
        False, F.col("chunk"), other, F.lit(0))
    tasks = tasks.unionByName(rows(
        meeting.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nx") - 1))),
        False, other, F.col("chunk"), F.lit(1)))
    if within_cells:
        tasks = tasks.unionByName(rows(
            at_home.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nx") - 1))),
            True, F.least("chunk", other), F.greatest("chunk", other), F.col("chunk") > other))
    return tasks


TASK_KEY = ["cell", "own", "x", "y"]


def sides(table: pa.Table) -> tuple[pa.Table, np.ndarray, pa.Table, np.ndarray, bool]:
    """(home rows, their unit vectors, rows they meet, their unit vectors, same rows?).

    Chunks are dealt by hash, so that a side can be empty.
    """
    side = table.column("side").to_numpy()
    home = table.filter(pa.array(side == 0))
    same = bool(table.column("own")[0].as_py()) and table.column("x")[0] == table.column("y")[0]
    meets = home if same else table.filter(pa.array(side == 1))
    return home, matrix(home.column("vector")), meets, matrix(meets.column("vector")), same
