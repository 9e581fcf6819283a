"""Hard negatives by exact integer scores from subset-sum tables (the method of the Four Russians).

Components become integers and every row is stored as bit planes: plane p holds bit p of each
component (two's complement), eight dimensions to a byte. For an anchor, a table per group of
eight dimensions holds the sums of all 256 subsets of its components, so one byte of a candidate
looks up the share of eight dimensions at once. A plane's shares are added, and the planes are
shifted and added from the sign down: the result is the full inner product, without rounding.

Anchors are scored against all rows in blocks, one pair of blocks per group. A first pass finds
each anchor's best rows of the same label, the positives. A second pass looks for the best rows of
other labels inside the score window of each positive. Both return only the best few per
block, so what is shuffled afterwards is linear in the number of block pairs.

Edge cases. Rows with a null label or vector, or a null, undefined or infinite component take no
part. Vectors of different lengths are compared as if the shorter ones ended in zeros; an empty vector
scores 0. Every row counts, repeated ones too: a copy of an anchor is another row, and copies of an
anchor each have their own result. A null id ranks after all others. Equal scores are ranked by
id. An empty table, or one without anchors, gives no rows. Columns of any other name may be there.
Components so large that a score times 100 does not fit 64 bits are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from twinsift.lineage import stage
from twinsift.llm.common import field, partitions

# Rows of a block of candidates and of a block of anchors; they bound the memory of a task.
CANDIDATE_ROWS = 65_536
ANCHOR_ROWS = 65_536
# Smaller blocks are not worth a task: every block returns its best rows per anchor.
LEAST_ROWS = 1_024
# Anchors that are scored at once, and candidates that are looked up at once (their sums stay in cache).
ANCHOR_SLICE = 32
LOOKUP_ROWS = 2_048

LOWEST = np.iinfo(np.int64).min


# ---- bit planes and tables ----------------------------------------------------------------


def integers(column: pa.Array, dims: int) -> np.ndarray:
    """Arrow lists of integers -> one row per list, padded with zeros to ``dims``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), dims), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def bit_planes(values: np.ndarray, bits: int) -> np.ndarray:
    """(rows, bits, dims / 8) bytes: bit p of eight neighbouring dimensions, the first one lowest."""
    planes = np.empty((len(values), bits, values.shape[1] // 8), np.uint8)
    for p in range(bits):
        planes[:, p] = np.packbits(((values >> p) & 1).astype(np.uint8), axis=1, bitorder="little")
    return planes


def from_planes(planes: np.ndarray) -> np.ndarray:
    """The integers behind bit planes."""
    bits = planes.shape[1]
    values = np.zeros((len(planes), planes.shape[2] * 8), np.int64)
    for p in range(bits):
        weight = -(1 << p) if p == bits - 1 else 1 << p
        values += np.unpackbits(planes[:, p], axis=1, bitorder="little").astype(np.int64) * weight
    return values


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(dims / 8, 256, anchors): for each group of eight dimensions the sum of every subset."""
    groups = anchors.T.reshape(-1, 8, len(anchors))
    sums = np.zeros((len(groups), 256, len(anchors)), np.int64)
    for j in range(8):
        sums[:, 1 << j:2 << j] = sums[:, :1 << j] + groups[:, j, None]
    return sums


def scores(anchors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(anchors, candidates) exact inner products."""
    sums = subset_sums(anchors)
    found = np.empty((len(anchors), len(planes)), np.int64)
    bits = planes.shape[1]
    for start in range(0, len(planes), LOOKUP_ROWS):
        part = planes[start:start + LOOKUP_ROWS]
        total = np.zeros((len(part), len(anchors)), np.int64)
        for p in range(bits - 1, -1, -1):
            total <<= 1
            for group, table in enumerate(sums):
                share = table[part[:, p, group]]
                if p == bits - 1:
                    total -= share
                else:
                    total += share
        found[:, start:start + len(part)] = total.T
    return found


# ---- scoring two blocks -------------------------------------------------------------------


def _planes(column: pa.ChunkedArray, bits: int) -> np.ndarray:
    data = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(data.to_pylist()), np.uint8).reshape(len(data), bits, -1)


def _codes(ours: pa.ChunkedArray, others: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the labels of both sides, equal for equal labels."""
    both = pa.chunked_array([*ours.chunks, *others.chunks], type=ours.type).combine_chunks().dictionary_encode()
    codes = both.indices.to_numpy()
    return codes[:len(ours)], codes[len(ours):]


def _best(found: np.ndarray, k: int):
    """(row, column, score) of the k highest above LOWEST per row, the first column where equal. Overwrites ``found``."""
    rows = np.arange(len(found))
    for _ in range(min(k, found.shape[1])):
        at = found.argmax(axis=1)
        score = found[rows, at]
        hit = np.flatnonzero(score > LOWEST)
        if not len(hit):
            return
        yield hit, at[hit], score[hit]
        found[hit, at[hit]] = LOWEST


def _by_id(candidates: pa.Table) -> pa.Table:
    return candidates.take(pc.sort_indices(candidates["id"], null_placement="at_end"))


def _schema(candidates: pa.Table, *keys: str) -> pa.Schema:
    types = {"anchor": pa.int64(), "place": pa.int32()}
    return pa.schema([*[(k, types[k]) for k in keys], ("id", candidates.schema.field("id").type),
                      ("row", pa.int64()), ("score", pa.int64())])


def _table(parts: list[tuple], schema: pa.Schema) -> pa.Table:
    if not parts:
        return schema.empty_table()
    columns = [pa.concat_arrays([pa.array(p[i]).cast(schema.field(i).type) for p in parts]) for i in range(len(schema))]
    return pa.Table.from_arrays(columns, schema=schema)


def _slices(candidates: pa.Table, anchors: pa.Table, bits: int):
    """Per slice of anchors: their places, scores against the candidates, and where the labels agree."""
    theirs = _planes(candidates["planes"], bits)
    values = from_planes(_planes(anchors["planes"], bits))
    label, labels = _codes(anchors["label"], candidates["label"])
    for start in range(0, len(values), ANCHOR_SLICE):
        part = slice(start, start + ANCHOR_SLICE)
        yield part, scores(values[part], theirs), label[part, None] == labels


def _positives_of(bits: int, k: int):
    def best(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        candidates = _by_id(candidates)
        schema = _schema(candidates, "anchor")
        if not len(candidates) or not len(anchors):
            return schema.empty_table()
        row, anchor = candidates["row"].to_numpy(), anchors["row"].to_numpy()
        parts = []
        for part, found, same in _slices(candidates, anchors, bits):
            mine = anchor[part]
            found[~same | (mine[:, None] == row)] = LOWEST
            for hit, at, score in _best(found, k):
                parts.append((mine[hit], candidates["id"].take(pa.array(at)).combine_chunks(), row[at], score))
        return _table(parts, schema)

    return best


def _negatives_of(bits: int, k: int, low: int, high: int):
    def best(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        candidates = _by_id(candidates)
        schema = _schema(candidates, "anchor", "place")
        if not len(candidates) or not len(anchors):
            return schema.empty_table()
        row, anchor = candidates["row"].to_numpy(), anchors["row"].to_numpy()
        windows = anchors["windows"].to_pylist()
        parts = []
        for part, found, same in _slices(candidates, anchors, bits):
            mine, given = anchor[part], windows[part]
            found[same] = LOWEST
            for place in range(max(map(len, given))):
                who = np.array([i for i, w in enumerate(given) if len(w) > place])
                positive = np.array([given[i][place] for i in who], np.int64)
                lowest, highest = -(-low * positive // 100), high * positive // 100
                inside = found[who]
                inside[(inside < lowest[:, None]) | (inside > highest[:, None])] = LOWEST
                for hit, at, score in _best(inside, k):
                    parts.append((mine[who[hit]], np.full(len(hit), place, np.int32),
                                  candidates["id"].take(pa.array(at)).combine_chunks(), row[at], score))
        return _table(parts, schema)

    return best


# ---- the jobs -----------------------------------------------------------------------------


def _usable(rows: DataFrame) -> DataFrame:
    unusable = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~unusable)


def _packed(rows: DataFrame) -> tuple[DataFrame, int, int, int]:
    """(row, id, label, anchor, planes), the number of bits, of rows and of anchors."""
    least, most, dims, count, anchors = rows.agg(
        F.min(F.array_min("q")), F.max(F.array_max("q")), F.max(F.size("q")), F.count(F.lit(1)),
        F.count(F.when(F.col("anchor"), 1))).first()
    least, most, dims = least or 0, most or 0, -(-max(dims or 0, 1) // 8) * 8
    if 100 * dims * max(-least, most) ** 2 >= 1 << 63:
        raise ValueError(f"components from {least} to {most} in {dims} dimensions: scores do not fit 64 bits")
    bits = max(int(least).bit_length(), int(most).bit_length()) + 1
    carried = [f for f in rows.schema if f.name != "q"]
    schema = StructType([*carried, StructField("planes", BinaryType())])
    names = [f.name for f in carried]

    def pack(batches):
        for batch in batches:
            data = bit_planes(integers(batch.column("q"), dims), bits).tobytes()
            size = len(data) // max(1, batch.num_rows)
            planes = pa.array([data[i * size:(i + 1) * size] for i in range(batch.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), planes], [*names, "planes"])

    return stage(rows.mapInArrow(pack, schema), "bit-planes"), bits, count, anchors


def _dealt(rows: DataFrame, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
    """Rows with the number of their block, repeated for every block of the other side."""
    return (rows.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(own_blocks)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1)))))


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label: str | Column = "label",
                   vector_col: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 3,
                   low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    The positives of an anchor are its best ``positives`` other rows of its label. For each of them
    come the best ``negatives`` rows of other labels that score between ``low`` and ``high`` percent
    of the positive, numbered by ``rank`` from 1. Components count as floor(scale * x).
    """
    spark = rows.sparkSession
    given = _usable(rows.select(
        field(id_col).alias("id"), (field(label) if isinstance(label, str) else label).alias("label"),
        field(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")))
    numbers = given.select(
        F.monotonically_increasing_id().alias("row"), "id", "label", "anchor",
        F.transform("vector", lambda x: F.floor(x * scale)).alias("q"))
    packed, bits, count, anchor_count = _packed(numbers)
    anchor_blocks = max(1, -(-anchor_count // ANCHOR_ROWS))
    wanted = min(-(-partitions(spark) // anchor_blocks), -(-count // LEAST_ROWS))
    candidate_blocks = max(1, wanted, -(-count // CANDIDATE_ROWS))
    key = ["block", "batch"]
    candidates = _dealt(packed.drop("anchor"), "block", candidate_blocks, "batch", anchor_blocks).groupBy(*key)
    anchors = packed.where("anchor").drop("anchor")

    def scored(side: DataFrame, best, fields: list[StructField]) -> DataFrame:
        dealt = _dealt(side, "batch", anchor_blocks, "block", candidate_blocks).groupBy(*key)
        return candidates.cogroup(dealt).applyInArrow(best, StructType(fields))

    id_type = packed.schema["id"].dataType
    first = [StructField("anchor", LongType()), StructField("id", id_type), StructField("row", LongType()),
             StructField("score", LongType())]
    best_first = [F.desc("score"), F.asc_nulls_last("id"), "row"]
    found = scored(anchors.drop("id"), _positives_of(bits, positives), first)
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(*best_first))
    chosen = stage(found.withColumn("rank", rank).where(F.col("rank") <= positives)
                   .withColumn("place", F.col("rank") - 1).drop("rank"), "positives")

    windows = chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("w"))
    asking = stage(
        anchors.drop("id").join(windows.withColumnRenamed("anchor", "row"), "row")
        .withColumn("windows", F.col("w.score")).drop("w"), "windows")
    second = [first[0], StructField("place", IntegerType()), *first[1:]]
    found = scored(asking, _negatives_of(bits, negatives, low, high), second)
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(*best_first))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= negatives).select(
        "anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    asked = chosen.join(names, "anchor").select(
        "anchor", "place", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(asked, ["anchor", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
        "negative_score")

