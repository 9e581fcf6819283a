"""Near duplicates by SimHash, joined through covering masks (covering locality-sensitive hashing, Pagh 2016).

The fingerprint of a text has a bit set where more than half of the 64-bit hashes of its word shingles have
it. To find all fingerprints that differ in at most two bits, every bit position gets one of the seven
non-zero vectors of three bits. For each of the seven vectors v there is a table, whose mask holds the
positions with an odd inner product with v. Any two positions have some v that is orthogonal to
both, so two fingerprints that differ only there agree under the mask of v and collide in its table: no pair
within the radius is missed, whatever the data.

A mask keeps 36 or 37 bits. A bucket with many fingerprints is split again by a second and a third
family of masks over the same positions, dealt out differently. Each family covers all pairs, so the
combined masks do as well, and they leave at most 10 bits open at the third level: a bucket there holds at most
1,024 fingerprints. What is compared in a bucket is thereby bounded, and only edges that connect come back.

Edge cases. Null text counts as empty; texts without words have the fingerprint zero, which is linked like
any other. Equal fingerprints are one node, so repeated rows cost nothing in the search. A null id is never
the smallest, unless a component has no other. Long texts are hashed in blocks of shingles.
An empty table gives no rows. Columns of any other name may be there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from twinsift.lineage import stage
from twinsift.llm.common import field, whole
from twinsift.operators.components import connected_components
from twinsift.operators.skew import lookup

WORDS = 3
RADIUS = 2
SEED = 42
BITS = 64
# Shingles hashed at once, to bound the memory of a long text.
BLOCK_SHINGLES = 65_536
# Fingerprints of a bucket that are compared directly; larger buckets are split by the next masks.
BUCKET_ROWS = 1_024


# ---- fingerprints -------------------------------------------------------------------------


def _joined_words(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a text with one space between them, where each starts and where it ends."""
    raw = np.frombuffer(text.lower(), np.uint8)
    space = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    after = np.concatenate([[True], space[:-1]]) if len(raw) else space
    kept = ~(space & after)
    joined, gap = raw[kept].copy(), space[kept]
    if len(gap) and gap[-1]:
        joined, gap = joined[:-1], gap[:-1]
    joined[gap] = 0x20
    gaps = np.flatnonzero(gap)
    if not len(joined):
        return b"", gaps, gaps
    return joined.tobytes(), np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(joined)]])


def fingerprint(text: str) -> int:
    """The SimHash of a text, as an unsigned number."""
    joined, starts, ends = _joined_words(text.encode("utf-8", "surrogatepass"))
    if not len(starts):
        return 0
    size = min(WORDS, len(starts))
    starts, ends = starts[:len(starts) - size + 1], ends[size - 1:]
    counts = np.zeros(BITS, np.int64)
    for low in range(0, len(starts), BLOCK_SHINGLES):
        part = slice(low, low + BLOCK_SHINGLES)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[part].tolist(), ends[part].tolist())],
                          dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as a signed number) for every row."""
    given = docs.select(field(id_col).alias("id"), whole(text_col).alias("text"))
    schema = StructType([given.schema["id"], StructField("fingerprint", LongType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found)], ["id", "fingerprint"])

    return given.mapInArrow(hashed, schema)


# ---- covering masks -----------------------------------------------------------------------


def covering_masks(level: int) -> list[int]:
    """Seven masks over 64 positions: any two positions are both outside one of them."""
    masks = []
    for v in range(1, 8):
        mask = 0
        for i in range(BITS):
            row, place = divmod(i, 7)
            vector = 1 + (place, row % 7, 2 * (place + row) % 7)[level]
            if (vector & v).bit_count() % 2:
                mask |= 1 << i
        masks.append(mask)
    return masks


LEVELS = 3


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _split(rows: DataFrame, level: int) -> DataFrame:
    """One row per table of the level: (fingerprint, tables, mask, key); ``tables`` names the masks used so far."""
    masks = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(_signed(m)).cast("bigint").alias("m"))
                      for v, m in enumerate(covering_masks(level))])
    mask = F.col("mask").bitwiseOR(F.col("one.m"))
    return rows.withColumn("one", F.explode(masks)).select(
        "fingerprint", (F.col("tables") * 8 + F.col("one.v") + 1).alias("tables"), mask.alias("mask"),
        F.col("fingerprint").bitwiseAND(mask).alias("key"))


def _links(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of edges that connect the fingerprints of a bucket within the radius, at most one fewer than these."""
    parent = np.arange(len(bucket))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    left, right = [], []
    for i in range(len(bucket) - 1):
        near = np.flatnonzero(np.bitwise_count(bucket[i + 1:] ^ bucket[i]) <= RADIUS) + i + 1
        for j in near.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                left.append(i)
                right.append(j)
    return np.array(left, np.int64), np.array(right, np.int64)


def _edges_of_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each run of rows with equal (tables, key); a run may go over several batches."""
    held = [np.empty(0, np.int64)] * 3
    last = False
    while not last:
        batch = next(batches, None)
        last = batch is None
        rows = held if last else [np.concatenate([h, batch.column(c).to_numpy()]) for c, h in zip(("tables", "key", "fingerprint"), held)]
        tables, key, value = rows
        new = (tables[1:] != tables[:-1]) | (key[1:] != key[:-1])
        heads = np.concatenate([[0], np.flatnonzero(new) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)
        # The last run may go on in the next batch.
        runs = len(heads) - 1 if last else max(0, len(heads) - 2)
        sizes = np.diff(heads)[:runs]
        pairs = heads[:runs][sizes == 2]
        near = pairs[np.bitwise_count(value[pairs] ^ value[np.minimum(pairs + 1, len(value) - 1)]) <= RADIUS] if len(pairs) else pairs
        found = [(value[near], value[near + 1])]
        for start, size in zip(heads[:runs][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            bucket = value[start:start + size]
            left, right = _links(bucket)
            found.append((bucket[left], bucket[right]))
        held = [r[heads[runs]:] for r in rows] if len(key) else held
        columns = [pa.array(np.concatenate([f[i] for f in found])) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, ["id1", "id2"])


def links(fingerprints: DataFrame) -> DataFrame:
    """(id1, id2): edges between distinct fingerprints within the radius, enough to connect all that are linked.

    ``fingerprints`` has one row per fingerprint.
    """
    rows = fingerprints.select("fingerprint", F.lit(0).cast("bigint").alias("tables"), F.lit(0).cast("bigint").alias("mask"))
    found = None
    for level in range(LEVELS):
        split = stage(_split(rows, level), "covering-tables")
        sized = stage(split.groupBy("tables", "key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "buckets")
        # At the last level the masks leave few free bits, so that no bucket is large.
        small = sized.where(F.col("rows") <= BUCKET_ROWS) if level + 1 < LEVELS else sized
        chosen = lookup(split, small, ["tables", "key"], "rows").select("tables", "key", "fingerprint")
        edges = (chosen.repartition("tables", "key").sortWithinPartitions("tables", "key")
                 .mapInArrow(_edges_of_sorted, "id1 bigint, id2 bigint"))
        found = edges if found is None else found.unionByName(edges)
        large = sized.where(F.col("rows") > BUCKET_ROWS)
        if level + 1 == LEVELS or not large.limit(1).count():
            return found
        rows = lookup(split, large, ["tables", "key"], "rows").select("fingerprint", "tables", "mask")
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row; the component is named by its smallest id."""
    hashed = stage(fingerprints(docs, id_col, text_col), "simhash")
    distinct = stage(hashed.groupBy("fingerprint").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")), "distinct")
    found = connected_components(links(distinct)).select(F.col("id").alias("fingerprint"), "cluster_id")
    labelled = stage(distinct.join(found, "fingerprint", "left")
                     .withColumn("cluster_id", F.coalesce("cluster_id", "fingerprint")), "components")
    least = labelled.groupBy("cluster_id").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    named = lookup(labelled, stage(least, "names"), "cluster_id", "nodes").select("fingerprint", "rows", "component_id")
    return lookup(hashed, stage(named, "named"), "fingerprint", "rows").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
