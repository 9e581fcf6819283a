"""Near duplicates by DartMinHash (Christiani, 2020) over weighted word shingles.

A text is a weighted set: its shingles of five words, each with its count. Every shingle throws
darts: points of a Poisson process over weight and rank, the same in every text. Weights are
cut into regions [0, 1), [1, 2), [2, 4), ..., whose darts arrive by rank at the rate of the region's
width; a text keeps the darts that lie under its weights and whose rank is below a limit
that yields about k (ln k + 2) of them. A dart falls on one of k coordinates by its hash,
and the earliest dart of a coordinate is its value; two texts agree in a coordinate with the
probability of their weighted Jaccard similarity. A text with a coordinate left empty throws
again with twice the limit. The work per text is its size plus the number of darts.

Bands of coordinates are joined to find candidates, and each candidate is checked exactly.
Texts with equal weighted sets are one node. Every node is compared with the most central
node of each of its buckets, which joins most of a class in linear work. Where a bucket then holds several
classes, its members outside the central one are compared with all the others, block by block. So no
pair in one bucket and different classes is left out, and only edges between classes come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from twinsift.lineage import stage
from twinsift.llm.common import field, whole
from twinsift.llm.text_arrays import blocks, folded, mix64
from twinsift.operators.components import connected_components

WORDS = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 5

# Members of one bucket that are compared with each other in one task.
BLOCK_ROWS = 512

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD1B54A32D192ED03)
UNIT = 1.0 / (1 << 53)


# ---- weighted sets ------------------------------------------------------------------------


def weighted_shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count), sorted by text and shingle.

    Words are runs of letters, marks and digits in lower case. A text of fewer words than
    a shingle has one shingle of them all, a text without words has none.
    """
    codes, text = folded(texts, digits=True)
    inside = codes != 0
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.float64)
    at = np.flatnonzero(inside)
    word = np.cumsum(np.concatenate([[False], inside[:-1]]) < inside) - 1
    place = (at - starts[word[at]]).astype(np.uint64)
    letters = mix64(codes[at].astype(np.uint64) * GOLDEN + place * STEP)
    hashes = mix64(np.add.reduceat(letters, np.searchsorted(at, starts)))
    of = text[starts]
    first = np.searchsorted(of, np.arange(len(texts)))
    size = np.searchsorted(of, np.arange(len(texts)), side="right") - first
    many = np.flatnonzero(of[:len(of) - words + 1] == of[words - 1:]) if len(of) >= words else np.empty(0, np.int64)
    shingle = np.zeros(len(many), np.uint64)
    for i in range(words):
        shingle = mix64(shingle * STEP + hashes[many + i])
    few = np.flatnonzero((size > 0) & (size < words))
    short = np.zeros(len(few), np.uint64)
    for i in range(words - 1):
        more = size[few] > i
        short[more] = mix64(short[more] * STEP + hashes[first[few[more]] + i])
    owner = np.concatenate([of[many], few])
    value = np.concatenate([shingle, short])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])])
    heads = np.flatnonzero(new)
    return owner[heads], value[heads], np.diff(np.append(heads, len(owner))).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform numbers above 0 and below 1."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * UNIT


def dart_minhash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, sets: int, k: int) -> np.ndarray:
    """k values per weighted set; sets without weight get zeros. ``owner`` numbers the sets."""
    total = np.bincount(owner, weight, minlength=sets)
    found = np.zeros((sets, k), np.uint64)
    wanted = k * (np.log(k) + 2)
    open_sets = total > 0
    limit = np.divide(wanted, total, out=np.zeros(sets), where=open_sets)
    while open_sets.any():
        mine = open_sets[owner]
        keys, ranks, darts = [], [], []
        low, layer = 0.0, 0
        while True:
            rows = np.flatnonzero(mine & (weight > low))
            if not len(rows):
                break
            width = max(low, 1.0)
            seed = mix64(element[rows] + np.uint64(layer * int(GOLDEN) % 2**64))
            rank = np.zeros(len(rows))
            most, over, of = limit[owner[rows]], weight[rows], owner[rows]
            while len(seed):
                seed = mix64(seed + GOLDEN)
                rank = rank - np.log(_unit(seed)) / width
                keep = rank < most
                seed, rank, most, over, of = seed[keep], rank[keep], most[keep], over[keep], of[keep]
                dart = mix64(seed ^ STEP)
                hit = low + width * _unit(mix64(dart ^ GOLDEN)) < over
                keys.append(of[hit] * k + (dart[hit] % np.uint64(k)).astype(np.int64))
                ranks.append(rank[hit])
                darts.append(dart[hit])
            low, layer = low + width, layer + 1
        key, rank, dart = np.concatenate(keys), np.concatenate(ranks), np.concatenate(darts)
        order = np.lexsort((rank, key))
        key, dart = key[order], dart[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        filled = np.zeros(sets * k, bool)
        filled[key[first]] = True
        found.reshape(-1)[key[first]] = dart[first]
        open_sets = open_sets & ~filled.reshape(sets, k).all(axis=1)
        limit = limit * 2
    return found


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band and set."""
    keys = np.zeros((len(values), bands), np.uint64)
    for i in range(rows):
        keys = mix64(keys * STEP + values[:, i::rows][:, :bands] + GOLDEN)
    return keys


# ---- the jobs -----------------------------------------------------------------------------


def _signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, d1, d2, bands): the digest of the weighted set and its bands, null for texts without words."""
    source = docs.select(field(id_col).alias("id"), whole(text_col).alias("text"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for start, block in blocks(batch.column("text").to_pylist()):
                owner, value, count = weighted_shingles(block)
                one, two = np.zeros(len(block), np.uint64), np.zeros(len(block), np.uint64)
                whole_count = count.astype(np.uint64)
                np.add.at(one, owner, mix64(value ^ GOLDEN) * whole_count)
                np.add.at(two, owner, mix64(value + STEP) * whole_count)
                empty = np.bincount(owner, minlength=len(block)) == 0
                keys = band_keys(dart_minhash(owner, value, count, len(block), BANDS * ROWS), BANDS, ROWS)
                offsets = pa.array(np.arange(len(block) + 1, dtype=np.int32) * BANDS)
                bands = pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, len(block)), pa.array(one.view(np.int64), mask=empty),
                     pa.array(two.view(np.int64)), bands], names=["id", "d1", "d2", "bands"])

    schema = StructType([source.schema["id"], StructField("d1", LongType()), StructField("d2", LongType()),
                         StructField("bands", ArrayType(LongType()))])
    return source.mapInArrow(signed, schema)


def _similar(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts reach the threshold, by exact weighted Jaccard."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            keep = []
            for start, block in blocks([x + "\0" + y for x, y in zip(left, right)]):
                end = start + len(block)
                keep.append(jaccard(left[start:end], right[start:end]) >= threshold - 1e-12)
            mask = pa.array(np.concatenate(keep) if keep else np.zeros(0, bool))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return both.mapInArrow(checked, StructType([both.schema["a"], both.schema["b"]]))


def jaccard(left: list[str], right: list[str]) -> np.ndarray:
    """Weighted Jaccard similarity of texts in the same place of two lists; 0 where both lack words."""
    n = len(left)
    owner, value, count = weighted_shingles([*left, *right])
    side, pair = owner >= n, owner % n
    order = np.lexsort((side, value, pair))
    pair, value, side, count = pair[order], value[order], side[order], count[order]
    twin = np.flatnonzero((pair[1:] == pair[:-1]) & (value[1:] == value[:-1]))
    shared = np.bincount(pair[twin], np.minimum(count[twin], count[twin + 1]), minlength=n)
    union = np.bincount(pair, count, minlength=n) - shared
    return np.divide(shared, union, out=np.zeros(n), where=union > 0)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = SIMILARITY) -> DataFrame:
    """(id, class_id, kept): every row with the smallest id of its class of near duplicates.

    A class holds texts joined by a chain of pairs at or above the threshold. ``kept`` is true
    for the row with the smallest id of each class, and for rows that repeat it. Null text
    counts as empty; texts without words are near to nothing and stay as they are. A null id
    ranks after every other id. An empty table gives no rows.
    """
    signed = stage(_signatures(docs, id_col, text_col), "signatures")
    worded = signed.where("d1 is not null")
    nodes = stage(
        worded.groupBy("d1", "d2").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id")).alias("first"),
                                       F.first("bands").alias("bands"))
        .select(F.struct("first.no_id", "first.id", "d1", "d2").alias("node"), "bands"), "nodes")
    # A node is (no_id, id, d1, d2) and sorts by its smallest id, so the least node names the class.
    edges = _edges(nodes, docs, id_col, text_col, threshold)
    classes = connected_components(edges, "a", "b")
    return _members(signed, nodes, classes, id_col)


def _members(signed: DataFrame, nodes: DataFrame, classes: DataFrame, id_col: str) -> DataFrame:
    labelled = nodes.select("node").join(classes.withColumnRenamed("id", "node"), "node", "left").select(
        "node", F.coalesce("cluster_id", "node").alias("top"))
    # One row per distinct content; the node's own digest is the key of its rows.
    by_content = labelled.select(
        F.col("node.d1").alias("d1"), F.col("node.d2").alias("d2"), F.col("top.id").alias("class_id"),
        (F.col("top") == F.col("node")).alias("is_top"), F.col("node.id").alias("first_id"))
    worded = signed.where("d1 is not null").select("id", "d1", "d2").join(by_content, ["d1", "d2"])
    return worded.select(
        F.col("id").alias(id_col), "class_id",
        (F.col("is_top") & F.col("id").eqNullSafe(F.col("first_id"))).alias("kept"),
    ).unionByName(signed.where("d1 is null").select(
        F.col("id").alias(id_col), F.col("id").alias("class_id"), F.lit(True).alias("kept")))


def _edges(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """Verified edges that connect every class."""
    placed = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    sizes = placed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = stage(placed.join(sizes, ["band", "key"]), "buckets")
    # The more nodes share its buckets, the more central a node is.
    central = buckets.groupBy("node").agg(F.sum("size").alias("centre"))
    ranked = stage(buckets.join(central, "node"), "ranked-buckets")
    hubs = ranked.groupBy("band", "key").agg(
        F.min(F.struct((-F.col("centre")).alias("centre"), "node")).getField("node").alias("hub"))
    star = stage(
        ranked.select("band", "key", "node").join(hubs, ["band", "key"]).where(F.col("node") != F.col("hub"))
        .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "star-pairs")

    # One text per node that is in any shared bucket.
    firsts = central.select("node", F.col("node.id").alias("id"))
    source = docs.select(field(id_col).alias("doc"), whole(text_col).alias("text"))
    held = firsts.join(source, F.col("id").eqNullSafe(F.col("doc"))).select("node", "text")
    texts = stage(_of_content(held), "node-texts")

    near = stage(_similar(star, texts, threshold), "near-pairs")
    classes = connected_components(near, "a", "b").withColumnRenamed("id", "node")
    split = ranked.select("band", "key", "size", "node").join(classes, "node", "left").join(
        hubs, ["band", "key"]).withColumn("class", F.coalesce("cluster_id", "node"))
    return near.unionByName(stage(_late_edges(split, texts, threshold), "late-pairs"))


def _late_edges(split: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Edges between classes that share a bucket, one per member and class it meets.

    Members outside the class of their bucket's hub are compared with all members of the bucket,
    chunk by chunk and each with a whole chunk at once, so that no list of pairs is made.
    """
    hub_class = split.where(F.col("node") == F.col("hub")).select("band", "key", F.col("class").alias("hub_class"))
    members = split.join(hub_class, ["band", "key"]).withColumn("stray", F.col("class") != F.col("hub_class"))
    # With two members both have met; with one class there is nothing to join.
    chunks = lambda n: F.ceil(n / F.lit(BLOCK_ROWS)).cast("int")
    open_buckets = members.where("size > 2").groupBy("band", "key").agg(
        chunks(F.count_if("stray")).alias("xs"), chunks(F.count(F.lit(1))).alias("ys")).where("xs > 0")
    met = members.join(open_buckets, ["band", "key"]).join(texts, "node").select(
        "band", "key", "xs", "ys", "stray", "node", F.xxhash64("class").alias("class"), "text",
        F.pmod(F.xxhash64("node"), F.col("xs").cast("bigint")).cast("int").alias("x"),
        F.pmod(F.xxhash64("node"), F.col("ys").cast("bigint")).cast("int").alias("y"))
    met = stage(met, "open-buckets")
    columns = ["band", "key", "x", "y", "side", "node", "class", "text"]
    strays = met.where("stray").drop("y").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("ys") - 1)))
    others = met.drop("x").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)))
    tasks = strays.withColumn("side", F.lit(0)).select(*columns).unionByName(
        others.withColumn("side", F.lit(1)).select(*columns))

    def block(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        left, right = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        one, two = edges_between(
            left.column("text").to_pylist(), left.column("class").to_numpy(),
            right.column("text").to_pylist(), right.column("class").to_numpy(), threshold)
        return pa.table({"a": left.column("node").take(pa.array(one)), "b": right.column("node").take(pa.array(two))})

    kind = met.schema["node"].dataType
    found = tasks.groupBy("band", "key", "x", "y").applyInArrow(
        block, StructType([StructField("a", kind), StructField("b", kind)]))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def edges_between(left: list[str], left_class: np.ndarray, right: list[str], right_class: np.ndarray,
                  threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): similar texts that connect all classes with similar texts, fewer than classes."""
    left_class, right_class = left_class.copy(), right_class.copy()
    owner, value, count = weighted_shingles([*left, *right])
    n = len(left)
    total = np.bincount(owner, count, minlength=n + len(right))
    first = np.searchsorted(owner, np.arange(n + 1))
    at = np.flatnonzero(owner >= n)
    order = at[np.argsort(value[at], kind="stable")]
    listed, holder, held = value[order], owner[order] - n, count[order]
    one, two = [], []
    for i in range(n):
        mine, mine_count = value[first[i]:first[i + 1]], count[first[i]:first[i + 1]]
        low = np.searchsorted(listed, mine)
        size = np.searchsorted(listed, mine, side="right") - low
        places = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        shared = np.bincount(holder[places], np.minimum(held[places], np.repeat(mine_count, size)), minlength=len(right))
        union = total[i] + total[n:] - shared
        near = np.flatnonzero((shared >= (threshold - 1e-12) * union) & (shared > 0) & (right_class != left_class[i]))
        if len(near):
            joined, pick = np.unique(right_class[near], return_index=True)
            two.append(near[pick])
            one.append(np.full(len(pick), i))
            for classes in (left_class, right_class):
                classes[np.isin(classes, joined)] = left_class[i]
    empty = np.empty(0, np.int64)
    return (np.concatenate(one), np.concatenate(two)) if one else (empty, empty)


def _of_content(held: DataFrame) -> DataFrame:
    """Of texts found by id, those whose weighted set is the node's; one per node."""
    def matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column("node").flatten()[2].to_numpy(zero_copy_only=False)
            keep = []
            for start, block in blocks(batch.column("text").to_pylist()):
                owner, value, count = weighted_shingles(block)
                one = np.zeros(len(block), np.uint64)
                np.add.at(one, owner, mix64(value ^ GOLDEN) * count.astype(np.uint64))
                keep.append(one.view(np.int64) == want[start:start + len(block)])
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return held.mapInArrow(matching, held.schema).dropDuplicates(["node"])


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         threshold: float = SIMILARITY) -> DataFrame:
    """The row with the smallest id of each class, with its own columns; rows of one id stay together."""
    classes = near_duplicates(docs, id_col, text_col, threshold)
    kept = classes.where("kept").select(field(id_col).alias("_twinsift_kept")).distinct()
    return docs.join(kept, field(id_col).eqNullSafe(F.col("_twinsift_kept")), "left_semi")
