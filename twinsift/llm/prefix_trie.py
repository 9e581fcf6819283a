"""The trie of all conversation prefixes, by ROLLUP over positional turn columns.

Every turn becomes an id, a digest of role and text, and a conversation a row of turn ids, eight to
a row (a column block). One ROLLUP over the positional columns aggregates the prefixes of all
lengths together, and grouping_id tells the length. A longer conversation continues in further blocks,
each keyed by the node where the block before it ends. That key is a digest of the whole prefix, put
together from digests over runs of 1, 2, 4, ... blocks, so the keys of all blocks are known after a number
of rounds that grows with the logarithm of the longest conversation, and no task walks along one.

Sums over subtrees take a second ROLLUP, over the nodes. What hangs below a block is added to its
last node first; these totals of blocks are summed upwards by pointer doubling, again in a
logarithmic number of rounds.

Edge cases. Null role or text counts as empty. Turns are ordered by number, null first; turns with the
same number by the digest of role and text, so that repeated rows are turns of their own and the
result does not depend on the order of rows. Rows without a conversation id belong to no conversation
and are left out. Texts of any length are hashed where they are read. An empty table gives
no nodes. Columns of any other name may be there.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from twinsift.lineage import stage
from twinsift.llm.common import field, whole
from twinsift.operators.order import with_position
from twinsift.operators.skew import lookup

WIDTH = 8
ROOT = "root"
# Member ids that are joined to one piece of text before they are hashed.
PIECE_IDS = 4_096

SLOTS = [f"t{i}" for i in range(1, WIDTH + 1)]


def _digest(*parts: Column | str) -> Column:
    """32 hex digits of SHA-256 over the parts, separated by spaces; null parts are skipped."""
    return F.left(F.sha2(F.concat_ws(" ", *parts), 256), F.lit(32))


def turn_ids(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """(conv, position, turn): the turns of each conversation in order, by the id of role and text.

    An id is a digest and, behind a dot, the number of code points of the text.
    """
    role, text = whole(role_col), whole(text_col)
    digest = F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(32))
    ids = turns.where(field(conv_col).isNotNull()).select(
        field(conv_col).alias("conv"), field(turn_col).alias("number"),
        F.concat(digest, F.lit("."), F.length(text).cast("string")).alias("turn"),
        F.monotonically_increasing_id().alias("row"))
    placed = with_position(stage(ids, "turn-ids"), ["number", "turn", "row"], within=["conv"])
    return stage(placed.select("conv", "position", "turn"), "turns")


def with_shared_heads(turns: DataFrame, base: Column, length: Column, longest: int) -> tuple[DataFrame, DataFrame]:
    """Replace the first turns of each conversation by those of another: (turns, conversations).

    ``base`` is the conversation whose first ``length`` turns (at most ``longest``; all if it has fewer,
    none if it is absent) are put in front of the own turns after the first ``length``; both are expressions
    of ``conv``. The results are what ``prefix_trie`` takes.
    """
    first = turns.where(F.col("position") < longest).join(
        turns.select(base.alias("conv")).distinct(), "conv", "left_semi")
    heads = first.groupBy(F.col("conv").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("position", "turn"))).alias("head"))
    conversations = stage(
        turns.groupBy("conv").agg(F.count(F.lit(1)).alias("rows"))
        .withColumns({"base": base, "cut": length}).join(heads, "base", "left")
        .withColumn("head", F.slice(F.coalesce(F.col("head.turn"), F.array().cast("array<string>")), F.lit(1), F.col("cut")))
        .select("conv", "rows", "cut", "head", (F.size("head") + F.greatest(F.col("rows") - F.col("cut"), F.lit(0)))
                .cast("bigint").alias("n_turns")), "conversations")
    own = lookup(turns, conversations.select("conv", "rows", "cut", F.size("head").alias("shared"), "n_turns"),
                 "conv", "rows").where("position >= cut").select(
        "conv", (F.col("position") - F.col("cut") + F.col("shared")).alias("position"), "turn", "n_turns")
    shared = conversations.select("conv", F.posexplode("head").alias("position", "turn"), "n_turns").select(
        "conv", F.col("position").cast("bigint").alias("position"), "turn", "n_turns")
    return shared.unionByName(own), conversations.select("conv", "n_turns")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) for ``prefix_trie``, without any change."""
    conversations = stage(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n_turns")), "conversations")
    return lookup(turns, conversations, "conv", "n_turns"), conversations


# ---- column blocks and their keys ---------------------------------------------------------


def _blocks(turns: DataFrame) -> DataFrame:
    """(conv, block, t1..t8, filled, n_turns): eight turns a row."""
    slot = F.col("position") % WIDTH
    return stage(
        turns.withColumn("block", F.expr(f"position div {WIDTH}"))
        .groupBy("conv", "block")
        .agg(*[F.max(F.when(slot == i, F.col("turn"))).alias(name) for i, name in enumerate(SLOTS)],
             F.count(F.lit(1)).alias("filled"), F.max("n_turns").alias("n_turns")), "blocks")


def _prefix_keys(blocks: DataFrame) -> DataFrame:
    """(conv, block, key): a digest of all turns before the block, for every block behind a full one."""
    full = blocks.where(F.col("filled") == WIDTH)
    level = stage(full.select("conv", F.col("block").alias("index"), _digest(*SLOTS).alias("digest"),
                              F.lit(0).alias("level")), "runs")
    runs, height = level, 0
    while level.where("index > 0").limit(1).count():
        height += 1
        level = stage(
            level.groupBy("conv", F.expr("index div 2").alias("index"))
            .agg(F.sort_array(F.collect_list(F.struct("index", "digest"))).alias("pair"))
            .where(F.size("pair") == 2)
            .select("conv", "index", F.left(F.sha2(F.array_join("pair.digest", " "), 256), F.lit(32)).alias("digest"),
                    F.lit(height).alias("level")), "runs")
        runs = runs.unionByName(level)
    # Block j starts behind the runs that the binary digits of j name, the longest one first.
    bits = F.filter(F.sequence(F.lit(0), F.lit(height)), lambda b: F.expr("block").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), b)) != 0)
    wanted = full.select("conv", (F.col("block") + 1).alias("block")).withColumn("level", F.explode(bits)).withColumn(
        "index", F.call_function("shiftright", F.col("block"), F.col("level") + 1) * 2)
    uses = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("level")).alias("uses")
    found = lookup(wanted, runs.select("conv", "level", "index", "digest", uses), ["conv", "level", "index"], "uses")
    return stage(
        found.groupBy("conv", "block").agg(F.sort_array(F.collect_list(F.struct("level", "digest")), asc=False).alias("runs"))
        .select("conv", "block", _digest(F.col("block").cast("string"), F.array_join("runs.digest", " ")).alias("key")),
        "prefix-keys")


def _keyed_blocks(blocks: DataFrame, keys: DataFrame) -> DataFrame:
    """Blocks with ``home``, the node they start from; the last id of a full block names its prefix in full."""
    ahead = keys.select("conv", (F.col("block") - 1).alias("block"), F.col("key").alias("next"))
    size = F.substring_index(SLOTS[-1], ".", -1)
    return stage(
        blocks.join(keys, ["conv", "block"], "left").join(ahead, ["conv", "block"], "left")
        .withColumns({"home": F.coalesce("key", F.lit(ROOT)),
                      SLOTS[-1]: F.when(F.col(SLOTS[-1]).isNotNull(), F.concat("next", F.lit("."), size))})
        .drop("key", "next"), "keyed-blocks")


def _node_key() -> Column:
    """The node at the end of a row of turn columns, of which the last ones may be null."""
    return F.when(F.col(SLOTS[-1]).isNotNull(), F.substring_index(SLOTS[-1], ".", 1)).otherwise(_digest("home", *SLOTS))


def _rollup(rows: DataFrame, *aggregates: Column) -> DataFrame:
    """The aggregates per prefix of the turn columns, for the prefixes that end in a turn."""
    grouped = rows.rollup("home", *SLOTS).agg(F.grouping_id().alias("_gid"), *aggregates)
    inside = grouped.withColumn("inside", F.lit(WIDTH) - F.bit_count("_gid")).where("inside between 1 and 8").drop("_gid")
    return inside.withColumn("last", F.get(F.array(*SLOTS), F.col("inside") - 1)).where("last is not null")


# ---- the trie -----------------------------------------------------------------------------


def _nodes(blocks: DataFrame, conversations: DataFrame) -> DataFrame:
    """(key, parent, depth, conv_id, n_convs, saved, home, t1..t8), the root with null columns."""
    found = _rollup(blocks, F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("block").alias("block"))
    before = F.concat(F.array("home"), F.slice(F.array(*SLOTS), F.lit(1), F.col("inside") - 1))
    size = F.substring_index("last", ".", -1).cast("bigint")
    nodes = found.select(
        _node_key().alias("key"), F.when(F.col("inside") == 1, F.col("home")).otherwise(_digest(before)).alias("parent"),
        (F.col("block") * WIDTH + F.col("inside")).cast("bigint").alias("depth"), "conv_id", "n_convs",
        ((F.col("n_convs") - 1) * size).alias("saved"), "home", *SLOTS)
    root = conversations.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    empty = [F.lit(None).cast("string").alias(c) for c in ("home", *SLOTS)]
    root = root.select(F.lit(ROOT).alias("key"), F.lit(None).cast("string").alias("parent"),
                       F.lit(0).cast("bigint").alias("depth"), "conv_id", "n_convs",
                       F.lit(0).cast("bigint").alias("saved"), *empty)
    nodes = stage(nodes.unionByName(root), "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(
        F.count(F.lit(1)).alias("n_children"))
    return stage(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))),
                 "counted-nodes")


def _block_totals(nodes: DataFrame) -> DataFrame:
    """(home, leaves, saved): the sums over all nodes below ``home``, in its own and all later blocks."""
    leaf = (F.col("n_children") == 0).cast("bigint")
    own = nodes.where("home is not null").groupBy("home").agg(F.sum(leaf).alias("leaves"), F.sum("saved").alias("saved"))
    up = nodes.where(f"{SLOTS[-1]} is not null and n_children > 0").select(F.col("key").alias("home"), F.col("home").alias("up"))
    totals = stage(own.join(up, "home", "left"), "block-totals")
    while totals.where("up is not null").limit(1).count():
        below = totals.where("up is not null").groupBy(F.col("up").alias("home")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count(F.lit(1)).alias("uses"))
        summed = stage(
            totals.join(below, "home", "left").select(
                "home", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), "up", "uses"), "block-sums")
        # A pointer moves to where the block it points to points.
        targets = summed.where("uses > 0").select(F.col("home").alias("up"), F.col("up").alias("next"), "uses")
        moved = lookup(summed.where("up is not null").drop("uses"), targets, "up", "uses")
        totals = stage(
            moved.select("home", "leaves", "saved", F.col("next").alias("up"))
            .unionByName(summed.where("up is null").select("home", "leaves", "saved", "up")), "block-totals")
    return totals.drop("up")


def _subtrees(nodes: DataFrame, totals: DataFrame) -> DataFrame:
    """(key, n_leaves, saved_tokens) for every node."""
    below = totals.select(F.col("home").alias("key"), F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
    leaf = (F.col("n_children") == 0).cast("bigint")
    whole_nodes = nodes.where("home is not null").join(below, "key", "left").select(
        "home", *SLOTS, (leaf + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
        (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
    sums = _rollup(whole_nodes, F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")).select(
        _node_key().alias("key"), "n_leaves", "saved_tokens")
    top = totals.where(F.col("home") == ROOT).select(
        F.lit(ROOT).alias("key"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    return sums.unionByName(top)


def _ends_hash(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the member ids in ascending order, joined by commas.

    Ids are put in order and joined to pieces in many tasks; only the pieces of a node
    pass through one, since a hash has an order.
    """
    placed = with_position(ends, ["conv"], within=["key"])
    pieces = placed.groupBy("key", F.expr(f"position div {PIECE_IDS}").alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def hashed(batches):
        key, state = None, None
        for batch in batches:
            done = []
            for this, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if this == key:
                    state.update(b",")
                else:
                    done.append((key, state))
                    key, state = this, hashlib.sha256()
                state.update(ids.encode())
            yield _hash_rows(done)
        yield _hash_rows([(key, state)])

    schema = StructType([StructField("key", StringType()), StructField("ends_sha256", StringType())])
    return pieces.repartition("key").sortWithinPartitions("key", "piece").select("key", "ids").mapInArrow(hashed, schema)


def _hash_rows(done: list[tuple]) -> pa.RecordBatch:
    done = [(key, state.hexdigest()) for key, state in done if state is not None]
    columns = [pa.array([row[i] for row in done], pa.string()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, ["key", "ends_sha256"])


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``turns`` has (conv, position, turn, n_turns) and ``conversations`` (conv, n_turns), one row each, also
    for conversations without turns. ``conv_id`` is the smallest member, ``saved_tokens`` the code points that
    a cache of shared prefixes need not read again below the node.
    """
    blocks = _blocks(turns)
    blocks = _keyed_blocks(blocks, _prefix_keys(blocks))
    nodes = _nodes(blocks, conversations)
    subtrees = _subtrees(nodes, _block_totals(nodes))
    last = F.col("block") == F.expr(f"(n_turns - 1) div {WIDTH}")
    ends = blocks.where(last).select(_node_key().alias("key"), "conv").unionByName(
        conversations.where("n_turns = 0").select(F.lit(ROOT).alias("key"), "conv"))
    parents = nodes.where("n_children > 0").select(
        F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("uses"))
    plain = nodes.select("key", "parent", "conv_id", "depth", "n_convs", "n_children")
    linked = lookup(plain.where("parent is not null"), parents, "parent", "uses").drop("uses").unionByName(
        plain.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast(nodes.schema["conv_id"].dataType)))
    nobody = hashlib.sha256(b"").hexdigest()
    return (
        linked.join(subtrees, "key", "left").join(_ends_hash(ends), "key", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                F.coalesce("n_leaves", F.lit(1).cast("bigint")).alias("n_leaves"),
                F.coalesce("saved_tokens", F.lit(0).cast("bigint")).alias("saved_tokens"),
                F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256")))
