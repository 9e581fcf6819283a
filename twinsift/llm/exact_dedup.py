"""Exact duplicates by sorting contents [DataFrame functions only].

Texts are equal when they agree in every byte after white space is deleted. Rows go to ranges by sampled
splitters of a key (first characters, SHA-256, salt). Each range is sorted by its normalised texts (spilling to
disk as needed), which places equal ones next to each other, and every row is compared in full
with the row before it: where they differ, a new run begins. Of equal texts the one with the most code
points before normalisation stays, then the smallest id.

A content with more rows than an even share of a partition is counted beforehand, dealt
to several ranges by a salt, and its decision is taken from the count: at most as
many contents as partitions can be that frequent, so their broadcast is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.lineage import stage
from twinsift.llm.common import field, partitions, range_of, splitters, whole

# The white space that normalisation deletes, [\x20\x09-\x0D].
WHITE_SPACE = (" ", "\n", "\t", "\r", "\x0b", "\x0c")

PREFIX = 24
RANGES_PER_PARTITION = 4


def normalised(text: Column) -> Column:
    for space in WHITE_SPACE:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    return (
        docs.select(field(id_col).alias("id"), whole(text_col).alias("text"),
                    F.struct(*[field(c) for c in carry]).alias("row") if carry else F.lit(None).alias("row"))
        .select("id", "row", F.length("text").alias("n"), normalised(F.col("text")).alias("norm"))
        .withColumn("sha", F.sha2("norm", 256))
        .withColumn("key", F.concat(F.left("norm", F.lit(PREFIX)), "sha"))
    )


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 carry: list[str] = ()) -> DataFrame:
    """(id, row, sha, keep_id, group_size, kept), one row per input row.

    ``row`` holds the columns named in ``carry``. ``kept`` is true for exactly one row of
    each group, also where whole rows repeat. Null text counts as empty, and all empty texts
    are one group. A null id ranks after every other id. An empty table gives no rows.
    Other columns may have any name: they are read only as fields of ``row``.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    keys = stage(_keyed(docs, id_col, text_col, []).select("id", "n", "sha", "key"), "content-keys")
    total = keys.count()
    share = max(1, total // parts)

    # Frequent contents with their decision: fewer than one per partition.
    best = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("no_id"), "id")
    counted = keys.groupBy("sha").agg(F.count(F.lit(1)).alias("hot_size")).where(F.col("hot_size") > share)
    hot = stage(
        keys.join(F.broadcast(counted), "sha").groupBy("sha")
        .agg(F.first("hot_size").alias("hot_size"), F.min(best).alias("hot_best"))
        .withColumn("hot_parts", F.ceil(F.col("hot_size") / F.lit(share)).cast("int")), "content-hot")

    def salted(rows: DataFrame) -> DataFrame:
        salt = F.coalesce(F.pmod(F.xxhash64("id", "n"), F.col("hot_parts").cast("bigint")), F.lit(0))
        return rows.join(F.broadcast(hot), "sha", "left").withColumn(
            "key", F.concat("key", F.lpad(salt.cast("string"), 10, "0")))

    lows = splitters(salted(keys).select("key"), RANGES_PER_PARTITION * parts)
    rows = salted(_keyed(docs, id_col, text_col, list(carry))).withColumn("range", range_of(F.col("key"), lows))
    in_order = Window.partitionBy("range").orderBy("norm", F.desc("n"), F.asc_nulls_last("id"))
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    compared = rows.withColumn("first", ~F.lag("norm").over(in_order).eqNullSafe(F.col("norm")))
    numbered = compared.select(
        "id", "row", "sha", "n", "hot_size", "hot_best", "range", "first",
        F.sum(F.col("first").cast("bigint")).over(so_far).alias("run"),
        F.last(F.when(F.col("first"), F.struct("id")), ignorenulls=True).over(so_far).alias("head"))
    # Rows are dealt by range already, so the sizes of the runs need no further shuffle.
    run = numbered.withColumn("run_size", F.count(F.lit(1)).over(Window.partitionBy("range", "run")))
    own = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("no_id"), "id")
    first = F.col("first")
    return run.select(
        "id", "row", "sha",
        F.when(F.col("hot_size").isNull(), F.col("head.id")).otherwise(F.col("hot_best.id")).alias("keep_id"),
        F.coalesce("hot_size", "run_size").alias("group_size"),
        F.when(F.col("hot_size").isNull(), first).otherwise(first & own.eqNullSafe(F.col("hot_best"))).alias("kept"))


def duplicate_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row."""
    return content_sort(docs, id_col, text_col).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their own columns."""
    kept = content_sort(docs, id_col, text_col, docs.columns).where("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
