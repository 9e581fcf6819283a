"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one bucket that are paired with each other inside one join key.
CHUNK_ROWS = 1_000


def lookup(big: DataFrame, small: DataFrame, key: str | list[str], rows: str, total: int | None = None,
           hot_rows: int | None = None, how: str = "inner") -> DataFrame:
    """Join of ``big`` with ``small``, which has one row per key and should be a stored table.

    Inner, or ``how="left"`` to keep the rows of ``big`` without a partner.

    ``rows`` is the column of ``small`` that tells how many rows ``big`` has for the
    key; it stays in the result. A key with more rows than an even share of a partition
    (``hot_rows`` if given) is dealt to several join keys: its row of ``small`` is repeated once per
    share, and rows of ``big`` are salted. Fewer keys than partitions can be above an even
    share, so the broadcast of their keys and shares, without payload, is bounded.
    ``total`` is the row count of ``big`` if known.
    """
    keys = [key] if isinstance(key, str) else key
    if hot_rows is None:
        if total is None:
            total = small.agg(F.sum(rows)).first()[0] or 0
        parts = int(small.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        hot_rows = max(CHUNK_ROWS, -(-total // parts))
    shared = small.withColumn("_shares", chunk_count(F.col(rows), hot_rows))
    hot = F.broadcast(shared.where("_shares > 1").select(*keys, "_shares"))
    salt = F.pmod(F.xxhash64(*big.columns), F.coalesce("_shares", F.lit(1)).cast("bigint"))
    salted = big.join(hot, keys, "left").withColumn("_salt", salt.cast("int")).drop("_shares")
    repeated = shared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def chunk_count(rows: Column, chunk_rows: int) -> Column:
    return F.ceil(rows / F.lit(chunk_rows)).cast("int")


def chunk_of(member: Column, chunks: Column) -> Column:
    return F.pmod(F.xxhash64(member), chunks.cast("bigint")).cast("int")


def pairs_in_buckets(rows: DataFrame, bucket: str, member: str, size: str, keep,
                     carry: tuple[str, ...] = (), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(bucket, member1 < member2, carried columns of both) of rows that share a bucket.

    ``size`` is the number of rows of the bucket. A bucket is cut into chunks and each
    pair of chunks is its own join key, so a key never sees more than about
    ``chunk_rows`` squared combinations however large the bucket is. ``keep(a, b)``
    receives accessors for the columns of both sides and drops pairs inside the join.
    """
    chunks = chunk_count(F.col(size), chunk_rows)
    rows = rows.withColumn("_last", chunks - 1).withColumn("_chunk", chunk_of(F.col(member), chunks))
    left = rows.withColumn("_lo", F.col("_chunk")).withColumn(
        "_hi", F.explode(F.sequence("_chunk", "_last"))).alias("a")
    right = rows.withColumn("_hi", F.col("_chunk")).withColumn(
        "_lo", F.explode(F.sequence(F.lit(0), "_chunk"))).alias("b")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    same_key = (a(bucket) == b(bucket)) & (a("_lo") == b("_lo")) & (a("_hi") == b("_hi"))
    once = (a("_lo") < a("_hi")) | (a(member) < b(member))
    ordered = a(member) < b(member)
    sides = [F.when(ordered, one(c)).otherwise(two(c)).alias(f"{c}{n}")
             for c in (member, *carry) for n, one, two in ((1, a, b), (2, b, a))]
    return left.join(right, same_key & once & keep(a, b)).select(a(bucket).alias(bucket), *sides)
