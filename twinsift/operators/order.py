"""Positions and running totals in a global order, without one task holding all rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from twinsift.lineage import stage


def running_totals(df: DataFrame, order: list[str | Column], totals: dict[str, str | Column],
                   within: list[str] | None = None) -> DataFrame:
    """Add, for every row, the sum of each value over the rows before it.

    ``totals`` maps new column names to values; ``within`` restarts the sums per group.
    Rows are range partitioned on (within, order), so even a single huge group is spread
    over many tasks. Each range is summed by itself; the sums of earlier ranges are added
    from a table with one row per (range, group). The ranges are stored before they are
    read twice, since a second sampling could cut them elsewhere. ``order`` must be unique.
    """
    within = within or []
    keys = [F.col(c) for c in within] + [c if isinstance(c, Column) else F.col(c) for c in order]
    values = {name: (v if isinstance(v, Column) else F.col(v)) for name, v in totals.items()}
    ranged = stage(
        df.withColumns({f"_value_{n}": v for n, v in values.items()})
        .withColumns({f"_key_{i}": k for i, k in enumerate(keys)})
        .repartitionByRange(*[F.col(f"_key_{i}") for i in range(len(keys))])
        .withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    key_names = [f"_key_{i}" for i in range(len(keys))]
    by_range = ["_range", *within]
    local = Window.partitionBy(*by_range).orderBy(*key_names).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range and group: bounded by the number of ranges, not of rows.
    earlier = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*by_range)
        .agg(*[F.sum(f"_value_{n}").alias(f"_sum_{n}") for n in values])
        .select(*by_range, *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}")
                             for n in values])
    )
    summed = ranged.withColumns(
        {f"_local_{n}": F.coalesce(F.sum(f"_value_{n}").over(local), F.lit(0)) for n in values})
    return (
        summed.join(offsets, by_range)
        .withColumns({n: F.col(f"_before_{n}") + F.col(f"_local_{n}") for n in values})
        .select(*df.columns, *values)
    )


def with_position(df: DataFrame, order: list[str | Column], name: str = "position",
                  within: list[str] | None = None) -> DataFrame:
    """0-based position of every row in the given (unique) order."""
    if within:
        return running_totals(df, order, {name: F.lit(1).cast("bigint")}, within)
    keys = [c if isinstance(c, Column) else F.col(c) for c in order]
    # A row's number within its range is stored with it, so that rows are shuffled once.
    ranged = stage(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_range", F.spark_partition_id())
        .mapInArrow(_numbered, StructType([*df.schema, StructField("_range", IntegerType()), StructField("_row", LongType())])),
        "ranges")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    offsets = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(offsets), "_range").select(
        *df.columns, (F.col("_before") + F.col("_row")).alias(name))


def _numbered(batches):
    start = 0
    for batch in batches:
        yield batch.append_column("_row", pa.array(np.arange(start, start + batch.num_rows)))
        start += batch.num_rows


@dataclass(frozen=True)
class Cut:
    """Where the first rows of an order end: those before, those equal to the row at the end, and how many of these belong."""

    before: Column
    equal: Column
    tied: int


def cut_after(keys: DataFrame, order: list[str | Column], rows: int) -> Cut:
    """The end of the first ``rows`` rows in the given order, found key by key by counting; nothing is sorted.

    ``keys`` is read several times and should be a stored table. A key with many values should follow a coarser one.
    """
    columns = [c if isinstance(c, Column) else F.col(c) for c in order]
    rest, left, end, equal = keys, rows, [], F.lit(True)
    for column in columns:
        counted = rest.groupBy(column.alias("key")).agg(F.count(F.lit(1)).alias("rows"))
        at = (running_totals(counted, ["key"], {"before": "rows"})
              .where((F.col("before") <= left) & (F.col("before") + F.col("rows") > left)).first())
        if at is None:
            return Cut(F.lit(True), F.lit(False), 0)
        end.append(F.lit(at["key"]).cast(counted.schema["key"].dataType))
        left -= at["before"]
        here = column.eqNullSafe(end[-1])
        rest, equal = rest.where(here), equal & here
    return Cut(F.struct(*columns) < F.struct(*end), equal, left)


def among_first(df: DataFrame, cuts: list[tuple[Column, Cut]], name: str) -> DataFrame:
    """Add whether a row is before the cut of its group; ``cuts`` pairs the condition of each group with its cut.

    Of rows equal to the one at the cut any may be among the first, as many as fit.
    """
    before = F.lit(False)
    for group, cut in cuts:
        before = before | (group & cut.before)
    marked = df.withColumn(name, before)
    for group, cut in cuts:
        if cut.tied:
            at_end = F.coalesce(group & cut.equal, F.lit(False))
            numbered = marked.where(at_end).withColumn(
                "_tied", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.lit(1))))
            marked = marked.where(~at_end).unionByName(
                numbered.withColumn(name, F.col("_tied") <= cut.tied).drop("_tied"))
    return marked
