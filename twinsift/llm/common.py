"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def field(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(text: str | Column) -> Column:
    """The text, null as the empty text."""
    return F.coalesce(field(text) if isinstance(text, str) else text, F.lit(""))


def splitters(keys: DataFrame, ranges: int) -> list:
    """Lower bounds of up to ``ranges`` even ranges of the only column, without the first.

    Spark samples the keys to cut the ranges; at most ``ranges`` values reach the driver.
    """
    name = keys.columns[0]
    cut = (keys.repartitionByRange(ranges, name).groupBy(F.spark_partition_id().alias("range"))
           .agg(F.min(name).alias("low")))
    lows = sorted({row["low"] for row in cut.collect() if row["low"] is not None})
    return lows[1:]


def constant(values: list, kind: str) -> Column:
    """Numbers or texts as one constant of the plan, however many they are; ``kind`` takes the type of a value."""
    some = values[0][0] if isinstance(values[0], list) else values[0]
    return F.from_json(F.lit(json.dumps(values)), kind.format("string" if isinstance(some, str) else "bigint"))


def range_of(key: Column, lows: list) -> Column:
    """The number of lower bounds at or below the key; null keys are in range 0.

    The bounds are looked up in two levels, so a row costs about twice the square root
    of their number.
    """
    if not lows:
        return F.lit(0)
    step = max(1, round(len(lows) ** 0.5))
    groups = [lows[i:i + step] for i in range(0, len(lows), step)]
    first = constant([g[0] for g in groups], "array<{}>")
    fine = constant(groups, "array<array<{}>>")
    at = F.size(F.filter(first, lambda low: low <= key))
    inside = F.size(F.filter(F.get(fine, at - 1), lambda low: low <= key))
    return F.when(key.isNull() | (at == 0), 0).otherwise((at - 1) * step + inside)
