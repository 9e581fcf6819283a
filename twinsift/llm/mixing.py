"""Mixing sources to target weights.

Targets: sources in code point order (null last) carry the weights in turn and share a
budget; a source stops at a cap and the excess is reshared by weight until none is above.
Selection (Efraimidis and Spirakis, 2006): a document with quality weight w draws the key
-ln(u) / w, with u from a hash of seed and id, so reruns agree. A source whose target covers
it takes every document once per complete epoch; the rest of the target is filled in key
order, by prefix sums of sizes. Prefix sums run over ranges, so a source may hold any share
of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.lineage import stage
from twinsift.llm.common import field, whole
from twinsift.operators.order import running_totals, with_position

# Weights by position of the source, share of all sizes, cap by source.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0

SEED = 20_231
UNKNOWN_QUALITY = 1.0


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^ \t-\r]+")).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sorted by cap per weight, sources are capped up to the point where what is left of the
    budget, dealt by weight, reaches no further cap; that is where resharing ends.
    """
    totals = stage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source-totals")
    budget = share * (totals.agg(F.sum("source_size")).first()[0] or 0)
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    weighted = with_position(
        totals.withColumn("no_source", F.col("source").isNull()), [F.col("no_source"), F.col("source")])
    capped = weighted.select(
        "source", "source_size", F.get(wheel, F.pmod("position", F.lit(len(weights))).cast("int")).alias("weight"),
        (F.col("source_size") * most).alias("cap"))
    reach = stage(capped.withColumn("level", F.col("cap") / F.col("weight")), "source-caps")
    before = stage(running_totals(
        reach.withColumn("no_source", F.col("source").isNull()),
        [F.col("level"), F.col("no_source"), F.col("source")],
        {"cap_before": F.col("cap"), "weight_before": F.col("weight")}), "source-levels")
    all_weight = before.agg(F.sum("weight")).first()[0] or 1.0
    level = (F.lit(budget) - F.col("cap_before")) / (F.lit(all_weight) - F.col("weight_before"))
    # The first source not capped fixes the level; all later ones share it.
    open_level = before.where(level < F.col("level")).agg(F.min(F.struct("level", "cap_before", level.alias("water")))).first()[0]
    water = open_level["water"] if open_level else None
    target = F.col("cap") if water is None else F.least(F.col("cap"), F.col("weight") * F.lit(water))
    return before.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", seed: int = SEED) -> DataFrame:
    """(id, source, text_hash, size, source_size, target, taken, times), one row per row of ``docs``.

    ``quality`` has (id, weight) with positive weights, one row per id; other documents
    weigh ``UNKNOWN_QUALITY``. ``times`` is how often the mix holds the document, ``taken`` its
    words there. The document in which the budget ends is taken if at least half of it fits, so
    a source differs from its target by at most half a document. Null text has size 0,
    null sources are one source, rows that repeat are rows of their own, and an empty table
    gives no rows. A document of size 0 is taken like any other.
    """
    sized = docs.select(
        field(id_col).alias("id"), field(source_col).alias("source"), F.xxhash64(whole(text_col)).alias("text_hash"),
        word_count(whole(text_col)).alias("size"))
    if quality is not None:
        sized = sized.join(quality.select(F.col("id"), F.col("weight").cast("double")), "id", "left")
    else:
        sized = sized.withColumn("weight", F.lit(UNKNOWN_QUALITY))
    # 52 bits of a hash of seed and id, moved off zero: u is above 0 and below 1.
    digits = F.left(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"))), F.lit(13))
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    keyed = stage(sized.withColumn("key", -F.ln(u) / F.coalesce("weight", F.lit(UNKNOWN_QUALITY))), "mix-keys")
    targets = stage(source_targets(keyed), "mix-targets")
    summed = running_totals(
        keyed.withColumns({"no_source": F.col("source").isNull(), "source_name": F.coalesce("source", F.lit(""))}),
        ["key", "id", "text_hash"], {"before": F.col("size")}, within=["no_source", "source_name"])
    joined = summed.alias("d").join(
        targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        "d.*", "t.source_size", "t.target")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    more = (F.col("before") + F.col("size") / 2.0 <= F.col("rest")) & (F.col("rest") > 0)
    return (
        joined.withColumn("epochs", full.cast("bigint")).withColumn("rest", rest)
        .withColumn("times", (F.col("epochs") + more.cast("bigint")))
        .select("id", "source", "text_hash", "size", "source_size", "target",
                (F.col("times") * F.col("size")).alias("taken"), "times"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """(id, weight) from rated documents: rated good counts twice, rated bad half."""
    rated = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.avg("quality").alias("q"))
    return rated.where("q is not null").select("id", F.pow(F.lit(2.0), 2 * F.col("q") - 1).alias("weight"))


def mixed_rows(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its own columns."""
    chosen = mix(docs, quality, id_col, text_col, source_col, seed)
    # Rows with one id, source and text are told apart by number only.
    same = ["match", "text_hash"]
    match = F.xxhash64("id", "source", "text_hash", F.col("id").isNull())
    times = stage(chosen.withColumn("match", match).groupBy(*same).agg(
        F.sum("times").alias("all_times"), F.count(F.lit(1)).alias("rows")), "mix-times")
    rows = docs.select(
        F.struct(*[field(c) for c in docs.columns]).alias("row"), field(id_col).alias("id"),
        field(source_col).alias("source"), F.xxhash64(whole(text_col)).alias("text_hash")
    ).withColumn("match", match).drop("id", "source").join(times, same)
    number = F.row_number().over(Window.partitionBy(*same).orderBy(F.xxhash64("row")))
    total = F.col("all_times")
    each = F.floor(total / F.col("rows")) + (number <= total % F.col("rows")).cast("bigint")
    return rows.withColumn("times", each.cast("int")).where("times > 0").select(
        "row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns])
