"""Checks and small operators on question tables and pair lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from twinsift.operators.order import with_position

# Column order of stored pairs, with and without the 0-based positions.
PAIR_COLUMNS = ["id1", "id2", "question1", "question2", "survey1", "survey2", "similarity"]
POSITIONED_PAIR_COLUMNS = ["idx1", "idx2", *PAIR_COLUMNS]


def preview(questions: DataFrame, rows: int = 5, id_col: str = "question_id") -> DataFrame:
    """The first rows by id."""
    return questions.orderBy(id_col).limit(rows)


def clean_text(questions: DataFrame, text_col: str = "question_text") -> DataFrame:
    """Text as string; rows without any visible character are dropped.

    A missing text is no text: it must not become a word that makes all such rows alike.
    """
    text = F.col(text_col).cast("string")
    return questions.withColumn(text_col, text).where(text.rlike(r"\S"))


def blank_count(questions: DataFrame, text_col: str = "question_text") -> DataFrame:
    """(rows, blank): how many rows ``clean_text`` drops."""
    kept = F.coalesce(F.col(text_col).cast("string").rlike(r"\S"), F.lit(False))
    return questions.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~kept).alias("blank"))


def repeated_ids(questions: DataFrame, id_col: str = "question_id") -> DataFrame:
    """(id, rows) of ids that occur more than once."""
    return questions.groupBy(id_col).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def require_unique_ids(questions: DataFrame, id_col: str = "question_id") -> DataFrame:
    """Fail and name up to ten of the repeated ids, since every join is by id."""
    bad = [str(r[0]) for r in repeated_ids(questions, id_col).orderBy(id_col).limit(10).collect()]
    if bad:
        raise ValueError(f"repeated {id_col}: {', '.join(bad)}")
    return questions


def with_defaults(questions: DataFrame, columns: tuple[str, ...] = ("survey_name", "directorate")) -> DataFrame:
    """Add missing descriptive columns as empty text."""
    absent = {c: F.lit("") for c in columns if c not in questions.columns}
    return questions.withColumns(absent) if absent else questions


def pair_details(pairs: DataFrame, questions: DataFrame, id_col: str = "question_id",
                 text_col: str = "question_text", survey_col: str = "survey_name",
                 digits: int | None = 4, positions: bool = False,
                 order_col: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Attach survey and text of both sides to (id1, id2, similarity), after the filtering.

    ``digits=None`` keeps the full similarity. ``positions`` adds the 0-based places of
    both questions in the order of ``order_col`` (the id by default). ``columns`` names the columns
    of the result, all by default; texts that it does not name are not moved.
    """
    columns = columns or (POSITIONED_PAIR_COLUMNS if positions else PAIR_COLUMNS)
    wanted = {name: c for name, c in (("question", text_col), ("survey", survey_col))
              if {f"{name}1", f"{name}2"} & {*columns}}
    described = questions.select(
        F.col(id_col).alias("_id"), *[F.col(c).alias(name) for name, c in wanted.items()],
        *([F.col(order_col)] if order_col else []))
    if positions:
        described = with_position(described, [order_col or "_id"], "idx")
    found = pairs
    for side in "12":
        named = {"_id": f"id{side}"} | {name: f"{name}{side}" for name in (*wanted, *(["idx"] if positions else []))}
        found = found.join(described.select(*[F.col(a).alias(b) for a, b in named.items()]), f"id{side}")
    similarity = F.col("similarity") if digits is None else F.round("similarity", digits)
    return found.withColumn("similarity", similarity).select(*columns)


def in_order_of(pairs: DataFrame, questions: DataFrame, order_col: str, id_col: str = "question_id") -> DataFrame:
    """Swap id1 and id2 where the second question comes first by ``order_col``."""
    place = questions.select(F.col(id_col).alias("_id"), F.col(order_col).alias("_place"))
    both = (pairs.join(place.toDF("id1", "_place1"), "id1").join(place.toDF("id2", "_place2"), "id2"))
    first = F.col("_place1") <= F.col("_place2")
    return both.withColumns({
        "id1": F.when(first, F.col("id1")).otherwise(F.col("id2")),
        "id2": F.when(first, F.col("id2")).otherwise(F.col("id1")),
    }).select(*pairs.columns)


def first_pairs(pairs: DataFrame, rows: int = 200, by: str = "id") -> DataFrame:
    """(id1, id2, similarity) of the first pairs by id, or the most similar ones."""
    if by not in ("id", "similarity"):
        raise ValueError(f"by must be 'id' or 'similarity', got {by!r}")
    order = ["id1", "id2"] if by == "id" else [F.desc("similarity"), "id1", "id2"]
    return pairs.select("id1", "id2", "similarity").orderBy(*order).limit(rows)


def page_count(counted: DataFrame, per_page: int = 50) -> DataFrame:
    """(pairs, pages) from the number of pairs; an empty list still has one page."""
    _check_page_size(per_page)
    return counted.select("pairs").withColumn(
        "pages", F.greatest(F.lit(1), F.ceil(F.col("pairs") / per_page)).cast("bigint"))


def pair_page(pairs: DataFrame, page: int, per_page: int = 50) -> DataFrame:
    """One page of pairs, most similar first; the page is kept within 1 .. last page.

    Rows are numbered in parallel, so a late page costs no more than the first.
    """
    _check_page_size(per_page)
    numbered = with_position(pairs.withColumn("_order", -F.col("similarity")), ["_order", "id1", "id2"])
    last = page_count(pairs.agg(F.count(F.lit(1)).alias("pairs")), per_page).first()["pages"]
    start = (min(max(page, 1), last) - 1) * per_page
    return (numbered.where((F.col("position") >= start) & (F.col("position") < start + per_page))
            .select("position", *pairs.columns))


# Positions per folder of stored pages.
PAGE_BLOCK = 100_000


def store_pages(pairs: DataFrame, path: str, block: int = PAGE_BLOCK) -> None:
    """Write the pairs once, numbered from the most similar one, so that a page reads only its own range.

    A folder holds ``block`` positions in order.
    """
    numbered = with_position(pairs, [F.desc_nulls_first("similarity"), "id1", "id2"])
    (numbered.select("position", *pairs.columns, F.floor(F.col("position") / block).alias("block"))
     .sortWithinPartitions("block", "position").write.partitionBy("block").parquet(path))


def stored_page(spark: SparkSession, path: str, schema: StructType, page: int, per_page: int = 50,
                block: int = PAGE_BLOCK) -> DataFrame:
    """One page of what ``store_pages`` wrote; ``schema`` is that of the pairs. The page is kept within 1 .. last page."""
    _check_page_size(per_page)
    columns = StructType([StructField("position", LongType()), *schema, StructField("block", LongType())])
    pages = spark.read.schema(columns).parquet(path)
    # The folder names tell the last block, so only that one is counted.
    top = pages.agg(F.max("block")).first()[0] or 0
    rows = (pages.where(F.col("block") == top).agg(F.max("position")).first()[0] or 0) + 1
    start = (min(max(page, 1), -(-rows // per_page)) - 1) * per_page
    inside = F.col("block").between(start // block, (start + per_page - 1) // block)
    return pages.where(inside & F.col("position").between(start, start + per_page - 1)).drop("block")


def _check_page_size(per_page: int) -> None:
    if not 10 <= per_page <= 200:
        raise ValueError(f"per_page must lie in 10..200, got {per_page}")
