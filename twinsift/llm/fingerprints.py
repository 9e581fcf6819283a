"""Merkle fingerprints of documents [DataFrame functions only].

A text is cut into paragraphs at line breaks and a paragraph into sentences, keeping every
character. A leaf is the hash of a sentence with its length, a paragraph hashes its leaves, a
section hashes a run of paragraphs and the root hashes the sections. A section ends after a
paragraph whose hash starts with one of four hexadecimal digits, so an insertion moves no later
section border. The fingerprint writes the whole tree as one string::

    root|section[paragraph(leaf.length leaf.length),paragraph(...)]section[...]

Equal roots mean equal texts; below differing roots, equal sections and paragraphs are
unchanged and the others locate the edit. Inner hashes are the first 64 bits of SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.llm.common import constant, field, partitions, range_of, splitters, whole

HASH = 16
SENTENCE_END = "(?<=[.!?] )"
SECTION_END = ("0", "1", "2", "3")
BLOCKS_PER_PARTITION = 8


def _hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(HASH))


def fingerprint(text: Column) -> Column:
    """The tree of a text (null as empty) as a string; the empty text is a tree of one empty leaf."""
    def leaves(paragraph):
        return F.array_join(F.transform(F.split(paragraph, SENTENCE_END), lambda s: F.concat(
            _hash(s), F.lit("."), F.length(s).cast("string"))), " ")

    def node(inside):
        return F.concat(_hash(inside), F.lit("("), inside, F.lit(")"))

    def closed(paragraph):
        last = F.left(paragraph, F.lit(1)).isin(*SECTION_END)
        return F.concat(paragraph, F.when(last, ";").otherwise(","))

    paragraphs = F.transform(F.transform(F.split(whole(text), "\n"), leaves), node)
    runs = F.filter(F.split(F.array_join(F.transform(paragraphs, closed), ""), ";"), lambda r: r != "")
    sections = F.transform(runs, lambda r: F.concat(_hash(r), F.lit("["), F.rtrim(r, F.lit(",")), F.lit("]")))
    tree = F.array_join(sections, "")
    heads = F.regexp_replace(tree, r"\[[^\]]*\]", "")
    return F.concat(F.sha2(heads, 256), F.lit("|"), tree)


def root(tree: Column) -> Column:
    return F.substring_index(tree, "|", 1)


def _leaves(tree: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(tree, F.lit(r"[0-9a-f]{16}\.[0-9]+"), F.lit(0)))


def _paragraphs(tree: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(tree, F.lit(r"([0-9a-f]{16})\("), F.lit(1)))


def _weight(leaves: Column) -> Column:
    return F.aggregate(leaves, F.lit(0).cast("bigint"),
                       lambda total, leaf: total + F.substring_index(leaf, ".", -1).cast("bigint"))


def likeness(a: Column, b: Column) -> Column:
    """Characters in sentences that both trees hold, as a share of all (Dice), 0 to 1."""
    return F.when(root(a) == root(b), 1.0).otherwise(F.try_divide(
        2.0 * _weight(F.array_intersect(_leaves(a), _leaves(b))), _weight(_leaves(a)) + _weight(_leaves(b))))


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Hashes of the paragraphs of ``b`` that ``a`` lacks: the branches an edit touched."""
    return F.when(root(a) == root(b), F.array().cast("array<string>")).otherwise(
        F.array_except(_paragraphs(b), _paragraphs(a)))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, next_text): the text of the row that follows by id; the first follows the last.

    Rows are dealt into blocks of ids by sampled bounds, and the first row of a block also
    visits the block before, so texts are shuffled once. A null id comes first; rows with
    one id follow each other by the hash of their text.
    """
    spark = docs.sparkSession
    ids = docs.select(field(id_col).alias("id"))
    lows = splitters(ids, BLOCKS_PER_PARTITION * partitions(spark))
    low, nulls = ids.agg(F.min("id"), F.count(F.when(F.col("id").isNull(), 1))).first()
    first = F.col("id").isNull() if nulls or low is None else F.col("id") == F.lit(low)
    block = F.col("block")
    starts = F.get(constant(lows, "array<{}>"), F.greatest(block - 1, F.lit(0))) == F.col("id") if lows else F.lit(False)
    homes = (
        F.when(first, F.array(block, F.lit(len(lows))))
        .when((block > 0) & starts, F.array(block, block - 1))
        .otherwise(F.array(block)))
    rows = (
        docs.select(field(id_col).alias("id"), whole(text_col).alias("text"))
        .withColumn("block", range_of(F.col("id"), lows))
        .select("id", "text", "block", F.posexplode(homes).alias("visits", "home"))
        .withColumn("tie", F.xxhash64("text"))
    )
    order = Window.partitionBy("home").orderBy("visits", F.asc_nulls_first("id"), "tie")
    return rows.withColumn("next_text", F.lead("text").over(order)).where("visits = 0").select(
        "id", "text", F.coalesce("next_text", "text").alias("next_text"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text, the text with its second half replaced from the next one, and compare.

    Null text counts as empty; a single row is its own next row; an empty table gives no
    rows. Other columns are not read.
    """
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    rows = with_next(docs, id_col, text_col).select(
        "id", "text", "next_text", n.cast("bigint").alias("n_chars"),
        F.concat(F.left("text", n - half), F.left("next_text", half)).alias("edited"))
    trees = rows.select(
        "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"),
        fingerprint(F.col("next_text")).alias("next_fingerprint"))
    own = F.col("fingerprint")
    return trees.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(own, F.col("edited_fingerprint")).alias("near_edited"),
        likeness(own, F.col("next_fingerprint")).alias("near_next"))
