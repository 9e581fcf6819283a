"""Built-in encoder: words of a text as a unit TF-IDF vector, in long form."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from twinsift.lineage import stage
from twinsift.operators.copies import content_groups, keepers_of
from twinsift.operators.skew import lookup

# Bounds the frequent words that are broadcast, about 10 MB.
FREQUENT_WORDS = 200_000
# Steps of frequency for each doubling.
STEPS = 16
# Texts whose words are counted at once, to bound the memory of a task.
LIST_ROWS = 1_024


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def distinct_texts(questions: DataFrame, id_col: str, text_col: str,
                   hot_rows: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Keepers (keeper, copies, text), members, and the number of texts; texts without a word are left out."""
    texts = (questions.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
             .where(F.col("text").rlike(r"\S")))
    groups, members = content_groups(texts, "id", F.sha2("text", 256), hot_rows)
    total = groups.agg(F.sum("copies")).first()[0] or 0
    return keepers_of(texts, "id", groups, "text"), members, total


def _distinct_words(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, word, count) of the distinct words of each row, a whole Arrow batch at once."""
    listed = batch.column("words")
    words = listed.flatten().dictionary_encode()
    size = max(1, len(words.dictionary))
    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(listed).to_numpy())
    key, count = np.unique(row * size + words.indices.to_numpy(), return_counts=True)
    return key // size, words.dictionary.take(pa.array(key % size)), count


def _counted(batches):
    for batch in batches:
        row, token, count = _distinct_words(batch)
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [batch.column("keeper").take(at), batch.column("copies").take(at), token, pa.array(count.astype(np.int64))],
            names=["keeper", "copies", "token", "tf"])


def _counted_lists(batches):
    for batch in (whole.slice(start, LIST_ROWS) for whole in batches for start in range(0, whole.num_rows, LIST_ROWS)):
        row, token, count = _distinct_words(batch)
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("keeper"), batch.column("copies"), pa.ListArray.from_arrays(ends, token),
             pa.ListArray.from_arrays(ends, pa.array(count.astype(np.int32)))], names=["keeper", "copies", "tokens", "tfs"])


def word_counts(keepers: DataFrame) -> DataFrame:
    """(keeper, copies, token, tf), stored. Words are counted where the text of a keeper is fetched."""
    schema = StructType([*keepers.select("keeper", "copies").schema]).add("token", "string").add("tf", "long")
    return stage(_listed(keepers).mapInArrow(_counted, schema), "counts")


def word_lists(keepers: DataFrame, path: str) -> DataFrame:
    """(keeper, copies, tokens, tfs), stored at ``path``: the distinct words of a keeper and their counts in one row."""
    schema = StructType([*keepers.select("keeper", "copies").schema]).add(
        "tokens", ArrayType(StringType())).add("tfs", ArrayType(IntegerType()))
    return stage(_listed(keepers).mapInArrow(_counted_lists, schema), "lists", path)


def _listed(keepers: DataFrame) -> DataFrame:
    return keepers.select("keeper", "copies", words(F.col("text")).alias("words"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """(token, token_id, df, kept): document frequency over all rows and over keepers.

    Stored before use, which also fixes the generated token ids.
    """
    counted = counts.groupBy("token").agg(F.sum("copies").alias("df"), F.count(F.lit(1)).alias("kept"))
    return stage(counted.withColumn("token_id", F.monotonically_increasing_id()), "vocabulary")


def shared_words(lists: DataFrame, path: str) -> DataFrame:
    """(token, token_id, df, kept) of the words of more than one row, stored at ``path``; ids are close to gapless."""
    counted = lists.select("copies", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.sum("copies").alias("df"), F.count(F.lit(1)).alias("kept")).where("kept > 1")
    # The number within the partition, and the partition, of which there are no more than shuffle partitions.
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.monotonically_increasing_id()
    return stage(counted.withColumn("_number", number).select(
        "token", (F.col("_number").bitwiseAND((1 << 33) - 1) * parts + F.shiftright("_number", 33)).alias("token_id"),
        "df", "kept"), "shared", path)


def split_by_frequency(shared: DataFrame) -> tuple[pa.Table, DataFrame]:
    """(the most frequent words, at most ``FREQUENT_WORDS``, as a local table to be broadcast; the other ones)."""
    step = F.floor(F.log2("kept") * STEPS)
    steps = shared.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()  # some hundreds
    least, words = math.inf, 0
    for found in steps:
        words += found["count"]
        if words > FREQUENT_WORDS:
            break
        least = found["step"]
    frequent = shared.where(step >= F.lit(float(least))).select("token", "token_id", "df").toArrow()
    return frequent, shared.where(step < F.lit(float(least)))


def weights(counts: DataFrame, total: int, hot_rows: int | None = None) -> DataFrame:
    """(keeper, copies, token, token_id, df, kept, v) for every word of a keeper with a weight ``v`` above 0."""
    vocab = vocabulary(counts)
    idf = F.log((F.lit(float(total)) + 1) / (F.col("df") + 1))
    return (
        lookup(counts, vocab, "token", "kept", hot_rows=hot_rows)
        .withColumn("v", F.col("tf") * idf).where("v > 0")
        .select("keeper", "copies", "token", "token_id", "df", "kept", "v")
    )


def tfidf_vectors(questions: DataFrame, id_col: str = "question_id",
                  text_col: str = "question_text", hot_rows: int | None = None) -> DataFrame:
    """Unit TF-IDF vectors of all rows in long form: (id, token, u)."""
    keepers, members, total = distinct_texts(questions, id_col, text_col, hot_rows)
    counts = word_counts(keepers)
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("keeper")))
    # A weight before the division has few different values, so it is stored in a fraction of the space.
    vectors = stage(weights(counts, total, hot_rows).select(
        "keeper", "copies", "token", "v", norm.alias("norm")), "weights").withColumn("u", F.col("v") / F.col("norm"))
    alone = vectors.where("copies = 1").select(F.col("keeper").alias("id"), "token", "u")
    # A group of copies meets each word of its text once, so the words are the small side
    # per copy; packing them keeps one row per group in the join.
    packed = stage(vectors.where("copies > 1").groupBy("keeper", "copies")
                   .agg(F.collect_list(F.struct("token", "u")).alias("entries")), "packed")
    copied = (lookup(members.select("id", "keeper"), packed, "keeper", "copies", hot_rows=hot_rows)
              .select("id", F.inline("entries")))
    return alone.unionByName(copied).withColumnRenamed("id", id_col)
