"""Language identification with n-gram filters that return sets of languages.

Learning: letter trigrams (lower case, word borders included) of all labelled texts are counted
per language. A language keeps the trigrams that make up at least ``MIN_SHARE`` of its letters and
are no rarer there than ``RATIO`` times their share in the language that uses them most. At most
``1 / MIN_SHARE`` trigrams per language can pass, so the model's size is bounded whatever was read.

A language with hundreds of letters has hardly any trigram that common. Where the kept trigrams
cover less than ``COVERED`` of its letters, a language with more than ``MANY_LETTERS`` kept letters is
known by single letters, chosen by the same two cuts.

The model is a Bloom filter in bit slices: every slot holds one bit per language, and the
AND over a trigram's slots is the set of languages that contain it. A bit column is the filter of one
language, so the slots follow the language with most trigrams: at most 2^18 of them, 32 KB a language. For a text, the hits of
each language are counted over all its letters, the hits expected from false positives are taken
off, and the language with most hits left is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from twinsift.lineage import stage
from twinsift.llm.common import field
from twinsift.llm.text_arrays import blocks, folded, mix64

MIN_SHARE = 1e-4
RATIO = 0.2
HASHES = 4
SLOTS_PER_GRAM = 16
UNDETERMINED = "und"

# A language is known by letters instead of trigrams below this coverage and beyond so many letters.
COVERED = 0.5
MANY_LETTERS = 256
# Stands before a single letter in place of the letter before; no code point is that large.
ALONE = 0x1FFFFF << 42

# The pipeline's filter: texts with a score below this share of their language's usual score go.
REJECT_BELOW = 0.2


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(trigram, text number), one per letter: the letter with its neighbours, or the word border."""
    codes, text = folded(texts, digits=False)
    at = np.flatnonzero(codes)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    wide = codes.astype(np.int64)
    before = np.where(at > 0, wide[at - 1], 0)
    return (before << 42) | (wide[at] << 21) | wide[at + 1], text[at]


def is_training(doc_id: Column) -> Column:
    """Three of four documents, by id: the others are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n), merged in memory and given out once per partition and million entries."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts):
        grams, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return grams, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)

    def out():
        for lang, parts in held.items():
            grams, n = merged(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for start, block in blocks(texts):
            of = np.array(langs[start:start + len(block)], dtype=object)
            for lang in set(of):
                mine = [t for t, name in zip(block, of) if name == lang]
                grams, n = np.unique(trigrams(mine)[0], return_counts=True)
                parts = held.setdefault(lang, [])
                parts.append((grams, n))
                if len(parts) >= 32:
                    held[lang] = [merged(parts)]
        if sum(len(g) for parts in held.values() for g, _ in parts) > 1_000_000:
            yield from out()
    yield from out()


@dataclass
class Model:
    """``slots`` has one row of language bits per slot; ``false_positive`` (a rate), ``by_letter`` and
    ``usual`` (the share of a training letter's kind that other training letters make known) have one value per language."""

    languages: list[str]
    slots: np.ndarray
    false_positive: np.ndarray
    by_letter: np.ndarray
    usual: np.ndarray
    fallback: str


def _letters(grams: np.ndarray) -> np.ndarray:
    """Trigrams as their middle letters."""
    return grams & (0x1FFFFF << 21) | ALONE


def _slots_of(grams: np.ndarray, size: int) -> Iterator[np.ndarray]:
    one = mix64(grams.view(np.uint64))
    two = mix64(one ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for i in range(HASHES):
        yield ((one + np.uint64(i) * two) >> np.uint64(20)) & np.uint64(size - 1)


def learn(labelled: DataFrame) -> Model:
    """The model from (text, lang) rows; rows without text or language teach nothing."""
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    counts = stage(
        rows.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")),
        "trigrams")
    # One row per language, like the model itself.
    totals = F.broadcast(counts.groupBy("lang").agg(F.sum("n").alias("total")))
    alone = F.col("gram").bitwiseAND(F.lit(0x1FFFFF << 21)).bitwiseOR(F.lit(ALONE))
    letters = counts.groupBy("lang", alone.alias("gram")).agg(F.sum("n").alias("n"))
    shares = counts.unionByName(letters).join(totals, "lang").withColumn("share", F.col("n") / F.col("total")).where(
        F.col("share") >= MIN_SHARE)
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    kept = shares.join(most, "gram").where(F.col("share") >= RATIO * F.col("most")).select("lang", "gram", "n", "total")
    found = kept.toPandas()
    if not len(found):
        return Model([], np.zeros((1, 1), np.uint8), np.zeros(0), np.zeros(0, bool), np.zeros(0), UNDETERMINED)
    # Each training letter against the others: a gram seen once is not known without it.
    found["known"] = found["n"].where(found["n"] > 1, 0) / found["total"]
    found["alone"] = found["gram"] >= ALONE
    kinds = found.groupby(["lang", "alone"])["known"].agg(["sum", "size"]).unstack(fill_value=0).reindex(
        columns=[(k, alone) for k in ("sum", "size") for alone in (False, True)], fill_value=0)
    by_letter = (kinds["sum", False] < COVERED) & (kinds["size", True] > MANY_LETTERS)
    by_letter |= kinds["size", False] == 0
    usual = kinds["sum", True].where(by_letter, kinds["sum", False])
    found = found[found["alone"] == found["lang"].map(by_letter)]
    languages = sorted(found["lang"].unique())
    number = found["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy()
    grams = found["gram"].to_numpy(np.int64)
    size = 1 << int(np.ceil(np.log2(SLOTS_PER_GRAM * max(16, np.bincount(number).max()))))
    slots = np.zeros((size, -(-len(languages) // 8)), np.uint8)
    bit = (128 >> number % 8).astype(np.uint8)
    for slot in _slots_of(grams, size):
        np.bitwise_or.at(slots, (slot, number // 8), bit)
    filled = np.array([((slots[:, i // 8] >> np.uint8(7 - i % 8)) & np.uint8(1)).mean() for i in range(len(languages))])
    largest = found.sort_values(["total", "lang"], ascending=[False, True])["lang"].iloc[0]
    return Model(languages, slots, filled ** HASHES,
                 by_letter[languages].to_numpy(bool), usual[languages].to_numpy(float), largest)


def judge(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """(language, score) per text; the score is the share of letters in the language's trigrams (or letters)."""
    grams, text = trigrams(texts)
    letters = np.bincount(text, minlength=len(texts))
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    sets = {}
    for alone in set(model.by_letter.tolist()):
        for slot in _slots_of(_letters(grams) if alone else grams, len(model.slots)):
            found = model.slots[slot]
            sets[alone] = found if alone not in sets else sets[alone] & found
    hits = np.empty((len(model.languages), len(texts)))
    for i, rate in enumerate(model.false_positive):
        bit = (sets[bool(model.by_letter[i])][:, i // 8] >> np.uint8(7 - i % 8)) & np.uint8(1)
        raw = np.bincount(text, bit, minlength=len(texts))
        hits[i] = np.clip((raw - letters * rate) / (1 - rate if rate < 1 else 1), 0, None)
    best = hits.argmax(axis=0)
    top = hits[best, np.arange(len(texts))]
    score = np.clip(np.divide(top, letters, out=np.zeros(len(texts)), where=letters > 0), 0, 1)
    names = [UNDETERMINED if not n else model.languages[b] if t > 0 else model.fallback
             for n, b, t in zip(letters, best, top)]
    return names, score


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
            carry: list[str] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """(id, carried columns, lang_pred, score) for every row; ``names`` renames the last two.

    A text that is null or has no letter is ``und`` with score 0. A text whose trigrams are all
    unknown gets the language with most training text and score 0. Without training rows
    everything is ``und``. Equal texts get equal answers; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*[field(c) for c in dict.fromkeys([id_col, text_col, *carry])])
    out = [id_col, *[c for c in carry if c != id_col]]

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, scores = [], []
            for _, block in blocks([t or "" for t in batch.column(text_col).to_pylist()]):
                found, score = judge(shared.value, block)
                languages += found
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in out], pa.array(languages, pa.string()),
                 pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64())],
                names=[*out, *names])

    schema = StructType([source.schema[c] for c in out] + [
        StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return source.mapInArrow(predicted, schema)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text is in a known language, with their own columns.

    A text goes if it has no letter, or none in the trigrams (or letters) of its best language, or if
    its score is less than ``REJECT_BELOW`` of what that language's own training letters score.
    """
    own = ("_twinsift_language", "_twinsift_score")
    judged = predict(docs, model, docs.columns[0], text_col, docs.columns, own)
    levels = [F.when(F.col(own[0]) == name, F.lit(float(REJECT_BELOW * usual)))
              for name, usual in zip(model.languages, model.usual)]
    return judged.where((F.col(own[0]) != UNDETERMINED) & (F.col(own[1]) > 0)
                        & (F.col(own[1]) >= F.coalesce(*levels, F.lit(0.0)))).select(*[field(c) for c in docs.columns])
