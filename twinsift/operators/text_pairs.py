"""Pairs and clusters of texts whose TF-IDF cosine reaches a threshold, exactly."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, AtomicType, DoubleType, IntegerType, LongType, StructType

from twinsift.lineage import drop, fresh_path, stage
from twinsift.operators.components import clusters_of_keepers, connected_components
from twinsift.operators.copies import expand_pairs
from twinsift.operators.skew import CHUNK_ROWS, chunk_count, chunk_of, lookup, pairs_in_buckets
from twinsift.operators.tfidf import LIST_ROWS, distinct_texts, shared_words, split_by_frequency, word_lists

# Room for floating-point error in the candidate bounds; the score itself decides.
MARGIN = 1e-9
# A similarity this little below the threshold counts as equal to it.
EQUAL = 1e-12
# What a prefix entry says about the words that are more frequent than its own: their norm, the
# largest weight and the sum of the weights.
REST = ("rest", "most", "total")
# Texts are dealt to so many spots, and spots to chunks.
SPOTS = 32_768
# One word in so many is searched beforehand, to see how many pairs to expect.
SAMPLED_SHARE = 16
# Words of pairs that are looked up at once.
GATHERED_WORDS = 1_000_000
# Pairs that are listed in one row.
LISTED_PAIRS = 1_024
# Words of the texts that are compared with each other in one place, and words fetched per group.
TILE_WORDS = 500_000
GROUP_WORDS = 2_000_000
# Prefix words of the texts of a chunk, and the fewest worth a chunk of their own.
PREFIX_WORDS = 3_000_000
LEAST_WORDS = 100_000
# Pairs of two chunks, on average, each of which comes about so many times.
TILE_PAIRS = 2_000_000
PAIR_ROWS = 3
# Bounds the broadcast list of words whose texts are cut into chunks.
CROWDED_WORDS = 500_000


def check_threshold(threshold: float) -> float:
    if not -1.0 <= threshold <= 1.0:
        raise ValueError(f"threshold must lie in -1..1, got {threshold}")
    return threshold


def _profiles(frequent: Broadcast, total: int, threshold: float, id_type: pa.DataType):
    """Arrow batches of (keeper, copies, known, others) -> what the search needs to know of a text.

    ``known`` has the places of words in ``frequent``, ``others`` the remaining words. ``tokens`` and ``vs`` are the vector
    by token id, ``norm`` its length. ``prefix`` holds the entries through which every
    pair at or above the threshold is found: let w be the rarest word two texts share. All shared
    words lie in both tails of w (the norm of w and all more frequent words), so the cosine is at most the
    product of the tails; each tail is at most 1, hence both must reach the threshold. Words of a single
    keeper count in the norms but are shared by nobody, so they are in neither. ``cut`` is the norm of the
    shared words that are not in the prefix. ``before`` is the next rarer word of the prefix, or -1.
    Prefix entries only bound a score, so they are rounded up to single precision.
    """
    def profile(token, shared, v):
        squares = np.cumsum(v * v)
        norm = np.sqrt(squares[-1])
        rest = np.sqrt(np.concatenate([[0.0], squares[:-1]])) / norm
        most = np.concatenate([[0.0], np.maximum.accumulate(v)[:-1]]) / norm
        sums = np.concatenate([[0.0], np.cumsum(v)[:-1]]) / norm
        u = v / norm
        first = shared & (np.sqrt(squares) / norm >= threshold - MARGIN)
        by_id = np.flatnonzero(shared)[np.argsort(token[shared])]
        # Where an id comes twice, so do the words, and no bound holds: the score decides.
        once = (token[1:] != token[:-1]).all()
        cut = np.linalg.norm(u[shared & ~first]) if once else np.inf
        before = np.append(token[first][1:], -1)[:first.sum()] if once else np.full(first.sum(), -1)
        return ((token[by_id], v[by_id]), (token[first], *(_above(x[first]) for x in (u, rest, most, sums)), before), norm, cut)

    def profiles(batches):
        words = [frequent.value[c].to_numpy() for c in ("token_id", "df")]
        for batch in (whole.slice(start, LIST_ROWS) for whole in batches for start in range(0, whole.num_rows, LIST_ROWS)):
            row, token, df, shared, tf = _words(batch, *words)
            v = tf * np.log((total + 1.0) / (df + 1.0))
            order = np.lexsort((-token, -df, row))
            order = order[v[order] > 0]
            row, token, shared, v = row[order], token[order], shared[order], v[order]
            known, starts = np.unique(row, return_index=True)
            found = [profile(*(c[a:b] for c in (token, shared, v))) for a, b in zip(starts, [*starts[1:], len(row)])]
            vector, prefix, at = [f[0] for f in found], [f[1] for f in found], pa.array(known)
            entries = pa.StructArray.from_arrays(
                [_joined(prefix, 0).cast(id_type), *[_joined(prefix, i).cast(pa.float32()) for i in range(1, 5)],
                 _joined(prefix, 5).cast(id_type)], ["token_id", "u", *REST, "before"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("keeper").take(at), batch.column("copies").take(at),
                 _lists(vector, _joined(vector, 0).cast(id_type)), _lists(vector, _joined(vector, 1)),
                 pa.array([f[2] for f in found], pa.float64()), _lists(prefix, entries),
                 pa.array([f[3] for f in found], pa.float64())],
                ["keeper", "copies", "tokens", "vs", "norm", "prefix", "cut"])
    return profiles


def _words(batch: pa.RecordBatch, ids: np.ndarray, dfs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, token id, df, shared, tf) of all words of a batch; a word of a single keeper has an id of its own, below 0."""
    def rows(lists: pa.ListArray, row: np.ndarray) -> np.ndarray:
        return np.repeat(row, pc.list_value_length(lists).to_numpy(zero_copy_only=False))

    every = np.arange(batch.num_rows)
    known, others = batch.column("known"), batch.column("others")
    part, word = known.flatten(), others.flatten()
    at, tf = (pc.struct_field(part, c) for c in ("at", "tf"))
    place = at.flatten().to_numpy()
    token = pc.struct_field(word, "token_id")
    shared = token.is_valid().to_numpy(zero_copy_only=False)
    token = np.where(shared, pc.fill_null(token, 0).to_numpy(), -1 - np.arange(len(word)))
    return tuple(np.concatenate(both) for both in (
        (rows(at, rows(known, every)), rows(others, every)), (ids[place], token),
        (dfs[place], pc.struct_field(word, "df").to_numpy()), (np.ones(len(place), bool), shared),
        (tf.flatten().to_numpy(), pc.struct_field(word, "tf").to_numpy())))


def _above(values: np.ndarray) -> np.ndarray:
    """In single precision, never less than before."""
    short = values.astype(np.float32)
    return np.where(short < values, np.nextafter(short, np.float32(np.inf)), short)


def _joined(parts: list[tuple], i: int) -> pa.Array:
    return pa.array(np.concatenate([p[i] for p in parts]) if parts else np.empty(0))


def _lists(parts: list[tuple], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(p[0]) for p in parts)]), pa.int32()), values)


def _packed(lists: DataFrame, shared: DataFrame, total: int, threshold: float) -> DataFrame:
    """(keeper, copies, tokens, vs, norm, prefix, cut), stored, one row per keeper; bounded by one text.

    The weights of frequent words, most of all words, come from a broadcast table where the text is. Only the other
    words are shuffled, and only those of several keepers have an entry in ``shared``.
    """
    frequent, rare = split_by_frequency(shared)
    spread = lists.sparkSession.sparkContext.broadcast(frequent)

    def places(batch):
        """(words, their counts, place of each among the frequent ones, ends of the rows)."""
        tokens, tfs = (batch.column(c) for c in ("tokens", "tfs"))
        words = tokens.flatten()
        place = pc.index_in(words, value_set=spread.value["token"].combine_chunks().cast(words.type))
        return words, tfs.flatten(), place, np.concatenate([[0], np.cumsum(pc.list_value_length(tokens).to_numpy())])

    def known(batches):
        for batch in batches:
            words, tfs, place, ends = places(batch)
            found = place.is_valid()
            ends = pa.array(np.concatenate([[0], np.cumsum(found.to_numpy(zero_copy_only=False))])[ends].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("keeper"), batch.column("copies"), *[
                    pa.ListArray.from_arrays(ends, c.filter(found)) for c in (place, tfs)]], ["keeper", "copies", "at", "tf"])

    def others(batches):
        for batch in batches:
            words, tfs, place, ends = places(batch)
            left = place.is_null()
            at = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(ends))).filter(left)
            yield pa.RecordBatch.from_arrays(
                [batch.column("keeper").take(at), batch.column("copies").take(at), words.filter(left), tfs.filter(left)],
                ["keeper", "copies", "token", "tf"])

    row = lists.select("keeper", "copies").schema
    places_of = ArrayType(IntegerType())
    frequent_words = lists.mapInArrow(known, StructType([*row]).add("at", places_of).add("tf", places_of)).select(
        "keeper", "copies", F.struct("at", "tf").alias("known"))
    rare_words = lists.mapInArrow(others, StructType([*row]).add("token", "string").add("tf", "integer")).join(
        rare.select("token", "token_id", "df"), "token", "left").select(
        "keeper", "copies", F.struct("token_id", F.coalesce("df", "copies").alias("df"), "tf").alias("others"))
    words = frequent_words.unionByName(rare_words, allowMissingColumns=True).groupBy("keeper").agg(
        F.max("copies").alias("copies"), F.collect_list("known").alias("known"), F.collect_list("others").alias("others"))
    small = (shared.agg(F.max("token_id")).first()[0] or 0) < 2**31
    id_type = IntegerType() if small else LongType()
    entry = StructType().add("token_id", id_type)
    for name in ("u", *REST):
        entry = entry.add(name, "float")
    entry = entry.add("before", id_type)
    schema = StructType([*row]).add("tokens", ArrayType(id_type)).add("vs", ArrayType(DoubleType())).add(
        "norm", "double").add("prefix", ArrayType(entry)).add("cut", "double")
    packed = stage(words.mapInArrow(
        _profiles(spread, total, threshold, pa.int32() if small else pa.int64()), schema), "packed")
    spread.unpersist()
    return packed


def unit_lists(packed: DataFrame, *further: str) -> DataFrame:
    """(id, tokens, us, further columns): the unit vectors by token id."""
    return packed.select(
        F.col("keeper").alias("id"), *further, "tokens", F.transform("vs", lambda v: v / F.col("norm")).alias("us"))


def prefix_entries(packed: DataFrame) -> DataFrame:
    """(token_id, keeper, u, rest, most, total, before), one row per prefix entry; further columns stay."""
    entries = packed.select(
        *[c for c in packed.columns if c not in ("copies", "tokens", "vs", "norm", "prefix", "cut")], F.inline("prefix"))
    return entries.withColumns({c: F.col(c).cast("double") for c in ("u", *REST)})


def _reachable(threshold: float | None, least=F.least):
    """Bound at the rarest shared word: its own product plus the most the rests can add.

    ``threshold=None`` takes the lesser of the ``floor`` of both.

    That is the product of their norms (Cauchy-Schwarz), and no more than the largest weight
    of one times the sum of the other.
    """
    def within(a, b):
        rests = least(least(a("rest") * b("rest"), a("most") * b("total")), a("total") * b("most"))
        return a("u") * b("u") + rests >= (least(a("floor"), b("floor")) if threshold is None else threshold) - MARGIN
    return within


def not_met(a, b):
    """Do two entries of a word stand for texts that did not surely meet at a rarer word?

    Texts whose next rarer words are the same share that one too. At the rarest word two texts share they never are.
    """
    return (a("before") != b("before")) | (a("before") < 0)


def reachable_there(threshold: float | None):
    """The same for texts that did not surely meet at a rarer word."""
    within = _reachable(threshold)
    return lambda a, b: within(a, b) & not_met(a, b)


def _spot(keeper: Column) -> Column:
    return F.pmod(F.xxhash64(keeper), F.lit(SPOTS)).cast("smallint")


def sized_entries(prefix: DataFrame, hot_rows: int | None) -> DataFrame:
    """Prefix entries of shared words with the number of entries of the word, stored."""
    sizes = stage(
        prefix.groupBy("token_id").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    return stage(lookup(prefix, sizes, "token_id", "size", hot_rows=hot_rows), "prefix")


def crowded_words(packed: DataFrame, chunk_rows: int) -> DataFrame:
    """(token_id) of words with too many texts for one run, at most ``CROWDED_WORDS``, to be broadcast."""
    entries = packed.agg(F.sum(F.size("prefix"))).first()[0] or 0
    most = max(chunk_rows, entries // CROWDED_WORDS)
    if not isinstance(packed.schema["keeper"].dataType, AtomicType):
        most = 1  # composite ids take the joins
    sizes = packed.select(F.explode("prefix.token_id").alias("token_id")).groupBy("token_id").count()
    return F.broadcast(stage(sizes.where(F.col("count") > most).select("token_id"), "crowded"))


def _in_runs(entries: DataFrame, found, chunks: int) -> DataFrame:
    """Lists (see ``_dealt``) that ``found`` makes of the prefix entries, which come with those of a word side by side, by keeper."""
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def search(batches):
        for table in _whole_runs(batches):
            keepers = table["keeper"].combine_chunks().dictionary_encode()
            keeper = keepers.indices.to_numpy().astype(np.int64)
            spot = np.empty(len(keepers.dictionary), np.int64)
            spot[keeper] = table["spot"].to_numpy()
            yield _dealt(keepers.dictionary, spot, *(keeper[side] for side in found(table, keeper)), chunks)

    # They were rounded up to single precision, so nothing is lost.
    entries = entries.withColumns({**{c: F.col(c).cast("float") for c in ("u", *REST)}, "spot": _spot(F.col("keeper"))})
    return (entries.repartition(parts, "token_id").sortWithinPartitions("token_id", "keeper", "u")
            .mapInArrow(search, _lists_schema(entries.schema["keeper"].dataType)))


def _lists_schema(id_type) -> StructType:
    ids = ArrayType(id_type)
    return StructType().add("group", "long").add("id1s", ids).add("id2s", ids).add("texts", ids)


def _dealt(ids: pa.Array, spot: np.ndarray, one: np.ndarray, two: np.ndarray, chunks: int) -> pa.RecordBatch:
    """(group, id1s, id2s, texts): the pairs, each once, by pair of chunks of their texts, one row per group.

    ``one`` and ``two`` are positions in ``ids``. ``texts`` are those of a group, each once.
    """
    one, two = np.divmod(np.unique(one * len(ids) + two), max(1, len(ids)))
    chunk = spot * chunks // SPOTS
    group = np.minimum(chunk[one], chunk[two]) * chunks + np.maximum(chunk[one], chunk[two])
    order = np.argsort(group, kind="stable")
    one, two, group = one[order], two[order], group[order]
    first, listed = _runs_of(group)
    home, text = np.divmod(np.unique(np.concatenate([group, group]) * len(ids) + np.concatenate([one, two])), max(1, len(ids)))
    _, homes = _runs_of(home)
    return pa.RecordBatch.from_arrays(
        [pa.array(group[first]), *(listed(ids.take(pa.array(side))) for side in (one, two)),
         homes(ids.take(pa.array(text)))], ["group", "id1s", "id2s", "texts"])


def _pairs_as_lists(pairs: DataFrame, chunks: int) -> DataFrame:
    """Pairs (id1, id2) as lists."""
    def deal(batches):
        for batch in (b for b in batches if b.num_rows):
            ids = pa.concat_arrays([batch.column("id1"), batch.column("id2")]).dictionary_encode()
            code = ids.indices.to_numpy().astype(np.int64)
            spot = np.empty(len(ids.dictionary), np.int64)
            spot[code] = np.concatenate([batch.column("spot1").to_numpy(), batch.column("spot2").to_numpy()])
            yield _dealt(ids.dictionary, spot, code[:batch.num_rows], code[batch.num_rows:], chunks)

    spots = [_spot(F.col(c)).alias(f"spot{c[2]}") for c in ("id1", "id2")]
    return pairs.select("id1", "id2", *spots).mapInArrow(deal, _lists_schema(pairs.schema["id1"].dataType))


def scored_pairs(entries: DataFrame, found, met: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    """(id1, id2, copies1, copies2, similarity) of the pairs that ``found`` makes of the entries, and of the pairs ``met``."""
    spark = packed.sparkSession
    path = fresh_path(spark, "candidates")
    scored = score_pairs(_candidates(entries, found, met, packed, path), packed, threshold)
    drop(spark, path)
    return scored


def _candidates(entries: DataFrame, found, met: DataFrame, packed: DataFrame, path: str) -> DataFrame:
    """Lists of the pairs that ``found`` makes of the entries, and of the pairs ``met``, stored at ``path``.

    Texts are dealt to chunks, and pairs to pairs of chunks. There are as many as the prefix words of a chunk and
    the expected pairs of two chunks ask for.
    """
    spark = entries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = packed.agg(F.sum(F.size("prefix"))).first()[0] or 0
    met_path = fresh_path(spark, "met")
    met = stage(met, "met", met_path)
    pairs = 0
    if words > LEAST_WORDS:
        some = _in_runs(entries.where(F.col("token_id") % SAMPLED_SHARE == 0), found, 1)
        pairs = met.count() + SAMPLED_SHARE * (some.agg(F.sum(F.size("id1s"))).first()[0] or 0)
    chunks = min(SPOTS, max(
        1, math.ceil(words / PREFIX_WORDS), math.ceil(math.sqrt(2 * pairs / (PAIR_ROWS * TILE_PAIRS))),
        min(math.ceil(math.sqrt(2 * parts)), words // LEAST_WORDS)))
    lists = stage(_in_runs(entries, found, chunks).unionByName(_pairs_as_lists(met, chunks)), "candidates", path)
    drop(spark, met_path)
    return lists


def _whole_runs(batches):
    """Tables in which the rows of a word, which follow each other, are complete."""
    held = None
    for batch in (b for b in batches if b.num_rows):
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        token = table["token_id"].to_numpy()
        last = int(np.searchsorted(token, token[-1]))
        if last:
            yield table.slice(0, last).combine_chunks()
        held = table.slice(last)
    if held is not None:
        yield held.combine_chunks()


def _near_in_run(table: pa.Table, threshold: float | None):
    """Which of the given entries of the same words, by position, are within reach."""
    near = _reachable(threshold, np.minimum)
    columns = {c: table[c].to_numpy().astype(np.float64) for c in ("u", *REST, *(["floor"] if threshold is None else []))}
    return lambda i, j: near(lambda c: columns[c][i], lambda c: columns[c][j])


def _runs_of(*codes: np.ndarray):
    """(first places of the runs of equal codes, what makes one list per run of a column)."""
    first = np.flatnonzero(np.any([np.diff(c, prepend=-1) != 0 for c in codes], axis=0))
    ends = pa.array(np.append(first, len(codes[0])).astype(np.int32))

    def listed(values):
        return pa.ListArray.from_arrays(ends, values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values)
    return first, listed


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)


def run_pairs(threshold: float | None, apart: str):
    """Pairs of a word within reach that differ in the column ``apart``, each row with those a step further, step by step."""
    def pairs(table: pa.Table, keeper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        token, before = table["token_id"].to_numpy(), table["before"].to_numpy()
        kind = keeper if apart == "keeper" else _codes(table[apart])
        near, one, two = _near_in_run(table, threshold), [], []
        at, step = np.arange(len(token)), 0
        while len(at):
            step += 1
            at = at[:np.searchsorted(at, len(token) - step)]
            at = at[token[at] == token[at + step]]
            met = at[(kind[at] != kind[at + step]) & ((before[at] != before[at + step]) | (before[at] < 0))]
            met = met[near(met, met + step)]
            one.append(met)
            two.append(met + step)
        return np.concatenate([np.empty(0, np.int64), *one]), np.concatenate([np.empty(0, np.int64), *two])
    return pairs


def _run_stars(threshold: float):
    """Pairs within reach of the first text of a word with each other one."""
    def pairs(table: pa.Table, keeper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        token = table["token_id"].to_numpy()
        hub = np.searchsorted(token, token)
        met = np.flatnonzero(keeper != keeper[hub])
        met = met[_near_in_run(table, threshold)(hub[met], met)]
        return hub[met], met
    return pairs


class _Lists:
    """The word lists of a group: texts by position, words by their number within the group."""

    def __init__(self, pairs: pa.Table, lists: pa.Table):
        self.ids = lists["id"].combine_chunks()
        self.one, self.two = (pc.index_in(pairs[c], value_set=self.ids).to_numpy().astype(np.int64) for c in ("id1", "id2"))
        tokens, us = (lists[c].combine_chunks() for c in ("tokens", "us"))
        length = pc.list_value_length(tokens).to_numpy()
        self.end = np.cumsum(length)
        self.start = self.end - length
        words = tokens.flatten().dictionary_encode()
        self.word, self.words = words.indices.to_numpy(), len(words.dictionary)
        self.u = us.flatten().to_numpy().astype(np.float64, copy=False)

    def keep(self, pairs: np.ndarray) -> None:
        self.one, self.two = self.one[pairs], self.two[pairs]

    def products(self):
        """(pairs, dot products, places of the first words both have in one and in two), for some pairs of one long text at a time.

        The words of the shorter text of a pair are looked up in the longer one, but those of the second in the first
        if an id comes twice, as then a word counts once in the first and twice in the second.
        """
        dense, place = np.zeros(self.words), np.zeros(self.words, np.int64)
        length = self.end - self.start
        # The words of a list are in order, so that equal ones follow each other.
        again = np.flatnonzero(self.word[1:] == self.word[:-1]) + 1
        row = np.searchsorted(self.end, again, "right")
        twice = np.zeros(len(length), bool)
        twice[row[self.start[row] < again]] = True
        turned = (length[self.one] < length[self.two]) & ~twice[self.one] & ~twice[self.two]
        longer, shorter = np.where(turned, self.two, self.one), np.where(turned, self.one, self.two)
        for run, one in _by_text(longer):
            mine = slice(self.start[one], self.end[one])
            dense[self.word[mine]] = self.u[mine]
            place[self.word[mine]] = np.arange(mine.start, mine.stop)
            last = np.cumsum(length[shorter[run]])
            cuts = np.searchsorted(last, np.arange(0, last[-1], GATHERED_WORDS), "right") if last[-1] > GATHERED_WORDS else [0]
            for part in (run[a:b] for a, b in zip(cuts, [*cuts[1:], len(run)]) if b > a):
                two = shorter[part]
                first = np.cumsum(length[two]) - length[two]
                at = np.repeat(self.start[two] - first, length[two]) + np.arange(first[-1] + length[two[-1]])
                word = self.word[at]
                shared = dense[word]
                met = np.flatnonzero(shared)
                # A text without a word in common gets its first word.
                begin = np.append(met, 0)[np.minimum(np.searchsorted(met, first), len(met))]
                begin = np.where((begin >= first) & (begin < first + length[two]), begin, first)
                places = place[word[begin]], at[begin]
                yield part, np.add.reduceat(shared * self.u[at], first), *(
                    np.where(turned[part], a, b) for a, b in (places[::-1], places))
            dense[self.word[mine]] = 0.0


def _by_text(texts: np.ndarray):
    """(pairs of one text, that text)."""
    order = np.argsort(texts, kind="stable")
    ends = [*(np.flatnonzero(np.diff(texts[order])) + 1).tolist(), len(order)]
    for a, b in zip([0, *ends[:-1]], ends):
        if b > a:
            yield order[a:b], texts[order[a]]


def _tile_scores(threshold: float):
    """Dot products of the pairs of a group, whose word lists come once each."""
    def scored(pairs: pa.Table, table: pa.Table) -> pa.Table:
        lists = _Lists(pairs, table)
        dots = np.zeros(len(pairs))
        for part, dot, _, _ in lists.products():
            dots[part] = dot
        # A pair that comes several times counts once.
        once = np.unique(lists.one * len(lists.ids) + lists.two, return_index=True)[1]
        near = once[dots[once] >= threshold - EQUAL]
        copies = table["copies"].combine_chunks()
        kept = pairs.select(["id1", "id2"]).take(pa.array(near))
        for name, side in (("copies1", lists.one), ("copies2", lists.two)):
            kept = kept.append_column(name, copies.take(pa.array(side[near])))
        return kept.append_column("similarity", pa.array(np.minimum(dots[near], 1.0)))
    return scored


def _tile_bounds(threshold: float):
    """The pairs of a group that can reach the threshold by what their prefixes share, each once.

    Let w be the most frequent word of both prefixes. Shared words that are not in both
    prefixes are more frequent than w, and none of them is in the prefix that ends first. So they
    add no more than the ``cut`` of that text times the rest of the other one behind w.
    """
    def bounded(found: pa.Table, table: pa.Table) -> pa.Table:
        lists = _Lists(pa.table({"id1": pc.list_flatten(found["id1s"]), "id2": pc.list_flatten(found["id2s"])}), table)
        lists.keep(np.unique(lists.one * len(lists.ids) + lists.two, return_index=True)[1])
        cut = table["cut"].to_numpy()
        # Entries run from frequent to rare words; the rest of an entry is the norm of the shared words before it.
        sums = np.concatenate([[0.0], np.cumsum(lists.u * lists.u)])
        rest = np.sqrt(sums[:-1] - np.repeat(sums[lists.start] - cut * cut, lists.end - lists.start) + MARGIN)
        near = np.zeros(len(lists.one), bool)
        for part, dot, place1, place2 in lists.products():
            # A cut without a bound times nothing is not a number.
            behind = np.fmax(cut[lists.one[part]] * rest[place2], cut[lists.two[part]] * rest[place1])
            near[part] = dot + behind >= threshold - MARGIN
        lists.keep(np.flatnonzero(near))
        _, listed = _runs_of(np.arange(len(lists.one)) // LISTED_PAIRS)
        return pa.table({f"{c}s": listed(lists.ids.take(pa.array(side))) for c, side in (("id1", lists.one), ("id2", lists.two))})
    return bounded


def _by_group(tiles: DataFrame, lists: DataFrame, found, schema: StructType) -> DataFrame:
    """What ``found`` makes of the pairs (group, id1, id2) or lists of each group, which fetches the words of a text once."""
    texts = F.col("texts") if "texts" in tiles.columns else F.array("id1", "id2")
    needed = tiles.select(F.col("group").alias("home"), F.explode(texts).alias("id")).distinct().join(lists, "id")
    return tiles.drop("texts").groupBy("group").cogroup(needed.groupBy("home")).applyInArrow(found, schema)


def _tile(chunks: Column) -> list[Column]:
    chunk = [chunk_of(F.col(c), chunks) for c in ("id1", "id2")]
    return [F.least(*chunk), F.greatest(*chunk)]


def _within_reach(candidates: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    """The candidates that can reach the threshold by their prefixes, a third of the words: lists (id1s, id2s), stored.

    Each group fetches the prefixes of its texts. All rows of a pair are in one group, where it counts once.
    """
    lists = packed.select(
        F.col("keeper").alias("id"), F.col("prefix.token_id").alias("tokens"), F.col("prefix.u").alias("us"), "cut")
    ids = ArrayType(packed.schema["keeper"].dataType)
    return stage(_by_group(
        candidates, lists, _tile_bounds(threshold), StructType().add("id1s", ids).add("id2s", ids)), "reach")


def score_pairs(candidates: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    """(id1, id2, copies1, copies2, similarity) of the candidates that reach the threshold.

    Candidates are stored lists, in which a pair may come several times. Most wrong ones leave by their prefixes alone. The components of the
    rest are kept together, so that a group of near copies fetches each word list about once, not
    once per pair. A component with more than ``TILE_WORDS`` words or many pairs is cut into chunks, and pairs
    of chunks are dealt to groups of a bounded number of words.
    """
    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = _within_reach(candidates, packed, threshold).select(F.inline(F.arrays_zip("id1s", "id2s"))).toDF("id1", "id2")
    ends = pairs.groupBy(F.col("id1").alias("id")).agg(F.count(F.lit(1)).alias("pairs"))
    texts = stage(
        connected_components(pairs)
        .join(packed.select(F.col("keeper").alias("id"), F.size("tokens").alias("words")), "id").join(ends, "id", "left")
        .select("cluster_id", "id", "words", F.coalesce("pairs", F.lit(0)).alias("pairs")), "texts")
    sized = stage(
        texts.groupBy("cluster_id").agg(
            F.count(F.lit(1)).alias("texts"), F.sum("words").alias("words"), F.sum("pairs").alias("pairs"))
        .select("cluster_id", "texts", F.greatest(
            chunk_count(F.col("words"), TILE_WORDS), F.ceil(F.sqrt(2 * F.col("pairs") / TILE_PAIRS)).cast("int")).alias("chunks"),
            "words"), "components")
    fetched = sized.agg(F.sum(F.col("words") * F.col("chunks"))).first()[0] or 0
    groups = max(parts, -(-fetched // GROUP_WORDS))
    first = stage(
        lookup(texts.where("pairs > 0").drop("words"), sized.drop("words"), "cluster_id", "texts")
        .select(F.col("id").alias("id1"), "cluster_id", "chunks", "pairs"), "first")
    tiles = stage(lookup(pairs, first, "id1", "pairs").select(
        F.pmod(F.xxhash64("cluster_id", *_tile(F.col("chunks"))), F.lit(groups)).alias("group"), "id1", "id2"), "tiles")
    lists = unit_lists(packed, "copies")
    schema = StructType([*pairs.schema]).add("copies1", packed.schema["copies"].dataType).add(
        "copies2", packed.schema["copies"].dataType).add("similarity", "double")
    return _by_group(tiles, lists, _tile_scores(threshold), schema)


def text_search(questions: DataFrame, threshold: float, id_col: str, text_col: str, hot_rows: int | None):
    """(packed vectors of the keepers, members of repeated texts), stored."""
    if check_threshold(threshold) <= 0:
        raise ValueError("text search needs a threshold above 0")
    keepers, members, total = distinct_texts(questions, id_col, text_col, hot_rows)
    spark = questions.sparkSession
    paths = [fresh_path(spark, name) for name in ("lists", "shared")]
    lists = word_lists(keepers, paths[0])
    packed = _packed(lists, shared_words(lists, paths[1]), total, threshold)
    for path in paths:
        drop(spark, path)
    return packed, members


def _copies(packed: DataFrame) -> DataFrame:
    """Repeated texts; a row in ``packed`` has a non-zero vector, so copies score 1."""
    return packed.where("copies > 1").select("keeper", "copies", F.lit(1.0).alias("similarity"))


def similar_texts(questions: DataFrame, threshold: float = 0.78, id_col: str = "question_id",
                  text_col: str = "question_text", chunk_rows: int = CHUNK_ROWS,
                  hot_rows: int | None = None) -> DataFrame:
    """All pairs (id1 < id2, similarity) of rows whose TF-IDF cosine is >= threshold."""
    pairs, members, copies = keeper_text_pairs(questions, threshold, id_col, text_col, chunk_rows, hot_rows)
    return expand_pairs(pairs, members, copies, chunk_rows)


def keeper_text_pairs(questions: DataFrame, threshold: float = 0.78, id_col: str = "question_id",
                      text_col: str = "question_text", chunk_rows: int = CHUNK_ROWS, hot_rows: int | None = None):
    """Pairs of distinct texts (id1, id2, similarity, copies1, copies2), members, and copy groups."""
    packed, members = text_search(questions, threshold, id_col, text_col, hot_rows)
    entries, crowded = prefix_entries(packed), crowded_words(packed, chunk_rows)
    met = pairs_in_buckets(
        sized_entries(entries.join(crowded, "token_id", "left_semi"), hot_rows), "token_id", "keeper", "size",
        reachable_there(threshold), chunk_rows=chunk_rows).select(F.col("keeper1").alias("id1"), F.col("keeper2").alias("id2"))
    runs = entries.join(crowded, "token_id", "left_anti")
    return scored_pairs(runs, run_pairs(threshold, "keeper"), met, packed, threshold), members, _copies(packed)


def text_clusters(questions: DataFrame, threshold: float = 0.78, id_col: str = "question_id",
                  text_col: str = "question_text", chunk_rows: int = CHUNK_ROWS,
                  hot_rows: int | None = None) -> DataFrame:
    """(cluster_id, id): connected components of ``similar_texts``, without listing all pairs.

    Texts are first compared with one text per shared word, which is linear and joins
    near copies. Then only texts of different groups so far can add anything, so the full
    search runs between groups and never within one.
    """
    packed, members = text_search(questions, threshold, id_col, text_col, hot_rows)
    entries, crowded = prefix_entries(packed), crowded_words(packed, chunk_rows)
    sized = sized_entries(entries.join(crowded, "token_id", "left_semi"), hot_rows)
    stars = stage(scored_pairs(entries.join(crowded, "token_id", "left_anti"), _run_stars(threshold),
                               _star_candidates(sized, threshold), packed, threshold), "stars")
    groups = connected_components(stars).select(F.col("cluster_id").alias("group"), F.col("id").alias("keeper"))
    # The prefix of a text is one row here, so that few rows meet their groups.
    grouped = prefix_entries(packed.select("keeper", "prefix").join(groups, "keeper", "left").withColumn(
        "group", F.coalesce("group", "keeper")))
    cut = stage(grouped.join(crowded, "token_id", "left_semi"), "grouped")
    between = scored_pairs(grouped.join(crowded, "token_id", "left_anti"), run_pairs(threshold, "group"),
                           _candidates_between_groups(cut, threshold, chunk_rows), packed, threshold)
    edges = stars.select("id1", "id2").unionByName(between.select("id1", "id2"))
    return clusters_of_keepers(packed, members, edges)


def _star_candidates(entries: DataFrame, threshold: float) -> DataFrame:
    """(id1, id2) of the smallest keeper of every word with each other keeper of the word."""
    star = stage(
        entries.groupBy("token_id").agg(
            F.min(F.struct("keeper", "u", *REST)).alias("hub"), F.count(F.lit(1)).alias("rows")), "hubs")
    met = lookup(entries.drop("size"), star, "token_id", "rows")
    near = _reachable(threshold)(F.col, lambda c: F.col(f"hub.{c}"))
    return met.where((F.col("keeper") > F.col("hub.keeper")) & near).select(
        F.col("hub.keeper").alias("id1"), F.col("keeper").alias("id2")).distinct()


def _candidates_between_groups(grouped: DataFrame, threshold: float, chunk_rows: int) -> DataFrame:
    """(id1, id2) that share a prefix word, are within reach and belong to different groups.

    Groups are paired per word first, each counted as one however many texts it has, by the
    largest values any of its texts has there; words of a single group drop out. Paired
    groups are then unfolded chunk by chunk.
    """
    sizes = stage(
        grouped.groupBy("token_id", "group").agg(
            F.count(F.lit(1)).alias("rows"), *[F.max(c).alias(c) for c in ("u", *REST)]), "group_sizes")
    words = stage(sizes.groupBy("token_id").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "words")
    shared = stage(lookup(sizes, words, "token_id", "size"), "shared")
    paired = pairs_in_buckets(
        shared, "token_id", "group", "size", _reachable(threshold), ("rows",), chunk_rows)
    for s in "12":
        last = chunk_count(F.col(f"rows{s}"), chunk_rows) - 1
        paired = paired.withColumn(f"chunk{s}", F.explode(F.sequence(F.lit(0), last)))
    mixed = shared.select("token_id", "group", "rows")
    texts = lookup(grouped, mixed, ["token_id", "group"], "rows").withColumn(
        "chunk", chunk_of(F.col("keeper"), chunk_count(F.col("rows"), chunk_rows)))
    for s in "12":
        side = texts.select(
            "token_id", *[F.col(c).alias(f"{c}{s}") for c in ("group", "chunk", "keeper", "u", *REST, "before")])
        paired = paired.join(side, ["token_id", f"group{s}", f"chunk{s}"])
    near = reachable_there(threshold)(lambda c: F.col(f"{c}1"), lambda c: F.col(f"{c}2"))
    return paired.where(near).select(
        F.least("keeper1", "keeper2").alias("id1"), F.greatest("keeper1", "keeper2").alias("id2")).distinct()
