"""Best-fit packing of documents into token sequences.

A document is its token ids and an end id. Longer ones than a sequence are cut into full pieces
and one shorter first piece. What is then to be packed is known by its histogram of lengths,
at most one number per possible length, so the plan is made on that histogram at any scale:

1. Martello and Toth's dominance reduction fixes sequences that some best packing holds.
   For a length: with the one that fills the sequence exactly; with the longest that fits if
   no second one fits beside it; with that one if it is at least as long as every pair that
   fits while no three fit; alone if nothing fits. This is repeated until nothing more is fixed.
2. Where no such set dominates, best fit decreasing packs what is left.

The plan says how many sequences hold which lengths. Pieces are numbered within their length
(over ranges, so one length may hold any share of the rows) and each number is looked up in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.lineage import stage
from twinsift.llm.common import field, whole
from twinsift.llm.tokens import encoder, vocabulary
from twinsift.operators.order import with_position

SEQUENCE = 2048
END_ID = 0

Pattern = tuple[int, ...]


# ---- the plan -----------------------------------------------------------------------------


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Fixed (lengths, sequences) and the histogram of what no dominating set was found for.

    A set that dominates for one document dominates for every other of its length while
    its members last, since taking sets away only leaves fewer alternatives.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    fixed: list[tuple[Pattern, int]] = []
    found = True
    while found:
        found = False
        for n in sorted(left, reverse=True):
            while left.get(n):
                partner = _dominating_partner(n, left, capacity)
                if partner is None:
                    break
                if not partner:
                    times = left[n] if 2 * n > capacity else 1
                    pattern = (n,)
                else:
                    times = left[n] // 2 if partner == n else min(left[n], left[partner])
                    pattern = (max(n, partner), min(n, partner))
                found = True
                fixed.append((pattern, times))
                for length in pattern:
                    left[length] -= times
                for length in set(pattern):
                    if not left[length]:
                        del left[length]
    return fixed, left


def _dominating_partner(n: int, left: dict[int, int], capacity: int) -> int | None:
    """The length that makes a dominating set with ``n``, 0 if ``n`` alone is one, None if unknown."""
    room = capacity - n
    others = sorted(length for length, count in left.items() if length <= room and count > (length == n))
    if not others:
        return 0
    best = others[-1]
    if best == room:
        return best
    spare = {length: left[length] - (length == n) for length in others}
    smallest = _smallest(spare, others, 3)
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return best
    if (len(smallest) < 3 or sum(smallest) > room) and best >= _longest_pair(spare, others, room):
        return best
    return None


def _smallest(left: dict[int, int], lengths: list[int], n: int) -> list[int]:
    found: list[int] = []
    for length in lengths:
        found += [length] * min(left[length], n - len(found))
        if len(found) == n:
            break
    return found


def _longest_pair(left: dict[int, int], lengths: list[int], room: int) -> int:
    best, i, j = 0, 0, len(lengths) - 1
    while i <= j:
        total = lengths[i] + lengths[j]
        if total > room or (i == j and left[lengths[i]] < 2):
            j -= 1
        else:
            best, i = max(best, total), i + 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """(lengths, sequences) by best fit decreasing, whole classes of equal sequences at a time."""
    rooms: list[int] = []
    classes: dict[int, list[tuple[Pattern, int]]] = {}

    def put(pattern: Pattern, room: int, times: int) -> None:
        if times:
            if room not in classes:
                classes[room] = []
                insort(rooms, room)
            classes[room].append((pattern, times))

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                pattern, times = classes[room].pop()
                if not classes[room]:
                    del classes[room]
                    rooms.pop(at)
            else:
                pattern, room, times = (), capacity, todo
            each = room // length
            full = min(times, todo // each)
            put(pattern + (length,) * each, room - each * length, full)
            todo -= full * each
            if full < times and 0 < todo < each:
                put(pattern + (length,) * todo, room - todo * length, 1)
                todo, full = 0, full + 1
            if pattern:
                put(pattern, room, times - full)
    return [entry for entries in classes.values() for entry in entries]


def plan(counts: dict[int, int], capacity: int = SEQUENCE) -> list[tuple[Pattern, int]]:
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def slots(patterns: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """Per length the rows (first number, first sequence, offset): where its pieces lie by number."""
    used: dict[int, int] = {}
    found: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            number = used.get(length, 0)
            found.setdefault(length, []).append((number, sequence, offset))
            used[length] = number + times
            offset += length
        sequence += times
    return {length: np.array(rows, dtype=np.int64) for length, rows in found.items()}


# ---- the jobs -----------------------------------------------------------------------------

PIECES = "piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text",
                 path: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32): one row per piece of a document.

    Null text counts as empty: a piece holding the end id alone.
    """
    path = path or vocabulary()
    source = docs.select(field(id_col).alias("id"), whole(text_col).alias("text"))
    schema = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            rows, pieces, starts, lengths, sums = [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                ids = np.array([*encode(text.as_py()), END_ID], dtype="<u4")
                edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for piece, (start, end) in enumerate(zip(edges, edges[1:])):
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(start)
                    lengths.append(end - start)
                    sums.append(zlib.crc32(ids[start:end].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()),
                 *[pa.array(x, pa.int64()) for x in (starts, lengths, sums)]], names=["id", *schema.names])

    kind = dict(source.dtypes)["id"]
    return source.mapInArrow(cut, f"id {kind}, {PIECES}")


def pack(docs: DataFrame, capacity: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text",
         path: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): every piece with its place.

    Repeated rows are packed once each, a null id like any other, other columns are not
    read, and an empty table gives no rows.
    """
    pieces = stage(token_pieces(docs, capacity, id_col, text_col, path), "pieces")
    counts = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}
    places = slots(plan(counts, capacity))
    numbered = with_position(pieces, ["id", "piece", "ids_crc32"], "number", within=["length"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            number = batch.column("number").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                rows, table = np.flatnonzero(length == n), places[int(n)]
                slot = table[np.searchsorted(table[:, 0], number[rows], side="right") - 1]
                sequence[rows] = slot[:, 1] + number[rows] - slot[:, 0]
                offset[rows] = slot[:, 2]
            names = [c for c in batch.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"])

    kind = dict(pieces.dtypes)["id"]
    return numbered.mapInArrow(place, f"id {kind}, {PIECES}, sequence_id long, offset long").withColumnRenamed(
        "id", id_col)
