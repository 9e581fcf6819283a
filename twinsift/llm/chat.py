"""Chat formatting in budgeted windows.

A turn is written as ``### role: text </turn>`` and a line break. Inside roles and texts the
characters that control strings start with are escaped by a backslash, so no text can write a
marker, and removing the backslashes gives the text back.

Prefix sums of turn tokens cut a conversation into spans of whole turns. A window holds the
system turn, the last turns before the span as far as the history budget reaches, and the span.
Only the assistant texts of the span are under the loss mask: what is repeated is masked out. Sums,
spans and history are found per range of tokens, so a conversation may hold any share of
the rows. A window exceeds the budget only by a single turn that is longer than its span budget.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from twinsift.lineage import stage
from twinsift.llm.common import whole
from twinsift.llm.tokens import encoder, vocabulary
from twinsift.operators.order import running_totals

WINDOW = 2048
HISTORY = 512

SYSTEM, ASSISTANT = "system", "assistant"
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*) </turn>\n", re.S)


def escape(text: str) -> str:
    return re.sub(r"[\\#<]", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def heading(role: str) -> str:
    return "### " + re.sub(r"[\\#<:]", r"\\\g<0>", role) + ": "


def written(role: str, text: str) -> str:
    return heading(role) + escape(text) + " </turn>\n"


def _counted(turns: DataFrame, path: str) -> DataFrame:
    """Adds the number of tokens of each written turn."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(written(role.as_py(), text.as_py())))
                     for role, text in zip(batch.column("role"), batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes, pa.int64())], names=[*batch.schema.names, "tokens"])

    return turns.mapInArrow(count, StructType([*turns.schema, StructField("tokens", LongType())]))


def spans(turns: DataFrame, window: int, history: int) -> DataFrame:
    """Adds ``system``, ``before`` (tokens before the turn), and ``span``, numbers that rise with the turns."""
    order = ["no_turn", "turn", "role", "tie"]
    placed = stage(running_totals(
        turns, order, {"position": F.lit(1).cast("bigint"), "all_before": F.col("tokens")}, within=["key"]), "turns")
    system = (F.col("position") == 0) & (F.col("role") == SYSTEM)
    per_key = placed.groupBy("key").agg(
        F.sum("tokens").alias("total"), F.max(F.when(system, F.col("tokens"))).alias("system_tokens"))
    room = F.greatest(F.lit(64), F.lit(window) - F.coalesce("system_tokens", F.lit(0)))
    step = F.greatest(F.lit(32), F.floor((room - history) / 2))
    end = F.col("before") + F.col("tokens")
    cell = F.floor(F.col("before") / F.col("step"))
    over = (end - cell * F.col("step") > 2 * F.col("step")).cast("bigint")
    return (
        placed.join(per_key, "key").withColumns({
            "system": system, "step": step,
            "before": F.when(system, F.lit(0)).otherwise(F.col("all_before") - F.coalesce("system_tokens", F.lit(0)))})
        # A conversation that fits is one span; a turn that leaves its cell too far is a span of its own.
        .withColumn("span", F.when(F.col("total") <= window, F.lit(0)).when(F.col("system"), F.lit(0))
                    .otherwise(2 * cell + over).cast("bigint")))


def windows(conversations: DataFrame, window: int = WINDOW, history: int = HISTORY, path: str | None = None) -> DataFrame:
    """(conv_id, window, text, repeat_chars, loss, tokens), one row per window.

    The first ``repeat_chars`` code points repeat earlier turns; ``loss`` lists (start, end) of the
    escaped assistant texts that are targets. A null text or role counts as empty, a null
    turn number comes last, null conversation ids are one conversation, rows that repeat are turns
    of their own, other columns are not read, and an empty table gives no rows.
    """
    path = path or vocabulary()
    source = conversations.select(
        F.struct(F.col("conv_id").isNull().alias("none"), F.col("conv_id").alias("id")).alias("key"),
        F.col("turn").isNull().alias("no_turn"), "turn", whole("role").alias("role"), whole("text").alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    turns = stage(spans(_counted(source, path), window, history), "turn-spans").withColumn(
        "end", F.col("before") + F.col("tokens"))
    # Turns are told apart by position; the system turn has the first one.
    target = turns.select("key", "span", "position", F.lit(False).alias("again"), "role", "text", "tokens")
    starts = turns.where(~F.col("system")).groupBy("key", "span").agg(
        F.min("before").alias("at"), F.min("position").alias("from"))
    starts = stage(starts, "span-starts")
    cell = lambda c: F.floor(c / F.lit(history)).cast("bigint")
    reaching = turns.where(~F.col("system") & (F.col("tokens") <= history)).withColumn(
        "cell", F.explode(F.sequence(cell(F.col("end")), cell(F.col("before") + history))))
    past = reaching.alias("t").join(
        starts.withColumn("cell", cell(F.col("at"))).alias("s"),
        (F.col("t.key") == F.col("s.key")) & (F.col("t.cell") == F.col("s.cell")) & (F.col("t.position") < F.col("s.from"))
        & (F.col("t.span") != F.col("s.span")) & (F.col("s.at") - F.col("t.before") <= history)).select(
        "t.key", "s.span", "t.position", F.lit(True).alias("again"), "t.role", "t.text", "t.tokens")
    system = turns.where("system").select("key", F.col("span").alias("own"), "position", "role", "text", "tokens")
    kept = starts.join(system, "key").where("span <> own").select(
        "key", "span", "position", F.lit(True).alias("again"), "role", "text", "tokens")
    rows = target.unionByName(past).unionByName(kept)
    grouped = rows.groupBy("key", "span").agg(
        F.sort_array(F.collect_list(F.struct("position", "again", "role", "text"))).alias("turns"),
        F.sum("tokens").alias("tokens"))
    loss = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, repeats, masks = [], [], []
            for members in batch.column("turns"):
                out, size, repeat, mask = [], 0, 0, []
                for member in members.as_py():
                    piece = written(member["role"], member["text"])
                    if member["again"]:
                        repeat += len(piece)
                    elif member["role"] == ASSISTANT:
                        start = size + len(heading(ASSISTANT))
                        mask.append({"start": start, "end": start + len(escape(member["text"]))})
                    out.append(piece)
                    size += len(piece)
                texts.append("".join(out))
                repeats.append(repeat)
                masks.append(mask)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").field(1), batch.column("span"), pa.array(texts, pa.string()),
                 pa.array(repeats, pa.int32()), pa.array(masks, loss), batch.column("tokens")],
                names=["conv_id", "window", "text", "repeat_chars", "loss", "tokens"])

    schema = StructType([
        StructField("conv_id", conversations.schema["conv_id"].dataType), StructField("window", LongType()),
        StructField("text", StringType()), StructField("repeat_chars", IntegerType()),
        StructField("loss", ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))),
        StructField("tokens", LongType())])
    return grouped.mapInArrow(write, schema)


def read_turns(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a written window; raises if anything else is in it."""
    found, at = [], 0
    while at < len(text):
        turn = TURN.match(text, at)
        if not turn:
            raise ValueError(f"no turn at {at}")
        found.append((unescape(turn[1]), unescape(turn[2])))
        at = turn.end()
    return found


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from windows.

    A hash over a whole conversation can only be taken in order, so the windows of one
    conversation stream through one task, which holds the state of the hash and nothing else.
    """
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    schema = StructType([
        StructField("conv_id", formatted.schema["conv_id"].dataType), StructField("n_turns", LongType()),
        StructField("turns_sha256", StringType()), StructField("loss_chars", LongType()),
        StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if state is None or state[0] != row["conv_id"]:
                    if state:
                        done.append(state)
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(row["text"][row["repeat_chars"]:]):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in row["loss"]:
                    target = unescape(row["text"][span["start"]:span["end"]])
                    state[3] += len(target)
                    state[4].update(target.encode("utf-8", "surrogatepass"))
                state[5] += len(row["text"])
            if done:
                yield _digest_rows(done, batch.schema.field("conv_id").type)
        if state:
            yield _digest_rows([state], batch.schema.field("conv_id").type)

    return ordered.mapInArrow(read, schema)


def _digest_rows(states: list[list], kind: pa.DataType) -> pa.RecordBatch:
    ids, turns, read, chars, loss, size = zip(*states)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, kind), pa.array(turns, pa.int64()), pa.array([h.hexdigest() for h in read]),
         pa.array(chars, pa.int64()), pa.array([h.hexdigest() for h in loss]), pa.array(size, pa.int64())],
        names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
