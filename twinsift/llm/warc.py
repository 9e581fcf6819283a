"""WARC archives: writing pages as records, reading records, and reassembling segments.

A page becomes a ``response`` record whose block is an HTTP message in chunked transfer framing,
or a ``revisit`` record without body if another record of the archive holds an equal payload. A block
longer than a segment is cut into a first record and ``continuation`` records, which
name the first record's id, their number, and in the last one the total length.

Archives are written and read with Spark's text source, records apart by their version
line, so every store that Spark reaches will do and no file is held as a whole. The
writer keeps that line out of payloads by ending a chunk inside it. For foreign
archives the reader joins a record that the line has cut, if the pieces end where its declared
length does. Otherwise the record was cut short: it is returned as far as it goes and marked, and the
records behind it are read on their own.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import deque
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, MapType, StringType, StructField, StructType

from twinsift.lineage import stage
from twinsift.llm.common import whole
from twinsift.operators.skew import lookup

VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SEGMENT = 16_384
CHUNK = 4_096
SMALLEST_REVISIT = 1_000
RECORDS_PER_FILE = 2_000
# A record that declares more than this is damaged; a longer one fits no binary value.
LONGEST_BLOCK = 2**31 - 1


# ---- framing ------------------------------------------------------------------------------


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing; a chunk also ends inside any record version line of the payload."""
    out, at = [], 0
    while at < len(payload):
        end = min(len(payload), at + size)
        line = payload.find(VERSION, at, end + len(VERSION))
        if line >= 0:
            end = min(end, line + 4)
        out += [b"%x\r\n" % (end - at), payload[at:end], b"\r\n"]
        at = end
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body with its extensions and trailers dropped; None if it is cut short."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            size = int(body[at:line].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        if size <= 0:
            return None if size else b"".join(out)
        start = line + 2
        if len(body) < start + size:
            return None
        out.append(body[start:start + size])
        at = start + size + 2


def headers_of(raw: bytes) -> dict[str, str]:
    """Fields by lower-case name, continuation lines joined."""
    found: dict[str, str] = {}
    name = None
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def payload_of(block: bytes) -> tuple[dict[str, str], bytes | None]:
    """HTTP fields and payload of a block."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = headers_of(head.partition(b"\r\n")[2])
    if "chunked" in fields.get("transfer-encoding", "").lower():
        return fields, unchunked(body)
    return fields, body


# ---- writing ------------------------------------------------------------------------------


def _uri(url: str) -> str:
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m.group()):02X}", url)


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", len(block))] if value is not None]
    return VERSION + "".join(lines).encode() + b"\r\n" + block


def _records(row: dict, segment: int, date: str) -> Iterator[bytes]:
    payload = row["html"].encode()
    name = f"<urn:uuid:{uuid.uuid4()}>"
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            b"X-Payload-Length: %d\r\nTransfer-Encoding: chunked\r\n\r\n" % len(payload))
    revisit = row["refers_to"] is not None
    block = http if revisit else http + chunked(payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name), ("WARC-Date", date),
        ("WARC-Target-URI", None if row["url"] is None else _uri(row["url"])),
        ("WARC-Payload-Digest", f"sha1:{row['digest']}"), ("X-Page-Id", row["page_id"]),
        ("Content-Type", "application/http; msgtype=response"),
        *([("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page-Id", row["refers_to"])] if revisit else [])]
    parts = [block[i:i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        yield _record(fields, block)
        return
    yield _record([*fields, ("WARC-Segment-Number", 1)], parts[0])
    for number, part in enumerate(parts[1:], 2):
        yield _record([
            ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date),
            ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", number),
            ("WARC-Segment-Total-Length", len(block) if number == len(parts) else None)], part)


def with_revisits(pages: DataFrame, smallest: int = SMALLEST_REVISIT) -> DataFrame:
    """(page_id, url, html, digest, refers_to): of equal payloads the largest page id responds."""
    rows = pages.select("page_id", "url", whole("html").alias("html")).withColumn(
        "digest", F.sha1(F.col("html").cast("binary")))
    groups = stage(
        rows.where(F.octet_length("html") >= smallest).groupBy("digest", F.octet_length("html").alias("bytes"))
        .agg(F.max("page_id").alias("responder"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "repeated-pages")
    sized = rows.withColumn("bytes", F.octet_length("html"))
    return lookup(sized, groups, ["digest", "bytes"], "rows", how="left").select(
        "page_id", "url", "html", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("responder")), F.col("responder")).alias("refers_to"))


def write_archive(pages: DataFrame, path: str, segment: int = SEGMENT, smallest: int = SMALLEST_REVISIT,
                  records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write a record per row of (page_id, url, html) as gzip archives below ``path``.

    Null html is an empty payload; null ids and urls are left out of the record. Rows that
    repeat are records of their own, and of rows that share the responding page id
    all are responses. Other columns are not read; an empty table writes no record.
    """
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                records = list(_records(batch.slice(row, 1).to_pylist()[0], segment, date))
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

    records = with_revisits(pages, smallest).mapInArrow(write, "record binary")
    # The text source writes the bytes as they are and ends each record by two line breaks.
    (records.select(F.col("record").cast("string").alias("value")).write
     .option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path))


# ---- reading ------------------------------------------------------------------------------

RECORD = StructType([StructField("fields", MapType(StringType(), StringType())), StructField("block", BinaryType()),
                     StructField("cut", BooleanType())])


class _Records:
    """Records out of the pieces between version lines, which come file by file."""

    def __init__(self):
        self.found: list[tuple[dict, bytes, bool]] = []
        self.file = None
        self.waiting: deque[bytes] = deque()
        self._drop()

    def _drop(self) -> None:
        self.fields, self.size, self.pieces, self.length = None, 0, [], 0

    def add(self, file: str, piece: bytes) -> None:
        if file != self.file:
            self.end()
            self.file = file
        self.waiting.append(piece)
        self._work()

    def end(self) -> None:
        """No piece follows that could belong to the held record."""
        while self.fields is not None:
            self._cut()
            self._work()

    def take(self) -> list[tuple[dict, bytes, bool]]:
        found, self.found = self.found, []
        return found

    def _work(self) -> None:
        while self.waiting:
            piece = self.waiting.popleft()
            if self.fields is None:
                self._open(piece)
                continue
            self.pieces.append(piece)
            self.length += len(VERSION) + len(piece)
            if self.length >= self.size:
                self._close()

    def _open(self, piece: bytes) -> None:
        head, gap, rest = piece.partition(b"\r\n\r\n")
        fields = headers_of(head)
        size = fields.get("content-length", "")
        if not gap or not size.isdecimal() or len(size) > 18 or int(size) > LONGEST_BLOCK:
            if any(name.startswith("warc-") for name in fields):
                self.found.append((fields, rest, True))
        elif len(rest) >= int(size):
            self.found.append((fields, rest[:int(size)], False))
        else:
            self.fields, self.size, self.pieces, self.length = fields, int(size), [rest], len(rest)

    def _close(self) -> None:
        block = VERSION.join(self.pieces)
        if block[self.size:].strip(b"\r\n"):
            self._cut()
        else:
            self.found.append((self.fields, block[:self.size], False))
            self._drop()

    def _cut(self) -> None:
        """Give up the held record; the pieces that were joined to it wait to be read as records."""
        self.found.append((self.fields, self.pieces[0], True))
        self.waiting.extendleft(reversed(self.pieces[1:]))
        self._drop()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(fields, block, cut) of every record of the archives below ``path``.

    ``cut`` marks a record that ends before its declared length, or declares none.
    """
    lines = spark.read.option("lineSep", VERSION.decode()).text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
    kind = pa.schema([("fields", pa.map_(pa.string(), pa.string())), ("block", pa.binary()), ("cut", pa.bool_())])

    def rows_of(found: list[tuple[dict, bytes, bool]]) -> pa.RecordBatch:
        columns = [[list(f.items()) for f, _, _ in found], [b for _, b, _ in found], [c for _, _, c in found]]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, kind)], schema=kind)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = _Records()
        for batch in batches:
            for file, value in zip(batch.column("file"), batch.column("value")):
                records.add(file.as_py(), value.as_py())
            yield rows_of(records.take())
        records.end()
        yield rows_of(records.take())

    return lines.mapInArrow(parse, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """(fields, http, payload, payload_digest, complete), one row per logical record.

    Continuation records are grouped by the id of their origin, ordered by number and joined.
    A record is complete if it is not cut, its segments are numbered without a gap, add up to the
    declared total length, and its chunks end. Otherwise its payload is null. A segment that occurs
    twice counts once. Continuations whose first segment is missing are one incomplete record,
    with the fields of the earliest of them.
    """
    number = F.col("fields")["warc-segment-number"]
    single = records.where(number.isNull()).select(
        "fields", F.array("block").alias("blocks"), (~F.col("cut")).alias("whole"))
    parts = records.where(number.isNotNull()).select(
        F.coalesce(F.col("fields")["warc-segment-origin-id"], F.col("fields")["warc-record-id"]).alias("origin"),
        F.expr("try_cast(fields['warc-segment-number'] AS int)").alias("number"), "block", "fields", "cut")
    joined = parts.groupBy("origin").agg(
        F.sort_array(F.collect_set(F.struct("number", "block"))).alias("parts"),
        F.max(F.expr("try_cast(fields['warc-segment-total-length'] AS bigint)")).alias("total"), F.max("cut").alias("cut"),
        F.min(F.struct("number", F.map_entries("fields").alias("entries"))).alias("earliest"))
    sizes = F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + F.octet_length(p["block"]))
    numbers = F.transform("parts", lambda p: p["number"])
    sound = ~F.col("cut") & (sizes == F.col("total")) & (numbers == F.sequence(F.lit(1), F.size("parts")))
    segmented = joined.select(
        F.map_from_entries("earliest.entries").alias("fields"), F.transform("parts", lambda p: p["block"]).alias("blocks"),
        F.coalesce(sound, F.lit(False)).alias("whole"))
    rows = single.unionByName(segmented)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            http, payloads, digests = [], [], []
            for blocks, complete in zip(batch.column("blocks"), batch.column("whole")):
                found, payload = payload_of(b"".join(blocks.as_py()))
                payload = payload if complete.as_py() else None
                http.append(list(found.items()))
                payloads.append(payload)
                digests.append(None if payload is None else hashlib.sha1(payload).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("fields"), pa.array(http, pa.map_(pa.string(), pa.string())),
                 pa.array(payloads, pa.binary()), pa.array(digests, pa.string()),
                 pa.array([p is not None for p in payloads], pa.bool_())],
                names=["fields", "http", "payload", "payload_digest", "complete"])

    strings = MapType(StringType(), StringType())
    return rows.mapInArrow(decode, StructType([
        StructField("fields", strings), StructField("http", strings), StructField("payload", BinaryType()),
        StructField("payload_digest", StringType()), StructField("complete", BooleanType())]))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of written archives.

    A revisit has no payload of its own: its size and digest are those it declares. A
    response whose payload differs from its declared digest is an error.
    """
    records = reassemble(read_records(spark, path))
    of = lambda name: F.col("fields")[name]
    revisit = of("warc-type") == "revisit"
    declared = F.substring_index(of("warc-payload-digest"), ":", -1)
    sound = F.col("complete") & (F.col("payload_digest") == declared)
    digest = F.when(revisit, declared).when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.concat(
        F.lit("damaged record "), of("warc-record-id"))))
    return records.select(
        of("x-page-id").cast(LongType()).alias("page_id"), of("warc-target-uri").alias("url"),
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.when(revisit, F.col("http")["x-payload-length"].cast("bigint")).otherwise(
            F.octet_length("payload").cast("bigint")).alias("payload_bytes"),
        digest.alias("payload_digest"), of("warc-type").alias("record_type"),
        of("x-refers-to-page-id").cast(LongType()).alias("refers_to"))


def resolve_revisits(pages: DataFrame) -> DataFrame:
    """Pages as read, the size and digest of every revisit taken from its response.

    ``pages`` should be a stored table. A revisit whose response is missing or has another digest
    than the one it declares is an error.
    """
    plain = pages.where("record_type <> 'revisit' or record_type is null")
    revisits = pages.where("record_type = 'revisit'")
    key = ["refers_to", "payload_digest"]
    counted = revisits.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
    responses = plain.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("found"))
    known = stage(counted.join(responses, key, "left"), "responses")
    size = F.coalesce("found", F.raise_error(F.concat(
        F.lit("no response for the revisit of page "), F.coalesce(F.col("refers_to").cast("string"), F.lit("null")))).cast("bigint"))
    resolved = lookup(revisits, known, key, "rows", how="left").withColumn("payload_bytes", size)
    return plain.unionByName(resolved.select(*plain.columns))
