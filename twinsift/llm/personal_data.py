"""Personal data in texts, also where it is disguised, with offsets into the original text.

Each text is searched for e-mail addresses, IP addresses, card and phone numbers. A transducer then
rewrites disguises: letters and digits that look like others, invisible characters, spelled
digits, ``(at)`` and ``dot``. It keeps, for each piece of its output, the characters it came from.
Identifiers that the rewritten text holds and whose pieces include a rewritten one are mapped back
to the original characters and added.

All searches take time in proportion to the text: none starts again inside a run it has read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from twinsift.llm.common import field, whole

KINDS = ("email", "ip", "card", "phone")

# ---- plain identifiers --------------------------------------------------------------------

# The character classes of the four kinds.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[Span]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def addresses(text: str) -> Iterator[Span]:
    for run in DOTTED.finditer(text):
        parts = run.group().split(".")
        start = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in four)):
                yield "ip", start, end
            start = end + 1


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for found in CARD.finditer(text):
        digits = found.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and passes_luhn(digits):
            yield "card", found.start(), found.end()


def phones(text: str) -> Iterator[Span]:
    for found in PHONE.finditer(text):
        if 9 <= len(DIGIT.findall(found.group())) <= 15:
            yield "phone", found.start(), found.end()


def plain(text: str) -> list[Span]:
    """The identifiers of all kinds, leftmost and not overlapping within a kind."""
    found = list(emails(text)) if "@" in text else []
    if DIGIT.search(text):
        found += [*addresses(text), *cards(text)]
        if "+" in text:
            found += phones(text)
    return found


# ---- the transducer -----------------------------------------------------------------------

# Letters of other alphabets that look like the Latin letters beside them.
LOOKALIKES = dict(zip(
    "аеорсухіѕјһԁԛԝ" "АВЕКМНОРСТХІЅЈ" "οανρικτυ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ı",
    "aeopcyxisjhdqw" "ABEKMHOPCTXISJ" "oavpiktu" "ABEZHIKMNOPTYX" "i"))
INVISIBLE = "­​‌‍⁠﻿"

# The digits from zero to nine, spelled.
SPELLED = {word: str(digit) for words in (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
) for digit, word in enumerate(words.split())} | {"oh": "0", "zwo": "2"}

AT_WORDS = "at|arroba|chez|ät"
DOT_WORDS = "dot|punkt|punto|point"
DOT_SET = set(DOT_WORDS.split("|"))
_SPACE = r"[\x20\t]{1,3}"
_LABEL = r"[A-Za-z0-9-]{1,63}"
_NUMBER = "|".join(sorted(SPELLED, key=len, reverse=True))

BRACKETED = re.compile(
    rf"[\[({{<][\x20\t]{{0,3}}(?:(?P<at>@|{AT_WORDS})|(?P<dot>\.|{DOT_WORDS}))[\x20\t]{{0,3}}[\])}}>]", re.I)
# A bare "at" counts if a spelled dot follows the next word, or if the word before has a digit, a sign
# or an inner dot and a dotted name follows; a bare "dot" between two words counts as a dot.
BARE_AT = re.compile(
    rf"{_SPACE}(?:{AT_WORDS}){_SPACE}(?={_LABEL}(?:{_SPACE}(?:{DOT_WORDS}){_SPACE}|[\x20\t]{{0,3}}[\[({{<]))", re.I)
NAMED_AT = re.compile(rf"{_SPACE}(?:{AT_WORDS}){_SPACE}(?={_LABEL}\.[A-Za-z])", re.I)
SIGNED = re.compile(r"[0-9_%+-]|[^.]\.+[^.]")
BARE_DOT = re.compile(rf"(?<=[A-Za-z0-9]){_SPACE}(?:{DOT_WORDS}){_SPACE}(?=[A-Za-z0-9])", re.I)
PLUS = re.compile(rf"\bplus[\x20-]{{1,3}}(?=(?:{_NUMBER}|[0-9])\b)", re.I)
NUMBER = re.compile(rf"\b(?:{_NUMBER})\b", re.I)
GAP = re.compile(r"[\x20,-]{1,3}\Z")


@lru_cache(maxsize=1)
def lookalikes() -> dict[str, str]:
    """One-character rewrites: the fixed list, decimal digits of all scripts, and compatibility forms
    of printable ASCII characters; invisible characters vanish."""
    table = {chr(c): "" for c in map(ord, INVISIBLE)} | LOOKALIKES
    for code in range(0x80, 0x20000):
        char = chr(code)
        plain_form = unicodedata.normalize("NFKC", char)
        if len(plain_form) == 1 and "!" <= plain_form <= "~":
            table.setdefault(char, plain_form)
        elif unicodedata.decimal(char, None) is not None:
            table.setdefault(char, str(unicodedata.decimal(char)))
    return table


@lru_cache(maxsize=1)
def _unusual() -> re.Pattern:
    """A character outside ASCII and the Latin letters that stand for themselves."""
    usual = "".join(chr(c) for c in range(0x80, 0x250) if chr(c) not in lookalikes())
    return re.compile("[^\0-\x7f" + re.escape(usual) + "]")


def _spelled_run(words: list[str]) -> bool:
    """Whether spelled digits follow each other, or every other word is one."""
    flags = bytes(map(SPELLED.__contains__, words))
    return b"\1\1" in flags or b"\1\0\1\0\1" in flags


def signed_ats(text: str) -> Iterator[tuple[int, int]]:
    """Bare "at"s before a dotted name, after a word that looks like the start of an address."""
    free = 0
    for m in NAMED_AT.finditer(text):
        before = text[free:m.start()]
        word = before[len(before.rstrip(LOCAL)):]
        if word and not word.endswith(".") and SIGNED.search(word):
            yield m.span()
        free = m.end()


def rewrites(text: str) -> list[tuple[int, int, str]]:
    """(start, end, replacement) of the disguises in a text, in order and not overlapping."""
    found: list[tuple[int, int, str]] = []
    if not text.isascii() and _unusual().search(text):
        table = lookalikes()
        found += [(i, i + 1, table[c]) for i, c in enumerate(text) if c in table]
    if any(c in text for c in "[({<"):
        for m in BRACKETED.finditer(text):
            start = m.start() - (len(text[max(0, m.start() - 3):m.start()]) - len(
                text[max(0, m.start() - 3):m.start()].rstrip(" \t")))
            after = text[m.end():m.end() + 3]
            found.append((start, m.end() + len(after) - len(after.lstrip(" \t")), "@" if m.group("at") else "."))
    words = text.lower().replace("-", " ").replace(",", " ").split()
    if found or not DOT_SET.isdisjoint(words):
        found += [(m.start(), m.end(), "@") for m in BARE_AT.finditer(text)]
    found += [(start, end, "@") for start, end in signed_ats(text)]
    if _spelled_run(words):
        last = None
        for m in NUMBER.finditer(text):
            if last is not None and GAP.match(text, last, m.start()):
                found.append((last, m.start(), ""))
            found.append((m.start(), m.end(), SPELLED[m.group().lower()]))
            last = m.end()
        found += [(m.start(), m.end(), "+") for m in PLUS.finditer(text)]
    if found:
        found += [(m.start(), m.end(), ".") for m in BARE_DOT.finditer(text)]
    found.sort(key=lambda r: (r[0], -r[1]))
    kept, end = [], 0
    for rewrite in found:
        if rewrite[0] >= end:
            kept.append(rewrite)
            end = rewrite[1]
    return kept


def transduce(text: str, changes: list[tuple[int, int, str]]) -> tuple[str, list[tuple[int, int, int, bool]]]:
    """The rewritten text and its pieces (start in it, start, end in the original, rewritten)."""
    out, pieces, at, size = [], [], 0, 0
    for start, end, new in changes:
        if start > at:
            out.append(text[at:start])
            pieces.append((size, at, start, False))
            size += start - at
        if new:
            out.append(new)
            pieces.append((size, start, end, True))
            size += len(new)
        at = end
    if at < len(text):
        out.append(text[at:])
        pieces.append((size, at, len(text), False))
    return "".join(out), pieces


def disguised(text: str) -> list[Span]:
    """Identifiers that only show after rewriting, at their original characters."""
    changes = rewrites(text)
    if not changes:
        return []
    normal, pieces = transduce(text, changes)
    starts = [p[0] for p in pieces]
    cuts = [i for i, p in enumerate(pieces) if p[3]]
    found = []
    for kind, a, b in plain(normal):
        first, last = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
        i = bisect_right(cuts, first - 1)
        joins = any(pieces[j][2] != pieces[j + 1][1] for j in range(first, last))
        if not joins and (i == len(cuts) or cuts[i] > last):
            continue
        start = pieces[first][1] + (0 if pieces[first][3] else a - pieces[first][0])
        end = pieces[last][2] if pieces[last][3] else pieces[last][1] + b - pieces[last][0]
        found.append((kind, start, end))
    return found


def personal_data(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, added) by start, then kind; added spans lie in no plain one of their kind."""
    base = plain(text)
    of_kind = {kind: [s for s in base if s[0] == kind] for kind in KINDS}
    starts = {kind: [s[1] for s in spans] for kind, spans in of_kind.items()}

    def covered(kind: str, start: int, end: int) -> bool:
        # Plain spans of a kind do not overlap: only the last one that starts here or before can hold it.
        before = bisect_right(starts[kind], start)
        return before > 0 and end <= of_kind[kind][before - 1][2]

    more = [s for s in disguised(text) if not covered(*s)]
    spans = [(*s, False) for s in base] + [(*s, True) for s in more]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# ---- the job ------------------------------------------------------------------------------

SPANS = ArrayType(StructType([
    StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()),
    StructField("added", BooleanType())]))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): for every row the spans (kind, start, end, added) in code points, end exclusive.

    Null and empty texts have no spans, repeated rows are searched each, other columns are not
    read, and an empty table gives no rows.
    """
    source = docs.select(field(id_col), whole(text_col).alias("_text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "added"), s)) for s in personal_data(text.as_py())]
                     for text in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=[id_col, "spans"])

    return source.mapInArrow(searched, StructType([source.schema[id_col], StructField("spans", SPANS)]))


def span_list(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
