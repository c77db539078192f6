"""Personal data: regular expressions propose spans, validators confirm them, words nearby adjust their score.

Every pattern is looked for in time proportional to the text. Base kinds are the leftmost matches that pass their validator;
where a base match fails because it runs on into its neighbour, narrower readings of it are tried, and bank account
numbers are looked for besides. Those are kept if their score, adjusted by words nearby, is high enough.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in the order in which they are listed, the base ones first.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "pan", "tel", "ssn", "iban")
#: What each kind is proposed by.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
TEL = re.compile(r"(\+[0-9]{1,3} ?\([0-9]{2,4}\) ?[0-9]{3}-[0-9]{4})(?![0-9])")
SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
IBAN_HEAD = re.compile(r"[A-Z]{2}[0-9]{2}")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
#: How long account numbers of these countries are.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28,
    "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}


@dataclass(frozen=True)
class Context:
    """The score of a kind, and the words that raise or lower it."""

    score: float
    more: tuple[str, ...]
    less: tuple[str, ...] = ()


CONTEXTS = {
    "email": Context(0.8, ("mail", "contact", "write", "address")),
    "ip": Context(0.6, ("ip", "host", "server", "login"), ("version", "release", "build")),
    "card": Context(0.7, ("card", "visa", "mastercard", "payment", "expires"), ("order", "invoice", "tracking")),
    "phone": Context(0.6, ("phone", "call", "tel", "mobile", "fax")),
    "pan": Context(0.6, ("card", "visa", "mastercard", "payment", "expires"), ("order", "invoice", "tracking")),
    "tel": Context(0.6, ("phone", "call", "tel", "mobile", "fax")),
    "ssn": Context(0.3, ("ssn", "social security", "taxpayer")),
    "iban": Context(0.8, ("iban", "account", "bank", "bic")),
}
#: How many code points before a span are looked at, and what a word found there changes.
NEARBY, STEP, LEAST = 40, 0.3, 0.5
_WORDS = {kind: [re.compile(r"(?<![a-z])(?:" + "|".join(words) + r")(?![a-z])") if words else None for words in (c.more, c.less)] for kind, c in CONTEXTS.items()}


def luhn(digits: str) -> bool:
    """Whether the digits, every second one from the right but one doubled, sum up to a multiple of ten."""
    total = 0
    for k, x in enumerate(reversed(digits)):
        d = int(x) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number without blanks has the right check digits."""
    return int("".join(str(int(x, 36)) for x in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @: what stands before it belongs to the address back to the last match or other @."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        free = at + 1
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", free)


def _card_digits(span: str) -> str:
    """The digits of a span if they may be a card's, else nothing."""
    digits = span.replace(" ", "").replace("-", "") if len(span) < 40 else ""
    return digits if 14 <= len(digits) <= 19 and luhn(digits) else ""


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of all valid spans; those of one base kind don't overlap."""
    for start, end in emails(text):
        yield "email", start, end
    for m in IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if _card_digits(m[0]):
            yield "card", *m.span()
            continue
        if SSN.fullmatch(m[0]) and m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", *m.span()
        for part in DIGITS.finditer(m[0]):
            if _card_digits(part[0]):
                yield "pan", m.start() + part.start(), m.start() + part.end()
    for m in PHONE.finditer(text):
        if 10 <= sum(map(m[0].count, "0123456789")) <= 15:
            yield "phone", *m.span()
        elif narrow := TEL.match(text, m.start()):
            yield "tel", *narrow.span(1)
    for m in filter(None, (IBAN.match(text, head.start()) for head in IBAN_HEAD.finditer(text))):
        account, length = m[0].replace(" ", ""), IBAN_LENGTHS.get(m[0][:2], 99)
        if length <= len(account) and mod97(account[:length]):
            end = next(k for k in range(length, len(m[0]) + 1) if k - m[0].count(" ", 0, k) == length)
            yield "iban", m.start(), m.start() + end


def find_spans(text: str, least: float = LEAST) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind: all base spans, and others whose score is at least least."""
    out = []
    for kind, start, end in proposed(text):
        near = text[max(0, start - NEARBY) : start].lower()
        more, less = _WORDS[kind]
        score = CONTEXTS[kind].score + STEP * bool(more and more.search(near)) - STEP * bool(less and less.search(near))
        if kind in BASE or score >= least - 1e-9:
            out.append((kind, start, end, round(min(max(score, 0.0), 1.0), 2)))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def find_personal_data(docs: DataFrame, path: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """path and findings, an array of (kind, start, end, score), for each row of docs; places in code points, end exclusive.

    Whole texts are searched, each in time proportional to its length, without a shuffle. A null text is an empty one and has
    no findings; rows with null paths and repeated rows keep a row each; an empty table gives an empty one; other columns
    aren't read.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in find_spans(t or "", least)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(SPAN))], [path, "findings"])

    rows = docs.select(F.col(f"`{path}`"), F.col(f"`{text}`"))
    return rows.mapInArrow(found, f"`{path}` {rows.schema[0].dataType.simpleString()}, findings array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def mask_personal_data(docs: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets (of spans that overlap, the first one's), all else as it was.

    Null texts stay null; columns may have any names; rows are rows, however often they come.
    """

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                parts, upto = [], 0
                for kind, start, end, _ in find_spans(t or "", least):
                    if start >= upto:
                        parts += [t[upto:start], f"<{kind}>"]
                    upto = max(upto, end)
                out.append(t if t is None else "".join([*parts, t[upto:]]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(1)], ["masked", "row"])

    rows = docs.select(F.col(f"`{text}`").alias("masked"), F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row"))
    out = rows.mapInArrow(masked, rows.schema)
    return out.select(*(F.col("masked").alias(x) if x == text else F.col("row").getField(x).alias(x) for x in docs.columns))
