"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Pure per-text work, so one map over the texts without a shuffle. All scans are
linear in the text, also for long runs of digits or of address characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import blocks, slim

#: fixed values: kinds in report order; the first four are always kept once their checks hold
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
#: fixed values: score of a span whose pattern and checksum hold, before context
START_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
#: fixed values: words that raise or lower the score of a kind when they stand near a span
CONTEXT = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "server", "host", "address", "adresse"),
    "card": ("card", "visa", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "telefon", "llamar"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social security"),
}
AGAINST = {"ip": ("version", "release"), "card": ("isbn", "order", "serial"), "phone": ("fax",), "ssn": ("part", "order"), "iban": (), "email": ("example",)}
RAISE, LOWER_BY, NEAR = 0.3, 0.3, 48
#: spans of the added kinds need this score
MIN_SCORE = 0.5

# fixed values: the contract's patterns, written so that a failed attempt is not repeated inside a run
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


def luhn(digits: str) -> bool:
    """Luhn check: every second digit from the right doubled, digit sums add up to a multiple of 10."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 mod-97-10: first four characters to the end, letters as 10 to 35, remainder 1."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            done = m.end()
            yield start, done


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest part of each proposed span, cut at a space, that the checksum confirms: the pattern also takes words that follow."""
    m = _IBAN.search(text)
    while m:
        a, b = m.span()
        while 15 <= len(s := text[a:b].replace(" ", "")) and not (len(s) <= 34 and mod97(s)):
            b = max(a, text.rfind(" ", a, b))
        if len(s) >= 15:
            yield a, b
            m = _IBAN.search(text, b)
        else:
            m = _IBAN.search(text, a + 1)


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b
    for m in _IP.finditer(text):
        if all(map(_byte, m[0].split("."))):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for a, b in _ibans(text):
        yield "iban", a, b
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", m.start(), m.end()


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """All accepted spans (kind, start, end, score), code points, end exclusive, by kind, then start."""
    out = []
    for kind, a, b in _proposed(text):
        near = f"{text[max(0, a - NEAR) : a]} {text[b : b + NEAR]}".lower()
        score = START_SCORE[kind] + RAISE * any(w in near for w in CONTEXT[kind]) - LOWER_BY * any(w in near for w in AGAINST[kind])
        if kind in BASE or score >= MIN_SCORE:
            out.append((kind, a, b, round(min(max(score, 0.0), 1.0), 3)))
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def find(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of every row's whole text (a null or empty text has none).

    Rows are kept one to one, repeated rows and null ids included; further columns of
    the input are not carried. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            found = [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in spans(t.decode("utf-8", "replace"))] for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(_SPAN))], ["doc_id", "spans"])

    return slim(docs).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>")


def joined(found: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def report(found: DataFrame) -> DataFrame:
    """Counts by base kind, digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [_count(kind).alias(f"n_{kind}") for kind in BASE]
    scores = F.concat_ws(",", F.transform("spans", lambda s: s["score"].cast("string")))
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores.alias("scores"))
