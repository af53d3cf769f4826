"""Helpers shared by the operators: byte-level word splitting, word and n-gram hashes.

Everything works on whole texts as UTF-8 bytes. Texts are joined with one
space after each, so no word spans two texts, and are handled in blocks of
texts of about ``BLOCK`` bytes (a longer text is a block of its own).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2 << 20
#: bytes that are hashed at once
PIECE = 1 << 19
#: words from so many bytes on are hashed by XXH64: sums of value * base^position are equal for some pairs of
#: words of 2^k bytes, whatever the base, where k is large
LONG_WORD = 64

_U = np.uint64
# a fixed random value per byte and an odd base; the hashes are sums of value * base^position mod 2^64
_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[LOWER]


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of the bytes that are word bytes: all but the given inclusive ranges."""
    out = np.ones(256, bool)
    for a, b in ranges:
        out[a : b + 1] = False
    return out


#: words ``[^\x20\x09-\x0D]+``
NON_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64, grown by doubling and kept per worker."""
    p = _powers.get(base)
    if p is None:
        p = np.ones(1, np.uint64)
    while len(p) < n:
        p = np.concatenate([p, p * _U(pow(base, len(p), 2**64))])
    _powers[base] = p
    return p[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (a fixed bijection)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """Words of a block of texts: byte spans, 64-bit hashes, and the first word of each text."""

    def __init__(self, texts: list[bytes], word: np.ndarray, lower: bool, hashes: bool = True):
        self.raw = b" ".join(texts) + b" "
        self.buf = np.frombuffer(self.raw, np.uint8)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offs = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(lens + 1, out=self.offs[1:])
        inside = np.empty(len(self.buf) + 1, bool)
        inside[0] = False
        np.take(word, self.buf, out=inside[1:])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.start, self.offs)
        self._bytes = _BYTE_LOWER if lower else _BYTE
        if hashes:
            (self.hash,) = self.hashes(None)

    def hashes(self, *lengths: int | None) -> list[np.ndarray]:
        """Hashes of the words' first bytes (of whole words for None, and of words that are shorter).

        ``LONG_WORD`` bytes and more are hashed one by one. Worked out for runs of words of about ``PIECE`` bytes, so that memory doesn't grow with the texts.
        """
        out = [np.empty(len(self), np.uint64) for _ in lengths]
        a = 0
        while a < len(self):
            zero = int(self.start[a])
            b = max(a + 1, int(np.searchsorted(self.start, zero + PIECE)))
            raw = self.buf[zero : self.end[b - 1]]
            acc = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(self._bytes[raw] * powers(_BASE, len(raw)), out=acc[1:])
            start, end = self.start[a:b] - zero, self.end[a:b] - zero
            back = powers(_BASE_INV, len(raw) + 1)[start]
            for h, n in zip(out, lengths):
                to = end if n is None else np.minimum(start + n, end)
                h[a:b] = mix((acc[to] - acc[start]) * back)
            a = b
        for h, n in zip(out, lengths):
            if n is None or n >= LONG_WORD:
                for k in np.flatnonzero(self.end - self.start >= LONG_WORD).tolist():
                    word = self.raw[self.start[k] : self.end[k]][:n]
                    h[k] = xxhash.xxh64_intdigest(word.lower() if self._bytes is _BYTE_LOWER else word)
        return out

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def ngram_hashes(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of n consecutive word hashes (len - n + 1 of them, text ends not regarded)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    base = 0xD1342543DE82EF95 + 8 * seed
    inv = pow(base, -1, 2**64)
    acc = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes + _U(seed)) * powers(base, len(hashes)), out=acc[1:])
    return mix((acc[n:] - acc[:-n]) * powers(inv, len(hashes) - n + 1))


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts as bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the record batches with about ``size`` bytes of text each, and their texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lens = pc.binary_length(batch.column(batch.schema.get_field_index(text)))
        ends = np.cumsum(pc.fill_null(lens, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            part = batch.slice(at, to - at)
            yield part, as_bytes(part.column(part.schema.get_field_index(text)))
            at = to


def slim(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator reads, so that further columns can have any name."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def remainder(divisor: int, col: str = "doc_id"):
    """crc32 of doc_id as text, modulo ``divisor`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % divisor


#: ids in one row of a list table, and copies of a large group's row that full lists are dealt to
LIST_IDS = 4096
FAN_OUT = 64


class Lists:
    """Ids gathered by key inside a task, given up as rows of at most ``LIST_IDS`` ids."""

    def __init__(self, limit: int | None = None, keys: int = 50_000):
        self.limit, self.keys, self.held, self.full = limit or LIST_IDS, keys, {}, []

    def add(self, key, doc_id) -> None:
        mine = self.held.setdefault(key, [])
        mine.append(doc_id)
        if len(mine) == self.limit:
            self.full.append((key, self.held.pop(key)))

    def rows(self, last: bool = False) -> list:
        out, self.full = self.full, []
        if last or len(self.held) > self.keys:
            out += self.held.items()
            self.held = {}
        return out


def spread_join(lists: DataFrame, groups: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Join lists of ids (column ``ids``) with one row per group (its size in ``n``).

    A full list belongs to a group of at least that size, so full lists meet copies of
    their group's row by salt: a group that holds a third of all ids is spread over
    ``FAN_OUT`` tasks a key. There are at most n / limit such groups.
    """
    limit = limit or LIST_IDS
    full = F.size("ids") >= limit
    plain = lists.filter(~full).join(groups, keys)
    copies = groups.filter(F.col("n") >= limit).withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(FAN_OUT - 1))))
    dealt = lists.filter(full).withColumn("salt_", F.pmod(F.xxhash64("ids"), F.lit(FAN_OUT)).cast("int")).join(copies, [*keys, "salt_"]).drop("salt_")
    return plain.unionByName(dealt)
