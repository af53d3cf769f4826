"""Exact dedup by skew-safe combining: local groups, then salted digest groups, then salt winners.

Each stage groups by digest and compares the whole contents before it merges.
Contents travel compressed (lossless, so equal contents and only those give equal
frames). A group's rows are combined before every shuffle, so a text that a third
of all rows share arrives as one row per task, then as one row per salt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Lists, blocks, slim, spread_join

#: fixed value: characters that don't count when texts are compared
SPACE = b" \t\n\x0b\x0c\r"
#: a task gives up its local groups beyond so many bytes of text, or ids in one group
LOCAL_BYTES = 16 << 20
LOCAL_IDS = 4096
SALTS = 16

_GROUP = "digest binary, check binary, content binary, best_len long, best_id long, n long"
_ARROW = pa.schema([("digest", pa.binary()), ("check", pa.binary()), ("content", pa.binary()), ("best_len", pa.int64()), ("best_id", pa.int64()), ("n", pa.int64())])


def normalised(text: bytes) -> bytes:
    return text.translate(None, SPACE)


def _keys(text: bytes) -> tuple[bytes, bytes]:
    """A digest and a second, independent one that tells contents apart should the first collide."""
    return hashlib.sha256(text).digest(), hashlib.blake2b(text, digest_size=16).digest()


def _better(a: tuple, b: tuple) -> tuple:
    """More code points, then the smaller doc_id (null last)."""
    rank = lambda x: (-x[0], x[1] is None, x[1] or 0)
    return a if rank(a) <= rank(b) else b


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of equal texts inside a task."""
    pack = zstandard.ZstdCompressor(level=1).compress
    groups: dict[bytes, list] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        rows = [(*_keys(text), pack(text), *g[0], g[1]) for text, g in groups.items()]
        groups.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    for part, texts in blocks(batches):
        for doc_id, raw in zip(part.column(0).to_pylist(), texts):
            text = normalised(raw)
            mine = (len(raw.decode("utf-8", "replace")), doc_id)
            g = groups.get(text)  # a dict compares the whole texts
            if g is None:
                groups[text] = [mine, 1]
                held += len(text)
            else:
                g[0] = _better(g[0], mine)
                g[1] += 1
        if held > LOCAL_BYTES:
            yield from flush()
            held = 0
    yield from flush()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge rows that follow one another with equal digests, after comparing contents."""
    unpack = zstandard.ZstdDecompressor().decompress
    last: list | None = None
    out: list[list] = []

    def emit() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)
        out.clear()
        return batch

    held = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if last is not None and row[:2] == tuple(last[:2]):
                if row[2] != last[2] and unpack(row[2]) != unpack(last[2]):
                    raise RuntimeError("two contents have the same two digests")
                last[3], last[4] = _better((row[3], row[4]), (last[3], last[4]))
                last[5] += row[5]
                continue
            if last is not None:
                out.append(last)
                held += len(last[2])
            last = list(row)
            if held > 4 << 20:
                yield emit()
                held = 0
    if last is not None:
        out.append(last)
    if out:
        yield emit()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a task by content, at most LOCAL_IDS in one row."""
    schema = pa.schema([("digest", pa.binary()), ("check", pa.binary()), ("ids", pa.list_(pa.int64()))])
    ids = Lists(LOCAL_IDS)

    def table(rows: list) -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.binary()), pa.array([k[1] for k, _ in rows], pa.binary()), pa.array([v for _, v in rows], pa.list_(pa.int64()))], schema=schema)

    for part, texts in blocks(batches):
        for doc_id, raw in zip(part.column(0).to_pylist(), texts):
            ids.add(_keys(normalised(raw)), doc_id)
        yield from table(ids.rows())
    yield from table(ids.rows(last=True))


def groups(docs: DataFrame) -> DataFrame:
    """One row per different content: digest, check, keep_id, n."""
    local = slim(docs).mapInArrow(_local, _GROUP)
    salted = local.withColumn("salt", F.pmod(F.xxhash64("best_id", "best_len", F.spark_partition_id()), F.lit(SALTS)))
    columns = [f.name for f in _ARROW]
    by_salt = salted.repartition("digest", "salt").sortWithinPartitions("digest", "check", "salt").select(columns).mapInArrow(_merge, _GROUP)
    whole = by_salt.repartition("digest").sortWithinPartitions("digest", "check").mapInArrow(_merge, _GROUP)
    return whole.select("digest", "check", F.col("best_id").alias("keep_id"), "n")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row, dropped ones too.

    Texts are equal when they are identical without white space; null counts as empty,
    and all empty texts are one group. The row with the most code points stays, then
    the smallest doc_id (a null id last). Where rows repeat a doc_id, each row of that
    id is marked kept if the id is the one to stay. Further columns are not carried; an
    empty table gives an empty result.

    A hot group's ids come back as lists that are spread over several tasks.
    """
    found = groups(docs)
    ids = slim(docs).mapInArrow(_members, "digest binary, check binary, ids array<long>")
    each = spread_join(ids, found, ["digest", "check"], LOCAL_IDS).select(F.explode("ids").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), "digest")
    return each.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


#: the same rows by grouping whole normalised texts
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM g
"""
