"""Chunks of documents that ask distributed tables about their keys.

A chunk is a block of documents inside one task, written once to the shared folder.
It sends its distinct keys, sorted and packed, to key buckets (a row per chunk and
bucket); a bucket sees what all chunks sent for its keys and answers each row in its
order. So a key costs a few bits per chunk that has it, however often the chunk has it,
and a bucket holds an even share of the distinct keys, however hot one of them is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .text import blocks, slim

#: text of a chunk, bytes; a longer text is a chunk of its own
CHUNK = 4 << 20
#: keys that a bucket is to hold, about
BUCKET_KEYS = 1 << 20
#: stands for a null doc_id; orders last
NULL_ID = np.iinfo(np.int64).max


def _deflate(data: bytes) -> bytes:
    return zstandard.compress(data, 3)


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes: planes that hardly vary cost little."""
    raw = np.ascontiguousarray(values).astype(np.uint64).view(np.uint8).reshape(-1, 8)
    top = int(values.max()) if len(values) else 0
    planes = max(1, -(-top.bit_length() // 8))
    return bytes([planes]) + _deflate(np.ascontiguousarray(raw[:, :planes].T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = data[0]
    raw = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(planes, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :planes] = raw.T
    return out.view(np.uint64).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def pack_bits(flags: np.ndarray) -> bytes:
    return _deflate(np.packbits(flags).tobytes())


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.decompress(data), np.uint8), count=n).astype(bool)


def bucket_bits(keys: float) -> int:
    """Buckets (a power of two) for about so many keys."""
    return max(3, int(np.ceil(np.log2(max(1.0, keys / BUCKET_KEYS)))))


def by_bucket(keys: np.ndarray, key_bits: int, bits: int) -> Iterator[tuple[int, slice]]:
    """Parts of sorted keys that share their top ``bits`` of ``key_bits`` bits."""
    bucket = (keys >> np.uint64(key_bits - bits)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else []
    for a, b in zip(cut, [*cut[1:], len(keys)]):
        yield int(bucket[a]), slice(int(a), int(b))


def chunks(docs: DataFrame, save=None, size: int = CHUNK) -> DataFrame:
    """(chunk, n_bytes, blob): the documents' ids and texts, compressed; with ``save`` kept in the shared folder.

    Without ``save`` the chunks are made anew whenever they are read. Then ``docs`` must
    give the same partitions each time, as a table read from files does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id, k = TaskContext.get().partitionId(), 0
        ids: list = []
        held: list[bytes] = []
        n = 0

        def out() -> pa.RecordBatch:
            nonlocal ids, held, n, k
            null = np.array([i is None for i in ids], bool)
            head = np.array([0 if i is None else i for i in ids], np.int64)
            lens = np.array([len(t) for t in held], np.int64)
            blob = b"".join([np.int64(len(ids)).tobytes(), head.tobytes(), null.tobytes(), lens.tobytes(), *held])
            batch = pa.RecordBatch.from_arrays([pa.array([part_id << 32 | k], pa.int64()), pa.array([n], pa.int64()), pa.array([_deflate(blob)], pa.binary())], ["chunk", "n_bytes", "blob"])
            ids, held, n, k = [], [], 0, k + 1
            return batch

        for part, texts in blocks(batches, size=size):
            for doc_id, text in zip(part.column(0).to_pylist(), texts):
                if held and n + len(text) > size:
                    yield out()
                ids.append(doc_id)
                held.append(text)
                n += len(text) + 1
        if held:
            yield out()

    made = slim(docs).mapInArrow(run, "chunk long, n_bytes long, blob binary")
    return save(made) if save else made


def documents(blob: bytes) -> tuple[list, list[bytes]]:
    """Ids (None for null) and texts of a chunk."""
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, n, 8)
    null = np.frombuffer(raw, bool, n, 8 + 8 * n)
    lens = np.frombuffer(raw, np.int64, n, 8 + 9 * n).tolist()
    at, texts = 8 + 17 * n, []
    for x in lens:
        texts.append(raw[at : at + x])
        at += x
    return [None if z else i for i, z in zip(head.tolist(), null.tolist())], texts


def bundle(parts: list[bytes]) -> bytes:
    return b"".join([np.array([len(parts), *map(len, parts)], np.int64).tobytes(), *parts])


def unbundle(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    at, out = 8 + 8 * n, []
    for x in np.frombuffer(data, np.int64, n, 8).tolist():
        out.append(data[at : at + x])
        at += x
    return out
