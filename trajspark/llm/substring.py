"""Substring dedup with fixed-block anchors.

Every text is cut into blocks of BLOCK words that don't overlap; the blocks are the
index. Every run of BLOCK consecutive words probes it. A repeat of WINDOW words holds
a whole block of either text, so an exact repeat always has an anchor: a probe that
meets a block of the same words. Around each anchor the texts are compared over the
words that a window through it can reach; windows that agree make up the maximal
repeats, and words of the later text are removed.

Probes and comparisons go through packed keys (see ``exchange``): the first keys are
short, so a probe costs about two bytes, and a false meeting only costs a comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import NULL_ID, bucket_bits, by_bucket, chunks, documents, pack, pack_bits, pack_sorted, unpack, unpack_bits, unpack_sorted
from .text import NON_SPACE, Words, ngram_hashes

WINDOW = 13
#: a window of 13 words holds a whole block of 7 wherever it starts
BLOCK = (WINDOW + 1) // 2
#: bits of an anchor key beyond those that number the blocks; 2^-8 of the probes meet a wrong block
SPARE_BITS = 8

_ASK = "bucket int, chunk long, n int, keys binary, more binary"
_ASK_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("more", pa.binary())])
_MASK = "chunk long, bucket int, kind int, n int, mask binary"
_MASK_ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("mask", pa.binary())])


@dataclass
class Plan:
    """Bits of the keys and of the buckets, by the size of the input."""

    key_bits: int
    key_buckets: int
    window_buckets: int

    @classmethod
    def of(cls, n_bytes: int) -> Plan:
        words = max(1, n_bytes // 6)
        bits = bucket_bits(words)
        return cls(min(63, max(bits + 8, int(np.ceil(np.log2(words / BLOCK + 1))) + SPARE_BITS)), bits, bits)


class Texts:
    """A chunk's texts as words, with the keys of all runs of BLOCK words."""

    def __init__(self, blob: bytes, plan: Plan):
        self.ids, texts = documents(blob)
        self.w = w = Words(texts, NON_SPACE, lower=False)
        self.order = np.array([NULL_ID if i is None else i for i in self.ids], np.int64)
        self.doc = w.doc_of()
        grams = ngram_hashes(w.hash, BLOCK) >> np.uint64(64 - plan.key_bits)
        n = len(grams)
        long = w.counts >= WINDOW
        inside = (self.doc[:n] == self.doc[BLOCK - 1 :]) & long[self.doc[:n]] if n else np.zeros(0, bool)
        self.at = np.flatnonzero(inside)
        self.key = grams[self.at]
        self.block = (self.at - w.first[self.doc[self.at]]) % BLOCK == 0 if n else np.zeros(0, bool)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys and which of them are blocks."""
        code = np.sort(self.key << np.uint64(1) | (~self.block).astype(np.uint64))
        key = code >> np.uint64(1)
        head = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        return key[head], (code[head] & np.uint64(1)) == 0

    def anchored(self, met: np.ndarray) -> np.ndarray:
        """Places of the runs that meet a block of the same key elsewhere; ``met`` is by distinct key."""
        by = np.argsort(self.key)
        key = self.key[by]
        head = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        first = np.flatnonzero(head)
        if not len(first):
            return np.zeros(0, np.int64)
        here = (np.diff(np.r_[first, len(key)]) > 1) & np.logical_or.reduceat(self.block[by], first)
        take = np.repeat(met | here, np.diff(np.r_[first, len(key)]))
        return self.at[by[take]]

    def candidates(self, met: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows through an anchor: first words, number of each one's hash, sorted hashes, smallest doc_id of each."""
        n = len(self.w) - WINDOW + 1
        if n <= 0:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.uint64), none
        cover = np.zeros(n + WINDOW + 1, np.int32)
        anchor = self.anchored(met)
        np.add.at(cover, np.maximum(anchor - (WINDOW - BLOCK), 0), 1)
        np.add.at(cover, anchor + 1, -1)
        near = np.cumsum(cover)[:n] > 0
        start = np.flatnonzero(near & (self.doc[:n] == self.doc[WINDOW - 1 :]))
        hashes = ngram_hashes(self.w.hash, WINDOW, seed=1)[start]
        by = np.argsort(hashes)
        value = hashes[by]
        head = np.r_[True, value[1:] != value[:-1]] if len(value) else np.zeros(0, bool)
        number = np.empty(len(start), np.int64)
        number[by] = np.cumsum(head) - 1
        first = np.flatnonzero(head)
        least = np.minimum.reduceat(self.order[self.doc[start[by]]], first) if len(first) else np.zeros(0, np.int64)
        return start, number, value[head], least


def _asks(chunk: int, keys: np.ndarray, key_bits: int, bits: int, more) -> pa.Table:
    rows = [(b, chunk, s.stop - s.start, pack_sorted(keys[s]), more(s)) for b, s in by_bucket(keys, key_bits, bits)]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _ASK_ARROW)], schema=_ASK_ARROW)


def _answers(table: pa.Table, kind: int, judge) -> pa.Table:
    """Judge all keys of a bucket, and answer each row by a mask in the row's order."""
    n = table.column("n").to_numpy()
    keys = np.concatenate([unpack_sorted(x) for x in table.column("keys").to_pylist()])
    flags = judge(keys, np.repeat(np.arange(len(n)), n), table.column("more").to_pylist(), n)
    cut = np.r_[0, np.cumsum(n)]
    rows = [(c, b, kind, int(k), pack_bits(flags[x:y])) for c, b, k, x, y in zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), n, cut, cut[1:]) if flags[x:y].any()]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _MASK_ARROW)], schema=_MASK_ARROW)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys, where each group of equal ones starts, and the groups' sizes."""
    by = np.argsort(keys)
    first = np.flatnonzero(np.r_[True, keys[by][1:] != keys[by][:-1]])
    return by, first, np.diff(np.r_[first, len(keys)])


def _meet(keys, row, more, n) -> np.ndarray:
    """Keys that several chunks have, one of them as a block."""
    block = np.concatenate([unpack_bits(m, k) for m, k in zip(more, n.tolist())])
    by, first, size = _groups(keys)
    hit = (size > 1) & np.logical_or.reduceat(block[by], first)
    out = np.zeros(len(keys), bool)
    out[by] = np.repeat(hit, size)
    return out


def _earlier(keys, row, more, n) -> np.ndarray:
    """Windows that start in a text of another chunk with a smaller doc_id than any here."""
    least = np.concatenate([unpack(m) for m in more]) ^ np.uint64(1 << 63)
    least = least.view(np.int64)
    by, first, size = _groups(keys)
    best = np.minimum.reduceat(least[by], first)
    out = np.zeros(len(keys), bool)
    out[by] = np.repeat(best, size) < least[by]
    return out


def _mask(masks: pa.Table, kind: int, keys: np.ndarray, key_bits: int, bits: int) -> np.ndarray:
    """A chunk's answers of a kind, over its sorted keys."""
    own = {b: m for b, k, m in zip(masks.column("bucket").to_pylist(), masks.column("kind").to_pylist(), masks.column("mask").to_pylist()) if k == kind}
    out = np.zeros(len(keys), bool)
    for b, s in by_bucket(keys, key_bits, bits):
        if b in own:
            out[s] = unpack_bits(own[b], s.stop - s.start)
    return out


def removals(docs: DataFrame, save, emit, schema: str) -> DataFrame:
    """Apply ``emit(ids, words, removed marks)`` -> Arrow table to every chunk, once it knows which words go."""
    table = chunks(docs, save)
    plan = Plan.of(table.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first()["n"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, block = Texts(blob, plan).distinct()
                yield from _asks(chunk, keys, plan.key_bits, plan.key_buckets, lambda s: pack_bits(block[s])).to_batches()

    def meet(rows: pa.Table) -> pa.Table:
        return _answers(rows, 0, _meet)

    def known(t: Texts, masks: pa.Table):
        keys, _ = t.distinct()
        return t.candidates(_mask(masks, 0, keys, plan.key_bits, plan.key_buckets))

    def extend(left: pa.Table, masks: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _ASK_ARROW.empty_table()
        _, _, hashes, least = known(Texts(left.column("blob")[0].as_py(), plan), masks)
        signed = least.view(np.uint64) ^ np.uint64(1 << 63)
        return _asks(left.column("chunk")[0].as_py(), hashes, 64, plan.window_buckets, lambda s: pack(signed[s]))

    def earlier(rows: pa.Table) -> pa.Table:
        return _answers(rows, 1, _earlier)

    def remove(left: pa.Table, masks: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([], emit.schema)
        t = Texts(left.column("blob")[0].as_py(), plan)
        start, number, hashes, least = known(t, masks)
        elsewhere = _mask(masks, 1, hashes, 64, plan.window_buckets)
        gone = np.zeros(len(t.w), bool)
        if len(start):
            repeat = start[elsewhere[number] | (least[number] < t.order[t.doc[start]])]
            cover = np.zeros(len(t.w) + 1, np.int32)
            np.add.at(cover, repeat, 1)
            np.add.at(cover, repeat + WINDOW, -1)
            gone = np.cumsum(cover)[:-1] > 0
        return emit(t.ids, t.w, gone)

    slimmed = table.select("chunk", "blob")
    met = save(slimmed.mapInArrow(probe, _ASK).groupBy("bucket").applyInArrow(meet, _MASK))
    asked = slimmed.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(extend, _ASK)
    masks = met.unionByName(asked.groupBy("bucket").applyInArrow(earlier, _MASK))
    return slimmed.groupBy("chunk").cogroup(masks.groupBy("chunk")).applyInArrow(remove, schema)


def kept_texts(w: Words, gone: np.ndarray) -> list[bytes]:
    """The words that stay of each text, joined by one space."""
    low = w.buf.copy()
    low[w.end] = 32
    step = np.zeros(len(low) + 1, np.int8)
    stay = ~gone
    step[w.start[stay]] += 1
    step[w.end[stay] + 1] -= 1
    keep = np.cumsum(step[:-1], dtype=np.int8) > 0
    flat = low[keep].tobytes()
    size = np.where(stay, w.end - w.start + 1, 0)
    ends = np.r_[0, np.cumsum(size)][w.first].tolist()
    return [flat[a : max(a, b - 1)] for a, b in zip(ends, ends[1:])]


def _n_gone(w: Words, gone: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(gone)][w.first])


class _Report:
    """Counts, and the digest of the words that stay."""

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def __call__(self, ids: list, w: Words, gone: np.ndarray) -> pa.Table:
        digest = [hashlib.sha256(t).hexdigest() for t in kept_texts(w, gone)]
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(w.counts), pa.array(_n_gone(w, gone)), pa.array(digest)], schema=self.schema)


class _Kept:
    """The words that stay, as text."""

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])

    def __call__(self, ids: list, w: Words, gone: np.ndarray) -> pa.Table:
        texts = [t.decode("utf-8", "replace") for t in kept_texts(w, gone)]
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(w.counts), pa.array(_n_gone(w, gone)), pa.array(texts, pa.string())], schema=self.schema)


def report(docs: DataFrame, save) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row.

    A word goes if a window of 13 words of its text that covers it also starts in a
    text with a smaller doc_id. A null id counts as larger than all others; rows with
    equal ids don't remove each other's words. Null counts as empty and texts under 13
    words lose none. Rows stay one to one; further columns are not carried; an empty
    table gives an empty result. Windows are told apart by 64-bit hashes.
    """
    return removals(docs, save, _Report(), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, save) -> DataFrame:
    """As ``report``, with the text that stays in place of its digest."""
    return removals(docs, save, _Kept(), "doc_id long, n_words long, n_removed long, text string")


#: the same rows by grouping all windows as texts
SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 11)) AS p, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS g
  FROM w WHERE len(ws) >= 13
), least AS (
  SELECT g, min(doc_id) AS d FROM g GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS k FROM g JOIN least USING (g) WHERE d < doc_id
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM w) x
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = x.doc_id AND gone.k = x.k) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) c ON c.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
