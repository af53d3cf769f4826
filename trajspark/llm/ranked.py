"""Ranked lexical search by pipelined term partitioning.

The benchmark's terms are dealt to owners. Documents are read once, in blocks; each
block leaves, for each owner, the postings of that owner's terms, and its lengths and
counts. Item bundles, which carry a sparse accumulator of a block's documents, then
pass the owners one after another: each stage is a cogroup of the bundles with one
owner's postings, adds integer contributions, and hands the bundles on. The last
stage selects.

A block holds at most ``BLOCK_DOCS`` documents and a bundle at most ``BUNDLE_ITEMS``
items, so an accumulator has a fixed size however common a term is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exchange import bundle, pack, pack_sorted, unbundle, unpack, unpack_sorted
from .text import Words, blocks, byte_class, slim

#: a term is made of ASCII letters, digits and all other characters from U+0080 on
TERM = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
OWNERS = 4
BLOCK_DOCS = 2048
BUNDLE_ITEMS = 256
#: text of the benchmark that is searched at once, bytes; a larger one is dealt to parts
PART_BYTES = 8 << 20
#: fixed values of the score
K, FLOOR, SLOPE, SCALE = 20, 50, 50, 1_000_000_000


class Vocabulary:
    """Terms of a part of the benchmark, numbered by their hash, and each item's terms."""

    def __init__(self, texts: list[bytes], owners: int):
        w = Words(texts, TERM, lower=True)
        self.hash = np.unique(w.hash)
        term = np.searchsorted(self.hash, w.hash)
        self.items = [np.unique(term[a:b]) for a, b in zip(w.first[:-1], w.first[1:])]
        self.owner = (self.hash % np.uint64(owners)).astype(np.int64) if len(self.hash) else np.zeros(0, np.int64)


def postings(texts: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, documents and occurrences of the vocabulary's terms (by term, then document), and the documents' lengths."""
    w = Words(texts, TERM, lower=True)
    if not len(w) or not len(vocabulary.hash):
        none = np.zeros(0, np.int64)
        return none, none, none, w.counts
    place = np.minimum(np.searchsorted(vocabulary.hash, w.hash), len(vocabulary.hash) - 1)
    known = vocabulary.hash[place] == w.hash
    key, tf = np.unique(place[known] * len(texts) + w.doc_of()[known], return_counts=True)
    return key // len(texts), key % len(texts), tf, w.counts


_INDEX = "block long, owner int, docs long, terms long, used binary, df binary, blob binary"


def index(docs: DataFrame, vocabulary, owners: int, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A row per block of documents and owner: the owner's postings, and their document counts by term.

    Rows of owner 0 also have the block's numbers of documents and terms; owner -1 has the ids and lengths.
    """
    names = [x.split()[0] for x in _INDEX.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        part_id, k = TaskContext.get().partitionId(), 0
        ids: list = []
        held: list = []
        n = 0

        def out() -> pa.RecordBatch:
            nonlocal ids, held, n, k
            sizes = np.cumsum([0, *[len(h[3]) for h in held]])
            term, doc, tf = (np.concatenate(x) for x in zip(*[(h[0], h[1] + a, h[2]) for h, a in zip(held, sizes)]))
            order = np.argsort(term, kind="stable")
            term, doc, tf = term[order], doc[order], tf[order]
            lengths = np.concatenate([h[3] for h in held])
            null = np.array([i is None for i in ids], np.uint64)
            whole = np.array([i or 0 for i in ids], np.int64)
            block = part_id << 32 | k
            rows = [(block, -1, int((lengths > 0).sum()), int(lengths.sum()), b"", b"", bundle([whole.tobytes(), pack(null), pack(lengths)]))]
            owner = v.owner[term]
            for o in range(owners):
                mine = owner == o
                if not mine.any():
                    continue
                used, first, df = np.unique(term[mine], return_index=True, return_counts=True)
                step = np.diff(doc[mine], prepend=0)
                step[first] = doc[mine][first]
                rows.append((block, o, 0, 0, pack_sorted(used.astype(np.uint64)), pack(df), bundle([pack(step), pack(tf[mine])])))
            ids, held, n, k = [], [], 0, k + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for part, texts in blocks(batches):
            column = part.column(0).to_pylist()
            for a in range(0, len(texts), BLOCK_DOCS):
                some = texts[a : a + BLOCK_DOCS]
                if held and len(ids) + len(some) > BLOCK_DOCS:
                    yield out()
                held.append(postings(some, v))
                ids += column[a : a + BLOCK_DOCS]
        if held:
            yield out()

    return save(slim(docs).mapInArrow(run, _INDEX))


def _document_counts(indexed: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term, over all blocks: added up inside tasks, then by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            for used, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                df[unpack_sorted(used).astype(np.int64)] += unpack(counts).astype(np.int64)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    out = np.zeros(n_terms, np.int64)
    parts = indexed.filter("owner >= 0").select("used", "df").mapInArrow(run, "term long, df long")
    for r in parts.groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most a row per benchmark term
        out[r["term"]] = r["df"]
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 * ln((2 * N + 2) / (2 * df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def contributions(used: np.ndarray, df: np.ndarray, step: np.ndarray, tf: np.ndarray, m: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first posting of each term, documents, 64-bit integer contributions) of one owner's postings."""
    first = np.r_[0, np.cumsum(df)]
    total = np.cumsum(step)
    base = np.r_[0, total][first[:-1]]
    doc = total - np.repeat(base, df)
    return first, doc, np.repeat(w[used], df) * ((SCALE * tf) // (1000 * tf + K * m[doc]))


_ACC = "block long, bundle int, meta binary, keys binary, scores binary"
_ACC_NAMES = ["block", "bundle", "meta", "keys", "scores"]
_ACC_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _stage(vocabulary, weight, totals: tuple[int, int]):
    """One owner's stage: bundles and the owner's postings of a block meet, the bundles go on."""
    n_docs, n_terms = totals

    def run(key: tuple, bundles: pa.Table, owned: pa.Table) -> pa.Table:
        if not owned.num_rows:
            return bundles.select(_ACC_NAMES)
        v: Vocabulary = vocabulary.value
        row = owned.to_pylist()[0]
        used, df = unpack_sorted(row["used"]).astype(np.int64), unpack(row["df"]).astype(np.int64)
        step, tf = (unpack(x).astype(np.int64) for x in unbundle(row["blob"]))
        out = []
        for b in bundles.to_pylist():
            lengths = unpack(unbundle(b["meta"])[2]).astype(np.int64)
            m = 100 - SLOPE + (SLOPE * lengths * n_docs) // n_terms
            first, doc, gain = contributions(used, df, step, tf, m, weight.value)
            items = v.items[b["bundle"] * BUNDLE_ITEMS : (b["bundle"] + 1) * BUNDLE_ITEMS]
            acc = np.zeros((len(items), len(lengths)), np.int64)
            keys = unpack_sorted(b["keys"]).astype(np.int64)
            acc.reshape(-1)[keys] = unpack(b["scores"]).astype(np.int64)
            for i, terms in enumerate(items):
                at = np.searchsorted(used, terms)
                at = at[(at < len(used)) & (used[np.minimum(at, len(used) - 1)] == terms)]
                for t in at.tolist():  # a term's documents are distinct
                    acc[i, doc[first[t] : first[t + 1]]] += gain[first[t] : first[t + 1]]
            keys = np.flatnonzero(acc)
            out.append((b["block"], b["bundle"], b["meta"], pack_sorted(keys.astype(np.uint64)), pack(acc.reshape(-1)[keys])))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ACC_TYPES)], names=_ACC_NAMES)

    return run


def _select(vocabulary, best: int):
    """The ``best`` documents of each item in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        for batch in batches:
            for b in batch.to_pylist():
                ids, null, _ = unbundle(b["meta"])
                ids, null = np.frombuffer(ids, np.int64), unpack(null).astype(bool)
                zero = b["bundle"] * BUNDLE_ITEMS
                keys, scores = unpack_sorted(b["keys"]).astype(np.int64), unpack(b["scores"]).astype(np.int64)
                item, doc = keys // len(ids), keys % len(ids)
                order = np.lexsort((ids[doc], null[doc], -scores, item))
                item, doc, scores = item[order], doc[order], scores[order]
                first = np.searchsorted(item, np.arange(len(v.items) + 1))
                top = np.flatnonzero(np.arange(len(item)) - first[item] < best)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item[top] + zero, pa.int64()), pa.array(ids[doc[top]], mask=null[doc[top]]), pa.array(scores[top])], ["place", "doc_id", "score"]
                )

    return run


def _parts(benchmark: DataFrame) -> Iterator[list]:
    """The items in lists of bounded text: by a hash of the item where the benchmark is large."""
    items = benchmark.select(F.col("item_id").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-size // PART_BYTES))
    for k in range(n):
        yield items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect() if n > 1 else items.collect()


def search(docs: DataFrame, benchmark: DataFrame, save: Callable[[DataFrame], DataFrame], best: int = 50, owners: int = OWNERS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``best`` documents of each benchmark item.

    All documents are scored for every item with a term of it; scores are 64-bit integers
    and only those above 0 are returned. Equal scores go by doc_id, null last; identical
    rows of documents are documents of their own and rank one after another. A null or
    empty text has no terms. Rows that repeat an item_id are items of their own, each with
    its ranks. Extra columns are not read. Empty tables give an empty result. Terms are
    told apart by 64-bit hashes.

    A benchmark of more than ``PART_BYTES`` is searched in parts, so what is broadcast
    (a part's terms and items) is bounded by it. What reaches the driver are a part's
    texts and one count for each of its terms.
    """
    schema = f"place long, item_id {benchmark.schema['item_id'].dataType.simpleString()}"
    found = [_search(docs, rows, save, best, owners, schema) for rows in _parts(benchmark)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search(docs: DataFrame, items: list, save, best: int, owners: int, schema: str) -> DataFrame:
    spark = docs.sparkSession
    made = Vocabulary([(r["text"] or "").encode() for r in items], owners)
    vocabulary = spark.sparkContext.broadcast(made)
    indexed = index(docs, vocabulary, owners, save)
    heads = indexed.filter("owner = -1")
    sums = heads.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = sums["docs"], max(1, sums["terms"])
    weight = spark.sparkContext.broadcast(weights(_document_counts(indexed, len(made.hash)), n_docs))

    bundles = -(-len(items) // BUNDLE_ITEMS)
    nothing = pack(np.zeros(0, np.uint64))
    acc = heads.select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(max(0, bundles - 1)))).alias("bundle"), F.col("blob").alias("meta"), F.lit(nothing).alias("keys"), F.lit(nothing).alias("scores")
    )
    for owner in range(owners):
        owned = indexed.filter(F.col("owner") == owner).select("block", "used", "df", "blob")
        acc = acc.groupBy("block").cogroup(owned.groupBy("block")).applyInArrow(_stage(vocabulary, weight, (n_docs, n_terms)), _ACC)
    local = acc.mapInArrow(_select(vocabulary, best), "place long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    top = local.withColumn("rank", rank).filter(F.col("rank") <= best)
    names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(items)], schema)
    return top.join(F.broadcast(names), "place").select("item_id", "rank", "doc_id", "score")


#: the same rows by joining terms; sums of products stay below 2^63
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), s AS (
  SELECT count(*) AS N, CAST(sum(len(ws)) AS BIGINT) AS L FROM d WHERE len(ws) > 0
), i AS (
  SELECT item, item_id, unnest(list_distinct(ws)) AS term
  FROM (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM benchmark)
), p AS (
  SELECT row_, doc_id, len, term, count(*) AS tf FROM (SELECT row_, doc_id, len(ws) AS len, unnest(ws) AS term FROM d) SEMI JOIN i USING (term) GROUP BY ALL
), f AS (
  SELECT term, CAST(floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, s GROUP BY term, N
), c AS (
  SELECT row_, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len * N) // L))) AS gain FROM p JOIN f USING (term), s
), t AS (
  SELECT item, item_id, row_, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM i JOIN c USING (term) GROUP BY ALL
), r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM t WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
