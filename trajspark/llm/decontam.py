"""Benchmark decontamination with an FM-index for each training shard.

A shard is a block of documents inside one task. Its words become symbols: the
number of the word in the benchmark's vocabulary, or 0 for every other word. Runs
of symbols that can hold a whole test phrase are indexed (suffix array by prefix
doubling, Burrows-Wheeler transform, wavelet matrix with ranks, sampled suffix
positions); all test phrases are searched backward at once, occurrences are
located through the samples, checked against the words, and merged to spans.
Documents are only scanned: no shuffle, and a shard's index is bounded by its block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Words, blocks, byte_class, slim

#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of texts with A-Z in lower case
WORD = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
WINDOW = 10
SAMPLE = 8
#: text of a shard, bytes; a longer text is a shard of its own
SHARD = 2 << 20
#: the benchmark is held by every task, so its size is checked
MAX_BENCHMARK = 64 << 20


class Wavelet:
    """Wavelet matrix over symbols: rank of a symbol before a position, for whole arrays of both."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        for k in range(bits - 1, -1, -1):
            bit = ((symbols >> k) & 1).astype(bool)
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(at), at
        for k, ones, zeros in zip(range(self.bits - 1, -1, -1), self.levels, self.zeros):
            bit = ((symbol >> k) & 1).astype(bool)
            one_lo, one_hi = ones[lo], ones[hi]
            lo = np.where(bit, zeros + one_lo, lo - one_lo)
            hi = np.where(bit, zeros + one_hi, hi - one_hi)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.levels, self.zeros):
            bit = ones[at + 1] - ones[at]
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return symbol


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    new = np.r_[True, s[1:] != s[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    step = 1
    while True:
        r = rank[order]
        tied = np.zeros(n, bool)
        tied[1:] |= r[1:] == r[:-1]
        tied[:-1] |= r[1:] == r[:-1]
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        rows = order[places]
        ahead = np.where(rows + step < n, rank[np.minimum(rows + step, n - 1)], -1)
        key = rank[rows] * (n + 1) + ahead + 1
        by = np.argsort(key, kind="stable")
        rows, key = rows[by], key[by]
        order[places] = rows
        head = np.r_[True, key[1:] != key[:-1]]
        rank[rows] = places[np.maximum.accumulate(np.where(head, np.arange(len(rows)), 0))]
        step *= 2


class FMIndex:
    """Backward search and location over a sequence of symbols below ``size``."""

    def __init__(self, symbols: np.ndarray, size: int, sample: int = SAMPLE):
        text = np.append(symbols + 1, 0)  # 0 ends the text
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.n, self.sample = len(text), sample
        self.before = np.zeros(size + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=size + 1)[: size + 1], out=self.before[1:])
        self.wavelet = Wavelet(bwt, max(1, int(size).bit_length()))
        kept = sa % sample == 0
        self.kept = np.zeros(self.n + 1, np.int32)
        np.cumsum(kept, out=self.kept[1:])
        self.samples = sa[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases, one a row, padded in front with -1."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero((phrases[:, k] >= 0) & (lo < hi))
            if not len(live):
                continue
            c = phrases[live, k] + 1
            lo[live] = self.before[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.before[c] + self.wavelet.rank(c, hi[live])
        return lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: walk back to a sampled suffix."""
        out, steps = np.empty(len(at), np.int64), np.zeros(len(at), np.int64)
        live, at = np.arange(len(at)), at.copy()
        while len(live):
            sampled = self.kept[at + 1] > self.kept[at]
            done = live[sampled]
            out[done] = self.samples[self.kept[at[sampled]]] + steps[done]
            live, at = live[~sampled], at[~sampled]
            steps[live] += 1
            if len(live):
                c = self.wavelet.access(at)
                at = self.before[c] + self.wavelet.rank(c, at)
        return out


@dataclass
class Benchmark:
    """Test phrases: distinct windows as rows of word numbers (from 1), and the items that have each."""

    vocabulary: np.ndarray  # sorted hashes of the words
    words: list[bytes]
    phrases: np.ndarray  # padded in front with -1
    lengths: np.ndarray
    items: list[list[str]]

    @property
    def shortest(self) -> int:
        return int(self.lengths.min()) if len(self.lengths) else 0


def phrases(items: list[tuple[object, str | None]], window: int = WINDOW) -> Benchmark:
    """Windows of ``window`` words of each item; a shorter item with words is one window; null has none."""
    texts = [(t or "").encode("utf-8", "surrogatepass") for _, t in items]
    w = Words(texts, WORD, lower=True)
    spelled: dict[int, bytes] = {}
    for h, a, b in zip(w.hash.tolist(), w.start.tolist(), w.end.tolist()):
        word = w.raw[a:b].lower()
        if spelled.setdefault(h, word) != word:
            raise RuntimeError("two benchmark words have one hash")
    vocabulary = np.array(sorted(spelled), np.uint64)
    ids = np.searchsorted(vocabulary, w.hash) + 1
    found: dict[tuple[int, ...], set[str]] = {}
    for k, (item, _) in enumerate(items):
        own = ids[w.first[k] : w.first[k + 1]].tolist()
        for p in range(max(1, len(own) - window + 1) if own else 0):
            found.setdefault(tuple(own[p : p + window]), set()).add("" if item is None else str(item))
    rows = np.full((len(found), window), -1, np.int64)
    lengths = np.array([len(p) for p in found], np.int64)
    for k, p in enumerate(found):
        rows[k, window - len(p) :] = p
    return Benchmark(vocabulary, [spelled[int(h)] for h in vocabulary], rows, lengths, [sorted(x) for x in found.values()])


def hits(texts: list[bytes], bench: Benchmark) -> tuple[Words, np.ndarray, np.ndarray]:
    """The shard's words, and every occurrence as (phrase, first word)."""
    w = Words(texts, WORD, lower=True)
    none = np.zeros(0, np.int64)
    if not len(w) or not len(bench.lengths):
        return w, none, none
    place = np.minimum(np.searchsorted(bench.vocabulary, w.hash), len(bench.vocabulary) - 1)
    symbol = np.where(bench.vocabulary[place] == w.hash, place + 1, 0)
    # runs of benchmark words inside one text that are long enough for a phrase
    broken = np.flatnonzero(symbol == 0)
    edges = np.unique(np.concatenate([broken, broken + 1, w.first]))
    begin, end = edges[:-1], edges[1:]
    long = (end - begin >= bench.shortest) & (symbol[np.minimum(begin, len(symbol) - 1)] > 0) & (begin < len(symbol))
    begin, end = begin[long], end[long]
    if not len(begin):
        return w, none, none
    # equal runs are indexed once
    distinct: dict[bytes, int] = {}
    run_of = np.array([distinct.setdefault(symbol[a:b].tobytes(), len(distinct)) for a, b in zip(begin.tolist(), end.tolist())])
    runs = [np.frombuffer(r, np.int64) for r in distinct]
    text = np.concatenate([x for r in runs for x in (r, [0])])
    starts = np.r_[0, np.cumsum([len(r) + 1 for r in runs])]
    index = FMIndex(text, len(bench.vocabulary) + 2)
    lo, hi = index.search(bench.phrases)
    n = hi - lo
    some = np.flatnonzero(n > 0)
    if not len(some):
        return w, none, none
    phrase = np.repeat(some, n[some])
    at = np.arange(n[some].sum()) - np.repeat(np.cumsum(n[some]) - n[some], n[some]) + np.repeat(lo[some], n[some])
    position = index.locate(at)
    # from the distinct runs to every run that equals them
    run = np.searchsorted(starts, position, "right") - 1
    inside = position - starts[run]
    by = np.argsort(run_of, kind="stable")
    first = np.searchsorted(run_of[by], np.arange(len(runs) + 1))
    copies = np.diff(first)[run]
    source = by[np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies) + np.repeat(first[run], copies)]
    return w, np.repeat(phrase, copies), begin[source] + np.repeat(inside, copies)


def _verified(w: Words, bench: Benchmark, phrase: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which occurrences hold the phrase's very words (words were told apart by 64-bit hashes)."""
    ok = np.ones(len(at), bool)
    checked: dict[int, bool] = {}
    for k, (p, a) in enumerate(zip(phrase.tolist(), at.tolist())):
        for j, word in enumerate(bench.phrases[p][-int(bench.lengths[p]) :].tolist()):
            same = checked.get(a + j)
            if same is None:
                same = checked[a + j] = w.raw[w.start[a + j] : w.end[a + j]].lower() == bench.words[word - 1]
            if not same:
                ok[k] = False
                break
    return ok


def load(spark_items: DataFrame, window: int = WINDOW) -> Benchmark:
    """The test phrases, after a check that the benchmark is small enough for every task to hold."""
    items = spark_items.select(F.col("item_id").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    if size > MAX_BENCHMARK:
        raise ValueError(f"the benchmark has {size} bytes; at most {MAX_BENCHMARK} can be searched at once")
    return phrases([(r["item_id"], r["text"]) for r in items.collect()], window)


_SPANS = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start: int, end: int>>"


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, spans: bool = True) -> DataFrame:
    """Hits of every document: n_words, n_hit, items (sorted as strings) and merged word spans.

    Rows stay one to one, repeated rows and null ids included. A null or empty text has
    no words. Further columns are not carried. With an empty benchmark nothing is hit.
    Spans are byte offsets in the UTF-8 text, end exclusive, from the first to the last
    word of each run of hit words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(benchmark, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for part, texts in blocks(batches, size=SHARD):
            w, n_hit, items, found = _shard(texts, bench, spans)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(w.counts), pa.array(n_hit), pa.array(items, pa.list_(pa.string())), pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                ["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return slim(docs).mapInArrow(run, _SPANS)


def _shard(texts: list[bytes], bench: Benchmark, spans: bool = True):
    w, phrase, at = hits(texts, bench)
    ok = _verified(w, bench, phrase, at)
    phrase, at = phrase[ok], at[ok]
    cover = np.zeros(len(w) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + bench.lengths[phrase], -1)
    hit = np.cumsum(cover)[:-1] > 0
    total = np.r_[0, np.cumsum(hit)]
    n_hit = np.diff(total[w.first])
    items: list[set[str]] = [set() for _ in texts]
    doc = np.searchsorted(w.first, at, "right") - 1
    for d, p in set(zip(doc.tolist(), phrase.tolist())):
        items[d].update(bench.items[p])
    found: list[list[dict]] = [[] for _ in texts]
    if spans and len(w):
        # runs of hit words, broken at text ends
        step = np.r_[hit, False] != np.r_[False, hit]
        step[w.first] |= np.r_[hit, False][w.first]
        cut = np.flatnonzero(step)
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(w)]):
            if a < len(w) and hit[a]:
                d = int(np.searchsorted(w.first, a, "right")) - 1
                found[d].append({"start": int(w.start[a] - w.offs[d]), "end": int(w.end[b - 1] - w.offs[d])})
    return w, n_hit, [sorted(x) for x in items], found


def report(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def cut_spans(text: bytes, found: list[dict]) -> bytes:
    """The text without the spans; what stays is kept byte for byte."""
    out, at = [], 0
    for s in found:
        out.append(text[at : s["start"]])
        at = s["end"]
    return b"".join([*out, text[at:]])


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, all columns kept, with the hit spans taken out of ``text``; untouched texts stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(load(benchmark, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for part, texts in blocks(batches, size=SHARD):
            _, n_hit, _, found = _shard(texts, bench)
            if n_hit.any():
                k = part.schema.get_field_index("text")
                old = part.column(k).to_pylist()
                new = [cut_spans(t, f).decode("utf-8", "replace") if f else o for t, f, o in zip(texts, found, old)]
                part = pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == k else c for i, c in enumerate(part.columns)], part.schema.names)
            yield part

    return docs.mapInArrow(run, docs.schema)


#: the same rows by joining all windows as texts
SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bg AS (
  SELECT DISTINCT item, least(len(ws), 10) AS n, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i:i + 9], ' '))) AS g FROM b WHERE len(ws) > 0
), dg AS (
  SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS p, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS g
  FROM w, (SELECT DISTINCT n FROM bg) s WHERE len(ws) >= n
), m AS (
  SELECT dg.doc_id, dg.p, dg.n, bg.item FROM dg JOIN bg ON bg.g = dg.g AND bg.n = dg.n
), hit AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS k FROM m) x GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM m) x GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.l, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM w LEFT JOIN hit ON hit.doc_id = w.doc_id LEFT JOIN its ON its.doc_id = w.doc_id
"""
