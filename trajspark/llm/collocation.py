"""Phrase collocation mining with weighted acyclic automata.

A shard (texts of one language inside a task) sorts its phrases of one to three words
and builds a count transducer: arcs carry words and counts, equal right languages are
one state. Sampled phrases cut the order of all phrases into prefix ranges. Every
shard's transducer is cut at them, and a range's cuts are united, summing the counts.
Parts of phrases are looked up by composition: a range sends the parts that its
candidates need as a transducer, cut the same way, and the owning ranges answer with
one that carries the counts.

A range holds about ``RANGE_NGRAMS`` phrases of all shards, however frequent a word is,
as cuts go down to the third word of a phrase.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exchange import _deflate, bundle, pack, pack_sorted, unbundle, unpack, unpack_sorted
from .text import LOWER, blocks, byte_class, mix

#: words are made of all bytes but space, tab and these, which end a piece
BREAK = ~byte_class((0x2E, 0x2E), (0x2C, 0x2C), (0x3B, 0x3B), (0x3A, 0x3A), (0x21, 0x21), (0x3F, 0x3F), (0x0A, 0x0D))
WORD = byte_class((0x20, 0x20), (0x09, 0x09)) & ~BREAK
#: text of a shard, bytes; a longer text is a shard of its own
SHARD = 12 << 20
RANGE_NGRAMS = 2 << 20
#: prefix ranges at most, and phrases sampled for each; a boundary's words are cut to so many bytes
MOST_RANGES, PER_RANGE, EDGE_BYTES = 1 << 18, 8, 64
SAMPLE_EVERY = 4096

Grams = tuple[tuple[np.ndarray, ...], ...]  # per length: label columns and counts, sorted


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts[order], first)


def _share(length: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State of each group of arcs (groups follow one another), and the arcs of the first group of each state.

    Groups with the same arcs are one state. They are proposed by hash and then compared arc by arc.
    """
    first = np.r_[0, np.cumsum(length)]
    if not len(length):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(first[-1], np.uint64)
    for c in columns:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64))
    total = np.r_[np.uint64(0), np.cumsum(h, dtype=np.uint64)]
    key = mix(total[first[1:]] - total[first[:-1]] + length.astype(np.uint64))
    _, one, state = np.unique(key, return_index=True, return_inverse=True)
    like = one[state]
    group = np.repeat(np.arange(len(length)), length)
    inside = np.arange(first[-1]) - first[group]
    same = length == length[like]
    other = np.where(same[group], first[like[group]] + inside, 0)
    differ = ~same[group]
    for c in columns:
        differ |= c != c[other]
    same[group[differ]] = False
    like = np.where(same, like, np.arange(len(length)))
    one, state = np.unique(like, return_inverse=True)
    return state, np.flatnonzero(np.isin(group, one))


class Transducer:
    """Counts of phrases of one to three words: sorted words, and arcs by depth.

    Arcs of the root are in order; a state's arcs follow one another. An arc with a
    count of 0 only leads on. ``target`` is a state of the next depth, or -1.
    """

    def __init__(self, words: pa.Array, arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], lengths: list[np.ndarray]):
        self.words, self.arcs, self.lengths = words, arcs, lengths

    @classmethod
    def build(cls, words: pa.Array, grams: Grams) -> Transducer:
        """From sorted phrases; states are settled from the deepest up, so that equal ones are shared."""
        (a1, n1), (a2, b2, n2), (a3, b3, c3, n3) = grams
        v = max(1, len(words))
        # phrases that lead on, with the counts they have themselves
        pair, count2 = _sum(np.r_[a2 * v + b2, a3 * v + b3], np.r_[n2, np.zeros(len(n3), np.int64)])
        one, count1 = _sum(np.r_[a1, pair // v], np.r_[n1, np.zeros(len(pair), np.int64)])
        none = lambda n: np.full(n, -1, np.int64)
        at, length = np.unique(a3 * v + b3, return_counts=True)
        state, kept = _share(length, c3, n3)
        arcs3, lengths3 = (c3[kept], n3[kept], none(len(kept))), length[np.unique(state, return_index=True)[1]] if len(length) else length
        target2 = none(len(pair))
        target2[np.searchsorted(pair, at)] = state
        label2 = pair % v
        at, length = np.unique(pair // v, return_counts=True)
        state, kept = _share(length, label2, count2, target2)
        arcs2, lengths2 = (label2[kept], count2[kept], target2[kept]), length[np.unique(state, return_index=True)[1]] if len(length) else length
        target1 = none(len(one))
        target1[np.searchsorted(one, at)] = state
        return cls(words, [(one, count1, target1), arcs2, arcs3], [lengths2, lengths3])

    def _unfold(self, depth: int, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the arcs into ``target``: which of them, and which arc of ``depth``, for all that follow."""
        lengths = self.lengths[depth - 1]
        some = np.flatnonzero(target >= 0)
        n = lengths[target[some]] if len(lengths) else np.zeros(0, np.int64)
        first = np.r_[0, np.cumsum(lengths)][target[some]] if len(lengths) else n
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(some, n), np.repeat(first, n) + inside

    def grams(self) -> Grams:
        """All phrases with a count, by length, sorted."""
        (l1, n1, t1), (l2, n2, t2), (l3, n3, _) = self.arcs
        up1, arc2 = self._unfold(1, t1)
        a2, b2, m2 = l1[up1], l2[arc2], n2[arc2]
        up2, arc3 = self._unfold(2, t2[arc2])
        a3, b3, c3, m3 = a2[up2], b2[up2], l3[arc3], n3[arc3]
        return (l1[n1 > 0], n1[n1 > 0]), (a2[m2 > 0], b2[m2 > 0], m2[m2 > 0]), (a3, b3, c3, m3)

    def pack(self) -> bytes:
        lens = np.diff(np.frombuffer(self.words.buffers()[1], np.int32, len(self.words) + 1, 4 * self.words.offset)) if len(self.words) else np.zeros(0, np.int64)
        parts = [pack(lens), _deflate(b"".join(self.words.to_pylist()))]
        for k, (label, count, target) in enumerate(self.arcs):
            parts += [pack_sorted(label.astype(np.uint64)) if k == 0 else pack(label), pack(count), pack(target + 1)]
        return bundle([*parts, *map(pack, self.lengths)])

    @classmethod
    def unpack(cls, data: bytes) -> Transducer:
        parts = unbundle(data)
        ints = [unpack(x).astype(np.int64) if k != 2 else unpack_sorted(x).astype(np.int64) for k, x in enumerate(parts) if k != 1]
        words = _binary(zstandard.decompress(parts[1]), ints[0])
        return cls(words, [(ints[k], ints[k + 1], ints[k + 2] - 1) for k in (1, 4, 7)], ints[10:12])


def _binary(data: bytes, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _numbered(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words in byte order, and the number of each word."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)


def shard(texts: list[bytes]) -> tuple[Transducer, int]:
    """Count transducer of the texts' phrases, and their number of words."""
    buf = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    inside = WORD[buf]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edges[0::2], edges[1::2]
    piece = np.cumsum(BREAK[buf], dtype=np.int32)[start]
    words, ids = _numbered(_binary(buf[inside].tobytes(), end - start))
    del buf, inside, edges
    v = max(1, len(words))
    label, n1 = np.unique(ids, return_counts=True)
    two = piece[1:] == piece[:-1]
    pair, at, n2 = np.unique((ids[:-1] * v + ids[1:])[two], return_inverse=True, return_counts=True)
    pair_at = np.full(max(0, len(ids) - 1), -1, np.int64)
    pair_at[two] = at
    three = piece[2:] == piece[:-2]
    triple, n3 = np.unique(pair_at[:-1][three] * v + ids[2:][three], return_counts=True)
    of = triple // v
    grams = ((label, n1), (pair // v, pair % v, n2), (pair[of] // v, pair[of] % v, triple % v, n3))
    return Transducer.build(words, grams), len(ids)


def union(parts: list[Transducer], least: int = 1) -> Transducer:
    """One transducer of all phrases, their counts added up; only those with a count of ``least``."""
    words, ids = _numbered(pa.concat_arrays([p.words for p in parts]))
    v, at = max(1, len(words)), 0
    columns: list[list] = [[], [], []]
    for p in parts:
        mine = ids[at : at + len(p.words)]
        at += len(p.words)
        for k, g in enumerate(p.grams()):
            columns[k].append([*[mine[c] for c in g[:-1]], g[-1]])
    (a1, n1), (a2, b2, n2), (a3, b3, c3, n3) = ([np.concatenate(c) for c in zip(*x)] for x in columns)
    a1, n1 = _sum(a1, n1)
    pair, n2 = _sum(a2 * v + b2, n2)
    heads, of = np.unique(a3 * v + b3, return_inverse=True)
    triple, n3 = _sum(of * v + c3, n3)
    k1, k2, k3 = n1 >= least, n2 >= least, n3 >= least
    pair, triple = pair[k2], triple[k3]
    head = heads[triple // v] if len(triple) else triple
    return of_grams(words, ((a1[k1], n1[k1]), (pair // v, pair % v, n2[k2]), (head // v, head % v, triple % v, n3[k3])))


def of_grams(words: pa.Array, grams: Grams) -> Transducer:
    """Transducer of the phrases with only the words that they use."""
    used = np.unique(np.concatenate([c for g in grams for c in g[:-1]])) if len(words) else np.zeros(0, np.int64)
    small = tuple((*[np.searchsorted(used, c) for c in g[:-1]], g[-1]) for g in grams)
    return Transducer.build(words.take(pa.array(used)), small)


def cuts(words: pa.Array, grams: Grams, edges: list[tuple[bytes, ...]]) -> list[tuple[int, int, int]]:
    """For each boundary phrase, how many phrases of each length come before it."""
    text = words.to_pylist()
    (a1, _), (a2, b2, _), (a3, b3, c3, _) = grams

    def within(column: np.ndarray, lo: int, hi: int, label: int, after: bool) -> int:
        return lo + int(np.searchsorted(column[lo:hi], label, "right" if after else "left"))

    out = []
    for edge in edges:
        i = bisect_left(text, edge[0])
        known = i < len(text) and text[i] == edge[0]
        deeper = len(edge) > 1 and known
        one = within(a1, 0, len(a1), i, deeper)
        lo2, lo3 = within(a2, 0, len(a2), i, False), within(a3, 0, len(a3), i, False)
        if deeper:
            hi2, hi3 = within(a2, lo2, len(a2), i, True), within(a3, lo3, len(a3), i, True)
            j = bisect_left(text, edge[1])
            known = j < len(text) and text[j] == edge[1]
            lo2_, lo3_ = within(b2, lo2, hi2, j, len(edge) > 2 and known), within(b3, lo3, hi3, j, False)
            if len(edge) > 2 and known:
                hi3 = within(b3, lo3_, hi3, j, True)
                lo3_ = within(c3, lo3_, hi3, bisect_left(text, edge[2]), False)
            lo2, lo3 = lo2_, lo3_
        out.append((one, lo2, lo3))
    return out


def slices(t: Transducer, edges: list[tuple[bytes, ...]]) -> Iterator[tuple[int, Transducer]]:
    """The parts of a transducer between boundary phrases, with the number of boundaries before each."""
    grams = t.grams()
    ends = [(0, 0, 0), *cuts(t.words, grams, edges), tuple(len(g[0]) for g in grams)]
    for k, (lo, hi) in enumerate(zip(ends, ends[1:])):
        if lo != hi:
            yield k, of_grams(t.words, tuple(tuple(c[a:b] for c in g) for g, a, b in zip(grams, lo, hi)))


def sample(t: Transducer, every: int) -> list[list[bytes]]:
    """Phrases at about equal steps of the sorted order, as boundaries."""
    out = []
    for columns in t.grams():
        for k in range(every // 2, len(columns[0]), every):
            out.append([t.words[int(c[k])].as_py()[:EDGE_BYTES] for c in columns[:-1]])
    return out


def lookup(t: Transducer, asked: Transducer) -> tuple[np.ndarray, np.ndarray]:
    """Composition of ``asked`` with ``t``: the counts in ``t`` of the one- and two-word phrases of ``asked`` (0 where there is none)."""
    place = pc.fill_null(pc.index_in(asked.words, value_set=t.words), -1).to_numpy(zero_copy_only=False).astype(np.int64) if len(asked.words) else np.zeros(0, np.int64)
    (a1, n1), (a2, b2, n2), _ = t.grams()
    (x1, _), (x2, y2, _), _ = asked.grams()
    v = max(1, len(t.words))

    def find(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray, ok: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(ok & (keys[at] == wanted), counts[at], 0)

    return find(a1, n1, place[x1], place[x1] >= 0), find(a2 * v + b2, n2, place[x2] * v + place[y2], (place[x2] >= 0) & (place[y2] >= 0))


def needed(t: Transducer) -> Transducer:
    """The parts of the candidates in ``t``; a part's count is 1 and the count of the longest-lived phrase around it."""
    _, (a2, b2, n2), (a3, b3, c3, n3) = t.grams()
    v = max(1, len(t.words))
    one = np.unique(np.r_[a2, b2, a3, c3])
    key, count = np.r_[a3 * v + b3, b3 * v + c3], np.r_[n3, n3]
    order = np.lexsort((-count, key))
    key, count = key[order], count[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    key, count = key[first], count[first] + 1
    none = np.zeros(0, np.int64)
    return of_grams(t.words, ((one, np.ones(len(one), np.int64)), (key // v, key % v, count), (none, none, none, none)))


def scores(a: np.ndarray, l: np.ndarray, r: np.ndarray) -> np.ndarray:
    """floor(1000000 * a * a / (l * r)), exact; products that pass 63 bits are worked out as Python integers."""
    safe = (a < 3_000_000) & (l < 3_000_000_000) & (r < 3_000_000_000)
    out = np.zeros(len(a), np.int64)
    out[safe] = 1_000_000 * a[safe] * a[safe] // (l[safe] * r[safe])
    for k in np.flatnonzero(~safe).tolist():
        out[k] = 1_000_000 * int(a[k]) ** 2 // (int(l[k]) * int(r[k]))
    return out


def best(own: Transducer, answers: Transducer, most: int) -> list[tuple]:
    """(phrase, a, l, r, score) of the first ``most`` candidates of ``own``."""
    _, (a2, b2, n2), (a3, b3, c3, n3) = own.grams()
    v, none = max(1, len(own.words)), np.zeros(0, np.int64)

    def parts(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = np.unique(one), np.unique(two)
        asked = Transducer.build(own.words, ((one, np.ones(len(one), np.int64)), (two // v, two % v, np.ones(len(two), np.int64)), (none, none, none, none)))
        f1, f2 = lookup(answers, asked)
        full = np.zeros(v, np.int64)
        full[one] = f1
        return full, np.stack([two, f2])

    f1, (keys, f2) = parts(np.r_[a2, b2, a3, c3], np.r_[a3 * v + b3, b3 * v + c3])
    two = lambda x, y: f2[np.searchsorted(keys, x * v + y)]
    first, last = two(a3, b3), two(b3, c3)
    cut1, cut2 = scores(n3, f1[a3], last), scores(n3, first, f1[c3])
    later = cut2 < cut1
    a = np.r_[n2, n3]
    l, r = np.r_[f1[a2], np.where(later, first, f1[a3])], np.r_[f1[b2], np.where(later, f1[c3], last)]
    score = np.r_[scores(n2, f1[a2], f1[b2]), np.where(later, cut2, cut1)]
    order = np.lexsort((-a, -score))
    if len(order) > most:  # all that tie with the last one
        z = order[most - 1]
        order = order[(score[order] > score[z]) | ((score[order] == score[z]) & (a[order] >= a[z]))]
    text, rows = own.words.to_pylist(), []
    for k in order.tolist():
        ids = (a2[k], b2[k]) if k < len(a2) else (a3[k - len(a2)], b3[k - len(a2)], c3[k - len(a2)])
        rows.append((b" ".join([text[i] for i in ids]), int(a[k]), int(l[k]), int(r[k]), int(score[k])))
    rows.sort(key=lambda x: (-x[4], -x[1], x[0]))
    return rows[:most]


_SHARDS = pa.schema([("lang", pa.string()), ("words", pa.int64()), ("ngrams", pa.int64()), ("sample", pa.list_(pa.list_(pa.binary()))), ("blob", pa.binary())])


def shards(docs: DataFrame, save: Callable[[DataFrame], DataFrame], size: int = SHARD, every: int = SAMPLE_EVERY) -> DataFrame:
    """A row per shard: its language, numbers of words and of different phrases, sampled phrases, and transducer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def out(lang: str) -> pa.RecordBatch:
            t, words = shard(held.pop(lang))
            sizes.pop(lang)
            n = sum(len(g[0]) for g in t.grams())
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([lang], [words], [n], [sample(t, every)], [t.pack()]), _SHARDS)], schema=_SHARDS)

        for part, texts in blocks(batches):
            for lang, text in zip(part.column(0).to_pylist(), texts):
                if sizes.get(lang, 0) + len(text) > size and lang in held:
                    yield out(lang)
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text) + 1
                if sum(sizes.values()) > 2 * size:
                    yield out(max(sizes, key=sizes.get))
        for lang in list(held):
            yield out(lang)

    slim = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return save(slim.mapInArrow(run, "lang string, words long, ngrams long, sample array<array<binary>>, blob binary"))


def boundaries(made: DataFrame, total: int, ranges: int) -> list[tuple[str, tuple[bytes, ...]]]:
    """Phrases that part the order of all languages' phrases into about ``ranges`` equal ranges, from a bounded sample."""
    rows = made.select("lang", F.explode("sample").alias("phrase"))
    thin = max(1, total // SAMPLE_EVERY // (PER_RANGE * ranges))
    if thin > 1:
        rows = rows.filter(F.pmod(F.xxhash64("lang", "phrase"), F.lit(thin)) == 0)
    found = sorted((r["lang"].encode(), tuple(bytes(w) for w in r["phrase"])) for r in rows.collect())
    step = max(1.0, len(found) / ranges)
    picked = sorted({found[int(k * step)] for k in range(1, ranges) if int(k * step) < len(found)})
    return [(lang.decode(), phrase) for lang, phrase in picked]


class Ranges:
    """Prefix ranges over (language, phrase): range k begins at boundary k - 1."""

    def __init__(self, edges: list[tuple[str, tuple[bytes, ...]]]):
        self.keys = [(lang.encode(), phrase) for lang, phrase in edges]

    def split(self, lang: str, t: Transducer) -> Iterator[tuple[int, Transducer]]:
        code = lang.encode()
        lo, hi = bisect_left(self.keys, (code,)), bisect_left(self.keys, (code + b"\0",))
        for k, part in slices(t, [phrase for _, phrase in self.keys[lo:hi]]):
            yield lo + k, part


_CUT = "range long, lang string, origin long, blob binary"
_CUT_NAMES = ["range", "lang", "origin", "blob"]
_CUT_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.binary()]


def _cut_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, _CUT_TYPES)], _CUT_NAMES)


def mine(
    docs: DataFrame, save: Callable[[DataFrame], DataFrame], least: int = 10, inside: int = 50, most: int = 2000, size: int = SHARD, range_ngrams: int = RANGE_NGRAMS, every: int = SAMPLE_EVERY
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``most`` phrases of two or three words.

    a is the phrase's count (``least`` at least), l and r the counts of the parts at the cut
    with the lowest score floor(1000000 a a / (l r)) (the first of equal ones), n the
    language's words. A phrase inside a longer candidate with at least ``inside`` percent
    of its count is left out. Phrases don't cross pieces, texts or languages; a null language
    is ``und``. Null and empty texts have no words; repeated rows count again; extra columns
    are not read; an empty table gives an empty result. Words are compared byte by byte.

    The driver sees a bounded sample of phrases, which only decides where ranges begin.
    """
    spark = docs.sparkSession
    made = shards(docs, save, size, every)
    total = made.agg(F.coalesce(F.sum("ngrams"), F.lit(0)).alias("n")).first()["n"]
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(MOST_RANGES, max(1, -(-total // range_ngrams), min(wide, total // (8 * every))))
    shared = spark.sparkContext.broadcast(Ranges(boundaries(made, total, ranges)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, blob in zip(*(batch.column(i).to_pylist() for i in range(2))):
                for k, part in shared.value.split(lang, Transducer.unpack(blob)):
                    yield _cut_batch([(k, lang, -1, part.pack())])

    def unite(key: tuple, table: pa.Table) -> pa.Table:
        k, lang = (x.as_py() for x in key)
        t = union([Transducer.unpack(b) for b in table.column("blob").to_pylist()], least)
        return pa.Table.from_batches([_cut_batch([(k, lang, k, t.pack())] if len(t.words) else [])])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, lang, blob in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                for to, part in shared.value.split(lang, needed(Transducer.unpack(blob))):
                    yield _cut_batch([(to, lang, k, part.pack())])

    def answer(key: tuple, owned: pa.Table, asked: pa.Table) -> pa.Table:
        """Counts for all that asked (to ``origin``), and the range's own candidates that no longer one covers (origin -1)."""
        k, lang = (x.as_py() for x in key)
        if not owned.num_rows:
            return pa.Table.from_batches([_cut_batch([])])
        t = Transducer.unpack(owned.column("blob")[0].as_py())
        one, (a2, b2, n2), three = t.grams()
        longer, rows, v = np.zeros(len(n2), np.int64), [], max(1, len(t.words))
        for origin, blob in zip(asked.column("origin").to_pylist(), asked.column("blob").to_pylist()):
            q = Transducer.unpack(blob)
            f1, f2 = lookup(t, q)
            (x1, _), (x2, y2, m2), none = q.grams()
            place = pc.fill_null(pc.index_in(q.words, value_set=t.words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            np.maximum.at(longer, np.searchsorted(a2 * v + b2, place[x2] * v + place[y2]), m2 - 1)
            rows.append((origin, lang, k, Transducer.build(q.words, ((x1, f1), (x2, y2, f2), none)).pack()))
        keep = 100 * longer < inside * n2
        rows.append((k, lang, -1, of_grams(t.words, ((one[0][:0], one[1][:0]), (a2[keep], b2[keep], n2[keep]), three)).pack()))
        return pa.Table.from_batches([_cut_batch(rows)])

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        lang = key[1].as_py()
        rows = []
        origin, blobs = table.column("origin").to_pylist(), table.column("blob").to_pylist()
        got = [Transducer.unpack(b) for o, b in zip(origin, blobs) if o >= 0]
        for o, b in zip(origin, blobs):
            if o < 0 and got:
                rows = best(Transducer.unpack(b), union(got), most)
        c = list(zip(*rows)) if rows else [[]] * 5
        columns = [pa.array([lang] * len(rows), pa.string()), pa.array([p.decode("utf-8", "replace") for p in c[0]], pa.string()), *[pa.array(x, pa.int64()) for x in c[1:]]]
        return pa.Table.from_arrays(columns, names=["lang", "phrase", "a", "l", "r", "score"])

    keys = ["range", "lang"]
    united = save(made.select("lang", "blob").mapInArrow(cut, _CUT).groupBy(*keys).applyInArrow(unite, _CUT))
    asked = united.mapInArrow(ask, _CUT)
    answered = united.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(answer, _CUT)
    found = answered.groupBy(*keys).applyInArrow(finish, "lang string, phrase string, a long, l long, r long, score long")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    top = found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)
    counts = made.groupBy("lang").agg(F.sum("words").alias("n"))
    return top.join(counts, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: the same rows by grouping whole phrases as texts
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_, coalesce(lang, 'und') AS lang,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents
), p AS (
  SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(ps) AS x FROM d)
), g AS (
  SELECT lang, 1 AS k, unnest(ws) AS phrase FROM p
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM p
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM p
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS MATERIALIZED (
  SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10
), m AS MATERIALIZED (
  SELECT lang, phrase, f FROM f WHERE f >= 10
), q AS MATERIALIZED (
  SELECT *, array_to_string(w[:cut], ' ') AS first_, array_to_string(w[cut + 1:], ' ') AS rest_ FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)
), s AS (
  SELECT q.lang, q.phrase, cut, q.f AS a, x.f AS l, y.f AS r, CAST((1000000 * CAST(q.f AS HUGEINT) * q.f) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM q JOIN m x ON x.lang = q.lang AND x.phrase = first_ JOIN m y ON y.lang = q.lang AND y.phrase = rest_
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), t AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, f FROM c WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], f FROM c WHERE k = 3) GROUP BY ALL
), o AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
  FROM b LEFT JOIN t ON t.lang = b.lang AND t.phrase = b.phrase WHERE t.f IS NULL OR 100 * t.f < 50 * a
)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""
