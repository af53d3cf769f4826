"""Language-model scoring with a hierarchical Pitman-Yor model of word pairs.

Every context (the word before, or the start of the text) is a restaurant whose
customers are the words that followed it; each of its tables sends a customer to the
one root restaurant of words, whose base is uniform over the vocabulary and one unseen
word. Seatings are Gibbs-sampled: in turn the numbers of tables of the dishes with equally
many customers are drawn given all other tables. Predictive probabilities are averaged over the samples.

The sampler is distributed. Buckets of contexts seat all customers of their
restaurants and send the tables of each word to the buckets of words, which seat them
as the root's customers. The first seating takes the frequency of the words in the
bucket as the parent's probabilities; the root that it fills is the parent of the
second seating, whose tables make the root that scores. So the chunks of documents
only say who the customers are. A context with more customers than a bucket is to hold
is dealt to several by the following word; its parts are seated apart and their tables
added up.

Contexts are told apart by 36 bits of a hash and their dishes by 28; words as such by 64.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import bucket_bits, bundle, chunks, documents, pack, pack_sorted, unbundle, unpack, unpack_sorted
from .text import NON_SPACE, Words, mix

#: rows with remainder 0 of crc32(doc_id) by this are held out
FOLDS = 10
SAMPLES, SWEEPS = 2, 3
DISCOUNT, STRENGTH = 0.8, 1.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.5, 1.0
#: numbers of tables of dishes with up to so many customers are drawn from tabled weights, beyond from their saddle-point form
EXACT = 256
#: a context is dealt to several buckets from this share of all words on (at most so many contexts)
HOT_SHARE = 1 / 65536
CONTEXT_BITS, DISH_BITS = 36, 28
START, END = np.uint64(0x5A17), np.uint64(0xE4D)


@cache
def _stirling(discount: float) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t) up to EXACT."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    with np.errstate(divide="ignore"):
        for c in range(EXACT):
            t = np.arange(EXACT + 1)
            stay = out[c] + np.log(np.maximum(c - discount * t, 0))
            out[c + 1] = np.logaddexp(stay, np.r_[-np.inf, out[c][:-1]])
    return out


def seat(rng: np.random.Generator, customers: np.ndarray, house: np.ndarray, houses: int, parent: np.ndarray, discount: float, strength: float, samples: int = SAMPLES, sweeps: int = SWEEPS) -> list[np.ndarray]:
    """Samples of the number of tables of each dish.

    ``customers`` of each dish (0 allowed), the restaurant it is in, and its probability
    in the parent. A sweep draws every dish's tables t from S(c, t) * prod_{j<t}
    (strength + discount * (tables of the other dishes + j)) * parent^t. Dishes with
    equally many customers are drawn together, given the tables drawn so far of all others;
    those beyond EXACT come in one block of their own (see ``_many``).
    """
    tables = np.minimum(customers, 1)
    out = []
    total = np.bincount(house, tables, houses).astype(np.int64)
    more = np.flatnonzero(customers > 1)
    by = more[np.argsort(np.minimum(customers[more], EXACT + 1), kind="stable")]
    size = np.minimum(customers[by], EXACT + 1)
    cut = np.searchsorted(size, np.arange(2, EXACT + 3))
    log_parent = np.log(np.maximum(parent, 1e-300))
    stirling = _stirling(discount)

    def put(rows: np.ndarray, drawn: np.ndarray) -> None:
        np.add.at(total, house[rows], drawn - tables[rows])
        tables[rows] = drawn

    for sweep in range(max(sweeps, samples)):
        for c in range(2, EXACT + 1):
            a, b = int(cut[c - 2]), int(cut[c - 1])
            step = max(1, (1 << 20) // c)
            for k in range(a, b, step):
                rows = by[k : min(b, k + step)]
                other = total[house[rows]] - tables[rows]
                t = np.arange(c)
                weight = np.cumsum(np.log(strength + discount * (other[:, None] + t)), axis=1) + log_parent[rows][:, None] * (t + 1) + stirling[c, 1 : c + 1]
                weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
                put(rows, (weight < rng.random(len(rows))[:, None] * weight[:, -1:]).sum(axis=1) + 1)
        rows = by[int(cut[EXACT - 1]) :]
        if len(rows):
            put(rows, _many(rng, customers[rows], total[house[rows]] - tables[rows], parent[rows], discount, strength))
        if sweep >= max(sweeps, samples) - samples:
            out.append(tables.copy())
    return out


def _many(rng, customers, other, parent, discount, strength) -> np.ndarray:
    """Tables of dishes with many customers, from the saddle-point form of the same weights.

    S(c, t) is the coefficient of z^c in ((1 - (1 - z)^d) / d)^t c! / t!; with z = 1 - u at its
    saddle point the weights' ratio is (1 - u^d) * parent * (strength / d + other + t) / t. So t - 1 is
    negative binomial with q = (1 - u^d) * parent (exactly so as c grows, where u is 0);
    beyond 50 tables it is drawn as normal with the curvature at the mode, which
    also holds where nearly every customer has a table. Means are within 3 % of exact sums
    at EXACT customers and nearer beyond.
    """
    c, base = customers.astype(np.float64), strength / discount + other
    parent = np.clip(parent, 1e-300, 1 - 1e-12)
    lo, hi = np.full(len(c), -60.0), np.full(len(c), -1e-12)  # of log u
    for _ in range(50):
        x = (lo + hi) / 2
        full = -np.expm1(discount * x)
        ours = np.log(c / discount) - np.log(-np.expm1(x)) - (discount - 1) * x + np.log(full)
        up = ours > np.log(full * base * parent) - np.log1p(-full * parent)
        hi, lo = np.where(up, x, hi), np.where(up, lo, x)
    full = -np.expm1(discount * x)
    q = full * parent
    mode = full * base * parent / (1 - q)
    slope = discount * np.exp((discount - 1) * x) / full
    bend = -slope - 1 / np.expm1(x) + (1 - discount) * np.exp(-x)
    spread = 1 / np.maximum(slope / (mode * bend) - 1 / (base + mode) + 1 / mode, 1e-300)
    few = 1 + rng.negative_binomial(base + 1, 1 - q)
    lots = np.rint(mode + 1 / (1 - q) + np.sqrt(spread) * rng.standard_normal(len(c)))
    return np.clip(np.where(mode < 50, few, lots), 1, customers).astype(np.int64)


@dataclass
class Sizes:
    word_bits: int
    pair_bits: int
    words: int

    @classmethod
    def of(cls, n_bytes: int, n_docs: int) -> Sizes:
        words = max(1, n_bytes // 6 + n_docs)
        return cls(bucket_bits(words / 4), bucket_bits(words), words)


def is_held_out(doc_id: int | None, folds: int = FOLDS) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0


class Tokens:
    """A chunk's tokens: hashes, contexts, and which of them the model learns from."""

    def __init__(self, blob: bytes):
        self.ids, texts = documents(blob)
        w = Words(texts, NON_SPACE, lower=True)
        docs = len(texts)
        self.lens = w.counts + 1
        self.first = np.r_[0, np.cumsum(self.lens)]
        self.hash = np.empty(len(w) + docs, np.uint64)
        end = self.first[1:] - 1
        inner = np.ones(len(self.hash), bool)
        inner[end] = False
        self.hash[inner] = w.hash
        self.hash[end] = END
        self.context = np.r_[START, self.hash[:-1]]
        self.context[self.first[:-1]] = START
        self.held = np.array([is_held_out(i) for i in self.ids], bool)
        self.learn = np.repeat(~self.held, self.lens)

    def distinct(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys, the number of each token's key, and how many learnt tokens have each."""
        by = np.argsort(keys)
        ordered = keys[by]
        head = np.r_[True, ordered[1:] != ordered[:-1]]
        number = np.empty(len(keys), np.int64)
        number[by] = np.cumsum(head) - 1
        first = np.flatnonzero(head)
        return ordered[head], number, np.add.reduceat(self.learn[by].astype(np.int64), first)

    def words(self):
        return self.distinct(self.hash)

    def pairs(self):
        return self.distinct(pair_keys(self.context, self.hash))


def pair_keys(context: np.ndarray, dish: np.ndarray) -> np.ndarray:
    top = mix(context + np.uint64(77)) >> np.uint64(64 - CONTEXT_BITS)
    return top << np.uint64(DISH_BITS) | dish >> np.uint64(64 - DISH_BITS)


def _rest(dish: np.ndarray) -> np.ndarray:
    """The bits of words that are not in their pair keys."""
    return dish & np.uint64((1 << (64 - DISH_BITS)) - 1)


def _dish(keys: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (keys & np.uint64((1 << DISH_BITS) - 1)) << np.uint64(64 - DISH_BITS) | rest


def _contexts(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(DISH_BITS)).astype(np.int64)


@dataclass
class Hot:
    """Contexts that are dealt to several buckets: sorted keys, numbers of parts, and all their tables once known."""

    keys: np.ndarray
    parts: np.ndarray
    tables: np.ndarray | None = None

    def find(self, contexts: np.ndarray) -> np.ndarray:
        """Place of each context, -1 if it is not hot."""
        if not len(self.keys) or not len(contexts):
            return np.full(len(contexts), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, contexts), len(self.keys) - 1)
        return np.where(self.keys[at] == contexts, at, -1)


def _house(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Restaurant number of each sorted key, and where each restaurant starts."""
    top = keys >> np.uint64(DISH_BITS)
    first = np.flatnonzero(np.r_[True, top[1:] != top[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys)])), first


def _deal(keys: np.ndarray, sizes: Sizes, hot: Hot) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted pair keys by bucket, and the buckets in that order. Hot contexts are dealt by dish."""
    bucket = (keys >> np.uint64(64 - sizes.pair_bits)).astype(np.int64)
    if len(hot.keys) and len(keys):
        house, first = _house(keys)
        at = hot.find(_contexts(keys[first]))
        parts = np.ones(len(first), np.int64)
        parts[at >= 0] = hot.parts[at[at >= 0]]
        part = (keys & np.uint64((1 << DISH_BITS) - 1)).astype(np.int64) % parts[house]
        bucket = (bucket + part) & ((1 << sizes.pair_bits) - 1)
    by = np.argsort(bucket, kind="stable")
    return by, bucket[by]


_ASK = "bucket int, chunk long, n int, keys binary, more binary"
_ASK_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("more", pa.binary())])
_ANSWER = "chunk long, kind int, bucket int, n int, keys binary, data binary, key long, sums array<bigint>"
_ANSWER_ARROW = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("data", pa.binary()), ("key", pa.int64()), ("sums", pa.list_(pa.int64()))])
#: kinds of answers to chunks: words, pairs; of sums that are added up by key: totals, hot words, hot contexts;
#: and of rows between buckets: what a bucket of pairs keeps, tables that it sends to the root, the root's answer
WORDS, PAIRS, TOTALS, HOT, HOUSES, KEPT, SENT, ROOT = range(8)


def _sums(kind: int, key: int, sums: list[int], bucket: int) -> tuple:
    return None, kind, bucket, None, None, None, key, sums


def _table(rows: list, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _runs(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for a, b in zip(cut, [*cut[1:], len(bucket)]):
        yield int(bucket[a]), slice(int(a), int(b))


def _merge(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's rows: sizes of the rows, distinct keys, each entry's key number, the rows' first entries."""
    n = table.column("n").to_numpy()
    keys = np.concatenate([unpack_sorted(x) for x in table.column("keys").to_pylist()])
    by = np.argsort(keys)
    head = np.r_[True, keys[by][1:] != keys[by][:-1]]
    number = np.empty(len(keys), np.int64)
    number[by] = np.cumsum(head) - 1
    return n, keys[by][head], number, np.r_[0, np.cumsum(n)]


def _count_words(table: pa.Table, sizes: Sizes) -> pa.Table:
    """Totals and hot words of a bucket's words."""
    _, keys, number, _ = _merge(table)
    count = np.bincount(number, np.concatenate([unpack(unbundle(x)[0]) for x in table.column("more").to_pylist()]), len(keys)).astype(np.int64)
    bucket = table.column("bucket")[0].as_py()
    rows = [_sums(TOTALS, 0, [int((count > 0).sum()), int(count.sum())], bucket)]
    hot = np.flatnonzero(count >= max(1, sizes.words * max(HOT_SHARE, 2.0**-sizes.pair_bits)))
    contexts = _contexts(pair_keys(keys[hot], keys[hot]))
    rows += [_sums(HOT, k, [c], bucket) for k, c in zip(contexts.tolist(), count[hot].tolist())]
    return _table(rows, _ANSWER_ARROW)


#: stands for the chunk in the rows that a bucket of words keeps for itself
KEEPER = np.iinfo(np.int64).min


def _sent(bucket: int, dish: np.ndarray, samples: list[np.ndarray], runs, words: np.ndarray | None = None) -> list[tuple]:
    """Tables of each word in a bucket of pairs, to the buckets of words (``runs`` of them). The sender's number is
    negative, unlike a chunk's. The words go along the first time only."""
    runs = list(runs)
    total = [np.bincount(dish, t, runs[-1][1].stop if runs else 0).astype(np.int64) for t in samples]
    return [(-1 - bucket, SENT, b, s.stop - s.start, None if words is None else pack_sorted(words[s]), bundle([pack(x[s]) for x in total]), None, None) for b, s in runs]


def _seat_pairs(table: pa.Table, sizes: Sizes, hot: Hot) -> pa.Table:
    """First seating of a bucket's restaurants: its tables to the root, and what the second seating needs."""
    n, keys, number, _ = _merge(table)
    bucket = table.column("bucket")[0].as_py()
    customers, rest = (np.concatenate([unpack(x) for x in part]) for part in zip(*(unbundle(m) for m in table.column("more").to_pylist())))
    count = np.bincount(number, customers, len(keys)).astype(np.int64)
    others = np.empty(len(keys), np.uint64)
    others[number] = rest
    words, dish = np.unique(_dish(keys, others), return_inverse=True)
    house, first = _house(keys)
    share = np.bincount(dish, count, len(words)) / max(1, count.sum())
    tables = seat(np.random.default_rng(bucket), count, house, len(first), share[dish], DISCOUNT, STRENGTH, samples=1)
    contexts = _contexts(keys[first])
    mine = np.flatnonzero(hot.find(contexts) >= 0)
    chunk = np.array(table.column("chunk").to_pylist(), np.int64)
    kept = bundle([pack(chunk), pack(n), _pack_entries(number, n, len(keys)), pack(count), pack(dish), pack(np.diff(house, prepend=-1)), pack(mine), pack(contexts[mine])])
    return _table([(None, KEPT, bucket, None, None, kept, None, None), *_sent(bucket, dish, tables, _runs((words >> np.uint64(64 - sizes.word_bits)).astype(np.int64)), words)], _ANSWER_ARROW)


def _seat_root(table: pa.Table) -> pa.Table:
    """Root customers and root tables of a bucket's words, to the buckets of pairs, in the order in which they sent
    the words; and, for the second round, the words and who sent which of them, so that words travel once."""
    n, keys, number, cut = _merge(table)
    bucket = table.column("bucket")[0].as_py()
    senders = np.array([-1 - x for x in table.column("chunk").to_pylist()], np.int64)
    customers = np.bincount(number, np.concatenate([unpack(unbundle(x)[0]) for x in table.column("more").to_pylist()]), len(keys)).astype(np.int64)
    tables = _root_tables(np.random.default_rng(bucket), customers)
    rows = [(bucket, ROOT, who, None, None, bundle([pack(x[number[a:b]]) for x in (customers, tables)]), None, None) for who, a, b in zip(senders.tolist(), cut, cut[1:])]
    kept = bundle([pack(senders), pack(n), _pack_entries(number, n, len(keys)), pack_sorted(keys)])
    return _table([*rows, (None, KEPT, bucket, None, None, kept, None, None), _sums(TOTALS, 0, [int(customers.sum()), int(tables.sum())], bucket)], _ANSWER_ARROW)


def _root_tables(rng: np.random.Generator, customers: np.ndarray) -> np.ndarray:
    # the root's other tables are not known here; the words of the bucket stand for all
    base = 1.0 / max(1, int((customers > 0).sum()))
    return seat(rng, customers, np.zeros(len(customers), np.int64), 1, np.full(len(customers), base), ROOT_DISCOUNT, ROOT_STRENGTH, samples=1)[0]


def _pack_entries(number: np.ndarray, n: np.ndarray, keys: int) -> bytes:
    """Key numbers of rows of ``n`` entries (ascending in a row) as one ascending list."""
    return pack_sorted(number.astype(np.uint64) + np.repeat(np.arange(len(n)), n).astype(np.uint64) * np.uint64(keys))


def _unpack_entries(data: bytes, n: np.ndarray, keys: int) -> np.ndarray:
    return (unpack_sorted(data) - np.repeat(np.arange(len(n)), n).astype(np.uint64) * np.uint64(keys)).astype(np.int64)


def _seat_root_again(table: pa.Table) -> pa.Table:
    """Counts, root customers and root tables (of every sample) of a bucket's words, to all chunks that asked for them."""
    bucket = table.column("bucket")[0].as_py()
    who = table.column("chunk").to_numpy()
    asked = table.filter(pa.array(who >= 0))
    _, keys, number, cut = _merge(asked)
    count = np.bincount(number, np.concatenate([unpack(unbundle(x)[0]) for x in asked.column("more").to_pylist()]), len(keys)).astype(np.int64)
    customers = np.zeros((SAMPLES, len(keys)), np.int64)
    more = table.column("more").to_pylist()
    for k in np.flatnonzero(who == KEEPER).tolist():
        senders, n, entries, words = unbundle(more[k])
        n, words = unpack(n).astype(np.int64), unpack_sorted(words)
        place = np.searchsorted(keys, words)[_unpack_entries(entries, n, len(words))]
        of = dict(zip(unpack(senders).astype(np.int64).tolist(), np.split(place, np.cumsum(n)[:-1])))
        for j in np.flatnonzero((who < 0) & (who != KEEPER)).tolist():
            customers[:, of[-1 - int(who[j])]] += np.array([unpack(x) for x in unbundle(more[j])], np.int64)
    rng = np.random.default_rng(bucket)
    tables = [_root_tables(rng, c) for c in customers]
    rows = []
    for chunk, a, b in zip(asked.column("chunk").to_pylist(), cut, cut[1:]):
        own = number[a:b]
        rows.append((chunk, WORDS, bucket, None, None, bundle([pack(x[own]) for x in (count, *customers, *tables)]), None, None))
    rows.append(_sums(TOTALS, 0, [int(x.sum()) for x in (*customers, *tables)], bucket))
    return _table(rows, _ANSWER_ARROW)


def _root(customers: np.ndarray, tables: np.ndarray, totals: Totals, k: int) -> np.ndarray:
    """The root's predictive probabilities of words."""
    spare = ROOT_STRENGTH + ROOT_DISCOUNT * totals.tables[k]
    return (customers - ROOT_DISCOUNT * tables + spare / (totals.vocabulary + 1)) / (ROOT_STRENGTH + totals.customers[k])


def _seat_again(table: pa.Table, totals: Totals) -> pa.Table:
    """Second seating, with the root as the parent: customers and tables of pairs and restaurants to all chunks that have them, and tables to the root."""
    bucket = table.column("bucket")[0].as_py()
    kind, data = table.column("kind").to_pylist(), table.column("data").to_pylist()
    chunk, n, entries, *kept = unbundle(data[kind.index(KEPT)])
    chunk, n, count, dish, head, mine, contexts = (unpack(x).astype(np.int64) for x in (chunk, n, *kept))
    house = np.cumsum(head) - 1
    number = _unpack_entries(entries, n, len(count))
    # the root answers by the top bits of the words, so in their order
    answers = sorted((c, d) for k, c, d in zip(kind, table.column("chunk").to_pylist(), data) if k == ROOT)
    parts = [[unpack(x) for x in unbundle(d)] for _, d in answers]
    customers, tables = (np.concatenate(x) for x in zip(*parts))
    ends = np.cumsum([len(c) for c, _ in parts])
    runs = [(c, slice(int(e) - len(p[0]), int(e))) for (c, _), e, p in zip(answers, ends, parts)]
    parent = _root(customers.astype(np.int64), tables.astype(np.int64), totals, 0)
    houses = int(house[-1]) + 1
    samples = seat(np.random.default_rng([bucket, 1]), count, house, houses, parent[dish], DISCOUNT, STRENGTH)
    guests = np.bincount(house, count, houses).astype(np.int64)
    total = [np.bincount(house, t, houses).astype(np.int64) for t in samples]
    rows = []
    cut = np.r_[0, np.cumsum(n)]
    for to, a, b in zip(chunk.tolist(), cut, cut[1:]):
        own = number[a:b]
        some = own[count[own] > 1]
        place = np.unique(house[own])
        rows.append((to, PAIRS, bucket, None, None, bundle([pack(x) for x in (count[own], *(t[some] for t in samples), guests[place], *(t[place] for t in total))]), None, None))
    rows += [_sums(HOUSES, c, [int(t[h]) for t in total], bucket) for h, c in zip(mine.tolist(), contexts.tolist())]
    return _table(rows + _sent(bucket, dish, samples, runs), _ANSWER_ARROW)


@dataclass
class Totals:
    vocabulary: int
    tokens: int
    customers: list[int]
    tables: list[int]
    documents: int


def _scores(blob: bytes, answers: pa.Table, sizes: Sizes, totals: Totals, hot: Hot) -> pa.Table:
    """Score a chunk's texts from the answers to its asks."""
    t = Tokens(blob)
    words, word_of, _ = t.words()
    pairs, pair_of, _ = t.pairs()
    data = {(k, b): d for k, b, d in zip(answers.column("kind").to_pylist(), answers.column("bucket").to_pylist(), answers.column("data").to_pylist())}
    count = np.zeros(len(words), np.int64)
    root = np.zeros((SAMPLES, len(words)))
    customers_of, tables_of = np.zeros((SAMPLES, len(words)), np.int64), np.zeros((SAMPLES, len(words)), np.int64)
    for b, s in _runs((words >> np.uint64(64 - sizes.word_bits)).astype(np.int64)):
        got = [unpack(x).astype(np.int64) for x in unbundle(data[WORDS, b])]
        count[s] = got[0]
        customers_of[:, s], tables_of[:, s] = got[1 : 1 + SAMPLES], got[1 + SAMPLES :]
    for k in range(SAMPLES):
        root[k] = _root(customers_of[k], tables_of[k], totals, k)
    by, bucket = _deal(pairs, sizes, hot)
    customers = np.zeros(len(pairs), np.int64)
    tables, opened = np.zeros((SAMPLES, len(pairs))), np.zeros((SAMPLES, len(pairs)))
    guests = np.zeros(len(pairs), np.int64)
    for b, s in _runs(bucket):
        own = by[s]
        c, *rest = (unpack(x).astype(np.int64) for x in unbundle(data[PAIRS, b]))
        customers[own] = c
        house, _ = _house(pairs[own])
        guests[own] = rest[SAMPLES][house]
        for k in range(SAMPLES):
            mine = np.minimum(c, 1)
            mine[c > 1] = rest[k]
            tables[k, own] = mine
            opened[k, own] = rest[SAMPLES + 1 + k][house]
    # a context's customers are the occurrences of its word (of the start: the texts)
    context = np.zeros(len(t.hash), np.int64)
    inner = np.ones(len(t.hash), bool)
    inner[t.first[:-1]] = False
    context[1:] = word_of[:-1]
    all_guests = np.where(inner, count[context], totals.documents)
    part = guests[pair_of]
    house, first = _house(pairs)
    at = hot.find(_contexts(pairs[first]))[house]
    for k in range(SAMPLES):  # a bucket knew a part of a hot context only
        opened[k, at >= 0] = hot.tables[k][at[at >= 0]]
    whole = at[pair_of] >= 0
    guests_of = np.where(whole, all_guests, part)
    mean = np.zeros(len(t.hash))
    for k in range(SAMPLES):
        below = STRENGTH + DISCOUNT * opened[k][pair_of]
        mean += (customers[pair_of] - DISCOUNT * tables[k][pair_of] + below * root[k][word_of]) / (STRENGTH + guests_of)
    log = np.log10(mean / SAMPLES)
    base = np.log10((count + 0.1) / (totals.tokens + 0.1 * (totals.vocabulary + 1)))[word_of]
    cut = t.first[:-1]
    return pa.Table.from_arrays(
        [
            pa.array(t.ids, pa.int64()),
            pa.array(t.held),
            pa.array(t.lens),
            pa.array(np.add.reduceat((count > 0)[word_of].astype(np.int64), cut)),
            pa.array(np.full(len(cut), totals.tokens, np.int64)),
            pa.array(np.add.reduceat(base, cut)),
            pa.array(np.add.reduceat(log, cut)),
        ],
        schema=_SCORES_ARROW,
    )


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORES_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _added(answers: DataFrame, kind: int, n: int) -> dict[int, list[int]]:
    """Sums of a kind by key."""
    rows = answers.filter(F.col("kind") == kind).groupBy("key").agg(*(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(n)))
    return {r["key"]: [r[f"s{k}"] for k in range(n)] for r in rows.collect()}


def score(docs: DataFrame, save) -> DataFrame:
    """Score of every row's whole text by a model learnt from the rows that are not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10
    probability of the text and its end) and perplexity (per token). Null counts as
    empty, so its only token is the end. Rows stay one to one, repeated rows and null
    ids (held out) included. Without a row to learn from, all words are equally likely.
    Further columns are not carried. ``docs`` must give the same partitions each time it
    is read, as a table read from files does; otherwise write it to a table first.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("docs")).first()
    sizes = Sizes.of(size["bytes"], size["docs"])
    table = chunks(docs).select("chunk", "blob")

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = Tokens(blob)
                words, _, count = t.words()
                runs = _runs((words >> np.uint64(64 - sizes.word_bits)).astype(np.int64))
                yield from _table([(b, chunk, s.stop - s.start, pack_sorted(words[s]), bundle([pack(count[s])])) for b, s in runs], _ASK_ARROW).to_batches()

    asked = save(table.mapInArrow(ask_words, _ASK))
    counted = save(asked.groupBy("bucket").applyInArrow(lambda rows: _count_words(rows, sizes), _ANSWER))
    vocabulary, tokens = _added(counted, TOTALS, 2).get(0, [0, 0])
    trained = docs.filter(F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary")) % FOLDS != 0).count()
    # at most 1 / HOT_SHARE contexts
    guests = {k: n for k, (n,) in _added(counted, HOT, 1).items()}
    guests[int(_contexts(pair_keys(np.array([START]), np.array([START])))[0])] = trained
    per_bucket = max(1.0, sizes.words / (1 << sizes.pair_bits))
    parts = {k: int(np.ceil(n / per_bucket)) for k, n in guests.items() if n > per_bucket}
    hot = Hot(np.array(sorted(parts), np.int64), np.array([parts[k] for k in sorted(parts)], np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = Tokens(blob)
                pairs, pair_of, customers = t.pairs()
                rest = np.empty(len(pairs), np.uint64)
                rest[pair_of] = _rest(t.hash)
                by, bucket = _deal(pairs, sizes, shared.value)
                yield from _table([(b, chunk, s.stop - s.start, pack_sorted(pairs[by[s]]), bundle([pack(customers[by[s]]), pack(rest[by[s]])])) for b, s in _runs(bucket)], _ASK_ARROW).to_batches()

    def finish(left: pa.Table, answers: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _SCORES_ARROW.empty_table()
        return _scores(left.column("blob")[0].as_py(), answers, sizes, totals, known.value)

    def totals_of(root: DataFrame, samples: int) -> Totals:
        sums = _added(root, TOTALS, 2 * samples).get(0, [0] * (2 * samples))
        return Totals(vocabulary, tokens, sums[:samples], sums[samples:], trained)

    def sent(seated: DataFrame) -> DataFrame:
        return seated.filter(F.col("kind") == SENT).select("bucket", "chunk", "n", "keys", F.col("data").alias("more"))

    seated = save(table.mapInArrow(ask_pairs, _ASK).groupBy("bucket").applyInArrow(lambda rows: _seat_pairs(rows, sizes, shared.value), _ANSWER))
    root = save(sent(seated).groupBy("bucket").applyInArrow(_seat_root, _ANSWER))
    before = totals_of(root, 1)
    again = seated.filter(F.col("kind") == KEPT).unionByName(root.filter(F.col("kind") == ROOT)).select("bucket", "kind", "chunk", "data")
    of_pairs = save(again.groupBy("bucket").applyInArrow(lambda rows: _seat_again(rows, before), _ANSWER))
    keeper = root.filter(F.col("kind") == KEPT).select("bucket", F.lit(KEEPER).alias("chunk"), F.lit(0).alias("n"), F.lit(None).cast("binary").alias("keys"), F.col("data").alias("more"))
    answered = save(asked.unionByName(sent(of_pairs)).unionByName(keeper).groupBy("bucket").applyInArrow(_seat_root_again, _ANSWER))
    totals = totals_of(answered, SAMPLES)
    opened = _added(of_pairs, HOUSES, SAMPLES)
    hot.tables = np.array([opened.get(k, [0] * SAMPLES) for k in hot.keys.tolist()], np.int64).reshape(-1, SAMPLES).T
    known = docs.sparkSession.sparkContext.broadcast(hot)
    answers = answered.filter(F.col("kind") == WORDS).unionByName(of_pairs.filter(F.col("kind") == PAIRS)).select("chunk", "kind", "bucket", "data")
    scored = table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, _SCORES)
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
