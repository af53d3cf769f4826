import collections
import itertools
import math
import re
import zlib

import numpy as np
import pytest

from trajspark.llm import exchange, pitmanyor
from trajspark.llm.queries import QUERIES
from trajspark.session import write_table

from llm_helpers import SF001, rows_of, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """The columns that don't depend on the model."""
    docs = []
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        docs.append((i, zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, [*WORD.findall(low), None]))
    count = collections.Counter(w for _, held, ws in docs if not held for w in ws)
    n, v = sum(count.values()), len(count)
    return [(i, held, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, held, ws in docs]


def fixed(rows):
    return [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows]


def test_query_counts_and_held_out_gain(spark, small):
    got = QUERIES["op3_lm_scoring"](spark, SF001).collect()
    same(fixed(got), brute(rows_of(small)))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 and abs(r["perplexity"] - 10 ** (-r["score"] / r["n_tokens"])) < 1e-6 * r["perplexity"] for r in got)


@pytest.mark.parametrize("table", ["odd", "empty"])
def test_odd_rows(request, table, tmp_path, spark):
    docs = request.getfixturevalue(table)
    docs.write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    got = pitmanyor.score(docs, write_table).collect()
    same(fixed(got), brute(rows_of(docs)))
    assert all(math.isfinite(r["score"]) for r in got)


def test_probabilities_add_up(spark, tmp_path, monkeypatch):
    """Texts of up to two words over a closed vocabulary and one unseen word: P(start w end) over P(end | w) sums to 1."""
    learn = [i for i in range(400) if not pitmanyor.is_held_out(i)]
    rng = np.random.default_rng(1)
    vocab = list("abcde")
    rows = [(i, " ".join(rng.choice(vocab, int(rng.integers(0, 6)), p=[0.5, 0.2, 0.15, 0.1, 0.05]))) for i in learn]
    held = [i for i in range(400, 3000) if pitmanyor.is_held_out(i)]
    asked = ["", *vocab, "new", *(f"{a} {b}" for a, b in itertools.product([*vocab, "new"], repeat=2)), *(f"a b {x}" for x in [*vocab, "new"])]
    rows += list(zip(held, asked))
    monkeypatch.setattr(pitmanyor, "HOT_SHARE", 1.0)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    got = {r["doc_id"]: 10 ** r["score"] for r in pitmanyor.score(spark.read.parquet(str(tmp_path / "t")), write_table).collect()}
    p = dict(zip(asked, (got[i] for i in held)))
    # P(end | start) + sum_w P(w | start) = 1, with P(w | start) = P(w, then any two more steps), bounded from below by shorter texts
    total = p[""] + sum(p[w] for w in [*vocab, "new"]) + sum(p[f"{a} {b}"] for a, b in itertools.product([*vocab, "new"], repeat=2))
    assert 0.1 < total < 1
    # one step: sum over w of P("a b w") / P("a b") = (1 - P(end | b)) * mean of P(end | w): check against the same ratio for "b"
    one = sum(p[f"a b {w}"] / p["a b"] for w in [*vocab, "new"])
    two = sum(p[f"b {w}"] / p["b"] for w in [*vocab, "new"])
    assert abs(one - two) < 1e-9


def test_hot_contexts_dealt_to_buckets_change_little(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["the " + str(rng.choice(["x", "y", "z", f"w{i}"])) for _ in range(30)])) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    one = {r["doc_id"]: r["score"] for r in pitmanyor.score(docs, write_table).collect()}
    made = pitmanyor.Sizes.of
    monkeypatch.setattr(pitmanyor.Sizes, "of", classmethod(lambda cls, b, d: pitmanyor.Sizes(3, 6, made(b, d).words)))
    two = {r["doc_id"]: r["score"] for r in pitmanyor.score(docs, write_table).collect()}
    assert np.allclose([one[i] for i in one], [two[i] for i in one], rtol=0.1)


def test_sampler_draws_from_the_seating_distribution():
    """One restaurant, two dishes: compare with all seatings counted one customer after another."""
    d, s, parent, c = 0.6, 1.5, [0.3, 0.1], [4, 3]
    exact = collections.Counter()
    stirling = pitmanyor._stirling(d)
    for a, b in itertools.product(range(1, 5), range(1, 4)):
        w = math.prod(s + d * j for j in range(a + b)) * parent[0] ** a * parent[1] ** b
        exact[a, b] = w * math.exp(stirling[4, a] + stirling[3, b])
    z = sum(exact.values())
    rng = np.random.default_rng(0)
    houses = 4000
    got = pitmanyor.seat(rng, np.tile(c, houses), np.repeat(np.arange(houses), 2), houses, np.tile(parent, houses), d, s, samples=1, sweeps=12)[0].reshape(-1, 2)
    for t in (0, 1):
        for k in range(1, c[t] + 1):
            want = sum(v for key, v in exact.items() if key[t] == k) / z
            assert abs((got[:, t] == k).mean() - want) < 0.05
    # S(c, t) by hand: S(3, 2) = 3 * (1 - d)
    assert math.isclose(math.exp(stirling[3, 2]), 3 * (1 - d))


def exact_tables(c, other, parent, d, s, top=5000):
    """Mean and deviation of a dish's tables from all weights."""
    log = np.full(top + 2, -np.inf)
    log[0] = 0.0
    t = np.arange(top + 2)
    with np.errstate(divide="ignore"):
        for k in range(c):
            log = np.logaddexp(log + np.log(np.maximum(k - d * t, 0)), np.r_[-np.inf, log[:-1]])
    t = np.arange(1, c + 1)
    w = np.cumsum(np.log(s + d * (other + t - 1))) + np.log(parent) * t + log[1 : c + 1]
    w = np.exp(w - w.max())
    mean = (w * t).sum() / w.sum()
    return mean, ((w * (t - mean) ** 2).sum() / w.sum()) ** 0.5


@pytest.mark.parametrize("c, other, parent", [(32, 1000, 0.05), (200, 1000, 0.05), (256, 0, 0.2), (257, 1000, 0.05), (1000, 1000, 0.05), (1000, 1000, 0.005), (5000, 0, 0.2), (1000, 20000, 0.05), (1000, 200000, 0.05), (3000, 2000, 0.3)])
def test_tables_of_frequent_dishes_follow_their_conditional(c, other, parent):
    """One dish beside ``other`` tables that stay: another dish of as many customers, one a table, that the parent surely has."""
    d, s, n = 0.8, 1.0, 4000
    rng = np.random.default_rng(0)
    mean, spread = exact_tables(c, other, parent, d, s)
    if c > pitmanyor.EXACT:
        got = pitmanyor._many(rng, np.full(n, c), np.full(n, other), np.full(n, parent), d, s)
    else:
        customers, house = np.full(n, c), np.arange(n)
        alone = np.ones(n * min(other, 40), np.int64)  # dishes with one customer have one table
        other = min(other, 40)
        mean, spread = exact_tables(c, other, parent, d, s)
        got = pitmanyor.seat(rng, np.r_[customers, alone], np.r_[house, np.repeat(house, other)], n, np.full(n * (1 + other), parent), d, s, samples=1, sweeps=1)[0][:n]
    assert abs(got.mean() - mean) < 0.02 * mean + 3 * spread / n**0.5 and abs(got.std() - spread) < 0.08 * spread + 0.05


def test_score_equals_a_plain_sampler(spark, tmp_path):
    """The model's log-probabilities against a one-machine sampler that seats customers one by one at tables."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "d", f"x{i % 9}"], int(rng.integers(1, 9)), p=[0.4, 0.3, 0.15, 0.1, 0.05]))) for i in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    got = {r["doc_id"]: r["score"] for r in pitmanyor.score(spark.read.parquet(str(tmp_path / "t")), write_table).collect()}
    learn = [["<s>", *t.split(), "</s>"] for i, t in rows if not pitmanyor.is_held_out(i)]
    vocabulary = {w for ws in learn for w in ws[1:]}
    d, s, e, q = pitmanyor.DISCOUNT, pitmanyor.STRENGTH, pitmanyor.ROOT_DISCOUNT, pitmanyor.ROOT_STRENGTH
    customers = [(ws[k], ws[k + 1]) for ws in learn for k in range(len(ws) - 1)]
    seats: dict = collections.defaultdict(lambda: collections.defaultdict(list))  # context, word: sizes of tables
    top: dict = collections.defaultdict(list)
    base = 1 / (len(vocabulary) + 1)

    def add(tables, new, mass, enter):
        r = rng.random() * (sum(tables) - mass * len(tables) + new)
        for k, size in enumerate(tables):
            r -= size - mass
            if r < 0:
                tables[k] += 1
                return
        tables.append(1)
        enter()

    def leave(tables):
        k = rng.choice(len(tables), p=np.array(tables) / sum(tables))
        tables[k] -= 1
        if not tables[k]:
            tables.pop(k)
            return True
        return False

    def root(w):
        n, t = sum(map(sum, top.values())), sum(map(len, top.values()))
        own = top.get(w, [])
        return (sum(own) - e * len(own) + (q + e * t) * base) / (q + n)

    def root_add(w):
        add(top[w], (q + e * sum(map(len, top.values()))) * base, e, lambda: None)

    def prob(c, w):
        house = seats.get(c, {})
        own = house.get(w, [])
        opened, n = sum(map(len, house.values())), sum(map(sum, house.values()))
        return (sum(own) - d * len(own) + (s + d * opened) * root(w)) / (s + n)

    mean, kept = collections.Counter(), 0
    asked = {(ws[k], ws[k + 1]) for ws in (["<s>", *t.split(), "</s>"] for _, t in rows) for k in range(len(ws) - 1)}
    for sweep in range(14):
        for c, w in customers:
            tables = seats[c][w]
            if sweep and leave(tables):
                leave(top[w])
            add(tables, (s + d * sum(map(len, seats[c].values()))) * root(w), d, lambda: root_add(w))
        if sweep >= 6:
            kept += 1
            for a in asked:
                mean[a] += prob(*a)
    want = {}
    for i, t in rows:
        ws = ["<s>", *t.split(), "</s>"]
        want[i] = sum(math.log10(mean[ws[k], ws[k + 1]] / kept) for k in range(len(ws) - 1))
    # the distributed sampler knows only a bucket's words when it seats the root
    assert all(abs(got[i] - want[i]) < 0.1 * abs(want[i]) + 0.1 for i in want)
    assert abs(sum(got.values()) - sum(want.values())) < 0.03 * abs(sum(want.values()))


def test_answers_are_bundled():
    parts = [b"", b"abc", bytes(1000)]
    assert exchange.unbundle(exchange.bundle(parts)) == parts


def test_scores_do_not_depend_on_the_chunks(spark, tmp_path, monkeypatch):
    """The root's customers are the tables of the merged restaurants, however many chunks a pair occurs in."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["new york", *rng.choice([f"w{k}" for k in range(40)], 12), f"own{i}"])) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    one = {r["doc_id"]: r["score"] for r in pitmanyor.score(docs, write_table).collect()}
    monkeypatch.setattr(pitmanyor, "chunks", lambda docs: exchange.chunks(docs, size=600))
    many = {r["doc_id"]: r["score"] for r in pitmanyor.score(docs, write_table).collect()}
    assert np.allclose([one[i] for i in one], [many[i] for i in one], rtol=1e-9)
