import hashlib
import re

import numpy as np
import pytest

from trajspark.llm import exchange, substring
from trajspark.llm.queries import QUERIES
from trajspark.session import write_table

from llm_helpers import SF001, rows_of, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=13):
    least = {}
    split = [(float("inf") if i is None else i, i, WORD.findall(t or "")) for i, t in rows]
    for o, _, w in split:
        for p in range(len(w) - n + 1):
            g = tuple(w[p : p + n])
            least[g] = min(o, least.get(g, o))
    out = []
    for o, i, w in split:
        gone = set()
        for p in range(len(w) - n + 1):
            if least[tuple(w[p : p + n])] < o:
                gone.update(range(p, p + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_query_equals_brute_force(spark, small):
    want = brute(rows_of(small))
    assert sum(r[2] for r in want) > 0
    same(QUERIES["op2_substring_dedup"](spark, SF001).collect(), want)


@pytest.mark.parametrize("table", ["odd", "empty"])
def test_odd_rows(request, table):
    docs = request.getfixturevalue(table)
    same(substring.report(docs, write_table).collect(), brute(rows_of(docs)))


@pytest.mark.parametrize("size", [200, 5000])
def test_repeats_at_all_offsets_over_many_chunks(spark, monkeypatch, size):
    rng = np.random.default_rng(4)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for i in range(120):
        w = [f"w{int(x)}" for x in rng.integers(0, 6, int(rng.integers(0, 40)))]
        a, n = int(rng.integers(0, 40)), int(rng.integers(5, 30))
        rows.append((int(rng.integers(-50, 50)) if i % 9 else None, " \n".join([*w, *passage[a : a + n], *w[:5]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    made = exchange.chunks
    monkeypatch.setattr(substring, "chunks", lambda docs, save: made(docs, save, size))
    same(substring.report(docs, write_table).collect(), brute(rows))
    texts = {(r["doc_id"], r["n_words"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in substring.dedup(docs, write_table).collect()}
    assert texts == {(i, n, h) for i, n, _, h in brute(rows)}


def test_packing_round_trips():
    rng = np.random.default_rng(0)
    for top in (1, 200, 70000, 2**40, 2**63):
        x = rng.integers(0, top, 500, dtype=np.uint64)
        assert (exchange.unpack(exchange.pack(x)) == x).all()
        assert (exchange.unpack_sorted(exchange.pack_sorted(np.sort(x))) == np.sort(x)).all()
    assert len(exchange.unpack(exchange.pack(np.zeros(0, np.uint64)))) == 0


def twins(k):
    """Two different words of 2^k bytes whose sums of value * base^position are equal modulo 2^64 for large k."""
    a, b = "a", "b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


def test_words_that_sums_cannot_tell_apart(spark):
    head = " ".join(f"w{i}" for i in range(12))
    for k in (6, 10, 12):
        one, two = twins(k)
        docs = spark.createDataFrame([(1, f"{head} {one}"), (2, f"{head} {two}"), (3, f"{head} {one}")], "doc_id long, text string")
        got = {r["doc_id"]: r["n_removed"] for r in substring.report(docs, write_table).collect()}
        assert got == {1: 0, 2: 0, 3: 13}
