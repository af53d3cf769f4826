import hashlib
import re

import numpy as np
import pytest

from trajspark.llm import decontam
from trajspark.llm.queries import QUERIES

from llm_helpers import SF001, rows_of, same

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=10):
    grams = {}
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - window + 1) if w else 0):
            grams.setdefault(tuple(w[p : p + window]), set()).add(str(i))
    sizes = sorted({len(g) for g in grams})
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                g = grams.get(tuple(w[p : p + n]))
                if g:
                    found |= g
                    hit.update(range(p, p + n))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_query_equals_brute_force(spark):
    docs, items = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute(rows_of(docs), [(r["item_id"], r["text"]) for r in items.collect()])
    assert sum(r[2] > 0 for r in want) > 0
    same(QUERIES["op1_decontamination"](spark, SF001).collect(), want)


@pytest.mark.parametrize("items", [[], [(1, None), (2, ""), (3, "Hello world"), (4, "one two three four five six seven eight nine ten eleven"), (5, "hello"), (5, "É中")]])
def test_odd_rows(spark, odd, empty, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    same(decontam.report(decontam.search(odd, bench)).collect(), brute(rows_of(odd), items))
    assert decontam.report(decontam.search(empty, bench)).collect() == []


def test_small_alphabet_index_finds_all_places():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 3, 500)
    index = decontam.FMIndex(text, 3)
    pats = np.array([text[p : p + 4] for p in range(0, 400, 7)])
    lo, hi = index.search(pats)
    for p, a, b in zip(pats, lo, hi):
        want = [i for i in range(len(text) - 3) if (text[i : i + 4] == p).all()]
        assert sorted(index.locate(np.arange(a, b))) == want


def test_clean_takes_spans_out(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x A b c d e f, g h i j k y"), (2, "a b c"), (3, None)], "doc_id long, text string")
    same(decontam.clean(docs, bench).collect(), [(1, "x  y"), (2, "a b c"), (3, None)])


def test_benchmark_words_that_sums_cannot_tell_apart(spark):
    one, two = "a", "b"
    for _ in range(10):
        one, two = one + two, two + one
    items = spark.createDataFrame([(1, f"x {one} y"), (2, f"x {two} y")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {one.upper()} y"), (2, f"x {two} y z"), (3, "x y")], "doc_id long, text string")
    got = {r["doc_id"]: (r["items"], r["n_hit"]) for r in decontam.search(docs, items).collect()}
    assert got == {1: (["1"], 3), 2: (["2"], 3), 3: ([], 0)}
