import collections
import math
import re

import pytest

from llm_helpers import rows_of, same
from trajspark.llm import ranked
from trajspark.llm.queries import write_table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = [(1, "Hello again, the WORDS of rows"), (2, None), (3, ""), (4, "one two TAIL1 tail3 é中 DE89 w5"), (4, "one two TAIL1 tail3 é中 DE89 w5"), (None, "a1 hello hello world"), (5, "nowhere to be found xyzzy")]


def terms(t):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, best=50):
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    lengths = [sum(b.values()) for _, b in bags]
    n_docs, total = sum(n > 0 for n in lengths), sum(lengths)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for (i, b), n in zip(bags, lengths):
            s = 0
            for t in set(terms(text)) & set(b):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                s += w * ((10**9 * b[t]) // (1000 * b[t] + 20 * (50 + (50 * n * n_docs) // total)))
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(found, key=lambda x: x[:3])[:best], 1)]
    return out


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(*x, 1, 2) for x in ITEMS], "item_id long, text string, rank int, block int")


@pytest.mark.parametrize("table", ["odd", "small", "empty"])
def test_search_equals_brute_force(request, table, items):
    docs = request.getfixturevalue(table)
    want = brute(rows_of(docs), ITEMS)
    assert table == "empty" or len(want) > 50
    same(ranked.search(docs, items, write_table).collect(), want)


def test_many_owners_small_best(spark, odd, items):
    same(ranked.search(odd, items, write_table, best=3, owners=7).collect(), brute(rows_of(odd), ITEMS, 3))


def test_empty_benchmark(odd, items):
    assert ranked.search(odd, items.limit(0), write_table).collect() == []


def test_benchmark_in_parts(spark, odd, items, monkeypatch):
    """The driver deals the items to parts; each part is searched by itself."""
    monkeypatch.setattr(ranked, "PART_BYTES", 60)
    parts = list(ranked._parts(items))
    assert len(parts) > 2 and sum(map(len, parts)) == len(ITEMS)
    same(ranked.search(odd, items, write_table).collect(), brute(rows_of(odd), ITEMS))


def test_more_items_than_a_bundle_and_more_documents_than_a_block(spark):
    docs = spark.createDataFrame([(i, f"t{i % 50} t{i % 7} common") for i in range(2 * ranked.BLOCK_DOCS + 5)], "doc_id long, text string").coalesce(1)
    items = [(i, f"common t{i % 60}") for i in range(ranked.BUNDLE_ITEMS + 9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = ranked.search(docs, bench, write_table, best=2).collect()
    same(got, brute(rows_of(docs), items, 2))
