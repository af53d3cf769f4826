import re

import numpy as np
import pytest
import xxhash

from trajspark.llm import simhash
from trajspark.session import write_table

from llm_helpers import rows_of, same


def brute_print(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute(rows, bits=4):
    prints = {f: None for f in map(brute_print, {t or "" for _, t in rows})}
    fs = list(prints)
    up = {f: f for f in fs}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= bits:
                up[root(a)] = root(b)
    of = {t: brute_print(t) for t in {t or "" for _, t in rows}}
    least = {}
    for i, t in rows:
        r = root(of[t or ""])
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, f"{of[t or '']:016x}", least.get(root(of[t or ""]))) for i, t in rows]


@pytest.mark.parametrize("table", ["odd", "small", "empty"])
def test_near_dedup_equals_brute_force(request, table, monkeypatch):
    docs = request.getfixturevalue(table)
    same(simhash.near_dedup(docs, write_table).collect(), brute(rows_of(docs)))


def test_golay_keys_meet_at_up_to_two_errors():
    rng = np.random.default_rng(0)
    for bits in (21, 22):
        w = rng.integers(0, 1 << bits, 300)
        for n in (0, 1, 2):
            v = w.copy()
            for row in range(len(v)):
                for b in rng.choice(bits, n, replace=False):
                    v[row] ^= 1 << int(b)
            (ka, na), (kb, nb) = simhash.segment_keys(w, bits), simhash.segment_keys(v, bits)
            for a, x, b, y in zip(ka, na, kb, nb):
                assert set(a[x]) & set(b[y])
                assert len(set(a[x])) == x.sum() <= 6


def test_links_connect_all_close_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = set(base.tolist())
    for f in base.tolist():
        for _ in range(25):
            g = f
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                g ^= 1 << int(b)
            prints.add(g)
    hot = int(base[0])
    prints |= {hot ^ 1 << a ^ 1 << b for a in range(64) for b in range(a)}
    fs = sorted(prints)
    signed = np.array(fs, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = [(np.int64(r["u"]).view(np.uint64), np.int64(r["v"]).view(np.uint64)) for r in simhash.links(df).collect()]
    assert all(int(a ^ b).bit_count() <= 4 for a, b in got)
    x, y = simhash.Forest(), simhash.Forest()
    for a, b in got:
        x.join(int(a), int(b))
    arr = np.array(fs, np.uint64)
    for k in range(len(arr)):
        for m in np.flatnonzero(np.bitwise_count(arr[k] ^ arr[:k]) <= 4):
            y.join(fs[k], fs[m])
    assert [x.root(f) for f in fs] == [y.root(f) for f in fs]


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1001 + i) for i in range(300)]
    df = spark.createDataFrame(chain + hub, "u long, v long")
    got = {r["node"]: r["root"] for r in simhash.components(df, write_table).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{1001 + i: 1000 for i in range(300)}}
