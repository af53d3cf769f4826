import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from llm_helpers import same
from trajspark.llm import collocation
from trajspark.llm.collocation import Transducer, _binary, cuts, of_grams, scores, shard, slices, union
from trajspark.llm.queries import write_table


def brute(rows, least=10, inside=50, most=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = []
    for lang in n:
        found = []
        cands = {p: a for (g, p), a in f.items() if g == lang and len(p) > 1 and a >= least}
        for p, a in cands.items():
            if any(100 * b >= inside * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            l, r, s = min(((f[lang, p[:k]], f[lang, p[k:]], 1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]])) for k in range(1, len(p))), key=lambda x: x[2])
            found.append((-s, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return out


def texts(df):
    return [(r["lang"], r["text"]) for r in df.select("lang", "text").collect()]


@pytest.mark.parametrize("table", ["odd", "empty"])
def test_collocations_equal_brute_force(request, table):
    docs = request.getfixturevalue(table)
    want = brute(texts(docs))
    assert table == "empty" or len(want) > 10
    same(collocation.mine(docs, write_table).collect(), want)


def test_many_ranges_and_shards_give_the_same_rows(spark):
    rng = random.Random(3)
    words = ["The", "of", "und", "a\x01b", "ä", "ab", "abc", "\U0001f600", "z" * 90, "z" * 91]
    rows = [
        (rng.choice(["en", "en", "de", None, "und"]), " ".join(rng.choice(words[: rng.choice([3, 4, 10])]) + rng.choice(["", "", "", ",", "\t", ".\n"]) for _ in range(rng.randrange(300))))
        for _ in range(60)
    ]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, range int, blob int").repartition(3)
    want = brute(rows)
    assert {r[0] for r in want} == {"en", "de", "und"} and any(r[2].count(" ") == 2 for r in want)
    same(collocation.mine(docs, write_table, size=4000, range_ngrams=60, every=8).collect(), want)
    same(collocation.mine(docs, write_table, least=3, inside=90, most=7, size=3000, range_ngrams=40, every=4).collect(), brute(rows, 3, 90, 7))


def phrases(t):
    text = t.words.to_pylist()
    return {tuple(text[int(i)] for i in row[:-1]): int(row[-1]) for g in t.grams() for row in zip(*g)}


def test_transducers_keep_counts_through_packing_cutting_and_union():
    rng = random.Random(5)
    parts = [[" ".join(rng.choice("abcdefg") + rng.choice("xyz.") for _ in range(200)).encode()] for _ in range(4)]
    made = [shard(p)[0] for p in parts]
    total = collections.Counter()
    for t in made:
        assert phrases(Transducer.unpack(t.pack())) == phrases(t)
        total.update(phrases(t))
    whole = union(made)
    assert phrases(whole) == dict(total)
    assert phrases(union(made, 3)) == {k: v for k, v in total.items() if v >= 3}
    edges = sorted([(b"bx",), (b"bx", b"cz"), (b"c",), (b"cy", b"az", b"g"), (b"cy", b"az", b"gzz"), (b"zz",)])
    for k, part in slices(whole, edges):
        for p in phrases(part):
            assert sum(e <= p for e in edges) == k
    assert sum(len(phrases(x)) for _, x in slices(whole, edges)) == len(total)
    grams = whole.grams()
    for edge, counts in zip(edges, cuts(whole.words, grams, edges)):
        for k, c in enumerate(counts, 1):
            assert c == sum(len(p) == k and p < edge for p in total)


def test_equal_right_languages_are_one_state():
    words = _binary(b"abcd", np.array([1, 1, 1, 1]))
    e = np.zeros(0, np.int64)
    three = (np.array([0, 0, 1, 1, 2]), np.array([3, 3, 3, 3, 3]), np.array([0, 1, 0, 1, 0]), np.array([2, 5, 2, 5, 2]))
    t = Transducer.build(words, ((e, e), (e, e, e), three))
    assert len(t.lengths[1]) == 2 and len(t.lengths[0]) == 2  # a and b share all that follows, c doesn't
    assert phrases(t) == {(b"a", b"d", b"a"): 2, (b"a", b"d", b"b"): 5, (b"b", b"d", b"a"): 2, (b"b", b"d", b"b"): 5, (b"c", b"d", b"a"): 2}


def test_no_words():
    t, n = shard([b"", b" \t.,"])
    assert n == 0 and phrases(t) == {} and phrases(Transducer.unpack(t.pack())) == {}
    assert phrases(union([t, t])) == {}
    assert isinstance(of_grams(t.words, t.grams()).words, pa.Array)


def test_scores_are_exact_beyond_63_bits():
    a, l, r = np.array([5_000_000_000, 10]), np.array([9_000_000_000, 30]), np.array([7_000_000_001, 7])
    assert scores(a, l, r).tolist() == [10**6 * int(x) ** 2 // (int(y) * int(z)) for x, y, z in zip(a, l, r)]
