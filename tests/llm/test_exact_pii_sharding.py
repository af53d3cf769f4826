import collections
import hashlib
import re
import zlib

import pytest

from trajspark.llm import exact, pii, sharding

from llm_helpers import rows_of, same

WS = re.compile(r"[\x20\x09-\x0D]")


@pytest.mark.parametrize("table", ["odd", "small", "empty"])
def test_exact_dedup_equals_brute_force(request, table, monkeypatch):
    monkeypatch.setattr(exact, "LOCAL_IDS", 8)
    docs = request.getfixturevalue(table)
    groups = collections.defaultdict(list)
    for i, t in rows_of(docs):
        groups[WS.sub("", t or "")].append((-len(t or ""), i is None, i))
    want = []
    for norm, g in groups.items():
        keep = min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        want += [(i, keep, len(g), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for _, _, i in g]
    same(exact.dedup(docs).collect(), want)


def test_exact_dedup_compares_contents_when_digests_collide(spark, monkeypatch):
    monkeypatch.setattr(exact, "_keys", lambda text: (b"same", hashlib.blake2b(text, digest_size=16).digest()))
    docs = spark.createDataFrame([(i, f"t{i % 3}") for i in range(12)], "doc_id long, text string")
    got = [tuple(r)[:3] for r in exact.dedup(docs).collect()]
    same(got, [(i, i % 3, 4) for i in range(12)])


def brute_spans(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


@pytest.mark.parametrize("table", ["odd", "small", "empty"])
def test_pii_base_spans_equal_the_patterns(request, table):
    docs = request.getfixturevalue(table)
    want = []
    for i, t in rows_of(docs):
        s = brute_spans(t or "")
        kinds = collections.Counter(k for k, _, _ in s)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        want.append((i, *(kinds[k] for k in pii.BASE), hashlib.sha256(text.encode()).hexdigest()))
    got = pii.report(pii.find(docs))
    assert got.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    same([tuple(r)[:6] for r in got.collect()], want)


def test_pii_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    kinds = [s[0] for s in pii.spans("my IBAN DE89 3704 0044 0532 0130 00, not DE88 3704 0044 0532 0130 00")]
    assert kinds == ["iban"]
    assert [s[0] for s in pii.spans("SSN 123-45-6789")] == ["ssn"]
    assert pii.spans("row 123-45-6789") == []
    near, far = pii.spans("credit card 4111 1111 1111 1111")[0][3], pii.spans("isbn 4111 1111 1111 1111")[0][3]
    assert near > pii.START_SCORE["card"] > far


def test_ibans_end_where_their_checksum_holds():
    be, es = "BE68 5390 0754 7034", "ES91 2100 0418 4502 0005 1332"
    for text in (be, f"{be} EUR", f"{be} EURO 12", f"{es} 100", "BE68539007547034 EUR", f"AB12 CDEF GHIJ {be} NOW", f"{be} {es} EUR"):
        found = [text[a:b] for kind, a, b, _ in pii.spans(text) if kind == "iban"]
        assert found == [x for x in (be, be.replace(" ", ""), es) if x in text], text
    assert not [x for x in pii.spans("BE68 5390 0754 7035 EUR") if x[0] == "iban"]


@pytest.mark.parametrize("table", ["odd", "small", "empty"])
def test_sharding_law(request, table):
    docs = request.getfixturevalue(table)
    got = sharding.assign(docs, [1.0] * 24, [1.0] * 25).collect()
    want = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows_of(docs)]
    same([tuple(r)[:3] for r in got], want)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and 0 <= r["shard"] < 24
        assert r["grown_shard"] in (r["shard"], 24)
        u = [(int(hashlib.md5(f"{'null' if r['doc_id'] is None else 'k' + str(r['doc_id'])}|{s}".encode()).hexdigest()[:12], 16), s) for s in range(24)]
        assert max(u)[1] == r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_weights(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'t' as text")
    n = {r["shard"]: r["count"] for r in sharding.assign(docs, [1.0, 3.0, 0.0, 4.0]).groupBy("shard").count().collect()}
    assert set(n) == {0, 1, 3}
    assert abs(n[0] - 500) < 100 and abs(n[1] - 1500) < 150 and abs(n[3] - 2000) < 150
