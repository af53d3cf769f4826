import collections
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from trajspark.llm import linededup
from trajspark.llm.queries import QUERIES, SQL
from trajspark.session import write_table

from llm_helpers import SF001, rows_of, same

T = linededup.MIN_BYTES


def brute(rows):
    """Rows in order; every window is looked up among all earlier ones by its lines."""
    docs = []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (t or "").split("\n")
        used = [(p, x.strip(" ").encode()) for p, x in enumerate(lines) if x.strip(" ")]
        docs.append((i, lines, used))
    first, out = {}, []
    for d, (i, lines, used) in enumerate(docs):
        size, gone = [len(b) for _, b in used], set()
        at = [sum(size[:k]) for k in range(len(used) + 1)]

        def window(dd, k):
            u = docs[dd][2]
            take, n = [], 0
            while k < len(u) and n < T:
                take.append(u[k][1])
                n += len(u[k][1])
                k += 1
            return take

        def back(dd, k):
            u, take, n = docs[dd][2], [], 0
            while k > 0 and n + len(u[k - 1][1]) <= T:
                k -= 1
                take.append(u[k][1])
                n += len(u[k][1])
            return take

        for k in range(len(used)):
            if at[-1] - at[k] < T:
                continue
            e, f = first.setdefault(tuple(window(d, k)), (d, k))
            if (e, f) == (d, k):
                continue
            common = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            left = common(back(d, k), back(e, f))
            right = common([used[k][1], *window(d, k + 1)], [docs[e][2][f][1], *window(e, f + 1)])
            gone.update(used[x][0] for x in range(k - left, k + right))
        kept = "\n".join(x for p, x in enumerate(lines) if p not in gone)
        out.append((i, 0 if lines == [""] else len(lines), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_query_equals_brute_force_and_sql(spark, small):
    got = QUERIES["op5_line_dedup"](spark, SF001)
    want = brute(rows_of(small))
    assert sum(r[2] for r in want) > 0
    same(got.collect(), want)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF001}/documents.parquet'")
    res = con.execute(SQL["op5_line_dedup"])
    assert [c[0] for c in res.description] == got.columns
    same(res.fetchall(), want)


LONG = [f"line {k} of a passage that several documents share with one another" for k in range(12)]
CASES = [
    (1, "\n".join(["own one", *LONG[:6], "tail"])),
    (2, "\n".join(["x", "", *LONG[2:6], "  ", "tail", "own two"])),
    (3, "\n".join([LONG[0], "other", LONG[1], "other"])),
    (4, "\n".join(["same line again and again, long enough to be a window of its own " * 2] * 5)),
    (5, "\n".join(LONG[:6]) + "\n"),
    (6, "\n\n\n"),
    (7, "short"),
    (8, "short"),
    (9, "é" * 70 + "\nend"),
    (10, "start\n" + "é" * 70 + "  \nend\nmore"),
]


def test_hand_made_runs(spark):
    docs = spark.createDataFrame(CASES, "doc_id long, text string")
    same(linededup.report(docs, write_table).collect(), brute(CASES))
    got = dict(linededup.dedup(docs, write_table).collect())
    assert got[2] == "\n".join(["x", "", "  ", "own two"])  # the passage and the tail after it
    assert got[3] == CASES[2][1] and got[7] == got[8] == "short" and got[1] == CASES[0][1]
    assert got[4].count("same line") == 2  # one line, which says it twice
    assert got[5] == ""
    assert got[10] == "start\nmore"


@pytest.mark.parametrize("table", ["odd", "empty"])
def test_odd_rows(request, table):
    docs = request.getfixturevalue(table)
    want = brute(rows_of(docs))
    same([(r[0], r[1], r[2]) for r in linededup.report(docs, write_table).collect()], [r[:3] for r in want])
    out = linededup.dedup(docs.withColumn("rid", F.lit("r")).withColumn("order_", F.lit(1)).withColumn("rest", F.lit(0)), write_table)
    assert collections.Counter(r["doc_id"] for r in out.collect()) == collections.Counter(i for i, _ in rows_of(docs))
    assert {"rid", "order_", "rest"} <= set(out.columns)


def earlier_runs(rows):
    """Every line of every run of T bytes that starts at an earlier place too; all runs are tried."""
    seqs = [(i, t.split("\n"), [(p, x.strip(" ").encode()) for p, x in enumerate(t.split("\n")) if x.strip(" ")]) for i, t in rows]
    seen, out = set(), {}
    for i, lines, used in seqs:
        gone = set()
        for a in range(len(used)):
            for b in range(a + 1, len(used) + 1):
                run = tuple(x for _, x in used[a:b])
                if sum(map(len, run)) >= T:
                    if run in seen:
                        gone.update(p for p, _ in used[a:b])
                    seen.add(run)
        out[i] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return out


def test_runs_repeat_any_earlier_document(spark):
    x, y, z = "x" * 130, "y" * 40, "z" * 40
    rng = random.Random(5)
    words = [c * n for c, n in zip("abcdefgh", (130, 119, 60, 40, 40, 25, 10, 1))]
    rows = [(1, f"{x}\nother"), (2, f"{x}\n{y}\n{z}"), (3, f"{x}\n{y}\n{z}"), (4, f"{y}\n{z}\n{x}"), (5, f"{x}\n{y}\n{z}\nown")]
    rows += [(i, "\n".join(rng.choice(["", *words]) for _ in range(rng.randint(1, 12)))) for i in range(10, 200)]
    got = dict(linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), write_table).collect())
    assert got[3] == "" and got[5] == "own"
    assert got == earlier_runs(rows)


def test_sql_takes_out_tails_that_repeat_a_later_document(spark):
    """A run repeats a document after the one where its first window occurred: query, SQL and any-earlier-run agree."""
    x, y, z = "x" * 130, "y" * 40, "z" * 40
    rows = [(1, f"{x}\nother"), (2, f"{x}\n{y}\n{z}"), (3, f"{x}\n{y}\n{z}"), (4, f"{y}\n{z}\nend"), (5, f"{y}\n{y}\n{z}\n{x}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = linededup.report(docs, write_table)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(linededup.SQL).fetchall()
    same(got.select("doc_id", "n_lines", "n_removed", "kept_sha256").collect(), want)
    assert {r[0]: r[2] for r in want} == {1: 0, 2: 1, 3: 3, 4: 0, 5: 1}
