import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_bpe import library
from test_decontam import words
from test_linededup import brute as brute_lines  # noqa: F401
from test_simhash import brute as brute_groups

from llm_helpers import COLUMNS, ODD, SF001, rows_of, same
from trajspark.llm import simhash
from trajspark.llm.queries import write_table

STAGE = dict(corpus_pipeline.STAGES)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text, items, window=10):
    """Text without the spans of words in benchmark windows."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    found = list(WORD.finditer(low))
    hit = set()
    grams = {tuple(w[p : p + window]) for w in map(words, items) for p in range(max(1, len(w) - window + 1) if w else 0)}
    for n in {len(g) for g in grams}:
        for p in range(len(found) - n + 1):
            if tuple(m[0] for m in found[p : p + n]) in grams:
                hit.update(range(p, p + n))
    out, at, k = [], 0, 0
    while k < len(found):
        if k in hit:
            e = k
            while e + 1 in hit:
                e += 1
            out.append(text[at : found[k].start()])
            at, k = found[e].end(), e
        k += 1
    return "".join([*out, text[at:]])


def check_stages(spark, docs, sf_dir):
    """Each stage against its brute force on its own input; the last result."""
    names = docs.columns
    out = write_table(STAGE["toxicity"](spark, docs, sf_dir))
    assert out.columns == names and out.count() <= docs.count()
    docs, out = out, write_table(STAGE["line_dedup"](spark, out, sf_dir))
    assert out.columns == names
    same([(i,) for i, _ in rows_of(out)], [(i,) for i, _ in rows_of(docs)])
    docs, out = out, write_table(STAGE["simhash_near_dedup"](spark, out, sf_dir))
    assert out.columns == names
    groups = {}
    for (i, t), (_, _, c) in zip(rows_of(docs), brute_groups(rows_of(docs))):
        groups.setdefault(c, []).append((i is None, i or 0))
    same([(i,) for i, _ in rows_of(out)], [((None if min(g)[0] else min(g)[1]),) for g in groups.values()])
    docs, out = out, write_table(STAGE["decontamination"](spark, out, sf_dir))
    assert out.columns == names
    items = [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    same(rows_of(out), [(i, None if t is None else cut(t, items)) for i, t in rows_of(docs)])
    docs, out = out, STAGE["bpe"](spark, out, sf_dir)
    got = [(r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in out.collect()]
    same(got, [(i, tuple(ids), d) for i, ids, d in library(rows_of(docs))])
    return got


def test_stages_equal_brute_force_and_run(spark, small):
    got = check_stages(spark, small, SF001)
    same([(r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in corpus_pipeline.run(spark, SF001).collect()], got)


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, COLUMNS).repartition(2).withColumns({c: F.lit("x") for c in ("row_", "score", "rid", "rest", "group_")}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1), (5, 0)] if rows else [], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None)] if rows else [], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    check_stages(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))


def test_one_row_of_each_group_stays(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "q"), (None, "q"), (9, None), (8, ""), (7, "other words in here")]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), write_table).collect()
    same(got, [(3, "a b c d e f"), (None, "q"), (8, ""), (7, "other words in here")])
