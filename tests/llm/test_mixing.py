import duckdb
import pytest
from pyspark.sql import functions as F

from llm_helpers import SF001, same
from trajspark.llm import mixing
from trajspark.llm.queries import write_table


def twin(docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    return con.execute(mixing.SQL).fetchall()


def shared_out(sizes, weights, most):
    """Targets by rounds of resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = sum(w[s] for s in order if s not in full)
        got = {s: most * sizes[s] if s in full else rest * w[s] / open_ for s in order}
        more = {s for s in order if got[s] > most * sizes[s]} - full
        if not more:
            return got
        full |= more


@pytest.mark.parametrize("table", ["odd", "small", "empty"])
def test_mix_equals_its_sql(request, table):
    docs = request.getfixturevalue(table)
    got = mixing.report(mixing.allocate(docs, write_table)).collect()
    same(got, twin(docs))


def test_targets_stop_at_three_times_a_source(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 300, "e": 2, "é": 40, None: 7}
    rows = [(i, " ".join(["w"] * k), s) for i, (s, k) in enumerate((s, 1) for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.report(mixing.allocate(docs, write_table)).join(docs.select("doc_id", "source"), "doc_id").collect()
    want = shared_out(sizes, (5, 2, 1), 3)
    assert sum(want[s] == 3 * sizes[s] for s in sizes) >= 4
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == sizes[s] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 1
        assert all(r["taken"] <= 3 * r["size"] for r in mine)
    same(mixing.report(mixing.allocate(docs, write_table)).collect(), twin(docs))


def test_taken_words_come_near_the_target_and_reruns_agree(spark, small):
    one = mixing.report(mixing.allocate(small, write_table))
    same(one.collect(), mixing.report(mixing.allocate(small.repartition(5, "text"), write_table)).collect())
    near = one.join(small.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("longest"))
    assert near.filter(F.abs(F.col("taken") - F.col("target")) > F.greatest(0.1 * F.col("target"), F.lit(30))).count() == 0


def test_repeated_rows_and_null_keys_are_taken_one_by_one(spark):
    rows = [(None, "a b c", "hot")] * 400 + [(7, "a b c", "hot")] * 100 + [(i, "x", "cold") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.report(mixing.allocate(docs, write_table)).collect()
    same(got, twin(docs))
    hot = [r for r in got if r["size"] == 3]
    assert len(hot) == 500 and abs(sum(r["taken"] for r in hot) - hot[0]["target"]) <= 3


def test_mix_gives_the_documents_themselves(spark, odd):
    want = mixing.allocate(odd, write_table).groupBy().agg(F.sum("copies")).first()[0]
    got = mixing.mix(odd, write_table)
    assert got.columns == odd.columns and got.count() == want
    assert got.join(odd.select("doc_id", "text", "salt"), ["doc_id", "text", "salt"], "left_anti").filter("doc_id is not null and text is not null").count() == 0


def test_sampling_probabilities_hold(spark):
    """Over many seeds each document comes as often as its source's rate says."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "a" if i < 60 else "b") for i in range(120)], "doc_id long, text string, source string")
    got = None
    for seed in range(12):
        one = mixing.allocate(docs, write_table, seed=seed, weights=(3, 1))
        got = one if got is None else got.unionByName(one)
    rate = got.withColumn("rate", F.col("target") / F.col("source_size")).groupBy("source_size").agg(F.avg("copies").alias("copies"), F.first("rate").alias("rate")).collect()
    assert all(abs(r["copies"] - r["rate"]) < 0.06 for r in rate)


def test_plan_has_no_python_and_no_cross_join(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    plan = mixing.allocate(docs, lambda df: df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
