"""Driver contract and plan-level properties on the driver's tables."""

import __spark_entry__ as E

from conftest import SF001


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) >= {"iter", "avg_return", "avg_win", "avg_tie", "avg_lose", "num_episode"}


def test_every_query_has_an_oracle_or_is_listed():
    # token ids of a subword vocabulary: not SQL, tested against the tokenizer library (test_subwords)
    rows_only = {"t11_subword_rows", "x3_subword_masks"}
    missing = set(E.queries()) - set(E.oracle_sql()) - set(E.LLM_QUERIES)
    assert missing == rows_only


def test_results_do_not_depend_on_shuffle_partitions(spark):
    q = E.queries()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        res = []
        for n in ("1", "4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            res.append(
                (
                    sorted(q["a3_outcomes_by_iteration"](spark, SF001).collect()),
                    sorted(q["d11_chunks_salted"](spark, SF001).collect()),
                )
            )
        assert res[0] == res[1] == res[2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
