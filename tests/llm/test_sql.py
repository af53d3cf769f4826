import duckdb
import pytest

from llm_helpers import SF001, same
from trajspark.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF001}/{t}.parquet'")
    got = QUERIES[name](spark, SF001)
    res = con.execute(SQL[name])
    assert [c[0] for c in res.description] == got.columns
    same(got.collect(), res.fetchall())
