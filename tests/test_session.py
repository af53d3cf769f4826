"""Folders that jobs write in the shared folder, and their removal."""

import os

from conftest import SF001
from trajspark import session
from trajspark.plans.catalog import QUERIES


def local(path):
    return path.removeprefix("file:")


def test_scratch_removes_what_jobs_inside_wrote(spark):
    outside = session.write_table(spark.range(3), "kept")
    kept = session._written[-1]
    with session.scratch(spark):
        assert QUERIES["v6_backward_induction"](spark, SF001).count() > 0
        inside = session._written[session._written.index(kept) + 1 :]
        assert inside and all(os.path.isdir(local(p)) for p in inside)
    assert not any(os.path.exists(local(p)) for p in inside)
    assert outside.count() == 3 and session._written[-1] == kept


def test_clean_removes_all(spark):
    session.write_table(spark.range(2))
    path = session._written[-1]
    assert session.clean(spark) >= 1 and not os.path.exists(local(path)) and session._written == []
