"""Stateful streaming (M3) on hand-made step files fed in event-time order."""

import datetime as dt

from pyspark.sql import Row
from pyspark.sql import functions as F

from trajspark.streaming import incremental as M

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "user_id bigint, event_id bigint, ts timestamp, state string"


def _at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def _run(spark, root, out, ckpt):
    s = spark.readStream.schema(SCHEMA).parquet(f"{root}/part=*").withWatermark("ts", "10 minutes")
    ep = M.assemble_until_terminal(s, "user_id", "ts", "event_id", "state", F.col("state") == "purchase", 7200)
    with M.rocksdb_state(spark):
        q = ep.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
        q = q.outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert q.exception() is None


def test_terminal_gap_timeout_and_late(spark, tmp_path):
    root, out, ckpt = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    batches = [
        # user 1: closed by its terminal step, then an open step; user 2: one step
        [(1, 1, _at(0), "click"), (1, 2, _at(10), "view"), (1, 3, _at(20), "purchase"), (1, 4, _at(30), "click"),
         (2, 5, _at(0), "view")],
        # user 1 returns after the gap (closes the open step); user 3 stays open at the end
        [(1, 6, _at(300), "click"), (3, 7, _at(600), "view")],
        # a step older than the watermark (600 - 10 minutes) is dropped
        [(4, 8, _at(60), "click")],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{root}/part={i}")
        _run(spark, root, out, ckpt)
    got = sorted(
        (r.user_id, int((r.episode_start - T0).total_seconds() // 60), r.n_steps, r.states, r.closed_by)
        for r in spark.read.parquet(out).collect()
    )
    assert got == [
        (1, 0, 3, "click view purchase", "terminal"),
        (1, 30, 1, "click", "inactive"),    # closed when the step at 300 arrived
        (1, 300, 1, "click", "inactive"),   # closed by the event-time timeout
        (2, 0, 1, "view", "inactive"),      # closed by the event-time timeout
    ]


def test_steps_out_of_order_inside_the_watermark(spark, tmp_path):
    """Any key type; a late step within the watermark takes its place by time."""
    root, out, ckpt = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    schema = "user_id string, event_id bigint, ts timestamp, state string"

    def run(rows, i):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/part={i}")
        s = spark.readStream.schema(schema).parquet(f"{root}/part=*").withWatermark("ts", "30 minutes")
        ep = M.assemble_until_terminal(s, "user_id", "ts", "event_id", "state", F.col("state") == "purchase", 7200)
        with M.rocksdb_state(spark):
            q = ep.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
            q = q.outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
        assert q.exception() is None

    run([("u", 1, _at(60), "b"), (None, 9, _at(61), "n")], 0)
    run([("u", 2, _at(55), "a")], 1)
    run([("u", 3, _at(70), "purchase")], 2)
    run([("u", 4, _at(68), "late"), ("flush", 99, _at(6000), "x")], 3)
    got = {(r.user_id, int((r.episode_start - T0).total_seconds() // 60), int((r.episode_end - T0).total_seconds() // 60), r.states, r.closed_by) for r in spark.read.parquet(out).collect()}
    assert got == {("u", 55, 70, "a b late purchase", "terminal"), (None, 61, 61, "n", "inactive")}


def test_many_keys_share_a_state_and_are_told_apart(spark, tmp_path, monkeypatch):
    """Episodes of interleaved keys in few groups, in entries of few steps; a batch's calls to the state follow the groups, not the keys."""
    monkeypatch.setattr(M, "EPISODE_CHUNK", 5)
    n, gap = 40, 120
    rows = [(u if u else None, 100 * u + i, _at(m + u % 3), "purchase" if i == 2 and u % 2 else f"s{i}") for u in range(n) for i, m in enumerate((0, 10, 20, 30, 30 + gap + u % 2))]
    want = set()
    for u in range(n):
        at = u % 3
        if u % 2:
            want |= {(u, at, at + 20, "s0 s1 purchase", "terminal"), (u, at + 30, at + 30, "s3", "inactive"), (u, at + 31 + gap, at + 31 + gap, "s4", "inactive")}
        else:
            want |= {(u or None, at, at + 30, "s0 s1 s2 s3", "inactive"), (u or None, at + 30 + gap, at + 30 + gap, "s4", "inactive")}
    root, out, ckpt = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    batches = [[r for r in rows if r[2] < _at(25)][::-1], [r for r in rows if r[2] >= _at(25)], [(-1, 1, _at(6000), "x")]]
    for i, part in enumerate(batches):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{root}/part={i}")
        s = spark.readStream.schema(SCHEMA).parquet(f"{root}/part=*").withWatermark("ts", "10 minutes")
        ep = M.assemble_until_terminal(s, "user_id", "ts", "event_id", "state", F.col("state") == "purchase", gap * 60, groups=3)
        with M.rocksdb_state(spark):
            q = ep.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
        assert q.exception() is None
        assert all(o["numRowsUpdated"] <= 30 for p in q.recentProgress for o in p["stateOperators"])
    minutes = lambda t: int((t - T0).total_seconds() // 60)
    got = [(r.user_id, minutes(r.episode_start), minutes(r.episode_end), r.states, r.closed_by) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(want) and set(got) == want


class _Handle:
    """A list state and timers that count the calls made to them."""

    def __init__(self):
        self.calls, self.held = 0, []

    def getListState(self, name, schema):
        return self

    def appendValue(self, x):
        self.calls += 1
        self.held.append(x)

    def put(self, xs):
        self.calls += 1
        self.held = list(xs)

    def get(self):
        self.calls += 1
        return iter(self.held)

    def clear(self):
        self.calls += 1
        self.held = []

    def registerTimer(self, ms):
        self.calls += 1


class _Times:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_the_calls_to_a_state_do_not_follow_the_keys(spark):
    """A thousand keys of a group cost as many calls as one: to append their steps, and to settle them."""
    calls = []
    for n in (1, 1000):
        handle, made = _Handle(), M._EpisodeProcessor(1_000_000)
        made.init(handle)
        rows = [Row(k=f"k{i}", us=j * 5_000_000, o=j, s="x", t=False, g=7) for i in range(n) for j in range(2)]
        assert list(made.handleInputRows((7,), iter(rows), _Times(0))) == []
        left = [x for r in made.handleExpiredTimer((7,), _Times(1_500), None) for x in zip(r["key"], r["start_us"], r["n_steps"], r["closed_by"])]
        assert sorted(left) == sorted((f"k{i}", 0, 1, "inactive") for i in range(n))
        left = [x for r in made.handleExpiredTimer((7,), _Times(6_500), None) for x in zip(r["key"], r["start_us"])]
        assert sorted(left) == sorted((f"k{i}", 5_000_000) for i in range(n)) and handle.held == []
        calls.append(handle.calls)
    assert calls[0] == calls[1] <= 8


def test_new_states_under_a_second_checkpoint(spark, tmp_path):
    """A new checkpoint over an existing table keeps its rows and adds unseen ones only; null keys are states."""
    table = str(tmp_path / "table")

    def ingest(rows, name):
        src = str(tmp_path / f"src-{name}")
        spark.createDataFrame(rows, "s string, p string").write.parquet(f"{src}/part=0")
        q = M.ingest_new_states(spark.readStream.schema("s string, p string").parquet(f"{src}/part=*"), table, ["s", "p"], str(tmp_path / name))
        q.awaitTermination()
        assert q.exception() is None

    ingest([("a", "1"), ("b", "1"), ("b", "1"), (None, None)], "one")
    ingest([("b", "1"), ("c", None), (None, None)], "two")
    got = sorted((r.s or "", r.p or "") for r in spark.read.parquet(table).collect())
    assert got == [("", ""), ("a", "1"), ("b", "1"), ("c", "")]


def test_late_rows_are_counted(spark, tmp_path):
    src, table, ckpt = str(tmp_path / "src"), str(tmp_path / "table"), str(tmp_path / "ckpt")
    late = []
    for i, rows in enumerate([[("a", _at(0))], [("b", _at(600))], [("c", _at(10)), ("d", _at(700))]]):
        spark.createDataFrame(rows, "s string, ts timestamp").coalesce(1).write.parquet(f"{src}/part={i}")
        stream = spark.readStream.schema("s string, ts timestamp").parquet(f"{src}/part=*")
        q = M.ingest_new_states(stream, table, ["s"], ckpt, watermark=("ts", "10 minutes"))
        q.awaitTermination()
        assert q.exception() is None
        late.append(M.late_rows(q))
    assert late == [0, 0, 1]
    assert sorted(r.s for r in spark.read.parquet(table).collect()) == ["a", "b", "d"]


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_only_the_buckets_of_a_batch_are_scanned(spark, tmp_path):
    table = str(tmp_path / "table")
    rows = [(f"s{i}", None if i % 5 == 0 else "p") for i in range(200)]
    src = str(tmp_path / "src")
    spark.createDataFrame(rows, "s string, p string").write.parquet(f"{src}/part=0")
    stream = spark.readStream.schema("s string, p string").parquet(f"{src}/part=*")
    M.ingest_new_states(stream, table, ["s", "p"], str(tmp_path / "c"), buckets=16).awaitTermination()
    stored = M.stored_states(spark, table)
    assert stored.select("bucket").distinct().count() == 16 and stored.count() == 200
    new = spark.createDataFrame([("s7", "p"), ("s0", None), ("new", "p")], "s string, p string").withColumn("bucket", M.state_bucket(["s", "p"], 16))
    wanted = sorted({r["bucket"] for r in new.collect()})
    left = M.unseen(new, table, ["s", "p"])
    assert [(r["s"], r["p"]) for r in left.collect()] == [("new", "p")]
    text = _plan(M.stored_states(spark, table, wanted))
    assert "PartitionFilters: [bucket" in text and all(f"{b}" in text for b in wanted)
    read = M.stored_states(spark, table, wanted).select(F.input_file_name().alias("f")).distinct().collect()
    assert {int(r["f"].split("bucket=")[1].split("/")[0]) for r in read} == set(wanted)


def test_upserts_keep_one_row_per_group_and_survive_a_second_write(spark, tmp_path):
    src, path, ckpt = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    schema = "g string, ts timestamp, value double"
    day = 1440
    batches = [
        [("a", _at(1), 1.0), ("b", _at(2), 2.0), (None, _at(3), 5.0), ("a", _at(day + 1), 7.0)],
        [("a", _at(4), 3.0), ("c", _at(5), 9.0), (None, _at(6), 7.0)],
        [("b", _at(day + 9), 4.0)],
    ]

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{src}/part=*")
        agg = M.live_metrics(stream, ["g"], "ts", "1 day", "value")
        q = M.write_updates(agg, path, ["window", "g"], ckpt, part=F.date_format("window.start", "yyyyMMdd"))
        q.awaitTermination()
        assert q.exception() is None

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/part={i}")
        run()
    got = M.read_latest(spark, path)
    assert got.columns == ["window", "g", "n", "mean_value", "min_value", "max_value"]
    want = {(0, "a", 2, 2.0), (0, "b", 1, 2.0), (0, None, 2, 6.0), (0, "c", 1, 9.0), (1, "a", 1, 7.0), (1, "b", 1, 4.0)}
    rows = got.collect()
    assert len(rows) == len(want) and {((r["window"]["start"] - T0).days, r["g"], r["n"], r["mean_value"]) for r in rows} == want
    # the last batch is put in place again, from what it staged
    staged = spark.read.parquet(f"{path}-staged-{M._run_of(ckpt)}-2")
    assert {r["part"] for r in staged.collect()} == {"20240102"}
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    assert M.read_latest(spark, path).count() == len(want)


def test_stream_queries_take_in_null_and_negative_keys(spark, tmp_path):
    """Rows with a null user, a null or negative id, or no time are fed like others."""
    from trajspark.plans.catalog import QUERIES

    sf = str(tmp_path)
    rows = [(i if i % 3 else (-i if i % 2 else None), _at(i * 7), None if i % 4 == 0 else -1, ["view", "click", "purchase"][i % 3], float(i), f"p{i}") for i in range(40)]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows + [(None, None, 5, "view", 1.0, "notime")], schema).write.parquet(f"{sf}/events.parquet")
    states = {(r[3], r[5]) for r in rows} | {("view", "notime")}
    for name in ("m1_new_states", "m1_new_states_state"):
        assert {tuple(r) for r in QUERIES[name](spark, sf).collect()} == states
    got = QUERIES["m3_assemble_episodes"](spark, sf).collect()
    assert sum(r["n_steps"] for r in got) == 40 and {r["user_id"] for r in got} == {None, -1}
    got = QUERIES["m3_terminal_episodes"](spark, sf).collect()
    assert sum(r["n_steps"] for r in got) == 40 and {r["user_id"] for r in got} == {None, -1}
    assert QUERIES["m4_resume"](spark, sf).count() == 41
