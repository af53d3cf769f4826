"""Incremental and streaming jobs (M1–M4) with Structured Streaming.

Sources are file streams with an explicit schema; event time is a
TIMESTAMP (files carry TIMESTAMP_NTZ, which watermarks refuse, so it is cast
with the session time zone). Every query has a checkpoint location, so a
restart resumes where it stopped and reprocesses nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from trajspark.functions.keys import joint_key


def event_stream(spark: SparkSession, path: str, schema: str, time_col: str = "ts", max_files: int | None = None) -> DataFrame:
    """File stream of parquet step/event files with ``time_col`` cast to TIMESTAMP."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path).withColumn(time_col, F.col(time_col).cast("timestamp"))


# M1 -------------------------------------------------------------------------
# Distinct keys of one micro-batch that may be broadcast: bytes of their text, checked per batch.
BATCH_KEYS_BROADCAST = 32 << 20
# Buckets of a new state table: partitions by digest of the key.
STATE_BUCKETS = 64


def _run_of(checkpoint: str) -> str:
    """A name for all batches of one checkpoint: a retried batch finds its own folder, another checkpoint doesn't."""
    return hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def _drop(spark: SparkSession, path: str) -> None:
    """Remove a staging folder of this job."""
    fs, p = _path(spark, path)
    fs.delete(p, True)


def state_bucket(keys: Sequence[str], buckets: int = STATE_BUCKETS) -> Column:
    """Bucket of a state: the digest of its joint key, so equal states (nulls too) share one."""
    return F.conv(F.substring(F.md5(joint_key(keys)), 1, 8), 16, 10).cast("bigint") % buckets


def stored_states(spark: SparkSession, table_path: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """The state table, or only the files of some buckets (partition pruning: the others are not scanned)."""
    stored = spark.read.parquet(table_path)
    return stored if buckets is None else stored.where(F.col("bucket").isin([int(b) for b in buckets]))


def unseen(new: DataFrame, table_path: str, keys: Sequence[str], own: Column | None = None) -> DataFrame:
    """The rows of ``new`` (distinct keys and their ``bucket``) that the state table does not hold.

    Only the buckets that ``new`` falls in are scanned. Small key sets (bytes checked) are
    broadcast to those files; larger ones meet them in a join on bucket and keys.
    """
    spark = new.sparkSession
    size = F.sum(F.lit(16) + sum((F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in keys), F.lit(0)))
    got = new.agg(size.alias("size"), F.collect_set("bucket").alias("buckets")).first()  # at most one number per bucket
    seen = stored_states(spark, table_path, got["buckets"])
    if own is not None:
        seen = seen.where(~own)
    seen = seen.select("bucket", *keys)
    on = lambda x, y: [x["bucket"] == y["bucket"], *[x[k].eqNullSafe(y[k]) for k in keys]]
    if (got["size"] or 0) <= BATCH_KEYS_BROADCAST:
        # the few keys that the table has, found by one pass over its files, leave the batch
        seen = seen.join(F.broadcast(new), on(seen, new), "left_semi").distinct()
    return new.join(seen, on(new, seen), "left_anti")


def ingest_new_states(
    stream: DataFrame,
    table_path: str,
    keys: Sequence[str],
    checkpoint: str,
    watermark: tuple[str, str] | None = None,
    trigger_available_now: bool = True,
    mode: str | None = None,
    buckets: int = STATE_BUCKETS,
) -> StreamingQuery:
    """Append only states never seen before to the table at ``table_path``.

    Exact mode (default): the table is partitioned by ``bucket`` (a digest of the key)
    and ``batch_id=<run>-<n>``. Each micro-batch is deduplicated, staged, and anti-joined
    with the buckets that its own keys fall in (see ``unseen``); it overwrites its own
    partitions only, so a retried batch replaces its own output (idempotent) and a run
    under a new checkpoint replaces nobody's. ``buckets`` must not change over a table's
    life. Keys that are null in every part are a state like any other, in all modes.
    Bounded-state mode (``watermark=(time_col, delay)``): Spark keeps the keys
    seen within the watermark (``dropDuplicatesWithinWatermark``).
    State mode (``mode="state"``): exact and incremental; every key seen by the
    stream is kept in the state store (``dropDuplicates`` without a
    watermark), so a batch costs its own size, not a scan of the table. The
    state grows with the distinct keys; run it on the RocksDB state store
    provider (session conf) when they outgrow executor memory. Unlike the
    table mode it does not know rows written to the table by other jobs.
    """
    keys = list(keys)
    spark = stream.sparkSession
    if mode == "state":
        out = stream.select(*keys).dropDuplicates(keys)
        w = out.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint)
        w = w.outputMode("append")
        return (w.trigger(availableNow=True) if trigger_available_now else w).start()
    if watermark is not None:
        time_col, delay = watermark
        out = stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys).select(*keys)
        w = out.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint)
        w = w.outputMode("append")
        return (w.trigger(availableNow=True) if trigger_available_now else w).start()

    run = _run_of(checkpoint)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        new = batch.select(*keys).distinct().withColumn("bucket", state_bucket(keys, buckets))
        staged = f"{checkpoint.rstrip('/')}-keys-{batch_id}"
        if _exists(spark, table_path):
            new.write.mode("overwrite").parquet(staged)
            part = F.col("batch_id").cast("string")
            own = (F.substring_index(part, "-", 1) == run) & (F.substring_index(part, "-", -1).cast("long") >= batch_id)
            new = unseen(spark.read.schema(new.schema).parquet(staged), table_path, keys, own)
        out = new.withColumn("batch_id", F.lit(f"{run}-{batch_id}")).repartition("bucket")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch_id").parquet(table_path)
        _drop(spark, staged)

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if trigger_available_now else w).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that arrived behind the watermark and were dropped, over the batches this run reports."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


# M2 -------------------------------------------------------------------------
def live_metrics(
    stream: DataFrame,
    group: Sequence[str],
    time_col: str,
    window: str,
    value: str,
    watermark: str | None = None,
    slide: str | None = None,
) -> DataFrame:
    """Running outcome metrics per (window, group…): count, mean, min, max of ``value``.

    Run it in update mode for live dashboards; the window (tumbling or
    sliding) is a parameter.
    """
    s = stream.withWatermark(time_col, watermark) if watermark else stream
    win = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    return s.groupBy(win.alias("window"), *group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean_value"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
    )


def write_updates(agg: DataFrame, path: str, keys: Sequence[str], checkpoint: str, part: Column, trigger_available_now: bool = True) -> StreamingQuery:
    """Upsert sink for update mode: a table with one row per group (``keys``), partitioned by ``part``.

    A batch rewrites only the partitions that hold a group it changed: their other rows are
    kept, the changed ones replaced. The new contents are staged first and then put in place
    by dynamic partition overwrite. A batch that is run again finds its staged contents and
    puts the same in place, so a failure between the two steps loses nothing. Null keys are
    groups like any other.
    """
    spark = agg.sparkSession
    run = _run_of(checkpoint)
    keys = list(keys)

    def staged_path(batch_id: int) -> str:
        return f"{path.rstrip('/')}-staged-{run}-{batch_id}"

    def write(batch: DataFrame, batch_id: int) -> None:
        staged = staged_path(batch_id)
        if not _exists(spark, f"{staged}/_SUCCESS"):
            out = batch.withColumn("part", part.cast("string"))
            if _exists(spark, path):
                changed = f"{staged}-rows"
                out.write.mode("overwrite").parquet(changed)
                out = spark.read.schema(out.schema).parquet(changed)
                stored = spark.read.schema(out.schema).parquet(path)
                touched = out.select("part").distinct()  # prunes the table's partitions at run time
                old = stored.join(touched, stored["part"].eqNullSafe(touched["part"]), "left_semi")
                old = old.join(out.select(*keys), [old[k].eqNullSafe(out[k]) for k in keys], "left_anti")
                out = old.select(out.columns).unionByName(out)
            out.write.mode("overwrite").parquet(staged)
        rows = spark.read.parquet(staged)
        rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
        # what earlier batches staged is in place for good
        _drop(spark, staged_path(batch_id - 1))
        _drop(spark, f"{staged}-rows")

    w = agg.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if trigger_available_now else w).start()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """Current value of every group written by ``write_updates``: the table holds one row for each."""
    return spark.read.parquet(path).drop("part")


# M3 -------------------------------------------------------------------------
def assemble_episodes(stream: DataFrame, key: Sequence[str], time_col: str, gap: str, step_cols: Sequence[str]) -> DataFrame:
    """Episodes from a step stream: a session closes after ``gap`` of inactivity.

    The steps of an episode are collected in time order; add a watermark
    before this call to emit closed sessions in append mode.
    """
    return stream.groupBy(F.session_window(time_col, gap).alias("session"), *key).agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.sort_array(F.collect_list(F.struct(time_col, *step_cols))).alias("steps"),
    )


# M4 -------------------------------------------------------------------------
def run_incremental(
    stream: DataFrame,
    sink_path: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    partition_by: Sequence[str] = (),
) -> int:
    """Process everything new since the last run (``availableNow``), then stop.

    Returns the number of input rows processed by this run (0 when nothing
    is new): a restarted pipeline resumes from its checkpoint.
    """
    out = transform(stream) if transform else stream
    w = out.writeStream.format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint)
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(int(p.get("numInputRows", 0)) for p in q.recentProgress)


# M3 (stateful) ------------------------------------------------------------------
@contextmanager
def rocksdb_state(spark: SparkSession):
    """The state store that ``transformWithState`` needs, for streams started inside; a batch saves its changes only."""
    base = "spark.sql.streaming.stateStore."
    wanted = {
        base + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        base + "rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


#: Groups of keys with one state each. A batch makes a few calls for each group it touches, however many keys that has.
EPISODE_GROUPS = 1024
#: Steps of one entry of a state, and episodes of one row on the way out.
EPISODE_CHUNK = 1 << 13
_STEPS = pa.schema([("k", pa.large_string()), ("us", pa.int64()), ("o", pa.int64()), ("s", pa.large_string()), ("t", pa.bool_())])


def _to_bytes(steps: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, steps.schema) as out:
        out.write_table(steps)
    return sink.getvalue().to_pybytes()


class _EpisodeProcessor(StatefulProcessor):
    """Steps of one group of keys as a list state of Arrow tables, and timers at which an episode may be settled."""

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle) -> None:
        self.handle = handle
        self.steps = handle.getListState("steps", "steps binary")

    def _wake(self, due_us: int, watermark_ms: int) -> None:
        """Have a timer expire at ``due_us``, or as soon as it can: it has to lie after the watermark."""
        self.handle.registerTimer(max(-(-due_us // 1000), watermark_ms + 1))

    def handleInputRows(self, key, rows, timerValues):
        """A batch costs its own steps: they are appended, and what is held is not read."""
        due = []
        while part := list(islice(rows, EPISODE_CHUNK)):
            cols = dict(zip(part[0].__fields__, zip(*part)))
            steps = pa.table([cols[c] for c in _STEPS.names], schema=_STEPS)
            self.steps.appendValue((_to_bytes(steps),))
            us = steps["us"].to_numpy()
            due.append(int(np.where(steps["t"].to_numpy(), us + 1, us + self.gap_us).min()))
        self._wake(min(due), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Episodes that nothing can change any more leave; the steps of the others are put back."""
        watermark = timerValues.getCurrentWatermarkInMs()
        parts = [pa.ipc.open_stream(x[0]).read_all() for x in self.steps.get()]
        if not parts:
            return
        held = pa.concat_tables(parts)
        k = held["k"].combine_chunks().dictionary_encode().indices.to_numpy()
        # by key, time and order; steps that tie stay as they came
        at = np.lexsort((held["o"].to_numpy(), held["us"].to_numpy(), k))
        held, k = held.take(at), k[at]
        us, end = held["us"].to_numpy(), held["t"].to_numpy()
        first = np.flatnonzero(np.r_[True, (np.diff(k) != 0) | (np.diff(us) >= self.gap_us) | end[:-1]])
        last = np.r_[first[1:], len(us)] - 1
        settled_at = np.where(end[last], us[last] + 1, us[last] + self.gap_us)
        done = settled_at <= watermark * 1000
        if done.all():
            self.steps.clear()
        else:
            if done.any():
                left = held.filter(pa.array(np.repeat(~done, last - first + 1)))
                self.steps.put([(_to_bytes(left.slice(i, EPISODE_CHUNK)),) for i in range(0, len(left), EPISODE_CHUNK)])
            self._wake(int(settled_at[~done].min()), watermark)
        first, last = first[done], last[done]
        for i in range(0, len(first), EPISODE_CHUNK):
            a, b = first[i : i + EPISODE_CHUNK], last[i : i + EPISODE_CHUNK]
            names = held["s"].slice(a[0], b[-1] - a[0] + 1).to_pylist()
            yield Row(
                key=held["k"].take(a).to_pylist(), start_us=us[a].tolist(), end_us=us[b].tolist(), n_steps=(b - a + 1).tolist(),
                states=[" ".join(names[x : y + 1]) for x, y in zip((a - a[0]).tolist(), (b - a[0]).tolist())],
                closed_by=np.where(end[b], "terminal", "inactive").tolist(),
            )

    def close(self) -> None:
        pass


def assemble_until_terminal(
    stream: DataFrame, key: str | Sequence[str], time_col: str, order_col: str, state_col: str, terminal: F.Column | str, gap_seconds: int,
    groups: int = EPISODE_GROUPS,
) -> DataFrame:
    """Episodes closed by a terminal step, or by ``gap_seconds`` of inactivity.

    ``transformWithState``: the keys are dealt to ``groups`` by digest, and the unsettled
    steps of a group are a list state to which a batch appends its own; a timer reads it
    when the first episode may be settled. A call to the state thus serves all keys of a
    group; a task holds one group's unsettled steps at a time. ``groups`` must not change
    over a checkpoint's life. A step that
    arrives out of order within the watermark takes its place by time. An episode leaves
    once nothing can change it: its terminal step is older than the watermark, or its last
    step plus the gap is. Steps older than the watermark are dropped by Spark; the caller
    sets it on ``time_col`` and starts the stream under ``rocksdb_state``. To have the open
    episodes too at the end of a feed, send a step of another key that moves the watermark.
    Times cross the Python boundary as epoch microseconds, so nothing depends
    on the session time zone. Key columns may be null; steps without a time are left out.
    """
    term = F.col(terminal) if isinstance(terminal, str) else terminal
    keys = [key] if isinstance(key, str) else list(key)
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    # one text per key, whatever its columns
    rows = stream.where(F.col(time_col).isNotNull()).select(
        F.to_json(F.struct(*keys), options).alias("k"), time_col, F.unix_micros(time_col).alias("us"), F.coalesce(F.col(order_col).cast("bigint"), F.lit(0)).alias("o"),
        F.coalesce(F.col(state_col).cast("string"), F.lit("")).alias("s"), F.coalesce(term, F.lit(False)).alias("t"),
    )
    key_type = stream.select(*keys).schema
    out = rows.withColumn("g", F.pmod(F.xxhash64("k"), F.lit(groups)).cast("int")).groupBy("g").transformWithState(
        _EpisodeProcessor(int(gap_seconds) * 1_000_000),
        "key array<string>, start_us array<bigint>, end_us array<bigint>, n_steps array<bigint>, states array<string>, closed_by array<string>",
        "Append", "EventTime",
    )
    return out.select(F.inline(F.arrays_zip(*out.columns))).select(
        F.from_json("key", key_type, options).alias("key"),
        F.timestamp_micros("start_us").alias("episode_start"),
        F.timestamp_micros("end_us").alias("episode_end"),
        "n_steps", "states", "closed_by",
    ).select("key.*", "episode_start", "episode_end", "n_steps", "states", "closed_by")
