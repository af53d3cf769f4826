"""Sources and sinks.

Every buffer is read with an explicit schema (no inference); malformed lines
go to a reject table instead of failing the job; arrays exist only at this
edge and become the long ``steps`` table right away.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.operators.sampling import shuffle, with_index
from trajspark.session import write_table

CORRUPT = "_corrupt_record"

# S1 schemas per buffer kind --------------------------------------------------
# Field names (also the odd spelling) and types of the log formats.
TRAJ_SCHEMAS: dict[str, T.StructType] = {
    # tic-tac-toe: state = [[9 board cells], "O"/"X"] (heterogeneous → array<string>)
    "tictactoe": T.StructType(
        [
            T.StructField("state", T.ArrayType(T.ArrayType(T.StringType()))),
            T.StructField("action", T.ArrayType(T.IntegerType())),
            T.StructField("reward", T.ArrayType(T.IntegerType())),
            T.StructField("turn", T.ArrayType(T.BooleanType())),
        ]
    ),
    # two-player board game with a 2-vector reward and serialised states
    "breakthrough": T.StructType(
        [
            T.StructField("state", T.ArrayType(T.StringType())),
            T.StructField("action", T.ArrayType(T.StringType())),
            T.StructField("reward", T.ArrayType(T.ArrayType(T.DoubleType()))),
            T.StructField("turn", T.ArrayType(T.IntegerType())),
            T.StructField("serializad_state", T.ArrayType(T.StringType())),
        ]
    ),
    # generic: string states and actions, numeric reward, boolean turn
    "generic": T.StructType(
        [
            T.StructField("state", T.ArrayType(T.StringType())),
            T.StructField("action", T.ArrayType(T.StringType())),
            T.StructField("reward", T.ArrayType(T.DoubleType())),
            T.StructField("turn", T.ArrayType(T.BooleanType())),
        ]
    ),
}
# How the logs name a terminal state, and its evaluation.
TERMINAL_SENTINEL = "Terminal State."
TERMINAL_EVAL = "This is the terminal state."
# Field names and types of the look-ahead log format.
LOOKAHEAD_SCHEMA = T.StructType(
    [
        T.StructField("current_state", T.StringType()),
        T.StructField("current_serializad_state", T.StringType()),
        T.StructField(
            "pv",
            T.ArrayType(
                T.StructType(
                    [
                        *TRAJ_SCHEMAS["breakthrough"].fields,
                        T.StructField(
                            "final_state",
                            T.StructType(
                                [
                                    T.StructField("state", T.StringType()),
                                    T.StructField("eval", T.StringType()),
                                    T.StructField("turn", T.IntegerType()),
                                ]
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)


def _paths(paths: str | Sequence[str]) -> list[str]:
    if isinstance(paths, str):
        return [p for p in paths.split(",") if p]
    return list(paths)


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])


#: digests of repeated lines that are broadcast, bytes (measured); more are joined
REPEATS_BROADCAST = 32 << 20
#: copies of one repeated line that are numbered at a time
REPEATS_STEP = 4096


def _numbered(raw: DataFrame, broadcast_bytes: int = REPEATS_BROADCAST) -> DataFrame:
    """(source_file, line, record_id): the digest of file and line, with ``-2``, ``-3``, … for further copies.

    Only 16-byte digests are counted, after partial aggregation, and only those that repeat
    are kept (written to the shared folder). A line whose digest doesn't repeat goes on from
    where it was read. Copies of a line can't be told apart, so repeated lines meet as
    one row per task and are then written out as often as they were counted.
    """
    raw = raw.withColumn("_id", F.unhex(F.md5(F.concat_ws("\n", "source_file", "line"))))
    counts = raw.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    repeats = write_table(counts, "repeats").select("_id")
    if repeats.count() * 32 <= broadcast_bytes:
        repeats = F.broadcast(repeats)
    text = F.lower(F.hex("_id"))
    once = raw.join(repeats, "_id", "left_anti").select("source_file", "line", text.alias("record_id"))
    again = raw.join(repeats, "_id", "left_semi").groupBy("_id").agg(
        F.first("source_file").alias("source_file"), F.first("line").alias("line"), F.count(F.lit(1)).alias("_n")
    )
    again = again.withColumn("_from", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"), F.lit(REPEATS_STEP).cast("bigint"))))
    again = again.withColumn("_k", F.explode(F.sequence("_from", F.least(F.col("_n"), F.col("_from") + REPEATS_STEP - 1))))
    return once.unionByName(again.select("source_file", "line", F.when(F.col("_k") == 1, text).otherwise(F.concat_ws("-", text, "_k")).alias("record_id")))


def read_records(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, required: str
) -> tuple[DataFrame, DataFrame]:
    """JSON lines → (rows with ``source_file`` and ``record_id``, rejects).

    A line that is no JSON of this shape, or lacks the ``required`` field, is a reject
    (source_file, record_id, line); blank lines don't count. The record id is a digest of
    the file and the line, with a number for lines that repeat in a file, so it doesn't
    depend on how the files are split or read (see ``_numbered``).
    """
    raw = spark.read.text(_paths(paths)).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("line"))
    raw = _numbered(raw.where(~F.col("line").rlike(r"^\s*$")))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    rows = raw.withColumn("_r", F.from_json("line", _with_corrupt(schema), options))
    bad = F.col("_r").isNull() | F.col(f"_r.{CORRUPT}").isNotNull() | F.col(f"_r.{required}").isNull()
    rejects = rows.where(bad).select("source_file", "record_id", "line")
    return rows.where(~bad).select("source_file", "record_id", *[F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields]), rejects


# S1 -------------------------------------------------------------------------
def read_trajectories(
    spark: SparkSession, paths: str | Sequence[str], kind: str, extra: Sequence[T.StructField] = ()
) -> tuple[DataFrame, DataFrame]:
    """Trajectory JSONL → (trajectory rows with ``episode_id``, rejects); see ``read_records``."""
    schema = T.StructType(list(TRAJ_SCHEMAS[kind].fields) + list(extra))
    good, rejects = read_records(spark, paths, schema, "state")
    return good.withColumnRenamed("record_id", "episode_id"), rejects


def trajectories_to_steps(traj: DataFrame, kind: str, keys: Sequence[str] = ("episode_id",)) -> DataFrame:
    """Struct-of-arrays → long ``steps`` table (state n+1 rows, the last is terminal).

    The two-player kind is brought to the same form as the others: ``reward`` is the
    first player's, ``turn`` is true when the first player (0) acts, and the serialised
    state stands beside the shown one as ``serialised_state``.
    """
    keys = list(keys)
    two = kind == "breakthrough"
    t = traj.select(
        *keys, "action", "reward", "turn", *(["serializad_state"] if two else []), F.posexplode("state").alias("step", "_s"), F.size("state").alias("_n")
    )
    i = F.col("step") + 1
    if kind == "tictactoe":
        state = F.struct(F.from_json(F.col("_s")[0], "array<int>").alias("board"), F.col("_s")[1].alias("mark"))
    else:
        state = F.col("_s")
    reward, turn = F.try_element_at("reward", i), F.try_element_at("turn", i)
    if two:
        reward, turn = F.try_element_at(reward, F.lit(1)), turn == 0
    return t.select(
        *keys,
        F.col("step").cast("int").alias("step"),
        state.alias("state"),
        *([F.try_element_at("serializad_state", i).alias("serialised_state")] if two else []),
        F.try_element_at("action", i).alias("action"),
        reward.alias("reward"),
        turn.alias("turn"),
        (F.col("step") == F.col("_n") - 1).alias("is_terminal"),
    )


def read_buffer(
    spark: SparkSession, paths: str | Sequence[str], kind: str, extra: Sequence[T.StructField] = ()
) -> tuple[DataFrame, DataFrame]:
    """Trajectory buffer → (steps, rejects)."""
    traj, rejects = read_trajectories(spark, paths, kind, extra)
    keys = ["episode_id", *[f.name for f in extra]]
    return trajectories_to_steps(traj, kind, keys), rejects


def read_lookahead(
    spark: SparkSession, paths: str | Sequence[str], extra: Sequence[T.StructField] = ()
) -> tuple[DataFrame, DataFrame]:
    """Look-ahead records → (one row per variation, rejects).

    Rows: record_id, extra fields, current_state, current_serialised_state, pv_idx from 0,
    ``pv`` (the variation as logged) and ``final_state`` (state, eval, turn: first player
    to move, is_terminal).
    """
    good, rejects = read_records(spark, paths, T.StructType([*LOOKAHEAD_SCHEMA.fields, *extra]), "pv")
    rows = good.select(
        "record_id", *[f.name for f in extra], "current_state", F.col("current_serializad_state").alias("current_serialised_state"),
        F.posexplode("pv").alias("pv_idx", "pv"),
    )
    end = F.col("pv.final_state")
    return rows.withColumn(
        "final_state",
        F.struct(end["state"].alias("state"), end["eval"].alias("eval"), (end["turn"] == 0).alias("turn"), (end["state"] == TERMINAL_SENTINEL).alias("is_terminal")),
    ), rejects


def write_lookahead(rows: DataFrame, path: str, extra: Sequence[str] = ()) -> None:
    """Variations back to one record a line, in pv_idx order, with the evaluations of ``final_state`` in place.

    A record's variations are gathered in one row, as the format asks.
    """
    pv = F.col("pv").withField("final_state", F.col("pv.final_state").withField("eval", F.col("final_state.eval")))
    g = rows.groupBy("record_id", *extra).agg(
        F.first("current_state").alias("current_state"),
        F.first("current_serialised_state").alias("current_serializad_state"),
        F.sort_array(F.collect_list(F.struct("pv_idx", pv.alias("v")))).alias("_pv"),
    )
    out = g.select(*extra, "current_state", "current_serializad_state", F.transform("_pv", lambda x: x["v"]).alias("pv"))
    write_buffer(out, path)


# S2 -------------------------------------------------------------------------
def write_buffer(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """JSONL sink; nulls are written (they are meaningful, e.g. ``eval: null``).

    ``partition_by`` writes one folder per value (e.g. one run folder per
    iteration) in a single job.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError("mode must be 'overwrite' or 'append'")
    w = df.write.mode(mode).option("ignoreNullFields", "false")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


# S3 -------------------------------------------------------------------------
def merge_keyed(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """Keyed records merged with the last record winning (partial aggregation, no sort)."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def read_keyed(spark: SparkSession, paths: str | Sequence[str], value_type: str = "string") -> tuple[DataFrame, DataFrame]:
    """Lines of ``{key: value, …}`` objects → ((key BIGINT, value, file, block, pos) rows, rejects).

    Merge with ``merge_keyed(…, ["file", "block", "pos"])``: ``block`` is the
    byte offset of the file split (Spark packs splits into tasks by size, so
    a later split of a big file can get smaller ids), ``pos`` increases with
    the line inside a split. Rejects (file, line): lines that are no such object,
    and keys that are no number.
    """
    raw = spark.read.text(_paths(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), "value",
    ).where(~F.col("value").rlike(r"^\s*$"))
    m = raw.withColumn("_m", F.from_json("value", f"map<string,{value_type}>"))
    bad = m.where(F.col("_m").isNull()).select("file", F.col("value").alias("line"))
    e = m.select("file", "block", "pos", F.col("value").alias("line"), F.explode("_m").alias("_k", "value"))
    e = e.withColumn("key", F.expr("try_cast(_k AS BIGINT)"))
    bad = bad.unionByName(e.where(F.col("key").isNull()).select("file", "line"))
    return e.where(F.col("key").isNotNull()).select("key", "value", "file", "block", "pos"), bad


# S4 -------------------------------------------------------------------------
def read_runs(
    spark: SparkSession, paths: str | Sequence[str], kind: str, extra: Sequence[T.StructField] = ()
) -> tuple[DataFrame, DataFrame]:
    """Many run folders / comma-separated paths / globs → (one steps table, rejects).

    ``run`` is the name of the folder that holds each file.
    """
    traj, rejects = read_trajectories(spark, paths, kind, extra)
    run = F.regexp_extract(F.col("source_file"), r"([^/]+)/[^/]+$", 1)
    keys = ["run", "episode_id", *[f.name for f in extra]]
    return trajectories_to_steps(traj.withColumn("run", run), kind, keys), rejects.withColumn("run", run)


# S5 -------------------------------------------------------------------------
STATE_BUFFER = T.StructType([T.StructField("serializad_state", T.StringType())])


def read_states(
    spark: SparkSession, paths: str | Sequence[str], kind: str, traj_kind: str = "breakthrough"
) -> tuple[DataFrame, DataFrame]:
    """A trajectory buffer or a state buffer → (one ``state`` table, distinct and non-terminal, rejects).

    ``kind`` is 'trajectory' or 'states'; lines of another shape are rejects.
    """
    if kind == "states":
        good, rejects = read_records(spark, paths, STATE_BUFFER, "serializad_state")
        df = good.select(F.col("serializad_state").alias("state"))
    elif kind == "trajectory":
        traj, rejects = read_trajectories(spark, paths, traj_kind)
        col = "serializad_state" if "serializad_state" in traj.columns else "state"
        df = traj.select(F.explode(col).alias("state"))
    else:
        raise ValueError(f"unknown buffer kind {kind!r}; expected 'trajectory' or 'states'")
    return df.where(F.col("state").isNotNull() & (F.col("state") != TERMINAL_SENTINEL)).distinct(), rejects


# Win-rate labels -------------------------------------------------------------
# Field names and types of the label log.
LABEL_SCHEMA = T.StructType(
    [
        T.StructField("state_turn", T.StructType([T.StructField("state", T.StringType()), T.StructField("turn", T.IntegerType())])),
        T.StructField("win", T.StringType()),
        T.StructField("win_rate", T.DoubleType()),
        T.StructField("label_seq", T.LongType()),
    ]
)


def write_labels(labels: DataFrame, path: str, key: str = "key", turn: str = "turn", seq: str = "label_seq") -> None:
    """Win-rate labels (key, turn, win, win_rate, seq) as JSON lines."""
    out = labels.select(F.struct(F.col(key).alias("state"), F.col(turn).alias("turn")).alias("state_turn"), "win", "win_rate", F.col(seq).cast("long").alias("label_seq"))
    write_buffer(out, path)


def read_labels(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Win-rate label lines → ((key, turn, win, win_rate, label_seq), rejects); P12 lets the last of a key win."""
    good, rejects = read_records(spark, paths, LABEL_SCHEMA, "state_turn")
    return good.select(F.col("state_turn.state").alias("key"), F.col("state_turn.turn").alias("turn"), "win", "win_rate", "label_seq"), rejects


# S6 -------------------------------------------------------------------------
def history_window(df: DataFrame, iteration: int, history: int, seed: int | str = 42, it_col: str = "iter",
                   keys: Sequence[str] | None = None) -> DataFrame:
    """Union of iterations max(1, i+1−history) … i, then a seeded shuffle.

    On a table partitioned by ``it_col`` the filter prunes partitions.
    """
    lo = max(1, iteration + 1 - history)
    w = df.where(F.col(it_col).between(lo, iteration))
    return shuffle(w, keys or w.columns, seed)


# S7 -------------------------------------------------------------------------
def contiguous_iterations(df: DataFrame, it_col: str = "iter") -> DataFrame:
    """Rows of iterations 1, 2, … up to the first gap.

    The first gap is the smallest of {1} ∪ {i + 1} that is not an iteration:
    an anti join of the distinct iteration list with itself and a global
    ``min`` (partial aggregation; no window, no single partition). Rows are
    then kept by a range filter.
    """
    its = df.select(F.col(it_col).cast("long").alias("_i")).distinct()
    cand = its.select((F.col("_i") + 1).alias("_i")).union(df.sparkSession.range(1, 2).select(F.col("id").alias("_i")))
    first_gap = cand.join(its, "_i", "left_anti").select(F.min("_i")).scalar()
    return df.where((F.col(it_col) >= 1) & (F.col(it_col) < F.lit(first_gap)))


# S8 -------------------------------------------------------------------------
def export_requests(
    prompts: DataFrame, keys: Sequence[str], model: str, params: Mapping[str, float], url: str = "/v1/chat/completions",
    raw: str | None = None,
) -> DataFrame:
    """Batch-inference request lines: custom_id 'request-<idx>' from a stable index."""
    idx, _ = with_index(prompts, [F.col(k) for k in keys], "_idx")
    body = F.struct(
        F.lit(model).alias("model"),
        F.col("messages").alias("messages"),
        *[F.lit(v).alias(k) for k, v in params.items()],
    )
    fields = [
        F.concat(F.lit("request-"), F.col("_idx").cast("string")).alias("custom_id"),
        F.lit("POST").alias("method"),
        F.lit(url).alias("url"),
        body.alias("body"),
    ]
    if raw:
        fields.append(F.col(raw).alias("raw_data"))
    rec = F.struct(*fields)
    return idx.select(*keys, F.col("_idx").alias("idx"), rec["custom_id"].alias("custom_id"), F.to_json(rec).alias("line"))


def write_requests(requests: DataFrame, path: str) -> None:
    """Request lines as text, one request a line."""
    requests.select("line").write.mode("overwrite").text(path)


# S9 -------------------------------------------------------------------------
def save_values(df: DataFrame, path: str, info: Mapping[str, object]) -> None:
    """Value table (state, value to 3 places, visits) as Parquet plus a one-row JSON header."""
    spark = df.sparkSession
    df.select("state", F.round("value", 3).alias("value"), F.col("visits").cast("bigint").alias("visits")).write.mode(
        "overwrite"
    ).parquet(f"{path}/values")
    spark.createDataFrame([(json.dumps(dict(info), sort_keys=True),)], "info string").write.mode("overwrite").text(
        f"{path}/header"
    )


def load_values(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    header = spark.read.text(f"{path}/header").first()[0]
    return spark.read.parquet(f"{path}/values"), json.loads(header)


# S10 ------------------------------------------------------------------------
def write_manifest(spark: SparkSession, path: str, params: Mapping[str, object], counts: Mapping[str, int]) -> DataFrame:
    """One-row manifest of parameters, row counts and seed written beside an output."""
    row = {"params": json.dumps(dict(params), sort_keys=True, default=str), **{f"n_{k}": int(v) for k, v in counts.items()}}
    m = spark.createDataFrame([row])
    m.write.mode("overwrite").json(f"{path}/_manifest")
    return m
