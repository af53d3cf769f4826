"""Answer extraction and scoring (P11–P13), all built-in column functions.

Extraction never raises: ANSI casts go through ``try_cast`` /
``try_element_at`` and every row gets a ``status``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trajspark.functions.keys import seeded_uniform

# Answer markers.
BEST_MOVE_MARKER = '"best_move": '
VERDICT_MARKER = "Advantage"
VERDICT_TAGS = ("<white>", "<black>")


# P11 ------------------------------------------------------------------------
def extract_pattern(
    df: DataFrame, response: str, legal: str, keys: Sequence[str], seed: int | str = 42, marker: str = BEST_MOVE_MARKER
) -> DataFrame:
    """The single digit after the first marker names the move from 1: digit − 1 is the action itself.

    ``legal`` is an array of action numbers. A digit − 1 that is not in it, or no digit →
    a seeded uniform legal action with status 'fallback' (status 'no_marker' when the
    marker is absent).
    """
    parts = F.split(F.col(response), F.lit(marker), -1)
    after = F.try_element_at(parts, F.lit(2))
    digit = F.expr("try_cast(substring(_after, 1, 1) AS INT)")
    t = df.withColumn("_after", after).withColumn("_d", digit)
    move = (F.col("_d") - 1).cast(df.schema[legal].dataType.elementType)
    ok = F.col("_after").isNotNull() & F.coalesce(F.array_contains(F.col(legal), move), F.lit(False))
    u = seeded_uniform(f"{seed}|pick", keys)
    fallback = F.element_at(F.col(legal), (F.floor(u * F.size(legal)) + 1).cast("int"))
    status = F.when(F.col("_after").isNull(), "no_marker").when(ok, "ok").otherwise("fallback")
    return (
        t.withColumn("action", F.when(ok, move).otherwise(fallback))
        .withColumn("status", status)
        .drop("_after", "_d")
    )


def extract_json(df: DataFrame, response: str, schema: StructType | str, field: str, default: Column) -> DataFrame:
    """Parse a JSON answer; a missing/malformed field takes the default (status 'default')."""
    parsed = F.from_json(F.col(response), schema)
    val = parsed[field]
    return df.withColumn("answer", F.coalesce(val, default)).withColumn(
        "status", F.when(val.isNull(), "default").otherwise("ok")
    )


def verdict(text: Column, marker: str = VERDICT_MARKER, tags: tuple[str, str] = VERDICT_TAGS) -> Column:
    """Verdict after the last marker word: exactly one tag decides, both/neither → 'undecided'."""
    tail = F.element_at(F.split(text, F.lit(marker), -1), -1)
    a, b = tags
    has_a = F.contains(tail, F.lit(a))
    has_b = F.contains(tail, F.lit(b))
    return (
        F.when(has_a & ~has_b, a.strip("<>"))
        .when(has_b & ~has_a, b.strip("<>"))
        .otherwise("undecided")
    )


def extract_verdict(df: DataFrame, response: str) -> DataFrame:
    v = verdict(F.col(response))
    return df.withColumn("predict", v).withColumn(
        "status", F.when(F.col("predict") == "undecided", "undecided").otherwise("ok")
    )


def yield_report(df: DataFrame, mode: str) -> DataFrame:
    """Rows per extraction status."""
    return df.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("mode", F.lit(mode))


# P12 ------------------------------------------------------------------------
def verdict_accuracy(pred: DataFrame, labels: DataFrame, key: Sequence[str], min_abs: float = 0.2) -> DataFrame:
    """Join predictions to labels, drop |win_rate| < min_abs and undecided, right / total.

    Labels are deduplicated first (last wins by ``label_seq`` when present).
    Accuracy is null when nothing qualifies.
    """
    if "label_seq" in labels.columns:
        labels = labels.groupBy(*key).agg(
            F.max_by(F.struct("win", "win_rate"), "label_seq").alias("_l")
        ).select(*key, "_l.win", "_l.win_rate")
    j = pred.join(labels.select(*key, "win", "win_rate"), list(key))
    q = j.where((F.abs("win_rate") >= min_abs) & (F.col("predict") != "undecided"))
    return q.agg(
        F.count_if(F.col("predict") == F.col("win")).alias("n_right"), F.count(F.lit(1)).alias("n_total")
    ).withColumn("accuracy", F.round(F.col("n_right") / F.nullif(F.col("n_total"), F.lit(0)), 6))


# P13 ------------------------------------------------------------------------
def move_distribution(
    logprobs: DataFrame, state: str, move: str, lp: str, temperature: float = 1.0, seed: int | str = 42
) -> DataFrame:
    """Per state: softmax over legal moves, argmax, and a seeded temperature sample.

    Illegal or unseen moves carry lp = −inf and get probability 0; a state
    whose moves are all −inf gets the uniform distribution. The sample is
    the first move (in move order) whose cumulative probability exceeds a
    seeded uniform number.
    """
    wp = Window.partitionBy(state)
    m = F.max(lp).over(wp)
    n = F.count(F.lit(1)).over(wp)
    ninf = F.lit(float("-inf"))
    t = logprobs.withColumn("_m", m).withColumn("_n", n)
    e = F.when(F.col(lp) == ninf, F.lit(0.0)).otherwise(F.exp((F.col(lp) - F.col("_m")) / temperature))
    t = t.withColumn("_e", F.when(F.col("_m") == ninf, F.lit(1.0)).otherwise(e))
    t = t.withColumn("p", F.col("_e") / F.sum("_e").over(wp))
    wo = Window.partitionBy(state).orderBy(move)
    t = t.withColumn("_cum", F.sum("p").over(wo.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    t = t.withColumn("_prev", F.coalesce(F.sum("p").over(wo.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    u = seeded_uniform(seed, [state])
    t = t.withColumn("_u", u)
    last = F.row_number().over(Window.partitionBy(state).orderBy(F.col(move).desc())) == 1
    is_sample = ((F.col("_prev") <= F.col("_u")) & (F.col("_u") < F.col("_cum"))) | (last & (F.col("_cum") <= F.col("_u")))
    wa = Window.partitionBy(state).orderBy(F.col("p").desc(), F.col(move))
    return t.select(
        state,
        move,
        lp,
        F.round("p", 6).alias("p"),
        (F.row_number().over(wa) == 1).alias("is_argmax"),
        is_sample.alias("is_sample"),
    )


# P13 (token level) --------------------------------------------------------------
#: fixed values: texts of the tokens that close a move in a chat transcript
HEADER_TOKENS = ("<|start_header_id|>", "assistant", "<|end_header_id|>", "\n\n")


def extract_move_logprobs(
    outputs: DataFrame, keys: Sequence[str], positions: str, legal: str, moves: Mapping[str, int], headers: Sequence[str] = HEADER_TOKENS
) -> DataFrame:
    """Log-prob of every legal move from a model's token log-probs by position.

    ``positions``: array of positions, each an array of (token, logprob) candidates or null;
    ``legal``: array of the state's legal moves; ``moves``: move of each move token. A position
    tells of a move when it holds a move token (the last one counts) and a token of a closing
    header. A move's log-prob is the highest of its positions, over all outputs of the key;
    one that is null, NaN or infinite counts as -inf. Moves never seen are -inf; a key without
    a finite log-prob gets 0.0 for all its legal moves (``is_uniform``), as a uniform choice.

    Rows per legal move: (keys…, move, lp, n_positions, is_uniform). Outputs are reduced to
    their best value per move inside the row before the shuffle, so a key may have any number.
    Rows of a key share its legal moves; a null list of positions has none.
    """
    ninf = F.lit(float("-inf"))
    table = F.create_map(*[F.lit(x) for pair in moves.items() for x in pair])

    def told(p: F.Column) -> F.Column:
        named = F.filter(p, lambda c: c["token"].isin(*moves))
        closed = F.exists(p, lambda c: F.coalesce(c["token"].isin(*headers), F.lit(False)))
        last = F.get(named, F.size(named) - 1)
        lp = last["logprob"].cast("double")
        finite = F.when(lp.isNull() | F.isnan(lp) | (F.abs(lp) == float("inf")), ninf).otherwise(lp)
        return F.when(closed & (F.size(named) > 0), F.struct(F.element_at(table, last["token"]).alias("move"), finite.alias("lp")))

    t = outputs.select(*keys, F.col(legal).alias("_legal"), F.filter(F.transform(F.coalesce(F.col(positions), F.array()), told), lambda x: x.isNotNull()).alias("_seen"))
    per_move = lambda m: F.filter("_seen", lambda x: x["move"] == m)
    one = t.select(
        *keys,
        F.explode(
            F.transform("_legal", lambda m: F.struct(m.alias("move"), F.array_max(F.transform(per_move(m), lambda x: x["lp"])).alias("lp"), F.size(per_move(m)).cast("bigint").alias("n")))
        ).alias("_m"),
    )
    best = one.groupBy(*keys, F.col("_m.move").alias("move")).agg(F.coalesce(F.max("_m.lp"), ninf).alias("lp"), F.sum("_m.n").alias("n_positions"))
    none = F.max("lp").over(Window.partitionBy(*keys)) == ninf
    return best.select(*keys, "move", F.when(none, 0.0).otherwise(F.col("lp")).alias("lp"), "n_positions", none.alias("is_uniform"))
