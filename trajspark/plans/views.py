"""Views over the driver's tables that give every operator real rows.

Each view has a Spark builder here and a DuckDB twin in ``views_sql``. The
canonical trajectory form is the long ``steps`` table:

    (episode keys…, step, state, action, reward, turn, is_terminal, …)

``step`` is 0-based and total inside an episode; row ``t`` holds state
``s_t``, the action ``a_t`` taken there and the reward ``r_t`` that action
earned. The last row of an episode is the terminal state: its action and
reward are null. ``turn`` is true when our player acts at ``t``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.operators.steps import number_steps
from trajspark.session import write_table
from trajspark.sources.tables import table

EP_KEYS = ["user_id", "week"]
ORDER_KEYS = ["l_orderkey"]


def _outcome(col) -> F.Column:
    """Terminal reward of a week episode: +1 purchase, -1 error, else 0."""
    return F.when(col == "purchase", 1).when(col == "error", -1).otherwise(0)


# An episode is numbered by spans of time of this length, so that a task holds a span and not an episode.
SPAN = "minute"

def _weeks(ev: DataFrame) -> tuple[DataFrame, F.Column]:
    """Add the episode week; the iteration is the week number from 1.

    The first week is a scalar subquery: no cross join, no unpartitioned window.
    """
    ev = ev.withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    first_week = ev.select(F.min("week")).scalar()
    return ev, (F.floor(F.datediff("week", first_week) / 7) + 1).cast("int").alias("iter")


def ep_event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-episode facts of ``ep_events`` straight from ``events``, without a window.

    Same rows as ``episode_facts(ep_events(...))``: only the last action earns
    a reward (the outcome of the terminal event), so final reward = return =
    outcome of the last event; the first turn is the turn at step 0; an
    episode needs two events to hold an action. First and last events are
    ``min_by`` / ``max_by`` on (ts, event_id): partial aggregation, so a hot
    episode is combined map-side instead of landing whole in one task.
    """
    ev, it = _weeks(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"))
    order = F.struct("ts", "event_id")
    f = ev.groupBy(*EP_KEYS).agg(
        F.min_by("event_type", order).alias("first_state"),
        F.max_by("event_type", order).alias("last_state"),
        F.count(F.lit(1)).alias("n_steps"),
    ).where(F.col("n_steps") > 1)
    final = _outcome(F.col("last_state")).cast("int")
    return f.select(
        *EP_KEYS, it, "first_state",
        ((F.col("user_id") % 2) == 0).alias("first_turn"),
        final.alias("final_reward"),
        final.cast("bigint").alias("ep_return"),
        (F.col("n_steps") - 1).alias("n_actions"),
    )


def ep_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as week episodes: episode = (user_id, week of ts).

    step = row_number over (episode order by ts, event_id) - 1; state is the
    event type, the action is the next event type, the reward of the last
    action is the outcome of the terminal event; iter = week number from 1.
    """
    ev, it = _weeks(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"))
    ev = number_steps(ev, EP_KEYS, ["ts", "event_id"], "event_type", F.date_trunc(SPAN, "ts"), ahead=2)
    step, nxt, nxt2 = F.col("step"), F.col("_next1"), F.col("_next2")
    return ev.select(
        "user_id",
        "week",
        it,
        step.alias("step"),
        "event_id",
        F.col("event_type").alias("state"),
        nxt.alias("action"),
        F.when(nxt.isNull(), F.lit(None).cast("int"))
        .when(nxt2.isNull(), _outcome(nxt))
        .otherwise(0)
        .cast("int")
        .alias("reward"),
        (((F.col("user_id") + step) % 2) == 0).alias("turn"),
        nxt.isNull().alias("is_terminal"),
        F.round(F.col("value") / 400, 6).alias("value"),
    )


def ep_events_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ep_events`` written once to the shared folder, for queries that read it several times."""
    return write_table(ep_events(spark, sf_dir), "ep-events")


def ep_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as order episodes (the large-scale trajectory table).

    (l_orderkey, l_linenumber) repeats in the test data, so the step order
    uses every column, which makes it total.
    """
    li = table(spark, sf_dir, "lineitem")
    order_cols = [
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ]
    li = li.withColumn("state", F.concat("l_returnflag", "l_linestatus"))
    li = number_steps(li, ORDER_KEYS, order_cols, "state", F.floor(F.col("l_linenumber") / 4096), ahead=1)
    nxt = F.col("_next1")
    return li.select(
        "l_orderkey",
        "step",
        "state",
        nxt.alias("action"),
        F.when(nxt.isNull(), F.lit(None).cast("double")).otherwise(F.col("l_quantity")).alias("reward"),
        ((F.col("step") % 2) == 0).alias("turn"),
        nxt.isNull().alias("is_terminal"),
        F.col("l_extendedprice").alias("value"),
    )


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (event_type, props) states; terminal = event_type 'error'."""
    ev = table(spark, sf_dir, "events")
    return (
        ev.select(F.col("event_type").alias("state"), "props")
        .distinct()
        .withColumn("is_terminal", F.col("state") == "error")
    )


def raw_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (event_type, props) occurrence, duplicates kept (input to D1)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_type").alias("state"), "props", "event_id", "user_id")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """state = user_id, candidate = event_type, sample_idx = event_id."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("state"),
        F.col("event_type").alias("candidate"),
        F.col("event_id").alias("sample_idx"),
    )


def policy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own steps of ``ep_events`` with logged log-probs and an advantage."""
    ep = ep_events(spark, sf_dir).where(F.col("action").isNotNull())
    return ep.select(
        *EP_KEYS, "iter", "step", "state", "action", "reward", "turn", "value",
        (-F.col("value")).alias("old_lp"),
        (-F.col("value") + F.lit(0.1) * ((F.col("step") % 3) - 1)).alias("lp"),
        (F.col("reward") - F.col("value")).alias("adv"),
    )


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` with a total turn order (turn, role, text)."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed replay records: key = user_id, value = event_type, order = event_id."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq")
    )


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected part–supplier graph from ``lineitem``: nodes 'p<k>' and 's<k>'."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    p = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    s = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    # both directions from one pass over the distinct pairs
    both = F.array(F.struct(p.alias("src"), s.alias("dst")), F.struct(s.alias("src"), p.alias("dst")))
    return li.select(F.explode(both).alias("_e")).select("_e.src", "_e.dst")


def week_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(state, props) occurrences tagged with their week number from 1 (iteration)."""
    ev = table(spark, sf_dir, "events").withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    first_week = ev.select(F.min("week")).scalar()
    return ev.select(
        F.col("event_type").alias("state"),
        "props",
        (F.col("event_type") == "error").alias("is_terminal"),
        (F.floor(F.datediff("week", first_week) / 7) + 1).cast("int").alias("iter"),
    )


def batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users of ``events`` (rows to batch)."""
    return table(spark, sf_dir, "events").select("user_id").distinct()


#: a look-ahead record is a state of a user
LA_RECORD = ["user_id", "state"]


def lookahead_ev(spark: SparkSession, sf_dir: str, k: int = 4, seed: int = 42) -> DataFrame:
    """Look-ahead records in long form: record = a user's state, variations = all k-step
    look-aheads that start from it (current_state), numbered in seeded md5 order (pv_idx from 0)."""
    from trajspark.operators.sampling import seeded_rank
    from trajspark.operators.steps import look_ahead

    la = look_ahead(ep_events(spark, sf_dir), EP_KEYS, k)
    ranked = seeded_rank(la, LA_RECORD, ["user_id", "week", "step"], seed, "pv_idx")
    return ranked.withColumn("pv_idx", F.col("pv_idx").cast("int")).withColumn("current_state", F.col("state"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` ⋈ ``labels``: a verdict text per document and its label.

    truth: 'black' when quality = 1; weight (stands in for win_rate) = quality − toxic.
    The text has one-tag, both-tag, no-tag and tag-before-the-marker cases.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    lab = table(spark, sf_dir, "labels")
    body = (
        F.when(F.col("lang") == "de", F.lit("Advantage: unclear"))
        .when(F.col("n_chars") % 5 == 0, F.lit("Advantage: <black> and <white>"))
        .when(F.col("n_chars") % 2 == 0, F.lit("Advantage: <black>"))
        .otherwise(F.lit("Advantage: <white>"))
    )
    prefix = F.when(F.col("n_chars") % 3 == 0, F.lit("<white> early. ")).otherwise(F.lit(""))
    return docs.join(lab, "doc_id").select(
        "doc_id",
        F.concat(prefix, body).alias("response"),
        F.when(F.col("quality") == 1, "black").otherwise("white").alias("win"),
        (F.col("quality") - F.col("toxic")).cast("double").alias("win_rate"),
    )


def logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """state = user_id, move = event_type; lp = −avg(value)/100 over all the user's events;
    moves that the user never made get lp = −inf."""
    ev = table(spark, sf_dir, "events")
    moves = ev.select(F.array_sort(F.collect_set("event_type"))).scalar()  # one value per event type
    legal = ev.select(F.col("user_id").alias("state")).distinct().select("state", F.explode(moves).alias("move"))
    seen = ev.groupBy(F.col("user_id").alias("state"), F.col("event_type").alias("move")).agg(
        F.round(-F.avg("value") / 100, 6).alias("lp")
    )
    return legal.join(seen, ["state", "move"], "left").select(
        "state", "move", F.coalesce("lp", F.lit(float("-inf"))).alias("lp")
    )
