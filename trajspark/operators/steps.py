"""Trajectory reshaping on the long ``steps`` table.

All per-episode work is a window or an aggregate partitioned by the episode
key, so one shuffle on that key serves every later window on the same key
(Spark reuses the clustering), and windows spill instead of holding a whole
episode in Python memory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.keys import bucket_of, sa_key
from trajspark.functions.text import token_ids

WS = "[ \t\n\r\f]+"  # whitespace token separator, the same class in Java and RE2


def _w(ep: Sequence[str], order: str = "step", desc: bool = False):
    o = F.col(order).desc() if desc else F.col(order)
    return Window.partitionBy(*ep).orderBy(o)


def _same(left: DataFrame, right: DataFrame, cols: Sequence[str], name) -> Column:
    """Null-safe equality of key columns (an equi-join for Spark)."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right[name(c)])
    return cond


def _with_next_state(cur: DataFrame, steps: DataFrame, ep: Sequence[str], order: str, more: Sequence[str] = ()) -> DataFrame:
    """``next_state`` (and ``next_…`` of more columns) by a join on (episode…, step + 1); both
    sides hash on the step as well, so a long episode spreads over many tasks. Null keys are
    keys like any other."""
    nxt = steps.select(
        *[F.col(k).alias(f"_n_{k}") for k in ep], (F.col(order) - 1).alias("_n_o"), F.col("state").alias("next_state"),
        *[F.col(c).alias(f"next_{c}") for c in more],
    )
    cond = _same(cur, nxt, ep, lambda c: f"_n_{c}") & (cur[order] == nxt["_n_o"])
    return cur.join(nxt, cond, "left").drop(*[f"_n_{k}" for k in ep], "_n_o")


# T1 -------------------------------------------------------------------------
def to_transitions(steps: DataFrame, ep: Sequence[str], order: str = "step", more: Sequence[str] = ()) -> DataFrame:
    """(s, a, r, s', turn, step) for every step that has an action, and ``next_…`` of more columns.

    ``order`` is the dense 0-based step number.
    """
    cur = steps.where(F.col("action").isNotNull())
    t = _with_next_state(cur, steps, ep, order, more)
    return t.select(*ep, order, "state", "action", "reward", "next_state", "turn", *[f"next_{c}" for c in more])


def with_last(steps: DataFrame, ep: Sequence[str], col: str, name: str, order: str = "step") -> DataFrame:
    """The value of ``col`` at an episode's last step, on every step: a partial aggregate joined back."""
    last = steps.groupBy(*ep).agg(F.max_by(col, order).alias(name))
    last = last.select(*[F.col(k).alias(f"_f_{k}") for k in ep], name)
    return steps.join(last, _same(steps, last, ep, lambda c: f"_f_{c}")).drop(*[f"_f_{k}" for k in ep])


# T2 -------------------------------------------------------------------------
def own_steps(steps: DataFrame, turn: str = "turn") -> DataFrame:
    """One actor's steps (``turn`` true); the terminal state has no action and is dropped."""
    return steps.where(F.col(turn) & F.col("action").isNotNull())


# T3 -------------------------------------------------------------------------
def suffix_starts(steps: DataFrame, ep: Sequence[str], order: str = "step", own_only: bool = True) -> DataFrame:
    """Where suffixes start: (episode…, start, state, action, turn), one narrow row each.

    Sample, group and chunk these; ``with_suffixes`` cuts the suffixes only when they are rendered.
    """
    out = steps.where(F.col("action").isNotNull())
    if own_only:
        out = out.where(F.col("turn"))
    return out.select(*ep, F.col(order).alias("start"), "state", "action", "turn")


def with_suffixes(starts: DataFrame, steps: DataFrame, ep: Sequence[str], order: str = "step") -> DataFrame:
    """Adds suffix_actions, suffix_states, suffix_len and return_to_go to rows with a ``start``.

    Every episode's arrays are gathered once (as long as the episode, like T9's) and
    joined; a row's suffix is a slice of them. ``order`` is the dense 0-based step number.
    """
    g = steps.groupBy(*ep).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "state", "action", "reward"))).alias("_s"))
    g = g.select(*[F.col(k).alias(f"_g_{k}") for k in ep], "_s")
    t = starts.join(g, _same(starts, g, ep, lambda c: f"_g_{c}")).drop(*[f"_g_{k}" for k in ep])
    t = t.withColumn("_s", F.slice("_s", F.col("start") + 1, F.size("_s")))
    rewards = F.filter(F.transform("_s", lambda x: x["reward"]), lambda r: r.isNotNull())
    kind = steps.schema["reward"].dataType.simpleString()
    total = "bigint" if kind in ("int", "bigint", "smallint", "tinyint") else "double"
    return t.select(
        *starts.columns,
        F.size(F.filter("_s", lambda x: x["action"].isNotNull())).cast("bigint").alias("suffix_len"),
        F.when(F.size(rewards) > 0, F.aggregate(rewards, F.lit(0).cast(total), lambda a, r: a + r.cast(total))).alias("return_to_go"),
        F.filter(F.transform("_s", lambda x: x["action"]), lambda a: a.isNotNull()).alias("suffix_actions"),
        F.transform("_s", lambda x: x["state"]).alias("suffix_states"),
    )


def suffixes(steps: DataFrame, ep: Sequence[str], order: str = "step", own_only: bool = True) -> DataFrame:
    """Suffix of every trajectory from each (own) step to the end."""
    return with_suffixes(suffix_starts(steps, ep, order, own_only), steps, ep, order)


# T4 -------------------------------------------------------------------------
def drop_terminal(df: DataFrame, col: str = "is_terminal") -> DataFrame:
    return df.where(~F.col(col))


# T5 -------------------------------------------------------------------------
SHAPE_RULES = ("states_eq_actions_plus_1", "turns_eq_actions", "last_state_terminal", "steps_contiguous")


def episode_shape(steps: DataFrame, ep: Sequence[str], order: str = "step") -> DataFrame:
    """Per-episode shape facts (one partial aggregate, no sort)."""
    return steps.groupBy(*ep).agg(
        F.count(F.lit(1)).alias("n_states"),
        F.count("action").alias("n_actions"),
        F.count(F.when(F.col("action").isNotNull(), F.col("turn"))).alias("n_turns"),
        F.max_by("is_terminal", order).alias("last_terminal"),
        F.min(order).alias("min_step"),
        F.max(order).alias("max_step"),
    )


def audit_shape(steps: DataFrame, ep: Sequence[str], order: str = "step") -> DataFrame:
    """Violation counts per shape rule: a table, not an abort."""
    s = episode_shape(steps, ep, order)
    checks = {
        "states_eq_actions_plus_1": F.col("n_states") != F.col("n_actions") + 1,
        "turns_eq_actions": F.col("n_turns") != F.col("n_actions"),
        "last_state_terminal": ~F.coalesce(F.col("last_terminal"), F.lit(False)),
        "steps_contiguous": (F.col("min_step") != 0) | (F.col("max_step") != F.col("n_states") - 1),
    }
    agg = s.agg(
        F.count(F.lit(1)).alias("n_episodes"),
        *[F.count_if(c).alias(name) for name, c in checks.items()],
    )
    stack = ", ".join(f"'{n}', {n}" for n in checks)
    return agg.selectExpr("n_episodes", f"stack({len(checks)}, {stack}) AS (rule, n_violations)").select(
        "rule", "n_episodes", "n_violations"
    )


# T6 -------------------------------------------------------------------------
def audit_replay(
    steps: DataFrame, ep: Sequence[str], order: str = "step", legal: DataFrame | None = None, rules: DataFrame | None = None
) -> DataFrame:
    """Replay audit of logged transitions, counted per rule.

    * ``alternation``: the actor flag changes at every step;
    * ``next_state``: s' = apply(s, a). ``rules`` is the game's table (state, action,
      next_state); without it the action names the next state (event episodes);
    * ``terminal_flag``: the terminal flag is set exactly on the last state;
    * ``legal`` (with ``legal`` or ``rules``): the action is one that the table has for the state.

    ``order`` is the dense 0-based step number; neighbours come from joins on
    (episode…, step ± 1), so a long episode spreads over tasks. A rule table may be of any size.
    """
    t = _with_next_state(steps, steps, ep, order).withColumnRenamed("next_state", "_next_state")
    before = steps.select(*[F.col(k).alias(f"_b_{k}") for k in ep], (F.col(order) + 1).alias("_b_o"), F.col("turn").alias("_prev_turn"))
    t = t.join(before, _same(t, before, ep, lambda c: f"_b_{c}") & (t[order] == before["_b_o"]), "left")
    acted = F.col("action").isNotNull()
    wanted = F.col("action")
    if rules is not None:
        r = rules.select(F.col("state").alias("_r_s"), F.col("action").alias("_r_a"), F.col("next_state").alias("_r_n")).distinct()
        t = t.join(r, (t["state"] == r["_r_s"]) & (t["action"] == r["_r_a"]), "left")
        wanted = F.col("_r_n")
    checks = [
        ("alternation", F.col("_prev_turn").isNotNull() & F.col("turn").isNotNull(), F.col("_prev_turn") == F.col("turn")),
        ("next_state", acted, ~wanted.eqNullSafe(F.col("_next_state"))),
        ("terminal_flag", F.lit(True), F.col("is_terminal") != F.col("_next_state").isNull()),
    ]
    if legal is not None:
        ok = legal.select(F.col("state").alias("_l_s"), F.col("action").alias("_l_a")).distinct().withColumn("_legal", F.lit(True))
        t = t.join(ok, (t["state"] == ok["_l_s"]) & (t["action"] == ok["_l_a"]), "left")
        checks.append(("legal", acted, F.col("_legal").isNull()))
    elif rules is not None:
        checks.append(("legal", acted, F.col("_r_n").isNull()))
    # every rule's counts in one aggregate (one pass over the steps), then one row per rule
    aggs = []
    for i, (_, cond, bad) in enumerate(checks):
        aggs += [F.count_if(cond).alias(f"_c{i}"), F.count_if(cond & bad).alias(f"_v{i}")]
    rows = ", ".join(f"'{name}', _c{i}, _v{i}" for i, (name, _, _) in enumerate(checks))
    return t.agg(*aggs).selectExpr(f"stack({len(checks)}, {rows}) AS (rule, n_checked, n_violations)")


# T7 -------------------------------------------------------------------------
def with_sa_key(df: DataFrame, state: str = "state", action: str = "action", buckets: int | None = None) -> DataFrame:
    out = df.withColumn("sa_key", sa_key(state, action))
    if buckets:
        out = out.withColumn("sa_bucket", bucket_of(F.col("sa_key"), buckets))
    return out


# T8 -------------------------------------------------------------------------
def own_view(
    steps: DataFrame, ep: Sequence[str], order: str = "step", credit_final: bool = False, extra: Sequence[str] = ()
) -> DataFrame:
    """One player's view: own steps, own-sign reward, ``done`` flag.

    Our side is fixed by the actor of step 0; rewards are negated when that
    actor is not us. ``done`` is set on a non-zero reward or on the last
    action of the game. Episodes without own steps vanish. With
    ``credit_final`` a final reward earned on the opponent's move is added to
    our last step (the default keeps the logged behaviour, which drops it).

    ``order`` is the dense 0-based step number. The per-episode facts are a
    partial aggregate joined back on the episode (AQE splits a hot key of that
    join), and s' comes from a join on (episode…, step + 1); no window over a
    whole episode.
    """
    has_action = F.col("action").isNotNull()
    facts = steps.groupBy(*ep).agg(
        F.min_by("turn", order).alias("_first_turn"),
        F.max(F.when(has_action, F.col(order))).alias("_last_action_step"),
        F.max_by("reward", F.when(has_action, F.col(order))).alias("_final_raw"),
        F.max(F.when(has_action & F.col("turn"), F.col(order))).alias("_last_own"),
    )
    facts = facts.select(*[F.col(k).alias(f"_f_{k}") for k in ep], *[c for c in facts.columns if c not in ep])
    cur = steps.select(*ep, order, "state", "action", "reward", "turn", *extra).where(has_action & F.col("turn"))
    cur = _with_next_state(cur, steps, ep, order)
    t = cur.join(facts, _same(cur, facts, ep, lambda c: f"_f_{c}"))
    sign = F.when(F.col("_first_turn"), 1).otherwise(-1)
    t = t.withColumn("_own_reward", F.col("reward") * sign)
    done = F.col(order) == F.col("_last_action_step")
    if credit_final:
        bonus = F.when(
            (F.col(order) == F.col("_last_own")) & (F.col("_last_own") != F.col("_last_action_step")),
            F.col("_final_raw") * sign,
        ).otherwise(0)
        t = t.withColumn("_own_reward", F.col("_own_reward") + bonus)
        done = done | (F.col(order) == F.col("_last_own"))
    done = (F.abs(F.col("_own_reward")) > 0) | done
    return t.select(
        *ep, order, "state", "action", "next_state", F.col("_own_reward").alias("reward"), done.alias("done"), *extra
    )


# T9 -------------------------------------------------------------------------
def to_trajectories(steps: DataFrame, ep: Sequence[str], order: str = "step") -> DataFrame:
    """Steps → trajectory arrays (inverse of T1): state[n+1], action[n], reward[n], turn[n].

    Arrays exist only at the read/write edge; one array per episode is
    bounded by the episode length, which ``audit_shape`` reports.
    """
    g = steps.groupBy(*ep).agg(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "state", "action", "reward", "turn"))).alias(
            "_s"
        )
    )
    acted = F.filter("_s", lambda x: x["action"].isNotNull())
    return g.select(
        *ep,
        F.transform("_s", lambda x: x["state"]).alias("state"),
        F.transform(acted, lambda x: x["action"]).alias("action"),
        F.transform(acted, lambda x: x["reward"]).alias("reward"),
        F.transform(acted, lambda x: x["turn"]).alias("turn"),
    )


# T10 ------------------------------------------------------------------------
#: steps of an episode that one task looks ahead over
LOOK_SPAN = 1024


def look_ahead(steps: DataFrame, ep: Sequence[str], k: int, order: str = "step", span: int = LOOK_SPAN) -> DataFrame:
    """k-step look-ahead over logged games.

    Per state with an action: the next k actions and rewards and a
    ``final_state``: the state k steps ahead with its turn (eval null), or the
    terminal state (turn null) when the game ends inside the window.

    ``order`` is the dense 0-based step number. Halo exchange: an episode is cut in spans
    of ``span`` steps, hashed on the span as well, and each span also receives the first k
    rows of the span behind it; all look-aheads are then windows inside a span. So a row
    travels once, but for k in ``span``, and a long episode spreads over tasks.
    """
    span = max(span, k)
    home = F.floor(F.col(order) / span)
    halo = (F.col(order) % span < k) & (home > 0)
    t = steps.select(
        *ep, order, "state", "action", "reward", "turn", "is_terminal", home.alias("_home"), F.explode(F.when(halo, F.array(home, home - 1)).otherwise(F.array(home))).alias("_span")
    )
    w = Window.partitionBy(*ep, "_span").orderBy(order)
    ahead = w.rowsBetween(0, k - 1)
    t = t.select(
        *ep, order, "state", "action", "_home", "_span",
        F.collect_list("action").over(ahead).alias("pv_actions"),
        F.collect_list("reward").over(ahead).alias("pv_rewards"),
        F.lead("state", k).over(w).alias("_as"),
        F.lead("is_terminal", k).over(w).alias("_at"),
        F.lead("turn", k).over(w).alias("_au"),
        F.lead(F.lit(True), k).over(w).alias("_ak"),
        F.last("state").over(w.rowsBetween(0, k)).alias("_last"),  # the furthest row seen: the episode's last one when it ends early
    )
    t = t.where((F.col("_home") == F.col("_span")) & F.col("action").isNotNull())
    ended = F.col("_ak").isNull() | F.col("_as").isNull() | F.col("_at")
    return t.select(
        *ep,
        order,
        "state",
        "pv_actions",
        "pv_rewards",
        F.struct(
            F.coalesce(F.col("_as"), F.col("_last")).alias("state"),
            F.lit(None).cast("string").alias("eval"),
            F.when(ended, F.lit(None).cast("boolean")).otherwise(F.col("_au")).alias("turn"),
            ended.alias("is_terminal"),
        ).alias("final_state"),
    )


# T11 ------------------------------------------------------------------------
def token_rows(
    texts: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    is_action: Column | None = None,
    reward: Column | None = None,
    vocabulary: str | None = None,
) -> DataFrame:
    """Text items → token rows: ``is_action`` repeated, the item's reward on its last token.

    Whitespace tokens by default; ``vocabulary`` names a subword vocabulary
    (``functions.text.register_subwords``), whose ids are then the tokens.
    """
    is_action = is_action if is_action is not None else F.lit(False)
    reward = reward if reward is not None else F.lit(0.0)
    toks = token_ids(F.col(text), vocabulary) if vocabulary else F.filter(F.split(F.col(text), WS), lambda x: x != "")
    t = texts.select(*keys, toks.alias("_t"), is_action.alias("is_action"), reward.cast("double").alias("_r"))
    # outer: else Spark puts a filter on the array's size below, which encodes every text a second time
    t = t.select(*keys, "is_action", "_r", F.size("_t").alias("_n"), F.posexplode_outer("_t").alias("tok_idx", "token"))
    return t.where(F.col("tok_idx").isNotNull()).select(
        *keys,
        "tok_idx",
        "token",
        "is_action",
        F.when(F.col("tok_idx") == F.col("_n") - 1, F.col("_r")).otherwise(F.lit(0.0)).alias("reward"),
    )


# T12 ------------------------------------------------------------------------
def keep_last(df: DataFrame, ep: Sequence[str], order: str, k: int) -> DataFrame:
    """History truncation: keep the last k items of every history."""
    w = Window.partitionBy(*ep).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


# Step numbering --------------------------------------------------------------
def number_steps(
    df: DataFrame, ep: Sequence[str], order: Sequence[str], carry: str, span: Column, ahead: int = 2, name: str = "step"
) -> DataFrame:
    """0-based step (column ``name``) per episode and the next ``ahead`` values of ``carry``
    (``_next1`` … ``_next{ahead}``).

    ``span`` cuts an episode into pieces that follow one another in ``order`` (such as
    the minute of a time). Rows are numbered inside each (episode, span), and a small
    table with one row per (episode, span) supplies the offsets (counts of the earlier
    spans) and the first values of the following spans, which fill the look-ahead at
    a span's end. So a task holds a span, however long the episode is. The result equals
    ``row_number()`` / ``lead()`` over the episode; null keys are keys like any other.
    """
    r = df.withColumn("_slice", span)
    w = Window.partitionBy(*ep, "_slice").orderBy(*order)
    loc = r.select(
        "*",
        F.row_number().over(w).alias("_rn"),
        *[F.lead(carry, i).over(w).alias(f"_n{i}") for i in range(1, ahead + 1)],
    )
    # one row per (episode, span): count and the first `ahead` values (in a struct, as a list drops nulls)
    heads = loc.groupBy(*ep, "_slice").agg(
        F.count(F.lit(1)).alias("_cnt"),
        F.sort_array(F.collect_list(F.when(F.col("_rn") <= ahead, F.struct("_rn", F.col(carry).alias("v"))))).alias("_h"),
    )
    ws = Window.partitionBy(*ep).orderBy("_slice")
    heads = heads.select(
        *[F.col(c).alias(f"_o_{c}") for c in [*ep, "_slice"]], "_cnt",
        F.coalesce(F.sum("_cnt").over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        # every span holds at least one row, so `ahead` following spans hold `ahead` values
        F.slice(
            F.flatten(F.collect_list(F.transform("_h", lambda x: x["v"])).over(ws.rowsBetween(1, ahead))), 1, ahead
        ).alias("_after"),
    )
    j = loc.join(heads, _same(loc, heads, [*ep, "_slice"], lambda c: f"_o_{c}"))
    out = j.withColumn(name, (F.col("_off") + F.col("_rn") - 1).cast("int"))
    # the i-th value ahead: local lead while the span has it, else from the following spans
    n_local = F.least(F.col("_cnt") - F.col("_rn"), F.lit(ahead))
    for i in range(1, ahead + 1):
        out = out.withColumn(
            f"_next{i}",
            F.when(F.lit(i) <= n_local, F.col(f"_n{i}")).otherwise(
                F.try_element_at("_after", F.greatest(F.lit(i) - n_local, F.lit(1)).cast("int"))
            ),
        )
    return out.drop("_slice", "_rn", "_off", "_after", "_cnt", *[f"_n{i}" for i in range(1, ahead + 1)], *[f"_o_{c}" for c in [*ep, "_slice"]])
