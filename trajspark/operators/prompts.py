"""Prompt tables.

One engine for every template: a template is a row (name, system, user)
whose texts hold ``{slot}`` placeholders; game wording arrives as data.
Prompts are ``ARRAY<STRUCT<role, content>>`` plus flat ``system`` / ``user``
columns.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.functions.keys import joint_key, seeded_uniform

# The template wording used by the registered queries (our own text).
TEMPLATES = [
    ("evaluate", "You evaluate positions of a turn-based game.",
     "State: {state}\nOur turn: {turn}\nEvaluate the position for the player to move."),
    ("improve", "You improve a policy from evaluated actions.",
     "State: {state}\nEvaluated actions:\n{actions}\nChoose the best action."),
    ("td", "You aggregate look-ahead evaluations into a value.",
     "State: {state}\nVariations:\n{variations}\nGive the value of the state."),
    ("mc", "You estimate action values from sampled games.",
     "State: {state}\nAction: {action}\nGames:\n{games}"),
    ("mc_state", "You estimate state values from sampled games.",
     "State: {state}\nGames:\n{games}"),
    ("q_student", "You evaluate actions of a turn-based game.",
     "State: {state}\nAction: {action}\nEvaluate the action for the player to move."),
    ("move", "You choose a move.",
     "State: {state}\nLegal moves: {moves}\nAnswer with {\"best_move\": n}."),
    ("student", "You are a helpful assistant.", "{text}"),
    ("move_sample", "You choose a move.",
     "State: {state}\nLegal moves: {moves}\nSample: {sample}\nAnswer with {\"best_move\": n}."),
]


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "name string, system string, user string")


def fill(text: Column, slots: Mapping[str, Column]) -> Column:
    """Replace every ``{slot}`` in ``text`` by its column value (cast to string).

    The template is cut at its slots once and the parts are joined, so a value that
    itself holds a ``{slot}`` stays as it is.
    """
    if not slots:
        return text
    names = "|".join(re.escape(n) for n in slots)
    parts = F.split(text, f"(?=\\{{(?:{names})\\}})|(?<=\\{{(?:{names})\\}})", -1)

    def part(p: Column) -> Column:
        out = p
        for name, value in slots.items():
            out = F.when(p == "{" + name + "}", F.coalesce(value.cast("string"), F.lit(""))).otherwise(out)
        return out

    return F.array_join(F.transform(parts, part), "")


# P1 -------------------------------------------------------------------------
def prompt_table(df: DataFrame, templates: DataFrame, name: str, slots: Mapping[str, Column]) -> DataFrame:
    """Render one template over every row: adds ``system``, ``user`` and ``messages``.

    The template texts enter as scalar subqueries (one row each), so the
    data side is never shuffled or joined.
    """
    t = templates.where(F.col("name") == name)
    sys_t = t.select("system").scalar()
    usr_t = t.select("user").scalar()
    # the template becomes a column first: a subquery can't stand inside an array function
    out = df.withColumn("system", sys_t).withColumn("_template", usr_t)
    out = out.withColumn("user", fill(F.col("_template"), slots)).drop("_template")
    return out.withColumn(
        "messages",
        F.array(
            F.struct(F.lit("system").alias("role"), F.col("system").alias("content")),
            F.struct(F.lit("user").alias("role"), F.col("user").alias("content")),
        ),
    )


# P2 -------------------------------------------------------------------------
def mc_prompts(chunked_suffixes: DataFrame, key: Sequence[str], templates: DataFrame, template: str = "mc") -> DataFrame:
    """Monte-Carlo group prompts: the suffix games of one (s, a) chunk, numbered and joined.

    With key = state the prompt asks for the state's value (template ``mc_state``), with
    key = (state, action) for the action's. Input rows: (key…, chunk, pos, state, action, game_text). Each chunk holds at
    most n rows (D11), so the ordered collect is bounded by n.
    """
    g = chunked_suffixes.groupBy(*key, "chunk").agg(
        F.min("state").alias("first_state"),
        F.min("action").alias("first_action"),
        F.sort_array(F.collect_list(F.struct("pos", "game_text"))).alias("_g"),
    )
    lines = F.transform("_g", lambda x: F.concat(F.lit("Game "), (x["pos"] + 1).cast("string"), F.lit(": "), x["game_text"]))
    games = F.concat(F.array_join(lines, "\n"), F.lit("\nEnd of games."))
    g = g.withColumn("games", games).withColumn("n_games", F.size("_g")).drop("_g")
    return prompt_table(
        g, templates, template, {"state": F.col("first_state"), "action": F.col("first_action"), "games": F.col("games")}
    )


# P5 -------------------------------------------------------------------------
def td_prompts(look: DataFrame, record: Sequence[str], m: int, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Look-ahead aggregation prompts, and the error rows.

    Per variation (pv_idx < m): the move list, the end state and its
    evaluation (a terminal end state gets its reward text instead). Lines
    are joined in variation order per record. A record with a non-terminal
    end state that lacks an evaluation goes to the error table instead.
    """
    v = look.where(F.col("pv_idx") < m)
    fs = F.col("final_state")
    reward_sum = F.aggregate("pv_rewards", F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))
    evaluation = F.when(fs["is_terminal"], F.concat(F.lit("terminal, reward "), reward_sum.cast("string"))).otherwise(fs["eval"])
    line = F.concat(
        F.lit("Variation "), (F.col("pv_idx") + 1).cast("string"), F.lit(": moves "),
        F.array_join("pv_actions", " "), F.lit("; end "), fs["state"], F.lit("; eval "), F.coalesce(evaluation, F.lit("?")),
    )
    v = v.select(*record, "pv_idx", "current_state", line.alias("line"), evaluation.isNull().alias("_missing"))
    g = v.groupBy(*record).agg(
        F.min("current_state").alias("current_state"),
        F.sort_array(F.collect_list(F.struct("pv_idx", "line"))).alias("_l"),
        F.count_if("_missing").alias("n_missing"),
    )
    g = g.withColumn("variations", F.array_join(F.transform("_l", lambda x: x["line"]), "\n")).drop("_l")
    ok = g.where(F.col("n_missing") == 0).drop("n_missing")
    errors = g.where(F.col("n_missing") > 0).select(*record, "n_missing")
    return prompt_table(ok, templates, "td", {"state": F.col("current_state"), "variations": F.col("variations")}), errors


# P6 -------------------------------------------------------------------------
def improvement_prompts(evals: DataFrame, state: str, templates: DataFrame) -> DataFrame:
    """Per state, the evaluated actions and their texts in action order."""
    g = evals.groupBy(state).agg(F.sort_array(F.collect_list(F.struct("action", "text"))).alias("_a"))
    lines = F.array_join(F.transform("_a", lambda x: F.concat(x["action"].cast("string"), F.lit(": "), x["text"])), "\n")
    g = g.withColumn("actions", lines).withColumn("n_actions", F.size("_a")).drop("_a")
    return prompt_table(g, templates, "improve", {"state": F.col(state), "actions": F.col("actions")})


# P7 -------------------------------------------------------------------------
def candidates(states: DataFrame, legal: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every legal action per state: an equi-join on the state to the legal-move table."""
    return states.join(legal, list(keys))


# P10 ------------------------------------------------------------------------
def epsilon_split(df: DataFrame, keys: Sequence[str], legal: str, eps: float, seed: int | str = 42) -> tuple[DataFrame, DataFrame]:
    """ε-greedy: rows under ε get a seeded uniform legal action and skip the model.

    Returns (random_rows with ``action``, model_rows). ``legal`` is an array column.
    """
    u = seeded_uniform(seed, keys)
    u2 = seeded_uniform(f"{seed}|pick", keys)
    t = df.withColumn("_u", u)
    rnd = t.where(F.col("_u") < eps).withColumn(
        "action", F.element_at(F.col(legal), (F.floor(u2 * F.size(legal)) + 1).cast("int"))
    ).drop("_u")
    model = t.where(F.col("_u") >= eps).drop("_u")
    return rnd, model


def voted_candidates(
    states: DataFrame,
    keys: Sequence[str],
    legal: str,
    templates: DataFrame,
    n_samples: int,
    k: int,
    scorer: str,
    state_text: Column,
    seed: int | str = 42,
) -> DataFrame:
    """Candidate actions by sampling: replicate each state n times (D10), ask the
    scorer (P8), extract the move (P11) and keep the top-k by votes (A6)."""
    from trajspark.operators.answers import extract_pattern
    from trajspark.operators.infer import infer
    from trajspark.operators.metrics import vote
    from trajspark.operators.sampling import replicate

    rep = replicate(states, n_samples, "replica")
    ids = [*keys, "replica"]
    pr = prompt_table(
        rep, templates, "move_sample",
        {"state": state_text, "moves": F.array_join(F.col(legal).cast("array<string>"), ","), "sample": F.col("replica")},
    )
    resp = infer(pr, scorer, ids)
    ext = extract_pattern(pr.select(*ids, legal).join(resp, ids), "response", legal, ids, seed=seed)
    key = joint_key(keys)
    v = vote(ext.select(*keys, key.alias("_key"), F.col("action").alias("candidate"), F.col("replica").alias("sample_idx")),
             "_key", "candidate", k)
    first = ext.select(*keys, key.alias("_key")).distinct()
    return v.join(first, "_key").drop("_key")
