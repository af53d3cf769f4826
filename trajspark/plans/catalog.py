"""Registered queries: each operator applied to views over the driver's tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose
columns (names, flat types, 6-place rounding) match its SQL twin in
``oracle``. Arrays are rendered as joined strings and dates as strings so
both engines can be compared value by value.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.operators import board as B
from trajspark.operators import metrics as A
from trajspark.operators import steps as T
from trajspark.plans import views as V
from trajspark.sources.tables import table

EP = V.EP_KEYS
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return deco


def _wk(df: DataFrame) -> DataFrame:
    return df.withColumn("week", F.col("week").cast("string")) if "week" in df.columns else df


def _join(c, sep: str = " ") -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)


# ---------------------------------------------------------------- T family
@query("t1_transitions")
def t1(spark, sf):
    return _wk(T.to_transitions(V.ep_events(spark, sf), EP))


@query("t2_own_steps")
def t2(spark, sf):
    return _wk(T.own_steps(V.ep_events(spark, sf)).select(*EP, "step", "state", "action", "reward"))


@query("t3_suffixes")
def t3(spark, sf):
    s = T.suffixes(V.ep_events_once(spark, sf), EP)
    return _wk(
        s.select(
            *EP, "start", "suffix_len", "return_to_go",
            _join(F.col("suffix_actions")).alias("suffix_actions"),
            _join(F.col("suffix_states")).alias("suffix_states"),
        )
    )


@query("t4_drop_terminal")
def t4(spark, sf):
    return T.drop_terminal(V.states(spark, sf)).select("state", "props")


@query("t5_audit_shape")
def t5(spark, sf):
    return T.audit_shape(V.ep_events(spark, sf), EP)


@query("t6_audit_replay")
def t6(spark, sf):
    return T.audit_replay(V.ep_events_once(spark, sf), EP)


def _rules(spark, sf):
    """A rule table (state, action, next_state): every event may follow every other but an error a signup;
    an action leads to the state of its name."""
    kinds = table(spark, sf, "events").select("event_type").distinct()
    names = kinds.agg(F.array_sort(F.collect_set("event_type"))).scalar()  # one value per event type
    pairs = kinds.select(F.col("event_type").alias("state"), F.explode(names).alias("action"))
    return pairs.where(~((F.col("state") == "error") & (F.col("action") == "signup"))).withColumn("next_state", F.col("action"))


@query("t6_audit_rules")
def t6r(spark, sf):
    return T.audit_replay(V.ep_events_once(spark, sf), EP, rules=_rules(spark, sf))


TIC_TAC_TOE = B.winning_lines(3, 3, 3)


def _board_log(spark, sf):
    """Tic-tac-toe games written as a log and read back (S1) as steps.

    Every (user, week) of events is a game of cells in seeded order. By another seeded digit a
    sixteenth of the games each has a wrong reward, lacks its last move, plays an
    occupied cell, or has one actor only.
    """
    g = table(spark, sf, "events").select("user_id", F.date_trunc("week", "ts").cast("date").cast("string").alias("week")).distinct()
    drawn = lambda c: F.struct(F.md5(F.concat_ws("|", F.lit("42"), F.col("user_id").cast("string"), "week", c.cast("string"))).alias("h"), c.alias("c"))
    cells = F.transform(F.sort_array(F.transform(F.sequence(F.lit(0), F.lit(8)), drawn)), lambda x: x["c"])
    states, actions = B.replay_moves(cells, TIC_TAC_TOE, 9)
    spoil = F.substring(F.md5(F.concat_ws("|", F.lit("7"), F.col("user_id").cast("string"), "week")), 1, 1)
    g = g.select("user_id", spoil.alias("spoil"), states.alias("states"), actions.alias("actions"))
    cut = F.col("spoil") == "1"
    g = g.withColumns(
        {
            "states": F.when(cut, F.slice("states", 1, F.size("states") - 1)).otherwise(F.col("states")),
            "actions": F.when(cut, F.slice("actions", 1, F.size("actions") - 1)).otherwise(F.col("actions")),
        }
    )
    n = F.size("actions")
    final = F.when(F.col("spoil") == "0", 5).otherwise(B.outcome_reward(B.status(F.element_at("states", -1)["board"], TIC_TAC_TOE)))
    reward = F.transform("actions", lambda x, i: F.when(i == n - 1, final).otherwise(0))
    turn = F.transform("actions", lambda x, i: (F.col("spoil") == "3") | ((i % 2 == 0) == (F.col("user_id") % 2 == 0)))
    played = F.transform("actions", lambda x, i: F.when((F.col("spoil") == "2") & (i == n - 1), F.get("actions", F.lit(0))).otherwise(x))
    shown = F.array_join(F.transform("states", lambda x: F.concat(F.lit("["), F.to_json(x["board"]), F.lit(', "'), x["mark"], F.lit('"]'))), ", ")
    line = F.concat(
        F.lit('{"state": ['), shown, F.lit('], "action": '), F.to_json(played), F.lit(', "reward": '), F.to_json(reward), F.lit(', "turn": '), F.to_json(turn), F.lit("}")
    )
    path = _scratch(spark, "t6-log")
    g.select(line.alias("value")).write.text(path)
    return S.read_buffer(spark, path, "tictactoe")[0]


@query("t6_board_audit")
def t6b(spark, sf):
    return B.audit_board(_board_log(spark, sf), ["episode_id"], TIC_TAC_TOE)


@query("t6_board_outcomes")
def t6o(spark, sf):
    return B.board_outcomes(_board_log(spark, sf), ["episode_id"], TIC_TAC_TOE)


@query("t7_sa_keys")
def t7(spark, sf):
    own = T.with_sa_key(T.own_steps(V.ep_events(spark, sf)))
    return own.groupBy("sa_key").agg(F.count(F.lit(1)).alias("n"))


@query("t8_own_view")
def t8(spark, sf):
    return _wk(T.own_view(V.ep_events_once(spark, sf), EP))


@query("t8_own_view_credit_final")
def t8c(spark, sf):
    return _wk(T.own_view(V.ep_events_once(spark, sf), EP, credit_final=True))


@query("t9_trajectories")
def t9(spark, sf):
    tr = T.to_trajectories(V.ep_events(spark, sf), EP)
    return _wk(
        tr.select(
            *EP,
            F.size("state").alias("n_states"),
            _join(F.col("state")).alias("states"),
            _join(F.col("action")).alias("actions"),
            _join(F.col("reward")).alias("rewards"),
            _join(F.col("turn")).alias("turns"),
        )
    )


@query("t9_order_trajectories")
def t9o(spark, sf):
    tr = T.to_trajectories(V.ep_orders(spark, sf), V.ORDER_KEYS)
    return tr.select(
        "l_orderkey",
        F.size("state").alias("n_states"),
        _join(F.col("state")).alias("states"),
        F.round(F.aggregate("reward", F.lit(0.0), lambda a, x: a + x), 6).alias("total_reward"),
    )


@query("t10_look_ahead")
def t10(spark, sf):
    la = T.look_ahead(V.ep_events(spark, sf), EP, k=4)
    return _wk(
        la.select(
            *EP, "step", "state",
            _join(F.col("pv_actions")).alias("pv_actions"),
            _join(F.col("pv_rewards")).alias("pv_rewards"),
            F.col("final_state.state").alias("final_state"),
            F.col("final_state.turn").alias("final_turn"),
            F.col("final_state.is_terminal").alias("final_terminal"),
        )
    )


def _chat_reward():
    return F.when(F.col("role") == "assistant", 1.0).when(F.col("role") == "system", -0.5).otherwise(0.0)


@query("t11_token_rows")
def t11(spark, sf):
    c = V.chats(spark, sf)
    return T.token_rows(c, ["conv_id", "turn"], is_action=F.col("role") == "assistant", reward=_chat_reward())


@query("t12_keep_last")
def t12(spark, sf):
    return T.keep_last(V.chats(spark, sf), ["conv_id"], "turn", 3).select("conv_id", "turn", "role")


# ---------------------------------------------------------------- A family
@query("a1_win_rate")
def a1(spark, sf):
    return A.win_rate_of(V.ep_event_facts(spark, sf))


@query("a2_episode_outcomes")
def a2(spark, sf):
    return A.outcomes_of(V.ep_event_facts(spark, sf))


@query("a3_outcomes_by_iteration")
def a3(spark, sf):
    return A.outcomes_of(V.ep_event_facts(spark, sf), ["iter"])


@query("a4_key_counts")
def a4(spark, sf):
    own = T.own_steps(V.ep_events(spark, sf))
    return A.key_counts(own, ["state", "action"])


@query("a4_key_counts_approx")
def a4a(spark, sf):
    """The HyperLogLog++ form; so few keys that the estimate is exact."""
    own = T.own_steps(V.ep_events(spark, sf))
    return A.key_counts(own, ["state", "action"], approx=True)


@query("a4_window_sketches")
def a4w(spark, sf):
    """Unique (state, action) pairs of every window of three iterations, from one stored sketch per iteration."""
    own = T.own_steps(V.ep_events(spark, sf))
    stored = write_table(A.key_sketches(own, "iter", ["state", "action"]), "sketches")
    return A.window_key_counts(stored, "iter", 3)


def _ep_summary_input(spark, sf):
    f = V.ep_event_facts(spark, sf)
    return f.select(
        "first_state",
        F.col("ep_return").alias("reward"),
        F.when(F.col("final_reward") != 0, 1.0).otherwise(0.0).alias("done"),
        F.col("n_actions").alias("length"),
    )


@query("a5_interaction_summary")
def a5(spark, sf):
    return A.interaction_summary(_ep_summary_input(spark, sf), "first_state", ["reward", "done", "length"])


@query("a5_order_summary")
def a5o(spark, sf):
    f = A.episode_facts(V.ep_orders(spark, sf), V.ORDER_KEYS)
    e = f.select("first_state", F.col("ep_return").alias("reward"), F.col("n_actions").alias("length"))
    return A.interaction_summary(e, "first_state", ["reward", "length"])


@query("a6_vote")
def a6(spark, sf):
    return A.vote(V.votes(spark, sf), "state", "candidate", k=2)


@query("a7_masked_stats")
def a7(spark, sf):
    emb = table(spark, sf, "embeddings")
    return A.masked_stats(emb, ["vec_id"], "embedding", F.transform("embedding", lambda x, i: (i + F.col("label")) % 3 != 0))


@query("a7_unpadded_stats")
def a7u(spark, sf):
    """The array up to its first padding position, then unmasked statistics."""
    emb = table(spark, sf, "embeddings")
    cut = A.unpad(F.col("embedding"), F.transform("embedding", lambda x, i: i < 8 + F.col("label")))
    emb = emb.withColumn("kept", cut)
    return A.masked_stats(emb, ["vec_id"], "kept", F.transform("kept", lambda x: F.lit(True)))


@query("a8_outcome_counts")
def a8(spark, sf):
    f = V.ep_event_facts(spark, sf)
    return A.outcome_counts(f, "iter")


@query("a10_token_cost")
def a10(spark, sf):
    return A.token_cost(V.chats(spark, sf), "conv_id", "turn", is_output=F.col("role") == "assistant")


@query("a11_normalise")
def a11(spark, sf):
    pl = write_table(V.policy_log(spark, sf), "policy-log")  # read by the statistics and by the rows
    n = A.normalise(pl, "adv", "adv_norm")
    return _wk(n.select(*EP, "step", F.round("adv_norm", 6).alias("adv_norm")))


@query("a12_update_diagnostics")
def a12(spark, sf):
    pl = V.policy_log(spark, sf).withColumn("ret", F.col("reward").cast("double"))
    return A.update_diagnostics(pl, "iter")


@query("a13_best_so_far")
def a13(spark, sf):
    f = V.ep_event_facts(spark, sf)
    return A.best_so_far(f, "iter", "ep_return")


@query("a14_score_board")
def a14(spark, sf):
    f = V.ep_event_facts(spark, sf)
    scores = f.select(
        F.col("iter").alias("run"),
        F.lit("endgames").alias("benchmark"),
        F.when(F.col("first_turn"), F.col("final_reward")).otherwise(-F.col("final_reward")).cast("double").alias("score"),
    )
    return A.score_board(scores, A.bounds_table(spark), "run")


# ---------------------------------------------------------------- D family
from trajspark.functions.keys import sa_key, seeded_order  # noqa: E402
from trajspark.operators import sampling as D  # noqa: E402

SKEYS = ["state", "props"]


@query("d1_distinct_states")
def d1(spark, sf):
    return D.distinct_states(V.raw_states(spark, sf), SKEYS)


@query("d1_distinct_counts")
def d1c(spark, sf):
    return D.distinct_counts(V.raw_states(spark, sf), SKEYS)


@query("d3_not_done")
def d3(spark, sf):
    ws = V.week_states(spark, sf)
    done = ws.where(F.col("iter") == 1)
    return D.not_done(V.states(spark, sf), done, SKEYS)


@query("d4_sample_n")
def d4(spark, sf):
    return D.sample_n(V.states(spark, sf), SKEYS, 100, seed=42).select(*SKEYS)


@query("d5_sample_ratio")
def d5(spark, sf):
    return D.sample_ratio(V.raw_states(spark, sf), ["event_id"], 0.025, seed=42).select("event_id", *SKEYS)


def _holdout(spark, sf):
    return D.holdout(T.drop_terminal(V.states(spark, sf)), SKEYS, 50, seed=7)


@query("d6_holdout_test")
def d6t(spark, sf):
    return _holdout(spark, sf)[1].select(*SKEYS)


@query("d6_holdout_train")
def d6r(spark, sf):
    return _holdout(spark, sf)[0].select(*SKEYS)


@query("d6_leakage")
def d6l(spark, sf):
    train, test = _holdout(spark, sf)
    return D.leakage_report(train, test, SKEYS)


@query("d7_grow_frontier")
def d7(spark, sf):
    """The frontier of week 1 grown by all later weeks."""
    ws = V.week_states(spark, sf)
    return D.grow_frontier(ws.where(F.col("iter") == 1), ws.where(F.col("iter") > 1), SKEYS)


@query("d8_shuffle")
def d8(spark, sf):
    return D.shuffle(V.states(spark, sf), SKEYS, seed=42)


@query("d9_index")
def d9(spark, sf):
    idx, _ = D.with_index(V.states(spark, sf), seeded_order(42, SKEYS))
    return idx.select(*SKEYS, "idx")


@query("d10_replicate")
def d10(spark, sf):
    return D.replicate(V.states(spark, sf).select(*SKEYS), 3)


def _chunk_input(spark, sf):
    own = T.own_steps(V.ep_events(spark, sf))
    return own.select(*EP, "step", sa_key("state", "action").alias("sa_key"))


@query("d11_chunks")
def d11(spark, sf):
    return _wk(D.chunk(_chunk_input(spark, sf), ["sa_key"], [*EP, "step"], 5, seed=42))


@query("d11_chunks_salted")
def d11s(spark, sf):
    return _wk(D.chunk(_chunk_input(spark, sf), ["sa_key"], [*EP, "step"], 5, seed=42, salt_digits=1))


@query("d12_batches")
def d12(spark, sf):
    return D.batches(V.batch_rows(spark, sf), ["user_id"], 4)


@query("d13_epoch_plan")
def d13(spark, sf):
    return D.epoch_plan(V.batch_rows(spark, sf), ["user_id"], workers=2, size=4, seed=42)


# ---------------------------------------------------------------- V family
from trajspark.operators import value as VE  # noqa: E402


def _own_with_values(spark, sf):
    ep = T.with_last(V.ep_events_once(spark, sf), EP, "value", "final_value")
    own = T.own_view(ep, EP, extra=["value", "final_value"])
    return VE.next_values(own, EP, "step", "value", "final_value")


@query("v1_gae")
def v1(spark, sf):
    g = VE.gae(_own_with_values(spark, sf), EP)
    # γ·v with v at 6 places lands exactly on half-way values; a 1e-9 nudge
    # resolves those ties the same way in both engines.
    return _wk(g.select(*EP, "step", F.round(F.col("adv") + 1e-9, 6).alias("adv"), F.round(F.col("ret") + 1e-9, 6).alias("ret")))


@query("v2_next_values")
def v2(spark, sf):
    return _wk(_own_with_values(spark, sf).select(*EP, "step", "value", "next_value"))


def _transitions(spark, sf):
    t = T.to_transitions(V.ep_events(spark, sf), EP, more=["is_terminal"])
    return t.select("state", "next_state", F.col("next_is_terminal").alias("next_terminal"), "reward")


@query("v3_td0")
def v3(spark, sf):
    v = VE.td0(_transitions(spark, sf), alpha=0.4, sweeps=2)
    return v.select("state", F.round("value", 6).alias("value"), "visits")


@query("v3_td0_delta")
def v3d(spark, sf):
    """Values of (event type, props) states of each user's events, by sweeps over what moved."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", F.concat_ws(" ", "event_type", "props").alias("state"))
    w = T.number_steps(e.withColumn("next", F.struct("state", "event_type")), ["user_id"], ["ts", "event_id"], "next", F.date_trunc("hour", "ts"), ahead=1)
    t = w.where(F.col("_next1").isNotNull()).select(
        "state",
        F.col("_next1.state").alias("next_state"),
        (F.col("_next1.event_type") == "error").alias("next_terminal"),
        F.when(F.col("_next1.event_type") == "purchase", 1).when(F.col("_next1.event_type") == "error", -1).otherwise(0).alias("reward"),
    )
    v, _ = VE.td0_delta(t, alpha=0.4, max_sweeps=3)
    return v.select("state", F.round("value", 6).alias("value"), "visits")


def _graph(spark, sf):
    e = V.graph_edges(spark, sf).withColumn("action", F.col("dst"))
    goals = spark.range(1).select(F.lit("s1").alias("node"))
    return e, goals


@query("v4_shortest_path")
def v4(spark, sf):
    e, goals = _graph(spark, sf)
    return VE.shortest_policy(e, goals)


@query("v5_degrade_policy")
def v5(spark, sf):
    e, goals = _graph(spark, sf)
    pol = VE.shortest_policy(e, goals)
    return VE.degrade_policy(pol, e.select(F.col("src").alias("node"), "action"), p=0.5, seed=42)


def _layers(spark, sf):
    ep = V.ep_events_once(spark, sf)
    nodes = ep.groupBy(F.col("step").alias("layer"), F.col("state").alias("node")).agg(
        F.max("is_terminal").alias("_ends")
    ).select(
        "layer",
        "node",
        ((F.col("layer") % 2) == 0).alias("maximize"),
        F.when(
            F.col("_ends"),
            (F.when(F.col("node") == "purchase", 1).when(F.col("node") == "error", -1).otherwise(0) * (100 - F.col("layer"))).cast("double"),
        ).alias("end_value"),
    )
    edges = ep.where(F.col("action").isNotNull()).select(
        F.col("step").alias("layer"), F.col("state").alias("node"), F.col("action").alias("next_node")
    ).distinct()
    return nodes, edges


def _at(layer, node):
    """A node of the layered graph as one text."""
    return F.concat_ws(":", layer.cast("string"), node)


def _layer_values(nodes, edges):
    flat = nodes.select(_at(F.col("layer"), F.col("node")).alias("node"), "maximize", "end_value")
    links = edges.select(_at(F.col("layer"), F.col("node")).alias("node"), _at(F.col("layer") + 1, F.col("next_node")).alias("next_node"))
    return VE.backward_induction(flat, links)


@query("v6_backward_induction")
def v6(spark, sf):
    vals = _layer_values(*_layers(spark, sf))
    return vals.select(F.expr("substr(node, 1, instr(node, ':') - 1)").cast("int").alias("layer"), F.expr("substr(node, instr(node, ':') + 1)").alias("node"), "maximize", "value")


def _greedy(spark, sf):
    nodes, edges = _layers(spark, sf)
    vals = _layer_values(nodes, edges)
    to = vals.select(F.col("node").alias("to"), "value")
    ch = edges.select(_at(F.col("layer"), F.col("node")).alias("node"), F.col("next_node").alias("action"), _at(F.col("layer") + 1, F.col("next_node")).alias("to"))
    ch = ch.join(to, "to").join(vals.select("node", "maximize"), "node")
    return VE.greedy_actions(ch.select("node", "maximize", "action", "value"), seed=42)


@query("v7_greedy_actions")
def v7(spark, sf):
    return _greedy(spark, sf).select("node", "action", "value", "is_pick")


@query("v8_move_accuracy")
def v8(spark, sf):
    opt = _greedy(spark, sf)
    pred = T.own_steps(V.ep_events(spark, sf)).select(
        F.concat_ws(":", F.col("step").cast("string"), "state").alias("node"), "action"
    )
    return VE.move_accuracy(pred, opt, ["node"])


@query("v8_misses")
def v8m(spark, sf):
    """Steps whose move is parsed but not among the optimal ones."""
    pred = T.own_steps(V.ep_events(spark, sf)).select(
        *EP, F.concat_ws(":", F.col("step").cast("string"), "state").alias("node"), "action"
    )
    return _wk(VE.misses(pred, _greedy(spark, sf), ["node"]))


# ---------------------------------------------------------------- P family
from trajspark.operators import answers as P  # noqa: E402
from trajspark.operators import infer as I  # noqa: E402
from trajspark.operators import prompts as PR  # noqa: E402

LA_KEYS = [*V.LA_RECORD, "pv_idx"]


@query("p1_prompt_table")
def p1(spark, sf):
    st = V.states(spark, sf)
    out = PR.prompt_table(st, PR.template_table(spark), "evaluate", {"state": F.concat_ws(" ", "state", "props"), "turn": F.lit("true")})
    return out.select("state", "props", "system", "user", F.size("messages").alias("n_messages"))


def _game_text():
    return F.concat(
        F.lit("actions: "), F.array_join("suffix_actions", " "), F.lit("; return: "), F.col("return_to_go").cast("string")
    )


@query("p2_mc_prompts")
def p2(spark, sf):
    ep = V.ep_events_once(spark, sf)
    s = T.suffix_starts(ep, EP).select(*EP, "start", "state", "action", sa_key("state", "action").alias("sa_key"))
    ch = T.with_suffixes(D.chunk(s, ["sa_key"], [*EP, "start"], 5, seed=42), ep, EP).withColumn("game_text", _game_text())
    out = PR.mc_prompts(ch, ["sa_key"], PR.template_table(spark))
    return out.select("sa_key", "chunk", F.col("first_state").alias("state"), F.col("first_action").alias("action"), "n_games", "user")


@query("p2_mc_state_prompts")
def p2v(spark, sf):
    """The state-value form: the games of a state, whatever the action."""
    ep = V.ep_events_once(spark, sf)
    ch = D.chunk(T.suffix_starts(ep, EP), ["state"], [*EP, "start"], 5, seed=42)
    ch = T.with_suffixes(ch, ep, EP).withColumn("game_text", _game_text())
    out = PR.mc_prompts(ch, ["state"], PR.template_table(spark), "mc_state")
    return out.select("state", "chunk", "n_games", "user")


@query("p3_visit_prompts")
def p3(spark, sf):
    tr = T.to_transitions(V.ep_events(spark, sf), EP).select("state", "turn").distinct()
    out = PR.prompt_table(tr, PR.template_table(spark), "evaluate", {"state": F.col("state"), "turn": F.col("turn")})
    return out.select("state", "turn", "user")


def _end_state_prompts(spark, sf, m=2, la=None):
    la = (la if la is not None else V.lookahead_ev(spark, sf)).where((F.col("pv_idx") < m) & ~F.col("final_state.is_terminal"))
    out = PR.prompt_table(
        la, PR.template_table(spark), "evaluate",
        {"state": F.col("final_state.state"), "turn": F.col("final_state.turn")},
    )
    return out


@query("p4_end_state_prompts")
def p4(spark, sf):
    return _end_state_prompts(spark, sf).select(*LA_KEYS, "system", "user")


def _responses(spark, sf, la=None):
    return I.infer(_end_state_prompts(spark, sf, la=la), "len_value", LA_KEYS)


@query("p8_infer")
def p8(spark, sf):
    return _responses(spark, sf)


def _attached(spark, sf):
    la = write_table(V.lookahead_ev(spark, sf), "look-ahead")  # read by the prompts and by the attachment
    return I.attach_eval(la, _responses(spark, sf, la), LA_KEYS)


@query("p9_attach")
def p9(spark, sf):
    a = _attached(spark, sf)
    return a.select(
        *LA_KEYS,
        F.col("final_state.state").alias("final_state"),
        F.col("final_state.eval").alias("final_eval"),
        F.col("final_state.is_terminal").alias("final_terminal"),
    )


@query("p5_td_prompts")
def p5(spark, sf):
    ok, _ = PR.td_prompts(_attached(spark, sf), V.LA_RECORD, 2, PR.template_table(spark))
    return ok.select(*V.LA_RECORD, "user")


@query("p5_td_errors")
def p5e(spark, sf):
    _, err = PR.td_prompts(_attached(spark, sf), V.LA_RECORD, 3, PR.template_table(spark))
    return err


@query("p6_improvement_prompts")
def p6(spark, sf):
    ev = V.votes(spark, sf).groupBy("state", F.col("candidate").alias("action")).agg(
        F.concat(F.lit("n="), F.count(F.lit(1)).cast("string")).alias("text")
    )
    out = PR.improvement_prompts(ev, "state", PR.template_table(spark))
    return out.select("state", "n_actions", "user")


def _legal(spark, sf):
    return T.to_transitions(V.ep_events(spark, sf), EP).select("state", "action").distinct()


@query("p7_candidates")
def p7(spark, sf):
    return PR.candidates(V.states(spark, sf).select("state", "props"), _legal(spark, sf), ["state"])


def _legal_moves(spark, sf):
    """Legal move numbers of each state; an action's number is the length of its name."""
    return _legal(spark, sf).groupBy("state").agg(F.sort_array(F.collect_set(F.length("action"))).alias("legal"))


def _eps_split(spark, sf):
    st = V.states(spark, sf).select("state", "props").join(_legal_moves(spark, sf), "state")
    return PR.epsilon_split(st, SKEYS, "legal", eps=0.3, seed=42)


def _model_moves(spark, sf):
    _, model = _eps_split(spark, sf)
    pr = PR.prompt_table(
        model, PR.template_table(spark), "move", {"state": F.concat_ws(" ", "state", "props"), "moves": F.array_join(F.col("legal").cast("array<string>"), ",")}
    )
    resp = I.infer(pr, "best_move", SKEYS)
    j = pr.select(*SKEYS, "legal").join(resp, SKEYS)
    return P.extract_pattern(j, "response", "legal", SKEYS, seed=42)


@query("p7_candidates_voted")
def p7v(spark, sf):
    st = V.states(spark, sf).select("state", "props").join(_legal_moves(spark, sf), "state")
    out = PR.voted_candidates(
        st, SKEYS, "legal", PR.template_table(spark), n_samples=3, k=2, scorer="best_move",
        state_text=F.concat_ws(" ", "state", "props"), seed=42,
    )
    return out.select(*SKEYS, "candidate", "n_votes", "first_seen", "rank")


@query("p10_epsilon_split")
def p10(spark, sf):
    rnd, _ = _eps_split(spark, sf)
    r = rnd.select(*SKEYS, "action", F.lit("random").alias("source"), F.lit("skipped").alias("status"))
    m = _model_moves(spark, sf).select(*SKEYS, "action", F.lit("model").alias("source"), "status")
    return r.unionByName(m)


@query("p11_extract_pattern")
def p11p(spark, sf):
    return _model_moves(spark, sf).select(*SKEYS, "response", "action", "status")


@query("p11_extract_json")
def p11j(spark, sf):
    """JSON answers with well-formed, malformed and field-less replies; a default where the field is missing."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    reply = (
        F.when(F.col("n_chars") % 4 == 0, F.concat(F.lit('{"thoughts": "'), F.col("lang"), F.lit('", "action": "move '), (F.col("n_chars") % 9).cast("string"), F.lit('"}')))
        .when(F.col("n_chars") % 4 == 1, F.lit('{"thoughts": "none"}'))
        .when(F.col("n_chars") % 4 == 2, F.lit('{"action": '))
        .otherwise(F.lit("move up"))
    )
    out = P.extract_json(d.withColumn("response", reply), "response", "thoughts string, action string", "action", F.lit(""))
    return out.select("doc_id", "answer", "status")


@query("p11_extract_verdict")
def p11v(spark, sf):
    return P.extract_verdict(V.verdicts(spark, sf), "response").select("doc_id", "predict", "status")


@query("p11_yield_report")
def p11y(spark, sf):
    return P.yield_report(P.extract_verdict(V.verdicts(spark, sf), "response"), "verdict")


@query("p12_verdict_accuracy")
def p12(spark, sf):
    v = V.verdicts(spark, sf)
    pred = P.extract_verdict(v, "response").select("doc_id", "predict")
    return P.verdict_accuracy(pred, v.select("doc_id", "win", "win_rate"), ["doc_id"])


@query("p12_label_file")
def p12f(spark, sf):
    """Win-rate labels written as a log, an older one of each state included, read back with the last one winning."""
    v = V.verdicts(spark, sf).withColumn("key", F.col("doc_id").cast("string"))
    old = v.select("key", F.lit("none").alias("win"), F.lit(9.0).alias("win_rate"), F.lit(0).alias("label_seq"))
    new = v.select("key", "win", "win_rate", F.lit(1).alias("label_seq"))
    path = _scratch(spark, "p12")
    S.write_labels(new.unionByName(old).withColumn("turn", F.lit(0)), path)
    labels, _ = S.read_labels(spark, path)
    pred = P.extract_verdict(v, "response").select("key", "predict")
    return P.verdict_accuracy(pred, labels, ["key"])


@query("p13_move_distribution")
def p13(spark, sf):
    return P.move_distribution(V.logprobs(spark, sf), "state", "move", "lp", temperature=1.0, seed=42)


@query("p13_extract_logprobs")
def p13x(spark, sf):
    """Token log-probs by position, nested as a model server returns them (one output per user and week)."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.date_trunc("week", "ts").alias("week"), "event_type", "value")
    k = F.col("event_id")
    candidate = lambda token, lp: F.struct(token.alias("token"), lp.cast("double").alias("logprob"))
    lp = F.when(k % 13 == 0, float("-inf")).when(k % 11 == 0, float("nan")).when(k % 17 == 5, None).otherwise(F.round(-F.col("value") / 100, 6))
    named = candidate((F.length("event_type") % 9 + 1).cast("string"), lp)
    again = candidate((k % 9 + 1).cast("string"), F.round(-F.col("value") / 50, 6))
    closing = candidate(F.get(F.array(*[F.lit(t) for t in (*P.HEADER_TOKENS, "other")]), (k % 5).cast("int")), F.lit(-1.0))
    position = F.when(k % 19 != 0, F.when(k % 7 == 0, F.array(named, again, closing)).otherwise(F.array(named, closing)))
    out = e.withColumn("p", position).groupBy("user_id", "week").agg(F.collect_list(F.struct("p")).alias("ps"))
    out = out.select(
        F.col("user_id").alias("state"),
        F.transform("ps", lambda x: x["p"]).alias("positions"),
        F.filter(F.sequence(F.lit(1), F.lit(9)), lambda m: (F.col("user_id") + m) % 4 != 0).alias("legal"),
    )
    got = P.extract_move_logprobs(out, ["state"], "positions", "legal", {str(m): m for m in range(1, 10)})
    return got.select("state", "move", F.round("lp", 6).alias("lp"), "n_positions", "is_uniform")


# ---------------------------------------------------------------- X family
from trajspark.operators import examples as X  # noqa: E402


@query("x1_sft_pairs")
def x1(spark, sf):
    """Every question with its own answer: the assistant message right after a user message."""
    ask, answer = X.exchanges(V.chats(spark, sf), ["conv_id"], "turn")
    student = PR.prompt_table(ask, PR.template_table(spark), "student", {"text": F.col("text")})
    out = X.sft_pairs(student, answer, ["conv_id", "turn"])
    return out.select("conv_id", "turn", F.size("messages").alias("n_messages"), "system", "user", "assistant")


def _variant(spark, sf, template, slots):
    """SFT pairs whose student sees a short prompt and whose target is the teacher's evaluation text."""
    ev = V.votes(spark, sf).groupBy("state", F.col("candidate").alias("action")).agg(F.count(F.lit(1)).alias("n"))
    rows = ev.groupBy("state").agg(F.max_by("action", F.struct("n", "action")).alias("action"), F.sum("n").alias("n"))
    student = PR.prompt_table(rows.select("state", "action"), PR.template_table(spark), template, slots)
    teacher = rows.select("state", F.concat(F.lit("best "), "action", F.lit(" of "), F.col("n").cast("string")).alias("content"))
    out = X.sft_pairs(student, teacher, ["state"])
    return out.select("state", F.size("messages").alias("n_messages"), "system", "user", "assistant")


@query("x1_sft_value")
def x1v(spark, sf):
    return _variant(spark, sf, "evaluate", {"state": F.col("state"), "turn": F.lit("true")})


@query("x1_sft_action_value")
def x1q(spark, sf):
    return _variant(spark, sf, "q_student", {"state": F.col("state"), "action": F.col("action")})


@query("x1_sft_policy")
def x1p(spark, sf):
    return _variant(spark, sf, "move", {"state": F.col("state"), "moves": F.col("action")})


def _rendered(spark, sf):
    return X.render_chat(V.chats(spark, sf), ["conv_id"], ["turn"])


@query("x2_render_chat")
def x2(spark, sf):
    return _rendered(spark, sf)


def _masked(spark, sf):
    return X.label_masks(_rendered(spark, sf), X.MAX_TOKENS)


@query("x3_label_masks")
def x3(spark, sf):
    m = _masked(spark, sf)
    return m.select(
        "conv_id", "n_tokens", "n_prompt", "n_label", "kept",
        F.when(F.col("kept"), F.element_at("labels", F.col("n_prompt") + 1)).alias("first_label"),
    )


@query("x3_dropped")
def x3d(spark, sf):
    m = _masked(spark, sf)
    return m.agg(F.count_if(~F.col("kept")).alias("n_dropped"), F.count(F.lit(1)).alias("n_rows"))


def _subword_vocabulary(spark) -> str:
    """The byte-level vocabulary with the chat template's marks as special tokens."""
    import public_tokenizers
    from trajspark.functions.text import register_subwords

    marks = [m for text in X.LLAMA3.values() for m in re.findall(r"<\|[^|]*\|>", text)]
    register_subwords(spark, "byte-bpe", public_tokenizers.path("byte_bpe_50k.json"), sorted(set(marks)))
    return "byte-bpe"


@query("x3_subword_masks")
def x3s(spark, sf):
    """Ids and labels of every rendered conversation; digests of both."""
    m = X.label_id_masks(_rendered(spark, sf), X.MAX_TOKENS, _subword_vocabulary(spark))
    digest = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ","))
    return m.select("conv_id", "n_tokens", "n_prompt", "n_label", "kept", digest("input_ids").alias("ids_md5"), digest("labels").alias("labels_md5"))


@query("t11_subword_rows")
def t11s(spark, sf):
    c = V.chats(spark, sf).select("conv_id", "turn", "role", "text")
    name = _subword_vocabulary(spark)
    rows = T.token_rows(c, ["conv_id", "turn", "role"], is_action=F.col("role") == "assistant", reward=F.col("turn") * 1.0, vocabulary=name)
    return rows.withColumnRenamed("token", "token_id")


@query("x4_pad_batches")
def x4(spark, sf):
    m = _masked(spark, sf).where("kept").select("conv_id", F.col("input_tokens").alias("tok"))
    b = X.epoch_batches(m, ["conv_id"], 4, seed=42)
    p = X.pad_batches(b, "tok", "batch")
    return p.select(
        "conv_id", "batch", "length", "padded_len", "n_pad",
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_attention"),
        F.size("tok_padded").alias("n_padded"),
    )


def _ppo(spark, sf):
    ep = V.ep_events_once(spark, sf).withColumn("lp", -F.col("value") + F.lit(0.1) * ((F.col("step") % 3) - 1))
    return X.ppo_samples(ep, EP)


@query("x5_ppo_samples")
def x5(spark, sf):
    s = _ppo(spark, sf)
    return _wk(
        s.select(
            *EP, "step", "state", "action",
            F.round(F.col("adv_norm") + 1e-9, 6).alias("adv_norm"),
            F.round(F.col("ret") + 1e-9, 6).alias("ret"),
            F.round("old_lp", 6).alias("old_lp"),
        )
    )


@query("x5_not_null_audit")
def x5a(spark, sf):
    return X.not_null_audit(_ppo(spark, sf))


# ---------------------------------------------------------------- S family
from pyspark.sql import types as TY  # noqa: E402

from trajspark.session import new_folder, write_table  # noqa: E402
from trajspark.sources import io as S  # noqa: E402


def _scratch(spark, tag: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local temp dir)."""
    return new_folder(spark, tag)


@query("s1_read_buffer")
def s1(spark, sf):
    """Round trip: week episodes → trajectory JSONL (S2) → explicit-schema read (S1) → steps."""
    tr = T.to_trajectories(V.ep_events(spark, sf), EP).withColumn("week", F.col("week").cast("string"))
    path = _scratch(spark, "s1")
    S.write_buffer(tr, path)
    extra = [TY.StructField("user_id", TY.LongType()), TY.StructField("week", TY.StringType())]
    steps, _ = S.read_buffer(spark, path, "generic", extra)
    return steps.select(*EP, "step", "state", "action", "reward", "turn", "is_terminal")


@query("s1_rejects")
def s1r(spark, sf):
    """Malformed lines go to the reject table: documents texts are not trajectories."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("{\"state\": "), F.col("text")).alias("value"))
    path = _scratch(spark, "s1r")
    docs.write.mode("overwrite").text(path)
    _, rejects = S.read_buffer(spark, path, "generic")
    return rejects.agg(F.count(F.lit(1)).alias("n_rejects"))


@query("s4_read_runs")
def s4(spark, sf):
    """Each iteration's trajectories as its own run folder (one partitioned write), read back as one table."""
    tr = T.to_trajectories(V.ep_events(spark, sf), [*EP, "iter"]).withColumn("week", F.col("week").cast("string"))
    root = _scratch(spark, "s4")
    S.write_buffer(tr.withColumn("run", F.concat(F.lit("iter-"), F.col("iter").cast("string"))).drop("iter"), root,
                   partition_by=["run"])
    extra = [TY.StructField("user_id", TY.LongType()), TY.StructField("week", TY.StringType())]
    steps, _ = S.read_runs(spark, f"{root}/run=*", "generic", extra)
    return steps.select(
        F.regexp_replace("run", "^run=", "").alias("run"), *EP, "step", "state", "action", "reward", "turn", "is_terminal"
    )


@query("s5_read_states")
def s5(spark, sf):
    """A trajectory buffer and a state buffer of the same states give one distinct, non-terminal state table."""
    tr = T.to_trajectories(V.ep_events(spark, sf), EP).withColumn("week", F.col("week").cast("string"))
    tpath, spath = _scratch(spark, "s5-traj"), _scratch(spark, "s5-states")
    S.write_buffer(tr, tpath)
    from_traj, _ = S.read_states(spark, tpath, "trajectory", traj_kind="generic")
    S.write_buffer(from_traj.select(F.col("state").alias("serializad_state")), spath)
    from_states, _ = S.read_states(spark, spath, "states")
    both = from_traj.withColumn("src", F.lit("trajectory")).unionByName(from_states.withColumn("src", F.lit("states")))
    return both.select("src", "state")


@query("s1_two_player_win_rate")
def s1b(spark, sf):
    """A1 on the two-player log format: written with 2-vector rewards and player numbers, read back, aggregated."""
    ep = V.ep_events(spark, sf)
    acted = F.col("action").isNotNull()
    both = F.array(F.col("reward").cast("double"), -F.col("reward").cast("double"))
    rec = ep.select(
        *EP, "step", "state", F.when(acted, F.col("action")).alias("a"), F.when(acted, both).alias("r"),
        F.when(acted, F.when(F.col("turn"), 0).otherwise(1)).alias("t"), F.when(F.col("is_terminal"), S.TERMINAL_SENTINEL).otherwise(F.col("state")).alias("z"),
    )
    g = rec.groupBy(*EP).agg(F.sort_array(F.collect_list(F.struct("step", "state", "a", "r", "t", "z"))).alias("_s"))
    moves = F.filter("_s", lambda x: x["a"].isNotNull())
    log = g.select(
        F.transform("_s", lambda x: x["state"]).alias("state"), F.transform(moves, lambda x: x["a"]).alias("action"),
        F.transform(moves, lambda x: x["r"]).alias("reward"), F.transform(moves, lambda x: x["t"]).alias("turn"),
        F.transform("_s", lambda x: x["z"]).alias("serializad_state"),
    )
    path = _scratch(spark, "s1b")
    S.write_buffer(log, path)
    steps, _ = S.read_buffer(spark, path, "breakthrough")
    return A.win_rate(steps, ["episode_id"])


@query("s3_read_keyed")
def s3r(spark, sf):
    """Keyed records written as one object a line, read with their order, merged with the last winning; bad lines counted."""
    kv = V.keyed(spark, sf).groupBy("key").agg(F.max_by("value", "seq").alias("value"))
    lines = kv.select(F.to_json(F.map_from_arrays(F.array(F.col("key").cast("string")), F.array("value"))).alias("value"))
    bad = table(spark, sf, "documents").select(F.concat(F.lit("no object "), F.col("doc_id").cast("string")).alias("value"))
    path = _scratch(spark, "s3r")
    lines.unionByName(bad).write.mode("overwrite").text(path)
    rows, rejects = S.read_keyed(spark, path)
    merged = S.merge_keyed(rows, "key", "value", ["file", "block", "pos"])
    return merged.withColumn("n_rejects", rejects.agg(F.count(F.lit(1))).scalar())


@query("p9_write_back")
def p9w(spark, sf):
    """Look-ahead records written, read, evaluated at their end states, written back in place and read again."""
    la = V.lookahead_ev(spark, sf)
    end = F.col("final_state")
    logged = la.select(
        F.concat_ws(":", F.col("user_id").cast("string"), "state").alias("record_id"), "user_id", "pv_idx", "current_state",
        F.col("state").alias("current_serialised_state"),
        F.struct(
            F.array("state").alias("state"), F.col("pv_actions").alias("action"),
            F.transform("pv_rewards", lambda r: F.array(r.cast("double"), -r.cast("double"))).alias("reward"),
            F.transform("pv_actions", lambda a, i: (i % 2).cast("int")).alias("turn"), F.array("state").alias("serializad_state"),
            F.struct(
                F.when(end["is_terminal"], S.TERMINAL_SENTINEL).otherwise(end["state"]).alias("state"),
                F.when(end["is_terminal"], S.TERMINAL_EVAL).alias("eval"),
                F.when(end["turn"], 0).when(~end["turn"], 1).alias("turn"),
            ).alias("final_state"),
        ).alias("pv"),
    ).withColumn("final_state", F.col("pv.final_state"))
    first, second = _scratch(spark, "p9-log"), _scratch(spark, "p9-updated")
    S.write_lookahead(logged, first, ["user_id"])
    extra = [TY.StructField("user_id", TY.LongType())]
    rows, _ = S.read_lookahead(spark, first, extra)
    keys = ["record_id", "pv_idx"]
    asked = rows.where((F.col("pv_idx") < 2) & ~F.col("final_state.is_terminal"))
    prompts = PR.prompt_table(asked, PR.template_table(spark), "evaluate", {"state": F.col("final_state.state"), "turn": F.col("final_state.turn")})
    answered = I.attach_response(prompts.select(*keys, "messages"), I.infer(prompts, "len_value", keys), keys)
    replies = answered.select(*keys, F.element_at("messages", -1)["content"].alias("response"))
    S.write_lookahead(I.attach_eval(rows, replies, keys), second, ["user_id"])
    back, _ = S.read_lookahead(spark, second, extra)
    return back.select(
        "user_id", F.col("current_state").alias("state"), "pv_idx", F.array_join("pv.action", " ").alias("pv_actions"),
        F.col("final_state.state").alias("final_state"), F.col("final_state.eval").alias("final_eval"),
    )


@query("s10_manifest")
def s10(spark, sf):
    """An output written with its one-row manifest: parameters, seed and row counts."""
    steps = V.ep_events(spark, sf)
    out = _scratch(spark, "s10")
    written = write_table(steps.where(F.col("action").isNotNull()), "s10-out")
    counts = written.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(*EP).alias("episodes")).first()
    S.write_manifest(spark, out, {"seed": 42, "view": "ep_events", "filter": "action is not null"},
                     {"rows": counts["rows"], "episodes": counts["episodes"]})
    return spark.read.json(f"{out}/_manifest").select("params", "n_rows", "n_episodes")


@query("s3_merge_keyed")
def s3(spark, sf):
    return S.merge_keyed(V.keyed(spark, sf), "key", "value", ["seq"])


@query("s6_history_window")
def s6(spark, sf):
    w = S.history_window(V.ep_events(spark, sf), iteration=4, history=3, keys=[*EP, "step"])
    return _wk(w.select(*EP, "step", "iter", "state"))


@query("s7_contiguous_iterations")
def s7(spark, sf):
    c = S.contiguous_iterations(V.ep_events(spark, sf))
    return c.groupBy("iter").agg(F.count(F.lit(1)).alias("n_steps"))


@query("s8_export_requests")
def s8(spark, sf):
    """Request lines written with their raw data, and read back field by field."""
    st = V.states(spark, sf)
    pr = PR.prompt_table(st, PR.template_table(spark), "evaluate", {"state": F.concat_ws(" ", "state", "props"), "turn": F.lit("true")})
    req = S.export_requests(
        pr.withColumn("raw", F.concat_ws(" ", "state", "props")), SKEYS, "model-under-test", {"temperature": 1.0, "top_p": 1.0, "max_tokens": 512}, raw="raw"
    )
    path = _scratch(spark, "s8")
    S.write_requests(req, path)
    schema = (
        "custom_id string, method string, url string, raw_data string, body struct<model: string, "
        "messages: array<struct<role: string, content: string>>, temperature: double, top_p: double, max_tokens: int>"
    )
    got = spark.read.text(path).select(F.from_json("value", schema).alias("r"))
    return got.select(
        "r.custom_id", "r.method", "r.url", "r.raw_data", "r.body.model", "r.body.temperature", "r.body.max_tokens",
        F.array_join(F.transform("r.body.messages", lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n").alias("messages"),
    )


@query("s9_value_table")
def s9(spark, sf):
    v = VE.td0(_transitions(spark, sf), alpha=0.4, sweeps=2)
    path = _scratch(spark, "s9")
    S.save_values(v, path, {"type": "td", "sweeps": 2, "alpha": 0.4})
    loaded, _ = S.load_values(spark, path)
    return loaded


# ---------------------------------------------------------------- M family
from trajspark.streaming import incremental as M  # noqa: E402

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string, is_flush boolean"


def _feed(spark, sf, run, split: str = "id", parts: int = 4, flush: bool = False) -> str:
    """Feed the whole ``events`` table to a stream in ``parts`` folders.

    The folders are staged by one write with the table's own parallelism;
    ``run(glob)`` then processes one more folder each time (``availableNow`` on
    a fixed checkpoint), so every query resumes from its checkpoint between
    folders. ``split="id"`` deals rows by ``event_id`` (null ids to folder 0);
    ``split="time"`` cuts ``ts`` into equal spans so folders arrive in event-time
    order (no step is late; rows without a time come first). ``flush`` adds a last
    folder with a row two days after the last event that only moves the watermark
    (``is_flush``). Returns the glob of all folders.
    """
    root = _scratch(spark, "stream-src")
    ev = table(spark, sf, "events")
    if split == "time":
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        lo, hi = ev.select(F.min(us), F.max(us)).first()
        k = F.floor((us - F.lit(lo or 0)) * parts / F.lit((hi or 0) - (lo or 0) + 1))
    else:
        k = F.pmod(F.col("event_id"), F.lit(parts))
    staged = ev.withColumns({"is_flush": F.lit(False), "part": F.coalesce(k, F.lit(0)).cast("int")})
    if flush:
        late = {"ts": F.expr("ts + INTERVAL 2 DAYS"), "is_flush": F.lit(True), "part": F.lit(parts)}
        last = ev.select(F.max("ts").alias("ts")).select(*[late.get(c, F.lit(None).cast(ev.schema[c].dataType) if c in ev.columns else None).alias(c) for c in staged.columns])
        staged = staged.unionByName(last)
    staged.write.mode("overwrite").partitionBy("part").parquet(root)
    for i in range(parts + flush):
        run(f"{root}/part=[0-{i}]")
    return f"{root}/part=*"


def _stream(spark, glob):
    return M.event_stream(spark, glob, EVENT_SCHEMA).select(
        "event_id", "ts", "user_id", F.col("event_type").alias("state"), "props", "value", "is_flush"
    )


def _until_done(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


@query("m1_new_states")
def m1(spark, sf):
    table_path, ckpt = _scratch(spark, "m1-table"), _scratch(spark, "m1-ckpt")
    _feed(spark, sf, lambda root: _until_done(M.ingest_new_states(_stream(spark, root), table_path, ["state", "props"], ckpt, buckets=8)))
    return spark.read.parquet(table_path).select("state", "props")


@query("m1_new_states_watermark")
def m1w(spark, sf):
    table_path, ckpt = _scratch(spark, "m1w-table"), _scratch(spark, "m1w-ckpt")
    _feed(
        spark, sf,
        lambda root: _until_done(
            M.ingest_new_states(_stream(spark, root), table_path, ["state", "props"], ckpt, watermark=("ts", "1 day"))
        ),
        split="time",
    )
    # the watermark lets go of states not seen for a day, so one that comes back is written again
    return spark.read.parquet(table_path).select("state", "props").distinct()


@query("m1_new_states_state")
def m1s(spark, sf):
    table_path, ckpt = _scratch(spark, "m1s-table"), _scratch(spark, "m1s-ckpt")
    _feed(
        spark, sf,
        lambda root: _until_done(
            M.ingest_new_states(_stream(spark, root), table_path, ["state", "props"], ckpt, mode="state")
        ),
    )
    return spark.read.parquet(table_path).select("state", "props")


def _append_to_parquet(df, path: str, ckpt: str) -> None:
    _until_done(
        df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", ckpt)
        .trigger(availableNow=True).start()
    )


@query("m2_live_metrics")
def m2(spark, sf):
    """Update mode with a watermark: closed windows leave the state; each batch
    rewrites the windows it changed, so the table holds one row per group."""
    path, ckpt = _scratch(spark, "m2-out"), _scratch(spark, "m2-ckpt")

    def run(root):
        agg = M.live_metrics(_stream(spark, root), ["state"], "ts", "1 day", "value", watermark="1 hour")
        _until_done(M.write_updates(agg, path, ["window", "state"], ckpt, part=F.date_format("window.start", "yyyyMMdd")))

    _feed(spark, sf, run, split="time")
    out = M.read_latest(spark, path)
    return out.select(
        F.col("window.start").cast("string").alias("window_start"), "state", "n",
        F.round("mean_value", 6).alias("mean_value"), "min_value", "max_value",
    )


# Watermark delay of the M3 streams.
M3_DELAY = "1 hour"


@query("m3_assemble_episodes")
def m3(spark, sf):
    """Session episodes in append mode: a session is written once the watermark passes its end; the last ones are flushed."""
    path, ckpt = _scratch(spark, "m3-out"), _scratch(spark, "m3-ckpt")

    def run(root):
        s = _stream(spark, root).withWatermark("ts", M3_DELAY)
        _append_to_parquet(M.assemble_episodes(s, ["user_id", "is_flush"], "ts", "2 hours", ["event_id", "state"]), path, ckpt)

    _feed(spark, sf, run, split="time", flush=True)
    out = spark.read.parquet(path).where(~F.col("is_flush"))
    return out.select(
        "user_id",
        F.col("session.start").cast("string").alias("session_start"),
        F.col("session.end").cast("string").alias("session_end"),
        "n_steps",
        F.array_join(F.transform("steps", lambda s: s["state"]), " ").alias("states"),
    )


@query("m3_terminal_episodes")
def m3t(spark, sf):
    """Episodes closed at the terminal step (purchase or error) or after 2 hours without a step."""
    path, ckpt = _scratch(spark, "m3t-out"), _scratch(spark, "m3t-ckpt")

    def run(root):
        s = _stream(spark, root).withWatermark("ts", M3_DELAY)
        ep = M.assemble_until_terminal(s, ["user_id", "is_flush"], "ts", "event_id", "state", F.col("state").isin("purchase", "error"), 7200)
        with M.rocksdb_state(spark):
            _append_to_parquet(ep, path, ckpt)

    _feed(spark, sf, run, split="time", flush=True)
    out = spark.read.parquet(path).where(~F.col("is_flush"))
    return out.select(
        "user_id",
        F.col("episode_start").cast("string").alias("episode_start"),
        F.col("episode_end").cast("string").alias("episode_end"),
        "n_steps", "states", "closed_by",
    )


@query("m4_resume")
def m4(spark, sf):
    sink, ckpt = _scratch(spark, "m4-sink"), _scratch(spark, "m4-ckpt")
    runs: list[int] = []
    root = _feed(spark, sf, lambda r: runs.append(M.run_incremental(_stream(spark, r), sink, ckpt)), parts=2)
    runs.append(M.run_incremental(_stream(spark, root), sink, ckpt))  # nothing new: reprocesses nothing
    out = spark.read.parquet(sink).select("event_id", "state")
    return out.withColumn("runs_with_new_rows", F.lit(sum(int(r > 0) for r in runs)))


# ---------------------------------------------------------------- A9, D2
def _bench_results(spark, sf):
    """Benchmark games per (parameter combo, repeat): week episodes dealt to the 32
    combos by a seeded hash; repeat = iteration − 1 (0 is the search run)."""
    f = V.ep_event_facts(spark, sf)
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("42"), F.col("user_id").cast("string"), F.col("week").cast("string"))), 1, 8), 16, 10)
    f = f.withColumn("combo", (h.cast("bigint") % 32).cast("int")).withColumn("repeat", F.col("iter") - 1)
    return f.groupBy("combo", "repeat").agg(
        F.count_if(F.col("final_reward") == -1).alias("losses"), F.count(F.lit(1)).alias("games")
    )


@query("a9_leaderboard")
def a9(spark, sf):
    return A.leaderboard(A.param_grid(spark), _bench_results(spark, sf))


@query("d2_distinct_variations")
def d2(spark, sf):
    la = V.lookahead_ev(spark, sf)
    var = F.struct(F.array_join("pv_actions", " ").alias("moves"), F.col("final_state.state").alias("end"))
    g = la.groupBy(*V.LA_RECORD).agg(F.sort_array(F.collect_list(F.struct("pv_idx", var.alias("v")))).alias("_v"))
    # the first variation is repeated on purpose
    arr = F.transform("_v", lambda x: x["v"])
    g = g.withColumn("variations", F.concat(arr, F.slice(arr, 1, 1)))
    d = D.distinct_variations(g, "variations")
    return d.select(*V.LA_RECORD, (F.size("_v") + 1).alias("n_variations"), F.size("variations").alias("n_distinct"))
