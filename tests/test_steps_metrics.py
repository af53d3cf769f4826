"""Trajectory reshaping and metrics on hand-made rows (FIXTURES §2)."""

from pyspark.sql import functions as F

from trajspark.operators import metrics as A
from trajspark.operators import steps as T

SCHEMA = "ep string, step int, state string, action string, reward int, turn boolean, is_terminal boolean"


def steps_df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def episode(ep, states, actions, rewards, turns):
    rows = []
    for i, s in enumerate(states):
        last = i == len(states) - 1
        rows.append((ep, i, s, None if last else actions[i], None if last else rewards[i], turns[i] if not last else None, last))
    return rows


def test_transitions_and_trajectory_roundtrip(spark):
    df = steps_df(spark, episode("e1", ["s0", "s1", "s2"], ["a", "b"], [0, 1], [True, False]))
    tr = T.to_transitions(df, ["ep"]).orderBy("step").collect()
    assert [(r.state, r.action, r.next_state) for r in tr] == [("s0", "a", "s1"), ("s1", "b", "s2")]
    traj = T.to_trajectories(df, ["ep"]).first()
    assert traj.state == ["s0", "s1", "s2"] and traj.action == ["a", "b"] and traj.reward == [0, 1]
    assert traj.turn == [True, False]


def test_shape_audit_counts_violations(spark):
    good = episode("e1", ["s0", "s1"], ["a"], [1], [True])
    bad = [("e2", 0, "x", "a", 0, True, False), ("e2", 2, "y", None, None, None, False)]  # gap + no terminal
    res = {r.rule: r.n_violations for r in T.audit_shape(steps_df(spark, good + bad), ["ep"]).collect()}
    assert res["steps_contiguous"] == 1 and res["last_state_terminal"] == 1


def test_own_view_loss_on_opponent_move(spark):
    # we act at steps 0 and 2; the opponent's last move (step 3) loses the game for us
    df = steps_df(spark, episode("e", ["s0", "s1", "s2", "s3", "s4"], ["a", "b", "c", "d"], [0, 0, 0, 1], [True, False, True, False]))
    plain = T.own_view(df, ["ep"]).orderBy("step").collect()
    assert [(r.step, r.reward, r.done) for r in plain] == [(0, 0, False), (2, 0, False)]
    credit = T.own_view(df, ["ep"], credit_final=True).orderBy("step").collect()
    assert [(r.step, r.reward, r.done) for r in credit] == [(0, 0, False), (2, 1, True)]


def test_suffixes_and_look_ahead(spark):
    df = steps_df(spark, episode("e", ["s0", "s1", "s2", "s3"], ["a", "b", "c"], [0, 0, 1], [True, False, True]))
    sfx = {r.start: (r.suffix_actions, r.return_to_go) for r in T.suffixes(df, ["ep"]).collect()}
    assert sfx == {0: (["a", "b", "c"], 1), 2: (["c"], 1)}
    la = {r.step: r for r in T.look_ahead(df, ["ep"], k=2).collect()}
    assert la[0].pv_actions == ["a", "b"] and la[0].final_state.state == "s2" and la[0].final_state.turn is True
    assert la[2].final_state.state == "s3" and la[2].final_state.turn is None and la[2].final_state.is_terminal


def test_win_rate_zero_sum_is_black(spark):
    rows = episode("e1", ["s", "x"], ["a"], [1], [True]) + episode("e2", ["s", "y"], ["a"], [-1], [True])
    r = A.win_rate(steps_df(spark, rows), ["ep"]).first()
    assert r.win == "black" and r.win_rate == 0.0 and r.n_games == 2


def test_outcomes_sign_flip_and_empty(spark):
    rows = episode("e1", ["s", "x"], ["a"], [1], [True]) + episode("e2", ["s", "y"], ["a"], [1], [False])
    r = A.episode_outcomes(steps_df(spark, rows), ["ep"]).first()
    assert (r.avg_win, r.avg_lose, r.avg_return, r.num_episode) == (0.5, 0.5, 0.0, 2)
    empty = A.episode_outcomes(steps_df(spark, []), ["ep"]).first()
    assert empty.num_episode == 0 and empty.avg_return is None


def test_vote_tie_goes_to_first_appearance(spark):
    df = spark.createDataFrame([("s", "a", 0), ("s", "b", 1), ("s", "b", 2), ("s", "a", 3)], "state string, candidate string, sample_idx int")
    assert [r.candidate for r in A.vote(df, "state", "candidate", k=1).collect()] == ["a"]


def test_score_normalisation_fixed_points(spark):
    scores = spark.createDataFrame([(1, "maze", -83.0), (2, "maze", -6.84), (3, "maze", -101.0)], "run int, benchmark string, score double")
    res = {r.run: r.norm_score for r in A.score_board(scores, A.bounds_table(spark), "run").collect()}
    assert res == {1: 50.0, 2: 100.0, 3: 0.0}


def test_masked_stats(spark):
    rows = [
        (1, [1.0, 100.0, 2.0, 3.0], [True, False, True, True]),
        (2, [5.0], [False]),
        (3, [1e9, 1e9 + 1, 1e9 + 2], [True, True, True]),
        (4, [], []),
        (5, [1.0, 2.0], [None, True]),
    ]
    df = spark.createDataFrame(rows, "id int, xs array<double>, mask array<boolean>")
    r = {x.id: x for x in A.masked_stats(df, ["id"], "xs", "mask").collect()}
    assert (r[1].mean, r[1].min, r[1].max, r[1].n_kept, r[1].n) == (1.5, 1.0, 3.0, 3, 4) and abs(r[1].std - 0.816497) < 1e-6
    assert (r[2].mean, r[2].min, r[2].std, r[2].n_kept) == (0.0, None, None, 0)
    assert abs(r[3].std - 0.816497) < 1e-6  # no cancellation
    assert (r[4].mean, r[4].std, r[4].n) == (None, None, 0)
    assert (r[5].min, r[5].n_kept) == (2.0, 1)


def test_unpad_cuts_at_the_first_padding(spark):
    rows = [(1, [1, 2, 3], [True, False, True]), (2, [1, 2], [True, True]), (3, [1], [False])]
    df = spark.createDataFrame(rows, "id int, xs array<int>, mask array<boolean>")
    got = {r.id: r.u for r in df.select("id", A.unpad(F.col("xs"), F.col("mask")).alias("u")).collect()}
    assert got == {1: [1], 2: [1, 2], 3: []}


def test_running_stats_across_partitions(spark):
    df = spark.range(0, 500, numPartitions=7).select(F.col("id").alias("k"), ((F.col("id") * 37) % 101).cast("double").alias("x"))
    rows = A.running_stats(df, ["k"], "x").orderBy("k").collect()
    xs = [(k * 37) % 101 for k in range(500)]
    run_sum, run_max = 0.0, float("-inf")
    for k, r in enumerate(rows):
        run_sum += xs[k]
        run_max = max(run_max, xs[k])
        assert r.k == k and r.running_sum == run_sum and r.running_count == k + 1 and r.running_max == run_max


def test_window_free_episode_facts_equal_the_steps_path(spark):
    from trajspark.operators import metrics as A
    from trajspark.plans import views as V

    cols = ["user_id", "week", "iter", "first_state", "first_turn", "final_reward", "ep_return", "n_actions"]
    sf = "/root/testdata/sf0.01"
    direct = V.ep_event_facts(spark, sf).select(*cols)
    via_steps = A.episode_facts(V.ep_events(spark, sf), V.EP_KEYS, extra=["iter"]).select(*cols)
    assert [(f.name, f.dataType) for f in direct.schema] == [(f.name, f.dataType) for f in via_steps.schema]
    assert direct.exceptAll(via_steps).count() == 0 and via_steps.exceptAll(direct).count() == 0
    assert direct.count() > 0


def test_numbering_by_spans_equals_one_window(spark):
    from pyspark.sql import Window

    from trajspark.operators.steps import number_steps

    rows = [(k if k < 3 else None, i, f"v{i}" if i % 5 else None) for k in range(4) for i in range(40)] + [(7, 0, "only")]
    df = spark.createDataFrame(rows, "g int, t int, v string")
    w = Window.partitionBy("g").orderBy("t")
    cols = ["g", "t", "v", "step", "_next1", "_next2", "_next3"]
    want = df.select(
        "g", "t", "v", (F.row_number().over(w) - 1).alias("step"), *[F.lead("v", i).over(w).alias(f"_next{i}") for i in (1, 2, 3)]
    )
    for span in (F.lit(0), F.floor(F.col("t") / 7), F.col("t")):
        got = number_steps(df, ["g"], ["t"], "v", span, ahead=3).select(*cols)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_audit_replay_counts_each_rule_in_one_pass(spark):
    schema = "ep int, step int, state string, action string, turn boolean, is_terminal boolean"
    rows = [
        # episode 1: clean
        (1, 0, "a", "b", True, False), (1, 1, "b", "c", False, False), (1, 2, "c", None, True, True),
        # episode 2: same actor twice, the action does not name the next state, terminal flag early
        (2, 0, "a", "b", True, False), (2, 1, "b", "x", True, True), (2, 2, "c", None, False, True),
    ]
    steps = spark.createDataFrame(rows, schema)
    legal = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "b")], "state string, action string")
    got = {r.rule: (r.n_checked, r.n_violations) for r in T.audit_replay(steps, ["ep"], legal=legal).collect()}
    assert got == {
        "alternation": (4, 1),
        "next_state": (4, 1),
        "terminal_flag": (6, 1),
        "legal": (4, 1),  # (b, x) is not a legal move
    }


def test_running_stats_across_partitions_with_nulls(spark):
    import pandas as pd

    n = 1000
    rows = [(i, None if i % 7 == 0 or 300 <= i < 340 else float((i * 37) % 101 - 50)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, x double").repartition(13)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        got = A.running_stats(df, ["k"], "x", "r").orderBy("k").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    x = pd.Series([r[1] for r in rows], dtype="float64")
    want_sum = x.fillna(0).cumsum()
    want_cnt = x.notna().cumsum()
    want_max = x.cummax().ffill()
    assert (got["r_sum"] - want_sum).abs().max() < 1e-9
    assert (got["r_count"] == want_cnt).all()
    assert ((got["r_mean"] - want_sum / want_cnt.where(want_cnt > 0)).abs().fillna(0) < 1e-9).all()
    assert ((got["r_max"] - want_max).abs().fillna(0) < 1e-12).all()


NULL_STEPS = [
    # an episode under a null key is an episode like any other
    (None, 0, "a", "b", 0, True), (None, 1, "b", "c", -1, False), (None, 2, "c", None, None, True),
    (1, 0, "x", "y", 0, False), (1, 1, "y", "z", 1, True), (1, 2, "z", None, None, False),
]


def _null_steps(spark):
    df = spark.createDataFrame(NULL_STEPS, "ep int, step int, state string, action string, reward int, turn boolean")
    return df.withColumn("is_terminal", F.col("action").isNull())


def test_null_keys_keep_their_rows(spark):
    steps = _null_steps(spark)
    t = {(r.ep, r.step): r.next_state for r in T.to_transitions(steps, ["ep"]).collect()}
    assert t == {(None, 0): "b", (None, 1): "c", (1, 0): "y", (1, 1): "z"}
    own = {(r.ep, r.step): (r.next_state, r.reward, r.done) for r in T.own_view(steps, ["ep"]).collect()}
    assert own == {(None, 0): ("b", 0, False), (1, 1): ("z", -1, True)}
    credit = {(r.ep, r.step): (r.reward, r.done) for r in T.own_view(steps, ["ep"], credit_final=True).collect()}
    assert credit == {(None, 0): (-1, True), (1, 1): (-1, True)}
    la = {(r.ep, r.step): (r.pv_actions, r.final_state.state, r.final_state.is_terminal) for r in T.look_ahead(steps, ["ep"], k=2).collect()}
    assert la == {(None, 0): (["b", "c"], "c", True), (None, 1): (["c"], "c", True), (1, 0): (["y", "z"], "z", True), (1, 1): (["z"], "z", True)}


def test_joins_equal_the_windows(spark):
    from pyspark.sql import Window

    from trajspark.plans import views as V

    steps = V.ep_events(spark, "/root/testdata/sf0.01")
    w = Window.partitionBy(*V.EP_KEYS).orderBy("step")
    want = steps.withColumn("next_state", F.lead("state").over(w)).where(F.col("action").isNotNull())
    got = T.to_transitions(steps, V.EP_KEYS)
    want = want.select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    ahead = T.look_ahead(steps, V.EP_KEYS, k=3).select(*V.EP_KEYS, "step", "pv_actions")
    full = steps.select(*V.EP_KEYS, "step", F.collect_list("action").over(w.rowsBetween(0, 2)).alias("pv_actions"), "action")
    full = full.where(F.col("action").isNotNull()).drop("action")
    assert ahead.exceptAll(full).count() == 0 and full.exceptAll(ahead).count() == 0


def test_tic_tac_toe_steps_against_a_rule_table(spark, tmp_path):
    import json

    from trajspark.sources import io as S

    game = {"state": [[[0] * 9, "O"], [[1] + [0] * 8, "X"], [[1, 2] + [0] * 7, "O"]], "action": [0, 1], "reward": [0, 1], "turn": [True, False]}
    bad = {"state": [[[0] * 9, "O"], [[1] + [0] * 8, "X"]], "action": [5], "reward": [0], "turn": [True]}
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, (game, bad))) + "\n")
    steps, rejects = S.read_buffer(spark, str(tmp_path / "t.jsonl"), "tictactoe")
    assert rejects.count() == 0
    kinds = "state struct<board: array<int>, mark: string>, action int, next_state struct<board: array<int>, mark: string>"
    zero, one, two = ([0] * 9, "O"), ([1] + [0] * 8, "X"), ([1, 2] + [0] * 7, "O")
    rules = spark.createDataFrame([(zero, 0, one), (one, 1, two)], kinds)
    got = {r.rule: (r.n_checked, r.n_violations) for r in T.audit_replay(steps, ["episode_id"], rules=rules).collect()}
    assert got == {"alternation": (1, 0), "next_state": (3, 1), "terminal_flag": (5, 0), "legal": (3, 1)}


def test_suffixes_under_a_null_key(spark):
    steps = _null_steps(spark)
    got = {(r.ep, r.start): (r.suffix_len, r.return_to_go, r.suffix_actions, r.suffix_states) for r in T.suffixes(steps, ["ep"], own_only=False).collect()}
    assert got[(None, 0)] == (2, -1, ["b", "c"], ["a", "b", "c"]) and got[(1, 1)] == (1, 1, ["z"], ["y", "z"]) and len(got) == 4


def test_window_counts_from_stored_sketches(spark):
    """Many keys: the windows' estimates lie within 5 % of the exact counts; rows are exact."""
    df = spark.range(0, 60_000).select(F.col("id"), (F.col("id") % 6 + 1).cast("int").alias("iter")).withColumn(
        "k", F.when(F.col("id") % 1000 == 0, None).otherwise((F.col("id") * 7919 % 23_000 + F.col("iter") * 3000).cast("string"))
    )
    got = {r["iter"]: (r["n_unique"], r["n_pairs"]) for r in A.window_key_counts(A.key_sketches(df, "iter", ["k"]), "iter", 3).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    for i, (n_unique, n_pairs) in got.items():
        w = df.where(F.col("iter").between(i - 2, i))
        exact = w.agg(F.count_distinct("k")).first()[0] + 1
        assert n_pairs == w.count() and abs(n_unique - exact) < 0.05 * exact
