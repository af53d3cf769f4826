"""Sources and sinks on files written under pytest's tmp_path."""

import json

from pyspark.sql import functions as F

from trajspark.sources import io as S


def _write_lines(path, lines):
    path.write_text("\n".join(lines) + "\n")


def test_read_tictactoe_buffer_with_rejects(spark, tmp_path):
    traj = {"state": [[[0] * 9, "O"], [[1] + [0] * 8, "X"]], "action": [0], "reward": [1], "turn": [True]}
    _write_lines(tmp_path / "buf.jsonl", [json.dumps(traj), "{not json"])
    steps, rejects = S.read_buffer(spark, str(tmp_path), "tictactoe")
    rows = steps.orderBy("step").collect()
    assert rows[0].state.board == [0] * 9 and rows[0].state.mark == "O" and rows[0].action == 0
    assert rows[1].is_terminal and rows[1].action is None
    assert rejects.count() == 1


def test_breakthrough_two_vector_reward_and_state_buffer(spark, tmp_path):
    traj = {"state": ["s0", "s1"], "action": ["a2b3"], "reward": [[1.0, -1.0]], "turn": [0],
            "serializad_state": ["b0", "Terminal State."]}
    _write_lines(tmp_path / "t.jsonl", [json.dumps(traj)])
    steps, _ = S.read_buffer(spark, str(tmp_path / "t.jsonl"), "breakthrough")
    first = steps.where("step = 0").first()
    assert (first.reward, first.turn, first.serialised_state) == (1.0, True, "b0")
    states, _ = S.read_states(spark, str(tmp_path / "t.jsonl"), "trajectory")
    assert [r.state for r in states.collect()] == ["b0"]
    _write_lines(tmp_path / "s.jsonl", [json.dumps({"serializad_state": "x"}), json.dumps({"serializad_state": "x"})])
    assert S.read_states(spark, str(tmp_path / "s.jsonl"), "states")[0].count() == 1
    _write_lines(tmp_path / "odd.jsonl", [json.dumps({"other": 1}), "{broken", json.dumps({"serializad_state": "x"}), "  "])
    good, rejects = S.read_states(spark, str(tmp_path / "odd.jsonl"), "states")
    assert good.count() == 1 and sorted(r.line for r in rejects.collect()) == ['{"other": 1}', "{broken"]
    try:
        S.read_states(spark, str(tmp_path / "s.jsonl"), "other")
    except ValueError:
        pass
    else:
        raise AssertionError("expected ValueError")


def test_write_buffer_keeps_nulls_and_appends(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "id int, eval string")
    out = str(tmp_path / "o")
    S.write_buffer(df, out)
    S.write_buffer(df, out, mode="append")
    lines = [r.value for r in spark.read.text(out).collect()]
    assert len(lines) == 2 and all('"eval":null' in ln for ln in lines)


def test_keyed_merge_last_wins(spark, tmp_path):
    _write_lines(tmp_path / "k.jsonl", [json.dumps({"1": "a", "2": "b"}), json.dumps({"1": "c"})])
    kv, _ = S.read_keyed(spark, str(tmp_path / "k.jsonl"))
    merged = {r.key: r.value for r in S.merge_keyed(kv, "key", "value", ["file", "block", "pos"]).collect()}
    assert merged == {1: "c", 2: "b"}


def test_keyed_merge_last_wins_across_file_splits(spark, tmp_path):
    lines = [json.dumps({"1": f"v{i}", str(i + 10): "x" * (i % 7)}) for i in range(400)]
    _write_lines(tmp_path / "big.jsonl", lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")  # many splits of one file
    try:
        kv, _ = S.read_keyed(spark, str(tmp_path / "big.jsonl"))
        assert kv.select("block").distinct().count() > 5
        merged = {r.key: r.value for r in S.merge_keyed(kv, "key", "value", ["file", "block", "pos"]).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert merged[1] == "v399" and len(merged) == 401


def test_read_runs_and_manifest(spark, tmp_path):
    for run in ("r1", "r2"):
        (tmp_path / run).mkdir()
        _write_lines(tmp_path / run / "b.jsonl", [json.dumps({"state": ["x", "y"], "action": ["a"], "reward": [0.0], "turn": [True]})])
    steps, _ = S.read_runs(spark, f"{tmp_path}/r1,{tmp_path}/r2", "generic")
    assert steps.select("run").distinct().count() == 2
    m = S.write_manifest(spark, str(tmp_path / "m"), {"seed": 42}, {"steps": steps.count()}).first()
    assert m.n_steps == 4 and json.loads(m.params) == {"seed": 42}


def test_contiguous_iterations_stop_at_gap(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (4,)], "iter int")
    assert sorted(r.iter for r in S.contiguous_iterations(df).collect()) == [1, 2, 2]


def test_value_table_roundtrip(spark, tmp_path):
    v = spark.createDataFrame([("s", 0.12345, 3)], "state string, value double, visits int")
    S.save_values(v, str(tmp_path / "v"), {"type": "td", "alpha": 0.4})
    loaded, info = S.load_values(spark, str(tmp_path / "v"))
    assert loaded.first().value == 0.123 and info["alpha"] == 0.4


def test_export_requests_ids(spark):
    df = spark.createDataFrame([("b",), ("a",)], "k string").withColumn(
        "messages", F.array(F.struct(F.lit("user").alias("role"), F.col("k").alias("content")))
    )
    req = {r.k: json.loads(r.line) for r in S.export_requests(df, ["k"], "m", {"max_tokens": 8}).collect()}
    assert req["a"]["custom_id"] == "request-0" and req["b"]["body"]["max_tokens"] == 8


def test_keyed_lines_that_are_no_objects_are_rejects(spark, tmp_path):
    _write_lines(tmp_path / "k.jsonl", [json.dumps({"1": "a"}), "nope", json.dumps({"x": "b"}), ""])
    rows, rejects = S.read_keyed(spark, str(tmp_path / "k.jsonl"))
    assert [(r.key, r.value) for r in rows.collect()] == [(1, "a")]
    assert sorted(r.line for r in rejects.collect()) == ["nope", '{"x": "b"}']


def test_two_player_log_runs_through_the_metrics(spark, tmp_path):
    from trajspark.operators import metrics as A
    from trajspark.operators import steps as T

    games = [
        {"state": ["s0", "s1", "Terminal State."], "action": ["a", "b"], "reward": [[0, 0], [1, -1]], "turn": [0, 1], "serializad_state": ["z0", "z1", "Terminal State."]},
        {"state": ["s0", "Terminal State."], "action": ["c"], "reward": [[-1, 1]], "turn": [0], "serializad_state": ["z0", "Terminal State."]},
        {"state": ["s9", "Terminal State."], "action": ["c"], "reward": [[-1, 1]], "turn": [1], "serializad_state": ["z9", "Terminal State."]},
    ]
    _write_lines(tmp_path / "g.jsonl", [json.dumps(g) for g in games])
    steps, rejects = S.read_buffer(spark, str(tmp_path / "g.jsonl"), "breakthrough")
    assert rejects.count() == 0
    assert sorted(r.action for r in T.own_steps(steps).collect()) == ["a", "c"]
    wins = {(r.first_state, r.first_turn): (r.win, r.win_rate) for r in A.win_rate(steps, ["episode_id"]).collect()}
    assert wins == {("s0", True): ("black", 0.0), ("s9", False): ("white", -1.0)}
    out = A.episode_outcomes(steps, ["episode_id"]).first()
    assert out.num_episode == 3 and abs(out.avg_win - 2 / 3) < 1e-6


def test_episode_ids_do_not_depend_on_splits(spark, tmp_path):
    game = {"state": ["s0", "s1"], "action": ["a"], "reward": [1.0], "turn": [True]}
    _write_lines(tmp_path / "g.jsonl", [json.dumps({**game, "action": [str(i % 90)]}) for i in range(200)])
    seen = []
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("128m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            steps, _ = S.read_buffer(spark, str(tmp_path / "g.jsonl"), "generic")
            seen.append(sorted((r.episode_id, r.action) for r in steps.where("step = 0").collect()))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert seen[0] == seen[1] and len({i for i, _ in seen[0]}) == 200


def test_lookahead_records_are_written_back(spark, tmp_path):
    pv = lambda a, end: {"state": ["s"], "action": [a], "reward": [[0, 0]], "turn": [0], "serializad_state": ["z"], "final_state": end}
    rec = {"current_state": "s", "current_serializad_state": "z", "pv": [
        pv("d5d4", {"state": "e", "eval": None, "turn": 0}),
        pv("a2b3", {"state": S.TERMINAL_SENTINEL, "eval": S.TERMINAL_EVAL, "turn": None}),
    ]}
    _write_lines(tmp_path / "l.jsonl", [json.dumps(rec), "[]"])
    rows, rejects = S.read_lookahead(spark, str(tmp_path / "l.jsonl"))
    assert rejects.count() == 1
    got = {r.pv_idx: r.final_state for r in rows.collect()}
    assert (got[0].turn, got[0].is_terminal, got[1].turn, got[1].is_terminal) == (True, False, None, True)
    from trajspark.operators.infer import attach_eval

    replies = spark.createDataFrame([(rows.first().record_id, 0, "good")], "record_id string, pv_idx int, response string")
    S.write_lookahead(attach_eval(rows, replies, ["record_id", "pv_idx"]), str(tmp_path / "out"))
    back = json.loads(spark.read.text(str(tmp_path / "out")).first().value)
    want = json.loads(json.dumps(rec))
    want["pv"][0]["final_state"]["eval"] = "good"
    for p in want["pv"]:
        p["reward"] = [[0.0, 0.0]]
    assert back == want
