"""Prompts, inference, answer extraction and training examples."""

from pyspark.sql import functions as F

from trajspark.operators import answers as P
from trajspark.operators import examples as X
from trajspark.operators import infer as I
from trajspark.operators import prompts as PR


def test_prompt_table_fills_slots(spark):
    df = spark.createDataFrame([("s1", True)], "state string, turn boolean")
    out = PR.prompt_table(df, PR.template_table(spark), "evaluate", {"state": F.col("state"), "turn": F.col("turn")}).first()
    assert "State: s1" in out.user and "Our turn: true" in out.user
    assert [m.role for m in out.messages] == ["system", "user"]


def test_verdicts_undecided_cases(spark):
    texts = [
        (1, "Advantage: <black>"),
        (2, "Advantage: <black> <white>"),  # both
        (3, "Advantage: none"),  # neither
        (4, "<white> before. Advantage: <black>"),  # tag only before the marker
    ]
    df = spark.createDataFrame(texts, "id int, response string")
    got = {r.id: r.predict for r in P.extract_verdict(df, "response").collect()}
    assert got == {1: "black", 2: "undecided", 3: "undecided", 4: "black"}


def test_verdict_accuracy_strict_threshold(spark):
    pred = spark.createDataFrame([(1, "black"), (2, "black"), (3, "white")], "id int, predict string")
    labels = spark.createDataFrame([(1, "black", 0.19), (2, "black", 0.20), (3, "black", -0.20)], "id int, win string, win_rate double")
    r = P.verdict_accuracy(pred, labels, ["id"]).first()
    assert (r.n_right, r.n_total, r.accuracy) == (1, 2, 0.5)
    none = P.verdict_accuracy(pred.where("id = 1"), labels, ["id"]).first()
    assert none.n_total == 0 and none.accuracy is None


def test_pattern_extraction_and_fallback(spark):
    """Digit − 1 is the move itself; it counts if it is in the legal list."""
    rows = [(1, '{"best_move": 5}', [4, 8]), (2, '{"best_move": 1}', [4, 8]), (3, "no idea", [6]), (4, '{"best_move": x}', [2]), (5, '{"best_move": 9}', [4, 8]), (6, None, [3])]
    df = spark.createDataFrame(rows, "id int, response string, legal array<int>")
    got = {r.id: (r.action, r.status) for r in P.extract_pattern(df, "response", "legal", ["id"]).collect()}
    assert got[1] == (4, "ok") and got[5] == (8, "ok")
    assert got[2][1] == "fallback" and got[2][0] in (4, 8)
    assert got[3] == (6, "no_marker") and got[4] == (2, "fallback") and got[6] == (3, "no_marker")


def test_json_extraction_takes_the_default_where_the_field_is_missing(spark):
    rows = [(1, '{"action": "up", "thoughts": "t"}'), (2, '{"thoughts": "t"}'), (3, "up"), (4, None), (5, '{"action": ')]
    df = spark.createDataFrame(rows, "id int, response string")
    out = P.extract_json(df, "response", "thoughts string, action string", "action", F.lit("none"))
    assert {r.id: (r.answer, r.status) for r in out.collect()} == {1: ("up", "ok"), **{i: ("none", "default") for i in (2, 3, 4, 5)}}


def test_values_with_slots_stay_as_they_are(spark):
    from trajspark.operators import prompts as PR

    df = spark.createDataFrame([("x {turn} y",), ("{state}",), (None,)], "state string")
    out = PR.prompt_table(df, spark.createDataFrame([("t", "s", "A {state} B {turn}{turn} {other}")], "name string, system string, user string"), "t", {"state": F.col("state"), "turn": F.lit("now")})
    assert sorted(r.user for r in out.collect()) == ["A  B nownow {other}", "A x {turn} y B nownow {other}", "A {state} B nownow {other}"]


def test_joint_keys_tell_pairs_apart(spark):
    from trajspark.functions.keys import joint_key

    rows = [("a|b", "c"), ("a", "b|c"), (None, "a"), ("a", None), ("", "a"), ("-", "a"), ("1:a", "")]
    df = spark.createDataFrame(rows, "p string, q string")
    assert df.select(joint_key(["p", "q"]).alias("k")).distinct().count() == len(rows)


def test_move_distribution_all_minus_inf_is_uniform(spark):
    ninf = float("-inf")
    df = spark.createDataFrame([(1, "a", ninf), (1, "b", ninf), (2, "a", 0.0), (2, "b", ninf)], "state int, move string, lp double")
    res = {(r.state, r.move): r for r in P.move_distribution(df, "state", "move", "lp").collect()}
    assert res[(1, "a")].p == 0.5 and res[(1, "b")].p == 0.5
    assert res[(2, "a")].p == 1.0 and res[(2, "b")].p == 0.0 and res[(2, "a")].is_argmax and res[(2, "a")].is_sample
    assert sum(1 for (s, _), r in res.items() if s == 1 and r.is_sample) == 1


def test_infer_attach_and_freeze(spark):
    pr = spark.createDataFrame([(1, "abc"), (2, "abcdefgh")], "id int, user string")
    resp = I.infer(pr, "len_value", ["id"])
    assert {r.id: r.response for r in resp.collect()} == {1: "value 0", 2: "value -2"}


def test_label_masks_reject_cut_answer(spark):
    df = spark.createDataFrame(
        [(1, "q1 q2", "q1 q2 a1 a2"), (2, "q1 q2 q3 q4 q5", "q1 q2 q3 q4 q5 a1")], "id int, query_text string, full_text string"
    )
    got = {r.id: r for r in X.label_masks(df, max_len=4).collect()}
    assert got[1].labels == ["-100", "-100", "a1", "a2"] and got[1].kept
    assert not got[2].kept and got[2].n_label == 0


def test_render_chat_query_and_full(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "c int, turn int, role string, text string")
    r = X.render_chat(turns, ["c"], ["turn"]).first()
    assert r.full_text.startswith("<|begin_of_text|><|start_header_id|>user")
    assert r.query_text.endswith("<|start_header_id|>assistant<|end_header_id|>\n") and "yo" not in r.query_text
