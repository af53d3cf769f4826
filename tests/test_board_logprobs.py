"""Board rules (T6), token-level log-probs (P13) and repeated lines (S1) on hand-made rows."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from trajspark.operators import answers as P
from trajspark.operators import board as B
from trajspark.sources import io as S

LINES = B.winning_lines()


def plain_status(b):
    for code in (1, 2):
        if any(all(b[i] == code for i in line) for line in ((0, 1, 2), (3, 4, 5), (6, 7, 8), (0, 3, 6), (1, 4, 7), (2, 5, 8), (0, 4, 8), (2, 4, 6))):
            return code
    return -1 if 0 in b else 0


def test_lines_of_boards():
    assert len(LINES) == 8 and sorted(map(len, LINES)) == [3] * 8
    assert len(B.winning_lines(7, 6, 4)) == 69  # four in a row


def test_status_moves_and_mover_of_every_board(spark):
    boards = [b for b in itertools.product((0, 1, 2), repeat=9) if 0 <= b.count(1) - b.count(2) <= 1]
    df = spark.createDataFrame([(list(b), "OX"[b.count(1) - b.count(2)]) for b in boards], "board array<int>, mark string").select(F.struct("board", "mark").alias("s"))
    got = df.select("s.board", B.status(F.col("s.board"), LINES).alias("w"), B.mover(F.col("s.board")).alias("m"), "s.mark", B.legal_moves(F.col("s"), LINES).alias("free"), B.apply_move(F.col("s"), F.lit(4)).alias("n"), B.apply_move(F.col("s"), F.lit(9)).alias("off"))
    rows = got.collect()
    assert len(rows) == len(boards)
    for r in rows:
        b, w = list(r["board"]), plain_status(r["board"])
        assert r["w"] == w and r["m"] == r["mark"] and r["off"] is None
        assert r["free"] == ([i for i in range(9) if b[i] == 0] if w == -1 else [])
        b[4] = 1 if r["mark"] == "O" else 2
        assert r["n"]["board"] == b and r["n"]["mark"] == ("X" if r["mark"] == "O" else "O")


def steps(spark, tmp_path, *games):
    (tmp_path / "g.jsonl").write_text("\n".join(map(json.dumps, games)) + "\n")
    got, rejects = S.read_buffer(spark, str(tmp_path / "g.jsonl"), "tictactoe")
    assert rejects.count() == 0
    return got


def game(moves, first=True):
    b, mark, states = [0] * 9, "O", [[[0] * 9, "O"]]
    for a in moves:
        b = b[:]
        b[a] = 1 if mark == "O" else 2
        mark = "X" if mark == "O" else "O"
        states.append([b, mark])
    w = plain_status(b)
    return {"state": states, "action": list(moves), "reward": [0] * (len(moves) - 1) + [{1: 1, 2: -1}.get(w, 0)], "turn": [(i % 2 == 0) == first for i in range(len(moves))]}


def audit(df):
    return {r.rule: r.n_violations for r in B.audit_board(df, ["episode_id"], LINES).collect()}


def test_audit_counts_each_kind_of_fault(spark, tmp_path):
    won, drawn = game([0, 3, 1, 4, 2]), game([0, 1, 2, 4, 3, 5, 7, 6, 8], first=False)
    none = dict.fromkeys(["alternation", "mark", "legal", "next_state", "terminal_flag", "winner"], 0)
    assert audit(steps(spark, tmp_path, won, drawn, won)) == none
    over = game([0, 3, 1, 4, 2, 5])  # goes on after the win
    assert audit(steps(spark, tmp_path, over)) == {**none, "legal": 1, "terminal_flag": 1}
    wrong = {**won, "reward": [0, 0, 0, 0, -1]}
    assert audit(steps(spark, tmp_path, wrong)) == {**none, "winner": 1}
    off = {**won, "action": [0, 3, 1, 4, 12]}
    assert audit(steps(spark, tmp_path, off)) == {**none, "legal": 1, "next_state": 1}
    mark = {**won, "state": [*won["state"][:2], [won["state"][2][0], "X"], *won["state"][3:]]}
    assert audit(steps(spark, tmp_path, mark)) == {**none, "mark": 1, "next_state": 2}
    out = {r.winner: (r.n_games, r.n_moves) for r in B.board_outcomes(steps(spark, tmp_path, won, won, drawn), ["episode_id"], LINES).collect()}
    assert out == {1: (2, 10), 0: (1, 9)}


def test_replay_stops_when_the_game_is_over(spark):
    df = spark.createDataFrame([([0, 3, 1, 4, 2, 5, 6, 7, 8],)], "m array<int>")
    s, a = B.replay_moves(F.col("m"), LINES, 9)
    r = df.select(s.alias("s"), a.alias("a")).first()
    want = game([0, 3, 1, 4, 2])
    assert r["a"] == want["action"] and [[list(x["board"]), x["mark"]] for x in r["s"]] == want["state"]


def test_move_logprobs_from_token_positions(spark):
    inf, nan = float("inf"), float("nan")
    head = ("<|end_header_id|>", -0.1)
    rows = [
        ("a", [[("3", -1.0), head], [("3", -0.5), ("x", -9.0)], None, [("1", -4.0), ("2", -2.0), head]], [1, 2, 3]),  # no header: not told; the last move token counts
        ("a", [[("3", -3.0), ("assistant", -1.0)], [("9", -0.1), head]], [1, 2, 3]),  # lower value doesn't win; 9 is no legal move
        ("b", [[("1", -inf), head], [("2", nan), head], [("1", None), head], [(None, -1.0), head]], [1, 2]),
        ("c", None, [5]),
    ]
    df = spark.createDataFrame(rows, "s string, p array<array<struct<token: string, logprob: double>>>, legal array<int>")
    got = {(r.s, r.move): (r.lp, r.n_positions, r.is_uniform) for r in P.extract_move_logprobs(df, ["s"], "p", "legal", {str(m): m for m in range(1, 10)}).collect()}
    assert got == {
        ("a", 1): (-inf, 0, False), ("a", 2): (-2.0, 1, False), ("a", 3): (-1.0, 2, False),
        ("b", 1): (0.0, 2, True), ("b", 2): (0.0, 1, True), ("c", 5): (0.0, 0, True),
    }


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_one_line_repeated_very_often(spark, tmp_path, limit):
    lines = ['{"a": 1}'] * 9000 + [f'{{"a": {i}}}' for i in range(2, 40)] + ["broken"] * 3 + ["", "  "]
    for name in "xy":
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    raw = spark.read.text(str(tmp_path)).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("line")).where("line rlike '[a-z]'")
    got = S._numbered(raw, limit)
    assert got.count() == 2 * (len(lines) - 2) and got.select("record_id").distinct().count() == got.count()
    ids = [r["record_id"] for r in got.where("line = '{\"a\": 1}' and source_file like '%x.jsonl'").collect()]
    base = min(ids, key=len)
    assert set(ids) == {base, *[f"{base}-{k}" for k in range(2, 9001)]}
    rows, rejects = S.read_records(spark, str(tmp_path), S.T.StructType([S.T.StructField("a", S.T.IntegerType())]), "a")
    assert rows.count() == 2 * 9038 and sorted(r["line"] for r in rejects.collect()) == ["broken"] * 6


def test_the_numbering_exchange_carries_no_text(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    raw = spark.read.text(str(tmp_path)).select(F.lit("f").alias("source_file"), F.col("value").alias("line"))
    unique = S._numbered(raw).where("record_id not like '%-%'")
    plan = unique._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "Window" not in plan
