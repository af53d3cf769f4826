"""Board rules as expressions (T6): moves, winners and audits without a table of states.

A board is an array of cell codes (0 empty, 1 first player, 2 second player) read row by
row, a state is ``struct<board, mark>``. Everything is array expressions over a small list
of winning lines, so a log of any size is judged where it is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.operators.steps import _with_next_state

#: fixed values: marks of the players by code
MARKS = ("O", "X")


def winning_lines(width: int = 3, height: int = 3, run: int = 3) -> list[list[int]]:
    """Cells of every row, column and diagonal run of ``run`` cells."""
    out = []
    for dx, dy in ((1, 0), (0, 1), (1, 1), (-1, 1)):
        for y in range(height):
            for x in range(width):
                ends = x + (run - 1) * dx, y + (run - 1) * dy
                if 0 <= ends[0] < width and ends[1] < height:
                    out.append([(y + i * dy) * width + x + i * dx for i in range(run)])
    return out


def code_of(mark: Column) -> Column:
    """1 for the first player's mark, 2 for the second's, null for another text."""
    return F.when(mark == MARKS[0], 1).when(mark == MARKS[1], 2)


def apply_move(state: Column, action: Column) -> Column:
    """State after the mover puts the mark on cell ``action``; null when the cell is off the board."""
    board, mark = state["board"], state["mark"]
    after = F.transform(board, lambda x, i: F.when(i == action, code_of(mark)).otherwise(x).cast("int"))
    other = F.when(mark == MARKS[0], MARKS[1]).when(mark == MARKS[1], MARKS[0])
    return F.when((action >= 0) & (action < F.size(board)), F.struct(after.alias("board"), other.alias("mark")))


def status(board: Column, lines: Sequence[Sequence[int]]) -> Column:
    """Code of the winner, 0 for a draw, -1 while the game goes on; null for a null board."""
    table = F.array(*[F.array(*[F.lit(i) for i in line]) for line in lines])

    def won(code: int) -> Column:
        return F.exists(table, lambda line: F.forall(line, lambda i: F.coalesce(F.get(board, i) == code, F.lit(False))))

    return F.when(board.isNull(), F.lit(None).cast("int")).when(won(1), 1).when(won(2), 2).when(F.array_contains(board, 0), -1).otherwise(0)


def legal_moves(state: Column, lines: Sequence[Sequence[int]]) -> Column:
    """Empty cells of a game that goes on, in order."""
    board = state["board"]
    free = F.filter(F.transform(board, lambda x, i: F.when(x == 0, i)), lambda i: i.isNotNull())
    return F.when(status(board, lines) == -1, free).otherwise(F.array().cast("array<int>"))


def mover(board: Column) -> Column:
    """Mark that is to move: the first player's while both have as many cells."""
    cells = lambda code: F.size(F.filter(board, lambda x: x == code))
    return F.when(cells(1) == cells(2), MARKS[0]).otherwise(MARKS[1])


def outcome_reward(winner: Column) -> Column:
    """+1 when the first player won, -1 when the second did, else 0."""
    return F.when(winner == 1, 1).when(winner == 2, -1).otherwise(0)


def audit_board(steps: DataFrame, ep: Sequence[str], lines: Sequence[Sequence[int]], order: str = "step") -> DataFrame:
    """Replay audit of logged board games, counted per rule.

    * ``alternation``: the actor flag changes at every step;
    * ``mark``: the state's mark is the one that is to move by the cells;
    * ``legal``: the action is an empty cell of a game that goes on;
    * ``next_state``: the next state is the move applied to this one;
    * ``terminal_flag``: the game is over in the last state and in no other;
    * ``winner``: the last action's reward names the winner, and the rewards before are 0.

    ``order`` is the dense 0-based step number; the neighbour comes by a join on
    (episode…, step + 1), so a long game spreads over tasks. A null action (but for the
    last state's), board or reward is a violation of the rules that need it.
    """
    t = _with_next_state(steps, steps, ep, order, ["is_terminal", "turn"])
    s, nxt = F.col("state"), F.col("next_state")
    acted = F.col("action").isNotNull()
    last = F.coalesce(F.col("next_is_terminal"), F.lit(False))
    truth = lambda c: F.coalesce(c, F.lit(False))
    over = truth(status(s["board"], lines) != -1)
    wanted = F.when(last, outcome_reward(status(nxt["board"], lines))).otherwise(0)
    checks = [
        ("alternation", F.col("turn").isNotNull() & F.col("next_turn").isNotNull(), F.col("turn") != F.col("next_turn")),
        ("mark", F.lit(True), over | truth(s["mark"] == mover(s["board"]))),
        ("legal", acted, truth(F.array_contains(legal_moves(s, lines), F.col("action")))),
        ("next_state", acted, truth(apply_move(s, F.col("action")) == nxt)),
        ("terminal_flag", F.lit(True), F.col("is_terminal") == over),
        ("winner", acted, truth(F.col("reward") == wanted)),
    ]
    aggs = []
    for i, (_, cond, good) in enumerate(checks):
        aggs += [F.count_if(cond).alias(f"_c{i}"), F.count_if(cond & ~good).alias(f"_v{i}")]
    rows = ", ".join(f"'{name}', _c{i}, _v{i}" for i, (name, _, _) in enumerate(checks))
    return t.agg(*aggs).selectExpr(f"stack({len(checks)}, {rows}) AS (rule, n_checked, n_violations)")


def board_outcomes(steps: DataFrame, ep: Sequence[str], lines: Sequence[Sequence[int]], order: str = "step") -> DataFrame:
    """Games and moves by the winner of the last board (0 draw, -1 unfinished)."""
    last = steps.groupBy(*ep).agg(F.max_by("state", order).alias("state"), F.count("action").alias("moves"))
    return last.groupBy(status(F.col("state.board"), lines).alias("winner")).agg(F.count(F.lit(1)).alias("n_games"), F.sum("moves").alias("n_moves"))


def replay_moves(moves: Column, lines: Sequence[Sequence[int]], cells: int) -> tuple[Column, Column]:
    """States and actions of a game from a list of cells: moves are played until the game is over.

    The states are one more than the actions. Moves must name different cells.
    """
    empty = F.struct(F.array_repeat(F.lit(0), cells).alias("board"), F.lit(MARKS[0]).alias("mark"))
    kind = "struct<states:array<struct<board:array<int>,mark:string>>,actions:array<int>>"
    start = F.struct(F.array(empty).alias("states"), F.array().cast("array<int>").alias("actions")).cast(kind)

    def play(acc: Column, move: Column) -> Column:
        now = F.element_at(acc["states"], -1)
        go_on = status(now["board"], lines) == -1
        more = F.struct(F.concat(acc["states"], F.array(apply_move(now, move))).alias("states"), F.concat(acc["actions"], F.array(move)).alias("actions")).cast(kind)
        return F.when(go_on, more).otherwise(acc)

    game = F.aggregate(moves, start, play)
    return game["states"], game["actions"]
