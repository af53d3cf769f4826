"""Value estimation (V1–V8).

GAE is computed with running windows instead of per-episode arrays, so an
episode never has to fit in one row. Iterative estimates (TD sweeps,
shortest-path frontier, backward induction by peeling) loop on the driver over small
per-round DataFrames and cut lineage with a reliable checkpoint each round.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.keys import seeded_key, seeded_uniform
from trajspark.operators.steps import _same, number_steps
from trajspark.session import cut_lineage, write_table


# A side whose size was just measured is broadcast up to so many bytes; above, the join shuffles.
BROADCAST_BYTES = 32 << 20


def _size(df: DataFrame, *cols: str) -> tuple[int, int]:
    """Rows, and bytes of the columns as text (with 16 a row for the rest)."""
    text = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in cols), F.lit(16))
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(text), F.lit(0))).first()
    return n, size


def _bounded_broadcast(df: DataFrame, n_bytes: int) -> DataFrame:
    return F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df


#: rows that one task sorts for a least-of aggregation (some 270 bytes a row, measured)
SORT_ROWS = 1 << 18


def _spread(df: DataFrame, n_rows: int, *cols: str) -> DataFrame:
    """Deal at most ``n_rows`` rows so that a task aggregates about ``SORT_ROWS`` of them.

    An aggregate that keeps a text is sorted, a task's rows at once, and their number a
    task grows with the input where small rows were packed into few partitions. The
    partition that a row comes from is part of the deal, so repeated rows are spread too.
    """
    n = -(-n_rows // SORT_ROWS)
    return df if n <= 1 else df.repartition(n, *cols, F.spark_partition_id())


#: steps of an episode that one task works through at once
SPAN = 4096
# Blocks that are composed as one list.
SUPER = 256


#: column with the 0-based number of a row among its episode's rows
POSITION = "own_step"


# V2 -------------------------------------------------------------------------
def next_values(own: DataFrame, ep: Sequence[str], order: str, value: str, final_value: str) -> DataFrame:
    """Next own-step value; the last own step takes the value of the final next state.

    ``order`` counts steps; a task holds the steps of a span of it, not an episode. The
    own steps' 0-based number stays as ``POSITION``, so that ``gae`` doesn't count again.
    """
    t = number_steps(own, ep, [order], value, F.floor(F.col(order) / SPAN), ahead=1, name=POSITION)
    return t.withColumn("next_value", F.coalesce("_next1", F.col(final_value))).drop("_next1")


# V1 -------------------------------------------------------------------------
def gae(
    df: DataFrame,
    ep: Sequence[str],
    order: str = "step",
    reward: str = "reward",
    value: str = "value",
    next_value: str = "next_value",
    done: str = "done",
    gamma: float = 0.99,
    lam: float = 0.95,
) -> DataFrame:
    """Generalised advantage and returns per episode, reset at ``done``.

    gae_t = δ_t + γλ(1 − done_t)·gae_{t+1},  δ_t = r_t + γ·(done_t ? 0 : v'_t) − v_t.

    A suffix scan in blocks: inside a block gae_t = a_t + b_t·G with G the advantage at
    the next block's start (b = 0 behind a done); a_t and b_t come from windows over one
    block. Where a block's (γλ)^length is so small that three blocks leave nothing of a
    double, G is read off the next three blocks. Otherwise blocks compose in the same
    way, first inside super-blocks of ``SUPER`` blocks, then over an episode's
    super-blocks (one for every million steps). So every term is kept and no task holds
    a long episode. A column ``POSITION`` (see ``next_values``) saves the numbering.
    """
    rho = gamma * lam
    block = SPAN if rho >= 1 or rho <= 0 else max(1, min(SPAN, int(300.0 / -math.log(rho))))
    d = F.coalesce(F.col(done).cast("boolean"), F.lit(False))
    t = df.withColumn(
        "_delta", F.col(reward).cast("double") + F.when(d, F.lit(0.0)).otherwise(F.lit(gamma) * F.col(next_value)) - F.col(value)
    ).withColumn("_done", d)
    if POSITION in df.columns:
        t = t.withColumnRenamed(POSITION, "_pos")
    else:
        t = number_steps(t, ep, [order], "_done", F.floor(F.col(order) / SPAN), ahead=1, name="_pos").drop("_next1")
    t = t.withColumn("_blk", F.floor(F.col("_pos") / F.lit(block))).withColumn("_off", F.col("_pos") - F.col("_blk") * block)
    blk = Window.partitionBy(*ep, "_blk")
    t = t.withColumn("_seg", F.coalesce(F.sum(F.col("_done").cast("int")).over(blk.orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = Window.partitionBy(*ep, "_blk", "_seg").orderBy(F.col("_pos").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weight = F.pow(F.lit(rho), F.col("_off")) if rho else F.when(F.col("_off") == 0, 1.0).otherwise(0.0)
    later = F.sum(F.col("_done").cast("int")).over(blk.orderBy(F.col("_pos").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if rho:
        t = t.withColumn("_a", F.sum(F.col("_delta") * weight).over(run) / weight)
        t = t.withColumn("_b", F.when(later > 0, 0.0).otherwise(F.pow(F.lit(rho), F.max("_off").over(blk) + 1 - F.col("_off"))))
    else:
        t = t.withColumn("_a", F.col("_delta")).withColumn("_b", F.lit(0.0))

    def scan(rows: DataFrame, keys: list[str], at: str, a: str, b: str) -> DataFrame:
        """Per row of a group in descending ``at``: the composition (ca, cb) of all later rows, and of the whole group (wa, wb)."""
        g = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), F.col(a).alias("a"), F.col(b).alias("b"))), asc=False).alias("_l"))
        zero = F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), F.array().cast("array<struct<at:bigint,a:double,b:double>>").alias("out"))
        step = lambda acc, x: F.struct(
            (x["a"] + x["b"] * acc["a"]).alias("a"), (x["b"] * acc["b"]).alias("b"),
            F.concat(acc["out"], F.array(F.struct(x["at"].cast("bigint").alias("at"), acc["a"].alias("a"), acc["b"].alias("b")))).alias("out"),
        )
        g = g.withColumn("_f", F.aggregate("_l", zero, step))
        return g.select(*keys, F.explode("_f.out").alias("_x"), F.col("_f.a").alias("wa"), F.col("_f.b").alias("wb")).select(
            *keys, F.col("_x.at").alias(at), F.col("_x.a").alias("ca"), F.col("_x.b").alias("cb"), "wa", "wb"
        )

    heads = t.where(F.col("_off") == 0)
    if not rho or block * -math.log(rho) > 250:  # e^-750 of anything is below the smallest double
        w = Window.partitionBy(*ep).orderBy("_blk")
        a, b = [[F.coalesce(F.lead(c, i).over(w), F.lit(0.0)) for i in (1, 2, 3)] for c in ("_a", "_b")]
        carry = heads.select(*[F.col(k).alias(f"_c_{k}") for k in [*ep, "_blk"]], (a[0] + b[0] * (a[1] + b[1] * a[2])).alias("_g"), F.lead("_a").over(w).isNotNull().alias("_more"))
        carry = carry.where("_more").drop("_more")
    else:
        inner = scan(heads.select(*ep, "_blk", F.floor(F.col("_blk") / SUPER).alias("_sup"), "_a", "_b"), [*ep, "_sup"], "_blk", "_a", "_b")
        outer = scan(inner.groupBy(*ep, "_sup").agg(F.first("wa").alias("_a"), F.first("wb").alias("_b")), list(ep), "_sup", "_a", "_b")
        outer = outer.select(*[F.col(k).alias(f"_u_{k}") for k in [*ep, "_sup"]], F.col("ca").alias("_h"))
        carry = inner.join(outer, _same(inner, outer, [*ep, "_sup"], lambda c: f"_u_{c}"))
        carry = carry.select(*[F.col(k).alias(f"_c_{k}") for k in [*ep, "_blk"]], (F.col("ca") + F.col("cb") * F.col("_h")).alias("_g"))
    t = t.join(carry, _same(t, carry, [*ep, "_blk"], lambda c: f"_c_{c}"), "left").withColumn("_g", F.coalesce("_g", F.lit(0.0)))
    t = t.withColumn("adv", F.col("_a") + F.col("_b") * F.col("_g"))
    t = t.withColumn("ret", F.col("adv") + F.col(value))
    return t.drop(*[c for c in t.columns if c.startswith("_")])


# V3 -------------------------------------------------------------------------
def td0(transitions: DataFrame, alpha: float = 0.4, sweeps: int = 1, init: float = 0.0) -> DataFrame:
    """Batch TD(0): ``sweeps`` synchronous sweeps of v(s) += α·(mean target − v(s)).

    target = r + v(s'), and r alone when s' is terminal. Re-aimed from the
    play-order update to synchronous sweeps. Transitions are first reduced to
    (s, s') pairs with counts and reward sums (one shuffle), so each sweep
    joins a table bounded by the state space, not by the log.
    """
    pairs = transitions.groupBy("state", "next_state", "next_terminal").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("reward").cast("double")).alias("r_sum")
    )
    pairs = cut_lineage(pairs)
    visits = pairs.groupBy("state").agg(F.sum("n").alias("visits"))
    states = pairs.select("state").union(pairs.select(F.col("next_state").alias("state"))).distinct()
    v = write_table(states.withColumn("value", F.lit(float(init))), "td-values")
    for _ in range(sweeps):
        nv = v.select(F.col("state").alias("next_state"), F.col("value").alias("nv"))
        tgt = pairs.join(nv, "next_state", "left").select(
            "state",
            "n",
            (F.col("r_sum") + F.when(F.col("next_terminal"), F.lit(0.0)).otherwise(F.coalesce("nv", F.lit(0.0)) * F.col("n"))).alias(
                "t_sum"
            ),
        )
        mean_t = tgt.groupBy("state").agg((F.sum("t_sum") / F.sum("n")).alias("target"))
        v = write_table(
            v.join(mean_t, "state", "left").select(
                "state",
                F.when(F.col("target").isNull(), F.col("value"))
                .otherwise(F.col("value") + F.lit(alpha) * (F.col("target") - F.col("value")))
                .alias("value"),
            ),
            "td-values",
        )
    return v.join(visits, "state", "left").select("state", "value", F.coalesce("visits", F.lit(0)).alias("visits"))


def td0_delta(
    transitions: DataFrame, alpha: float = 0.4, tolerance: float = 0.0, max_sweeps: int = 100, init: float = 0.0
) -> tuple[DataFrame, list[tuple[int, int]]]:
    """TD(0) driven by changes: (values, [(states recomputed, states moved) per sweep]).

    The sweeps of ``td0``, but a state is recomputed only when one of its successors, or
    its own value, moved by more than ``tolerance`` in the sweep before: nothing else can
    change. With a tolerance of 0 the values equal those of as many full sweeps. It
    ends when no state moves, or after ``max_sweeps``. Rows as of ``td0``.

    Transitions are reduced to (s, s') pairs once. A sweep reads the pairs of the
    states to recompute, and writes their values beside the table; the table is written
    anew when as many rows lie beside it as in it.
    """
    pairs = write_table(
        transitions.groupBy("state", "next_state", "next_terminal").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("reward").cast("double")).alias("r_sum")), "td-pairs"
    )
    states = pairs.select("state").union(pairs.select(F.col("next_state").alias("state"))).distinct()
    start = F.lit(float(init))
    base = write_table(states.select("state", start.alias("value"), F.lit(0).alias("sweep")), "td-values")
    n_base, beside, n_beside = base.count(), None, 0
    links = pairs.select("state", "next_state")
    due, log = pairs.select("state").distinct(), []
    for sweep in range(1, max_sweeps + 1):
        every = base if beside is None else base.unionByName(beside)
        v = every.groupBy("state").agg(F.max_by("value", "sweep").alias("value")) if beside is not None else base.select("state", "value")
        mine = pairs.join(due, "state", "left_semi") if sweep > 1 else pairs
        to = v.select(F.col("state").alias("next_state"), F.col("value").alias("nv"))
        then = F.when(F.col("next_terminal"), 0.0).otherwise(F.coalesce("nv", F.lit(0.0)) * F.col("n"))
        target = mine.join(to, "next_state", "left").groupBy("state").agg((F.sum(F.col("r_sum") + then) / F.sum("n")).alias("target"))
        changed = target.join(v, "state").select(
            "state", (F.col("value") + alpha * (F.col("target") - F.col("value"))).alias("value"), F.lit(sweep).alias("sweep"), F.col("value").alias("before")
        )
        changed = write_table(changed, "td-delta")
        moved = changed.where(F.abs(F.col("value") - F.col("before")) > tolerance).select("state", "value", "sweep")
        got = changed.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("value") - F.col("before")) > tolerance).alias("m")).first()
        log.append((got["n"], got["m"]))
        if not got["m"]:
            break
        beside = moved if beside is None else beside.unionByName(moved)
        n_beside += got["m"]
        if n_beside >= n_base or sweep % SEEN_TABLES == 0:
            base = write_table(base.unionByName(beside).groupBy("state").agg(F.max_by("value", "sweep").alias("value"), F.max("sweep").alias("sweep")), "td-values")
            beside, n_beside = None, 0
        names = moved.select("state")
        due = names.union(links.join(names.select(F.col("state").alias("next_state")), "next_state", "left_semi").select("state")).distinct()
    every = base if beside is None else base.unionByName(beside)
    last = every.groupBy("state").agg(F.max_by("value", "sweep").alias("value"))
    visits = pairs.groupBy("state").agg(F.sum("n").alias("visits"))
    return last.join(visits, "state", "left").select("state", "value", F.coalesce("visits", F.lit(0)).alias("visits")), log


# V4 -------------------------------------------------------------------------
#: rounds kept as tables of their own before they are written as one
SEEN_TABLES = 8


def shortest_policy(
    edges: DataFrame, goals: DataFrame, rank: str = "action", max_rounds: int | None = None
) -> DataFrame:
    """Multi-source shortest-path policy on an edge table (src, dst, action).

    Breadth-first frontier from the goals over reversed edges; each newly
    reached node records its distance and its first move: the action of an
    edge into the previous frontier, ties broken by ``rank`` (the fixed
    direction order). Stops when the frontier is empty (or at ``max_rounds``).
    """
    # the edges are read in place each round; a hub's edges stay spread over the table's
    # partitions while the frontier is broadcast, and AQE splits them when it is joined
    e = write_table(edges.select("src", "dst", "action", F.col(rank).alias("_rank")), "bfs-edges")
    n_edges = e.count()
    first = goals.select("node", F.lit(0).alias("dist"), F.lit(None).cast("string").alias("move"))
    rounds = [write_table(first, "bfs-round")]
    frontier = rounds[0]
    n_new, front_bytes = _size(frontier, "node")
    seen_bytes = front_bytes
    d = 0
    while n_new and (max_rounds is None or d < max_rounds):
        seen = rounds[0]
        for r in rounds[1:]:
            seen = seen.unionByName(r)
        front = frontier.select(F.col("node").alias("dst"))
        cand = e.join(_bounded_broadcast(front, front_bytes), "dst").select(F.col("src").alias("node"), "action", "_rank")
        # partial aggregation first: a node that many edges reach is one row per task
        best = _spread(cand, n_edges, "node", "action").groupBy("node").agg(F.min_by("action", F.struct("_rank", "action")).alias("move"))
        new = best.join(_bounded_broadcast(seen.select("node"), seen_bytes), "node", "left_anti")
        frontier = write_table(new.select("node", F.lit(d + 1).alias("dist"), "move"), "bfs-round")
        n_new, front_bytes = _size(frontier, "node")
        if not n_new:
            break
        d += 1
        seen_bytes += front_bytes
        rounds.append(frontier)
        if len(rounds) > SEEN_TABLES:  # keep few tables to read: one holds all older rounds
            older = rounds[0]
            for r in rounds[1:-1]:
                older = older.unionByName(r)
            rounds = [write_table(older, "bfs-seen"), frontier]
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


# V5 -------------------------------------------------------------------------
def degrade_policy(policy: DataFrame, moves: DataFrame, p: float, seed: int | str = 42) -> DataFrame:
    """With probability 1 − p replace a node's move by a uniform draw from its moves.

    ``moves`` is (node, action). The draw is the move with the least seeded key: one
    partial aggregate, so a hub's moves are combined before they meet and no
    task holds, ranks or counts them. Repeated moves are drawn as one. The moves are
    written once, and dealt so that a task sorts a bounded number of them.
    """
    moves = write_table(moves.select("node", "action"), "moves")
    u_keep = seeded_uniform(seed, ["node"])
    pol = policy.where(F.col("move").isNotNull()).select("node", "dist", "move", u_keep.alias("_uk"))
    drawn = _spread(moves, moves.count(), "node", "action").groupBy("node").agg(F.min_by("action", F.struct(seeded_key(f"{seed}|pick", ["node", "action"]), "action")).alias("action"))
    j = pol.join(drawn, "node")
    return j.select(
        "node",
        "dist",
        F.when(F.col("_uk") < p, F.col("move")).otherwise(F.col("action")).alias("move"),
        (F.col("_uk") >= p).alias("is_random"),
    )


# V6 -------------------------------------------------------------------------
#: what is left of a graph is settled by one task when it has no more bytes than this (measured)
PEEL_BYTES = 32 << 20
#: peeled rounds that are planned as one job
PEEL_ROUNDS = 4


def _best(maximize: Column, hi: Column, lo: Column, end: Column) -> Column:
    return F.when(maximize, F.greatest(hi, end)).otherwise(F.least(lo, end))


def _peel_rest(pdf):
    """Settle a whole small graph: a node is done when the counter of its open successors is 0."""
    import pandas as pd

    is_edge = pdf["next_node"].notna().to_numpy()
    nodes, edges = pdf[~is_edge], pdf[is_edge]
    left = dict(zip(nodes["node"], nodes["left"]))
    bounds = {n: ([] if x != x else [x], [] if y != y else [y], m, None if e != e else e) for n, x, y, m, e in zip(nodes["node"], nodes["hi"], nodes["lo"], nodes["maximize"], nodes["end_value"])}
    before: dict[str, list[str]] = {}
    for n, to in zip(edges["node"], edges["next_node"]):
        before.setdefault(to, []).append(n)
    ready = [n for n, k in left.items() if k == 0]
    value = {}
    for n in ready:  # grows while it is read
        hi, lo, maximize, end = bounds[n]
        seen = (hi if maximize else lo) + ([] if end is None else [end])
        value[n] = (max(seen) if maximize else min(seen)) if seen else None
        for p in before.get(n, ()):
            if value[n] is not None:
                bounds[p][0].append(value[n])
                bounds[p][1].append(value[n])
            left[p] -= 1
            if left[p] == 0:
                ready.append(p)
    return pd.DataFrame({"node": list(bounds), "maximize": [bounds[n][2] for n in bounds], "value": pd.Series([value.get(n) for n in bounds], dtype="float64")})


def backward_induction(nodes: DataFrame, edges: DataFrame, peel_bytes: int = PEEL_BYTES, rounds: int = PEEL_ROUNDS) -> DataFrame:
    """Best value per node of any transition graph, from its ends back.

    nodes: (node, maximize, end_value) with end_value null when the node never ends a
    game; edges: (node, next_node). value = max (maximizing player) or min over successor
    values and the node's own end value. A node may be reached at several depths.

    Rounds peel the graph: every node whose successors are all settled (a counter of open
    ones) is settled, and its value goes to its predecessors as one aggregate, so a hub
    costs a partial aggregation. ``rounds`` rounds are a job, whose result is written; what
    is left is measured, and one task settles the rest as soon as that is small. Nodes on
    cycles, or that lead into one, have no value. Edges into unknown nodes don't count;
    nodes are distinct, edges are made so.
    """
    nodes = nodes.select(F.col("node").cast("string").alias("node"), "maximize", F.col("end_value").cast("double").alias("end_value"))
    edges = edges.select(F.col("node").cast("string").alias("node"), F.col("next_node").cast("string").alias("next_node")).distinct()
    known = nodes.select(F.col("node").alias("next_node"))
    edges = write_table(edges.join(known, "next_node", "left_semi"), "peel-edges")
    none = F.lit(None).cast("double")
    out_degree = edges.groupBy("node").agg(F.count(F.lit(1)).alias("left"))
    pending = nodes.join(out_degree, "node", "left").select("node", "maximize", "end_value", F.coalesce("left", F.lit(0)).alias("left"), none.alias("hi"), none.alias("lo"))
    pending = write_table(pending, "peel")
    text = F.octet_length("node") + F.lit(32)
    done: list[DataFrame] = []
    while True:
        got = pending.agg(F.sum(text).alias("bytes"), F.count_if(F.col("left") == 0).alias("ready")).first()
        size = (got["bytes"] or 0) + (edges.agg(F.sum(text + F.octet_length("next_node")).alias("bytes")).first()["bytes"] or 0)
        if not got["ready"] or size <= peel_bytes:
            break
        settled = None
        for _ in range(rounds):
            ready = pending.where("left = 0").withColumn("value", _best(F.col("maximize"), F.col("hi"), F.col("lo"), F.col("end_value")))
            sent = edges.join(ready.select(F.col("node").alias("next_node"), "value"), "next_node").groupBy("node").agg(
                F.count(F.lit(1)).alias("n"), F.max("value").alias("smax"), F.min("value").alias("smin")
            )
            pending = pending.where("left > 0").join(sent, "node", "left").select(
                "node", "maximize", "end_value", (F.col("left") - F.coalesce("n", F.lit(0))).alias("left"), F.greatest("hi", "smax").alias("hi"), F.least("lo", "smin").alias("lo")
            )
            ready = ready.select("node", "maximize", "end_value", F.lit(-1).cast("bigint").alias("left"), F.col("value").alias("hi"), "lo")
            settled = ready if settled is None else settled.unionByName(ready)
        step = write_table(settled.unionByName(pending), "peel")
        done.append(step.where("left < 0").select("node", "maximize", F.col("hi").alias("value")))
        pending = step.where("left >= 0")
        edges = write_table(edges.join(pending.select("node"), "node", "left_semi").join(pending.select(F.col("node").alias("next_node")), "next_node", "left_semi"), "peel-edges")
    columns = ["node", "maximize", "end_value", "left", "hi", "lo"]
    if got["ready"]:
        links = edges.select("node", *[F.lit(None).cast(pending.schema[c].dataType).alias(c) for c in columns[1:]], "next_node")
        rest = pending.select(*columns, F.lit(None).cast("string").alias("next_node")).unionByName(links)
        rest = write_table(rest.withColumn("whole", F.lit(0)).groupBy("whole").applyInPandas(_peel_rest, "node string, maximize boolean, value double"), "peel-values")
    else:
        rest = pending.select("node", "maximize", none.alias("value"))
    for d in done:
        rest = rest.unionByName(d)
    return rest


# V7 -------------------------------------------------------------------------
def greedy_actions(choices: DataFrame, seed: int | str = 42) -> DataFrame:
    """All actions whose successor value is best for the mover, plus one seeded pick.

    choices: (node, maximize, action, value). Output adds ``is_best`` rows only
    and ``is_pick`` for the seeded tie-break.
    """
    signed = F.when(F.col("maximize"), F.col("value")).otherwise(-F.col("value"))
    w = Window.partitionBy("node").orderBy(signed.desc())
    best = choices.withColumn("_rk", F.rank().over(w)).where(F.col("_rk") == 1).drop("_rk")
    tie = seeded_key(seed, ["node", "action"])
    wp = Window.partitionBy("node").orderBy(tie, "action")
    return best.withColumn("is_pick", F.row_number().over(wp) == 1)


# V8 -------------------------------------------------------------------------
def move_accuracy(pred: DataFrame, optimal: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chosen action vs the optimal set: counts, accuracy, parse failures apart.

    pred: (keys…, action) with null action = parse failure; optimal: (keys…, action).
    """
    opt = optimal.select(*keys, "action").distinct().withColumn("_ok", F.lit(True))
    j = pred.join(opt, [*keys, "action"], "left")
    return j.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("action").isNull()).alias("n_parse_fail"),
        F.count_if(F.col("_ok")).alias("n_correct"),
    ).withColumn(
        "accuracy",
        F.round(F.col("n_correct") / F.nullif(F.col("n") - F.col("n_parse_fail"), F.lit(0)), 6),
    )


def misses(pred: DataFrame, optimal: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predictions that are parsed but not optimal."""
    opt = optimal.select(*keys, "action").distinct()
    return pred.where(F.col("action").isNotNull()).join(opt, [*keys, "action"], "left_anti")
