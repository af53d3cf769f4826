"""Sampling, batching and value estimation: unit rows and properties."""

import math

from pyspark.sql import functions as F

from trajspark.operators import sampling as D
from trajspark.operators import value as VE


def test_holdout_disjoint_and_complete(spark):
    df = spark.range(200).select(F.col("id").alias("k"))
    train, test = D.holdout(df, ["k"], 30, seed=3)
    assert test.count() == 30
    assert train.join(test, "k").count() == 0
    assert train.count() + test.count() == 200
    r = D.leakage_report(train, test, ["k"]).first()
    assert (r.n_train, r.n_test, r.n_overlap) == (170, 30, 0)


def test_sample_n_above_count_is_an_error(spark):
    df = spark.range(5).select(F.col("id").alias("k"))
    try:
        D.sample_n(df, ["k"], 6)
    except ValueError:
        return
    raise AssertionError("expected ValueError")


def test_samples_are_the_first_rows_in_md5_order(spark, monkeypatch):
    import hashlib

    df = spark.createDataFrame([(i, f"v{i % 50}") for i in range(400)] + [(None, "x")], "k int, v string")
    order = lambda r: (hashlib.md5("|".join(["5", *(str(x) for x in r if x is not None)]).encode()).hexdigest(), r[0] is not None, r[0] or 0)
    rows = sorted(map(tuple, df.collect()), key=order)
    for exact in (10_000, 1):  # one counting pass, and as many as the digits need
        monkeypatch.setattr(D, "EXACT_ROWS", exact)
        monkeypatch.setattr(D, "COUNT_DIGITS", 1)
        for n in (0, 1, 100, 401):
            got = {tuple(r) for r in D.sample_n(df, ["k", "v"], n, seed=5).collect()}
            assert got == set(rows[:n])
        assert D.sample_ratio(df, ["k", "v"], 0.25, seed=5).count() == 100
    # rows that repeat tie on the whole md5
    same = spark.range(30).selectExpr("1 AS k")
    assert D.sample_n(same, ["k"], 7).count() == 7
    assert D.sample_n(same.limit(0), ["k"], 0).count() == 0


def test_dense_index_is_dense(spark):
    df = spark.range(1000).repartition(7).select(F.col("id").alias("k"))
    idx, total = D.with_index(df, [F.col("k")])
    rows = idx.select("k", "idx").collect()
    assert total == 1000 and sorted(r.idx for r in rows) == list(range(1000))
    assert all(r.k == r.idx for r in rows)


def test_wrap_around_batches(spark):
    df = spark.range(5).select(F.col("id").alias("k"))
    b = D.batches(df, ["k"], 4).collect()
    assert max(r.batch for r in b) == 1
    pads = sorted(r.k for r in b if r.is_pad)
    assert pads == [0, 1, 2] and sum(1 for r in b if r.batch == 1) == 4


def test_chunks_partition_each_key_exactly(spark):
    rows = [("hot", i) for i in range(23)] + [(None, i) for i in range(3)]
    df = spark.createDataFrame(rows, "key string, id int")
    exact = D.chunk(df, ["key"], ["id"], 5).collect()
    for digits in (1, 4):
        other = D.chunk(df, ["key"], ["id"], 5, salt_digits=digits).collect()
        assert {(r.key, r.id, r.chunk, r.pos) for r in exact} == {(r.key, r.id, r.chunk, r.pos) for r in other}
    hot = sorted((r.chunk, r.pos) for r in exact if r.key == "hot")
    assert hot == [(i // 5, i % 5) for i in range(23)]


def test_a_short_table_fills_its_only_batch(spark):
    df = spark.createDataFrame([(7,), (8,)], "k int")
    for size, n in ((4, 4), (5, 5), (2, 2)):
        b = D.batches(df, ["k"], size).collect()
        assert len(b) == n and {r.batch for r in b} == {0}
    assert sorted(r.k for r in D.batches(df, ["k"], 5).collect()) == [7, 7, 7, 8, 8]


def test_counts_regard_rows_with_null_parts(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", "x")], "p string, q string")
    assert tuple(D.distinct_counts(df, ["p", "q"]).first()) == (3, 2)
    from trajspark.operators import metrics as A

    assert tuple(A.key_counts(df, ["p", "q"]).first()) == (2, 3)
    assert tuple(A.key_counts(df, ["p", "q"], approx=True).first()) == (2, 3)


def test_epoch_plan_drops_short_minibatches(spark):
    df = spark.range(11).select(F.col("id").alias("k"))
    plan = D.epoch_plan(df, ["k"], workers=2, size=2, seed=1).collect()
    # worker 0 gets 6 rows → 3 minibatches; worker 1 gets 5 rows → 2 full minibatches
    per = {}
    for r in plan:
        per.setdefault((r.worker, r.minibatch), 0)
        per[(r.worker, r.minibatch)] += 1
    assert all(v == 2 for v in per.values()) and len(plan) == 10


def test_gae_reference_values(spark):
    rows = [("e", 0, 0.0, 0.1, 0.2, False), ("e", 1, 0.0, 0.2, 0.3, False), ("e", 2, 1.0, 0.3, 0.9, True)]
    df = spark.createDataFrame(rows, "ep string, step int, reward double, value double, next_value double, done boolean")
    got = [r.adv for r in VE.gae(df, ["ep"]).orderBy("step").collect()]
    for g, e in zip(got, [0.808406675, 0.75535, 0.7]):
        assert abs(g - e) < 1e-12


def test_gae_undiscounted_is_reward_to_go(spark):
    rows = [("e", i, float(i % 3), 0.0, 0.0, i == 9) for i in range(10)]
    df = spark.createDataFrame(rows, "ep string, step int, reward double, value double, next_value double, done boolean")
    got = [r.adv for r in VE.gae(df, ["ep"], gamma=1.0, lam=1.0).orderBy("step").collect()]
    rewards = [float(i % 3) for i in range(10)]
    assert got == [sum(rewards[i:]) for i in range(10)]


def test_gae_long_episode_matches_recursion(spark):
    n = 12000
    rows = [("e", i, math.sin(i) * 0.5, 0.1, 0.1, i % 5000 == 4999) for i in range(n)]
    df = spark.createDataFrame(rows, "ep string, step int, reward double, value double, next_value double, done boolean")
    got = [r.adv for r in VE.gae(df, ["ep"]).orderBy("step").collect()]
    adv, out = 0.0, [0.0] * n
    for t in reversed(range(n)):
        r, v, nv, d = rows[t][2], rows[t][3], rows[t][4], rows[t][5]
        delta = r + 0.99 * (0.0 if d else nv) - v
        adv = delta + 0.99 * 0.95 * (0.0 if d else 1.0) * adv
        out[t] = adv
    assert max(abs(a - b) for a, b in zip(got, out)) < 1e-9


# A garden of our own: a ring around a pond with a gate, G, and a dead end. '#' is closed.
GARDEN = """
#######
#..G..#
#.###.#
#.#...#
#.....#
#.##..#
#######
"""
MOVES = {"east": (0, 1), "north": (-1, 0), "south": (1, 0), "west": (0, -1)}


def _garden_edges(spark):
    rows = GARDEN.split()
    free = {(x, y): c for x, row in enumerate(rows) for y, c in enumerate(row) if c != "#"}
    edges = [
        (f"{x},{y}", f"{x + dx},{y + dy}", name, rank)
        for (x, y) in free
        for rank, (name, (dx, dy)) in enumerate(MOVES.items())
        if (x + dx, y + dy) in free
    ]
    goal = next(f"{x},{y}" for (x, y), c in free.items() if c == "G")
    return free, goal, spark.createDataFrame(edges, "src string, dst string, action string, dir_rank int")


def test_shortest_policy_walks_to_the_goal(spark, monkeypatch):
    free, goal, edges = _garden_edges(spark)
    goals = spark.createDataFrame([(goal,)], "node string")
    # distances by hand: rings of cells around the goal
    dist, ring = {goal: 0}, [tuple(map(int, goal.split(",")))]
    while ring:
        ring = [(x + dx, y + dy) for x, y in ring for dx, dy in MOVES.values() if (x + dx, y + dy) in free and f"{x + dx},{y + dy}" not in dist and not dist.update({f"{x + dx},{y + dy}": dist[f"{x},{y}"] + 1})]
    for tables, size in ((8, 32 << 20), (1, 0)):  # also with compaction and without a broadcast
        monkeypatch.setattr(VE, "SEEN_TABLES", tables)
        monkeypatch.setattr(VE, "BROADCAST_BYTES", size)
        pol = {r.node: (r.dist, r.move) for r in VE.shortest_policy(edges, goals, rank="dir_rank").collect()}
        assert {k: d for k, (d, _) in pol.items()} == dist and pol[goal][1] is None
        for node, (d, move) in pol.items():
            if move:
                x, y = map(int, node.split(","))
                closer = [m for m, (dx, dy) in MOVES.items() if dist.get(f"{x + dx},{y + dy}") == d - 1]
                assert move == closer[0]  # ties go by the fixed order of the moves
    opt = spark.createDataFrame([(k, m) for k, (_, m) in pol.items() if m], "node string, action string")
    pred = spark.createDataFrame([("1,1", "east"), ("1,5", "south"), ("4,1", None)], "node string, action string")
    acc = VE.move_accuracy(pred, opt, ["node"]).first()
    assert (acc.n, acc.n_parse_fail, acc.n_correct, acc.accuracy) == (3, 1, 1, 0.5)
    assert [(r.node, r.action) for r in VE.misses(pred, opt, ["node"]).collect()] == [("1,5", "south")]


def test_degrade_policy_keeps_share(spark):
    free, goal, edges = _garden_edges(spark)
    pol = VE.shortest_policy(edges, spark.createDataFrame([(goal,)], "node string"), rank="dir_rank")
    deg = VE.degrade_policy(pol, edges.select(F.col("src").alias("node"), "action"), p=1.0).collect()
    assert all(not r.is_random for r in deg) and len(deg) == len(free) - 1


def test_gae_terms_reach_over_many_blocks(spark, monkeypatch):
    """Small blocks and super-blocks: every later reward counts."""
    monkeypatch.setattr(VE, "SPAN", 3)
    n = 60
    rows = [(None if e else "e", i, 1.0 if i == n - 1 else 0.0, 0.0, 0.0, i in (20, n - 1)) for e in range(2) for i in range(n)]
    df = spark.createDataFrame(rows, "ep string, step int, reward double, value double, next_value double, done boolean")
    got = {(r.ep, r.step): r.adv for r in VE.gae(df, ["ep"], gamma=0.9, lam=0.8).collect()}
    for e in ("e", None):
        for i in range(n):
            want = 0.0 if i <= 20 else 0.72 ** (n - 1 - i)
            assert abs(got[e, i] - want) <= 1e-12 * max(want, 1e-30)
    assert len(got) == 2 * n


def test_backward_induction_and_greedy(spark):
    # root (max) → {a, b}; a (min) → {w (+5), l (−3)}, b (min) → {d (0)}
    nodes = spark.createDataFrame(
        [("root", True, None), ("a", False, None), ("b", False, None), ("w", True, 5.0), ("l", True, -3.0), ("d", True, 0.0)],
        "node string, maximize boolean, end_value double",
    )
    edges = spark.createDataFrame([("root", "a"), ("root", "b"), ("a", "w"), ("a", "l"), ("b", "d"), ("b", "d")], "node string, next_node string")
    vals = {r.node: r.value for r in VE.backward_induction(nodes, edges).collect()}
    assert vals["a"] == -3.0 and vals["b"] == 0.0 and vals["root"] == 0.0
    ch = spark.createDataFrame([("root", True, "a", -3.0), ("root", True, "b", 0.0)], "node string, maximize boolean, action string, value double")
    g = VE.greedy_actions(ch).collect()
    assert [(r.action, r.is_pick) for r in g] == [("b", True)]


def test_td0_two_sweeps(spark):
    tr = spark.createDataFrame([("a", "b", False, 0), ("b", "t", True, 1)], "state string, next_state string, next_terminal boolean, reward int")
    v = {r.state: r.value for r in VE.td0(tr, alpha=0.5, sweeps=2).collect()}
    # sweep 1: v(b) = 0.5; sweep 2: v(a) = 0.5 * 0.5 = 0.25, v(b) = 0.75
    assert v == {"a": 0.25, "b": 0.75, "t": 0.0}


def test_peeling_a_graph_with_nodes_at_several_depths(spark):
    """Rounds and the one-task rest agree with recursion; cycles, dead ends and edges into nowhere are defined."""
    import functools
    import random

    rng = random.Random(4)
    n = 60
    links = sorted({(f"n{i}", f"n{j}") for i in range(n) for j in rng.sample(range(i + 1, n), min(3, n - 1 - i)) if rng.random() < 0.9})
    ends = {f"n{i}": float(rng.randrange(-9, 9)) if i > n - 8 or rng.random() < 0.1 else None for i in range(n)}
    after = {}
    for a, b in links:
        after.setdefault(a, []).append(b)

    @functools.cache
    def value(x):
        seen = [v for v in map(value, after.get(x, ())) if v is not None] + ([ends[x]] if ends[x] is not None else [])
        return (max(seen) if int(x[1:]) % 2 else min(seen)) if seen else None

    cycle = [("c1", "c2"), ("c2", "c1"), ("c0", "c1"), ("c0", "n59"), ("c1", "nowhere")]
    rows = [(x, bool(int(x[1:]) % 2), e) for x, e in ends.items()] + [("c0", True, 1.0), ("c1", True, None), ("c2", False, 3.0)]
    nodes = spark.createDataFrame(rows, "node string, maximize boolean, end_value double")
    edges = spark.createDataFrame(links + cycle, "node string, next_node string")
    want = {**{x: value(x) for x in ends}, "c0": None, "c1": None, "c2": None}
    for size, rounds in ((1 << 20, 4), (0, 3), (1500, 1)):
        got = VE.backward_induction(nodes, edges, peel_bytes=size, rounds=rounds).collect()
        assert len(got) == len(want) and {r.node: r.value for r in got} == want
    none = VE.backward_induction(nodes.limit(0), edges.limit(0)).collect()
    assert none == []


def test_delta_sweeps_equal_full_sweeps_and_touch_fewer_states(spark):
    # a chain that ends in a reward, and a part that nothing happens in
    rows = [(f"c{i}", f"c{i + 1}", i == 11, 1 if i == 11 else 0) for i in range(12)] + [(f"d{i}", f"d{i + 1}", False, 0) for i in range(40)] + [("c0", "c2", False, 0)]
    tr = spark.createDataFrame(rows, "state string, next_state string, next_terminal boolean, reward int")
    for sweeps in (1, 5):
        got, log = VE.td0_delta(tr, alpha=0.5, max_sweeps=sweeps)
        full = VE.td0(tr, alpha=0.5, sweeps=sweeps)
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in full.collect()}
    assert log[0] == (52, 1) and all(n <= 6 for n, _ in log[1:]) and [m for _, m in log] == [1, 2, 3, 4, 5]
    got, log = VE.td0_delta(tr, alpha=1.0, tolerance=1e-9, max_sweeps=50)
    v = {r.state: r.value for r in got.collect()}
    assert all(v[f"c{i}"] == 1.0 for i in range(12)) and v["d0"] == v["c12"] == 0.0 and len(log) < 16 and log[-1][1] == 0


def test_gae_reads_the_next_blocks_where_nothing_is_left_of_later_ones(spark):
    n = 1500  # blocks of 432 steps at a discount of one half
    rows = [(None if e else "e", i, float(i % 7 == 0), 0.25, 0.5, i == 700) for e in range(2) for i in range(n)]
    df = spark.createDataFrame(rows, "ep string, step int, reward double, value double, next_value double, done boolean")
    got = {(r.ep, r.step): r.adv for r in VE.gae(df, ["ep"], gamma=0.5, lam=1.0).collect()}
    want, g = {}, 0.0
    for i in reversed(range(n)):
        done = i == 700
        g = float(i % 7 == 0) + (0 if done else 0.25) - 0.25 + (0 if done else 0.5 * g)
        want[i] = g
    assert len(got) == 2 * n and all(abs(got[e, i] - want[i]) < 1e-9 for e in ("e", None) for i in range(n))


def test_degraded_moves_are_uniform_draws(spark):
    """Every move of a node is drawn about equally often over many nodes; a hub's moves are combined before the shuffle."""
    n = 3000
    pol = spark.range(n).select(F.concat(F.lit("n"), "id").alias("node"), F.lit(1).alias("dist"), F.lit("m0").alias("move"))
    moves = pol.select("node", F.explode(F.array(*[F.lit(f"m{k}") for k in range(4)], F.lit("m3"))).alias("action"))
    got = VE.degrade_policy(pol, moves, p=0.0)
    assert got.where("is_random").count() == n
    share = {r["move"]: r["count"] / n for r in got.groupBy("move").count().collect()}
    assert set(share) == {"m0", "m1", "m2", "m3"} and all(abs(x - 0.25) < 0.04 for x in share.values())
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_no_task_sorts_more_moves_than_its_share(spark, monkeypatch):
    """A hub, a move that comes many times and many small nodes are dealt evenly; policy and draws stay the same."""
    hub = spark.range(400).select(F.lit("hub").alias("node"), F.concat(F.lit("x"), "id").alias("action"))
    again = spark.range(0, 800, 1, 8).select(F.lit("again").alias("node"), F.lit("y").alias("action"))
    small = spark.range(800).select(F.concat(F.lit("n"), "id").alias("node"), F.lit("hub").alias("action"))
    moves = hub.unionByName(again).unionByName(small)
    edges = moves.select(F.col("node").alias("src"), F.col("action").alias("dst"), "action")
    goals = spark.createDataFrame([("x1",), ("y",)], "node string")

    def run():
        pol = VE.shortest_policy(edges, goals)
        return sorted(map(tuple, pol.collect()), key=str), sorted(map(tuple, VE.degrade_policy(pol, moves, p=0.3).collect()))

    want = run()
    monkeypatch.setattr(VE, "SORT_ROWS", 200)
    dealt = VE._spread(moves, 2000, "node", "action")
    sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert dealt.rdd.getNumPartitions() == 10 and sum(sizes) == 2000 and max(sizes) < 2000 / 2
    assert run() == want
    pol = spark.createDataFrame([("hub", 1, "x1")], "node string, dist int, move string")
    assert "spark_partition_id" in VE.degrade_policy(pol, moves, p=0.3)._jdf.queryExecution().optimizedPlan().toString().lower()
