"""Aggregations, metrics and ranking.

Per-episode facts are computed with one partial aggregate keyed by the
episode (map-side combine, so a hot episode costs one row per task), then
rolled up again on a small key. Whole-table statistics are scalar
subqueries, never an unpartitioned window or a cross join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.keys import joint_key

from trajspark.operators.steps import WS
from trajspark.session import cut_lineage


def _r(c: Column, d: int = 6) -> Column:
    return F.round(c, d)


def episode_facts(steps: DataFrame, ep: Sequence[str], order: str = "step", extra: Sequence[str] = ()) -> DataFrame:
    """First state/turn, final reward, return, length per episode with at least one action."""
    has_action = F.col("action").isNotNull()
    return (
        steps.groupBy(*ep, *extra)
        .agg(
            F.min_by("state", order).alias("first_state"),
            F.min_by("turn", order).alias("first_turn"),
            F.max_by("reward", F.when(has_action, F.col(order))).alias("final_reward"),
            F.sum("reward").alias("ep_return"),
            F.count("action").alias("n_actions"),
        )
        .where(F.col("n_actions") > 0)
    )


# A1 -------------------------------------------------------------------------
def win_rate(steps: DataFrame, ep: Sequence[str], order: str = "step") -> DataFrame:
    """Monte-Carlo label per (first state, first turn): mean final reward; black if the sum ≥ 0."""
    return win_rate_of(episode_facts(steps, ep, order))


def win_rate_of(f: DataFrame) -> DataFrame:
    """A1 over per-episode facts (first_state, first_turn, final_reward)."""
    return f.groupBy("first_state", "first_turn").agg(
        F.when(F.sum("final_reward") >= 0, F.lit("black")).otherwise(F.lit("white")).alias("win"),
        _r(F.avg("final_reward")).alias("win_rate"),
        F.count(F.lit(1)).alias("n_games"),
    )


# A2 / A3 --------------------------------------------------------------------
def _outcome_cols(f: DataFrame) -> list[Column]:
    ours = F.col("first_turn")
    r = F.col("final_reward")
    signed = F.when(ours, r).otherwise(-r)
    return [
        _r(F.avg(signed)).alias("avg_return"),
        _r(F.avg(F.when(signed == 1, 1.0).otherwise(0.0))).alias("avg_win"),
        _r(F.avg(F.when(r == 0, 1.0).otherwise(0.0))).alias("avg_tie"),
        _r(F.avg(F.when(signed == -1, 1.0).otherwise(0.0))).alias("avg_lose"),
        F.count(F.lit(1)).alias("num_episode"),
    ]


def episode_outcomes(steps: DataFrame, ep: Sequence[str], order: str = "step") -> DataFrame:
    """Mean return and win/tie/loss rates from our side; empty input gives nulls and 0."""
    return outcomes_of(episode_facts(steps, ep, order))


def outcomes_by_iteration(steps: DataFrame, ep: Sequence[str], order: str = "step", it: str = "iter") -> DataFrame:
    return outcomes_of(episode_facts(steps, ep, order, extra=[it]), [it])


def outcomes_of(f: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A2 (no ``by``) / A3 (``by`` = iteration) over per-episode facts."""
    return (f.groupBy(*by) if by else f).agg(*_outcome_cols(f))


# A4 -------------------------------------------------------------------------
def key_counts(df: DataFrame, keys: Sequence[str], approx: bool = False) -> DataFrame:
    """Unique keys and total rows (``approx`` uses HyperLogLog++ for very large inputs)."""
    distinct = F.approx_count_distinct(F.struct(*keys)) if approx else F.count_distinct(F.struct(*keys))
    return df.agg(distinct.alias("n_unique"), F.count(F.lit(1)).alias("n_pairs"))


#: log2 of the registers of a stored sketch: relative error about 1.04 / sqrt(2**12) = 1.6 %
SKETCH_LG_K = 12


def key_sketches(df: DataFrame, it_col: str, keys: Sequence[str], lg_k: int = SKETCH_LG_K) -> DataFrame:
    """One mergeable sketch per iteration: (it_col, sketch, n_pairs). Store it; ``window_key_counts`` reads it.

    A sketch has at most 2**lg_k registers however many keys there are, and partial
    sketches are merged in the shuffle. Rows with a null key part count as a key of their own.
    """
    return df.groupBy(it_col).agg(F.hll_sketch_agg(joint_key(keys), F.lit(lg_k)).alias("sketch"), F.count(F.lit(1)).alias("n_pairs"))


def window_key_counts(sketches: DataFrame, it_col: str, history: int) -> DataFrame:
    """Unique keys and total rows of each iteration's history window (iterations i + 1 - history … i), from the stored sketches.

    A sketch goes to the ``history`` windows that it lies in, and a window's are merged; the rows are not read again.
    """
    until = F.explode(F.sequence(F.col(it_col), F.col(it_col) + history - 1))
    ends = sketches.select(F.col(it_col).alias("_e"))
    w = sketches.select(until.alias("_i"), "sketch", "n_pairs").join(ends, F.col("_i") == F.col("_e"), "left_semi")
    return w.groupBy(F.col("_i").alias(it_col)).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_unique"), F.sum("n_pairs").alias("n_pairs")
    )


# A5 -------------------------------------------------------------------------
def interaction_summary(episodes: DataFrame, start: str, cols: Sequence[str]) -> DataFrame:
    """mean / population std / min / max of each column per start point, plus a macro row.

    The macro row (start = '__macro__') averages the per-start statistics,
    which a rollup over the episodes (the micro average) would not give. The
    rollup here runs over the small per-start table instead: its detail rows
    average one row (the value itself) and its grand-total row is the macro
    average, so the input is aggregated once (a union of the per-start rows
    and a second aggregate over them would compute the input twice).
    """
    stats = []
    for c in cols:
        x = F.col(c).cast("double")
        stats += [
            _r(F.avg(x)).alias(f"{c}_mean"),
            _r(F.stddev_pop(x)).alias(f"{c}_std"),
            _r(F.min(x)).alias(f"{c}_min"),
            _r(F.max(x)).alias(f"{c}_max"),
        ]
    per = episodes.groupBy(F.col(start).cast("string").alias("start")).agg(
        *stats, F.count(F.lit(1)).alias("n_episodes")
    )
    names = [c for c in per.columns if c not in ("start", "n_episodes")]
    r = per.rollup("start").agg(
        *[_r(F.avg(n)).alias(n) for n in names], F.sum("n_episodes").alias("n_episodes"), F.grouping_id().alias("_g")
    )
    label = F.when(F.col("_g") == 1, F.lit("__macro__")).otherwise(F.col("start"))
    return r.select(label.alias("start"), *names, "n_episodes")


# A6 -------------------------------------------------------------------------
def vote(df: DataFrame, state: str, cand: str, k: int, sample_idx: str = "sample_idx") -> DataFrame:
    """Top-k candidates per state by count; ties go to the first appearance."""
    g = df.groupBy(state, cand).agg(F.count(F.lit(1)).alias("n_votes"), F.min(sample_idx).alias("first_seen"))
    w = Window.partitionBy(state).orderBy(F.col("n_votes").desc(), F.col("first_seen"))
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# A7 -------------------------------------------------------------------------
def masked_stats(df: DataFrame, keys: Sequence[str], xs: str, mask: Column | str, n: Column | None = None) -> DataFrame:
    """Statistics of an array column over the elements whose mask is true.

    ``mask`` is an array of booleans or numbers as long as ``xs`` (null: false). mean =
    sum(x·mask)/n with n the full length unless given; min, max and population std are
    over the kept elements (null when none is kept, or n is 0). The std is taken around
    the kept mean in a second pass, so large offsets don't cancel. Pure per-row array
    work: no shuffle at all.
    """
    m = F.col(mask) if isinstance(mask, str) else mask
    pairs = F.arrays_zip(F.transform(F.col(xs), lambda x: x.cast("double")).alias("x"), F.transform(m, lambda b: F.coalesce(b.cast("boolean"), F.lit(False))).alias("m"))
    t = df.withColumn("_kept", F.transform(F.filter(pairs, lambda p: p["m"]), lambda p: p["x"]))
    t = t.withColumn("_m", F.size("_kept")).withColumn("_s", F.aggregate("_kept", F.lit(0.0), lambda a, x: a + x))
    t = t.withColumn("_mu", F.col("_s") / F.nullif(F.col("_m"), F.lit(0)))
    t = t.withColumn("_v", F.aggregate("_kept", F.lit(0.0), lambda a, x: a + (x - F.col("_mu")) * (x - F.col("_mu"))))
    size = n if n is not None else F.size(xs)
    return t.select(
        *keys,
        _r(F.col("_s") / F.nullif(size, F.lit(0))).alias("mean"),
        _r(F.array_min("_kept")).alias("min"),
        _r(F.array_max("_kept")).alias("max"),
        _r(F.sqrt(F.col("_v") / F.nullif(F.col("_m"), F.lit(0)))).alias("std"),
        F.col("_m").alias("n_kept"),
        size.alias("n"),
    )


def unpad(xs: Column, mask: Column) -> Column:
    """The array up to its first masked-out position."""
    first = F.array_position(F.transform(mask, lambda b: F.coalesce(b.cast("boolean"), F.lit(False))), F.lit(False))
    return F.when(first > 0, F.slice(xs, 1, (first - 1).cast("int"))).otherwise(xs)


# A8 -------------------------------------------------------------------------
def outcome_counts(facts: DataFrame, group: str, outcome: str = "final_reward") -> DataFrame:
    """Benchmark outcome counts per group: +1 win, −1 loss, the rest draws."""
    o = F.col(outcome)
    return facts.groupBy(group).agg(
        F.count_if(o == 1).alias("n_win"),
        F.count_if(o == -1).alias("n_loss"),
        F.count_if((o != 1) & (o != -1)).alias("n_draw"),
    )


# A10 ------------------------------------------------------------------------
def token_cost(
    turns: DataFrame,
    run: str,
    order: str,
    is_output: Column,
    price_in: float = 0.03,
    price_out: float = 0.06,
    tokens: Column | None = None,
) -> DataFrame:
    """Input/output tokens, cost per call and cumulative cost per run.

    Prices are per 1,000 tokens. ``tokens`` defaults to whitespace tokens.
    """
    if tokens is None:
        tokens = F.size(F.filter(F.split(F.col("text"), WS), lambda x: x != ""))
    t = turns.select(
        run,
        order,
        F.when(is_output, F.lit(0)).otherwise(tokens).alias("in_tokens"),
        F.when(is_output, tokens).otherwise(F.lit(0)).alias("out_tokens"),
    )
    cost = F.col("in_tokens") * F.lit(price_in) / 1000 + F.col("out_tokens") * F.lit(price_out) / 1000
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("cost", cost)
    return t.select(
        run,
        order,
        "in_tokens",
        "out_tokens",
        _r(F.col("cost")).alias("cost"),
        F.sum("in_tokens").over(w).alias("cum_in_tokens"),
        F.sum("out_tokens").over(w).alias("cum_out_tokens"),
        _r(F.sum("cost").over(w)).alias("cum_cost"),
    )


# A11 ------------------------------------------------------------------------
def normalise(df: DataFrame, x: str, out: str | None = None, eps: float = 1e-8) -> DataFrame:
    """(x − mean) / (sample std + eps) over the whole table, via scalar subqueries."""
    # one scalar subquery carrying both statistics (a second one would rerun the input)
    stats = df.agg(F.struct(F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).alias("st")).scalar()
    return df.withColumn(out or f"{x}_norm", (F.col(x) - stats["m"]) / (stats["s"] + F.lit(eps)))


# Running aggregates ---------------------------------------------------------
def running_stats(df: DataFrame, order: Sequence[str], value: str, prefix: str = "running") -> DataFrame:
    """Running sum, count, mean and max of ``value`` in a global order, without a
    single-partition window.

    Distributed range sort → reliable checkpoint (fixes partition contents) →
    one total per partition reaches the driver → a window per partition id
    (JVM-side) continues from its partition's offset, joined from a table with one
    row per partition. Work and memory per task stay
    bounded whatever the row count.
    """
    srt = cut_lineage(df.orderBy(*order).withColumn("_pid", F.spark_partition_id()))
    x = F.col(value).cast("double")
    tot = {
        r["_pid"]: (r["s"] or 0.0, r["n"], r["m"])
        for r in srt.groupBy("_pid").agg(F.sum(x).alias("s"), F.count(x).alias("n"), F.max(x).alias("m")).collect()
    }
    names = [f"{prefix}_sum", f"{prefix}_count", f"{prefix}_mean", f"{prefix}_max"]
    if not tot:
        return srt.drop("_pid").select(
            "*", *[F.lit(None).cast("long" if n.endswith("_count") else "double").alias(n) for n in names]
        )
    # offsets: totals of all earlier partitions (a loop over one row per partition)
    off_s, off_n, off_m = [], [], []
    acc_s, acc_n, acc_m = 0.0, 0, None
    for p in range(max(tot) + 1):
        off_s.append(acc_s)
        off_n.append(acc_n)
        off_m.append(acc_m)
        s, n, m = tot.get(p, (0.0, 0, None))
        acc_s, acc_n = acc_s + s, acc_n + n
        acc_m = m if acc_m is None else (acc_m if m is None else max(acc_m, m))
    # a row per partition, sent to every task
    starts = df.sparkSession.createDataFrame(
        [(p, float(off_s[p]), int(off_n[p]), None if off_m[p] is None else float(off_m[p])) for p in range(len(off_s))],
        "_pid int, _s0 double, _n0 long, _m0 double",
    )
    columns = [c for c in srt.columns if c != "_pid"]
    srt = srt.join(F.broadcast(starts), "_pid")
    s0, n0, m0 = F.col("_s0"), F.col("_n0"), F.col("_m0")
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cs = F.coalesce(F.sum(x).over(w), F.lit(0.0)) + s0
    cn = F.count(x).over(w) + n0
    return srt.select(
        *columns,
        cs.alias(names[0]),
        cn.alias(names[1]),
        (cs / F.when(cn > 0, cn)).alias(names[2]),
        F.greatest(F.max(x).over(w), m0).alias(names[3]),
    )


# A12 ------------------------------------------------------------------------
def update_diagnostics(
    df: DataFrame,
    batch: str,
    lp: str = "lp",
    old_lp: str = "old_lp",
    adv: str = "adv",
    ret: str = "ret",
    value: str = "value",
    clip: float = 0.2,
    value_coef: float = 0.5,
    entropy_coef: float = 0.01,
) -> DataFrame:
    """Policy-update diagnostics from logged log-probs (metrics only, no gradients).

    ratio = exp(lp − old_lp); clipped surrogate −min(r·A, clip(r)·A);
    value loss (ret − value)²; entropy estimate −lp; total =
    policy + value_coef·value − entropy_coef·entropy; per batch with the
    running mean of the total.
    """
    ratio = F.exp(F.col(lp) - F.col(old_lp))
    clipped = F.least(F.greatest(ratio, F.lit(1 - clip)), F.lit(1 + clip))
    pol = -F.least(ratio * F.col(adv), clipped * F.col(adv))
    vloss = F.pow(F.col(ret) - F.col(value), 2)
    ent = -F.col(lp)
    g = df.groupBy(batch).agg(
        F.avg(pol).alias("policy_loss"),
        F.avg(vloss).alias("value_loss"),
        F.avg(ent).alias("entropy"),
        F.avg(ratio).alias("ratio_mean"),
        F.stddev_pop(ratio).alias("ratio_std"),
        F.avg(F.when(F.abs(ratio - 1) > clip, 1.0).otherwise(0.0)).alias("clip_frac"),
        F.count(F.lit(1)).alias("n"),
    )
    total = F.col("policy_loss") + F.lit(value_coef) * F.col("value_loss") - F.lit(entropy_coef) * F.col("entropy")
    g = g.withColumn("total_loss", total)
    # the running mean over batches is a distributed prefix scan: the number of
    # minibatches grows with the data, so no single-partition window
    g = running_stats(g, [batch], "total_loss", "_run")
    return g.select(
        batch,
        *[_r(F.col(c)).alias(c) for c in ("policy_loss", "value_loss", "entropy", "ratio_mean", "ratio_std", "clip_frac", "total_loss")],
        "n",
        _r(F.col("_run_mean")).alias("running_total"),
    )


# A13 ------------------------------------------------------------------------
def best_so_far(df: DataFrame, epoch: str, reward: str) -> DataFrame:
    """Average reward per epoch and the best average seen so far."""
    g = df.groupBy(epoch).agg(F.avg(reward).alias("avg_reward"), F.count(F.lit(1)).alias("n"))
    g = running_stats(g, [epoch], "avg_reward", "_run")
    return g.select(epoch, _r(F.col("avg_reward")).alias("avg_reward"), "n", _r(F.col("_run_max")).alias("best_so_far"))


# A14 ------------------------------------------------------------------------
# Published score bounds (floor, dataset mean, best) per benchmark.
SCORE_BOUNDS = [
    ("maze", -101.0, -83.0, -6.84),
    ("chess", -401.0, 0.21, 1.0),
    ("endgames", -1.0, 0.586, 1.0),
]


def bounds_table(spark) -> DataFrame:
    return spark.createDataFrame(SCORE_BOUNDS, "benchmark string, min_score double, avg_score double, max_score double")


def normalised_score(score: Column, lo: Column, mean: Column, hi: Column) -> Column:
    """Piecewise linear: floor → 0, dataset mean → 50, best → 100."""
    return F.when(score < mean, (score - lo) / (mean - lo) * 50).otherwise(50 + (score - mean) / (hi - mean) * 50)


def score_board(scores: DataFrame, bounds: DataFrame, run: str, benchmark: str = "benchmark", score: str = "score") -> DataFrame:
    """Normalise each run's score by its benchmark bounds, then average per run.

    The bounds table has one row per benchmark: a broadcast of fixed size.
    """
    j = scores.join(F.broadcast(bounds), benchmark)
    norm = normalised_score(F.col(score), F.col("min_score"), F.col("avg_score"), F.col("max_score"))
    return j.groupBy(run, benchmark).agg(
        _r(F.avg(score)).alias("raw_score"), _r(F.avg(norm)).alias("norm_score"), F.count(F.lit(1)).alias("n")
    )


# A9 -------------------------------------------------------------------------
# The "mid" parameter grid (episodes × epsilon × alpha = 32 runs).
GRID_EPISODES = [10000, 15000, 20000, 25000]
GRID_EPSILONS = [0.10, 0.15]
GRID_ALPHAS = [0.3, 0.4, 0.5, 0.6]


def param_grid(spark, episodes=GRID_EPISODES, epsilons=GRID_EPSILONS, alphas=GRID_ALPHAS) -> DataFrame:
    """Parameter product by generators over literal arrays (no join); ``combo`` numbers it."""
    one = spark.range(1)
    g = one.select(F.posexplode(F.array(*[F.lit(e) for e in episodes])).alias("_ei", "max_episode"))
    g = g.select("*", F.posexplode(F.array(*[F.lit(e) for e in epsilons])).alias("_pi", "epsilon"))
    g = g.select("*", F.posexplode(F.array(*[F.lit(a) for a in alphas])).alias("_ai", "alpha"))
    n_p, n_a = len(epsilons), len(alphas)
    return g.select(
        ((F.col("_ei") * n_p + F.col("_pi")) * n_a + F.col("_ai")).alias("combo"), "max_episode", "epsilon", "alpha"
    )


def leaderboard(grid: DataFrame, results: DataFrame, first_k: int = 10, final_k: int = 5) -> DataFrame:
    """Two-phase leaderboard over a parameter grid.

    results: (combo, repeat, losses, games) with repeat 0 = the search run.
    Phase 1 keeps the ``first_k`` combos with the fewest losses (then fewer
    episodes); phase 2 pools their repeat runs, computes the loss percentage
    and keeps ``final_k``. ``lose_pct_ref`` reproduces the logged formula,
    which divides by the repeat count twice. The top-k sorts run on the
    per-combo table (one row per parameter set), not on the log.
    """
    # both phases' per-combo figures in one aggregate (one pass over the results)
    rp = F.col("repeat")
    per = results.groupBy("combo").agg(
        F.count_if(rp == 0).alias("_n_base"),
        F.sum(F.when(rp == 0, F.col("losses"))).alias("base_win"),
        F.sum(F.when(rp > 0, F.col("losses"))).alias("rep_losses"),
        F.sum(F.when(rp > 0, F.col("games"))).alias("rep_games"),
        F.count_distinct(F.when(rp > 0, rp)).alias("n_repeats"),
    )
    top = (
        grid.join(per.where(F.col("_n_base") > 0), "combo")
        .orderBy("base_win", "max_episode", "epsilon", "alpha")
        .limit(first_k)
    )
    j = top.where(F.col("n_repeats") > 0)
    pct = F.col("rep_losses") / F.col("rep_games") * 100
    ref = F.col("rep_losses") / F.col("n_repeats") / F.col("rep_games") * 100
    return (
        j.select("combo", "max_episode", "epsilon", "alpha", "base_win", _r(pct, 2).alias("lose_pct"), _r(ref, 2).alias("lose_pct_ref"), "rep_games")
        .orderBy("lose_pct", "max_episode", "epsilon", "alpha")
        .limit(final_k)
    )
