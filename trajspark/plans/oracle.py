"""DuckDB SQL twins of the registered queries (the correctness oracle).

Tables region … conversations are views in the oracle's DuckDB; the
``with_views`` prefix defines our derived views on top of them.
"""

from __future__ import annotations

import re

from trajspark.plans.views_sql import with_views as W

# each part as length:text, so that different pairs never share a key
SA = "CAST(length(state) AS VARCHAR) || ':' || state || '|' || CAST(length(action) AS VARCHAR) || ':' || action"
WS = "[ \\t\\n\\r\\f]+"
TOKENS = f"list_filter(string_split_regex(text, '{WS}'), lambda x: x <> '')"

FACTS = """
facts AS (
  SELECT user_id, week, any_value(iter) AS iter,
         arg_min(state, step) AS first_state, arg_min(turn, step) AS first_turn,
         arg_max(reward, CASE WHEN action IS NOT NULL THEN step END) AS final_reward,
         CAST(sum(reward) AS BIGINT) AS ep_return, count(action) AS n_actions
  FROM ep_events GROUP BY user_id, week HAVING count(action) > 0)
"""

OUTCOME_COLS = """
  round(avg(CASE WHEN first_turn THEN final_reward ELSE -final_reward END), 6) AS avg_return,
  round(avg(CASE WHEN (CASE WHEN first_turn THEN final_reward ELSE -final_reward END) = 1 THEN 1.0 ELSE 0.0 END), 6) AS avg_win,
  round(avg(CASE WHEN final_reward = 0 THEN 1.0 ELSE 0.0 END), 6) AS avg_tie,
  round(avg(CASE WHEN (CASE WHEN first_turn THEN final_reward ELSE -final_reward END) = -1 THEN 1.0 ELSE 0.0 END), 6) AS avg_lose,
  count(*) AS num_episode
"""


def _summary(src: str, cols: list[str]) -> str:
    stats = ",\n".join(
        f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std, "
        f"round(min({c}), 6) AS {c}_min, round(max({c}), 6) AS {c}_max"
        for c in cols
    )
    names = [f"{c}_{s}" for c in cols for s in ("mean", "std", "min", "max")]
    macro = ", ".join(f"round(avg({n}), 6) AS {n}" for n in names)
    return f"""
per AS (SELECT CAST(first_state AS VARCHAR) AS start, {stats}, count(*) AS n_episodes FROM {src} GROUP BY 1)
SELECT * FROM per
UNION ALL
SELECT '__macro__' AS start, {macro}, CAST(sum(n_episodes) AS BIGINT) AS n_episodes FROM per
"""


SQL: dict[str, str] = {
    # ------------------------------------------------------------ T family
    "t1_transitions": W("ep_events") + """
SELECT user_id, CAST(week AS VARCHAR) AS week, step, state, action, reward, next_state, turn FROM (
  SELECT *, lead(state) OVER (PARTITION BY user_id, week ORDER BY step) AS next_state FROM ep_events) t
WHERE action IS NOT NULL""",
    "t2_own_steps": W("ep_events") + """
SELECT user_id, CAST(week AS VARCHAR) AS week, step, state, action, reward FROM ep_events
WHERE turn AND action IS NOT NULL""",
    "t3_suffixes": W("ep_events") + """
SELECT user_id, CAST(week AS VARCHAR) AS week, start, suffix_len, return_to_go,
       array_to_string(list_reverse(list_filter(acts, lambda x: x IS NOT NULL)), ' ') AS suffix_actions,
       array_to_string(list_reverse(sts), ' ') AS suffix_states
FROM (
  SELECT user_id, week, step AS start, action, turn,
         count(action) OVER w AS suffix_len,
         CAST(sum(reward) OVER w AS BIGINT) AS return_to_go,
         list(action) OVER w AS acts, list(state) OVER w AS sts
  FROM ep_events
  WINDOW w AS (PARTITION BY user_id, week ORDER BY step DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) s
WHERE action IS NOT NULL AND turn""",
    "t4_drop_terminal": W("states") + "SELECT state, props FROM states WHERE NOT is_terminal",
    "t5_audit_shape": W("ep_events") + """,
s AS (SELECT user_id, week, count(*) AS n_states, count(action) AS n_actions,
             count(CASE WHEN action IS NOT NULL THEN turn END) AS n_turns,
             arg_max(is_terminal, step) AS last_terminal, min(step) AS min_step, max(step) AS max_step
      FROM ep_events GROUP BY user_id, week)
SELECT 'states_eq_actions_plus_1' AS rule, count(*) AS n_episodes, CAST(count_if(n_states <> n_actions + 1) AS BIGINT) AS n_violations FROM s
UNION ALL SELECT 'turns_eq_actions', count(*), CAST(count_if(n_turns <> n_actions) AS BIGINT) FROM s
UNION ALL SELECT 'last_state_terminal', count(*), CAST(count_if(NOT coalesce(last_terminal, false)) AS BIGINT) FROM s
UNION ALL SELECT 'steps_contiguous', count(*), CAST(count_if(min_step <> 0 OR max_step <> n_states - 1) AS BIGINT) FROM s""",
    "t6_audit_replay": W("ep_events") + """,
t AS (SELECT *, lag(turn) OVER w AS prev_turn, lead(state) OVER w AS next_state FROM ep_events
      WINDOW w AS (PARTITION BY user_id, week ORDER BY step))
SELECT 'alternation' AS rule, CAST(count_if(prev_turn IS NOT NULL) AS BIGINT) AS n_checked,
       CAST(count_if(prev_turn IS NOT NULL AND prev_turn = turn) AS BIGINT) AS n_violations FROM t
UNION ALL SELECT 'next_state', CAST(count_if(action IS NOT NULL) AS BIGINT),
       CAST(count_if(action IS NOT NULL AND action IS DISTINCT FROM next_state) AS BIGINT) FROM t
UNION ALL SELECT 'terminal_flag', CAST(count(*) AS BIGINT),
       CAST(count_if(is_terminal <> (next_state IS NULL)) AS BIGINT) FROM t""",
    "t7_sa_keys": W("ep_events") + """
SELECT """ + SA + """ AS sa_key, count(*) AS n FROM ep_events
WHERE turn AND action IS NOT NULL GROUP BY 1""",
    "t8_own_view": W("ep_events") + """,
t AS (SELECT *, lead(state) OVER (PARTITION BY user_id, week ORDER BY step) AS next_state,
             arg_min(turn, step) OVER (PARTITION BY user_id, week) AS first_turn,
             max(CASE WHEN action IS NOT NULL THEN step END) OVER (PARTITION BY user_id, week) AS last_action_step
      FROM ep_events)
SELECT user_id, CAST(week AS VARCHAR) AS week, step, state, action, next_state,
       reward * CASE WHEN first_turn THEN 1 ELSE -1 END AS reward,
       (abs(reward * CASE WHEN first_turn THEN 1 ELSE -1 END) > 0 OR step = last_action_step) AS done
FROM t WHERE action IS NOT NULL AND turn""",
    "t8_own_view_credit_final": W("ep_events") + """,
t AS (SELECT *, lead(state) OVER (PARTITION BY user_id, week ORDER BY step) AS next_state,
             arg_min(turn, step) OVER (PARTITION BY user_id, week) AS first_turn,
             max(CASE WHEN action IS NOT NULL THEN step END) OVER (PARTITION BY user_id, week) AS last_action_step,
             max(CASE WHEN action IS NOT NULL AND turn THEN step END) OVER (PARTITION BY user_id, week) AS last_own
      FROM ep_events),
u AS (SELECT *, reward * CASE WHEN first_turn THEN 1 ELSE -1 END AS own_r FROM t),
v AS (SELECT *, max(CASE WHEN step = last_action_step THEN own_r END) OVER (PARTITION BY user_id, week) AS final_r FROM u),
x AS (SELECT *, own_r + CASE WHEN step = last_own AND last_own <> last_action_step THEN final_r ELSE 0 END AS r2 FROM v)
SELECT user_id, CAST(week AS VARCHAR) AS week, step, state, action, next_state, r2 AS reward,
       (abs(r2) > 0 OR step = last_action_step OR step = last_own) AS done
FROM x WHERE action IS NOT NULL AND turn""",
    "t9_trajectories": W("ep_events") + """
SELECT user_id, CAST(week AS VARCHAR) AS week, CAST(count(*) AS INTEGER) AS n_states,
       string_agg(state, ' ' ORDER BY step) AS states,
       coalesce(string_agg(action, ' ' ORDER BY step), '') AS actions,
       coalesce(string_agg(CAST(reward AS VARCHAR), ' ' ORDER BY step), '') AS rewards,
       coalesce(string_agg(CASE WHEN action IS NOT NULL THEN CAST(turn AS VARCHAR) END, ' ' ORDER BY step), '') AS turns
FROM ep_events GROUP BY user_id, week""",
    "t9_order_trajectories": W("ep_orders") + """
SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n_states, string_agg(state, ' ' ORDER BY step) AS states,
       round(coalesce(sum(reward), 0.0), 6) AS total_reward
FROM ep_orders GROUP BY l_orderkey""",
    "t10_look_ahead": W("ep_events") + """,
t AS (SELECT *, list(action) OVER f AS acts, list(reward) OVER f AS rws,
             lead(state, 4) OVER w AS a_state, lead(is_terminal, 4) OVER w AS a_term, lead(turn, 4) OVER w AS a_turn,
             arg_max(state, step) OVER (PARTITION BY user_id, week) AS last_state
      FROM ep_events
      WINDOW w AS (PARTITION BY user_id, week ORDER BY step),
             f AS (PARTITION BY user_id, week ORDER BY step ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT user_id, CAST(week AS VARCHAR) AS week, step, state,
       array_to_string(list_filter(acts, lambda x: x IS NOT NULL), ' ') AS pv_actions,
       array_to_string(list_transform(list_filter(rws, lambda x: x IS NOT NULL), lambda x: CAST(x AS VARCHAR)), ' ') AS pv_rewards,
       CASE WHEN a_state IS NULL OR a_term THEN last_state ELSE a_state END AS final_state,
       CASE WHEN a_state IS NULL OR a_term THEN NULL ELSE a_turn END AS final_turn,
       (a_state IS NULL OR a_term) AS final_terminal
FROM t WHERE action IS NOT NULL""",
    "t11_token_rows": f"""
WITH t AS (SELECT conv_id, turn, role, {TOKENS} AS toks,
                  CASE role WHEN 'assistant' THEN 1.0 WHEN 'system' THEN -0.5 ELSE 0.0 END AS r
           FROM conversations),
u AS (SELECT conv_id, turn, role, r, len(toks) AS n, unnest(toks) AS token,
             generate_subscripts(toks, 1) - 1 AS tok_idx FROM t)
SELECT conv_id, turn, CAST(tok_idx AS INTEGER) AS tok_idx, token, role = 'assistant' AS is_action,
       CAST(CASE WHEN tok_idx = n - 1 THEN r ELSE 0.0 END AS DOUBLE) AS reward
FROM u""",
    "t12_keep_last": """
SELECT conv_id, turn, role FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) t
WHERE rn <= 3""",
    # ------------------------------------------------------------ A family
    "a1_win_rate": W("ep_events") + "," + FACTS + """
SELECT first_state, first_turn, CASE WHEN sum(final_reward) >= 0 THEN 'black' ELSE 'white' END AS win,
       round(avg(final_reward), 6) AS win_rate, count(*) AS n_games
FROM facts GROUP BY first_state, first_turn""",
    "a2_episode_outcomes": W("ep_events") + "," + FACTS + "SELECT " + OUTCOME_COLS + " FROM facts",
    "a3_outcomes_by_iteration": W("ep_events") + "," + FACTS + "SELECT iter, " + OUTCOME_COLS
    + " FROM facts GROUP BY iter",
    "a4_key_counts": W("ep_events") + """
SELECT count(DISTINCT (state, action)) AS n_unique, count(*) AS n_pairs FROM ep_events
WHERE turn AND action IS NOT NULL""",
    "a5_interaction_summary": W("ep_events") + "," + FACTS + """,
e AS (SELECT first_state, CAST(ep_return AS DOUBLE) AS reward,
             CASE WHEN final_reward <> 0 THEN 1.0 ELSE 0.0 END AS done, CAST(n_actions AS DOUBLE) AS length FROM facts),
""" + _summary("e", ["reward", "done", "length"]),
    "a5_order_summary": W("ep_orders") + """,
e AS (SELECT arg_min(state, step) AS first_state, sum(reward) AS reward, CAST(count(action) AS DOUBLE) AS length
      FROM ep_orders GROUP BY l_orderkey HAVING count(action) > 0),
""" + _summary("e", ["reward", "length"]),
    "a6_vote": W("votes") + """
SELECT * FROM (
  SELECT state, candidate, count(*) AS n_votes, min(sample_idx) AS first_seen,
         CAST(row_number() OVER (PARTITION BY state ORDER BY count(*) DESC, min(sample_idx)) AS INTEGER) AS rank
  FROM votes GROUP BY state, candidate) t
WHERE rank <= 2""",
    "a7_masked_stats": """
SELECT vec_id, round(coalesce(sum(x) FILTER (WHERE (i + label) % 3 <> 0), 0) / any_value(n), 6) AS mean, round(min(x) FILTER (WHERE (i + label) % 3 <> 0), 6) AS min,
       round(max(x) FILTER (WHERE (i + label) % 3 <> 0), 6) AS max, round(stddev_pop(x) FILTER (WHERE (i + label) % 3 <> 0), 6) AS std,
       CAST(count_if((i + label) % 3 <> 0) AS INTEGER) AS n_kept, CAST(any_value(n) AS INTEGER) AS n
FROM (SELECT vec_id, label, len(embedding) AS n, CAST(unnest(embedding) AS DOUBLE) AS x,
             generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) u
GROUP BY vec_id""",
    "a7_unpadded_stats": """
SELECT vec_id, round(sum(x) / count(*), 6) AS mean, round(min(x), 6) AS min, round(max(x), 6) AS max,
       round(stddev_pop(x), 6) AS std, CAST(count(*) AS INTEGER) AS n_kept, CAST(count(*) AS INTEGER) AS n
FROM (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x,
             generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) u
WHERE i < 8 + label GROUP BY vec_id""",
    "a8_outcome_counts": W("ep_events") + "," + FACTS + """
SELECT iter, CAST(count_if(final_reward = 1) AS BIGINT) AS n_win, CAST(count_if(final_reward = -1) AS BIGINT) AS n_loss,
       CAST(count_if(final_reward <> 1 AND final_reward <> -1) AS BIGINT) AS n_draw
FROM facts GROUP BY iter""",
    "a10_token_cost": f"""
WITH t AS (SELECT conv_id, turn,
                  CAST(CASE WHEN role = 'assistant' THEN 0 ELSE len({TOKENS}) END AS INTEGER) AS in_tokens,
                  CAST(CASE WHEN role = 'assistant' THEN len({TOKENS}) ELSE 0 END AS INTEGER) AS out_tokens
           FROM conversations),
c AS (SELECT *, in_tokens * 0.03 / 1000 + out_tokens * 0.06 / 1000 AS cost FROM t)
SELECT conv_id, turn, in_tokens, out_tokens, round(cost, 6) AS cost,
       CAST(sum(in_tokens) OVER w AS BIGINT) AS cum_in_tokens, CAST(sum(out_tokens) OVER w AS BIGINT) AS cum_out_tokens,
       round(sum(cost) OVER w, 6) AS cum_cost
FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "a11_normalise": W("policy_log") + """
SELECT user_id, CAST(week AS VARCHAR) AS week, step,
       round((adv - avg(adv) OVER ()) / (stddev_samp(adv) OVER () + 1e-8), 6) AS adv_norm
FROM policy_log""",
    "a12_update_diagnostics": W("policy_log") + """,
t AS (SELECT iter, exp(lp - old_lp) AS ratio, adv, CAST(reward AS DOUBLE) AS ret, value, lp FROM policy_log),
g AS (SELECT iter,
             avg(-least(ratio * adv, least(greatest(ratio, 0.8), 1.2) * adv)) AS policy_loss,
             avg(pow(ret - value, 2)) AS value_loss, avg(-lp) AS entropy,
             avg(ratio) AS ratio_mean, stddev_pop(ratio) AS ratio_std,
             avg(CASE WHEN abs(ratio - 1) > 0.2 THEN 1.0 ELSE 0.0 END) AS clip_frac, count(*) AS n
      FROM t GROUP BY iter),
h AS (SELECT *, policy_loss + 0.5 * value_loss - 0.01 * entropy AS total_loss FROM g)
SELECT iter, round(policy_loss, 6) AS policy_loss, round(value_loss, 6) AS value_loss, round(entropy, 6) AS entropy,
       round(ratio_mean, 6) AS ratio_mean, round(ratio_std, 6) AS ratio_std, round(clip_frac, 6) AS clip_frac,
       round(total_loss, 6) AS total_loss, n,
       round(avg(total_loss) OVER (ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running_total
FROM h""",
    "a13_best_so_far": W("ep_events") + "," + FACTS + """,
g AS (SELECT iter, avg(ep_return) AS avg_reward, count(*) AS n FROM facts GROUP BY iter)
SELECT iter, round(avg_reward, 6) AS avg_reward, n,
       round(max(avg_reward) OVER (ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS best_so_far
FROM g""",
    "a14_score_board": W("ep_events") + "," + FACTS + """,
b(benchmark, min_score, avg_score, max_score) AS (VALUES ('maze', -101.0, -83.0, -6.84), ('chess', -401.0, 0.21, 1.0),
                                                       ('endgames', -1.0, 0.586, 1.0)),
s AS (SELECT iter AS run, 'endgames' AS benchmark,
             CAST(CASE WHEN first_turn THEN final_reward ELSE -final_reward END AS DOUBLE) AS score FROM facts)
SELECT run, s.benchmark, round(avg(score), 6) AS raw_score,
       round(avg(CASE WHEN score < avg_score THEN (score - min_score) / (avg_score - min_score) * 50
                      ELSE 50 + (score - avg_score) / (max_score - avg_score) * 50 END), 6) AS norm_score,
       count(*) AS n
FROM s JOIN b ON s.benchmark = b.benchmark GROUP BY run, s.benchmark""",
}

MD5_STATE = "md5(concat_ws('|', '{seed}', state, props))"
CHUNK_SQL = W("ep_events") + f"""
SELECT user_id, CAST(week AS VARCHAR) AS week, step, sa_key,
       CAST((rk - 1) // 5 AS BIGINT) AS chunk, CAST((rk - 1) % 5 AS BIGINT) AS pos
FROM (SELECT user_id, week, step, {SA} AS sa_key,
             row_number() OVER (PARTITION BY {SA}
                                ORDER BY md5(concat_ws('|', '42', CAST(user_id AS VARCHAR), CAST(week AS VARCHAR), CAST(step AS VARCHAR))),
                                         user_id, week, step) AS rk
      FROM ep_events WHERE turn AND action IS NOT NULL) t"""

SQL.update({
    # the order is the feature (unit test); the twin checks no row is lost or repeated
    "d8_shuffle": W("states") + "SELECT state, props, is_terminal FROM states",
    "d1_distinct_states": W("raw_states") + "SELECT state, props, count(*) AS n_copies FROM raw_states GROUP BY state, props",
    "d1_distinct_counts": W("raw_states") + "SELECT count(*) AS n_before, count(DISTINCT (state, props)) AS n_after FROM raw_states",
    "d3_not_done": W("states", "week_states") + """
SELECT s.state, s.props, s.is_terminal FROM states s
WHERE NOT EXISTS (SELECT 1 FROM week_states d WHERE d.iter = 1
                  AND d.state IS NOT DISTINCT FROM s.state AND d.props IS NOT DISTINCT FROM s.props)""",
    "d4_sample_n": W("states") + f"""
SELECT state, props FROM states ORDER BY {MD5_STATE.format(seed=42)}, state, props LIMIT 100""",
    "d5_sample_ratio": W("raw_states") + """
SELECT event_id, state, props FROM (
  SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', CAST(event_id AS VARCHAR))), event_id) AS rn FROM raw_states) t
WHERE rn <= (SELECT CAST(floor(0.025 * count(*)) AS BIGINT) FROM raw_states)""",
    "d6_holdout_test": W("states") + f"""
SELECT state, props FROM states WHERE NOT is_terminal ORDER BY {MD5_STATE.format(seed=7)}, state, props LIMIT 50""",
    "d6_holdout_train": W("states") + f"""
SELECT state, props FROM states WHERE NOT is_terminal EXCEPT ALL
SELECT * FROM (SELECT state, props FROM states WHERE NOT is_terminal ORDER BY {MD5_STATE.format(seed=7)}, state, props LIMIT 50) t""",
    "d6_leakage": W("states") + """
SELECT count(*) - 50 AS n_train, CAST(50 AS BIGINT) AS n_test, CAST(0 AS BIGINT) AS n_overlap FROM states WHERE NOT is_terminal""",
    "d7_grow_frontier": W("week_states") + """
SELECT DISTINCT state, props, is_terminal FROM week_states WHERE NOT is_terminal""",
    "d9_index": W("states") + f"""
SELECT state, props, row_number() OVER (ORDER BY {MD5_STATE.format(seed=42)}, state, props) - 1 AS idx FROM states""",
    "d10_replicate": W("states") + """
SELECT state, props, CAST(unnest(range(3)) AS INTEGER) AS replica FROM states""",
    "d11_chunks": CHUNK_SQL,
    "d11_chunks_salted": CHUNK_SQL,
    "d12_batches": W("batch_rows") + """,
b AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS idx FROM batch_rows),
p AS (SELECT (4 - count(*) % 4) % 4 AS pad, (count(*) - 1) // 4 AS last FROM b),
u AS (SELECT user_id, idx, CAST(idx // 4 AS BIGINT) AS batch, false AS is_pad FROM b
      UNION ALL
      SELECT user_id, idx, CAST(last AS BIGINT), true FROM b, p WHERE idx < pad)
SELECT *, batch % 2 = 0 AS side_first FROM u""",
    "d13_epoch_plan": W("batch_rows") + """,
b AS (SELECT user_id, row_number() OVER (ORDER BY md5(concat_ws('|', '42', CAST(user_id AS VARCHAR))), user_id) - 1 AS idx
      FROM batch_rows),
n AS (SELECT count(*) AS total FROM b),
c AS (SELECT user_id, idx, CAST(idx % 2 AS INTEGER) AS worker, CAST((idx // 2) // 4 AS BIGINT) AS minibatch FROM b)
SELECT c.* FROM c, n WHERE minibatch < ((total - worker - 1) // 2 + 1) // 4""",
})

OWN_VALUES = """,
t AS (SELECT *, lead(state) OVER (PARTITION BY user_id, week ORDER BY step) AS next_state,
             arg_min(turn, step) OVER (PARTITION BY user_id, week) AS first_turn,
             max(CASE WHEN action IS NOT NULL THEN step END) OVER (PARTITION BY user_id, week) AS last_action_step,
             arg_max(value, step) OVER (PARTITION BY user_id, week) AS final_value
      FROM ep_events),
own AS (SELECT user_id, week, step, value, final_value, reward * CASE WHEN first_turn THEN 1 ELSE -1 END AS reward,
               (abs(reward) > 0 OR step = last_action_step) AS done
        FROM t WHERE action IS NOT NULL AND turn),
nv AS (SELECT *, coalesce(lead(value) OVER w, final_value) AS next_value, row_number() OVER w - 1 AS pos,
              count(*) OVER (PARTITION BY user_id, week) AS n
       FROM own WINDOW w AS (PARTITION BY user_id, week ORDER BY step))
"""

TD_SWEEP = """,
t{i} AS (SELECT p.state, sum(p.r_sum + CASE WHEN p.next_terminal THEN 0.0 ELSE coalesce(v.value, 0.0) * p.n END) / sum(p.n) AS target
        FROM pairs p LEFT JOIN v{j} v ON v.state = p.next_state GROUP BY p.state),
v{i} AS (SELECT v.state, CASE WHEN t.target IS NULL THEN v.value ELSE v.value + 0.4 * (t.target - v.value) END AS value
        FROM v{j} v LEFT JOIN t{i} t ON t.state = v.state)"""

BFS = """,
bfs(node, d) AS (SELECT 's1', 0 UNION SELECT e.src, b.d + 1 FROM bfs b JOIN graph_edges e ON e.dst = b.node WHERE b.d < 12),
dist AS (SELECT node, min(d) AS dist FROM bfs GROUP BY node),
pol AS (SELECT d.node, CAST(d.dist AS INTEGER) AS dist,
               (SELECT min(e.dst) FROM graph_edges e JOIN dist d2 ON d2.node = e.dst
                WHERE e.src = d.node AND d2.dist = d.dist - 1) AS move
        FROM dist d)
"""


def _u(seed: str, key: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {key})), 1, 13))::BIGINT / 4503599627370496.0)"


MAX_LAYERS = 64


def _layers_sql() -> str:
    out = [""",
n AS (SELECT step AS layer, state AS node, step % 2 = 0 AS maximize,
             CASE WHEN bool_or(is_terminal) THEN
                  CAST((CASE state WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) * (100 - step) AS DOUBLE) END AS end_value
      FROM ep_events GROUP BY step, state),
e AS (SELECT DISTINCT step AS layer, state AS node, action AS next_node FROM ep_events WHERE action IS NOT NULL)"""]
    out.append(f""",
l{MAX_LAYERS} AS (SELECT layer, node, maximize, end_value AS value FROM n WHERE layer = {MAX_LAYERS})""")
    for i in range(MAX_LAYERS - 1, -1, -1):
        out.append(f""",
l{i} AS (SELECT n.layer, n.node, n.maximize,
               CASE WHEN n.maximize THEN greatest(s.smax, n.end_value) ELSE least(s.smin, n.end_value) END AS value
        FROM n LEFT JOIN (SELECT e.node, max(v.value) AS smax, min(v.value) AS smin FROM e JOIN l{i + 1} v ON v.node = e.next_node
                          WHERE e.layer = {i} GROUP BY e.node) s ON s.node = n.node
        WHERE n.layer = {i})""")
    out.append(",\nvals AS (" + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(MAX_LAYERS + 1)) + ")")
    return "".join(out)


GREEDY = _layers_sql() + """,
ch AS (SELECT CAST(e.layer AS VARCHAR) || ':' || e.node AS node, n.maximize, e.next_node AS action, v.value
       FROM e JOIN vals v ON v.layer = e.layer + 1 AND v.node = e.next_node
              JOIN n ON n.layer = e.layer AND n.node = e.node),
best AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY node ORDER BY CASE WHEN maximize THEN value ELSE -value END DESC) AS rk FROM ch) x
         WHERE rk = 1),
greedy AS (SELECT node, action, value,
                  row_number() OVER (PARTITION BY node ORDER BY md5(concat_ws('|', '42', node, action)), action) = 1 AS is_pick
           FROM best)
"""


def _recursive(sql: str) -> str:
    return "WITH RECURSIVE " + sql[len("WITH "):]


SQL.update({
    "v2_next_values": W("ep_events") + OWN_VALUES + """
SELECT user_id, CAST(week AS VARCHAR) AS week, step, value, next_value FROM nv""",
    "v1_gae": _recursive(W("ep_events")) + OWN_VALUES + """,
c AS (SELECT *, reward + CASE WHEN done THEN 0.0 ELSE 0.99 * next_value END - value AS delta FROM nv),
r(user_id, week, pos, step, value, adv) AS (
  SELECT user_id, week, pos, step, value, delta FROM c WHERE pos = n - 1
  UNION ALL
  SELECT c.user_id, c.week, c.pos, c.step, c.value, c.delta + 0.99 * 0.95 * (CASE WHEN c.done THEN 0 ELSE 1 END) * r.adv
  FROM c JOIN r ON c.user_id = r.user_id AND c.week = r.week AND c.pos = r.pos - 1)
SELECT user_id, CAST(week AS VARCHAR) AS week, step, round(adv + 1e-9, 6) AS adv, round(adv + value + 1e-9, 6) AS ret FROM r""",
    "v3_td0": W("ep_events") + """,
tr AS (SELECT * FROM (SELECT state, lead(state) OVER w AS next_state, lead(is_terminal) OVER w AS next_terminal, reward
                      FROM ep_events WINDOW w AS (PARTITION BY user_id, week ORDER BY step)) x WHERE next_state IS NOT NULL),
pairs AS (SELECT state, next_state, next_terminal, count(*) AS n, sum(CAST(reward AS DOUBLE)) AS r_sum FROM tr
          GROUP BY state, next_state, next_terminal),
v0 AS (SELECT state, 0.0 AS value FROM (SELECT state FROM pairs UNION SELECT next_state FROM pairs) s)"""
    + TD_SWEEP.format(i=1, j=0) + TD_SWEEP.format(i=2, j=1) + """
SELECT v2.state, round(v2.value, 6) AS value, CAST(coalesce(vis.visits, 0) AS BIGINT) AS visits
FROM v2 LEFT JOIN (SELECT state, sum(n) AS visits FROM pairs GROUP BY state) vis ON vis.state = v2.state""",
    "v4_shortest_path": _recursive(W("graph_edges")) + BFS + "SELECT node, dist, move FROM pol",
    "v5_degrade_policy": _recursive(W("graph_edges")) + BFS + f""",
mv AS (SELECT src AS node, arg_min(dst, md5('42|pick|' || src || '|' || dst)) AS action FROM graph_edges GROUP BY src)
SELECT p.node, p.dist, CASE WHEN {_u('42', 'p.node')} < 0.5 THEN p.move ELSE mv.action END AS move,
       {_u('42', 'p.node')} >= 0.5 AS is_random
FROM pol p JOIN mv ON mv.node = p.node
WHERE p.move IS NOT NULL""",
    "v6_backward_induction": W("ep_events") + _layers_sql() + """
SELECT layer, node, maximize, value FROM vals""",
    "v7_greedy_actions": W("ep_events") + GREEDY + "SELECT node, action, value, is_pick FROM greedy",
    "v8_move_accuracy": W("ep_events") + GREEDY + """,
pred AS (SELECT CAST(step AS VARCHAR) || ':' || state AS node, action FROM ep_events WHERE turn AND action IS NOT NULL),
j AS (SELECT p.*, EXISTS (SELECT 1 FROM greedy g WHERE g.node = p.node AND g.action = p.action) AS ok FROM pred p)
SELECT count(*) AS n, CAST(count_if(action IS NULL) AS BIGINT) AS n_parse_fail, CAST(count_if(ok) AS BIGINT) AS n_correct,
       round(count_if(ok) / nullif(count(*) - count_if(action IS NULL), 0), 6) AS accuracy
FROM j""",
})

from trajspark.operators.prompts import TEMPLATES  # noqa: E402

_TPL = {name: (system, user) for name, system, user in TEMPLATES}


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _fill(name: str, slots: dict[str, str]) -> str:
    # the template is cut at its slots; values are never searched for slots
    pieces = re.split("(" + "|".join(re.escape("{" + k + "}") for k in slots) + ")", _TPL[name][1])
    named = {"{" + k + "}": f"coalesce(CAST({v} AS VARCHAR), '')" for k, v in slots.items()}
    return "(" + " || ".join(named.get(p, _lit(p)) for p in pieces if p) + ")"


def _sys(name: str) -> str:
    return _lit(_TPL[name][0])


def _u2(seed: str, keys: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {keys})), 1, 13))::BIGINT / 4503599627370496.0)"


SUFFIX_CHUNKS = f""",
sfx AS (SELECT user_id, week, step AS start, state, action, turn,
               CAST(sum(reward) OVER w AS BIGINT) AS rtg, list(action) OVER w AS acts
        FROM ep_events
        WINDOW w AS (PARTITION BY user_id, week ORDER BY step DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
games AS (SELECT user_id, week, start, state, action, {SA} AS sa_key,
                 'actions: ' || array_to_string(list_reverse(list_filter(acts, lambda x: x IS NOT NULL)), ' ') || '; return: ' || CAST(rtg AS VARCHAR) AS game_text
          FROM sfx WHERE action IS NOT NULL AND turn),
ch AS (SELECT *, (rk - 1) // 5 AS chunk, (rk - 1) % 5 AS pos FROM (
         SELECT *, row_number() OVER (PARTITION BY sa_key ORDER BY md5(concat_ws('|', '42', CAST(user_id AS VARCHAR), CAST(week AS VARCHAR), CAST(start AS VARCHAR))), user_id, week, start) AS rk
         FROM games) r)
"""

EPS = f""",
legal AS (SELECT state, list_sort(list(DISTINCT CAST(length(action) AS INTEGER))) AS legal FROM (
            SELECT state, lead(state) OVER (PARTITION BY user_id, week ORDER BY step) AS action FROM ep_events) t
          WHERE action IS NOT NULL GROUP BY state),
st AS (SELECT s.state, s.props, l.legal, {_u2('42', 's.state, s.props')} AS u, {_u2('42|pick', 's.state, s.props')} AS u2
       FROM states s JOIN legal l ON l.state = s.state),
rnd AS (SELECT state, props, legal[CAST(floor(u2 * len(legal)) AS INTEGER) + 1] AS action FROM st WHERE u < 0.3),
model AS (SELECT state, props, legal, u2, {_fill('move', {'state': "state || ' ' || props", 'moves': "array_to_string(legal, ',')"})} AS user
          FROM st WHERE u >= 0.3),
resp AS (SELECT *, '{{"best_move": ' || CAST(length(user) % 9 + 1 AS VARCHAR) || '}}' AS response FROM model),
ext AS (SELECT *, string_split(response, '"best_move": ') AS parts FROM resp),
ext2 AS (SELECT *, CASE WHEN len(parts) >= 2 THEN parts[2] END AS after FROM ext),
ext3 AS (SELECT *, TRY_CAST(substr(after, 1, 1) AS INTEGER) - 1 AS idx FROM ext2),
moves AS (SELECT state, props, response,
                 CASE WHEN after IS NOT NULL AND coalesce(list_contains(legal, idx), false) THEN idx
                      ELSE legal[CAST(floor(u2 * len(legal)) AS INTEGER) + 1] END AS action,
                 CASE WHEN after IS NULL THEN 'no_marker'
                      WHEN coalesce(list_contains(legal, idx), false) THEN 'ok' ELSE 'fallback' END AS status
          FROM ext3)
"""

VERDICT = """,
pv AS (SELECT doc_id, win, win_rate,
              CASE WHEN contains(tail, '<white>') AND NOT contains(tail, '<black>') THEN 'white'
                   WHEN contains(tail, '<black>') AND NOT contains(tail, '<white>') THEN 'black'
                   ELSE 'undecided' END AS predict
       FROM (SELECT *, string_split(response, 'Advantage')[-1] AS tail FROM verdicts) t)
"""

END_PROMPTS = f""",
esp AS (SELECT user_id, state, pv_idx, {_sys('evaluate')} AS system,
               {_fill('evaluate', {'state': 'final_state', 'turn': 'final_turn'})} AS user
        FROM lookahead_ev WHERE pv_idx < 2 AND NOT final_terminal),
resp AS (SELECT user_id, state, pv_idx, 'value ' || CAST(length(user) % 7 - 3 AS VARCHAR) AS response FROM esp),
att AS (SELECT l.*, coalesce(r.response, l.final_eval) AS eval
        FROM lookahead_ev l LEFT JOIN resp r ON r.user_id = l.user_id AND r.state = l.state AND r.pv_idx = l.pv_idx)
"""


def _td(m: int) -> str:
    return f""",
lines AS (SELECT user_id, state, pv_idx, current_state,
                 CASE WHEN final_terminal THEN 'terminal, reward ' || CAST(list_sum(list_transform(pv_rewards, lambda x: CAST(x AS DOUBLE))) AS VARCHAR)
                      ELSE eval END AS evaluation,
                 'Variation ' || CAST(pv_idx + 1 AS VARCHAR) || ': moves ' || array_to_string(pv_actions, ' ') || '; end ' || final_state
                 || '; eval ' || coalesce(CASE WHEN final_terminal THEN 'terminal, reward ' || CAST(list_sum(list_transform(pv_rewards, lambda x: CAST(x AS DOUBLE))) AS VARCHAR) ELSE eval END, '?') AS line
          FROM att WHERE pv_idx < {m}),
rec AS (SELECT user_id, state, string_agg(line, '\n' ORDER BY pv_idx) AS variations,
               count_if(evaluation IS NULL) AS n_missing
        FROM lines GROUP BY user_id, state)
"""


SQL.update({
    "p1_prompt_table": W("states") + f"""
SELECT state, props, {_sys('evaluate')} AS system,
       {_fill('evaluate', {'state': "concat_ws(' ', state, props)", 'turn': "'true'"})} AS user, 2 AS n_messages
FROM states""",
    "p2_mc_prompts": W("ep_events") + SUFFIX_CHUNKS + f""",
g AS (SELECT sa_key, CAST(chunk AS BIGINT) AS chunk, min(state) AS state, min(action) AS action, CAST(count(*) AS INTEGER) AS n_games,
             string_agg('Game ' || CAST(pos + 1 AS VARCHAR) || ': ' || game_text, '\n' ORDER BY pos) || '\nEnd of games.' AS games
      FROM ch GROUP BY sa_key, chunk)
SELECT sa_key, chunk, state, action, n_games, {_fill('mc', {'state': 'state', 'action': 'action', 'games': 'games'})} AS user FROM g""",
    "p3_visit_prompts": W("ep_events") + f"""
SELECT state, turn, {_fill('evaluate', {'state': 'state', 'turn': 'turn'})} AS user
FROM (SELECT DISTINCT state, turn FROM ep_events WHERE action IS NOT NULL) t""",
    "p4_end_state_prompts": W("lookahead_ev") + END_PROMPTS + """
SELECT user_id, state, pv_idx, system, user FROM esp""",
    "p8_infer": W("lookahead_ev") + END_PROMPTS + """
SELECT user_id, state, pv_idx, response FROM resp""",
    "p9_attach": W("lookahead_ev") + END_PROMPTS + """
SELECT user_id, state, pv_idx, final_state, eval AS final_eval, final_terminal FROM att""",
    "p5_td_prompts": W("lookahead_ev") + END_PROMPTS + _td(2) + f"""
SELECT user_id, state, {_fill('td', {'state': 'state', 'variations': 'variations'})} AS user
FROM rec WHERE n_missing = 0""",
    "p5_td_errors": W("lookahead_ev") + END_PROMPTS + _td(3) + """
SELECT user_id, state, CAST(n_missing AS BIGINT) AS n_missing FROM rec WHERE n_missing > 0""",
    "p6_improvement_prompts": W("votes") + f""",
ev AS (SELECT state, candidate AS action, 'n=' || CAST(count(*) AS VARCHAR) AS text FROM votes GROUP BY state, candidate),
g AS (SELECT state, CAST(count(*) AS INTEGER) AS n_actions, string_agg(action || ': ' || text, '\n' ORDER BY action) AS actions
      FROM ev GROUP BY state)
SELECT state, n_actions, {_fill('improve', {'state': 'state', 'actions': 'actions'})} AS user FROM g""",
    "p7_candidates": W("ep_events", "states") + """,
legal AS (SELECT DISTINCT state, action FROM ep_events WHERE action IS NOT NULL)
SELECT s.state, s.props, l.action FROM states s JOIN legal l ON l.state = s.state""",
    "p10_epsilon_split": W("ep_events", "states") + EPS + """
SELECT state, props, action, 'random' AS source, 'skipped' AS status FROM rnd
UNION ALL
SELECT state, props, action, 'model', status FROM moves""",
    "p11_extract_pattern": W("ep_events", "states") + EPS + "SELECT state, props, response, action, status FROM moves",
    "p11_extract_json": """
SELECT doc_id, CASE WHEN n_chars % 4 = 0 THEN 'move ' || CAST(n_chars % 9 AS VARCHAR) ELSE '' END AS answer,
       CASE WHEN n_chars % 4 = 0 THEN 'ok' ELSE 'default' END AS status FROM documents""",
    "p11_extract_verdict": W("verdicts") + VERDICT + """
SELECT doc_id, predict, CASE WHEN predict = 'undecided' THEN 'undecided' ELSE 'ok' END AS status FROM pv""",
    "p11_yield_report": W("verdicts") + VERDICT + """
SELECT CASE WHEN predict = 'undecided' THEN 'undecided' ELSE 'ok' END AS status, count(*) AS n, 'verdict' AS mode
FROM pv GROUP BY 1""",
    "p12_verdict_accuracy": W("verdicts") + VERDICT + """
SELECT CAST(count_if(predict = win) AS BIGINT) AS n_right, count(*) AS n_total,
       round(count_if(predict = win) / nullif(count(*), 0), 6) AS accuracy
FROM pv WHERE abs(win_rate) >= 0.2 AND predict <> 'undecided'""",
    "p13_move_distribution": W("logprobs") + f""",
t AS (SELECT *, max(lp) OVER (PARTITION BY state) AS m FROM logprobs),
e AS (SELECT *, CASE WHEN m = '-inf'::DOUBLE THEN 1.0 WHEN lp = '-inf'::DOUBLE THEN 0.0 ELSE exp(lp - m) END AS ex FROM t),
p AS (SELECT *, ex / sum(ex) OVER (PARTITION BY state) AS p FROM e),
c AS (SELECT *, sum(p) OVER (PARTITION BY state ORDER BY move ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             coalesce(sum(p) OVER (PARTITION BY state ORDER BY move ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS prev,
             {_u2('42', 'CAST(state AS VARCHAR)')} AS u,
             row_number() OVER (PARTITION BY state ORDER BY move DESC) = 1 AS is_last,
             row_number() OVER (PARTITION BY state ORDER BY p DESC, move) = 1 AS is_argmax
      FROM p)
SELECT state, move, lp, round(p, 6) AS p, is_argmax,
       ((prev <= u AND u < cum) OR (is_last AND cum <= u)) AS is_sample
FROM c""",
})

from trajspark.operators.examples import MAX_TOKENS  # noqa: E402

XTOK = "list_filter(string_split_regex({x}, '" + WS + "'), lambda t: t <> '')"
RENDER = """,
r AS (SELECT conv_id, '<|start_header_id|>' || role || '<|end_header_id|>\n' || text || '<|eot_id|>\n' AS piece,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn,
             count(*) OVER (PARTITION BY conv_id) AS n
      FROM conversations),
rc AS (SELECT conv_id, CAST(max(n) AS INTEGER) AS n_messages,
              '<|begin_of_text|>' || coalesce(string_agg(piece, '' ORDER BY rn) FILTER (WHERE rn < n), '')
              || '<|start_header_id|>assistant<|end_header_id|>\n' AS query_text,
              '<|begin_of_text|>' || string_agg(piece, '' ORDER BY rn) AS full_text
       FROM r GROUP BY conv_id),
mk AS (SELECT conv_id, full_text, (""" + XTOK.format(x="full_text") + f""")[1:{MAX_TOKENS}] AS toks,
              CAST(len(""" + XTOK.format(x="query_text") + """) AS INTEGER) AS n_prompt FROM rc),
mk2 AS (SELECT conv_id, toks, CAST(len(toks) AS INTEGER) AS n_tokens, n_prompt,
               CAST(greatest(len(toks) - n_prompt, 0) AS INTEGER) AS n_label FROM mk)
"""

PPO = OWN_VALUES.replace(
    "own AS (SELECT user_id, week, step, value, final_value,",
    "own AS (SELECT user_id, week, step, state, action, value, final_value, -value + 0.1 * ((step % 3) - 1) AS lp,",
) + """,
c AS (SELECT *, reward + CASE WHEN done THEN 0.0 ELSE 0.99 * next_value END - value AS delta FROM nv),
r(user_id, week, pos, step, state, action, value, lp, adv) AS (
  SELECT user_id, week, pos, step, state, action, value, lp, delta FROM c WHERE pos = n - 1
  UNION ALL
  SELECT c.user_id, c.week, c.pos, c.step, c.state, c.action, c.value, c.lp,
         c.delta + 0.99 * 0.95 * (CASE WHEN c.done THEN 0 ELSE 1 END) * r.adv
  FROM c JOIN r ON c.user_id = r.user_id AND c.week = r.week AND c.pos = r.pos - 1),
ppo AS (SELECT user_id, week, step, state, action,
               (adv - avg(adv) OVER ()) / (stddev_samp(adv) OVER () + 1e-8) AS adv_norm, adv + value AS ret, lp AS old_lp
        FROM r)
"""

SQL.update({
    "x1_sft_pairs": f"""
WITH n AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations
           WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, turn, 3 AS n_messages, {_sys('student')} AS system, {_fill('student', {'text': 'text'})} AS user, next_text AS assistant
FROM n WHERE role = 'user' AND next_role = 'assistant'""",
    "x2_render_chat": "WITH dummy AS (SELECT 1)" + RENDER + "SELECT conv_id, n_messages, query_text, full_text FROM rc",
    "x3_label_masks": "WITH dummy AS (SELECT 1)" + RENDER + """
SELECT conv_id, n_tokens, n_prompt, n_label, n_label > 0 AS kept,
       CASE WHEN n_label > 0 THEN toks[n_prompt + 1] END AS first_label FROM mk2""",
    "x3_dropped": "WITH dummy AS (SELECT 1)" + RENDER + """
SELECT CAST(count_if(n_label <= 0) AS BIGINT) AS n_dropped, count(*) AS n_rows FROM mk2""",
    "x4_pad_batches": "WITH dummy AS (SELECT 1)" + RENDER + """,
k AS (SELECT conv_id, n_tokens AS length,
             CAST((row_number() OVER (ORDER BY md5(concat_ws('|', '42', CAST(conv_id AS VARCHAR))), conv_id) - 1) // 4 AS BIGINT) AS batch
      FROM mk2 WHERE n_label > 0)
SELECT conv_id, batch, length, CAST(max(length) OVER (PARTITION BY batch) AS INTEGER) AS padded_len,
       CAST(max(length) OVER (PARTITION BY batch) - length AS INTEGER) AS n_pad, length AS n_attention,
       CAST(max(length) OVER (PARTITION BY batch) AS INTEGER) AS n_padded
FROM k""",
    "x5_ppo_samples": _recursive(W("ep_events")) + PPO + """
SELECT user_id, CAST(week AS VARCHAR) AS week, step, state, action, round(adv_norm + 1e-9, 6) AS adv_norm,
       round(ret + 1e-9, 6) AS ret, round(old_lp, 6) AS old_lp FROM ppo""",
    "x5_not_null_audit": _recursive(W("ep_events")) + PPO + """
SELECT CAST(count_if(state IS NULL) AS BIGINT) AS null_state, CAST(count_if(action IS NULL) AS BIGINT) AS null_action,
       CAST(count_if(adv_norm IS NULL) AS BIGINT) AS null_adv_norm, CAST(count_if(ret IS NULL) AS BIGINT) AS null_ret,
       CAST(count_if(old_lp IS NULL) AS BIGINT) AS null_old_lp, count(*) AS n FROM ppo""",
})

SQL.update({
    "s1_read_buffer": W("ep_events") + """
SELECT user_id, CAST(week AS VARCHAR) AS week, step, state, action, CAST(reward AS DOUBLE) AS reward,
       CASE WHEN action IS NOT NULL THEN turn END AS turn, is_terminal FROM ep_events""",
    "s1_rejects": """
SELECT CAST(sum(len(list_filter(string_split('{"state": ' || text, chr(10)), lambda x: NOT regexp_matches(x, '^\\s*$'))))
            AS BIGINT) AS n_rejects
FROM documents""",
    "s4_read_runs": W("ep_events") + """
SELECT 'iter-' || CAST(iter AS VARCHAR) AS run, user_id, CAST(week AS VARCHAR) AS week, step, state, action,
       CAST(reward AS DOUBLE) AS reward, CASE WHEN action IS NOT NULL THEN turn END AS turn, is_terminal
FROM ep_events""",
    "s5_read_states": """
SELECT 'trajectory' AS src, state FROM (SELECT DISTINCT event_type AS state FROM events) t
UNION ALL
SELECT 'states' AS src, state FROM (SELECT DISTINCT event_type AS state FROM events) s""",
    "s10_manifest": W("ep_events") + """
SELECT '{"filter": "action is not null", "seed": 42, "view": "ep_events"}' AS params,
       count(*) AS n_rows, count(DISTINCT (user_id, week)) AS n_episodes
FROM ep_events WHERE action IS NOT NULL""",
    "s3_merge_keyed": W("keyed") + "SELECT key, arg_max(value, seq) AS value FROM keyed GROUP BY key",
    "s6_history_window": W("ep_events") + """
SELECT user_id, CAST(week AS VARCHAR) AS week, step, iter, state FROM ep_events WHERE iter BETWEEN 2 AND 4""",
    "s7_contiguous_iterations": W("ep_events") + """,
its AS (SELECT iter, row_number() OVER (ORDER BY iter) AS rn FROM (SELECT DISTINCT iter FROM ep_events) d)
SELECT e.iter, count(*) AS n_steps FROM ep_events e JOIN its ON its.iter = e.iter AND its.rn = its.iter GROUP BY e.iter""",
    "s9_value_table": SQL["v3_td0"].replace(
        "SELECT v2.state, round(v2.value, 6) AS value,", "SELECT v2.state, round(v2.value, 3) AS value,"
    ),
})

SQL.update({
    "m1_new_states": "SELECT DISTINCT event_type AS state, props FROM events",
    "m1_new_states_state": "SELECT DISTINCT event_type AS state, props FROM events",
    "m1_new_states_watermark": "SELECT DISTINCT event_type AS state, props FROM events",
    "m2_live_metrics": """
SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS window_start, event_type AS state, count(*) AS n,
       round(avg(value), 6) AS mean_value, min(value) AS min_value, max(value) AS max_value
FROM events GROUP BY 1, 2""",
    "m3_assemble_episodes": """
WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS brk
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g),
e AS (SELECT user_id, min(ts) AS st, max(ts) + INTERVAL 2 HOUR AS en, count(*) AS n_steps,
             string_agg(event_type, ' ' ORDER BY ts, event_id) AS states
      FROM s GROUP BY user_id, sid)
SELECT user_id, CAST(st AS VARCHAR) AS session_start, CAST(en AS VARCHAR) AS session_end, n_steps, states
FROM e""",
    "m3_terminal_episodes": """
WITH b AS (SELECT *, lag(event_type) OVER w AS prev_type, lag(ts) OVER w AS prev_ts, lead(ts) OVER w AS next_ts
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, CASE WHEN prev_ts IS NULL OR prev_type IN ('purchase', 'error') OR ts - prev_ts >= INTERVAL 2 HOUR
                     THEN 1 ELSE 0 END AS brk FROM b),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS eid FROM g),
l AS (SELECT *, lead(eid) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM eid AS is_last FROM s),
e AS (SELECT user_id, min(ts) AS st, max(ts) AS en, count(*) AS n_steps,
             string_agg(event_type, ' ' ORDER BY ts, event_id) AS states,
             bool_or(is_last AND event_type IN ('purchase', 'error')) AS term,
             max(CASE WHEN is_last THEN next_ts END) AS nxt
      FROM l GROUP BY user_id, eid)
SELECT user_id, CAST(st AS VARCHAR) AS episode_start, CAST(en AS VARCHAR) AS episode_end, n_steps, states,
       CASE WHEN term THEN 'terminal' ELSE 'inactive' END AS closed_by
FROM e""",
    "m4_resume": "SELECT event_id, event_type AS state, 2 AS runs_with_new_rows FROM events",
})

SQL.update({
    "a9_leaderboard": W("ep_events") + "," + FACTS + """,
grid AS (SELECT ((e.i * 2 + p.i) * 4 + a.i) AS combo, e.v AS max_episode, p.v AS epsilon, a.v AS alpha
         FROM (VALUES (0, 10000), (1, 15000), (2, 20000), (3, 25000)) e(i, v),
              (VALUES (0, 0.10::DOUBLE), (1, 0.15::DOUBLE)) p(i, v),
              (VALUES (0, 0.3::DOUBLE), (1, 0.4::DOUBLE), (2, 0.5::DOUBLE), (3, 0.6::DOUBLE)) a(i, v)),
res AS (SELECT CAST(('0x' || substr(md5(concat_ws('|', '42', CAST(user_id AS VARCHAR), CAST(week AS VARCHAR))), 1, 8))::BIGINT % 32 AS INTEGER) AS combo,
               iter - 1 AS repeat, count_if(final_reward = -1) AS losses, count(*) AS games
        FROM facts GROUP BY 1, 2),
first AS (SELECT combo, CAST(sum(losses) AS BIGINT) AS base_win FROM res WHERE repeat = 0 GROUP BY combo),
top AS (SELECT g.*, f.base_win FROM grid g JOIN first f ON f.combo = g.combo
        ORDER BY base_win, max_episode, epsilon, alpha LIMIT 10),
rep AS (SELECT combo, sum(losses) AS rep_losses, CAST(sum(games) AS BIGINT) AS rep_games, count(DISTINCT repeat) AS n_repeats
        FROM res WHERE repeat > 0 GROUP BY combo)
SELECT t.combo, CAST(max_episode AS INTEGER) AS max_episode, epsilon, alpha, base_win,
       round(rep_losses / rep_games * 100, 2) AS lose_pct,
       round(rep_losses / n_repeats / rep_games * 100, 2) AS lose_pct_ref, rep_games
FROM top t JOIN rep r ON r.combo = t.combo
ORDER BY lose_pct, max_episode, epsilon, alpha LIMIT 5""",
    "d2_distinct_variations": W("lookahead_ev") + """
SELECT user_id, state, CAST(count(*) + 1 AS INTEGER) AS n_variations,
       CAST(count(DISTINCT (array_to_string(pv_actions, ' '), final_state)) AS INTEGER) AS n_distinct
FROM lookahead_ev GROUP BY user_id, state""",
})

VOTED = f""",
legal AS (SELECT state, list_sort(list(DISTINCT CAST(length(action) AS INTEGER))) AS legal FROM (
            SELECT state, lead(state) OVER (PARTITION BY user_id, week ORDER BY step) AS action FROM ep_events) t
          WHERE action IS NOT NULL GROUP BY state),
rep AS (SELECT s.state, s.props, l.legal, CAST(unnest(range(3)) AS INTEGER) AS replica FROM states s JOIN legal l ON l.state = s.state),
pr AS (SELECT *, {_fill('move_sample', {'state': "state || ' ' || props", 'moves': "array_to_string(legal, ',')", 'sample': 'replica'})} AS user
       FROM rep),
resp AS (SELECT *, '{{"best_move": ' || CAST(length(user) % 9 + 1 AS VARCHAR) || '}}' AS response FROM pr),
ext AS (SELECT *, CASE WHEN len(string_split(response, '"best_move": ')) >= 2 THEN string_split(response, '"best_move": ')[2] END AS after
        FROM resp),
ext2 AS (SELECT *, TRY_CAST(substr(after, 1, 1) AS INTEGER) - 1 AS idx,
                {_u2('42|pick', 'state, props, CAST(replica AS VARCHAR)')} AS u2 FROM ext),
mv AS (SELECT state, props, replica,
              CASE WHEN after IS NOT NULL AND coalesce(list_contains(legal, idx), false) THEN idx
                   ELSE legal[CAST(floor(u2 * len(legal)) AS INTEGER) + 1] END AS candidate
       FROM ext2)
"""

SQL["p7_candidates_voted"] = W("ep_events", "states") + VOTED + """
SELECT * FROM (
  SELECT state, props, candidate, count(*) AS n_votes, min(replica) AS first_seen,
         CAST(row_number() OVER (PARTITION BY state, props ORDER BY count(*) DESC, min(replica)) AS INTEGER) AS rank
  FROM mv GROUP BY state, props, candidate) t
WHERE rank <= 2"""

SQL["s8_export_requests"] = W("states") + f"""
SELECT 'request-' || CAST(row_number() OVER (ORDER BY state, props) - 1 AS VARCHAR) AS custom_id, 'POST' AS method,
       '/v1/chat/completions' AS url, concat_ws(' ', state, props) AS raw_data, 'model-under-test' AS model,
       CAST(1.0 AS DOUBLE) AS temperature, CAST(512 AS INTEGER) AS max_tokens,
       'system: ' || {_sys('evaluate')} || chr(10) || 'user: ' || {_fill('evaluate', {'state': "concat_ws(' ', state, props)", 'turn': "'true'"})} AS messages
FROM states"""
SQL["s1_two_player_win_rate"] = SQL["a1_win_rate"]
SQL["s3_read_keyed"] = W("keyed") + """
SELECT key, arg_max(value, seq) AS value, (SELECT count(*) FROM documents) AS n_rejects FROM keyed GROUP BY key"""
SQL["p9_write_back"] = W("lookahead_ev") + END_PROMPTS + """
SELECT user_id, state, pv_idx, array_to_string(pv_actions, ' ') AS pv_actions,
       CASE WHEN final_terminal THEN 'Terminal State.' ELSE final_state END AS final_state,
       CASE WHEN final_terminal THEN 'This is the terminal state.' ELSE eval END AS final_eval FROM att"""

SQL["p2_mc_state_prompts"] = W("ep_events") + f""",
sfx AS (SELECT user_id, week, step AS start, state, action, turn,
               CAST(sum(reward) OVER w AS BIGINT) AS rtg, list(action) OVER w AS acts
        FROM ep_events
        WINDOW w AS (PARTITION BY user_id, week ORDER BY step DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
games AS (SELECT user_id, week, start, state,
                 'actions: ' || array_to_string(list_reverse(list_filter(acts, lambda x: x IS NOT NULL)), ' ') || '; return: ' || CAST(rtg AS VARCHAR) AS game_text
          FROM sfx WHERE action IS NOT NULL AND turn),
ch AS (SELECT *, (rk - 1) // 5 AS chunk, (rk - 1) % 5 AS pos FROM (
         SELECT *, row_number() OVER (PARTITION BY state ORDER BY md5(concat_ws('|', '42', CAST(user_id AS VARCHAR), CAST(week AS VARCHAR), CAST(start AS VARCHAR))), user_id, week, start) AS rk
         FROM games) r),
g AS (SELECT state, CAST(chunk AS BIGINT) AS chunk, CAST(count(*) AS INTEGER) AS n_games,
             string_agg('Game ' || CAST(pos + 1 AS VARCHAR) || ': ' || game_text, '\n' ORDER BY pos) || '\nEnd of games.' AS games
      FROM ch GROUP BY state, chunk)
SELECT state, chunk, n_games, {_fill('mc_state', {'state': 'state', 'games': 'games'})} AS user FROM g"""
SQL["t6_audit_rules"] = W("ep_events") + """,
t AS (SELECT *, lag(turn) OVER w AS prev_turn, lead(state) OVER w AS next_state,
             CASE WHEN action IS NOT NULL AND NOT (state = 'error' AND action = 'signup') THEN action END AS wanted FROM ep_events
      WINDOW w AS (PARTITION BY user_id, week ORDER BY step))
SELECT 'alternation' AS rule, CAST(count_if(prev_turn IS NOT NULL) AS BIGINT) AS n_checked,
       CAST(count_if(prev_turn IS NOT NULL AND prev_turn = turn) AS BIGINT) AS n_violations FROM t
UNION ALL SELECT 'next_state', CAST(count_if(action IS NOT NULL) AS BIGINT),
       CAST(count_if(action IS NOT NULL AND wanted IS DISTINCT FROM next_state) AS BIGINT) FROM t
UNION ALL SELECT 'terminal_flag', CAST(count(*) AS BIGINT),
       CAST(count_if(is_terminal <> (next_state IS NULL)) AS BIGINT) FROM t
UNION ALL SELECT 'legal', CAST(count_if(action IS NOT NULL) AS BIGINT), CAST(count_if(action IS NOT NULL AND wanted IS NULL) AS BIGINT) FROM t"""
SQL["a4_key_counts_approx"] = SQL["a4_key_counts"]
SQL["v8_misses"] = W("ep_events") + GREEDY + """
SELECT user_id, CAST(week AS VARCHAR) AS week, CAST(step AS VARCHAR) || ':' || state AS node, action
FROM ep_events p WHERE action IS NOT NULL AND turn
  AND NOT EXISTS (SELECT 1 FROM greedy g WHERE g.node = CAST(p.step AS VARCHAR) || ':' || p.state AND g.action = p.action)"""


def _sft(template: str, slots: dict[str, str]) -> str:
    return W("votes") + f""",
ev AS (SELECT state, candidate AS action, count(*) AS n FROM votes GROUP BY state, candidate),
r AS (SELECT state, arg_max(action, (n, action)) AS action, CAST(sum(n) AS BIGINT) AS n FROM ev GROUP BY state)
SELECT state, CAST(3 AS INTEGER) AS n_messages, {_sys(template)} AS system, {_fill(template, slots)} AS user,
       'best ' || action || ' of ' || CAST(n AS VARCHAR) AS assistant FROM r"""


SQL["x1_sft_value"] = _sft("evaluate", {"state": "state", "turn": "'true'"})
SQL["x1_sft_action_value"] = _sft("q_student", {"state": "state", "action": "action"})
SQL["x1_sft_policy"] = _sft("move", {"state": "state", "moves": "action"})
SQL["p12_label_file"] = SQL["p12_verdict_accuracy"]


_GAMES = """
WITH g AS (SELECT DISTINCT user_id, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week FROM events),
c AS (SELECT user_id, week, cell, row_number() OVER (PARTITION BY user_id, week
             ORDER BY md5('42|' || CAST(user_id AS VARCHAR) || '|' || week || '|' || CAST(cell AS VARCHAR))) - 1 AS place
      FROM g CROSS JOIN range(9) t(cell)),
l AS (SELECT unnest([[0, 1, 2], [3, 4, 5], [6, 7, 8], [0, 3, 6], [1, 4, 7], [2, 5, 8], [0, 4, 8], [2, 4, 6]]) AS line),
f AS (SELECT user_id, week, line, max(place) AS ends, min(place % 2) AS who FROM c JOIN (SELECT line, unnest(line) AS cell FROM l) USING (cell)
      GROUP BY user_id, week, line HAVING min(place % 2) = max(place % 2)),
e AS (SELECT g.user_id, g.week, substr(md5('7|' || CAST(g.user_id AS VARCHAR) || '|' || g.week), 1, 1) AS spoil,
             coalesce(min(ends) + 1, 9) AS m, coalesce(arg_min(who + 1, ends), 0) AS winner
      FROM g LEFT JOIN f ON f.user_id = g.user_id AND f.week = g.week GROUP BY g.user_id, g.week),
k AS (SELECT *, m - CASE WHEN spoil = '1' THEN 1 ELSE 0 END AS n FROM e)
"""

SQL["t6_board_audit"] = _GAMES + """
SELECT 'alternation' AS rule, CAST(sum(n - 1) AS BIGINT) AS n_checked, CAST(coalesce(sum(n - 1) FILTER (spoil = '3'), 0) AS BIGINT) AS n_violations FROM k
UNION ALL SELECT 'mark', CAST(sum(n + 1) AS BIGINT), CAST(0 AS BIGINT) FROM k
UNION ALL SELECT 'legal', CAST(sum(n) AS BIGINT), CAST(count_if(spoil = '2') AS BIGINT) FROM k
UNION ALL SELECT 'next_state', CAST(sum(n) AS BIGINT), CAST(count_if(spoil = '2') AS BIGINT) FROM k
UNION ALL SELECT 'terminal_flag', CAST(sum(n + 1) AS BIGINT), CAST(count_if(spoil = '1') AS BIGINT) FROM k
UNION ALL SELECT 'winner', CAST(sum(n) AS BIGINT), CAST(count_if(spoil = '0') AS BIGINT) FROM k"""

SQL["t6_board_outcomes"] = _GAMES + """
SELECT CAST(CASE WHEN spoil = '1' THEN -1 ELSE winner END AS INT) AS winner, count(*) AS n_games, CAST(sum(n) AS BIGINT) AS n_moves FROM k GROUP BY 1"""

SQL["p13_extract_logprobs"] = """
WITH e AS (
  SELECT user_id AS state, CAST(CASE WHEN event_id % 7 = 0 THEN event_id % 9 + 1 ELSE length(event_type) % 9 + 1 END AS INT) AS move,
         CASE WHEN event_id % 7 = 0 THEN round(-value / 50, 6)
              WHEN event_id % 13 = 0 OR event_id % 11 = 0 OR event_id % 17 = 5 THEN '-inf'::DOUBLE ELSE round(-value / 100, 6) END AS lp
  FROM events WHERE event_id % 19 <> 0 AND event_id % 5 < 4),
m AS (SELECT DISTINCT user_id AS state, CAST(move AS INT) AS move FROM events, range(1, 10) t(move) WHERE (user_id + move) % 4 <> 0),
b AS (SELECT m.state, m.move, coalesce(max(lp), '-inf'::DOUBLE) AS lp, count(e.move) AS n_positions FROM m LEFT JOIN e ON e.state = m.state AND e.move = m.move GROUP BY m.state, m.move)
SELECT state, move, round(CASE WHEN max(lp) OVER w = '-inf'::DOUBLE THEN 0.0 ELSE lp END, 6) AS lp, n_positions, max(lp) OVER w = '-inf'::DOUBLE AS is_uniform
FROM b WINDOW w AS (PARTITION BY state)"""

SQL["a4_window_sketches"] = W("ep_events") + """,
own AS (SELECT iter, state, action FROM ep_events WHERE turn AND action IS NOT NULL)
SELECT i.iter, count(DISTINCT (state, action)) AS n_unique, count(*) AS n_pairs
FROM (SELECT DISTINCT iter FROM own) i JOIN own ON own.iter BETWEEN i.iter - 2 AND i.iter GROUP BY i.iter"""


def _td_sweeps(n: int) -> str:
    """Full synchronous sweeps, one after another."""
    out = """
WITH e AS (SELECT user_id, ts, event_id, event_type, event_type || ' ' || props AS state FROM events),
t AS (SELECT state, lead(state) OVER w AS next_state, lead(event_type) OVER w AS nt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT state, next_state, nt = 'error' AS over, count(*) AS n, CAST(sum(CASE nt WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) AS DOUBLE) AS r
      FROM t WHERE next_state IS NOT NULL GROUP BY ALL),
v0 AS (SELECT DISTINCT state, 0.0::DOUBLE AS value FROM (SELECT state FROM p UNION ALL SELECT next_state FROM p))"""
    for k in range(n):
        out += f""",
g{k} AS (SELECT p.state, sum(r + CASE WHEN over THEN 0 ELSE v.value * n END) / sum(n) AS target FROM p JOIN v{k} v ON v.state = p.next_state GROUP BY p.state),
v{k + 1} AS (SELECT v.state, CASE WHEN target IS NULL THEN value ELSE value + 0.4::DOUBLE * (target - value) END AS value FROM v{k} v LEFT JOIN g{k} g ON g.state = v.state)"""
    return out + f"""
SELECT v.state, round(value, 6) AS value, CAST(coalesce(n, 0) AS BIGINT) AS visits
FROM v{n} v LEFT JOIN (SELECT state, sum(n) AS n FROM p GROUP BY state) s ON s.state = v.state"""


SQL["v3_td0_delta"] = _td_sweeps(3)
