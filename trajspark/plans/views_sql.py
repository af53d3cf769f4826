"""DuckDB twins of the views in ``views`` (used only by the SQL oracle)."""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "ep_events": (
        (),
        """
        SELECT user_id, week,
               CAST((week - (SELECT min(CAST(date_trunc('week', ts) AS DATE)) FROM events)) // 7 + 1 AS INTEGER) AS iter,
               CAST(row_number() OVER w - 1 AS INTEGER) AS step,
               event_id,
               event_type AS state,
               lead(event_type) OVER w AS action,
               CAST(CASE WHEN lead(event_type) OVER w IS NULL THEN NULL
                         WHEN lead(event_type, 2) OVER w IS NULL THEN
                              CASE lead(event_type) OVER w WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END
                         ELSE 0 END AS INTEGER) AS reward,
               ((user_id + row_number() OVER w - 1) % 2 = 0) AS turn,
               lead(event_type) OVER w IS NULL AS is_terminal,
               round(value / 400, 6) AS value
        FROM (SELECT *, CAST(date_trunc('week', ts) AS DATE) AS week FROM events) e
        WINDOW w AS (PARTITION BY user_id, week ORDER BY ts, event_id)
        """,
    ),
    "ep_orders": (
        (),
        """
        SELECT l_orderkey,
               CAST(row_number() OVER w - 1 AS INTEGER) AS step,
               l_returnflag || l_linestatus AS state,
               lead(l_returnflag || l_linestatus) OVER w AS action,
               CASE WHEN lead(l_returnflag || l_linestatus) OVER w IS NULL THEN NULL ELSE l_quantity END AS reward,
               ((row_number() OVER w - 1) % 2 = 0) AS turn,
               lead(l_returnflag || l_linestatus) OVER w IS NULL AS is_terminal,
               l_extendedprice AS value
        FROM lineitem
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
                     l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)
        """,
    ),
    "states": (
        (),
        """
        SELECT state, props, state = 'error' AS is_terminal
        FROM (SELECT DISTINCT event_type AS state, props FROM events) d
        """,
    ),
    "raw_states": ((), "SELECT event_type AS state, props, event_id, user_id FROM events"),
    "votes": ((), "SELECT user_id AS state, event_type AS candidate, event_id AS sample_idx FROM events"),
    "policy_log": (
        ("ep_events",),
        """
        SELECT user_id, week, iter, step, state, action, reward, turn, value,
               -value AS old_lp,
               -value + 0.1 * ((step % 3) - 1) AS lp,
               reward - value AS adv
        FROM ep_events WHERE action IS NOT NULL
        """,
    ),
    "chats": ((), "SELECT conv_id, turn, role, text FROM conversations"),
    "keyed": ((), "SELECT user_id AS key, event_type AS value, event_id AS seq FROM events"),
    "graph_edges": (
        (),
        """
        SELECT 'p' || CAST(l_partkey AS VARCHAR) AS src, 's' || CAST(l_suppkey AS VARCHAR) AS dst
        FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) a
        UNION ALL
        SELECT 's' || CAST(l_suppkey AS VARCHAR), 'p' || CAST(l_partkey AS VARCHAR)
        FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) b
        """,
    ),
    "week_states": (
        (),
        """
        SELECT event_type AS state, props, event_type = 'error' AS is_terminal,
               CAST((CAST(date_trunc('week', ts) AS DATE) - (SELECT min(CAST(date_trunc('week', ts) AS DATE)) FROM events)) // 7 + 1 AS INTEGER) AS iter
        FROM events
        """,
    ),
    "batch_rows": ((), "SELECT DISTINCT user_id FROM events"),
    "lookahead_ev": (
        ("ep_events",),
        """
          SELECT user_id, week, step, state, state AS current_state,
                 list_filter(acts, lambda x: x IS NOT NULL) AS pv_actions,
                 list_filter(rws, lambda x: x IS NOT NULL) AS pv_rewards,
                 CASE WHEN a_state IS NULL OR a_term THEN last_state ELSE a_state END AS final_state,
                 CAST(NULL AS VARCHAR) AS final_eval,
                 CASE WHEN a_state IS NULL OR a_term THEN NULL ELSE a_turn END AS final_turn,
                 (a_state IS NULL OR a_term) AS final_terminal,
                 CAST(row_number() OVER (PARTITION BY user_id, state
                      ORDER BY md5(concat_ws('|', '42', CAST(user_id AS VARCHAR), CAST(week AS VARCHAR), CAST(step AS VARCHAR))), user_id, week, step) - 1
                      AS INTEGER) AS pv_idx
          FROM (SELECT *, list(action) OVER f AS acts, list(reward) OVER f AS rws,
                       lead(state, 4) OVER w AS a_state, lead(is_terminal, 4) OVER w AS a_term, lead(turn, 4) OVER w AS a_turn,
                       arg_max(state, step) OVER (PARTITION BY user_id, week) AS last_state
                FROM ep_events
                WINDOW w AS (PARTITION BY user_id, week ORDER BY step),
                       f AS (PARTITION BY user_id, week ORDER BY step ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) t
          WHERE action IS NOT NULL
        """,
    ),
    "verdicts": (
        (),
        """
        SELECT d.doc_id,
               CASE WHEN n_chars % 3 = 0 THEN '<white> early. ' ELSE '' END ||
               CASE WHEN lang = 'de' THEN 'Advantage: unclear'
                    WHEN n_chars % 5 = 0 THEN 'Advantage: <black> and <white>'
                    WHEN n_chars % 2 = 0 THEN 'Advantage: <black>'
                    ELSE 'Advantage: <white>' END AS response,
               CASE WHEN quality = 1 THEN 'black' ELSE 'white' END AS win,
               CAST(quality - toxic AS DOUBLE) AS win_rate
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id
        """,
    ),
    "logprobs": (
        (),
        """
        SELECT g.state, g.move, coalesce(s.lp, '-inf'::DOUBLE) AS lp
        FROM (SELECT u.user_id AS state, m.event_type AS move FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT event_type FROM events) m) g
        LEFT JOIN (SELECT user_id AS state, event_type AS move, round(-avg(value) / 100, 6) AS lp FROM events
                   GROUP BY 1, 2) s ON s.state = g.state AND s.move = g.move
        """,
    ),
}


def with_views(*names: str) -> str:
    """``WITH`` clause defining the named views and their dependencies, in order."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in ordered:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        ordered.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered) + "\n"
