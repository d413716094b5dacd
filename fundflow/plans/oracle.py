"""SQL oracle: each registered query written once more as plain SQL.

The strings run on DuckDB over the driver tables (``lineitem``, ``orders``,
``customer``, ``supplier`` registered as views) and must give the same rows
as the Spark query of the same key.  They share one ``WITH`` block that
rebuilds the model's inputs (same adapter as ``sources.fixtures``) and the
model's stages (actions, nodes, edges, timeline) in SQL.
"""
from __future__ import annotations

from ..sources.fixtures import PROFILES

ORDER = 'ts_ms, hash, "from", "to", amount, label'
AS_OF_POSITION = 500


def _adapter(profile: str) -> str:
    p = PROFILES[profile]
    wallet = "concat('0x', lpad(lower(hex({k})), 40, '0'))"
    vault = "concat('0xf', lpad(lower(hex({k})), 39, '0'))"
    hsh = "concat('0x', lpad(lower(hex({k})), 64, '0'))"
    watch_cap = f" AND c_custkey < {p['watch_cap']}" if p["watch_cap"] is not None else ""
    vault_rule = (f"s_suppkey % {p['vault_mod']} = 0" if p["vault_mod"] is not None
                  else f"s_suppkey < {p['vault_cap']}")
    receiver = "l_partkey" if p["receiver_mod"] is None else f"l_partkey % {p['receiver_mod']}"
    role_cap = f" AND c_custkey <= {p['role_cap']}" if p["role_cap"] is not None else ""
    hop = "c_custkey = 0" if p["hop_step"] is None else f"c_custkey % {p['hop_step']} = 0"
    btime = ("strftime(o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)), "
             "'%Y-%m-%d %H:%M:%S') || '.000 UTC'")
    return f"""
watchlist AS (
  SELECT {wallet.format(k='c_custkey')} AS address
  FROM customer WHERE c_custkey % 5 = 0{watch_cap}),
vaults AS (
  SELECT {vault.format(k='s_suppkey')} AS address FROM supplier WHERE {vault_rule}),
roles AS (
  SELECT address, 'thorchain' AS role, 2 AS priority FROM vaults
  UNION ALL
  SELECT {wallet.format(k='c_custkey')},
         CASE WHEN {hop} THEN 'pre-inter' ELSE 'attacker' END,
         CASE WHEN {hop} THEN 3 ELSE 1 END
  FROM customer WHERE c_custkey % {p['role_step']} = 0{role_cap}),
transfers AS (
  SELECT {hsh.format(k='l_orderkey')} AS tx_hash,
         {btime} AS block_time,
         {wallet.format(k='o_custkey')} AS from_address,
         CASE WHEN l_returnflag = 'R' THEN {vault.format(k='l_suppkey')}
              ELSE {wallet.format(k=receiver)} END AS to_address,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(38,18)) AS amount,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(38,18)) AS amount_usd
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
transactions AS (
  SELECT {hsh.format(k='o_orderkey')} AS hash,
         {btime} AS block_time,
         {wallet.format(k='o_custkey')} AS "from",
         CASE WHEN sk IS NULL THEN {wallet.format(k='o_custkey')} ELSE {vault.format(k='sk')} END AS "to"
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS sk FROM lineitem
                    WHERE l_returnflag = 'R' GROUP BY l_orderkey) m
    ON l_orderkey = o_orderkey)"""


_MODEL = """
mutual AS (
  SELECT tx_hash, block_time, from_address, to_address, amount, amount_usd,
         'mutual_transfer' AS label
  FROM transfers
  WHERE from_address IN (SELECT address FROM watchlist)
    AND to_address IN (SELECT address FROM watchlist)),
calls AS (SELECT hash, block_time, "from", "to" FROM transactions
          WHERE "to" IN (SELECT address FROM vaults)),
exits AS (
  SELECT t.tx_hash, t.block_time, t.from_address, t.to_address, t.amount, t.amount_usd,
         'thorchain_launder' AS label
  FROM transfers t JOIN calls x
    ON t.tx_hash = x.hash AND t.from_address = x."from" AND t.to_address = x."to"),
actions AS (SELECT * FROM mutual UNION ALL SELECT * FROM exits),
edges AS (
  SELECT from_address AS "from", to_address AS "to", tx_hash,
         CAST(round(amount, 4) AS DOUBLE) AS amount_eth,
         CAST(round(amount_usd, 2) AS DOUBLE) AS amount_usd,
         block_time AS "timestamp", label
  FROM actions),
ends AS (
  SELECT from_address AS address, 'send' AS side, amount, amount_usd FROM actions
  UNION ALL
  SELECT to_address, 'receive', amount, amount_usd FROM actions),
rroles AS (
  SELECT lower(address) AS address, first(role ORDER BY priority, role) AS role
  FROM roles WHERE address IS NOT NULL GROUP BY lower(address)),
sums AS (
  SELECT address,
         sum(CASE WHEN side = 'send' THEN amount END) AS s_sent,
         sum(CASE WHEN side = 'receive' THEN amount END) AS s_recv,
         sum(CASE WHEN side = 'send' THEN amount_usd END) AS s_sent_usd,
         sum(CASE WHEN side = 'receive' THEN amount_usd END) AS s_recv_usd,
         count(*) AS tx_count
  FROM ends WHERE address IS NOT NULL GROUP BY address),
stats AS (
  SELECT address,
         CAST(round(coalesce(s_sent, 0), 4) AS DOUBLE) AS total_sent,
         CAST(round(coalesce(s_recv, 0), 4) AS DOUBLE) AS total_received,
         CAST(round(coalesce(s_sent_usd, 0), 2) AS DOUBLE) AS total_sent_usd,
         CAST(round(coalesce(s_recv_usd, 0), 2) AS DOUBLE) AS total_received_usd,
         tx_count
  FROM sums),
nodes AS (
  SELECT s.address AS id, substr(s.address, 1, 6) || '.....' || right(s.address, 4) AS short,
         coalesce(r.role, 'inter') AS role, s.total_sent, s.total_received, s.tx_count
  FROM stats s LEFT JOIN rroles r ON s.address = r.address),
tl AS (
  SELECT * FROM (
    SELECT from_address AS "from", to_address AS "to",
           CAST(round(amount, 4) AS DECIMAL(38,18)) AS amount,
           epoch_ms(strptime(replace(block_time, ' UTC', ''), '%Y-%m-%d %H:%M:%S.%g')) AS ts_ms,
           label, tx_hash AS hash
    FROM actions) WHERE ts_ms IS NOT NULL),
bounds AS (
  SELECT min(ts_ms) AS start_ms, max(ts_ms) AS end_ms,
         greatest(max(ts_ms) - min(ts_ms), 1) AS span_ms, count(*) AS events FROM tl),
attackers AS (SELECT id AS address FROM nodes WHERE role = 'attacker'),
seen AS (
  SELECT tl.* FROM tl, bounds
  WHERE (ts_ms - start_ms) * 1000 <= {pos} * span_ms),
tl_ends AS (
  SELECT "from" AS address, 0 AS side_rank, * FROM tl
  UNION ALL
  SELECT "to" AS address, 1 AS side_rank, * FROM tl),
firsts AS (
  SELECT address, ts_ms AS f_ts, hash AS f_hash, "from" AS f_from, "to" AS f_to,
         amount AS f_amount, label AS f_label, side_rank AS f_side
  FROM (SELECT *, row_number() OVER (PARTITION BY address
                                     ORDER BY {order}, side_rank) AS rn
        FROM tl_ends WHERE address IS NOT NULL) WHERE rn = 1),
ev AS (
  SELECT ((ts_ms - start_ms) * 1000 + span_ms - 1) // span_ms AS frame,
         ((ts_ms + 36000000 - start_ms) * 1000 + span_ms - 1) // span_ms AS settle,
         amount, label, "from", "to"
  FROM tl, bounds)""".replace("{order}", ORDER).replace("{pos}", str(AS_OF_POSITION))


def _with(profile: str) -> str:
    return "WITH " + _adapter(profile).strip() + "," + _MODEL + "\n"


_T_AT = f"(SELECT start_ms + ({AS_OF_POSITION} * span_ms) / CAST(1000 AS DOUBLE) FROM bounds)"


def _totals(src: str) -> str:
    return f"""
SELECT (SELECT count(*) FROM (SELECT "from" AS a FROM {src} UNION SELECT "to" FROM {src}
                              UNION SELECT address FROM attackers) WHERE a IS NOT NULL) AS wallets,
       count(*) AS transfers,
       CAST(coalesce(sum(amount), 0) AS DOUBLE) AS eth,
       CAST(coalesce(sum(CASE WHEN label = 'thorchain_launder' THEN amount ELSE 0 END), 0) AS DOUBLE) AS laundered,
       CAST(floor(CAST(coalesce(sum(amount), 0) AS DOUBLE) + 0.5) AS BIGINT) AS eth_whole,
       CAST(floor(CAST(coalesce(sum(CASE WHEN label = 'thorchain_launder' THEN amount ELSE 0 END), 0) AS DOUBLE) + 0.5) AS BIGINT) AS laundered_whole,
       format('{{:,}}', CAST(floor(CAST(coalesce(sum(amount), 0) AS DOUBLE) + 0.5) AS BIGINT)) AS eth_text,
       format('{{:,}}', CAST(floor(CAST(coalesce(sum(CASE WHEN label = 'thorchain_launder' THEN amount ELSE 0 END), 0) AS DOUBLE) + 0.5) AS BIGINT)) AS laundered_text
FROM {src}"""


_FRAMES = """
SELECT g.frame,
       (SELECT start_ms FROM bounds) + (g.frame * (SELECT span_ms FROM bounds)) / CAST(1000 AS DOUBLE) AS t_ms,
       CAST(sum(coalesce(s.n, 0)) OVER w AS BIGINT) AS events,
       CAST(sum(coalesce(s.eth, 0)) OVER w AS DOUBLE) AS eth,
       CAST(sum(coalesce(s.lnd, 0)) OVER w AS DOUBLE) AS laundered,
       CAST(sum(coalesce(f.n, 0)) OVER w AS BIGINT) AS wallets,
       CAST(sum(coalesce(s.n, 0)) OVER w - sum(coalesce(d.n, 0)) OVER w AS BIGINT) AS in_flight
FROM (SELECT range AS frame FROM range(0, 1001)) g
LEFT JOIN (SELECT frame, count(*) AS n, sum(amount) AS eth,
                  sum(CASE WHEN label = 'thorchain_launder' THEN amount ELSE 0 END) AS lnd
           FROM ev GROUP BY frame) s ON g.frame = s.frame
LEFT JOIN (SELECT settle AS frame, count(*) AS n FROM ev WHERE settle <= 1000 GROUP BY settle) d
  ON g.frame = d.frame
LEFT JOIN (SELECT frame, count(*) AS n FROM (
             SELECT address, min(frame) AS frame FROM (
               SELECT "from" AS address, frame FROM ev UNION ALL SELECT "to", frame FROM ev
               UNION ALL SELECT address, 0 FROM attackers) WHERE address IS NOT NULL
             GROUP BY address) GROUP BY frame) f ON g.frame = f.frame
WINDOW w AS (ORDER BY g.frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def _activation(delay: int, play: bool) -> str:
    visible = "CASE WHEN t <= (SELECT end_ms FROM bounds) THEN t END" if play else "t"
    return f"""
SELECT n.id AS address, n.role,
       CAST(CASE WHEN n.role = 'attacker' THEN (SELECT start_ms FROM bounds) ELSE {visible} END AS BIGINT)
         AS activation_ms
FROM nodes n LEFT JOIN (
  SELECT address, min(CASE WHEN side_rank = 0 THEN ts_ms ELSE ts_ms + {delay} END) AS t
  FROM tl_ends WHERE address IS NOT NULL GROUP BY address) a ON n.id = a.address"""


_ACTIONS = ("SELECT tx_hash, block_time, from_address, to_address, CAST(amount AS DOUBLE) AS amount, "
            "CAST(amount_usd AS DOUBLE) AS amount_usd, label FROM {src}")
_TL = 'SELECT "from", "to", CAST(amount AS DOUBLE) AS amount, ts_ms, label, hash FROM {src}'
_NODES = "SELECT id, short, role, total_sent, total_received, tx_count FROM nodes"
_EDGES = 'SELECT "from", "to", tx_hash, amount_eth, amount_usd, "timestamp", label FROM edges'
_TITLE = ("CASE role WHEN 'thorchain' THEN 'ATTACKER EXIT VIA THORCHAIN BRIDGE' "
          "WHEN 'inter' THEN 'LAUNDERING ADDRESS' WHEN 'pre-inter' THEN 'LAUNDERING ADDRESS' "
          "ELSE upper(role) END")
_LEGEND = ("upper(CASE role WHEN 'attacker' THEN 'Attacker Entry' WHEN 'pre-inter' THEN 'Hop Address' "
           "WHEN 'inter' THEN 'Intermediate Node' WHEN 'thorchain' THEN 'Bridge Exit' ELSE upper(role) END)")
_PAIR = "concat_ws(':', least(\"from\", \"to\"), greatest(\"from\", \"to\"))"


def _money_text(expr: str, d: int) -> str:
    return f"CAST(CAST(round({expr}, {d}) AS DECIMAL(38,{d})) AS VARCHAR) || ' ETH'"


def _whole(expr: str) -> str:
    return f"CAST(floor(CAST({expr} AS DOUBLE) + 0.5) AS BIGINT)"


_W1 = f"""
SELECT "from", "to", CAST(amount AS DOUBLE) AS amount, ts_ms, label, hash, pair_key, pair_seq,
       CAST(30 + (pair_seq * 12) % 180 AS BIGINT) AS curvature
FROM (SELECT *, {_PAIR} AS pair_key,
             row_number() OVER (PARTITION BY {_PAIR} ORDER BY {ORDER}) AS pair_seq FROM tl)"""

BODIES: dict[str, str] = {
    "S1_scan_transfers": _ACTIONS.replace(", label", "").format(src="transfers"),
    "S2_scan_transactions": 'SELECT hash, block_time, "from", "to" FROM transactions',
    "S3_watchlist": "SELECT address FROM watchlist",
    "S4_vaults": "SELECT address FROM vaults",
    "S5_roles": "SELECT address, role, CAST(priority AS BIGINT) AS priority FROM roles",
    "S6_write_actions": _ACTIONS.format(src="actions"),
    "S7_scan_actions": _ACTIONS.format(src="actions"),
    "S8_write_graph": _NODES,
    "S9_read_graph": _EDGES,
    "S10_preview": _ACTIONS.format(src="actions")
    + " ORDER BY block_time, tx_hash, from_address, to_address, amount, label LIMIT 5",
    "P1_with_label": _ACTIONS.replace("label", "'mutual_transfer' AS label").format(src="transfers"),
    "P2_action_columns": _ACTIONS.format(src="actions"),
    "P3_drop_right_time": _ACTIONS.format(src="exits"),
    "P4_cast_amounts": ("SELECT tx_hash, CAST(amount AS DOUBLE) AS amount, "
                        "CAST(amount_usd AS DOUBLE) AS amount_usd, label FROM actions"),
    "P5_lower_keys": ("SELECT lower(tx_hash) AS tx_hash, lower(from_address) AS from_address, "
                      "lower(to_address) AS to_address FROM transfers"),
    "P6_edge_projection": _EDGES,
    "P7_timeline_projection": _TL.format(src="tl"),
    "P7_untimed_count": "SELECT count(*) AS untimed FROM actions WHERE right(tx_hash, 1) = '7'",
    "F1_both_endpoints_watched": _ACTIONS.format(src="mutual"),
    "F2_calls_into_vault": 'SELECT hash, block_time, "from", "to" FROM calls',
    "F3_is_exit": _TL.format(src="tl") + " WHERE label = 'thorchain_launder'",
    "F4_as_of": _TL.format(src="seen"),
    "F5_role_filter": _NODES + " WHERE role = 'attacker'",
    "F6_wallet_detail": f"""
SELECT id AS address, role, tx_count AS txns, {_whole('total_sent')} AS sent,
       {_whole('total_received')} AS received, {_TITLE} AS title
FROM nodes WHERE id = (SELECT id FROM nodes ORDER BY tx_count DESC, id LIMIT 1)""",
    "F7_transfer_detail": f"""
SELECT "from", "to", CAST(amount AS DOUBLE) AS amount, {_money_text('amount', 4)} AS amount_text, hash, ts_ms
FROM tl WHERE hash = (SELECT hash FROM tl GROUP BY hash ORDER BY count(*) DESC, hash LIMIT 1)""",
    "F8_labelled_amount": f"""
SELECT hash, "from", "to", ts_ms,
       CASE WHEN amount > 0.01 THEN {_money_text('amount', 2)} END AS amount_label FROM tl""",
    "J1_exit_transfers": _ACTIONS.format(src="exits"),
    "J2_watch_semi": _ACTIONS.format(src="mutual"),
    "J3_role_lookup": """
SELECT w.address, coalesce(r.role, 'inter') AS role
FROM (SELECT DISTINCT address FROM ends WHERE address IS NOT NULL) w
LEFT JOIN rroles r ON w.address = r.address""",
    "J4_edge_with_roles": """
SELECT e."from", e."to", e.tx_hash, e.amount_eth, e.amount_usd, e."timestamp", e.label,
       coalesce(a.role, 'inter') AS from_role, coalesce(b.role, 'inter') AS to_role
FROM edges e LEFT JOIN nodes a ON e."from" = a.id LEFT JOIN nodes b ON e."to" = b.id""",
    "A1_total_sent": "SELECT address, total_sent FROM stats",
    "A2_total_received": "SELECT address, total_received FROM stats",
    "A3_tx_count": "SELECT address, tx_count FROM stats",
    "A4_wallet_stats": _NODES,
    "A5_distinct_wallets": "SELECT DISTINCT address FROM ends WHERE address IS NOT NULL",
    "A6_role_counts": """
SELECT r.role, count(n.id) AS wallets
FROM (VALUES ('attacker'), ('thorchain'), ('pre-inter'), ('inter')) r(role) LEFT JOIN nodes n ON n.role = r.role
GROUP BY r.role""",
    "A7_graph_summary": """
SELECT count(*) AS wallets,
       CAST(coalesce(sum(CASE WHEN role = 'attacker' THEN 1 ELSE 0 END), 0) AS BIGINT) AS attacker_wallets,
       CAST(coalesce(sum(CASE WHEN role = 'pre-inter' THEN 1 ELSE 0 END), 0) AS BIGINT) AS pre_inter_wallets,
       CAST(coalesce(sum(CASE WHEN role = 'inter' THEN 1 ELSE 0 END), 0) AS BIGINT) AS inter_wallets,
       CAST(coalesce(sum(CASE WHEN role = 'thorchain' THEN 1 ELSE 0 END), 0) AS BIGINT) AS thorchain_wallets,
       (SELECT count(*) FROM edges) AS edges
FROM nodes""",
    "A8_time_bounds": "SELECT start_ms, end_ms, CAST(span_ms AS BIGINT) AS span_ms, events FROM bounds",
    "A9_flow_totals": _totals("tl"),
    "A10_pair_counts": """
SELECT least("from", "to") AS wallet_a, greatest("from", "to") AS wallet_b,
       concat_ws(':', least("from", "to"), greatest("from", "to")) AS pair_key, count(*) AS transfers
FROM tl GROUP BY 1, 2""",
    "A11_wallet_usd_totals": ("SELECT address, total_sent, total_received, total_sent_usd, "
                              "total_received_usd, tx_count FROM stats"),
    "W1_pair_sequence": _W1,
    "W2_global_sequence": f"""
SELECT "from", "to", CAST(amount AS DOUBLE) AS amount, ts_ms, label, hash, idx,
       CAST(30 + (idx * 17) % 150 AS BIGINT) AS curvature
FROM (SELECT *, row_number() OVER (ORDER BY {ORDER}) - 1 AS idx FROM tl)""",
    "W3_running_totals": f"""
SELECT "from", "to", CAST(amount AS DOUBLE) AS amount, ts_ms, label, hash,
       row_number() OVER (ORDER BY {ORDER}) AS tx_number,
       CAST(sum(amount) OVER w AS DOUBLE) AS cum_eth,
       CAST(sum(CASE WHEN label = 'thorchain_launder' THEN amount ELSE 0 END) OVER w AS DOUBLE) AS cum_laundered
FROM tl WINDOW w AS (ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "W4_running_wallet_totals": f"""
SELECT address, CAST(side_rank AS BIGINT) AS side_rank, "from", "to", CAST(amount AS DOUBLE) AS amount,
       ts_ms, label, hash,
       row_number() OVER (PARTITION BY address ORDER BY {ORDER}, side_rank) AS txns,
       CAST(sum(CASE WHEN side_rank = 0 THEN amount ELSE 0 END) OVER w AS DOUBLE) AS sent,
       CAST(sum(CASE WHEN side_rank = 1 THEN amount ELSE 0 END) OVER w AS DOUBLE) AS received
FROM tl_ends WHERE address IS NOT NULL
WINDOW w AS (PARTITION BY address ORDER BY {ORDER}, side_rank
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "W5_first_appearance": """
SELECT address, f_ts AS first_ts_ms, CASE WHEN f_side = 0 THEN 'send' ELSE 'receive' END AS first_side,
       row_number() OVER (ORDER BY f_ts, f_hash, f_from, f_to, f_amount, f_label, f_side) - 1 AS appearance
FROM firsts""",
    "W6_lane_index": """
SELECT n.id AS address, n.role,
       row_number() OVER (PARTITION BY n.role ORDER BY f.f_ts NULLS LAST, f.f_hash, f.f_from, f.f_to,
                          f.f_amount, f.f_label, f.f_side, n.id) - 1 AS lane
FROM nodes n LEFT JOIN firsts f ON n.id = f.address""",
    "T1_snapshot": """
SELECT p.address, coalesce(n.role, 'inter') AS role, p.txns, p.sent, p.received
FROM (SELECT address, CAST(sum(one) AS BIGINT) AS txns, CAST(sum(s) AS DOUBLE) AS sent,
             CAST(sum(r) AS DOUBLE) AS received
      FROM (SELECT "from" AS address, 1 AS one, amount AS s, CAST(0 AS DECIMAL(38,18)) AS r FROM seen
            UNION ALL SELECT "to", 1, CAST(0 AS DECIMAL(38,18)), amount FROM seen
            UNION ALL SELECT address, 0, 0, 0 FROM attackers)
      WHERE address IS NOT NULL GROUP BY address) p
LEFT JOIN nodes n ON p.address = n.id""",
    "T2_totals_at": _totals("seen"),
    "T3_frames": _FRAMES,
    "T4_activation_play": _activation(36000000, True),
    "T4_activation_scrub": _activation(0, False),
    "T5_transfer_state": f"""
SELECT hash, "from", "to", ts_ms, label, p AS progress,
       CASE WHEN p < 0 THEN 'pending' WHEN p < 1 THEN 'in_flight' ELSE 'settled' END AS state
FROM (SELECT *, least(CAST(1 AS DOUBLE),
                      ({_T_AT} - CAST(ts_ms AS DOUBLE)) / CAST(36000000 AS DOUBLE)) AS p FROM tl)""",
    "T6_inflight_at": f"SELECT frame, t_ms, in_flight FROM ({_FRAMES})",
    "T7_scrub_position": """
SELECT hash, "from", "to", ts_ms,
       CAST(floor((CAST(ts_ms AS DOUBLE) - CAST(start_ms AS DOUBLE)) / CAST(span_ms AS DOUBLE)
                  * CAST(1000 AS DOUBLE) + 0.5) AS BIGINT) AS position
FROM tl, bounds""",
    "O1_timeline_order": _TL.format(src="tl") + f" ORDER BY {ORDER}",
    "O2_preview": _TL.format(src="tl") + f" ORDER BY {ORDER} LIMIT 5",
    "U1_actions": _ACTIONS.format(src="actions"),
    "U2_endpoints": ("SELECT address, side, CAST(amount AS DOUBLE) AS amount, "
                     "CAST(amount_usd AS DOUBLE) AS amount_usd FROM ends"),
    "X1_classify": "SELECT id, role FROM nodes",
    "X2_short_address": "SELECT id, short FROM nodes",
    "X3_address_tag": "SELECT id, substr(id, 1, 8) || '…' AS tag FROM nodes",
    "X4_role_title": f"SELECT id, role, {_TITLE} AS title FROM nodes",
    "X5_role_legend": f"SELECT id, role, {_LEGEND} AS legend FROM nodes",
    "X6_pair_key": f'SELECT hash, "from", "to", {_PAIR} AS pair_key FROM tl',
    "X7_edge_weight": """
SELECT hash, "from", "to",
       least(CAST(0.5 AS DOUBLE) + CAST(amount AS DOUBLE) / CAST(400 AS DOUBLE), CAST(3 AS DOUBLE)) AS weight
FROM tl""",
    "X8_curvature": """
SELECT hash, "from", "to", CAST(30 + (n * 12) % 180 AS BIGINT) AS pair_curve,
       CAST(30 + (n * 17) % 150 AS BIGINT) AS global_curve
FROM (SELECT *, (ts_ms // 60000) % 1000 AS n FROM tl)""",
    "X9_round_money": 'SELECT tx_hash, "from", "to", amount_eth, amount_usd FROM edges',
    "X10_round_whole": f"""
SELECT id, {_whole('total_sent')} AS sent_whole, format('{{:,}}', {_whole('total_received')}) AS received_text
FROM nodes""",
    "X11_amount_text": f"""
SELECT hash, "from", "to", {_money_text('amount', 2)} AS text_2dp, {_money_text('amount', 4)} AS text_4dp
FROM tl""",
    "X12_parse_time": """
SELECT tx_hash, from_address, to_address, block_time, ts AS ts_ms, ts AS iso_zulu, ts AS no_zone,
       ts - ts % 60000 AS minutes, ts - ts % 86400000 AS day, ts + 123 AS micros, ts + 500 AS tenths, ts - 7200000 AS ahead,
       CAST(NULL AS BIGINT) AS unread
FROM (SELECT *, epoch_ms(strptime(replace(block_time, ' UTC', ''), '%Y-%m-%d %H:%M:%S.%g')) AS ts FROM actions)""",
    "X13_time_text": """
SELECT hash, "from", "to", ts_ms, strftime(epoch_ms(ts_ms), '%b %d %H:%M') AS time_text FROM tl""",
}


_NULL_TL = """(SELECT "from", "to", CASE WHEN right(hash, 1) = '3' THEN NULL ELSE amount END AS amount, ts_ms, label, hash
      FROM {src})"""


def _with_nulls(key: str, *sources: str) -> str:
    """The body of ``key`` over amounts of which some are null; a null counts as 0 in sums."""
    body = BODIES[key]
    for src in sources:
        body = body.replace(f"FROM {src} ", f"FROM {_NULL_TL.format(src=src)} {src} ")
    body = body.replace("sum(amount)", "sum(coalesce(amount, 0))").replace("THEN amount ELSE", "THEN coalesce(amount, 0) ELSE")
    return body.replace("sum(s)", "sum(coalesce(s, 0))").replace("sum(r)", "sum(coalesce(r, 0))")


BODIES["W3_null_amounts"] = _with_nulls("W3_running_totals", "tl")
BODIES["W4_null_amounts"] = _with_nulls("W4_running_wallet_totals").replace("FROM tl_ends WHERE", """FROM (
  SELECT address, side_rank, "from", "to", CASE WHEN right(hash, 1) = '3' THEN NULL ELSE amount END AS amount,
         ts_ms, label, hash FROM tl_ends) WHERE""")
# the same questions, asked of stored states and layouts
for _stored, _plain in (("T1_stored_snapshot", "T1_snapshot"), ("T2_stored_totals", "T2_totals_at"), ("F4_stored_as_of", "F4_as_of"),
                        ("J1_bucketed_exits", "J1_exit_transfers"), ("F6_stored_wallet", "F6_wallet_detail"),
                        ("F7_stored_transfer", "F7_transfer_detail")):
    BODIES[_stored] = BODIES[_plain]
BODIES["T1_null_amounts"] = _with_nulls("T1_snapshot").replace("FROM seen", f"FROM {_NULL_TL.format(src='seen')}")


def exact_double_casts(sql: str) -> str:
    """Rewrite ``CAST(x AS DOUBLE)`` as ``CAST(CAST(x AS VARCHAR) AS DOUBLE)``.

    DuckDB converts a DECIMAL(38,18) to DOUBLE in two rounding steps, which
    can miss the nearest double by one unit in the last place; parsing the
    exact decimal text is correctly rounded, as Spark's conversion is.
    Integer and double inputs are unchanged by the detour.
    """
    out, i = [], 0
    while True:
        j = sql.find("CAST(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + 4
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = sql[j + 5:k]
        out.append(sql[i:j])
        if inner.endswith(" AS DOUBLE"):
            expr = exact_double_casts(inner[: -len(" AS DOUBLE")])
            out.append(f"CAST(CAST({expr} AS VARCHAR) AS DOUBLE)")
        else:
            out.append("CAST(" + exact_double_casts(inner) + ")")
        i = k + 1


def oracle_sql(profile: str = "scale") -> dict[str, str]:
    head = _with(profile)
    return {k: exact_double_casts(head + body.strip()) for k, body in BODIES.items()}
