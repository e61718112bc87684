"""Replay of the append-only log, scans and windows over it."""

from __future__ import annotations

PLANS = {
    "log_replay_asof": "SELECT seq, op, key FROM log WHERE seq < 2000",
    "log_snapshot_id": "SELECT max(seq) + 1 AS snapshot_id FROM log",
    "log_replay_latest": """
SELECT key, op, max_by(event_id, seq) AS last_event, max(seq) AS last_seq FROM log GROUP BY key, op""",
    "log_live_edges": """
SELECT key, max(CASE WHEN op = 'edge.add' THEN seq END) > coalesce(max(CASE WHEN op = 'edge.invalidate' THEN seq END), -1) AS live
FROM log WHERE op LIKE 'edge.%' GROUP BY key HAVING max(CASE WHEN op = 'edge.add' THEN seq END) IS NOT NULL""",
    "log_eligibility_since_add": """
WITH a AS (SELECT key, max(seq) AS added FROM log WHERE op = 'assertion.add' GROUP BY key)
SELECT a.key, a.added, max_by(l.value, l.seq) AS verdict FROM a LEFT JOIN log l
ON l.key = a.key AND l.op = 'assertion.set_eligibility' AND l.seq > a.added GROUP BY a.key, a.added""",
    "log_counts": """
SELECT count(DISTINCT CASE WHEN op = 'node.add' THEN key END) AS nodes, count(DISTINCT CASE WHEN op = 'edge.add' THEN key END) AS edges,
       count(DISTINCT CASE WHEN op = 'assertion.add' THEN key END) AS assertions, count(*) AS rows_read FROM log""",
    "log_diff_live": """
WITH s AS (SELECT key, max(CASE WHEN op = 'edge.add' AND seq < 4000 THEN seq END) AS a1, max(CASE WHEN op = 'edge.invalidate' AND seq < 4000 THEN seq END) AS i1,
                  max(CASE WHEN op = 'edge.add' THEN seq END) AS a2, max(CASE WHEN op = 'edge.invalidate' THEN seq END) AS i2 FROM log GROUP BY key),
f AS (SELECT key, coalesce(a1 > coalesce(i1, -1), false) AS was, coalesce(a2 > coalesce(i2, -1), false) AS now FROM s)
SELECT key, was, now FROM f WHERE was <> now""",
    "log_repair_prefix": """
WITH line AS (SELECT seq AS no, CASE WHEN seq = 7000 THEN seq + 1 ELSE seq END AS said FROM log),
bad AS (SELECT min(no) AS first_bad FROM line WHERE no <> said)
SELECT no AS seq FROM line CROSS JOIN bad WHERE first_bad IS NULL OR no < first_bad""",
    "log_first_seen": "SELECT key, min(seq) AS first_seq, min_by(op, seq) AS first_op FROM log GROUP BY key",
    "scan_flatten_turns": "SELECT turn_id, conv_id, ix, speaker, ts FROM turn WHERE trim(text) <> ''",
    "scan_json_props": "SELECT event_id, @json(props, '$.k') AS k FROM events",
    "scan_profile": "SELECT speaker, count(*) AS turns, count(DISTINCT conv_id) AS conversations, max(ix) AS last_ix FROM turn GROUP BY speaker",
    "scan_pair_groups": """
SELECT g AS group_id, count(*) AS members, CASE WHEN count(*) <> 2 THEN 'size' WHEN count(DISTINCT label) <> 2 THEN 'labels' ELSE 'ok' END AS reason
FROM (SELECT @idiv(doc_id, 2) AS g, quality AS label FROM labels) l GROUP BY g""",
    "context_window_prev10": """
SELECT turn_id, count(*) OVER w AS previous, CAST(coalesce(sum(length(text)) OVER w, 0) AS BIGINT) AS chars
FROM (SELECT turn_id, conv_id, ix, CAST(text AS STRING) AS text FROM turn) t
WINDOW w AS (PARTITION BY conv_id ORDER BY ix ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
    "summary_refresh_asof": """
SELECT t.turn_id, s.turn_id AS summary_at FROM turn t LEFT JOIN turn s ON t.conv_id = s.conv_id AND s.ix = @idiv(t.ix, 10) * 10""",
    "session_window_turns": """
SELECT turn_id FROM (SELECT turn_id, conv_id, ix, greatest(m, coalesce(lag(m) OVER c, 0), coalesce(lead(m) OVER c, 0)) AS near
  FROM (SELECT turn_id, conv_id, ix, CASE WHEN length(text) % 5 = 0 THEN 1 ELSE 0 END AS m FROM turn) t WINDOW c AS (PARTITION BY conv_id ORDER BY ix)) x WHERE near = 1""",
    "registry_seen_earlier": """
SELECT conv_id, ix, CAST(sum(fresh) OVER (PARTITION BY conv_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS known
FROM (SELECT t.conv_id, t.ix, count(f.tok) AS fresh FROM turn t
      LEFT JOIN (SELECT conv_id, tok, min(ix) AS first_ix FROM turn_token WHERE length(tok) >= 7 GROUP BY conv_id, tok) f
      ON t.conv_id = f.conv_id AND t.ix = f.first_ix GROUP BY t.conv_id, t.ix) x""",
    # blocks are digested apart, then their digests
    "log_digest": """
SELECT @sha(@saggby(part, ';', block)) AS digest FROM (
  SELECT @idiv(seq, 4096) AS block, @sha(@saggby(concat(CAST(seq AS STRING), ':', op, ':', key, ':', coalesce(payload, '')), ';', seq)) AS part FROM log GROUP BY @idiv(seq, 4096)) b""",
    "log_state_digest": """
SELECT @sha(@saggby(part, ';', block)) AS digest FROM (
  SELECT substr(@sha(key), 1, 3) AS block, @sha(@sagg(item, ';')) AS part FROM (
    SELECT key, concat(key, '/', op, '/', CAST(max(seq) AS STRING)) AS item FROM log GROUP BY key, op) s GROUP BY substr(@sha(key), 1, 3)) b""",
    # the next owner inside a block of the log, else the first one of the next blocks that have any
    "log_forward_fill_turn": """
WITH e AS (SELECT seq, @idiv(seq, 4096) AS block, CASE WHEN op = 'node.add' THEN event_id END AS own FROM log),
b AS (SELECT block, @firstnn(first_own) OVER (ORDER BY block ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM (
  SELECT block, min_by(own, CASE WHEN own IS NOT NULL THEN seq END) AS first_own FROM e GROUP BY block) f)
SELECT e.seq, coalesce(@firstnn(e.own) OVER (PARTITION BY e.block ORDER BY e.seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), b.later) AS owner FROM e JOIN b ON b.block = e.block""",
    "running_turn_plan": """
WITH c AS (SELECT CAST(conv_id AS BIGINT) AS c, @idiv(CAST(conv_id AS BIGINT), 64) AS block, count(*) AS n FROM turn GROUP BY CAST(conv_id AS BIGINT), @idiv(CAST(conv_id AS BIGINT), 64)),
b AS (SELECT block, coalesce(sum(n) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT block, sum(n) AS n FROM c GROUP BY block) x)
SELECT CAST(c.c AS STRING) AS conv_id, c.n, CAST(b.before + sum(c.n) OVER (PARTITION BY c.block ORDER BY c.c) AS BIGINT) AS so_far FROM c JOIN b ON b.block = c.block""",
}

#: The same results without blocks.
PLAIN = {
    "log_forward_fill_turn": """
SELECT seq, @firstnn(CASE WHEN op = 'node.add' THEN event_id END) OVER (ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS owner FROM log""",
    "running_turn_plan": """
SELECT conv_id, n, CAST(sum(n) OVER (ORDER BY CAST(conv_id AS BIGINT)) AS BIGINT) AS so_far FROM (SELECT conv_id, count(*) AS n FROM turn GROUP BY conv_id) c""",
}
