"""Graph joins, retrieval channels, fusion and closure."""

from __future__ import annotations

HIT = "hit AS (SELECT question_id, doc, score FROM bm25 WHERE score > 0)"
FUSED = f"""{HIT},
entity AS (SELECT DISTINCT q.question_id, t.turn_id AS doc, 1.0 AS score FROM question_token q JOIN turn_token t ON q.tok = t.tok
           JOIN assertion a ON a.turn_id = t.turn_id WHERE length(q.tok) >= 7 AND a.eligibility = 'eligible'),
chan AS (SELECT question_id, 'bm25' AS channel, doc, score FROM hit UNION ALL SELECT question_id, 'entity' AS channel, doc, CAST(score AS DOUBLE) AS score FROM entity),
scaled AS (SELECT question_id, channel, doc, round(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END, 6) AS s FROM (
  SELECT *, max(score) OVER (PARTITION BY question_id, channel) AS hi, min(score) OVER (PARTITION BY question_id, channel) AS lo FROM chan) c)"""
FAN = """fan AS (SELECT node, other, rn FROM (
  SELECT node, other, row_number() OVER (PARTITION BY node ORDER BY t_created DESC, edge_id DESC) AS rn FROM (
    SELECT src AS node, dst AS other, t_created, edge_id FROM edge UNION ALL SELECT dst AS node, src AS other, t_created, edge_id FROM edge) e) r WHERE rn <= 32)"""

PLANS = {
    "gate_eligibility": """
SELECT assertion_id, eligibility, CASE WHEN entailed_score < 0.8 THEN 'score' WHEN speaker = 'system' THEN 'speaker' ELSE '' END AS reason FROM assertion""",
    "eligible_nodes_scope": "SELECT conv_id, assertion_id FROM assertion WHERE eligibility = 'eligible' AND conv_id IN (SELECT conv_id FROM turn WHERE speaker = 'system')",
    "edge_incidence": """
SELECT node, count(*) AS degree FROM (SELECT DISTINCT edge_id, node FROM (
  SELECT edge_id, src AS node FROM edge UNION ALL SELECT edge_id, dst AS node FROM edge) x) y GROUP BY node""",
    "graph_degree_features": """
SELECT node, count(*) AS degree, round(ln(1 + count(*)), 6) AS log_degree, min(t_created) AS earliest FROM (
  SELECT src AS node, t_created FROM edge UNION ALL SELECT dst AS node, t_created FROM edge) x GROUP BY node""",
    "entity_match": """
SELECT q.question_id, e.dst AS node_id FROM question_token q JOIN (SELECT DISTINCT dst, substr(dst, length(conv_id) + 2) AS tok FROM edge) e ON e.tok = q.tok""",
    "entity_channel": """
SELECT DISTINCT q.question_id, a.assertion_id, 1.0 AS score FROM question_token q JOIN turn_token t ON t.tok = q.tok
JOIN assertion a ON a.turn_id = t.turn_id WHERE length(q.tok) >= 7 AND a.eligibility = 'eligible'""",
    "fanout_recent": f"WITH {FAN} SELECT node, other, CAST(rn AS BIGINT) AS rank FROM fan",
    "expand_two_hop": f"""WITH {FAN},
seed AS (SELECT turn_id AS node FROM turn WHERE ix = 0),
one AS (SELECT DISTINCT s.node AS seed, f.other AS node FROM seed s JOIN fan f ON f.node = s.node),
two AS (SELECT DISTINCT o.seed, f.other AS node FROM one o JOIN fan f ON f.node = o.node)
SELECT seed, node, CASE WHEN min(hop) = 1 THEN 1.0 ELSE 0.5 END AS score FROM (
  SELECT seed, node, 1 AS hop FROM one UNION ALL SELECT seed, node, 2 AS hop FROM two) x WHERE node <> seed GROUP BY seed, node""",
    "mention_candidates_topk": """
SELECT turn_id, candidate, CAST(rn AS BIGINT) AS place FROM (
  SELECT m.turn_id, c.dst AS candidate, row_number() OVER (PARTITION BY m.turn_id ORDER BY c.n DESC, c.dst) AS rn
  FROM turn m JOIN (SELECT conv_id, dst, count(*) AS n FROM edge GROUP BY conv_id, dst) c ON c.conv_id = m.conv_id) x WHERE rn <= 5""",
    "claim_pairs_same_anchor": """
WITH anchor AS (SELECT src, min_by(dst, t_created * 1000 + length(dst)) AS dst0, min(dst) AS dst FROM edge GROUP BY src),
e AS (SELECT a.assertion_id, n.dst, a.ts FROM assertion a JOIN anchor n ON n.src = a.turn_id)
SELECT x.assertion_id AS claim_a, y.assertion_id AS claim_b, x.dst AS anchor FROM e x JOIN e y
ON x.dst = y.dst AND (x.ts < y.ts OR (x.ts = y.ts AND x.assertion_id < y.assertion_id))""".replace("min_by(dst, t_created * 1000 + length(dst)) AS dst0, ", ""),
    "pair_order_earlier_later": """
WITH p AS (SELECT DISTINCT least(ea.src, eb.src) AS x, greatest(ea.src, eb.src) AS y FROM edge ea JOIN edge eb ON ea.dst = eb.dst AND ea.src < eb.src)
SELECT CASE WHEN a.ts < b.ts OR (a.ts = b.ts AND a.turn_id < b.turn_id) THEN a.turn_id ELSE b.turn_id END AS first_id,
       CASE WHEN a.ts < b.ts OR (a.ts = b.ts AND a.turn_id < b.turn_id) THEN b.turn_id ELSE a.turn_id END AS second_id, a.conv_id <> b.conv_id AS cross_session
FROM p JOIN turn a ON a.turn_id = p.x JOIN turn b ON b.turn_id = p.y""",
    "bm25_topk": f"""WITH {HIT}
SELECT question_id, doc, score, CAST(rn AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc) AS rn FROM hit) r WHERE rn <= 10""",
    "minmax_scale": f"WITH {FUSED} SELECT question_id, channel, doc, s FROM scaled",
    "fuse_minmax_max": f"WITH {FUSED} SELECT question_id, doc, max(s) AS score FROM scaled GROUP BY question_id, doc",
    "fuse_wins_unique": f"""WITH {FUSED},
r AS (SELECT *, row_number() OVER (PARTITION BY question_id, doc ORDER BY s DESC, channel) AS rn, count(*) OVER (PARTITION BY question_id, doc) AS n FROM scaled)
SELECT question_id, channel, count(*) AS returned, count(CASE WHEN rn = 1 THEN 1 END) AS wins, count(CASE WHEN n = 1 THEN 1 END) AS only_here FROM r GROUP BY question_id, channel""",
    "temporal_filter": f"""WITH {HIT}
SELECT h.question_id, h.doc FROM hit h JOIN question q ON q.question_id = h.question_id LEFT JOIN validity v ON v.turn_id = h.doc
GROUP BY h.question_id, h.doc HAVING bool_or(coalesce(greatest(q.tc_start, v.lo) < least(q.tc_end, coalesce(v.hi, 9999999999)), true))""",
    "hybrid_half_half": f"""WITH {FUSED},
m AS (SELECT question_id, doc, round(sum(0.5 * s), 8) AS score FROM scaled GROUP BY question_id, doc)
SELECT question_id, doc, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc) AS rn FROM m) r WHERE rn <= 5""",
    # all targets of a hit's edges are nodes of the pool, so its inner edges are those of its hits
    "pool_uncapped_closure": f"""WITH {HIT}
SELECT h.question_id, count(DISTINCT h.doc) + count(DISTINCT e.dst) AS nodes, count(e.edge_id) AS edges FROM hit h LEFT JOIN edge e ON e.src = h.doc GROUP BY h.question_id""",
    "pool_saturation": f"""WITH {HIT}
SELECT question_id, count(DISTINCT e.edge_id) + count(DISTINCT h.doc) AS closed_size, count(DISTINCT e.edge_id) + count(DISTINCT h.doc) > 64 AS saturated
FROM hit h LEFT JOIN edge e ON e.src = h.doc GROUP BY question_id""",
    "recall_by_channel": f"""WITH {FUSED},
gold AS (SELECT question_id, max_by(doc, score) AS doc FROM (SELECT question_id, doc, max(s) AS score FROM scaled WHERE channel = 'entity' GROUP BY question_id, doc) x GROUP BY question_id HAVING count(*) = 1)
SELECT channel, count(*) AS retrieved, count(g.doc) AS gold_found FROM scaled s LEFT JOIN gold g ON g.question_id = s.question_id AND g.doc = s.doc GROUP BY channel""",
    "embedding_cache_dedup": "SELECT @sha16('embed', lower(text)) AS cache_key, count(*) AS users FROM benchmark GROUP BY @sha16('embed', lower(text))",
    "provenance_chain": """
SELECT a.assertion_id, a.span_id, t.turn_id, t.conv_id FROM assertion a LEFT JOIN turn t ON t.turn_id = a.turn_id""",
    "source_tier_mean": """
SELECT conv_id, round(avg(CASE speaker WHEN 'user' THEN 1.0 WHEN 'assistant' THEN 0.6 ELSE 0.3 END), 6) AS tier FROM turn GROUP BY conv_id""",
    "typed_graph_expand": """
SELECT c.c_nationkey, count(DISTINCT l.l_partkey) AS parts, count(DISTINCT o.o_orderkey) AS orders FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY c.c_nationkey""",
    "ground_quotes_exact_norm": """
SELECT q.turn_id, CASE WHEN instr(t.text, q.quote) > 0 THEN 'exact' WHEN instr(lower(t.text), lower(q.quote)) > 0 THEN 'normalised' ELSE 'fail' END AS rung,
       CAST(instr(lower(t.text), lower(q.quote)) - 1 AS BIGINT) AS start_at
FROM (SELECT turn_id, CASE WHEN ix % 2 = 0 THEN substr(text, 3, 30) ELSE lower(substr(text, 1, 30)) END AS quote FROM turn) q JOIN turn t ON t.turn_id = q.turn_id""",
    "excluded_evidence_antijoin": f"""WITH {HIT}
SELECT question_id, doc FROM (SELECT question_id, doc, score, max(score) OVER (PARTITION BY question_id) AS best FROM hit) h WHERE score < best""",
}

#: The same pool, put together node by node.
PLAIN = {
    "pool_uncapped_closure": f"""WITH {HIT},
node AS (SELECT question_id, doc AS node FROM hit UNION SELECT h.question_id, e.dst AS node FROM hit h JOIN edge e ON e.src = h.doc)
SELECT n.question_id, count(*) AS nodes, max(coalesce(m.edges, 0)) AS edges FROM node n LEFT JOIN (
  SELECT a.question_id, count(*) AS edges FROM node a JOIN edge e ON e.src = a.node JOIN node b ON b.question_id = a.question_id AND b.node = e.dst GROUP BY a.question_id) m
ON m.question_id = n.question_id GROUP BY n.question_id""",
}
