"""Checks of evidence sets and commits, obligations, utility and reward."""

from __future__ import annotations

SETS = """
size_of AS (SELECT set_id, count(*) AS n FROM atom GROUP BY set_id),
gold AS (SELECT set_id, atom FROM (SELECT set_id, atom, row_number() OVER (PARTITION BY set_id ORDER BY (atom * 17 + set_id) % 23, atom) AS rn FROM atom) g WHERE rn <= 3)"""
U = f"""{SETS},
suf AS (SELECT s.set_id, CAST(count(CASE WHEN a.atom % 2 = 0 THEN 1 END) AS DOUBLE) / count(*) AS suff FROM gold s JOIN atom a ON a.set_id = s.set_id AND a.atom = s.atom GROUP BY s.set_id),
src AS (SELECT set_id, avg(tier) AS quality FROM atom GROUP BY set_id),
ground AS (SELECT n_nationkey AS v, CAST(n_nationkey % 7 AS DOUBLE) / 6 AS tier FROM nation),
sim AS (SELECT b.set_id, g.v, CASE WHEN g.v = b.atom THEN 1.0 ELSE greatest(0.0, 1.0 - abs(g.tier - b.tier) * 2) END AS s FROM atom b CROSS JOIN ground g),
red AS (SELECT set_id, sum(all_s) / count(*) AS singles, avg(best) AS joint FROM (SELECT set_id, v, sum(s) AS all_s, max(s) AS best FROM sim GROUP BY set_id, v) r GROUP BY set_id),
terms AS (SELECT z.set_id, suff, quality, CASE WHEN z.n < 2 OR singles <= 0 THEN 0.0 ELSE least(1.0, greatest(0.0, (singles - joint) / singles)) END AS redundancy, least(1.0, CAST(z.n AS DOUBLE) / 16) AS size, z.n
          FROM size_of z JOIN suf ON suf.set_id = z.set_id JOIN src ON src.set_id = z.set_id JOIN red ON red.set_id = z.set_id)"""

PLANS = {
    "supersede_invalidations": """
SELECT e.edge_id, n.ts AS t_invalid, n.turn_id AS superseded_by FROM edge e JOIN (
  SELECT turn_id, lead(turn_id) OVER (PARTITION BY conv_id, speaker ORDER BY ix) AS by_turn FROM turn) s ON s.turn_id = e.src
JOIN turn n ON n.turn_id = s.by_turn""",
    "corruption_audit": """
WITH before AS (SELECT key, max_by(op, seq) AS op FROM log WHERE seq < 6000 GROUP BY key), after AS (SELECT key, max_by(op, seq) AS op FROM log GROUP BY key)
SELECT coalesce(b.op, 'none') AS was, coalesce(a.op, 'none') AS now, count(*) AS n FROM before b FULL JOIN after a ON a.key = b.key GROUP BY coalesce(b.op, 'none'), coalesce(a.op, 'none')""",
    "obligation_deficit": """
SELECT set_id, CASE WHEN bool_or(atom = 3) THEN 0.0 ELSE 1.0 END AS anchor, CASE WHEN bool_or(ref = 2) THEN 0.0 ELSE 1.0 END AS value,
       round(1 - CAST(count(CASE WHEN tier > 0.3 THEN 1 END) AS DOUBLE) / count(*), 6) AS source FROM atom GROUP BY set_id""",
    "obligation_coverage": """
SELECT set_id, round((CASE WHEN bool_or(atom = 3) THEN 1.0 ELSE 0.0 END + CASE WHEN bool_or(ref = 2) THEN 1.0 ELSE 0.0 END) / 2, 6) AS coverage FROM atom GROUP BY set_id""",
    # what each atom takes off the deficits of its set without it
    "delta_deficit": """
SELECT set_id, atom, CASE WHEN atom = 3 THEN 1.0 ELSE 0.0 END AS anchor, CASE WHEN ref = 2 AND count(CASE WHEN ref = 2 THEN 1 END) OVER s = 1 THEN 1.0 ELSE 0.0 END AS value,
       round(CAST(count(CASE WHEN tier > 0.3 THEN 1 END) OVER s AS DOUBLE) / (count(*) OVER s)
         - CASE WHEN (count(*) OVER s) = 1 THEN 0.0 ELSE CAST((count(CASE WHEN tier > 0.3 THEN 1 END) OVER s) - CASE WHEN tier > 0.3 THEN 1 ELSE 0 END AS DOUBLE) / ((count(*) OVER s) - 1) END, 6) AS source
FROM atom WINDOW s AS (PARTITION BY set_id)""",
    "utility_terms": f"WITH {U} SELECT set_id, round(suff, 6) AS sufficiency, round(quality, 6) AS source_quality, round(redundancy, 6) AS redundancy, round(size, 6) AS size FROM terms",
    "reward_exp": f"""WITH {U}
SELECT set_id, round(suff + 0.25 * quality - 0.1 * redundancy - 0.05 * size, 6) AS utility,
       round(CASE WHEN n > 16 THEN 0.0 ELSE exp(2.0 * (suff + 0.25 * quality - 0.1 * redundancy - 0.05 * size)) END, 6) AS reward,
       round(CASE WHEN n <= 16 THEN 2.0 * (suff + 0.25 * quality - 0.1 * redundancy - 0.05 * size) END, 6) AS log_reward FROM terms""",
    "legal_adds_mask": """
WITH s AS (SELECT set_id, CAST(sum(@shl(atom)) AS BIGINT) AS mask, count(*) AS n FROM atom GROUP BY set_id)
SELECT s.set_id, n.n_nationkey AS atom FROM s JOIN nation n ON s.n < 16 AND (s.mask & @shl(n.n_nationkey)) = 0 AND (@shl(n.n_regionkey) & ~s.mask) = 0""",
    "stop_and_dead_ends": """
WITH s AS (SELECT set_id, CAST(sum(@shl(atom)) AS BIGINT) AS mask, count(*) AS n FROM atom GROUP BY set_id),
a AS (SELECT s.set_id, count(*) AS adds FROM s JOIN nation n ON s.n < 16 AND (s.mask & @shl(n.n_nationkey)) = 0 AND (@shl(n.n_regionkey) & ~s.mask) = 0 GROUP BY s.set_id)
SELECT s.set_id, s.n BETWEEN 1 AND 16 AS may_stop, s.n > 16 AND a.adds IS NULL AS dead_end FROM s LEFT JOIN a ON a.set_id = s.set_id""",
    "dedup_sets": """
SELECT members, count(*) AS copies, min(set_id) AS first_set FROM (SELECT set_id, @saggby(CAST(atom AS STRING), ',', atom) AS members FROM atom GROUP BY set_id) s GROUP BY members""",
    # the mean distance over all pairs of sets; pairs without a common atom have distance 1 and are counted, not made
    "portfolio_jaccard": """
WITH n AS (SELECT set_id, count(*) AS n FROM atom GROUP BY set_id),
c AS (SELECT a.set_id AS x, b.set_id AS y, count(*) AS common FROM atom a JOIN atom b ON a.atom = b.atom AND a.set_id < b.set_id GROUP BY a.set_id, b.set_id),
j AS (SELECT sum(CAST(common AS DOUBLE) / (p.n + q.n - common)) AS alike FROM c JOIN n p ON p.set_id = c.x JOIN n q ON q.set_id = c.y),
t AS (SELECT CAST(count(*) AS DOUBLE) AS sets FROM n)
SELECT round(CASE WHEN sets < 2 THEN 0.0 ELSE 1 - coalesce(alike, 0.0) / (sets * (sets - 1) / 2) END, 6) AS diversity FROM j CROSS JOIN t""",
    "jaccard_spread_bits": """
WITH m AS (SELECT set_id, CAST(sum(@shl(atom)) AS BIGINT) AS mask FROM atom GROUP BY set_id)
SELECT a.set_id AS x, b.set_id AS y, @bits(a.mask & b.mask) AS common, @bits(a.mask | b.mask) AS together FROM m a JOIN m b ON b.set_id = a.set_id + 1""",
}

#: Deficits of every set with and without each of its atoms, counted apart.
PLAIN = {
    "delta_deficit": """
WITH w AS (SELECT a.set_id, a.atom, b.atom AS m, b.ref, b.tier FROM atom a JOIN atom b ON b.set_id = a.set_id),
d AS (SELECT set_id, atom, count(CASE WHEN m = 3 THEN 1 END) AS a1, count(CASE WHEN m = 3 AND m <> atom THEN 1 END) AS a0,
             count(CASE WHEN ref = 2 THEN 1 END) AS v1, count(CASE WHEN ref = 2 AND m <> atom THEN 1 END) AS v0,
             avg(CASE WHEN tier > 0.3 THEN 1.0 ELSE 0.0 END) AS s1, coalesce(avg(CASE WHEN m <> atom THEN CASE WHEN tier > 0.3 THEN 1.0 ELSE 0.0 END END), 0.0) AS s0 FROM w GROUP BY set_id, atom)
SELECT set_id, atom, CASE WHEN a1 > 0 AND a0 = 0 THEN 1.0 ELSE 0.0 END AS anchor, CASE WHEN v1 > 0 AND v0 = 0 THEN 1.0 ELSE 0.0 END AS value, round(s1 - s0, 6) AS source FROM d""",
}
