"""Evidence sets' parts that references hold together, by bit masks; the oracle walks the references instead."""

from __future__ import annotations

from provenlace.plans.dialect import plan

# A set has a few dozen atoms at most (below 64), so its links are a short list of masks. Folding them
# unites the parts that each one touches.
MASKS = """
WITH link AS (
  SELECT DISTINCT a.set_id, @shl(a.atom) | CASE WHEN b.atom IS NULL THEN CAST(0 AS BIGINT) ELSE @shl(b.atom) END AS m
  FROM atom a LEFT JOIN atom b ON b.set_id = a.set_id AND b.atom = a.ref),
part AS (
  SELECT set_id, aggregate(collect_list(m), CAST(array() AS ARRAY<BIGINT>), (acc, e) ->
    concat(filter(acc, x -> (x & e) = 0), array(aggregate(filter(acc, x -> (x & e) <> 0), e, (p, x) -> p | x)))) AS parts
  FROM link GROUP BY set_id)
SELECT set_id, CAST(size(parts) AS BIGINT) AS components, CAST(array_max(transform(parts, x -> bit_count(x))) AS BIGINT) AS largest FROM part"""

WALKS = """
WITH RECURSIVE link AS (
  SELECT a.set_id, a.atom AS x, b.atom AS y FROM atom a JOIN atom b ON b.set_id = a.set_id AND b.atom = a.ref
  UNION SELECT a.set_id, b.atom AS x, a.atom AS y FROM atom a JOIN atom b ON b.set_id = a.set_id AND b.atom = a.ref),
walk(set_id, root, node) AS (
  SELECT set_id, atom AS root, atom AS node FROM atom
  UNION SELECT w.set_id, w.root, l.y AS node FROM walk w JOIN link l ON l.set_id = w.set_id AND l.x = w.node),
label AS (SELECT set_id, node, min(root) AS root FROM walk GROUP BY set_id, node),
part AS (SELECT set_id, root, count(*) AS n FROM label GROUP BY set_id, root)
SELECT set_id, count(*) AS components, max(n) AS largest FROM part GROUP BY set_id"""

QUERIES = {"components_refs": plan(MASKS)[0]}
ORACLE = {"components_refs": plan(WALKS)[1]}
