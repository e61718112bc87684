"""Registered queries of the evidence operators: they derive graph tables from the supplied ones; the SQL beside them is written apart."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenlace.evidence import checks, commits, fold
from provenlace.plans.dialect import plan, render
from provenlace.plans.views import with_views
from provenlace.storage import cut

#: Tables of graph, pools and sets: a set for each conversation, with atoms that break each of the checks somewhere.
TABLES = {
    "turn": "SELECT turn_id, conv_id FROM turn",
    "span": "SELECT span_id, turn_id FROM assertion WHERE ix % 9 <> 8",
    "assertion": "SELECT assertion_id, eligibility FROM assertion",
    "assertion_span": "SELECT assertion_id, span_id FROM assertion",
    "node": """
SELECT concat('n/', turn_id) AS node_id, CASE kind WHEN 'claim' THEN 'Claim' WHEN 'value' THEN 'Value' ELSE 'Event' END AS ntype,
       CASE WHEN ix % 11 <> 10 THEN assertion_id END AS assertion_id, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi FROM assertion
UNION ALL SELECT DISTINCT dst, 'Entity', CAST(NULL AS STRING), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM edge
UNION ALL SELECT concat('t/', turn_id), 'TimeInterval', CAST(NULL AS STRING), CAST(lo AS DOUBLE), CAST(hi AS DOUBLE) FROM validity""",
    "edge": """
SELECT e.edge_id, e.etype, concat('n/', e.src) AS src, e.dst, e.t_created, CASE WHEN length(e.dst) % 5 = 0 THEN v.hi END AS t_invalid,
       CASE WHEN length(e.dst) % 5 = 0 AND v.hi IS NOT NULL THEN CASE WHEN length(e.dst) % 10 = 0 THEN concat('v/', e.conv_id, '/first') ELSE concat('v/', e.src) END END AS superseded_by
FROM edge e JOIN validity v ON v.turn_id = e.src
UNION ALL SELECT concat('v/', turn_id), 'valid_during', concat('n/', turn_id), concat('t/', turn_id), lo, CAST(NULL AS BIGINT), CAST(NULL AS STRING) FROM validity
UNION ALL SELECT concat('v/', conv_id, '/first'), 'valid_during', concat('n/', turn_id), concat('t/', turn_id), lo - 60, CAST(NULL AS BIGINT), CAST(NULL AS STRING)
FROM validity WHERE turn_id = concat('conv/', conv_id, '/0') AND CAST(conv_id AS BIGINT) % 2 = 0""",
    "provenance": """
SELECT e.edge_id, a.span_id FROM edge e JOIN assertion a ON a.turn_id = e.src
UNION ALL SELECT concat('v/', turn_id), span_id FROM assertion""",
    "sets": "SELECT DISTINCT conv_id AS set_id, conv_id AS question_id FROM turn",
    "question": """
SELECT DISTINCT conv_id AS question_id, CAST(conv_id AS BIGINT) % 5 < 2 AS constrained, CAST(1704067200 + CAST(conv_id AS BIGINT) * 86400 - CASE CAST(conv_id AS BIGINT) % 5 WHEN 0 THEN 5000 ELSE 0 END AS DOUBLE) AS lo,
       CAST(1704067200 + CAST(conv_id AS BIGINT) * 86400 + CASE CAST(conv_id AS BIGINT) % 5 WHEN 0 THEN -100 ELSE 50 END AS DOUBLE) AS hi FROM turn""",
    "scope": """
SELECT DISTINCT conv_id AS question_id, CASE CAST(conv_id AS BIGINT) % 3 WHEN 0 THEN conv_id ELSE 'elsewhere' END AS conv_id FROM turn WHERE CAST(conv_id AS BIGINT) % 3 < 2""",
    "atom": """
SELECT conv_id AS question_id, concat('a/', turn_id) AS atom_id, 'node' AS kind, concat('n/', turn_id) AS target, CAST(NULL AS STRING) AS label FROM turn
UNION ALL SELECT conv_id, concat('e/', edge_id), 'edge', edge_id, etype FROM edge
UNION ALL SELECT DISTINCT conv_id, concat('x/', dst), 'node', dst, CAST(NULL AS STRING) FROM edge
UNION ALL SELECT conv_id, concat('b/', turn_id), 'binding', CAST(NULL AS STRING), 'answer' FROM turn WHERE ix < 2
UNION ALL SELECT conv_id, concat('d/', turn_id), 'node', concat('n/', turn_id), CAST(NULL AS STRING) FROM turn WHERE ix = 0
UNION ALL SELECT conv_id, concat('u/', turn_id), 'node', 'nothing', CAST(NULL AS STRING) FROM turn WHERE ix = 0""",
    "ref": """
SELECT conv_id AS question_id, concat('e/', edge_id) AS atom_id, concat('a/', src) AS ref FROM edge
UNION ALL SELECT conv_id, concat('e/', edge_id), concat('x/', dst) FROM edge
UNION ALL SELECT conv_id, concat('b/', turn_id), concat('a/', turn_id) FROM turn WHERE ix < 2""",
    "member": """
SELECT conv_id AS set_id, concat('a/', turn_id) AS atom_id FROM turn WHERE ix < 6 AND NOT (ix = 1 AND CAST(conv_id AS BIGINT) % 4 = 0)
UNION ALL SELECT conv_id, concat('e/', edge_id) FROM edge WHERE length(dst) % 3 = 0
UNION ALL SELECT DISTINCT conv_id, concat('x/', dst) FROM edge WHERE length(dst) % 3 = 0 AND length(dst) % 4 <> 0
UNION ALL SELECT conv_id, concat('b/', turn_id) FROM turn WHERE ix = 0 OR (ix = 1 AND CAST(conv_id AS BIGINT) % 4 = 0)
UNION ALL SELECT conv_id, concat('d/', turn_id) FROM turn WHERE ix = 0 AND CAST(conv_id AS BIGINT) % 6 = 0
UNION ALL SELECT conv_id, concat('u/', turn_id) FROM turn WHERE ix = 0 AND CAST(conv_id AS BIGINT) % 7 = 0
UNION ALL SELECT conv_id, 'unheard of' FROM turn WHERE ix = 0 AND CAST(conv_id AS BIGINT) % 8 = 0""",
}
H_TABLES = [*TABLES]


#: Shared views that the derived tables are made of.
BASES = ("turn", "assertion", "edge", "early", "dated", "validity")


def derived(spark: SparkSession, sf_dir: str, names: list[str], bodies: dict[str, str] = TABLES, merged: bool = False) -> dict[str, DataFrame]:
    """The named tables; the views they share are made once and written, so that no table is read and split into words again for each use.

    merged: joins with the views and the tables are merged. A plan knows the size of the files alone, not that of the words made from them,
    and would broadcast these. Of the views only columns that the bodies name are written; no body reads them by *.
    """
    read = re.compile(rf"\b(FROM|JOIN) ({'|'.join(BASES)})\b")
    texts = {n: read.sub(r"\1 {\2}", render(bodies[n], True)) for n in names}
    words = set(re.findall(r"\w+", " ".join(texts.values())))
    base = {}
    for b in BASES:
        if any("{" + b + "}" in x for x in texts.values()):
            whole = plan(f"SELECT * FROM {b}")[0](spark, sf_dir)
            base[b] = cut(whole.select(*[c for c in whole.columns if c in words]))
    told = (lambda df: df.hint("merge")) if merged else (lambda df: df)
    return {n: told(spark.sql(x, **{b: told(df) for b, df in base.items() if "{" + b + "}" in x})) for n, x in texts.items()}


def _oracle(body: str, names: list[str], bodies: dict[str, str] = TABLES) -> str:
    """body over the derived tables, which it calls g_<name>, for the checking engine."""
    head = ", ".join(f"g_{n} AS ({bodies[n]})" for n in names)
    return render(with_views(f"WITH {head} {body}", ()), False)


H_SQL = """, s AS (SELECT m.set_id, m.atom_id, a.kind, a.target, a.label FROM g_member m LEFT JOIN g_atom a ON a.question_id = m.set_id AND a.atom_id = m.atom_id),
base AS (SELECT set_id, atom_id, atom_id AS via, kind, target FROM s WHERE kind <> 'binding'
         UNION ALL SELECT s.set_id, s.atom_id, r.ref, a.kind, a.target FROM s JOIN g_ref r ON r.question_id = s.set_id AND r.atom_id = s.atom_id
         JOIN g_atom a ON a.question_id = s.set_id AND a.atom_id = r.ref WHERE s.kind = 'binding'),
bad_node AS (SELECT node_id FROM g_node n WHERE ntype IN ('Claim', 'Value', 'Event') AND NOT EXISTS (SELECT 1 FROM g_assertion a WHERE a.assertion_id = n.assertion_id AND a.eligibility = 'eligible')),
times AS (SELECT b.set_id, b.atom_id, b.via, t.lo, t.hi FROM base b JOIN g_edge e ON e.src = b.target AND e.etype = 'valid_during' AND e.t_invalid IS NULL JOIN g_node t ON t.node_id = e.dst WHERE b.kind = 'node'),
where_from AS (
  SELECT b.set_id, b.atom_id, p.span_id FROM base b JOIN g_provenance p ON p.edge_id = b.target WHERE b.kind = 'edge'
  UNION ALL SELECT b.set_id, b.atom_id, v.span_id FROM base b JOIN g_node n ON n.node_id = b.target LEFT JOIN g_assertion_span v ON v.assertion_id = n.assertion_id
  WHERE b.kind = 'node' AND n.ntype IN ('Claim', 'Value', 'Event')),
v AS (
  SELECT set_id, 'H1' AS code, NULL AS atom_id FROM g_member GROUP BY set_id HAVING count(DISTINCT atom_id) > 16
  UNION ALL SELECT set_id, 'H2', atom_id FROM s WHERE kind IS NULL OR (kind = 'node' AND target NOT IN (SELECT node_id FROM g_node)) OR (kind = 'edge' AND target NOT IN (SELECT edge_id FROM g_edge))
  UNION ALL SELECT s.set_id, 'H3', s.atom_id FROM s JOIN g_ref r ON r.question_id = s.set_id AND r.atom_id = s.atom_id
            WHERE NOT EXISTS (SELECT 1 FROM g_member m WHERE m.set_id = s.set_id AND m.atom_id = r.ref)
  UNION ALL SELECT a.set_id, 'H4', a.atom_id FROM s a JOIN s b ON b.set_id = a.set_id AND b.target = a.target AND b.kind = a.kind AND b.atom_id < a.atom_id WHERE a.kind = 'node'
  UNION ALL SELECT set_id, 'H5', min(atom_id) FROM s WHERE kind = 'binding' GROUP BY set_id HAVING count(*) > 1
  UNION ALL SELECT s.set_id, 'H6', s.atom_id FROM s WHERE kind = 'edge' AND target IN (SELECT edge_id FROM g_edge WHERE t_invalid IS NOT NULL)
  UNION ALL SELECT s.set_id, 'H7', s.atom_id FROM s WHERE (kind = 'node' AND target IN (SELECT node_id FROM bad_node))
            OR (kind = 'edge' AND target IN (SELECT edge_id FROM g_edge WHERE src IN (SELECT node_id FROM bad_node)))
  UNION ALL SELECT s.set_id, 'H8', s.atom_id FROM s JOIN g_edge e ON s.kind = 'edge' AND e.edge_id = s.target WHERE e.superseded_by IS NOT NULL
            AND NOT EXISTS (SELECT 1 FROM g_edge f WHERE f.edge_id = e.superseded_by AND f.t_created >= e.t_created)
  UNION ALL SELECT t.set_id, 'H8', t.atom_id FROM times t JOIN s ON s.set_id = t.set_id AND s.atom_id = t.atom_id AND s.kind = 'binding' JOIN g_question q ON q.question_id = t.set_id AND q.constrained
            WHERE EXISTS (SELECT 1 FROM g_member m WHERE m.set_id = t.set_id AND m.atom_id = t.via)
            GROUP BY t.set_id, t.atom_id HAVING NOT bool_or(t.lo < q.hi AND q.lo < coalesce(t.hi, 1e300) AND t.lo < coalesce(t.hi, 1e300))
  UNION ALL SELECT w.set_id, 'H9', w.atom_id FROM where_from w WHERE EXISTS (SELECT 1 FROM g_scope c WHERE c.question_id = w.set_id)
            AND NOT EXISTS (SELECT 1 FROM g_span n JOIN g_turn t ON t.turn_id = n.turn_id JOIN g_scope c ON c.conv_id = t.conv_id WHERE n.span_id = w.span_id AND c.question_id = w.set_id)),
d AS (SELECT DISTINCT set_id, code, atom_id FROM v)
"""

#: A batch of commits: each conversation's turns 1 and 2 as one commit, with rows that break each of the checks somewhere.
STAGED = {
    "node": """
SELECT concat('n/', turn_id) AS node_id, 'Claim' AS ntype, text_norm AS payload, CAST(NULL AS STRING) AS alias, assertion_id, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi
FROM assertion WHERE ix = 0
UNION ALL SELECT DISTINCT dst, 'Entity', dst, 'old', CAST(NULL AS STRING), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM edge JOIN turn ON turn_id = src WHERE ix = 0
UNION ALL SELECT concat('t/', turn_id), 'TimeInterval', '', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(lo AS DOUBLE), CAST(CASE WHEN CAST(conv_id AS BIGINT) % 2 = 0 THEN lo ELSE lo + 60 END AS DOUBLE)
FROM validity WHERE turn_id = concat('conv/', conv_id, '/0')""",
    "edge": """
SELECT edge_id, etype, concat('n/', src) AS src, dst, t_created, CAST(NULL AS BIGINT) AS t_invalid, CAST(NULL AS STRING) AS superseded_by FROM edge JOIN turn ON turn_id = src WHERE ix = 0""",
    "span": "SELECT span_id FROM assertion WHERE ix % 3 < 2",
    "assertion": "SELECT assertion_id, eligibility FROM assertion",
    "new_node": """
SELECT conv_id AS commit_id, ix AS pos, concat('n/', turn_id) AS node_id, CASE ix WHEN 1 THEN 'Value' ELSE 'Claim' END AS ntype, text_norm AS payload, CAST(NULL AS STRING) AS alias, assertion_id,
       CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi FROM assertion WHERE ix IN (1, 2)
UNION ALL SELECT conv_id, 9, concat('n/', turn_id), 'Claim', concat(text_norm, CASE WHEN CAST(conv_id AS BIGINT) % 3 = 0 THEN '!' ELSE '' END), CAST(NULL AS STRING), assertion_id, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM assertion WHERE ix = 0
UNION ALL SELECT DISTINCT conv_id, 8, dst, 'Entity', dst, CASE WHEN length(dst) % 2 = 0 THEN 'new' ELSE 'old' END, CAST(NULL AS STRING), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM edge JOIN turn USING (conv_id) WHERE turn_id = src AND ix = 1""",
    "new_edge": """
SELECT conv_id AS commit_id, 0 AS pos, edge_id, CASE WHEN length(dst) % 13 = 0 THEN 'invented' ELSE etype END AS etype, concat('n/', src) AS src, dst, t_created,
       CASE WHEN length(dst) % 11 = 0 THEN t_created END AS t_invalid, CAST(NULL AS STRING) AS superseded_by FROM edge JOIN turn USING (conv_id) WHERE turn_id = src AND ix IN (1, 2)
UNION ALL SELECT conv_id, 1, concat('again/', edge_id), etype, concat('n/', src), dst, t_created, CAST(NULL AS BIGINT), CAST(NULL AS STRING) FROM edge JOIN turn USING (conv_id) WHERE turn_id = src AND ix = 0 AND length(dst) % 2 = 0
UNION ALL SELECT conv_id, 2, concat('v/', turn_id), 'valid_during', concat('n/', turn_id), concat('t/', turn_id), ts, CAST(NULL AS BIGINT), CAST(NULL AS STRING) FROM turn WHERE ix = 0""",
    "new_provenance": "SELECT conv_id AS commit_id, edge_id, span_id FROM edge JOIN assertion USING (conv_id) WHERE turn_id = src AND ix IN (1, 2)",
    "gone": """
SELECT conv_id AS commit_id, edge_id, t_created + CASE WHEN length(dst) % 3 = 0 THEN 0 ELSE 60 END AS t_invalid,
       CASE WHEN length(dst) % 4 = 0 THEN concat('again/', edge_id) WHEN length(dst) % 7 = 0 THEN 'nowhere' END AS superseded_by FROM edge JOIN turn USING (conv_id) WHERE turn_id = src AND ix = 0 AND length(dst) % 4 < 2""",
}
V_SQL = """, kind AS (SELECT commit_id, node_id, ntype, lo, hi FROM g_new_node UNION SELECT c.commit_id, n.node_id, n.ntype, n.lo, n.hi FROM g_node n JOIN (SELECT DISTINCT commit_id FROM g_new_edge) c
  ON NOT EXISTS (SELECT 1 FROM g_new_node o WHERE o.commit_id = c.commit_id AND o.node_id = n.node_id)),
v AS (
  SELECT e.commit_id, 'V1' AS code, e.edge_id AS id FROM g_new_edge e LEFT JOIN kind s ON s.commit_id = e.commit_id AND s.node_id = e.src LEFT JOIN kind d ON d.commit_id = e.commit_id AND d.node_id = e.dst
  WHERE e.etype = 'invented' OR coalesce(s.ntype, '') NOT IN ('Claim', 'Value', 'Event') OR coalesce(d.ntype, '') <> CASE e.etype WHEN 'about_entity' THEN 'Entity' ELSE 'TimeInterval' END
  UNION ALL SELECT a.commit_id, 'V2', a.node_id FROM g_new_node a JOIN g_node b ON a.node_id = b.node_id AND (a.payload <> b.payload OR a.ntype <> b.ntype OR a.alias <> b.alias)
  UNION ALL SELECT p.commit_id, 'V3', p.edge_id FROM g_new_provenance p WHERE p.span_id NOT IN (SELECT span_id FROM g_span)
  UNION ALL SELECT n.commit_id, 'V4', n.node_id FROM g_new_node n WHERE n.ntype <> 'Entity' AND n.assertion_id IN (SELECT assertion_id FROM g_assertion WHERE eligibility <> 'eligible')
  UNION ALL SELECT commit_id, 'V5', edge_id FROM g_new_edge WHERE t_invalid <= t_created
  UNION ALL SELECT g.commit_id, 'V5', g.edge_id FROM g_gone g JOIN g_edge e USING (edge_id) WHERE g.t_invalid <= e.t_created
  UNION ALL SELECT e.commit_id, 'V5', e.edge_id FROM g_new_edge e JOIN kind k ON k.commit_id = e.commit_id AND k.node_id = e.dst WHERE e.etype = 'valid_during' AND k.hi <= k.lo
  UNION ALL SELECT e.commit_id, 'V6', e.edge_id FROM g_new_edge e JOIN g_edge f ON f.etype = e.etype AND f.src = e.src AND f.dst = e.dst AND f.edge_id <> e.edge_id
            WHERE e.t_invalid IS NULL AND NOT EXISTS (SELECT 1 FROM g_gone g WHERE g.commit_id = e.commit_id AND g.edge_id = f.edge_id)
  UNION ALL SELECT g.commit_id, 'V7', g.edge_id FROM g_gone g WHERE g.superseded_by NOT IN (SELECT edge_id FROM g_new_edge) AND g.superseded_by NOT IN (SELECT edge_id FROM g_edge)),
d AS (SELECT DISTINCT * FROM v)
"""

#: Events as a log: what the payload says is JSON, as a log on disk has it.
LOG = """
SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'node.add' WHEN 'view' THEN 'edge.add' WHEN 'error' THEN 'edge.invalidate' WHEN 'purchase' THEN 'assertion.add'
         ELSE CASE WHEN event_id % 2 = 0 THEN 'assertion.set_flags' ELSE 'assertion.set_eligibility' END END AS op,
       CASE event_type
         WHEN 'signup' THEN concat('{"node_id":"', CAST(user_id AS STRING), '","ntype":"Entity"}')
         WHEN 'view' THEN concat('{"edge_id":"', CAST(user_id AS STRING), '","src":"', CAST(event_id AS STRING), '"}')
         WHEN 'error' THEN concat('{"edge_id":"', CAST(user_id AS STRING), '","t_invalid":"', CAST(event_id AS STRING), '"}')
         WHEN 'purchase' THEN concat('{"assertion_id":"', CAST(user_id AS STRING), '","eligibility":"quarantined","flags":{"asserted_by":"', CAST(event_id AS STRING), '","entailed_score":0.0}}')
         ELSE CASE WHEN event_id % 2 = 0 THEN concat('{"assertion_id":"', CAST(user_id AS STRING), '","entailed_score":', CAST(event_id % 100 AS STRING), '}')
                   ELSE concat('{"assertion_id":"', CAST(user_id AS STRING), '","eligibility":"', CASE WHEN event_id % 3 = 0 THEN 'quarantined' ELSE 'eligible' END, '"}') END END AS payload FROM events"""
EDGES = """SELECT user_id, arg_max(event_id, event_id) FILTER (event_type = 'view') AS added, max(event_id) FILTER (event_type = 'error') AS gone FROM events{} GROUP BY user_id"""
ASSERTIONS = """
WITH a AS (SELECT user_id, max(event_id) AS added FROM events WHERE event_type = 'purchase' GROUP BY user_id),
f AS (SELECT e.user_id, max(event_id) FILTER (event_id % 2 = 0) AS flagged, max(event_id) FILTER (event_id % 2 = 1) AS judged FROM events e JOIN a ON a.user_id = e.user_id AND e.event_id > a.added
      WHERE event_type NOT IN ('signup', 'view', 'error', 'purchase') GROUP BY e.user_id),
s AS (SELECT CAST(a.user_id AS VARCHAR) AS assertion_id, CAST(a.added AS VARCHAR) AS asserted_by, CASE WHEN flagged IS NULL THEN 0.0 ELSE flagged % 100 END::DOUBLE AS entailed_score,
             CASE WHEN judged IS NULL OR judged % 3 = 0 THEN 'quarantined' ELSE 'eligible' END AS eligibility FROM a LEFT JOIN f USING (user_id))
"""


def _folded(spark: SparkSession, sf_dir: str, upto: int | None = None) -> dict[str, DataFrame]:
    return fold.fold(plan(LOG)[0](spark, sf_dir), upto)


#: How the batch's tables say which turn an edge is from, and the same of edges that have their turn's number: no join, so the edges are shuffled once.
EARLY = {"edge JOIN turn ON turn_id = src": "early", "edge JOIN turn USING (conv_id) WHERE turn_id = src AND": "early WHERE", "edge JOIN assertion USING (conv_id)": "early JOIN assertion USING (conv_id, ix)"}


def _staged(spark: SparkSession, sf_dir: str, written: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The batch and its snapshot; the tables named in written are written once for the checks."""
    bodies = dict(STAGED)
    for joined, own in EARLY.items():
        bodies = {n: body.replace(joined, own) for n, body in bodies.items()}
    tables = derived(spark, sf_dir, [*STAGED], bodies)
    for n in ("node", "new_node"):
        one = F.array_compact(F.array("alias"))
        tables[n] = tables[n].withColumn("aliases", one).drop("alias")
    return tables | {n: cut(tables[n]) for n in written}


#: The single checks by the names they are registered under.
SINGLE_H = {"H1": "size", "H2": "resolves", "H3": "closure", "H4": "identity", "H5": "binding", "H6": "retired", "H7": "support", "H8": "temporal", "H9": "scope"}
SINGLE_V = {"V1": "endpoints", "V2": "ids", "V3": "provenance", "V4": "eligibility", "V5": "intervals", "V6": "duplicates", "V7": "successor"}

QUERIES = {
    "check_h_violations": lambda spark, d: checks.violations(derived(spark, d, H_TABLES)),
    "check_h_by_category": lambda spark, d: checks.tally(derived(spark, d, H_TABLES)),
    "commit_validate_violations": lambda spark, d: commits.violations(_staged(spark, d, ("node", "new_node"))),
    "commit_tally_zero_filled": lambda spark, d: commits.tally(_staged(spark, d, ("node", "new_node"))),
    "log_fold_edges": lambda spark, d: _folded(spark, d)["edge"].select("edge_id", "src", "t_invalid"),
    "log_fold_assertions": lambda spark, d: _folded(spark, d)["assertion"].select("assertion_id", "asserted_by", "entailed_score", "eligibility"),
    "log_fold_counts": lambda spark, d: fold.counts(_folded(spark, d)),
    "log_fold_liveness": lambda spark, d: fold.liveness_changes(_folded(spark, d, 4000), _folded(spark, d)),
    "log_fold_digest": lambda spark, d: fold.digest(_folded(spark, d)),
}
ORACLE = {
    "check_h_violations": _oracle(H_SQL + "SELECT set_id, code, atom_id FROM d", H_TABLES),
    "check_h_by_category": _oracle(
        H_SQL + "SELECT c.code, c.name, count(d.code) AS findings FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in checks.CODES.items())
        + ") c(code, name) LEFT JOIN d ON d.code = c.code GROUP BY c.code, c.name", H_TABLES),
    "commit_validate_violations": _oracle(V_SQL + "SELECT commit_id, code, id FROM d", [*STAGED], STAGED),
    "commit_tally_zero_filled": _oracle(
        V_SQL + "SELECT c.code, c.name, count(d.code) AS findings FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in commits.CODES.items())
        + ") c(code, name) LEFT JOIN d ON d.code = c.code GROUP BY c.code, c.name", [*STAGED], STAGED),
    "log_fold_edges": f"""SELECT CAST(user_id AS VARCHAR) AS edge_id, CAST(added AS VARCHAR) AS src, CASE WHEN gone > added THEN CAST(gone AS VARCHAR) END AS t_invalid
FROM ({EDGES.format("")}) e WHERE added IS NOT NULL""",
    "log_fold_assertions": ASSERTIONS + "SELECT * FROM s",
    "log_fold_counts": ASSERTIONS + f"""SELECT (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'signup') AS nodes, e.*, (SELECT count(*) FROM s) AS assertions,
(SELECT count(*) FROM s WHERE eligibility = 'eligible') AS eligible_assertions, 0::BIGINT AS turns, 0::BIGINT AS spans
FROM (SELECT count(added) AS edges, count(*) FILTER (added IS NOT NULL AND NOT coalesce(gone > added, false)) AS live_edges FROM ({EDGES.format("")}) x) e""",
    "log_fold_liveness": f"""
SELECT CAST(n.user_id AS VARCHAR) AS edge_id, coalesce(b.added > coalesce(b.gone, -1), false) AS was, coalesce(n.added > coalesce(n.gone, -1), false) AS now
FROM ({EDGES.format("")}) n LEFT JOIN ({EDGES.format(" WHERE event_id < 4000")}) b USING (user_id)
WHERE coalesce(b.added > coalesce(b.gone, -1), false) <> coalesce(n.added > coalesce(n.gone, -1), false)""",
}
for _c, _n in [*SINGLE_H.items(), ("H8", "supersession")]:
    QUERIES[f"check_{_c.lower()}_{_n}"] = lambda spark, d, c=_c: checks.violations(derived(spark, d, H_TABLES), codes=(c,)).drop("code")
    ORACLE[f"check_{_c.lower()}_{_n}"] = _oracle(H_SQL + f"SELECT set_id, atom_id FROM d WHERE code = '{_c}'", H_TABLES)
for _c, _n in SINGLE_V.items():
    QUERIES[f"commit_{_c.lower()}_{_n}"] = lambda spark, d, c=_c: commits.violations(_staged(spark, d), codes=(c,)).drop("code")
    ORACLE[f"commit_{_c.lower()}_{_n}"] = _oracle(V_SQL + f"SELECT commit_id, id FROM d WHERE code = '{_c}'", [*STAGED], STAGED)
