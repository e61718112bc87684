"""Registered queries of pools and of the reader over the derived graph tables; the SQL beside them is written apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenlace.evidence import pools, reader, retrieval
from provenlace.evidence.queries import TABLES, _oracle, derived
from provenlace.plans.dialect import plan

BUDGET, CAP = 160, 24
WEIGHTS = {"graph": 0.5}
#: Beside the graph: chosen nodes, scored atoms, positions and bounds of spans, names, and generations of a reader.
POOL = TABLES | {
    "chosen": "SELECT conv_id AS question_id, concat('n/', turn_id) AS node_id FROM turn WHERE ix % 2 = 0",
    "assertion": "SELECT assertion_id, eligibility, text_norm FROM assertion",
    "assertion_span": """
SELECT assertion_id, 1 AS pos, span_id FROM assertion UNION ALL SELECT assertion_id, 0, 'torn' FROM assertion WHERE ix % 3 = 0""",
    "span": "SELECT span_id, turn_id, ix % 4 AS start, ix % 4 + CASE WHEN ix % 5 = 4 THEN 0 ELSE 30 END AS end FROM assertion WHERE ix % 9 <> 8",
    "turn": "SELECT turn_id, conv_id, text FROM turn",
    "name": "SELECT DISTINCT dst AS node_id, dst AS name FROM edge WHERE length(dst) % 2 = 0",
    "spans_of": """
SELECT concat('n/', turn_id) AS target, 1 AS pos, span_id FROM assertion UNION ALL SELECT concat('n/', turn_id), 0, 'torn' FROM assertion WHERE ix % 3 = 0""",
    "scored": """
SELECT conv_id AS question_id, concat('a/', turn_id) AS atom_id, 'node' AS kind, ix % 3 = 0 AS hit, CAST(length(text) % 7 AS DOUBLE) AS score,
       concat('[c] ', text) AS line, CAST(NULL AS STRING) AS ref FROM turn
UNION ALL SELECT conv_id, concat('e/', edge_id), 'edge', false, CAST(length(dst) AS DOUBLE), concat('[c] (', etype, ' ', dst, ')'), concat('a/', src) FROM edge WHERE length(dst) % 3 = 0""",
    "generation": """
SELECT turn_id AS answer_id, ix, CASE ix % 7 WHEN 0 THEN 'Answer: [[INSUFFICIENT EVIDENCE]]' WHEN 1 THEN concat('answer:', substr(text, 1, 30), ' [C2] and [c1] [c2]') WHEN 2 THEN '[c3][c4]'
  WHEN 3 THEN '[?]' WHEN 4 THEN concat('  [', substr(text, 1, 20), ']  ') WHEN 5 THEN 'insufficient evidence [c9]' ELSE concat(substr(text, 1, 40), ' [c', CAST(ix AS STRING), ']') END AS said FROM turn""",
    "hits": """
SELECT conv_id AS question_id, 'bm25' AS channel, concat('n/', turn_id) AS node_id, CAST(length(text) % 7 AS DOUBLE) AS score FROM turn WHERE ix % 2 = 0
UNION ALL SELECT conv_id, 'dense', concat('n/', turn_id), CAST(length(text) % 11 AS DOUBLE) / 10 FROM turn WHERE ix < 5
UNION ALL SELECT conv_id, 'entity', concat('n/', turn_id), CAST(1 AS DOUBLE) FROM turn WHERE ix % 3 = 0
UNION ALL SELECT conv_id, 'graph', concat('n/', turn_id), CASE ix WHEN 1 THEN CAST(1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) / 2 END FROM turn WHERE ix BETWEEN 1 AND 4""",
    "constraint": "SELECT DISTINCT conv_id AS question_id, CAST(1704067200 + CAST(conv_id AS BIGINT) * 86400 + 60 AS DOUBLE) AS lo, CAST(1704067200 + CAST(conv_id AS BIGINT) * 86400 + 150 AS DOUBLE) AS hi FROM turn WHERE CAST(conv_id AS BIGINT) % 2 = 1",
    "shown": "SELECT turn_id AS answer_id, 'c1' AS claim_id, concat('a/', turn_id) AS atom_id FROM turn UNION ALL SELECT turn_id, 'c6', concat('b/', turn_id) FROM turn",
}


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [*derived(spark, sf_dir, list(names), POOL, merged=True).values()]


def _atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, node, edge = _tables(spark, sf_dir, "chosen", "node", "edge")
    return pools.materialise(pools.with_companions(chosen, node, edge), node, edge)


def pool_companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.companions(*_tables(spark, sf_dir, "node", "edge"))


def pool_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _atoms(spark, sf_dir)


def pool_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.adjacency(_atoms(spark, sf_dir)).groupBy("question_id", "relation").agg(
        F.count(F.lit(1)).alias("links"), F.countDistinct("src").alias("sources"), F.min("dst").alias("first_dst")
    )


def pool_edge_ref_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool with every fifth edge atom's ends exchanged, and every seventh naming no edge."""
    atoms, (edge,) = _atoms(spark, sf_dir), _tables(spark, sf_dir, "edge")
    turned = F.conv(F.substring("atom_id", 1, 4), 16, 10).cast("int") % 5 == 0
    named = F.when((F.col("kind") == "edge") & (F.conv(F.substring("atom_id", 5, 4), 16, 10).cast("int") % 7 == 0), "nothing").otherwise(F.col("target"))
    bad = atoms.select(
        "question_id", "atom_id", "kind", named.alias("target"), F.when(turned, F.col("ref_dst")).otherwise(F.col("ref_src")).alias("ref_src"),
        F.when(turned, F.col("ref_src")).otherwise(F.col("ref_dst")).alias("ref_dst"),
    )
    return pools.edge_ref_problems(bad, edge)


def graph_intervals_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.intervals_of(*_tables(spark, sf_dir, "node", "edge"))


def graph_node_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.node_text(*_tables(spark, sf_dir, "node", "assertion"))


def graph_conversation_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.conversation_of(*_tables(spark, sf_dir, "assertion_span", "span", "turn"))


def atom_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans_of, span, turn, edge, name = _tables(spark, sf_dir, "spans_of", "span", "turn", "edge", "name")
    return reader.quotes(_atoms(spark, sf_dir), spans_of, span, turn, edge, name)


def serialise_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.order(*_tables(spark, sf_dir, "scored")).select("question_id", "atom_id", "place")


def serialise_order_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = reader.order(*_tables(spark, sf_dir, "scored")).withColumn("tokens", reader.approx_tokens(F.col("line")))
    return reader.cut(placed.withColumn("refs", F.array_compact(F.array("ref"))), BUDGET)


def answer_parse_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    (said,) = _tables(spark, sf_dir, "generation")
    a = said.select("answer_id", reader.parse_answer(F.col("said")).alias("a"))
    return a.select("answer_id", "a.answer_text", F.array_join("a.citations", ",").alias("citations"), "a.abstained")


def answer_resolve_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    said, shown = _tables(spark, sf_dir, "generation", "shown")
    parsed = said.select("answer_id", reader.parse_answer(F.col("said"))["citations"].alias("citations"))
    return reader.resolve_citations(parsed, shown, strict=False)


def channel_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    (hits,) = _tables(spark, sf_dir, "hits")
    return retrieval.fuse(retrieval.scaled(hits, WEIGHTS)).select("question_id", "node_id", "score", "winner")


def channel_fusion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    (hits,) = _tables(spark, sf_dir, "hits")
    return retrieval.fusion_report(retrieval.fuse(retrieval.scaled(hits, WEIGHTS)))


def temporal_filter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, constraint, node, edge = _tables(spark, sf_dir, "hits", "constraint", "node", "edge")
    kept = retrieval.temporal_filter(retrieval.fuse(retrieval.scaled(hits, WEIGHTS)), constraint, pools.intervals_of(node, edge))
    return kept.groupBy("question_id", "reason").agg(F.count(F.lit(1)).alias("nodes"))


def retrieval_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, constraint, node, edge = _tables(spark, sf_dir, "hits", "constraint", "node", "edge")
    atoms = retrieval.assemble(hits, constraint, node, edge, CAP, WEIGHTS)
    return atoms.select("question_id", "atom_id", "kind", "target", "label", "score", F.size("channels").alias("channels"))


NODE_ATOM = "substr(sha256('atom' || chr(31) || 'node' || chr(31) || chr(31) || {} || chr(31)), 1, 16)"
POOL_SQL = f""", comp AS (SELECT DISTINCT e.src AS node_id, e.dst AS companion FROM g_edge e JOIN g_node n ON n.node_id = e.dst
  WHERE e.t_invalid IS NULL AND e.etype IN ('about_entity', 'valid_during') AND n.ntype IN ('Entity', 'TimeInterval')),
n AS (SELECT question_id, node_id FROM g_chosen UNION SELECT question_id, companion FROM g_chosen JOIN comp USING (node_id)),
ea AS (SELECT a.question_id, e.edge_id, e.etype, {NODE_ATOM.format("e.src")} AS x, {NODE_ATOM.format("e.dst")} AS y
  FROM n a, n b, g_edge e WHERE a.question_id = b.question_id AND a.node_id = e.src AND b.node_id = e.dst AND e.t_invalid IS NULL),
atoms AS (SELECT n.question_id, {NODE_ATOM.format("n.node_id")} AS atom_id, 'node' AS kind, n.node_id AS target, coalesce(k.ntype, '') AS label, NULL AS ref_src, NULL AS ref_dst
  FROM n LEFT JOIN g_node k USING (node_id)
  UNION ALL SELECT question_id, substr(sha256(concat_ws(chr(31), 'atom', 'edge', x || ',' || y, edge_id, etype)), 1, 16), 'edge', edge_id, etype, x, y FROM ea)
"""
PLACED = """, r AS (SELECT question_id, atom_id, kind, row_number() OVER (PARTITION BY question_id, kind = 'edge' ORDER BY hit DESC, score DESC, atom_id DESC) AS rn,
  count(*) OVER (PARTITION BY question_id, kind = 'edge') AS n FROM g_scored),
s AS (SELECT *, CASE WHEN kind = 'edge' THEN 2 WHEN rn <= n - n // 2 THEN 1 ELSE 3 END AS part FROM r)
SELECT question_id, atom_id, row_number() OVER (PARTITION BY question_id ORDER BY part, CASE WHEN part = 3 THEN -rn ELSE rn END) AS place FROM s"""
ANSWERS = r""", t AS (SELECT answer_id, CASE WHEN lower(said) LIKE 'answer:%' THEN trim(substr(said, 8)) ELSE trim(said) END AS answer_text FROM g_generation),
p AS (SELECT answer_id, answer_text, [lower(x) FOR x IN regexp_extract_all(answer_text, '(?i)\[(c[0-9]+)\]', 1)] AS c,
  trim(regexp_replace(regexp_replace(answer_text, '(?i)\[c[0-9]+\]', ' ', 'g'), '\s+', ' ', 'g')) AS bare FROM t),
a AS (SELECT answer_id, answer_text, list_filter(c, lambda x, i: list_position(c, x) = i) AS c,
  lower(regexp_replace(bare, '^[\[ ]+', '')) LIKE 'insufficient evidence%' OR regexp_full_match(lower(bare), '((a|an|the)\b|[^a-z0-9])*') AS abstained FROM p)
"""
FUSED = """, e AS (SELECT question_id, channel, min(score) AS lo, max(score) AS hi FROM g_hits GROUP BY question_id, channel),
w AS (SELECT h.question_id, h.channel, h.node_id, round(CASE WHEN hi = lo THEN 1 ELSE (score - lo) / (hi - lo) END * CASE h.channel WHEN 'graph' THEN 0.5 ELSE 1 END, 9) AS s FROM g_hits h JOIN e USING (question_id, channel)),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id, node_id ORDER BY s DESC, channel) AS rn, count(*) OVER (PARTITION BY question_id, node_id) AS n FROM w)
"""
_G, _C = ["node", "edge", "chosen"], ["generation"]
QUERIES = {f.__name__: f for f in (
    pool_companions, pool_materialise, pool_adjacency, pool_edge_ref_problems, graph_intervals_of, graph_node_text, graph_conversation_of, atom_quotes,
    serialise_order, serialise_order_and_cut, answer_parse_citations, answer_resolve_citations, channel_fusion, channel_fusion_report, temporal_filter_report, retrieval_assemble)}
ORACLE = {
    "pool_companions": _oracle(POOL_SQL + "SELECT * FROM comp", _G, POOL),
    "pool_materialise": _oracle(POOL_SQL + "SELECT * FROM atoms", _G, POOL),
    "pool_adjacency": _oracle(POOL_SQL + """, l AS (
SELECT question_id, x AS src, y AS dst, etype AS relation FROM ea UNION ALL SELECT question_id, y, x, 'rev_' || etype FROM ea
UNION ALL SELECT question_id, unnest([atom_id, ref_src, atom_id, ref_dst]), unnest([ref_src, atom_id, ref_dst, atom_id]), 'incident' FROM atoms WHERE kind = 'edge')
SELECT question_id, relation, count(*) AS links, count(DISTINCT src) AS sources, min(dst) AS first_dst FROM l GROUP BY question_id, relation""", _G, POOL),
    "pool_edge_ref_problems": _oracle(POOL_SQL + """
SELECT question_id, atom_id, CASE WHEN ('0x' || substr(atom_id, 5, 4))::INT % 7 = 0 THEN 'unknown edge' ELSE 'other ends' END AS problem FROM atoms
WHERE kind = 'edge' AND (('0x' || substr(atom_id, 5, 4))::INT % 7 = 0 OR (('0x' || substr(atom_id, 1, 4))::INT % 5 = 0 AND ref_src <> ref_dst))""", _G, POOL),
    "graph_intervals_of": _oracle("""SELECT e.src AS node_id, n.lo, n.hi FROM g_edge e, g_node n
WHERE e.etype = 'valid_during' AND e.t_invalid IS NULL AND n.node_id = e.dst AND n.ntype = 'TimeInterval' AND NOT (n.lo IS NULL AND n.hi IS NULL) AND (n.lo IS NULL OR n.hi IS NULL OR n.lo <= n.hi)""", _G, POOL),
    "graph_node_text": _oracle("SELECT node_id, coalesce((SELECT text_norm FROM g_assertion a WHERE a.assertion_id = n.assertion_id), '') AS text FROM g_node n", ["node", "assertion"], POOL),
    "graph_conversation_of": _oracle("""SELECT assertion_id, conv_id FROM (SELECT a.assertion_id, t.conv_id, row_number() OVER (PARTITION BY a.assertion_id ORDER BY a.pos, a.span_id) AS rn
FROM g_assertion_span a JOIN g_span USING (span_id) JOIN g_turn t USING (turn_id)) x WHERE rn = 1""", ["assertion_span", "span", "turn"], POOL),
    "atom_quotes": _oracle(POOL_SQL + """, said AS (SELECT o.target, trim(substr(t.text, s."start" + 1, s."end" - s."start")) AS said FROM g_spans_of o JOIN g_span s USING (span_id) JOIN g_turn t USING (turn_id))
SELECT a.question_id, a.atom_id, CASE a.kind WHEN 'edge' THEN (SELECT '(' || e.etype || ' → ' || coalesce((SELECT name FROM g_name m WHERE m.node_id = e.dst), e.dst) || ')' FROM g_edge e WHERE e.edge_id = a.target)
  ELSE coalesce((SELECT said FROM said s WHERE s.target = a.target AND s.said <> ''), (SELECT name FROM g_name m WHERE m.node_id = a.target), '') END AS quote FROM atoms a""",
        [*_G, "spans_of", "span", "turn", "name"], POOL),
    "channel_fusion": _oracle(FUSED + "SELECT question_id, node_id, s AS score, channel AS winner FROM r WHERE rn = 1", ["hits"], POOL),
    "channel_fusion_report": _oracle(FUSED + """SELECT question_id, channel, count(*) AS returned, count(*) FILTER (rn = 1) AS wins, count(*) FILTER (n = 1) AS only_here
FROM r GROUP BY question_id, channel""", ["hits"], POOL),
    "temporal_filter_report": _oracle(""", n AS (SELECT DISTINCT question_id, node_id FROM g_hits),
i AS (SELECT e.src AS node_id, t.lo, coalesce(t.hi, 1e300) AS hi FROM g_edge e JOIN g_node t ON t.node_id = e.dst WHERE e.etype = 'valid_during' AND e.t_invalid IS NULL),
x AS (SELECT n.question_id, CASE WHEN NOT EXISTS (SELECT 1 FROM g_constraint c WHERE c.question_id = n.question_id) THEN 'no constraint' WHEN NOT EXISTS (SELECT 1 FROM i WHERE i.node_id = n.node_id) THEN 'no interval'
  WHEN EXISTS (SELECT 1 FROM i JOIN g_constraint c ON i.lo < c.hi AND c.lo < i.hi AND i.lo < i.hi WHERE i.node_id = n.node_id AND c.question_id = n.question_id) THEN 'overlap' ELSE 'miss' END AS reason FROM n)
SELECT question_id, reason, count(*) AS nodes FROM x GROUP BY question_id, reason""", ["node", "edge", "hits", "constraint"], POOL),
    "serialise_order": _oracle(PLACED, ["scored"], POOL),
    "answer_parse_citations": _oracle(ANSWERS + "SELECT answer_id, answer_text, CASE WHEN abstained THEN '' ELSE array_to_string(c, ',') END AS citations, abstained FROM a", _C, POOL),
    "answer_resolve_citations": _oracle(ANSWERS + """, u AS (SELECT answer_id, unnest(c) AS citation, generate_subscripts(c, 1) - 1 AS pos FROM a WHERE NOT abstained)
SELECT u.answer_id, u.pos, u.citation, s.atom_id FROM u LEFT JOIN g_shown s ON s.answer_id = u.answer_id AND s.claim_id = u.citation""", [*_C, "shown"], POOL),
}
