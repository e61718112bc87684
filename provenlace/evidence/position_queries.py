"""Registered queries of the as-of join, references and claim pairs; the SQL beside them is written apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenlace.evidence import asof, pairs, references
from provenlace.evidence.queries import LOG
from provenlace.plans.dialect import plan, render
from provenlace.plans.views import with_views


def asof_item_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signup with its user's assertion as the log has it at that position."""
    log = plan(LOG)[0](spark, sf_dir).filter("op LIKE 'assertion.%'")
    said = lambda path: F.get_json_object("payload", path)
    flag = lambda name: F.coalesce(said(f"$.{name}"), said(f"$.flags.{name}"))
    added = F.when(F.col("op") == "assertion.add", F.col("seq"))
    changes = log.select(
        said("$.assertion_id").alias("user"), "seq", added.alias("added_at"), flag("asserted_by").alias("asserted_by"),
        flag("entailed_score").cast("double").alias("entailed_score"), said("$.eligibility").alias("eligibility"),
    )
    items = plan("SELECT event_id AS seq, CAST(user_id AS STRING) AS user FROM events WHERE event_type = 'signup'")[0](spark, sf_dir)
    state = asof.asof(items, changes, "user", "seq", ["added_at", "asserted_by", "entailed_score", "eligibility"])
    there = F.col("added_at").isNotNull()
    return state.select("seq", "user", there.alias("present"), *[F.when(there, F.col(c)).alias(c) for c in ("asserted_by", "entailed_score", "eligibility")])


def asof_order_at_shipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shipped line with the last order that its customer had made before that day."""
    when = "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, o_custkey, @epoch(l_shipdate) AS at FROM lineitem JOIN orders ON o_orderkey = l_orderkey"
    made = "SELECT o_custkey, @epoch(o_orderdate) AS at, o_orderkey AS last_order, o_orderstatus AS last_status FROM orders"
    items, changes = plan(when)[0](spark, sf_dir), plan(made)[0](spark, sf_dir).withColumn("tie", F.col("last_order"))
    return asof.asof(items, changes, "o_custkey", "at", ["last_order", "last_status"], ["tie"], block=86_400 * 90)


#: A customer's orders as a pool: each refers to the one before; BUILDING customers' first order refers to their last one, MACHINERY customers' to none that is there.
POOL = """
SELECT CAST(o_custkey AS STRING) AS question_id, concat('o/', CAST(o_orderkey AS STRING)) AS atom_id, c_mktsegment AS segment,
       concat('o/', CAST(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS STRING)) AS before,
       concat('o/', CAST(last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS STRING)) AS final
FROM orders JOIN customer ON c_custkey = o_custkey"""


def _pool(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = plan(POOL)[0](spark, sf_dir)
    other = F.when(F.col("segment") == "BUILDING", F.col("final")).when(F.col("segment") == "MACHINERY", F.lit("nowhere"))
    return rows.select("question_id", "atom_id"), rows.select("question_id", "atom_id", F.coalesce("before", other).alias("ref")).filter("ref IS NOT NULL")


# for the oracle: places of a customer's orders in time
PLACES = """
WITH p AS (
  SELECT CAST(o_custkey AS VARCHAR) AS question_id, 'o/' || CAST(o_orderkey AS VARCHAR) AS atom_id, c_mktsegment AS segment,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n
  FROM orders JOIN customer ON c_custkey = o_custkey)
"""
CLAIMS = """
SELECT conv_id AS question_id, turn_id AS claim_id, speaker AS session_id, collect_set(tok) AS tokens FROM turn_token GROUP BY conv_id, turn_id, speaker"""

QUERIES = {
    "asof_item_state": asof_item_state,
    "asof_order_at_shipment": asof_order_at_shipment,
    "ref_closure": lambda spark, d: references.closure(_pool(spark, d)[1].filter("ref <> 'nowhere'")),
    "ref_levels": lambda spark, d: references.levels(*_pool(spark, d)),
    "pool_reference_cycles": lambda spark, d: references.cycles(_pool(spark, d)[1]),
    "pool_problems": lambda spark, d: references.problems(*_pool(spark, d), cap=20),
    "claim_pairs_shared_tokens": lambda spark, d: pairs.best_pairs(plan(CLAIMS)[0](spark, d), 4).withColumn("overlap", F.round("overlap", 6)),
}
ORACLE = {
    "asof_item_state": """
WITH s AS (SELECT event_id, user_id FROM events WHERE event_type = 'signup'),
a AS (SELECT s.event_id, max(e.event_id) AS added FROM s JOIN events e ON e.user_id = s.user_id AND e.event_id < s.event_id AND e.event_type = 'purchase' GROUP BY 1),
f AS (SELECT s.event_id, max(e.event_id) FILTER (e.event_id % 2 = 0) AS flagged, max(e.event_id) FILTER (e.event_id % 2 = 1) AS judged
      FROM s JOIN a USING (event_id) JOIN events e ON e.user_id = s.user_id AND e.event_id < s.event_id AND e.event_id > a.added
      WHERE e.event_type NOT IN ('signup', 'view', 'error', 'purchase') GROUP BY 1)
SELECT s.event_id AS seq, CAST(s.user_id AS VARCHAR) AS "user", added IS NOT NULL AS present, CAST(added AS VARCHAR) AS asserted_by,
       CASE WHEN added IS NULL THEN NULL WHEN flagged IS NULL THEN 0.0 ELSE flagged % 100 END::DOUBLE AS entailed_score,
       CASE WHEN added IS NULL THEN NULL WHEN judged IS NULL OR judged % 3 = 0 THEN 'quarantined' ELSE 'eligible' END AS eligibility
FROM s LEFT JOIN a USING (event_id) LEFT JOIN f USING (event_id)""",
    "asof_order_at_shipment": """
WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, o_custkey, l_shipdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS last_order, arg_max(o_orderstatus, o_orderkey) AS last_status FROM orders GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l.o_custkey, epoch(l_shipdate)::BIGINT AS at, last_order, last_status
FROM l ASOF LEFT JOIN o ON o.o_custkey = l.o_custkey AND o.o_orderdate < l.l_shipdate""",
    "ref_closure": PLACES + """
SELECT a.question_id, a.atom_id, b.atom_id AS ref, CASE WHEN a.i > b.i THEN a.i - b.i ELSE a.i - b.i + a.n END AS hops
FROM p a JOIN p b ON b.question_id = a.question_id WHERE a.i > b.i OR a.segment = 'BUILDING'""",
    "ref_levels": PLACES + "SELECT question_id, atom_id, CASE WHEN segment <> 'BUILDING' THEN i END AS level FROM p",
    "pool_reference_cycles": PLACES + "SELECT question_id, min(atom_id) OVER (PARTITION BY question_id) AS cycle_id, atom_id FROM p WHERE segment = 'BUILDING'",
    "pool_problems": PLACES + """
SELECT question_id, 'cycle' AS problem, atom_id, min(atom_id) OVER (PARTITION BY question_id) AS detail FROM p WHERE segment = 'BUILDING'
UNION ALL SELECT question_id, 'missing', atom_id, 'nowhere' FROM p WHERE segment = 'MACHINERY' AND i = 0
UNION ALL SELECT question_id, 'over_cap', NULL, CAST(count(*) AS VARCHAR) FROM p GROUP BY question_id HAVING count(*) > 20""",
    "claim_pairs_shared_tokens": render(with_views("""
SELECT question_id, a, b, cross_session, round(overlap, 6) AS overlap, rank FROM (
  SELECT *, (row_number() OVER (PARTITION BY question_id ORDER BY cross_session DESC, overlap DESC, a, b))::INT AS rank FROM (
    SELECT x.conv_id AS question_id, x.turn_id AS a, y.turn_id AS b, x.speaker IS DISTINCT FROM y.speaker AS cross_session,
           len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) AS overlap
    FROM (SELECT conv_id, turn_id, speaker, list(tok) AS t FROM turn_token GROUP BY ALL) x
    JOIN (SELECT conv_id, turn_id, speaker, list(tok) AS t FROM turn_token GROUP BY ALL) y ON y.conv_id = x.conv_id AND x.turn_id < y.turn_id) z
  WHERE overlap > 0) r WHERE rank <= 4""", ()), False),
}
