"""Registered queries of the log's reports; each conversation's turns are the log, and the SQL beside them reads the turns instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenlace.evidence import fold, log_reports
from provenlace.plans.dialect import plan, render
from provenlace.plans.views import with_views

AT = "(CAST(conv_id AS BIGINT) * 1000 + ix) * 10"
LOG = f"""
SELECT {AT} AS seq, 'span.add' AS op, concat('{{"span_id":"s/', turn_id, '","turn_id":"', turn_id, '","start":0,"end":', CAST(ix + 5 AS STRING), '}}') AS payload FROM turn WHERE ix % 6 <> 5
UNION ALL SELECT {AT} + 1, 'mention.add', concat('{{"span_id":"s/', turn_id, '","turn_id":"', turn_id, '","rung":"exact"}}') FROM turn
UNION ALL SELECT {AT} + 2, 'mention.add', concat('{{"span_id":"s/', turn_id, '","turn_id":"', turn_id, '","rung":"fuzzy"}}') FROM turn WHERE ix % 3 = 0
UNION ALL SELECT {AT} + 3, 'turn.add', concat('{{"turn_id":"', turn_id, '","conv_id":"', conv_id, '"}}') FROM turn WHERE ix % 7 <> 6
UNION ALL SELECT {AT} + 4, 'assertion.add', concat('{{"assertion_id":"a/', turn_id, '","kind":"claim","spans":["s/', turn_id, CASE WHEN ix % 4 = 1 THEN '","other' ELSE '' END, '"]}}') FROM turn WHERE speaker <> 'system'
UNION ALL SELECT {AT} + 5, 'assertion.set_eligibility', concat('{{"assertion_id":"a/', turn_id, '","eligibility":"', CASE WHEN ix % 2 = 0 THEN 'eligible' ELSE 'quarantined' END, '"}}') FROM turn WHERE ix % 4 <> 3
UNION ALL SELECT {AT} + 6, 'assertion.set_eligibility', concat('{{"assertion_id":"a/', turn_id, '","eligibility":"', CASE WHEN ix % 5 = 0 THEN 'eligible' ELSE 'quarantined' END, '"}}') FROM turn WHERE ix % 5 < 2"""
SPENT = "SELECT user_id % 50 AS query_id, CASE WHEN event_id % 3 = 0 THEN 'retrieve' ELSE 'answer' END AS stage, CASE WHEN event_id % 2 = 0 THEN 'llm_calls' ELSE 'llm_tokens_in' END AS meter, event_id % 9 AS amount FROM events"
CAPS = {"llm_calls": 400, "llm_tokens_in": 450}
UPTO = 200_000


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(LOG)[0](spark, sf_dir)


def log_ingested_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_reports.ingested_turns(_log(spark, sf_dir), UPTO)


def log_idempotent_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_reports.still_to_ingest(plan("SELECT turn_id FROM turn")[0](spark, sf_dir), _log(spark, sf_dir), UPTO)


def log_mentions_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_reports.mentions(_log(spark, sf_dir))


def log_unverified_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_reports.unverified(_log(spark, sf_dir))


def log_mention_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return log_reports.mention_records(log, fold.fold(log))


def log_last_verdict_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return log_reports.eligible_since(log, fold.fold(log))


def log_yield_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return log_reports.yields(log, fold.fold(log))


def log_ledger_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_reports.ledger(plan(SPENT)[0](spark, sf_dir), CAPS)


def log_ledger_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint with each thousandth event: calls so far by number, tokens by amount."""
    at = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id % 1000 = 0").select(F.col("event_id").alias("seq"))
    return log_reports.restored(at.withColumn("meters", F.create_map(F.lit("llm_calls"), F.col("seq"), F.lit("llm_tokens_in"), F.col("seq") * 9)))


def _oracle(body: str) -> str:
    return render(with_views(body, ()), False)


SPANS = "SELECT turn_id, ix FROM turn WHERE ix % 6 <> 5 AND ix % 7 <> 6"
VERDICT = f"""SELECT 'a/' || turn_id AS assertion_id, CASE WHEN ix % 5 < 2 THEN {AT} + 6 ELSE {AT} + 5 END AS seq FROM turn
WHERE speaker <> 'system' AND CASE WHEN ix % 5 < 2 THEN ix % 5 = 0 ELSE ix % 4 <> 3 AND ix % 2 = 0 END"""
QUERIES = {f.__name__: f for f in (
    log_ingested_turns, log_idempotent_antijoin, log_mentions_first_seen, log_unverified_assertions, log_mention_records, log_last_verdict_order, log_yield_rates,
    log_ledger_rollup, log_ledger_restore)}
ORACLE = {
    "log_ingested_turns": _oracle(f"SELECT turn_id FROM turn WHERE ix % 7 <> 6 AND {AT} + 3 < {UPTO}"),
    "log_idempotent_antijoin": _oracle(f"SELECT turn_id FROM turn WHERE ix % 7 = 6 OR {AT} + 3 >= {UPTO}"),
    "log_mentions_first_seen": _oracle(f"SELECT 's/' || turn_id AS span_id, turn_id, 'exact' AS rung, {AT} + 1 AS seq FROM turn"),
    "log_unverified_assertions": _oracle(f"SELECT 'a/' || turn_id AS assertion_id, {AT} + 4 AS first_seq FROM turn WHERE speaker <> 'system' AND ix % 4 = 3 AND ix % 5 >= 2"),
    "log_mention_records": _oracle(f"""SELECT 's/' || turn_id AS span_id, turn_id, 0 AS start, ix + 5 AS "end", 'exact' AS rung, {AT} + 1 AS seq FROM turn WHERE ix % 6 <> 5 AND ix % 7 <> 6"""),
    "log_last_verdict_order": _oracle(VERDICT),
    "log_yield_rates": _oracle(f"""WITH t AS (SELECT count(*) FILTER (ix % 7 <> 6) AS turns, count(*) FILTER (ix % 6 <> 5 AND ix % 7 <> 6) AS mentions, count(*) FILTER (speaker <> 'system') AS stored,
count(*) FILTER (speaker <> 'system' AND ix % 4 = 1) AS multi FROM turn), e AS (SELECT count(*) AS n FROM ({VERDICT}) v)
SELECT turns, mentions, round(mentions / turns, 6) AS mentions_per_turn, stored AS assertions_stored, n AS assertions_eligible, round(n / turns, 6) AS eligible_per_turn, multi AS multi_span_assertions FROM t, e"""),
    "log_ledger_rollup": f"""WITH s AS ({SPENT})
SELECT query_id, stage, meter, CAST(sum(amount) AS BIGINT) AS amount, count(*) AS calls, CAST((SELECT sum(amount) FROM s x WHERE x.query_id = s.query_id AND x.meter = s.meter) AS BIGINT) AS query_amount,
(SELECT sum(amount) FROM s x WHERE x.query_id = s.query_id AND x.meter = s.meter) > CASE meter WHEN 'llm_calls' THEN 400 ELSE 450 END AS over_cap FROM s GROUP BY query_id, stage, meter""",
    "log_ledger_restore": """SELECT unnest(['llm_calls', 'llm_tokens_in']) AS meter, unnest([m, 9 * m]) AS amount FROM (SELECT max(event_id) AS m FROM events WHERE event_id % 1000 = 0) e""",
}
