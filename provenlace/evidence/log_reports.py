"""What a log says about its own progress: turns taken in, mentions, verdicts, yields, and the ledger of what was spent.

The log is (seq, op, payload as JSON), as for the fold. Every operator is one aggregation by key; none orders the whole log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenlace.evidence.fold import counts

#: What a run meters.
METERS = ("terminal_checks", "incremental_ops", "model_forwards", "llm_calls", "llm_tokens_in", "llm_tokens_out", "wall_clock_ms")


def _ops(log: DataFrame, op: str, schema: str, upto: int | None = None) -> DataFrame:
    log = log.filter(F.col("op") == op)
    log = log if upto is None else log.filter(F.col("seq") < upto)
    return log.select("seq", F.from_json("payload", schema).alias("r")).select("seq", "r.*")


def ingested_turns(log: DataFrame, upto: int | None = None) -> DataFrame:
    """(turn_id) of all turns taken in, once each."""
    return _ops(log, "turn.add", "turn_id string", upto).select("turn_id").filter("turn_id IS NOT NULL").distinct()


def still_to_ingest(turns: DataFrame, log: DataFrame, upto: int | None = None) -> DataFrame:
    """Rows of turns that the log does not hold yet; null ids are never held."""
    return turns.join(ingested_turns(log, upto), "turn_id", "left_anti")


def mentions(log: DataFrame, upto: int | None = None) -> DataFrame:
    """(span_id, turn_id, rung, seq): the first mention of each span; a later one repeats it after a crash. Null spans are left out."""
    rows = _ops(log, "mention.add", "span_id string, turn_id string, rung string", upto).filter("span_id IS NOT NULL")
    first = rows.groupBy("span_id").agg(F.min(F.struct("seq", "turn_id", "rung")).alias("m"))
    return first.select("span_id", "m.turn_id", "m.rung", "m.seq")


def unverified(log: DataFrame, upto: int | None = None) -> DataFrame:
    """(assertion_id, first_seq) of assertions that no verdict names, wherever in the log it stands; first_seq gives their order."""
    stored = _ops(log, "assertion.add", "assertion_id string", upto).filter("assertion_id IS NOT NULL")
    judged = _ops(log, "assertion.set_eligibility", "assertion_id string", upto).select("assertion_id").distinct()
    return stored.groupBy("assertion_id").agg(F.min("seq").alias("first_seq")).join(judged, "assertion_id", "left_anti")


def mention_records(log: DataFrame, state: dict[str, DataFrame]) -> DataFrame:
    """(span_id, turn_id, start, end, rung, seq): mentions whose span and turn are both in the state; torn ones are left out."""
    spans = state["span"].select("span_id", "start", "end")
    out = mentions(log).join(spans, "span_id").join(state["turn"].select("turn_id"), "turn_id")
    return out.select("span_id", "turn_id", "start", "end", "rung", "seq")


def eligible_since(log: DataFrame, state: dict[str, DataFrame]) -> DataFrame:
    """(assertion_id, seq) of assertions that end up eligible by a verdict, with the last verdict's place; seq gives their order."""
    last = _ops(log, "assertion.set_eligibility", "assertion_id string").groupBy("assertion_id").agg(F.max("seq").alias("seq"))
    return last.join(state["assertion"].filter("eligibility = 'eligible'").select("assertion_id"), "assertion_id")


def yields(log: DataFrame, state: dict[str, DataFrame]) -> DataFrame:
    """One row: turns, mentions, assertions stored and eligible, rates a turn (null without turns), and stored assertions of several spans."""
    several = _ops(log, "assertion.add", "spans array<string>").agg(F.count_if(F.size("spans") > 1).alias("multi_span_assertions"))
    found = mention_records(log, state).agg(F.count(F.lit(1)).alias("mentions"))
    out = counts(state).crossJoin(found).crossJoin(several)  # one row each
    rate = lambda c: F.round(F.col(c) / F.nullif(F.col("turns"), F.lit(0)), 6)
    return out.select(
        "turns", "mentions", rate("mentions").alias("mentions_per_turn"), F.col("assertions").alias("assertions_stored"),
        F.col("eligible_assertions").alias("assertions_eligible"), rate("eligible_assertions").alias("eligible_per_turn"), "multi_span_assertions",
    )


def ledger(spent: DataFrame, caps: dict[str, float] | None = None, strict: bool = False) -> DataFrame:
    """(query_id, stage, meter, amount, calls, query_amount, over_cap): what each query spent in each stage, and in all, on each meter.

    spent: (query_id, stage, meter, amount). caps: what a query may spend in all, by meter; without a cap over_cap is false.
    Strict: a query over a cap, or an unknown meter, is an error. Null queries, stages and amounts of 0 are groups and rows like any other.
    """
    caps = caps or {}
    known = F.col("meter").isin(*METERS)
    cap = F.lit(None).cast("double")
    for m, most in caps.items():
        cap = F.when(F.col("meter") == m, F.lit(float(most))).otherwise(cap)
    parts = spent.groupBy("query_id", "stage", "meter").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("calls"))
    whole = parts.groupBy(F.col("query_id").alias("__q"), F.col("meter").alias("__m")).agg(F.sum("amount").alias("query_amount"))
    out = parts.join(whole, F.col("query_id").eqNullSafe(F.col("__q")) & F.col("meter").eqNullSafe(F.col("__m")))
    over = F.coalesce(F.col("query_amount") > cap, F.lit(False))
    if strict:
        bad = F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("unknown meter: "), F.coalesce("meter", F.lit("null"))))
        bad = bad.when(over, F.concat(F.lit("over the cap of "), "meter"))
        over = F.when(bad.isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(over)
    return out.select("query_id", "stage", "meter", "amount", "calls", "query_amount", over.alias("over_cap"))


def restored(checkpoints: DataFrame) -> DataFrame:
    """(meter, amount): the ledger as the last of checkpoints (seq, meters as a map) has it; without one, no rows."""
    last = checkpoints.agg(F.max_by("meters", "seq").alias("meters"))
    return last.select(F.explode("meters").alias("meter", "amount"))
