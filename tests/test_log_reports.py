"""The log's reports on hand-made logs."""

from __future__ import annotations

import json

import pytest

from provenlace.evidence import fold, log_reports


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        ("span.add", {"span_id": "s1", "turn_id": "t1", "start": 0, "end": 3}),
        ("mention.add", {"span_id": "s1", "turn_id": "t1", "rung": "exact"}),
        ("mention.add", {"span_id": "s1", "turn_id": "t1", "rung": "fuzzy"}),
        ("mention.add", {"span_id": "torn", "turn_id": "t1", "rung": "exact"}),
        ("mention.add", {"span_id": None, "turn_id": "t1"}),
        ("turn.add", {"turn_id": "t1", "conv_id": "c"}),
        ("assertion.add", {"assertion_id": "a", "spans": ["s1", "s2"]}),
        ("assertion.set_eligibility", {"assertion_id": "a", "eligibility": "eligible"}),
        ("assertion.add", {"assertion_id": "b", "spans": ["s1"], "eligibility": "eligible"}),
        ("assertion.add", {"assertion_id": "b", "spans": ["s1"], "eligibility": "eligible"}),
        ("assertion.set_eligibility", {"assertion_id": "ghost", "eligibility": "eligible"}),
        ("assertion.add", {"assertion_id": "c", "spans": []}),
        ("assertion.set_eligibility", {"assertion_id": "c", "eligibility": "eligible"}),
        ("assertion.set_eligibility", {"assertion_id": "c", "eligibility": "quarantined"}),
    ]
    rows = [(i, op, json.dumps(p)) for i, (op, p) in enumerate(rows)] + [(99, "turn.add", "no json"), (98, "mention.add", None)]
    return spark.createDataFrame(rows, "seq long, op string, payload string").cache()


def test_reports(log):
    state = fold.fold(log)
    assert [tuple(r) for r in log_reports.ingested_turns(log).collect()] == [("t1",)]
    assert log_reports.ingested_turns(log, 5).count() == 0
    assert {(r["span_id"], r["rung"], r["seq"]) for r in log_reports.mentions(log).collect()} == {("s1", "exact", 1), ("torn", "exact", 3)}
    assert [(r["span_id"], r["end"]) for r in log_reports.mention_records(log, state).collect()] == [("s1", 3)]
    assert [tuple(r) for r in log_reports.unverified(log).collect()] == [("b", 8)]
    assert [tuple(r) for r in log_reports.eligible_since(log, state).collect()] == [("a", 7)]
    row = log_reports.yields(log, state).first()
    assert (row["turns"], row["mentions"], row["assertions_stored"], row["assertions_eligible"], row["multi_span_assertions"]) == (1, 1, 3, 2, 1)
    empty = log.limit(0)
    assert log_reports.yields(empty, fold.fold(empty)).first()["mentions_per_turn"] is None


def test_ledger(spark):
    rows = [("q", "a", log_reports.METERS[0], 3), ("q", "b", log_reports.METERS[0], 4), (None, None, log_reports.METERS[0], 9), ("q", "a", log_reports.METERS[1], 50)]
    spent = spark.createDataFrame(rows, "query_id string, stage string, meter string, amount long")
    got = {(r["query_id"], r["stage"], r["meter"]): (r["amount"], r["query_amount"], r["over_cap"]) for r in log_reports.ledger(spent, {log_reports.METERS[0]: 6}).collect()}
    m, n = log_reports.METERS[:2]
    assert got == {("q", "a", m): (3, 7, True), ("q", "b", m): (4, 7, True), (None, None, m): (9, 9, True), ("q", "a", n): (50, 50, False)}
    assert log_reports.ledger(spent, {m: 9}, strict=True).count() == 4
    with pytest.raises(Exception, match="over the cap"):
        log_reports.ledger(spent, {m: 6}, strict=True).collect()
    with pytest.raises(Exception, match="unknown meter"):
        log_reports.ledger(spent.replace(m, "smiles"), strict=True).collect()
