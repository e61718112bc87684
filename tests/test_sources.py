"""Log and corpus readers on small files with known contents."""

from __future__ import annotations

import hashlib
import json

import pytest

from provenlace.sources import corpora, event_log


def test_log_is_numbered_without_gaps_and_replayed_up_to_a_position(spark, tmp_path):
    folder = str(tmp_path / "log")
    rows = [(i, f"op{i % 3}", f'{{"v":{i}}}', "2024-01-01", "1") for i in range(500)]
    events = spark.createDataFrame(rows, "i int, op string, payload string, ts string, schema_version string").repartition(7)
    after = event_log.append(events, folder, ["i"], 0)
    assert after == 500
    assert event_log.append(events.filter("i < 10"), folder, ["i"], after) == 510
    assert event_log.append(events.filter("i < 0"), folder, ["i"], 510) == 510
    log = event_log.replay(spark, folder)
    assert event_log.snapshot_id(log) == 510
    assert [(r["seq"], r["payload"]) for r in log.orderBy("seq").collect()] == [(k, f'{{"v":{k % 500}}}') for k in range(510)]
    assert event_log.replay(spark, folder, 3).count() == 3
    with pytest.raises(Exception, match="an event needs an op"):
        event_log.append(spark.createDataFrame([(1, " ", "{}", "t", "1")], events.schema), folder, ["i"], 510)


def test_lines_end_at_the_first_torn_or_misnumbered_one(spark, tmp_path):
    line = lambda n: json.dumps({"op": "turn.add", "payload": {"b": n, "a": [1]}, "schema_version": "1", "seq": n, "ts": "t"})
    cases = {
        "whole": ([line(n) for n in range(40)], 40),
        "torn": ([line(n) for n in range(5)] + [line(5)[:20], line(6)], 5),
        "gap": ([line(0), line(1), line(3), line(2)], 2),
        "blank": ([line(0), "", line(1)], 1),
        "none": ([], 0),
    }
    for name, (lines, kept) in cases.items():
        path = tmp_path / f"{name}.jsonl"
        path.write_text("".join(f"{x}\n" for x in lines))
        found = event_log.read_lines(spark, str(path)).orderBy("seq").collect()
        assert [r["seq"] for r in found] == list(range(kept)), name
        assert all(json.loads(r["payload"]) == {"b": r["seq"], "a": [1]} for r in found)


def test_sessions_are_flattened_and_pinned(spark, tmp_path):
    record = {
        "question_id": "q1", "question_type": "x", "question": "?", "question_date": "2023/05/30 (Tue) 23:40", "answer": "a", "answer_session_ids": ["s2"],
        "haystack_session_ids": ["s1", "s2"], "haystack_dates": ["2023/05/20 (Sat) 02:21", "2023/05/21 (Sun) 14:05"],
        "haystack_sessions": [[{"role": "user", "content": "hi"}], [{"role": "user", "content": "b"}, {"role": "assistant", "content": "c", "has_answer": True}]],
    }
    path = tmp_path / "a.json"
    path.write_text(json.dumps([record]))
    corpus = corpora.read_sessions(spark, str(path), hashlib.sha256(path.read_bytes()).hexdigest())
    turns = corpora.session_turns(corpus, "p").orderBy("turn_id").collect()
    assert [(r["turn_id"], r["ts"], r["text"], r["is_evidence"]) for r in turns] == [
        ("p/q1/s1/0", "2023-05-20T02:21:00Z", "hi", False),
        ("p/q1/s2/0", "2023-05-21T14:05:00Z", "b", False),
        ("p/q1/s2/1", "2023-05-21T14:05:00Z", "c", True),
    ]
    only = spark.createDataFrame([("q1", "s2")], "question_id string, session_id string")
    assert corpora.session_turns(corpus, "p", only).count() == 2
    meta = corpora.question_meta(corpus).first()
    assert (meta["n_sessions"], meta["n_haystack_turns"]) == (2, 3)
    with pytest.raises(ValueError, match="SHA-256"):
        corpora.read_sessions(spark, str(path), "0" * 64)
    path.write_text(json.dumps([{"question_id": "q"}]))
    with pytest.raises(Exception, match="a record has no"):
        corpora.read_sessions(spark, str(path)).collect()


def test_samples_order_sessions_by_number_and_find_their_evidence(spark, tmp_path):
    turn = lambda d, text: {"speaker": "A", "text": text, "dia_id": d}
    talk = {"speaker_a": "A"}
    for n in range(1, 12):
        talk |= {f"session_{n}": [turn(f"D{n}:1", f"t{n}"), turn(f"D{n}:2", " "), turn(f"D{n}:3", "u")], f"session_{n}_date_time": "1:56 pm on 8 May, 2023"}
    qa = [{"question": "?", "answer": 5, "category": 2, "evidence": ["D11:3", "D9:9"]}, {"question": "!", "category": 5, "adversarial_answer": "no", "evidence": []}]
    path = tmp_path / "b.json"
    path.write_text(json.dumps([{"sample_id": "c", "conversation": talk, "qa": qa}]))
    corpus = corpora.read_samples(spark, str(path))
    turns = corpora.sample_turns(corpus)
    found = turns.orderBy("session_no", "turn_id").collect()
    assert [r["session_no"] for r in found] == [n for n in range(1, 12) for _ in range(2)]
    assert {r["ts"] for r in found} == {"2023-05-08T13:56:00Z"}
    questions = corpora.sample_questions(corpus)
    assert [(r["question_id"], r["answer"], r["adversarial_answer"]) for r in questions.orderBy("ix").collect()] == [("c/0", "5", None), ("c/1", None, "no")]
    assert [tuple(r) for r in corpora.evidence_turns(questions, turns).collect()] == [("c/0", "samples/c/session_11/2")]
