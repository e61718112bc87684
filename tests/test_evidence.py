"""Folds, set checks and commit checks against row-by-row references and hand-made rows in which each rule fires."""

from __future__ import annotations

import json
import random

import pytest

from provenlace.evidence import checks, commits, fold

LOG = "seq long, op string, payload string"


def replay(rows):
    """The same state, one operation after the other."""
    node, edge, assertion = {}, {}, {}
    for _, op, text in sorted(rows):
        p = json.loads(text)
        if op == "node.add":
            node[p["node_id"]] = p["ntype"]
        elif op == "edge.add":
            edge[p["edge_id"]] = [p["src"], p.get("t_invalid"), p.get("superseded_by")]
        elif op == "edge.invalidate" and p["edge_id"] in edge:
            edge[p["edge_id"]][1:] = [p["t_invalid"], p.get("superseded_by")]
        elif op == "assertion.add":
            assertion[p["assertion_id"]] = {"eligibility": p["eligibility"], **p["flags"]}
        elif op in ("assertion.set_flags", "assertion.set_eligibility") and p["assertion_id"] in assertion:
            assertion[p["assertion_id"]].update({k: v for k, v in p.items() if k != "assertion_id"})
    return node, edge, assertion


def random_log(n, seed):
    rng, rows = random.Random(seed), []
    for seq in range(n):
        key = f"k{rng.randrange(12)}"
        op, p = rng.choice([
            ("node.add", {"node_id": key, "ntype": rng.choice(["Claim", "Entity"])}),
            ("edge.add", {"edge_id": key, "src": f"s{seq}", "etype": "about_entity"}),
            ("edge.invalidate", {"edge_id": key, "t_invalid": f"t{seq}", **({"superseded_by": f"e{seq}"} if seq % 2 else {})}),
            ("assertion.add", {"assertion_id": key, "eligibility": "quarantined", "flags": {"asserted_by": f"a{seq}", "entailed_score": 0.0, "externally_verified": False}}),
            ("assertion.set_flags", {"assertion_id": key, **rng.choice([{"entailed_score": seq / 7}, {"externally_verified": True}, {"asserted_by": f"b{seq}"}])}),
            ("assertion.set_eligibility", {"assertion_id": key, "eligibility": rng.choice(["eligible", "quarantined"])}),
            ("ledger.checkpoint", {"x": 1}),
        ])
        rows.append((seq, op, json.dumps(p)))
    return rows


@pytest.mark.parametrize("upto", [0, 60, 400])
def test_fold_is_a_replay(spark, upto):
    rows = random_log(400, 7)
    node, edge, assertion = replay(rows[:upto])
    state = fold.fold(spark.createDataFrame(random.Random(1).sample(rows, len(rows)), LOG), upto)
    assert {r.node_id: r.ntype for r in state["node"].collect()} == node
    assert {r.edge_id: [r.src, r.t_invalid, r.superseded_by] for r in state["edge"].collect()} == edge
    got = {r.assertion_id: {k: r[k] for k in ("eligibility", "asserted_by", "entailed_score", "externally_verified")} for r in state["assertion"].collect()}
    assert got == assertion
    counted = fold.counts(state).first()
    assert counted.live_edges == sum(e[1] is None for e in edge.values()) and counted.nodes == len(node)
    assert counted.eligible_assertions == sum(a["eligibility"] == "eligible" for a in assertion.values())


def test_digest_and_changes(spark):
    rows = random_log(300, 9)
    one, two = (fold.fold(spark.createDataFrame(random.Random(s).sample(rows, len(rows)), LOG)) for s in (1, 2))
    short = fold.fold(spark.createDataFrame(rows, LOG), 100)
    assert fold.digest(one).first().digest == fold.digest(two).first().digest != fold.digest(short).first().digest
    before, after = replay(rows[:100])[1], replay(rows)[1]
    live = lambda s, k: k in s and s[k][1] is None
    want = {(k, live(before, k), live(after, k)) for k in before | after if live(before, k) != live(after, k)}
    assert {tuple(r) for r in fold.liveness_changes(short, one).collect()} == want


def frames(spark, schemas, rows):
    return {k: spark.createDataFrame(rows.get(k, []), s) for k, s in schemas.items()}


SETS = {
    "sets": "set_id string, question_id string", "member": "set_id string, atom_id string",
    "atom": "question_id string, atom_id string, kind string, target string, label string", "ref": "question_id string, atom_id string, ref string",
    "question": "question_id string, constrained boolean, lo double, hi double", "scope": "question_id string, conv_id string",
    "node": "node_id string, ntype string, assertion_id string, lo double, hi double",
    "edge": "edge_id string, etype string, src string, dst string, t_created string, t_invalid string, superseded_by string",
    "provenance": "edge_id string, span_id string", "assertion": "assertion_id string, eligibility string",
    "assertion_span": "assertion_id string, span_id string", "span": "span_id string, turn_id string", "turn": "turn_id string, conv_id string",
}
GRAPH = {
    "node": [("c1", "Claim", "a1", None, None), ("c2", "Value", "a2", None, None), ("c3", "Event", None, None, None), ("c4", "Claim", "lost", None, None),
             ("x1", "Entity", None, None, None), ("t1", "TimeInterval", None, 0.0, 10.0), ("t2", "TimeInterval", None, 20.0, None), ("c5", "Claim", "a5", None, None)],
    "edge": [("e1", "about_entity", "c1", "x1", "2024-01-02", None, None), ("e2", "about_entity", "c1", "x1", "2024-01-02", "2024-01-05", "e1"),
             ("e3", "about_entity", "c1", "x1", "2024-01-09", "2024-01-10", "e1"), ("e4", "about_entity", "c1", "x1", "2024-01-01", "2024-01-10", "nowhere"),
             ("v1", "valid_during", "c1", "t1", "2024-01-02", None, None), ("e5", "about_entity", "c2", "x1", "2024-01-01", None, None)],
    "provenance": [("e1", "s1"), ("e2", "s1"), ("e3", "s1"), ("e4", "s1"), ("v1", "s1"), ("e5", "gone")],
    "assertion": [("a1", "eligible"), ("a2", "quarantined"), ("a5", "eligible")],
    "assertion_span": [("a1", "s1"), ("a2", "s1"), ("a5", "s2")],
    "span": [("s1", "u1"), ("s2", "u2")], "turn": [("u1", "conv1"), ("u2", "conv2")],
    "question": [("q", False, None, None), ("qt", True, 12.0, 15.0), ("qi", True, 5.0, None), ("qs", False, None, None)],
    "scope": [("qs", "conv1")],
}
ATOMS = [
    ("n1", "node", "c1", None, []), ("n1b", "node", "c1", None, []), ("x1", "node", "x1", None, []), ("e1", "edge", "e1", "about_entity", ["n1", "x1"]),
    ("n2", "node", "c2", None, []), ("n3", "node", "c3", None, []), ("n4", "node", "c4", None, []), ("n5", "node", "c5", None, []),
    ("e2", "edge", "e2", "about_entity", []), ("e3", "edge", "e3", "about_entity", []), ("e4", "edge", "e4", "about_entity", []), ("e5", "edge", "e5", "about_entity", []),
    ("none", "node", "nothing", None, []), ("b1", "binding", None, "answer", ["n1"]), ("b2", "binding", None, "answer", ["n5"]), ("lost", "binding", None, "who", ["absent"]),
    *[(f"f{i}", "node", "x1", f"label {i}", []) for i in range(17)],
]
CASES = [
    ("q", [], {("H1", None)}),
    ("q", [f"f{i}" for i in range(17)], {("H1", None)}),
    ("q", [f"f{i}" for i in range(16)], set()),
    ("q", ["n1", "x1", "e1", "b1"], set()),
    ("q", ["none", "unheard"], {("H2", "none"), ("H2", "unheard")}),
    ("q", ["n1", "e1"], {("H3", "e1")}),
    ("q", ["n1", "n1b"], {("H4", "n1b")}),
    ("q", ["n1", "n5", "b1", "b2"], {("H5", "b1")}),
    ("q", ["e2"], {("H6", "e2"), ("H8", "e2")} - {("H8", "e2")}),
    ("q", ["e3", "e4"], {("H6", "e3"), ("H6", "e4"), ("H8", "e3"), ("H8", "e4")}),
    ("q", ["n2", "n3", "n4", "e5"], {("H7", "n2"), ("H7", "n3"), ("H7", "n4"), ("H7", "e5")}),
    ("qt", ["n1", "b1"], {("H8", "b1")}),
    ("qi", ["n1", "b1"], set()),
    ("qt", ["n5", "b2"], set()),
    ("qs", ["n1", "x1", "e1", "b1"], set()),
    ("qs", ["n5", "b2"], {("H9", "n5"), ("H9", "b2")}),
    ("qs", ["e5", "n4"], {("H7", "e5"), ("H9", "e5"), ("H7", "n4"), ("H9", "n4")}),
    ("q", ["lost"], {("H3", "lost")}),
    ("qs", ["lost"], {("H3", "lost"), ("H9", "lost")}),
]


def test_set_checks(spark):
    rows = dict(GRAPH)
    questions = [r[0] for r in GRAPH["question"]]
    rows["atom"] = [(q, a, kind, target, label) for q in questions for a, kind, target, label, _ in ATOMS]
    rows["ref"] = [(q, a, r) for q in questions for a, *_, refs in ATOMS for r in refs]
    rows["sets"] = [(str(i), q) for i, (q, _, _) in enumerate(CASES)]
    rows["member"] = [(str(i), a) for i, (_, atoms, _) in enumerate(CASES) for a in atoms]
    tables = frames(spark, SETS, rows)
    got = {}
    for r in checks.violations(tables).collect():
        got.setdefault(r.set_id, set()).add((r.code, r.atom_id))
    for i, (_, _, want) in enumerate(CASES):
        assert got.get(str(i), set()) == want, CASES[i]
    counts = {r.code: r.findings for r in checks.tally(tables).collect()}
    assert counts == {c: sum(code == c for _, _, w in CASES for code, _ in w) for c in checks.CODES}
    assert checks.violations(frames(spark, SETS, {})).count() == 0


COMMITS = {
    "new_node": "commit_id string, pos int, node_id string, ntype string, payload string, aliases array<string>, assertion_id string, lo double, hi double",
    "new_edge": "commit_id string, pos int, edge_id string, etype string, src string, dst string, t_created string, t_invalid string, superseded_by string",
    "new_provenance": "commit_id string, edge_id string, span_id string", "gone": "commit_id string, edge_id string, t_invalid string, superseded_by string",
    "node": "node_id string, ntype string, payload string, aliases array<string>, assertion_id string, lo double, hi double",
    "edge": "edge_id string, etype string, src string, dst string, t_created string, t_invalid string, superseded_by string",
    "span": "span_id string", "assertion": "assertion_id string, eligibility string",
}


def test_commit_checks(spark):
    node = lambda c, p, n, t, a=None, payload="p", aliases=None, lo=None, hi=None: (c, p, n, t, payload, aliases, a, lo, hi)
    edge = lambda c, p, e, t, s, d, at="2024-02-01", gone=None, by=None: (c, p, e, t, s, d, at, gone, by)
    rows = {
        "node": [("c1", "Claim", "p", None, "a1", None, None), ("x1", "Entity", "p", ["one"], None, None, None), ("t0", "TimeInterval", "p", None, None, 5.0, 5.0)],
        "edge": [("e1", "about_entity", "c1", "x1", "2024-01-01", None, None), ("e9", "about_entity", "c1", "x1", "2023-01-01", "2023-02-01", None)],
        "span": [("s1",)], "assertion": [("a1", "eligible"), ("a2", "eligible"), ("a3", "quarantined")],
        "new_node": [
            node("ok", 0, "c2", "Claim", "a2"), node("ok", 1, "x1", "Entity", aliases=["one", "two"]),
            node("id", 0, "x1", "Entity", aliases=["two"]), node("id", 1, "c1", "Claim", "a1", payload="other"), node("id", 2, "c7", "Value", "a1"),
            node("twice", 0, "n", "Entity", payload="p"), node("twice", 1, "n", "Entity", payload="q"), node("twice", 2, "c8", "Claim", "a2"), node("twice", 3, "c9", "Value", "a2"),
            node("quarantined", 0, "c3", "Claim", "a3"), node("quarantined", 1, "c4", "Event"), node("quarantined", 2, "x2", "Entity"),
        ],
        "new_edge": [
            edge("ok", 0, "e2", "about_entity", "c2", "x1"), edge("ok", 1, "e3", "about_entity", "c1", "x1", by=None),
            edge("ends", 0, "f1", "about_entity", "x1", "c1"), edge("ends", 1, "f2", "invented", "c1", "x1"), edge("ends", 2, "f3", "about_entity", "c1", "unknown"),
            edge("id", 0, "e1", "about_entity", "c1", "x1", at="2024-01-09"),
            edge("times", 0, "g1", "same_as", "x1", "x1", at="2024-02-02", gone="2024-02-02"), edge("times", 1, "g2", "valid_during", "c1", "t0"),
            edge("double", 0, "h1", "about_entity", "c1", "x1"), edge("double", 1, "h2", "about_entity", "c1", "x1"),
        ],
        "new_provenance": [("ok", "e2", "s1"), ("lost", "e5", "s1"), ("lost", "e5", "s2")],
        "gone": [("ok", "e1", "2024-02-01", "e3"), ("times", "e1", "2024-01-01", None), ("times", "none", "2024-01-01", None), ("next", "e1", "2024-03-01", "nowhere")],
    }
    want = {
        ("ends", "V1", "f1"), ("ends", "V1", "f2"), ("ends", "V1", "f3"),
        ("id", "V2", "x1"), ("id", "V2", "c1"), ("id", "V2", "c7"), ("id", "V2", "e1"), ("twice", "V2", "n"), ("twice", "V2", "c9"),
        ("lost", "V3", "e5"), ("quarantined", "V4", "c3"), ("quarantined", "V4", "c4"),
        ("times", "V5", "g1"), ("times", "V5", "g2"), ("times", "V5", "e1"), ("times", "V5", "none"),
        ("times", "V6", "g1"), ("double", "V6", "h1"), ("double", "V6", "h2"), ("next", "V7", "e1"),
    }
    tables = frames(spark, COMMITS, rows)
    got = {tuple(r) for r in commits.violations(tables).collect()}
    assert got == want
    assert {r.code: r.findings for r in commits.tally(tables).collect()} == {c: sum(code == c for _, code, _ in want) for c in commits.CODES}
    assert commits.violations(frames(spark, COMMITS, {})).count() == 0


def test_checks_do_not_derive_their_tables_again(spark):
    """What the nine checks share is written once: their plan reads no file, and its exchanges are few."""
    from provenlace import catalog

    told = catalog.QUERIES["check_h_violations"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" not in told and told.count("Exchange ") <= 50


def test_nodes_without_assertion_stay_apart(spark):
    """Nodes that name no assertion do not meet in one task."""
    node = spark.createDataFrame([(f"n{i}", "Entity", None, None, None) for i in range(800)] + [("c", "Claim", "a", None, None)], SETS["node"]).repartition(4)
    assertion = spark.createDataFrame([("a", "eligible")], SETS["assertion"])
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        parts = checks._lookup(node, assertion).rdd.glom().map(len).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert sum(parts) == 801 and max(parts) <= 400


def test_single_checks_write_what_they_ask_for(spark, monkeypatch):
    writes, real = [], checks.cut
    monkeypatch.setattr(checks, "cut", lambda df: writes.append(df) or real(df))
    tables = frames(spark, SETS, {})
    for code, many in (("H2", 2), ("H4", 2), ("H5", 1), ("H9", 3)):
        writes.clear()
        checks.violations(tables, codes=(code,))
        assert len(writes) == many, code


def test_commits_beside_several_live_edges(spark):
    """All live edges of the same type and ends have to be invalidated; an edge that stands twice in a commit is one."""
    edge = lambda c, p, e: (c, p, e, "about_entity", "c1", "x1", "2024-02-01", None, None)
    rows = {
        "edge": [(e, "about_entity", "c1", "x1", "2024-01-01", None, None) for e in ("e1", "e2")],
        "new_edge": [edge("one", 0, "h"), edge("both", 0, "h"), edge("none", 0, "h"), edge("own", 0, "e1"), edge("both", 1, "h"), edge("more", 0, "h"), edge("more", 1, "i")],
        "gone": [(c, e, "2024-02-01", None) for c, e in (("one", "e1"), ("both", "e1"), ("both", "e2"), ("own", "e2"), ("more", "e1"), ("more", "e2"))],
    }
    got = {tuple(r) for r in commits.violations(frames(spark, COMMITS, rows), codes=("V6",)).collect()}
    assert got == {("one", "V6", "h"), ("none", "V6", "h"), ("more", "V6", "i")}


def test_commit_checks_shuffle_edges_few_times(spark):
    """No table of the batch joins edges with turns again, and the ends of edges are looked up once for V1 and V5."""
    from provenlace import catalog

    told = catalog.QUERIES["commit_validate_violations"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert told.count("Exchange ") <= 30
