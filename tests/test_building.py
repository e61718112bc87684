"""The graph built from decisions in order, against a replay one by one, over micro-batches and restarts."""

from __future__ import annotations

import hashlib
import json
import random
import tempfile

import pytest

from provenlace.evidence import fold
from provenlace.evidence.commits import ENDPOINTS
from provenlace.streaming import building

COLUMNS = [f.split()[0] for f in building.PROPOSAL.split(", ")]


def sha(*parts):
    return hashlib.sha256("\x1f".join(str(p) for p in parts).encode()).hexdigest()[:16]


class Replay:
    """All of a conversation's graph in plain dictionaries, scanned whole for every rule."""

    def __init__(self):
        self.node, self.edge, self.held, self.rows = {}, {}, [], []

    def say(self, p, accepted, floor=False, checks="", n=1):
        self.rows.append((p["conv_id"], p["seq"], p["action"], accepted, floor, checks, n))

    def take(self, p, only_link=False):
        a = p["action"]
        ent = lambda name: sha("Entity", p["conv_id"], " ".join(name.lower().split()))
        if a == "defer":
            if ent(p["name"]) not in self.node:
                self.held.append(p)
                return self.say(p, False, checks="parked")
            p = {**p, "action": "link", "entity_id": ent(p["name"])}
            a = "link"
        if a in ("relation", "valid_during") and p["confidence"] is not None and p["confidence"] < 0.5:
            return self.say(p, False, floor=True)
        nodes, edges, gone = [], [], []
        if a in ("link", "create"):
            ntype = {"claim": "Claim", "value": "Value", "event": "Event", "time": "Claim"}.get(p["kind"], "Claim")
            me = dict(id=sha(ntype, p["assertion_id"]), ntype=ntype, body=p["assertion_id"], aliases=set())
            target = p["entity_id"] if a == "link" else ent(p["name"])
            if a == "create":
                plain = " ".join(p["name"].lower().split())
                old = self.node.get(target, {"aliases": set()})
                nodes.append(dict(id=target, ntype="Entity", body=plain, aliases=old["aliases"] | ({p["name"]} - {plain})))
            nodes.append(me)
            edges.append(("about_entity", me["id"], target))
        elif a == "supersede":
            edges.append(("supersedes", p["src"], p["dst"]))
            gone = [i for i, e in self.edge.items() if not e["dead"] and p["dst"] in e["ends"][1:] and e["ends"][0] not in ("supersedes", "contradicts")]
        elif a == "contradict":
            edges.append(("contradicts", p["src"], p["dst"]))
        elif a == "relation":
            edges.append((p["etype"], p["src"], p["dst"]))
        elif a == "valid_during":
            i = sha("TimeInterval", p["lo"], p["hi"])
            nodes.append(dict(id=i, ntype="TimeInterval", body=(p["lo"], p["hi"]), aliases=set()))
            edges.append(("valid_during", p["src"], i))
        elif a == "alias" and self.node.get(p["entity_id"], {}).get("ntype") == "Entity":
            old = self.node[p["entity_id"]]
            nodes.append({**old, "aliases": old["aliases"] | {s for s in p["surfaces"] or [] if s and s != old["body"]}})
        else:
            return self.say(p, False, checks="unknown")
        bad = self.judge(p, nodes, edges, gone)
        if bad:
            return self.say(p, False, checks=",".join(sorted(bad)))
        for n in nodes:
            self.node[n["id"]] = n
        for e in edges:
            self.edge[sha("edge", *e)] = dict(ends=e, t=p["t"], spans=p["spans"], dead=None)
        for i in gone:
            self.edge[i]["dead"] = p["t"]
        self.say(p, True, n=len(nodes) + len(edges) + len(gone))
        if a == "create":
            mine = [q for q in self.held if " ".join(q["name"].lower().split()) == " ".join(p["name"].lower().split())]
            self.held = [q for q in self.held if q not in mine]
            for q in mine:
                self.take({**q, "action": "link", "entity_id": ent(q["name"])})

    def judge(self, p, nodes, edges, gone):
        bad = set()
        types = {i: n["ntype"] for i, n in self.node.items()} | {n["id"]: n["ntype"] for n in nodes}
        for e in edges:
            if e[0] not in ENDPOINTS or any(types.get(x) not in side.split() for x, side in zip(e[1:], ENDPOINTS[e[0]], strict=True)):
                bad.add("V1")
            old = self.edge.get(sha("edge", *e))
            if old and (old["dead"] or old["t"] != p["t"] or old["spans"] != p["spans"]):
                bad.add("V2")
            if e[0] == "valid_during" and p["lo"] is not None and p["hi"] is not None and p["hi"] <= p["lo"]:
                bad.add("V5")
            if e[0] in ("same_as", "contradicts", "supersedes") and e[1] == e[2]:
                bad.add("V6")
        for n in nodes:
            if n["ntype"] in ("Claim", "Value", "Event"):
                if any(o["body"] == n["body"] and o["ntype"] in ("Claim", "Value", "Event") and o["id"] != n["id"] for o in self.node.values()):
                    bad.add("V2")
                if not p["eligible"]:
                    bad.add("V4")
        if edges and (not p["spans"] or p["unknown_spans"]):
            bad.add("V3")
        if any(p["t"] <= self.edge[i]["t"] for i in gone):
            bad.add("V5")
        return bad


def random_decisions(n, seed):
    rng, rows, names = random.Random(seed), [], ["My Car", "my car", "Fitbit", "the  fitbit", "Rex"]
    for seq in range(n):
        conv = rng.choice(["c1", "c1", "c2", "c3"])
        kind = rng.choice(["claim", "claim", "value", "event", "time"])
        some = lambda: sha({"claim": "Claim", "time": "Claim"}.get(k := rng.choice(["claim", "value", "event"]), k.capitalize()), f"{conv}-a{rng.randrange(8)}")  # noqa: E731, B023
        ent = sha("Entity", conv, " ".join(rng.choice(names).lower().split()))
        p = dict.fromkeys(COLUMNS) | {
            "conv_id": conv, "seq": seq, "action": rng.choice("link create create supersede contradict alias relation valid_during valid_during defer defer nonsense".split()),
            "assertion_id": f"{conv}-a{rng.randrange(8)}", "kind": kind, "name": rng.choice(names), "entity_id": ent,
            "etype": rng.choice(["has_value", "same_as", "asserted_by", "made up"]), "src": some(), "dst": some(), "lo": rng.choice([None, 1.0, 5.0]), "hi": rng.choice([None, 5.0, 9.0]),
            "surfaces": rng.choice([None, [], ["auto", "", "rex"]]), "confidence": rng.choice([None, 0.2, 0.5, 0.9]), "t": f"{1000 + seq - rng.choice([0, 0, 0, 300])}",
            "spans": rng.choice([["s1"], ["s1", "s2"], [], None]) if rng.random() < 0.15 else ["s1"], "eligible": rng.random() < 0.93, "unknown_spans": int(rng.random() < 0.06),
        }
        if p["action"] == "relation" and rng.random() < 0.6:
            p["src"] = ent
        rows.append(p)
    return rows


def told(outcomes):
    got = {}
    for r in outcomes.collect():
        key = (r.conv_id, r.decided_at, r.seq, r.action, r.accepted, r.below_floor, r.checks)
        got[key] = got.get(key, 0) + 1
    return sorted((k[0], k[2], k[3], k[4], k[5], k[6], n) for k, n in got.items())


def expected(rows):
    replays = {}
    for p in sorted(rows, key=lambda p: p["seq"]):
        replays.setdefault(p["conv_id"], Replay()).take(p)
    return replays


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], building.PROPOSAL)


@pytest.mark.parametrize("pieces", [1, 5])
def test_building_is_a_replay(spark, pieces):
    """In one micro-batch, or file by file with a restart in between and rows delivered again."""
    rows, folder = random_decisions(300, 5), tempfile.mkdtemp(prefix="provenlace-")
    replays = expected(rows)
    cut = [rows[i * len(rows) // pieces : (i + 1) * len(rows) // pieces] for i in range(pieces)]
    for i, part in enumerate(cut):
        again = cut[i - 1][-7:] if i else []
        frame(spark, [*part, *again]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if i in (pieces // 2, pieces - 1):  # the others wait and are taken file by file
            out = building.build(spark, f"{folder}/in", f"{folder}/out", f"{folder}/marks", files_a_batch=1)
    want = sorted(r for x in replays.values() for r in x.rows)
    assert told(out) == want
    counted = {r.measure: r.n for r in building.report(out).collect()}
    assert {k for *_, k, _ in want} >= {"V1", "V4", "parked", "unknown"} and counted["accepted"] > 50
    assert counted["attempted"] == counted["accepted"] + counted["refused"]
    assert counted["attempted"] + counted["below_floor"] + counted["parked"] == 300
    state = fold.fold(building.log_of(out))
    edges = {i: (e["dead"], e["ends"][1]) for x in replays.values() for i, e in x.edge.items()}
    assert {r.edge_id: (r.t_invalid, r.src) for r in state["edge"].collect()} == edges
    assert {r.node_id for r in state["node"].collect()} == {i for x in replays.values() for i in x.node}
    assert {r.property: r.failures for r in building.audit(out).collect()} == {"a_effective": 0, "b_history": 0, "c_no_collateral": 0}
    again = building.build(spark, f"{folder}/in", f"{folder}/out", f"{folder}/marks")
    assert told(again) == want


def test_audit_finds_what_is_wrong(spark):
    op = lambda seq, pos, kind, edge, successor=None: ("c", seq, seq, "x", True, False, "", pos, kind, json.dumps({"edge_id": edge, "superseded_by": successor}))
    rows = [
        op(1, 0, "edge.add", "a"), op(2, 0, "edge.add", "b"), op(2, 1, "edge.invalidate", "a", "b"),  # in order
        op(3, 0, "edge.invalidate", "a", "nobody"),  # was not live; its successor is not there
        op(4, 0, "edge.add", "d"), op(4, 1, "edge.invalidate", "d"),  # comes and goes in one step
    ]
    found = {r.property: r.failures for r in building.audit(spark.createDataFrame(rows, building.OUTCOME)).collect()}
    assert found == {"a_effective": 1, "b_history": 1, "c_no_collateral": 1}


def test_prepared_counts_unknown_spans(spark):
    rows = [dict.fromkeys(COLUMNS) | {"conv_id": "c", "seq": i, "action": "link", "assertion_id": a, "spans": s} for i, (a, s) in enumerate([("a1", ["s1"]), ("a2", ["s1", "zz", "yy"]), (None, None)])]
    got = building.prepared(
        frame(spark, rows).drop("eligible", "unknown_spans"),
        spark.createDataFrame([("a1", "eligible"), ("a2", "quarantined")], "assertion_id string, eligibility string"), spark.createDataFrame([("s1",)], "span_id string"),
    ).collect()
    assert sorted((r.seq, r.eligible, r.unknown_spans) for r in got) == [(0, True, 0), (1, False, 2), (2, False, 0)]


def test_state_is_read_and_written_once_a_call():
    """A new conversation reads nothing; what changes often is written once; what a call removes is gone for the next."""
    stored, trips = {}, []

    class State:
        def __getattr__(self, name):
            act = {"containsKey": lambda k: k in stored, "getValue": stored.get, "updateValue": stored.__setitem__, "removeKey": stored.pop}[name]
            return lambda *a: (trips.append(name), act(*a))[1]

    held = building.Held(State())
    held.begin(True)
    assert not held.containsKey(("a",)) and held.getValue(("b",)) is None
    for i in range(5):
        held.updateValue(("a",), (str(i),))
    held.updateValue(("b",), ("x",))
    held.updateValue(("c",), ("y",))
    held.removeKey(("c",))
    assert held.getValue(("a",)) == ("4",) and not held.containsKey(("c",)) and not trips
    held.end()
    assert stored == {("a",): ("4",), ("b",): ("x",)} and trips == ["updateValue"] * 2
    held.begin(False)
    trips.clear()
    assert held.getValue(("a",)) == held.getValue(("a",)) == ("4",) and trips == ["containsKey", "getValue"]
    held.removeKey(("a",))
    held.end()
    assert stored == {("b",): ("x",)}
