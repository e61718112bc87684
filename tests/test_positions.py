"""As-of join against a replay, references against walks, claim pairs against all pairs."""

from __future__ import annotations

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from provenlace.evidence import asof, fold, pairs, references


@pytest.mark.parametrize("block", [7, 65_536])
def test_asof_is_a_replay(spark, block):
    """A hot key, items at the same position, before all and after all changes, null positions and keys."""
    rng = random.Random(3)
    key = lambda: "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", None])
    changes = [(key(), rng.randrange(100), i, *rng.choice([(i, None), (None, f"v{i}"), (i, f"v{i}")])) for i in range(400)]
    items = [(i, key(), rng.choice([None, 0, 50, 50, 99, 200, rng.randrange(120)]), "kept", "gone") for i in range(150)]
    items += [items[3]]
    got = asof.asof(
        spark.createDataFrame(items, "item int, k string, pos int, other string, y string"),
        spark.createDataFrame(changes, "k string, pos int, nr int, x int, y string"), "k", "pos", ["x", "y"], ["nr"], block,
    )
    assert got.columns == ["item", "k", "pos", "other", "x", "y"]
    want = []
    for item, k, pos, other, _ in items:
        x = y = None
        for ck, _, _, cx, cy in sorted((c for c in changes if c[0] is not None and c[0] == k and (pos is None or c[1] < pos)), key=lambda c: (c[1], c[2])):
            x, y = x if cx is None else cx, y if cy is None else cy
        want.append((item, k, pos, other, x, y))
    order = lambda r: str(tuple(r))
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(want, key=order)


def test_asof_equals_the_fold(spark):
    """What an item sees is what the log folded up to its position holds."""
    rng = random.Random(4)
    rows = []
    for seq in range(200):
        i = f"a{rng.randrange(3)}"
        op, p = rng.choice([("assertion.add", {"assertion_id": i, "eligibility": "quarantined", "flags": {"entailed_score": 0.0}}), ("assertion.set_eligibility", {"assertion_id": i, "eligibility": rng.choice(["eligible", "quarantined"])})])
        rows.append((seq, op, json.dumps(p)))
    log = spark.createDataFrame(rows, "seq long, op string, payload string")
    said = F.get_json_object("payload", "$.eligibility")
    changes = log.select(F.get_json_object("payload", "$.assertion_id").alias("k"), "seq", F.when(F.col("op") == "assertion.add", F.col("seq")).alias("added"), said.alias("eligibility"))
    points = [0, 20, 77, 200]
    items = spark.createDataFrame([(f"a{i}", p) for i in range(3) for p in points], "k string, seq long")
    got = {(r.k, r.seq): r.eligibility if r.added is not None else None for r in asof.asof(items, changes, "k", "seq", ["added", "eligibility"], block=16).collect()}
    for p in points:
        state = {r.assertion_id: r.eligibility for r in fold.fold(log, p)["assertion"].collect()}
        assert {k: got[k, p] for k in ("a0", "a1", "a2")} == {k: state.get(k) for k in ("a0", "a1", "a2")}


REF = "question_id string, atom_id string, ref string"


def walks(edges):
    """Least hops from each atom, breadth first."""
    out = {}
    for start in {a for a, _ in edges}:
        seen, front, n = {}, {start}, 0
        while front:
            n += 1
            front = {b for a, b in edges if a in front and b not in seen}
            seen |= dict.fromkeys(front, n)
        out |= {(start, b): h for b, h in seen.items()}
    return out


def test_references_of_random_graphs(spark):
    rng = random.Random(8)
    pools = {f"q{i}": {(str(rng.randrange(9)), str(rng.randrange(12 if i % 2 else 9))) for _ in range(rng.randrange(14))} for i in range(12)}
    rows = [(q, a, b) for q, edges in pools.items() for a, b in edges]
    atoms = [(q, str(i)) for q in pools for i in range(9)]
    ref = spark.createDataFrame([*rows, *rows[:5], ("q0", None, "1"), (None, "1", "2")], REF)
    atom = spark.createDataFrame(atoms, "question_id string, atom_id string")
    want = {(q, a, b): h for q, edges in pools.items() for (a, b), h in walks(edges).items()}
    assert {(r.question_id, r.atom_id, r.ref): r.hops for r in references.closure(ref).collect()} == want
    cyc = {(q, a): min(b for b in map(str, range(12)) if (q, a, b) in want and (q, b, a) in want) for q, a, b in want if a == b}
    assert {(r.question_id, r.atom_id): r.cycle_id for r in references.cycles(ref).collect()} == cyc

    def level(q, a, path=()):
        if a in path:
            return None
        below = [level(q, b, (*path, a)) for x, b in pools[q] if x == a and int(b) < 9]
        return None if None in below else 1 + max(below, default=-1)

    got = {(r.question_id, r.atom_id): r.level for r in references.levels(atom, ref).collect()}
    assert got == {(q, a): level(q, a) for q, a in atoms}
    found = {(r.question_id, r.problem, r.atom_id, r.detail) for r in references.problems(atom, ref, 8).collect() if r.question_id and r.atom_id != "none"}
    inner = {q: {e for e in edges if int(e[1]) < 9} for q, edges in pools.items()}
    turning = {(q, a) for q, edges in inner.items() for (a, b) in walks(edges) if a == b}
    assert {f[:3] for f in found if f[1] == "cycle"} == {(q, "cycle", a) for q, a in turning}
    assert {f for f in found if f[1] == "missing" and f[2]} == {(q, "missing", a, b) for q, edges in pools.items() for a, b in edges if int(b) >= 9}
    assert {f[0] for f in found if f[1] == "over_cap"} == set(pools)


def test_a_long_chain_and_a_long_ring(spark):
    chain = [("q", f"{i:04d}", f"{i - 1:04d}") for i in range(1, 1001)]
    ring = [("r", f"{i:03d}", f"{(i + 1) % 60:03d}") for i in range(60)] + [("r", "x", "000")]
    ref = spark.createDataFrame([*chain, *ring], REF)
    reached = references.closure(ref)
    assert reached.filter("question_id = 'q'").count() == 1000 * 1001 // 2
    assert reached.filter("question_id = 'q' AND atom_id = '1000' AND ref = '0000'").first().hops == 1000
    assert {(r.cycle_id, r.question_id) for r in references.cycles(ref).collect()} == {("000", "r")}
    atom = spark.createDataFrame([("q", f"{i:04d}") for i in range(1001)] + [("r", "x")] + [("r", f"{i:03d}") for i in range(60)], "question_id string, atom_id string")
    got = {r.atom_id: r.level for r in references.levels(atom, ref).collect()}
    assert all(got[f"{i:04d}"] == i for i in range(1001)) and got["x"] is None
    assert references.closure(spark.createDataFrame([], REF)).count() == 0


@pytest.mark.parametrize("k", [1, 5, 50, 10_000])
def test_best_pairs_are_the_best_of_all(spark, k):
    """Near copies, a token that nearly all claims have, claims of frequent tokens only, few and many sessions."""
    rng = random.Random(k)
    claims = []
    for q, n in (("big", 90), ("small", 4), ("one", 1), ("single session", 30)):
        base = [f"w{rng.randrange(60)}" for _ in range(8)]
        for i in range(n):
            tokens = {f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 9))} if rng.random() < 0.7 else set(base[: rng.randrange(5, 9)])
            if rng.random() < 0.8:
                tokens.add("the")
            session = None if q == "single session" else rng.choice(["s1", "s2", None])
            claims.append((q, f"{q}{i:03d}", session, sorted(tokens) if rng.random() > 0.05 else []))
    want = {}
    for q in {c[0] for c in claims}:
        mine = [c for c in claims if c[0] == q and c[3]]
        scored = [(a[2] != b[2], len({*a[3]} & {*b[3]}) / len({*a[3]} | {*b[3]}), a[1], b[1]) for a, b in itertools.combinations(mine, 2)]
        ranked = sorted((s for s in scored if s[1] > 0), key=lambda s: (not s[0], -s[1], s[2], s[3]))[:k]
        want |= {(q, i + 1): (s[2], s[3], s[0], round(s[1], 9)) for i, s in enumerate(ranked)}
    df = spark.createDataFrame(claims, "question_id string, claim_id string, session_id string, tokens array<string>")
    got = {(r.question_id, r["rank"]): (r.a, r.b, r.cross_session, round(r.overlap, 9)) for r in pairs.best_pairs(df, k).collect()}
    assert got == want
    assert pairs.best_pairs(df.limit(0)).count() == 0


def test_references_meet_once_and_make_no_pairs(spark):
    """A chain of 4,000 references has eight million pairs; levels, cycles and problems make none of them."""
    n = 4000
    atom = spark.createDataFrame([("q", f"{i:05}") for i in range(n)], "question_id string, atom_id string")
    ref = spark.createDataFrame([("q", f"{i:05}", f"{i - 1:05}") for i in range(1, n)] + [("q", "00000", "nowhere")], REF)
    made = references.levels(atom, ref)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {int(r.atom_id): r.level for r in made.collect()} == {i: i for i in range(n)}
    assert references.cycles(ref).count() == 0
    assert [tuple(r) for r in references.problems(atom, ref, n).collect()] == [("q", "missing", "00000", "nowhere")]
    ring = ref.replace("nowhere", f"{n - 1:05}", "ref")
    assert references.cycles(ring).filter("cycle_id = '00000'").count() == n
    assert references.levels(atom, ring).filter("level IS NULL").count() == n


def test_problems_of_null_ids(spark):
    atom = spark.createDataFrame([("q", "a"), ("q", None), (None, "a")], "question_id string, atom_id string")
    ref = spark.createDataFrame([("q", "a", None), (None, "a", "a"), ("q", None, "a")], REF)
    found = {tuple(r) for r in references.problems(atom, ref, 1).collect()}
    assert found == {("q", "missing", "a", None), (None, "missing", "a", "a"), ("q", "over_cap", None, "2")}
