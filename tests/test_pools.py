"""Pools, reader, anchors, intervals, samples and vector search on hand-made rows and against plain references."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from provenlace.evidence import pools, reader
from provenlace.functions import anchors, intervals
from provenlace.operators import pooling, sampling, vectors

NODE = "node_id string, ntype string, assertion_id string, lo double, hi double"
EDGE = "edge_id string, etype string, src string, dst string, t_invalid double"


@pytest.fixture(scope="module")
def graph(spark):
    node = spark.createDataFrame([
        ("c1", "Claim", "a1", None, None), ("c2", "Claim", None, None, None), ("e1", "Entity", None, None, None),
        ("t1", "TimeInterval", None, 1.0, 5.0), ("t2", "TimeInterval", None, 9.0, 2.0), ("t3", "TimeInterval", None, None, None), ("t4", "TimeInterval", None, None, 3.0),
    ], NODE)
    edge = spark.createDataFrame([
        ("x1", "about_entity", "c1", "e1", None), ("x2", "about_entity", "c1", "e1", None), ("x3", "about_entity", "c2", "e1", 7.0),
        ("x4", "valid_during", "c1", "t1", None), ("x5", "valid_during", "c1", "t2", None), ("x6", "valid_during", "c1", "t3", None), ("x7", "valid_during", "c1", "t4", None),
        ("x8", "supports", "c2", "c1", None), ("x9", "about_entity", "c1", "c2", None), ("xa", "valid_during", "c2", "t1", 4.0), ("xb", "supports", "c1", "e1", None),
    ], EDGE)
    return node, edge


def test_companions_are_structural_and_live(graph):
    got = {tuple(r) for r in pools.companions(*graph).collect()}
    assert got == {("c1", "e1"), ("c1", "t1"), ("c1", "t2"), ("c1", "t3"), ("c1", "t4")}


def test_intervals_skip_what_is_no_interval(graph):
    assert {tuple(r) for r in pools.intervals_of(*graph).collect()} == {("c1", 1.0, 5.0), ("c1", None, 3.0)}


def test_pool_atoms_links_and_wrong_ends(spark, graph):
    chosen = spark.createDataFrame([("q", "c1"), ("q", "c1"), ("q", "c2"), ("q", "e1"), ("q", "ghost"), ("r", "c1"), ("r", None), (None, "c1")], "question_id string, node_id string")
    atoms = pools.materialise(chosen, *graph).cache()
    rows = atoms.collect()
    assert sorted((r["question_id"], r["target"]) for r in rows if r["kind"] == "node") == [("q", "c1"), ("q", "c2"), ("q", "e1"), ("q", "ghost"), ("r", "c1")]
    assert sorted((r["question_id"], r["target"]) for r in rows if r["kind"] == "edge") == [("q", "x1"), ("q", "x2"), ("q", "x8"), ("q", "x9"), ("q", "xb")]
    assert len({r["atom_id"] for r in rows if r["question_id"] == "q"}) == 9
    assert pools.edge_ref_problems(atoms, graph[1]).count() == 0
    turned = atoms.withColumn("ref_src", F.when(F.col("target") == "x8", F.col("ref_dst")).otherwise(F.col("ref_src")))
    turned = turned.withColumn("target", F.when(F.col("target") == "x9", "gone").otherwise(F.col("target")))
    assert sorted(r["problem"] for r in pools.edge_ref_problems(turned, graph[1]).collect()) == ["other ends", "unknown edge"]
    links = pools.adjacency(atoms)
    assert links.count() == 30
    assert links.filter("relation = 'rev_supports'").count() == 2
    assert pools.adjacency(atoms.filter("target <> 'c2'")).filter("relation = 'incident'").count() == 16
    bad = atoms.filter("target = 'x1'").select("question_id", "atom_id")
    assert pools.admissible(atoms, bad).count() == atoms.count() - 1
    assert pools.materialise(chosen.limit(0), *graph).count() == 0


def test_first_span_that_is_known_tells_the_conversation(spark):
    of = spark.createDataFrame([("a", 0, "torn"), ("a", 1, "s1"), ("a", 2, "s2"), ("b", 0, "torn")], "assertion_id string, pos int, span_id string")
    span = spark.createDataFrame([("s1", "t1"), ("s2", "t2")], "span_id string, turn_id string")
    turn = spark.createDataFrame([("t1", "C"), ("t2", "D")], "turn_id string, conv_id string")
    assert [tuple(r) for r in pools.conversation_of(of, span, turn).collect()] == [("a", "C")]


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("Answer:  The Paris [C2][c1] [c2]", ("The Paris [C2][c1] [c2]", ["c2", "c1"], False)),
        ("[ [INSUFFICIENT EVIDENCE] ] [c1]", ("[ [INSUFFICIENT EVIDENCE] ] [c1]", [], True)),
        ("insufficient evidence here [c1]", ("insufficient evidence here [c1]", [], True)),
        ("[c1] [c2]", ("[c1] [c2]", [], True)),
        ("the [?]", ("the [?]", [], True)),
        ("[Paris] and [Rome] [c3]", ("[Paris] and [Rome] [c3]", ["c3"], False)),
        ("[", ("[", [], True)),
        (None, ("", [], True)),
    ],
)
def test_answers(spark, said, want):
    row = spark.createDataFrame([(said,)], "s string").select(reader.parse_answer(F.col("s")).alias("a")).first()["a"]
    assert (row["answer_text"], row["citations"], row["abstained"]) == want


def test_a_citation_of_nothing_shown(spark):
    parsed = spark.createDataFrame([(1, ["c1", "c9"])], "answer_id int, citations array<string>")
    shown = spark.createDataFrame([(1, "c1", "x")], "answer_id int, claim_id string, atom_id string")
    got = reader.resolve_citations(parsed, shown, strict=False).orderBy("pos").collect()
    assert [(r["citation"], r["atom_id"]) for r in got] == [("c1", "x"), ("c9", None)]
    with pytest.raises(Exception, match="nothing shown"):
        reader.resolve_citations(parsed, shown).collect()


def test_order_has_edges_in_the_middle_and_the_budget_keeps_closure(spark):
    rows = [("q", a, "node", a == "n5", s) for a, s in [("n1", 5.0), ("n2", 4.0), ("n3", 3.0), ("n4", 2.0), ("n5", 1.0)]] + [("q", "e1", "edge", None, None), ("q", "e2", "edge", False, 9.0)]
    placed = reader.order(spark.createDataFrame(rows, "question_id string, atom_id string, kind string, hit boolean, score double"))
    assert [r["atom_id"] for r in placed.orderBy("place").collect()] == ["n5", "n1", "n2", "e2", "e1", "n4", "n3"]
    # n4 does not fit; e2 needs it and goes; its tokens are given to e1's follower only if that is next
    refs = {"e2": ["n4"], "e1": ["n1"]}
    atoms = [r["atom_id"] for r in placed.orderBy("place").collect()]
    cost = {"n5": 10, "n1": 10, "n2": 10, "e2": 10, "e1": 10, "n4": 10, "n3": 10}
    assert reader._within(atoms, cost, {a: refs.get(a, []) for a in atoms}, 50) == ["n5", "n1", "n2", "e1", "n4"]
    assert reader._within(atoms, cost | {"n4": 30}, {a: refs.get(a, []) for a in atoms}, 50) == ["n5", "n1", "n2", "e1"]
    assert reader._within(atoms, cost | {"n5": 90}, {a: [] for a in atoms}, 50) == ["n5"]
    assert reader._within(["e2"], {"e2": 1}, {"e2": ["never seen"]}, 50) == []


def test_quotes(spark, graph):
    text = "x" * 500
    atoms = spark.createDataFrame([("q", "A", "node", "c1"), ("q", "B", "node", "c2"), ("q", "C", "node", "e1"), ("q", "D", "edge", "x1"), ("q", "E", "edge", "x4")], "question_id string, atom_id string, kind string, target string")
    of = spark.createDataFrame([("c1", 0, "s0"), ("c1", 1, "s1"), ("c2", 0, "s2")], "target string, pos int, span_id string")
    span = spark.createDataFrame([("s0", "t", 2, 2), ("s1", "t", 1, 3), ("s2", "u", 0, 500)], "span_id string, turn_id string, start int, end int")
    turn = spark.createDataFrame([("t", "abcdef"), ("u", text)], "turn_id string, text string")
    name = spark.createDataFrame([("e1", "London"), ("t1", "")], "node_id string, name string")
    got = {r["atom_id"]: r["quote"] for r in reader.quotes(atoms, of, span, turn, graph[1], name).collect()}
    assert got == {"A": "bc", "B": "x" * 399 + "…", "C": "London", "D": "(about_entity → London)", "E": "(valid_during → t1)"}


def test_anchors(spark):
    asks = spark.createDataFrame([(1, "Who wrote  the Green Album?"), (2, "nothing"), (3, None)], "question_id int, text string")
    titles = spark.createDataFrame([(1, "Green"), (1, "green  album"), (1, "  "), (1, None), (2, "Green"), (3, "x")], "question_id int, title string")
    assert {r[0]: r[1] for r in anchors.title_in_question(asks, titles).collect()} == {1: "green  album", 2: None, 3: None}
    steps = spark.createDataFrame([(1, "The Green Album >> author"), (2, "#1 >> x"), (3, ">> x")], "question_id int, step string")
    assert {r[0]: r[1] for r in anchors.subject_title(steps, titles).collect()} == {1: "green  album", 2: None, 3: None}


def test_intervals_against_all_pairs(spark):
    rng = random.Random(5)
    bound = lambda: None if rng.random() < 0.15 else rng.randrange(-400, 400)
    a, b = [[(i, bound(), bound()) for i in range(60)] for _ in range(2)]
    inf = float("inf")
    span = lambda x: (-inf if x[1] is None else x[1], inf if x[2] is None else x[2])
    want = sorted((x[0], y[0]) for x in a for y in b if max(span(x)[0], span(y)[0]) < min(span(x)[1], span(y)[1]) and span(x)[0] < span(x)[1] and span(y)[0] < span(y)[1])
    left, right = spark.createDataFrame(a, "p long, lo long, hi long"), spark.createDataFrame(b, "o long, lo long, hi long")
    assert sorted(tuple(r) for r in intervals.overlap_join(left, right, "p", "o", 50).collect()) == want
    bounded = [x for x in a if x[1] is not None and x[2] is not None]
    part = {r["p"]: r["fraction"] for r in intervals.covered_fraction(left.filter("lo IS NOT NULL AND hi IS NOT NULL"), right, "p", 50).collect()}
    for i, lo, hi in bounded:
        held = sum(any(span(y)[0] <= t < span(y)[1] for y in b) for t in range(lo, hi))
        assert part[i] == (round(held / (hi - lo), 6) if hi > lo else 0)
    assert intervals.overlap_join(left.limit(0), right, "p", "o").count() == 0


def test_stratified_sample_has_its_size_and_shares(spark):
    rows = spark.createDataFrame([(i, "a" if i % 10 < 7 else ("b" if i % 10 < 9 else None), i % 3) for i in range(1001)], "id long, s string, n int")
    quota = {r["stratum"]: r["quota"] for r in sampling.quotas(rows, "s", 101).collect()}
    assert sum(quota.values()) == 101
    assert quota == {"a": 71, "b": 20, None: 10}
    got = sampling.stratified_sample(rows, "s", "id", 101).collect()
    assert {s: sum(r["s"] == s for r in got) for s in quota} == quota
    assert sorted(got) == sorted(sampling.stratified_sample(rows.repartition(7), "s", "id", 101).collect())
    assert sampling.stratified_sample(rows, "s", "id", 5000).count() == 1001
    assert sampling.stratified_sample(rows.limit(0), "s", "id", 10).count() == 0


def test_sample_ranks_agree_over_many_buckets(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "a") for i in range(500)], "id long, s string")
    want = sorted(r["id"] for r in sampling.stratified_sample(rows, "s", "id", 77).collect())
    monkeypatch.setattr(sampling, "BUCKET", 20)
    assert sorted(r["id"] for r in sampling.stratified_sample(rows, "s", "id", 77).collect()) == want


def test_vector_blocks_find_what_all_pairs_find(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8)).round(2)
    v[7] = 0
    v[9] = v[10]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(None, [1.0] * 8), (900, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vectors.cosine_topk(df.filter("vec_id % 10 = 0 OR vec_id IN (7, 9)"), df, 5, query_block=8, row_block=50).collect()
    keep = [i for i in range(300) if i != 7]
    u = v / np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]
    for q in [9, *range(0, 300, 10)]:
        best = sorted((-round(float(u[q] @ u[i]), 6), i) for i in keep if i != q)[:5]
        assert [(r["node_id"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"]) if r["question_id"] == q] == [(i, n) for n, (_, i) in enumerate(best, 1)]
    assert not [r for r in got if r["question_id"] == 7]
    assert vectors.cosine_topk(df.limit(0), df, 5).count() == 0


def test_pooled_features(spark):
    vec = spark.createDataFrame([("a", [1.0, -2.0]), ("b", [3.0, -4.0])], "item string, vector array<double>")
    sets = spark.createDataFrame([(1, "a"), (1, "b"), (1, "unknown"), (2, None)], "set_id int, item string")
    got = {r["set_id"]: r["features"] for r in pooling.pool_sets(sets, vec, 2, 4).collect()}
    assert got == {1: [2.0, -3.0, 3.0, -2.0, 0.5], 2: [0.0] * 5}
    with pytest.raises(Exception, match="no member is known"):
        pooling.pool_sets(sets.filter("item = 'unknown'"), vec, 2, 4).collect()
    assert pooling.pool_sets(sets.limit(0), vec, 2, 4).count() == 0


def test_class_mapping_and_pool_sizes(spark):
    labels = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z"), (5, None)], "item int, native string")
    mapping = spark.createDataFrame([("x", "T"), ("y", "T"), ("w", "U")], "native string, target string")
    assert sorted(map(tuple, pooling.class_mapping(labels, mapping).collect())) == [("x", 2, "T", True), ("y", 1, "T", True), ("z", 1, None, False)]
    atoms = spark.createDataFrame([("p", 1, "A  b"), ("p", 2, "a b"), ("q", 3, ""), ("q", 4, ""), ("q", 5, None), ("r", 6, "a b")], "question_id string, atom_id int, text string")
    assert tuple(pooling.pool_sizes(atoms).first()) == (3, 1, 2, 3, 1)
    assert tuple(pooling.pool_sizes(atoms.limit(0)).first()) == (0, None, None, None, 0)


def test_scaled_cosines_hold_every_pair_and_few_at_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 4))
    v[20] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(60)], "vec_id long, embedding array<double>")
    got = {(r["question_id"], r["node_id"]): r["s"] for r in vectors.cosine_scaled(df.filter("vec_id % 10 = 0"), df, query_block=3, row_block=16).collect()}
    unit = np.delete(v, 20, 0) / np.linalg.norm(np.delete(v, 20, 0), axis=1)[:, None]
    ids = [i for i in range(60) if i != 20]
    want = {}
    for q in (0, 10, 30, 40, 50):
        cosines = {i: round(float(unit[ids.index(q)] @ unit[ids.index(i)]), 6) for i in ids if i != q}
        lo, hi = min(cosines.values()), max(cosines.values())
        want |= {(q, i): (c - lo) / (hi - lo) for i, c in cosines.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    flat = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(3)], "vec_id long, embedding array<double>")
    assert {r["s"] for r in vectors.cosine_scaled(flat, flat).collect()} == {0.0}
    assert vectors.cosine_scaled(df.limit(0), df).count() == 0
    # a task works through its block in parts
    monkeypatch.setattr(vectors, "HELD", 100)
    held = [out.size for _, out in vectors._scored(pd.DataFrame({"id": range(30), "v": list(v[30:])}), pd.DataFrame({"id": range(20), "v": list(v[:20])}))]
    assert sum(held) == 600 and max(held) <= 100
