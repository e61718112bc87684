"""Fusion, the temporal filter and the assembled pool on hand-made rows."""

from __future__ import annotations

from provenlace.evidence import pool_queries, retrieval

HITS = "question_id string, channel string, node_id string, score double"
SF = "/root/testdata/sf0.001"


def test_fusion(spark):
    hits = spark.createDataFrame([("q", "b", "x", 4.0), ("q", "b", "y", 2.0), ("q", "b", "z", 3.0), ("q", "a", "x", 7.0), ("q", "a", "w", 7.0), ("r", "b", "y", 1.0)], HITS)
    fused = retrieval.fuse(retrieval.scaled(hits, {"a": 2.0}))
    assert {(r["question_id"], r["node_id"]): (r["score"], r["winner"], r["channels"]) for r in fused.collect()} == {
        ("q", "x"): (2.0, "a", {"a": 2.0, "b": 1.0}), ("q", "w"): (2.0, "a", {"a": 2.0}), ("q", "y"): (0.0, "b", {"b": 0.0}),
        ("q", "z"): (0.5, "b", {"b": 0.5}), ("r", "y"): (1.0, "b", {"b": 1.0}),
    }
    report = {(r["question_id"], r["channel"]): (r["returned"], r["wins"], r["only_here"]) for r in retrieval.fusion_report(fused).collect()}
    assert report == {("q", "a"): (2, 2, 1), ("q", "b"): (3, 2, 2), ("r", "b"): (1, 1, 1)}
    tie = retrieval.fuse(retrieval.scaled(hits)).filter("node_id = 'x'").first()
    assert (tie["score"], tie["winner"]) == (1.0, "a")
    assert retrieval.fuse(retrieval.scaled(hits.limit(0))).count() == 0


def test_fusion_of_repeated_and_null_hits(spark):
    hits = [("q", "b", "x", 4.0), ("q", "b", "x", 2.0), ("q", "b", "y", 2.0), ("q", "a", "x", 1.0), ("q", "a", "w", 0.0), ("q", "b", None, 3.0), (None, "b", "x", 3.0), ("q", None, "x", 9.0), ("q", "a", "y", None), ("q", "a", "z", None)]
    fused = retrieval.fuse(retrieval.scaled(spark.createDataFrame(hits, HITS)))
    assert {(r["question_id"], r["node_id"]): (r["score"], r["winner"], r["channels"]) for r in fused.collect()} == {
        ("q", "x"): (1.0, "a", {"a": 1.0, "b": 1.0}), ("q", "y"): (0.0, "b", {"a": None, "b": 0.0}), ("q", "z"): (None, "a", {"a": None}), ("q", "w"): (0.0, "a", {"a": 0.0}),
    }


def test_temporal_filter_lets_pass_what_it_cannot_judge(spark):
    hits = spark.createDataFrame([(q, "b", n, 1.0) for q in "qr" for n in ("in", "out", "open", "both", "none")], HITS)
    held = spark.createDataFrame([("in", 4.0, 9.0), ("out", 6.0, 9.0), ("out", 0.0, 2.0), ("open", None, 3.0), ("both", 6.0, 9.0), ("both", 4.0, 5.0)], "node_id string, lo double, hi double")
    asked = spark.createDataFrame([("q", 2.0, 6.0)], "question_id string, lo double, hi double")
    got = {(r["question_id"], r["node_id"]): (r["kept"], r["reason"]) for r in retrieval.temporal_filter(retrieval.fuse(retrieval.scaled(hits)), asked, held).collect()}
    assert got == {("q", "in"): (True, "overlap"), ("q", "out"): (False, "miss"), ("q", "open"): (True, "overlap"), ("q", "both"): (True, "overlap"), ("q", "none"): (True, "no interval")} | {
        ("r", n): (True, "no constraint") for n in ("in", "out", "open", "both", "none")
    }


def test_cap_passes_over_what_does_not_fit(spark):
    scores = spark.createDataFrame([("q", "a", 3.0), ("q", "b", 2.0), ("q", "c", 1.0), ("q", "d", 1.0)], "question_id string, node_id string, score double")
    companion = spark.createDataFrame([("a", "e"), ("b", "f"), ("b", "g"), ("c", "e")], "node_id string, companion string")
    got = lambda cap: sorted(r["node_id"] for r in retrieval.capped(scores, companion, cap).collect())
    assert got(4) == ["a", "c", "d", "e"]
    assert got(1) == ["d"]
    assert got(9) == ["a", "b", "c", "d", "e", "f", "g"]


def test_assembled_pools_equal_one_by_one(spark):
    hits, constraint, node, edge = (t.toPandas() for t in pool_queries._tables(spark, SF, "hits", "constraint", "node", "edge"))
    got = pool_queries.retrieval_assemble(spark, SF).toPandas()
    kinds, alive = dict(zip(node["node_id"], node["ntype"], strict=True)), edge[edge["t_invalid"].isna()]
    times = {n: (lo, hi) for n, lo, hi in zip(node["node_id"], node["lo"], node["hi"], strict=True)}
    out_edges = {s: list(zip(g["etype"], g["dst"], g["edge_id"], strict=True)) for s, g in alive.groupby("src")}
    asked = {q: (lo, hi) for q, lo, hi in constraint.itertuples(index=False)}
    for q, rows in hits.groupby("question_id"):
        score = {}
        for channel, part in rows.groupby("channel"):
            lo, hi = part["score"].min(), part["score"].max()
            for n, s in zip(part["node_id"], part["score"], strict=True):
                score[n] = max(score.get(n, 0.0), round((1.0 if hi == lo else (s - lo) / (hi - lo)) * pool_queries.WEIGHTS.get(channel, 1.0), 9))
        pool = set()
        for n in sorted(score, key=lambda n: (-score[n], n)):
            held = [times[d] for e, d, _ in out_edges.get(n, []) if e == "valid_during" and kinds.get(d) == "TimeInterval"]
            if q in asked and held and not any(max(lo, asked[q][0]) < min(hi if hi == hi else 1e300, asked[q][1]) for lo, hi in held):
                continue
            more = pool | {n} | {d for e, d, _ in out_edges.get(n, []) if kinds.get(d) in ("Entity", "TimeInterval")}
            pool = more if len(more) <= pool_queries.CAP else pool
        mine = got[got["question_id"] == q]
        assert set(mine[mine["kind"] == "node"]["target"]) == pool
        assert sorted(mine[mine["kind"] == "edge"]["target"]) == sorted(i for n in pool for _, d, i in out_edges.get(n, []) if d in pool)
        assert {t: s for t, s in zip(mine["target"], mine["score"], strict=True) if s == s} == {n: s for n, s in score.items() if n in pool}


def test_assembly_of_repeated_and_null_turns(spark, tmp_path):
    """A turn that is there twice, without a number or without a text."""
    row = "conv_id long, turn long, role string, text string"
    turns = [(1, 0, "user", "something remarkable"), (1, 0, "user", "something remarkable indeed"), (1, None, "user", "numberless"), (1, 2, "user", None), (2, 0, "user", "another conversation"), (2, 2, "user", None), (2, 4, "user", None), (None, 0, "user", "nowhere")]
    spark.createDataFrame(turns, row).write.parquet(str(tmp_path / "conversations.parquet"))
    got = pool_queries.retrieval_assemble(spark, str(tmp_path)).filter("kind = 'node' AND channels IS NOT NULL").collect()
    assert {(r["question_id"], r["target"]) for r in got} == {("1", "n/conv/1/0"), ("1", "n/conv/1/2"), ("2", "n/conv/2/0"), ("2", "n/conv/2/2"), ("2", "n/conv/2/4")}
    assert {r["channels"] for r in got if r["target"] == "n/conv/1/0"} == {3}


def test_pools_are_made_once(spark):
    """What the atoms are made of is written, so the plan after it has no grouped function and no fusion."""
    plan = pool_queries.retrieval_assemble(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "map_from_entries" not in plan


def test_derived_tables_are_not_broadcast(spark):
    made = pool_queries.retrieval_assemble(spark, SF)
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
