"""Diversity against all pairs one by one and all subsets of a small universe."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from provenlace.evidence import diversity


def distance(a, b):
    return 1 - (len(a & b) / len(a | b) if a | b else 1.0)


def test_chance_is_the_mean_over_all_subsets(spark):
    cases = [(a, b, u) for u in range(1, 7) for a in range(u + 1) for b in range(u + 1)]
    df = spark.createDataFrame(cases, "a long, b long, u long")
    for r in df.withColumn("e", diversity.chance_distance(F.col("a"), F.col("b"), F.col("u"))).collect():
        pairs = [distance(set(x), set(y)) for x in itertools.combinations(range(r.u), r.a) for y in itertools.combinations(range(r.u), r.b)]
        assert abs(r.e - (sum(pairs) / len(pairs) if r.a and r.b else 0)) < 1e-12, r


def test_diversity_equals_all_pairs_and_sketches_come_near(spark):
    rng = random.Random(4)
    sets = {q: [rng.sample(range(12), rng.randrange(0, 7)) for _ in range(n)] for q, n in (("p", 8), ("q", 25), ("one", 1))}
    sets["q"] += [sets["q"][0]] * 3 + [[], []]
    rows = [(q, i, [str(a) for a in s] * 2) for q, ss in sets.items() for i, s in enumerate(ss)] + [(None, 0, ["1"]), ("null", 0, [None, "1"]), ("null", 1, ["1"])]
    df = spark.createDataFrame(rows, "question_id string, place int, atoms array<string>")
    universe = spark.createDataFrame([("p", 12), ("q", 12), ("one", 12)], "question_id string, atoms long")
    got = {r.question_id: r for r in diversity.diversity(df, universe).collect()}
    assert set(got) == {"p", "q", "one", "null"} and got["one"].observed == got["one"].chance == 0
    assert got["null"].observed == 0 and got["null"].chance == 0
    for q in ("p", "q"):
        pairs = [distance(set(a), set(b)) for a, b in itertools.combinations(sets[q], 2)]
        assert got[q].sets == len(sets[q]) and abs(got[q].observed - sum(pairs) / len(pairs)) < 1e-9
        assert abs(got[q].excess - (got[q].observed - got[q].chance)) < 1e-12
    near = {r.question_id: r.observed for r in diversity.diversity(df, universe, sketches=400).collect()}
    assert all(abs(near[q] - got[q].observed) < 0.03 for q in got)
    assert diversity.diversity(df.limit(0), universe).count() == 0
