"""Order statistics against sorted lists: hot groups, ties, negatives, neighbours in floating point, extremes."""

from __future__ import annotations

import math
import random

import pytest

from provenlace.operators import selection


@pytest.mark.parametrize("buckets", [2, 16, 4096])
def test_every_rank_is_the_sorted_one(spark, buckets):
    rng = random.Random(buckets)
    groups = {
        "hot": [rng.gauss(0, 100) for _ in range(700)], "ties": [float(rng.randrange(3)) for _ in range(60)], "one": [7.5], "same": [2.0] * 9,
        "near": [1.0, math.nextafter(1.0, 2), math.nextafter(math.nextafter(1.0, 2), 2)], "far": [-1.7e308, 0.0, -0.5, 1.7e308, 5e-324], None: [3.0, 1.0],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("hot", None), ("hot", math.nan)]
    picks = {g: sorted({0, len(v) - 1, len(v) // 2, *[rng.randrange(len(v)) for _ in range(5)]}) for g, v in groups.items()}
    ranks = [(g, r) for g, rs in picks.items() for r in rs] + [("hot", 700), ("hot", -1), ("unheard of", 0)]
    rng.shuffle(rows)
    got = selection.at_ranks(spark.createDataFrame(rows, "g string, v double"), spark.createDataFrame(ranks, "g string, rank long"), "g", "v", buckets).collect()
    want = {(g, r): sorted(groups[g])[r] for g, rs in picks.items() for r in rs} | {("hot", 700): None, ("hot", -1): None, ("unheard of", 0): None}
    assert {(r.g, r["rank"]): r.v for r in got} == want


def test_quantiles_and_nearest_ranks(spark):
    rng = random.Random(2)
    groups = {"a": [rng.random() for _ in range(101)], "b": [1.0, 2.0], "c": [5.0]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("d", None)], "g string, v double")
    got = {r.g: (r.p50, r.p95) for r in selection.quantiles(rows, "g", "v", {"p50": 0.5, "p95": 0.95}, ("p95",)).collect()}
    middle = lambda s: (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
    assert got == {g: (pytest.approx(middle(sorted(v))), sorted(v)[max(0, math.ceil(0.95 * len(v)) - 1)]) for g, v in groups.items()}
    assert selection.quantiles(rows.limit(0), "g", "v", {"p50": 0.5}).count() == 0
