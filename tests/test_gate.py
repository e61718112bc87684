"""The gate against plain numpy: Newton's optimum, early stop, refusals, and the report row by row."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenlace.evidence import gate

FEATURES = ["a", "b", "flat"]
ROWS = "a double, b double, flat double, label int, part string"


def sample(n, seed, share=0.3):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n) * 50 + 1000, rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-((a - 1000) / 40 - b + np.log(share / (1 - share)))))).astype(int)
    part = np.where(np.arange(n) % 4 == 0, "dev", "train")
    return [(float(a[i]), float(b[i]), 7.0, int(y[i]), str(part[i])) for i in range(n)]


def plain(rows, decay):
    x = np.array([[r[0], r[1]] for r in rows if r[4] == "train"])
    y = np.array([r[3] for r in rows if r[4] == "train"])
    x = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(len(y))])
    weight, w = np.where(y > 0, (y == 0).sum() / y.sum(), 1.0), np.zeros(3)
    for _ in range(20000):
        w -= 0.5 * (x.T @ (weight * (1 / (1 + np.exp(-x @ w)) - y)) / len(y) + decay * w)
    return w


def test_train_reaches_the_optimum(spark):
    # the same rows to train and to select, so the least dev loss is at the optimum
    rows = [(*r[:4], p) for r in sample(1500, 1) for p in ("train", "dev")]
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    got = gate.train(df, FEATURES, patience=100)
    want = plain(rows, gate.DECAY)
    assert np.allclose([got.weights[0], got.weights[1], got.weights[3]], want, atol=5e-3)
    train = [r for r in rows if r[4] == "train"]
    assert got.balance == {0: sum(r[3] == 0 for r in train), 1: sum(r[3] for r in train)} and abs(got.positive - got.balance[0] / got.balance[1]) < 1e-12
    losses = [t for t, _ in got.history]
    assert losses == sorted(losses, reverse=True)
    p = np.array([r.p for r in df.select(gate.predict(got).alias("p"), "a", "b").collect()])
    x = np.array([[r.a, r.b] for r in df.select("a", "b").collect()])
    z = (x - got.mean[:2]) / got.scale[:2]
    assert np.allclose(np.sort(p), np.sort(1 / (1 + np.exp(-(z @ got.weights[:2] + got.weights[3])))), atol=1e-9)


def test_the_step_of_the_least_dev_loss_stays(spark):
    # dev labels contradict the train labels, so every step away from the start is worse
    rows = [(r[0], r[1], r[2], 1 - r[3] if r[4] == "dev" else r[3], r[4]) for r in sample(400, 2, 0.5)]
    got = gate.train(spark.createDataFrame(rows, ROWS), FEATURES, patience=3)
    assert (got.weights == 0).all() and len(got.history) >= 2
    devs = [d for _, d in got.history]
    assert devs[0] == min(devs)


def test_odd_rows_and_refusals(spark):
    odd = [(None, 1.0, 7.0, 1, "train"), (float("nan"), float("inf"), None, 0, "train"), (1.0, 2.0, 7.0, None, "dev"), (1.0, 2.0, 7.0, 1, None), (1.0, 2.0, 7.0, 0, "test")]
    rows = sample(300, 3)
    got = gate.train(spark.createDataFrame(rows + odd, ROWS), FEATURES)
    assert np.isfinite(got.weights).all() and sum(got.balance.values()) == sum(r[4] == "train" for r in rows) + 2
    told = spark.createDataFrame(odd, ROWS).select(gate.predict(got).alias("p")).collect()
    assert all(0 <= r.p <= 1 for r in told)
    with pytest.raises(ValueError, match="no dev rows"):
        gate.train(spark.createDataFrame([r for r in rows if r[4] == "train"], ROWS), FEATURES)
    with pytest.raises(ValueError, match="no train rows"):
        gate.train(spark.createDataFrame([], ROWS), FEATURES)
    one = gate.train(spark.createDataFrame([(*r[:3], 1, r[4]) for r in rows], ROWS), FEATURES, steps=8)
    assert one.positive == 0 or np.isfinite(one.weights).all()


def plain_report(pairs, share):
    s, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    w = np.where(y == 1, (1 - share) * len(y) / n1, share * len(y) / n0) if n0 and n1 else np.ones(len(y))
    risks, curve, w0, e0 = [], {}, 0.0, 0.0
    for v in sorted(set(s), reverse=True):
        here = s == v
        n, gw, ge = here.sum(), w[here].sum(), (w * (y == 0))[here].sum()
        risks += [(e0 + ge / n * k) / (w0 + gw / n * k) for k in range(1, n + 1)]
        w0, e0 = w0 + gw, e0 + ge
        curve[v] = e0 / w0
    return float(np.mean(risks)), curve


@pytest.mark.parametrize("seed", [1, 2])
def test_report_equals_row_by_row(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(float(np.round(v, 1 + seed)), int(rng.random() < 0.2 + 0.7 * v)) for v in rng.random(500)] + [(0.5, 1)] * 300 + [(1.0, 1)] * 9 + [(0.0, 0)]
    df = spark.createDataFrame([*pairs, (None, 1), (0.3, None)], "score double, label int").repartition(3)
    got = {r.metric: r.value for r in gate.evaluate(df, target=0.02).collect()}
    for name, share in gate.PREVALENCES.items():
        area, curve = plain_report(pairs, share)
        assert abs(got[f"aurc_{name}"] - area) < 1e-9
        if name == "natural":
            fit = [v for v, r in curve.items() if r <= 0.02]
            assert got["met"] == float(bool(fit)) and got["threshold"] == (min(fit) if fit else max(curve))
    said = [(s >= got["threshold"], y) for s, y in pairs]
    assert abs(got["coverage"] - np.mean([a for a, _ in said])) < 1e-9
    assert abs(got["false_abstention"] - np.mean([not a for a, y in said if y])) < 1e-9
    assert abs(got["abstention_recall"] - np.mean([not a for a, y in said if not y])) < 1e-9
    assert got["n"] == len(pairs) and got["vacuous"] == 0
    assert gate.evaluate(df, target=0.06).filter("metric = 'vacuous'").first().value == 1


def test_report_of_one_class_and_of_nothing(spark):
    ones = {r.metric: r.value for r in gate.evaluate(spark.createDataFrame([(0.4, 1), (0.6, 1)], "score double, label int")).collect()}
    assert ones["aurc_natural"] == 0 and ones["abstention_recall"] is None and ones["coverage"] == 1
    none = {r.metric: r.value for r in gate.evaluate(spark.createDataFrame([], "score double, label int")).collect()}
    assert none["threshold"] == 1 and none["n"] == 0 and none["aurc_natural"] is None


def test_digamma(spark):
    x = [1.0, 1.5, 3.25, 40.0, 1e6]
    got = [r.v for r in spark.createDataFrame([(v,) for v in x], "x double").select(gate._digamma(F.col("x")).alias("v")).collect()]
    assert np.allclose(got, [-0.5772156649015329, 0.03648997397857652, 1.0169909, 3.6763273740, 13.815510057964191], atol=2e-6)
