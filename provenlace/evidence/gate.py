"""The answerability gate: a weighted logistic model by Newton steps, its scores, and their risk and coverage at stated prevalences.

Labels are 1 (answerable) or 0. A model is a handful of numbers; rows never leave the tasks but as sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Shares of unanswerable questions that results are told for, and the risk that is allowed at the natural one.
PREVALENCES = {"natural": 0.06, "constructed": 0.5}
TARGET_RISK = 0.03
DECAY = 1e-4
BINS = 10


@dataclass
class Gate:
    """Weights of standardised features, the intercept last; losses of each step as (train, dev)."""

    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    positive: float
    balance: dict[int, int]
    history: list[tuple[float, float]] = field(default_factory=list)


def _sums(rows: DataFrame, gate: Gate, d: int) -> np.ndarray:
    """At gate's weights, over the train rows the loss, gradient and Hessian, over the dev rows the loss, with the numbers of rows."""
    mean, scale, w, positive = gate.mean, gate.scale, gate.weights, gate.positive

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4 + d + d * d)
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[2:]] or [np.zeros((batch.num_rows, 0))])
            z = (x - mean) / scale
            z = np.column_stack([np.where(np.isfinite(z), z, 0.0), np.ones(batch.num_rows)])
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            dev = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            logit = z @ w
            weight = np.where(y > 0.5, positive, 1.0)
            loss = weight * (np.logaddexp(0.0, logit) - y * logit)
            p = 0.5 * (1 + np.tanh(logit / 2))
            t = ~dev
            total[:4] += t.sum(), loss[t].sum(), dev.sum(), loss[dev].sum()
            total[4 : 4 + d] += z[t].T @ (weight * (p - y))[t]
            total[4 + d :] += (z[t].T @ (z[t] * (weight * p * (1 - p))[t, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["part"])

    each = rows.mapInArrow(parts, "part array<double>").select(F.posexplode("part").alias("at", "v"))
    out = np.zeros(4 + d + d * d)
    for r in each.groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def train(rows: DataFrame, features: list[str], label: str = "label", part: str = "part", decay: float = DECAY, steps: int = 25, patience: int = 5) -> Gate:
    """A logistic gate from the rows whose ``part`` is train, that of the least loss on those whose part is dev.

    Loss: mean of cross-entropy, label 1 weighing (rows of label 0) / (rows of label 1), plus decay / 2 of the squared weights. A
    step is one aggregation: each task sums its part of gradient and Hessian, and only these sums, one row a task, are
    added up. A step that does not lower the train loss is halved. It ends when the gradient is flat or the dev loss has not fallen for
    ``patience`` steps. Features are standardised by the train rows; null, NaN and infinite ones count as their mean, constant ones have
    no say. Rows with a null label or another part are left out. No train rows or no dev rows: ValueError, as nothing could be selected.
    """
    whole = F.col(label).cast("double")
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double"))
    used = rows.filter(F.col(part).isin("train", "dev") & F.col(label).isNotNull())
    used = used.select(whole.alias("y"), (F.col(part) == "dev").alias("dev"), *[number(c).alias(f"x{i}") for i, c in enumerate(features)])
    sums = [f(F.col(f"x{i}")).alias(f"{n}{i}") for i in range(len(features)) for n, f in (("mean", F.avg), ("dev", F.stddev_pop))]
    told = used.filter("NOT dev").agg(F.count_if(F.col("y") > 0.5).alias("n1"), F.count(F.lit(1)).alias("n"), *sums).first()
    if not told["n"]:
        raise ValueError("no train rows: there is nothing to learn from")
    d, n1, n0 = len(features) + 1, told["n1"], told["n"] - told["n1"]
    mean = np.array([told[f"mean{i}"] or 0.0 for i in range(d - 1)])
    scale = np.array([told[f"dev{i}"] or 0.0 for i in range(d - 1)])
    scale = np.where(scale > 1e-12 * np.maximum(1.0, np.abs(mean)), scale, np.inf)
    gate = Gate(list(features), mean, scale, np.zeros(d), n0 / n1 if n1 else 1.0, {0: n0, 1: n1})

    best, best_dev, since, last, step = gate.weights, np.inf, 0, np.inf, np.zeros(d)
    for _ in range(steps):
        s = _sums(used, gate, d)
        if not s[2]:
            raise ValueError("no dev rows: no step could be selected, and the result would be the start")
        loss, dev = s[1] / s[0] + decay / 2 * gate.weights @ gate.weights, s[3] / s[2]
        if loss > last + 1e-12:
            step = step / 2
            if np.abs(step).max() < 1e-10:
                break
            gate.weights = gate.weights - step
            continue
        gate.history.append((float(loss), float(dev)))
        last = loss
        best, best_dev, since = (gate.weights, dev, 0) if dev < best_dev - 1e-6 else (best, best_dev, since + 1)
        slope = s[4 : 4 + d] / s[0] + decay * gate.weights
        if since >= patience or np.abs(slope).max() < 1e-9:
            break
        step = -np.linalg.solve(s[4 + d :].reshape(d, d) / s[0] + decay * np.eye(d), slope)
        gate.weights = gate.weights + step
    gate.weights = best
    return gate


def predict(gate: Gate) -> Column:
    """The probability of label 1 as a built-in expression over the features' columns."""
    logit = F.lit(float(gate.weights[-1]))
    for name, mean, scale, w in zip(gate.features, gate.mean, gate.scale, gate.weights, strict=False):
        if np.isfinite(scale):
            x = F.col(name).cast("double")
            usable = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
            logit = logit + F.when(usable, (x - float(mean)) / float(scale) * float(w)).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


def class_weights(rows: DataFrame, label: str, prevalence: float | None) -> tuple[float, float]:
    """What a row of label 0 and of label 1 weighs so that label 0 has that share; 1 and 1 without a prevalence or a class."""
    n0, n1 = rows.agg(F.count_if(F.col(label) < 0.5), F.count_if(F.col(label) >= 0.5)).first()
    if prevalence is None or not n0 or not n1:
        return 1.0, 1.0
    return prevalence * (n0 + n1) / n0, (1 - prevalence) * (n0 + n1) / n1


def curve(rows: DataFrame, score: str = "score", label: str = "label", weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(score, n, weight, error, before_weight, before_error, total, coverage, risk): a row for each threshold, all its ties at once.

    Scores of 0 to 1. Running sums go by bands of scores and inside each of them, so no task holds all thresholds. Rows with
    a null score or label are left out.
    """
    w0, w1 = weights
    known = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).cast("double").alias("score"), (F.col(label) < 0.5).alias("wrong"))
    at = known.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.count_if("wrong").alias("wrong"))
    at = at.select("score", "n", ((F.col("n") - F.col("wrong")) * w1 + F.col("wrong") * w0).alias("weight"), (F.col("wrong") * w0).alias("error"), F.floor(F.col("score") * 1024).alias("band"))
    above = W.orderBy(F.desc("band")).rowsBetween(W.unboundedPreceding, -1)
    bands = at.groupBy("band").agg(F.sum("weight").alias("bw"), F.sum("error").alias("be"))
    zero = F.lit(0.0)
    bands = bands.select("band", F.coalesce(F.sum("bw").over(above), zero).alias("w0"), F.coalesce(F.sum("be").over(above), zero).alias("e0"), F.sum("bw").over(W.partitionBy()).alias("total"))
    inside = W.partitionBy("band").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    out = at.join(bands, "band").withColumns({
        "before_weight": F.col("w0") + F.coalesce(F.sum("weight").over(inside), zero),
        "before_error": F.col("e0") + F.coalesce(F.sum("error").over(inside), zero),
    })
    covered = F.col("before_weight") + F.col("weight")
    risk = (F.col("before_error") + F.col("error")) / covered
    return out.select("score", "n", "weight", "error", "before_weight", "before_error", "total", (covered / F.col("total")).alias("coverage"), risk.alias("risk"))


def _digamma(x: Column) -> Column:
    """For x of 1 or more, by its series ten further on."""
    y = x + 10
    series = F.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6)
    for j in range(10):
        series = series - 1 / (x + j)
    return series


def aurc(curve_: DataFrame) -> Column:
    """An aggregate over ``curve``: the mean risk over all prefixes of the rows from the highest score down.

    Among ties a prefix has the mean weight and error of the ties, whose order says nothing. The sum over n of them,
    of (e0 + e k) / (w0 + w k), has a closed form, so a score that a third of all rows share makes one row.
    """
    n, w0, e0 = F.col("n"), F.col("before_weight"), F.col("before_error")
    w, e = F.col("weight") / n, F.col("error") / n
    harmonic = _digamma(w0 / w + n + 1) - _digamma(w0 / w + 1)
    return F.sum(n * e / w + (e0 - e * w0 / w) / w * harmonic) / F.sum(n)


def threshold(curve_: DataFrame, target: float = TARGET_RISK) -> tuple[float, bool]:
    """The lowest score whose risk is at most the target, and whether there is one; else the highest score (1 without rows)."""
    low, high = curve_.agg(F.min(F.when(F.col("risk") <= target, F.col("score"))), F.max("score")).first()
    return (1.0 if high is None else high, False) if low is None else (low, True)


def evaluate(rows: DataFrame, score: str = "score", label: str = "label", at: float | None = None, target: float = TARGET_RISK) -> DataFrame:
    """(metric, value): the gate's report. Null where a metric has nothing to count.

    aurc_<prevalence> for each of PREVALENCES; threshold (given, or the lowest within the target at the natural prevalence), met (1 or 0;
    null if given) and vacuous (1 if the target is no less than that prevalence); coverage, selective_risk, abstention_recall
    and false_abstention at the threshold; brier, ece (ten equal bins), n.
    """
    spark = rows.sparkSession
    rows = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).cast("double").alias("score"), F.col(label).cast("double").alias("label"))
    out: dict[str, float | None] = {}
    for name, share in PREVALENCES.items():
        here = curve(rows, "score", "label", class_weights(rows, "label", share))
        out[f"aurc_{name}"] = here.agg(aurc(here)).first()[0]
        if name == "natural":
            cut_, met = (at, None) if at is not None else threshold(here, target)
    out |= {"threshold": cut_, "met": None if met is None else float(met), "vacuous": float(target >= PREVALENCES["natural"])}
    said, good = F.col("score") >= cut_, F.col("label") >= 0.5
    share = lambda a, b: F.count_if(a) / F.nullif(F.count_if(b), F.lit(0))
    bin_ = F.when(F.col("score") <= 0, 0).otherwise(F.least(F.lit(BINS - 1), F.ceil(F.col("score") * BINS) - 1))
    told = rows.agg(
        share(said, F.lit(True)).alias("coverage"), share(said & ~good, said).alias("selective_risk"), share(~said & ~good, ~good).alias("abstention_recall"),
        share(~said & good, good).alias("false_abstention"), F.avg((F.col("score") - F.col("label")) ** 2).alias("brier"), F.count(F.lit(1)).cast("double").alias("n"),
    ).first()
    gaps = rows.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("score") - F.avg("label")).alias("gap"))
    out |= told.asDict() | {"ece": gaps.agg(F.sum(F.col("n") * F.col("gap")) / F.sum("n")).first()[0]}
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in out.items()], "metric string, value double")
