"""Quality classifier: scores learned from pairs of a better and a worse text (Bradley-Terry), cut at a quantile."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenlace.llm.common import cut, fresh, table
from provenlace.operators.selection import at_ranks

#: Kinds of characters: 0 blank, 1 line end, 2 lower-case letter, 3 upper-case letter, 4 other letter, 5 digit,
#: 6 other character, 7 and up one for each ASCII mark.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
KINDS = 7 + len(MARKS)
WIDTH = 1024
#: Characters of a text, and words, that are looked at together.
HELD = 1 << 20
WINDOW = 64
SURFACE = 10
FEATURES = SURFACE + KINDS + WIDTH
#: Labelled texts that a task learns from together, and how few of the rarer label are not enough for that.
PART_ROWS, PART_RARE = 6000, 500
SLOPES = np.geomspace(1, 100, 41)


def held_out(id_col: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _kinds() -> np.ndarray:
    out = np.full(0x110000, 6, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            out[c] = 2 if ch.islower() else 3 if ch.isupper() else 4
        elif ch.isdigit():
            out[c] = 5
        elif ch.isspace():
            out[c] = 1 if ch == "\n" else 0
    for i, m in enumerate(MARKS):
        out[ord(m)] = 7 + i
    return out


class Features:
    """How a text is written, without its words: kinds of characters, their trigrams, repetition, lengths."""

    def __init__(self) -> None:
        self.kind = _kinds()

    def of(self, text: str | None) -> np.ndarray:
        out = np.zeros(FEATURES)
        text = text or ""
        if not text:
            return out.astype(np.float32)
        counts, grams = np.zeros(KINDS), np.zeros(WIDTH)
        for i in range(0, len(text), HELD):
            part = text[max(0, i - 2) : i + HELD]
            k = self.kind[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint32)
            counts += np.bincount(k[min(2, i) :], minlength=KINDS)
            if len(k) > 2:
                h = (k[:-2] * np.uint32(2654435761) + k[1:-1] * np.uint32(2246822519) + k[2:] * np.uint32(3266489917)) >> np.uint32(12)
                grams += np.bincount(h % WIDTH, minlength=WIDTH)
        words = text.split()
        lines = text.split("\n")
        n = max(1, len(words))
        fresh_share = [len(set(words[i : i + WINDOW])) / min(WINDOW, len(words) - i) for i in range(0, len(words), WINDOW)]
        lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
        out[:SURFACE] = (
            np.mean(fresh_share) if words else 0.0, min(fresh_share, default=0.0), len(set(words)) / n, len(set(lines)) / len(lines),
            lengths.mean() / 10, lengths.std() / 10, np.log1p(len(text)) / 10, np.log1p(len(words)) / 10, len(lines) / n,
            sum(w[-1] in MARKS for w in words) / n,
        )
        out[SURFACE : SURFACE + KINDS] = np.sqrt(counts / len(text))
        out[SURFACE + KINDS :] = np.sqrt(grams / max(1.0, grams.sum()))
        return out.astype(np.float32)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * (w x - cut) + ln(0.3 / 0.7)))), so that a text at the cut scores ``at``."""

    weights: np.ndarray
    cut: float = 0.0
    slope: float = 1.0
    at: float = 0.3

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.asarray(x, np.float64) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw - self.cut) + np.log(self.at / (1 - self.at)), -30, 30)))


def bradley_terry(x: np.ndarray, better: np.ndarray, worse: np.ndarray, l2: float = 1e-4, steps: int = 200) -> np.ndarray:
    """Weights w by which better beats worse with likelihood 1 / (1 + exp(-w (x_better - x_worse))): accelerated descent."""
    mean, dev = x.mean(0), x.std(0) + 1e-3
    z = ((x - mean) / dev / np.sqrt(x.shape[1])).astype(np.float64)
    w = v = np.zeros(x.shape[1])
    rate = 1.0 / (0.25 * 4 * float((z * z).sum(1).max()) + l2)
    n = len(better)
    for i in range(steps):
        s = z @ v
        p = 1 / (1 + np.exp(np.clip(s[better] - s[worse], -30, 30)))
        # the differences' gradient, gathered by text so that no table of pairs is made
        pull = np.bincount(better, p, len(z)) - np.bincount(worse, p, len(z))
        new = v + rate * (pull @ z / n - l2 * v)
        v, w = new + i / (i + 3) * (new - w), new
    return w / dev / np.sqrt(x.shape[1])


def preference_pairs(y: np.ndarray, most: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` pairs (row of label 1, row of label 0); each row of the rarer label is in as many as of the other sort can be dealt."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(seed)
    n = min(most, len(good) * len(bad))
    rounds = -(-n // max(len(good), len(bad)))
    pick = lambda a: np.concatenate([np.resize(rng.permutation(a), max(len(good), len(bad))) for _ in range(rounds)])[:n]
    return pick(good), pick(bad)


def quantile_cut(raw: np.ndarray, weight: np.ndarray, share: float) -> float:
    """The middle between the two scores between which ``share`` of the weight is passed."""
    order = np.argsort(raw, kind="stable")
    passed = np.cumsum(weight[order]) / weight.sum()
    i = int(np.searchsorted(passed, share - 1e-9))
    i = min(i, len(raw) - 2)
    return float((raw[order[i]] + raw[order[i + 1]]) / 2)


def fit(x: np.ndarray, y: np.ndarray, pairs: int = 40_000, folds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """A part's weights, of unit spread between its deciles, and the loss of each of SLOPES over scores under weights that were learned without the scored text."""
    weights = bradley_terry(x, *preference_pairs(y, pairs))
    fold = np.zeros(len(y), int)
    for label in (0, 1):
        at = np.flatnonzero(y == label)
        fold[at] = np.arange(len(at)) % folds
    raw = np.zeros(len(y))
    share = float((y == 0).mean())
    for f in range(folds):
        learn = np.flatnonzero(fold != f)
        w = bradley_terry(x[learn], *preference_pairs(y[learn], pairs // folds))
        held = fold == f
        r = x[held] @ w
        raw[held] = (r - quantile_cut(r, np.ones(len(r)), share)) / _spread(r)
    return weights / _spread(x @ weights), _losses(raw, y)


def _spread(r: np.ndarray) -> float:
    return float(np.quantile(r, 0.9) - np.quantile(r, 0.1) + 1e-9)


def _losses(x: np.ndarray, y: np.ndarray, at: float = 0.3) -> np.ndarray:
    """The logistic loss of the scores under each slope."""
    sign = np.where(y > 0, 1.0, -1.0)
    return np.array([np.logaddexp(0, -sign * (s * x + np.log(at / (1 - at)))).sum() for s in SLOPES])


def train(
    docs: DataFrame,
    labels: DataFrame,
    part_rows: int = PART_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Model:
    """Learn from every labelled row that is not held out.

    The labelled texts are dealt into parts of about ``part_rows`` by a hash of the text, and each part's preference pairs take in all of its texts. The
    weights are the mean of the parts' weights, each of unit spread; the slope is that of the least loss over all parts; the cut is the exact quantile of
    all labelled texts' scores. Where a label is so rare that a part would hold under PART_RARE of its texts, each of them goes to several parts.
    So a task holds one part (about 9 kB a text), and 9 kB a part reach the driver.

    Copies of a text, which are those of equal SHA-256, count once. Labels whose id or value is null are left out; an id with both labels gives a row of each;
    without labels of both kinds all texts score alike.
    """
    d, i, y = fresh("d"), fresh("i"), "y"
    label = labels.select(F.col(id_col).alias(i), F.col(label_col).cast("int").alias(y)).filter(F.col(i).isNotNull() & F.col(y).isin(0, 1) & ~held_out(F.col(i))).distinct()
    kept = docs.filter(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias(d), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            # most trigrams are in no text, so a packed vector takes a few hundred bytes and goes to the labels in place of its text
            own = [zlib.compress(features.of(t.as_py()).tobytes(), 1) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(own, pa.binary())], [d, "t", "x"])

    packed = kept.select(d, "t", F.unhex(F.sha2("t", 256)).alias("h")).mapInArrow(vectors, f"{d} {docs.schema[id_col].dataType.simpleString()}, t binary, x binary")
    found = packed.join(label.hint("merge"), F.col(d) == F.col(i))
    rows = cut(found.groupBy("t").agg(F.max(y).alias(y), F.any_value("x").alias("x")).select(y, F.xxhash64("t").alias("h"), "x"))
    counts = {r[y]: r["n"] for r in rows.groupBy(y).agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = counts.get(0, 0), counts.get(1, 0)
    if min(bad, good) < 4:
        # one label only, or nearly: nothing to prefer by
        return Model(np.zeros(FEATURES), cut=-1.0 if good >= bad else 1.0)
    parts = -(-(bad + good) // part_rows)
    times = F.when(F.col(y) == int(good < bad), min(parts, -(-parts * PART_RARE // min(bad, good)))).otherwise(1)
    dealt = rows.withColumn("part", F.explode(F.sequence(F.lit(0), times - 1))).withColumn("part", F.pmod(F.pmod("h", F.lit(parts)) + F.col("part"), F.lit(parts)))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        own = sorted(zip(pdf["y"].tolist(), map(bytes, pdf["x"]), strict=True))
        labelled = np.array([v for v, _ in own], int)
        if min(labelled.sum(), len(own) - labelled.sum()) < 4:
            return pd.DataFrame({"w": [], "loss": []})
        weights, loss = fit(np.stack([_unpacked(v) for _, v in own]), labelled)
        return pd.DataFrame({"w": [weights.tobytes()], "loss": [loss.tolist()]})

    learned = sorted((bytes(r["w"]), r["loss"]) for r in dealt.groupBy("part").applyInPandas(learn, "w binary, loss array<double>").collect())
    weights = np.mean([np.frombuffer(w) for w, _ in learned], axis=0)
    slope = float(SLOPES[int(np.argmin(np.sum([loss for _, loss in learned], axis=0)))])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float(_unpacked(v.as_py()) @ weights) for v in b.column(0)], pa.float64())], ["own"])

    own = rows.select("x").mapInArrow(raw, "own double").withColumn("g", F.lit(0))
    most = bad + good - 1
    at = {"low": int(0.1 * most), "high": int(0.9 * most), "last": min(bad - 1, most - 1), "next": min(bad, most)}
    ranks = docs.sparkSession.createDataFrame([(0, r) for r in sorted({*at.values()})], "g int, rank long")
    value = {r["rank"]: r["own"] for r in at_ranks(own, ranks, "g", "own").collect()}
    middle = (value[at["last"]] + value[at["next"]]) / 2
    return Model(weights, middle, slope / (value[at["high"]] - value[at["low"]] + 1e-9))


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.float32)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row's whole text.

    Null and empty texts score as a text all of whose features are 0; null ids, repeated rows and ties are rows like
    any other; an empty table gives an empty result; other columns are ignored. A long text's characters are counted in
    parts of a million.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, features = shared.value, Features()
        for b in batches:
            x = np.stack([features.of(t.as_py()) for t in b.column(1)]) if b.num_rows else np.zeros((0, FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.score(x), pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return slim.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
