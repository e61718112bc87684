"""Toxicity: noisy-channel deobfuscation, then a score of the restored text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenlace.llm.common import fresh, table
from provenlace.llm.language_id import held_out

#: The model's letters: a blank, a-z, then the lower-case letters of Latin-1, oe and a long s's stand-in.
ALPHABET = " abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
N = len(ALPHABET)
INDEX = {c: i for i, c in enumerate(ALPHABET)}
#: What a character may stand for in disguised spelling.
DISGUISE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "¡": "i", "£": "l", "¢": "c",
}
LETTER = r"[^\W\d_]"
WORDS = re.compile(LETTER + "+")
#: A token that may be disguised: a letter with a stand-in or separator beside it, or a letter three times.
ODD = re.compile(rf"{LETTER}[0-9@$!|+€(¡£¢.*_\-]+{LETTER}|[0-9@$!|+€(¡£¢]+{LETTER}|{LETTER}[0-9@$|+€(¡£¢]|({LETTER})\1\1")
#: Four or more single letters or stand-ins with a separator between each two.
SPACED = re.compile(r"(?<![^\s])[^\W_](?:[ .\-_*]{1,2}[0-9@$!|+€(¡£¢a-zß-ÿœ]){3,}(?![^\s.,;:!?])")
PREFIXES = (4, 5, 6)
REMEMBERED = 500_000
COST = {"stand-in": 0.7, "lost": 6.0, "separator": 1.0, "repeat": 0.4}
#: What a mark counts, against the next heavier one of its text.
LESS = 0.5
#: Times as often as in other texts that a mark stands in toxic ones.
LEAST_RATIO = 10


def _codes(text: str) -> np.ndarray:
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _codes.map[np.minimum(chars, 0x3FF)]


_codes.map = np.zeros(0x400, np.int64)
for _c, _i in INDEX.items():
    _codes.map[ord(_c)] = _i


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of letter trigrams over all rows' whole texts, shape (N, N, N); at most N^3 numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N**3, np.int64)
        for b in batches:
            for t in b.column(0):
                text = (t.as_py() or "").lower()
                for i in range(0, len(text), 1 << 20):
                    c = np.concatenate([[0, 0], _codes(text[i : i + (1 << 20)]), [0]])
                    key = (c[:-2] * N + c[1:-1]) * N + c[2:]
                    total += np.bincount(key[(c[1:-1] > 0) | (c[2:] > 0)], minlength=N**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    sums = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(N**3)
    out[sums["k"].to_numpy(np.int64)] = sums["n"].to_numpy()
    return out.reshape(N, N, N)


def letter_model(counts: np.ndarray, words: list[str], share: float = 0.1) -> np.ndarray:
    """-ln P(c | a, b), smoothed; the given words make up ``share`` of all that is counted."""
    own = np.zeros_like(counts)
    for w in words:
        c = [0, 0, *(INDEX.get(x, 0) for x in w), 0]
        for a, b, x in zip(c, c[1:], c[2:], strict=False):
            own[a, b, x] += 1
    tri = counts / max(1.0, counts.sum()) * (1 - share) + own / max(1.0, own.sum()) * share
    bi, uni = tri.sum(0), tri.sum((0, 1))
    uni = (uni + 1e-6) / (uni + 1e-6).sum()
    bi = (bi + 1e-5 * uni) / (bi.sum(1, keepdims=True) + 1e-5)
    tri = (tri + 1e-6 * bi[None]) / (tri.sum(2, keepdims=True) + 1e-6)
    return -np.log(tri)


def decode(seen: str, cost: list, slack: float | None = None) -> str:
    """The likeliest text behind ``seen`` (lower case): a Viterbi search over letters.

    Each character stands for itself, for what DISGUISE says, or for nothing: separators and
    stand-ins may be noise, a letter may repeat the one before it. A state is the last two letters.
    States dearer than the cheapest by more than ``slack`` are left: whatever follows, the cheapest
    may take the same letters and is in the same state two of them later, so with three times the dearest
    trigram (the default) none of them can win.
    """
    slack = 3 * max(map(max, map(max, cost))) if slack is None else slack
    # a text is its last letter and the text before it, so that long tokens share what they begin with
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    before = ""
    for ch in seen:
        ways = [(INDEX[ch], 0.0)] if ch in INDEX and ch != " " else []
        ways += [(INDEX[c], COST["stand-in"]) for c in DISGUISE.get(ch, "")]
        nothing = COST["repeat"] if ch == before and ways else COST["lost"] if ch in DISGUISE else COST["separator"] if not ch.isalpha() else None
        if not ways and nothing is None:
            ways = [(0, 0.0)]
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (paid, text) in states.items():
            row = cost[a][b]
            for i, extra in ways:
                new = paid + extra + row[i]
                if (b, i) not in after or new < after[b, i][0]:
                    after[b, i] = (new, (text, i))
            if nothing is not None:
                new = paid + nothing
                if (a, b) not in after or new < after[a, b][0]:
                    after[a, b] = (new, text)
        most = min(x[0] for x in after.values()) + slack
        states, before = {k: x for k, x in after.items() if x[0] <= most}, ch
    text = min(((paid + cost[a][b][0], text) for (a, b), (paid, text) in states.items()), key=lambda x: x[0])[1]
    letters = []
    while text is not None:
        text, i = text
        letters.append(ALPHABET[i])
    return "".join(reversed(letters))


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    slope: float = 1.0
    bias: float = -3.0
    cost: np.ndarray | None = None


class Reader:
    """Finds the marks of a model's weights in texts. Of each word the heaviest mark counts."""

    def __init__(self, model: Model):
        self.weights = model.weights
        self.cost = None if model.cost is None else model.cost.tolist()
        self.slack = None if model.cost is None else 3 * float(model.cost.max())
        self.whole = [w for w in model.weights if len(w) > 3 and not w.endswith("*")]
        self.known: dict[str, tuple[str, ...]] = {}

    def word(self, w: str) -> str | None:
        marks = [m for m in (w, *(w[:k] + "*" for k in PREFIXES if len(w) > k)) if m in self.weights]
        return max(marks, key=self.weights.__getitem__) if marks else None

    def restored(self, seen: str) -> list[str]:
        return decode(seen, self.cost, self.slack).split() if self.cost is not None else []

    def token(self, raw: str) -> tuple[str, ...]:
        low = raw.lower()
        words = WORDS.findall(low)
        if ODD.search(low):
            words += self.restored(low.strip(".,;:?\"'`)]}>([{<-_*!")) + self.restored(low.strip(".,;:?\"'`)]}>[{<-_*"))
        return tuple({m for w in words if (m := self.word(w))})

    def marks(self, text: str) -> set[str]:
        tokens = set(text.split())
        if missing := tokens.difference(self.known):
            if len(self.known) > REMEMBERED:
                self.known.clear()
                missing = tokens
            self.known.update((t, self.token(t)) for t in missing)
        found = {m for t in tokens for m in self.known[t]}
        for spaced in SPACED.finditer(text.lower()):
            # where a run of spaced letters begins and ends is open, so marks may stand inside it
            run = "".join(self.restored(spaced[0]))
            found.update(w for w in self.whole if w in run)
        return found

    def evidence(self, text: str | None) -> float:
        """The weights of all marks, heaviest first, each counting LESS than the one before: long texts gain little by their length."""
        return float(sum(w * LESS**i for i, w in enumerate(sorted(map(self.weights.__getitem__, self.marks(text or "")), reverse=True))))


def _fit_line(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic regression on one number: Newton steps, halved until the loss falls."""
    z = np.stack([x, np.ones_like(x)], axis=1)
    near = np.array([1.0, -3.0])
    sign = np.where(y > 0, 1.0, -1.0)
    loss = lambda w: float(weight @ np.logaddexp(0, -sign * (z @ w)) + 5e-3 * ((w - near) ** 2).sum())
    w = near
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + 1e-2 * (w - near)
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        step, now = np.linalg.solve(h, g), loss(w)
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return float(max(0.05, w[0])), float(w[1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    rows_per_class: int = 6000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Learn marks, their weights and a calibration on about ``rows_per_class`` labelled rows a class.

    That number is the documented bound of the labelled sample, which a hash of the id draws from
    the rows that are not held out. Marks are words and word beginnings that stand in many
    toxic and hardly any other texts of the sample. For the calibration, marks learned from each half of
    the sample score the other half, so that all of it serves both. Copies count once. The letter model
    counts the trigrams of all rows' whole texts. Without labels of both kinds, the model has no marks. Labels
    whose id or value is null are left out; an id with both labels gives a row of each.
    """
    label = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y")).filter("y IS NOT NULL AND __id IS NOT NULL").distinct()
    counts = {r["y"]: r["n"] for r in label.filter(~held_out(F.col("__id"))).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(1) or not counts.get(0):
        return Model()
    draw = F.pmod(F.xxhash64(F.lit(5), "__id"), F.lit(1_000_000))
    share = {y: min(1.0, rows_per_class / n) for y, n in counts.items()}
    picked = F.when(F.col("y") == 1, draw < int(1_000_000 * share[1])).otherwise(draw < int(1_000_000 * share[0]))
    # the drawn labels are bounded, so they go to the texts and no text is shuffled to find them
    drawn = F.broadcast(label.filter(~held_out(F.col("__id"))).filter(picked))
    rows = docs.select(F.col(id_col).alias("__d"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    sample = rows.join(drawn, F.col("__d") == F.col("__id")).select("t", "y", F.pmod(F.xxhash64("t"), F.lit(2)).cast("int").alias("half"))
    texts = sample.groupBy("t").agg(F.max("y").alias("y"), F.max("half").alias("half"))  # copies count once

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, y, half in zip(b.column(0), b.column(1), b.column(2), strict=True):
                words = set(WORDS.findall(t.as_py().lower()))
                marks = [*words, *{w[:k] + "*" for w in words for k in PREFIXES if len(w) > k}]
                told = [pa.array([x.as_py()] * len(marks), pa.int32()) for x in (y, half)]
                yield pa.RecordBatch.from_arrays([pa.array(marks, pa.string()), *told], ["m", "y", "half"])

    n = {(r["y"], r["half"]): r["n"] for r in texts.groupBy("y", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    times = [F.sum(F.when((F.col("y") == y) & (F.col("half") == h), 1).otherwise(0)).alias(f"n{y}{h}") for y in (0, 1) for h in (0, 1)]
    told = texts.mapInArrow(features, "m string, y int, half int").groupBy("m").agg(*times)
    kinds = [((0,), "first"), ((1,), "second"), ((0, 1), "all")]
    ratios = []
    for halves, name in kinds:
        n1, n0 = (sum(n.get((y, h), 0) for h in halves) + 1 for y in (1, 0))
        bad, good = (sum((F.col(f"n{y}{h}") for h in halves), F.lit(0)) for y in (1, 0))
        # rates that are held with some certainty: a standard deviation against the mark
        ratio = ((bad - F.sqrt(bad) + 0.5) / n1) / ((good + F.sqrt(good + 1) + 0.5) / n0)
        ratios.append(F.when((bad >= max(2, round(0.01 * n1))) & (ratio > LEAST_RATIO), F.log(ratio)).alias(name))
    # a mark stands in a hundredth of the toxic sample at least, so there are few of them
    found = told.select("m", *ratios).filter("first IS NOT NULL OR second IS NOT NULL OR `all` IS NOT NULL").collect()
    weights = {name: {r["m"]: r[name] for r in found if r[name] is not None} for _, name in kinds}
    cost = letter_model(trigram_counts(docs, text_col), [m for m in weights["all"] if not m.endswith("*")])
    model = Model(weights["all"], cost=cost)
    shared = docs.sparkSession.sparkContext.broadcast((weights["second"], weights["first"], cost))

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *other, letters = shared.value
        readers = [Reader(Model(w, cost=letters)) for w in other]
        for b in batches:
            x = [readers[h.as_py()].evidence(t.as_py()) for t, h in zip(b.column(0), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), b.column(1)], ["x", "y"])

    other = texts.select("t", "y", "half").mapInArrow(evidence, "x double, y int").toPandas()
    x, y = other["x"].to_numpy(float), other["y"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return model
    model.slope, model.bias = _fit_line(x, y, np.where(y == 1, 1 / share[1], 1 / share[0]) / max(1 / share[1], 1 / share[0]))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a score (0 to 1) of every row's whole text; null and empty texts score as ones without marks.

    Null ids, repeated rows and ties are rows like any other; an empty table gives an empty
    result; all columns are kept, one named like ``out`` is replaced. Disguised tokens (stand-ins,
    separators, repeated or spaced letters) are decoded first, and both what stands there and what
    is restored count.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop(out)
    names = rows.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        reader = Reader(m)
        for b in batches:
            x = np.array([reader.evidence(t.as_py()) for t in b.column(at)])
            p = 1 / (1 + np.exp(-np.clip(m.slope * x + m.bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*names, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, `{out}` double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **how) -> DataFrame:
    """docs without the rows that score ``threshold`` or more under a model learned from docs and labels.

    Rows with null ids or texts, empty texts, repeated rows and ties are scored like any other, and all rows of a clean
    text stay; empty labels drop nothing; an empty table stays empty; all columns are kept.
    """
    out = fresh("toxicity")
    return score(docs, train(docs, labels, **how), out=out).filter(F.col(out) < threshold).drop(out)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
