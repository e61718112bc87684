"""Language ID: family first, then one-versus-one linear SVMs inside the family."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenlace.llm.common import table

WIDTH = 4096
#: Characters whose n-grams are held at a time.
HELD = 1 << 20
#: Language families by ISO 639-1 code; any other code is a family of its own.
FAMILIES = {
    "germanic": ("de", "en", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "indo-aryan": ("hi", "bn", "ur", "mr", "ne", "pa", "gu", "si"),
    "semitic": ("ar", "he", "am", "mt"),
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}


def held_out(id_col: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class NGrams:
    """Hashed letter bigrams and trigrams of texts, blanks standing for all other characters."""

    def __init__(self) -> None:
        self.letter = _letters()

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes (n, 2), the text each row of them belongs to, and the letters of each text."""
        lower = [t.lower() for t in texts]
        chars = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(lower)), np.fromiter((len(t) + 1 for t in lower), np.int64, len(lower)))
        if not lower:
            return np.zeros((0, 2), np.uint32), owner, np.zeros(0, np.int64)
        is_letter = self.letter[chars]
        letters = np.bincount(owner[is_letter], minlength=len(lower))
        before = np.concatenate([[False], is_letter[:-1]])
        keep = is_letter | before
        c, who = np.where(is_letter, chars, 32)[keep].astype(np.uint32), owner[keep]
        p = np.concatenate([np.array([32, 32], np.uint32), c])
        two = (p[1:-1] * np.uint32(2654435761) + p[2:] * np.uint32(2246822519)) >> np.uint32(9)
        three = (two + p[:-2] * np.uint32(3266489917)) * np.uint32(668265263) >> np.uint32(11)
        return np.stack([two % (WIDTH // 4), WIDTH // 4 + three % (WIDTH - WIDTH // 4)], axis=1), who, letters

    def profile(self, text: str) -> np.ndarray:
        """Shares of the n-grams in the text, in parts of bounded size."""
        total = np.zeros(WIDTH)
        for i in range(0, len(text), HELD):
            h, _, _ = self.of([text[i : i + HELD]])
            total += np.bincount(h.ravel(), minlength=WIDTH)
        return (total / max(1.0, total.sum())).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM (squared hinge, both classes weighing the same)."""
    mean, dev = x.mean(0), x.std(0) + 1e-4
    z = (x - mean) / dev / np.sqrt(x.shape[1])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    b = vb = 0.0
    rate = 1.0 / (2.0 * (1.0 + float((z * z).sum(1).max())) + l2)
    for i in range(steps):
        slack = np.maximum(0.0, 1.0 - y * (z @ v + vb)) * weight * y
        w_new, b_new = v + rate * (2 * slack @ z - l2 * v), vb + rate * 2 * float(slack.sum())
        push = i / (i + 3)
        v, vb = w_new + push * (w_new - w), b_new + push * (b_new - b)
        w, b = w_new, b_new
    w = w / dev / np.sqrt(x.shape[1])
    return w.astype(np.float64), float(b - w @ mean)


@dataclass
class Model:
    """Columns of weights: one per family (against the rest), then one per pair of a family's languages."""

    families: list[list[str]]
    pairs: list[list[tuple[int, int, int]]]
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, margins: np.ndarray) -> tuple[str, float]:
        squash = lambda m: 1.0 / (1.0 + np.exp(-np.clip(2.0 * m, -30, 30)))
        n = len(self.families)
        family = int(np.argmax(margins[:n])) if n > 1 else 0
        sure = float(squash(margins[family])) if n > 1 else 1.0
        langs = self.families[family]
        won = np.zeros(len(langs))
        for a, b, column in self.pairs[family]:
            p = float(squash(margins[column]))
            won[a] += p
            won[b] += 1.0 - p
        best = int(np.argmax(won))
        return langs[best], sure * (won[best] / (len(langs) - 1) if len(langs) > 1 else 1.0)


def fit(rows: list[tuple[str, np.ndarray]]) -> Model:
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return Model([["und"]], [[]], np.zeros((WIDTH, 1)), np.zeros(1))
    names = sorted({FAMILY.get(x, x) for x in langs})
    families = [[x for x in langs if FAMILY.get(x, x) == f] for f in names]
    x = np.stack([v for _, v in rows])
    lang = np.array([v for v, _ in rows])
    family = np.array([names.index(FAMILY.get(v, v)) for v in lang])
    columns = []
    for f in range(len(names)):
        columns.append(linear_svm(x, np.where(family == f, 1.0, -1.0).astype(np.float32)) if len(names) > 1 else (np.zeros(WIDTH), 0.0))
    pairs: list[list[tuple[int, int, int]]] = []
    for members in families:
        pairs.append([])
        for a, b in combinations(range(len(members)), 2):
            pick = (lang == members[a]) | (lang == members[b])
            pairs[-1].append((a, b, len(columns)))
            columns.append(linear_svm(x[pick], np.where(lang[pick] == members[a], 1.0, -1.0).astype(np.float32)))
    return Model(families, pairs, np.stack([w for w, _ in columns], axis=1), np.array([b for _, b in columns]))


def train(
    docs: DataFrame,
    rows_per_language: int = 600,
    most_rows: int = 4800,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model:
    """Fit on about ``rows_per_language`` rows of each language, about ``most_rows`` in all (the documented bounds of the sample).

    Only rows that are not held out and have a text and a language; which of them is decided by a
    hash of the id. The driver gets a vector of 4096 numbers for each of these rows, 80 MB at most.
    """
    usable = docs.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return fit([])
    rows_per_language = min(rows_per_language, most_rows / len(counts))
    draw = F.pmod(F.xxhash64(F.lit(6), id_col, F.length(text_col)), F.lit(1_000_000))
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col(lang_col) == lang, int(1_000_000 * min(1.0, rows_per_language / n))).otherwise(share)
    sample = usable.filter(draw < share).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = NGrams()
        for b in batches:
            out = [grams.profile(t.as_py()).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["lang", "v"])

    found = sample.mapInArrow(vectors, "lang string, v binary").collect()
    return fit([(r["lang"], np.frombuffer(bytes(r["v"]), np.float32)) for r in found])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every row's whole text.

    und with score 0 where the text is null or has no letter. Null ids and repeated rows are rows
    like any other; an empty table gives an empty result; further columns are ignored. A long
    text is worked on in parts of a million characters whose n-grams are summed up.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, grams = shared.value, NGrams()
        weights = m.weights.astype(np.float32)

        def margins(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, who, letters = grams.of(texts)
            total = np.zeros((len(texts), weights.shape[1]))
            if len(who):
                each = weights[h[:, 0]] + weights[h[:, 1]]
                first = np.flatnonzero(np.diff(who, prepend=-1))
                total[who[first]] = np.add.reduceat(each, first, axis=0, dtype=np.float64)
            return total, 2 * np.bincount(who, minlength=len(texts)), letters

        for b in batches:
            ids, col = b.column(0), b.column(1)
            lang, score = [], []

            def settle(texts: list[str]) -> None:
                total, n, letters = margins(texts)
                for row, count, any_letter in zip(total, n, letters, strict=True):
                    if not any_letter:
                        lang.append("und")
                        score.append(0.0)
                    else:
                        name, p = m.predict(row / count + m.bias)
                        lang.append(name)
                        score.append(p)

            held, size = [], 0
            for t in col:
                text = t.as_py() or ""
                if len(text) > HELD:
                    settle(held)
                    held, size = [], 0
                    parts = [margins([text[i : i + HELD]]) for i in range(0, len(text), HELD)]
                    total, n, letters = (sum(p[k] for p in parts) for k in range(3))
                    name, p = m.predict(total[0] / n[0] + m.bias) if letters[0] else ("und", 0.0)
                    lang.append(name)
                    score.append(p)
                    continue
                held.append(text)
                size += len(text)
                if size > HELD:
                    settle(held)
                    held, size = [], 0
            settle(held)
            yield pa.RecordBatch.from_arrays([ids, pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return slim.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
