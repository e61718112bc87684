"""Learned operators and the pipeline's stages: exact decoding, training, flushes, odd rows."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest

import corpus_pipeline
from provenlace.llm import language_id, mixing, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n int, h string, th string, id string, score double"
ODD = [
    (1, "same text here", "en", "a", 1, "x", "y", "z", 0.1),
    (2, "same text here", "en", "a", None, None, None, None, None),
    (2, "same text here", "en", "a", None, None, None, None, None),
    (3, None, None, None, 1, "x", "y", "z", 0.1),
    (4, "", "fr", "b", 1, "x", "y", "z", 0.1),
    (None, " \t\n\n", "fr", None, 1, "x", "y", "z", 0.1),
    (5, "word and more " * 30000, "en", "b", 1, "x", "y", "z", 0.1),
]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def every_reading(seen, cost):
    """(cost, text) of the cheapest of all readings, by trying each."""
    ways = []
    before = ""
    for ch in seen:
        here = [(ch, 0.0)] if ch in toxicity.INDEX and ch != " " else []
        here += [(c, toxicity.COST["stand-in"]) for c in toxicity.DISGUISE.get(ch, "")]
        if ch == before and here:
            here.append(("", toxicity.COST["repeat"]))
        elif ch in toxicity.DISGUISE:
            here.append(("", toxicity.COST["lost"]))
        elif not ch.isalpha():
            here.append(("", toxicity.COST["separator"]))
        ways.append(here or [(" ", 0.0)])
        before = ch
    best = (math.inf, "")
    for path in itertools.product(*ways):
        text, paid, a, b = "", 0.0, 0, 0
        for c, extra in path:
            paid += extra
            if c:
                i = toxicity.INDEX[c]
                paid, a, b, text = paid + cost[a][b][i], b, i, text + c
        best = min(best, (paid + cost[a][b][0], text))
    return best


def test_decoding_is_exact():
    rng = random.Random(4)
    counts = np.random.default_rng(1).integers(0, 9, (toxicity.N,) * 3).astype(float)
    cost = toxicity.letter_model(counts, ["idiot", "blarg"]).tolist()
    for _ in range(60):
        seen = "".join(rng.choice("abio014!|$.-_z") for _ in range(rng.randrange(1, 8)))
        paid, text = every_reading(seen, cost)
        got = toxicity.decode(seen, cost)
        assert got == text or abs(every_reading(seen, cost)[0] - paid) < 1e-9 and len(got) <= len(seen), seen
    long = toxicity.decode("b1a" * 20000, cost)  # neither slow nor deep
    assert len(long) > 1000


def test_toxicity_learns_words_and_their_disguises(spark):
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in ("tan", "mir", "sol", "ver") for b in ("do", "ka", "li") for c in ("n", "s", "ta")]
    bad = ["blargo", "snorkus", "frumpel"]
    hide = {"blargo": "bl4rg0", "snorkus": "s.n.o.r.k.u.s", "frumpel": "frrrumpel"}
    rows, labels = [], []
    for i in range(600):
        text, toxic = [rng.choice(words) for _ in range(40)], i % 6 == 0
        if toxic:
            text[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, " ".join([*words[:20], hide[bad[i % 3]], *words[20:]])) for i in range(6)]
    rows += [(2000, None), (2001, ""), (None, "blargo and blargo")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels += [(None, 1, 1), (5, None, None)]
    model = toxicity.train(docs, spark.createDataFrame(labels, LABELS))
    got = {r.doc_id: r.score >= 0.7 for r in toxicity.score(docs, model).collect()}
    assert all(got[i] == (i % 6 == 0) for i in range(600))
    assert all(got[1000 + i] for i in range(6)) and not got[2000] and not got[2001] and got[None]
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert kept == {i for i, toxic in got.items() if not toxic}


def test_toxicity_without_labels_and_odd_rows(spark, odd, none):
    no_labels = spark.createDataFrame([], LABELS)
    for docs in (odd, none):
        kept = toxicity.drop_toxic(docs, no_labels)
        assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity.drop_toxic(none, spark.createDataFrame([(1, 1, 1), (2, 1, 0)], LABELS)).count() == 0


def test_language_id_flushes(spark):
    """A long last text, a batch that ends just as its texts have been worked on, and no rows."""
    de, fr = "der hund und die katze sind nicht allein ", "le chien et le chat ne sont pas seuls "
    learn = [(i, (de if i % 2 else fr) * (1 + i % 5), "de" if i % 2 else "fr") for i in range(60)]
    model = language_id.train(spark.createDataFrame(learn, "doc_id long, text string, lang string"))
    for sizes in ([10, 1_100_000], [600_000, 600_000], [1_100_000, 10, 1_100_000], []):
        rows = [(i, (de if i % 2 else fr) * (n // 38 + 1)) for i, n in enumerate(sizes)]
        got = language_id.predict(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), model).collect()
        assert {r.doc_id: r.lang_pred for r in got} == {i: "de" if i % 2 else "fr" for i in range(len(sizes))}


def test_simhash_components_odd_rows(odd, none):
    rows = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.simhash_components(odd).collect())
    assert len(rows) == len(ODD) and len({r[1] for r in rows if r[0] in (1, 2)}) == 1
    assert {r[2] for r in rows if r[1] == "0" * 16} == {3}
    assert simhash.simhash_components(none).count() == 0


def test_mixed_rows_odd_rows(odd, none):
    kept = mixing.mixed_rows(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id IN (3, 4)").count() == 0
    assert mixing.mixed_rows(none).count() == 0


def test_stages_keep_clean_rows(spark, odd):
    """No labels of both kinds, no benchmark passage: toxicity and decontamination drop nothing, near-dedup only copies."""
    sf = "/root/testdata/sf0.001"
    docs = spark.createDataFrame([(i, f"row {i} " + " ".join(f"w{i}x{j}" for j in range(30)), "en", "s", 9) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars int")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, sf)
        assert sorted(out.columns) == sorted(docs.columns), name
        assert {r.doc_id for r in out.collect()} == set(range(40)), name
