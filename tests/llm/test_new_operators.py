"""Divergence, tokenizer alignment and quality against brute force; stages with clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from provenlace.llm import alignment, decontaminate, divergence, mixing, quality, sharding, simhash, toxicity
from tests.llm.test_models import LABELS, ODD, SCHEMA
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# divergence


def terms_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if "a" <= c <= "z" or ord(c) >= 0x80 else " " for c in low).split(" ")


def divergence_by_hand(rows, top):
    rows = [(lang or "", source or "", [t for t in terms_of(text) if t]) for _, text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        df = Counter(t for x, _, ts in rows if x == lang for t in set(ts))
        kept = [t for t, n in df.items() if n >= 3]
        count = {}
        for x, s, ts in rows:
            if x == lang:
                count.setdefault(s, Counter()).update(t for t in ts if df[t] >= 3)
        whole = sum(count.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        for s, c in count.items():
            pairs = [(o, sum((share(c, t) - share(count[o], t)) ** 2 // share(count[o], t) for t in kept)) for o in count if o != s]
            over = [(t, (share(c, t) - share(whole, t)) ** 2 // share(whole, t)) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, items in (("pair", pairs), ("term", over)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_divergence_by_hand(spark, monkeypatch, broadcast):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", broadcast)
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "SLICE", 40)
    rng = random.Random(3)
    words = ["the", "The", "THE", "été", "ÉTÉ", "x1y", "a_b", "Straße", "日本", "don't", " nbsp", "zero\x00byte"] + [f"w{chr(97 + i)}" for i in range(15)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "Ä", None])) for i in range(120)]
    rows += [(None, None, "en", "only"), (7, "", "fr", "s1"), (8, "lonely words", "fr", "s2"), (9, "alone", "it", "s1"), rows[0], rows[0]]
    got = divergence.divergence(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3), top_terms=4).collect()
    assert sorted(tuple(r) for r in got) == divergence_by_hand(rows, 4)
    assert {r.value for r in got if r.lang == "fr"} == {0} and not [r for r in got if r.lang == "it"]


def test_divergence_odd_rows_and_oracle(spark, odd, none):
    want = divergence_by_hand([(r[0], r[1], r[2], r[3]) for r in ODD], 200)
    assert sorted(tuple(r) for r in divergence.divergence(odd).collect()) == want
    assert divergence.divergence(none).count() == 0
    assert_same(divergence.op11_source_divergence(spark, SF), divergence.SQL, SF)


# alignment


@pytest.fixture(scope="module")
def files():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return a.read(), b.read()


def align_by_hand(rows, both):
    """Whole texts through the libraries, all pairs of tokens compared by their byte ranges."""
    found = []
    for i, text in rows:
        a = both.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        if text and not both.faithful(" " + text, a, b):
            a, b = [], []
        spans = []
        for ids, raw in ((a, both.a_bytes), (b, both.b_bytes)):
            ends = list(itertools.accumulate(len(raw[x]) for x in ids))
            spans.append(list(zip([0, *ends], ends, ids, strict=False)))
        links = [(x, y) for s, e, x in spans[0] for t, f, y in spans[1] if s < f and t < e]
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = ["|".join(",".join(str(x) for s, e, x in side if lo <= s and e <= hi) for side in spans) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        found.append((i, a, b, links, groups))
    n = Counter(link for f in found for link in f[3])
    top = {}
    for (_, y), c in n.items():
        top[y] = max(top.get(y, 0), c)
    out = []
    for i, a, b, links, groups in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(n[x] == top[x[1]] for x in links), sum(n[x] for x in links), digest))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("block", [300, 8 << 20])
def test_alignment_by_hand(spark, monkeypatch, files, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "SLICE", 40)
    rng = random.Random(12)
    bits = [" ", "  ", "\n", " \n ", "\t", "a", "Ba", " word", "word", "é", "日本", "😀", "▁", "<|endoftext|>", "<s>", "<0x41>", "1234", "don't", "'s", "..."]
    bits += ["　", "\x1c", "\x85", "​", "_", "ß", " ", "᠎", "\x00"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randrange(25)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, " "), (503, "x "), (504, "ab" * 200), (505, " " * 70), rows[1], rows[1]]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), *files).collect()
    assert in_order(tuple(r) for r in got) == in_order(align_by_hand(rows, alignment.Tokenizers(*files)))


def test_alignment_odd_rows(odd, none, files):
    rows = [(r[0], r[1] if r[0] != 5 else r[1][:0]) for r in ODD]
    got = alignment.align(odd.filter("doc_id IS NULL OR doc_id <> 5"), *files).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(r) for r in align_by_hand(rows, alignment.Tokenizers(*files)) if r[0] != 5)
    long = alignment.align(odd.filter("doc_id = 5"), *files).first()
    assert long.n_links >= max(long.n_a, long.n_b) > 80_000
    assert alignment.align(none, *files).count() == 0


def test_bits_rank():
    rng = np.random.default_rng(1)
    for size in (1, 63, 64, 65, 1000):
        flags = rng.random(size) < 0.3
        bits = alignment.Bits.of(np.flatnonzero(flags), size)
        assert bits.positions().tolist() == np.flatnonzero(flags).tolist()
        assert bits.rank(np.arange(size + 1)).tolist() == [int(flags[:i].sum()) for i in range(size + 1)]


# quality


def test_bradley_terry_gradient_is_that_of_all_pairs():
    """The weights are where the plain pairwise loss, written with a table of differences, is least."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3))
    y = (x @ [2.0, -1.0, 0.0] + rng.normal(size=40) > 0).astype(int)
    good, bad = (a.ravel() for a in np.meshgrid(np.flatnonzero(y == 1), np.flatnonzero(y == 0)))
    w = quality.bradley_terry(x, good, bad, l2=1e-3, steps=4000)
    dev = x.std(0) + 1e-3
    loss = lambda w: np.logaddexp(0, -((x[good] - x[bad]) @ w)).mean() + 5e-4 * ((w * dev * np.sqrt(3)) ** 2).sum()
    assert all(loss(w) <= loss(w + d) + 1e-9 for d in 0.05 * np.vstack([np.eye(3), -np.eye(3)]))


def test_preference_pairs_and_quantile():
    y = np.array([1] * 7 + [0] * 2)
    good, bad = quality.preference_pairs(y, 100)
    assert len(good) == 14 and set(good) == set(range(7)) and set(bad) == {7, 8}
    assert quality.quantile_cut(np.array([3.0, 1.0, 2.0, 4.0]), np.ones(4), 0.5) == 2.5
    assert quality.quantile_cut(np.array([3.0, 1.0, 2.0, 4.0]), np.array([1, 3, 1, 1.0]), 0.5) == 1.5


def test_quality_learns_and_odd_rows(spark, odd, none):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("tan", "mir", "sol", "ver", "ud") for b in ("do", "ka", "li", "en")]
    rows, labels = [], []
    for i in range(300):
        good = i % 5 != 0
        text = [rng.choice(words) for _ in range(30)]
        rows.append((i, " ".join(text if good else [w + "$$#" for w in text])))
        labels.append((i, int(good), 0))
    labels += [(None, 1, 0), (3, None, 0), (4, 2, 0)]
    rows += [(900, None), (901, ""), (None, "tando mirka solli")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame(labels, LABELS))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all((got[i] >= 0.3) == (i % 5 != 0) for i in range(300))
    assert len(got) == 303 and all(0 <= s <= 1 for s in got.values())
    blind = quality.train(odd, spark.createDataFrame([(1, 1, 0)], LABELS))
    assert {round(r.score, 6) for r in quality.score(odd, blind).collect()} == {round(1 / (1 + np.exp(-(1 + np.log(3 / 7)))), 6)}
    assert quality.score(none, model).count() == 0
    a, b = "fine words here. " * 100_000, quality.Features()
    monkey, quality.HELD = quality.HELD, 1 << 30
    whole = b.of(a)
    quality.HELD = monkey
    assert np.allclose(b.of(a), whole)


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op13_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(got) > 50 and sum(r.predicted == r.quality for r in got) >= 0.97 * len(got)


# stages


CLASH = "__th __id __own __bad __n __i __s __toxicity __d score id th t fp nid own size shard slot k".split()


def test_stages_keep_clashing_columns(spark):
    """Columns of every helper name come through unharmed."""
    text = lambda i: f"row {i} " + " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(i, text(i), "en", "s", 9, *[f"{c}{i}" for c in CLASH]) for i in range(30)] + [(99, text(1), "en", "s", 9, *[f"{c}99" for c in CLASH])]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in CLASH)
    docs = spark.createDataFrame(rows, schema)
    by_id = {r.doc_id: r for r in docs.collect()}
    for f in (
        lambda d: toxicity.drop_toxic(d, spark.createDataFrame([(1, 1, 1), (3, 1, 0), (5, 1, 1), (8, 1, 0)], LABELS)),
        simhash.drop_near_duplicates,
        lambda d: decontaminate.decontaminate(d, spark.createDataFrame([(1, text(3))], "item_id long, text string")),
        mixing.mixed_rows,
    ):
        out = f(docs)
        assert sorted(out.columns) == sorted(docs.columns)
        kept = out.collect()
        assert len(kept) > 20 and all(r.asDict() == by_id[r.doc_id].asDict() for r in kept)
    out = sharding.sharded_rows(docs, 4).collect()
    new = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    assert all({k: v for k, v in r.asDict().items() if k not in new} == {k: v for k, v in by_id[r.doc_id].asDict().items() if k not in new} for r in out)
    assert sorted((r.shard, r.slot) for r in out) == [(s, i) for s in range(4) for i in range(8 if s < 3 else 7)]


def test_pipeline_keeps_texts(spark):
    got = corpus_pipeline.run(spark, SF)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = got.collect()
    assert {"doc_id", "text", "lang", "source", "shard", "slot"} <= set(got.columns)
    assert rows and all((r.text, r.lang, r.source) == (docs[r.doc_id].text, docs[r.doc_id].lang, docs[r.doc_id].source) for r in rows)
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)


def linked(prints, radius):
    root = dict(zip(prints, prints, strict=True))
    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= radius and root[a] != root[b]:
            old = root[b]
            root = {k: root[a] if r == old else r for k, r in root.items()}
    return {frozenset(k for k, r in root.items() if r == v) for v in root.values()}


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_links_at_smaller_radius(spark, monkeypatch, radius):
    monkeypatch.setattr(simhash, "SMALL", 2)
    prints = sorted({sum(1 << b for b in bits) for bits in itertools.combinations(range(0, 40, 5), 2)} | {1 << b for b in range(0, 40, 5)} | {0, 1 << 50, 3 << 50})
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    links = {(r.a, r.b) for r in simhash.links_within(nodes, radius).collect()}
    root = {p: p for p in prints}
    for a, b in links:
        old = root[b]
        root = {k: root[a] if r == old else r for k, r in root.items()}
    assert {frozenset(k for k, r in root.items() if r == v) for v in root.values()} == linked(prints, radius)


@pytest.mark.parametrize("rare", [300, 6])
def test_quality_learns_from_every_labelled_row(spark, monkeypatch, rare):
    """Every text is in some part and in its pairs, with a rare label in several; bad rows of one kind, ever so few, change the model."""
    monkeypatch.setattr(quality, "PART_RARE", 20)
    rng = random.Random(9)
    text = lambda end: " ".join(rng.choice(["tan", "mir", "sol", "ver"]) + rng.choice(["do", "ka"]) + end for _ in range(20))
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 5][:1500]
    docs = [(i, text("$$#" if n < rare else "")) for n, i in enumerate(ids)]
    labels = [(i, int(n >= rare), 0) for n, i in enumerate(ids)]
    seen = spark.sparkContext.accumulator(0)
    plain = quality.fit

    def fit(x, y, *more):
        seen.add(len(y))
        return plain(x, y, *more)

    monkeypatch.setattr(quality, "fit", fit)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality.train(df, spark.createDataFrame(labels, LABELS), 300)
    parts = 5
    times = min(parts, -(-parts * 20 // rare))
    assert seen.value == 1500 - rare + times * rare
    got = {r.doc_id: r.score >= 0.3 for r in quality.score(df, model).collect()}
    assert all(got[i] == (n >= rare) for n, i in enumerate(ids))
