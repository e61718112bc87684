"""Corpus operators: oracles, brute force, invariants, and odd rows (nulls, empties, repeats, clashing names)."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from provenlace.llm import (
    chat_format,
    components,
    decontaminate,
    exact_dedup,
    language_id,
    line_dedup,
    mixing,
    queries,
    sharding,
    simhash,
    token_counts,
    toxicity,
)
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n int, h string, th string, id string"
LONG = "word and more " * 30000
ODD = [
    (1, "same text here", "en", "a", 1, "x", "y", "z"),
    (2, "same text here", "en", "a", None, None, None, None),
    (2, "same text here", "en", "a", None, None, None, None),
    (3, None, None, None, 1, "x", "y", "z"),
    (4, "", "fr", "b", 1, "x", "y", "z"),
    (None, " \t\n\n", "fr", None, 1, "x", "y", "z"),
    (5, LONG, "en", "b", 1, "x", "y", "z"),
    (6, "A\n a \nB", None, "b", 1, "x", "y", "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.ORACLE[name], SF)


def test_exact_dedup_odd_rows(odd, none):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(odd).collect()}
    assert {(1, 1, 3, True), (2, 1, 3, False), (3, 3, 2, True), (4, 3, 2, False), (None, None, 1, True)} <= got
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_survives_hash_clashes(odd):
    plain = exact_dedup.exact_dedup(odd, keep="max")
    clash = exact_dedup.exact_dedup(odd, keep="max", digest=lambda t: F.lit(b"one").cast("binary"))
    assert sorted(map(str, plain.collect())) == sorted(map(str, clash.collect()))


def test_line_dedup_odd_rows(odd, none):
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(odd, min_docs=2).collect()}
    assert got[1] == ("", 1, 1)
    assert got[3] == (None, 1, 0)
    assert got[4] == ("", 1, 0)
    assert got[6] == ("A\n a \nB", 3, 0)
    assert got[None] == (" \t\n\n", 3, 0)
    assert line_dedup.line_dedup(none).count() == 0


def test_sharding_laws(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = sharding.shard_documents(docs).toPandas().merge(docs.toPandas(), on="doc_id")
    sizes = got.groupby("shard").size()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    assert all(zlib.crc32(t.encode()) == c and len(t.encode()) + 1 == s for t, c, s in zip(got["text"], got["text_crc32"], got["size"]))
    assert (got.groupby("text")["shard"].nunique() == 1).all()
    small = sharding.shard_documents(odd, shards=3).toPandas()
    assert len(small) == len(ODD) and small.groupby("shard").size().max() <= 3
    assert sharding.shard_documents(none).count() == 0


def test_sharding_splits_a_hot_group(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 200, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    sizes = sharding.shard_documents(docs).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in sizes) == [50] * 8


def fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in prints}


@pytest.mark.parametrize("small", [24, 2])
def test_simhash_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    base = "the quick brown fox jumps over the lazy dog again and again until night falls on the quiet old town".split()
    texts = [" ".join(base[:i] + ["x"] + base[i + 1 :]) for i in range(len(base))] + ["", None, "one", "ONE", " ".join(base * 9)] * 2
    texts += [" ".join(base * 9 + [w]) for w in base]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = {i: fingerprint(t, 3) for i, t in enumerate(texts)}
    roots = classes(prints, 2)
    for r in simhash.simhash_components(docs).collect():
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.component_id == roots[r.doc_id]


@pytest.mark.parametrize("radius", [2, 3, 5, 6])
def test_masks_cover_every_difference(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = __import__("random").Random(radius)
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not diff & m for m in masks)


def test_near_duplicates(spark, odd, none):
    words = [f"w{i}" for i in range(200)]
    near = [*words[:100], "other", *words[101:]]
    rows = [(9, " ".join(words)), (7, " ".join(near)), (8, " ".join(words)), (1, "quite another text about something else"), (2, None), (3, "")]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1, 2, 7}
    assert simhash.drop_near_duplicates(odd).select("doc_id").distinct().count() == simhash.drop_near_duplicates(odd).count()
    assert simhash.drop_near_duplicates(none).count() == 0


def test_near_duplicates_in_a_crowded_bucket(spark):
    """Orders of the same words: one fingerprint for all, near-duplicates only inside each order."""
    rows, want = [], set()
    for group in range(20):
        words = sorted((f"w{i}" for i in range(120)), key=lambda w: hashlib.md5(f"{group} {w}".encode()).digest())
        swapped = [*words[:50], words[51], words[50], *words[52:]]
        rows += [(100 + group, " ".join(words)), (200 + group, " ".join(swapped))]
        want.add(100 + group)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == want


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (20, 21), (7, 7), (None, 1)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 20: 20, 21: 20, 7: 7}


def test_decontamination(spark, odd, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "too short"), (3, None)], "item_id long, text string")
    swapped = [*item[:6], "X", *item[7:13], "Y", *item[14:]]
    rows = [(1, "so " + " ".join(item).upper() + "!"), (2, "a b c " + " ".join(swapped) + " d e"), (3, " ".join(item[:7]) + " and nothing else at all here"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == {(1, 1), (2, 1)}
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {3, 4, 5}
    assert decontaminate.decontaminate(odd, bench).count() == len(ODD)
    assert decontaminate.contaminated(none, bench).count() == 0


def test_decontamination_finds_all_verbatim(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    flat = lambda s: " " + " ".join(re.findall(r"[^\W_]+", s.lower())) + " "
    items = {r.item_id: flat(r.text) for r in bench.collect()}
    want = {(r.doc_id, k) for r in docs.collect() for k, q in items.items() if q in flat(r.text)}
    assert want <= {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}


def test_token_counts_match_the_library(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in token_counts.token_counts(docs, path).collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
    with open(path, encoding="utf-8") as file:
        bpe = token_counts.Bpe(json.load(file))
    cases = ["", "aaaaaaa", "<|endoftext|>hi", "don't I'LL", "ΣΑΣ", "İx", "日本語 👍🏽", "a\x1cb\x85c", "é ﬁ", "z" * 3000, None]
    assert bpe.count(cases) == [len(library.encode(c or "", add_special_tokens=False).ids) for c in cases]
    assert token_counts.token_counts(odd, path).count() == len(ODD)
    assert token_counts.token_counts(none, path).count() == 0


def test_language_id(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    got = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(language_id.held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.95 * len(got)
    odds = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(odd, model).collect()}
    assert odds[3] == odds[4] == odds[None] == ("und", 0.0) and 0 <= odds[5][1] <= 1
    assert language_id.predict(none, model).count() == 0


def test_toxicity(spark, odd, none):
    model = toxicity.Model({"idiot": 6.0, "loser": 6.0}, slope=1.0, bias=-3.0)
    model.cost = toxicity.letter_model(toxicity.trigram_counts(spark.read.parquet(f"{SF}/documents.parquet")), list(model.weights))
    rows = [(1, "you 1d10t there"), (2, "you i d i o t there"), (3, "l.o.s.e.r"), (4, "a fine idea"), (5, None), (6, ""), (7, "L0SER!")]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(got[i] > 0.7 for i in (1, 2, 3, 7)) and all(got[i] < 0.2 for i in (4, 5, 6))
    assert toxicity.score(odd, model).count() == len(ODD)
    assert toxicity.score(none, model).count() == 0


def test_index_permutations(spark):
    """Every key gives a permutation, different keys different ones, and none keeps blocks in order, whatever their number."""
    sizes = [1, 2, 3, 341, 1000]
    rows = spark.createDataFrame([(n, key, i) for n in sizes for key in range(6) for i in range(n)], "n long, key long, i long")
    got = rows.select("n", "key", "i", mixing.permuted(F.col("i"), F.col("key"), F.col("n")).alias("to")).toPandas().sort_values(["n", "key", "i"])
    for n, of_size in got.groupby("n"):
        images = [tuple(part["to"]) for _, part in of_size.groupby("key")]
        assert all(sorted(p) == list(range(n)) for p in images)
        if n > 100:
            assert len(set(images)) == 6
            # neighbours stay neighbours, and places stay, about as seldom as by chance
            assert all(sum(abs(a - b) == 1 for a, b in zip(p, p[1:], strict=False)) < 12 and sum(a == i for i, a in enumerate(p)) < 12 for p in images)


def test_mixing_laws(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix_sources(docs, mixing.Mix(block_words=16)).toPandas()
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] >= 0).all()
    by = got.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(by["target"].sum() - 1.5 * by["size"].sum()) < 1e-3
    assert ((by["taken"] - by["target"]).abs() <= 0.02 * by["target"] + 32).all()
    again = mixing.mix_sources(docs.repartition(7), mixing.Mix(block_words=16)).toPandas()
    assert got.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()
    assert mixing.mix_sources(odd).count() == len(ODD)
    assert mixing.mix_sources(none).count() == 0


def test_chat_format_odd_rows(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "yes <|end|>"), (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, None, None, "first"),
        (2, 0, "user", "alone"), (None, 0, "user", "nobody"), (4, 0, "user", "a"), (4, 1, "assistant", "b"), (5, 0, "user", "a"), (5, 1, "assistant", "c"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pairs = chat_format.preference_pairs(turns, F.shiftright(F.col("conv_id"), 1), F.col("conv_id").bitwiseAND(1) == 1)
    got = {r.pair_id: r for r in pairs.collect()}
    assert set(got) == {0, 1, 2}
    assert got[0].n_prefix == 0 and got[0].rejected[0].text == "<||>\nfirst<|end|>\n"
    assert "< |end|>" in got[0].chosen[1].text
    assert not got[1].complete and got[1].rejected == []
    assert got[2].n_prefix == 1 and got[2].prompt == "<|user|>\na<|end|>\n" and got[2].chosen[0].train and got[2].differs
    assert chat_format.preference_pairs(turns.limit(0), F.col("conv_id"), F.lit(True)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "shard", "slot"} <= set(out.columns)
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert ids <= {r.doc_id for r in docs.select("doc_id").collect()} and len(ids) > 80


def overlaps(doc, item, window=13, similarity=0.8):
    """Whether some aligned window of the item (all of it, if shorter) agrees enough, by trying all alignments."""
    w = min(window, len(item))
    for shift in range(-len(item) + 1, len(doc)):
        agree = [doc[i] == item[i - shift] for i in range(max(0, shift), min(len(doc), len(item) + shift))]
        if any(sum(agree[i : i + w]) >= w * similarity for i in range(len(agree) - w + 1)):
            return True
    return False


def test_decontamination_brute_force(spark):
    """Items of 1 to 24 tokens, short ones among them, at all offsets, with the replaced tokens anywhere."""
    rng = __import__("random").Random(3)
    items = {n: [f"q{n}x{i}" for i in range(n)] for n in [*range(1, 16), 20, 24]}
    docs = {}
    for n, item in items.items():
        for offset in range(9):
            for wrong in range(5):
                part = list(item)
                for i in rng.sample(range(n), min(wrong, n)):
                    part[i] = "other"
                docs[len(docs)] = [f"a{i}" for i in range(offset)] + part + ["z"] * (offset % 3)
    for pair in itertools.combinations(range(13), 2):
        docs[len(docs)] = ["a"] * (len(docs) % 7) + ["other" if i in pair else t for i, t in enumerate(items[20][4:17])] + ["z"]
    want = {(d, n) for d, doc in docs.items() for n, item in items.items() if overlaps(doc, item)}
    bench = spark.createDataFrame([(n, " ".join(t)) for n, t in items.items()], "item_id long, text string")
    rows = spark.createDataFrame([(d, " ".join(t)) for d, t in docs.items()], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(rows, bench).collect()}
    assert len(want) > 300
    assert got == want


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


@pytest.mark.parametrize("paired", [8, 2])
def test_near_duplicates_brute_force(spark, monkeypatch, paired):
    """Copies with a passage added or cut, or words replaced, at shares around the similarity; a common passage; odd texts."""
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = __import__("random").Random(5)
    some = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    shared, texts = some(60), ["", None, " \t", "one", "ONE", "one two", "a b c d e", "A  b c d e"]
    for n in (40, 120, 400):
        for _ in range(8):
            base = some(n)
            texts.append(" ".join(base))
            for share in (0.05, 0.1, 0.18, 0.3):
                m, at = max(1, int(n * share)), rng.randrange(n)
                edits = [base + some(m), base[:at] + some(m) + base[at:], base[m:], base[: at - at // 4] + base[min(n, at - at // 4 + m) :]]
                swapped = list(base)
                for i in rng.sample(range(n), max(1, m // 5)):
                    swapped[i] = "other"
                texts.append(" ".join(rng.choice([*edits, swapped])))
    texts += [" ".join(shared + some(n)) for n in (4, 5, 8, 15, 40) for _ in range(5)]
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if root[a] != root[b] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if r == old else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == set(root)
    assert len(set(root)) < len(texts) - 40
