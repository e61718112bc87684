"""Benchmark decontamination: spaced-seed hashes joined, overlaps verified token by token."""

from __future__ import annotations

from functools import cache, reduce
from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenlace.llm.common import cut, fresh, table

#: Positions a seed compares at most, and seeds of a window length at most: more positions make fewer chance hits.
WEIGHT = 6
FAMILY = 3
#: Windows up to this length get spaced seeds, longer ones a run of tokens.
SPACED = 16
#: A benchmark index up to this many seeds (about 40 bytes each) is broadcast; a larger one is shuffled.
BROADCAST_SEEDS = 1_000_000
#: Hits up to this number (about 60 bytes each) are broadcast to the documents' texts.
BROADCAST_HITS = 200_000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def token_hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


@cache
def seed_masks(length: int, wrong: int) -> tuple[tuple[int, ...], ...]:
    """Few masks, as positions from 0, such that wherever ``wrong`` of ``length`` tokens differ, one fits between them somewhere."""
    if not wrong:
        return (tuple(range(length)),)
    if length <= SPACED:
        spoilt = [set(c) for c in combinations(range(length), wrong)]
        for weight in range(min(WEIGHT, length - wrong), 1, -1):
            spared = {}
            for rest in combinations(range(1, length), weight - 1):
                placed = [{o + x for x in (0, *rest)} for o in range(length - rest[-1])]
                spared[(0, *rest)] = {i for i, c in enumerate(spoilt) if any(not c & p for p in placed)}
            left, masks = set(range(len(spoilt))), []
            while left and len(masks) < FAMILY:
                masks.append(max(spared, key=lambda m: (len(spared[m] & left), -m[-1], m)))
                left -= spared[masks[-1]]
            if not left:
                return tuple(masks)
    return (tuple(range(max(1, ceil((length - wrong) / (wrong + 1))))),)  # the longest run that agrees


def _seed(hashes: Column, i: Column, mask: tuple[int, ...]) -> Column:
    """The hash, under a mask, of the tokens from i on; those past the end are left out."""
    return F.xxhash64(*[F.get(hashes, i + k) for k in mask])


def contaminated(
    docs: DataFrame,
    bench: DataFrame,
    window: int = 13,
    similarity: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Which documents hold part of which benchmark items: id, item, start, n_aligned, n_matched.

    An item counts when, in some ``window`` aligned tokens (all of them, if the item is shorter), at
    least ``similarity`` agree, so replaced tokens do not hide a passage. Documents and items are
    compared under masks at every token, and whichever tokens of such a window differ, one of its
    masks misses them (seed_masks), so that every such alignment is found; it is then compared token
    by token. One row per document and item, with the best alignment: the first aligned token of the
    document, and how many aligned tokens there are and agree.

    Tokens are lower-case runs of letters and digits. Items of few tokens count as others
    do: up to four must agree in all, one of one token with each document that has it. Texts without
    tokens, null texts among them, match nothing. Items of equal text are all reported; repeated document rows are
    reported once per distinct text. Null ids are reported as null. Empty tables give an empty
    result; further columns are ignored.
    """
    items = bench.select(F.col(item_col).alias("item"), token_hashes(F.col(item_text_col)).alias("it")).filter(F.size("it") > 0)
    named = cut(items.select("item", F.xxhash64("it").alias("k"), "it").distinct())
    texts = cut(named.groupBy("k").agg(F.first("it").alias("it")))
    w = F.least(F.lit(window), F.size("it"))
    lengths = [r[0] for r in texts.select(w).distinct().collect()]
    families = {n: seed_masks(n, n - ceil(n * similarity)) for n in lengths}
    masks = sorted({m for family in families.values() for m in family})
    parts = []
    for m, mask in enumerate(masks):
        of = texts.filter(w.isin([n for n in lengths if mask in families[n]]))
        seeds = F.transform(F.sequence(F.lit(0), F.size("it") - 1 - mask[-1]), lambda i: _seed(F.col("it"), i, mask))  # noqa: B023
        parts.append(of.select("k", F.lit(m).alias("m"), F.posexplode(seeds).alias("at", "seed")))
    none = texts.limit(0).select("k", F.lit(0).alias("m"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("seed"))
    index = cut(reduce(DataFrame.unionByName, parts, none))
    if index.count() <= BROADCAST_SEEDS:
        index = F.broadcast(index)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    th = F.xxhash64("t")
    # the hashes are a column of their own: inside the seeds' lambda they would be made anew for each token
    hashed = base.select("id", th.alias("th"), token_hashes(F.col("t")).alias("hs"))
    # seeds that tokens past the end are left out of agree with none of the index, which has whole ones only
    at = F.when(F.size("hs") > 0, F.sequence(F.lit(0), F.size("hs") - 1)).otherwise(F.array().cast("array<int>"))
    every = masks or [(0,)]
    seeds = F.flatten(F.transform(at, lambda i: F.array(*[_seed(F.col("hs"), i, mask) for mask in every])))
    probes = hashed.select("id", "th", F.posexplode(seeds).alias("p", "seed"))
    probes = probes.select("id", "th", "seed", (F.col("p") % len(every)).alias("m"), F.floor(F.col("p") / len(every)).cast("int").alias("pos"))
    hits = probes.join(index, ["seed", "m"]).select("id", "th", "k", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    hits = hits.withColumnsRenamed({"id": "hit_id", "th": "hit_th"})
    hits = cut(hits)
    if hits.count() <= BROADCAST_HITS:
        hits = F.broadcast(hits)
    d = base.withColumn("th", th)
    cond = F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th"))
    pairs = d.join(hits, cond).select("id", "th", token_hashes(F.col("t")).alias("dt"), "k", "shift").join(texts, "k")
    lo = F.greatest(F.lit(0), "shift")
    n = F.least(F.size("dt"), F.size("it") + F.col("shift")) - lo
    agree = F.zip_with(F.slice("dt", lo + 1, n), F.slice("it", lo - F.col("shift") + 1, n), lambda a, b: (a == b).cast("int"))
    pairs = pairs.select("id", "th", "k", lo.alias("start"), agree.alias("agree"), F.size("it").alias("size"))
    w = F.least(F.lit(window), "size")
    sums = F.transform(
        F.when(F.size("agree") >= w, F.sequence(F.lit(0), F.size("agree") - w)).otherwise(F.array().cast("array<int>")),
        lambda i: F.aggregate(F.slice("agree", i + 1, w), F.lit(0), lambda a, x: a + x),
    )
    found = pairs.withColumn("best", F.array_max(sums)).filter(F.col("best") >= F.ceil(w * similarity))
    found = found.select(
        "id", "th", "k", "start",
        F.size("agree").alias("n_aligned"), F.aggregate("agree", F.lit(0), lambda a, x: a + x).alias("n_matched"),
    )
    top = F.max(F.struct("n_matched", (-F.col("start")).alias("s"), "n_aligned")).alias("b")
    # items of equal text share what was found
    return found.groupBy("id", "th", "k").agg(top).join(named.select("k", "item"), "k").select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), (-F.col("b.s")).cast("long").alias("start"),
        F.col("b.n_aligned").cast("long").alias("n_aligned"), F.col("b.n_matched").cast("long").alias("n_matched"),
    )


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the rows whose id is reported by ``contaminated``; every clean row stays."""
    found = contaminated(docs, bench, id_col=id_col, text_col=text_col, **how)
    name = fresh("bad")
    bad = cut(found.select(F.col(id_col).alias(name)).distinct())
    if bad.count() <= BROADCAST_HITS:
        bad = F.broadcast(bad)
    return docs.join(bad, docs[id_col].eqNullSafe(F.col(name)), "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
