"""SimHash near-dedup: covering locality-sensitive hashing of 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenlace.llm.common import cut, fresh, table
from provenlace.llm.components import components

BITS = 64
#: Shingles whose bits are counted at a time.
COUNTED = 1 << 15
#: In buckets up to this size all pairs are compared, in larger ones the exact ways below are taken.
SMALL = 24


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks such that any ``radius`` bits are all absent from one of them.

    Bit i gets a vector m(i) of radius + 1 bits, not all zero; mask v, for each v but zero, holds
    the bits whose m(i) has an odd number of ones in common with v. The vectors of at most
    ``radius`` bits do not span the space, so some v is orthogonal to all of them, and v's mask
    has none of these bits: two fingerprints that differ there only agree under it.
    """
    n = 1 << (radius + 1)
    # as even as can be: all vectors in turn, or, when there are more than bits, those with the highest bit
    vectors = [i % (n - 1) + 1 if n <= BITS else (n >> 1) + i % (n >> 1) for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str, words: int, features: str = "shingles") -> int:
    """Bit b is 1 if more than half of the features' XXH64 (seed 42) have it."""
    low = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if not low:
        return 0
    if features == "words":
        parts = list(dict.fromkeys(low))
    else:
        joined = b" ".join(low)
        size = np.fromiter(map(len, low), np.int64, len(low))
        ends = np.cumsum(size + 1) - 1
        starts = ends - size
        k = min(words, len(low))
        parts = [joined[a:b] for a, b in zip(starts[: len(low) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    h = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(parts), COUNTED):
        some = np.array([h(p, 42) for p in parts[i : i + COUNTED]], "<u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(parts), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(docs: DataFrame, words: int, keep: list[Column], text: Column, features: str = "shingles") -> DataFrame:
    """The kept columns and fp (long) of every row."""
    slim = docs.select(*keep, text.alias("__t"))
    names = slim.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [_signed(fingerprint(t.as_py() or "", words, features)) for t in b.column(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(fp, pa.int64())], [*names, "fp"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{kinds}, fp long" if names else "fp long")


def _tables(nodes: DataFrame, radius: int) -> DataFrame:
    """Every fingerprint under every covering mask: (fp, mask, masked)."""
    masks = F.array(*[F.lit(_signed(m)) for m in covering_masks(radius)])
    return nodes.select("fp", F.explode(masks).alias("mask")).select("fp", "mask", F.col("mask").bitwiseAND(F.col("fp")).alias("masked"))


def links_within(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b) links that join exactly the fingerprints (fp, distinct) within ``radius`` <= 2.

    Buckets of few fingerprints give their pairs. In larger ones, at radius 1, each fingerprint looks for
    the 64 values one bit away. At radius 2 each fingerprint also stands
    under all values one bit away: two fingerprints at distance 2 or less have such a value in
    common, all that share one are within 2 of each other, so linking each to the value's
    smallest joins them without making pairs. No link is lost and none made up.
    """
    rows = _tables(nodes, radius)
    sizes = rows.groupBy("mask", "masked").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high"))
    sizes = cut(sizes.filter("n > 1"))
    two = sizes.filter("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    member = cut(rows.join(sizes.filter("n > 2").select("mask", "masked", "n"), ["mask", "masked"]))
    few = member.filter(F.col("n") <= SMALL)
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.mask") == F.col("y.mask")) & (F.col("x.masked") == F.col("y.masked")) & (F.col("x.fp") < F.col("y.fp")))
    pairs = two.unionByName(pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))
    pairs = pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()
    crowd = member.filter(F.col("n") > SMALL).select("fp").distinct()
    if radius < 2:
        flips = F.array(*[F.lit(_signed(1 << i)) for i in range(BITS if radius else 0)]).cast("array<long>")
        near = crowd.select(F.col("fp").alias("a"), F.explode(flips).alias("flip")).select("a", F.col("a").bitwiseXOR(F.col("flip")).alias("b"))
        return pairs.unionByName(near.filter("a < b").join(crowd.select(F.col("fp").alias("b")), "b").select("a", "b"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS)])
    probes = crowd.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("flip").bitwiseXOR(F.col("fp")).alias("value"))
    first = cut(probes.groupBy("value").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("value", "low"))
    stars = probes.join(first, "value").filter("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b")).distinct()
    return pairs.unionByName(stars)


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits), component_id of every row.

    Rows whose fingerprints differ in ``radius`` (2 at most) or fewer bits are linked; the
    component id is the smallest id that links reach. Texts in lower case (A-Z) are cut at ASCII
    blanks into words and shingles of ``words`` words, repeats included; shorter ones are one
    shingle; null, empty and blank texts have fingerprint zero and link like any other. Repeated
    rows and equal texts share a fingerprint. Null ids come last (a component of null ids only
    has a null id). An empty table gives an empty result; further columns are ignored.
    """
    if radius > 2:
        raise ValueError("links without pairs need a radius of 2 at most")
    prints = cut(fingerprints(docs, words, [F.col(id_col).alias("id")], F.col(text_col)))
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("low")))
    roots = components(links_within(nodes.select("fp"), radius))
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    joined = cut(joined)
    ids = cut(joined.groupBy("root").agg(F.min("low").alias("component_id")))
    named = cut(joined.join(ids, "root").select("fp", "component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


#: Near-duplicate search: buckets up to this size give all their pairs, larger ones pairs with their pivots first.
PAIRED = 8
PIVOTS = 2
#: Words of 64 bits of a set's small bitmap, a power of two.
FOLDED = 4
#: One text in so many, and this many at least, are counted for which shingles are frequent; the most frequent ones kept.
SAMPLED = 16
SAMPLE_ROWS = 2_000
FREQUENT = 50_000
#: Tables up to this number of rows (under 100 bytes each) are broadcast, larger ones shuffled.
BROADCAST_ROWS = 60_000
#: Members of a bucket that one task compares with all others.
DEALT = 256


def _shingles(text: Column, words: int) -> tuple[Column, Column]:
    """Hashes of the words of a text, and from their column the distinct hashes of its shingles."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hashes = F.transform(F.array_remove(F.split(low, "[\\x20\\x09-\\x0D]+"), ""), lambda w: F.xxhash64(w))
    h = F.col("__w")
    windows = F.when(F.size(h) >= words, F.sequence(F.lit(0), F.size(h) - words)).otherwise(F.array().cast("array<int>"))
    long = F.transform(windows, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
    return hashes, F.array_distinct(F.when(F.size(h) >= words, long).otherwise(F.array(F.xxhash64(h))))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Distinct 64-bit hashes, in order, of the shingles of a text: the same sets as _shingles, by other hashes."""
    low = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    h = xxhash.xxh64_intdigest
    if len(low) < words:
        return np.array([h(b" ".join(low), 43)], np.uint64)
    each = np.fromiter((h(w, 42) for w in low), np.uint64, len(low))
    last = len(low) - words + 1
    mixed = each[:last].copy()
    for k in range(1, words):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + each[k : k + last]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def _small(df: DataFrame) -> DataFrame:
    """df (cut), to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _signatures(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(th, id, fp, size, maps, few, p) of texts (th, id, t): fingerprint, and size, bitmaps and prefix of the shingle set.

    Sets of that similarity share an element of their prefixes, the first elements in any one order, as
    many as may be lacking in the other and one more. The order is by frequency in a sample, then
    by hash: a sample decides how many candidates there are, never whether a pair is found. A bit of the
    bitmap is whether an odd number of elements fall on it, so two bitmaps differ in no more bits
    than their sets differ in elements, and halves of a bitmap, XORed, are one of half the size. maps has two to four bits for each
    element (64 FOLDED at least), few has 64 FOLDED.
    """
    share = max(1, min(SAMPLED, texts.count() // SAMPLE_ROWS))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), words).view(np.int64))], ["h"])

    some = texts.filter(F.pmod(F.xxhash64("th"), F.lit(share)) == 0).select("t").mapInArrow(counted, "h long")
    often = some.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    common, times = often["h"].to_numpy().view(np.uint64), often["n"].to_numpy()
    by_hash = np.argsort(common)
    shared = texts.sparkSession.sparkContext.broadcast((common[by_hash], times[by_hash]))
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = shared.value
        lists = pa.list_(pa.int64())
        for b in batches:
            prints, sizes, maps, few, prefixes = [], [], [], [], []
            for t in b.column(2):
                text = t.as_py()
                s = shingle_set(text, words)
                prints.append(_signed(fingerprint(text, words, "words")))
                width = max(64 * FOLDED, 1 << (2 * len(s) - 1).bit_length())
                bits = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
                maps.append(np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64))
                few.append(np.bitwise_xor.reduce(maps[-1].reshape(-1, FOLDED), axis=0))
                sizes.append(len(s))
                # a little under, so that rounding makes prefixes longer, never shorter
                most = len(s) - int(np.ceil(len(s) * similarity - 1e-6)) + 1
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.argsort(np.where(known[at] == s, count[at], 0), kind="stable")]
                prefixes.append(s[:most].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), *[pa.array(x, lists) for x in (maps, few, prefixes)]],
                ["th", "id", "fp", "size", "maps", "few", "p"],
            )

    out = f"th binary, id {kind}, fp long, size int, maps array<long>, few array<long>, p array<long>"
    return cut(texts.select("th", "id", "t").mapInArrow(run, out))


def _order(i: int) -> Column:
    return F.struct(F.xxhash64(F.lit(i), "nid"), "nid")


def _ends(a: str, b: str) -> Column:
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def _bucket_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """(e: a, b) of nodes (nid, fp) within ``radius`` bits that share a bucket of the covering tables.

    Buckets of up to PAIRED members give all pairs; in larger ones each member is compared with
    PIVOTS members that hashes pick, the same in every bucket that holds them, so a large group of
    copies gives a few pairs per member.
    """
    masks = F.array(*[F.lit(_signed(m)) for m in covering_masks(radius)])
    rows = nodes.select("nid", "fp", F.explode(masks).alias("mask")).select(F.xxhash64("mask", F.col("mask").bitwiseAND(F.col("fp"))).alias("key"), "nid", "fp")
    many = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    member = cut(rows.join(_small(many), "key"))
    y = [F.col("key").alias("key2"), F.col("nid").alias("nid2"), F.col("fp").alias("fp2")]
    few = member.filter(F.col("n") <= PAIRED)
    some = few.join(few.select(*y), (F.col("key") == F.col("key2")) & (F.col("nid") < F.col("nid2")))
    crowd = member.filter(F.col("n") > PAIRED)
    tops = crowd.groupBy("key").agg(F.array(*[F.min_by(F.struct("key", "nid", "fp"), _order(i)) for i in range(PIVOTS)]).alias("ys"))
    tops = cut(tops.select(F.explode(F.array_distinct("ys")).alias("y")).select("y.*").select(*y))
    stars = crowd.join(tops, (F.col("key") == F.col("key2")) & (F.col("nid") != F.col("nid2")))
    return some.unionByName(stars).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius).select(_ends("nid", "nid2").alias("e"))


def _differ(x: Column, y: Column) -> Column:
    """Bits in which two bitmaps differ; the longer one, of twice the length at most, is folded."""
    n = F.least(F.size(x), F.size(y))
    half = lambda m, i: F.when(F.size(m) > n, F.get(m, i).bitwiseXOR(F.get(m, i + n))).otherwise(F.get(m, i))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.bit_count(half(x, i).bitwiseXOR(half(y, i))))


def _most(size_x: Column, size_y: Column, similarity: float) -> Column:
    """In how many elements sets of these sizes and the similarity may differ."""
    return (size_x + size_y) * ((1 - similarity) / (1 + similarity)) + 1e-6


def _similar(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, words: int, similarity: float, repeated: bool) -> DataFrame:
    """The pairs (a, b), cut, whose shingle sets have the similarity.

    Pairs that sizes or bitmaps rule out are left first; no other texts than those of the rest are fetched.
    """
    about = sigs.select("nid", "own_th", "own", "size", "maps")
    for x in "ab":
        pairs = pairs.join(about.select(*[F.col(c).alias(f"{c}_{x}") for c in about.columns]), F.col(x) == F.col(f"nid_{x}"))
    a, b = F.col("size_a"), F.col("size_b")
    near = (F.least(a, b) >= similarity * F.greatest(a, b) - 1e-6) & (_differ(F.col("maps_a"), F.col("maps_b")) <= _most(a, b, similarity))
    pairs = cut(pairs.filter(near).select(*[c for x in "ab" for c in (x, f"own_th_{x}", f"own_{x}")]))
    ends = [pairs.select(F.col(x).alias("nid"), F.col(f"own_th_{x}").alias("own_th"), F.col(f"own_{x}").alias("own")) for x in "ab"]
    needed = _small(cut(ends[0].union(ends[1]).distinct()))
    hashes, shingles = _shingles(F.col("t"), words)
    found = texts.join(needed, (F.col("th") == F.col("own_th")) & F.col("id").eqNullSafe(F.col("own")))
    sets = found.select("nid", hashes.alias("__w")).select("nid", shingles.alias("s"))
    sets = cut(sets.dropDuplicates(["nid"]) if repeated else sets)
    both = pairs.select("a", "b").join(sets.select(F.col("nid").alias("a"), F.col("s").alias("sa")), "a")
    both = both.join(sets.select(F.col("nid").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return cut(both.filter(common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b"))


def _short(similarity: float) -> Column:
    """Whether an element may be the first common one of a pair's smaller set."""
    return F.col("at") <= F.col("size") - F.ceil(F.col("size") * (2 * similarity / (1 + similarity)) - 1e-6)


def _alike(x: str, y: str, similarity: float) -> Column:
    """What rows of a pair's first common element fulfil if the sets are similar.

    All common elements stand from here on in both, so neither may have fewer left than must be common.
    """
    must = (F.col(f"{x}.size") + F.col(f"{y}.size")) * (similarity / (1 + similarity)) - 1e-6
    return (F.col(f"{x}.size") - F.col(f"{x}.at") >= must) & (F.col(f"{y}.size") - F.col(f"{y}.at") >= must)


def _shared(sigs: DataFrame, similarity: float) -> DataFrame:
    """(h, nid, at, size, n), cut, of prefix elements that several texts have, one of them as its short ones."""
    flat = sigs.select("nid", "size", F.posexplode("p").alias("at", "h")).select("h", "nid", "at", "size")
    many = flat.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.bool_or(_short(similarity)).alias("any"))
    many = cut(many.filter("n > 1 AND any").select(F.col("h").alias("h2"), F.col("n").cast("int").alias("n")))
    return cut(flat.join(_small(many), F.col("h") == F.col("h2")).drop("h2"))


def _pivot_pairs(shares: DataFrame, similarity: float) -> DataFrame:
    """Pairs of each member of a large bucket with the bucket's pivots."""
    crowd = shares.filter(F.col("n") > PAIRED)
    tops = crowd.groupBy("h").agg(F.array(*[F.min_by(F.struct("h", "nid", "at", "size"), _order(i)) for i in range(PIVOTS)]).alias("ys"))
    tops = cut(tops.select(F.explode(F.array_distinct("ys")).alias("y")).select("y.*"))
    pairs = crowd.alias("x").join(tops.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.nid") != F.col("y.nid")) & _alike("x", "y", similarity))
    return pairs.select(_ends("x.nid", "y.nid").alias("e"))


def _all_pairs(shares: DataFrame, similarity: float) -> DataFrame:
    """Pairs of all members of buckets that have different roots, the smaller set's element a short one.

    Members are dealt out, DEALT of a bucket to a part, and the members that may be the smaller of a
    pair stand in each part, so that a large bucket is the work of many tasks.
    """
    parts = F.ceil(F.col("n") / DEALT).cast("int")
    ys = shares.withColumn("part", F.pmod(F.xxhash64("nid"), parts).cast("int"))
    xs = shares.filter(_short(similarity)).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    smaller = (F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.nid") != F.col("y.nid")))
    cond = (F.col("x.h") == F.col("y.h")) & (F.col("x.part") == F.col("y.part")) & smaller & (F.col("x.root") != F.col("y.root"))
    bits = [F.bit_count(F.get("x.few", F.lit(i)).bitwiseXOR(F.get("y.few", F.lit(i)))) for i in range(FOLDED)]
    near = sum(bits[1:], bits[0]) <= _most(F.col("x.size"), F.col("y.size"), similarity)
    return xs.alias("x").join(ys.alias("y"), cond & _alike("x", "y", similarity) & near).select(_ends("x.nid", "y.nid").alias("e"))


def near_duplicate_links(sigs: DataFrame, texts: DataFrame, words: int, similarity: float, radius: int, repeated: bool) -> DataFrame:
    """(a, b) of texts (sigs, one row each) that join all whose shingle sets have the similarity.

    First, pairs within ``radius`` bits out of the covering tables and pairs of large prefix buckets' members
    with their pivots are compared. Then the elements whose texts still are in several components
    give all their pairs, so none stays apart. sigs has nid, own_th, own (text hash and id of one row with
    that text), fp, size, maps, few, p; texts th, id and t of every row, some of them alike if repeated.
    """
    shares = _shared(sigs, similarity)
    first = _bucket_pairs(sigs.select("nid", "fp"), radius).unionByName(_pivot_pairs(shares, similarity))
    links = _similar(first.select("e.*").distinct(), sigs, texts, words, similarity, repeated)
    roots = _small(components(links))
    rooted = shares.join(roots, F.col("nid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "nid")).drop("node")
    torn = rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    torn = cut(torn.filter("low <> high").select(F.col("h").alias("h2")))
    left = rooted.join(_small(torn), F.col("h") == F.col("h2")).drop("h2")
    left = cut(left.join(sigs.select(F.col("nid").alias("node"), "few"), F.col("nid") == F.col("node")).drop("node"))
    more = cut(_all_pairs(left, similarity).select("e.*").distinct())
    return links.unionByName(_similar(more, sigs, texts, words, similarity, repeated))


def drop_near_duplicates(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs with one row of each group of near-duplicates: the one with the smallest id.

    Rows of equal texts are a group, and groups whose texts' sets of ``words``-word shingles (words
    cut at ASCII blanks, A-Z in lower case) have a Jaccard similarity of ``similarity`` or more are
    joined, all of them: first those that covering hashing, with ``radius``, of SimHash fingerprints of
    the distinct words brings together, then those that prefixes of the shingle sets find among the rest.
    Null, empty and blank-less texts follow the same rules, null counting as empty. Null ids come
    last. Of repeated rows one stays. An empty table gives an empty one; all columns are kept.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    th = F.unhex(F.md5(t.cast("binary")))
    texts = docs.select(th.alias("th"), F.col(id_col).alias("id"), t.alias("t"))
    rows = _signatures(texts, words, similarity)
    least_id = F.min(F.struct(F.col("id").isNull().alias("no"), "id"))
    pairs = cut(rows.groupBy("th", "id").agg(F.count(F.lit(1)).alias("n")))
    repeated = not pairs.filter("n > 1").isEmpty()
    nodes = cut(pairs.groupBy("th").agg(least_id.alias("low")).select(F.col("th").alias("own_th"), F.col("low.id").alias("own")))
    # both keys, so that a large group of copies is spread over the tasks
    own = (F.col("th") == F.col("own_th")) & F.col("id").eqNullSafe(F.col("own"))
    sigs = rows.join(nodes, own).select("own_th", "own", "fp", "size", "maps", "few", "p")
    sigs = cut(sigs.dropDuplicates(["own_th"]) if repeated else sigs).withColumn("nid", F.monotonically_increasing_id())
    roots = components(near_duplicate_links(sigs, texts, words, similarity, radius, repeated))
    low = F.struct(F.col("own").isNull().alias("no"), "own", "own_th")
    named = sigs.select("nid", low.alias("low")).join(_small(roots), F.col("nid") == F.col("node"), "left")
    stays = named.groupBy(F.coalesce("root", "nid").alias("root")).agg(F.min("low").alias("low")).select("low.own", "low.own_th")
    mine, gone_text, gone_id = fresh("own"), fresh("th"), fresh("id")
    gone = cut(pairs.join(stays, own, "left_anti").select(F.col("th").alias(gone_text), F.col("id").alias(gone_id)))
    kept = docs.withColumn(mine, th).join(_small(gone), (F.col(mine) == F.col(gone_text)) & docs[id_col].eqNullSafe(F.col(gone_id)), "left_anti")
    if repeated:  # one of the rows with the same id and text
        kept = kept.dropDuplicates([mine])
    return kept.drop(mine)
