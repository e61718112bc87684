"""Mixing sources to target weights: token blocks, drawn per output shard, joined by index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provenlace.llm.common import bucket_count, cut, fresh, table

WORD = "[^\\x20\\x09-\\x0D]+"
#: Output shards whose draws are summed together.
STRETCH = 4096
#: Rounds of the index permutations.
ROUNDS = 16


@dataclass(frozen=True)
class Mix:
    """share: of all words that the mix has. cap: times its words that a source gives at most."""

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    cap: int = 2
    block_words: int = 128
    shard_blocks: int = 1024
    seed: int = 42


def _uniform(*cols: str | Column) -> Column:
    """In [0, 1), from a hash of the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") / float(1 << 52)


def permuted(place: Column, key: Column, n: Column) -> Column:
    """place's image under a permutation of 0 to n - 1 that key chooses, by a swap-or-not shuffle.

    Each round pairs every place with its mirror image about a point drawn from the key and, by a hash of the larger of the two, swaps both
    or neither. So each round is a permutation whatever n is.
    """

    def swap(x: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, i), n) - x, n)
        return F.when(F.pmod(F.xxhash64(key, i, F.greatest(x, other)), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), place.cast("long"), swap)


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """Add rank, weight and target to (sk, source, source_size): one row per source.

    Sources go by code point, null last. Each gets the same multiple of its weight, but at most
    cap times its words; the multiple is such that all targets make share times all words.
    """
    everything = W.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1)
    ranked = ranked.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, mix.weights)), (F.col("rank") % len(mix.weights) + 1).cast("int"))
    ).withColumn("most", F.col("source_size").cast("double") * mix.cap)
    by_ratio = W.orderBy(F.col("most") / F.col("weight"), "rank")
    ranked = (
        ranked.withColumn("step", F.row_number().over(by_ratio))
        .withColumn("full_before", F.coalesce(F.sum("most").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("budget", F.sum("source_size").over(everything) * mix.share)
        .withColumn("level", (F.col("budget") - F.col("full_before")) / F.col("weight_left"))
    )
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("step", "level"))
    return ranked.withColumn("level", F.min(fits).over(everything)["level"]).select(
        "sk", "source", "source_size", "rank", F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.col("most")).alias("target")
    )


def draw_blocks(targets: DataFrame, mix: Mix) -> DataFrame:
    """(sk, shard, block): the blocks that each output shard takes, a block at most cap times in all.

    A shard draws its source counts from the multinomial distribution given by the sources' shares
    of all blocks: the whole part of each expectation is given, the rest drawn. A source's draws end
    at its share of blocks; what it then lacks goes to one last shard. The i-th block a source
    gives is i's place in a pseudorandom permutation of its block indices, a new one for each pass.
    """
    everything = W.partitionBy()
    blocks = F.ceil(F.col("source_size") / mix.block_words)
    t = (
        targets.filter("source_size > 0")
        .withColumn("nb", F.when(blocks < 2**31 - 99, blocks).otherwise(F.raise_error(F.lit("a source has over 2^31 blocks; take larger ones"))).cast("long"))
        .withColumn("q", F.least(F.round(F.col("target") * F.col("nb") / F.col("source_size")).cast("long"), F.col("nb") * mix.cap))
        .withColumn("all_q", F.sum("q").over(everything))
        .filter("q > 0")
        .withColumn("shards", F.ceil(F.col("all_q") / mix.shard_blocks))
    )
    per = (
        t.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
        .withColumn("slots", F.least(F.lit(mix.shard_blocks).cast("long"), F.col("all_q") - F.col("shard") * mix.shard_blocks))
        .withColumn("mean", F.col("slots") * F.col("q") / F.col("all_q"))
        .withColumn("base", F.floor("mean"))
    )
    in_shard = W.partitionBy("shard")
    per = (
        per.withColumn("rest", F.col("slots") - F.sum("base").over(in_shard))
        .withColumn("part", F.col("mean") - F.col("base"))
        .withColumn("at", F.coalesce(F.sum("part").over(in_shard.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("at", F.when(F.col("rest") > 0, F.col("at") / F.sum("part").over(in_shard)).otherwise(F.lit(0.0)))
    )
    draws = per.groupBy("shard").agg(F.max("rest").alias("rest")).filter("rest > 0")
    draws = draws.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rest")))).select(
        "shard", _uniform(F.lit(mix.seed), "shard", "i").alias("at"), F.lit(None).cast("string").alias("sk"), F.lit(1).alias("drawn")
    )
    marks = per.filter("part > 0").select("shard", "at", "sk", F.lit(0).alias("drawn"))
    landed = marks.unionByName(draws).withColumn(
        "sk", F.last("sk", ignorenulls=True).over(in_shard.orderBy("at", "drawn").rowsBetween(W.unboundedPreceding, 0))
    )
    extra = landed.filter("drawn = 1").groupBy("shard", "sk").agg(F.count(F.lit(1)).alias("extra"))
    counts = per.join(extra, ["shard", "sk"], "left").withColumn("c", F.col("base") + F.coalesce("extra", F.lit(0)))
    # summed in two levels, shards of a stretch and then stretches, so that no task holds all shards of a source
    counts = counts.withColumn("stretch", F.floor(F.col("shard") / STRETCH))
    stretches = counts.groupBy("sk", "stretch").agg(F.sum("c").alias("of_stretch"))
    stretches = stretches.select(
        "sk", "stretch", (F.sum("of_stretch").over(W.partitionBy("sk").orderBy("stretch").rowsBetween(W.unboundedPreceding, 0)) - F.col("of_stretch")).alias("before"),
        F.sum("of_stretch").over(W.partitionBy("sk")).alias("total"),
    )
    in_stretch = W.partitionBy("sk", "stretch").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)
    counts = counts.withColumn("to", F.sum("c").over(in_stretch)).join(stretches, ["sk", "stretch"]).withColumn("to", F.col("to") + F.col("before"))
    spans = counts.select(
        "sk", "shard", "nb", (F.col("to") - F.col("c")).alias("lo"), F.least("to", "q").alias("hi"),
        F.when((F.col("shard") == F.col("shards") - 1) & (F.col("total") < F.col("q")), F.struct(F.col("total").alias("lo"), F.col("q").alias("hi"))).alias("more"),
        "shards",
    )
    spans = spans.select("sk", "shard", "nb", "lo", "hi").unionByName(
        spans.filter("more IS NOT NULL").select("sk", F.col("shards").alias("shard"), "nb", "more.lo", "more.hi")
    )
    slots = spans.filter("hi > lo").withColumn("i", F.explode(F.sequence("lo", F.col("hi") - 1)))
    turn, place = F.floor(F.col("i") / F.col("nb")), F.col("i") % F.col("nb")
    # one key and count for all places of a pass
    key = F.xxhash64(F.lit(mix.seed), "sk", turn)
    slots = slots.select("sk", "shard", "nb", place.alias("place"), key.alias("key"))
    return slots.select("sk", "shard", permuted(F.col("place"), F.col("key"), F.col("nb")).alias("block"))


def mix_sources(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words the mix takes of every row: id, source, size, source_size, target, taken.

    Words are runs of anything but ASCII blanks; a null text has none. A source's words lie in one
    stream, its rows in the order of a hash of the id; the stream is packed into blocks of
    block_words words. taken counts a row's words in the drawn blocks, so none passes cap times
    its size. A null source is a source of its own; null ids and repeated rows are rows like
    any other; rows without words take none. An empty table gives an empty result, further
    columns are ignored. The same rows give the same result, however they are partitioned.

    Offsets are summed in two levels (hash buckets within the source, rows within the bucket), so
    a source with a third of all rows is spread over many tasks.
    """
    slim = cut(
        docs.select(
            F.col(id_col).alias("id"),
            F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("th"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        )
        .withColumn("sk", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
        .withColumn("h", F.xxhash64(F.lit(mix.seed), "id", "th"))
    )
    buckets = bucket_count(slim.count())
    rows = slim.withColumn("b", F.pmod("h", F.lit(buckets)))
    targets = cut(source_targets(slim.groupBy("sk", "source").agg(F.sum("size").alias("source_size")), mix))
    uses = draw_blocks(targets, mix).groupBy("sk", "block").agg(F.count(F.lit(1)).alias("uses"))
    words = rows.filter("size > 0")
    offsets = words.groupBy("sk", "b").agg(F.sum("size").alias("n"))
    offsets = offsets.select(
        "sk", "b", F.coalesce(F.sum("n").over(W.partitionBy("sk").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("off")
    )
    inside = W.partitionBy("sk", "b").orderBy("h", "id", "th").rowsBetween(W.unboundedPreceding, -1)
    spans = (
        words.withColumn("run", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, ["sk", "b"])
        .select("id", "th", "sk", "size", (F.col("off") + F.col("run")).alias("start"))
    )
    size = mix.block_words
    pieces = spans.withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("size") - 1) / size)))
    ).withColumn("n", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * size) - F.greatest("start", F.col("block") * size))
    taken = (
        # the uses grow with the corpus, so they are never broadcast, however well they compress
        pieces.join(uses.hint("merge"), ["sk", "block"], "left")
        .groupBy("id", "th", "sk", "start", "size")
        .agg(F.sum(F.col("n") * F.coalesce("uses", F.lit(0))).alias("taken"))
        .select("id", "th", "sk", "size", "taken")
    )
    every = taken.unionByName(rows.filter("size = 0").select("id", "th", "sk", "size", F.lit(0).cast("long").alias("taken")))
    return every.join(targets.select("sk", "source", "source_size", "target"), "sk").select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("th").alias("text_md5"), "size", "source_size", "target", "taken"
    )


def mixed_rows(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it: 0 to cap times.

    The words taken of a row are rounded to whole copies by a hash, up as often as their share says,
    so sources keep their targets on average. Rows without words are not taken. All columns stay.
    """
    taken = mix_sources(docs, mix, id_col, text_col, source_col)
    part = F.col("taken") / F.col("size")
    up = _uniform(F.lit(mix.seed + 2), id_col, "text_md5") < part - F.floor(part)
    own_id, own_text, own_source, n, i = (fresh() for _ in range(5))
    copies = taken.filter("taken > 0").select(
        F.col(id_col).alias(own_id), F.col("text_md5").alias(own_text), F.col(source_col).alias(own_source), (F.floor(part) + up.cast("int")).cast("int").alias(n)
    )
    # rows that are repeated in all three share their draws
    copies = copies.groupBy(own_id, own_text, own_source).agg(F.round(F.sum(n) / F.count(F.lit(1))).cast("int").alias(n)).filter(F.col(n) > 0)
    own = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    cond = docs[id_col].eqNullSafe(F.col(own_id)) & (own == F.col(own_text)) & docs[source_col].eqNullSafe(F.col(own_source))
    rows = docs.join(copies, cond).withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n))))
    return rows.drop(own_id, own_text, own_source, n, i)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
