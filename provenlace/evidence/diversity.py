"""How different a question's sets are: the mean Jaccard distance of their pairs, what sets of these sizes would have by chance, and the excess."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenlace.storage import cut

KEY = ["question_id", "place"]


def chance_distance(a: Column, b: Column, universe: Column) -> Column:
    """The expected Jaccard distance of two random sets of a and b of the universe's atoms: exact, over the hypergeometric overlap.

    0 where a set or the universe is empty; a set of more atoms than the universe counts as all of it.
    """
    a, b = F.least(a, universe), F.least(b, universe)
    start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("mass"), F.lit(0.0).alias("sum"))

    def add(s: Column, k: Column) -> Column:
        ahead = s["p"] * (a - k) * (b - k) / ((k + 1) * (universe - a - b + k + 1))
        return F.struct(ahead.alias("p"), (s["mass"] + s["p"]).alias("mass"), (s["sum"] + s["p"] * (1 - k / (a + b - k))).alias("sum"))

    # chances relative to that of the least overlap there can be, each from the one before
    ks = F.sequence(F.greatest(F.lit(0), a + b - universe), F.least(a, b))
    return F.when((a > 0) & (b > 0), F.aggregate(ks, start, add, lambda s: s["sum"] / s["mass"])).otherwise(0.0)


def _overlaps(sets: DataFrame) -> DataFrame:
    """(question_id, alike): the sum of pairs' Jaccard similarities, from the pairs that share an atom."""
    member = sets.select(*KEY, F.size("atoms").alias("n"), F.explode("atoms").alias("atom"))
    other = member.select("question_id", "atom", F.col("place").alias("other"), F.col("n").alias("m"))
    common = member.join(other, ["question_id", "atom"]).filter("place < other").groupBy(*KEY, "other", "n", "m").agg(F.count(F.lit(1)).alias("k"))
    empty = sets.filter(F.size("atoms") == 0).groupBy("question_id").agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).alias("alike"))
    found = common.select("question_id", (F.col("k") / (F.col("n") + F.col("m") - F.col("k"))).alias("alike"))
    return found.unionByName(empty).groupBy("question_id").agg(F.sum("alike").alias("alike"))


def _sketched(sets: DataFrame, sketches: int) -> DataFrame:
    """The same sum, estimated: two sets agree in a least hash as often as they are alike, and agreements are counted by value, without pairs."""
    member = sets.select(*KEY, F.explode_outer("atoms").alias("atom")).withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(sketches))))
    hashed = F.when(F.col("atom").isNotNull(), F.xxhash64("seed", "atom"))
    least = member.groupBy(*KEY, "seed").agg(F.min(hashed).alias("least"))
    n = F.col("n")
    return least.groupBy("question_id", "seed", "least").agg(F.count(F.lit(1)).alias("n")).groupBy("question_id").agg((F.sum(n * (n - 1) / 2) / sketches).alias("alike"))


def diversity(sets: DataFrame, universe: DataFrame, sketches: int | None = None) -> DataFrame:
    """(question_id, sets, observed, chance, excess) of sets (question_id, place, atoms) within universe (question_id, atoms long).

    Equal sets at different places are sets of their own, repeated atoms of a set count once; two empty sets are alike. Fewer
    than two sets: all 0. chance comes from counts of pairs of sizes. Pairs that share an atom are joined and counted, which is
    for portfolios, a few sets a question; for many sets ``sketches`` hash functions estimate the sum (its
    standard error is at most 0.5 / sqrt(sketches)) in work that grows with the sets' atoms and not with pairs.
    Null questions are left out; a question without a universe has an empty one (chance 0).
    """
    sets = cut(sets.filter("question_id IS NOT NULL").select(*KEY, F.array_compact(F.array_distinct("atoms")).alias("atoms")))
    alike = _overlaps(sets) if sketches is None else _sketched(sets, sketches)
    sizes = cut(sets.groupBy("question_id", F.size("atoms").cast("long").alias("a")).agg(F.count(F.lit(1)).alias("n")))
    other = sizes.select("question_id", F.col("a").alias("b"), F.col("n").alias("m"))
    pairs = sizes.join(other, "question_id").filter("a <= b").withColumn("pairs", F.when(F.col("a") == F.col("b"), F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("n") * F.col("m")))
    pairs = pairs.filter("pairs > 0").join(universe.select("question_id", F.col("atoms").cast("long").alias("u")).groupBy("question_id").agg(F.max("u").alias("u")), "question_id", "left")
    each = chance_distance(F.col("a"), F.col("b"), F.coalesce("u", F.lit(0).cast("long")))
    chance = pairs.groupBy("question_id").agg((F.sum(F.col("pairs") * each) / F.sum("pairs")).alias("chance"))
    n = F.col("sets")
    total = sizes.groupBy("question_id").agg(F.sum("n").alias("sets")).join(alike, "question_id", "left").join(chance, "question_id", "left")
    observed = F.when(n < 2, 0.0).otherwise(1 - F.coalesce("alike", F.lit(0.0)) / (n * (n - 1) / 2))
    out = total.select("question_id", "sets", observed.alias("observed"), F.coalesce("chance", F.lit(0.0)).alias("chance"))
    return out.withColumn("excess", F.col("observed") - F.col("chance"))
