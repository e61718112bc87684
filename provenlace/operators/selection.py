"""Order statistics by refining histograms: exact ranks, quantiles and medians of groups without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provenlace.storage import cut

BUCKETS = 4096
#: Ranges looked for up to this number (under 100 bytes each) go to all tasks, more are joined by group.
BROADCAST_RANGES = 50_000


def at_ranks(rows: DataFrame, ranks: DataFrame, group: str, value: str, buckets: int = BUCKETS) -> DataFrame:
    """ranks (group, rank; from 0) with ``value``: the value at that place of its group's values in order, null beyond the last.

    Each pass counts the values of every range that is looked for in ``buckets`` parts, map-side first; the part that
    holds the rank is the next range, from its least to its largest value, until these are one. So a pass shuffles at most ``buckets``
    rows a range and task, whatever the size of a group, and two or three passes find a rank among billions. Null and
    NaN values are left out; null groups are groups of their own.
    """
    own, v = "__g", "__v"
    data = cut(rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.struct(F.col(group)).alias(own), F.col(value).cast("double").alias(v)))
    ends = data.groupBy(own).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(F.lit(1)).alias("n"))
    asked = ranks.select(F.struct(F.col(group)).alias(own), "rank").distinct()
    left = cut(asked.join(ends, own).filter((F.col("rank") >= 0) & (F.col("rank") < F.col("n"))).select(own, "rank", "lo", "hi", F.col("rank").alias("inside")))
    done = left.filter("lo = hi")
    left = left.filter("lo < hi")
    while not left.isEmpty():
        ranges = left.select(own, "lo", "hi").distinct()
        ranges = F.broadcast(ranges) if ranges.count() <= BROADCAST_RANGES else ranges
        # a part's number never falls as the value grows, so parts are in order whatever rounding does
        width = F.col("hi") / 2 - F.col("lo") / 2
        tiny = F.when(F.col(v) > F.col("lo"), F.lit(buckets - 1).cast("long")).otherwise(F.lit(0).cast("long"))
        part = F.when(width > 0, F.least(F.floor((F.col(v) / 2 - F.col("lo") / 2) / F.nullif(width, F.lit(0.0)) * buckets), F.lit(buckets - 1))).otherwise(tiny)
        counted = (
            data.join(ranges, own).filter(F.col(v).between(F.col("lo"), F.col("hi")))
            .groupBy(own, "lo", "hi", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"))
        )
        before = W.partitionBy(own, "lo", "hi").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        counted = counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        here = (F.col("inside") >= F.col("before")) & (F.col("inside") < F.col("before") + F.col("n"))
        found = cut(left.join(counted, [own, "lo", "hi"]).filter(here).select(own, "rank", F.col("low").alias("lo"), F.col("high").alias("hi"), (F.col("inside") - F.col("before")).alias("inside")))
        done, left = done.unionByName(found.filter("lo = hi")), found.filter("lo < hi")
    told = cut(done.select(F.col(f"{own}.{group}").alias("__group"), F.col("rank").alias("__rank"), F.col("lo").alias(value)))
    same = ranks[group].eqNullSafe(F.col("__group")) & (ranks["rank"] == F.col("__rank"))
    return ranks.join(told, same, "left").drop("__group", "__rank")


def quantiles(rows: DataFrame, group: str, value: str, shares: dict[str, float], nearest: tuple[str, ...] = ()) -> DataFrame:
    """(group, one column per share): between the two neighbouring values in proportion, or, for those named in ``nearest``, the value of
    the least rank that at least that share of values reaches."""
    sizes = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    places = []
    for name, p in shares.items():
        at = F.lit(p) * (F.col("n") - 1) if name not in nearest else F.greatest(F.ceil(F.lit(p) * F.col("n")) - 1, F.lit(0)).cast("double")
        places.append(F.struct(F.lit(name).alias("name"), at.alias("at")))
    wanted = cut(sizes.select(group, F.explode(F.array(*places)).alias("s")).select(group, "s.name", "s.at"))
    low, high = F.floor("at"), F.ceil("at")
    ranks = wanted.select(group, F.explode(F.array(low, high)).alias("rank")).distinct()
    found = cut(at_ranks(rows, ranks, group, value))
    a = found.select(F.col(group).alias("ga"), F.col("rank").alias("ra"), F.col(value).alias("va"))
    b = found.select(F.col(group).alias("gb"), F.col("rank").alias("rb"), F.col(value).alias("vb"))
    both = wanted.join(a, wanted[group].eqNullSafe(F.col("ga")) & (low == F.col("ra"))).join(b, wanted[group].eqNullSafe(F.col("gb")) & (high == F.col("rb")))
    both = both.withColumn("q", F.when(F.col("ra") == F.col("rb"), F.col("va")).otherwise((high - F.col("at")) * F.col("va") + (F.col("at") - low) * F.col("vb")))
    return both.groupBy(group).agg(*[F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in shares])
