"""Joins of half-open intervals [lo, hi) by overlap, through buckets of time; a null bound is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WEEK = 604_800


def is_unbounded(lo: Column, hi: Column) -> Column:
    return lo.isNull() & hi.isNull()


def is_empty(lo: Column, hi: Column) -> Column:
    """Both bounds are there and leave nothing between them."""
    return F.coalesce(lo >= hi, F.lit(False))


def _bucketed(left: DataFrame, right: DataFrame, key: str, other: str, width: int) -> DataFrame:
    """(key, other, bucket, q_lo, q_hi, lo, hi): intervals of both sides in each bucket of time that they share, bounds clipped to all times that matter."""
    span = left.select("lo", "hi").unionByName(right.select("lo", "hi")).agg(
        F.least(F.min("lo"), F.min("hi")).alias("first"), F.greatest(F.max("lo"), F.max("hi")).alias("last")
    )
    deal = F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)))

    def clipped(df: DataFrame, name: str) -> DataFrame:
        df = df.crossJoin(F.broadcast(span))  # one row
        lo, hi = F.coalesce("lo", F.col("first") - 1), F.coalesce("hi", F.col("last") + 1)
        return df.select(name, lo.cast("long").alias("lo"), hi.cast("long").alias("hi")).filter("lo < hi").withColumn("bucket", deal)

    ours = clipped(left, key).withColumnsRenamed({"lo": "q_lo", "hi": "q_hi"})
    return ours.join(clipped(right, other), "bucket").filter((F.col("q_lo") < F.col("hi")) & (F.col("lo") < F.col("q_hi")))


def overlap_join(left: DataFrame, right: DataFrame, key: str, other: str, width: int = WEEK) -> DataFrame:
    """(key, other) of all rows of left (key, lo, hi) and right (other, lo, hi) whose intervals overlap.

    Bounds are whole numbers. Empty intervals overlap nothing; a row without any bound overlaps all others. Pairs are found by an equi-join
    on the buckets of ``width`` that both lie in and kept in the one where their overlap begins; an interval comes
    once for each bucket it lies in. Repeated rows give repeated pairs.
    """
    pairs = _bucketed(left, right, key, other, width)
    return pairs.filter(F.floor(F.greatest("q_lo", "lo") / width) == F.col("bucket")).select(key, other)


def covered_fraction(left: DataFrame, right: DataFrame, key: str, width: int = WEEK) -> DataFrame:
    """(key, fraction): the part of each of left's intervals (key, lo, hi; both bounds, keys once) that right's (lo, hi) cover together.

    Overlaps among right's intervals count once. An empty interval has the fraction 0. The union is measured bucket by bucket, as
    buckets share no time, so an interval of many covers isn't one task's.
    """
    cut = _bucketed(left, right.select(F.lit(1).alias("__o"), "lo", "hi"), key, "__o", width).select(
        key, "bucket",
        F.greatest("q_lo", "lo", F.col("bucket") * width).alias("a"), F.least("q_hi", "hi", (F.col("bucket") + 1) * width).alias("b"),
    ).filter("a < b")
    before = W.partitionBy(key, "bucket").orderBy("a", "b").rowsBetween(W.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("b") - F.greatest("a", F.coalesce("reach", "a")))
    union = cut.withColumn("reach", F.max("b").over(before)).groupBy(key).agg(F.sum(new).alias("covered"))
    part = F.when(F.col("lo") < F.col("hi"), F.coalesce("covered", F.lit(0)) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    return left.select(key, "lo", "hi").join(union, key, "left").select(key, F.round(part.cast("double"), 6).alias("fraction"))
