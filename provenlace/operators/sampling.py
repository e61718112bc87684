"""Samples of stated sizes over strata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that a task ranks at most, on average.
BUCKET = 100_000


def quotas(rows: DataFrame, stratum: str, limit: int) -> DataFrame:
    """(stratum, n, quota): limit rows in proportion to the strata's sizes, rounded down; the rest goes one by one to the largest.

    Equally large strata take by name, null last. A limit of all rows or more takes everything.
    The strata are few against the rows; their sizes are one aggregation.
    """
    sizes = rows.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    every = W.partitionBy()
    out = sizes.withColumn("total", F.sum("n").over(every)).withColumn("base", F.floor(F.col("n") * F.lit(limit) / F.col("total")))
    by_size = W.orderBy(F.col("n").desc(), F.col("stratum").isNull(), "stratum")
    out = out.withColumn("rest", F.lit(limit) - F.sum("base").over(every)).withColumn("turn", F.row_number().over(by_size))
    quota = F.when(F.col("total") <= limit, F.col("n")).otherwise(F.col("base") + (F.col("turn") <= F.col("rest")).cast("long"))
    return out.select("stratum", "n", quota.cast("long").alias("quota"))


def stratified_sample(rows: DataFrame, stratum: str, id_col: str, limit: int, seed: int = 0) -> DataFrame:
    """Rows of a sample of exactly limit rows: each stratum's first ones by a seeded hash of the id, as many as its quota.

    Ranks are found in two levels, by ranges of the hash and inside them, so a stratum may hold any share of the rows.
    Rows of one id tie and are told apart by nothing, so which of them stay is open if the quota ends among them.
    """
    total = rows.count()
    n = max(1, -(-total // BUCKET))
    at = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), F.col(id_col).cast("string")), 256), 1, 12), 16, 10).cast("long")
    drawn = rows.withColumn("__at", at).withColumn("__b", F.floor(F.col("__at") / float(1 << 48) * n).cast("long")).withColumn("__s", F.col(stratum))
    before = W.partitionBy("__s").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = drawn.groupBy("__s", "__b").agg(F.count(F.lit(1)).alias("__n"))
    offsets = offsets.select(F.col("__s").alias("__os"), F.col("__b").alias("__ob"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    quota = quotas(rows, stratum, limit).select(F.col("stratum").alias("__qs"), F.col("quota").alias("__quota"))
    offsets = offsets.join(quota, F.col("__os").eqNullSafe(F.col("__qs"))).drop("__qs").filter("__off < __quota")
    found = drawn.join(offsets, F.col("__s").eqNullSafe(F.col("__os")) & (F.col("__b") == F.col("__ob")))
    rank = F.row_number().over(W.partitionBy("__s", "__b").orderBy("__at", id_col)) + F.col("__off")
    return found.withColumn("__r", rank).filter("__r <= __quota").select(*rows.columns)
