"""Exact dedup: one 128-bit hash per text, one aggregation, bytes compared inside each group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenlace.llm.common import cut, table


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest: Callable[[Column], Column] = md5_128
) -> DataFrame:
    """Mark, for every row, which row of its group of equal texts stays.

    Returns id, keep_id, group_size, kept, text_sha256. ``keep`` is "min" (the smallest id stays)
    or "max". Null texts count as empty ones. Null ids lose against any id; a group of null ids
    only has a null keep_id, and its rows are kept. Repeated rows (same id, same text) all count
    in group_size and are all marked kept when their id stays. An empty table gives an empty
    result. Further columns of docs are ignored.

    One aggregation by hash compares the bytes too: a group whose smallest and largest text are
    the same holds one text only. Partial aggregation runs before the shuffle, so a group with a
    third of all rows arrives as one row per map task. If a hash ever stands for two texts, the
    rows of that hash are grouped by their text instead.
    """
    best = F.min if keep == "min" else F.max
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    hashed = base.withColumn("h", digest(F.col("t")))
    groups = cut(
        hashed.groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"), best("id").alias("keep_id"), F.min("t").alias("a"), F.max("t").alias("z"))
        .select("h", "n", "keep_id", (F.col("a") == F.col("z")).alias("same"))
    )
    slim = hashed.select("id", "h", F.sha2(F.col("t").cast("binary"), 256).alias("sha"))
    clashes = groups.filter(~F.col("same")).select("h")
    if clashes.isEmpty():
        joined = slim.join(groups.select("h", "n", "keep_id"), "h", "left")
    else:
        split = hashed.join(clashes, "h", "left_semi")
        by_text = split.groupBy("h", "t").agg(F.count(F.lit(1)).alias("n"), best("id").alias("keep_id"))
        odd = split.join(by_text, ["h", "t"]).select("id", "h", F.sha2(F.col("t").cast("binary"), 256).alias("sha"), "n", "keep_id")
        even = slim.join(groups.filter("same").select("h", "n", "keep_id"), "h")
        joined = even.select("id", "h", "sha", "n", "keep_id").unionByName(odd)
    return joined.select(
        F.col("id").alias(id_col),
        F.col("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
