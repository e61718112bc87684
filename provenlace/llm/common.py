"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; only where that is unset on one machine, as in tests, a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not (sc.getConf().get("spark.checkpoint.dir", None) or sc.master.startswith("local[") or sc.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="provenlace-"))
    return sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder all executors share and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_count(rows: int) -> int:
    """Buckets for ranks in two levels: many against the tasks, about 10,000 rows each at scale."""
    return max(4096, rows // 10_000)


def hash_bucket(buckets: int, *cols: str | Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(buckets))


def gapless_rank(df: DataFrame, keys: list[str], bucket: str, order: list, out: str) -> DataFrame:
    """Rank rows of each key 0, 1, 2, ... by (bucket, order) without one task holding a key.

    Rows are numbered inside (key, bucket); bucket sizes, a small table, are summed up to each
    bucket's offset. df is read twice, so it should be cheap or cut.
    """
    counts, off, rn = f"__n_{out}", f"__o_{out}", f"__r_{out}"
    sizes = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias(counts))
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, bucket, F.coalesce(F.sum(counts).over(before), F.lit(0)).alias(off))
    numbered = df.withColumn(rn, F.row_number().over(W.partitionBy(*keys, bucket).orderBy(*order)))
    cond = [numbered[k].eqNullSafe(offsets[k]) for k in [*keys, bucket]]
    joined = numbered.join(offsets, cond, "left")
    return joined.select(*[numbered[c] for c in df.columns], (F.col(off) + F.col(rn) - 1).cast("long").alias(out))


def fresh(prefix: str = "c") -> str:
    """A column name that no caller's table has."""
    return f"__{prefix}_{uuid.uuid4().hex[:8]}"


