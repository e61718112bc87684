"""The event log as a stream: liveness per key, and idempotent append."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenlace.plans.dialect import render
from provenlace.plans.log import PLANS
from provenlace.plans.views import with_views
from provenlace.storage import shared_folder


def live_edges(log: DataFrame) -> DataFrame:
    """Running state per key of a log (event_id, event_type, user_id), batch or stream: is its edge live.

    An edge is live when its last add comes after its last invalidation; keys never added have no row.
    """
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("event_id")))
    state = log.groupBy(F.col("user_id").cast("string").alias("key")).agg(last("view").alias("added"), last("error").alias("gone"))
    return state.filter("added IS NOT NULL").select("key", (F.col("added") > F.coalesce("gone", F.lit(-1))).alias("live"))


def stream_log_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read the log as a stream to its present end and return the state it leaves."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # the reader watches a folder: the table itself, or the one its file lies in
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{folder}/state"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = live_edges(source).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/marks")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


QUERIES = {"stream_log_liveness": stream_log_liveness}
ORACLE = {"stream_log_liveness": render(with_views(PLANS["log_live_edges"], ()), False)}
