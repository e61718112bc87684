"""The append-only event log: a table of (seq, ts, schema_version, op, payload), and its JSON lines form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provenlace.storage import cut

LINE = "seq BIGINT, ts STRING, schema_version STRING, op STRING, payload STRING"
#: Rows of a segment, the folder that a replay up to some position can skip.
SEGMENT = 1_000_000


def numbered(df: DataFrame, order: list[str], out: str, start: int = 0) -> DataFrame:
    """df with a gapless number from ``start`` in ``order``, without one task holding all rows.

    Rows are dealt by ranges of the order and numbered inside each task; the tasks' row counts, one
    row each, are summed up to offsets.
    """
    local = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    placed = local.withColumn("__task", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    before = W.orderBy("__task").rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy("__task").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select("__task", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    # one row a task
    return placed.join(F.broadcast(offsets), "__task").withColumn(out, F.col("__off") + F.col("__at") + start).drop("__task", "__at", "__off", "__id")


def snapshot_id(log: DataFrame) -> int:
    """One past the last position; 0 of an empty log."""
    last = log.agg(F.max("seq")).first()[0]
    return 0 if last is None else last + 1


def replay(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame:
    """The log's rows before position ``upto`` (all if None); later segments are not read."""
    log = spark.read.schema(f"{LINE}, segment BIGINT").parquet(folder)
    if upto is not None:
        log = log.filter((F.col("segment") <= upto // SEGMENT) & (F.col("seq") < upto))
    return log.drop("segment")


def append(events: DataFrame, folder: str, order: list[str], start: int) -> int:
    """Append (op, payload, ts, schema_version, and the order's columns) from position ``start``; the next position is returned.

    One writer at a time: it passes the position that the last call returned, or ``snapshot_id``
    of the log. A null or blank op stops the whole append; an empty table appends nothing.
    """
    op = F.when(F.trim(F.coalesce("op", F.lit(""))) == "", F.raise_error(F.lit("an event needs an op")).cast("string")).otherwise(F.col("op"))
    rows = cut(numbered(events.withColumn("op", op), order, "seq", start).select("seq", "ts", "schema_version", "op", "payload"))
    n = rows.count()
    if n:
        rows.withColumn("segment", F.expr(f"seq div {SEGMENT}")).write.mode("append").partitionBy("segment").parquet(folder)
    return start + n


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The longest prefix of a JSON lines log whose lines are well formed and numbered 0, 1, 2, ... without a gap.

    Lines keep their place by file, block and place in the block, however the files are dealt. An
    empty file gives an empty log; blank or torn lines and those without seq or op end the prefix.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )
    rows = numbered(lines, ["file", "block", "row"], "no").withColumn("e", F.from_json("value", LINE))
    fine = F.coalesce((F.col("e.seq") == F.col("no")) & (F.trim("e.op") != ""), F.lit(False))
    rows = cut(rows.select("no", "e", fine.alias("fine")))
    end = rows.filter(~F.col("fine")).agg(F.min("no")).first()[0]
    return (rows if end is None else rows.filter(F.col("no") < end)).select("e.*")


def write_lines(log: DataFrame, folder: str) -> None:
    """JSON lines in order of position, keys in order of their names; read_lines reads them back."""
    fields = F.to_json(F.struct("op", "payload", "schema_version", "seq", "ts"))
    log.repartitionByRange("seq").sortWithinPartitions("seq").select(fields.alias("value")).write.text(folder)
