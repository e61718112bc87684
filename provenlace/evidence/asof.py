"""As-of join: each item with the state that the changes before its position have left, without a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Positions of a block; a key's changes in one block are ordered in one task.
BLOCK = 65_536
END = 2**63 - 1


def asof(items: DataFrame, changes: DataFrame, key: str, at: str, fields: list[str], tie: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """items with ``fields`` as the changes of their ``key`` at positions before ``at`` have left them.

    A change is a row of changes whose non-null fields are set; null ones stay as they were. Among changes at one position
    the last in the order of ``tie`` wins. An item sees changes at positions below its own, all of them if that is null;
    null keys match nothing. Fields that nothing has set are null. Items keep their other columns and repeated rows;
    a column of theirs named like a field is replaced.

    Only the items' distinct positions are ordered among the changes, by key and block of positions; what earlier blocks
    leave is carried over from each block's last values, a row per key and block. So a hot key is spread over its blocks,
    and a hot position costs one row.
    """
    tie = tie or []
    point, place = "__point", "__at"
    asked = items.filter(F.col(key).isNotNull()).select(key, F.coalesce(F.col(at).cast("long"), F.lit(END)).alias(place)).distinct()
    asked = asked.withColumn(point, F.lit(True))
    made = changes.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, F.col(at).cast("long").alias(place), *tie, *fields).withColumn(point, F.lit(False))
    rows = asked.unionByName(made, allowMissingColumns=True).withColumn("__block", F.floor(F.col(place) / F.lit(block)).cast("long"))
    order = F.struct(place, *tie)
    lasts = rows.groupBy(key, "__block").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields])
    before = W.partitionBy(key).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    carried = lasts.select(key, "__block", *[F.last(f, ignorenulls=True).over(before).alias(f"__{f}") for f in fields])
    # a point stands before the changes at its own position
    upto = W.partitionBy(key, "__block").orderBy(F.col(place), F.col(point).desc(), *tie).rowsBetween(W.unboundedPreceding, 0)
    inside = rows.select(key, "__block", place, point, *[F.last(f, ignorenulls=True).over(upto).alias(f) for f in fields]).filter(point)
    state = inside.join(carried, [key, "__block"]).select(
        F.col(key).alias("__key"), place, *[F.coalesce(f, f"__{f}").alias(f) for f in fields]
    )
    same = (items[key] == F.col("__key")) & (F.coalesce(items[at].cast("long"), F.lit(END)) == F.col(place))
    return items.drop(*[f for f in fields if f in items.columns]).join(state, same, "left").drop("__key", place)
