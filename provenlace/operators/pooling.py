"""Fixed-width features of sets: mean and maximum of their members' vectors, and their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pool_sets(members: DataFrame, vectors: DataFrame, width: int, most: int) -> DataFrame:
    """(set_id, features): width means, width maxima, and the share of ``most`` that the known members make.

    members: (set_id, item), a null item for an empty set, whose features are 0; vectors: (item, vector) of width numbers, items once each.
    Members that vectors doesn't know are left out; a set that has members, but none known, is an error, as its features
    would be those of an empty set. Sums and maxima are aggregated place by place before the shuffle.
    """
    joined = members.select("set_id", "item").join(vectors.select("item", "vector"), "item", "left")
    at = [F.element_at("vector", i + 1).cast("double") for i in range(width)]
    known, named = F.count("vector"), F.count("item")
    wide = joined.groupBy("set_id").agg(
        F.array(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in at]).alias("means"), F.array(*[F.coalesce(F.max(c), F.lit(0.0)) for c in at]).alias("most"),
        known.alias("known"), named.alias("named"),
    )
    lost = F.raise_error(F.concat(F.lit("no member is known of set "), F.col("set_id").cast("string"))).cast("array<double>")
    features = F.concat("means", "most", F.array(F.col("known") / F.lit(float(most))))
    return wide.select("set_id", F.when((F.col("named") > 0) & (F.col("known") == 0), lost).otherwise(features).alias("features"))


def class_mapping(labels: DataFrame, mapping: DataFrame) -> DataFrame:
    """(native, instances, target, merged): what a mapping (native, target) does to each class of labels (item, native).

    target is null for a class that is dropped; merged says that another class present has the same target.
    Null labels are left out; a class of the mapping that no item has does not appear.
    """
    present = labels.filter("native IS NOT NULL").groupBy("native").agg(F.count(F.lit(1)).alias("instances"))
    both = present.join(mapping.select("native", "target").dropDuplicates(["native"]), "native", "left")
    shared = both.groupBy("target").agg((F.count(F.lit(1)) > 1).alias("merged"))
    return both.join(shared, "target", "left").select("native", "instances", "target", F.coalesce("merged", F.lit(False)).alias("merged"))


def pool_sizes(atoms: DataFrame) -> DataFrame:
    """One row: pools, the least, upper median and largest number of atoms, and atoms whose text another atom of the pool has.

    atoms: (question_id, atom_id, text); texts are compared folded, empty ones not at all. Without pools the sizes are null.
    """
    text = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    sizes = atoms.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    # sizes are few against pools, so the median is taken from their counts
    by_size = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("pools"))
    middle = F.expr("try_element_at(filter(steps, s -> s.upto > total div 2), 1).n")
    steps = F.expr("aggregate(array_sort(collect_list(struct(n, pools))), cast(array() as array<struct<n: bigint, upto: bigint>>), "
                   "(acc, s) -> concat(acc, array(struct(s.n as n, coalesce(try_element_at(acc, -1).upto, 0L) + s.pools as upto))))")  # fmt: skip
    out = by_size.agg(F.sum("pools").alias("total"), F.min("n").alias("least"), F.max("n").alias("most"), steps.alias("steps"))
    twice = atoms.select("question_id", text.alias("t")).filter("t <> ''").groupBy("question_id", "t").agg((F.count(F.lit(1)) - 1).alias("extra"))
    extra = twice.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("equal_texts"))
    median = F.when(F.size("steps") > 0, middle)
    return out.crossJoin(extra).select(F.coalesce("total", F.lit(0)).alias("pools"), "least", median.alias("median"), "most", "equal_texts")  # one row each
