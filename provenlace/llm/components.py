"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenlace.llm.common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that stands in a link; root is the smallest node it can reach.

    Rounds of taking the smallest label among neighbours and then the label's own label, until no
    label changes. Links and labels are cut each round; nothing of them comes to the driver but
    the number of changes. Loops and repeated links don't matter; null ends are left out.
    """
    one = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    both = cut(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("root")).withColumnRenamed("u", "node"))
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("root").alias("near"))
        step = labels.join(near, labels["node"] == near["u"]).select("node", F.least("root", "near").alias("next"), F.col("root").alias("was"))
        step = cut(step)
        jump = step.select(F.col("node").alias("at"), F.col("next").alias("far"))
        after = step.join(jump, step["next"] == jump["at"], "left").select("node", "was", F.least("next", F.coalesce("far", "next")).alias("root"))
        after = cut(after)
        labels = after.select("node", "root")
        if after.filter("root <> was").isEmpty():
            return labels
