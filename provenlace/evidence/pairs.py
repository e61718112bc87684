"""Pairs of claims that share tokens, the best of each question, without making all pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provenlace.storage import cut

#: Similarities that are looked down to, one after the other, for questions that still lack pairs; the last means any shared token.
STEPS = (0.8, 0.6, 0.4, 0.2, 0.0)


def _overlapping(claims: DataFrame, least: float) -> DataFrame:
    """Pairs of a question's claims whose token sets have a Jaccard similarity of ``least`` or more and something in common.

    Such sets share one of their first tokens in any one order, as many as may be lacking in the other and one more; the
    order here is by rarity, so that a frequent token joins claims only where most of their tokens are frequent.
    """
    tokens = claims.select("question_id", "claim_id", F.explode("tokens").alias("tok"))
    rarity = tokens.groupBy("question_id", "tok").agg(F.count(F.lit(1)).alias("df"))
    ordered = tokens.join(rarity.filter("df > 1"), ["question_id", "tok"])
    # tokens of one claim only come first in the order and join nothing, so they are only counted
    ordered = ordered.join(claims.select("question_id", "claim_id", F.size("tokens").alias("size")), ["question_id", "claim_id"])
    rank = F.row_number().over(W.partitionBy("question_id", "claim_id").orderBy("df", "tok"))
    several = F.count(F.lit(1)).over(W.partitionBy("question_id", "claim_id"))
    must = F.greatest(F.ceil(F.col("size") * F.lit(least) - 1e-9), F.lit(1))
    prefix = ordered.withColumn("at", rank + F.col("size") - several).filter(F.col("at") <= F.col("size") - must + 1)
    a = prefix.select("question_id", "tok", F.col("claim_id").alias("a"), F.col("size").alias("sa"))
    b = prefix.select("question_id", "tok", F.col("claim_id").alias("b"), F.col("size").alias("sb"))
    fits = (F.col("a") < F.col("b")) & (F.least("sa", "sb") >= F.greatest("sa", "sb") * least - 1e-9)
    found = a.join(b, ["question_id", "tok"]).filter(fits).select("question_id", "a", "b").distinct()
    for x in "ab":
        mine = claims.select("question_id", F.col("claim_id").alias(x), F.col("tokens").alias(f"t{x}"), F.col("session_id").alias(f"s{x}"))
        found = found.join(mine, ["question_id", x])
    common = F.size(F.array_intersect("ta", "tb"))
    overlap = common / (F.size("ta") + F.size("tb") - common)
    found = found.select("question_id", "a", "b", (~F.col("sa").eqNullSafe(F.col("sb"))).alias("cross_session"), overlap.alias("overlap"))
    return found.filter((F.col("overlap") >= least - 1e-9) & (F.col("overlap") > 0))


def best_pairs(claims: DataFrame, k: int = 50) -> DataFrame:
    """(question_id, a, b, cross_session, overlap, rank): each question's first k pairs of claims that share a token.

    claims: question_id, claim_id, session_id, tokens (array<string>, distinct). Pairs of different sessions come first, then the
    larger overlap (shared tokens of all tokens), then ids. A question is done at the first similarity of STEPS at which k
    pairs of different sessions are at least that similar, for then none below can be among the first k; only questions that
    have fewer go on to the next, and those that lack them to the end give whatever shares a token. So the pairs made are about those asked for,
    and a question of few claims is small at any similarity. Claims without tokens and null ids pair with nothing.
    """
    left = cut(claims.select("question_id", "claim_id", "session_id", F.array_distinct("tokens").alias("tokens")).filter("size(tokens) > 0 AND question_id IS NOT NULL AND claim_id IS NOT NULL"))
    first = W.partitionBy("question_id").orderBy(F.col("cross_session").desc(), F.col("overlap").desc(), "a", "b")
    done = []
    for least in STEPS:
        if left.isEmpty():
            break
        pairs = cut(_overlapping(left, least))
        full = pairs.groupBy("question_id").agg(F.count_if("cross_session").alias("n")).filter(F.col("n") >= k) if least else left.select("question_id").distinct()
        full = cut(full.select("question_id"))
        done.append(pairs.join(full, "question_id", "left_semi"))
        left = cut(left.join(full, "question_id", "left_anti"))
    if not done:
        return _overlapping(left, 1.0).withColumn("rank", F.lit(1))
    return reduce(DataFrame.unionByName, done).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
