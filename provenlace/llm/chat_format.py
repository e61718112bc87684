"""Preference formatting: one shared prompt and two masked completions per pair of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenlace.llm.common import table


def _rendered(turn: Column) -> Column:
    """Role line, text, end mark. A mark inside a text or role is broken up, so it can't end a turn."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|"), safe(turn["role"]), F.lit("|>\n"), safe(turn["text"]), F.lit("<|end|>\n"))


def preference_pairs(turns: DataFrame, pair: Column, rejected: Column, order: str = "turn", train_role: str = "assistant") -> DataFrame:
    """Render every pair of conversations as prompt plus two completions.

    turns has role, text and an order column; ``pair`` names the pair of a row, ``rejected`` is
    true for the turns of the rejected side. The prompt is the longest common turn prefix (same
    role and text), rendered once. Returns pair_id, n_prefix, prompt, and for both sides the
    segments (array of text and train: whether the loss counts it, true for ``train_role``).
    complete says that both sides have turns, differs that the completions are not the same.

    Null roles and texts count as empty; null order values come first; equal order values go by
    role and text, repeated rows stay repeated turns. Rows with a null pair make no pair. A side
    without turns has an empty completion. An empty table gives an empty result; further columns
    are ignored. One row holds one pair, as one training example.
    """
    t = turns.select(
        pair.alias("pair_id"),
        rejected.alias("rej"),
        F.struct(
            F.col(order).isNotNull().alias("known"), F.col(order).alias("o"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
        ).alias("turn"),
    ).filter("pair_id IS NOT NULL")
    side = lambda which: F.array_sort(F.collect_list(F.when(which, F.col("turn"))))
    both = t.groupBy("pair_id").agg(side(~F.col("rej")).alias("c"), side(F.col("rej")).alias("r"))
    n = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(
        F.slice("c", F.lit(1), n), F.slice("r", F.lit(1), n), lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"])
    )
    first_off = F.array_position(same, False)
    both = both.withColumn("k", F.when(first_off == 0, n).otherwise(first_off - 1).cast("int"))
    tail = lambda name: F.slice(name, F.col("k") + 1, F.greatest(F.size(name) - F.col("k"), F.lit(0)))
    segments = lambda name: F.transform(
        tail(name), lambda x: F.struct(_rendered(x).alias("text"), (x["role"] == train_role).alias("train"))
    )
    return both.select(
        "pair_id",
        F.col("k").cast("long").alias("n_prefix"),
        F.array_join(F.transform(F.slice("c", F.lit(1), F.col("k")), _rendered), "").alias("prompt"),
        segments("c").alias("chosen"),
        segments("r").alias("rejected"),
        ((F.size("c") > 0) & (F.size("r") > 0)).alias("complete"),
    ).withColumn("differs", F.col("chosen") != F.col("rejected"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) make pair k."""
    turns = table(spark, sf_dir, "conversations")
    pairs = preference_pairs(turns, F.shiftright(F.col("conv_id"), 1), F.col("conv_id").bitwiseAND(1) == 1)
    text = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), "")
    mask = lambda c: F.array_join(F.transform(c, lambda x: F.when(x["train"], "1").otherwise("0")), "")
    chars = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.when(x["train"], F.length(x["text"])).otherwise(0))
    return pairs.select(
        "pair_id",
        "n_prefix",
        "complete",
        "differs",
        "prompt",
        *[f(c).alias(f"{c}{s}") for c in ("chosen", "rejected") for f, s in ((text, "_text"), (mask, "_mask"), (chars, "_train_chars"))],
    )


SQL = r"""
WITH t AS (
  SELECT conv_id >> 1 AS pair_id, conv_id & 1 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, '<|' || replace(role, '<|', '< |') || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10) AS seg FROM t),
a AS (SELECT * FROM r WHERE side = 0), b AS (SELECT * FROM r WHERE side = 1),
m AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.pos, b.pos) AS pos,
         coalesce(a.role = b.role AND a.text = b.text, false) AS ok
  FROM a FULL JOIN b ON a.pair_id = b.pair_id AND a.pos = b.pos),
p AS (SELECT pair_id, coalesce(min(pos) FILTER (WHERE NOT ok), max(pos) + 1) AS k FROM m GROUP BY pair_id)
SELECT pair_id, any_value(k)::BIGINT AS n_prefix,
       bool_or(side = 0) AND bool_or(side = 1) AS complete,
       coalesce(string_agg(seg, '' ORDER BY pos) FILTER (WHERE side = 0 AND pos >= k), '')
         <> coalesce(string_agg(seg, '' ORDER BY pos) FILTER (WHERE side = 1 AND pos >= k), '') AS differs,
       coalesce(string_agg(seg, '' ORDER BY pos) FILTER (WHERE side = 0 AND pos < k), '') AS prompt,
       coalesce(string_agg(seg, '' ORDER BY pos) FILTER (WHERE side = 0 AND pos >= k), '') AS chosen_text,
       coalesce(string_agg(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, '' ORDER BY pos) FILTER (WHERE side = 0 AND pos >= k), '') AS chosen_mask,
       coalesce(sum(length(seg)) FILTER (WHERE side = 0 AND pos >= k AND role = 'assistant'), 0)::BIGINT AS chosen_train_chars,
       coalesce(string_agg(seg, '' ORDER BY pos) FILTER (WHERE side = 1 AND pos >= k), '') AS rejected_text,
       coalesce(string_agg(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, '' ORDER BY pos) FILTER (WHERE side = 1 AND pos >= k), '') AS rejected_mask,
       coalesce(sum(length(seg)) FILTER (WHERE side = 1 AND pos >= k AND role = 'assistant'), 0)::BIGINT AS rejected_train_chars
FROM r JOIN p USING (pair_id) GROUP BY pair_id
"""
