"""Registered queries of normalisation and grounding; the SQL beside them tries every span of whole words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenlace.functions import grounding
from provenlace.plans.dialect import plan, render
from provenlace.plans.views import with_views
from provenlace.storage import cut

#: A turn's fourth to ninth word as its quote: as it stands, in capitals (A-Z) and wider apart, with a changed character and a doubled one, or backwards.
QUOTES = """
SELECT turn_id, conv_id, text, CASE length(text) % 4 WHEN 0 THEN base WHEN 1 THEN translate(replace(base, ' ', '  '), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')
         WHEN 2 THEN concat(substr(base, 1, 4), '#', substr(base, 6, 9), substr(base, 14)) ELSE reverse(base) END AS quote
FROM (SELECT turn_id, conv_id, text, {} AS base FROM turn) b"""
SPARK_QUOTES = QUOTES.format("array_join(slice(@words(text), 4, 6), ' ')")
DUCK_QUOTES = QUOTES.format("array_to_string(list_slice(@words(text), 4, 9), ' ')")
def single(text: str) -> str:
    """The checking engine compares bytes, so letters of two bytes become capitals, which a normalised text has none of."""
    return f"translate({text}, 'äöüßéèêëàâîïôùûçñáíóú', 'ABCDEFGHIJKLMNOPQRSTU')"


# every span of whole words of each text, over arrays of characters
BRUTE = f"""
WITH q AS ({DUCK_QUOTES}),
c AS (SELECT turn_id, i - 1 AS i, substr(text, i, 1) AS ch, regexp_matches(substr(text, i, 1), '^\\s$') AS blank FROM (SELECT turn_id, text, unnest(generate_series(1, length(text))) AS i FROM q) x),
k AS (SELECT * FROM (SELECT *, lag(blank, 1, true) OVER (PARTITION BY turn_id ORDER BY i) AS after_blank FROM c) y WHERE NOT (blank AND after_blank)),
m AS (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY i) - 1 AS j, i = max(i) OVER (PARTITION BY turn_id) AS final FROM k),
t AS (SELECT * FROM m WHERE NOT (final AND blank)),
n AS (SELECT turn_id, string_agg(CASE WHEN blank THEN ' ' ELSE lower(ch) END, '' ORDER BY j) AS norm, list(i ORDER BY j) AS plc FROM t GROUP BY turn_id),
z AS (SELECT q.turn_id, q.conv_id, q.text, q.quote, coalesce(norm, '') AS norm, list_append(coalesce(plc, []), length(q.text)) AS plc, trim(regexp_replace(lower(q.quote), '\\s+', ' ', 'g')) AS nq FROM q LEFT JOIN n USING (turn_id)),
w AS (SELECT turn_id, i, regexp_matches(substr(norm, i + 1, 1), '[\\p{{L}}\\p{{N}}_]') AND i < length(norm) AS own, i > 0 AND regexp_matches(substr(norm, i, 1), '[\\p{{L}}\\p{{N}}_]') AS before
      FROM (SELECT turn_id, norm, unnest(generate_series(0, length(norm))) AS i FROM z) v),
spans AS (
  SELECT z.turn_id, a.i AS s, b.i AS e, 1 - levenshtein({single("substr(z.norm, a.i + 1, b.i - a.i)")}, {single("z.nq")}) / greatest(length(z.nq), b.i - a.i) AS score
  FROM z JOIN w a ON a.turn_id = z.turn_id AND a.own AND NOT a.before JOIN w b ON b.turn_id = z.turn_id AND b.before AND NOT b.own AND b.i > a.i
  WHERE abs(b.i - a.i - length(z.nq)) <= floor(length(z.nq) * 0.15 / 0.85 + 1e-9) AND length(z.nq) > 0),
best AS (SELECT turn_id, s, e, score FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY round(score, 9) DESC, s, e) AS rn FROM spans WHERE score >= 0.85 - 1e-9) r WHERE rn = 1),
g AS (
  SELECT z.turn_id, z.conv_id, CASE WHEN trim(quote) = '' THEN 'failed' WHEN instr(text, quote) > 0 THEN 'exact' WHEN instr(norm, nq) > 0 THEN 'normalised' WHEN best.s IS NOT NULL THEN 'fuzzy' ELSE 'failed' END AS rung,
         CASE WHEN instr(text, quote) > 0 THEN instr(text, quote) - 1 END AS xs, CASE WHEN instr(norm, nq) > 0 THEN instr(norm, nq) - 1 END AS ns, text, quote, nq, plc, s, e, score FROM z LEFT JOIN best USING (turn_id)),
r AS (
  SELECT turn_id, conv_id, rung, CAST(CASE rung WHEN 'exact' THEN xs WHEN 'normalised' THEN plc[ns + 1] WHEN 'fuzzy' THEN plc[s + 1] END AS INT) AS "start",
         CAST(CASE rung WHEN 'exact' THEN xs + length(quote) WHEN 'normalised' THEN plc[ns + length(nq) + 1] WHEN 'fuzzy' THEN plc[e + 1] END AS INT) AS "end",
         CASE rung WHEN 'failed' THEN NULL WHEN 'fuzzy' THEN round(score, 6) ELSE 1.0 END AS score FROM g)
"""


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(SPARK_QUOTES)[0](spark, sf_dir).withColumnRenamed("turn_id", "row_id")


def text_offset_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grounding.with_offsets(plan("SELECT turn_id, text FROM turn")[0](spark, sf_dir), "text", "norm", "offsets")
    return rows.select("turn_id", "norm", F.array_join(F.transform("offsets", lambda i: i.cast("string")), ",").alias("offsets"))


def ground_quotes_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grounding.ground(_quotes(spark, sf_dir))
    return found.select(F.col("row_id").alias("turn_id"), "rung", "start", "end", F.round("score", 6).alias("score"))


def ground_quotes_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the fuzzy rung: the closest span of whole words of every normalised turn."""
    rows = _quotes(spark, sf_dir)
    both = cut(grounding.with_offsets(grounding.with_offsets(rows, "text", "n", "o"), "quote", "q", "oq"))
    found = grounding.closest_spans(both.select("row_id", F.col("n").alias("text"), F.col("q").alias("quote")))
    return found.select(F.col("row_id").alias("turn_id"), F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), F.round("score", 6).alias("score"))


def ground_claims_all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's quotes as one claim."""
    return grounding.grounded_claims(_quotes(spark, sf_dir).withColumnRenamed("conv_id", "claim_id"))


def _oracle(body: str) -> str:
    return render(with_views(BRUTE + body, ()), False)


QUERIES = {
    "text_offset_map": text_offset_map,
    "ground_quotes_ladder": ground_quotes_ladder,
    "ground_quotes_fuzzy": ground_quotes_fuzzy,
    "ground_claims_all_or_nothing": ground_claims_all_or_nothing,
}
ORACLE = {
    "text_offset_map": _oracle("SELECT turn_id, norm, array_to_string(plc, ',') AS offsets FROM z"),
    "ground_quotes_ladder": _oracle('SELECT turn_id, rung, "start", "end", score FROM r'),
    "ground_quotes_fuzzy": _oracle("SELECT turn_id, s, e, round(score, 6) AS score FROM best"),
    "ground_claims_all_or_nothing": _oracle(
        "SELECT conv_id AS claim_id, bool_and(rung <> 'failed') AS grounded, count(*) AS quotes, "
        + ", ".join(f"count(*) FILTER (rung = '{r}') AS {r}" for r in ("exact", "normalised", "fuzzy", "failed")) + " FROM r GROUP BY conv_id"
    ),
}
