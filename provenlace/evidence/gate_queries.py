"""Registered queries of the gate: trained on documents' measures and their labels; the report of given scores has an oracle written apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenlace.evidence import gate
from provenlace.plans.dialect import plan, render
from provenlace.plans.views import with_views
from provenlace.storage import cut

FEATURES = ["words", "word_length", "distinct", "digits", "capitals", "marks", "lines"]


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with measures of their whole texts, three fifths of them to train."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda kind: F.regexp_count(text, F.lit(kind)) / size
    turn = F.pmod(F.xxhash64(F.lit("gate"), F.col("doc_id")), F.lit(5))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.alias("text"), words.alias("w"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return docs.join(labels, "doc_id").select(
        "doc_id", "label", F.when(turn == 0, "test").when(turn == 1, "dev").otherwise("train").alias("part"),
        F.log1p(F.size("w")).alias("words"), (size / F.greatest(F.size("w"), F.lit(1))).alias("word_length"), (F.size(F.array_distinct("w")) / F.greatest(F.size("w"), F.lit(1))).alias("distinct"),
        share("[0-9]").alias("digits"), share("[A-Z]").alias("capitals"), share(r"[^\p{L}\p{N}\s]").alias("marks"), F.log1p(F.regexp_count(text, F.lit("\n"))).alias("lines"),
    )


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(_measured(spark, sf_dir))
    return rows.withColumn("score", gate.predict(gate.train(rows, FEATURES)))


def gate_train_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", "part", "label", F.round("score", 4).alias("p_answerable"))


def gate_train_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the test part at the threshold that the dev part gives."""
    rows = cut(_scored(spark, sf_dir).select("part", "label", "score"))
    dev = rows.filter("part = 'dev'")
    at, _ = gate.threshold(gate.curve(dev, weights=gate.class_weights(dev, "label", gate.PREVALENCES["natural"])))
    return gate.evaluate(rows.filter("part = 'test'"), at=at).withColumn("value", F.round("value", 6))


def gate_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(plan("SELECT score, label FROM gate")[0](spark, sf_dir))
    return gate.evaluate(rows).withColumn("value", F.round("value", 6))


QUERIES = {"gate_train_predict": gate_train_predict, "gate_train_evaluate": gate_train_evaluate, "gate_evaluate": gate_evaluate}
ORACLE = {
    "gate_evaluate": render(with_views("""
WITH c AS (SELECT count(*) AS n, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM gate),
p(name, share) AS (VALUES ('natural', 0.06), ('constructed', 0.5)),
r AS (SELECT name, score, label, CASE label WHEN 0 THEN share * n / n0 ELSE (1 - share) * n / n1 END AS w FROM gate CROSS JOIN p CROSS JOIN c),
g AS (SELECT name, score, count(*) AS n, sum(w) AS w, sum(CASE label WHEN 0 THEN w ELSE 0 END) AS e FROM r GROUP BY name, score),
b AS (SELECT *, sum(w) OVER o - w AS w0, sum(e) OVER o - e AS e0 FROM g WINDOW o AS (PARTITION BY name ORDER BY score DESC)),
k AS (SELECT name, (e0 + e / n * i) / (w0 + w / n * i) AS risk FROM b, generate_series(1, n) s(i)),
t AS (SELECT coalesce(min(score) FILTER ((e0 + e) / (w0 + w) <= 0.03), max(score)) AS threshold, count(*) FILTER ((e0 + e) / (w0 + w) <= 0.03) > 0 AS met FROM b WHERE name = 'natural'),
x AS (SELECT g.score >= threshold AS said, label = 1 AS good, g.score, label FROM gate g CROSS JOIN t),
bins AS (SELECT count(*) AS n, abs(avg(score) - avg(label)) AS gap FROM gate GROUP BY CASE WHEN score <= 0 THEN 0 ELSE least(9, ceil(score * 10) - 1) END),
m(metric, value) AS (
  SELECT concat('aurc_', name), avg(risk) FROM k GROUP BY name
  UNION ALL SELECT 'threshold', threshold FROM t UNION ALL SELECT 'met', CASE WHEN met THEN 1 ELSE 0 END FROM t UNION ALL SELECT 'vacuous', 0
  UNION ALL SELECT 'coverage', avg(CASE WHEN said THEN 1 ELSE 0 END) FROM x
  UNION ALL SELECT 'selective_risk', avg(CASE WHEN good THEN 0 ELSE 1 END) FROM x WHERE said
  UNION ALL SELECT 'abstention_recall', avg(CASE WHEN said THEN 0 ELSE 1 END) FROM x WHERE NOT good
  UNION ALL SELECT 'false_abstention', avg(CASE WHEN said THEN 0 ELSE 1 END) FROM x WHERE good
  UNION ALL SELECT 'brier', avg((score - label) * (score - label)) FROM gate UNION ALL SELECT 'n', count(*) FROM gate
  UNION ALL SELECT 'ece', sum(n * gap) / sum(n) FROM bins)
SELECT metric, round(CAST(value AS DOUBLE), 6) AS value FROM m""", (), plain=True), False),
}
