"""Line dedup: lines that many documents share go from all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenlace.llm.common import cut, table

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII blanks at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop every line whose key stands in at least ``min_docs`` documents; keep the rest in order.

    Returns id, text (the kept lines joined by newline; null when the text was null), n_lines,
    n_dropped. A null or empty text is one empty line. Keys of fewer than ``min_chars`` code
    points are never dropped. A document is a distinct id (all null ids are one document);
    repeated rows count once and each gets its own result row. An empty table gives an empty
    result. Further columns are ignored.

    Only 128-bit line hashes are shuffled for counting, once per document and line; counts are
    summed on the map side, so a line in a third of all documents costs a row per task. The hashes
    over the limit meet the exploded lines in a join that adaptive execution may split, and only
    positions of dropped lines go back to their documents.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).withColumn("th", F.md5(F.coalesce("t", F.lit("")).cast("binary")))
    lines = F.split(F.coalesce(F.col("t"), F.lit("")), "\n", -1)
    exploded = (
        base.select("id", "th", F.posexplode(lines).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .filter(F.length("key") >= min_chars)
        .select("id", "th", "pos", F.unhex(F.md5(F.col("key").cast("binary"))).alias("h"))
    )
    frequent = cut(
        exploded.select("id", "h").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).select("h")
    )
    dropped = exploded.join(frequent, "h", "left_semi").groupBy("id", "th").agg(F.collect_set("pos").alias("gone"))
    joined = base.alias("b").join(
        dropped.alias("d"), F.col("b.id").eqNullSafe(F.col("d.id")) & (F.col("b.th") == F.col("d.th")), "left"
    )
    n = F.size("ls")
    rest = F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("t")).otherwise(
        F.array_join(F.transform(rest, lambda i: F.element_at(F.col("ls"), i + 1)), "\n")
    )
    return joined.select(F.col("b.id").alias("id"), F.col("b.t").alias("t"), F.col("d.gone").alias("gone"), lines.alias("ls")).select(
        F.col("id").alias(id_col),
        kept.alias(text_col),
        n.cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
