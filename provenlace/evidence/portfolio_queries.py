"""Registered queries of the set searches over the derived graph tables; what SQL can express has an oracle written apart."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenlace.evidence import checks, diversity, portfolio
from provenlace.evidence.queries import H_SQL, H_TABLES, TABLES, _oracle, derived
from provenlace.plans.dialect import plan, render
from provenlace.plans.views import with_views
from provenlace.storage import cut

#: Each atom's worth and speaker: what an assertion entails, a little for what ties assertions together.
WORTH = {
    "worth": """
SELECT conv_id AS question_id, concat('a/', turn_id) AS atom_id, entailed_score AS worth, speaker FROM assertion
UNION ALL SELECT conv_id, concat('e/', edge_id), CAST(3 AS DOUBLE) / 10, CAST(NULL AS STRING) FROM edge
UNION ALL SELECT conv_id, concat('b/', turn_id), CAST(1 AS DOUBLE) / 2, CAST(NULL AS STRING) FROM turn WHERE ix < 2""",
}
GIVEN = TABLES | WORTH
#: Sets to be minimised: the first turns' atoms that a valid set may hold, with some of their edges and what these lead to.
WHOLE = TABLES | {
    "member": """
SELECT a.conv_id AS set_id, concat('a/', a.turn_id) AS atom_id FROM assertion a WHERE a.eligibility = 'eligible' AND a.ix < 4
UNION ALL SELECT e.conv_id, concat('e/', e.edge_id) FROM edge e JOIN assertion a ON a.turn_id = e.src WHERE a.eligibility = 'eligible' AND a.ix < 4 AND length(e.dst) % 3 = 0
UNION ALL SELECT DISTINCT e.conv_id, concat('x/', e.dst) FROM edge e JOIN assertion a ON a.turn_id = e.src WHERE a.eligibility = 'eligible' AND a.ix < 4 AND length(e.dst) % 3 = 0
UNION ALL SELECT a.conv_id, concat('b/', a.turn_id) FROM assertion a WHERE a.eligibility = 'eligible' AND a.ix < 1""",
}
SAME, SIZE = 0.2, 0.05


def _dated(bodies: dict[str, str]) -> dict[str, str]:
    """bodies that read edges with their validity from one view, so the edges meet it once and not for each use."""
    dated = {n: b.replace("FROM edge e JOIN validity v ON v.turn_id = e.src", "FROM dated e WHERE e.timed").replace("v.hi", "e.hi") for n, b in bodies.items()}
    return {n: re.sub(r"\b(FROM|JOIN) edge\b", r"\1 dated", b) for n, b in dated.items()}


def utility(chosen: Column) -> Column:
    """Worths less 0.2 for each atom beyond the first of a speaker and 0.05 for every atom."""
    known = F.filter(F.transform(chosen, lambda x: x["speaker"]), lambda s: s.isNotNull())
    total = F.aggregate(chosen, F.lit(0.0), lambda s, x: s + F.coalesce(x["worth"], F.lit(0.0)))
    return total - SAME * (F.size(known) - F.size(F.array_distinct(known))) - SIZE * F.size(chosen)


def _given(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    tables = derived(spark, sf_dir, [*H_TABLES, "worth"], _dated(GIVEN))
    return tables, tables.pop("worth")


def _listed(column: str) -> Column:
    return F.array_join(column, " ").alias(column)


def search_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.beam(*_given(spark, sf_dir), utility, width=4, max_atoms=6).select("question_id", "place", _listed("atoms"), "score")


def search_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.greedy(*_given(spark, sf_dir), utility, openers=4, max_atoms=6).select("question_id", "opener", _listed("atoms"), "score")


def select_by_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.by_relevance(*_given(spark, sf_dir), max_atoms=6).select("question_id", "valid", _listed("codes"), _listed("atoms"))


def minimise_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = derived(spark, sf_dir, H_TABLES, _dated(WHOLE))
    # what fails alone is in no set here, so only the rest is written
    told = cut(checks.facts(tables).filter("NOT alone"))
    fit = portfolio.pool(tables, tables["atom"].select("question_id", "atom_id"), 1000, told).select(F.col("question_id").alias("set_id"), "atom.atom_id")
    tables["member"] = tables["member"].join(fit, ["set_id", "atom_id"], "left_semi")
    return portfolio.minimise(tables, 1000, told).select("set_id", _listed("atoms"), "removed", "passes", "evidence")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's set twice, as two candidates."""
    tables = derived(spark, sf_dir, H_TABLES)
    listed = tables["member"].groupBy("set_id").agg(F.collect_set("atom_id").alias("atoms"))
    twice = tables["sets"].join(listed, "set_id").withColumn("place", F.explode(F.array(F.lit(1), F.lit(2))))
    return portfolio.h_filter(twice, tables, budget=1)


def set_filter_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("question_id", "place", "checked", "valid", _listed("codes"))


def set_filter_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.rejections(_judged(spark, sf_dir))


def portfolio_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns as sets of words, within the words of the conversation."""
    words = cut(plan("SELECT conv_id AS question_id, ix AS place, tok FROM turn_token")[0](spark, sf_dir))
    sets = words.groupBy("question_id", "place").agg(F.collect_list("tok").alias("atoms"))
    found = diversity.diversity(sets, words.groupBy("question_id").agg(F.countDistinct("tok").alias("atoms")))
    return found.select("question_id", "sets", *[F.round(c, 6).alias(c) for c in ("observed", "chance", "excess")])


DIVERSITY_SQL = """
WITH w AS (SELECT DISTINCT conv_id AS question_id, ix AS place, tok FROM turn_token), n AS (SELECT question_id, place, count(*) AS n FROM w GROUP BY question_id, place),
u AS (SELECT question_id, count(DISTINCT tok) AS u FROM w GROUP BY question_id),
p AS (SELECT a.question_id, a.place AS x, b.place AS y, a.n AS a, b.n AS b, u, (SELECT count(*) FROM w v JOIN w z ON z.question_id = v.question_id AND z.tok = v.tok WHERE v.question_id = a.question_id
        AND v.place = a.place AND z.place = b.place) AS k FROM n a JOIN n b ON b.question_id = a.question_id AND a.place < b.place JOIN u ON u.question_id = a.question_id),
s AS (SELECT DISTINCT a, b, u FROM p),
h AS (SELECT a, b, u, k, exp(lgamma(a + 1) - lgamma(k + 1) - lgamma(a - k + 1) + lgamma(u - a + 1) - lgamma(b - k + 1) - lgamma(u - a - b + k + 1) - lgamma(u + 1) + lgamma(b + 1) + lgamma(u - b + 1)) AS mass
      FROM s, generate_series(greatest(0, a + b - u), least(a, b)) g(k)),
e AS (SELECT a, b, u, sum(mass * (1 - k / CAST(a + b - k AS DOUBLE))) AS e FROM h GROUP BY a, b, u),
d AS (SELECT question_id, avg(1 - k / CAST(p.a + p.b - k AS DOUBLE)) AS observed, avg(e.e) AS chance FROM p JOIN e ON e.a = p.a AND e.b = p.b AND e.u = p.u GROUP BY question_id)
SELECT n.question_id, count(*) AS sets, round(coalesce(max(observed), 0.0), 6) AS observed, round(coalesce(max(chance), 0.0), 6) AS chance, round(coalesce(max(observed) - max(chance), 0.0), 6) AS excess
FROM n LEFT JOIN d ON d.question_id = n.question_id GROUP BY n.question_id"""

QUERIES = {
    "portfolio_diversity": portfolio_diversity,
    "search_beam": search_beam,
    "search_greedy": search_greedy,
    "select_by_relevance": select_by_relevance,
    "minimise_structural": minimise_structural,
    "set_filter_verdicts": set_filter_verdicts,
    "set_filter_rejections": set_filter_rejections,
}
ORACLE = {
    "portfolio_diversity": render(with_views(DIVERSITY_SQL, (), plain=True), False),
    "set_filter_verdicts": _oracle(
        H_SQL + "SELECT m.set_id AS question_id, p.place, true AS checked, count(d.code) = 0 AS valid, coalesce(string_agg(DISTINCT d.code, ' ' ORDER BY d.code), '') AS codes "
        "FROM (SELECT DISTINCT set_id FROM g_member) m CROSS JOIN (VALUES (1), (2)) p(place) LEFT JOIN d ON d.set_id = m.set_id GROUP BY m.set_id, p.place", H_TABLES),
    "set_filter_rejections": _oracle(
        H_SQL + "SELECT c.code, c.name, count(DISTINCT d.set_id) AS sets FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in checks.CODES.items())
        + ") c(code, name) LEFT JOIN d ON d.code = c.code GROUP BY c.code, c.name", H_TABLES),
}
