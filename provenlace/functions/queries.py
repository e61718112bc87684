"""Registered queries of the time, interval and anchor functions, with SQL written apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provenlace.functions import anchors, intervals, time_phrases
from provenlace.plans.dialect import plan, render
from provenlace.plans.views import with_views

ASKED = "SELECT question_id, tc_start AS lo, tc_end AS hi FROM question"
HELD = "SELECT turn_id, lo, hi FROM validity"
#: A conversation's first turn asks; its longer words, in two spellings, are the titles.
ASKS = "SELECT conv_id AS question_id, text FROM turn WHERE ix = 0"
STEPS = "SELECT conv_id AS question_id, CASE WHEN CAST(conv_id AS BIGINT) % 5 = 0 THEN '#1 >> of' ELSE concat(substr(text, 1, 24), ' >> of') END AS step FROM turn WHERE ix = 0"
TITLES = "SELECT DISTINCT conv_id AS question_id, CASE WHEN length(tok) % 2 = 0 AND @rlike(tok, '^[a-z]+$') THEN upper(tok) ELSE tok END AS title FROM turn_token WHERE length(tok) >= 5 AND ix < 3"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return plan(ASKED)[0](spark, sf_dir), plan(HELD)[0](spark, sf_dir)


def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlap_join(*_sides(spark, sf_dir), "question_id", "turn_id")


def interval_covered_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.covered_fraction(*_sides(spark, sf_dir), "question_id")


def anchor_longest_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.title_in_question(plan(ASKS)[0](spark, sf_dir), plan(TITLES)[0](spark, sf_dir))


def anchor_step_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.subject_title(plan(STEPS)[0](spark, sf_dir), plan(TITLES)[0](spark, sf_dir))


def _oracle(body: str, **tables: str) -> str:
    head = ", ".join(f"{n} AS ({b})" for n, b in tables.items())
    return render(with_views(f"WITH {head} {body}", ()), False)


FIRST_TITLE = "SELECT question_id, title AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY length(title) DESC, title) AS rn FROM found) f WHERE rn = 1"
QUERIES = {
    "interval_overlap_join": interval_overlap_join,
    "interval_covered_fraction": interval_covered_fraction,
    "anchor_longest_title": anchor_longest_title,
    "anchor_step_subject": anchor_step_subject,
    "time_phrase_resolve": time_phrases.time_phrase_resolve,
}
ORACLE = {
    "interval_overlap_join": _oracle(
        "SELECT question_id, turn_id FROM asked q JOIN held v ON q.lo < coalesce(v.hi, 1e18) AND v.lo < q.hi AND v.lo < coalesce(v.hi, 1e18)", asked=ASKED, held=HELD),
    # time is cut at every bound: a piece is covered or not as a whole
    "interval_covered_fraction": _oracle("""
, pair AS (SELECT question_id, greatest(q.lo, v.lo) AS a, least(q.hi, coalesce(v.hi, q.hi)) AS b FROM asked q JOIN held v ON greatest(q.lo, v.lo) < least(q.hi, coalesce(v.hi, q.hi))),
bound AS (SELECT question_id, a AS t FROM pair UNION SELECT question_id, b FROM pair),
piece AS (SELECT question_id, t, lead(t) OVER (PARTITION BY question_id ORDER BY t) AS u FROM bound),
c AS (SELECT question_id, sum(u - t) AS covered FROM piece p WHERE u IS NOT NULL AND EXISTS (SELECT 1 FROM pair x WHERE x.question_id = p.question_id AND x.a <= p.t AND x.b >= p.u) GROUP BY question_id)
SELECT q.question_id, round(coalesce(covered, 0)::DOUBLE / (hi - lo), 6) AS fraction FROM asked q LEFT JOIN c ON c.question_id = q.question_id""", asked=ASKED, held=HELD),
    "anchor_longest_title": _oracle(f"""
, found AS (SELECT q.question_id, t.title FROM asks q JOIN titles t ON t.question_id = q.question_id AND instr(lower(regexp_replace(q.text, '\\s+', ' ', 'g')), lower(t.title)) > 0)
SELECT q.question_id, f.anchor FROM asks q LEFT JOIN ({FIRST_TITLE}) f ON f.question_id = q.question_id""", asks=ASKS, titles=TITLES),
    "anchor_step_subject": _oracle(f"""
, s AS (SELECT question_id, lower(trim(regexp_replace(split_part(step, '>>', 1), '\\s+', ' ', 'g'))) AS s FROM steps),
found AS (SELECT s.question_id, t.title FROM s JOIN titles t ON t.question_id = s.question_id AND s.s <> '' AND s.s NOT LIKE '#%' AND (instr(s.s, lower(t.title)) > 0 OR instr(lower(t.title), s.s) > 0))
SELECT q.question_id, f.anchor FROM steps q LEFT JOIN ({FIRST_TITLE}) f ON f.question_id = q.question_id""", steps=STEPS, titles=TITLES),
    "time_phrase_resolve": time_phrases.ORACLE,
}
