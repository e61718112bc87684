"""Selective prediction, calibration, agreement, sampling, cost and report operators."""

from __future__ import annotations

# running sums of errors from the highest score down, by bands of scores and inside each of them
CURVE = """
g AS (SELECT score, CAST(floor(score * 1024) AS BIGINT) AS band, count(*) AS n, sum(1 - label) AS errors FROM gate GROUP BY score),
bands AS (SELECT band, sum(n) AS n, sum(errors) AS errors FROM g GROUP BY band),
o AS (SELECT band, coalesce(sum(n) OVER above, 0) AS n0, coalesce(sum(errors) OVER above, 0) AS e0, sum(n) OVER () AS total FROM bands
      WINDOW above AS (ORDER BY band DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT g.score, g.n, g.errors, o.n0 + sum(g.n) OVER inside AS cum_n, o.e0 + sum(g.errors) OVER inside AS cum_e, o.total FROM g JOIN o ON o.band = g.band
      WINDOW inside AS (PARTITION BY g.band ORDER BY g.score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
PLAIN_CURVE = """
g AS (SELECT score, count(*) AS n, sum(1 - label) AS errors FROM gate GROUP BY score),
c AS (SELECT score, n, errors, sum(n) OVER o AS cum_n, sum(errors) OVER o AS cum_e, sum(n) OVER () AS total FROM g
      WINDOW o AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
RESULT = """
res AS (SELECT l.doc_id, CASE l.doc_id % 4 WHEN 0 THEN 'single' WHEN 1 THEN 'multi' WHEN 2 THEN 'temporal' ELSE 'open' END AS category,
        CASE WHEN l.doc_id % 5 = 0 THEN 'abstain' ELSE 'answer' END AS outcome, CASE WHEN l.doc_id % 10 = 0 THEN 'gate' ELSE 'fallback' END AS cause,
        CAST(l.quality AS DOUBLE) * ((l.doc_id % 9) + 1) / 9 AS f1, l.quality, l.toxic FROM labels l)"""

PLANS = {
    "risk_coverage_curve": f"WITH {CURVE} SELECT score, round(CAST(cum_n AS DOUBLE) / total, 6) AS coverage, round(CAST(cum_e AS DOUBLE) / cum_n, 6) AS risk FROM c",
    "aurc": f"""WITH {CURVE},
i AS (SELECT n, errors, cum_n, cum_e, @seq(1, n) AS k FROM c)
SELECT round(avg((cum_e - errors + CAST(errors AS DOUBLE) * k / n) / (cum_n - n + k)), 6) AS aurc FROM i""",
    "reweight_prevalence": """
SELECT label, count(*) AS n, round(CASE label WHEN 0 THEN 0.06 / (CAST(count(*) AS DOUBLE) / sum(count(*)) OVER ()) ELSE 0.94 / (CAST(count(*) AS DOUBLE) / sum(count(*)) OVER ()) END, 6) AS weight FROM gate GROUP BY label""",
    "selective_metrics": """
SELECT round(CAST(count(CASE WHEN score >= 0.5 THEN 1 END) AS DOUBLE) / count(*), 6) AS coverage,
       round(CAST(count(CASE WHEN score >= 0.5 AND label = 0 THEN 1 END) AS DOUBLE) / nullif(count(CASE WHEN score >= 0.5 THEN 1 END), 0), 6) AS risk,
       round(CAST(count(CASE WHEN score < 0.5 AND label = 0 THEN 1 END) AS DOUBLE) / nullif(count(CASE WHEN label = 0 THEN 1 END), 0), 6) AS abstention_recall,
       round(CAST(count(CASE WHEN score < 0.5 AND label = 1 THEN 1 END) AS DOUBLE) / nullif(count(CASE WHEN label = 1 THEN 1 END), 0), 6) AS false_abstention FROM gate""",
    # risk of the answered ones, weighted so that 0.06 of all are unanswerable; at most 0.03 is allowed
    "choose_threshold": f"""WITH {CURVE},
w AS (SELECT CAST(count(CASE WHEN label = 0 THEN 1 END) AS DOUBLE) AS n0, CAST(count(CASE WHEN label = 1 THEN 1 END) AS DOUBLE) AS n1 FROM gate),
r AS (SELECT score, cum_n = total AS everything, CASE WHEN n0 = 0 OR n1 = 0 THEN CAST(cum_e AS DOUBLE) / cum_n
             ELSE 0.06 * cum_e / n0 / (0.06 * cum_e / n0 + 0.94 * (cum_n - cum_e) / n1) END AS risk FROM c CROSS JOIN w)
SELECT coalesce(min(CASE WHEN risk <= 0.03 THEN score END), max(score)) AS threshold, count(CASE WHEN risk <= 0.03 THEN 1 END) > 0 AS met,
       coalesce(bool_or(everything AND risk <= 0.03), false) AS vacuous FROM r""",
    "pair_accuracy": """
WITH p AS (SELECT group_id, @idiv(item_id, 40) AS b, max(CASE WHEN label = 1 THEN score END) AS pos, max(CASE WHEN label = 0 THEN score END) AS neg, count(*) AS n,
                  count(CASE WHEN label = 1 THEN 1 END) AS np FROM gate GROUP BY group_id, @idiv(item_id, 40))
SELECT count(*) AS pairs, count(CASE WHEN pos > neg THEN 1 END) AS right_order FROM p WHERE n = 2 AND np = 1""",
    "brier_ece": """
WITH b AS (SELECT score, label, CASE WHEN score <= 0 THEN 0 ELSE least(9, CAST(ceil(score * 10) AS INT) - 1) END AS bin FROM gate),
e AS (SELECT bin, count(*) AS n, avg(score) AS conf, avg(CAST(label AS DOUBLE)) AS acc FROM b GROUP BY bin)
SELECT round((SELECT avg((score - label) * (score - label)) FROM gate), 6) AS brier, round(sum(n * abs(conf - acc)) / sum(n), 6) AS ece FROM e""",
    "mcnemar_counts": """
SELECT count(CASE WHEN quality = 1 AND toxic = 0 THEN 1 END) AS only_a, count(CASE WHEN quality = 0 AND toxic = 1 THEN 1 END) AS only_b, count(*) AS n FROM labels""",
    "cohen_kappa": """
WITH t AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(CASE WHEN quality = toxic THEN 1 END) AS agree, sum(quality) AS a, sum(toxic) AS b FROM labels)
SELECT round((agree / n - (a / n * b / n + (1 - a / n) * (1 - b / n))) / (1 - (a / n * b / n + (1 - a / n) * (1 - b / n))), 6) AS kappa FROM t""",
    "macro_f1": """
WITH c AS (SELECT 1 AS cls, count(CASE WHEN quality = 1 AND toxic = 1 THEN 1 END) AS tp, count(CASE WHEN quality = 0 AND toxic = 1 THEN 1 END) AS fp, count(CASE WHEN quality = 1 AND toxic = 0 THEN 1 END) AS fn FROM labels
  UNION ALL SELECT 0, count(CASE WHEN quality = 0 AND toxic = 0 THEN 1 END), count(CASE WHEN quality = 1 AND toxic = 0 THEN 1 END), count(CASE WHEN quality = 0 AND toxic = 1 THEN 1 END) FROM labels
  UNION ALL SELECT 2, 0, 0, 0)
SELECT round(avg(CASE WHEN tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END), 6) AS macro_f1, count(CASE WHEN tp + fp + fn > 0 THEN 1 END) AS classes FROM c""",
    "slot_scores": f"""WITH {RESULT}
SELECT category, count(CASE WHEN quality = 1 AND toxic = 1 THEN 1 END) AS tp, count(CASE WHEN quality <> toxic THEN 1 END) AS fp_and_fn, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM res GROUP BY category""",
    "spearman_ties": """
WITH r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rs, rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1) / 2.0 AS rl FROM gate)
SELECT round(corr(CAST(rs AS DOUBLE), CAST(rl AS DOUBLE)), 6) AS rho FROM r""",
    "score_by_category": f"""WITH {RESULT},
s AS (SELECT category, f1, outcome FROM res UNION ALL SELECT 'overall' AS category, f1, outcome FROM res)
SELECT category, count(*) AS n, count(CASE WHEN outcome = 'answer' THEN 1 END) AS answered, round(avg(CASE WHEN outcome = 'answer' THEN f1 ELSE 0.0 END), 6) AS f1_all,
       round(avg(CASE WHEN outcome = 'answer' THEN f1 END), 6) AS f1_answered FROM s GROUP BY category""",
    "abstain_by_cause": f"WITH {RESULT} SELECT cause, count(*) AS n FROM res WHERE outcome = 'abstain' GROUP BY cause",
    "class_weights": "SELECT label, round(CAST(sum(count(*)) OVER () AS DOUBLE) / (2 * count(*)), 6) AS weight FROM gate GROUP BY label",
    "split_train_dev_test": """
SELECT item_id, CASE WHEN rn <= round(n * 0.6) THEN 'train' WHEN rn <= round(n * 0.8) THEN 'dev' ELSE 'test' END AS part FROM (
  SELECT item_id, row_number() OVER (PARTITION BY group_id ORDER BY @sha16('split', CAST(item_id AS STRING))) AS rn, count(*) OVER (PARTITION BY group_id) AS n FROM gate) g""",
    "similarity_arm_grid": """
WITH t AS (SELECT @seq(0, 20) AS i FROM region WHERE r_regionkey = 0), h AS (SELECT i, count(CASE WHEN (score >= i / 20.0) = (label = 1) THEN 1 END) AS hits FROM gate JOIN t ON true GROUP BY i)
SELECT min(i) AS step, max(hits) AS hits FROM h WHERE hits = (SELECT max(hits) FROM h)""",
    "adjudication_items": "SELECT doc_id, quality AS pass_a, toxic AS pass_b FROM labels WHERE quality <> toxic",
    "ordering_gap": """
WITH p AS (SELECT group_id, item_id, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, item_id) AS a, row_number() OVER (PARTITION BY group_id ORDER BY item_id) AS b, count(*) OVER (PARTITION BY group_id) AS n FROM gate)
SELECT group_id, round(1 - 6.0 * sum((a - b) * (a - b)) / (max(n) * (max(n) * max(n) - 1)), 6) AS rank_correlation FROM p WHERE n > 1 GROUP BY group_id""",
    "ceilings_1_to_4": """
SELECT conv_id, count(*) AS assertions, round(CAST(count(CASE WHEN eligibility = 'eligible' THEN 1 END) AS DOUBLE) / count(*), 6) AS extraction,
       round(CAST(count(CASE WHEN eligibility = 'eligible' AND ix < 4 THEN 1 END) AS DOUBLE) / nullif(count(CASE WHEN eligibility = 'eligible' THEN 1 END), 0), 6) AS graph FROM assertion GROUP BY conv_id""",
    "packing_survival": """
WITH t AS (SELECT turn_id, conv_id, ix, sum(@idiv(length(text), 4)) OVER (PARTITION BY conv_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM turn),
b AS (SELECT CAST(160 AS BIGINT) AS budget UNION ALL SELECT 512 UNION ALL SELECT 1024)
SELECT budget, conv_id, count(CASE WHEN used <= budget OR ix = 0 THEN 1 END) AS kept, count(*) AS n FROM t JOIN b ON true GROUP BY budget, conv_id""",
    "bakeoff_decide": """
WITH c AS (SELECT source AS arm, count(*) AS n, round(CAST(sum(n_chars) AS DOUBLE) / count(*), 6) AS rate, CAST(count(CASE WHEN n_chars < 60 THEN 1 END) AS DOUBLE) / count(*) AS failures FROM documents GROUP BY source)
SELECT arm, rate, rate >= 0.99 * (SELECT max(rate) FROM c WHERE failures < 0.02) AS in_band FROM c WHERE failures < 0.02""",
    "gate_feature_row": """
SELECT group_id, round(max(score), 6) AS top, round(sum(CASE WHEN rn <= 3 THEN score ELSE 0.0 END), 6) AS top3, round(avg(score), 6) AS mean FROM (
  SELECT group_id, score, row_number() OVER (PARTITION BY group_id ORDER BY score DESC) AS rn FROM gate) g GROUP BY group_id""",
    "group_advantage": """
SELECT item_id, round(CASE WHEN count(*) OVER g = 1 THEN 0.0 ELSE (score - avg(score) OVER g) / (stddev_pop(score) OVER g + 0.000001) END, 5) AS advantage FROM gate WINDOW g AS (PARTITION BY group_id)""",
    "first_under_threshold": "SELECT key, min(CASE WHEN value < 1 THEN seq END) AS first_seq FROM log GROUP BY key",
}

#: The same curves in one pass over all scores.
PLAIN = {n: PLANS[n].replace(CURVE, PLAIN_CURVE) for n in ("risk_coverage_curve", "aurc", "choose_threshold")}
