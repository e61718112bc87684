"""Identity, text, answer, time and interval functions."""

from __future__ import annotations

from provenlace.plans.views import ARTICLES, EPOCH

ANSWER = f"@join(@words(@rr(concat(' ', trim(@rr(@rr(lower(@rr($, '\\[c[0-9]+\\]', ' ')), '[^\\p{{L}}\\p{{N}}_\\s]', ''), '\\s+', ' ')), ' '), ' ({'|'.join(ARTICLES.split())})(?: ({'|'.join(ARTICLES.split())}))* ', ' ')))"
answer = lambda c: ANSWER.replace("$", c, 1)

PAIRED = f"""
pairs AS (SELECT a.turn_id, a.conv_id, {answer("a.text")} AS p, {answer("b.text")} AS g
          FROM turn a JOIN turn b ON a.conv_id = b.conv_id AND b.ix = a.ix + 1),
pt AS (SELECT turn_id, tok, count(*) AS n FROM (SELECT turn_id, @explode(@words(p)) AS tok FROM pairs) x GROUP BY turn_id, tok),
gt AS (SELECT turn_id, tok, count(*) AS n FROM (SELECT turn_id, @explode(@words(g)) AS tok FROM pairs) x GROUP BY turn_id, tok),
met AS (SELECT pt.turn_id, CAST(sum(least(pt.n, gt.n)) AS BIGINT) AS common FROM pt JOIN gt ON pt.turn_id = gt.turn_id AND pt.tok = gt.tok GROUP BY pt.turn_id),
s AS (SELECT pairs.turn_id, @len(@words(p)) AS np, @len(@words(g)) AS ng, coalesce(common, 0) AS common FROM pairs LEFT JOIN met ON pairs.turn_id = met.turn_id)"""

PLANS = {
    "id_hash_span": "SELECT turn_id, @sha16('span', turn_id, '0', CAST(length(text) AS STRING)) AS span_id FROM turn",
    "id_hash_node_edge": """
SELECT turn_id, @sha16('node', 'Claim', turn_id) AS node_id, @sha16('edge', 'asserted_by', turn_id, speaker) AS edge_id,
       @sha16('atom', 'node', turn_id, '', conv_id) AS atom_id FROM turn""",
    "id_hash_set": """
SELECT conv_id, @sha16('set', members) AS set_hash FROM (SELECT conv_id, @sagg(turn_id, ',') AS members FROM turn GROUP BY conv_id) s""",
    "canonical_digest": """
SELECT item_id, @sha(concat('{"id":', CAST(item_id AS STRING), ',"len":', CAST(length(text) AS STRING), '}')) AS digest FROM benchmark""",
    "text_normalise": "SELECT turn_id, trim(@rr(lower(text), '\\s+', ' ')) AS text_norm FROM turn",
    "text_casefold": "SELECT doc_id, md5(trim(@rr(replace(lower(text), 'ß', 'ss'), '\\s+', ' '))) AS folded FROM documents",
    "text_answer_normalise": f"SELECT turn_id, {answer('text')} AS answer FROM turn",
    "text_approx_tokens": """
SELECT turn_id, @idiv((n * 13 + 9), 10) AS tokens FROM (SELECT turn_id, @len(@words(trim(@rr(text, '\\s+', ' ')))) AS n FROM turn) t""",
    "text_word_jaccard": """
SELECT a.turn_id, round(CASE WHEN @len(@uni(a.w, b.w)) = 0 THEN 0 ELSE CAST(@len(@inter(a.w, b.w)) AS DOUBLE) / @len(@uni(a.w, b.w)) END, 3) AS jaccard
FROM (SELECT turn_id, conv_id, ix, @distinct(@words(@rr(lower(text), '\\s+', ' '))) AS w FROM turn) a
JOIN (SELECT conv_id, ix, @distinct(@words(@rr(lower(text), '\\s+', ' '))) AS w FROM turn) b ON a.conv_id = b.conv_id AND b.ix = a.ix + 1""",
    "answer_token_f1": f"""WITH {PAIRED}
SELECT turn_id, round(CASE WHEN np = 0 AND ng = 0 THEN 1.0 WHEN common = 0 THEN 0.0 ELSE 2.0 * common / (np + ng) END, 6) AS f1 FROM s""",
    "answer_bleu1": f"""WITH {PAIRED}
SELECT turn_id, round(CASE WHEN np = 0 OR ng = 0 THEN CASE WHEN np = ng THEN 1.0 ELSE 0.0 END
  ELSE CAST(common AS DOUBLE) / np * CASE WHEN np > ng THEN 1.0 ELSE exp(1 - CAST(ng AS DOUBLE) / np) END END, 6) AS bleu1 FROM s""",
    "answer_equivalence": f"""WITH {PAIRED}
SELECT turn_id, p <> '' AND p = g AS same FROM pairs""",
    "format_date": """
SELECT item_id, said, CASE WHEN d IS NULL THEN substr(said, 1, 10) ELSE concat(CAST(day(d) AS STRING), ' ', CASE month(d) WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 3 THEN 'March' WHEN 4 THEN 'April'
       WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'July' WHEN 8 THEN 'August' WHEN 9 THEN 'September' WHEN 10 THEN 'October' WHEN 11 THEN 'November' ELSE 'December' END,
       ' ', CAST(year(d) AS STRING)) END AS shown
FROM (SELECT item_id, said, try_cast(said AS DATE) AS d FROM (
  SELECT item_id, CASE item_id % 8 WHEN 6 THEN 'some time last year' WHEN 7 THEN '' ELSE CAST(DATE '2024-01-01' + CAST(item_id * 29 % 731 AS INT) AS STRING) END AS said FROM benchmark) s) b""",
    "time_calendar_intervals": """
SELECT o_orderkey, @epochday(date_trunc('day', o_orderdate)) AS day_lo, @epochday(date_trunc('week', o_orderdate)) AS week_lo,
       @epochday(date_trunc('month', o_orderdate)) AS month_lo, @epochday(date_trunc('year', o_orderdate)) AS year_lo FROM orders""",
    # sine and cosine of days since a reference day, over four periods
    "relative_time_encoding": """
SELECT o_orderkey, round(sin(d), 6) AS sin1, round(cos(d), 6) AS cos1, round(sin(d / 7.0), 6) AS sin7, round(cos(d / 7.0), 6) AS cos7,
       round(sin(d / 30.0), 6) AS sin30, round(cos(d / 30.0), 6) AS cos30, round(sin(d / 365.0), 6) AS sin365, round(cos(d / 365.0), 6) AS cos365
FROM (SELECT o_orderkey, CAST(@epochday(o_orderdate) - 788918400 AS DOUBLE) / 86400 AS d FROM orders) o""",
    "sample_size_power": """
SELECT item_id, CAST(ceil(power((1.96 * sqrt(psi) + 0.84 * sqrt(psi - delta * delta)) / delta, 2)) AS BIGINT) AS n
FROM (SELECT item_id, 0.1 + (item_id % 10) * 0.05 AS psi, 0.05 + (item_id % 5) * 0.01 AS delta FROM benchmark) b""",
    "bitmask_encode": """
SELECT n_regionkey, CAST(sum(@shl(n_nationkey)) AS BIGINT) AS mask, CAST(count(*) AS BIGINT) AS members FROM nation GROUP BY n_regionkey""",
}
