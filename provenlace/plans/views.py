"""Shared views: the evidence-graph model over the supplied tables."""

from __future__ import annotations

import re

#: An answer's articles, and words that retrieval leaves out.
ARTICLES = "a an the"
STOPWORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
STOPPED = ", ".join(f"'{w}'" for w in STOPWORDS.split())
EPOCH = 1704067200
TAU = 0.8

VIEWS = {
    "turn": f"""
SELECT concat('conv/', CAST(conv_id AS STRING), '/', CAST(turn AS STRING)) AS turn_id, CAST(conv_id AS STRING) AS conv_id, turn AS ix,
       role AS speaker, {EPOCH} + conv_id * 86400 + turn * 60 AS ts, text FROM conversations""",
    "assertion": f"""
SELECT *, @sha16('assertion', kind, text_norm, span_id) AS assertion_id,
       CASE WHEN entailed_score >= {TAU} AND speaker <> 'system' THEN 'eligible' ELSE 'quarantined' END AS eligibility
FROM (SELECT turn_id, conv_id, ix, speaker, ts, trim(@rr(lower(text), '\\s+', ' ')) AS text_norm,
             @sha16('span', turn_id, '0', CAST(length(text) AS STRING)) AS span_id,
             CASE ix % 3 WHEN 0 THEN 'claim' WHEN 1 THEN 'value' ELSE 'event' END AS kind,
             CAST(length(text) % 101 AS DOUBLE) / 100 AS entailed_score FROM turn) t""",
    "turn_token": """
SELECT DISTINCT turn_id, conv_id, ix, ts, speaker, tok FROM (
  SELECT turn_id, conv_id, ix, ts, speaker, @explode(@words(@rr(lower(text), '[^\\p{L}\\p{N}_]+', ' '))) AS tok FROM turn) t""",
    "edge": """
SELECT @sha16('edge', 'about_entity', turn_id, concat(conv_id, ':', tok)) AS edge_id, 'about_entity' AS etype, turn_id AS src,
       concat(conv_id, ':', tok) AS dst, ts AS t_created, conv_id FROM turn_token WHERE length(tok) >= 7""",
    "early": """
SELECT @sha16('edge', 'about_entity', turn_id, concat(conv_id, ':', tok)) AS edge_id, 'about_entity' AS etype, turn_id AS src,
       concat(conv_id, ':', tok) AS dst, ts AS t_created, conv_id, ix FROM turn_token WHERE length(tok) >= 7 AND ix < 3""",
    "validity": """
SELECT turn_id, conv_id, speaker, ts AS lo, lead(ts) OVER (PARTITION BY conv_id, speaker ORDER BY ix) AS hi FROM turn""",
    # edges with what their turn's validity says, so that who asks for it joins no more
    "dated": """
SELECT e.*, v.hi, v.turn_id IS NOT NULL AS timed FROM edge e LEFT JOIN validity v ON v.turn_id = e.src""",
    "question": f"""
SELECT item_id AS question_id, text, {EPOCH} + item_id * 43200 AS tc_start, {EPOCH} + item_id * 43200 + 604800 AS tc_end FROM benchmark""",
    "question_token": f"""
SELECT DISTINCT question_id, tok FROM (
  SELECT question_id, @explode(@words(@rr(lower(text), '[^\\p{{L}}\\p{{N}}_]+', ' '))) AS tok FROM question) q
WHERE tok NOT IN ({STOPPED})""",
    "doc_token": f"""
SELECT turn_id AS doc, tok, count(*) AS tf FROM (
  SELECT turn_id, @explode(@words(@rr(text_norm, '[^\\p{{L}}\\p{{N}}_]+', ' '))) AS tok FROM assertion WHERE eligibility = 'eligible') d
WHERE tok NOT IN ({STOPPED}) GROUP BY turn_id, tok""",
    "bm25": """
SELECT question_id, d.doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score
FROM question_token q JOIN doc_token d ON q.tok = d.tok
JOIN (SELECT tok, CAST(count(*) AS DOUBLE) AS df FROM doc_token GROUP BY tok) f ON f.tok = d.tok
JOIN (SELECT doc, CAST(sum(tf) AS DOUBLE) AS dl FROM doc_token GROUP BY doc) l ON l.doc = d.doc
CROSS JOIN (SELECT CAST(count(DISTINCT doc) AS DOUBLE) AS n, CAST(sum(tf) AS DOUBLE) / count(DISTINCT doc) AS avgdl FROM doc_token) c
GROUP BY question_id, d.doc""",
    # numbered in two levels: by blocks of 65,536 ids, whose sizes are few, and inside each of them
    "log": """
SELECT CAST(o.off + row_number() OVER (PARTITION BY o.block ORDER BY e.event_id) - 1 AS BIGINT) AS seq,
       CASE e.event_type WHEN 'signup' THEN 'node.add' WHEN 'view' THEN 'edge.add' WHEN 'error' THEN 'edge.invalidate'
                       WHEN 'purchase' THEN 'assertion.add' ELSE 'assertion.set_eligibility' END AS op,
       CAST(e.user_id AS STRING) AS key, e.props AS payload, e.value, e.event_id
FROM events e JOIN (
  SELECT block, coalesce(sum(n) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM (SELECT @idiv(event_id, 65536) AS block, count(*) AS n FROM events GROUP BY @idiv(event_id, 65536)) b) o ON o.block = @idiv(e.event_id, 65536)""",
    "gate": """
SELECT d.doc_id AS item_id, d.source AS group_id, CAST((d.n_chars * 37 + d.doc_id * 11) % 997 AS DOUBLE) / 996 AS score, l.quality AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "vec": """
SELECT vec_id, embedding, label, sqrt(@dot(embedding, embedding)) AS norm FROM embeddings""",
    "atom": """
SELECT a.item_id AS set_id, b.n_nationkey AS atom, b.n_regionkey AS ref, CAST(b.n_nationkey % 7 AS DOUBLE) / 6 AS tier
FROM benchmark a JOIN nation b ON (a.item_id * 13 + b.n_nationkey * b.n_nationkey + b.n_nationkey * 7) % 11 < 4""",
}

#: Views that the oracle has in another, plainer form.
PLAIN = {
    "log": """
SELECT row_number() OVER (ORDER BY event_id) - 1 AS seq,
       CASE event_type WHEN 'signup' THEN 'node.add' WHEN 'view' THEN 'edge.add' WHEN 'error' THEN 'edge.invalidate'
                       WHEN 'purchase' THEN 'assertion.add' ELSE 'assertion.set_eligibility' END AS op,
       CAST(user_id AS STRING) AS key, props AS payload, value, event_id FROM events""",
}


def with_views(body: str, views: tuple[str, ...], plain: bool = False) -> str:
    """body after the views it names and, before them, those that they read themselves."""
    order: list[str] = []
    bodies = VIEWS | PLAIN if plain else VIEWS

    def need(name: str) -> None:
        if name in order:
            return
        for other in VIEWS:
            if other != name and re.search(rf"\b(FROM|JOIN) {other}\b", bodies[name]):
                need(other)
        order.append(name)

    for name in [v for v in VIEWS if v in views or re.search(rf"\b(FROM|JOIN) {v}\b", body)]:
        need(name)
    head = ",\n".join(f"{v} AS ({bodies[v]})" for v in order)
    if not order:
        return body
    own = re.match(r"\s*WITH (RECURSIVE )?", body, re.IGNORECASE)
    return f"WITH {own[1] or ''}{head},\n{body[own.end() :]}" if own else f"WITH {head}\n{body}"
