"""The seven checks that a batch of graph commits passes before it is appended."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Names of the checks, which node types an edge type may join, and edge types that may not be loops.
CODES = {
    "V1": "endpoint", "V2": "id", "V3": "provenance", "V4": "eligibility", "V5": "interval", "V6": "duplicate", "V7": "supersession",
}
ENDPOINTS = {
    "mentioned_in": ("Mention", "Turn"),
    "asserted_by": ("Claim Value Event", "Source"),
    "about_entity": ("Claim Value Event", "Entity"),
    "has_value": ("Entity", "Value"),
    "valid_during": ("Claim Value Event", "TimeInterval"),
    "supported_by": ("Claim Value Event Entity Conflict", "SourceSpan"),
    "same_as": ("Entity", "Entity"),
    "contradicts": ("Claim Value Event", "Claim Value Event"),
    "supersedes": ("Claim Value Event", "Claim Value Event"),
    "derived_from": ("Conflict", "Claim"),
    "retired_by": ("Claim", "Turn"),
}
NO_LOOPS = "('same_as', 'contradicts', 'supersedes')"
BACKED = "('Claim', 'Value', 'Event')"
RULES = ", ".join(f"'{e}/{side}/{t}'" for e, sides in ENDPOINTS.items() for side, types in zip(("src", "dst"), sides, strict=True) for t in types.split())
TYPES = ", ".join(f"'{e}'" for e in ENDPOINTS)

# A commit's own node goes before the snapshot's of the same id; its edges' ends are looked up in both.
SHARED = f"""
own AS (SELECT commit_id, node_id, max_by(struct(ntype, assertion_id, lo, hi), pos) AS n FROM {{new_node}} GROUP BY commit_id, node_id),
stop AS (SELECT e.commit_id, e.edge_id, e.etype, x.side, x.node_id FROM {{new_edge}} e
         LATERAL VIEW inline(array(named_struct('side', 'src', 'node_id', e.src), named_struct('side', 'dst', 'node_id', e.dst))) x AS side, node_id),
seen AS (SELECT s.*, coalesce(o.n.ntype, n.ntype) AS ntype, CASE WHEN o.node_id IS NULL THEN n.lo ELSE o.n.lo END AS lo, CASE WHEN o.node_id IS NULL THEN n.hi ELSE o.n.hi END AS hi
         FROM stop s LEFT JOIN own o ON o.commit_id = s.commit_id AND o.node_id = s.node_id LEFT JOIN {{node}} n ON n.node_id = s.node_id)"""
# What V1 and V5 ask of the ends, of one pass over them.
ENDS = f"""SELECT commit_id, code, edge_id AS id FROM seen LATERAL VIEW explode(array_compact(array(
             CASE WHEN etype IN ({TYPES}) AND concat_ws('/', etype, side, ntype) NOT IN ({RULES}) THEN 'V1' END, CASE WHEN etype = 'valid_during' AND side = 'dst' AND hi <= lo THEN 'V5' END))) f AS code"""
BY_CODE = {
    "V1": f"""SELECT e.commit_id, e.edge_id AS id FROM {{new_edge}} e WHERE e.etype IS NULL OR e.etype NOT IN ({TYPES})""",
    "V2": f"""SELECT commit_id, node_id AS id FROM {{new_node}} GROUP BY commit_id, node_id HAVING count(DISTINCT struct(ntype, payload, array_sort(aliases))) > 1
              UNION ALL SELECT a.commit_id, a.node_id FROM {{new_node}} a JOIN {{node}} b ON b.node_id = a.node_id
              WHERE NOT (a.ntype <=> b.ntype AND a.payload <=> b.payload AND (array_sort(coalesce(a.aliases, array())) <=> array_sort(coalesce(b.aliases, array()))
                         OR (a.ntype = 'Entity' AND size(array_except(coalesce(b.aliases, array()), coalesce(a.aliases, array()))) = 0)))
              UNION ALL SELECT a.commit_id, a.node_id FROM {{new_node}} a JOIN {{node}} b ON b.assertion_id = a.assertion_id AND b.node_id <> a.node_id
              WHERE a.ntype IN {BACKED} AND b.ntype IN {BACKED}
              UNION ALL SELECT commit_id, node_id FROM (SELECT commit_id, node_id, lag(node_id) OVER (PARTITION BY commit_id, assertion_id ORDER BY pos) AS holder
                FROM {{new_node}} WHERE ntype IN {BACKED} AND assertion_id IS NOT NULL) h WHERE holder <> node_id
              UNION ALL SELECT commit_id, edge_id FROM {{new_edge}} GROUP BY commit_id, edge_id HAVING count(DISTINCT struct(etype, src, dst, t_created, t_invalid, superseded_by)) > 1
              UNION ALL SELECT a.commit_id, a.edge_id FROM {{new_edge}} a JOIN {{edge}} b ON b.edge_id = a.edge_id
              WHERE struct(a.etype, a.src, a.dst, a.t_created, a.t_invalid, a.superseded_by) <> struct(b.etype, b.src, b.dst, b.t_created, b.t_invalid, b.superseded_by)
                 OR NOT (a.t_invalid <=> b.t_invalid) OR NOT (a.superseded_by <=> b.superseded_by)""",
    "V3": "SELECT p.commit_id, p.edge_id AS id FROM {new_provenance} p LEFT ANTI JOIN {span} s ON s.span_id = p.span_id",
    "V4": f"""SELECT n.commit_id, n.node_id AS id FROM {{new_node}} n LEFT ANTI JOIN (SELECT assertion_id FROM {{assertion}} WHERE eligibility = 'eligible') a
              ON a.assertion_id = n.assertion_id WHERE n.ntype IN {BACKED}""",
    "V5": """SELECT commit_id, edge_id AS id FROM {new_edge} WHERE t_invalid <= t_created
             UNION ALL SELECT g.commit_id, g.edge_id FROM {gone} g LEFT JOIN {edge} e ON e.edge_id = g.edge_id WHERE e.edge_id IS NULL OR g.t_invalid <= e.t_created""",
    "V6": f"""SELECT commit_id, edge_id AS id FROM {{new_edge}} WHERE etype IN {NO_LOOPS} AND src = dst
              UNION ALL SELECT commit_id, edge_id FROM (
                SELECT commit_id, edge_id, lag(edge_id) OVER (PARTITION BY commit_id, etype, src, dst ORDER BY pos) AS before FROM {{new_edge}} WHERE t_invalid IS NULL) d WHERE before <> edge_id
              UNION ALL SELECT f.commit_id, f.edge_id FROM (SELECT commit_id, etype, src, dst, min_by(edge_id, pos) AS edge_id FROM {{new_edge}} WHERE t_invalid IS NULL GROUP BY commit_id, etype, src, dst) f
              JOIN (SELECT etype, src, dst, edge_id FROM {{edge}} WHERE t_invalid IS NULL) e ON e.etype = f.etype AND e.src = f.src AND e.dst = f.dst AND e.edge_id <> f.edge_id
              LEFT ANTI JOIN {{gone}} g ON g.commit_id = f.commit_id AND g.edge_id = e.edge_id""",
    "V7": """SELECT g.commit_id, g.edge_id AS id FROM {gone} g LEFT JOIN {new_edge} n ON n.commit_id = g.commit_id AND n.edge_id = g.superseded_by
             LEFT JOIN {edge} e ON e.edge_id = g.superseded_by WHERE g.superseded_by IS NOT NULL AND n.edge_id IS NULL AND e.edge_id IS NULL""",
}


def violations(tables: dict[str, DataFrame], codes: tuple[str, ...] = tuple(CODES)) -> DataFrame:
    """(commit_id, code, id), distinct: what is wrong with which node or edge; a commit without rows may be appended.

    tables: the batch as new_node (commit_id, pos, node_id, ntype, payload, aliases, assertion_id, lo, hi), new_edge (commit_id, pos,
    edge_id, etype, src, dst, t_created, t_invalid, superseded_by), new_provenance (commit_id, edge_id, span_id) and gone
    (commit_id, edge_id, t_invalid, superseded_by; its invalidations); the snapshot as node (without commit_id and pos), edge, span and
    assertion. payload is the node's content without aliases, pos the order within the commit.

    V1 ends of the types an edge's type allows, V2 one content for an id (an entity may gain aliases) and one node for an
    assertion, V3 provenance that exists, V4 eligible assertions only, V5 intervals and invalidations in the right order, V6 no loops
    of NO_LOOPS and no second live edge of the same type and ends unless the commit invalidates the first, V7 successors that exist.
    Each commit is judged against the snapshot alone, as if it came first: commits that build on each other go into later batches.
    """
    spark = tables["new_node"].sparkSession
    parts = [f"SELECT commit_id, '{c}' AS code, id FROM ({BY_CODE[c]}) v" for c in codes]
    ends = ", ".join(f"'{c}'" for c in codes if c in ("V1", "V5"))
    if ends:
        parts.append(f"SELECT * FROM ({ENDS}) v WHERE code IN ({ends})")
    sql = f"{'WITH ' + SHARED if ends else ''} SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)}) u"
    return spark.sql(sql, **{k: v for k, v in tables.items() if "{" + k + "}" in sql})


def tally(tables: dict[str, DataFrame]) -> DataFrame:
    """(code, name, findings) of all seven checks, those without findings too."""
    names = tables["new_node"].sparkSession.createDataFrame(list(CODES.items()), "code string, name string")
    found = violations(tables).groupBy("code").count().withColumnRenamed("count", "findings")
    return names.join(found, "code", "left").na.fill(0, ["findings"])
