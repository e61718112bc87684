"""The graph state at a log position: eight kinds of operations folded per key, without ordering the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The flags of an assertion that can be set one by one, with their types.
FLAGS = {
    "asserted_by": "string",
    "entailed_by_span": "boolean",
    "entailed_score": "double",
    "externally_verified": "boolean",
    "current_under_update_policy": "boolean",
}
FLAG_STRUCT = ", ".join(f"{k}: {t}" for k, t in FLAGS.items())
NODE = "node_id string, ntype string, payload map<string, string>"
EDGE = "edge_id string, etype string, src string, dst string, t_created string, provenance array<string>, t_invalid string, superseded_by string"
ASSERTION = f"assertion_id string, kind string, text_norm string, spans array<string>, flags struct<{FLAG_STRUCT}>, t_created string, eligibility string"
TURN = "turn_id string, conv_id string, session_id string, speaker string, ts string, text string"
SPAN = "span_id string, turn_id string, start int, end int"


def _read(log: DataFrame, op: str, schema: str) -> DataFrame:
    return log.filter(F.col("op") == op).select("seq", F.from_json("payload", schema).alias("r"))


def _last(rows: DataFrame, key: str) -> DataFrame:
    """The row with the highest seq of each key; null keys are left out."""
    rows = rows.filter(F.col(f"r.{key}").isNotNull())
    return rows.groupBy(F.col(f"r.{key}").alias("k")).agg(F.max("seq").alias("added"), F.max_by("r", "seq").alias("r"))


def _since(changed: Column, added: Column, new: Column, old: Column) -> Column:
    """new if it was set after the record was added last, else old."""
    return F.when(changed > added, new).otherwise(old)


def fold(log: DataFrame, upto: int | None = None) -> dict[str, DataFrame]:
    """Tables node, edge, assertion, turn and span out of log (seq, op, payload as JSON), rows before ``upto`` only.

    The last add of a key wins and undoes what was set before it. An edge's last invalidation since then
    replaces both t_invalid and superseded_by; the edge stays. Flags are set one by one, eligibility as
    a whole. Settings of keys that were never added, null keys, unreadable payloads and other operations
    count for nothing. Each family is one aggregation by key with partial sums before the shuffle: no
    window, no order over the log. An empty log gives empty tables.
    """
    log = log if upto is None else log.filter(F.col("seq") < upto)
    node = _last(_read(log, "node.add", NODE), "node_id").select("r.*")
    turn = _last(_read(log, "turn.add", TURN), "turn_id").select("r.*")
    span = _last(_read(log, "span.add", SPAN), "span_id").select("r.*")

    gone = _last(_read(log, "edge.invalidate", "edge_id string, t_invalid string, superseded_by string"), "edge_id")
    gone = gone.select("k", F.col("added").alias("at"), F.col("r").alias("g"))
    edge = _last(_read(log, "edge.add", EDGE), "edge_id").join(gone, "k", "left")
    edge = edge.select(
        *[f"r.{c}" for c in ("edge_id", "etype", "src", "dst", "t_created", "provenance")],
        *[_since(F.col("at"), F.col("added"), F.col(f"g.{c}"), F.col(f"r.{c}")).alias(c) for c in ("t_invalid", "superseded_by")],
    )

    flags = _read(log, "assertion.set_flags", "assertion_id string, " + ", ".join(f"{k} {t}" for k, t in FLAGS.items()))
    flags = flags.filter("r.assertion_id IS NOT NULL").groupBy(F.col("r.assertion_id").alias("k")).agg(
        *[F.max(F.when(F.col(f"r.{k}").isNotNull(), F.struct("seq", F.col(f"r.{k}").alias("v")))).alias(f"f_{k}") for k in FLAGS]
    )
    verdict = _last(_read(log, "assertion.set_eligibility", "assertion_id string, eligibility string"), "assertion_id")
    verdict = verdict.select("k", F.col("added").alias("at"), F.col("r.eligibility").alias("verdict"))
    assertion = _last(_read(log, "assertion.add", ASSERTION), "assertion_id").join(flags, "k", "left").join(verdict, "k", "left")
    assertion = assertion.select(
        *[f"r.{c}" for c in ("assertion_id", "kind", "text_norm", "spans", "t_created")],
        *[_since(F.col(f"f_{k}.seq"), F.col("added"), F.col(f"f_{k}.v"), F.col(f"r.flags.{k}")).alias(k) for k in FLAGS],
        _since(F.col("at"), F.col("added"), F.col("verdict"), F.coalesce("r.eligibility", F.lit("quarantined"))).alias("eligibility"),
    )
    return {"node": node, "edge": edge, "assertion": assertion, "turn": turn, "span": span}


def counts(state: dict[str, DataFrame]) -> DataFrame:
    """One row: nodes, edges, live_edges, assertions, eligible_assertions, turns, spans."""
    n = F.count(F.lit(1))
    parts = [
        state["node"].agg(n.alias("nodes")),
        state["edge"].agg(n.alias("edges"), F.count_if(F.col("t_invalid").isNull()).alias("live_edges")),
        state["assertion"].agg(n.alias("assertions"), F.count_if(F.col("eligibility") == "eligible").alias("eligible_assertions")),
        state["turn"].agg(n.alias("turns")),
        state["span"].agg(n.alias("spans")),
    ]
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.crossJoin(p)
    return out


def digest(state: dict[str, DataFrame]) -> DataFrame:
    """One row, digest: equal for equal states, however they were reached and partitioned.

    Rows are hashed as JSON; the hashes of a table are summed up in four parts, so that no task orders or
    joins all rows; the sums are hashed.
    """
    rows = None
    for name in sorted(state):
        df = state[name].select([F.col(c) for c in sorted(state[name].columns)])
        hashed = df.select(F.sha2(F.concat(F.lit(f"{name}:"), F.to_json(F.struct("*"))), 256).alias("h"))
        rows = hashed if rows is None else rows.unionByName(hashed)
    parts = [F.coalesce(F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).alias(f"s{i}") for i in range(4)]
    sums = rows.agg(*parts, F.count(F.lit(1)).alias("n"))
    return sums.select(F.sha2(F.concat_ws("/", *[F.col(c).cast("string") for c in sums.columns]), 256).alias("digest"))


def liveness_changes(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(edge_id, was, now) of edges that are live in one state and not, or unknown, in the other."""
    live = lambda s, name: s["edge"].select("edge_id", F.col("t_invalid").isNull().alias(name))
    both = live(before, "was").join(live(after, "now"), "edge_id", "full")
    both = both.select("edge_id", F.coalesce("was", F.lit(False)).alias("was"), F.coalesce("now", F.lit(False)).alias("now"))
    return both.filter(F.col("was") != F.col("now"))
