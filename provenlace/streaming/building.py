"""Building the graph from decisions, in order, as a keyed-state stream: each commit is judged against all that came before it."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from provenlace.evidence import fold
from provenlace.evidence.commits import CODES, ENDPOINTS
from provenlace.plans.dialect import plan
from provenlace.sources.event_log import numbered
from provenlace.storage import shared_folder

#: What an assertion's kind becomes, edge types that record history, types that may not be loops, the confidence floors.
NTYPES = {"claim": "Claim", "value": "Value", "event": "Event", "time": "Claim"}
HISTORY = ("supersedes", "contradicts")
NO_LOOPS = ("same_as", "contradicts", "supersedes")
FLOORS = {"relation": 0.5, "valid_during": 0.5}
BACKED = ("Claim", "Value", "Event")

PROPOSAL = (
    "conv_id string, seq long, action string, assertion_id string, kind string, name string, entity_id string, etype string, src string, dst string, "
    "lo double, hi double, surfaces array<string>, confidence double, t string, spans array<string>, eligible boolean, unknown_spans int"
)
OUTCOME = "conv_id string, seq long, decided_at long, action string, accepted boolean, below_floor boolean, checks string, pos int, op string, payload string"


def _id(*parts: Any) -> str:
    return hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()[:16]


def canonical(name: str) -> str:
    return " ".join(name.lower().split())


class Held:
    """A map of the stream's state, each entry of which is read once and written once for the rows of a call, as each costs a trip to
    the JVM. A new conversation has nothing to read. What is held is no more than what the call's rows touch."""

    def __init__(self, state: Any):
        self.state = state
        self.begin(False)

    def begin(self, new: bool) -> None:
        self.new, self.seen, self.changed = new, {}, {}

    def containsKey(self, key: tuple) -> bool:  # noqa: N802
        if key not in self.seen:
            self.seen[key] = self.state.getValue(key) if not self.new and self.state.containsKey(key) else None
        return self.seen[key] is not None

    def getValue(self, key: tuple) -> tuple | None:  # noqa: N802
        return self.seen[key] if self.containsKey(key) else None

    def updateValue(self, key: tuple, value: tuple) -> None:  # noqa: N802
        self.seen[key] = self.changed[key] = value

    def removeKey(self, key: tuple) -> None:  # noqa: N802
        self.seen[key] = self.changed[key] = None

    def end(self) -> None:
        for key, value in self.changed.items():
            if value is not None:
                self.state.updateValue(key, value)
            elif not self.new and self.state.containsKey(key):
                self.state.removeKey(key)
        self.begin(False)


class Graph:
    """A conversation's graph in the stream's state: nodes, edges, and what is looked up by other keys than their ids."""

    def __init__(self, handle: StatefulProcessorHandle):
        text = "value string"
        self.nodes = Held(handle.getMapState("node", "id string", text))
        self.edges = Held(handle.getMapState("edge", "id string", text))
        self.backing = Held(handle.getMapState("backing", "id string", text))
        self.live = Held(handle.getMapState("live", "id string", text))
        self.touching = Held(handle.getMapState("touching", "id string", text))
        self.parked = Held(handle.getMapState("parked", "id string", text))
        self.last = handle.getValueState("last", "seq long")
        self.maps = (self.nodes, self.edges, self.backing, self.live, self.touching, self.parked)

    @staticmethod
    def get(state: Any, key: str) -> Any:
        return json.loads(state.getValue((key,))[0]) if state.containsKey((key,)) else None

    @staticmethod
    def put(state: Any, key: str, value: Any) -> None:
        state.updateValue((key,), (json.dumps(value),))

    def add_node(self, n: dict) -> None:
        self.put(self.nodes, n["node_id"], n)
        if n["ntype"] in BACKED and n.get("assertion_id"):
            self.put(self.backing, n["assertion_id"], n["node_id"])

    def add_edge(self, e: dict) -> None:
        self.put(self.edges, e["edge_id"], e)
        self.put(self.live, _id(e["etype"], e["src"], e["dst"]), e["edge_id"])
        for end in {e["src"], e["dst"]}:
            known = self.get(self.touching, end) or []
            if e["edge_id"] not in known:
                self.put(self.touching, end, [*known, e["edge_id"]])

    def invalidate(self, edge_id: str, t: str, successor: str | None) -> None:
        e = self.get(self.edges, edge_id)
        self.put(self.edges, edge_id, e | {"t_invalid": t, "superseded_by": successor or e["superseded_by"]})
        key = (_id(e["etype"], e["src"], e["dst"]),)
        if self.live.containsKey(key) and json.loads(self.live.getValue(key)[0]) == edge_id:
            self.live.removeKey(key)

    def live_edges_of(self, node_id: str) -> list[dict]:
        found = [self.get(self.edges, i) for i in self.get(self.touching, node_id) or []]
        return [e for e in found if e["t_invalid"] is None]


def claim(p: dict) -> dict:
    ntype = NTYPES.get(p["kind"], "Claim")
    return {"node_id": _id(ntype, p["assertion_id"]), "ntype": ntype, "assertion_id": p["assertion_id"]}


def entity(name: str, conv_id: str) -> dict:
    plain = canonical(name)
    return {"node_id": _id("Entity", conv_id, plain), "ntype": "Entity", "name": plain, "conv_id": conv_id, "aliases": [name] if name != plain else []}


def edge(etype: str, src: str, dst: str, p: dict) -> dict:
    ends = {"etype": etype, "src": src, "dst": dst}
    return {"edge_id": _id("edge", etype, src, dst), **ends, "t_created": p["t"], "t_invalid": None, "superseded_by": None, "provenance": p["spans"] or []}


def commit_of(p: dict, graph: Graph) -> dict | None:
    """What a decision would write: nodes, edges, gone (edge id, time, successor); None for an unknown action or an entity that is not there."""
    t, action = p["t"], p["action"]
    if action == "link":
        node = claim(p)
        return {"nodes": [node], "edges": [edge("about_entity", node["node_id"], p["entity_id"], p)], "gone": []}
    if action == "create":
        made, node = entity(p["name"], p["conv_id"]), claim(p)
        known = Graph.get(graph.nodes, made["node_id"])
        if known is not None and known["ntype"] == "Entity":  # surface forms add up
            made = known | {"aliases": sorted({*known["aliases"], *made["aliases"]})}
        return {"nodes": [made, node], "edges": [edge("about_entity", node["node_id"], made["node_id"], p)], "gone": []}
    if action == "supersede":
        made = edge("supersedes", p["src"], p["dst"], p)
        gone = [(e["edge_id"], t, made["edge_id"]) for e in graph.live_edges_of(p["dst"]) if e["etype"] not in HISTORY]
        return {"nodes": [], "edges": [made], "gone": sorted(gone)}
    if action == "contradict":
        return {"nodes": [], "edges": [edge("contradicts", p["src"], p["dst"], p)], "gone": []}
    if action == "alias":
        known = Graph.get(graph.nodes, p["entity_id"])
        if known is None or known["ntype"] != "Entity":
            return None
        more = {s for s in p["surfaces"] or [] if s and s != known["name"]}
        return {"nodes": [known | {"aliases": sorted({*known["aliases"], *more})}], "edges": [], "gone": []}
    if action == "relation":
        return {"nodes": [], "edges": [edge(p["etype"], p["src"], p["dst"], p)], "gone": []}
    if action == "valid_during":
        node = {"node_id": _id("TimeInterval", p["lo"], p["hi"]), "ntype": "TimeInterval", "lo": p["lo"], "hi": p["hi"]}
        return {"nodes": [node], "edges": [edge("valid_during", p["src"], node["node_id"], p)], "gone": []}
    return None


def failed_checks(c: dict, p: dict, graph: Graph) -> list[str]:
    """The codes of commits.CODES that the commit fails against the graph as it stands."""
    own = {n["node_id"]: n for n in c["nodes"]}
    node = lambda i: own.get(i) or Graph.get(graph.nodes, i)
    bad = set()
    for e in c["edges"]:
        sides = ENDPOINTS.get(e["etype"])
        ends = [node(e["src"]), node(e["dst"])]
        if sides is None or any(n is None or n["ntype"] not in types.split() for n, types in zip(ends, sides, strict=True)):
            bad.add("V1")
        known = Graph.get(graph.edges, e["edge_id"])
        if known is not None and known != e:
            bad.add("V2")
        if e["t_invalid"] is not None and e["t_invalid"] <= e["t_created"]:
            bad.add("V5")
        at = ends[1] or {}
        if e["etype"] == "valid_during" and at.get("lo") is not None and at.get("hi") is not None and at["hi"] <= at["lo"]:
            bad.add("V5")
        same = Graph.get(graph.live, _id(e["etype"], e["src"], e["dst"]))
        if (e["etype"] in NO_LOOPS and e["src"] == e["dst"]) or (same not in (None, e["edge_id"]) and same not in {g[0] for g in c["gone"]}):
            bad.add("V6")
    for n in c["nodes"]:
        known = Graph.get(graph.nodes, n["node_id"])
        grows = known is not None and n["ntype"] == "Entity" and {**known, "aliases": 0} == {**n, "aliases": 0} and set(n["aliases"]) >= set(known["aliases"])
        if known is not None and known != n and not grows:
            bad.add("V2")
        if n["ntype"] in BACKED:
            holder = Graph.get(graph.backing, n["assertion_id"]) if n["assertion_id"] else None
            if holder not in (None, n["node_id"]):
                bad.add("V2")
            if not p["eligible"] or not n["assertion_id"]:
                bad.add("V4")
    if c["edges"] and (p["unknown_spans"] or not p["spans"]):
        bad.add("V3")
    written = {e["edge_id"] for e in c["edges"]}
    for edge_id, t, successor in c["gone"]:
        known = Graph.get(graph.edges, edge_id)
        if known is None or t <= known["t_created"]:
            bad.add("V5")
        if successor is not None and successor not in written and not graph.edges.containsKey((successor,)):
            bad.add("V7")
    return sorted(bad)


class Builder(StatefulProcessor):
    """Applies a conversation's decisions in the order of seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.graph = Graph(handle)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out: list[tuple] = []
        last = self.graph.last.get()[0] if self.graph.last.exists() else None
        for m in self.graph.maps:
            m.begin(last is None)
        for p in sorted((_plain(r) for df in rows for r in df.to_dict("records")), key=lambda p: p["seq"]):
            if last is not None and p["seq"] <= last:
                continue  # delivered again
            last = p["seq"]
            out += self.decide(p, p["seq"])
        if last is not None:
            self.graph.last.update((last,))
        for m in self.graph.maps:
            m.end()
        if out:
            yield pd.DataFrame(out, columns=[f.split()[0] for f in OUTCOME.split(", ")])

    def decide(self, p: dict, at: int) -> list[tuple]:
        told = lambda accepted, floor=False, checks="", pos=None, op=None, payload=None: (
            p["conv_id"], p["seq"], at, p["action"], accepted, floor, checks, pos, op, payload,
        )
        if p["action"] == "defer":
            # a mention of something that has no entity yet: held until one of that name is made
            made = entity(p["name"], p["conv_id"])
            if self.graph.nodes.containsKey((made["node_id"],)):
                return self.decide(p | {"action": "link", "entity_id": made["node_id"]}, at)
            anchor = canonical(p["name"])
            self.graph.put(self.graph.parked, anchor, [*(self.graph.get(self.graph.parked, anchor) or []), p])
            return [told(False, checks="parked")]
        floor = FLOORS.get(p["action"])
        if floor is not None and p["confidence"] is not None and p["confidence"] < floor:
            return [told(False, floor=True)]
        c = commit_of(p, self.graph)
        if c is None:
            return [told(False, checks="unknown")]
        bad = failed_checks(c, p, self.graph)
        if bad:
            return [told(False, checks=",".join(bad))]
        ops: list[tuple[str, dict]] = []
        for n in c["nodes"]:
            self.graph.add_node(n)
            ops.append(("node.add", n))
        for e in c["edges"]:
            self.graph.add_edge(e)
            ops.append(("edge.add", e))
        for edge_id, t, successor in c["gone"]:
            self.graph.invalidate(edge_id, t, successor)
            ops.append(("edge.invalidate", {"edge_id": edge_id, "t_invalid": t, "superseded_by": successor}))
        out = [told(True, pos=i, op=op, payload=json.dumps(v, sort_keys=True)) for i, (op, v) in enumerate(ops)]
        if p["action"] == "create":
            anchor = canonical(p["name"])
            held = self.graph.get(self.graph.parked, anchor) or []
            if held:
                self.graph.parked.removeKey((anchor,))
            for q in held:
                out += self.decide(q | {"action": "link", "entity_id": c["nodes"][0]["node_id"]}, at)
        return out


def _plain(row: dict) -> dict:
    """A row of pandas in plain values: missing numbers as None, arrays as lists."""
    missing = lambda v: v is None or (isinstance(v, float) and v != v) or v is pd.NA
    return {k: None if missing(v) else list(v) if k in ("surfaces", "spans") else bool(v) if k == "eligible" else v for k, v in row.items()}


def prepared(proposals: DataFrame, assertion: DataFrame, span: DataFrame) -> DataFrame:
    """proposals with what the graph's base tables say: is the assertion eligible, how many of the spans are unknown."""
    ok = assertion.filter("eligibility = 'eligible'").select("assertion_id", F.lit(True).alias("eligible")).distinct()
    cited = proposals.select("conv_id", "seq", F.explode("spans").alias("span_id")).join(span.select("span_id"), "span_id", "left_anti")
    unknown = cited.groupBy("conv_id", "seq").agg(F.count(F.lit(1)).cast("int").alias("unknown_spans"))
    rows = proposals.join(ok, "assertion_id", "left").join(unknown, ["conv_id", "seq"], "left").na.fill({"eligible": False, "unknown_spans": 0})
    return rows.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in PROPOSAL.split(", ")])


def apply(proposals: DataFrame) -> DataFrame:
    """One row per write of an accepted decision, one for any other: the columns of OUTCOME. proposals: a stream with the columns of PROPOSAL.

    Actions are link (assertion_id, kind, entity_id), create (assertion_id, kind, name: the entity, its claim and the
    link), supersede and contradict (src over dst), alias (entity_id, surfaces), relation (etype, src, dst), valid_during
    (src, lo, hi) and defer (assertion_id, kind, name: linked as soon as an entity of that name is created). A decision is
    judged against the graph that the accepted ones before it have made; it is written whole or, with the codes of the
    checks it fails, not at all. Relations and intervals under their confidence floor are declined, no confidence passes.
    Superseding invalidates every live edge of the old claim but those that record history.

    State is keyed by conversation, to which entities and claims belong; a conversation's decisions are applied by seq,
    and later micro-batches may only bring later ones: one at or before the last applied is a repeated delivery and is left.
    Needs the RocksDB state store (its state is on disk, not in a task's memory).
    """
    return proposals.groupBy("conv_id").transformWithStateInPandas(Builder(), outputStructType=OUTCOME, outputMode="Append", timeMode="None")


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build(spark: SparkSession, source: str, out: str, marks: str, files_a_batch: int | None = None) -> DataFrame:
    """Apply the folder ``source`` of proposals to its present end and append the outcomes to ``out``; all outcomes are returned.

    A micro-batch writes the folder of its number, so that one that is repeated after a failure replaces what it had
    written. Called again with the same marks it goes on where it ended.
    """
    before = spark.conf.get(PROVIDER, None)
    reader = spark.readStream.schema(PROPOSAL)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = apply(reader.parquet(source)).writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", marks)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(f"{OUTCOME}, epoch int").parquet(out)


def report(outcomes: DataFrame) -> DataFrame:
    """(measure, n): attempted, accepted, refused, below_floor, parked (for good), and refusals by check, those of none too."""
    # a deferred decision has a row when it is parked and others when it is taken up again
    last = outcomes.groupBy("conv_id", "seq").agg(
        F.max_by("accepted", "decided_at").alias("accepted"), F.max_by("below_floor", "decided_at").alias("below_floor"), F.max_by("checks", "decided_at").alias("checks")
    )
    refused = ~F.col("accepted") & ~F.col("below_floor") & (F.col("checks") != "parked")
    measures = {"attempted": F.col("accepted") | refused, "accepted": F.col("accepted"), "refused": refused, "below_floor": F.col("below_floor"), "parked": F.col("checks") == "parked"}
    measures |= {f"refused_{c}": refused & F.array_contains(F.split("checks", ","), c) for c in CODES}
    row = last.agg(*[F.count_if(m).alias(k) for k, m in measures.items()])
    return row.unpivot([], [*measures], "measure", "n")


def log_of(outcomes: DataFrame) -> DataFrame:
    """The accepted writes as an event log (seq, op, payload), numbered by conversation, decision and place."""
    written = outcomes.filter("op IS NOT NULL").withColumn("decision", F.col("seq"))
    return numbered(written.drop("seq"), ["conv_id", "decided_at", "decision", "pos"], "seq").select("seq", "op", "payload")


def audit(outcomes: DataFrame) -> DataFrame:
    """(property, failures) of the written log, judged step by step: a_effective, b_history, c_no_collateral.

    a: an edge that a decision supersedes is not live after it, and its successor is; b: it was live before; c: no edge
    comes alive or dies but those the decision adds or invalidates. An edge's writes are ordered by window, so that the
    state before and after each is known without a replay.
    """
    writes = outcomes.filter("op IN ('edge.add', 'edge.invalidate')").select(
        "conv_id", "decided_at", "seq", "pos", (F.col("op") == "edge.add").alias("adds"),
        F.get_json_object("payload", "$.edge_id").alias("edge_id"), F.get_json_object("payload", "$.superseded_by").alias("successor"),
    )
    order = W.partitionBy("conv_id", "edge_id").orderBy("decided_at", "seq", "pos")
    state = writes.withColumn("was", F.coalesce(F.lag("adds").over(order), F.lit(False))).withColumn("final", F.lead("adds").over(order).isNull())
    gone = state.filter("NOT adds")
    # a successor is live after the step if its last write up to there adds it
    heirs = gone.filter("successor IS NOT NULL").select("conv_id", "decided_at", "seq", F.col("successor").alias("edge_id"), F.lit(True).alias("asked"))
    timeline = writes.select("conv_id", "edge_id", "decided_at", "seq", "adds").unionByName(heirs, allowMissingColumns=True)
    upto = W.partitionBy("conv_id", "edge_id").orderBy("decided_at", "seq", F.coalesce("asked", F.lit(False))).rowsBetween(W.unboundedPreceding, 0)
    dead = timeline.withColumn("alive", F.last("adds", ignorenulls=True).over(upto)).filter("asked AND NOT coalesce(alive, false)")
    step = ["conv_id", "decided_at", "seq", "edge_id"]
    again = writes.groupBy(*step).agg(F.bool_or("adds").alias("a"), F.bool_or(~F.col("adds")).alias("g")).filter("a AND g")
    return (
        gone.filter("NOT was").agg(F.count(F.lit(1)).alias("failures")).select(F.lit("b_history").alias("property"), "failures")
        .unionByName(dead.agg(F.count(F.lit(1)).alias("failures")).select(F.lit("a_effective").alias("property"), "failures"))
        .unionByName(again.agg(F.count(F.lit(1)).alias("failures")).select(F.lit("c_no_collateral").alias("property"), "failures"))
    )


#: Decisions over conversations: a turn's longest words are its mention, its claim is linked, dated, and put over or against the speaker's last.
DECISIONS = """
WITH m AS (SELECT turn_id, min(tok) AS tok FROM turn_token WHERE length(tok) >= 5 GROUP BY turn_id),
a AS (
  SELECT a.*, m.tok, CASE kind WHEN 'claim' THEN 'Claim' WHEN 'value' THEN 'Value' ELSE 'Event' END AS ntype, v.lo, v.hi,
         row_number() OVER (PARTITION BY a.conv_id, m.tok ORDER BY a.ix) AS nth FROM assertion a JOIN m ON m.turn_id = a.turn_id JOIN validity v ON v.turn_id = a.turn_id),
b AS (
  SELECT *, @sha16(ntype, assertion_id) AS claim, @sha16('Entity', conv_id, tok) AS entity,
         lag(@sha16(ntype, assertion_id)) OVER (PARTITION BY conv_id, speaker ORDER BY ix) AS before FROM a)
SELECT conv_id, CAST(ix * 10 + k AS BIGINT) AS seq, action, assertion_id, kind,
       CASE WHEN action IN ('create', 'defer') THEN CASE WHEN ix % 2 = 0 THEN upper(tok) ELSE tok END END AS name,
       CASE WHEN action IN ('link', 'alias') THEN entity END AS entity_id,
       CASE WHEN action = 'relation' THEN CASE WHEN ix % 4 = 3 THEN 'invented' ELSE 'has_value' END END AS etype,
       CASE WHEN action = 'relation' THEN entity WHEN action IN ('supersede', 'contradict', 'valid_during') THEN claim END AS src,
       CASE WHEN action = 'relation' THEN claim WHEN action IN ('supersede', 'contradict') THEN before END AS dst,
       CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, CASE WHEN action = 'alias' THEN array(upper(tok), concat('the ', tok)) END AS surfaces,
       CASE WHEN action IN ('relation', 'valid_during') THEN entailed_score END AS confidence, CAST(ts + k AS STRING) AS t, array(span_id) AS spans
FROM b LATERAL VIEW posexplode(array(
  CASE WHEN nth > 1 THEN 'link' WHEN ix % 3 = 1 THEN 'defer' ELSE 'create' END, 'valid_during', CASE WHEN before IS NULL THEN 'alias' WHEN ix % 2 = 0 THEN 'supersede' ELSE 'contradict' END,
  'relation', CASE WHEN ix % 3 = 1 THEN 'create' ELSE 'alias' END)) x AS k, action"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    assertion = plan("SELECT assertion_id, eligibility, span_id FROM assertion")[0](spark, sf_dir)
    return prepared(plan(DECISIONS)[0](spark, sf_dir), assertion, assertion)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/building-{uuid.uuid4().hex}"
    decisions(spark, sf_dir).write.parquet(f"{folder}/in")
    return build(spark, f"{folder}/in", f"{folder}/out", f"{folder}/marks").drop("epoch")


QUERIES = {
    "commit_build_outcomes": outcomes,
    "commit_build_report": lambda spark, d: report(outcomes(spark, d)),
    "commit_build_audit": lambda spark, d: audit(outcomes(spark, d)),
    "commit_build_edges": lambda spark, d: fold.fold(log_of(outcomes(spark, d)))["edge"],
}
ORACLE: dict[str, str] = {}
