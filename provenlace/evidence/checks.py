"""H: the nine checks of evidence sets against their question's pool and the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provenlace.storage import cut

#: What each check is called, and node types that stand for an assertion.
CODES = {
    "H1": "size", "H2": "type", "H3": "closure", "H4": "identity", "H5": "binding",
    "H6": "retired", "H7": "support", "H8": "temporal", "H9": "scope",
}
BACKED = ("Claim", "Value", "Event")
MAX_ATOMS = 16
#: Checks whose verdict on an atom is the same in every set.
ALONE = ("H2", "H6", "H7", "H8", "H9")


def _lookup(node: DataFrame, assertion: DataFrame) -> DataFrame:
    """Nodes with their assertion's state: at, ntype, lo, hi, spoken (assertion id, where that exists), backed (a type that needs one), sound."""
    known = assertion.select("assertion_id", F.lit(True).alias("known"), (F.col("eligibility") == "eligible").alias("ok"))
    backed = F.col("ntype").isin(*BACKED)
    # nodes that name no assertion, most of a graph, take no part in the join: their one null key would bring them all to one task
    told = node.filter("assertion_id IS NOT NULL").join(known, "assertion_id", "left")
    return told.unionByName(node.filter("assertion_id IS NULL"), allowMissingColumns=True).select(
        F.col("node_id").alias("at"), "ntype", "lo", "hi", F.when(F.col("known"), F.col("assertion_id")).alias("spoken"),
        backed.alias("backed"), F.coalesce("ok", F.lit(False)).alias("sound"),
    )


def _overlaps() -> Column:
    low, high = F.lit(-1e300), F.lit(1e300)
    begin = F.greatest(F.coalesce("lo", low), F.coalesce("q_lo", low))
    return begin < F.least(F.coalesce("hi", high), F.coalesce("q_hi", high))


def _findings(t: dict[str, DataFrame], most: int, codes: tuple[str, ...] = tuple(CODES)) -> dict[str, list[DataFrame]]:
    """For each of the codes the (set_id, atom_id) that fail it, all read from three relations that are written once, if a code asks for them.

    sel: selected atoms with what the pool says of them. basis: what an atom stands on, itself or, for a binding, its referents
    (through). place: the basis with its edge and, a row each, the nodes it touches: its own or its edge's two ends.
    """
    key, hit = ["question_id", "atom_id"], ["set_id", "atom_id"]
    sel = cut(t["sets"].join(t["member"], "set_id").join(t["atom"], key, "left").select("set_id", *key, "kind", "target", "label"))
    out: dict[str, list[DataFrame]] = {}
    size = t["sets"].join(t["member"].groupBy("set_id").agg(F.countDistinct("atom_id").alias("n")), "set_id", "left")
    out["H1"] = [size.filter((F.coalesce("n", F.lit(0)) == 0) | (F.col("n") > most)).select("set_id", F.lit(None).cast("string").alias("atom_id"))]
    out["H5"] = [sel.filter("kind = 'binding'").groupBy("set_id", "label").agg(F.min("atom_id").alias("atom_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(*hit)]
    basis = sel.filter("kind IN ('node', 'edge')").select("set_id", *key, F.col("atom_id").alias("through"), "kind", "target", F.lit(False).alias("bound"))
    if {"H3", "H4", "H8", "H9"} & {*codes}:
        refs = sel.filter("kind IS NOT NULL").select("set_id", *key, "kind").join(t["ref"], key)
        pooled = t["atom"].select("question_id", F.col("atom_id").alias("ref"), F.col("kind").alias("ref_kind"), "target", F.lit(True).alias("pooled"))
        refs = cut(refs.join(pooled, ["question_id", "ref"], "left"))
        bound = refs.filter("kind = 'binding'")
        basis = basis.unionByName(bound.filter("pooled").select("set_id", *key, F.col("ref").alias("through"), F.col("ref_kind").alias("kind"), "target", F.lit(True).alias("bound")))
        chosen = t["member"].select("set_id", F.col("atom_id").alias("ref"))
        out["H3"] = [refs.join(chosen, ["set_id", "ref"], "left_anti").select(*hit)]
        content = refs.groupBy(*hit).agg(F.array_sort(F.collect_list("ref")).alias("content"))
        same = W.partitionBy("set_id", "kind", "target", "label", F.coalesce("content", F.array().cast("array<string>"))).orderBy("atom_id")
        out["H4"] = [sel.filter("kind IS NOT NULL").join(content, hit, "left").withColumn("rn", F.row_number().over(same)).filter("rn > 1").select(*hit)]
    if not {"H2", "H6", "H7", "H8", "H9"} & {*codes}:
        return out

    edge = t["edge"].select(F.lit("edge").alias("kind"), F.col("edge_id").alias("target"), "etype", "src", "dst", "t_created", "t_invalid", "superseded_by", F.lit(True).alias("drawn"))
    touched = F.when(F.col("kind") == "node", F.array("target")).when(F.col("drawn"), F.array_distinct(F.array("src", "dst")))
    node = _lookup(t["node"], t["assertion"])
    place = cut(basis.join(edge, ["kind", "target"], "left").withColumn("at", F.explode_outer(touched)).join(node, "at", "left"))
    own = place.filter("NOT bound")
    lost = (F.col("kind") == "node") & F.col("ntype").isNull() | (F.col("kind") == "edge") & F.col("drawn").isNull()
    out["H2"] = [sel.filter("kind IS NULL").select(*hit), own.filter(lost).select(*hit)]
    out["H6"] = [own.filter("t_invalid IS NOT NULL").select(*hit)]
    out["H7"] = [own.filter("backed AND NOT sound").select(*hit)]
    if not {"H8", "H9"} & {*codes}:
        return out

    older = t["edge"].select(F.col("edge_id").alias("superseded_by"), F.col("t_created").alias("their_time"))
    out["H8"] = [own.filter("superseded_by IS NOT NULL").join(older, "superseded_by", "left").filter("their_time IS NULL OR their_time < t_created").select(*hit)]
    during = t["edge"].filter("etype = 'valid_during' AND t_invalid IS NULL").select("src", F.col("dst").alias("at"))
    during = during.join(node.filter("ntype = 'TimeInterval'"), "at").select(F.col("src").alias("target"), "lo", "hi")
    spans = ["set_id", "question_id", "atom_id", "through", "lo", "hi"]
    times = place.filter("bound AND ntype = 'TimeInterval' AND (kind = 'node' OR (etype = 'valid_during' AND at = dst))").select(*spans)
    times = times.unionByName(place.filter("bound AND kind = 'node'").drop("lo", "hi").join(during, "target").select(*spans))
    asked = t["question"].filter("constrained").select("question_id", F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"))
    times = times.join(t["member"].select("set_id", F.col("atom_id").alias("through")), ["set_id", "through"], "left_semi").join(asked, "question_id")
    out["H8"].append(times.groupBy(*hit).agg(F.bool_or(_overlaps()).alias("meets")).filter("NOT meets").select(*hit))

    told = t["assertion_span"].select(F.col("assertion_id").alias("spoken"), "span_id")
    traced = ["set_id", "question_id", "atom_id", "span_id"]
    from_nodes = place.filter("kind = 'node' AND spoken IS NOT NULL AND backed").join(told, "spoken").filter("span_id IS NOT NULL").select(*traced)
    from_edges = place.filter("drawn").select("set_id", *key, F.col("target").alias("edge_id")).distinct().join(t["provenance"], "edge_id").select(*traced)
    broken = place.filter("kind = 'node' AND spoken IS NULL AND backed").select(*traced[:3]).unionByName(bound.filter("pooled IS NULL").select(*traced[:3]))
    asked = t["scope"].select("question_id").distinct()
    places = t["span"].join(t["turn"], "turn_id").select("span_id", "conv_id")
    out_of = from_nodes.unionByName(from_edges).join(asked, "question_id").join(places, "span_id", "left").select(*traced[:3], "conv_id")
    out_of = out_of.unionByName(broken.join(asked, "question_id"), allowMissingColumns=True)
    out["H9"] = [out_of.join(t["scope"], ["question_id", "conv_id"], "left_anti").select(*hit)]
    return out


def _spans(links: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """(id, astray, convs) of links (id, span_id): the conversations of an id's spans, and whether one of the spans has none."""
    places = t["span"].join(t["turn"], "turn_id").select("span_id", "conv_id")
    return links.join(places, "span_id", "left").groupBy("id").agg(F.bool_or(F.col("conv_id").isNull()).alias("astray"), F.collect_set("conv_id").alias("convs"))


def _known(t: dict[str, DataFrame]) -> DataFrame:
    """What the checks ask of the graph by id, a row each: nodes (what 'n') as said with the intervals of their valid_during edges, edges (what 'e') with their times."""
    spans = _spans(t["assertion_span"].filter("span_id IS NOT NULL").select(F.col("assertion_id").alias("id"), "span_id"), t).withColumnRenamed("id", "assertion_id")
    state = t["assertion"].select("assertion_id", F.lit(True).alias("known"), (F.col("eligibility") == "eligible").alias("ok")).join(spans, "assertion_id", "left")
    # as in _lookup, nodes without an assertion take no part in the join
    node = t["node"].filter("assertion_id IS NOT NULL").join(state, "assertion_id", "left").unionByName(t["node"].filter("assertion_id IS NULL"), allowMissingColumns=True)
    said = F.struct("ntype", "lo", "hi", F.coalesce("known", F.lit(False)).alias("known"), F.col("ntype").isin(*BACKED).alias("backed"), F.coalesce("ok", F.lit(False)).alias("sound"), "astray", "convs")
    times = t["node"].filter("ntype = 'TimeInterval'").select(F.col("node_id").alias("dst"), "lo", "hi")
    during = t["edge"].filter("etype = 'valid_during' AND t_invalid IS NULL").select("src", "dst").join(times, "dst")
    rows = [
        node.select(F.lit("n").alias("what"), F.col("node_id").alias("at"), said.alias("said")),
        during.select(F.lit("n").alias("what"), F.col("src").alias("at"), F.struct("lo", "hi").alias("during")),
        t["edge"].select(F.lit("e").alias("what"), F.col("edge_id").alias("at"), "t_created"),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).filter("at IS NOT NULL")
    return rows.groupBy("what", "at").agg(F.collect_set("said").alias("said"), F.collect_set("during").alias("during"), F.min("t_created").alias("first"), F.count("t_created").alias("times"))


def _found(t: dict[str, DataFrame], pool: DataFrame) -> DataFrame:
    """(question_id, atom_id, alone, evidence, through, meets): what the graph says of the atoms in pool (question_id, atom_id, own, refs), which lie by question.

    One flow: atoms meet their question's scope and constraint where they are; edges get theirs by one join, and the nodes that atoms touch
    and the edges that supersede them by another. An edge that fails already asks for nothing more.
    """
    key = ["question_id", "atom_id"]
    merged = lambda df: df.hint("merge")
    scope = t["scope"].filter("question_id IS NOT NULL").groupBy("question_id").agg(F.collect_set("conv_id").alias("scopes"))
    asked = t["question"].filter("constrained").select("question_id", F.struct(F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi")).alias("asked"))
    # each atom as itself and, if it is a binding, at each of its referents
    itself = F.array(F.struct(F.col("atom_id").alias("id"), F.lit(None).cast("string").alias("by")))
    at_refs = F.when(F.col("own.kind") == "binding", F.transform("refs", lambda r: F.struct(r.alias("id"), F.col("atom_id").alias("by")))).otherwise(F.array())
    each = pool.select("question_id", "own", F.explode(F.concat(itself, at_refs)).alias("e"))
    seen = each.groupBy("question_id", F.col("e.id").alias("id")).agg(F.max(F.when(F.col("e.by").isNull(), F.struct("own.kind", "own.target"))).alias("own"), F.collect_set("e.by").alias("by"))
    whose = F.concat(F.when(F.col("own").isNotNull(), F.array(F.struct(F.col("id").alias("atom_id"), F.lit(None).cast("string").alias("through")))).otherwise(F.array()),
                     F.transform("by", lambda b: F.struct(b.alias("atom_id"), F.col("id").alias("through"))))
    basis = seen.select("question_id", F.explode(whose).alias("w"), F.col("own").isNull().alias("absent"), F.when(F.col("own").isNull(), "node").otherwise(F.col("own.kind")).alias("kind"), F.coalesce("own.target", F.when(F.col("own").isNull(), F.col("id"))).alias("target"))
    basis = basis.filter("kind IN ('node', 'edge')").select("question_id", "w.*", "absent", "kind", "target", F.col("w.through").isNotNull().alias("bound"))
    basis = basis.join(merged(scope), "question_id", "left").join(merged(asked), "question_id", "left").withColumn("asked", F.when(F.col("bound"), F.col("asked")))

    outside = lambda said: F.col("scopes").isNotNull() & F.coalesce(said["astray"] | (F.size(F.array_except(said["convs"], F.col("scopes"))) > 0), F.lit(False))
    spans = _spans(t["provenance"].filter("edge_id IS NOT NULL").select(F.col("edge_id").alias("id"), "span_id"), t).withColumnRenamed("id", "edge_id")
    edge = t["edge"].filter("edge_id IS NOT NULL").join(merged(spans), "edge_id", "left").withColumnRenamed("edge_id", "target").withColumn("drawn", F.lit(True))
    drawn = basis.filter("kind = 'edge'").join(merged(edge), "target", "left")
    fails = ~F.col("bound") & (F.col("drawn").isNull() | F.col("t_invalid").isNotNull()) | outside(F.struct("astray", "convs"))
    drawn = drawn.withColumn("fails", fails).filter("drawn OR fails")
    ask = lambda what, at: F.struct(F.lit(what).alias("what"), at.alias("at"))
    ends = F.transform(F.array_distinct(F.array("src", "dst")), lambda n: ask("n", n))
    older = F.when(F.col("superseded_by").isNotNull() & ~F.col("bound"), F.array(ask("e", F.col("superseded_by")))).otherwise(F.array())
    asks = F.when(F.col("fails") & ~F.col("bound"), F.array(ask("n", F.col("target")))).otherwise(F.concat(ends, older))
    timed = (F.col("etype") == "valid_during") & (F.col("a.at") == F.col("dst"))
    common = [*key, "through", "bound", "absent", "kind", "scopes", "asked"]
    at_edges = drawn.withColumn("a", F.explode(asks)).select(*common, "a.what", "a.at", "fails", F.coalesce(timed, F.lit(False)).alias("timed"), "t_created")
    at_nodes = basis.filter("kind = 'node'").select(*common, F.lit("n").alias("what"), F.col("target").alias("at"), (F.col("absent") & F.col("scopes").isNotNull()).alias("fails"), F.lit(True).alias("timed"))
    met = at_edges.unionByName(at_nodes, allowMissingColumns=True).join(merged(_known(t)), ["what", "at"], "left")

    node, own = F.col("kind") == "node", ~F.col("bound")
    said = F.when(F.col("what") == "n", F.coalesce("said", F.array()))
    some = lambda f: F.exists(said, f)
    broken = lambda s: s["backed"] & F.col("scopes").isNotNull() & (~s["known"] | outside(s))
    lost = own & node & ~some(lambda s: s["ntype"].isNotNull())
    late = (F.col("what") == "e") & F.coalesce((F.coalesce("times", F.lit(0)) == 0) | (F.col("first") < F.col("t_created")), F.lit(False))
    alone = F.col("fails") | late | F.coalesce(~F.col("absent") & (lost | own & some(lambda s: s["backed"] & ~s["sound"]) | node & some(broken)), F.lit(False))
    evidence = F.coalesce(own & node & some(lambda s: s["backed"]), F.lit(False))
    interval = F.transform(F.filter(said, lambda s: s["ntype"] == "TimeInterval"), lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi")))
    spans = F.concat(F.when(F.col("timed"), interval).otherwise(F.array()), F.when(node, F.coalesce("during", F.array())).otherwise(F.array()))
    spans = F.when(F.col("bound") & ~F.col("absent") & F.col("asked").isNotNull() & (F.col("what") == "n"), spans)
    out = met.select(*key, "through", "asked.*", alone.alias("alone"), evidence.alias("evidence"), F.explode_outer(spans).alias("span"))
    out = out.select(*key, "alone", "evidence", F.when(F.col("span").isNotNull(), F.col("through")).alias("through"), "q_lo", "q_hi", "span.lo", "span.hi")
    return out.filter("alone OR evidence OR through IS NOT NULL").select(*key, "alone", "evidence", "through", F.when(F.col("through").isNotNull(), _overlaps()).alias("meets"))


def facts(tables: dict[str, DataFrame]) -> DataFrame:
    """What the checks have to know of each atom of the pools, so that sets within one pool are judged in their own rows, without the graph.

    question_id, atom_id, alone (it fails one of ALONE, which it does in every set), evidence (a node that an assertion backs), same (a number
    that atoms of equal content share in their pool; null without a kind), slot (one that bindings of a slot share; null for other atoms), refs, meets
    (through, meets: each interval of a binding's referent, and whether it meets the question's). Repeated atoms (the least one counts) and references count once. A set
    passes if no atom fails alone, all refs are selected, no same and no slot is there twice, and no binding has intervals of selected referents that all miss.
    Nothing is written on the way; a pool's atoms and references are shuffled once, by question, where the answers join them.
    """
    key = ["question_id", "atom_id"]
    atom = tables["atom"].select(*key, F.struct("kind", "target", "label").alias("own"))
    rows = atom.unionByName(tables["ref"].select(*key, "ref"), allowMissingColumns=True).na.drop(subset=key).repartition("question_id")
    pool = rows.groupBy(*key).agg(F.min("own").alias("own"), F.collect_set("ref").alias("refs")).filter("own IS NOT NULL")
    answers = pool.unionByName(_found(tables, pool).repartition("question_id"), allowMissingColumns=True).groupBy(*key).agg(
        F.min("own").alias("own"), *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("alone", "evidence")],
        F.array_sort(F.max("refs")).alias("refs"), F.collect_set(F.when(F.col("through").isNotNull(), F.struct("through", "meets"))).alias("meets"),
    )
    told = answers.select(*key, (F.col("alone") | F.col("own.kind").isNull()).alias("alone"), "evidence", "own.*", "refs", "meets")
    same = F.dense_rank().over(W.partitionBy("question_id").orderBy("kind", "target", "label", "refs"))
    slot = F.dense_rank().over(W.partitionBy("question_id").orderBy("label"))
    return told.select(*key, "alone", "evidence", F.when(F.col("kind").isNotNull(), same).alias("same"), F.when(F.col("kind") == "binding", slot).alias("slot"), "refs", "meets")


def violations(tables: dict[str, DataFrame], max_atoms: int = MAX_ATOMS, codes: tuple[str, ...] = tuple(CODES)) -> DataFrame:
    """(set_id, code, atom_id), distinct: which check of H fails where; no row of a set means that it is valid.

    tables: sets (set_id, question_id), member (set_id, atom_id); each question's pool as atom (question_id, atom_id, kind
    node, edge or binding, target, label, a binding's slot) and ref (question_id, atom_id, ref); question (question_id, constrained,
    lo, hi) and scope (question_id, conv_id; none: unrestricted); the graph as node (node_id, ntype, assertion_id, lo, hi), edge
    (edge_id, etype, src, dst, t_created, t_invalid, superseded_by), provenance (edge_id, span_id), assertion (assertion_id,
    eligibility), assertion_span (assertion_id, span_id), span (span_id, turn_id) and turn (turn_id, conv_id).

    H1 size (0 or over max_atoms; atom_id null), H2 the atom is in the pool and denotes something, H3 all references are selected,
    H4 no two atoms of equal content (all but the first), H5 no slot bound twice (its first binding), H6 no invalidated edge,
    H7 every claim, value or event beneath has an eligible assertion, H8 no supersession by an older or unknown edge, and no binding whose
    evidence's intervals all miss the constraint (no interval passes), H9 all provenance inside the question's scope (broken
    chains fail, atoms without provenance pass). What is selected and what it stands on is written once, as far as the codes ask for it, and read by all checks; every join is by equal keys. Null ids match nothing; empty tables give no rows.
    """
    found = _findings(tables, max_atoms, codes=codes)
    parts = [part.select("set_id", F.lit(c).alias("code"), "atom_id") for c in codes for part in found[c]]
    return reduce(DataFrame.unionAll, parts).distinct()


def tally(tables: dict[str, DataFrame], max_atoms: int = MAX_ATOMS) -> DataFrame:
    """(code, name, sets, findings) of all nine checks, those without findings too."""
    spark = tables["sets"].sparkSession
    names = spark.createDataFrame(list(CODES.items()), "code string, name string")
    found = violations(tables, max_atoms).groupBy("code").agg({"set_id": "count"}).withColumnRenamed("count(set_id)", "findings")
    return names.join(found, "code", "left").na.fill(0, ["findings"])
