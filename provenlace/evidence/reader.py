"""What a reader is shown, and what its answers say: quotes, order, token budget, answers and their citations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provenlace.plans.views import ARTICLES

#: How an abstention begins, what a citation looks like, and a quote's length.
ABSTENTION = "INSUFFICIENT EVIDENCE"
CITATION = r"(?i)\[(c[0-9]+)\]"
LONGEST_QUOTE = 400


def squeeze(text: Column) -> Column:
    """Text with runs of blanks as one blank, none at its ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalise_answer(text: Column) -> Column:
    """Lower-cased words of an answer without citations, punctuation and articles."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(text, CITATION, " ")), r"[^\p{L}\p{N}_\s]", "")
    words = F.split(squeeze(bare), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*ARTICLES.split())), " ")


def _unwrapped(text: Column) -> Column:
    """Text out of all brackets that enclose the whole of it."""
    one = lambda t: F.when((F.length(t) > 1) & t.startswith("[") & t.endswith("]"), F.trim(t.substr(F.lit(2), F.length(t) - 2))).otherwise(t)
    return F.aggregate(F.sequence(F.lit(0), F.length(F.regexp_extract(text, r"^[\[ ]*", 0))), text, lambda t, _: one(t))


def parse_answer(generation: Column) -> Column:
    """A struct of answer_text, citations (lower case, in order, once each) and abstained.

    A leading 'answer:' goes. An answer abstains if, out of enclosing brackets and without citations, it begins
    with the abstention phrase, or if nothing of it would be scored; it then has no citations. Null is the empty answer.
    """
    text = F.regexp_replace(F.coalesce(generation, F.lit("")), r"^\s+|\s+$", "")
    text = F.when(F.lower(F.substring(text, 1, 7)) == "answer:", F.regexp_replace(text.substr(F.lit(8), F.length(text)), r"^\s+", "")).otherwise(text)
    cited = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)), F.lower))
    bare = _unwrapped(squeeze(F.regexp_replace(text, CITATION, " ")))
    abstained = F.lower(bare).startswith(ABSTENTION.lower()) | (normalise_answer(text) == "")
    none = F.array().cast("array<string>")
    return F.struct(text.alias("answer_text"), F.when(abstained, none).otherwise(cited).alias("citations"), abstained.alias("abstained"))


def resolve_citations(parsed: DataFrame, shown: DataFrame, strict: bool = True) -> DataFrame:
    """(answer_id, pos, citation, atom_id): citations of parsed (answer_id, citations) found among shown (answer_id, claim_id, atom_id).

    One that names nothing shown is an error, or, unless strict, has a null atom_id.
    """
    cited = parsed.select("answer_id", F.posexplode("citations").alias("pos", "citation"))
    claims = shown.select("answer_id", F.col("claim_id").alias("citation"), "atom_id", F.lit(True).alias("known"))
    out = cited.join(claims, ["answer_id", "citation"], "left")
    if strict:
        lost = F.raise_error(F.concat(F.lit("a citation of nothing shown: "), "citation")).cast("string")
        out = out.withColumn("atom_id", F.when(F.col("known"), F.col("atom_id")).otherwise(lost))
    return out.select("answer_id", "pos", "citation", "atom_id")


def clipped(text: Column) -> Column:
    """Text of at most LONGEST_QUOTE characters; a longer one ends in an ellipsis instead."""
    cut = F.concat(F.rtrim(F.substring(text, 1, LONGEST_QUOTE - 1)), F.lit("…"))
    return F.when(F.length(text) > LONGEST_QUOTE, cut).otherwise(text)


def quotes(atoms: DataFrame, spans_of: DataFrame, span: DataFrame, turn: DataFrame, edge: DataFrame, names: DataFrame) -> DataFrame:
    """(question_id, atom_id, quote): what an atom says.

    An edge atom names its type and its target, by names (node_id, name) or, without one, by id. A node atom is the first
    passage, by spans_of (target, pos, span_id), that is known and not blank, else its name, else ''.
    """
    passages = spans_of.join(span.select("span_id", "turn_id", "start", "end"), "span_id").join(turn.select("turn_id", "text"), "turn_id")
    said = F.trim(F.expr("substring(text, start + 1, greatest(end - start, 0))"))
    first = passages.select("target", "pos", said.alias("said")).filter("said <> ''").groupBy("target").agg(F.min_by("said", F.struct("pos", "said")).alias("said"))
    names = names.filter("name <> ''").select(F.col("node_id").alias("target"), "name")
    node = atoms.filter("kind = 'node'").join(first, "target", "left").join(names, "target", "left")
    node = node.select("question_id", "atom_id", clipped(F.coalesce("said", "name", F.lit(""))).alias("quote"))
    ends = edge.select(F.col("edge_id").alias("target"), "etype", "dst").join(names.select(F.col("target").alias("dst"), "name"), "dst", "left")
    rel = atoms.filter("kind = 'edge'").join(ends, "target", "left")
    shown = F.concat(F.lit("("), "etype", F.lit(" → "), F.coalesce("name", "dst"), F.lit(")"))
    return node.unionByName(rel.select("question_id", "atom_id", F.coalesce(shown, F.lit("")).alias("quote")))


def order(atoms: DataFrame) -> DataFrame:
    """Adds place (from 1) to (question_id, atom_id, kind, hit, score): the strongest first, edges in the middle, the next strongest last.

    Strength: an anchor hit, then the score, then the id, all descending. The better half of the atoms that are no edges
    (the larger half, if odd) leads; the other half comes last, in reverse. A question's atoms are one set, a few dozen.
    """
    strength = (F.coalesce("hit", F.lit(False)).desc(), F.coalesce("score", F.lit(0.0)).desc(), F.col("atom_id").desc())
    middle = F.col("kind") == "edge"
    side = W.partitionBy("question_id", middle)
    every = W.partitionBy("question_id")
    ranked = atoms.withColumn("__r", F.row_number().over(side.orderBy(*strength)))
    ranked = ranked.withColumn("__e", F.count_if(middle).over(every)).withColumn("__n", F.count(F.lit(1)).over(every))
    head = F.ceil((F.col("__n") - F.col("__e")) / 2)
    place = F.when(middle, head + F.col("__r")).when(F.col("__r") <= head, F.col("__r")).otherwise(head + F.col("__n") + 1 - F.col("__r"))
    return ranked.withColumn("place", place.cast("long")).drop("__r", "__e", "__n")


def approx_tokens(text: Column) -> Column:
    """1.3 tokens a word, rounded up."""
    words = F.size(F.filter(F.split(squeeze(text), " "), lambda w: w != ""))
    return F.floor((words * 13 + 9) / 10).cast("long")


def _within(ids: list[str], cost: dict[str, int], refs: dict[str, list[str]], budget: int) -> list[str]:
    used, kept = 0, set()
    for x in ids:  # a tail is cut off; the first always stays
        if kept and used + cost[x] > budget:
            break
        kept.add(x)
        used += cost[x]
    while loose := {x for x in kept if not kept.issuperset(refs[x])}:
        kept -= loose
        used -= sum(cost[x] for x in loose)
    again = True
    while again:  # what came free goes to the first that may come back, as long as the next one fits
        again = False
        for x in ids:
            if x in kept or not kept.issuperset(refs[x]):
                continue
            if used + cost[x] > budget:
                break
            kept.add(x)
            used += cost[x]
            again = True
    return [x for x in ids if x in kept]


def cut(placed: DataFrame, budget: int) -> DataFrame:
    """(question_id, atom_id, claim_id, position) of the atoms of (question_id, atom_id, place, tokens, refs) that a budget of tokens holds.

    Claims are numbered over the whole order, so an atom has one id at every budget. The order's end is cut off at the first
    atom that does not fit (the first atom always stays), then atoms that refer to one not kept go, and what they free is
    given back in order, up to the first one that does not fit.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        ids = list(pdf["atom_id"])
        refs = {a: [r for r in rs] if rs is not None else [] for a, rs in zip(ids, pdf["refs"], strict=True)}
        kept = _within(ids, dict(zip(ids, map(int, pdf["tokens"]), strict=True)), refs, budget)
        number = {a: f"c{i + 1}" for i, a in enumerate(ids)}
        return pd.DataFrame({
            "question_id": [pdf["question_id"].iloc[0]] * len(kept), "atom_id": kept, "claim_id": [number[a] for a in kept], "position": range(len(kept)),
        })

    slim = placed.select(F.col("question_id").cast("string"), "atom_id", "place", "tokens", "refs")
    return slim.groupBy("question_id").applyInPandas(one, "question_id string, atom_id string, claim_id string, position long")
