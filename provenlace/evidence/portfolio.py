"""Searches of evidence sets as relations: the states of all questions grow side by side, and the nine checks judge them together.

A state is a row (question_id, chosen): its atoms as an array of structs, atom_id first, with the columns that the score reads. A score is a
column over that array, so it stays in built-in expressions. Sets hold at most ``max_atoms`` atoms; a round joins states to their
question's pool by key, and partial ranks or minima leave each task before anything is shuffled.

tables: those of ``checks.violations`` but sets and member. features (question_id, atom_id, any columns of types that can be ordered).
Atoms without features have nulls there; repeated atoms and features of one atom count once; null ids are no atoms; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from heapq import heapify, heappop
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructType

from provenlace.evidence import checks
from provenlace.evidence.references import HELD
from provenlace.storage import cut

KEY = ["question_id", "atom_id"]
#: Digits of scores that count, so that equal scores are ties whatever the order of their sums.
DIGITS = 9

#: What is asked of a state's atoms beside each other (``checks.facts``).
BESIDE = ("same", "slot", "meets")

Score = Callable[[Column], Column]


def _ids(chosen: Column | str) -> Column:
    return F.transform(chosen, lambda x: x["atom_id"])


def _set_id(*parts: str) -> Column:
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def _once(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """tables with each atom and each reference once, written for the passes that follow."""
    return tables | {"atom": cut(tables["atom"].dropDuplicates(KEY)), "ref": cut(tables["ref"].select(*KEY, "ref").na.drop().distinct())}


def invalid(sets: DataFrame, tables: dict[str, DataFrame], max_atoms: int = checks.MAX_ATOMS, codes: tuple[str, ...] = tuple(checks.CODES)) -> DataFrame:
    """(set_id, code) of the checks that sets (set_id, question_id, atoms) fail, once each; tables hold each atom and reference once."""
    sets = cut(sets.select("set_id", "question_id", "atoms"))
    member = sets.select("set_id", F.explode("atoms").alias("atom_id"))
    return checks.violations(tables | {"sets": sets.select("set_id", "question_id"), "member": member}, max_atoms, codes).select("set_id", "code").distinct()


def pool(tables: dict[str, DataFrame], features: DataFrame, max_atoms: int = checks.MAX_ATOMS, told: DataFrame | None = None) -> DataFrame:
    """(question_id, atom, refs): atoms that some valid set may hold, with their features, what the checks ask of them beside others, and what has to be
    chosen before them. told: ``checks.facts(tables)``, where it is there already."""
    told = checks.facts(tables) if told is None else told
    more = [c for c in features.columns if c not in KEY]
    out = told.filter("NOT alone").filter(F.size("refs") < max_atoms)
    out = out.join(features.dropDuplicates(KEY), KEY, "left") if more else out
    return out.select("question_id", F.struct("atom_id", *more, *[F.col(c).alias(f"{c}__") for c in BESIDE]).alias("atom"), "refs")


def _valid(chosen: Column, max_atoms: int) -> Column:
    """Whether a state of atoms that pass alone, with all that they refer to, passes the checks."""
    once = lambda c: F.size(F.array_distinct(F.array_compact(F.transform(chosen, lambda x: x[c])))) == F.size(F.array_compact(F.transform(chosen, lambda x: x[c])))
    ids = _ids(chosen)
    asked = F.transform(chosen, lambda x: F.filter(x["meets__"], lambda m: F.array_contains(ids, m["through"])))
    late = F.exists(asked, lambda m: (F.size(m) > 0) & ~F.exists(m, lambda t: t["meets"]))
    return F.size(chosen).between(1, max_atoms) & once("same__") & once("slot__") & ~late


def _root(pooled: DataFrame) -> DataFrame:
    return pooled.select("question_id").distinct().withColumn("chosen", F.array().cast(ArrayType(pooled.schema["atom"].dataType)))


def _grown(states: DataFrame, pooled: DataFrame, score: Score) -> DataFrame:
    """Each state with each atom that may be added to it: not chosen yet, all its references chosen."""
    has = _ids("chosen")
    legal = ~F.array_contains(has, F.col("atom.atom_id")) & (F.size(F.array_except("refs", has)) == 0)
    out = states.join(pooled, "question_id").filter(legal).withColumn("added", F.col("atom.atom_id"))
    out = out.withColumn("chosen", F.array_sort(F.array_append("chosen", F.col("atom")))).drop("atom", "refs")
    return out.withColumn("score", F.round(score(F.col("chosen")), DIGITS))


def beam(tables: dict[str, DataFrame], features: DataFrame, score: Score, width: int = 8, keep: int | None = None, max_atoms: int = checks.MAX_ATOMS) -> DataFrame:
    """(question_id, place, set_id, atoms, score): the best valid sets among all that a beam of ``width`` sets passes, ``keep`` a question.

    Each layer holds the best of all ways to add a legal atom to a set of the layer before, equal sets once, ties by
    their ids. The checks are asked of the pools once; what they leave to a set's atoms together is judged in the sets' own rows.
    """
    pooled = cut(pool(tables, features, max_atoms))
    layer, layers = _root(pooled), []
    best = W.partitionBy("question_id").orderBy(F.desc_nulls_last("score"), _ids("chosen"))
    for _ in range(max_atoms):
        grown = _grown(layer.select("question_id", "chosen"), pooled, score).drop("added")
        layer = cut(grown.withColumn("rn", F.dense_rank().over(best)).filter(F.col("rn") <= width).drop("rn").dropDuplicates(["question_id", "chosen"]))
        layers.append(layer)
        if layer.isEmpty():
            break
    seen = reduce(DataFrame.unionByName, layers).filter(_valid(F.col("chosen"), max_atoms)).select("question_id", _ids("chosen").alias("atoms"), "score")
    first = W.partitionBy("question_id").orderBy(F.desc_nulls_last("score"), "atoms")
    valid = seen.withColumn("set_id", _set_id("question_id", "atoms")).withColumn("place", F.row_number().over(first))
    return valid.filter(F.col("place") <= (width if keep is None else keep)).select("question_id", "place", "set_id", "atoms", "score")


def greedy(tables: dict[str, DataFrame], features: DataFrame, score: Score, openers: int = 8, relevance: str = "worth", max_atoms: int = checks.MAX_ATOMS) -> DataFrame:
    """(question_id, opener, set_id, atoms, score): one run for each of the ``openers`` most relevant atoms that may come first.

    A run adds the atom of the largest gain, the least id among equals. It ends at the first valid set that no atom
    improves; a run that meets none is a dead end: its set_id, atoms and score are null. Sets are judged as in ``beam``.
    """
    pooled = cut(pool(tables, features, max_atoms))
    first = W.partitionBy("question_id").orderBy(F.desc(F.coalesce(F.col(f"atom.{relevance}"), F.lit(0.0))), "atom.atom_id")
    root = pooled.filter(F.size("refs") == 0).withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= openers)
    step = root.select("question_id", F.col("atom.atom_id").alias("opener"), F.array("atom").alias("chosen")).withColumn("score", F.round(score(F.col("chosen")), DIGITS))
    runs, ways = ["question_id", "opener"], []
    for n in range(1, max_atoms + 1):
        step = cut(step)
        ways.append(step.withColumn("n", F.lit(n)))
        if n == max_atoms or step.isEmpty():
            break
        order = F.struct(-F.coalesce("score", F.lit(float("-inf"))), "added")
        step = _grown(step.select(*runs, "chosen"), pooled, score).groupBy(*runs).agg(F.min_by(F.struct("chosen", "score"), order).alias("best")).select(*runs, "best.*")
    ahead = F.lead("score").over(W.partitionBy(*runs).orderBy("n"))
    way = reduce(DataFrame.unionByName, ways).select(*runs, "n", "chosen", "score", ahead.alias("ahead"))
    ends = (F.col("ahead").isNull() | (F.col("ahead") <= F.col("score"))) & _valid(F.col("chosen"), max_atoms)
    way = way.withColumn("atoms", _ids("chosen")).withColumn("set_id", F.when(ends, _set_id("question_id", "atoms")))
    return way.groupBy(*runs).agg(F.min_by(F.struct("set_id", "atoms", "score"), F.when(F.col("set_id").isNotNull(), F.col("n"))).alias("end")).select(*runs, "end.*")


def h_filter(candidates: DataFrame, tables: dict[str, DataFrame], budget: int | None = None, max_atoms: int = checks.MAX_ATOMS) -> DataFrame:
    """candidates (question_id, place, atoms) with set_id, checked, valid and codes (the checks it fails, in order).

    Equal sets are one and are judged once, at their first place; they share the verdict. With a budget only the first
    ``budget`` different sets of a question are judged: for the others checked is false, valid and codes are null. The rows that are valid
    are the portfolio with its repeats.
    """
    return _judged(candidates, _once(tables), budget, max_atoms)


def _judged(candidates: DataFrame, tables: dict[str, DataFrame], budget: int | None, max_atoms: int) -> DataFrame:
    """``h_filter`` of tables that hold each atom and reference once."""
    sets = candidates.withColumn("atoms", F.array_sort(F.array_distinct("atoms"))).withColumn("set_id", _set_id("question_id", "atoms"))
    sets = cut(sets.select("question_id", "place", "set_id", "atoms"))
    once = sets.groupBy("question_id", "set_id").agg(F.min("place").alias("first"), F.any_value("atoms").alias("atoms"))
    if budget is not None:
        once = once.withColumn("rn", F.row_number().over(W.partitionBy("question_id").orderBy("first", "set_id"))).filter(F.col("rn") <= budget)
    once = cut(once)
    codes = invalid(once, tables, max_atoms).groupBy("set_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    none = F.array().cast("array<string>")
    verdict = once.select("set_id", F.lit(True).alias("checked")).join(codes, "set_id", "left").withColumn("codes", F.coalesce("codes", none))
    out = sets.join(verdict, "set_id", "left")
    return out.select("question_id", "place", "set_id", "atoms", F.coalesce("checked", F.lit(False)).alias("checked"), (F.size("codes") == 0).alias("valid"), "codes")


def rejections(judged: DataFrame) -> DataFrame:
    """(code, name, sets): how many different checked sets each check refuses, those that refuse none too."""
    names = judged.sparkSession.createDataFrame(list(checks.CODES.items()), "code string, name string")
    seen = judged.filter("checked").select("set_id", F.explode("codes").alias("code")).distinct().groupBy("code").agg(F.count(F.lit(1)).alias("sets"))
    return names.join(seen, "code", "left").na.fill(0, ["sets"])


def by_relevance(tables: dict[str, DataFrame], features: DataFrame, relevance: str = "worth", max_atoms: int = checks.MAX_ATOMS) -> DataFrame:
    """One set a question, as ``h_filter`` gives it: atoms by (-relevance, number of references, id), each with all it refers to, while they fit.

    What does not fit never fits later, as sets only grow, so one walk over a pool in order is enough. A pool's atoms, references and features meet by one shuffle on
    the question; a task holds one pool at a time. A set holds all that its atoms refer to, so the checks get the chosen atoms with their references alone, not the pools.
    """
    rows = [
        tables["atom"].select(*KEY, F.lit("atom").alias("what"), "kind", "target", "label"), tables["ref"].select(*KEY, F.lit("ref").alias("what"), F.col("ref").alias("target")).filter("target IS NOT NULL"),
        features.select(*KEY, F.lit("worth").alias("what"), F.col(relevance).cast("double").alias("worth")).filter("worth IS NOT NULL"),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).na.drop(subset=KEY)
    out = StructType([*rows.select(*KEY, "kind", "target", "label").schema]).add("pooled", "boolean").add("refs", ArrayType(StringType()))
    columns = out.names

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = (row for pdf in batches for row in zip(*(pdf[c].tolist() for c in pdf.columns), strict=True))
        put: list[tuple] = []
        for question, told in groupby(each, itemgetter(0)):
            put += [(question, *row) for row in _selected(told, max_atoms)]
            if len(put) >= HELD:
                yield pd.DataFrame(put, columns=columns)
                put = []
        if put:
            yield pd.DataFrame(put, columns=columns)

    chosen = cut(rows.repartition("question_id").sortWithinPartitions("question_id").mapInPandas(walked, out))
    small = tables | {"atom": chosen.filter("pooled").select(*KEY, "kind", "target", "label"), "ref": chosen.select(*KEY, F.explode("refs").alias("ref"))}
    last = chosen.groupBy("question_id").agg(F.collect_list("atom_id").alias("atoms"))
    return _judged(last.withColumn("place", F.lit(1)), small, None, max_atoms)


def _selected(told: Iterator[tuple], most: int) -> Iterator[tuple]:
    """(atom_id, kind, target, label, pooled, refs) of the atoms that ``by_relevance`` chooses from a pool's rows."""
    pool: dict = {}
    refs: dict = {}
    worth: dict = {}
    for _, atom, what, kind, target, label, value in told:
        if what == "ref":
            refs.setdefault(atom, set()).add(target)
        elif what == "atom":
            pool.setdefault(atom, (kind, target, label))
        else:
            worth[atom] = max(worth.get(atom, value), value)
    low = {a: -worth.get(a, 0.0) for a in pool}
    # a worth that is no number comes last
    queue = [(low[a] != low[a], 0.0 if low[a] != low[a] else low[a], len(refs.get(a, ())), a) for a in pool]
    heapify(queue)
    chosen: dict = {}
    while queue and len(chosen) < most:
        first = heappop(queue)[-1]
        new, todo = dict.fromkeys([first]), [first]
        while todo and len(new.keys() - chosen.keys()) <= most - len(chosen):
            for r in refs.get(todo.pop(), ()):
                if r not in new:
                    new[r] = None
                    todo.append(r)
        if len(chosen | new) <= most:
            chosen |= new
    return ((a, *pool.get(a, (None, None, None)), a in pool, sorted(refs.get(a, ()))) for a in chosen)


class _Chosen:
    """A set from which atoms are taken and to which they are put back, with counts of all that the checks ask."""

    def __init__(self, atoms: list[dict], most: int):
        self.atoms, self.most = {a["atom_id"]: a for a in atoms}, most
        self.now: set = set()
        self.bad = self.missing = self.double = self.late = 0
        self.seen: Counter = Counter()
        self.asked, self.met = Counter(), Counter()
        self.holders: dict = {}
        self.timed: dict = {}
        for i, a in self.atoms.items():
            for r in a["refs"]:
                self.holders.setdefault(r, []).append(i)
            for m in a["meets"]:
                self.timed.setdefault(m["through"], []).append((i, m["meets"]))
        for i in self.atoms:
            self.move(i, 1)

    def _late(self, i: str) -> bool:
        return i in self.now and self.asked[i] > 0 and self.met[i] == 0

    def move(self, i: str, by: int) -> None:
        """Put i into the set (by 1) or take it out (by -1)."""
        a = self.atoms[i]
        touched = {i, *[b for b, _ in self.timed.get(i, ())]}
        self.late -= sum(map(self._late, touched))
        self.missing -= by * sum(h in self.now for h in self.holders.get(i, ()) if h != i)
        self.missing += by * sum(r not in self.now for r in a["refs"] if r != i)
        self.bad += by * a["alone"]
        for key in (("same", a["same"]), ("slot", a["slot"])):
            if key[1] is not None:
                self.double += by * (self.seen[key] > (by < 0))
                self.seen[key] += by
        for b, meets in self.timed.get(i, ()):
            self.asked[b] += by
            self.met[b] += by * bool(meets)
        (self.now.add if by > 0 else self.now.discard)(i)
        self.late += sum(map(self._late, touched))

    def valid(self) -> bool:
        return 0 < len(self.now) <= self.most and not (self.bad or self.missing or self.double or self.late)


def minimise(tables: dict[str, DataFrame], max_atoms: int = checks.MAX_ATOMS, told: DataFrame | None = None) -> DataFrame:
    """(set_id, atoms, removed, passes, evidence): sets (tables with sets and member) without the structural atoms that the checks can spare.

    Sweeps over a set's structural atoms by id leave out each whose deletion keeps the set valid, until a sweep finds none: a
    set from which no single atom can go, not the smallest one. Evidence (nodes of types that an assertion backs) never goes. passes
    counts the sweeps, the last one too.

    The checks are asked of the pools once (told: ``checks.facts(tables)``, where it is there already). A set's atoms then meet in a row with what the checks said
    of them, and its sweeps run there: a deletion changes counts of what it touches, so no set is judged whole again.
    """
    if told is None:
        told = checks.facts(tables)
    known = F.struct("atom_id", F.coalesce("alone", F.lit(True)).alias("alone"), F.coalesce("evidence", F.lit(False)).alias("evidence"), "same", "slot", F.coalesce("refs", F.array().cast("array<string>")).alias("refs"),
                     F.coalesce("meets", F.array().cast(told.schema["meets"].dataType.simpleString())).alias("meets"))
    member = tables["sets"].select("set_id", "question_id").distinct().join(tables["member"].select("set_id", "atom_id").na.drop().distinct(), "set_id", "left")
    sets = member.join(told, KEY, "left").groupBy("set_id").agg(F.collect_list(F.when(F.col("atom_id").isNotNull(), known)).alias("own"))

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                own = sorted(b.column(1)[i].as_py(), key=lambda a: a["atom_id"])
                chosen, spare, passes, moved = _Chosen(own, max_atoms), [a["atom_id"] for a in own if not a["evidence"]], 0, True
                while moved:
                    passes, moved = passes + 1, False
                    for a in spare:
                        chosen.move(a, -1)
                        if chosen.valid():
                            moved = True
                        else:
                            chosen.move(a, 1)
                    spare = [a for a in spare if a in chosen.now]
                left = [a["atom_id"] for a in own if a["atom_id"] in chosen.now]
                row = {"set_id": b.column(0)[i].as_py(), "atoms": left, "removed": len(own) - len(left), "passes": passes, "evidence": sum(a["evidence"] for a in own)}
                yield pa.RecordBatch.from_pylist([row], schema)

    kind = sets.schema["set_id"].dataType
    out = StructType().add("set_id", kind).add("atoms", ArrayType(StringType())).add("removed", "integer").add("passes", "integer").add("evidence", "integer")
    schema = to_arrow_schema(out)
    return sets.mapInArrow(swept, out)
