"""References among a pool's atoms: closure, cycles with their members, levels, and what makes a pool invalid.

Ids are strings. A pool's references meet once, by one shuffle and a sort on the question, and are followed there; none leaves its question, so no table of
pairs is made but the closure's own. A task holds one pool at a time, with memory in proportion to its references.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR = ["question_id", "atom_id", "ref"]
#: Rows that a task puts out at once.
HELD = 100_000


def _by_pool(rows: DataFrame, solve: Callable[[object, list[tuple]], Iterator[tuple]], kinds: dict[str, str]) -> DataFrame:
    """The rows (columns and types: kinds) that ``solve`` gives of each question's rows, of which it gets the question and the rest as tuples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        each = (row for pdf in batches for row in zip(*(pdf[c].tolist() for c in pdf.columns), strict=True))
        for question, own in groupby(each, itemgetter(0)):
            for row in solve(question, [r[1:] for r in own]):
                out.append((question, *row))
                if len(out) >= HELD:
                    yield pd.DataFrame(out, columns=[*kinds])
                    out = []
        if out:
            yield pd.DataFrame(out, columns=[*kinds])

    return rows.repartition("question_id").sortWithinPartitions("question_id").mapInPandas(run, ", ".join(f"{c} {t}" for c, t in kinds.items()))


def _linked(pairs: list[tuple]) -> dict:
    out: dict = {}
    for a, r in pairs:
        out.setdefault(a, set()).add(r)
    return out


def _reached(refs: dict, atom: object) -> dict:
    """What an atom reaches, with the least number of references to it."""
    found, layer, hops = {}, [atom], 0
    while layer:
        hops += 1
        layer = [*dict.fromkeys(r for x in layer for r in refs.get(x, ()) if r not in found)]
        found |= dict.fromkeys(layer, hops)
    return found


def _components(refs: dict) -> Iterator[list]:
    """Sets of atoms that reach each other, single ones too; those that a set refers to come before it (Tarjan's, without recursion)."""
    index: dict = {}
    low: dict = {}
    stack: list = []
    on: set = set()
    for root in refs:
        todo = [] if root in index else [(root, iter(refs[root]))]
        while todo:
            v, rest = todo[-1]
            if v not in index:
                index[v] = low[v] = len(index)
                stack.append(v)
                on.add(v)
            for w in rest:
                if w not in index:
                    todo.append((w, iter(refs.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[v])
                if low[v] == index[v]:
                    own = [stack.pop()]
                    while own[-1] != v:
                        own.append(stack.pop())
                    on.difference_update(own)
                    yield own


def _turning(refs: dict, own: list) -> bool:
    return len(own) > 1 or own[0] in refs.get(own[0], ())


def _kinds(df: DataFrame, *names: str) -> dict[str, str]:
    return {n: df.schema[n].dataType.simpleString() for n in names}


def closure(ref: DataFrame) -> DataFrame:
    """(question_id, atom_id, ref, hops): all that an atom's references reach, and over how few of them.

    There is no limit on hops. A pool gives a pair per atom and atom it reaches, and no pair leaves its question. An atom on a
    cycle reaches itself. Null ids reach nothing; repeated references count once; an empty table gives an empty result.
    """

    def solve(question: object, pairs: list[tuple]) -> Iterator[tuple]:
        refs = _linked(pairs)
        return ((a, r, hops) for a in refs for r, hops in _reached(refs, a).items())

    return _by_pool(ref.select(*PAIR).na.drop(), solve, _kinds(ref, *PAIR) | {"hops": "long"})


def cycles(ref: DataFrame) -> DataFrame:
    """(question_id, cycle_id, atom_id): the members of each set of atoms that all reach each other; cycle_id is the least of them."""

    def solve(question: object, pairs: list[tuple]) -> Iterator[tuple]:
        refs = _linked(pairs)
        return ((first, a) for own in _components(refs) if _turning(refs, own) for first in [min(own)] for a in own)

    kinds = _kinds(ref, *PAIR)
    return _by_pool(ref.select(*PAIR).na.drop(), solve, {"question_id": kinds["question_id"], "cycle_id": kinds["atom_id"], "atom_id": kinds["atom_id"]})


def _told(atom: DataFrame, ref: DataFrame) -> DataFrame:
    """Atoms and references in one table: (question_id, atom_id, ref, is_ref)."""
    return atom.select("question_id", "atom_id", F.lit(None).cast(ref.schema["ref"].dataType).alias("ref"), F.lit(False).alias("is_ref")).unionByName(
        ref.select(*PAIR, F.lit(True).alias("is_ref"))
    )


def levels(atom: DataFrame, ref: DataFrame) -> DataFrame:
    """(question_id, atom_id, level): the most references in a row from an atom; 0 without any, null for what reaches a cycle.

    References to atoms outside the pool do not count.
    """

    def solve(question: object, rows: list[tuple]) -> Iterator[tuple]:
        refs: dict = {a: set() for a, _, is_ref in rows if not is_ref}
        for a, r, is_ref in rows:
            if is_ref and a in refs and r in refs:
                refs[a].add(r)
        level: dict = {}
        for own in _components(refs):
            ahead = [level[r] for r in refs[own[0]] if r in level]
            endless = _turning(refs, own) or any(level[r] is None for a in own for r in refs[a] if r in level)
            level |= dict.fromkeys(own, None if endless else max(ahead, default=-1) + 1)
        return iter(level.items())

    pool = atom.select("question_id", "atom_id").na.drop()
    return _by_pool(_told(pool, ref.select(*PAIR).na.drop()), solve, _kinds(atom, "question_id", "atom_id") | {"level": "long"})


def problems(atom: DataFrame, ref: DataFrame, cap: int | None = None) -> DataFrame:
    """(question_id, problem, atom_id, detail): why a pool is invalid; a question without rows has a valid pool.

    over_cap: more atoms than the cap (detail: how many); missing: a reference to no atom of the pool (detail: to what); cycle: an
    atom that waits for itself (detail: the least atom of its cycle). Null ids are no atoms that could be referred to.
    """

    def solve(question: object, rows: list[tuple]) -> Iterator[tuple]:
        pool = {a for a, _, is_ref in rows if not is_ref}
        known = {a for a in pool if a is not None} if question is not None else set()
        pairs = {(a, r) for a, r, is_ref in rows if is_ref}
        yield from (("missing", a, r) for a, r in pairs if r not in known)
        refs = _linked([(a, r) for a, r in pairs if a is not None and r in known])
        yield from (("cycle", a, first) for own in _components(refs) if _turning(refs, own) for first in [min(own)] for a in own)
        if cap is not None and len(pool) > cap:
            yield "over_cap", None, str(len(pool))

    return _by_pool(_told(atom, ref), solve, _kinds(atom, "question_id") | {"problem": "string"} | _kinds(atom, "atom_id") | {"detail": "string"})
