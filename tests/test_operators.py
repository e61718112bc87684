"""Searches and resampling against independent enumeration on small instances."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from provenlace.operators import search, statistics


def instance(seed, n=7):
    rng = random.Random(seed)
    worth = {a: round(rng.random(), 3) for a in range(n)}
    refs = {a: {rng.randrange(a)} if a and rng.random() < 0.5 else set() for a in range(n)}
    return worth, refs


def closed_sets(worth, refs, most):
    for n in range(most + 1):
        for c in itertools.combinations(sorted(worth), n):
            if all(refs[a] <= set(c) for a in c):
                yield set(c)


def test_searches_return_closed_sets_and_beam_reaches_the_best():
    for seed in range(20):
        worth, refs = instance(seed)
        similar = search.likeness(worth)
        best = max(search.utility(s, worth, similar) for s in closed_sets(worth, refs, 4))
        found = {
            "greedy": search.greedy(worth, refs, similar, 4),
            "beam": search.beam(worth, refs, similar, 4, width=200),
            "relevance": search.by_relevance(worth, refs, 4),
        }
        for ids in found.values():
            assert len(ids) <= 4
            assert all(refs[a] <= set(ids) for a in ids)
        assert abs(search.utility(set(found["beam"]), worth, similar) - best) < 1e-9


def coverage(worth, saturation=0.3):
    """The four terms written out over all atoms."""
    alike = lambda a, b: max(0.0, 1 - 2 * abs(worth[a] - worth[b]))
    total = sum(worth.values())

    def value(s):
        if not s:
            return 0.0
        mass = lambda atoms: sum(min(sum(alike(i, j) for j in atoms), saturation * sum(alike(i, j) for j in worth)) for i in worth)
        div = lambda atoms: sum(sum(worth[a] for a in atoms if a % 3 == g) ** 0.5 for g in range(3))
        return sum(worth[a] for a in s) / total + 0.5 * len({a % 4 for a in s} & {0, 1, 2}) / 3 + 0.4 * mass(s) / mass(worth) + 0.3 * div(s) / div(worth)

    return alike, value


def test_coverage_objective_and_its_chains():
    for seed in range(20):
        worth, refs = instance(seed)
        alike, want = coverage(worth)
        value = search.objective(worth, alike, {a: {a % 4} for a in worth}, {0, 1, 2}, {a: a % 3 for a in worth})
        sets = list(closed_sets(worth, refs, 4))
        assert all(abs(value(s) - want(s)) < 1e-9 for s in sets)
        assert abs(value(set(worth)) - 2.2) < 1e-9
        best = max(map(want, sets))
        found = search.submodular(worth, refs, value, 4)
        assert all(set(s) in sets for s in found)
        assert want(found[0]) >= 0.63 * best
        assert [want(s) for s in found] == sorted(map(want, found), reverse=True)
        chain = search.cover_chain(value, sorted(worth), {}, 3)  # without references: the largest gain each time
        step = []
        while len(step) < 3:
            step.append(max((a for a in worth if a not in step), key=lambda a: (round(want({*step, a}), 9), -a)))
        assert chain == sorted(step)


def test_coverage_without_slots_and_with_a_small_budget():
    worth = {0: 0.5, 1: 0.5, 2: 0.9}
    none = search.objective(worth, lambda a, b: float(a == b), {}, set(), {})
    assert none(set()) == 0 and none({0}) > 0.5
    assert search.cover_chain(none, [0, 1, 2], {2: [0, 1]}, 2) == [0, 1]
    assert search.cover_chain(none, [0, 1, 2], {}, 1, opener=0) == [2]  # the single set is worth more than the forced one
    assert search.submodular({}, {}, lambda s: 0.0, 4) == []


def parts_of(atoms, near):
    """Sets of atoms that links inside atoms hold together."""
    parts, seen = [], set()
    for a in sorted(atoms):
        if a not in seen:
            part, todo = set(), [a]
            while todo:
                x = todo.pop()
                if x not in part:
                    part.add(x)
                    todo += near[x] & set(atoms)
            seen |= part
            parts.append(part)
    return parts


def test_tree_packing_is_the_best_forest():
    """In each component, no connected subset is worth more, and one of equal worth is neither smaller nor comes first."""
    for seed in range(30):
        worth, refs = instance(seed, 7)
        if seed % 3 == 0:
            worth = dict.fromkeys(worth, 0.2)  # ties
        got = search.tree_packing(worth, refs, 0.2)
        near = {a: refs[a] | {b for b in worth if a in refs[b]} for a in worth}
        for part in parts_of(worth, near):
            options = [c for n in range(1, len(part) + 1) for c in itertools.combinations(sorted(part), n) if len(parts_of(c, near)) == 1]
            gain = lambda s: round(sum(worth[a] for a in s) - 0.2 * (len(s) - 1), 9)
            best = min(options, key=lambda c: (-gain(c), len(c), c))
            assert set(got) & part == (set(best) if gain(best) > 0 else set())


def test_tree_packing_refuses_large_components():
    chain = {a: {a - 1} if a else set() for a in range(21)}
    with pytest.raises(ValueError, match="too large"):
        search.tree_packing(dict.fromkeys(chain, 1.0), chain)


def test_capped_pool_skips_and_goes_on():
    assert search.capped_pool({1: 3.0, 2: 2.0, 3: 1.0}, {1: {10, 11}, 2: {20, 21, 22}, 3: {10}}, 4) == [1, 3, 10, 11]


def test_minimise_never_drops_evidence():
    assert search.minimised({1, 2, 3, 4}, {1: {2}, 4: {3}}, {1}) == [1, 2]


def test_bootstrap_and_mcnemar():
    mean, low, high = statistics.bootstrap_interval(np.array([0.0, 1.0] * 50), np.arange(100))
    assert low < mean == 0.5 < high
    assert statistics.mcnemar(0, 0) == 1.0
    assert abs(statistics.mcnemar(1, 9) - 2 * 11 / 1024) < 1e-12


def test_poisson_resamples_spread_as_a_bootstrap_does():
    rng = np.random.default_rng(3)
    x = rng.normal(0.3, 2.0, 3000)
    keys = rng.integers(-(2**62), 2**62, 3000)
    n = statistics.resample_counts(keys, 500, 11)
    assert abs(n.mean() - 1) < 0.01 and abs(n.var() - 1) < 0.02
    assert (statistics.resample_counts(keys[::-1], 500, 11)[::-1] == n).all()
    means = (x @ n) / n.sum(0)
    assert abs(means.mean() - x.mean()) < 0.01
    assert abs(means.std() / (x.std() / 3000**0.5) - 1) < 0.15
