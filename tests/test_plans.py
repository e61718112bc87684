"""Every relational plan against DuckDB, and the golden cases of the survey."""

from __future__ import annotations

import pytest

from provenlace import catalog
from provenlace.plans import lattice
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_oracle(spark, name):
    assert_same(catalog.QUERIES[name](spark, SF), catalog.ORACLE[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_target_sums_to_one(spark):
    mass = catalog.QUERIES["target_distribution"](spark, SF).groupBy().sum("p").collect()[0][0]
    assert abs(mass - 1) < 1e-6


def test_states_within_steps(spark):
    states = catalog.QUERIES["lattice_states"](spark, SF).collect()
    assert all(r["mask"].bit_count() == r["size"] <= lattice.STEPS for r in states)


def test_replay_prefix_is_subset(spark):
    part = {r["seq"] for r in catalog.QUERIES["log_replay_asof"](spark, SF).collect()}
    assert part == set(range(len(part)))
