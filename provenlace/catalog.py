"""All registered queries of the evidence-graph engine, with their SQL."""

from __future__ import annotations

from provenlace.evidence import gate_queries, log_queries, pool_queries, portfolio_queries, position_queries
from provenlace.evidence import queries as evidence
from provenlace.functions import grounding_queries
from provenlace.functions import queries as functions
from provenlace.operators import queries as grouped
from provenlace.plans import evaluation, graph, lattice, log, partition, text, validity
from provenlace.plans.dialect import plan
from provenlace.streaming import building, liveness

QUERIES: dict = {}
ORACLE: dict = {}
for _module in (text, log, graph, validity, lattice, evaluation):
    # some plans have another, plainer form to be compared with
    for _name, _body in _module.PLANS.items():
        QUERIES[_name], ORACLE[_name] = plan(_body)[0], plan(getattr(_module, "PLAIN", {}).get(_name, _body))[1]
for _module in (grouped, evidence, gate_queries, log_queries, pool_queries, portfolio_queries, position_queries, functions, grounding_queries, liveness, building, partition):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
