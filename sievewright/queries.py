"""Registry of the screening operators' queries and their SQL."""

from __future__ import annotations

from .operators import connectors, embedding, experiments, inference, inputs, integrity, lexblock, lexical, metrics, modelling, nearest, pairs, partition, plain, queried, ranking, records, relational, responses, sampling, screening, specs  # noqa: F401
from .plans.catalogue import CATALOGUE

#: Modules whose queries are DataFrame code; a plan of the same name is then what they are held against.
MODULES = (modelling, pairs, lexblock, embedding, experiments, responses, specs, connectors, inference, nearest, partition, queried, records, sampling)
QUERIES = {name: CATALOGUE.query(name) for name in CATALOGUE.plans}
SQL = {name: CATALOGUE.oracle(name) for name in CATALOGUE.plans}
for module in MODULES:
    QUERIES |= module.QUERIES
    SQL |= getattr(module, "oracles", dict)()
