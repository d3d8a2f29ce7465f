"""Queries over the benchmark tables and the SQL that must give the same rows."""

from . import cuts, lines, measures, names, regions

MODULES = (regions, names, lines, cuts, measures)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLES = {k: q for m in MODULES for k, q in m.ORACLES.items()}
