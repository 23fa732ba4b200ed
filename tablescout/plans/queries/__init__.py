"""Every operator as a named query over the given tables, with the SQL that must give the same rows."""

from tablescout.plans.queries import (
    analytics, cleaning, contracts, forecasting, incremental, kpis, lifecycle, profiles, ranking, relations, semantics, similarity, sources,
    text,
)

_MODULES = (sources, cleaning, semantics, relations, profiles, kpis, ranking, lifecycle, analytics, forecasting, similarity, text, contracts, incremental)

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
