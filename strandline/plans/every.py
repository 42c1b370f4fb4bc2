"""All registered queries and their SQL, whatever module registers them."""

from __future__ import annotations

from . import catalog, composites, evaluation, features, files, studies

MODULES = (catalog, features, evaluation, studies, files, composites)
queries, oracle_sql = catalog.queries, catalog.oracle_sql
