"""All registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

from . import document_queries, geometry_queries, layout_queries, other_queries, table_queries, tagged_queries
from .base import Query

_PARTS = [layout_queries.REGISTRY, table_queries.REGISTRY, document_queries.REGISTRY, other_queries.REGISTRY, tagged_queries.REGISTRY, geometry_queries.REGISTRY]
QUERIES: dict[str, Query] = {n: q for p in _PARTS for n, q in p.queries.items()}
SQL: dict[str, str] = {n: s for p in _PARTS for n, s in p.sql.items()}
