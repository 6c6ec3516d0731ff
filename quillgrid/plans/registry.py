"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from quillgrid.plans import (
    box_queries,
    document_queries,
    entity_queries,
    file_queries,
    pattern_queries,
    stream_queries,
    vector_queries,
)

_MODULES = (document_queries, box_queries, file_queries, entity_queries, vector_queries, pattern_queries, stream_queries)

QUERIES = {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
