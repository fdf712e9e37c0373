"""All queries of the media library by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from mediaweave.plans import queries_browse, queries_clusters, queries_ingest, queries_vectors

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
for _module in (queries_clusters, queries_browse, queries_vectors, queries_ingest):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
