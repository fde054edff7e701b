"""All registered queries."""

from __future__ import annotations

from . import queries_core, queries_flow, queries_sessions, queries_stores, queries_streams, queries_text

QUERIES = {**queries_core.QUERIES, **queries_text.QUERIES, **queries_sessions.QUERIES, **queries_flow.QUERIES, **queries_streams.QUERIES,
           **queries_stores.QUERIES}
