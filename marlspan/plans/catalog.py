"""All registered queries of the analytics operators, with their SQL."""

from __future__ import annotations

from . import company_queries, desk_queries, filing_queries, news_queries, reference_queries, series_queries, source_queries, statement_queries, stats_queries, stream_queries

_PARTS = [series_queries, stats_queries, company_queries, statement_queries, source_queries, desk_queries, reference_queries, stream_queries, filing_queries, news_queries]
QUERIES = {k: f for m in _PARTS for k, f in m.reg.queries.items()}
SQL = {k: s for m in _PARTS for k, s in m.reg.sql.items()}
