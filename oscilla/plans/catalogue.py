"""All registered queries of the signal operators and their SQL."""

from __future__ import annotations

from . import container_queries, epoch_queries, marker_queries, signal_queries, stream_queries

QUERIES = signal_queries.QUERIES | marker_queries.QUERIES | epoch_queries.QUERIES | stream_queries.QUERIES | container_queries.QUERIES
ORACLE = signal_queries.ORACLE | marker_queries.ORACLE | epoch_queries.ORACLE | stream_queries.ORACLE | container_queries.ORACLE
