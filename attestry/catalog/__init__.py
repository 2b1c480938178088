"""Every registered query, grouped by family."""

from . import aggregates, columns, incident_queries, jobs, joins, loading, reading, streams
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "columns", "incident_queries", "jobs", "joins", "loading", "reading", "streams"]
