"""All registered queries; each module adds its own."""

from storyweft.plans import aggregates, forecasts, graphs, ingest, joins, linking, more, reports, series, surfaces, texts, vectors  # noqa: F401
from storyweft.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
