"""All queries outside the ``llm`` subpackage, by name, with their SQL."""

from __future__ import annotations

from spillway.plans import alerts, detection, evaluation, fields, models, statistics, traffic  # noqa: F401 - add their queries
from spillway.plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "w5_incident_sessions"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
