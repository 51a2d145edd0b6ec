"""All queries over the driver tables, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from quarryline.jobs import chunk_queries, generation_job, generation_queries, retrieval_queries  # noqa: F401  they register their queries
from quarryline.jobs.tables import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
