"""All registered queries and oracles of the core library."""

from tidemark.plans import commercial, identities, intake, messages, ordered, paged, relevance, rescored, scored, streamed, versioned, widened, workflow  # noqa: F401  register their queries
from tidemark.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
