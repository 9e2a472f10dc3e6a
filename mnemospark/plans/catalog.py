"""All registered queries."""

from mnemospark.plans import queries_index, queries_rows, queries_search, queries_state  # noqa: F401
from mnemospark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
