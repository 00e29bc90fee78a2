"""All queries of the subpackage, by name."""

from catalens.llm import (  # noqa: F401
    query_chats,
    query_dedup,
    query_models,
    query_runs,
    query_scans,
    query_search,
    query_tokens,
)
from catalens.llm.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
