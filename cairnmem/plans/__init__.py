"""Registered queries and the SQL that checks them."""

from cairnmem.plans import claims_queries, cognition_queries, lifecycle_queries, recall_queries, state_queries  # noqa: F401
from cairnmem.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
