"""Imports every query module so that the registry is complete."""

from lectern.plans import (  # noqa: F401
    contract_queries, coverage_queries, evidence_queries, operator_queries, records_queries, retrieval_queries, structure_queries, text_queries,
)
from lectern.plans.registry import QUERIES, SQL  # noqa: F401
