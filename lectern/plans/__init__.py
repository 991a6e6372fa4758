"""Composed retrieval and assessment plans, and the registered queries."""
