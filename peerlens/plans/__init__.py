"""Whole jobs built from the operators, and the queries over the synthetic tables."""


def load_queries():
    """Import every query module and return the registry."""
    from . import contact_queries, match_queries, people_queries, upkeep_queries, work_queries  # noqa: F401
    from .registry import QUERIES

    return QUERIES
