"""The queries of this library."""

from pagequarry.plans import formats, pages, store, structure, text
from pagequarry.plans.registry import ORACLES, QUERIES


def all_queries():
    """(queries by name, their SQL by name)."""
    return QUERIES, ORACLES
