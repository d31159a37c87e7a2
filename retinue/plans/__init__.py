"""Queries over the given tables, one per operator."""


def all_queries():
    """(name -> plan, name -> oracle SQL) of every registered query."""
    from retinue.plans import cells, graphs, logs, pictures, retrieval, streams, texts  # noqa: F401
    from retinue.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
