"""Queries over the given tables, one per operator, with their oracle SQL."""

import importlib

MODULES = (
    "flow_queries", "feature_queries", "split_queries", "graph_queries",
    "parameter_queries", "metric_queries", "balance_queries", "window_queries",
    "run_queries", "storage_queries",
)


def registry():
    """Name to ``(callable, sql)``; sql is None where SQL cannot say it."""
    found = {}
    for module in MODULES:
        for name, pair in importlib.import_module(f"{__name__}.{module}").QUERIES.items():
            if name in found:
                raise ValueError(f"Duplicate query name {name}.")
            found[name] = pair
    return found
