"""Registered queries over the provided tables, each with its DuckDB statement where one exists."""

from importlib import import_module

MODULES = [
    "compare_queries",
    "metric_queries",
    "mining_queries",
    "rollout_queries",
    "batch_queries",
    "catalog_queries",
    "prep_queries",
]


def load_all() -> None:
    for name in MODULES:
        import_module(f"sqltally.plans.{name}")
