"""Registered queries over the given tables, each with the SQL that checks it."""

from importlib import import_module

MODULES = [
    "measure_queries",
    "cohort_queries",
    "annotation_queries",
    "match_queries",
    "rollup_queries",
    "score_queries",
    "study_queries",
]


def load():
    """All registered queries by name."""
    for m in MODULES:
        import_module(f"chartloom.catalog.{m}")
    from chartloom.catalog.registry import QUERIES

    return QUERIES
