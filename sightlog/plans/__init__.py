"""Registered queries, grouped by the data they work on."""

from importlib import import_module

from sightlog.plans import registry

GROUPS = ["boxes", "evaluate", "sessions", "scoring", "replay", "pages", "audit", "cluster", "sinks", "streams"]


def _load() -> None:
    for group in GROUPS:
        import_module(f"sightlog.plans.{group}_queries")


def all_queries():
    _load()
    return dict(registry.QUERIES)


def reference_sql():
    _load()
    return dict(registry.ORACLES)
