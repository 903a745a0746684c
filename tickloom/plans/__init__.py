"""Registered queries over the test tables."""

from importlib import import_module

MODULES = ["bars", "digests", "filters", "features", "books", "ingest", "matrices", "streams"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"tickloom.plans.{name}")
