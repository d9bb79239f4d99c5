"""Registered queries with their SQL counterparts."""

from importlib import import_module

MODULES = ("scoring", "rollups", "series", "evaluation", "spatial", "tables", "streams", "jobs")


def load_all() -> None:
    """Import every query module once; importing registers its queries."""
    for name in MODULES:
        import_module(f"slopewatch.catalog.{name}")
