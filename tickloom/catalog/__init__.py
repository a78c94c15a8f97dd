"""Registered queries, each with equivalent SQL where SQL can express it."""

from tickloom.catalog.registry import REGISTRY


def load() -> dict:
    """Import every query module and return the registry."""
    from tickloom.catalog import features, operations, performance, quality, signals, sources, statistics, streams  # noqa: F401

    return REGISTRY
