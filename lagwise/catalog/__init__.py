"""All registered queries."""

from importlib import import_module

from lagwise.catalog.registry import ORACLES, QUERIES

_MODULES = ("clean", "ingest", "reconcile", "windows", "recurrences", "scoring", "models", "dataset")


def _load() -> None:
    for name in _MODULES:
        import_module(f"lagwise.catalog.{name}")


def queries():
    _load()
    return dict(QUERIES)


def oracles():
    _load()
    return dict(ORACLES)
