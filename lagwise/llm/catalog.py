"""All queries of this package."""

from importlib import import_module

from lagwise.llm.registry import ORACLES, QUERIES

_MODULES = ("packing", "simhash", "exact", "decontaminate", "langid", "tokenfile", "suffixes", "quality", "html", "tokencount", "periodic", "minhash", "prefixes")


def queries():
    for name in _MODULES:
        import_module(f"lagwise.llm.{name}")
    return dict(QUERIES)


def oracles():
    queries()
    return dict(ORACLES)
