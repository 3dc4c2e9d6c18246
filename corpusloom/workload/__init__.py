"""All registered queries."""

from importlib import import_module

MODULES = ("text_and_patterns", "classes_and_splits", "morphology", "vectors_and_results", "sources", "probes")


def load():
    from . import registry

    for module in MODULES:
        import_module(f"{__name__}.{module}")
    return registry.QUERIES, registry.ORACLES
