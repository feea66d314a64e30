"""Bindings of the operators to the given tables, each with its check SQL."""
from importlib import import_module

FAMILIES = ("pages", "filters", "listings", "intervals", "joins", "aggregates", "merges", "scalars", "messages", "lint", "ingest")


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")
