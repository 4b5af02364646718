"""Queries over the given tables."""

from importlib import import_module

AREAS = ("pit", "contract", "model", "ledger", "attribution", "loan", "quality", "source")


def load_all():
    """Every registered query by name."""
    from vintagekit.plans.registry import QUERIES

    import_module("vintagekit.plans.views")
    for area in AREAS:
        import_module(f"vintagekit.plans.{area}_queries")
    return QUERIES
