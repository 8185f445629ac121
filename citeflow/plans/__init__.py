"""Registered queries (one per inventory operator) and their test-table bindings."""

from citeflow.plans import catalog


def load_all():
    """Import every query module so the registry is complete."""
    import importlib
    for m in ("q_works", "q_timeline", "q_graph", "q_ml", "q_sources"):
        try:
            importlib.import_module(f"citeflow.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"citeflow.plans.{m}":
                raise
    return catalog.QUERIES, catalog.ORACLE
