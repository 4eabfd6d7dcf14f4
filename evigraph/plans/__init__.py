"""Registered queries over the star-schema tables; importing this package registers them all."""

from importlib import import_module

QUERY_MODULES = tuple(
    import_module(f"evigraph.plans.{name}")
    for name in ("graph_queries", "assembly_queries", "review_queries", "catalogue_queries", "further_queries", "promotion_queries")
)
