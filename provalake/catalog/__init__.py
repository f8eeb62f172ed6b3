"""Named queries over the star-schema tables, with comparison SQL where the operator can be said in SQL."""

from importlib import import_module

from provalake.catalog.registry import QUERIES, SQL

for _name in ("q_sources", "q_relational", "q_text", "q_vectors", "q_insight"):
    import_module(f"provalake.catalog.{_name}")

__all__ = ["QUERIES", "SQL"]
