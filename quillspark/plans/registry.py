"""All queries of the library's operators, by name, and their SQL."""

from __future__ import annotations

from importlib import import_module

from quillspark.plans.declare import ORACLE_SQL, QUERIES

for _family in ("text", "matching", "retrieval", "dedup", "gates", "joins", "splits", "metrics", "windows", "selection", "credit", "nested", "statistics", "ingest", "ranges", "invariants", "scalars", "information", "releases", "adapters", "records", "episodes", "datasets", "summaries", "readings"):
    import_module(f"quillspark.plans.{_family}")

__all__ = ["ORACLE_SQL", "QUERIES"]
