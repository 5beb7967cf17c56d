"""Registered queries over the test tables, with their SQL equivalents."""

from importlib import import_module

from workload.registry import ORACLES, QUERIES

MODULES = ("expressions", "storage", "joins_aggregates", "series_queries", "alerting", "learning", "streams")
for _module in MODULES:
    import_module(f"workload.{_module}")

__all__ = ["ORACLES", "QUERIES"]
