"""Imports every module that registers queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ("tables_and_filters", "joins_and_aggregates", "series_queries", "business_queries", "vector_queries", "stream_queries", "sql_queries", "source_queries")


def load() -> None:
    for name in MODULES:
        import_module(f"lakeloom.plans.{name}")
