"""Registered queries: one callable an operator, and its SQL beside it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registered() -> dict[str, tuple[Query, str | None]]:
    from . import geometry, graphs, levels, prompts, relations, shapes, topology

    found: dict[str, tuple[Query, str | None]] = {}
    for module in (prompts, relations, graphs, levels, topology, shapes, geometry):
        found |= module.QUERIES
    return found
