"""All queries of the signal operators with their SQL, gathered from the modules of tarnwave.plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "b10_phase_ensemble"
MODULES: tuple[str, ...] = ("core", "stats", "clock", "more", "sweeps", "files")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from importlib import import_module

    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        found |= import_module(f"tarnwave.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    from importlib import import_module

    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f"tarnwave.plans.{name}").ORACLES
    return found
