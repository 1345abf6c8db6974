"""Every query of the library by name, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["relational", "evaluation", "learning", "study", "intake", "summaries", "modelling", "explanations", "resumable", "tuning"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        out |= import_module(f"gneiss.plans.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= import_module(f"gneiss.plans.{name}").ORACLES
    return out
