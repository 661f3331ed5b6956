"""All queries of the transcript, retake and corpus operators, with the SQL that should give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("intervals", "text", "files", "records", "matching", "reports", "layout", "composed", "prosody", "rules", "script", "counts", "health")


def _all(name: str) -> dict:
    found: dict = {}
    for m in MODULES:
        for key, value in getattr(importlib.import_module(f"takeweave.queries.{m}"), name).items():
            if key in found:
                raise ValueError(f"query {key} is registered twice")
            found[key] = value
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("QUERIES")


def oracles() -> dict[str, str]:
    return _all("ORACLES")
