"""Named queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import ORACLES, QUERIES
from . import checks, commits, relations, scans, summaries, texts, writes  # noqa: F401


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["flagship"](spark, folder)


__all__ = ["ORACLES", "QUERIES", "flagship"]
