"""All queries of the engine and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tempora.plans import files, leaderboard, navigation, programs, records, replies, retrieval, sampling, segments, selection, services, statistics, streams, text

_MODULES = (retrieval, sampling, statistics, leaderboard, segments, selection, text, streams, programs, records, replies, navigation, files, services)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in _MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _MODULES:
        found |= module.ORACLE
    return found
