"""The registered queries and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import bands, duplicates, evaluation, poses, quality, series, streams

_PLANS = (bands, evaluation, series, poses, quality, duplicates, streams)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}
