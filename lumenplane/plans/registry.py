"""Named queries of the engine and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "channel_stats"

from lumenplane.plans import queries as _queries  # noqa: E402,F401  fills the registry
