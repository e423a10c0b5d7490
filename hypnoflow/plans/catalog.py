"""All named queries of the signal library and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codec, filtering, live, timeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = timeline.QUERIES | codec.QUERIES | filtering.QUERIES | live.QUERIES
SQL: dict[str, str] = timeline.SQL | codec.SQL | filtering.SQL | live.SQL
