"""The test tables as series and signals, and the SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.signal import micros
from ..operators.series import viewport

#: SQL for `series_by`: s (series, us, event_id, value).
S_TYPE = "s AS (SELECT event_type AS series, epoch_us(ts) AS us, event_id, value FROM events)"
S_USER = "s AS (SELECT CAST(user_id AS VARCHAR) AS series, epoch_us(ts) AS us, event_id, value FROM events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series_by(spark: SparkSession, sf_dir: str, column: str, window: tuple[int, int] | None = None) -> DataFrame:
    """series, us, event_id, value: the events as one series for each value of the column; those in the window (from, to] only, if there is one."""
    rows = table(spark, sf_dir, "events")
    rows = rows if window is None else viewport(rows, *window, us="ts")
    return rows.select(F.col(column).cast("string").alias("series"), micros(F.col("ts")).alias("us"), "event_id", "value")


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """The columns to so many places, without a negative zero."""
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})
