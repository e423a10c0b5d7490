"""What a viewer asks of a recording: windows that follow, pan and clamp, scales, layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signal import EPOCH_MS
from .resample import lttb
from .series import monotonic, viewport

PLOT_POINTS = 4000
AUTOSCALE_POINTS = 5000


def traces(df: DataFrame, x0: int, x1: int, points: int = PLOT_POINTS, follow: bool = False) -> DataFrame:
    """series, us, value to draw for the window (x0, x1]: at most `points` a series. follow: the window's first instant goes."""
    drawn = lttb(viewport(df, x0, x1), points)
    return drawn.where(F.col("us") > x0) if follow else drawn


def follow_window(end_ms: Column, length_ms: int = EPOCH_MS) -> tuple[Column, Column]:
    """The window whose end is the next multiple of its length."""
    end = (F.ceil(end_ms / length_ms) * length_ms).cast("bigint")
    return end - length_ms, end


def followed(df: DataFrame, end_ms: str, length_ms: int = EPOCH_MS, series: str = "series", *order: str) -> DataFrame:
    """df with lo, hi: the window of a viewer that follows, after each row in order. It moves on only when an end comes that lies after its own.

    A window's end is never before the end that moved it, so the state is the latest end so far, rounded up.
    """
    latest = monotonic(df, end_ms, series, *order).withColumnRenamed("guarded_us", "_latest")
    lo, hi = follow_window(F.col("_latest"), length_ms)
    return latest.withColumn("lo", lo).withColumn("hi", hi).drop("_latest")


def clamp_range(lo: Column, hi: Column, first: Column, last: Column) -> tuple[Column, Column]:
    """Each bound moved into the recording by itself."""
    return F.greatest(first, F.least(last, lo)), F.greatest(first, F.least(last, hi))


def pan(lo: Column, hi: Column, first: Column, last: Column, direction: int) -> tuple[Column, Column]:
    """The window moved by a tenth of its width; it stays where that would leave the recording."""
    by = F.floor((hi - lo) / 10) * direction
    out = (lo + by < first) | (hi + by > last)
    return F.when(out, lo).otherwise(lo + by), F.when(out, hi).otherwise(hi + by)


def relayout(autorange: Column, lo: Column, hi: Column, start: Column, length_ms: int = EPOCH_MS) -> tuple[Column, Column]:
    """The window a plot event asks for: the first epoch on autorange or where both bounds lie before the start."""
    reset = F.coalesce(autorange, F.lit(False)) | ((lo < start) & (hi < start))
    return F.when(reset, start).otherwise(lo), F.when(reset, start + length_ms).otherwise(hi)


def layout(index: Column, n: Column) -> tuple[Column, Column]:
    """The share of the height, from below, that channel index of n takes."""
    return 1.0 - (index + 1) / n, 1.0 - index / n


def default_scaling(signals: DataFrame) -> DataFrame:
    """signals with midpoint, halfrange, y_low, y_high from the physical range."""
    mid, half = (F.col("physical_min") + F.col("physical_max")) / 2.0, (F.col("physical_max") - F.col("physical_min")) / 2.0
    return signals.withColumn("midpoint", mid).withColumn("halfrange", half).withColumn("y_low", mid - half).withColumn("y_high", mid + half)


def scaled(signals: DataFrame, scalings: DataFrame) -> DataFrame:
    """signals with the scaling kept under their label, or the default one."""
    kept = scalings.select("label", F.col("midpoint").alias("_m"), F.col("halfrange").alias("_h")).dropDuplicates(["label"])
    both = default_scaling(signals).join(kept, "label", "left")
    mid, half = F.coalesce("_m", "midpoint"), F.coalesce("_h", "halfrange")
    return both.withColumn("midpoint", mid).withColumn("halfrange", half).withColumn("y_low", F.col("midpoint") - F.col("halfrange")).withColumn("y_high", F.col("midpoint") + F.col("halfrange")).drop("_m", "_h")


def autoscale(df: DataFrame, p_min: float, p_max: float, points: int = AUTOSCALE_POINTS) -> DataFrame:
    """series, lo, hi, midpoint, halfrange, y_low, y_high from the 1st and 99th percentiles of each series' plot points."""
    # `points` values a series at most, so its percentiles come from one sorted array
    shown = lttb(df, points).groupBy("series").agg(F.array_sort(F.collect_list("value")).alias("v"))
    at = lambda p: F.col("v")[(F.greatest(F.ceil(F.lit(p) * F.size("v")), F.lit(1)) - 1).cast("int")]
    both = shown.select("series", at(0.01).alias("lo"), at(0.99).alias("hi"))
    clamped = both.select("series", *[F.greatest(F.lit(p_min), F.least(F.lit(p_max), F.col(c))).alias(c) for c in ("lo", "hi")]).where("lo < hi")
    return clamped.select("series", "lo", "hi", ((F.col("lo") + F.col("hi")) / 2.0).alias("midpoint"), (1.1 * (F.col("hi") - F.col("lo")) / 2.0).alias("halfrange"), (F.col("lo") * 0.95).alias("y_low"), (F.col("hi") * 1.05).alias("y_high"))
