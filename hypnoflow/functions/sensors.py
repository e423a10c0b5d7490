"""What each kind of sensor puts out: the signals that a recording declares for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNORE_RATE = 500.0
IMU_RATES = (1.0, 2.0, 5.0, 10.0)
#: By sensor and mode, the label (after the sensor's name, where it has one), unit and physical range.
SIGNALS = {
    ("heart", ""): [("HR", "bpm", 0.0, 240.0), ("HRV", "ms", 0.0, 500.0)],
    ("temperature", ""): [("", "degC", -50.0, 150.0)],
    ("snore", ""): [("Snore", "", -1.0, 1.0)],
    ("motion", "movement"): [("", "g", 0.0, 16.0)],
    ("motion", "position"): [("Roll", "deg", -180.0, 180.0), ("Incl", "deg", 0.0, 90.0)],
    ("motion", "raw"): [(f"{kind} {axis}", unit, -most, most) for kind, unit, most in (("Accel", "g", 16.0), ("Gyro", "deg/s", 2000.0), ("Angle", "deg", 180.0)) for axis in "XYZ"],
}
SCHEMA = "driver string, mode string, signal_order int, label string, physical_dimension string, physical_min double, physical_max double, samples_per_record int"


def signals_of(spark: SparkSession, driver: str, mode: str = "", name: str = "", rate: float | None = None, record_seconds: float = 30.0) -> DataFrame:
    """The signals of one configured sensor. Heart and temperature give a sample a second, snoring SNORE_RATE."""
    if (driver, mode) not in SIGNALS:
        raise ValueError(f"no sensor {driver} with mode {mode!r}")
    if driver == "motion" and rate not in IMU_RATES:
        raise ValueError(f"a motion sensor runs at one of {IMU_RATES}")
    rate = {"motion": rate, "snore": SNORE_RATE}.get(driver, 1.0)
    named = driver in ("motion", "temperature")
    rows = [(driver, mode, i, f"{name} {label}".strip() if named else label, unit, low, high, int(rate * record_seconds)) for i, (label, unit, low, high) in enumerate(SIGNALS[driver, mode])]
    return spark.createDataFrame(rows, SCHEMA)


def signals_for(devices: DataFrame, record_seconds: float = 30.0) -> DataFrame:
    """The signals of each configured device (device_id, driver, mode, name, rate), as a table of devices says.

    Devices of an unknown kind or mode, and motion sensors whose rate is none of IMU_RATES, have no signals. A missing mode is "".
    """
    rows = [(driver, mode, i, *x) for (driver, mode), kinds in SIGNALS.items() for i, x in enumerate(kinds)]
    known = devices.sparkSession.createDataFrame(rows, "driver string, mode string, signal_order int, label string, physical_dimension string, physical_min double, physical_max double")
    own = devices.select("device_id", "driver", F.coalesce("mode", F.lit("")).alias("mode"), F.coalesce("name", F.lit("")).alias("name"), F.col("rate").cast("double").alias("rate"))
    own = own.where((F.col("driver") != "motion") | F.col("rate").isin(*IMU_RATES))
    label = F.when(F.col("driver").isin("motion", "temperature"), F.trim(F.concat_ws(" ", "name", "label"))).otherwise(F.col("label"))
    rate = F.when(F.col("driver") == "motion", F.col("rate")).when(F.col("driver") == "snore", SNORE_RATE).otherwise(1.0)
    both = own.join(F.broadcast(known), ["driver", "mode"])
    return both.select("device_id", "driver", "mode", "signal_order", label.alias("label"), "physical_dimension", "physical_min", "physical_max", F.floor(rate * record_seconds).cast("int").alias("samples_per_record"))
