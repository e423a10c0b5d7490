"""Queries on recordings in files and on streams. The streams read the events as files and run until all are read."""

from __future__ import annotations

import atexit
import posixpath
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import design
from ..functions.sensors import signals_for
from ..functions.signal import physical_to_digital, recording_name
from ..operators import filters, resample, series
from ..sources import edf
from ..streaming import live
from .filtering import N_USER, NOTCH, SQL as FILTERING_SQL, SRC, step_sql
from .tables import S_TYPE, S_USER, rounded, series_by, table
from .timeline import HOUR, SPAN, SQL as TIMELINE_SQL, beats

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; on one machine, where that is unset, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return posixpath.join(folder, uuid.uuid4().hex)


#: How late rows may come in the streams below, and in how many pieces they come.
LATE_US, PIECES = 10 * 24 * HOUR, 2
LATE = f"{LATE_US // 1_000_000} seconds"


def in_pieces(rows: DataFrame, end_us: int, key: str = "series", pieces: int = PIECES, late_us: int = LATE_US, delayed: bool = True) -> list[DataFrame]:
    """rows (key, us, event_id, value) with their time ts, in pieces of the whole span.

    delayed: every seventh row comes a piece late, if it is not so old then that the watermark has passed it. A last piece is one row, which has no key and moves the watermark to end_us.
    """
    spark = rows.sparkSession
    first, last = rows.agg(F.min("us"), F.max("us")).first()
    first, last = (first, last) if first is not None else (0, 0)
    length = max(-(-(last + 1 - first) // pieces), 1)
    piece = F.floor((F.col("us") - first) / length)
    allowed = F.lit(delayed) & (F.col("event_id") % 7 == 0) & (F.col("us") > first + (piece + 1) * length - late_us)
    cut = rows.withColumn("ts", F.timestamp_micros("us")).withColumn("_piece", F.least(piece + F.when(allowed, 1).otherwise(0), F.lit(pieces - 1)))
    out = [cut.where(F.col("_piece") == i).drop("_piece").repartition(4) for i in range(pieces)]
    end = spark.range(1).select(F.lit(None).cast(rows.schema[key].dataType).alias(key), F.lit(end_us + late_us).cast("bigint").alias("us"))
    end = end.withColumn("ts", F.timestamp_micros("us"))
    return [*out, end.select(*[c if c in end.columns else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in [*rows.columns, "ts"]])]


def stream_of(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """The files below a folder as a stream, four of them, which are a piece, in each micro-batch."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 4).parquet(folder)


def staged(rows: DataFrame, end_us: int, key: str = "series", **how) -> DataFrame:
    """rows (key, us, event_id, value) as a stream with their time ts: its pieces are written one after the other, and each is a micro-batch."""
    folder = shared_dir(rows.sparkSession)
    pieces = in_pieces(rows, end_us, key, **how)
    for piece in pieces:
        piece.write.mode("append").parquet(folder)
    return stream_of(rows.sparkSession, folder, pieces[0])


def finished(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """What the stream has written once it has read all there is."""
    folder = shared_dir(spark)
    with configured(spark, live.CONF):
        started = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
        started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@contextmanager
def configured(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@query(f"""WITH {S_TYPE}, w AS (SELECT series, us - us % {HOUR} AS a, value FROM s)
SELECT series, a AS start_us, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM w GROUP BY series, a""")
def stream_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means that a stream has closed: all of them, for time goes on after the last event."""
    rows = series_by(spark, sf_dir, "event_type")
    _, after = resample.span(rows, HOUR)
    out = finished(live.epoch_stream(staged(rows, after), "1 hour", LATE), spark).where("series IS NOT NULL")
    return rounded(out.select("series", F.unix_micros("start").alias("start_us"), "n", "mean", "low", "high"), "mean")


STREAM_LOW = design.cascade("lowpass", "butterworth", 1, 100.0, 12.0)


@query(f"WITH RECURSIVE {N_USER}, {step_sql('f1', 'n', STREAM_LOW[0])}, k AS (SELECT series, event_id, row_number() OVER (PARTITION BY series ORDER BY us, event_id) - 1 AS i FROM s) SELECT series, event_id, round(y, 6) + 0.0 AS y FROM f1 JOIN k USING (series, i)")
def stream_iir(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series_by(spark, sf_dir, "user_id")
    out = finished(live.iir_stream(staged(rows, resample.span(rows, HOUR)[1]), STREAM_LOW, LATE), spark)
    return rounded(out.where("series IS NOT NULL").select("series", "event_id", "y"), "y")


@query(TIMELINE_SQL["hrv_rolling"])
def stream_hrv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series_by(spark, sf_dir, "user_id")
    out = finished(live.hrv_stream(beats(staged(rows, resample.span(rows, HOUR)[1])), late=LATE), spark)
    return rounded(out.where("series IS NOT NULL").select("series", "event_id", "hrv"), "hrv")


#: Readings are repeated every ten minutes until they are an hour old; a task has four hours of a series, and the hour after them.
BEAT, STALE, STRETCH = 600, 3600, 4 * 3600


@query(f"""WITH {S_TYPE}, n AS (SELECT *, lead(us) OVER (PARTITION BY series ORDER BY us, event_id) AS after FROM s)
SELECT series, us, value, false AS repeated FROM s
UNION ALL SELECT series, us + i * {BEAT}000000, value, true FROM n, (SELECT unnest(range(1, {STALE // BEAT} + 1)) AS i) WHERE after IS NULL OR us + i * {BEAT}000000 < after""")
def stream_keepalive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings and their repeats by the readings' own times; time goes on after a series' last reading until its stretch is over and that is stale."""
    rows = series_by(spark, sf_dir, "event_type")
    out = finished(live.keep_alive(staged(rows, resample.span(rows, HOUR)[1] + (STRETCH + STALE) * 1_000_000), STALE, BEAT, LATE, STRETCH), spark)
    return out.where("series IS NOT NULL")


@query(TIMELINE_SQL["epoch_records"])
def stream_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly records of every event type as a stream closes them: a recording for each type, with one signal."""
    rows = series_by(spark, sf_dir, "event_type")
    first, after = resample.span(rows, HOUR)
    samples = staged(rows.withColumnRenamed("series", "recording").withColumn("signal", F.lit("value")), after, "recording")
    out = finished(live.record_stream(samples, [("value", 12)], HOUR, first, LATE), spark).where("recording IS NOT NULL")
    each = out.select(F.col("recording").alias("series"), "record", F.posexplode("values").alias("k", "value"), "is_filled")
    digital = physical_to_digital(F.round("value", 6), *[F.lit(x) for x in (0.0, 500.0, -32768.0, 32767.0)])
    return each.select("series", "record", F.col("k").cast("bigint").alias("k"), digital.alias("digital"), "is_filled")


RING = 16


@query(f"""WITH {S_USER}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY us, event_id) - 1 AS n, count(*) OVER (PARTITION BY series) AS total FROM s)
SELECT series, n, us, event_id, value, n < total - {RING} AS evicted FROM r""")
def stream_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a ring buffer of every user pushes out, and what it holds in the end. Rows come in the order of time here."""
    rows = series_by(spark, sf_dir, "user_id")
    _, after = resample.span(rows, HOUR)
    out = finished(live.ring_stream(staged(rows, after, delayed=False), RING, LATE, drain_us=after), spark)
    return out.where("series IS NOT NULL")


@query(FILTERING_SQL["snore_chain"])
def stream_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound as it is recorded, live: notch, rate reduction and chunks go on from piece to piece."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("series"), F.posexplode("embedding").alias("seq", "value"))
    rows = e.select("series", ((F.col("seq").cast("bigint") + 1) * 10_000).alias("us"), F.col("seq").cast("bigint").alias("event_id"), F.col("value").cast("double").alias("value"))
    end = (rows.agg(F.max("us")).first()[0] or 0) + 1_000_000
    out = finished(live.sound_stream(staged(rows, end), SRC, NOTCH, 4, LATE, drain_us=end), spark).where("series IS NOT NULL")
    return rounded(out.select("series", "chunk", "t", "samples", F.element_at("values", -1).alias("last")), "t", "last")


@query(TIMELINE_SQL["epoch_records"].replace("CAST(greatest(-32768", "round(0.0 + (CAST(greatest(-32768", 1).replace(" AS INTEGER) AS digital, value IS NULL AS is_filled", " AS INTEGER) + 32768) * 500.0 / 65535.0, 6) + 0.0 AS value", 1).replace("SELECT d.series, d.record, d.k,", "SELECT d.series, CAST(d.record AS BIGINT) AS record, CAST(d.record * 12 + d.k AS BIGINT) AS seq,", 1))
def edf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly epochs of every event type over the whole span, written as one recording and read back."""
    path = shared_dir(spark)
    edf.write_recordings(recording(spark, sf_dir), path, 3600.0, sizes=sizes_of(spark, sf_dir))
    return rounded(edf.read_recordings(spark, path).select(F.col("label").alias("series"), "record", "seq", "value"), "value")


def sizes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `recording` holds, without making it."""
    rows = series_by(spark, sf_dir, "event_type")
    first, after = resample.span(rows, HOUR)
    records = (after - first) // HOUR
    return rows.agg((F.count_distinct("series") * records * 12).alias("samples")).select(F.lit("night").alias("recording"), F.lit(records).cast("bigint").alias("records"), "samples").where("records > 0")


def recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series_by(spark, sf_dir, "event_type")
    first, after = resample.span(rows, HOUR)
    filled = resample.epochs(rows, HOUR, 12, first, after)
    names = filled.select("series").distinct()
    # a recording's signals are a few thousand at most: four digits in its header
    index = names.select("series", (F.row_number().over(Window.orderBy("series")) - 1).alias("signal_index"))
    rows = filled.join(index, "series")
    return rows.select(F.lit("night").alias("recording"), "signal_index", F.col("series").alias("label"), "record", "k", F.round("value", 6).alias("value"), F.lit(0.0).alias("physical_min"), F.lit(500.0).alias("physical_max"), F.lit(first).alias("start_us"))


@query(f"""WITH {S_TYPE}, l AS (SELECT series AS label, row_number() OVER (ORDER BY series) - 1 AS i FROM (SELECT DISTINCT series FROM s))
SELECT CAST(i AS INTEGER) AS signal_index, label, CAST(0 AS DOUBLE) AS physical_min, CAST(500 AS DOUBLE) AS physical_max, 12 AS samples_per_record, CAST(24 * i AS BIGINT) AS byte_offset FROM l
UNION ALL SELECT CAST(count(*) AS INTEGER), 'EDF Annotations', CAST(-1 AS DOUBLE), CAST(1 AS DOUBLE), 64, CAST(24 * count(*) AS BIGINT) FROM l""")
def edf_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    edf.write_recordings(recording(spark, sf_dir), path, 3600.0, sizes=sizes_of(spark, sf_dir))
    return edf.read_recordings(spark, path, "signals").select("signal_index", "label", "physical_min", "physical_max", "samples_per_record", "byte_offset")


#: Beds that are recorded at once.
BEDS = 4
BED_SQL = TIMELINE_SQL["epoch_records"].replace(S_TYPE, f"s AS (SELECT 'bed' || user_id % {BEDS} || '/' || event_type AS series, epoch_us(ts) AS us, event_id, value FROM events)", 1)
BED_SQL = BED_SQL.replace("CAST(greatest(-32768", "round(0.0 + (CAST(greatest(-32768", 1).replace(" AS INTEGER) AS digital, value IS NULL AS is_filled", " AS INTEGER) + 32768) * 500.0 / 65535.0, 6) + 0.0 AS value", 1)
BED_SQL = BED_SQL.replace("SELECT d.series, d.record, d.k,", "SELECT split_part(d.series, '/', 1) AS recording, split_part(d.series, '/', 2) AS label, CAST(d.record AS BIGINT) AS record, CAST(d.record * 12 + d.k AS BIGINT) AS seq,", 1)


class Beds:
    """The events of each bed as a recording with a signal for every event type, in pieces, recorded as they come."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.base = spark, shared_dir(spark)
        events = series_by(spark, sf_dir, "event_type")
        users = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("bed"), (F.col("user_id") % BEDS).cast("string")).alias("recording"))
        rows = events.join(users, "event_id").select("recording", F.col("series").alias("signal"), "us", "event_id", "value")
        self.first, after = resample.span(events, HOUR)
        # what a recorder records is configured: a few signals
        self.labels = sorted(r.series for r in events.select("series").distinct().collect())
        self.pieces = in_pieces(rows, after, "recording")
        self.path = f"{self.base}/recordings"

    def come(self, piece: DataFrame) -> None:
        piece.write.mode("append").parquet(f"{self.base}/events")

    def record(self) -> None:
        """Records what has come since it was called before."""
        records = live.record_stream(stream_of(self.spark, f"{self.base}/events", self.pieces[0]), [(label, 12) for label in self.labels], HOUR, self.first, LATE)
        signals = [{"label": label, "physical_min": 0.0, "physical_max": 500.0, "samples_per_record": 12} for label in self.labels]
        rounded_ = records.where("recording IS NOT NULL").withColumn("values", F.transform("values", lambda v: F.round(v, 6)))
        with configured(self.spark, live.CONF):
            edf.record_to(rounded_, self.path, f"{self.base}/recorder", signals, self.first, 3600.0).trigger(availableNow=True).start().awaitTermination()


def of_beds(samples: DataFrame) -> DataFrame:
    return rounded(samples.select(F.regexp_extract("path", "/(bed[0-9]+)-[^/]*$", 1).alias("recording"), "label", "record", "seq", "value"), "value")


@query(BED_SQL)
def edf_live_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beds recorded live, by a recorder that is stopped and started again, then stopped for good and read."""
    beds = Beds(spark, sf_dir)
    beds.come(beds.pieces[0])
    beds.record()
    for piece in beds.pieces[1:]:
        beds.come(piece)
    beds.record()
    edf.stop_recordings(spark, beds.path)
    return of_beds(edf.read_recordings(spark, beds.path))


@query(BED_SQL)
def edf_growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings read as a stream while they grow; the reader is stopped and started again as well."""
    beds = Beds(spark, sf_dir)
    out, reader = f"{beds.base}/read", f"{beds.base}/reader"
    for pieces in (beds.pieces[:1], beds.pieces[1:]):
        for piece in pieces:
            beds.come(piece)
        beds.record()
        samples = edf.stream_recordings(spark, beds.path)
        samples.writeStream.format("parquet").option("path", out).option("checkpointLocation", reader).trigger(availableNow=True).start().awaitTermination()
    return of_beds(spark.read.parquet(out))


@query(f"""WITH {S_TYPE}, {SPAN}, h AS (SELECT DISTINCT series, (us - first) // {HOUR} AS hour FROM s, b)
SELECT series, CAST(row_number() OVER (PARTITION BY series ORDER BY hour) - 1 AS BIGINT) AS record, CAST(hour * 3600 AS DOUBLE) AS start_s, CAST(first + hour * {HOUR} AS BIGINT) AS start_us FROM h, b""")
def edf_record_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording of every event type that has the hours with events only: where its records begin."""
    rows = series_by(spark, sf_dir, "event_type")
    first, after = resample.span(rows, HOUR)
    own = resample.epochs(rows, HOUR, 12, first, after, own_span=True).where("NOT is_filled")
    hours = series.numbered(own.where("k = 0").select("series", F.col("record").alias("hour")), "series", "hour").withColumnRenamed("seq", "record")
    samples = own.withColumnRenamed("record", "hour").join(hours, ["series", "hour"])
    kept = samples.select(F.col("series").alias("recording"), F.lit(0).alias("signal_index"), F.lit("value").alias("label"), "record", "k", "value", F.lit(0.0).alias("physical_min"), F.lit(500.0).alias("physical_max"), F.lit(first).alias("start_us"))
    path = shared_dir(spark)
    edf.write_recordings(kept, path, 3600.0, starts=hours.select(F.col("series").alias("recording"), "record", (F.col("hour") * 3600.0).alias("start_s")))
    return edf.read_recordings(spark, path, "records").select(F.regexp_extract("path", "/([^/-]+)-[^/]*$", 1).alias("series"), "record", "start_s", "start_us")


#: SQL of the devices: every customer's, of a kind that follows from the market segment.
DEVICES = """d AS (SELECT c_custkey AS device_id, CASE c_custkey % 6 WHEN 0 THEN 'heart' WHEN 1 THEN 'temperature' WHEN 2 THEN 'snore' ELSE 'motion' END AS driver, CASE c_custkey % 6 WHEN 3 THEN 'movement' WHEN 4 THEN 'position' WHEN 5 THEN 'raw' ELSE '' END AS mode, c_mktsegment AS name, c_nationkey % 12 AS rate FROM customer)"""


@query(f"""WITH {DEVICES}, v AS (SELECT * FROM (VALUES ('heart', '', 0, 'HR', 'bpm', CAST(0 AS DOUBLE), CAST(240 AS DOUBLE)), ('heart', '', 1, 'HRV', 'ms', 0, 500), ('temperature', '', 0, '', 'degC', -50, 150), ('snore', '', 0, 'Snore', '', -1, 1),
('motion', 'movement', 0, '', 'g', 0, 16), ('motion', 'position', 0, 'Roll', 'deg', -180, 180), ('motion', 'position', 1, 'Incl', 'deg', 0, 90),
('motion', 'raw', 0, 'Accel X', 'g', -16, 16), ('motion', 'raw', 1, 'Accel Y', 'g', -16, 16), ('motion', 'raw', 2, 'Accel Z', 'g', -16, 16),
('motion', 'raw', 3, 'Gyro X', 'deg/s', -2000, 2000), ('motion', 'raw', 4, 'Gyro Y', 'deg/s', -2000, 2000), ('motion', 'raw', 5, 'Gyro Z', 'deg/s', -2000, 2000),
('motion', 'raw', 6, 'Angle X', 'deg', -180, 180), ('motion', 'raw', 7, 'Angle Y', 'deg', -180, 180), ('motion', 'raw', 8, 'Angle Z', 'deg', -180, 180)) AS t(driver, mode, signal_order, label, physical_dimension, physical_min, physical_max))
SELECT device_id, driver, mode, signal_order, CASE WHEN driver IN ('motion', 'temperature') THEN trim(name || ' ' || label) ELSE label END AS label, physical_dimension, physical_min, physical_max,
  CAST(30 * CASE driver WHEN 'motion' THEN rate WHEN 'snore' THEN 500 ELSE 1 END AS INTEGER) AS samples_per_record FROM d JOIN v USING (driver, mode) WHERE driver <> 'motion' OR rate IN (1, 2, 5, 10)""")
def signal_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals of every customer's device."""
    kind = F.col("c_custkey") % 6
    driver = F.when(kind == 0, "heart").when(kind == 1, "temperature").when(kind == 2, "snore").otherwise("motion")
    mode = F.when(kind == 3, "movement").when(kind == 4, "position").when(kind == 5, "raw").otherwise("")
    devices = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("device_id"), driver.alias("driver"), mode.alias("mode"), F.col("c_mktsegment").alias("name"), (F.col("c_nationkey") % 12).alias("rate"))
    return signals_for(devices)


@query(f"""WITH {S_TYPE}, {SPAN}
SELECT CAST((us - first) // {HOUR} AS BIGINT) AS record, (us - first) // 1000 / 1000.0 AS onset, CASE WHEN event_id % 2 = 0 THEN CAST(2.5 AS DOUBLE) END AS duration, 'Note ' || event_id || ' ' || series AS text FROM s, b""")
def edf_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note of every event in its hour's record, written beside the signals and read back."""
    path = shared_dir(spark)
    first, _ = resample.span(series_by(spark, sf_dir, "event_type"), HOUR)
    since = F.col("us") - first
    notes = series_by(spark, sf_dir, "event_type").select(F.lit("night").alias("recording"), F.floor(since / HOUR).alias("record"), (F.floor(since / 1000) / 1000.0).alias("onset"), F.when(F.col("event_id") % 2 == 0, 2.5).alias("duration"), F.concat_ws(" ", F.lit("Note"), "event_id", "series").alias("text"))
    edf.write_recordings(recording(spark, sf_dir), path, 3600.0, notes, sizes=sizes_of(spark, sf_dir))
    return edf.read_recordings(spark, path, "annotations").select("record", "onset", "duration", "text")


@query("""SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 MINUTE * (o_orderkey % 1440), '%Y%m%d%H%M') || CASE WHEN o_custkey % 3 = 0 THEN '' ELSE '_' || replace(o_orderpriority, ' ', '_') END || '.edf' AS name FROM orders""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    device = F.when(F.col("o_custkey") % 3 != 0, F.replace("o_orderpriority", F.lit(" "), F.lit("_")))
    return table(spark, sf_dir, "orders").select("o_orderkey", recording_name(when, "edf", device).alias("name"))
