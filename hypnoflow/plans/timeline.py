"""Queries on time: windows, as-of look-ups, order statistics, buffers, resampling, epochs, beats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.signal import clamp
from ..operators import resample, series, view
from .tables import S_TYPE, S_USER, rounded, series_by, table

#: A day and an hour of the events, in epoch microseconds.
X0, X1 = 1_704_153_600_000_000, 1_704_240_000_000_000
HOUR = 3_600_000_000
#: SQL of b (first, after): the start of the first hour with events and the end of the last one.
SPAN = f"b AS (SELECT min(us) // {HOUR} * {HOUR} AS first, (max(us) // {HOUR} + 1) * {HOUR} AS after FROM s)"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"WITH {S_TYPE} SELECT series, us, value FROM s WHERE us > {X0} AND us <= {X1}")
def viewport_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_by(spark, sf_dir, "event_type", (X0, X1)).select("series", "us", "value")


@query(f"""WITH {S_TYPE}, {SPAN}, p AS (SELECT series, unnest(range(first, after + 1, {HOUR})) AS us FROM (SELECT DISTINCT series FROM s), b)
SELECT p.series, p.us, s.value, s.us AS found_us FROM p ASOF LEFT JOIN s ON p.series = s.series AND p.us >= s.us""")
def asof_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series_by(spark, sf_dir, "event_type")
    first, after = resample.span(s, HOUR)
    probes = s.select("series").distinct().select("series", F.explode(F.sequence(F.lit(first), F.lit(after), F.lit(HOUR))).alias("us"))
    return series.asof(probes, s)


@query(f"""WITH {S_USER}, e AS (SELECT series, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM s GROUP BY series)
SELECT * FROM e UNION ALL SELECT NULL, min(first_us), max(last_us), CAST(sum(n) AS BIGINT) FROM e""")
def series_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.extent(series_by(spark, sf_dir, "user_id"))


@query(f"WITH {S_TYPE} SELECT series, list_sort(list(value))[CAST(greatest(ceil(CAST(0.07 AS DOUBLE) * count(*)), 1) AS BIGINT)] AS value FROM s GROUP BY series")
def percentile_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.percentile(series_by(spark, sf_dir, "event_type"), "series", 0.07)


@query(f"WITH {S_USER} SELECT series, list_sort(list(value))[CAST(floor(CAST(0.9 AS DOUBLE) * (count(*) - 1)) + 1 AS BIGINT)] AS value FROM s GROUP BY series")
def percentile_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.percentile(series_by(spark, sf_dir, "user_id"), "series", 0.9, "lower")


@query(f"WITH {S_USER} SELECT series, value FROM (SELECT series, value, row_number() OVER (PARTITION BY series ORDER BY value) AS r FROM s) WHERE r = 11")
def kth_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.kth_smallest(series_by(spark, sf_dir, "user_id"), "series", 10)


@query(f"WITH {S_USER} SELECT series, us, value FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY us DESC, event_id DESC) AS r FROM s) WHERE r <= 16")
def ring_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.last_n(series_by(spark, sf_dir, "user_id"), 16).select("series", "us", "value")


@query(f"""WITH {S_TYPE}, g AS (SELECT series, (min(us) // {HOUR // 4} + 1) * {HOUR // 4} AS a, max(us) // {HOUR // 4} * {HOUR // 4} AS b FROM s GROUP BY series),
p AS (SELECT series, unnest(range(a, b + 1, {HOUR // 4})) AS us FROM g)
SELECT p.series, p.us, s.value, p.us - s.us AS age_us FROM p ASOF JOIN s ON p.series = s.series AND p.us >= s.us WHERE p.us - s.us <= {HOUR // 2}""")
def ffill_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.carried(series_by(spark, sf_dir, "event_type"), HOUR // 4, HOUR // 2)


@query(f"""WITH {S_USER}, j AS (SELECT *, us - CAST(value * 60000000 AS BIGINT) AS late FROM s)
SELECT series, event_id, late, max(late) OVER (PARTITION BY series ORDER BY us, event_id) AS guarded_us FROM j""")
def monotonic_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    jittered = series_by(spark, sf_dir, "user_id").withColumn("late", F.col("us") - F.round(F.col("value") * 60_000_000).cast("bigint"))
    return series.monotonic(jittered, "late").select("series", "event_id", "late", "guarded_us")


@query(f"""WITH {S_USER}, d AS (SELECT series, value - lag(value) OVER (PARTITION BY series ORDER BY us, event_id) AS d FROM s)
SELECT series, round(sqrt(avg(d * d)), 6) + 0.0 AS rmssd FROM d GROUP BY series""")
def rmssd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.rmssd(series_by(spark, sf_dir, "user_id")), "rmssd")


@query("""WITH f AS (SELECT CAST(vec_id % 20 AS VARCHAR) AS series, vec_id * 64 // 20 AS first_frame, 1000000 + vec_id * 3 AS arrived_us, embedding AS x FROM embeddings WHERE embedding IS NOT NULL),
g AS (SELECT *, first_value(arrived_us) OVER w + CAST(round((first_frame - first_value(first_frame) OVER w) * 2000.0) AS BIGINT) AS s FROM f WINDOW w AS (PARTITION BY series ORDER BY first_frame)),
h AS (SELECT *, max(s) OVER (PARTITION BY series ORDER BY first_frame) AS m FROM g), u AS (SELECT series, first_frame, m, unnest(range(0, len(x))) AS i, unnest(x) AS value FROM h)
SELECT series, first_frame + i AS frame, m + i * 2000 AS us, value FROM u""")
def audio_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "embeddings").where("embedding is not null").select((F.col("vec_id") % 20).cast("string").alias("series"), F.floor(F.col("vec_id") * 64 / 20).alias("first_frame"), (F.col("vec_id") * 3 + 1_000_000).alias("arrived_us"), F.col("embedding").alias("samples"))
    return series.audio_clock(chunks, 500.0)


#: Beats of 0.5 to 1.3 s from the events' values; every seventh row has none, every fifth two.
BEAT = "round(0.5 + value % 100 / 125.0, 3)"


@query(f"""WITH RECURSIVE {S_USER}, m AS (SELECT series, us, event_id, CASE WHEN event_id % 7 = 0 THEN [] WHEN event_id % 5 = 0 THEN [{BEAT}, {BEAT} + 0.125] ELSE [{BEAT}] END AS x,
  row_number() OVER (PARTITION BY series ORDER BY us, event_id) AS r FROM s),
b AS (SELECT series, r, i, CAST(floor(x[i] * 1000 + 0.5) AS INTEGER) AS ms FROM (SELECT series, r, x, unnest(range(1, len(x) + 1)) AS i FROM m)),
o AS (SELECT series, r, ms, row_number() OVER (PARTITION BY series ORDER BY r, i) AS n FROM b),
f AS (SELECT series, n, r, CASE WHEN ms BETWEEN 300 AND 2000 THEN [ms] ELSE CAST([] AS INTEGER[]) END AS kept FROM o WHERE n = 1
  UNION ALL SELECT o.series, o.n, o.r, CASE WHEN o.ms BETWEEN 300 AND 2000 AND (len(f.kept) = 0 OR abs(o.ms - f.kept[-1]) <= 250) THEN list_append(f.kept, o.ms)[greatest(len(f.kept) + 2 - 30, 1):] ELSE f.kept END
  FROM f JOIN o ON o.series = f.series AND o.n = f.n + 1),
l AS (SELECT series, r, arg_max(kept, n) AS kept FROM f GROUP BY series, r)
SELECT m.series, m.event_id, round(CASE WHEN len(l.kept) >= 2 THEN sqrt(list_avg(list_transform(range(2, len(l.kept) + 1), lambda i: (l.kept[i] - l.kept[i - 1]) * (l.kept[i] - l.kept[i - 1])))) END, 6) + 0.0 AS hrv
FROM m ASOF LEFT JOIN l ON m.series = l.series AND m.r >= l.r""")
def hrv_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.heart_rate_variability(beats(series_by(spark, sf_dir, "user_id"))).drop("us"), "hrv")


def beats(s: DataFrame) -> DataFrame:
    beat = F.round(F.lit(0.5) + F.col("value") % 100 / 125.0, 3)
    return s.withColumn("intervals", F.when(F.col("event_id") % 7 == 0, F.array().cast("array<double>")).when(F.col("event_id") % 5 == 0, F.array(beat, beat + 0.125)).otherwise(F.array(beat)))


def linear_sql(source: str, n: int, key: str) -> str:
    """SQL of a linear resampling of source (key, ms, event_id, value) to n points each: key, k, ms, value."""
    return f"""w AS (SELECT {key}, ms, value, lead(ms) OVER p AS t2, lead(value) OVER p AS v2, row_number() OVER p - 1 AS i, count(*) OVER q AS n, min(ms) OVER q AS t0, max(ms) OVER q AS t1
  FROM {source} WINDOW p AS (PARTITION BY {key} ORDER BY ms, event_id), q AS (PARTITION BY {key})),
st AS (SELECT *, (t1 - t0) / {float(n - 1)} AS step FROM w),
r AS (SELECT {key}, i AS k, ms, value FROM st WHERE n = {n}
  UNION ALL SELECT {key}, unnest(range(0, {n})), ms, value FROM st WHERE n <> {n} AND t1 = t0 AND i = 0
  UNION ALL SELECT {key}, 0, ms, value FROM st WHERE n <> {n} AND t1 > t0 AND i = 0
  UNION ALL SELECT {key}, {n - 1}, ms, value FROM st WHERE n <> {n} AND t1 > t0 AND i = n - 1
  UNION ALL SELECT {key}, k, floor(t0 + k * step), value + (v2 - value) * (t0 + k * step - ms) / (t2 - ms) FROM
    (SELECT *, unnest(range(CAST(floor((ms - t0) / step) + 1 AS BIGINT), CAST(least(floor((t2 - t0) / step), {n - 2}) + 1 AS BIGINT))) AS k FROM st WHERE n <> {n} AND t1 > t0 AND t2 IS NOT NULL))"""


@query(f"""WITH {S_USER}, m AS (SELECT series, us / 1000.0 AS ms, event_id, value FROM s), {linear_sql('m', 40, 'series')}
SELECT series, CAST(k AS BIGINT) AS k, round(ms, 3) AS ms, round(value, 6) + 0.0 AS value FROM r""")
def linear_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series_by(spark, sf_dir, "user_id").withColumn("ms", F.col("us") / 1000.0)
    return rounded(rounded(resample.linear(s, 40), "value"), "ms", places=3)


@query(f"""WITH {S_TYPE}, m AS (SELECT min(us) AS first, max(us) AS last FROM s), w AS (SELECT series, (us - first) // {HOUR} AS record, value, (last - first) // {HOUR} AS records FROM s, m)
SELECT series, record, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM w WHERE record < records GROUP BY series, record""")
def stopped_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording from the first event to the last: the epoch in which it is stopped is left out."""
    rows = series_by(spark, sf_dir, "event_type")
    first, last = rows.agg(F.min("us"), F.max("us")).first()
    kept = resample.whole_epochs(rows, HOUR, first, last)
    return rounded(kept.groupBy("series", "record").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total")


@query(f"""WITH {S_TYPE}, {SPAN}, e AS (SELECT {{'s': series, 'r': (us - first) // {HOUR}}} AS g, us / 1000.0 AS ms, event_id, value FROM s, b), {linear_sql('e', 12, 'g')},
d AS (SELECT series, record, k FROM (SELECT DISTINCT series FROM s), (SELECT unnest(range(0, (after - first) // {HOUR})) AS record FROM b), (SELECT unnest(range(0, 12)) AS k))
SELECT d.series, d.record, d.k, CAST(greatest(-32768, least(32767, floor((coalesce(round(value, 6), 0.0) - 0.0) * 65535.0 / 500.0 - 32768.0 + 0.5))) AS INTEGER) AS digital, value IS NULL AS is_filled
FROM d LEFT JOIN r ON d.series = r.g.s AND d.record = r.g.r AND d.k = r.k""")
def epoch_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.signal import physical_to_digital

    filled = resample.epochs(series_by(spark, sf_dir, "event_type"), HOUR, 12)
    digital = physical_to_digital(F.round("value", 6), *[F.lit(x) for x in (0.0, 500.0, -32768.0, 32767.0)])
    return filled.select("series", "record", "k", digital.alias("digital"), "is_filled")


LTTB_N = 12


def lttb_sql(source: str, n: int) -> str:
    """SQL of a point reduction of source (series, us, value) to n points, bucket after bucket."""
    return f"""o AS (SELECT series, CAST(us AS DOUBLE) AS t, us, value AS v, row_number() OVER (PARTITION BY series ORDER BY us, value) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM {source}),
b AS (SELECT *, CASE WHEN i = 0 THEN 0 WHEN i = n - 1 THEN {n - 1} ELSE NULL END AS b0, (n - 2) / {float(n - 2)} AS w FROM o WHERE n > {n}),
g AS (SELECT series, us, t, v, i, n, j FROM (SELECT *, unnest(range(0, {n - 2})) AS j FROM b) WHERE i >= floor(j * w) + 1 AND i < floor((j + 1) * w) + 1),
h AS (SELECT series, j - 1 AS j, avg(t) AS mt, avg(v) AS mv FROM (SELECT series, j, t, v FROM g UNION ALL SELECT series, {n - 2}, t, v FROM (SELECT *, floor({n - 2} * w) + 1 AS lo FROM b) WHERE i >= lo) GROUP BY ALL),
c AS (SELECT g.series, g.j, mt, mv, list({{'i': i, 'us': us, 't': t, 'v': v}} ORDER BY i) AS ps FROM g JOIN h USING (series, j) GROUP BY ALL),
k AS (SELECT series, -1 AS j, {{'i': i, 'us': us, 't': t, 'v': v}} AS p FROM b WHERE i = 0
  UNION ALL SELECT series, j, list_reduce(list_transform(ps, lambda x: {{'x': x, 'area': abs((a.t - mt) * (x.v - a.v) - (a.t - x.t) * (mv - a.v))}}), lambda u, y: CASE WHEN y.area > u.area THEN y ELSE u END).x
  FROM (SELECT c.series, c.j, c.ps, c.mt, c.mv, k.p AS a FROM k JOIN c ON c.series = k.series AND c.j = k.j + 1)),
l AS (SELECT series, p.us AS us, p.v AS value FROM k UNION ALL SELECT series, us, v FROM b WHERE i = n - 1 UNION ALL SELECT series, us, v FROM o WHERE n <= {n})"""


@query(f"WITH RECURSIVE {S_USER}, {lttb_sql('s', LTTB_N)} SELECT series, us, value FROM l")
def lttb_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.lttb(series_by(spark, sf_dir, "user_id"), LTTB_N)


@query(f"WITH RECURSIVE {S_TYPE}, v AS (SELECT * FROM s WHERE us > {X0} AND us <= {X0 + 216 * HOUR}), {lttb_sql('v', 50)} SELECT series, us, value FROM l")
def viewport_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.traces(series_by(spark, sf_dir, "event_type", (X0, X0 + 216 * HOUR)), X0, X0 + 216 * HOUR, points=50)


@query(f"""WITH RECURSIVE {S_USER}, {lttb_sql('s', 24)}, q AS (SELECT series, list_sort(list(value)) AS x, count(*) AS n FROM l GROUP BY series),
p AS (SELECT series, greatest(0.0, least(400.0, x[CAST(greatest(ceil(CAST(0.01 AS DOUBLE) * n), 1) AS BIGINT)])) AS lo, greatest(0.0, least(400.0, x[CAST(greatest(ceil(CAST(0.99 AS DOUBLE) * n), 1) AS BIGINT)])) AS hi FROM q)
SELECT series, lo, hi, round((lo + hi) / 2, 6) AS midpoint, round(1.1 * (hi - lo) / 2, 6) AS halfrange, round(lo * 0.95, 6) AS y_low, round(hi * 1.05, 6) AS y_high FROM p WHERE lo < hi""")
def autoscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(view.autoscale(series_by(spark, sf_dir, "user_id"), 0.0, 400.0, points=24), "midpoint", "halfrange", "y_low", "y_high")


@query("""WITH o AS (SELECT o_orderkey, epoch_ms(o_orderdate) + o_orderkey * 7919 AS t FROM orders)
SELECT o_orderkey, CAST(ceil(t / 30000.0) * 30000 AS BIGINT) - 30000 AS lo, CAST(ceil(t / 30000.0) * 30000 AS BIGINT) AS hi FROM o""")
def follow_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.signal import micros

    t = F.floor(micros(F.col("o_orderdate")) / 1000) + F.col("o_orderkey") * 7919
    lo, hi = view.follow_window(t)
    return table(spark, sf_dir, "orders").select("o_orderkey", lo.alias("lo"), hi.alias("hi"))


@query(f"""WITH {S_USER}, e AS (SELECT *, us // 1000 - CAST(value * 60000 AS BIGINT) AS end_ms FROM s), l AS (SELECT *, max(end_ms) OVER (PARTITION BY series ORDER BY us, event_id) AS latest FROM e)
SELECT series, event_id, CAST(ceil(latest / 30000.0) * 30000 AS BIGINT) - 30000 AS lo, CAST(ceil(latest / 30000.0) * 30000 AS BIGINT) AS hi FROM l""")
def followed_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A viewer of each user that follows ends which go back now and then."""
    ends = series_by(spark, sf_dir, "user_id").withColumn("end_ms", F.floor(F.col("us") / 1000) - F.round(F.col("value") * 60_000).cast("bigint"))
    return view.followed(ends, "end_ms").select("series", "event_id", "lo", "hi")


#: Events of the same type within ten minutes after one that was let through are not.
THROTTLE = HOUR // 6


@query(f"""WITH RECURSIVE {S_TYPE}, f AS (SELECT series, min(us) AS us FROM s GROUP BY series UNION ALL SELECT f.series, (SELECT min(s.us) FROM s WHERE s.series = f.series AND s.us >= f.us + {THROTTLE}) AS us FROM f WHERE us IS NOT NULL)
SELECT series, us, min(event_id) AS event_id FROM f JOIN s USING (series, us) GROUP BY series, us""")
def throttled_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.throttled(series_by(spark, sf_dir, "event_type"), THROTTLE).select("series", "us", "event_id")


@query("""WITH o AS (SELECT o_orderkey, o_custkey * 10 AS lo, o_custkey * 10 + 300 AS hi FROM orders)
SELECT o_orderkey, greatest(500, least(9000, lo)) AS clamped_lo, greatest(500, least(9000, hi)) AS clamped_hi,
  CASE WHEN lo + 30 < 500 OR hi + 30 > 9000 THEN lo ELSE lo + 30 END AS right_lo, CASE WHEN lo + 30 < 500 OR hi + 30 > 9000 THEN hi ELSE hi + 30 END AS right_hi,
  CASE WHEN lo - 30 < 500 OR hi - 30 > 9000 THEN lo ELSE lo - 30 END AS left_lo, CASE WHEN lo - 30 < 500 OR hi - 30 > 9000 THEN hi ELSE hi - 30 END AS left_hi,
  CASE WHEN o_orderkey % 5 = 0 OR (lo < 2000 AND hi < 2000) THEN 2000 ELSE lo END AS relaid_lo, CASE WHEN o_orderkey % 5 = 0 OR (lo < 2000 AND hi < 2000) THEN 32000 ELSE hi END AS relaid_hi FROM o""")
def window_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 10).alias("lo"), (F.col("o_custkey") * 10 + 300).alias("hi"))
    lo, hi, first, last = F.col("lo"), F.col("hi"), F.lit(500).cast("bigint"), F.lit(9000).cast("bigint")
    a, b, c, d = view.clamp_range(lo, hi, first, last), view.pan(lo, hi, first, last, 1), view.pan(lo, hi, first, last, -1), view.relayout(F.col("o_orderkey") % 5 == 0, lo, hi, F.lit(2000).cast("bigint"))
    names = ["clamped_lo", "clamped_hi", "right_lo", "right_hi", "left_lo", "left_hi", "relaid_lo", "relaid_hi"]
    return o.select("o_orderkey", *[x.alias(n) for x, n in zip((*a, *b, *c, *d), names)])


@query("""WITH p AS (SELECT p_partkey, p_brand AS label, -p_size * 1.0 AS physical_min, p_retailprice AS physical_max FROM part), k AS (SELECT DISTINCT p_brand AS label FROM part WHERE p_size > 45),
f AS (SELECT label, min(p_partkey) AS p_partkey FROM p GROUP BY label)
SELECT p.p_partkey, p.label, round(CASE WHEN k.label IS NOT NULL THEN 0.0 ELSE (physical_min + physical_max) / 2 END, 6) AS midpoint, round(CASE WHEN k.label IS NOT NULL THEN 1.0 ELSE (physical_max - physical_min) / 2 END, 6) AS halfrange,
  round(1.0 - (p.p_partkey % 20 + 1) / 20, 6) AS y0, round(1.0 - p.p_partkey % 20 / 20, 6) AS y1
FROM p JOIN f ON p.label = f.label AND p.p_partkey = f.p_partkey LEFT JOIN k ON k.label = p.label""")
def signal_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("label"), (-F.col("p_size") * 1.0).alias("physical_min"), F.col("p_retailprice").alias("physical_max"), "p_size")
    kept = p.where("p_size > 45").select("label", F.lit(0.0).alias("midpoint"), F.lit(1.0).alias("halfrange"))
    first = series.first_by_label(p, index="p_partkey")
    y0, y1 = view.layout(F.col("p_partkey") % 20, F.lit(20))
    return rounded(view.scaled(first, kept).select("p_partkey", "label", "midpoint", "halfrange", y0.alias("y0"), y1.alias("y1")), "midpoint", "halfrange", "y0", "y1")


@query("SELECT c_custkey, CASE WHEN NOT isnan(c_acctbal) THEN greatest(0.0, least(5000.0, c_acctbal)) END AS clamped FROM customer")
def clamp_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", clamp(F.col("c_acctbal"), F.lit(0.0), F.lit(5000.0)).alias("clamped"))


@query(f"""WITH {S_USER}, c AS (SELECT series, count(*) AS n FROM s GROUP BY series)
SELECT series, event_id, row_number() OVER (PARTITION BY series ORDER BY us, event_id) - 1 AS seq FROM s""")
def numbered_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.numbered(series_by(spark, sf_dir, "user_id")).select("series", "event_id", "seq")


@query("""SELECT l_orderkey, l_linenumber, channel, value FROM (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_extendedprice AS p, l_discount AS d FROM lineitem) UNPIVOT (value FOR channel IN (q, p, d))""")
def unpivot_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("d"))
    return wide.unpivot(["l_orderkey", "l_linenumber"], ["q", "p", "d"], "channel", "value")


@query("SELECT l_orderkey, n_name AS label, l_quantity AS value FROM lineitem JOIN nation ON n_nationkey = l_suppkey % 25")
def zip_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("signal_index"), F.col("n_name").alias("label"))
    values = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 25).alias("signal_index"), F.col("l_quantity").alias("value"))
    return values.join(signals, "signal_index").select("l_orderkey", "label", "value")


@query("""SELECT n_name AS label, CAST(n_nationkey AS BIGINT) AS signal_index FROM nation
UNION ALL SELECT r_name, CAST(r_regionkey + (SELECT max(n_nationkey) + 1 FROM nation) AS BIGINT) FROM region""")
def append_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "nation").select(F.col("n_name").alias("label"), F.col("n_nationkey").cast("bigint").alias("signal_index"))
    b = table(spark, sf_dir, "region").select(F.col("r_name").alias("label"), F.col("r_regionkey").cast("bigint").alias("signal_index"))
    return series.appended(a, b)


@query("""WITH k AS (SELECT o_custkey AS device_id, o_orderkey AS service_order, CASE o_orderpriority WHEN '1-URGENT' THEN 'heart' WHEN '2-HIGH' THEN 'temperature' WHEN '5-LOW' THEN 'motion' END AS driver FROM orders)
SELECT device_id, arg_min(driver, service_order) AS driver, min(service_order) AS service_order FROM k WHERE driver IS NOT NULL GROUP BY device_id""")
def driver_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    services = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("device_id"), F.col("o_orderkey").alias("service_order"), F.col("o_orderpriority").alias("service_uuid"))
    drivers = spark.createDataFrame([("1-URGENT", "heart"), ("2-HIGH", "temperature"), ("5-LOW", "motion")], "service_uuid string, driver string")
    return series.matched_drivers(services, drivers)
