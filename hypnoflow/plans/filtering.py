"""Queries on filters: coefficients, responses, taps, and running them over series."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import design
from ..operators import filters, resample, series
from .tables import S_USER, rounded, series_by, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


FS, FC = 100.0, 12.0
W = 2 * math.pi * FC / FS
#: n (series, i from 0, x): the series that filters run over, numbered.
N_USER = f"{S_USER}, n AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY us, event_id) - 1 AS i, value AS x FROM s)"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.numbered(series_by(spark, sf_dir, "user_id")).select("series", "seq", "value")


def step_sql(name: str, source: str, stage: design.Biquad) -> str:
    """SQL of one section over source (series, i, x), sample by sample: name (series, i, t, t1, y)."""
    b0, b1, b2, a1, a2, k = (f"CAST({getattr(stage, c)!r} AS DOUBLE)" for c in ("b0", "b1", "b2", "a1", "a2", "k"))
    return f"""{name} AS (SELECT series, i, {k} * x AS t, CAST(0 AS DOUBLE) AS t1, {b0} * {k} * x AS y FROM {source} WHERE i = 0
  UNION ALL SELECT n.series, n.i, {k} * n.x - {a1} * p.t - {a2} * p.t1, p.t, {b0} * ({k} * n.x - {a1} * p.t - {a2} * p.t1) + {b1} * p.t + {b2} * p.t1 FROM {name} p JOIN {source} n ON n.series = p.series AND n.i = p.i + 1)"""


LOW = design.cascade("lowpass", "butterworth", 2, FS, FC)
NOTCH = design.notch(FS, 20.0)
MOVE = design.movement_highpass(10.0)


@query(f"WITH RECURSIVE {N_USER}, {step_sql('f1', 'n', LOW[0])}, m AS (SELECT series, i, y AS x FROM f1), {step_sql('f2', 'm', LOW[1])} SELECT series, i AS seq, round(y, 6) + 0.0 AS y FROM f2")
def iir_butterworth_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = filters.iir(signals(spark, sf_dir), LOW)
    return rounded(out.select("series", "seq", "y"), "y")


@query(f"WITH RECURSIVE {N_USER}, {step_sql('f1', 'n', NOTCH[0])} SELECT series, i AS seq, round(y, 6) + 0.0 AS y FROM f1")
def iir_notch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = filters.iir(signals(spark, sf_dir), NOTCH)
    return rounded(out.select("series", "seq", "y"), "y")


def filtfilt_sql(stage: design.Biquad) -> str:
    b0, b1, b2, a1, a2, k = (f"CAST({getattr(stage, c)!r} AS DOUBLE)" for c in ("b0", "b1", "b2", "a1", "a2", "k"))
    return f"""{step_sql('f1', 'n', stage)}, e AS (SELECT series, max(i) AS last, arg_max(t, i) AS t, arg_max(t1, i) AS t1 FROM f1 GROUP BY series),
r AS (SELECT f1.series, e.last - f1.i AS i, f1.y AS x FROM f1 JOIN e USING (series)),
g AS (SELECT r.series, r.i, {k} * r.x - {a1} * e.t - {a2} * e.t1 AS t, e.t AS t1, {b0} * ({k} * r.x - {a1} * e.t - {a2} * e.t1) + {b1} * e.t + {b2} * e.t1 AS y FROM r JOIN e USING (series) WHERE r.i = 0
  UNION ALL SELECT r.series, r.i, {k} * r.x - {a1} * p.t - {a2} * p.t1, p.t, {b0} * ({k} * r.x - {a1} * p.t - {a2} * p.t1) + {b1} * p.t + {b2} * p.t1 FROM g p JOIN r ON r.series = p.series AND r.i = p.i + 1)"""


@query(f"WITH RECURSIVE {N_USER}, {filtfilt_sql(NOTCH[0])} SELECT g.series, e.last - g.i AS seq, round(g.y, 6) + 0.0 AS y FROM g JOIN e USING (series)")
def iir_filtfilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(filters.filtfilt(signals(spark, sf_dir), NOTCH), "y")


@query(f"""WITH RECURSIVE {N_USER}, nx AS (SELECT series, i, x * 0.01 AS x FROM n), ny AS (SELECT series, i, 9.81 - x * 0.01 AS x FROM n), nz AS (SELECT series, i, i % 7 * 1.0 AS x FROM n),
{step_sql('fx', 'nx', MOVE[0])}, {step_sql('fy', 'ny', MOVE[0])}, {step_sql('fz', 'nz', MOVE[0])}
SELECT series, i AS seq, round(sqrt(fx.y * fx.y + fy.y * fy.y + fz.y * fz.y), 6) AS movement FROM fx JOIN fy USING (series, i) JOIN fz USING (series, i)""")
def movement_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir).select("series", "seq", (F.col("value") * 0.01).alias("x"), (9.81 - F.col("value") * 0.01).alias("y"), (F.col("seq") % 7 * 1.0).alias("z"))
    return rounded(filters.movement(s, MOVE), "movement")


#: SQL of ch: every supplier is a channel with filter settings of its own.
CHANNELS = f"""ch AS (SELECT *, 2 * pi() * fc / {FS} AS w FROM (SELECT s_suppkey AS name, 2.0 + (s_suppkey * 7 % 400) / 10.0 AS fc, 0.5 + (s_nationkey % 5) / 4.0 AS q, 0.5 + (s_nationkey % 4) / 2.0 AS bw, s_acctbal / 1000.0 AS gain, s_suppkey % 5 AS pick, 1 + s_nationkey % 5 AS stages FROM supplier))"""


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier as a channel with filter settings of its own."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("name"), F.lit(FS).alias("fs"), (2.0 + (key * 7 % 400) / 10.0).alias("fc"), (0.5 + (nation % 5) / 4.0).alias("q"), (0.5 + (nation % 4) / 2.0).alias("bw"), (F.col("s_acctbal") / 1000.0).alias("gain"),
        (key % 5).alias("pick"), (1 + nation % 5).cast("int").alias("stages"),
    )


def of_kinds(df: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return df.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))


def lowpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, stage and coefficients of each channel's Butterworth low-pass of two stages."""
    return filters.designed(channels(spark, sf_dir).select("name", "fs", "fc", F.lit("lowpass").alias("kind"), F.lit("butterworth").alias("characteristic"), F.lit(2).alias("stages"))).drop("kind")


#: SQL of v, the same.
LOWPASS = f"""{CHANNELS}, lq AS (SELECT name, stage, cos(w) AS c, sin(w) / (2 * (0.5 / sin(pi() / 4 * (stage + 0.5)))) AS al FROM ch, (SELECT unnest([0, 1]) AS stage)),
v AS (SELECT name, stage, (1 - c) / 2 / (1 + al) AS b0, (1 - c) / (1 + al) AS b1, (1 - c) / 2 / (1 + al) AS b2, -2 * c / (1 + al) AS a1, (1 - al) / (1 + al) AS a2, CAST(1 AS DOUBLE) AS k FROM lq)"""


@query(f"""WITH {CHANNELS}, c AS (SELECT name, cos(w) AS c, sin(w) / (2 * q) AS al, sin(w) AS s, q, pow(10, gain / 40) AS g, tan(pi() * fc / {FS}) AS t FROM ch), d AS (SELECT *, 1 + al AS n FROM c),
r AS (SELECT name, 'lowpass' AS kind, (1 - c) / 2 / n AS b0, (1 - c) / n AS b1, (1 - c) / 2 / n AS b2, -2 * c / n AS a1, (1 - al) / n AS a2 FROM d
UNION ALL SELECT name, 'highpass', (1 + c) / 2 / n, -(1 + c) / n, (1 + c) / 2 / n, -2 * c / n, (1 - al) / n FROM d
UNION ALL SELECT name, 'allpass', (1 - al) / n, -2 * c / n, (1 + al) / n, -2 * c / n, (1 - al) / n FROM d
UNION ALL SELECT name, 'bandpass', al / n, 0.0, -al / n, -2 * c / n, (1 - al) / n FROM d
UNION ALL SELECT name, 'bandpass_q', al * q / n, 0.0, -al * q / n, -2 * c / n, (1 - al) / n FROM d
UNION ALL SELECT name, 'bandstop', 1 / n, -2 * c / n, 1 / n, -2 * c / n, (1 - al) / n FROM d
UNION ALL SELECT name, 'peak', (1 + al * g) / (1 + al / g), -2 * c / (1 + al / g), (1 - al * g) / (1 + al / g), -2 * c / (1 + al / g), (1 - al / g) / (1 + al / g) FROM d
UNION ALL SELECT name, 'lowshelf', g * (g + 1 - (g - 1) * c + 2 * sqrt(g) * al) / p, 2 * g * (g - 1 - (g + 1) * c) / p, g * (g + 1 - (g - 1) * c - 2 * sqrt(g) * al) / p, -2 * (g - 1 + (g + 1) * c) / p, (g + 1 + (g - 1) * c - 2 * sqrt(g) * al) / p FROM (SELECT *, g + 1 + (g - 1) * c + 2 * sqrt(g) * al AS p FROM d)
UNION ALL SELECT name, 'highshelf', g * (g + 1 + (g - 1) * c + 2 * sqrt(g) * al) / p, -2 * g * (g - 1 + (g + 1) * c) / p, g * (g + 1 + (g - 1) * c - 2 * sqrt(g) * al) / p, 2 * (g - 1 - (g + 1) * c) / p, (g + 1 - (g - 1) * c - 2 * sqrt(g) * al) / p FROM (SELECT *, g + 1 - (g - 1) * c + 2 * sqrt(g) * al AS p FROM d)
UNION ALL SELECT name, 'lowpass_bt', 3 * t * t / p, 6 * t * t / p, 3 * t * t / p, (6 * t * t - 2) / p, (3 * t * t - 3 * t + 1) / p FROM (SELECT *, 1 + 3 * t + 3 * t * t AS p FROM d))
SELECT name, kind, round(b0, 9) + 0.0 AS b0, round(b1, 9) + 0.0 AS b1, round(b2, 9) + 0.0 AS b2, round(a1, 9) + 0.0 AS a1, round(a2, 9) + 0.0 AS a2 FROM r""")
def iir_coeffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every kind for each channel's frequency, quality and gain."""
    kinds = ("lowpass", "highpass", "allpass", "bandpass", "bandpass_q", "bandstop", "peak", "lowshelf", "highshelf", "lowpass_bt")
    made = filters.designed(of_kinds(channels(spark, sf_dir).select("name", "fs", "fc", "q", "gain"), kinds))
    return rounded(made.drop("stage", "k"), "b0", "b1", "b2", "a1", "a2", places=9)


RES = 200
RESPONSE_SQL = f"""{LOWPASS}, p AS (SELECT v.*, i, -pi() * i / {float(RES)} AS w FROM v, (SELECT unnest(range(0, {RES})) AS i)),
q AS (SELECT *, b0 + b1 * cos(w) + b2 * cos(2 * w) AS tr, b1 * sin(w) + b2 * sin(2 * w) AS ti, 1 + a1 * cos(w) + a2 * cos(2 * w) AS lr, a1 * sin(w) + a2 * sin(2 * w) AS li FROM p),
z AS (SELECT name, stage, i, k * (tr * lr + ti * li) AS re, k * (ti * lr - tr * li) AS im, lr * lr + li * li AS n FROM q),
f AS (SELECT name, CAST(i AS INTEGER) AS i, product(sqrt(re * re + im * im) / n) AS m, sum(atan2(im, re)) AS phase FROM z GROUP BY name, i)"""


@query(f"WITH {RESPONSE_SQL} SELECT name, i, round(m, 9) AS magnitude, round(phase, 6) + 0.0 AS phase, CASE WHEN m > 0 THEN round(20 * log10(m), 6) + 0.0 END AS db FROM f")
def freq_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each channel's low-pass."""
    return rounded(rounded(filters.response(lowpass(spark, sf_dir), RES), "phase", "db"), "magnitude", places=9)


@query(f"""WITH {RESPONSE_SQL}, d AS (SELECT name, i, phase, phase - lag(phase) OVER (PARTITION BY name ORDER BY i) AS j FROM f),
u AS (SELECT name, i, abs(phase + 2 * pi() * sum(CASE WHEN j > pi() THEN -1 WHEN j < -pi() THEN 1 ELSE 0 END) OVER (PARTITION BY name ORDER BY i)) AS unwrapped FROM d),
g AS (SELECT name, i, unwrapped, CASE WHEN i > 0 THEN unwrapped / (i / {float(RES)}) END AS pd, abs(unwrapped - lag(unwrapped) OVER (PARTITION BY name ORDER BY i)) / (pi() / {RES}) AS gd FROM u),
h AS (SELECT *, max(pd) FILTER (WHERE i = 1) OVER (PARTITION BY name) AS pd1, max(pd) FILTER (WHERE i = 2) OVER (PARTITION BY name) AS pd2, max(gd) FILTER (WHERE i = 1) OVER (PARTITION BY name) AS gd1, max(gd) FILTER (WHERE i = 2) OVER (PARTITION BY name) AS gd2 FROM g)
SELECT name, i, round(unwrapped, 6) AS unwrapped, round(CASE i WHEN 0 THEN pd1 WHEN 1 THEN pd2 ELSE pd END, 5) AS phase_delay, round(CASE i WHEN 0 THEN gd1 WHEN 1 THEN gd2 ELSE gd END, 5) AS group_delay FROM h""")
def phase_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = filters.response(lowpass(spark, sf_dir), RES)
    out = filters.unwrapped(points, RES).select("name", "i", "unwrapped", "phase_delay", "group_delay")
    return rounded(rounded(out, "unwrapped"), "phase_delay", "group_delay", places=5)


@query(f"""WITH {LOWPASS}, r AS (SELECT name, stage, 'pole' AS kind, a1 / 2 AS h, a2 AS c FROM v UNION ALL SELECT name, stage, 'zero', b1 / b0 / 2, b2 / b0 FROM v),
w AS (SELECT *, unnest([0, 1]) AS which FROM r)
SELECT name, stage, kind, which, round(CASE WHEN h * h - c < 0 THEN -h ELSE -h + CASE which WHEN 0 THEN 1 ELSE -1 END * sqrt(abs(h * h - c)) END, 6) + 0.0 AS re, round(CASE WHEN h * h - c < 0 THEN CASE which WHEN 0 THEN 1 ELSE -1 END * sqrt(abs(h * h - c)) ELSE 0.0 END, 6) + 0.0 AS im FROM w""")
def poles_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(filters.poles_zeros(lowpass(spark, sf_dir)), "re", "im")


#: Samples of a step response.
STEP = 120


def channel_step_sql(name: str, source: str, stage: int) -> str:
    """SQL of one stage of v over source (name, i, x): name (name, i, t, t1, y)."""
    return f"""{name} AS (SELECT name, 0 AS i, k * x AS t, CAST(0 AS DOUBLE) AS t1, b0 * k * x AS y FROM {source} JOIN v USING (name) WHERE i = 0 AND stage = {stage}
  UNION ALL SELECT n.name, CAST(n.i AS INTEGER), k * n.x - a1 * p.t - a2 * p.t1, p.t, b0 * (k * n.x - a1 * p.t - a2 * p.t1) + b1 * p.t + b2 * p.t1 FROM {name} p JOIN {source} n ON n.name = p.name AND n.i = p.i + 1 JOIN v ON v.name = p.name AND v.stage = {stage})"""


@query(f"""WITH RECURSIVE {LOWPASS}, n AS (SELECT name, i, CAST(1 AS DOUBLE) AS x FROM ch, (SELECT unnest(range(0, {STEP})) AS i)), {channel_step_sql('f1', 'n', 0)}, m AS (SELECT name, i, y AS x FROM f1), {channel_step_sql('f2', 'm', 1)},
l AS (SELECT name, i, y, lag(y) OVER (PARTITION BY name ORDER BY i) AS a, lead(y) OVER (PARTITION BY name ORDER BY i) AS b FROM f2)
SELECT name, CAST(min(i) FILTER (WHERE y > a AND y >= b) AS BIGINT) AS max_at, round(arg_min(y, i) FILTER (WHERE y > a AND y >= b), 6) AS max_value,
  CAST(min(i) FILTER (WHERE y < a AND y <= b) AS BIGINT) AS min_at, round(arg_min(y, i) FILTER (WHERE y < a AND y <= b), 6) AS min_value FROM l GROUP BY name""")
def step_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first overshoot, and the first dip, of each channel's step response."""
    return rounded(filters.extrema(filters.time_response(lowpass(spark, sf_dir), STEP)), "max_value", "min_value")


@query(f"""WITH RECURSIVE {LOWPASS}, n AS (SELECT name, i, CAST(CASE WHEN i = 0 THEN 1 ELSE 0 END AS DOUBLE) AS x FROM ch, (SELECT unnest(range(0, 40)) AS i)), {channel_step_sql('f1', 'n', 0)}, m AS (SELECT name, i, y AS x FROM f1), {channel_step_sql('f2', 'm', 1)}
SELECT name, CAST(i AS BIGINT) AS i, round(y, 6) + 0.0 AS y FROM f2""")
def impulse_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(filters.time_response(lowpass(spark, sf_dir), 40, step=False), "y")


ORDER = 20


def taps_sql(order: int, f: float) -> str:
    w = 2 * math.pi * f / FS
    return f"SELECT n, h / sum(h) OVER () AS h FROM (SELECT n, CASE WHEN n = {order / 2} THEN {w!r} ELSE sin({w!r} * (n - {order / 2})) / (n - {order / 2}) * (0.54 - 0.46 * cos(2 * pi() * n / {order})) END AS h FROM (SELECT unnest(range(0, {order + 1})) AS n))"


#: SQL of low and high (name, n, h): windowed sincs of each channel, at its frequency and 5 Hz above.
CHANNEL_TAPS = f"""{CHANNELS}, raw AS (SELECT name, which, n, CASE WHEN n = {ORDER // 2} THEN w2 ELSE sin(w2 * (n - {ORDER // 2})) / (n - {ORDER // 2}) * (0.54 - 0.46 * cos(2 * pi() * n / {ORDER})) END AS h
  FROM (SELECT name, which, 2 * pi() * (fc + which) / {FS} AS w2 FROM ch, (SELECT unnest([0, 5]) AS which)), (SELECT unnest(range(0, {ORDER + 1})) AS n)),
unit AS (SELECT name, which, n, h / sum(h) OVER (PARTITION BY name, which) AS h FROM raw), low AS (SELECT name, n, h FROM unit WHERE which = 0), high AS (SELECT name, n, CASE WHEN n = {ORDER // 2} THEN 1 - h ELSE -h END AS h FROM unit WHERE which = 5)"""


def channel_taps(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...]) -> DataFrame:
    """The taps of each channel: high-passes and the bands' upper ends 5 Hz above its frequency."""
    asked = of_kinds(channels(spark, sf_dir).select("name", "fs", F.lit(ORDER).alias("taps"), "fc"), kinds)
    return filters.fir_designed(asked.withColumn("f1", F.when(F.col("kind") == "highpass", F.col("fc") + 5).otherwise(F.col("fc"))).withColumn("f2", F.col("fc") + 5))


@query(f"""WITH {CHANNEL_TAPS}, stop AS (SELECT name, n, low.h + high.h AS h FROM low JOIN high USING (name, n))
SELECT name, 'lowpass' AS kind, CAST(n AS INTEGER) AS n, round(h, 9) + 0.0 AS h FROM low UNION ALL SELECT name, 'highpass', CAST(n AS INTEGER), round(h, 9) + 0.0 FROM high UNION ALL SELECT name, 'bandstop', CAST(n AS INTEGER), round(h, 9) + 0.0 FROM stop
UNION ALL SELECT name, 'bandpass', CAST(n AS INTEGER), round(CASE WHEN n = {ORDER // 2} THEN 1 - h ELSE -h END, 9) + 0.0 FROM stop""")
def fir_taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(channel_taps(spark, sf_dir, ("lowpass", "highpass", "bandstop", "bandpass")), "h", places=9)


@query(f"WITH t AS ({taps_sql(ORDER, 10.0)}), {N_USER} SELECT a.series, a.i AS seq, round(sum(t.h * b.x), 6) + 0.0 AS y FROM n a CROSS JOIN t JOIN n b ON b.series = a.series AND b.i = a.i - t.n GROUP BY a.series, a.i")
def fir_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(filters.fir(signals(spark, sf_dir), design.fir_lowpass(ORDER, FS, 10.0)).select("series", "seq", "y"), "y")


@query(f"""WITH t AS ({taps_sql(ORDER, 10.0)}), e AS (SELECT CASE WHEN n = 0 THEN 0 ELSE {ORDER} - n END AS n, h FROM t WHERE n < {ORDER}), {N_USER}
SELECT a.series, a.i AS seq, round(sum(e.h * b.x), 6) + 0.0 AS y FROM n a CROSS JOIN e JOIN n b ON b.series = a.series AND b.i = a.i - e.n GROUP BY a.series, a.i""")
def fir_filter_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(filters.fir(signals(spark, sf_dir), design.fir_lowpass(ORDER, FS, 10.0), compat=True).select("series", "seq", "y"), "y")


@query(f"""WITH t AS ({taps_sql(ORDER, 10.0)}), {N_USER}, l AS (SELECT series, count(*) AS len FROM n GROUP BY series),
f AS (SELECT a.series, a.i, sum(t.h * b.x) AS y FROM n a CROSS JOIN t JOIN n b ON b.series = a.series AND b.i = a.i - t.n GROUP BY a.series, a.i),
c AS (SELECT series, i - len AS j, x FROM n JOIN l USING (series) WHERE i >= len - {ORDER + 1} UNION ALL SELECT series, len - 1 - i, y FROM f JOIN l USING (series))
SELECT a.series, l.len - 1 - a.j AS seq, round(sum(t.h * b.x), 6) + 0.0 AS y FROM c a JOIN l USING (series) CROSS JOIN t JOIN c b ON b.series = a.series AND b.j = a.j - t.n WHERE a.j >= 0 GROUP BY a.series, a.j, l.len""")
def fir_filtfilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(filters.fir_filtfilt(signals(spark, sf_dir), design.fir_lowpass(ORDER, FS, 10.0)), "y")


@query(f"""WITH {CHANNEL_TAPS}, f AS (SELECT name, CAST(i AS INTEGER) AS i, sqrt(pow(sum(h * cos(-pi() * i * n / {float(RES)})), 2) + pow(sum(h * sin(-pi() * i * n / {float(RES)})), 2)) AS m FROM low, (SELECT unnest(range(0, {RES})) AS i) GROUP BY name, i)
SELECT name, i, round(m, 8) AS magnitude FROM f""")
def fir_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    taps = channel_taps(spark, sf_dir, ("lowpass",))
    return rounded(filters.fir_response(taps, RES).select("name", "i", "magnitude"), "magnitude", places=8)


SRC = design.polyphase(100.0, 40.0, 8)


def phases_sql(p: design.Polyphase) -> str:
    return "(VALUES " + ", ".join(f"({i}, {j}, CAST({h!r} AS DOUBLE))" for i, phase in enumerate(p.phases) for j, h in enumerate(phase)) + ") AS v(p, j, h)"


@query(f"""WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS series, unnest(range(0, len(embedding))) AS seq, unnest(embedding) AS x FROM embeddings WHERE embedding IS NOT NULL),
l AS (SELECT series, max(seq) AS last FROM e GROUP BY series), o AS (SELECT series, last, unnest(range(0, (last * {SRC.up} + {SRC.up} - 1) // {SRC.down} + 1)) AS n FROM l), h AS (SELECT * FROM {phases_sql(SRC)})
SELECT o.series, o.n, round(o.n / {SRC.rate!r} - {SRC.delay_s!r}, 6) + 0.0 AS t, round(sum(h.h * e.x) / sum(h.h), 6) + 0.0 AS value
FROM o JOIN h ON h.p = o.n * {SRC.down} % {SRC.up} JOIN e ON e.series = o.series AND e.seq = o.n * {SRC.down} // {SRC.up} - h.j GROUP BY ALL HAVING abs(sum(h.h)) > 1e-12""")
def polyphase_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("series"), F.posexplode("embedding").alias("seq", "value"))
    e = e.select("series", F.col("seq").cast("bigint").alias("seq"), F.col("value").cast("double").alias("value"))
    return rounded(resample.polyphase(e, SRC), "t", "value")


@query(f"""WITH RECURSIVE a AS (SELECT CAST(vec_id AS VARCHAR) AS series, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE embedding IS NOT NULL), {step_sql('f1', 'a', NOTCH[0])},
l AS (SELECT series, max(i) AS last FROM f1 GROUP BY series), o AS (SELECT series, unnest(range(0, (last * {SRC.up} + {SRC.up} - 1) // {SRC.down} + 1)) AS n FROM l), h AS (SELECT * FROM {phases_sql(SRC)}),
y AS (SELECT o.series, o.n, o.n / {SRC.rate!r} - {SRC.delay_s!r} AS t, sum(h.h * e.y) / sum(h.h) AS value FROM o JOIN h ON h.p = o.n * {SRC.down} % {SRC.up} JOIN f1 e ON e.series = o.series AND e.i = o.n * {SRC.down} // {SRC.up} - h.j GROUP BY ALL)
SELECT series, n // 4 AS chunk, round(min(t), 6) + 0.0 AS t, count(*) AS samples, round(arg_max(value, n), 6) + 0.0 AS last FROM y GROUP BY ALL""")
def snore_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound as it is recorded: mains notch, rate reduction, chunks of a tenth of a second."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("series"), F.posexplode("embedding").alias("seq", "value"))
    clean, _ = filters.iir(e.select("series", F.col("seq").cast("bigint").alias("seq"), F.col("value").cast("double").alias("value")), NOTCH)
    slow = resample.polyphase(clean.select("series", "seq", F.col("y").alias("value")), SRC)
    out = resample.chunked(slow, 4).select("series", "chunk", "t", "samples", F.element_at("values", -1).alias("last"))
    return rounded(out, "t", "last")


BETA = design.kaiser_beta(100.0)


@query(f"""WITH RECURSIVE {CHANNELS}, c AS (SELECT c, {BETA!r} * sqrt(1 - (c / 25.0) * (c / 25.0)) AS x FROM (SELECT unnest(range(0, 26)) AS c)),
t AS (SELECT c, x, 0 AS k, CAST(1 AS DOUBLE) AS term, CAST(1 AS DOUBLE) AS total FROM c
  UNION ALL SELECT c, x, k + 1, term * pow(x / (2 * (k + 1)), 2), total + term * pow(x / (2 * (k + 1)), 2) FROM t WHERE term > 1e-6 * total),
i AS (SELECT c, arg_max(total, k) AS v FROM t GROUP BY c),
h AS (SELECT name, c, CASE WHEN c = 0 THEN 2 * 5.0 / {FS} ELSE (sin(2 * c * pi() * (fc + 5) / {FS}) - sin(2 * c * pi() * fc / {FS})) / (c * pi()) * v / (SELECT v FROM i WHERE c = 0) END AS h FROM i, ch)
SELECT name, CAST(25 - c AS INTEGER) AS n, round(h, 9) + 0.0 AS h FROM h UNION SELECT name, CAST(25 + c AS INTEGER), round(h, 9) + 0.0 FROM h""")
def kaiser_taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A band of 5 Hz from each channel's frequency on."""
    asked = channels(spark, sf_dir).select("name", "fs", F.lit("kaiser").alias("kind"), F.col("fc").alias("f1"), (F.col("fc") + 5).alias("f2"))
    return rounded(filters.fir_designed(asked).drop("kind"), "h", places=9)


#: What the channels pick from.
CLOSED = ("butterworth", "chebyshev05", "chebyshev1", "chebyshev2", "chebyshev3")


def picked(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...]) -> DataFrame:
    pick = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("pick") % len(kinds) + 1).cast("int"))
    return rounded(filters.prototypes(channels(spark, sf_dir).withColumn("characteristic", pick)), "a", "b", places=5)


@query(f"""WITH {CHANNELS}, k AS (SELECT * FROM (VALUES (0, 'butterworth', CAST(0 AS DOUBLE)), (1, 'chebyshev05', 0.5), (2, 'chebyshev1', 1), (3, 'chebyshev2', 2), (4, 'chebyshev3', 3)) AS v(pick, characteristic, ripple)),
p AS (SELECT name, characteristic, ripple, stages, stage, pi() * (2 * (stages - 1 - stage) + 1) / (4 * stages) AS angle, pow(10, ripple / 10) - 1 AS e FROM (SELECT name, pick, stages, unnest(range(0, stages)) AS stage FROM ch) JOIN k USING (pick)),
m AS (SELECT *, CASE WHEN e > 0 THEN asinh(1 / sqrt(e)) / (2 * stages) END AS mu, CASE WHEN e > 0 THEN cosh(acosh(sqrt(2 + 1 / e)) / (2 * stages)) ELSE 1 END AS scale FROM p),
q AS (SELECT *, CASE WHEN e > 0 THEN sinh(mu) ELSE 1 END * sin(angle) AS re, CASE WHEN e > 0 THEN cosh(mu) ELSE 1 END * cos(angle) AS im FROM m)
SELECT name, characteristic, CAST(stages AS INTEGER) AS stages, CAST(stage AS INTEGER) AS stage, round(2 * re / (re * re + im * im) * scale, 5) + 0.0 AS a, round(scale * scale / (re * re + im * im), 5) + 0.0 AS b FROM q""")
def prototype_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the prototypes that the channels pick, of those whose poles have a closed form."""
    return picked(spark, sf_dir, CLOSED)


@query()
def prototype_bessel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections from the roots of Bessel polynomials, for which SQL has no form; tested by their responses."""
    return picked(spark, sf_dir, ("bessel", "allpass"))


@query(f"""WITH {CHANNELS}, n AS (SELECT name, stages, 2 * stages AS n FROM ch), k AS (SELECT name, n, unnest(range(0, n + 1)) AS k FROM n)
SELECT name, CAST(k AS INTEGER) AS k, round(CAST(factorial(CAST(2 * n - k AS INTEGER)) AS DOUBLE) * pow(2, k) * CAST(factorial(CAST(n AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(2 * n AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(k AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(n - k AS INTEGER)) AS DOUBLE), 8) AS c, CASE WHEN k = 0 THEN CAST(3.0103 AS DOUBLE) END AS drop_db FROM k""")
def bessel_polynomials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Bessel sections multiplied out: scaled so that s has the coefficient one, they are the reverse Bessel polynomials; and how far they are down at their
    own frequency."""
    sections = filters.prototypes(channels(spark, sf_dir).withColumn("characteristic", F.lit("bessel")))
    grown = filters.polynomials(sections)
    one = grown.where("k = 1").select("name", F.col("c").alias("x"))
    level = 10 * F.log10((1 - F.col("b")) * (1 - F.col("b")) + F.col("a") * F.col("a"))
    down = sections.groupBy("name").agg(F.sum(level).alias("drop_db"))
    out = grown.join(one, "name").join(down, "name").select("name", "k", (F.col("c") / F.pow("x", F.col("k").cast("double"))).alias("c"), F.when(F.col("k") == 0, F.round("drop_db", 4)).alias("drop_db"))
    return rounded(out, "c", places=8)


@query(f"""WITH {CHANNELS}, d AS (SELECT name, w, cos(w) AS c, tan(w / 2) AS t, sin(w) / (2 * q) AS al, sin(w) * sinh(ln(2) / 2 * bw * w / sin(w)) AS bw FROM ch),
z AS (SELECT name, -2 * exp(-w / sqrt(2)) * cos(w / sqrt(2)) AS a1, exp(-w * sqrt(2)) AS a2 FROM d),
r AS (SELECT name, 'lowpass_gain' AS kind, 1 / (1 + al) AS b0, 2 / (1 + al) AS b1, 1 / (1 + al) AS b2, -2 * c / (1 + al) AS a1, (1 - al) / (1 + al) AS a2, (1 - c) / 2 AS k FROM d
UNION ALL SELECT name, 'highpass_gain', 1 / (1 + al), -2 / (1 + al), 1 / (1 + al), -2 * c / (1 + al), (1 - al) / (1 + al), (1 + c) / 2 FROM d
UNION ALL SELECT name, 'allpass_bw', (1 - bw) / (1 + bw), -2 * c / (1 + bw), 1, -2 * c / (1 + bw), (1 - bw) / (1 + bw), 1 FROM d
UNION ALL SELECT name, 'bandpass_bw', bw / (1 + bw), 0, -bw / (1 + bw), -2 * c / (1 + bw), (1 - bw) / (1 + bw), 1 FROM d
UNION ALL SELECT name, 'bandstop_bw', 1 / (1 + bw), -2 * c / (1 + bw), 1 / (1 + bw), -2 * c / (1 + bw), (1 - bw) / (1 + bw), 1 FROM d
UNION ALL SELECT name, 'highpass_bt', 3 / p, -6 / p, 3 / p, (2 * t * t - 6) / p, (t * t - 3 * t + 3) / p, 1 FROM (SELECT name, t, t * t + 3 * t + 3 AS p FROM d)
UNION ALL SELECT name, 'matched_z', 1 + a1 + a2, 0, 0, a1, a2, 1 FROM z)
SELECT name, kind, round(b0, 9) + 0.0 AS b0, round(b1, 9) + 0.0 AS b1, round(b2, 9) + 0.0 AS b2, round(a1, 9) + 0.0 AS a1, round(a2, 9) + 0.0 AS a2, round(k, 9) + 0.0 AS k FROM r""")
def iir_coeffs_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Designs with the gain apart, by bandwidth, the Bessel-Thomson high-pass and the matched z-transform, for each channel."""
    own = channels(spark, sf_dir).select("name", "fs", "fc", "q", "bw")
    none = lambda *c: {x: F.lit(None).cast("double") for x in c}
    asked = [
        of_kinds(own, ("lowpass", "highpass")).withColumns(none("bw")).withColumn("pre_gain", F.lit(True)),
        of_kinds(own, ("allpass", "bandpass", "bandstop")).withColumns(none("q")),
        of_kinds(own, ("highpass_bt",)),
        of_kinds(own, ("lowpass",)).withColumn("characteristic", F.lit("butterworth")).withColumn("transform", F.lit("matched_z")).withColumn("stages", F.lit(1)),
    ]
    made = []
    for a, name in zip(asked, ("_gain", "_bw", "", None)):
        rows = filters.designed(a)
        made.append(rows.withColumn("kind", F.lit("matched_z") if name is None else F.concat("kind", F.lit(name))))
    return rounded(reduce(DataFrame.unionByName, made).drop("stage"), "b0", "b1", "b2", "a1", "a2", "k", places=9)
