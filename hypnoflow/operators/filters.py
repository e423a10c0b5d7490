"""Running digital filters over series, and their responses."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import design
from ..functions.design import Biquad
from ..functions.kernels import iir as iir_kernel
from ..functions.kernels import state_space

#: Samples of a series that one task filters at once.
CHUNK = 1 << 16
#: Rows of settings that are taken apart at once, and rows made of them that are put out at once.
ROWS_READ, ROWS_MADE = 256, 8192


def _packed(df: DataFrame, series: str, chunk: int) -> DataFrame:
    """series, chunk, values: the samples of every chunk of each series, in order."""
    rows = df.select(F.col(series).alias("series"), F.floor(F.col("seq") / chunk).alias("chunk"), F.struct("seq", F.col("value").cast("double").alias("value")).alias("row"))
    return rows.groupBy("series", "chunk").agg(F.array_sort(F.collect_list("row"))["value"].alias("values"))


def _doubles(column: pa.Array) -> Iterator[np.ndarray]:
    return (x.values.to_numpy(zero_copy_only=False) for x in column)


def _by_series(df: DataFrame, more: DataFrame, how: str = "inner", *on: str, series: str = "series") -> DataFrame:
    """df joined by series, null ones too, and by other columns."""
    renamed = more.withColumnsRenamed({c: f"_{c}" for c in (series, *on)})
    same = F.col(series).eqNullSafe(F.col(f"_{series}"))
    for c in on:
        same &= F.col(c) == F.col(f"_{c}")
    return df.join(renamed, same, how).drop(*(f"_{c}" for c in (series, *on)))


def _filtered(packed: DataFrame, stages: Sequence[Biquad], initial: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """packed with the chunks' outputs y, and the (series, n, state) after each series; initial: (series, state)."""
    kind = packed.schema["series"].dataType.simpleString()
    index = packed.schema["chunk"].dataType.simpleString()
    a, _, _, _ = state_space(stages)

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = [iir_kernel(stages, x)[1].tolist() for x in _doubles(batch["values"])]
            yield pa.RecordBatch.from_arrays([batch["series"], batch["chunk"], batch["values"].value_lengths().cast(pa.int64()), pa.array(states, pa.list_(pa.float64()))], ["series", "chunk", "n", "state"])

    ends = packed.mapInArrow(ended, f"series {kind}, chunk {index}, n bigint, state array<double>")
    begun = ends.withColumn("first", F.lit(None).cast("array<double>")) if initial is None else _by_series(ends, initial.select("series", F.col("state").alias("first")), "left")

    # the few numbers of each chunk stream in order: the state before it, and whether it is the last of its series
    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["chunk", "start", "last", "n", "state"], [pa.int64(), pa.list_(pa.float64()), pa.bool_(), pa.int64(), pa.list_(pa.float64())]
        now, held, z, total = object(), None, None, 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            key = pa.concat_arrays([r[0] for r in rows])
            return pa.RecordBatch.from_arrays([key, *(pa.array(c, k) for c, k in zip(zip(*(r[1:] for r in rows)), kinds))], ["series", *names])

        for batch in batches:
            rows = []
            for i, (who, chunk, n, own, first) in enumerate(zip(batch["series"].to_pylist(), batch["chunk"].to_pylist(), batch["n"].to_pylist(), batch["state"].to_pylist(), batch["first"].to_pylist())):
                begins = held is None or who != now
                if held is not None:
                    rows.append((*held[:3], begins, *held[3:]))
                if begins:
                    now, z, total = who, np.array(first or np.zeros(len(a)), float), 0
                start = z
                z = (np.linalg.matrix_power(a, n) @ z if z.any() else z) + np.array(own)
                total += n
                held = (batch["series"].slice(i, 1), chunk, start.tolist(), total, z.tolist())
            if rows:
                yield out(rows)
        if held is not None:
            yield out([(*held[:3], True, *held[3:])])

    ordered = begun.repartition("series").sortWithinPartitions("series", "chunk")
    chain = ordered.mapInArrow(chained, f"series {kind}, chunk bigint, start array<double>, last boolean, n bigint, state array<double>")

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [iir_kernel(stages, x, z)[0] for x, z in zip(_doubles(batch["values"]), _doubles(batch["start"]))]
            yield pa.RecordBatch.from_arrays([batch["series"], batch["chunk"], batch["values"], pa.array(out, pa.list_(pa.float64()))], ["series", "chunk", "values", "y"])

    started = _by_series(packed, chain.select("series", "chunk", "start"), "inner", "chunk")
    out = started.mapInArrow(filtered, f"series {kind}, chunk {index}, values array<double>, y array<double>")
    return out, chain.where("last").select("series", "n", "state")


def iir(df: DataFrame, stages: Sequence[Biquad], series: str = "series", initial: DataFrame | None = None, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(series, seq, value, y) and the (series, n, state) after each series, from (series, seq, value) with seq from 0.

    A series is cut into chunks, each one row with an array. Each is filtered from rest for the state it ends in; these few
    numbers a chunk are chained along the series (state after = A^n state before + what the chunk adds), and each chunk is
    then filtered from its true start. So the longest series is filtered by as many tasks as it has chunks. Samples are
    shuffled once, to make the chunks.
    """
    out, after = _filtered(_packed(df, series, chunk), stages, None if initial is None else initial.select(F.col(series).alias("series"), "state"))
    each = out.select("series", "chunk", F.posexplode(F.arrays_zip("values", "y")).alias("at", "x"))
    rows = each.select(F.col("series").alias(series), (F.col("chunk") * chunk + F.col("at")).alias("seq"), F.col("x.values").alias("value"), F.col("x.y").alias("y"))
    return rows, after.select(F.col("series").alias(series), "n", "state")


def filtfilt(df: DataFrame, stages: Sequence[Biquad], series: str = "series", chunk: int = CHUNK) -> DataFrame:
    """series, seq, y: filtered forwards, then backwards from the state the first pass ended in. Chunks are turned as they are."""
    forward, after = _filtered(_packed(df, series, chunk), stages)
    turned = forward.select("series", (-F.col("chunk")).alias("chunk"), F.reverse("y").alias("values"))
    back, _ = _filtered(turned, stages, after.select("series", "state"))
    each = back.select("series", "chunk", F.posexplode(F.reverse("y")).alias("at", "y"))
    return each.select(F.col("series").alias(series), (F.col("at") - F.col("chunk") * chunk).alias("seq"), "y")


def fir(df: DataFrame, taps: Sequence[float], series: str = "series", compat: bool = False, chunk: int = CHUNK) -> DataFrame:
    """series, seq, value, y from (series, seq, value): the dot product of the taps and the samples up to each; those that are not
    there, as before the first, are zero.

    A series is cut into chunks that have a filter's length of the samples before them too, so the longest one is filtered by
    as many tasks as it has chunks.

    compat: all taps but the last, the newest sample meeting the first tap and the one before it the last but one, then
    backwards from there, as a ring of one slot less than the taps makes it.
    """
    h = [float(x) for x in taps]
    if compat:
        h = [h[0], *h[-2:0:-1]] if len(h) > 1 else []
    kind = df.schema[series].dataType.simpleString()
    own = df.select(F.col(series).alias("series"), F.col("seq").cast("bigint").alias("seq"), F.col("value").cast("double").alias("value"))
    if not h:
        return own.select(F.col("series").alias(series), "seq", "value", F.lit(0.0).alias("y"))
    halo = len(h) - 1
    in_chunks = F.sequence(F.floor(F.col("seq") / chunk), F.floor((F.col("seq") + halo) / chunk))
    rows = own.withColumn("chunk", F.explode(in_chunks))
    packed = rows.groupBy("series", "chunk").agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("rows"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (which, inputs) in enumerate(zip(batch["chunk"].to_pylist(), batch["rows"])):
                seq, value = inputs.values.field("seq").to_numpy(), inputs.values.field("value").to_numpy()
                first = int(seq[0])
                x = np.zeros(int(seq[-1]) - first + 1)
                x[seq - first] = value
                new = seq >= which * chunk
                y = np.convolve(x, h)[seq[new] - first]
                key = batch["series"].take(pa.array(np.full(len(y), i)))
                yield pa.RecordBatch.from_arrays([key, pa.array(seq[new]), pa.array(value[new]), pa.array(y)], ["series", "seq", "value", "y"])

    out = packed.mapInArrow(of, f"series {kind}, seq bigint, value double, y double")
    return out.select(F.col("series").alias(series), "seq", "value", "y")


def fir_filtfilt(df: DataFrame, taps: Sequence[float], series: str = "series", compat: bool = False) -> DataFrame:
    """series, seq, y: filtered forwards, then backwards with the forward pass's last samples still in the ring."""
    length = df.groupBy(series).agg(F.count(F.lit(1)).alias("n"))
    forward = _by_series(fir(df, taps, series, compat=compat), length, series=series)
    ring = forward.where(F.col("seq") >= F.col("n") - len(taps)).select(series, (F.col("seq") - F.col("n")).alias("seq"), "value")
    turned = forward.select(series, (F.col("n") - 1 - F.col("seq")).alias("seq"), F.col("y").alias("value"))
    back = _by_series(fir(ring.unionByName(turned), taps, series, compat=compat).where("seq >= 0"), length, series=series)
    return back.select(series, (F.col("n") - 1 - F.col("seq")).alias("seq"), "y")


def coefficient_rows(spark: SparkSession, stages: Sequence[Biquad], name: str = "") -> DataFrame:
    """name, stage, b0, b1, b2, a1, a2, k."""
    rows = [(name, i, s.b0, s.b1, s.b2, s.a1, s.a2, s.k) for i, s in enumerate(stages)]
    return spark.createDataFrame(rows, "name string, stage int, b0 double, b1 double, b2 double, a1 double, a2 double, k double")


def _with(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df's columns of these names and kinds, null where it has none."""
    return df.select("name", *[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()])


def _rows_of(df: DataFrame, make: Callable[[dict], Iterator[tuple]], out: dict[str, tuple[pa.DataType, str]]) -> DataFrame:
    """A few rows for each row of df, with its name. They are put out so many at a time, whatever a batch of df makes."""
    kind = df.schema["name"].dataType.simpleString()

    def table(names: pa.Array, made: list[tuple]) -> pa.RecordBatch:
        at, *columns = zip(*made)
        return pa.RecordBatch.from_arrays([names.take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, (k, _) in zip(columns, out.values()))], ["name", *out])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            for first in range(0, batch.num_rows, ROWS_READ):
                for i, row in enumerate(batch.slice(first, ROWS_READ).to_pylist()):
                    for x in make(row):
                        made.append((first + i, *x))
                        if len(made) == ROWS_MADE:
                            yield table(batch["name"], made)
                            made = []
            if made:
                yield table(batch["name"], made)

    return df.mapInArrow(of, f"name {kind}, " + ", ".join(f"{c} {k}" for c, (_, k) in out.items()))


DOUBLE, INT, STRING = (pa.float64(), "double"), (pa.int32(), "int"), (pa.string(), "string")


def designed(settings: DataFrame) -> DataFrame:
    """name, kind, stage, b0, b1, b2, a1, a2, k of the filter that each row of settings asks for.

    settings: name, kind, fs, fc, and what the design needs of q, bw, gain, pre_gain; with characteristic, stages and perhaps transform ("matched_z")
    the filter is a cascade, else one section. Rows without a kind, a rate or a frequency have no sections. Each row is designed by itself.
    """
    asked = _with(settings, {"kind": "string", "characteristic": "string", "stages": "int", "transform": "string", "fs": "double", "fc": "double", "q": "double", "bw": "double", "gain": "double", "pre_gain": "boolean"})

    def made(r: dict) -> Iterator[tuple]:
        if r["kind"] is None or r["fs"] is None or r["fc"] is None:
            return
        more = {"q": r["q"], "bw": r["bw"], "gain": r["gain"] or 0.0, "pre_gain": bool(r["pre_gain"])}
        stages = [design.biquad(r["kind"], r["fs"], r["fc"], **more)] if r["characteristic"] is None else design.cascade(r["kind"], r["characteristic"], r["stages"] or 0, r["fs"], r["fc"], **more, transform=r["transform"] or "bilinear")
        for i, s in enumerate(stages):
            yield r["kind"], i, s.b0, s.b1, s.b2, s.a1, s.a2, s.k

    return _rows_of(asked, made, {"kind": STRING, "stage": INT} | {c: DOUBLE for c in ("b0", "b1", "b2", "a1", "a2", "k")})


def prototypes(settings: DataFrame) -> DataFrame:
    """name, characteristic, stages, stage, a, b: the analogue sections that each row of settings (name, characteristic, stages) asks for."""
    asked = _with(settings, {"characteristic": "string", "stages": "int"}).where("characteristic IS NOT NULL AND stages > 0")
    made = lambda r: ((r["characteristic"], r["stages"], i, float(a), float(b)) for i, (a, b) in enumerate(design.prototype(r["characteristic"], r["stages"])))
    return _rows_of(asked, made, {"characteristic": STRING, "stages": INT, "stage": INT, "a": DOUBLE, "b": DOUBLE})


def polynomials(sections: DataFrame) -> DataFrame:
    """name, k, c: the coefficients of s^k of the product of the sections 1 + a s + b s^2 of each name, from (name, stage, a, b)."""
    grouped = sections.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("stage", "a", "b"))).alias("x"))
    at = lambda p, k: F.coalesce(F.when(k >= 0, F.get(p, k)), F.lit(0.0))
    times = lambda p, x: F.transform(F.sequence(F.lit(0), F.size(p) + 1), lambda k: at(p, k) + x["a"] * at(p, k - 1) + x["b"] * at(p, k - 2))
    return grouped.select("name", F.posexplode(F.aggregate("x", F.array(F.lit(1.0)), times)).alias("k", "c"))


def fir_designed(settings: DataFrame) -> DataFrame:
    """name, kind, n, h: the taps that each row of settings (name, kind, taps, fs, f1, and f2 for bands) asks for.

    kind: lowpass, highpass, bandstop, bandpass (Hamming windows; f1 is the frequency of the first two) or kaiser (a band, by default 100 dB).
    Rows without a kind, a rate or a frequency have no taps.
    """
    asked = _with(settings, {"kind": "string", "taps": "int", "fs": "double", "f1": "double", "f2": "double", "attenuation": "double"})
    makers = {"lowpass": design.fir_lowpass, "highpass": design.fir_highpass, "bandstop": design.fir_bandstop, "bandpass": design.fir_bandpass}

    def made(r: dict) -> Iterator[tuple]:
        if r["kind"] is None or r["fs"] is None or r["f1"] is None:
            return
        if r["kind"] == "kaiser":
            h = design.fir_kaiser(r["fs"], r["f1"], r["f2"], r["taps"] or 51, r["attenuation"] or 100.0)
        else:
            h = makers[r["kind"]](r["taps"], r["fs"], *([r["f1"], r["f2"]] if r["kind"].startswith("band") else [r["f1"]]))
        for i, x in enumerate(h):
            yield r["kind"], i, float(x)

    return _rows_of(asked, made, {"kind": STRING, "n": INT, "h": DOUBLE})


def time_response(coefficients: DataFrame, n: int, step: bool = True) -> DataFrame:
    """name, i, y: what each filter of (name, stage, b0, b1, b2, a1, a2, k) makes of a unit step, or a unit impulse, in n samples."""
    grouped = coefficients.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("stage", "b0", "b1", "b2", "a1", "a2", "k"))).alias("stages"))
    x = np.ones(n) if step else np.eye(1, n)[0]

    def made(r: dict) -> Iterator[tuple]:
        y, _ = iir_kernel([Biquad(*(s[c] for c in ("b0", "b1", "b2", "a1", "a2", "k"))) for s in r["stages"]], x)
        yield from enumerate(y.tolist())

    return _rows_of(grouped, made, {"i": (pa.int64(), "bigint"), "y": DOUBLE})


def response(coefficients: DataFrame, resolution: int = 100) -> DataFrame:
    """name, i, magnitude, phase, db at the frequencies i / (2 resolution) of the sampling rate: the product of the stages'
    magnitudes and the sum of their phases."""
    w = -F.lit(math.pi) * F.col("i") / float(resolution)
    cos1, sin1, cos2, sin2 = F.cos(w), F.sin(w), F.cos(2 * w), F.sin(2 * w)
    top_re, top_im = F.col("b0") + F.col("b1") * cos1 + F.col("b2") * cos2, F.col("b1") * sin1 + F.col("b2") * sin2
    low_re, low_im = 1 + F.col("a1") * cos1 + F.col("a2") * cos2, F.col("a1") * sin1 + F.col("a2") * sin2
    re = F.col("k") * (top_re * low_re + top_im * low_im)
    im = F.col("k") * (top_im * low_re - top_re * low_im)
    size = low_re * low_re + low_im * low_im
    each = coefficients.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(resolution - 1)))).select("name", "stage", "i", (F.hypot(re, im) / size).alias("m"), F.atan2(im, re).alias("phi"))
    grouped = each.groupBy("name", "i").agg(F.array_sort(F.collect_list(F.struct("stage", "m", "phi"))).alias("s"))
    magnitude = F.aggregate("s", F.lit(1.0), lambda acc, x: acc * x["m"])
    phase = F.aggregate("s", F.lit(0.0), lambda acc, x: acc + x["phi"])
    return grouped.select("name", "i", magnitude.alias("magnitude"), phase.alias("phase")).withColumn("db", F.when(F.col("magnitude") > 0, 20 * F.log10("magnitude")))


def fir_response(taps: DataFrame, resolution: int = 100) -> DataFrame:
    """i, magnitude, db of taps (n, h); by name, where taps have one.

    A filter's taps come together once; its frequencies are made in the tasks, a bounded number of filters at a time, and never shuffled.
    """
    keys = [c for c in ("name",) if c in taps.columns]
    own = taps.where("n IS NOT NULL AND h IS NOT NULL").select(*keys, F.struct(F.col("n").cast("double").alias("n"), F.col("h").cast("double").alias("h")).alias("tap"))
    packed = own.groupBy(*keys).agg(F.array_sort(F.collect_list("tap")).alias("taps")).where(F.size("taps") > 0)
    at, step = np.arange(resolution), max(ROWS_MADE // max(resolution, 1), 1)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows if resolution > 0 else 0, step):
                part = batch.slice(first, step)
                lengths, flat = part["taps"].value_lengths().to_numpy(), part["taps"].flatten()
                w, h = -math.pi / resolution * np.outer(flat.field("n").to_numpy(), at), flat.field("h").to_numpy()[:, None]
                begins = np.cumsum(lengths) - lengths
                re, im = (np.add.reduceat(h * x, begins, axis=0).ravel() for x in (np.cos(w), np.sin(w)))
                which = pa.array(np.repeat(np.arange(part.num_rows), resolution))
                yield pa.RecordBatch.from_arrays([*(part[c].take(which) for c in keys), pa.array(np.tile(at, part.num_rows).astype(np.int32)), pa.array(re), pa.array(im)], [*keys, "i", "re", "im"])

    each = packed.mapInArrow(of, ", ".join([*(f"{c} {taps.schema[c].dataType.simpleString()}" for c in keys), "i int, re double, im double"]))
    return each.select(*keys, "i", F.hypot("re", "im").alias("magnitude")).withColumn("db", F.when(F.col("magnitude") > 0, 20 * F.log10("magnitude")))


def unwrapped(points: DataFrame, resolution: int, name: str = "name") -> DataFrame:
    """points (name, i, phase) with unwrapped (jumps over pi undone, as an absolute value), phase_delay and group_delay.

    The first delays have nothing before them and repeat the second's, which repeats the third's.
    """
    w = Window.partitionBy(name).orderBy("i")
    jump = F.col("phase") - F.lag("phase").over(w)
    turn = F.when(jump > math.pi, -1).when(jump < -math.pi, 1).otherwise(0)
    flat = points.withColumn("_turn", turn).withColumn("unwrapped", F.abs(F.col("phase") + 2 * math.pi * F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    flat = flat.withColumn("_pd", F.when(F.col("i") > 0, F.col("unwrapped") / (F.col("i") / float(resolution)))).withColumn("_gd", F.abs(F.col("unwrapped") - F.lag("unwrapped").over(w)) / (math.pi / resolution))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pick = lambda c: F.when(F.col("i") == 0, F.nth_value(c, 2).over(whole)).when(F.col("i") == 1, F.nth_value(c, 3).over(whole)).otherwise(F.col(c))
    return flat.withColumn("phase_delay", pick("_pd")).withColumn("group_delay", pick("_gd")).drop("_turn", "_pd", "_gd")


def roots(one: Column, two: Column) -> Column:
    """The two roots of x^2 + one x + two as structs re, im; the larger or upper first."""
    half = one / 2.0
    disc = half * half - two
    root = F.sqrt(F.abs(disc))
    pair = lambda sign: F.struct(F.when(disc < 0, -half).otherwise(-half + sign * root).alias("re"), F.when(disc < 0, sign * root).otherwise(F.lit(0.0)).alias("im"))
    return F.array(pair(F.lit(1.0)), pair(F.lit(-1.0)))


def poles_zeros(coefficients: DataFrame) -> DataFrame:
    """name, stage, kind (pole, zero), which, re, im."""
    both = F.create_map(F.lit("pole"), roots(F.col("a1"), F.col("a2")), F.lit("zero"), roots(F.col("b1") / F.col("b0"), F.col("b2") / F.col("b0")))
    rows = coefficients.where("b0 != 0").select("name", "stage", F.explode(both).alias("kind", "r"))
    return rows.select("name", "stage", "kind", F.posexplode("r").alias("which", "x")).select("name", "stage", "kind", "which", F.col("x.re").alias("re"), F.col("x.im").alias("im"))


def movement(df: DataFrame, stages: Sequence[Biquad], series: str = "series") -> DataFrame:
    """series, seq, movement: the length of the filtered acceleration, from (series, seq, x, y, z).

    The three axes are three series of one filter run.
    """
    axes = df.select(F.col(series).alias("of"), "seq", F.explode(F.create_map(F.lit("x"), "x", F.lit("y"), "y", F.lit("z"), "z")).alias("axis", "value"))
    axes = axes.select(F.struct("of", "axis").alias("signal"), "seq", "value")
    out, _ = iir(axes, stages, "signal")
    return out.groupBy(F.col("signal.of").alias(series), "seq").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("movement"))


def extrema(df: DataFrame, value: str = "y", order: str = "i", name: str = "name") -> DataFrame:
    """name, first_max (i, value) and the first local minimum of a response."""
    w = Window.partitionBy(name).orderBy(order)
    near = df.withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w))
    top = (F.col(value) > F.col("_a")) & (F.col(value) >= F.col("_b"))
    low = (F.col(value) < F.col("_a")) & (F.col(value) <= F.col("_b"))
    return near.groupBy(name).agg(
        F.min(F.when(top, F.col(order))).alias("max_at"), F.min_by(value, F.when(top, F.col(order))).alias("max_value"), F.min(F.when(low, F.col(order))).alias("min_at"), F.min_by(value, F.when(low, F.col(order))).alias("min_value")
    )
