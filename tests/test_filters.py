"""Filter design and running filters: known responses, direct recursions, chunking."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hypnoflow.functions import design, kernels
from hypnoflow.operators import filters


def recursion(stages, x, z=None):
    z = [list(s) for s in (z or [[0.0, 0.0]] * len(stages))]
    out = []
    for v in x:
        for s, st in zip(stages, z):
            t = s.k * v - s.a1 * st[0] - s.a2 * st[1]
            v = s.b0 * t + s.b1 * st[0] + s.b2 * st[1]
            st[1], st[0] = st[0], t
        out.append(v)
    return np.array(out), z


def gain(stages, f, fs):
    z = np.exp(-2j * math.pi * f / fs)
    return abs(np.prod([s.k * (s.b0 + z * (s.b1 + z * s.b2)) / (1 + z * (s.a1 + z * s.a2)) for s in stages]))


@pytest.mark.parametrize("stages", [0, 1, 2, 5])
@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_block_kernel_is_the_recursion(stages, n):
    made = design.cascade("lowpass", "butterworth", stages, 100, 9)
    x = np.random.default_rng(n).standard_normal(n)
    y, z = kernels.iir(made, x)
    want, end = recursion(made, x)
    assert np.allclose(y, want, atol=1e-9) and np.allclose(z, np.ravel(end), atol=1e-9)
    half = n // 2
    first, z1 = kernels.iir(made, x[:half])
    second, _ = kernels.iir(made, x[half:], z1)
    assert np.allclose(np.concatenate([first, second]), want, atol=1e-9)


@pytest.mark.parametrize("characteristic", ["butterworth", "bessel"])
@pytest.mark.parametrize("stages", [1, 2, 4])
def test_cutoff_is_three_decibels(characteristic, stages):
    low = design.cascade("lowpass", characteristic, stages, 1000, 50)
    assert abs(gain(low, 0, 1000) - 1) < 1e-9
    assert abs(20 * math.log10(gain(low, 50, 1000)) + 3.01) < (0.02 if characteristic == "butterworth" else 0.5)
    assert gain(low, 400, 1000) < 0.05 ** min(stages, 2)
    high = design.cascade("highpass", characteristic, stages, 1000, 50)
    assert gain(high, 0, 1000) < 1e-9 and abs(gain(high, 500, 1000) - 1) < 1e-9


@pytest.mark.parametrize("kind", ["bessel", "butterworth", "chebyshev05", "chebyshev1", "chebyshev2", "chebyshev3"])
def test_prototypes_fall_three_decibels_at_one(kind):
    for n in range(1, 6):
        level = sum(-10 * math.log10((1 - b) ** 2 + a * a) for a, b in design.prototype(kind, n))
        assert abs(level + 3.0103) < 1e-3
        matched = design.cascade("lowpass", kind, n, 1000, 20, transform="matched_z")
        assert abs(gain(matched, 0, 1000) - 1) < 1e-9
        assert all(abs(r) < 1 for s in matched for r in np.roots([1, s.a1, s.a2]))


def test_known_sections():
    # second-order prototypes by hand: Bessel 3/(s^2+3s+3), Butterworth 1/(s^2+sqrt2 s+1)
    (a, b), = design.prototype("bessel", 1)
    assert abs(a / math.sqrt(b) - math.sqrt(3)) < 1e-9 and abs(b - 0.618) < 1e-3
    (a, b), = design.prototype("butterworth", 1)
    assert abs(a - math.sqrt(2)) < 1e-6 and abs(b - 1) < 1e-6
    (a, b), = design.prototype("chebyshev05", 1)
    assert abs(a - 1.3614) < 1e-3 and abs(b - 1.3827) < 1e-3
    (a, b), = design.prototype("allpass", 1)
    assert abs(a - 1.6278) < 1e-3 and abs(b - 0.8832) < 1e-3
    m = design.movement_highpass(10)[0]
    assert np.allclose([m.b0, m.b1, m.a1, m.a2], [0.97803047920655961, -1.9560609584131192, -1.9555782403150352, 0.9565436765112032], atol=1e-12)


def test_design_errors():
    assert len(design.cascade("lowpass", "butterworth", 40, 100, 5)) == design.MAX_STAGES
    assert design.cascade("lowpass", "butterworth", 0, 100, 5) == []
    for bad in (lambda: design.cascade("lowpass", "chebyshev1", 2, 100, 5), lambda: design.cascade("lowpass", "bessel", 6, 100, 5, transform="matched_z"), lambda: design.biquad("bandpass", 100, 5), lambda: design.biquad("peak", 100, 5, gain=3), lambda: design.biquad("odd", 100, 5, q=1), lambda: design.fir_highpass(21, 100, 5)):
        with pytest.raises(ValueError):
            bad()
    assert design.biquad("lowpass", 100, 5, q=1, pre_gain=True).k < 0.1
    for kind in ("bandpass", "bandstop", "allpass"):
        assert design.biquad(kind, 100, 5, bw=1.0).a2 < 1


def test_special_sections():
    assert gain([design.biquad("bandstop", 1000, 50, q=20)], 50, 1000) < 1e-9
    assert abs(gain([design.biquad("peak", 1000, 50, q=1, gain=6)], 50, 1000) - 10 ** 0.3) < 1e-9
    assert abs(gain([design.biquad("lowshelf", 1000, 50, q=0.7, gain=6)], 0, 1000) - 10 ** 0.3) < 1e-9
    assert abs(gain([design.biquad("highshelf", 1000, 50, q=0.7, gain=6)], 500, 1000) - 10 ** 0.3) < 1e-9
    bt = design.biquad("highpass_bt", 1000, 100)
    assert gain([bt], 0, 1000) < 1e-9 and abs(gain([bt], 500, 1000) - 1) < 1e-9
    old = design.biquad("highpass_bt", 1000, 100, compat=True)
    assert abs(gain([old], 0, 1000) - 28.4) < 0.1 and gain([old], 500, 1000) < 1e-9


def test_fir_designs():
    f = lambda h, x: abs(np.sum(h * np.exp(-2j * math.pi * x / 100 * np.arange(len(h)))))
    low = design.fir_lowpass(60, 100, 10)
    assert np.allclose(low, low[::-1]) and abs(low.sum() - 1) < 1e-12
    stop = design.fir_bandstop(60, 100, 10, 30)
    assert abs(f(stop, 0) - 1) < 0.01 and f(stop, 20) < 0.02 and abs(f(stop, 45) - 1) < 0.02
    lifted = design.fir_bandstop(60, 100, 10, 30, compat=True)
    assert abs(f(lifted, 0) - 1) < 0.01 and abs(f(lifted, 20) - 2) < 0.02
    band = design.fir_bandpass(60, 100, 10, 30)
    assert f(band, 0) < 0.02 and abs(f(band, 20) - 1) < 0.02
    assert np.allclose(design.fir_bandpass(60, 100, 10, 30, compat=True), -band)
    kaiser = design.fir_kaiser(100, 0, 10, 101, 60)
    assert f(kaiser, 30) < 2e-3 and abs(f(kaiser, 2) - 1) < 2e-3 and len(design.fir_kaiser(100, 0, 10, 50)) == 51
    assert abs(design.bessel_i0(3.0) - np.i0(3.0)) < 1e-4


def test_rational_and_polyphase():
    assert design.rational(500 / 48000) == (1, 96) and design.rational(500 / 44100) == (5, 441)
    p = design.polyphase(48000, 500)
    assert (p.up, p.down, sum(map(len, p.phases))) == (1, 96, 25)
    assert abs(design.polyphase(44100, 500).delay_s * 5 - design.polyphase(44100, 500, compat=True).delay_s) < 1e-12


def test_chunks_chain(spark):
    made = design.cascade("lowpass", "butterworth", 2, 100, 9)
    x = np.random.default_rng(3).standard_normal((3, 500))
    df = spark.createDataFrame([(f"s{s}", i, float(v)) for s in range(3) for i, v in enumerate(x[s][: 500 - 100 * s])], "series string, seq bigint, value double").repartition(7)
    out, after = filters.iir(df, made, chunk=64)
    got = {(r.series, r.seq): r.y for r in out.collect()}
    for s in range(3):
        want, end = recursion(made, x[s][: 500 - 100 * s])
        assert np.allclose([got[f"s{s}", i] for i in range(len(want))], want, atol=1e-9)
        state = [r.state for r in after.collect() if r.series == f"s{s}"][0]
        assert np.allclose(state, np.ravel(end), atol=1e-9)
    both = {(r.series, r.seq): r.y for r in filters.filtfilt(df, made).collect()}
    forward, z = recursion(made, x[0])
    back, _ = recursion(made, forward[::-1], z)
    assert np.allclose([both["s0", i] for i in range(500)], back[::-1], atol=1e-9)


def test_fir_on_series(spark):
    x, h = np.arange(1.0, 9.0), [0.5, 0.3, 0.15, 0.05]
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "series string, seq bigint, value double")
    got = [r.y for r in filters.fir(df, h).orderBy("seq").collect()]
    assert np.allclose(got, np.convolve(x, h)[:8])
    old = [r.y for r in filters.fir(df, h, compat=True).orderBy("seq").collect()]
    assert np.allclose(old, np.convolve(x, [0.5, 0.15, 0.3])[:8])
    assert [r.y for r in filters.fir(df, [1.0], compat=True).collect()] == [0.0] * 8


def test_responses(spark):
    made = design.cascade("lowpass", "butterworth", 2, 100, 9)
    got = filters.response(filters.coefficient_rows(spark, made, "x"), 50).orderBy("i").collect()
    assert all(abs(r.magnitude - gain(made, r.i, 100)) < 1e-9 for r in got)
    roots = filters.poles_zeros(filters.coefficient_rows(spark, made, "x")).collect()
    assert all(math.hypot(r.re, r.im) < 1 for r in roots if r.kind == "pole") and all(abs(r.re + 1) < 1e-6 for r in roots if r.kind == "zero")


def test_movement_of_any_series_names(spark):
    rng = np.random.default_rng(1)
    rows = [(s, i, *map(float, rng.standard_normal(3))) for s in ("arm/left", "arm/right", "arm") for i in range(50)]
    df = spark.createDataFrame(rows, "series string, seq bigint, x double, y double, z double")
    stages = design.movement_highpass(10.0)
    got = {(r.series, r.seq): r.movement for r in filters.movement(df, stages).collect()}
    assert len(got) == 150
    for s in ("arm/left", "arm/right", "arm"):
        own = np.array([r[2:] for r in rows if r[0] == s])
        y = np.stack([kernels.iir(stages, own[:, a])[0] for a in range(3)], axis=1)
        assert np.allclose([got[s, i] for i in range(50)], np.sqrt((y * y).sum(axis=1)), atol=1e-9)
    by_number = df.withColumn("series", F.xxhash64("series"))
    assert filters.movement(by_number, stages).schema["series"].dataType == by_number.schema["series"].dataType


def test_filtfilt_turns_chunks(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal(333)
    stages = design.cascade("lowpass", "butterworth", 2, 100.0, 12.0)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "series string, seq bigint, value double").repartition(3)
    got = {r.seq: r.y for r in filters.filtfilt(df, stages, chunk=50).collect()}
    forward, z = kernels.iir(stages, x)
    back, _ = kernels.iir(stages, forward[::-1], z)
    assert len(got) == 333 and np.allclose([got[i] for i in range(333)], back[::-1], atol=1e-9)


def test_fir_by_chunks(spark):
    rng = np.random.default_rng(7)
    x = {"a": rng.standard_normal(205), "b/c": rng.standard_normal(3)}
    h = design.fir_lowpass(20, 100.0, 10.0)
    df = spark.createDataFrame([(s, i, float(v)) for s, values in x.items() for i, v in enumerate(values)], "series string, seq bigint, value double").repartition(3)
    got = {(r.series, r.seq): (r.value, r.y) for r in filters.fir(df, h, chunk=16).collect()}
    assert len(got) == 208
    for s, values in x.items():
        want = np.convolve(values, h)[: len(values)]
        assert np.allclose([got[s, i] for i in range(len(values))], np.stack([values, want], axis=1), atol=1e-12)


def test_filters_designed_by_row(spark):
    """Each row's sections are those of the design functions; rows that ask for nothing have none."""
    rows = [
        (1, "lowpass", None, None, None, 100.0, 12.0, 0.9, None, None, None), (2, "peak", None, None, None, 100.0, 7.0, 2.0, None, 6.0, None), (3, "bandstop", None, None, None, 200.0, 50.0, None, 1.0, None, None),
        (4, "highpass", "butterworth", 3, None, 100.0, 5.0, None, None, None, True), (5, "lowpass", "chebyshev1", 2, "matched_z", 100.0, 5.0, None, None, None, None), (6, "lowpass", "bessel", 0, None, 100.0, 5.0, None, None, None, None),
        (7, None, None, None, None, 100.0, 5.0, 1.0, None, None, None), (8, "lowpass", None, None, None, None, 5.0, 1.0, None, None, None), (None, "allpass", None, None, None, 100.0, 5.0, 1.0, None, None, None),
    ]
    df = spark.createDataFrame(rows, "name int, kind string, characteristic string, stages int, transform string, fs double, fc double, q double, bw double, gain double, pre_gain boolean")
    got = {}
    for r in filters.designed(df).orderBy("name", "stage").collect():
        got.setdefault(r.name, []).append(design.Biquad(r.b0, r.b1, r.b2, r.a1, r.a2, r.k))
    want = {
        1: [design.biquad("lowpass", 100.0, 12.0, 0.9)], 2: [design.biquad("peak", 100.0, 7.0, 2.0, gain=6.0)], 3: [design.biquad("bandstop", 200.0, 50.0, bw=1.0)],
        4: design.cascade("highpass", "butterworth", 3, 100.0, 5.0, pre_gain=True), 5: design.cascade("lowpass", "chebyshev1", 2, 100.0, 5.0, transform="matched_z"), None: [design.biquad("allpass", 100.0, 5.0, 1.0)],
    }
    assert got == want
    assert filters.designed(df.limit(0)).count() == 0 and filters.designed(df.select("name")).count() == 0


def test_time_responses(spark):
    stages = {n: design.cascade("lowpass", "butterworth", n, 100.0, 8.0) for n in (1, 3)}
    coefficients = filters.coefficient_rows(spark, stages[1], "one").unionByName(filters.coefficient_rows(spark, stages[3], "three"))
    for step, x in ((True, np.ones(90)), (False, np.eye(1, 90)[0])):
        got = {}
        for r in filters.time_response(coefficients, 90, step).orderBy("name", "i").collect():
            got.setdefault(r.name, []).append(r.y)
        for n, name in ((1, "one"), (3, "three")):
            assert np.allclose(got[name], recursion(stages[n], x)[0], atol=1e-9)


def test_taps_designed_by_row(spark):
    rows = [(1, "lowpass", 20, 100.0, 10.0, None), (2, "bandpass", 20, 100.0, 10.0, 20.0), (3, "kaiser", None, 100.0, 5.0, 20.0), (4, "highpass", 20, None, 10.0, None), (5, None, 20, 100.0, 1.0, None)]
    got = {}
    for r in filters.fir_designed(spark.createDataFrame(rows, "name int, kind string, taps int, fs double, f1 double, f2 double")).orderBy("name", "n").collect():
        got.setdefault(r.name, []).append(r.h)
    want = {1: design.fir_lowpass(20, 100.0, 10.0), 2: design.fir_bandpass(20, 100.0, 10.0, 20.0), 3: design.fir_kaiser(100.0, 5.0, 20.0)}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)
    two = spark.createDataFrame([(n, i, float(h)) for n in ("a", "b") for i, h in enumerate(design.fir_lowpass(6, 100.0, 10.0 if n == "a" else 20.0))], "name string, n int, h double")
    both = {(r.name, r.i): r.magnitude for r in filters.fir_response(two, 8).collect()}
    for n in "ab":
        alone = {r.i: r.magnitude for r in filters.fir_response(two.where(f"name = '{n}'").drop("name"), 8).collect()}
        assert all(abs(both[n, i] - m) < 1e-12 for i, m in alone.items()) and len(alone) == 8


def test_responses_are_not_shuffled(spark):
    rng = np.random.default_rng(3)
    rows = [(k, n, float(x)) for k in range(300) for n, x in enumerate(rng.standard_normal(k % 7 + 1))]
    out = filters.fir_response(spark.createDataFrame([*rows, (0, None, 5.0), (1, 3, None)], "name int, n int, h double"), 50)
    want = {}
    for k, n, x in rows:
        want[k] = want.get(k, 0) + x * np.exp(-1j * math.pi * np.arange(50) * n / 50)
    got = {(r.name, r.i): (r.magnitude, r.db) for r in out.collect()}
    assert len(got) == 300 * 50 and all(math.isclose(got[k, i][0], abs(want[k][i]), abs_tol=1e-12) for k in want for i in range(50))
    # the groups that are shuffled are filters, not filters times frequencies
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_rows_made_of_settings_come_in_bounded_batches():
    batch = filters.pa.RecordBatch.from_pylist([{"name": i} for i in range(3000)])

    class Settings:
        schema = {"name": type("Field", (), {"dataType": type("Kind", (), {"simpleString": lambda self: "bigint"})()})()}

        def mapInArrow(self, of, schema):
            return list(of(iter([batch])))

    made = filters._rows_of(Settings(), lambda r: ((r["name"] * 120 + i,) for i in range(120)), {"y": (filters.pa.int64(), "bigint")})
    assert max(b.num_rows for b in made) <= filters.ROWS_MADE
    assert [y for b in made for y in b["y"].to_pylist()] == list(range(3000 * 120))
    assert [n for b in made for n in b["name"].to_pylist()] == [i // 120 for i in range(3000 * 120)]


def test_products_of_sections(spark):
    df = spark.createDataFrame([("x", 0, 2.0, 3.0), ("x", 1, -1.0, 0.5), ("y", 0, 1.0, 0.0)], "name string, stage int, a double, b double")
    got = {}
    for r in filters.polynomials(df).orderBy("name", "k").collect():
        got.setdefault(r.name, []).append(r.c)
    assert got == {"x": [1.0, 1.0, 1.5, -2.0, 1.5], "y": [1.0, 1.0, 0.0]}


def test_signals_of_devices(spark):
    from hypnoflow.functions.sensors import signals_for, signals_of

    devices = [(1, "heart", None, None, None), (2, "motion", "raw", "Arm", 5.0), (3, "motion", "raw", "Leg", 3.0), (4, "temperature", "", "Skin", None), (5, "odd", "", "", None), (6, "snore", "", "x", None), (7, None, None, None, None)]
    got = {}
    for r in signals_for(spark.createDataFrame(devices, "device_id int, driver string, mode string, name string, rate double")).orderBy("device_id", "signal_order").collect():
        got.setdefault(r.device_id, []).append(tuple(r)[1:])
    want = {1: signals_of(spark, "heart"), 2: signals_of(spark, "motion", "raw", "Arm", 5.0), 4: signals_of(spark, "temperature", name="Skin"), 6: signals_of(spark, "snore")}
    assert got == {k: [tuple(r) for r in df.orderBy("signal_order").collect()] for k, df in want.items()}
