"""Series operators on small literal tables, and whole queries against their SQL."""

import math
import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hypnoflow.functions import design, kernels
from hypnoflow.functions import signal as sig
from hypnoflow.operators import filters, resample, series, view

S = "series string, us bigint, event_id bigint, value double"


def frame(spark, values, name="a", step=1000):
    return spark.createDataFrame([(name, i * step, i, float(v)) for i, v in enumerate(values)], S)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_asof(spark):
    s = spark.createDataFrame([("a", 10, 1, 1.0), ("a", 20, 2, 2.0), ("a", 20, 3, 3.0), ("b", 5, 4, 9.0)], S)
    probes = spark.createDataFrame([("a", t) for t in (9, 10, 15, 20, 99)] + [("c", 1)], "series string, us bigint")
    got = {(r.series, r.us): (r.value, r.found_us) for r in series.asof(probes, s).collect()}
    assert got == {("a", 9): (None, None), ("a", 10): (1.0, 10), ("a", 15): (1.0, 10), ("a", 20): (3.0, 20), ("a", 99): (3.0, 20), ("c", 1): (None, None)}


@pytest.mark.parametrize("p", [-1, 0, 0.07, 0.14, 0.28, 0.5, 0.55, 0.99, 1, 3])
def test_percentiles(spark, p):
    x = np.random.default_rng(1).integers(0, 40, 100)
    df = frame(spark, x)
    q = min(max(p, 0), 1)
    assert series.percentile(df, "series", p).first().value == sorted(x)[max(int(np.ceil(q * 100)), 1) - 1]
    assert series.percentile(df, "series", p, "lower").first().value == sorted(x)[int(np.floor(q * 99))]
    k = int(q * 99)
    assert series.kth_smallest(df, "series", k).first().value == sorted(x)[k]


def test_selection_of_odd_values(spark):
    """Zeros of both signs, infinities, nulls, NaN, equal values, longs beyond doubles, and a null group."""
    inf = float("inf")
    x = {"a": [0.0, -0.0, 3.5, -inf, inf, -1e-300, 1e-300, float("nan"), None], "b": [2.25] * 40, None: [-3.0, -7.5, 1e308], "c": [None], "d": [float("nan")]}
    df = spark.createDataFrame([(g, v) for g, vs in x.items() for v in vs], "g string, value double").repartition(3)
    for k in (0, 3, 6):
        want = {g: sorted(v for v in vs if v is not None and v == v)[k] for g, vs in x.items() if len([v for v in vs if v is not None and v == v]) > k}
        assert {r.g: r.value for r in series.kth_smallest(df, "g", k).collect()} == want
    big = spark.createDataFrame([(1, 2**62 + 1), (1, 2**62 + 2), (1, -(2**63)), (2, 5), (2, None)], "g int, value bigint")
    got = series.percentile(big, "g", 1.0)
    assert {(r.g, r.value) for r in got.collect()} == {(1, 2**62 + 2), (2, 5)} and got.schema["value"].dataType.simpleString() == "bigint"
    assert {(r.g, r.value) for r in series.kth_smallest(big, "g", 0).collect()} == {(1, -(2**63)), (2, 5)}


def test_selection_without_broadcast(spark, monkeypatch):
    """Groups too many to be broadcast, with one of half of all rows."""
    monkeypatch.setattr(series, "BROADCAST_SERIES", 0)
    monkeypatch.setattr(series, "HEAVY", 4)
    rng = np.random.default_rng(5)
    rows = [(None if i % 2 else f"s{i % 30}", float(v)) for i, v in enumerate(rng.standard_normal(3000))]
    df = spark.createDataFrame(rows, "g string, value double").repartition(4)
    for p in (0.0, 0.5, 0.9):
        own = {g: sorted(v for x, v in rows if x == g) for g, _ in rows}
        assert {r.g: r.value for r in series.percentile(df, "g", p).collect()} == {g: v[max(math.ceil(p * len(v)), 1) - 1] for g, v in own.items()}
    plan = series.percentile(df, "g", 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_percentile_edges(spark):
    assert series.kth_smallest(frame(spark, [1, 2]), "series", 2).count() == 0
    assert series.percentile(frame(spark, []), "series", 0.5).count() == 0
    with pytest.raises(ValueError):
        series.percentile(frame(spark, [1]), "series", 0.5, "middle")
    with pytest.raises(ValueError):
        series.kth_smallest(frame(spark, [1]), "series", -1)


def test_viewport_and_follow(spark):
    df = frame(spark, range(10))
    assert [r.value for r in series.viewport(df, 2000, 5000).orderBy("us").collect()] == [3, 4, 5]
    lo, hi = view.follow_window(F.lit(60_001))
    assert tuple(one(spark, lo, hi)) == (60_000, 90_000)
    lo, hi = view.follow_window(F.lit(60_000))
    assert tuple(one(spark, lo, hi)) == (30_000, 60_000)


def linear(spark, ms, v, n):
    df = spark.createDataFrame([("a", float(t), i, float(x)) for i, (t, x) in enumerate(zip(ms, v))], "series string, ms double, event_id bigint, value double")
    return [(r.k, r.ms, r.value) for r in resample.linear(df, n).orderBy("k").collect()]


def test_linear_rules(spark):
    assert linear(spark, [], [], 4) == [] and linear(spark, [0, 1], [1, 2], 0) == []
    assert linear(spark, [0, 5, 6], [1, 2, 9], 3) == [(0, 0, 1), (1, 5, 2), (2, 6, 9)]  # as many: untouched
    assert linear(spark, [0, 5, 6, 9], [1, 2, 9, 4], 1) == [(0, 5, 2)]
    assert linear(spark, [3, 3], [1, 2], 3) == [(0, 3, 1), (1, 3, 1), (2, 3, 1)]
    assert linear(spark, [0, 10, 30], [0, 10, -10], 4) == [(0, 0, 0), (1, 10, 10), (2, 20, 0), (3, 30, -10)]
    assert linear(spark, [0, 10], [0, 10], 4) == [(0, 0, 0), (1, 3, pytest.approx(10 / 3)), (2, 6, pytest.approx(20 / 3)), (3, 10, 10)]


def test_linear_against_interp(spark):
    rng = np.random.default_rng(0)
    t, v = np.cumsum(rng.integers(1, 50, 200)), rng.standard_normal(200)
    got = linear(spark, t, v, 333)
    grid = np.linspace(t[0], t[-1], 333)
    assert len(got) == 333 and np.allclose([x[2] for x in got], np.interp(grid, t, v), atol=1e-9)


def plain_lttb(t, v, n):
    """Largest triangle, three buckets, over whole arrays."""
    size = len(t)
    if n >= size or n < 3:
        return list(range(size))
    width = (size - 2) / (n - 2)
    kept = [0]
    for i in range(n - 2):
        lo, hi = math.floor(i * width) + 1, math.floor((i + 1) * width) + 1
        end = min(math.floor((i + 2) * width) + 1, size)
        mt, mv = t[hi:end].mean(), v[hi:end].mean()
        a = kept[-1]
        kept.append(max(range(lo, hi), key=lambda j: (abs((t[a] - mt) * (v[j] - v[a]) - (t[a] - t[j]) * (mv - v[a])), -j)))
    return [*kept, size - 1]


def test_hull_holds_every_winner():
    """Whatever the base and the mean after, the first of the largest triangles is among the points that are kept."""
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 4, 5, 17, 100, 1000):
        for v in (rng.standard_normal(size), rng.integers(0, 4, size).astype(float), np.zeros(size), np.arange(size) ** 2.0, np.minimum(np.arange(size), 7.0), np.sin(np.arange(size) / 9)):
            t = np.cumsum(rng.integers(0, 3, size)).astype(float)  # times that repeat
            order = np.lexsort((v, t))
            t, v = t[order], v[order]
            kept = kernels.hull(t, v)
            assert (np.diff(kept) > 0).all() and kept[0] == 0
            for _ in range(40):
                base, mean = rng.integers(-9, 9, 2), (t[-1] + rng.integers(0, 9), float(rng.integers(-3, 4)))
                best = kernels.largest_triangle(*base, t, v, *mean)
                assert kept[kernels.largest_triangle(*base, t[kept], v[kept], *mean)] == best
    assert len(kernels.hull(np.arange(1e5), rng.standard_normal(100_000))) < 100
    assert kernels.hull(np.arange(50.0), np.full(50, 2.5)).tolist() == [0, 49]


@pytest.mark.parametrize("n", [1, 3, 4, 7, 50, 400])
def test_lttb_by_hulls(spark, n):
    """Equal times and values, flat and sloping stretches, a null series, series of n rows and one more, over stretches and runs."""
    rng = np.random.default_rng(n)
    rows = []
    for s, m in ((None, 5000), ("a", 3000), ("b", n), ("c", n + 1), ("d", 2), ("e", 64)):
        t, v = np.sort(rng.integers(0, 4 * m, m)), np.where(rng.random(m) < 0.5, rng.integers(0, 3, m), rng.integers(-50, 50, m)).astype(float)
        v[m // 3 : m // 2] = 1.0
        rows += [(s, int(x), float(y)) for x, y in zip(t, v)]
    df = spark.createDataFrame(rows + [("a", 7, float("nan")), ("a", 7, None)], "series string, us bigint, value double").repartition(5)
    got = {}
    for r in resample.lttb(df, n).collect():
        got.setdefault(r.series, []).append((r.us, r.value))
    for s in (None, "a", "b", "c", "d", "e"):
        own = sorted((u, v) for x, u, v in rows if x == s)
        t, v = (np.array(x, float) for x in zip(*own))
        assert sorted(got[s]) == [own[i] for i in plain_lttb(t - t[0], v, n)], s


def test_lttb_of_rows_without_a_time(spark):
    """As the SQL of the queries has it: they are a series' last rows."""
    import duckdb

    from hypnoflow.plans.timeline import lttb_sql

    rng = np.random.default_rng(8)
    rows = [(s, int(u) * 1_000_000, float(v)) for s, size in (("a", 90), ("b", 40), ("c", 5), ("e", 300)) for u, v in zip(range(size), rng.integers(0, 50, size))]
    rows += [(s, None, float(v)) for s, size in (("a", 1), ("b", 30), ("c", 2), ("d", 30), ("e", 70)) for v in rng.permutation(size)]
    db = duckdb.connect()
    db.execute("CREATE TABLE s (series VARCHAR, us BIGINT, value DOUBLE)")
    db.executemany("INSERT INTO s VALUES (?, ?, ?)", rows)
    want = Counter(db.execute(f"WITH RECURSIVE {lttb_sql('s', 12)} SELECT series, us, value FROM l").fetchall())
    got = resample.lttb(spark.createDataFrame(rows, "series string, us bigint, value double"), 12).collect()
    assert Counter((r.series, r.us, r.value) for r in got) == want


def test_lttb_of_one_long_series(spark):
    """Many tasks reduce it, and few points go through the chain."""
    df = spark.range(400_000).select(F.lit("a").alias("series"), F.col("id").alias("us"), (F.sin(F.col("id") / 5000) * 40 + F.pmod(F.xxhash64("id"), F.lit(1000)) / 100).alias("value"))
    got = sorted((r.us, r.value) for r in resample.lttb(df, 200).collect())
    t, v = np.array(df.orderBy("us").select("us").toPandas().us, float), np.array(df.orderBy("us").select("value").toPandas().value)
    assert [u for u, _ in got] == plain_lttb(t, v, 200)
    placed = series.stretched(df, "us")
    assert placed.select("_part").distinct().count() == series.STRETCHES * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_lttb_of_many_series(spark):
    rng = np.random.default_rng(4)
    rows = [(s, int(i * 10 + rng.integers(0, 9)), float(rng.standard_normal())) for s, m in (("a/b", 30_000), ("a", 3), ("b", 40)) for i in range(m)]
    df = spark.createDataFrame(rows, "series string, us bigint, value double").repartition(5)
    got = {}
    for r in resample.lttb(df, 12).collect():
        got.setdefault(r.series, []).append(r.us)
    for s in ("a/b", "a", "b"):
        own = sorted((u, v) for x, u, v in rows if x == s)
        t, v = np.array([u for u, _ in own], float), np.array([x for _, x in own])
        assert sorted(got[s]) == [own[i][0] for i in plain_lttb(t, v, 12)]


@pytest.fixture
def thin_tasks(spark):
    """Many tasks that are not put together, so that each holds few rows of a series."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def many_short_series(seed):
    rng = np.random.default_rng(seed)
    return [(s, int(u), float(v)) for s in [None, *map(str, range(60))] for u, v in zip(rng.integers(0, 10_000, 66), rng.integers(0, 500, 66))]


def test_lttb_of_series_that_meet_in_a_task(spark, thin_tasks):
    """A series' row often comes after another one's whose place is the one before, in the same bucket."""
    rows = many_short_series(6)
    df = spark.createDataFrame(rows, "series string, us bigint, value double").repartition(5)
    got = {}
    for r in resample.lttb(df, 12, splits=range(10, 10_000, 10)).collect():
        got.setdefault(r.series, []).append((r.us, r.value))
    for s in {s for s, _, _ in rows}:
        own = sorted((u, v) for x, u, v in rows if x == s)
        t, v = (np.array(x, float) for x in zip(*own))
        assert sorted(got[s]) == [own[i] for i in plain_lttb(t - t[0], v, 12)], s


def test_autoscale_of_series_that_meet_in_a_task(spark, thin_tasks):
    rows = many_short_series(7)
    df = spark.createDataFrame(rows, "series string, us bigint, value double").repartition(5)
    got = {r.series: (r.lo, r.hi) for r in view.autoscale(df, 0.0, 500.0, points=24).collect()}
    for s in {s for s, _, _ in rows}:
        t, v = (np.array(x, float) for x in zip(*sorted((u, v) for x, u, v in rows if x == s)))
        shown = sorted(v[plain_lttb(t - t[0], v, 24)])
        assert got[s] == (shown[0], shown[23]), s


@pytest.mark.parametrize("chunk", [1 << 15, 64])
def test_polyphase_by_chunks(spark, chunk):
    rng = np.random.default_rng(2)
    filt = design.polyphase(100.0, 40.0, 8)
    series = {"a": np.arange(500), "b": np.setdiff1d(np.arange(300), np.arange(90, 200)), "c": np.array([0])}
    value = {s: rng.standard_normal(len(q)) for s, q in series.items()}
    df = spark.createDataFrame([(s, int(i), float(x)) for s, q in series.items() for i, x in zip(q, value[s])], "series string, seq bigint, value double").repartition(4)
    got = {(r.series, r.n): r.value for r in resample.polyphase(df, filt, chunk_samples=chunk).collect()}
    want = {}
    for s, q in series.items():
        x = dict(zip(q.tolist(), value[s]))
        for n in range((int(q[-1]) * filt.up + filt.up - 1) // filt.down + 1):
            h, top = filt.phases[n * filt.down % filt.up], n * filt.down // filt.up
            met = [(h[j], x[top - j]) for j in range(len(h)) if top - j in x]
            if met:
                w = sum(a for a, _ in met)
                want[s, n] = sum(a * b for a, b in met) / w if abs(w) > 1e-12 else 0.0
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_epochs_fill(spark):
    df = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 500, 1, 3.0), ("b", 2500, 2, 7.0)], S)
    got = {(r.series, r.record): [] for r in resample.epochs(df, 1000, 3, 0, 3000).collect()}
    for r in resample.epochs(df, 1000, 3, 0, 3000).orderBy("series", "record", "k").collect():
        got[r.series, r.record].append((r.value, r.is_filled))
    assert got["a", 0] == [(1.0, False), (2.0, False), (3.0, False)] and got["a", 1] == [(0.0, True)] * 3 and got["b", 2] == [(7.0, False)] * 3


def test_numbering_over_many_partitions(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 10)).alias("series"), ((F.col("id") * 7919) % 5000).alias("us"), F.col("id").alias("event_id"), F.lit(1.0).alias("value"))
    got = series.numbered(df.repartition(9)).collect()
    for s in ("hot", "s8"):
        own = sorted((r for r in got if r.series == s), key=lambda r: (r.us, r.event_id))
        assert [r.seq for r in own] == list(range(len(own)))


def test_retention_and_carry(spark):
    assert [r.value for r in series.last_n(frame(spark, range(9)), 3).orderBy("us").collect()] == [6, 7, 8]
    df = spark.createDataFrame([("a", 5, 0, 1.0), ("a", 100, 1, 2.0)], S)
    got = [(r.us, r.value) for r in series.carried(df, 10, 30).orderBy("us").collect()]
    assert got == [(10, 1.0), (20, 1.0), (30, 1.0), (100, 2.0)]
    late = df.withColumn("late", F.when(F.col("us") == 100, 3).otherwise(50).cast("bigint"))
    assert [r.guarded_us for r in series.monotonic(late, "late").orderBy("us").collect()] == [50, 50]


def test_hrv(spark):
    w = kernels.HrvWindow(3)
    assert w.push([1.0]) is None and w.push([0.1, 2.5]) is None and w.push([1.4]) is None  # implausible, then a jump
    assert w.push([1.1]) == 100 and w.push([]) == 100
    assert w.push([1.2]) == 100 and w.push([1.0]) == pytest.approx(np.sqrt((100**2 + 200**2) / 2))
    with pytest.raises(ValueError):
        kernels.HrvWindow(1)
    df = spark.createDataFrame([("a", i, i, [x]) for i, x in enumerate((1.0, 1.1, 1.2))], "series string, us bigint, event_id bigint, intervals array<double>")
    assert [r.hrv for r in series.heart_rate_variability(df).orderBy("us").collect()] == [None, 100.0, 100.0]


def test_hrv_of_odd_intervals(spark):
    bad = [None, float("nan"), float("inf"), -float("inf"), 1e300, -1.0, 0.2995, 2.0005]
    assert kernels.HrvWindow(4).push([1.0, *bad, 1.1]) == 100 and [kernels.beat_ms(x) for x in (0.2996, 2.0004)] == [300, 2000]
    df = spark.createDataFrame([("a", i, i, x) for i, x in enumerate(([1.0, None], None, [], bad, [1.1]))] + [(None, 0, 9, [0.5]), (None, 1, 10, [0.6])], "series string, us bigint, event_id bigint, intervals array<double>")
    got = {(r.series, r.us): r.hrv for r in series.heart_rate_variability(df).collect()}
    assert got == {("a", 0): None, ("a", 1): None, ("a", 2): None, ("a", 3): None, ("a", 4): 100.0, (None, 0): None, (None, 1): 100.0}
    assert series.heart_rate_variability(df.limit(0)).count() == 0


def test_beats_of_a_stretch_compose():
    """For every state before a stretch, its map gives what going through it beat by beat gives."""
    rng = np.random.default_rng(9)
    for size, spread in ((0, 1), (1, 400), (5, 900), (40, 300), (300, 60), (300, 900)):
        beats = np.clip(1000 + np.cumsum(rng.integers(-spread, spread + 1, size)) % 1700, 300, 2000).tolist()
        held = kernels.BeatMap(6)
        for x in beats:
            held.push(x)
        packed = held.packed()
        assert len(packed[0]) < 60 or size > 40
        for state in [None, *range(300, 2001, 7)]:
            before = [] if state is None else [310, state]
            plain = kernels.HrvWindow(6, before)
            plain.push([x / 1000 for x in beats])
            assert kernels.beats_after(before, packed, 6) == list(plain.kept)


def test_hrv_over_many_stretches(spark):
    rng = np.random.default_rng(10)
    rows = []
    for s, m in (("hot", 6000), (None, 900), ("b", 1), ("c", 40)):
        beats = np.clip(0.9 + np.cumsum(rng.normal(0, 0.06, m)) % 1.2, 0.2, 2.2)
        rows += [(s, int(u), i, [] if i % 7 == 0 else [float(x), float("nan")] if i % 5 == 0 else [float(x)]) for i, (u, x) in enumerate(zip(np.sort(rng.integers(0, 10**6, m)), beats))]
    df = spark.createDataFrame(rows, "series string, us bigint, event_id bigint, intervals array<double>").repartition(6)
    got = {(r.series, r.event_id): r.hrv for r in series.heart_rate_variability(df).collect()}
    assert len(got) == len(rows)
    for s in ("hot", None, "b", "c"):
        w = kernels.HrvWindow()
        for _, _, i, x in sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[2])):
            assert got[s, i] == w.push(x)


@pytest.mark.parametrize("hot", ["hot", None])
def test_hrv_cuts_long_series_only(spark, hot):
    """Rows of short series are shuffled once and have no maps; a long one, the null one too, is cut as before. Rows without a time, and rows that come twice."""
    rng = np.random.default_rng(21)
    rows = [(f"s{i}", int(u), int(u) % 7, [0.7 + (u * 37 % 100) / 400]) for i in range(60) for u in rng.integers(0, 40, 30).tolist()]  # equal times have equal rows
    rows += [("s1", None, 3, [0.9]), ("s1", None, 4, None), *rows[:5]]
    more = [(hot, u, 0, [0.6 + float(x)]) for u, x in enumerate(rng.random(900) / 3)]
    exchanges = []
    for given, cut in ((rows, []), ([*rows, *more], [hot])):
        df = spark.createDataFrame(given, "series string, us bigint, event_id bigint, intervals array<double>").repartition(3)
        assert series.long_series(df, "series") == cut
        out = series.heart_rate_variability(df)
        exchanges.append(out._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression"))
        want = []
        for s in {r[0] for r in given}:
            w = kernels.HrvWindow()
            want += [(s, u, i, w.push(x or ())) for _, u, i, x in sorted((r for r in given if r[0] == s), key=lambda r: (-1 if r[1] is None else r[1], r[2]))]
        assert Counter(tuple(r) for r in out.collect()) == Counter(want)
    assert exchanges == [1, 3] and series.long_series(df.limit(0), "series") == []


def test_stretches_hold_equal_shares(spark):
    """Wherever rows lie in time: one row of 1970 among those of a month, rows without a time, an empty table."""
    df = spark.range(20_000).select(F.lit("a").alias("series"), (F.col("id") * 130_000_000 + 1_704_067_200_000_000).alias("us"), F.col("id").alias("event_id"), F.lit(1.0).alias("value"))
    odd = df.unionByName(spark.createDataFrame([("a", 0, -1, 1.0), ("a", None, -2, 1.0)], S))
    counts = [r["count"] for r in series.stretched(odd, "us").groupBy("_part").count().collect()]
    assert max(counts) <= 2 * 20_000 / (len(counts) - 1) and len(counts) == series.STRETCHES * int(spark.conf.get("spark.sql.shuffle.partitions")) + 1
    got = {r.event_id: r.seq for r in series.numbered(odd).collect()}
    assert got[-2] == 0 and got[-1] == 1 and got[19_999] == 20_001
    assert series.numbered(odd.limit(0)).count() == 0 and series.splitters(df.limit(0), "us") == []
    same = [r._part for r in series.stretched(df, "us", [1.0, 1.0]).select("_part").distinct().collect()]
    assert same == [1]


def test_null_series_is_a_series(spark):
    """Every operator gives the null series what it gives another one with the same rows."""
    rng = np.random.default_rng(7)
    values = rng.standard_normal(40).tolist()
    df = spark.createDataFrame([(s, i * 500_000, i, v) for s in (None, "a") for i, v in enumerate(values)], S)
    stages = design.cascade("lowpass", "butterworth", 1, 100.0, 12.0)
    placed = series.numbered(df)
    filt = design.polyphase(100.0, 40.0, 8)
    runs = {
        "epochs": resample.epochs(df, 1_000_000, 3), "own epochs": resample.epochs(df, 1_000_000, 3, own_span=True), "lttb": resample.lttb(df, 7), "linear": resample.linear(df.withColumn("ms", F.col("us") / 1000.0), 11),
        "iir": filters.iir(placed, stages)[0], "state": filters.iir(placed, stages)[1], "filtfilt": filters.filtfilt(placed, stages), "fir": filters.fir(placed, [0.5, 0.25]), "fir_filtfilt": filters.fir_filtfilt(placed, [0.5, 0.25, 0.1]),
        "polyphase": resample.polyphase(placed, filt), "percentile": series.percentile(df, "series", 0.3), "rmssd": series.rmssd(df), "monotonic": series.monotonic(df, "us"), "numbered": placed, "autoscale": view.autoscale(df, -9.0, 9.0),
    }
    for name, out in runs.items():
        rest = [c for c in out.columns if c != "series"]
        own = {s: sorted(tuple(r[c] for c in rest) for r in out.collect() if r.series == s) for s in (None, "a")}
        assert own["a"] and own[None] == own["a"], name
    assert not any(r.is_filled for r in runs["epochs"].collect())


def test_bounds_reach_the_scan(spark, tmp_path):
    for kind in ("timestamp", "timestamp_ntz"):
        path = f"{tmp_path}/{kind}"
        spark.range(10).select(F.timestamp_micros(F.col("id") * 1_000_000).cast(kind).alias("ts"), "id").write.parquet(path)
        got = series.viewport(spark.read.parquet(path), 2_000_000, 5_000_000, "ts")
        assert sorted(r.id for r in got.collect()) == [3, 4, 5]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThan(ts" in plan and "LessThanOrEqual(ts" in plan


def test_linear_over_many_stretches(spark):
    rng = np.random.default_rng(6)
    t, v = np.cumsum(rng.integers(1, 50, 3000)).astype(float), rng.standard_normal(3000)
    for n in (1, 2, 7, 3000, 5000):
        df = spark.createDataFrame([("a", float(a), i, float(b)) for i, (a, b) in enumerate(zip(t, v))], "series string, ms double, event_id bigint, value double").repartition(4)
        long, short = (sorted((r.k, r.ms, r.value) for r in resample.linear(df, n, long=x).collect()) for x in (True, False))
        assert long == short and len(long) == n


def test_own_spans_of_epochs(spark):
    df = spark.createDataFrame([("a", 5_500, 1, 1.0), ("a", 8_500, 2, 3.0), ("b", 99_100, 3, 2.0)], S)
    got = sorted((r.series, r.record, r.value, r.is_filled) for r in resample.epochs(df, 1000, 1, own_span=True).collect())
    assert got == [("a", 0, 1.0, False), ("a", 1, 0.0, True), ("a", 2, 0.0, True), ("a", 3, 3.0, False), ("b", 94, 2.0, False)]


def plain_throttle(times, wait):
    out, last = [], None
    for i, t in enumerate(times):
        if last is None or t >= last + wait:
            out.append(i)
            last = t
    return out


def test_throttle_of_a_stretch_composes():
    rng = np.random.default_rng(14)
    for size, top, wait in ((1, 5, 3), (40, 30, 7), (200, 1000, 100), (200, 1000, 3), (50, 10, 100), (30, 30, 0)):
        t = np.sort(rng.integers(0, top, size)).astype(np.int64)
        for pieces in (1, 2, 5):
            held = kernels.ThinMap(wait)
            for part in np.array_split(t, pieces):
                held.push(part)
            for last in [None, *range(-2 * wait - 2, int(t[0]))]:
                ahead = [] if last is None else [last]
                all_of = [*ahead, *t.tolist()]
                kept = plain_throttle(all_of, wait)
                assert kernels.last_after(last, held.packed(), wait) == all_of[kept[-1]]
                assert (np.flatnonzero(kernels.thinned(t, wait, last)) + len(ahead)).tolist() == kept[len(ahead) :]


def test_throttle_over_many_stretches(spark):
    rng = np.random.default_rng(15)
    rows = [(s, int(u), i, 0.0) for s, m, top in (("hot", 5000, 10**6), (None, 400, 10**6), ("b", 1, 10), ("c", 300, 20)) for i, u in enumerate(np.sort(rng.integers(0, top, m)))]
    df = spark.createDataFrame([*rows, ("c", None, 999, 0.0)], S).repartition(5)
    for wait in (0, 1, 700, 10**7):
        got = series.throttled(df, wait)
        assert got.columns == df.columns
        found = {}
        for r in got.collect():
            found.setdefault(r.series, []).append(r.event_id)
        for s in ("hot", None, "b", "c"):
            own = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[2]))
            assert sorted(found[s]) == [own[i][2] for i in plain_throttle([r[1] for r in own], wait)], (s, wait)
    with pytest.raises(ValueError):
        series.throttled(df, -1)


def test_window_that_follows(spark):
    ends = [5, 31_000, 29_000, 60_000, 60_001, 10]
    df = spark.createDataFrame([(None, i, i, e) for i, e in enumerate(ends)], "series string, us bigint, event_id bigint, end_ms bigint")
    got = [(r.lo, r.hi) for r in view.followed(df, "end_ms").orderBy("us").collect()]
    end, want = 0, []
    for e in ends:
        end = -(-e // 30_000) * 30_000 if e > end else end
        want.append((end - 30_000, end))
    assert got == want


def test_quantise(spark):
    args = [F.lit(x) for x in (-100.0, 100.0, -100.0, 100.0)]
    cases = {-2.5: -2, 2.5: 3, 1e9: 100, -1e9: -100, float("nan"): 0, None: 0}
    df = spark.createDataFrame([(v, w) for v, w in cases.items()], "v double, w int").withColumn("d", sig.physical_to_digital(F.col("v"), *args))
    assert all(r.d == r.w for r in df.collect())
    assert one(spark, sig.digital_to_physical(F.lit(5), F.lit(0.0), F.lit(1.0), F.lit(3), F.lit(3)))[0] == 0.0


@pytest.mark.parametrize("x,y,roll,incl", [(0, 0, 0, 0), (0, 90, 90, 0), (0, -90, -90, 0), (180, 0, -180, 0), (90, 0, 0, 90), (-45, 0, 0, 45)])
def test_body_position(spark, x, y, roll, incl):
    a, b = sig.body_position(F.lit(float(x)), F.lit(float(y)))
    got = one(spark, a, b)
    assert got[1] == pytest.approx(incl, abs=1e-6) and (abs(x) == 90 or got[0] == pytest.approx(roll, abs=1e-6))


def test_frames(spark):
    hr = one(spark, sig.heart_rate_frame(F.lit(bytes([0b11111, 0x2C, 0x01, 5, 1, 0, 4, 0, 2]))))[0]
    assert (hr.heart_rate, hr.contact, hr.energy, hr.rr) == (300, True, 261, [1.0, 0.5])
    hr = one(spark, sig.heart_rate_frame(F.lit(bytes([0, 61]))))[0]
    assert (hr.heart_rate, hr.contact, hr.energy, hr.rr) == (61, None, None, [])
    assert one(spark, sig.temperature_frame(F.lit((-250).to_bytes(2, "little", signed=True))))[0] == -2.5
    assert one(spark, sig.is_imu_frame(F.lit(b"\x55\x61" + bytes(18))), sig.is_imu_frame(F.lit(b"\x55\x62" + bytes(18))), sig.is_imu_frame(F.lit(b"\x55\x61")))[:] == (True, False, False)


def test_annotations(spark):
    block = F.concat(F.lit("+9\x14\x14\x00"), sig.build_tal(F.lit(9.5), F.lit(None).cast("double"), F.lit("Apnoea")), sig.build_tal(F.lit(-1.0), F.lit(2.25), F.lit("Turn")), F.lit("\x00\x00"))
    got, first = one(spark, sig.parse_tals(block), sig.first_onset(block))
    assert [tuple(a) for a in got] == [(9.5, None, "Apnoea"), (-1.0, 2.25, "Turn")] and first == 9.0
    assert one(spark, sig.parse_tals(F.lit("")), sig.first_onset(F.lit("")))[:] == ([], None)
    years = one(spark, *[F.year(sig.parse_header_start(F.lit(f"02.03.{yy}"), F.lit("04.05.06"))) for yy in ("84", "85")])
    assert tuple(years) == (2084, 1985)


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_every_query_with_its_sql(spark):
    """Every query at the smallest scale has the columns and the number of rows that its SQL gives."""
    import duckdb

    from hypnoflow.plans import catalog

    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(SMALL):
        db.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    for name, run in catalog.QUERIES.items():
        got = run(spark, SMALL).toPandas()
        if name in catalog.SQL:
            want = db.sql(catalog.SQL[name]).df()
            assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want), name
        else:
            assert len(got), name


def test_epochs_over_the_whole_span(spark):
    df = spark.createDataFrame([("a", 5_500, 1, 1.0), ("b", 9_100, 2, 2.0)], "series string, us bigint, event_id bigint, value double")
    got = {(r.series, r.record, r.value) for r in resample.epochs(df, 1000, 1).collect()}
    assert got == {(s, r, {("a", 0): 1.0, ("b", 4): 2.0}.get((s, r), 0.0)) for s in "ab" for r in range(5)}
    assert resample.epochs(df.limit(0), 1000, 1).count() == 0


def test_long_series_in_many_stretches(spark):
    """Numbers, as-of look-ups and guarded times of a series that most rows belong to, over many partitions."""
    rng = np.random.default_rng(11)
    n = 60_000
    us = np.sort(rng.integers(0, 5_000_000, n))
    who = np.where(rng.random(n) < 0.8, "hot", np.where(rng.random(n) < 0.5, "a", None))
    rows = [(w, int(u), i, float(i)) for i, (w, u) in enumerate(zip(who, us))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.createDataFrame(rows, S).repartition(7)
        got = {r.event_id: r.seq for r in series.numbered(df).collect()}
        want, count = {}, {}
        for w, _, i, _ in rows:
            want[i] = count[w] = count.get(w, -1) + 1
        assert got == want
        for r in series.rmssd(df).collect():
            v = np.array([x for w, _, _, x in rows if w == r.series])
            assert abs(r.rmssd - math.sqrt((np.diff(v) ** 2).mean())) < 1e-9
        late = df.withColumn("late", F.col("us") - F.pmod(F.xxhash64("event_id"), F.lit(900_000)))
        top, expected = {}, {}
        for r in sorted(late.collect(), key=lambda r: (r.us, r.event_id)):
            expected[r.event_id] = top[r.series] = max(top.get(r.series, -(1 << 62)), r.late)
        assert {r.event_id: r.guarded_us for r in series.monotonic(late, "late").collect()} == expected
        probes = spark.createDataFrame([(w, int(u)) for w in ("hot", "a", None, "none") for u in rng.integers(-100_000, 5_100_000, 400)], "series string, us bigint")
        found = {(r.series, r.us): (r.value, r.found_us) for r in series.asof(probes, df).collect()}
        own = {w: [(u, v) for x, u, _, v in rows if x == w] for w in ("hot", "a", None, "none")}
        for (w, u), answer in found.items():
            at = np.searchsorted([x for x, _ in own[w]], u, side="right") - 1
            assert answer == ((own[w][at][1], own[w][at][0]) if at >= 0 else (None, None))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
