"""The live processors with state and timers of our own, dealt to batches at random, against the batch operators' rules."""

import numpy as np
import pandas as pd
import pytest

from hypnoflow.functions import design, kernels
from hypnoflow.streaming import folds, live

SECOND = 1_000_000


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.now


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Listed:
    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(list(self.rows))

    def put(self, rows):
        self.rows = list(rows)

    def appendValue(self, row):  # noqa: N802
        self.rows.append(row)

    def clear(self):
        self.rows = []


class Mapped(dict):
    getValue, removeKey, updateValue = dict.get, dict.pop, dict.__setitem__  # noqa: N815


class Handle:
    """State and timers of one key."""

    def __init__(self):
        self.timers, self.states = set(), {}

    def getValueState(self, name, schema):  # noqa: N802
        return self.states.setdefault(name, Value())

    def getListState(self, name, schema):  # noqa: N802
        return self.states.setdefault(name, Listed())

    def getMapState(self, name, key, schema):  # noqa: N802
        return self.states.setdefault(name, Mapped())

    def listTimers(self):  # noqa: N802
        return iter(sorted(self.timers))

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


def run(make, batches, key=("t",)):
    """What a processor puts out for batches of (rows, watermark in ms after them); it is made anew for every batch, as after a restart."""
    handle, out = Handle(), []
    for frame, mark in batches:
        processor = make()
        processor.init(handle)
        if len(frame):
            out += list(processor.handleInputRows(key, iter([frame[: len(frame) // 2], frame[len(frame) // 2 :]]), Clock(mark)))
        while any(t <= mark for t in handle.timers):
            handle.timers -= {t for t in handle.timers if t <= mark}
            out += list(processor.handleExpiredTimer(key, Clock(mark), None))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame()


def dealt(rows, rng, n=6, late_us=20 * SECOND, end_us=10**12):
    """rows in n batches, none later than the watermark, each batch in no order, with the watermark after it."""
    rows = rows.assign(seen=rows["us"] + rng.integers(0, late_us, len(rows)))
    cuts = np.sort(rng.integers(0, int(rows["seen"].max()) + 1, n - 1)).tolist()
    out, newest, done = [], 0, -1
    for hi in [*cuts, int(rows["seen"].max())]:
        part = rows[(rows["seen"] > done) & (rows["seen"] <= hi)]
        newest, done = max(newest, int(part["us"].max()) if len(part) else 0), hi
        out.append((part.drop(columns="seen").sample(frac=1, random_state=1), max(newest - late_us, 0) // 1000))
    return [*out, (rows.drop(columns="seen").head(0), end_us // 1000)]


def processor(fold, state, columns, *arguments):
    return lambda: live.in_order_processor(fold, arguments, state, columns)


def test_filters_and_beats_in_order():
    rng = np.random.default_rng(1)
    stages = design.cascade("lowpass", "butterworth", 2, 100.0, 12.0)
    for seed in range(5):
        n = 300
        rows = pd.DataFrame({"us": np.sort(rng.integers(1, 200 * SECOND, n)), "event_id": np.arange(n), "value": rng.standard_normal(n)})
        rows.loc[10:14, "us"] = rows.loc[10, "us"]  # equal times go by event_id
        rows = rows.sort_values(["us", "event_id"])
        got = run(processor("Filter", "z array<double>", {"value": "double"}, stages), dealt(rows, np.random.default_rng(seed)))
        assert got["event_id"].tolist() == rows["event_id"].tolist()
        assert np.allclose(got["y"], kernels.iir(stages, rows["value"].to_numpy())[0], atol=1e-9)
        beats = rows.assign(intervals=[None if i % 9 == 0 else np.array([0.7 + 0.01 * (i % 50), float("nan")]) for i in range(n)]).drop(columns="value")
        got = run(processor("Beats", "kept array<int>", {"intervals": "array<double>"}, 30), dealt(beats, np.random.default_rng(seed)))
        w = kernels.HrvWindow()
        want = [w.push(() if x is None else x) for x in beats["intervals"]]
        assert got["event_id"].tolist() == beats["event_id"].tolist() and np.allclose(got["hrv"], np.array(want, float), equal_nan=True)


def test_rows_in_order_ask_the_state_little(monkeypatch):
    """Calls of the state for a group's frame and for its timer, what is held, and the one timer that waits; a null series, a null measurement, an empty one."""
    calls = []
    for kind, names in ((Value, ("exists", "get", "update")), (Listed, ("exists", "get", "put", "appendValue", "clear")), (Handle, ("registerTimer", "deleteTimer"))):
        for name in names:
            monkeypatch.setattr(kind, name, lambda self, *x, plain=getattr(kind, name), name=name: (calls.append(name), plain(self, *x))[1])
    handle, beats = Handle(), processor("Beats", "kept array<int>", {"intervals": "array<double>"}, 30)()
    beats.init(handle)
    frame = pd.DataFrame({"event_id": range(5), "series": ["a", None, "a", None, "a"], "us": np.array([1, 2, 3, 100, 101]) * SECOND, "intervals": [np.array([0.7]), None, np.array([0.8, np.nan]), np.array([]), np.array([0.9])]})
    assert not list(beats.handleInputRows((5,), iter([frame, frame.head(0)]), Clock(0)))
    assert calls == ["appendValue", "get", "registerTimer", "update"] and handle.timers == {1000}
    held = folds.unpacked([row[0] for row in handle.states["held"].rows])
    assert held.column_names == ["series", "us", "event_id", "intervals"] and not held.schema.metadata and held["intervals"].null_count == 1
    for now, timers, ids, hrv in ((50_000, {100_000}, [0, 2, 1], [None, 100.0, None]), (200_000, set(), [4, 3], [100.0, None])):
        calls.clear()
        handle.timers.clear()
        (out,) = list(beats.handleExpiredTimer((5,), Clock(now), None))
        assert len(calls) <= 6 and handle.timers == timers
        assert out["event_id"].tolist() == ids and [None if pd.isna(x) else x for x in out["hrv"]] == hrv


def plain_repeats(readings, stale, beat, until):
    out = [(u, v, False) for u, v in readings]
    for i, (u, v) in enumerate(readings):
        end = readings[i + 1][0] if i + 1 < len(readings) else until + 1
        out += [(u + k * beat, v, True) for k in range(1, stale // beat + 1) if u + k * beat < end]
    return sorted(out)


def test_repeats_do_not_depend_on_batches():
    readings = [(SECOND, 1.0), (3 * SECOND, 2.0), (6 * SECOND, 3.0), (6 * SECOND + 1, 4.0), (20 * SECOND, 5.0)]
    rows = pd.DataFrame({"us": [u for u, _ in readings], "event_id": range(5), "value": [v for _, v in readings]})
    made = processor("KeepAlive", "us bigint, value double, sent bigint", {"value": "double"}, 3 * SECOND, SECOND)
    for seed in range(8):
        for end in (20, 21, 22, 40):
            got = run(made, dealt(rows, np.random.default_rng(seed), end_us=end * SECOND))
            assert sorted(got.itertuples(index=False, name=None), key=lambda r: r[1:]) == [("t", *r) for r in plain_repeats(readings, 3 * SECOND, SECOND, end * SECOND)]
    # the reading of 2 s comes after that of 5 s
    late = [(rows.iloc[[0]].assign(us=0 + SECOND // 2, value=1.0), 0), (rows.iloc[[0]].assign(us=5 * SECOND, value=3.0), 0), (rows.iloc[[0]].assign(us=2 * SECOND, value=2.0), 1000), (rows.head(0), 30_000)]
    got = run(made, late)
    assert sorted((u, v, r) for _, u, v, r in got.itertuples(index=False, name=None)) == plain_repeats([(SECOND // 2, 1.0), (2 * SECOND, 2.0), (5 * SECOND, 3.0)], 3 * SECOND, SECOND, 30 * SECOND)


def test_repeats_by_the_clock():
    handle, processor = Handle(), live.keep_alive_processor(3 * SECOND, SECOND)
    processor.init(handle)
    frame = pd.DataFrame({"series": ["t", "t"], "us": [2, 1], "value": [36.5, 36.0]})
    out = list(processor.handleInputRows(("t",), iter([frame]), Clock(10_000)))
    assert out[0]["value"].tolist() == [36.0, 36.5] and handle.timers == {11_000}
    # an older reading is passed on and changes nothing
    assert list(processor.handleInputRows(("t",), iter([frame.tail(1)]), Clock(10_500)))[0]["value"].tolist() == [36.0]
    repeats = []
    for now in (11_000, 12_000, 13_000, 14_000):
        handle.timers.clear()
        repeats += [(f["us"][0], f["value"][0]) for f in processor.handleExpiredTimer(("t",), Clock(now), None)]
    assert repeats == [(11_000_000, 36.5), (12_000_000, 36.5), (13_000_000, 36.5)] and not handle.timers
    assert not list(processor.handleInputRows(("t",), iter([frame.head(0)]), Clock(20_000))) and not handle.timers


def test_linear_points_are_those_of_the_operator(spark):
    from hypnoflow.operators import resample

    rng = np.random.default_rng(4)
    for size, n in ((1, 1), (1, 4), (2, 2), (2, 7), (5, 1), (6, 1), (6, 2), (40, 12), (12, 40), (3, 5)):
        t = np.sort(rng.integers(0, 30_000, size)) / 1000.0
        t[: size // 3] = t[0]
        v = rng.standard_normal(size)
        df = spark.createDataFrame([("a", float(a), i, float(b)) for i, (a, b) in enumerate(zip(t, v))], "series string, ms double, event_id bigint, value double")
        want = sorted((r.k, r.ms, r.value) for r in resample.linear(df, n, long=False).collect())
        ms, value = kernels.linear_points(t, v, n)
        assert [(i, a, b) for i, (a, b) in enumerate(zip(ms.tolist(), value.tolist()))] == want


def test_records_of_epochs_that_are_over():
    """Two signals of two samples, an epoch without samples, rows before the start and of other signals, time that goes on."""
    rows = pd.DataFrame([(5, 0, "a", 9.0), (10, 1, "a", 1.0), (15, 2, "a", 3.0), (19, 3, "b", 4.0), (31, 4, "a", 5.0), (33, 5, "a", 7.0), (34, 6, "c", 1.0)], columns=["us", "event_id", "signal", "value"])
    rows["us"] *= SECOND
    made = processor("Epochs", "record bigint", {"signal": "string", "value": "double"}, (("a", 2), ("b", 2)), 10 * SECOND, 10 * SECOND)
    want = [(0, 0, [1.0, 3.0], False), (0, 1, [4.0, 4.0], False), (1, 0, [0.0, 0.0], True), (1, 1, [0.0, 0.0], True), (2, 0, [5.0, 7.0], False), (2, 1, [0.0, 0.0], True), (3, 0, [0.0, 0.0], True), (3, 1, [0.0, 0.0], True)]
    for seed in range(6):
        got = run(made, dealt(rows, np.random.default_rng(seed), end_us=50 * SECOND - 1000))
        assert [(r.record, r.signal_index, r.values, r.is_filled) for r in got.itertuples(index=False)] == want[:6]
        got = run(made, dealt(rows, np.random.default_rng(seed), end_us=50 * SECOND))
        assert [(r.record, r.signal_index, r.values, r.is_filled) for r in got.itertuples(index=False)] == want


@pytest.mark.parametrize("taken", [1, 50, 10**6])
def test_records_hold_rows_by_epoch(monkeypatch, taken):
    """The same records as from all rows at once, while no more than an epoch's rows go to the fold."""
    rng = np.random.default_rng(taken)
    n, signals, start = 900, (("a", 3), ("b", 2)), 10 * SECOND
    rows = pd.DataFrame({"us": rng.integers(0, 300, n) * SECOND, "event_id": rng.permutation(n), "signal": rng.choice(["a", "b", "c", None], n), "value": rng.standard_normal(n)})
    rows = rows[(rows["us"] < 100 * SECOND) | (rows["us"] >= 140 * SECOND)]  # four epochs without samples
    whole = run(processor("Epochs", "record bigint", {"signal": "string", "value": "double"}, signals, 10 * SECOND, start), dealt(rows, rng, end_us=320 * SECOND))
    seen, plain = [], folds.Epochs.rows
    monkeypatch.setattr(folds.Epochs, "rows", lambda self, key, state, given, until: (seen.append(len(given["us"])), plain(self, key, state, given, until))[1])
    got = run(lambda: live.epochs_processor(signals, 10 * SECOND, start, taken, 7), dealt(rows, rng, end_us=320 * SECOND))
    assert got.to_dict("list") == whole.to_dict("list") and len(got) == 62
    assert max(seen) < 60 and sum(seen) == (rows["us"] >= start).sum()


def test_records_cost_a_frame_for_many_and_a_value_for_a_chunk(monkeypatch):
    """No frame is made for each record, and what is held of an epoch is one value for each time it is dealt rows, not one for each sample; a null recording and null values."""
    frames, held = [], []
    monkeypatch.setattr(Mapped, "updateValue", lambda self, key, value: (held.append(value), self.__setitem__(key, value))[1])
    plain = pd.DataFrame.__init__
    rows = pd.DataFrame({"us": np.arange(2000) * SECOND // 2, "event_id": np.arange(2000), "signal": ["a", "b"] * 1000, "value": [None, *np.arange(1999.0)]})
    batches = [(rows, 0), (rows.head(0), 1000 * 1000)]
    monkeypatch.setattr(pd.DataFrame, "__init__", lambda self, *a, **b: (frames.append(1), plain(self, *a, **b))[1])
    got = run(lambda: live.epochs_processor((("a", 10), ("b", 10)), 10 * SECOND, 0, 10**6, 50), batches, (None,))
    assert len(got) == 200 and got["recording"].isna().all() and np.isnan(got["values"][0][0]) and got["values"][199][-1] == 1998.0
    assert len(held) == 100 and all(len(x) == 1 and isinstance(x[0], bytes) for x in held)
    assert len(frames) < 20


@pytest.mark.parametrize("chunk", [1, 4, 7, 1000])
def test_sound_goes_on_from_batch_to_batch(spark, chunk):
    from hypnoflow.operators import resample

    rng = np.random.default_rng(8)
    filt, stages = design.polyphase(100.0, 40.0, 8), design.cascade("lowpass", "butterworth", 1, 100.0, 30.0)
    seq = np.setdiff1d(np.arange(400), np.arange(150, 260))
    rows = pd.DataFrame({"us": (seq + 1) * 10_000, "event_id": seq, "value": rng.standard_normal(len(seq))})
    y, _ = kernels.iir(stages, rows["value"].to_numpy())
    slow = resample.polyphase(spark.createDataFrame([("t", int(i), float(v)) for i, v in zip(seq, y)], "series string, seq bigint, value double"), filt)
    want = {r.chunk: r for r in resample.chunked(slow, chunk).collect()}
    made = processor("Sound", "z array<double>", {"value": "double"}, filt, tuple(stages), chunk, 10 * SECOND)
    for seed in range(4):
        got = run(made, dealt(rows, np.random.default_rng(seed), late_us=SECOND, end_us=10 * SECOND))
        assert sorted(got["chunk"]) == sorted(want) and len(got) == len(want)
        for r in got.itertuples(index=False):
            assert r.samples == want[r.chunk].samples and abs(r.t - want[r.chunk].t) < 1e-9 and np.allclose(r.values, want[r.chunk].values, atol=1e-9)


def test_ring_pushes_out_the_oldest():
    rng = np.random.default_rng(2)
    for capacity in (1, 2, 7, 100):
        rows = pd.DataFrame({"us": np.sort(rng.integers(0, 10**9, 60)), "event_id": np.arange(60), "value": rng.standard_normal(60)})
        cuts = [0, *sorted(rng.integers(0, 61, 5).tolist()), 60]
        batches = [(rows.iloc[a:b].sample(frac=1, random_state=3), 0) for a, b in zip(cuts, cuts[1:])]
        got = run(lambda: live.ring_processor(capacity, None, 10**10), [*batches, (rows.head(0), 10**7)])
        assert got["event_id"].tolist() == list(range(60)) and got["n"].tolist() == list(range(60)) and got["us"].tolist() == rows["us"].tolist()
        assert got["evicted"].tolist() == [i < 60 - capacity for i in range(60)]
        without = run(lambda: live.ring_processor(capacity, None, None), batches)
        assert len(without) == max(60 - capacity, 0)


def test_ring_lets_old_rows_go():
    rows = pd.DataFrame({"us": [0, 10, 20, 100, 105, 300], "event_id": range(6), "value": 1.0})
    batches = [(rows.iloc[[0, 1, 2]], 0), (rows.iloc[[3]], 0), (rows.iloc[[4, 5]], 0)]
    got = run(lambda: live.ring_processor(4, 85, 1_000_000), [*batches, (rows.head(0), 2_000)])
    assert got["us"].tolist() == [0, 10, 20, 100, 105, 300] and got["evicted"].tolist() == [True] * 5 + [False]


@pytest.mark.parametrize("capacity", [0, -1, 1.5, float("nan"), True, None])
def test_ring_capacity(spark, capacity):
    with pytest.raises(ValueError):
        live.ring_stream(spark.range(1), capacity)


def test_rows_without_values(spark):
    """A fold with nothing to do yet puts nothing out, and waits for what it holds."""
    keep = folds.KeepAlive(3, 1)
    assert keep.rows(("t",), None, {"us": np.array([], np.int64), "value": np.array([])}, 5) == (None, [])
    assert folds.Epochs([("a", 1)], 10, 100).cut(50) == 99 and folds.Epochs([("a", 1)], 10, 100).cut(109) == 109


FOLDS = {
    "Filter": ("z array<double>", {"value": "double"}, (design.cascade("lowpass", "butterworth", 2, 100.0, 12.0),)),
    "Beats": ("kept array<int>", {"intervals": "array<double>"}, (30,)),
    "KeepAlive": ("us bigint, value double, sent bigint", {"value": "double"}, (3 * SECOND, SECOND)),
    "Sound": ("z array<double>", {"value": "double"}, (design.polyphase(100.0, 40.0, 8), (), 4, 300 * SECOND)),
}


@pytest.mark.parametrize("fold", FOLDS)
def test_a_group_of_series_is_as_each_by_itself(monkeypatch, fold):
    """Series (the null one too) that come and end at other times, in one group, with a few calls of the state for each batch, whatever the number of series."""
    state, columns, arguments = FOLDS[fold]
    rng, calls = np.random.default_rng(11), []
    for name in ("put", "get", "appendValue"):
        monkeypatch.setattr(Listed, name, lambda self, *x, plain=getattr(Listed, name): (calls.append(1), plain(self, *x))[1])
    for many in (3, 30):
        n = 20 * many
        rows = pd.DataFrame({"series": rng.choice([None, *(f"s{i}" for i in range(many - 1))], n), "us": np.sort(rng.integers(1, 200 * SECOND, n)), "value": rng.standard_normal(n)})
        rows["event_id"] = rows.groupby("series", dropna=False).cumcount()
        rows["intervals"] = [None if i % 9 == 0 else np.array([0.7 + 0.01 * (i % 50)]) for i in range(n)]
        batches = dealt(rows[["series", "us", "event_id", *columns]], rng, end_us=400 * SECOND)
        calls.clear()
        got = run(processor(fold, state, columns, *arguments), batches, (5,))
        assert len(calls) <= 8 * len(batches)
        for name, own in got.groupby("series", dropna=False):
            name = None if pd.isna(name) else name
            alone = [(b[b["series"].isna() if name is None else b["series"] == name].drop(columns="series"), mark) for b, mark in batches]
            want = run(processor(fold, state, columns, *arguments), alone, (name,))
            order = [c for c in ("us", "chunk", "repeated") if c in want.columns]
            pd.testing.assert_frame_equal(own.sort_values(order, ignore_index=True), want.sort_values(order, ignore_index=True), rtol=1e-9)
        assert got["series"].nunique(dropna=False) == rows["series"].nunique(dropna=False) == many


@pytest.mark.parametrize("retain_us", [None, 30 * SECOND])
def test_rings_of_a_group_of_series(retain_us):
    """Each series' buffer pushes out and holds what one by itself does: the null series, and series that come after the buffers have been emptied."""
    rng, n = np.random.default_rng(13), 400
    rows = pd.DataFrame({"series": rng.choice([None, *(f"s{i}" for i in range(20))], n), "us": np.sort(rng.integers(1, 200 * SECOND, n)), "event_id": np.arange(n), "value": rng.standard_normal(n)})
    rows.loc[390:, "series"] = rng.choice(["late", "s1"], 10)
    cuts = [0, 50, 51, 300, 390, n]
    batches = [(rows.iloc[a:b].sample(frac=1, random_state=5), 0 if b < 390 else 250_000) for a, b in zip(cuts, cuts[1:])]

    def make():
        return live.ring_processor(7, retain_us, 240 * SECOND)

    got = run(make, batches, (5,))
    assert got["series"].nunique(dropna=False) == 22 and not got["evicted"].all() and got["evicted"].any()
    for name, own in got.groupby("series", dropna=False):
        name = None if pd.isna(name) else name
        alone = [(b[b["series"].isna() if name is None else b["series"] == name].drop(columns="series"), mark) for b, mark in batches]
        want = run(make, alone, (name,))[own.columns]
        assert own.sort_values("n").drop(columns="series").values.tolist() == want.sort_values("n").drop(columns="series").values.tolist()
        assert len(own) == (rows["series"].isna() if name is None else rows["series"] == name).sum() - (0 if name != "s1" else min((rows.loc[390:, "series"] == "s1").sum(), 7))


def test_repeats_by_stretches_of_time(spark):
    """A series is many groups: gaps shorter and longer than a stretch, readings at a stretch's edges, equal times, none of a value, ids or series that are null."""
    from hypnoflow.plans.live import finished, staged

    rng = np.random.default_rng(17)
    times = {"a": [*rng.integers(1, 120, 40).tolist(), 40, 40, 80, 300, 303, 311], 7: [39, 50], None: [5, 44]}
    rows = [(None if s is None else str(s), t * SECOND + SECOND // 2 * (t % 40 > 0), None if t == 303 else i, None if t == 311 else float(i)) for s, own in times.items() for i, t in enumerate(own)]
    samples = spark.createDataFrame(rows, "series string, us bigint, event_id bigint, value double")
    stream = live.keep_alive(staged(samples, 400 * SECOND, late_us=1000 * SECOND), 10, 3, "1000 seconds", 40)
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and "window" in plan
    got = finished(stream, spark).collect()
    for name in {r[0] for r in rows}:
        own = sorted(((u, -1 if i is None else i, v) for s, u, i, v in rows if s == name), key=lambda r: r[:2])
        want = [(u, v is None, v or 0.0, r) for u, v, r in [x for i, (u, _, v) in enumerate(own) for x in [(u, v, False), *[(u + k * 3 * SECOND, v, True) for k in range(1, 4) if i + 1 == len(own) or u + k * 3 * SECOND < own[i + 1][0]]]]]
        assert sorted((r.us, r.value is None, r.value or 0.0, r.repeated) for r in got if r.series == name and r.us < 400 * SECOND) == sorted(want)
    with pytest.raises(ValueError):
        live.keep_alive(samples, 10, 3, stretch=40)
