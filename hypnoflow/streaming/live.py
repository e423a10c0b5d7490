"""The live forms: epochs, records of epochs, filters, beat variability, sound at a lower rate, ring buffers, and keeping slow sensors alive.

All but the means of epochs and the ring buffers take their rows in order: rows are held in state until the watermark has passed them, however they
are dealt to batches and files, and then go through a fold (`folds`). So the results are those of the batch operators, whenever and in whatever
pieces the stream is run. Records of epochs hold their rows by epoch, so a task has one epoch's of a recording at a time. Rows that are later than `late` allows are dropped by the watermark, as everywhere in Spark, and so are rows without a
time, and those from before 1970, where watermarks begin. Series are dealt to groups (`GROUPS`), each of which is one key, as is a
recording in `record_stream`: what a task holds of a group are the rows that the watermark has not passed and the folds' states.
The processors need the RocksDB state store (`CONF`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.design import Biquad, Polyphase

#: Stands for a row without an event_id while it is held; such rows come before others of their time.
NO_ID = -(1 << 63)
CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def epoch_stream(samples: DataFrame, epoch: str = "30 seconds", late: str = "10 seconds") -> DataFrame:
    """window start, series, n, mean, min, max of each closed epoch, from (ts timestamp, series, value)."""
    w = F.window("ts", epoch)
    out = samples.withWatermark("ts", late).groupBy(w, "series").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    return out.select(F.col("window.start").alias("start"), "series", "n", "mean", "low", "high")


#: Groups that the series of a stream are dealt to, by a hash; what it costs to call a task is paid for a group, not for each of its series.
GROUPS = 1024


def in_order_processor(fold: str, arguments: tuple, state: str, columns: dict[str, str]) -> StatefulProcessor:
    """The processor's class is made here so that it travels whole: its runner starts before the package has been shipped."""

    class InOrder(StatefulProcessor):
        """Holds rows (series, us, event_id and the columns) until the watermark has passed them, and gives those of each series to the fold in order.

        A key is a group of series; frames without a series are of the one that the key names. Rows are held as Arrow streams, one for each frame."""

        def __init__(self, fold: str, arguments: tuple, state: str, columns: dict[str, str]) -> None:
            self.name, self.arguments, self.schema = fold, arguments, state
            self.columns = ["series", "us", "event_id", *columns]
            self.loaded = None

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.held = handle.getListState("held", "rows binary")
            self.states = handle.getListState("states", f"series string, {self.schema}")
            self.timer = handle.getValueState("timer", "at bigint")

        @property
        def fold(self):
            if self.loaded is None:
                from hypnoflow.streaming import folds

                self.loaded = getattr(folds, self.name)(*self.arguments)
            return self.loaded

        def wake(self, at: int) -> None:
            """A timer in time, and one only."""
            before = (self.timer.get() or (None,))[0]
            if before is None or at < before:
                if before is not None:
                    self.handle.deleteTimer(before)
                self.handle.registerTimer(at)
                self.timer.update((at,))

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            from hypnoflow.streaming import folds

            first = None
            for frame in rows:
                if len(frame):
                    frame = frame if "series" in frame.columns else frame.assign(series=key[0])
                    self.held.appendValue((folds.packed(frame, self.columns),))
                    first = min(x for x in (first, int(frame["us"].min())) if x is not None)
            if first is not None:
                self.wake(-(-first // 1000))
            yield from ()

        def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            from hypnoflow.streaming import folds

            until = 1000 * timerValues.getCurrentWatermarkInMs()
            held = [row[0] for row in self.held.get()]
            states = {row[0]: tuple(row[1:]) for row in self.states.get()}
            out, rest, due = folds.each_series(self.fold, self.columns[1:], held, states, until)
            if states:
                self.states.put([(name, *state) for name, state in states.items()])
            if rest is not None:
                self.held.put([(rest,)])
            elif held:
                self.held.clear()
            # the timer that was held has just gone off
            at = None if due is None else max(-(-due // 1000), timerValues.getCurrentWatermarkInMs() + 1)
            if at is not None:
                self.handle.registerTimer(at)
            self.timer.update((at,))
            if out is not None:
                yield out

        def close(self) -> None:
            pass

    return InOrder(fold, arguments, state, columns)


#: Rows that a task takes in before it deals them to the epochs that hold them, and records that it puts out at once.
TAKEN, PUT_OUT = 100_000, 256


def epochs_processor(signals: tuple, epoch_us: int, start_us: int, taken: int, put_out: int) -> StatefulProcessor:
    """Rows held by epoch; the class is made here so that it travels whole."""

    class ByEpoch(StatefulProcessor):
        """Holds a recording's rows in the state, by the epoch that they are in, and gives one epoch's at a time to the fold: a task never has more of a
        recording than an epoch and `taken` rows."""

        def __init__(self, signals: tuple, epoch_us: int, start_us: int, taken: int, put_out: int) -> None:
            self.signals, self.epoch_us, self.start_us, self.taken, self.put_out = signals, epoch_us, start_us, taken, put_out
            self.loaded = None

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            # an Arrow stream of us, event_id, signal (its place in the list of signals, -1 for others) and value
            self.held = handle.getMapState("held", "record bigint, chunk bigint", "rows binary")
            # of each epoch that rows are held of, how many chunks they are in
            self.index = handle.getValueState("index", "record array<bigint>, chunks array<bigint>")
            self.state = handle.getValueState("state", "record bigint")

        @property
        def fold(self):
            if self.loaded is None:
                from hypnoflow.streaming import folds

                self.loaded = folds.Epochs(self.signals, self.epoch_us, self.start_us)
            return self.loaded

        def chunks(self) -> dict[int, int]:
            return dict(zip(*self.index.get())) if self.index.exists() else {}

        def deal(self, frames: list[pd.DataFrame], chunks: dict[int, int], first: int) -> None:
            from hypnoflow.streaming import folds

            place = {label: i for i, (label, _) in enumerate(self.signals)}
            rows = {c: np.concatenate([f[c].to_numpy() for f in frames]) for c in ("us", "event_id", "value")}
            rows["signal"] = np.concatenate([f["signal"].map(place).fillna(-1).to_numpy(np.int32) for f in frames])
            record = (rows["us"] - self.start_us) // self.epoch_us
            order = np.argsort(record, kind="stable")
            order = order[np.searchsorted(record[order], first) :]  # what is before the start, or the next record, is left out
            table, record = pa.table({c: x[order] for c, x in rows.items()}), record[order]
            cuts = np.flatnonzero(np.diff(record, append=record[-1:] + 1)) + 1
            for a, b in zip([0, *cuts.tolist()], cuts.tolist()):
                r = int(record[a])
                self.held.updateValue((r, chunks.get(r, 0)), (folds.packed(table.slice(a, b - a)),))
                chunks[r] = chunks.get(r, 0) + 1

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            chunks, first = self.chunks(), self.state.get()[0] if self.state.exists() else 0
            earliest, frames, n = None, [], 0
            for frame in rows:
                if len(frame):
                    earliest = min(x for x in (earliest, int(frame["us"].min())) if x is not None)
                    frames, n = [*frames, frame], n + len(frame)
                    if n >= self.taken:
                        self.deal(frames, chunks, first)
                        frames, n = [], 0
            if frames:
                self.deal(frames, chunks, first)
            if earliest is not None:
                self.index.update((list(chunks), list(chunks.values())))
                self.handle.registerTimer(-(-earliest // 1000))
            yield from ()

        def rows_of(self, record: int, chunks: dict[int, int]) -> dict[str, np.ndarray]:
            """The epoch's rows in order; they are not held any more."""
            from hypnoflow.streaming import folds

            parts = [self.held.getValue((record, c))[0] for c in range(chunks.get(record, 0))]
            for c in range(chunks.pop(record, 0)):
                self.held.removeKey((record, c))
            if not parts:
                return {"us": np.zeros(0, np.int64), "event_id": np.zeros(0, np.int64), "signal": np.zeros(0, object), "value": np.zeros(0)}
            table = folds.unpacked(parts)
            rows = {c: table[c].to_numpy() for c in table.column_names}
            order = np.lexsort((rows["event_id"], rows["us"]))
            labels = np.array([*(label for label, _ in self.signals), None], object)
            return {c: x[order] for c, x in (rows | {"signal": labels[rows["signal"]]}).items()}

        def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            from hypnoflow.streaming import folds

            until, chunks, out = 1000 * timerValues.getCurrentWatermarkInMs(), self.chunks(), []
            first = self.state.get()[0] if self.state.exists() else 0
            after = max(self.fold.over(until), first)
            for r in range(first, after):
                out += self.fold.rows(key, (r,), self.rows_of(r, chunks), self.start_us + (r + 1) * self.epoch_us - 1)[1]
                if len(out) == self.put_out:
                    yield folds.together(out)
                    out = []
            self.state.update((after,))
            self.index.update((list(chunks), list(chunks.values())))
            self.handle.registerTimer(max(-(-self.fold.next((after,), None) // 1000), timerValues.getCurrentWatermarkInMs() + 1))
            if out:
                yield folds.together(out)

        def close(self) -> None:
            pass

    return ByEpoch(signals, epoch_us, start_us, taken, put_out)


def grouped(rows: DataFrame, processor: StatefulProcessor, out: str, time_mode: str = "eventTime") -> DataFrame:
    """What the processor makes of groups of series, with the series in their own type."""
    kind = rows.schema["series"].dataType
    # in the state a series is a string, which can be null where pandas' whole numbers cannot
    rows = rows.withColumn("series", F.col("series").cast("string")).withColumn("_group", F.pmod(F.hash("series"), F.lit(GROUPS)))
    done = rows.groupBy("_group").transformWithStateInPandas(processor, f"series string, {out}", "append", time_mode)
    done = done.withColumn("series", F.col("series").cast(kind))
    return done.withColumn("event_id", F.when(F.col("event_id") != NO_ID, F.col("event_id"))) if "event_id" in done.columns else done


def _in_order(samples: DataFrame, late: str, fold: str, arguments: tuple, state: str, columns: dict[str, str], out: str) -> DataFrame:
    # pandas has no whole numbers that are null
    told = F.coalesce(F.col("event_id").cast("bigint"), F.lit(NO_ID)).alias("event_id")
    rows = samples.where("us IS NOT NULL AND ts IS NOT NULL").select("series", "us", told, *columns, "ts").withWatermark("ts", late)
    return grouped(rows, in_order_processor(fold, arguments, state, columns), out)


def iir_stream(samples: DataFrame, stages: Sequence[Biquad], late: str = "10 seconds") -> DataFrame:
    """series, us, event_id, value, y from (series, us, event_id, value, ts): the batch filter's kernel, its state kept from batch to batch."""
    return _in_order(samples, late, "Filter", (tuple(stages),), "z array<double>", {"value": "double"}, "us bigint, event_id bigint, value double, y double")


def hrv_stream(samples: DataFrame, window: int = 30, late: str = "10 seconds") -> DataFrame:
    """series, us, event_id, hrv of every measurement (series, us, event_id, intervals, ts)."""
    return _in_order(samples, late, "Beats", (window,), "kept array<int>", {"intervals": "array<double>"}, "us bigint, event_id bigint, hrv double")


def record_stream(samples: DataFrame, signals: Sequence[tuple[str, int]], epoch_us: int, start_us: int, late: str = "10 seconds") -> DataFrame:
    """recording, signal_index, label, record, values, is_filled of each epoch that is over, from (recording, signal, us, event_id, value, ts).

    What a recorder writes every epoch: each of the signals (label, samples a record) resampled to its number of samples, zeros where it had
    none. Epochs count from start_us. A recording begins when its first sample comes, with all records since the start, and gives a record for every epoch
    from then on, samples or not.
    """
    out = "signal_index int, label string, record bigint, values array<double>, is_filled boolean"
    told = F.coalesce(F.col("event_id").cast("bigint"), F.lit(NO_ID)).alias("event_id")
    rows = samples.where("us IS NOT NULL AND ts IS NOT NULL").select("recording", "us", told, "signal", "value", "ts").withWatermark("ts", late)
    kind = samples.schema["recording"].dataType.simpleString()
    return rows.groupBy("recording").transformWithStateInPandas(epochs_processor(tuple(signals), epoch_us, start_us, TAKEN, PUT_OUT), f"recording {kind}, {out}", "append", "eventTime")


def sound_stream(samples: DataFrame, polyphase: Polyphase, stages: Sequence[Biquad] = (), chunk: int = 50, late: str = "10 seconds", drain_us: int | None = None) -> DataFrame:
    """series, chunk, t, samples, values from (series, us, event_id: the sample's number, value, ts): sound at the filter's rate, `chunk` samples at a time.

    Filter length and state go on from batch to batch, so the samples are those of the batch operators. The last chunk, which may not be full, is put
    out when the watermark passes drain_us.
    """
    state = "z array<double>, tail array<double>, there array<double>, begun bigint, n bigint, rest array<double>, rest_n array<bigint>, drained boolean"
    return _in_order(samples, late, "Sound", (polyphase, tuple(stages), chunk, drain_us), state, {"value": "double"}, "chunk bigint, t double, samples bigint, values array<double>")


def ring_processor(capacity: int, retain_us: int | None, drain_us: int | None) -> StatefulProcessor:
    """The ring buffers of a group of series; the class is made here so that it travels whole."""

    class Ring(StatefulProcessor):
        """What the buffers of a group hold (an Arrow stream, each series' oldest row first) and, for each series, what has been pushed: read and written once
        for each micro-batch that has rows of the group. Frames without a series are of the one that the key names."""

        def __init__(self, capacity: int, retain_us: int | None, drain_us: int | None) -> None:
            self.capacity, self.retain_us, self.drain_us = capacity, retain_us, drain_us

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.held = handle.getListState("held", "rows binary")
            # rows ever pushed, the newest time, whether the contents have been put out
            self.series = handle.getListState("pushed", "series string, pushed bigint, newest bigint, drained boolean")

        def contents(self) -> pd.DataFrame:
            from hypnoflow.streaming import folds

            return folds.unpacked([row[0] for row in self.held.get()]).to_pandas() if self.held.exists() else pd.DataFrame()

        def keep(self, rows: pd.DataFrame, pushed: dict[str | None, tuple[int, int, bool]]) -> None:
            from hypnoflow.streaming import folds

            self.series.put([(name, *state) for name, state in pushed.items()])
            self.held.put([(folds.packed(rows),)]) if len(rows) else self.held.clear()

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            from hypnoflow.streaming import folds

            frames = [f for f in rows if len(f)]
            if not frames:
                return
            batch = pd.concat(frames).sort_values(["us", "event_id"], kind="stable")
            batch = batch if "series" in batch.columns else batch.assign(series=key[0])
            pushed = {row[0]: tuple(row[1:]) for row in self.series.get()} if self.series.exists() else {}
            kept, out, fresh = folds.pushed(self.contents(), batch, pushed, self.capacity, self.retain_us)
            if fresh and self.drain_us is not None:
                self.handle.registerTimer(-(-self.drain_us // 1000))
            self.keep(kept, pushed)
            if len(out):
                yield out.assign(evicted=True)

        def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            pushed, rows = {row[0]: tuple(row[1:]) for row in self.series.get()}, self.contents()
            full = {name for name, state in pushed.items() if not state[2]}
            out = rows["series"].map(lambda name: (None if pd.isna(name) else name) in full).to_numpy(bool) if len(rows) else []
            self.keep(rows[~out] if len(rows) else rows, {name: (n, newest, True) for name, (n, newest, _) in pushed.items()})
            if np.any(out):
                yield rows[out].assign(evicted=False)

        def close(self) -> None:
            pass

    return Ring(capacity, retain_us, drain_us)


def ring_stream(samples: DataFrame, capacity: int, late: str = "10 seconds", retain_us: int | None = None, drain_us: int | None = None) -> DataFrame:
    """series, n, us, event_id, value, evicted from (series, us, event_id, value, ts): what a ring buffer of a capacity pushes out.

    Rows are pushed as they come, those of a batch by time; n counts a series' pushes from 0. With retain_us, rows older than the newest one by more
    go too, as soon as they are the oldest. When the watermark passes drain_us, a series' contents are put out, not marked as evicted, and its buffer is empty.
    """
    if isinstance(capacity, bool) or not isinstance(capacity, int) or capacity < 1:
        raise ValueError(f"a ring buffer holds a whole number of rows, one at least, not {capacity}")
    told = F.coalesce(F.col("event_id").cast("bigint"), F.lit(NO_ID)).alias("event_id")
    rows = samples.where("us IS NOT NULL AND ts IS NOT NULL").select("series", "us", told, "value", "ts").withWatermark("ts", late)
    return grouped(rows, ring_processor(capacity, retain_us, drain_us), "n bigint, us bigint, event_id bigint, value double, evicted boolean")


def keep_alive_processor(stale_us: int, beat_us: int) -> StatefulProcessor:
    """By the clock of the machine; the class is made here so that it travels whole."""

    class KeepAlive(StatefulProcessor):
        """Passes every reading on and repeats the newest one each beat until the next, or until it is stale."""

        def __init__(self, stale_us: int, beat_us: int) -> None:
            self.stale_us, self.beat_us = stale_us, beat_us

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            # the newest reading's own time, when it came, its value, and how often it has been repeated
            self.last = handle.getValueState("last", "us bigint, seen_us bigint, value double, sent bigint")

        def wait(self) -> None:
            """A timer for the next repeat, and no other."""
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            _, seen, _, sent = self.last.get()
            if (sent + 1) * self.beat_us <= self.stale_us:
                self.handle.registerTimer(-(-(seen + (sent + 1) * self.beat_us) // 1000))

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            frames = [f for f in rows if len(f)]
            if not frames:
                return
            frame = pd.concat(frames)
            frame = frame.sort_values(["us", *(["event_id"] if "event_id" in frame.columns else [])], kind="stable")
            times, values = frame["us"].to_numpy(np.int64), frame["value"].to_numpy(float)
            # a reading that is older than the one repeated now is passed on and changes nothing
            if not self.last.exists() or self.last.get()[0] <= times[-1]:
                self.last.update((int(times[-1]), 1000 * timerValues.getCurrentProcessingTimeInMs(), float(values[-1]), 0))
                self.wait()
            yield pd.DataFrame({"series": key[0], "us": times, "value": values, "repeated": False})

        def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            if not self.last.exists():
                return
            us, seen, value, sent = self.last.get()
            due = min(1000 * timerValues.getCurrentProcessingTimeInMs() - seen, self.stale_us) // self.beat_us
            if due > sent:
                self.last.update((us, seen, value, due))
                self.wait()
                yield pd.DataFrame({"series": key[0], "us": [seen + i * self.beat_us for i in range(sent + 1, due + 1)], "value": value, "repeated": True})

        def close(self) -> None:
            pass

    return KeepAlive(stale_us, beat_us)


def keep_alive(samples: DataFrame, stale: float = 60.0, beat: float = 1.0, late: str | None = None, stretch: float | None = None) -> DataFrame:
    """series, us, value, repeated from (series, us, event_id, value, ts): every reading, and the last one again each `beat` seconds until it is `stale`.

    Repeats follow the clock of the machine, and readings are passed on at once. With `late`, how late readings may come, repeats follow the readings'
    times: readings and repeats come when the watermark has passed them, the same whatever the batches. Readings later than that are dropped.
    With `stretch` (seconds; `late` is needed too) a series is cut into stretches of time, each with the readings of `stale` after it, which may end its repeats.
    Each stretch is put out when these are over, and is a group of its own: many tasks share a series.
    """
    stale_us, beat_us = int(stale * 1_000_000), int(beat * 1_000_000)
    out = "us bigint, value double, repeated boolean"
    if stretch is not None:
        if late is None:
            raise ValueError("stretches of time need `late`, for they follow the readings' times")
        return _keep_alive_by_stretch(samples, stale_us, beat_us, late, int(stretch * 1_000_000))
    if late is not None:
        return _in_order(samples, late, "KeepAlive", (stale_us, beat_us), "us bigint, value double, sent bigint", {"value": "double"}, out)
    kind = samples.schema["series"].dataType.simpleString()
    return samples.groupBy("series").transformWithStateInPandas(keep_alive_processor(stale_us, beat_us), f"series {kind}, {out}", "append", "processingTime")


def _keep_alive_by_stretch(samples: DataFrame, stale_us: int, beat_us: int, late: str, stretch_us: int) -> DataFrame:
    rows = samples.where("us IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    stretches = rows.groupBy(F.window("ts", f"{stretch_us + stale_us} microseconds", f"{stretch_us} microseconds"), "series").agg(F.sort_array(F.collect_list(F.struct("us", "event_id", "value"))).alias("readings"))
    after = F.unix_micros("window.start") + stretch_us
    each = stretches.select("series", after.alias("after"), F.explode(F.arrays_zip("readings", F.expr("slice(readings, 2, size(readings))").alias("next"))).alias("r")).where("r.readings.us < after")
    repeats = F.floor(F.least(F.lit(stale_us), F.col("r.next.us") - F.col("r.readings.us") - 1) / beat_us)  # least passes over a next that there is not
    beats = each.select("series", F.col("r.readings.us").alias("us"), F.col("r.readings.value").alias("value"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(repeats, F.lit(0)).cast("bigint"))).alias("k"))
    return beats.select("series", (F.col("us") + F.col("k") * beat_us).alias("us"), "value", (F.col("k") > 0).alias("repeated"))
