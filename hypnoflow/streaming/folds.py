"""What live operators do with the rows of a series, given in order: plain classes, loaded in the tasks.

A fold has `cut(until)`, the time up to which rows are to be given when no row at or before `until` can come any more; `rows(key, state, rows,
until)`, which takes those rows (columns as arrays, in order) and puts out columns (arrays by name) and the next state; and `next(state, waiting)`, the time at
which it wants to be called again, where `waiting` is the time of the first row that is held back (None: never).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa

from ..functions.design import Biquad, Polyphase
from ..functions.kernels import HrvWindow, iir, linear_points, polyphase_outputs, polyphase_taps

Rows = Mapping[str, np.ndarray]
State = tuple | None


def packed(frame: pd.DataFrame | pa.Table, columns: Sequence[str] | None = None) -> bytes:
    """The frame, or its columns of these names, as an Arrow stream, without what pandas notes beside them."""
    table = frame if isinstance(frame, pa.Table) else pa.table({c: pa.array(frame[c], from_pandas=True) for c in columns or frame.columns})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(held: Sequence[bytes]) -> pa.Table:
    """The rows of all that was packed; a column that had nothing but nulls in some of it has the others' type."""
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in held], promote_options="permissive")


def named(series: object, n: int) -> np.ndarray:
    out = np.empty(n, object)
    out[:] = series
    return out


def together(parts: Sequence[Mapping]) -> pd.DataFrame | None:
    """The columns of all parts, lists or arrays, as one frame."""

    def joined(each: Sequence) -> list | np.ndarray:
        return [x for own in each for x in own] if isinstance(each[0], list) else np.concatenate([np.asarray(own) for own in each])

    return pd.DataFrame({c: joined([p[c] for p in parts]) for c in parts[0]}) if parts else None


def each_series(fold: Fold, columns: Sequence[str], held: Sequence[bytes], states: dict[object, tuple], until: int) -> tuple[pd.DataFrame | None, bytes | None, int | None]:
    """What the fold makes of the rows (their columns but the series) that are certain, the rows that are held on, and when it is to be called again; `states`, by series, are changed in place."""
    spans: dict[object, tuple[int, int]] = {}
    rows = {c: np.zeros(0) for c in columns}
    us = np.zeros(0, np.int64)
    if held:
        table = unpacked(held)
        coded = table["series"].cast(pa.string()).combine_chunks().dictionary_encode(null_encoding="encode")
        code, us = coded.indices.to_numpy(), table["us"].to_numpy()
        order = np.lexsort((table["event_id"].to_numpy(), us, code))
        code, us = code[order], us[order]
        cuts = np.flatnonzero(np.diff(code, prepend=-1, append=len(coded.dictionary)))
        spans = {name: (lo, hi) for name, lo, hi in zip(coded.dictionary.to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist())}
        rows = {c: table[c].to_numpy()[order] for c in columns}
    cut, out, dues, waits = fold.cut(until), [], [], np.ones(len(us), bool)
    for name in {**states, **spans}:
        (lo, hi), state = spans.get(name, (0, 0)), states.get(name)
        ready = lo + int(np.searchsorted(us[lo:hi], cut, side="right"))
        due = fold.next(state, None) if state is not None else None
        if lo < hi and us[lo] <= until or due is not None and due <= until:
            state, put = fold.rows((name,), state, {c: v[lo:ready] for c, v in rows.items()}, until)
            out += put
            waits[lo:ready] = False
            if state is not None:
                states[name] = state
            lo = ready
        waiting = int(us[lo]) if lo < hi else None
        due = waiting if state is None else fold.next(state, waiting)
        if due is not None:
            dues.append(due)
    rest = packed(table.take(order[waits])) if waits.any() else None
    return together(out), rest, min(dues, default=None)


def pushed(held: pd.DataFrame, batch: pd.DataFrame, states: dict[str | None, tuple[int, int, bool]], capacity: int, retain_us: int | None) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    """What ring buffers of many series hold after a batch, what it has pushed out of them, and whether some series are new.

    held: series, n, us, event_id, value, the oldest row of each series first; batch: the same without n, in order. states, by series: rows ever
    pushed, the newest time, and a mark that is left alone; they are changed in place.
    """
    columns = ["series", "n", "us", "event_id", "value"]
    rows = pd.concat([held, batch.assign(n=-1)[columns]], ignore_index=True) if len(held) else batch.assign(n=-1)[columns]
    code, names = pd.factorize(rows["series"], use_na_sentinel=False)
    names = [None if pd.isna(name) else name for name in names]
    before = [states.get(name) for name in names]
    order = np.argsort(code, kind="stable")
    rows, code = rows.take(order), code[order]
    fresh, us = rows["n"].to_numpy() < 0, rows["us"].to_numpy()
    size = np.bincount(code, minlength=len(names))
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    place, came = np.arange(len(code)) - start[code], np.bincount(code, fresh, len(names)).astype(np.int64)
    total = came + np.array([s[0] if s else 0 for s in before], np.int64)
    newest = np.array([s[1] if s else us.min() for s in before], np.int64)
    np.maximum.at(newest, code[fresh], us[fresh])
    rows = rows.assign(n=total[code] - size[code] + place)
    gone = place < (size - capacity)[code]
    if retain_us is not None:
        # rows that are too old go until the first one that is not
        stays = ~gone & (us >= newest[code] - retain_us)
        first = np.minimum.reduceat(np.where(stays, place, len(code)), start)
        gone = place < first[code]
    states |= {name: (int(total[i]), int(newest[i]), before[i][2] if before[i] else False) for i, name in enumerate(names)}
    return rows[~gone], rows[gone], None in before


class Fold:
    """Takes every row as soon as it is certain, and waits for the next one."""

    def cut(self, until: int) -> int:
        return until

    def next(self, state: State, waiting: int | None) -> int | None:
        return waiting

    def rows(self, key: tuple, state: State, rows: Rows, until: int) -> tuple[State, list[Mapping]]:
        raise NotImplementedError


class Filter(Fold):
    """The batch filter's kernel; the state is the filter's."""

    def __init__(self, stages: Sequence[Biquad]) -> None:
        self.stages = stages

    def rows(self, key: tuple, state: State, rows: Rows, until: int) -> tuple[State, list[Mapping]]:
        value = rows["value"].astype(np.float64)
        y, z = iir(self.stages, value, np.array(state[0]) if state else None)
        return (z.tolist(),), [{"series": named(key[0], len(y)), "us": rows["us"], "event_id": rows["event_id"], "value": value, "y": y}]


class Beats(Fold):
    """Beat variability; the state is the window of accepted intervals."""

    def __init__(self, window: int) -> None:
        self.window = window

    def rows(self, key: tuple, state: State, rows: Rows, until: int) -> tuple[State, list[Mapping]]:
        kept = HrvWindow(self.window, state[0] if state else ())
        out = [kept.push(x.tolist() if x is not None else ()) for x in rows["intervals"]]
        return (list(kept.kept),), [{"series": named(key[0], len(out)), "us": rows["us"], "event_id": rows["event_id"], "hrv": np.array(out, dtype=float)}]


class KeepAlive(Fold):
    """Every reading, and the last one again each `beat_us` until the next, or until it is `stale_us` old; state: us, value, repeats so far."""

    def __init__(self, stale_us: int, beat_us: int) -> None:
        self.stale_us, self.beat_us = stale_us, beat_us

    def next(self, state: State, waiting: int | None) -> int | None:
        us, _, sent = state
        due = us + (sent + 1) * self.beat_us if (sent + 1) * self.beat_us <= self.stale_us else None
        return min((t for t in (due, waiting) if t is not None), default=None)

    def rows(self, key: tuple, state: State, rows: Rows, until: int) -> tuple[State, list[Mapping]]:
        first = [] if state is None else [state[:2]]
        us = np.array([t for t, _ in first] + rows["us"].tolist(), np.int64)
        value = np.array([v for _, v in first] + rows["value"].tolist(), float)
        if not len(us):
            return state, []
        sent = np.zeros(len(us), np.int64)
        sent[: len(first)] = state[2] if state else 0
        # so many beats fit before the next reading, or until the reading is stale
        room = np.concatenate([np.diff(us) - 1, [max(until - us[-1], 0)]])
        due = np.maximum(np.minimum(room, self.stale_us) // self.beat_us, sent)
        which = np.repeat(np.arange(len(us)), due - sent)
        beat = np.arange(len(which)) - np.searchsorted(which, which) + 1 + sent[which]
        us_out, value_out = np.concatenate([us[len(first) :], us[which] + beat * self.beat_us]), np.concatenate([value[len(first) :], value[which]])
        out = {"series": named(key[0], len(us_out)), "us": us_out, "value": value_out, "repeated": np.arange(len(us_out)) >= len(us) - len(first)}
        return (int(us[-1]), float(value[-1]), int(due[-1])), [out] if len(us_out) else []


class Epochs(Fold):
    """Each epoch of a recording, once it is over, as a record: every signal as exactly its number of samples, zeros where it has none.

    signals: (label, samples a record), in order. Rows name their signal; those of other signals are left out, as are rows before the start. The
    state is the number of the next record. Epochs without any row are records too, for as long as time goes on.
    """

    def __init__(self, signals: Sequence[tuple[str, int]], epoch_us: int, start_us: int) -> None:
        self.signals, self.epoch_us, self.start_us = list(signals), epoch_us, start_us

    def over(self, until: int) -> int:
        """How many epochs are over."""
        return max((until + 1 - self.start_us) // self.epoch_us, 0)

    def cut(self, until: int) -> int:
        return self.start_us + self.over(until) * self.epoch_us - 1

    def next(self, state: State, waiting: int | None) -> int | None:
        return self.start_us + (state[0] + 1) * self.epoch_us - 1

    def rows(self, key: tuple, state: State, rows: Rows, until: int) -> tuple[State, list[Mapping]]:
        first, after = state[0] if state else 0, self.over(until)
        record = (rows["us"] - self.start_us) // self.epoch_us
        given = {label: rows["signal"] == label for label, _ in self.signals}
        out = {c: [] for c in ("recording", "signal_index", "label", "record", "values", "is_filled")}
        for r in range(first, after):
            lo, hi = np.searchsorted(record, [r, r + 1])
            for i, (label, n) in enumerate(self.signals):
                own = np.flatnonzero(given[label][lo:hi]) + lo
                values = linear_points(rows["us"][own] / 1000.0, rows["value"][own].astype(float), n)[1] if len(own) else np.zeros(n)
                for c, x in zip(out, (key[0], i, label, r, values.tolist(), not len(own))):
                    out[c].append(x)
        return (max(first, after),), [out] if out["record"] else []


class Sound(Fold):
    """Sound at a lower rate, in chunks: filter stages, then rational resampling, then so many samples at a time with the first one's time.

    Rows name their sample's number; numbers that are missing are left out of the weighing. The state holds the filter's state, the inputs of
    a filter's length and which of them there are, the next input and output, and the samples (and their numbers) of the chunk that is not full; at `drain_us` that one
    is put out as it is.
    """

    def __init__(self, polyphase: Polyphase, stages: Sequence[Biquad], chunk: int, drain_us: int | None) -> None:
        self.filter, self.stages, self.chunk, self.drain_us = polyphase, list(stages), chunk, drain_us
        self.taps, self.length = polyphase_taps(polyphase)

    def next(self, state: State, waiting: int | None) -> int | None:
        return min((t for t in (waiting, None if state and state[7] else self.drain_us) if t is not None), default=None)

    def rows(self, key: tuple, state: State, rows: Rows, until: int) -> tuple[State, list[Mapping]]:
        longest, up, down = self.taps.shape[1], self.filter.up, self.filter.down
        z, tail, there, begun, n, rest, rest_n, drained = state or ([], [0.0] * (longest - 1), [0.0] * (longest - 1), 0, 0, [], [], False)
        seq, value = rows["event_id"].astype(np.int64), rows["value"].astype(float)
        fresh = seq >= begun  # a number that has been passed is of no use any more
        seq, value = seq[fresh], value[fresh]
        outputs: list[tuple[int, float]] = list(zip(rest_n, rest))
        if len(seq):
            if self.stages:
                value, state_z = iir(self.stages, value, np.array(z) if z else None)
                z = state_z.tolist()
            end = int(seq[-1]) + 1
            x, here = np.zeros(longest - 1 + end - begun), np.zeros(longest - 1 + end - begun)
            x[: longest - 1], here[: longest - 1] = tail, there
            at = seq - begun + longest - 1
            x[at], here[at] = value, 1.0
            ready = np.arange(n, ((end * up) - 1) // down + 1)
            y, good = polyphase_outputs(self.taps, self.length, up, down, x, here, begun - (longest - 1), ready)
            outputs += [(int(i), float(v)) for i, v in zip(ready[good], y[good])]
            tail, there, begun, n = x[len(x) - (longest - 1) :].tolist(), here[len(here) - (longest - 1) :].tolist(), end, int(ready[-1]) + 1 if len(ready) else n
        drained = drained or self.drain_us is not None and until >= self.drain_us
        groups: dict[int, list[tuple[int, float]]] = {}
        for i, v in outputs:
            groups.setdefault(i // self.chunk, []).append((i, v))
        full = {c: g for c, g in groups.items() if (c + 1) * self.chunk <= n or drained}
        kept = [x for c, g in groups.items() if c not in full for x in g]
        out = [(key[0], c, g[0][0] / self.filter.rate - self.filter.delay_s, len(g), [v for _, v in g]) for c, g in sorted(full.items())]
        frame = pd.DataFrame(out, columns=["series", "chunk", "t", "samples", "values"])
        return (z, tail, there, begun, n, [v for _, v in kept], [i for i, _ in kept], drained), [frame] if out else []
