"""Numeric kernels on one array, used by batch and streaming jobs alike."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Sequence
from functools import lru_cache
from itertools import pairwise

import numpy as np

from .design import Biquad, Polyphase

BLOCK = 64


def state_space(stages: Sequence[Biquad]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """A, B, C, D of a cascade of sections; each section's state is its last two inner values."""
    a, b, c, d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
    for s in stages:
        a2, b2 = np.array([[-s.a1, -s.a2], [1.0, 0.0]]), np.array([s.k, 0.0])
        c2, d2 = np.array([s.b1 - s.b0 * s.a1, s.b2 - s.b0 * s.a2]), s.b0 * s.k
        n = len(a)
        a = np.block([[a, np.zeros((n, 2))], [np.outer(b2, c), a2]])
        b, c, d = np.concatenate([b, b2 * d]), np.concatenate([d2 * c, c2]), d2 * d
    return a, b, c, d


@lru_cache(maxsize=64)
def _blocked(stages: tuple[Biquad, ...]) -> tuple:
    """A, B, C, D and the matrices that take a block of samples at once; the same for every series of a filter."""
    a, b, c, d = state_space(stages)
    powers = [np.eye(len(a))]
    for _ in range(BLOCK):
        powers.append(powers[-1] @ a)
    observe = np.array([c @ p for p in powers[:BLOCK]])
    impulse = np.concatenate([[d], observe[:-1] @ b])
    reach = np.array([p @ b for p in powers[:BLOCK]])[::-1]
    shift = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
    return a, b, c, d, powers[BLOCK], observe, reach, np.where(shift >= 0, impulse[shift], 0.0)


def iir(stages: Sequence[Biquad], x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The filtered array and the state after it. Blocks of samples go through matrix products, not one by one."""
    a, b, c, d, leap, observe, reach, toeplitz = _blocked(tuple(stages))
    z = np.zeros(len(a)) if state is None or not len(state) else np.asarray(state, float)
    if not len(a):
        return x * d, z
    n = len(x) // BLOCK * BLOCK
    blocks = x[:n].reshape(-1, BLOCK)
    own, pushed = blocks @ toeplitz.T, blocks @ reach
    states = np.empty((len(blocks), len(a)))
    for i in range(len(blocks)):
        states[i] = z
        z = leap @ z + pushed[i]
    out = [(own + states @ observe.T).ravel()]
    tail = np.empty(len(x) - n)
    for i, v in enumerate(x[n:]):
        tail[i] = c @ z + d * v
        z = a @ z + b * v
    return np.concatenate([*out, tail]), z


def largest_triangle(t0: float, v0: float, t: np.ndarray, v: np.ndarray, mean_t: float, mean_v: float) -> int:
    """Which of the points (t, v) makes the largest triangle with (t0, v0) and the mean of the bucket after; the first of equals."""
    side_t, side_v = mean_t - t0, mean_v - v0
    return int(np.argmax(np.abs(side_v * (t - t0) - side_t * (v - v0))))


def linear_points(ms: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Times and values of n points evenly over a series in order, as `linear` gives them; the series has a sample at least."""
    size = len(ms)
    if size == n:
        return ms, value
    if n == 1:
        return ms[(size - 1) // 2 :][:1], value[(size - 1) // 2 :][:1]
    if ms[-1] == ms[0]:
        return np.full(n, ms[0]), np.full(n, value[0])
    step = (ms[-1] - ms[0]) / (n - 1)
    k = np.arange(1, n - 1)
    # a segment has the points after its first sample's place on the grid, up to its last sample's
    at, left = ms[0] + k * step, np.searchsorted(np.floor((ms - ms[0]) / step), k, side="left") - 1
    inner = value[left] + (value[left + 1] - value[left]) * (at - ms[left]) / (ms[left + 1] - ms[left])
    return np.concatenate([ms[:1], np.floor(at), ms[-1:]]), np.concatenate([value[:1], inner, value[-1:]])


def polyphase_taps(filt: Polyphase) -> tuple[np.ndarray, np.ndarray]:
    """The phases' taps as one matrix, and how many each has."""
    length = np.array([len(h) for h in filt.phases])
    taps = np.zeros((filt.up, length.max()))
    for i, h in enumerate(filt.phases):
        taps[i, : len(h)] = h
    return taps, length


def polyphase_outputs(taps: np.ndarray, length: np.ndarray, up: int, down: int, x: np.ndarray, there: np.ndarray, start: int, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outputs n of a rational resampling, and which of them met any input. x[i] is input start + i, and there[i] whether it is one;
    the inputs of a filter's length before the newest one of each output are in x."""
    longest = taps.shape[1]
    y, w, met = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    for a in range(0, len(n), 1 << 14):
        cut = slice(a, a + (1 << 14))
        phase = n[cut] * down % up
        place = (n[cut] * down // up - start)[:, None] - np.arange(longest)
        weighed = taps[phase] * there[place]
        y[cut], w[cut], met[cut] = (weighed * x[place]).sum(axis=1), weighed.sum(axis=1), (there[place] * (np.arange(longest) < length[phase, None])).sum(axis=1)
    full = np.abs(w) > 1e-12
    return np.where(full, y / np.where(full, w, 1.0), 0.0), met > 0


#: How far under a chord a point must lie, beside the products that say so, to be under it for certain.
SURE = 1e-14


def _under_chords(t: np.ndarray, v: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Which points are left when those under the chord of their neighbours are taken away again and again; t is rising.

    Points on a chord stay, but for those between two of the same value. After so many rounds more points may be left than need be.
    """
    left = np.arange(len(t))
    for _ in range(rounds):
        a, m, b = left[:-2], left[1:-1], left[2:]
        chord, own = (t[m] - t[a]) * (v[b] - v[a]), (t[b] - t[a]) * (v[m] - v[a])
        go = (chord - own > SURE * (np.abs(chord) + np.abs(own))) | (v[a] == v[m]) & (v[m] == v[b])
        if not go.any():
            break
        left = left[np.concatenate([[True], ~go, [True]])]
    return left


def hull(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Places, in order, of points that hold every corner of the convex hull; (t, v) is sorted by t, then v.

    The height of a point over a line through two others is linear in the point, so whichever the line, the highest and the lowest are among
    these, the first of equally high ones with them.
    """
    if len(t) < 4:
        return np.arange(len(t))
    new = np.concatenate([[True], np.diff(t) > 0])
    low = np.flatnonzero(new)
    # of one time, the last place has the largest value; the first place that has it is wanted
    last = np.concatenate([low[1:], [len(t)]]) - 1
    equal = np.concatenate([[False], ~new[1:] & (np.diff(v) == 0)])
    first_of = np.maximum.accumulate(np.where(equal, 0, np.arange(len(t))))
    top = first_of[last]
    return np.unique(np.concatenate([top[_under_chords(t[top], v[top])], low[_under_chords(t[low], -v[low])]]))


#: Plausible beat intervals in ms, and how much one may differ from the last accepted one.
SHORTEST, LONGEST, JUMP = 300, 2000, 250


def beat_ms(seconds: float | None) -> int | None:
    """An interval in whole ms; None where it is not plausible, or no finite number."""
    if seconds is None or not math.isfinite(seconds):
        return None
    ms = math.floor(seconds * 1000 + 0.5)
    return ms if SHORTEST <= ms <= LONGEST else None


class HrvWindow:
    """RMSSD over the last `window` accepted beat intervals; intervals must be plausible and not jump."""

    def __init__(self, window: int = 30, kept: Sequence[int] = ()) -> None:
        if window < 2:
            raise ValueError("the window must hold at least two intervals")
        self.window, self.kept = window, deque(kept)
        self.squares = sum((b - a) ** 2 for a, b in pairwise(self.kept))

    def push(self, intervals: Sequence[float | None]) -> float | None:
        kept = self.kept
        for seconds in intervals:
            ms = beat_ms(seconds)
            if ms is not None and (not kept or abs(ms - kept[-1]) <= JUMP):
                if kept:
                    self.squares += (ms - kept[-1]) ** 2
                kept.append(ms)
                if len(kept) > self.window:
                    self.squares -= (kept[1] - kept.popleft()) ** 2
        return math.sqrt(self.squares / (len(kept) - 1)) if len(kept) >= 2 else None


class BeatMap:
    """What a stretch of beats makes of any state before it: the state is the last accepted interval, or none.

    States that have accepted nothing are free; those that accept the same beats from one beat on are a class with one tail, the last
    `window` accepted intervals. A beat is accepted by the free states near it, which become a class, so there are soon a few classes and
    nothing free. Maps compose: that of two stretches is the second's of what the first makes.
    """

    def __init__(self, window: int) -> None:
        self.owner = np.full(LONGEST - SHORTEST + 2, -1, np.int32)  # state 0 is none
        self.free, self.tails, self.window = len(self.owner), [], window

    def push(self, ms: int) -> None:
        for tail in self.tails:
            if abs(ms - tail[-1]) <= JUMP:
                tail.append(ms)
        if self.free:
            first = max(ms - JUMP, SHORTEST) - SHORTEST + 1
            near = self.owner[first : min(ms + JUMP, LONGEST) - SHORTEST + 2]
            fresh = np.flatnonzero(near < 0) + first
            if self.owner[0] < 0 or len(fresh):
                self.free -= len(fresh) + int(self.owner[0] < 0)
                self.owner[fresh] = len(self.tails)
                self.owner[0] = len(self.tails) if self.owner[0] < 0 else self.owner[0]
                self.tails.append(deque([ms], self.window))

    def packed(self) -> tuple[list[int], list[int], list[list[int]]]:
        """Where runs of states of one class begin, the classes of the runs (-1: free), and the classes' tails."""
        begin = np.concatenate([[0], np.flatnonzero(np.diff(self.owner)) + 1])
        return begin.tolist(), self.owner[begin].tolist(), [list(x) for x in self.tails]


def beats_after(tail: list[int], packed: tuple[list[int], list[int], list[list[int]]], window: int) -> list[int]:
    """The last accepted intervals after a stretch with this map, from those before it."""
    begin, owner, tails = packed
    which = owner[bisect_right(begin, tail[-1] - SHORTEST + 1 if tail else 0) - 1]
    return tail if which < 0 else [*tail, *tails[which]][-window:]


def _ends(t: np.ndarray, wait: int, start: np.ndarray) -> np.ndarray:
    """Where one comes to from each start by going on to the first time at least `wait` later, as long as there is one."""
    jumps = [np.append(np.maximum(np.searchsorted(t, t + wait, side="left"), np.arange(1, len(t) + 1)), len(t))]
    while (jumps[-1] < len(t)).any():
        jumps.append(jumps[-1][jumps[-1]])
    at = start.copy()
    for jump in reversed(jumps):
        at = np.where(jump[at] < len(t), jump[at], at)
    return at


def thinned(t: np.ndarray, wait: int, last: int | None) -> np.ndarray:
    """Which of the times, in order, a throttle lets through that let one through at `last` before them."""
    through = np.zeros(len(t) + 1, bool)
    jump = np.append(np.maximum(np.searchsorted(t, t + wait, side="left"), np.arange(1, len(t) + 1)), len(t))
    reached = np.array([0 if last is None else int(np.searchsorted(t, last + wait, side="left"))])
    # the rows reached from these, then twice as many, and so on
    while (reached < len(t)).any():
        through[reached] = True
        reached, jump = np.concatenate([reached, jump[reached]]), jump[jump]
        if through[reached[reached < len(t)]].all():
            break
    return through[: len(t)]


class ThinMap:
    """What a stretch of times makes of the time let through before it: the first one let through in it is one of the first `wait`, or the one
    after them, and each of these leads to a last one."""

    def __init__(self, wait: int) -> None:
        self.wait = wait
        self.begin, self.last = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.open = True  # more may come that can be the first

    def push(self, t: np.ndarray) -> None:
        if not len(t):
            return
        start = np.searchsorted(t, self.last + self.wait, side="left")
        on = start < len(t)
        self.last[on] = t[_ends(t, self.wait, start[on])]
        if self.open:
            first = self.begin[0] if len(self.begin) else t[0]
            beyond = int(np.searchsorted(t, first + self.wait, side="left"))
            fresh = np.arange(min(beyond + 1, len(t)))
            self.open = beyond >= len(t)
            self.begin, self.last = np.concatenate([self.begin, t[fresh]]), np.concatenate([self.last, t[_ends(t, self.wait, fresh)]])

    def packed(self) -> tuple[list[int], list[int]]:
        """By runs of the same last time: the latest time to begin with, and that last time."""
        ends = np.append(self.last[1:] != self.last[:-1], True) if len(self.last) else np.zeros(0, bool)
        return self.begin[ends].tolist(), self.last[ends].tolist()


def last_after(last: int | None, packed: tuple[list[int], list[int]], wait: int) -> int | None:
    """When the last time of all was let through after a stretch with this map, from that before it."""
    begin, ends = packed
    at = 0 if last is None else bisect_left(begin, last + wait)
    return ends[at] if at < len(ends) else last
