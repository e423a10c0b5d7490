"""Filter design on the driver: a few numbers in, a few coefficients out. Formulas are those of the audio-EQ cookbook,
of analogue prototypes computed here from their polynomials, and of windowed-sinc and Kaiser designs."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

MAX_STAGES = 12
MATCHED_STAGES = 5


@dataclass(frozen=True)
class Biquad:
    """y = b0 t + b1 t' + b2 t'' with t = k x - a1 t' - a2 t''."""

    b0: float
    b1: float
    b2: float
    a1: float
    a2: float
    k: float = 1.0


def _alpha(w: float, q: float | None, bw: float | None) -> float:
    if bw:
        return math.sin(w) * math.sinh(math.log(2) / 2 * bw * w / math.sin(w))
    if not q:
        raise ValueError("Q or BW is needed")
    return math.sin(w) / (2 * q)


def biquad(kind: str, fs: float, fc: float, q: float | None = None, bw: float | None = None, gain: float = 0.0, pre_gain: bool = False, compat: bool = False) -> Biquad:
    """A second-order section. kind: lowpass, highpass, allpass, bandpass, bandpass_q, bandstop, peak, lowshelf, highshelf,
    lowpass_bt, highpass_bt. compat: the Bessel-Thomson high-pass with a low-pass numerator, as some libraries have it."""
    w = 2 * math.pi * fc / fs
    c = math.cos(w)
    if kind in ("lowpass_bt", "highpass_bt"):
        t = math.tan(math.pi * fc / fs)
        if kind == "lowpass_bt":
            p = 1 + 3 * t + 3 * t * t
            b = 3 * t * t / p
            return Biquad(b, 2 * b, b, (6 * t * t - 2) / p, (3 * t * t - 3 * t + 1) / p)
        p = t * t + 3 * t + 3 if not compat else t + t * t + 3
        b = 3 / p
        if compat:
            return Biquad(b, 2 * b, b, (2 * t * t - 6) / p, (t * t - t + 3) / p)
        return Biquad(b, -2 * b, b, (2 * t * t - 6) / p, (t * t - 3 * t + 3) / p)
    if kind in ("peak", "lowshelf", "highshelf"):
        if not q:
            raise ValueError("Q is needed")
        a, al = 10 ** (gain / 40), math.sin(w) / (2 * q)
        if kind == "peak":
            p = 1 + al / a
            return Biquad((1 + al * a) / p, -2 * c / p, (1 - al * a) / p, -2 * c / p, (1 - al / a) / p)
        s, up, down = 2 * math.sqrt(a) * al, a + 1, a - 1
        g = 1 if kind == "lowshelf" else -1  # the two shelves mirror each other in the sign of the cosine
        p = up + g * down * c + s
        return Biquad(a * (up - g * down * c + s) / p, g * 2 * a * (down - g * up * c) / p, a * (up - g * down * c - s) / p, -g * 2 * (down + g * up * c) / p, (up + g * down * c - s) / p)
    al = _alpha(w, q, None if kind in ("lowpass", "highpass") else bw)
    n = 1 + al
    poles = (-2 * c / n, (1 - al) / n)
    if kind in ("lowpass", "highpass"):
        sign = 1 if kind == "lowpass" else -1
        level = (1 - sign * c) / 2
        b = (1 if pre_gain else level) / n
        return Biquad(b, sign * 2 * b, b, *poles, level if pre_gain else 1.0)
    if kind == "allpass":
        return Biquad((1 - al) / n, -2 * c / n, (1 + al) / n, *poles)
    if kind in ("bandpass", "bandpass_q"):
        if kind == "bandpass_q" and not q:
            raise ValueError("Q is needed")
        b = al * (q if kind == "bandpass_q" else 1) / n
        return Biquad(b, 0.0, -b, *poles)
    if kind == "bandstop":
        return Biquad(1 / n, -2 * c / n, 1 / n, *poles)
    raise ValueError(f"no design named {kind}")


def matched_z_lowpass(fs: float, fc: float, a: float, b: float, pre_gain: bool = False) -> Biquad:
    """The poles of 1 / (1 + a s + b s^2), mapped by z = exp(s T)."""
    w = 2 * math.pi * fc / fs
    s = -a / (2 * b)
    turn = -w * math.sqrt(abs(a * a / (4 * b * b) - 1 / b))
    a1, a2 = -2 * math.exp(s * w) * math.cos(turn), math.exp(2 * s * w)
    level = 1 + a1 + a2
    return Biquad(1.0 if pre_gain else level, 0.0, 0.0, a1, a2, level if pre_gain else 1.0)


def _poles(kind: str, n: int) -> np.ndarray:
    """The n poles of an analogue prototype, at any scale."""
    if kind in ("bessel", "allpass"):
        # reverse Bessel polynomial: the coefficient of s^k is (2n-k)! / (2^(n-k) k! (n-k)!)
        c = [math.factorial(2 * n - k) / (2.0 ** (n - k) * math.factorial(k) * math.factorial(n - k)) for k in range(n, -1, -1)]
        scale = c[-1] ** (1 / n)  # the constant as one, so that the roots stay near the unit circle
        return np.roots([x / scale ** (n - (n - i)) for i, x in enumerate(c)]) * 1.0
    angle = math.pi * (2 * np.arange(n) + 1) / (2 * n)
    if kind == "butterworth":
        return -np.sin(angle) + 1j * np.cos(angle)
    ripple = {"chebyshev05": 0.5, "chebyshev1": 1.0, "chebyshev2": 2.0, "chebyshev3": 3.0}.get(kind)
    if ripple is None:
        raise ValueError(f"no characteristic named {kind}")
    mu = math.asinh(1 / math.sqrt(10 ** (ripple / 10) - 1)) / n
    return -math.sinh(mu) * np.sin(angle) + 1j * math.cosh(mu) * np.cos(angle)


@lru_cache(maxsize=1024)
def prototype(kind: str, stages: int, drop_db: float = 10 * math.log10(2)) -> list[tuple[float, float]]:
    """a, b of each stage 1 / (1 + a s + b s^2), scaled so that the whole is down by drop_db from DC at s = j.

    All-pass stages are scaled so that their group delay has fallen to 1/sqrt(2) there.
    """
    poles = _poles(kind, 2 * stages)
    up = sorted(poles[poles.imag > 0], key=lambda p: p.imag)
    ab = np.array([(-2 * p.real / abs(p) ** 2, 1 / abs(p) ** 2) for p in up])

    def level(x: float) -> float:
        a, b = ab[:, 0] * x, ab[:, 1] * x * x
        if kind == "allpass":
            return float((a * (1 + b) / (1 + (a * a - 2 * b) + b * b)).sum() / a.sum() - 1 / math.sqrt(2))
        return float(-10 * np.log10((1 - b) ** 2 + a * a).sum() + drop_db)

    # the last crossing: a rippled response is above the drop on the whole passband
    grid = np.geomspace(1e-3, 1e3, 4001)
    at = max(i for i in range(len(grid) - 1) if level(grid[i]) > 0 >= level(grid[i + 1]))
    low, high = grid[at], grid[at + 1]
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if level(middle) > 0 else (low, middle)
    return [(a * low, b * low * low) for a, b in ab.tolist()]


def cascade(behaviour: str, characteristic: str, stages: int, fs: float, fc: float, q: float | None = None, bw: float | None = None, gain: float = 0.0, pre_gain: bool = False, transform: str = "bilinear", one_db: bool = False) -> list[Biquad]:
    """The sections of a filter: `stages` biquads (at most 12; none: the signal passes unchanged)."""
    stages = min(stages, MAX_STAGES)
    if transform == "matched_z":
        if stages > MATCHED_STAGES:
            raise ValueError(f"matched-Z designs have at most {MATCHED_STAGES} stages")
        return [matched_z_lowpass(fs, fc, a, b, pre_gain) for a, b in (prototype(characteristic, stages) if stages else [])]
    if behaviour not in ("lowpass", "highpass"):
        if characteristic == "bessel":
            fc = fc * math.sqrt(stages) / stages if stages else fc
        return [biquad(behaviour, fs, fc, q, bw, gain, pre_gain)] * stages
    if characteristic == "butterworth":
        return [biquad(behaviour, fs, fc, 0.5 / math.sin(math.pi / (2 * stages) * (i + 0.5)), pre_gain=pre_gain) for i in range(stages)]
    if characteristic != "bessel":
        raise ValueError(f"{characteristic} needs the matched-Z transform")
    out = []
    for a, b in prototype("bessel", stages, 1.0 if one_db else 10 * math.log10(2)) if stages else []:
        f = 1 / math.sqrt(b)
        out.append(biquad(behaviour, fs, fc / f if behaviour == "highpass" else fc * f, math.sqrt(b) / a, pre_gain=pre_gain))
    return out


def notch(fs: float, mains: float = 50.0, q: float = 20.0) -> list[Biquad]:
    return [biquad("bandstop", fs, mains, q)]


def movement_highpass(fs: float) -> list[Biquad]:
    """What takes gravity out of acceleration: one Butterworth high-pass section at 0.05 Hz."""
    return cascade("highpass", "butterworth", 1, fs, 0.05)


# --- finite impulse responses -----------------------------------------------------------------------------------


def fir_lowpass(order: int, fs: float, fc: float) -> np.ndarray:
    """order + 1 taps of a Hamming-windowed sinc with unit gain at DC."""
    w = 2 * math.pi * fc / fs
    n = np.arange(order + 1)
    k = n - order / 2
    h = np.where(k == 0, w, np.sin(w * k) / np.where(k == 0, 1, k) * (0.54 - 0.46 * np.cos(2 * math.pi * n / order)))
    return h / h.sum()


def _inverted(h: np.ndarray) -> np.ndarray:
    if len(h) % 2 == 0:
        raise ValueError("spectral inversion needs an even order")
    h = -h
    h[len(h) // 2] += 1
    return h


def fir_highpass(order: int, fs: float, fc: float) -> np.ndarray:
    return _inverted(fir_lowpass(order, fs, fc))


def fir_bandstop(order: int, fs: float, f1: float, f2: float, compat: bool = False) -> np.ndarray:
    """A low-pass below f1 and a high-pass above f2. compat: the sum the other way round, which lifts the band instead."""
    return fir_lowpass(order, fs, f2 if compat else f1) + fir_highpass(order, fs, f1 if compat else f2)


def fir_bandpass(order: int, fs: float, f1: float, f2: float, compat: bool = False) -> np.ndarray:
    """Passes f1 to f2. compat: with inverted polarity."""
    h = _inverted(fir_bandstop(order, fs, f1, f2))
    return -h if compat else h


def bessel_i0(x: float) -> float:
    """The power series, until a term no longer counts."""
    total = term = 1.0
    k = 0
    while term > 1e-6 * total:
        k += 1
        term *= (x / (2 * k)) ** 2
        total += term
    return total


def kaiser_beta(attenuation: float) -> float:
    if attenuation < 21:
        return 0.0
    return 0.1102 * (attenuation - 8.7) if attenuation > 50 else 0.5842 * (attenuation - 21) ** 0.4 + 0.07886 * (attenuation - 21)


def fir_kaiser(fs: float, fa: float, fb: float, order: int = 51, attenuation: float = 100.0) -> np.ndarray:
    """Kaiser-windowed taps that pass fa to fb; an even order is raised by one, giving order taps."""
    order += order % 2 == 0
    half = (order - 1) // 2
    beta = kaiser_beta(attenuation)
    c = np.arange(1, half + 1)
    side = (np.sin(2 * c * math.pi * fb / fs) - np.sin(2 * c * math.pi * fa / fs)) / (c * math.pi)
    side = side * [bessel_i0(beta * math.sqrt(1 - (i / half) ** 2)) / bessel_i0(beta) for i in c]
    return np.concatenate([side[::-1], [2 * (fb - fa) / fs], side])


# --- rational resampling ---------------------------------------------------------------------------------------------


def rational(x: float, most: int = 1024, eps: float = 1e-10) -> tuple[int, int]:
    """A fraction near x by continued fractions, neither part above `most`."""
    (p0, q0), (p1, q1), rest = (0, 1), (1, 0), x
    while True:
        a = math.floor(rest)
        p2, q2 = a * p1 + p0, a * q1 + q0
        if p2 > most or q2 > most:
            break
        p0, q0, p1, q1 = p1, q1, p2, q2
        if abs(x - p1 / q1) <= eps or rest == a:
            break
        rest = 1 / (rest - a)
    g = math.gcd(p1, q1) or 1
    return p1 // g, q1 // g


@dataclass(frozen=True)
class Polyphase:
    """up/down: the ratio; phases[p]: the taps that phase p uses; delay: of the filter, in samples of `delay_rate`."""

    up: int
    down: int
    phases: tuple[tuple[float, ...], ...]
    delay_s: float
    rate: float


def polyphase(fs: float, target: float, taps_per_phase: int = 24, attenuation: float = 80.0, compat: bool = False) -> Polyphase:
    """A Kaiser low-pass split into phases. compat: the delay counted in input samples, right only where up is 1."""
    up, down = rational(target / fs)
    n = max(taps_per_phase, 8) * up
    n += n % 2 == 0
    cut, beta = 0.5 / max(up, down), kaiser_beta(attenuation)
    k = np.arange(n)
    window = np.i0(beta * np.sqrt(np.maximum(0, 1 - (2 * k / (n - 1) - 1) ** 2))) / np.i0(beta)
    h = 2 * cut * np.sinc(2 * cut * (k - (n - 1) / 2)) * window
    h = h / h.sum()
    delay = (n - 1) / 2 / fs / (1 if compat else up)
    return Polyphase(up, down, tuple(tuple(h[p::up].tolist()) for p in range(up)), delay, fs * up / down)
