"""Column functions for samples, angles, sensor frames and EDF text fields. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_MS = 30_000
INT16 = (-32768, 32767)
#: Separators inside an EDF+ annotation list.
TAL_TEXT, TAL_DURATION, TAL_END = "\x14", "\x15", "\x00"


def micros(ts: Column) -> Column:
    """Epoch microseconds of a timestamp with or without time zone."""
    return F.unix_micros(ts.cast("timestamp"))


def digital_to_physical(d: Column, p_min: Column, p_max: Column, d_min: Column, d_max: Column) -> Column:
    """Linear map of a digital value to its physical one; 0 where the digital range is empty."""
    return F.when(d_max == d_min, F.lit(0.0)).otherwise(p_min + (d - d_min) * (p_max - p_min) / (d_max - d_min))


def physical_to_digital(v: Column, p_min: Column, p_max: Column, d_min: Column, d_max: Column) -> Column:
    """Rounded half up and clamped to the digital range; null, NaN and an empty physical range give 0."""
    scaled = F.floor((v - p_min) * (d_max - d_min) / (p_max - p_min) + d_min + F.lit(0.5))
    clamped = F.greatest(d_min, F.least(d_max, scaled.cast("double")))
    return F.when(v.isNull() | F.isnan(v) | (p_max == p_min), F.lit(0)).otherwise(clamped).cast("int")


def wrap_angle(degrees: Column) -> Column:
    """The same angle in [-180, 180)."""
    return F.pmod(degrees + 180.0, F.lit(360.0)) - 180.0


def body_position(x: Column, y: Column) -> tuple[Column, Column]:
    """Roll (-180 to 180, 0 on the back) and inclination (0 to 90), in degrees, of Euler angles x and y in degrees.

    They follow from gravity seen by the body; the third angle turns about gravity and cancels.
    """
    a, b = F.radians(x), F.radians(y)
    gx, gy, gz = F.sin(b), -F.sin(a) * F.cos(b), F.cos(a) * F.cos(b)
    return wrap_angle(F.degrees(F.atan2(gx, gz))), F.abs(F.degrees(F.atan2(gy, F.hypot(gx, gz))))


def magnitude(*parts: Column) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [p * p for p in parts]))


def clamp(v: Column, low: Column, high: Column) -> Column:
    """v within [low, high]; null for NaN."""
    return F.when(~F.isnan(v), F.greatest(low, F.least(high, v)))


def backoff_cap(attempt: Column, base_ms: float, max_ms: float) -> Column:
    """The longest wait before a retry: base * 2**attempt, at most max. A jittered wait is rand() times this."""
    return F.floor(F.least(F.lit(float(max_ms)), F.lit(float(base_ms)) * F.pow(F.lit(2.0), attempt)))


# --- complex numbers as structs -----------------------------------------------------------------------------------


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def from_polar(r: Column, phi: Column) -> Column:
    return complex_of(r * F.cos(phi), r * F.sin(phi))


def c_add(a: Column, b: Column) -> Column:
    return complex_of(a["re"] + b["re"], a["im"] + b["im"])


def c_sub(a: Column, b: Column) -> Column:
    return complex_of(a["re"] - b["re"], a["im"] - b["im"])


def c_mul(a: Column, b: Column) -> Column:
    return complex_of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def c_conj(a: Column) -> Column:
    return complex_of(a["re"], -a["im"])


def c_div(a: Column, b: Column) -> Column:
    n = b["re"] * b["re"] + b["im"] * b["im"]
    top = c_mul(a, c_conj(b))
    return complex_of(top["re"] / n, top["im"] / n)


def c_abs(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def c_phase(a: Column) -> Column:
    return F.atan2(a["im"], a["re"])


# --- sensor frames --------------------------------------------------------------------------------------------------


def u8(frame: Column, at: int | Column) -> Column:
    """The byte at an offset from 0; null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    byte = F.conv(F.hex(frame.substr(at + 1, F.lit(1))), 16, 10).cast("int")
    return F.when(F.octet_length(frame) > at, byte)


def u16(frame: Column, at: int | Column) -> Column:
    """Little-endian unsigned 16 bits."""
    at = F.lit(at) if isinstance(at, int) else at
    return u8(frame, at) + u8(frame, at + 1) * 256


def i16(frame: Column, at: int | Column) -> Column:
    v = u16(frame, at)
    return F.when(v >= 32768, v - 65536).otherwise(v)


def heart_rate_frame(frame: Column) -> Column:
    """heart_rate, contact (null: not supported), energy (null: none) and rr (seconds) of a heart-rate measurement."""
    flags = u8(frame, 0)
    bit = lambda i: F.getbit(flags, F.lit(i)) == 1
    rate = F.when(bit(0), u16(frame, 1)).otherwise(u8(frame, 1))
    after_rate = F.when(bit(0), 3).otherwise(2)
    rr_at = after_rate + F.when(bit(3), 2).otherwise(0)
    n = F.floor((F.octet_length(frame) - rr_at) / 2).cast("int")
    rr = F.when(bit(4) & (n > 0), F.transform(F.sequence(F.lit(0), n - 1), lambda i: u16(frame, rr_at + i * 2) / 1024.0)).otherwise(F.array().cast("array<double>"))
    return F.struct(rate.alias("heart_rate"), F.when(bit(1), bit(2)).alias("contact"), F.when(bit(3), u16(frame, after_rate)).alias("energy"), rr.alias("rr"))


def temperature_frame(frame: Column) -> Column:
    return i16(frame, 0) / 100.0


def is_imu_frame(frame: Column) -> Column:
    return (F.octet_length(frame) == 20) & (F.substring(F.hex(frame), 1, 4) == "5561")


def imu_frame(frame: Column) -> Column:
    """acc (g), gyro (degrees/s), angle (degrees), three each, of a 20-byte frame."""
    triple = lambda first, scale, places: F.array(*[F.round(i16(frame, first + 2 * i) / 32768.0 * scale, places) for i in range(3)])
    return F.struct(triple(2, 16, 4).alias("acc"), triple(8, 2000, 2).alias("gyro"), triple(14, 180, 3).alias("angle"))


# --- EDF text fields --------------------------------------------------------------------------------------------------


def fixed(text: Column, width: int) -> Column:
    """text cut or padded with spaces to the width; what is not ASCII becomes a question mark, so bytes and characters agree."""
    return F.rpad(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20-\x7E]", "?"), width, " ")


def subfield(text: Column) -> Column:
    """An EDF+ subfield: white space as underscores, X where nothing is known."""
    return F.coalesce(F.regexp_replace(text, r"\s+", "_"), F.lit("X"))


def edf_day(day: Column) -> Column:
    return F.coalesce(F.upper(F.date_format(day, "dd-MMM-yyyy")), F.lit("X"))


def patient_id(code: Column, sex: Column, born: Column, name: Column) -> Column:
    return F.concat_ws(" ", subfield(code), subfield(sex), edf_day(born), subfield(name))


def recording_id(start: Column, admin: Column, technician: Column, equipment: Column) -> Column:
    return F.concat_ws(" ", F.lit("Startdate"), edf_day(start), subfield(admin), subfield(technician), subfield(equipment))


def recording_name(when: Column, extension: str, device: Column | None = None) -> Column:
    """yyyyMMddHHmm[_device].extension"""
    stamp = F.date_format(when, "yyyyMMddHHmm")
    return F.concat(stamp, F.lit("") if device is None else F.coalesce(F.concat(F.lit("_"), device), F.lit("")), F.lit(f".{extension}"))


def header_start(start: Column) -> Column:
    """Date and time of an EDF header, 16 characters."""
    return F.concat(F.date_format(start, "dd.MM.yy"), F.date_format(start, "HH.mm.ss"))


def parse_header_start(day: Column, clock: Column) -> Column:
    """The timestamp of dd.mm.yy and HH.mm.ss; years from 85 are in the last century."""
    d, c = F.split(day, r"\."), F.split(clock, r"\.")
    yy = d[2].cast("int")
    return F.make_timestamp(yy + F.when(yy >= 85, 1900).otherwise(2000), d[1].cast("int"), d[0].cast("int"), c[0].cast("int"), c[1].cast("int"), c[2].cast("int"))


def build_tal(onset: Column, duration: Column, text: Column) -> Column:
    """One annotation: signed onset, optional duration, text, in seconds to three places."""
    sign = F.when(onset >= 0, "+").otherwise("")
    lasting = F.when(duration.isNotNull(), F.concat(F.lit(TAL_DURATION), F.format_string("%.3f", duration))).otherwise("")
    return F.concat(sign, F.format_string("%.3f", onset), lasting, F.lit(TAL_TEXT), text, F.lit(TAL_TEXT + TAL_END))


def parse_tals(block: Column) -> Column:
    """onset, duration, text of every annotation of a block; time-keeping entries, which have no text, are left out."""
    tals = F.filter(F.split(block, TAL_END), lambda t: F.length(F.trim(t)) > 0)

    def entries(tal: Column) -> Column:
        parts = F.split(tal, TAL_TEXT)
        timed = F.split(parts[0], TAL_DURATION)
        texts = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.length(x) > 0)
        return F.transform(texts, lambda x: F.struct(timed[0].try_cast("double").alias("onset"), F.get(timed, F.lit(1)).try_cast("double").alias("duration"), x.alias("text")))

    return F.flatten(F.transform(tals, entries))


def first_onset(block: Column) -> Column:
    """The onset of a block's first annotation, its time-keeping entry; null for an empty block."""
    return F.split(F.get(F.filter(F.split(block, TAL_END), lambda t: F.length(F.trim(t)) > 0), F.lit(0)), f"[{TAL_TEXT}{TAL_DURATION}]")[0].try_cast("double")


# --- predicates from configuration ---------------------------------------------------------------------------------


def visible_if(groups: Sequence[dict] | None) -> Column:
    """Whether a field shows: an OR over groups of equalities, each group an AND unless its mode is "any".

    No groups at all (None) is true, an empty list false.
    """
    if groups is None:
        return F.lit(True)
    tests = [reduce(or_ if g.get("mode") == "any" else and_, [F.coalesce(F.col(f) == F.lit(v), F.lit(False)) for f, v in g["conditions"]]) for g in groups]
    return reduce(or_, tests, F.lit(False))


def field_error(value: Column, required: bool = False, min_length: int | None = None, max_length: int | None = None) -> Column:
    """Which rule a text field breaks first, or null."""
    out = F.lit(None).cast("string")
    if max_length is not None:
        out = F.when(F.length(value) > max_length, "max_length").otherwise(out)
    if min_length is not None:
        out = F.when(F.length(value) < min_length, "min_length").otherwise(out)
    if required:
        out = F.when(value.isNull() | (F.length(value) == 0), "required").otherwise(out)
    return out
