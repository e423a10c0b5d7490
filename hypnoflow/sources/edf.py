"""EDF and EDF+ recordings as a PySpark Python data source, `edf`.

Reading gives a row per sample: (path, signal_index, label, record, seq, ts_us, value). A partition is a share of a file's records,
planned from the files' sizes; headers are read in the tasks. Times are those of the records: a record starts where its
time-keeping annotation says, which for recordings with gaps (EDF+D) is not where the record before ends; without such an
annotation it starts at its number times the record duration. Option `signals` (labels, comma-separated) limits what is
decoded, and filters on signal_index and record are pushed down. kind=annotations, kind=records, kind=signals and kind=header
give the other parts of a file. Spark keeps what was pushed with the loaded source: load anew for other filters in one query.

A recording that still grows can be read as a stream (`stream_recordings`): an offset is how many whole records each file has, so every sample
comes once, whenever the stream is stopped and started again.

Writing (`write_recordings`): records are of one size, so every record has a known place in its file. A recording is cut into shares of records that
many tasks write, each in its own place of the one file, however often a task is run; the header comes with the first share, whose task is told
how many records there are. On a store whose files cannot be changed in place, shares are files of their own and are put together by a task for each
recording. The commit sees that all records are there and of one layout; a file counts once its name is in the manifest.

Recording live (`record_to`, a streaming sink): records are written to their places as they come, so a batch that is repeated changes nothing, and the
count in the header stays -1, which readers take from the file's size, until `stop_recordings` fills it in.

A physical or digital range, a count or a duration that is no number is an error, not zero.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..functions.signal import build_tal

ANNOTATIONS = "EDF Annotations"
ANNOTATION_SAMPLES = 64
RECORD_SECONDS = 30.0
MANIFEST = "manifest.json"
#: Bytes of records that one partition reads.
PARTITION_BYTES = 32 << 20
#: Bytes of records that are read at once, and samples of a signal that are put out at once.
RUN_BYTES, BATCH_SAMPLES = 1 << 20, 1 << 16
#: Widths of the fields that each signal has, in the order of the header.
SIGNAL_FIELDS = (("label", 16), ("transducer_type", 80), ("physical_dimension", 8), ("physical_min", 8), ("physical_max", 8), ("digital_min", 8), ("digital_max", 8), ("prefiltering", 80), ("samples_per_record", 8), ("reserved", 32))
HEADER_FIELDS = (("version", 8), ("patient_id", 80), ("recording_id", 80), ("day", 8), ("clock", 8), ("header_bytes", 8), ("reserved", 44), ("data_records", 8), ("record_duration", 8), ("signal_count", 4))
#: Where the header says how many records there are.
COUNT_AT = 236
#: Bytes of records that one task writes, at most.
SHARE_BYTES = 32 << 20
SCHEMAS = {
    "samples": "path string, signal_index int, label string, record bigint, seq bigint, ts_us bigint, value double",
    "records": "path string, record bigint, start_s double, start_us bigint",
    "annotations": "path string, record bigint, onset double, duration double, text string",
    "signals": "path string, signal_index int, label string, transducer_type string, physical_dimension string, physical_min double, physical_max double, digital_min int, digital_max int, prefiltering string, samples_per_record int, byte_offset bigint",
    "header": "path string, version string, patient_id string, recording_id string, start_us bigint, data_records bigint, record_duration double, signal_count int",
}


def located(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"^[a-z][a-z0-9+.-]*:/", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def _number(text: str, kind: type = float):
    try:
        return kind(float(text))
    except ValueError:
        return None


@dataclass
class Header:
    fields: dict
    signals: list[dict]

    @property
    def record_bytes(self) -> int:
        return sum(2 * s["samples_per_record"] for s in self.signals)

    @property
    def start_us(self) -> int:
        day, month, year = (int(x) for x in self.fields["day"].split("."))
        hour, minute, second = (int(x) for x in self.fields["clock"].split("."))
        when = datetime(year + (1900 if year >= 85 else 2000), month, day, hour, minute, second, tzinfo=timezone.utc)
        return int(when.timestamp()) * 1_000_000


def read_header(f: pa.NativeFile, size: int) -> Header:
    """The header of an open file; a record count that was never filled in follows from the file's size."""
    raw, at, fields = f.read(256).decode("ascii", "replace"), 0, {}
    for name, width in HEADER_FIELDS:
        fields[name] = raw[at : at + width].strip()
        at += width
    n = int(fields["signal_count"])
    raw, at = f.read(256 * n).decode("ascii", "replace"), 0
    signals: list[dict] = [{} for _ in range(n)]
    for name, width in SIGNAL_FIELDS:
        for s in signals:
            s[name] = raw[at : at + width].strip()
            at += width
    offset = 0
    for s in signals:
        for name in ("physical_min", "physical_max", "digital_min", "digital_max", "samples_per_record"):
            number = _number(s[name], float if name.startswith("physical") else int)
            if number is None and name != "samples_per_record" and ANNOTATIONS in s["label"]:
                number = 0  # the ranges of annotations say nothing
            if number is None:
                raise ValueError(f"{name} of signal {s['label']!r} is {s[name]!r}, which is no number")
            s[name] = number
        s["byte_offset"] = offset
        offset += 2 * s["samples_per_record"]
    for name, kind in (("header_bytes", int), ("data_records", int), ("record_duration", float)):
        fields[name] = _number(fields[name], kind)
    if fields["record_duration"] is None:
        raise ValueError("the record duration is no number")
    fields["header_bytes"] = fields["header_bytes"] or 256 * (n + 1)
    if fields["data_records"] is None or fields["data_records"] < 0:
        fields["data_records"] = (size - fields["header_bytes"]) // offset if offset else 0
    return Header(fields, signals)


def to_physical(d: np.ndarray, s: dict) -> np.ndarray:
    span = s["digital_max"] - s["digital_min"]
    return s["physical_min"] + (d - s["digital_min"]) * ((s["physical_max"] - s["physical_min"]) / span) if span else np.zeros(len(d))


def to_digital(v: np.ndarray, s: dict) -> np.ndarray:
    span = s["physical_max"] - s["physical_min"]
    if not span:
        return np.zeros(len(v), "<i2")
    d = np.floor((v - s["physical_min"]) * (s["digital_max"] - s["digital_min"]) / span + s["digital_min"] + 0.5)
    return np.nan_to_num(np.clip(d, s["digital_min"], s["digital_max"]), nan=0.0).astype("<i2")


def annotations_of(block: bytes) -> list[tuple[float | None, float | None, str]]:
    """onset, duration, text of each annotation in a record; the time-keeping entry has no text."""
    out = []
    for tal in block.decode("utf-8", "replace").split("\x00"):
        if tal.strip():
            timed, *texts = tal.split("\x14")
            onset, _, lasting = timed.partition("\x15")
            out += [(_number(onset), _number(lasting) if lasting else None, t) for t in texts if t]
    return out


def onset_of(block: bytes) -> float | None:
    """The start of a record that its time-keeping entry, the first of its annotations, gives."""
    first = block.split(b"\x14", 1)[0].split(b"\x15", 1)[0]
    return _number(first.decode("utf-8", "replace")) if first[:1] in (b"+", b"-") else None


@dataclass
class FileShare(InputPartition):
    """Share `part` of `parts` of a file's records."""

    path: str
    part: int
    parts: int


class EdfReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.kind = options["path"], options.get("kind", "samples")
        self.labels = [x.strip() for x in options["signals"].split(",")] if options.get("signals") else None
        self.records, self.indices = [0, 1 << 62], None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if self.kind == "samples" and f.attribute == ("signal_index",) and isinstance(f, EqualTo):
                self.indices = {f.value} if self.indices is None else self.indices & {f.value}
            elif self.kind == "samples" and f.attribute == ("record",) and isinstance(f, (EqualTo, GreaterThanOrEqual, LessThanOrEqual)):
                if not isinstance(f, LessThanOrEqual):
                    self.records[0] = max(self.records[0], f.value)
                if not isinstance(f, GreaterThanOrEqual):
                    self.records[1] = min(self.records[1], f.value + 1)
            else:
                yield f

    def _files(self) -> list[tuple[str, int]]:
        """The files and their sizes."""
        system, path = located(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [(self.path, info.size)]
        found = {posixpath.relpath(i.path, path): i.size for i in system.get_file_info(fs.FileSelector(path, recursive=True)) if i.type == fs.FileType.File}
        names = sorted(n for n in found if n.lower().endswith(".edf"))
        if MANIFEST in found:
            with system.open_input_stream(posixpath.join(path, MANIFEST)) as f:
                names = json.loads(f.read())
        return [(posixpath.join(self.path, n), found[n]) for n in names]

    def partitions(self) -> list[FileShare]:
        whole = self.kind in ("header", "signals")
        counts = [(path, 1 if whole else max(1, -(-size // PARTITION_BYTES))) for path, size in self._files()]
        return [FileShare(path, i, n) for path, n in counts for i in range(n)] or [FileShare("", 0, 1)]

    def read(self, part: FileShare) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        system, own = located(part.path)
        with system.open_input_file(own) as f:
            head = read_header(f, f.size())
            total = head.fields["data_records"]
            first, after = (max(total * part.part // part.parts, self.records[0]), min(total * (part.part + 1) // part.parts, self.records[1]))
            yield from getattr(self, f"_{self.kind}")(part.path, head, f, first, after)

    def _header(self, path: str, head: Header, f: pa.NativeFile, first: int, after: int) -> Iterator[tuple]:
        h = head.fields
        yield path, h["version"], h["patient_id"], h["recording_id"], head.start_us, h["data_records"], h["record_duration"], len(head.signals)

    def _signals(self, path: str, head: Header, f: pa.NativeFile, first: int, after: int) -> Iterator[tuple]:
        for i, s in enumerate(head.signals):
            yield (path, i, *(s[c] for c in ("label", "transducer_type", "physical_dimension", "physical_min", "physical_max", "digital_min", "digital_max", "prefiltering", "samples_per_record", "byte_offset")))

    def _runs(self, head: Header, f: pa.NativeFile, first: int, after: int) -> Iterator[tuple[int, np.ndarray]]:
        """The number of the first record of each run, and the run as (records, bytes)."""
        step = max(1, RUN_BYTES // max(head.record_bytes, 1))
        for r in range(first, after, step):
            f.seek(head.fields["header_bytes"] + r * head.record_bytes)
            raw = np.frombuffer(f.read(min(step, after - r) * head.record_bytes), np.uint8)
            yield r, raw[: len(raw) // max(head.record_bytes, 1) * head.record_bytes].reshape(-1, max(head.record_bytes, 1))

    @staticmethod
    def _notes(head: Header) -> dict | None:
        return next((s for s in head.signals if ANNOTATIONS in s["label"]), None)

    def _starts(self, head: Header, r: int, run: np.ndarray) -> np.ndarray:
        """Seconds from the file's start at which each record of a run begins."""
        starts = (r + np.arange(len(run))) * head.fields["record_duration"]
        s = self._notes(head)
        if s is not None:
            for i, row in enumerate(run[:, s["byte_offset"] : s["byte_offset"] + 2 * s["samples_per_record"]]):
                onset = onset_of(row[:64].tobytes())
                starts[i] = starts[i] if onset is None else onset
        return starts

    def _records(self, path: str, head: Header, f: pa.NativeFile, first: int, after: int) -> Iterator[tuple]:
        for r, run in self._runs(head, f, first, after):
            for i, start in enumerate(self._starts(head, r, run).tolist()):
                yield path, r + i, start, head.start_us + int(np.floor(start * 1e6 + 0.5))

    def _annotations(self, path: str, head: Header, f: pa.NativeFile, first: int, after: int) -> Iterator[tuple]:
        s = self._notes(head)
        for r, run in self._runs(head, f, first, after if s else first):
            for i, row in enumerate(run[:, s["byte_offset"] : s["byte_offset"] + 2 * s["samples_per_record"]]):
                yield from ((path, r + i, *x) for x in annotations_of(row.tobytes()))

    def _samples(self, path: str, head: Header, f: pa.NativeFile, first: int, after: int) -> Iterator[pa.RecordBatch]:
        # a label stands for the first signal that has it
        one = {s["label"]: i for i, s in reversed(list(enumerate(head.signals)))}
        wanted = [i for i, s in enumerate(head.signals) if ANNOTATIONS not in s["label"] and s["samples_per_record"] and (self.labels is None or s["label"] in self.labels and one[s["label"]] == i) and (self.indices is None or i in self.indices)]
        for r, run in self._runs(head, f, first, after):
            starts = self._starts(head, r, run)
            for i in wanted:
                s, n = head.signals[i], head.signals[i]["samples_per_record"]
                raw = np.ascontiguousarray(run[:, s["byte_offset"] : s["byte_offset"] + 2 * n]).view("<i2").astype(np.float64)
                record = np.repeat(r + np.arange(len(run)), n)
                k = np.tile(np.arange(n), len(run))
                ts = head.start_us + np.floor(np.repeat(starts, n) * 1e6 + k * (head.fields["record_duration"] / n * 1e6) + 1e-3).astype(np.int64)
                value = to_physical(raw.ravel(), s)
                for at in range(0, len(value), BATCH_SAMPLES):
                    cut = slice(at, at + BATCH_SAMPLES)
                    m = len(value[cut])
                    same = lambda x: pa.DictionaryArray.from_arrays(pa.array(np.zeros(m, np.int32)), pa.array([x])).cast(pa.string())
                    columns = [same(path), pa.array(np.full(m, i, np.int32)), same(s["label"]), pa.array(record[cut]), pa.array(record[cut] * n + k[cut]), pa.array(ts[cut]), pa.array(value[cut])]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "signal_index", "label", "record", "seq", "ts_us", "value"])


@dataclass
class RecordShare(InputPartition):
    """Records from `first` to before `after` of a file."""

    path: str
    first: int
    after: int


class EdfStreamReader(DataSourceStreamReader):
    """Whole records that have been added to files since the offset before; new files are read from their first record on."""

    def __init__(self, options: dict) -> None:
        self.batch = EdfReader(options)
        self.heads: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        offset = {}
        for path, size in self.batch._files():
            if path not in self.heads:
                if size < 256:
                    continue  # not even begun
                system, own = located(path)
                with system.open_input_file(own) as f:
                    n = f.read(256)[252:256].decode("ascii", "replace").strip()
                    if not n.isdecimal() or size < 256 * (int(n) + 1):
                        continue
                    f.seek(0)
                    head = read_header(f, size)
                self.heads[path] = (head.fields["header_bytes"], head.record_bytes)
            start, record = self.heads[path]
            offset[path] = max(size - start, 0) // record if record else 0
        return offset

    def partitions(self, start: dict, end: dict) -> list[RecordShare]:
        parts = []
        for path, after in sorted(end.items()):
            system, own = located(path)
            with system.open_input_file(own) as f:
                step = max(1, PARTITION_BYTES // max(read_header(f, f.size()).record_bytes, 1))
            first = start.get(path, 0)
            parts += [RecordShare(path, r, min(r + step, after)) for r in range(first, after, step)]
        return parts

    def read(self, part: RecordShare) -> Iterator[pa.RecordBatch]:
        system, own = located(part.path)
        with system.open_input_file(own) as f:
            yield from getattr(self.batch, f"_{self.batch.kind}")(part.path, read_header(f, f.size()), f, part.first, part.after)


def padded(text: object, width: int) -> bytes:
    return str(text).encode("ascii", "replace")[:width].ljust(width)


def build_header(start_us: int, signals: list[dict], data_records: int, duration: float = RECORD_SECONDS, patient: str = "X X X X", recording: str = "Startdate X X X X", kind: str = "EDF+C") -> bytes:
    when = datetime.fromtimestamp(start_us / 1e6, tz=timezone.utc)
    out = padded("0", 8) + padded(patient, 80) + padded(recording, 80) + when.strftime("%d.%m.%y%H.%M.%S").encode() + padded(256 * (len(signals) + 1), 8) + padded(kind, 44)
    out += padded(data_records, 8) + padded(f"{duration:.6f}", 8) + padded(len(signals), 4)
    return out + b"".join(padded(s.get(name, ""), width) for name, width in SIGNAL_FIELDS for s in signals)


def all_to_digital(v: np.ndarray, signals: list[dict]) -> np.ndarray:
    """Whole records (rows of samples, signal after signal) as integers."""
    across = lambda name: np.concatenate([np.full(s["samples_per_record"], float(s[name])) for s in signals])
    low, high, least, most = (across(c) for c in ("physical_min", "physical_max", "digital_min", "digital_max"))
    flat = high == low
    d = np.floor((v - low) * (most - least) / np.where(flat, 1.0, high - low) + least + 0.5)
    return np.where(flat, 0.0, np.nan_to_num(np.clip(d, least, most), nan=0.0)).astype("<i2")


def time_kept(start_s: float) -> bytes:
    return f"+{start_s:.3f}\x14\x14\x00".encode()


def file_name(recording: str) -> str:
    """A recording's own file name, without the ending: no two recordings share one."""
    return f"{re.sub(r'[^A-Za-z0-9._-]', '_', recording)[:80]}-{zlib.crc32(recording.encode()):08x}"


@dataclass
class Share:
    """What has been written of a recording: records from first to before after, or only its header's count where there are none."""

    file: str
    share: int
    layout: str
    first: int
    after: int
    records: int | None


@dataclass
class Written(WriterCommitMessage):
    shares: list[Share]


class EdfWriter(DataSourceArrowWriter):
    """Rows are sorted by recording, share, record, signal_index, k. A row with signal_index -1 comes before its record's samples: it has the record's
    annotations and start, or, with record -1, the number of all records."""

    def __init__(self, path: str, duration: float, patient: str, recording: str, annotation_samples: int | None = None, gaps: bool = False, in_place: bool | None = None) -> None:
        self.path, self.duration, self.patient, self.recording, self.gaps = path, duration, patient, recording, gaps
        self.annotation_samples = annotation_samples or ANNOTATION_SAMPLES
        self.in_place = isinstance(located(path)[0], fs.LocalFileSystem) if in_place is None else in_place
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = located(self.path)
        system.create_dir(path, recursive=True)
        done: list[Share] = []
        open_file: tuple[str, object] | None = None
        signals: list[dict] = []
        pattern = np.zeros(0, np.int32)

        def put(share: Share, at: int, data: bytes) -> None:
            """Writes data to its place, or to the end of the share's own file."""
            nonlocal open_file
            name = posixpath.join(path, f"{share.file}.part" if self.in_place else f"{share.file}.{share.share:08d}.part")
            if open_file is None or open_file[0] != name:
                close()
                open_file = (name, os.open(name, os.O_RDWR | os.O_CREAT, 0o644) if self.in_place else system.open_output_stream(name, compression=None))
            if not self.in_place:
                open_file[1].write(data)
                return
            view = memoryview(data)
            while view:
                n = os.pwrite(open_file[1], view, at)
                view, at = view[n:], at + n

        def close() -> None:
            nonlocal open_file
            if open_file is not None:
                os.close(open_file[1]) if self.in_place else open_file[1].close()
            open_file = None

        def run(rows: pa.Table) -> None:
            """Puts out whole records of one share."""
            nonlocal signals, pattern
            own, number = rows["recording"][0].as_py(), rows["share"][0].as_py()
            name = f"{file_name(own)}-{self.job}.edf"
            if not done or (done[-1].file, done[-1].share) != (name, number):
                done.append(Share(name, number, "", 0, 0, None))
                signals = []
            share = done[-1]
            mark = rows["signal_index"].to_numpy() < 0
            told = rows.filter(pa.array(mark)).select(["record", "records", "start_s", "tals"]).to_pylist()
            notes = {t["record"]: t for t in told if t["record"] >= 0}
            share.records = next((t["records"] for t in told if t["record"] < 0), share.records)
            rows = rows.filter(pa.array(~mark))
            index, record, value = (rows[c].to_numpy() for c in ("signal_index", "record", "value"))
            if not signals and len(index):
                first = record == record[0]
                pattern = index[first]
                bounds = np.flatnonzero(np.diff(pattern, prepend=-1, append=-2)).tolist()
                signals = [{"label": rows["label"][a].as_py(), "physical_min": rows["physical_min"][a].as_py(), "physical_max": rows["physical_max"][a].as_py(), "digital_min": -32768, "digital_max": 32767, "samples_per_record": b - a} for a, b in zip(bounds[:-1], bounds[1:])]
                share.layout, share.first, share.after = json.dumps(signals), int(record[0]), int(record[0])
            width = len(pattern)
            which = record[::width] if width else record
            wrong = next(iter(sorted(set(notes) - set(record.tolist()))), None)
            if wrong is not None:
                raise ValueError(f"annotations of record {wrong} of {own}, which has no samples")
            if len(record) != len(which) * width or (record != np.repeat(which, width)).any() or (index != np.tile(pattern, len(which))).any():
                raise ValueError(f"a record of {own} from {which[0]} on does not have the samples of the share's first")
            if (which != share.after + np.arange(len(which))).any():
                raise ValueError(f"record {share.after} of {own} is missing")
            if not len(which):
                return  # a recording's number of records, without its first one
            count, samples = len(which), 2 * width
            header, size = 256 * (len(signals) + 2), samples + 2 * self.annotation_samples
            if share.records is not None and share.first == share.after == 0:
                every = [*signals, {"label": ANNOTATIONS, "physical_min": -1, "physical_max": 1, "digital_min": -32768, "digital_max": 32767, "samples_per_record": self.annotation_samples}]
                put(share, 0, build_header(rows["start_us"][0].as_py(), every, share.records, self.duration, self.patient, self.recording, "EDF+D" if self.gaps else "EDF+C"))
            out = np.zeros((count, size), np.uint8)
            out[:, :samples] = all_to_digital(value.reshape(count, width), signals).view(np.uint8)
            for i, r in enumerate(which.tolist()):
                note = notes.get(r, {})
                kept = time_kept(r * self.duration if note.get("start_s") is None else note["start_s"]) + "".join(note.get("tals") or ()).encode()
                if len(kept) > 2 * self.annotation_samples:
                    raise ValueError(f"the annotations of record {r} of {own} do not fit {2 * self.annotation_samples} bytes")
                out[i, samples : samples + len(kept)] = np.frombuffer(kept, np.uint8)
            put(share, header + share.after * size, out.tobytes())
            share.after += count

        def cuts(rows: pa.Table, names: list[str]) -> np.ndarray:
            """The rows at which any of the columns changes."""
            new = np.zeros(max(rows.num_rows - 1, 0), bool)
            for c in names:
                column = rows[c].combine_chunks()
                new |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            return np.flatnonzero(new) + 1

        rest: pa.Table | None = None
        try:
            for batch in iterator:
                rows = pa.Table.from_batches([batch])
                rows = rows if rest is None else pa.concat_tables([rest, rows])
                # the last record may go on in the next batch
                ends = cuts(rows, ["recording", "share", "record"])
                whole = int(ends[-1]) if len(ends) else 0
                rest = rows.slice(whole)
                whole = rows.slice(0, whole)
                bounds = [0, *cuts(whole, ["recording", "share"]).tolist(), whole.num_rows] if whole.num_rows else []
                for a, b in zip(bounds, bounds[1:]):
                    run(whole.slice(a, b - a))
            if rest is not None and rest.num_rows:
                run(rest)
        finally:
            close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        """Sees that every recording is whole, and makes its file count."""
        of: dict[str, list[Share]] = {}
        for share in (x for m in messages if m for x in m.shares):
            of.setdefault(share.file, []).append(share)
        for name, shares in of.items():
            shares.sort(key=lambda x: x.share)
            written = [x for x in shares if x.after > x.first]
            at = 0
            for x in written:
                if x.first != at:
                    raise ValueError(f"record {at} of {name} is missing")
                if x.layout != written[0].layout:
                    raise ValueError(f"record {x.first} of {name} does not have the samples of the first")
                at = x.after
            if at != next((x.records for x in shares if x.records is not None), None):
                raise ValueError(f"record {at} of {name} is missing")
        system, path = located(self.path)
        system.create_dir(path, recursive=True)
        if not self.in_place:
            parts = {name: [f"{name}.{x.share:08d}.part" for x in shares if x.after > x.first] for name, shares in of.items()}
            with system.open_output_stream(posixpath.join(path, f"{self.job}{SHARES}")) as out:
                out.write(json.dumps(parts).encode())
            return
        for name in of:
            system.move(posixpath.join(path, f"{name}.part"), posixpath.join(path, name))
        publish(self.path, sorted(of))

    def abort(self, messages: list[Written | None]) -> None:
        system, path = located(self.path)
        for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if self.job in info.base_name and info.base_name.endswith(".part"):
                system.delete_file(info.path)


#: The ending of the list of shares that are still to be put together.
SHARES = ".shares.json"


def publish(where: str, names: list[str]) -> None:
    """Writes the manifest."""
    system, path = located(where)
    with system.open_output_stream(posixpath.join(path, MANIFEST)) as out:
        out.write(json.dumps(names).encode())


def put_together(spark: SparkSession, where: str) -> None:
    """Recordings whose shares are files of their own, each by one task, copied a few megabytes at a time."""
    system, path = located(where)
    lists = [i for i in system.get_file_info(fs.FileSelector(path)) if i.base_name.endswith(SHARES)]
    if not lists:
        return
    parts: dict[str, list[str]] = {}
    for info in lists:
        with system.open_input_stream(info.path) as f:
            parts |= json.loads(f.read())

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = located(where)
        for batch in batches:
            for name, shares in zip(batch["name"].to_pylist(), batch["shares"].to_pylist()):
                with system.open_output_stream(posixpath.join(path, name), compression=None) as out:
                    for share in shares:
                        with system.open_input_stream(posixpath.join(path, share), compression=None) as f:
                            while piece := f.read(8 << 20):
                                out.write(piece)
            yield pa.RecordBatch.from_arrays([batch["name"]], ["name"])

    todo = spark.createDataFrame(list(parts.items()), "name string, shares array<string>").repartition(max(len(parts), 1), "name")
    publish(where, sorted(r.name for r in todo.mapInArrow(copied, "name string").collect()))
    for name in [x for shares in parts.values() for x in shares] + [i.base_name for i in lists]:
        system.delete_file(posixpath.join(path, name))


class EdfRecorder(DataSourceStreamArrowWriter):
    """Writes rows (recording, signal_index, record, values) to their places; a recording's rows of a record are in one task, in order."""

    def __init__(self, path: str, duration: float, start_us: int, signals: list[dict], patient: str, recording: str) -> None:
        if not isinstance(located(path)[0], fs.LocalFileSystem):
            raise ValueError(f"a recording grows in place, which files of {path} cannot")
        self.path, self.duration, self.start_us, self.patient, self.recording = path, duration, start_us, patient, recording
        notes = {"label": ANNOTATIONS, "physical_min": -1, "physical_max": 1, "samples_per_record": ANNOTATION_SAMPLES}
        self.signals = [{"digital_min": -32768, "digital_max": 32767} | s for s in [*signals, notes]]

    def digital(self, rows: list[tuple]) -> list[bytes]:
        """Each row's samples as they are written; all rows of a signal are scaled at once."""
        out = [b""] * len(rows)
        for index in {r[2] for r in rows}:
            s, own = self.signals[index], [i for i, r in enumerate(rows) if r[2] == index]
            wrong = next((rows[i] for i in own if len(rows[i][3]) != s["samples_per_record"]), None)
            if wrong is not None:
                raise ValueError(f"record {wrong[1]} of {wrong[0]} does not have the samples of {s['label']}")
            scaled = to_digital(np.array([rows[i][3] for i in own], float).ravel(), s).reshape(len(own), s["samples_per_record"])
            for i, samples in zip(own, scaled):
                out[i] = samples.tobytes()
        return out

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        _, path = located(self.path)
        os.makedirs(path, exist_ok=True)
        offsets = np.cumsum([0, *(2 * s["samples_per_record"] for s in self.signals)]).tolist()
        header, size = build_header(self.start_us, self.signals, -1, self.duration, self.patient, self.recording), offsets[-1]
        files: dict[str, int] = {}
        try:
            for batch in iterator:
                rows = sorted((r for r in zip(*(batch[c].to_pylist() for c in ("recording", "record", "signal_index", "values"))) if r[0] is not None), key=lambda r: r[:3])
                for i, ((who, record, index, _), samples) in enumerate(zip(rows, self.digital(rows))):
                    if who not in files:
                        files[who] = os.open(posixpath.join(path, f"{file_name(who)}.edf"), os.O_RDWR | os.O_CREAT, 0o644)
                        if os.fstat(files[who]).st_size < len(header):
                            os.pwrite(files[who], header, 0)
                    at = len(header) + record * size
                    os.pwrite(files[who], samples, at + offsets[index])
                    if i + 1 == len(rows) or rows[i + 1][:2] != (who, record):
                        # the annotations are a record's end: with them it is whole
                        os.pwrite(files[who], time_kept(record * self.duration).ljust(2 * ANNOTATION_SAMPLES, b"\x00"), at + offsets[-2])
            for f in files.values():
                os.fsync(f)
        finally:
            for f in files.values():
                os.close(f)
        return WriterCommitMessage()

    def commit(self, messages: list, batchId: int) -> None:
        """Nothing is left to do: what a batch writes has its place, and comes there again if the batch is repeated."""

    def abort(self, messages: list, batchId: int) -> None:
        """Records that a batch has left are written again when it is repeated."""


def stop_recordings(spark: SparkSession, where: str) -> None:
    """Fills in how many records the recordings below a folder have; what a record that is not whole has left goes."""
    system, path = located(where)
    names = [i.path for i in system.get_file_info(fs.FileSelector(path)) if i.base_name.endswith(".edf")]

    def stopped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["name"].to_pylist():
                size = os.path.getsize(name)
                with pa.OSFile(name) as f:
                    head = read_header(f, size)
                records = (size - head.fields["header_bytes"]) // head.record_bytes
                with open(name, "r+b") as f:
                    f.truncate(head.fields["header_bytes"] + records * head.record_bytes)
                    f.seek(COUNT_AT)
                    f.write(padded(records, 8))
            yield batch

    spark.createDataFrame([(n,) for n in names], "name string").repartition(8, "name").mapInArrow(stopped, "name string").count()


class EdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "samples")]

    def reader(self, schema: StructType) -> EdfReader:
        return EdfReader(dict(self.options))

    def streamReader(self, schema: StructType) -> EdfStreamReader:
        return EdfStreamReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> EdfWriter:
        o = self.options
        in_place = {"true": True, "false": False}.get(o.get("in_place", ""))
        return EdfWriter(o["path"], float(o.get("record_seconds", RECORD_SECONDS)), o.get("patient", "X X X X"), o.get("recording", "Startdate X X X X"), int(o["annotation_samples"]) if "annotation_samples" in o else None, o.get("gaps") == "true", in_place)

    def streamWriter(self, schema: StructType, overwrite: bool) -> EdfRecorder:
        o = self.options
        return EdfRecorder(o["path"], float(o.get("record_seconds", RECORD_SECONDS)), int(o["start_us"]), json.loads(o["signals"]), o.get("patient", "X X X X"), o.get("recording", "Startdate X X X X"))


def write_recordings(
    rows: DataFrame, path: str, record_seconds: float = RECORD_SECONDS, annotations: DataFrame | None = None, patient: str = "X X X X", recording: str = "Startdate X X X X", starts: DataFrame | None = None, in_place: bool | None = None,
    sizes: DataFrame | None = None,
) -> None:
    """One file a recording from (recording, signal_index, label, record, k, value, physical_min, physical_max, start_us).

    Records are numbered from 0 without a gap, and have the samples of the first one; anything else is an error. A null recording is named "null".
    annotations: (recording, record, onset, duration, text). The annotation signal is as wide as the fullest record needs,
    2 * ANNOTATION_SAMPLES bytes at least; annotations of a record that does not exist are an error, as is one without a text; control characters that
    annotations are told apart by become blanks. starts: (recording, record, start_s) of records that do not follow the one before at once; the files are
    EDF+D then. patient, recording: the header's identification fields. in_place: whether files can be changed in place (None: local ones can).
    sizes: (recording, records, samples), where it is known what the rows hold; else they are counted first.
    """
    spark = rows.sparkSession
    spark.dataSource.register(EdfSource)
    who = lambda df: F.coalesce(df["recording"].cast("string"), F.lit("null")).alias("recording")
    kept = rows.select(who(rows), F.col("signal_index").cast("int").alias("signal_index"), "label", F.col("record").cast("bigint").alias("record"), F.col("k").cast("bigint").alias("k"), F.col("value").cast("double").alias("value"), "physical_min", "physical_max", "start_us")
    if sizes is None:
        sizes = kept.groupBy("recording").agg((F.max("record") + 1).alias("records"), F.count(F.lit(1)).alias("samples"))
    total = sizes.agg(F.sum("records").alias("records"), F.sum("samples").alias("samples")).first()
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # shares for all tasks, none of more than SHARE_BYTES
    step = max(1, min(-(-(total.records or 0) // tasks), SHARE_BYTES * (total.records or 0) // max(2 * (total.samples or 1), 1)))
    marks = [sizes.select("recording", F.lit(-1).cast("bigint").alias("record"), "records")]
    samples = None
    if annotations is not None:
        text = F.when(F.col("text").isNull(), F.raise_error(F.lit("an annotation without a text"))).otherwise(F.translate("text", "\x14\x15\x00", "   "))
        tal = F.struct("onset", build_tal(F.col("onset"), F.col("duration"), text).alias("tal"))
        blocks = annotations.select(who(annotations), F.col("record").cast("bigint").alias("record"), tal.alias("tal")).groupBy("recording", "record").agg(F.array_sort(F.collect_list("tal"))["tal"].alias("tals"))
        lost = blocks.join(sizes, "recording", "left").where("records IS NULL OR record IS NULL OR record < 0 OR record >= records").select("recording", "record").first()
        if lost is not None:
            raise ValueError(f"annotations of record {lost.record} of {lost.recording}, which has no samples")
        size = F.octet_length(F.concat_ws("", "tals")) + F.length(F.format_string("+%.3f", F.col("record") * float(record_seconds))) + (3 if starts is None else 12)
        samples = max(ANNOTATION_SAMPLES, -(-(blocks.agg(F.max(size)).first()[0] or 0) // 2))
        if samples >= 10**8:
            raise ValueError(f"{samples} samples of annotations a record are more than the header's field can say")
        marks.append(blocks)
    if starts is not None:
        marks.append(starts.select(who(starts), F.col("record").cast("bigint").alias("record"), F.col("start_s").cast("double").alias("start_s")))
    told = marks[0]
    for more in marks[1:]:
        told = told.unionByName(more, allowMissingColumns=True)
    told = told.select("recording", "record", *[(F.col(c) if c in told.columns else F.lit(None)).cast(kind).alias(c) for c, kind in (("records", "bigint"), ("start_s", "double"), ("tals", "array<string>"))])
    if len(marks) > 2:  # a record's annotations and start are one row
        told = told.groupBy("recording", "record").agg(*[F.max(c).alias(c) for c in ("records", "start_s", "tals")])
    both = kept.unionByName(told.withColumn("signal_index", F.lit(-1)), allowMissingColumns=True).withColumn("share", F.floor(F.greatest("record", F.lit(0)) / step).cast("bigint"))
    ordered = both.repartition("recording", "share").sortWithinPartitions("recording", "share", "record", "signal_index", "k")
    writer = ordered.write.format("edf").option("record_seconds", str(record_seconds)).option("patient", patient).option("recording", recording).option("gaps", str(starts is not None).lower())
    for name, value in (("annotation_samples", samples), ("in_place", in_place if in_place is None else str(in_place).lower())):
        writer = writer if value is None else writer.option(name, str(value))
    writer.mode("append").save(path)
    put_together(spark, path)


def record_to(records: DataFrame, path: str, checkpoint: str, signals: list[dict], start_us: int, record_seconds: float = RECORD_SECONDS) -> DataStreamWriter:
    """A stream of records (recording, signal_index, record, values), to be started: one growing file a recording.

    signals: label, physical_min, physical_max, samples_per_record of each, in order.
    """
    records.sparkSession.dataSource.register(EdfSource)
    rows = records.select(F.col("recording").cast("string").alias("recording"), F.col("signal_index").cast("int").alias("signal_index"), F.col("record").cast("bigint").alias("record"), "values")
    return rows.writeStream.format("edf").option("path", path).option("checkpointLocation", checkpoint).option("record_seconds", str(record_seconds)).option("start_us", str(start_us)).option("signals", json.dumps(signals)).outputMode("append")


def stream_recordings(spark: SparkSession, path: str, kind: str = "samples") -> DataFrame:
    """The recordings below a folder as they grow."""
    spark.dataSource.register(EdfSource)
    return spark.readStream.format("edf").option("kind", kind).load(path)


def read_recordings(spark: SparkSession, path: str, kind: str = "samples", signals: str | None = None) -> DataFrame:
    spark.dataSource.register(EdfSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("edf").option("kind", kind)
    return (reader.option("signals", signals) if signals else reader).load(path)
