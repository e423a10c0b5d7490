"""EDF files: round trips, header fields, annotations, push-down."""

import numpy as np
import pytest

from hypnoflow.sources import edf


def rows(name, labels, records, n, start=1_700_000_000_000_000):
    return [(name, i, label, r, k, float(np.sin(r * n + k + i) * 90), -100.0, 100.0, start) for i, label in enumerate(labels) for r in range(records) for k in range(n)]


SCHEMA = "recording string, signal_index int, label string, record bigint, k bigint, value double, physical_min double, physical_max double, start_us bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edf") / "night")
    df = spark.createDataFrame(rows("one", ["EEG", "ECG"], 5, 40) + rows("two", ["EEG"], 700, 30), SCHEMA)
    edf.write_recordings(df.repartition(6), path, 2.0)
    return path


def test_round_trip(spark, folder):
    got = edf.read_recordings(spark, folder).collect()
    assert len(got) == 2 * 5 * 40 + 700 * 30
    one = sorted((r for r in got if "/one-" in r.path and r.label == "ECG"), key=lambda r: r.seq)
    want = [np.sin(r * 40 + k + 1) * 90 for r in range(5) for k in range(40)]
    assert np.allclose([r.value for r in one], want, atol=200 / 65535)
    assert [r.ts_us for r in one[:3]] == [1_700_000_000_000_000 + 50_000 * i for i in range(3)]


def test_header_and_signals(spark, folder):
    head = {r.path.rsplit("/", 1)[1][:3]: r for r in edf.read_recordings(spark, folder, "header").collect()}
    assert (head["one"].data_records, head["one"].record_duration, head["one"].signal_count, head["two"].data_records) == (5, 2.0, 3, 700)
    signals = edf.read_recordings(spark, folder, "signals").where("path like '%/one-%'").orderBy("signal_index").collect()
    assert [(s.label, s.samples_per_record, s.byte_offset) for s in signals] == [("EEG", 40, 0), ("ECG", 40, 80), (edf.ANNOTATIONS, 64, 160)]
    assert edf.read_recordings(spark, folder, "annotations").count() == 0  # time-keeping entries have no text


def test_selection(spark, folder):
    assert edf.read_recordings(spark, folder, signals="ECG").count() == 200
    assert edf.read_recordings(spark, folder).where("record = 3 and signal_index = 0").count() == 70
    assert edf.read_recordings(spark, folder).where("record >= 698").count() == 60
    reader = edf.EdfReader({"path": "x"})
    assert list(reader.pushFilters([edf.EqualTo(("signal_index",), 1), edf.EqualTo(("record",), 4)])) == [] and reader.records == [4, 5]


def by_hand(path, data_records, signals, blocks):
    path.write_bytes(edf.build_header(473_385_600_000_000, signals, data_records, 1.0) + b"".join(blocks))


def test_files_by_hand(spark, tmp_path):
    signal = {"label": "EEG", "physical_min": -10, "physical_max": 10, "digital_min": -100, "digital_max": 100, "samples_per_record": 2}
    notes = {"label": edf.ANNOTATIONS, "physical_min": -1, "physical_max": 1, "digital_min": -32768, "digital_max": 32767, "samples_per_record": 16}
    flat = signal | {"label": "EEG", "physical_max": -10}
    record = lambda t, text: np.array([50, -100], "<i2").tobytes() + text.ljust(32, b"\x00") + np.array([1, 2], "<i2").tobytes()
    blocks = [record(0, b"+0\x14\x14\x00+0.5\x152\x14Apnoea\x14\x00"), record(1, b"+1\x14\x14\x00")]
    by_hand(tmp_path / "a.edf", -1, [signal, notes, flat], blocks)  # never closed: the count follows from the size
    got = edf.read_recordings(spark, str(tmp_path / "a.edf")).orderBy("signal_index", "seq").collect()
    assert [r.value for r in got] == [5.0, -10.0, 5.0, -10.0, -10.0, -10.0, -10.0, -10.0]
    found = edf.read_recordings(spark, str(tmp_path / "a.edf"), "annotations").collect()
    assert [(r.record, r.onset, r.duration, r.text) for r in found] == [(0, 0.5, 2.0, "Apnoea")]
    assert edf.read_recordings(spark, str(tmp_path), signals="EEG").count() == 4  # the first of two equal labels
    assert edf.read_recordings(spark, str(tmp_path / "a.edf"), "header").first().start_us == 473_385_600_000_000


def test_records_with_gaps(spark, tmp_path):
    signal = {"label": "EEG", "physical_min": -10, "physical_max": 10, "digital_min": -100, "digital_max": 100, "samples_per_record": 2}
    notes = {"label": edf.ANNOTATIONS, "physical_min": -1, "physical_max": 1, "digital_min": -32768, "digital_max": 32767, "samples_per_record": 16}
    record = lambda text: np.array([50, -100], "<i2").tobytes() + text.ljust(32, b"\x00")
    by_hand(tmp_path / "d.edf", 4, [signal, notes], [record(b"+0.25\x14\x14\x00"), record(b"+1.25\x14\x14\x00"), record(b"+61.5\x14\x14\x00+61.75\x14Arousal\x14\x00"), record(b"")])
    start = 473_385_600_000_000
    got = edf.read_recordings(spark, str(tmp_path / "d.edf"), "records").orderBy("record").collect()
    assert [(r.record, r.start_s, r.start_us - start) for r in got] == [(0, 0.25, 250_000), (1, 1.25, 1_250_000), (2, 61.5, 61_500_000), (3, 3.0, 3_000_000)]
    samples = edf.read_recordings(spark, str(tmp_path / "d.edf")).orderBy("seq").collect()
    assert [r.ts_us - start for r in samples] == [250_000, 750_000, 1_250_000, 1_750_000, 61_500_000, 62_000_000, 3_000_000, 3_500_000]
    assert [r.seq for r in samples] == list(range(8))


def test_shares_of_a_file(spark, folder, monkeypatch):
    monkeypatch.setattr(edf, "PARTITION_BYTES", 5000)
    monkeypatch.setattr(edf, "RUN_BYTES", 700)
    monkeypatch.setattr(edf, "BATCH_SAMPLES", 50)
    reader = edf.EdfReader({"path": folder})
    parts = reader.partitions()
    assert len(parts) > 20
    got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(got) == 2 * 5 * 40 + 700 * 30 and len({(r["path"], r["signal_index"], r["seq"]) for r in got}) == len(got)
    assert {r["record"] for r in got if "/two-" in r["path"]} == set(range(700))


@pytest.mark.parametrize("field", ["physical_min", "digital_max", "samples_per_record"])
def test_unreadable_numbers_are_errors(tmp_path, field):
    signal = {"label": "EEG", "physical_min": -10, "physical_max": 10, "digital_min": -100, "digital_max": 100, "samples_per_record": 2} | {field: "ten"}
    by_hand(tmp_path / "x.edf", 1, [signal], [b"\x00" * 4])
    with open(tmp_path / "x.edf", "rb") as f, pytest.raises(ValueError, match=field):
        edf.read_header(f, 516)


def test_ranges_of_annotations_may_be_blank(spark, tmp_path):
    notes = {"label": edf.ANNOTATIONS, "physical_min": "", "digital_max": "", "samples_per_record": 16}
    by_hand(tmp_path / "n.edf", 1, [notes], [b"+0\x14\x14\x00+2\x14Lights out\x14\x00".ljust(32, b"\x00")])
    assert [(r.onset, r.text) for r in edf.read_recordings(spark, str(tmp_path / "n.edf"), "annotations").collect()] == [(2.0, "Lights out")]
    assert edf.read_recordings(spark, str(tmp_path / "n.edf")).count() == 0


def test_quantising():
    s = {"physical_min": -10, "physical_max": 10, "digital_min": -100, "digital_max": 100}
    assert edf.to_digital(np.array([0.25, -0.25, 99, -99, np.nan]), s).tolist() == [3, -2, 100, -100, 0]
    assert edf.to_digital(np.array([1.0]), s | {"physical_max": -10}).tolist() == [0]
    assert len(edf.build_header(0, [s | {"label": "é" * 30, "samples_per_record": 1}], 1)) == 512


def test_incomplete_record_is_an_error(spark, tmp_path):
    bad = rows("x", ["A"], 2, 4)[:-1]
    with pytest.raises(Exception, match="does not have the samples"):
        edf.write_recordings(spark.createDataFrame(bad, SCHEMA), str(tmp_path / "bad"))


def test_annotations_are_written(spark, tmp_path):
    notes = [("x", 1, 2.5, None, "b"), ("x", 1, 2.0, 1.25, "a"), ("x", 0, 0.0, None, "long " * 40)]
    df = spark.createDataFrame(rows("x", ["A"], 3, 4), SCHEMA)
    edf.write_recordings(df, str(tmp_path / "n"), 2.0, spark.createDataFrame(notes, "recording string, record bigint, onset double, duration double, text string"), patient="P1 F X Ann")
    got = edf.read_recordings(spark, str(tmp_path / "n"), "annotations").orderBy("onset").collect()
    assert [(r.record, r.onset, r.duration, r.text) for r in got] == [(0, 0.0, None, "long " * 40), (1, 2.0, 1.25, "a"), (1, 2.5, None, "b")]
    assert edf.read_recordings(spark, str(tmp_path / "n"), "header").first().patient_id == "P1 F X Ann"


def files_of(path):
    return {f.name.rsplit("-", 1)[0]: f.read_bytes() for f in path.iterdir() if f.suffix == ".edf"}


def test_shares_make_the_file_that_one_task_makes(spark, tmp_path):
    """Whatever the shares and the store: the same bytes, with annotations, several recordings, ranges and widths."""
    notes = spark.createDataFrame([("one", r, r * 2.0 + 0.5, None, f"n{r}") for r in range(0, 97, 3)] + [("a b", 2, 4.0, 1.0, "x")], "recording string, record bigint, onset double, duration double, text string")
    data = rows("one", ["EEG", "ECG"], 97, 8) + rows("two", ["EEG"], 3, 5) + rows("a b", ["A", "B", "C"], 4, 2) + rows("a_b", ["A"], 4, 2)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for name, partitions, in_place in (("many", "16", None), ("one", "1", None), ("parts", "16", False)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            edf.write_recordings(df, str(tmp_path / name), 2.0, notes, in_place=in_place)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    made = [files_of(tmp_path / name) for name in ("many", "one", "parts")]
    assert made[0] == made[1] == made[2] and len(made[0]) == 4
    assert not [f for name in ("many", "one", "parts") for f in (tmp_path / name).iterdir() if f.suffix == ".part" or "shares" in f.name]
    again = [edf.read_recordings(spark, str(tmp_path / name), "annotations").count() for name in ("many", "parts")]
    assert again == [34, 34] and edf.read_recordings(spark, str(tmp_path / "many")).count() == len(data)


def test_repeated_tasks_change_nothing(tmp_path):
    """A share that is written twice, by two tasks, leaves the file as it is."""
    import pyarrow as pa

    writer = edf.EdfWriter(str(tmp_path), 1.0, "X X X X", "Startdate X X X X")
    names = ["recording", "share", "record", "signal_index", "k", "value", "label", "physical_min", "physical_max", "start_us", "records", "start_s", "tals"]
    mark = ("n", 0, -1, -1, None, None, None, None, None, None, 6, None, None)
    shares = [[mark]] + [[]] * 2
    shares = [s + [("n", i, r, 0, k, float(r * 3 + k), "A", -100.0, 100.0, 0, None, None, None) for r in (2 * i, 2 * i + 1) for k in range(3)] for i, s in enumerate(shares)]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.string())]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*s), kinds)], names) for s in shares]
    messages = [writer.write(iter([batches[i].slice(j, 2) for j in range(0, batches[i].num_rows, 2)])) for i in (2, 0, 1)]
    first = next(tmp_path.glob("*.part")).read_bytes()
    writer.write(iter([batches[1], batches[2]]))
    assert next(tmp_path.glob("*.part")).read_bytes() == first
    with pytest.raises(ValueError, match="record 2"):
        writer.commit([messages[0], messages[1]])
    with pytest.raises(ValueError, match="record 4"):
        writer.commit(messages[1:])
    writer.commit(messages)
    head = next(tmp_path.glob("*.edf")).read_bytes()
    assert head[edf.COUNT_AT : edf.COUNT_AT + 8] == b"6       " and len(head) == 768 + 6 * (6 + 128)
    writer.abort([])


def test_recordings_that_are_not_whole(spark, tmp_path):
    for i, (bad, what) in enumerate([([r for r in rows("x", ["A"], 5, 4) if r[3] != 2], "record 2"), (rows("x", ["A"], 2, 4) + [("x", 1, "B", 1, 0, 1.0, -1.0, 1.0, 0)], "samples"), ([r for r in rows("x", ["A"], 3, 4) if r[3]], "record 0")]):
        with pytest.raises(Exception, match=what):
            edf.write_recordings(spark.createDataFrame(bad, SCHEMA), str(tmp_path / f"b{i}"))
        assert not list((tmp_path / f"b{i}").glob("*.edf"))
    notes = spark.createDataFrame([("x", 0, 0.0, None, None)], "recording string, record bigint, onset double, duration double, text string")
    with pytest.raises(Exception, match="without a text"):
        edf.write_recordings(spark.createDataFrame(rows("x", ["A"], 1, 4), SCHEMA), str(tmp_path / "t"), annotations=notes)
    odd = spark.createDataFrame([("x", 0, 0.0, None, "a\x14b\x15c\x00d")], notes.schema)
    edf.write_recordings(spark.createDataFrame(rows("x", ["A"], 1, 4) + [(None, *r[1:]) for r in rows("", ["A"], 2, 4)], SCHEMA), str(tmp_path / "o"), annotations=odd)
    assert [r.text for r in edf.read_recordings(spark, str(tmp_path / "o"), "annotations").collect()] == ["a b c d"]
    assert {p.rsplit("/", 1)[1].split("-")[0] for p in (r.path for r in edf.read_recordings(spark, str(tmp_path / "o"), "header").collect())} == {"x", "null"}
    edf.write_recordings(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"))
    assert edf.read_recordings(spark, str(tmp_path / "e")).count() == 0


def test_starts_of_records(spark, tmp_path):
    starts = spark.createDataFrame([("x", 1, 7.25), ("x", 2, 3600.0)], "recording string, record bigint, start_s double")
    notes = spark.createDataFrame([("x", 1, 7.5, None, "here")], "recording string, record bigint, onset double, duration double, text string")
    edf.write_recordings(spark.createDataFrame(rows("x", ["A"], 3, 2), SCHEMA), str(tmp_path / "g"), 2.0, notes, starts=starts)
    got = edf.read_recordings(spark, str(tmp_path / "g"), "records").orderBy("record").collect()
    assert [r.start_s for r in got] == [0.0, 7.25, 3600.0]
    assert next((tmp_path / "g").glob("*.edf")).read_bytes()[192:197] == b"EDF+D"
    samples = edf.read_recordings(spark, str(tmp_path / "g")).orderBy("seq").collect()
    assert [r.ts_us - 1_700_000_000_000_000 for r in samples] == [0, 1_000_000, 7_250_000, 8_250_000, 3_600_000_000, 3_601_000_000]
    assert [r.text for r in edf.read_recordings(spark, str(tmp_path / "g"), "annotations").collect()] == ["here"]


LIVE = [{"label": "A", "physical_min": -10.0, "physical_max": 10.0, "samples_per_record": 2}, {"label": "B", "physical_min": 0.0, "physical_max": 1.0, "samples_per_record": 1}]


def come(folder, batch, records, who=("n",)):
    """A file of records for the stream to find."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    data = [(w, i, r, [float(r), -float(r)] if i == 0 else [r / 100]) for w in who for r in records for i in (1, 0)]
    kinds = [("recording", pa.string()), ("signal_index", pa.int32()), ("record", pa.int64()), ("values", pa.list_(pa.float64()))]
    folder.mkdir(exist_ok=True)
    pq.write_table(pa.table([pa.array(c, k) for c, (_, k) in zip(zip(*data), kinds)], names=[n for n, _ in kinds]), folder / f"{batch}.parquet")


def test_recorder_and_reader_that_stop_and_start(spark, tmp_path):
    """Records come in batches; recorder and reader are new queries each time; the reader sees every sample once."""
    schema = "recording string, signal_index int, record bigint, values array<double>"

    def recorded():
        records = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        edf.record_to(records, str(tmp_path / "out"), str(tmp_path / "c1"), LIVE, 1_700_000_000_000_000, 1.0).trigger(availableNow=True).start().awaitTermination()

    def read():
        edf.stream_recordings(spark, str(tmp_path / "out")).writeStream.format("parquet").option("path", str(tmp_path / "read")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "read")).count()

    come(tmp_path / "in", "a", range(3))
    recorded()
    assert read() == 9 and read() == 9
    head = edf.read_recordings(spark, str(tmp_path / "out"), "header").first()
    assert head.data_records == 3 and next((tmp_path / "out").glob("*.edf")).read_bytes()[edf.COUNT_AT : edf.COUNT_AT + 8] == b"-1      "
    come(tmp_path / "in", "b", range(3, 5), ("n", "m/1"))
    come(tmp_path / "in", "c", range(0, 3), ("m/1",))
    recorded()
    # half a record at the end, as a writer leaves it that is killed
    (name,) = [f for f in (tmp_path / "out").glob("n-*.edf")]
    with open(name, "ab") as f:
        f.write(b"xxx")
    assert read() == 30
    come(tmp_path / "in", "d", range(5, 6))
    recorded()
    assert read() == 33
    edf.stop_recordings(spark, str(tmp_path / "out"))
    got = edf.read_recordings(spark, str(tmp_path / "out")).collect()
    assert {r.data_records for r in edf.read_recordings(spark, str(tmp_path / "out"), "header").collect()} == {6, 5}
    once = spark.read.parquet(str(tmp_path / "read")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, once)) and len(once) == 33
    assert all(abs(r.value - (r.record * (1 - 2 * (r.seq % 2)) if r.label == "A" else r.record / 100)) < 1e-3 for r in got)


def test_recorder_repeats_a_batch(tmp_path):
    import pyarrow as pa

    recorder = edf.EdfRecorder(str(tmp_path), 1.0, 0, LIVE, "X X X X", "Startdate X X X X")
    data = [("n", i, r, [1.0 * r] * (2 - i)) for r in range(4) for i in (0, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*data)], ["recording", "signal_index", "record", "values"])
    recorder.write(iter([batch.slice(0, 4)]))
    recorder.write(iter([batch]))
    first = next(tmp_path.glob("*.edf")).read_bytes()
    recorder.write(iter([batch]))
    assert next(tmp_path.glob("*.edf")).read_bytes() == first and len(first) == 1024 + 4 * (6 + 128)
    with pytest.raises(ValueError, match="samples of B"):
        recorder.write(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(("n", 1, 0, [1.0, 2.0]))], batch.schema.names)]))
    with pytest.raises(Exception):
        edf.EdfRecorder("s3://bucket/x", 1.0, 0, LIVE, "", "")


def test_sensor_signals(spark):
    from hypnoflow.functions.sensors import signals_of

    raw = signals_of(spark, "motion", "raw", "Arm", 5.0).collect()
    assert len(raw) == 9 and raw[0].label == "Arm Accel X" and raw[0].samples_per_record == 150
    for bad in (("motion", "raw", "", 3.0), ("odd",)):
        with pytest.raises(ValueError):
            signals_of(spark, *bad)


def test_recording_covers_all_events(spark, tmp_path):
    from datetime import datetime, timedelta

    from hypnoflow.plans import live

    start = datetime(2024, 1, 1, 0, 30)
    events = [(i, i % 3, "ab"[i % 2], start + timedelta(hours=13 * i), float(10 + i)) for i in range(60)]  # over 32 days
    spark.createDataFrame(events, "event_id bigint, user_id bigint, event_type string, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    rows = live.recording(spark, str(tmp_path)).where("value <> 0").select("label", "record", "value").distinct().collect()
    assert {(r.label, r.record, r.value) for r in rows} == {("ab"[i % 2], 13 * i, 10.0 + i) for i in range(60)}
    back = live.edf_roundtrip(spark, str(tmp_path)).where("value > 1").select("record").distinct().collect()
    assert {r.record for r in back} == {13 * i for i in range(60)}


def test_all_annotations_are_written(spark, tmp_path):
    notes = [("x", i % 3, float(i % 3 * 2) + i / 1000, None, f"note {i} é") for i in range(200)] + [("x", 1, 2.5, 1.5, "long " * 100)]
    schema = "recording string, record bigint, onset double, duration double, text string"
    df = spark.createDataFrame(rows("x", ["A"], 3, 4), SCHEMA)
    edf.write_recordings(df, str(tmp_path / "n"), 2.0, spark.createDataFrame(notes, schema))
    got = edf.read_recordings(spark, str(tmp_path / "n"), "annotations").collect()
    assert sorted((r.record, r.text) for r in got) == sorted((n[1], n[4]) for n in notes)
    assert edf.read_recordings(spark, str(tmp_path / "n")).count() == 12
    with pytest.raises(ValueError, match="record 7"):
        edf.write_recordings(df, str(tmp_path / "m"), 2.0, spark.createDataFrame([("x", 7, 1.0, None, "a")], schema))


def test_folders_off_one_machine_must_be_named(monkeypatch):
    from types import SimpleNamespace

    from hypnoflow.plans import live

    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="spark://elsewhere:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        live.shared_dir(spark)
    spark.conf.get = lambda key, default: "hdfs://a/b"
    assert live.shared_dir(spark).startswith("hdfs://a/b/")
