"""Operators on long series tables: rows of (series, ts, value), one series per signal of a recording."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from datetime import datetime, timedelta
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.kernels import BeatMap, HrvWindow, ThinMap, beat_ms, beats_after, last_after, thinned


def by_time(series: str = "series", *order: str) -> "Window":
    return Window.partitionBy(series).orderBy(*(order or ("us", "event_id")))


#: A table is cut into so many stretches of time for each shuffle partition, which are worked on by themselves.
STRETCHES = 4


def splitters(df: DataFrame, time: str) -> list[float]:
    """Times that cut df into stretches of about the same number of rows, wherever its rows lie in time: quantiles from a sketch.

    They are found once, by an action, and are constants from then on. Operators on the same rows can share them.
    """
    parts = STRETCHES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.col(time).cast("double")
    found = df.select(at.alias("t")).where(~F.isnan("t")).agg(F.percentile_approx("t", [i / parts for i in range(1, parts)], max(10_000, 20 * parts))).first()[0]
    return sorted(set(found or ()))


def stretched(df: DataFrame, time: str, splits: Sequence[float] | None = None) -> DataFrame:
    """df with _part, the stretch of time that a row is in, in order; rows without a time come before all others.

    The stretch follows from the row alone, so it is the same wherever and whenever the row is read. A stretch holds about an equal share
    of the table's rows, so no series fills one task, however many rows it has; rows of one and the same time are in one stretch.
    """
    splits = splitters(df, time) if splits is None else sorted(set(splits))
    if not splits:
        return df.withColumn("_part", F.lit(0).cast("bigint"))
    cut = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="_at", outputCol="_cut", handleInvalid="keep")
    placed = cut.transform(df.withColumn("_at", F.col(time).cast("double")))
    return placed.withColumn("_part", F.when(F.col("_at").isNull(), F.lit(-1)).otherwise(F.col("_cut")).cast("bigint")).drop("_at", "_cut")


def long_series(df: DataFrame, series: str) -> list:
    """The series of more rows than a stretch would hold: fewer than there are stretches. Rows of the others need not be cut to be a small part of a task's."""
    parts = STRETCHES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = df.groupBy(F.col(series).alias("_series")).agg(F.count(F.lit(1)).alias("_n"))
    seen = sizes.agg(F.sum("_n").alias("rows"), F.max("_n").alias("most")).first()
    if seen.rows is None or seen.most * parts <= seen.rows:
        return []
    return [r._series for r in sizes.where(F.col("_n") * parts > seen.rows).select("_series").collect()]


def among(names: list, series: str) -> Column:
    """Whether the series is one of the names, which may hold null."""
    return F.when(F.col(series).isNull(), F.lit(None in names)).otherwise(F.col(series).isin([x for x in names if x is not None]))


def parts_before(series: str) -> "Window":
    return Window.partitionBy(series).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def with_starts(placed: DataFrame, totals: DataFrame, series: str, starts: Mapping[str, Column], order: Sequence[str]) -> tuple[DataFrame, "Window"]:
    """placed (series, _part, ...), with a row before those of each part that holds the `starts`, and the window to work in.

    starts are made of the totals (series, _part, ...) of all parts of a series, one row each. Such a row has _row = 0, the others 1; it is null in
    all other columns. Rows and starts meet in the window's own shuffle, with no join.
    """
    first = totals.select(series, "_part", F.lit(0).alias("_row"), *[c.alias(k) for k, c in starts.items()])
    both = placed.withColumn("_row", F.lit(1)).unionByName(first, allowMissingColumns=True)
    return both, Window.partitionBy(series, "_part").orderBy("_row", *order)


def so_far(w: "Window") -> "Window":
    return w.rowsBetween(Window.unboundedPreceding, 0)


def numbered(df: DataFrame, series: str = "series", *order: str, splits: Sequence[float] | None = None) -> DataFrame:
    """df with seq, the row's place in its series from 0.

    Rows are numbered in stretches of time (of the first order column, a number), and offset by what stretches before hold of the
    series; so a series that is most of the table is numbered by many tasks.
    """
    order = order or ("us", "event_id")
    placed = stretched(df, order[0], splits)
    counts = placed.groupBy(series, "_part").agg(F.count(F.lit(1)).alias("_total"))
    both, w = with_starts(placed, counts, series, {"_before": F.coalesce(F.sum("_total").over(parts_before(series)), F.lit(0))}, order)
    out = both.withColumn("seq", F.row_number().over(w) - 2 + F.first("_before").over(so_far(w))).where("_row = 1")
    return out.drop("_part", "_row", "_before")


def viewport(df: DataFrame, x0: int, x1: int, us: str = "us") -> DataFrame:
    """Samples in (x0, x1], in epoch microseconds: the lower bound is outside, the upper inside.

    us is a number of microseconds or a timestamp; bounds on a column as it is stored reach the scan.
    """
    kind = df.schema[us].dataType.simpleString()
    lo, hi = (F.lit(x) for x in (x0, x1))
    if kind.startswith("timestamp"):
        text = [(datetime(1970, 1, 1) + timedelta(microseconds=x)).isoformat(" ") for x in (x0, x1)]
        lo, hi = (F.lit(t).cast("timestamp_ntz") if kind == "timestamp_ntz" else F.lit(f"{t}+00:00").cast("timestamp") for t in text)
    return df.where((F.col(us) > lo) & (F.col(us) <= hi))


def asof(probes: DataFrame, samples: DataFrame, series: str = "series", us: str = "us", order: str = "event_id", splits: Sequence[float] | None = None) -> DataFrame:
    """probes with value and found_us of the last sample at or before each (the last of equal times), null if none.

    Both sides go through one sort by series and stretch of time, and each stretch takes over what was last seen before it;
    nothing is broadcast or compared pairwise, and a long series is many tasks.
    """
    a = samples.select(series, us, F.lit(0).alias("_probe"), F.col(order).alias("_order"), F.struct(F.col("value"), F.col(us).alias("found_us")).alias("_seen"))
    both = stretched(probes.withColumn("_probe", F.lit(1)).unionByName(a, allowMissingColumns=True), us, splits)
    totals = both.groupBy(series, "_part").agg(F.max_by("_seen", F.when(F.col("_probe") == 0, F.struct(us, "_order"))).alias("_total"))
    rows, w = with_starts(both, totals, series, {"_seen": F.last("_total", ignorenulls=True).over(parts_before(series))}, (us, "_probe", "_order"))
    seen = rows.withColumn("_seen", F.last("_seen", ignorenulls=True).over(so_far(w))).where("_row = 1 AND _probe = 1")
    return seen.select(*probes.columns, F.col("_seen.value").alias("value"), F.col("_seen.found_us").alias("found_us"))


def extent(df: DataFrame, us: str = "us") -> DataFrame:
    """First and last time of every series, and of all series."""
    own = df.groupBy("series").agg(F.min(us).alias("first_us"), F.max(us).alias("last_us"), F.count(F.lit(1)).alias("n"))
    return own.unionByName(own.agg(F.lit(None).cast("string").alias("series"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("n").alias("n")))


#: Bits of a key that one round of selection looks at, and a bound of the table of series that is broadcast.
DIGIT_BITS = 16
BROADCAST_SERIES = 200_000
#: A series with more than this share of the rows is heavy; there are at most so many.
HEAVY = 1024


def sort_keys(rows: DataFrame, value: str = "value") -> DataFrame:
    """rows with _key, a long that is in the order of the values when taken as unsigned; -0.0 is 0.0, and numbers that are neither whole nor
    floating are taken as doubles. Rows without a number go."""
    kind = rows.schema[value].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return rows.where(F.col(value).isNotNull()).withColumn("_key", F.col(value).cast("bigint").bitwiseXOR(F.lit(-(1 << 63))))
    double = rows.withColumn(value, F.col(value).cast("double") + F.lit(0.0)).where(F.col(value).isNotNull() & ~F.isnan(value))
    names = [*double.columns, "_key"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch[value].to_numpy(zero_copy_only=False).view(np.int64)
            # negative numbers are turned round, the others get the highest bit
            key = np.where(bits < 0, ~bits, bits ^ np.int64(-(1 << 63)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], names)

    return double.mapInArrow(of, StructType([*double.schema.fields, StructField("_key", LongType())]))


def met(rows: DataFrame, table: DataFrame, on: str, heavy: list, small: bool) -> DataFrame:
    """rows joined with a table of one row for each series: broadcast where it is small, else only the rows of heavy series."""
    table = table.withColumnRenamed(on, "_on")
    same = F.col(on).eqNullSafe(F.col("_on"))
    if small:
        return rows.join(F.broadcast(table), same).drop("_on")
    few = rows.where(among(heavy, on)).join(F.broadcast(table.where(among(heavy, "_on"))), same)
    return few.unionByName(rows.where(~among(heavy, on)).join(table.where(~among(heavy, "_on")), same)).drop("_on")


def selected(df: DataFrame, group: str, rank: Callable[[Column], Column], value: str = "value") -> DataFrame:
    """group, value: of each group the sample of the rank from 1 that `rank` gives for its size; groups without such a rank have no row.

    Radix selection: values become keys of 64 bits, and each of four rounds counts the rows of every group by 16 bits more and keeps
    those that share the bits of the one looked for. Counts are added up before they are shuffled, at most 65,536 of them for a group come
    together, and no task sorts or holds a group's samples. The counts of groups (a key and a few numbers each) are broadcast if
    there are BROADCAST_SERIES at most; beyond, the rows of groups larger than 1 / HEAVY of all, HEAVY at most, still stay where they are.
    """
    kind = df.schema[value].dataType
    rows = sort_keys(df.select(F.col(group).alias("_group"), F.col(value).alias("value")))
    held = rows.schema["value"].dataType
    sizes = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_n"))
    seen = sizes.agg(F.count(F.lit(1)).alias("groups"), F.sum("_n").alias("rows")).first()
    small = seen.groups <= BROADCAST_SERIES
    heavy = [] if small else [r._group for r in sizes.where(F.col("_n") * HEAVY > seen.rows).select("_group").collect()]
    # what is known of a group: the first bits of the key that is looked for, and its rank among the keys that share them
    state = sizes.select("_group", F.lit(0).cast("bigint").alias("_prefix"), rank(F.col("_n")).cast("bigint").alias("_rank")).where("_rank >= 1")
    start = F.struct(F.lit(None).cast("bigint").alias("digit"), F.col("_rank").alias("left"), F.lit(None).cast(held).alias("value"))

    def step(at: Column, x: Column) -> Column:
        """Goes past the digits that hold fewer than are left."""
        found = F.struct(x["_digit"].alias("digit"), at["left"].alias("left"), x["_value"].alias("value"))
        past = F.struct(at["digit"].alias("digit"), (at["left"] - x["_n"]).alias("left"), at["value"].alias("value"))
        return F.when(at["digit"].isNotNull(), at).when(at["left"] <= x["_n"], found).otherwise(past)

    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        digit = F.shiftrightunsigned("_key", shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
        inside = met(rows, state, "_group", heavy, small)
        if shift < 64 - DIGIT_BITS:
            inside = inside.where(F.shiftrightunsigned("_key", shift + DIGIT_BITS) == F.col("_prefix"))
        counts = inside.groupBy("_group", "_prefix", "_rank", digit.alias("_digit")).agg(F.count(F.lit(1)).alias("_n"), F.min("value").alias("_value"))
        table = counts.groupBy("_group", "_prefix", "_rank").agg(F.array_sort(F.collect_list(F.struct("_digit", "_n", "_value"))).alias("_counts"))
        found = table.select("_group", "_prefix", F.aggregate("_counts", start, step).alias("_at")).where("_at.digit IS NOT NULL")
        state = found.select("_group", (F.shiftleft("_prefix", DIGIT_BITS) + F.col("_at.digit")).alias("_prefix"), F.col("_at.left").alias("_rank"), F.col("_at.value").alias("value"))
        value_of, state = state, state.drop("value")
    return value_of.select(F.col("_group").alias(group), F.col("value").cast(kind))


def percentile(df: DataFrame, group: str, p: float, method: str = "nearest_rank", value: str = "value") -> DataFrame:
    """group, value: the sample at rank ceil(p n) ("nearest_rank", at least 1) or floor(p (n - 1)) + 1 ("lower")."""
    p = min(max(p, 0.0), 1.0)
    if method not in ("nearest_rank", "lower"):
        raise ValueError(f"no percentile method {method}")
    nearest = lambda n: F.greatest(F.ceil(F.lit(p) * n), F.lit(1))
    lower = lambda n: F.floor(F.lit(p) * (n - 1)) + 1
    return selected(df, group, nearest if method == "nearest_rank" else lower, value).withColumnRenamed(value, "value")


def kth_smallest(df: DataFrame, group: str, k: int, value: str = "value") -> DataFrame:
    """group, value: the k-th smallest from 0; groups of k or fewer samples give no row."""
    if k < 0:
        raise ValueError("k is from 0")
    return selected(df, group, lambda n: F.lit(k + 1), value)


def last_n(df: DataFrame, n: int | Column, series: str = "series", *order: str) -> DataFrame:
    """The newest n rows of each series: what a ring buffer of capacity n holds."""
    newest = Window.partitionBy(series).orderBy(*[F.desc(c) for c in (order or ("us", "event_id"))])
    return df.withColumn("_age", F.row_number().over(newest)).where(F.col("_age") <= n).drop("_age")


def capacity(rate: Column, samples_per_record: Column, seconds: float = 300.0) -> Column:
    """What a live buffer keeps: five minutes and a record, two records at least."""
    return F.greatest(F.ceil(rate * seconds) + samples_per_record, 2 * samples_per_record)


def carried(df: DataFrame, grid_us: int, stale_us: int, series: str = "series") -> DataFrame:
    """series, us, value on a regular grid from each series' first tick on: the last known value, for at most stale_us."""
    bounds = df.groupBy(series).agg(F.min("us").alias("_a"), F.max("us").alias("_b"))
    first = (F.floor(F.col("_a") / grid_us) + 1) * grid_us
    ticks = F.when(first <= F.col("_b"), F.sequence(first, F.floor(F.col("_b") / grid_us) * grid_us, F.lit(grid_us)))
    probes = bounds.select(series, F.explode(ticks).alias("us"))
    found = asof(probes, df, series)
    return found.where(F.col("us") - F.col("found_us") <= stale_us).select(series, "us", "value", (F.col("us") - F.col("found_us")).alias("age_us"))


def monotonic(df: DataFrame, us: str, series: str = "series", *order: str, splits: Sequence[float] | None = None) -> DataFrame:
    """df with guarded_us: no time before one already seen. Stretches of the first order column are guarded by themselves, and
    by the latest time of those before."""
    order = order or ("us", "event_id")
    placed = stretched(df, order[0], splits).withColumn("_guard", F.col(us))
    totals = placed.groupBy(series, "_part").agg(F.max(us).alias("_total"))
    both, w = with_starts(placed, totals, series, {"_guard": F.max("_total").over(parts_before(series))}, order)
    return both.withColumn("guarded_us", F.max("_guard").over(so_far(w))).where("_row = 1").drop("_part", "_row", "_guard")


def audio_clock(frames: DataFrame, rate: float, series: str = "series", *order: str) -> DataFrame:
    """frames (series, arrived_us, first_frame, samples: array) as samples with us: each chunk starts where the sound card's clock
    puts it relative to the series' first chunk, never before an earlier chunk, and its samples follow at the fixed rate."""
    order = order or ("first_frame",)
    splits = splitters(frames, order[0])
    placed = stretched(frames, order[0], splits)
    # the series' first chunk is that of its first stretch
    totals = placed.groupBy(series, "_part").agg(F.min_by(F.struct("arrived_us", "first_frame"), F.struct(*order)).alias("_total"))
    whole = Window.partitionBy(series).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    both, w = with_starts(placed, totals, series, {"_first": F.first("_total").over(whole)}, order)
    begun = both.withColumn("_first", F.first("_first").over(so_far(w))).where("_row = 1").drop("_part", "_row")
    start = F.col("_first.arrived_us") + F.round((F.col("first_frame") - F.col("_first.first_frame")) * (1e6 / rate)).cast("bigint")
    guarded = monotonic(begun.withColumn("_start", start), "_start", series, *order, splits=splits)
    each = guarded.select(series, "first_frame", "guarded_us", F.posexplode("samples").alias("i", "value"))
    return each.select(series, (F.col("first_frame") + F.col("i")).alias("frame"), (F.col("guarded_us") + F.round(F.col("i") * (1e6 / rate)).cast("bigint")).alias("us"), "value")


def rmssd(df: DataFrame, series: str = "series", value: str = "value", *order: str, splits: Sequence[float] | None = None) -> DataFrame:
    """Root mean square of successive differences; null for series of one sample. A stretch's first row follows the last one before it."""
    order = order or ("us", "event_id")
    placed = stretched(df.select(series, *order, F.col(value).alias("_v")), order[0], splits)
    totals = placed.groupBy(series, "_part").agg(F.max_by("_v", F.struct(*order)).alias("_total"))
    both, w = with_starts(placed, totals, series, {"_v": F.last("_total").over(parts_before(series))}, order)
    step = both.withColumn("_before", F.lag("_v").over(w)).where("_row = 1")
    return step.groupBy(series).agg(F.sqrt(F.avg(F.pow(F.col("_v") - F.col("_before"), F.lit(2.0)))).alias("rmssd"))


class Step(Protocol):
    """What a stretch of rows makes of any state before it; `packed` says so in a few numbers."""

    def push(self, values: Sequence) -> None: ...

    def packed(self) -> tuple: ...


class Judge(Protocol):
    """Goes through rows from a known state."""

    def push(self, values: Sequence) -> Sequence: ...


def composed(
    rows: DataFrame, series: str, order: Sequence[str], column: str, step: Callable[[], Step], packed: Mapping[str, tuple[pa.DataType, str]], after: Callable[[object, tuple], object], state: tuple[pa.DataType, str], judge: Callable[[object], Judge], out: tuple[str, pa.DataType, str]
) -> DataFrame:
    """rows (series, _part, ...) with a column `out`, made of the values of `column`, that seems to need a fold over the whole series, by many tasks.

    Each stretch gives, as `packed` columns, the map from the state before it to the state after it (`step`); the maps, small ones, are applied
    along each series one after the other (`after`, from None); and every stretch is then gone through from its true start (`judge`). Rows are
    shuffled twice by series and stretch, the maps once by series. Rows without a _part are of series that are not cut: they have no maps and are
    shuffled once, as are all rows if there is no column _part.
    """
    names = [c for c in rows.columns if c != "_part"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def runs(batch: pa.RecordBatch, *marks: str) -> Iterator[tuple[tuple, int, Sequence]]:
        """The batch's values by series, stretch and marks, and where they begin."""
        keys = list(zip(*(batch[c].to_pylist() for c in (series, "_part", *marks))))
        nested = pa.types.is_nested(batch[column].type)
        values = batch[column].to_pylist() if nested or batch[column].null_count else batch[column].to_numpy()
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else []
        for a, b in zip(cuts, cuts[1:]):
            yield keys[a], a, values[a:b]

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, kind = None, None, None
        columns = [series, "_part", *packed]

        def table(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), [kind, pa.int64(), *(k for k, _ in packed.values())])], columns)

        for batch in batches:
            kind, found = batch.schema.field(series).type, []
            for at, _, part in runs(batch):
                if held is None or at != now:
                    found += [(*now, *held.packed())] if held is not None else []
                    now, held = at, step()
                held.push(part)
            if found:
                yield table(found)
        if held is not None:
            yield table([(*now, *held.packed())])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, value = object(), None
        for batch in batches:
            starts = []
            for who, *told in zip(*(batch[c].to_pylist() for c in (series, *packed))):
                if who != now:
                    now, value = who, None
                starts.append(value)
                value = after(value, tuple(told))
            yield pa.RecordBatch.from_arrays([batch[series], batch["_part"], pa.array(starts, state[0])], [series, "_part", "_start"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, now = None, None
        for batch in batches:
            told = []
            for (*where, mark), at, part in runs(batch, "_row"):
                if not mark:
                    here, now = where, judge(batch["_start"][at].as_py())
                    continue
                if where != here:
                    here, now = where, judge(None)
                told.extend(now.push(part))
            if told:
                kept = pa.array(np.flatnonzero(batch["_row"].to_numpy() == 1))
                yield pa.RecordBatch.from_arrays([*(batch[c].take(kept) for c in names), pa.array(told, out[1])], [*names, out[0]])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", {out[0]} {out[2]}"
    if "_part" not in rows.columns:
        whole = rows.repartition(series).sortWithinPartitions(series, *order)
        return whole.withColumn("_part", F.lit(0)).withColumn("_row", F.lit(1)).mapInArrow(judged, schema)
    ordered = rows.where("_part IS NOT NULL").repartition(series, "_part").sortWithinPartitions(series, "_part", *order)
    parts = ordered.mapInArrow(maps, ", ".join([f"`{series}` {kinds[series]}", "_part bigint", *(f"{c} {kind}" for c, (_, kind) in packed.items())]))
    starts = parts.repartition(series).sortWithinPartitions(series, "_part").mapInArrow(chained, f"`{series}` {kinds[series]}, _part bigint, _start {state[1]}")
    both = rows.withColumn("_row", F.lit(1)).unionByName(starts.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    told = both.repartition(series, "_part").sortWithinPartitions(series, "_part", "_row", *order)
    return told.mapInArrow(judged, schema)


class BeatStep(BeatMap):
    def push(self, values: Sequence) -> None:
        for intervals in values:
            for seconds in intervals or ():
                ms = beat_ms(seconds)
                if ms is not None:
                    super().push(ms)


class BeatJudge:
    def __init__(self, window: int, tail: list[int] | None) -> None:
        self.kept = HrvWindow(window, tail or ())

    def push(self, values: Sequence) -> list[float | None]:
        return [self.kept.push(x or ()) for x in values]


def heart_rate_variability(df: DataFrame, window: int = 30, series: str = "series", *order: str, splits: Sequence[float] | None = None) -> DataFrame:
    """Every measurement (series, us, event_id, intervals: array of seconds) with hrv, null until two intervals are accepted.

    An interval is judged against the last accepted one, which looks like a fold over the whole series. But what a stretch of beats does
    depends on that one number only: it is a map from the interval accepted before it to those accepted last in it, so the longest series
    is worked on by as many tasks as it has stretches (`composed`). Null, NaN and infinite intervals are never accepted. Only long series are cut
    (`long_series`), unless splits are given.
    """
    HrvWindow(window)
    order = order or ("us", "event_id")
    rows = df.select(series, *order, F.col("intervals").cast("array<double>").alias("intervals"))
    if splits is not None:
        rows = stretched(rows, order[0], splits)
    elif cut := long_series(rows, series):
        in_cut = among(cut, series)
        rows = stretched(rows, order[0], splitters(rows.where(in_cut), order[0])).withColumn("_part", F.when(in_cut, F.col("_part")))
    ints = (pa.list_(pa.int32()), "array<int>")
    packed = {"begin": ints, "owner": ints, "tails": (pa.list_(pa.list_(pa.int32())), "array<array<int>>")}
    out = composed(rows, series, order, "intervals", lambda: BeatStep(window), packed, lambda tail, told: beats_after(tail or [], told, window), ints, lambda tail: BeatJudge(window, tail), ("hrv", pa.float64(), "double"))
    return out.drop("intervals")


class ThinStep:
    def __init__(self, wait: int) -> None:
        self.held = ThinMap(wait)

    def push(self, values: Sequence) -> None:
        self.held.push(np.asarray(values, np.int64))

    def packed(self) -> tuple[list[int], list[int]]:
        return self.held.packed()


class ThinJudge:
    def __init__(self, wait: int, last: int | None) -> None:
        self.wait, self.last = wait, last

    def push(self, values: Sequence) -> list[bool]:
        at = np.asarray(values, np.int64)
        through = thinned(at, self.wait, self.last)
        if through.any():
            self.last = int(at[np.flatnonzero(through)[-1]])
        return through.tolist()


def throttled(df: DataFrame, wait_us: int, series: str = "series", *order: str, splits: Sequence[float] | None = None) -> DataFrame:
    """The rows of df that a throttle lets through: of each series the first, and then always the first that comes wait_us or more after the
    last one let through. Rows without a time (the first order column, whole microseconds) are not let through.

    What a stretch does depends on when the last row before it went through, and only on rows near its beginning: it is a map with a few
    values (`composed`); within it, each row points to the first one that is late enough, and the rows that are reached are found by doubling.
    """
    if wait_us < 0:
        raise ValueError("a throttle does not wait for less than nothing")
    order = order or ("us", "event_id")
    rows = stretched(df.where(F.col(order[0]).isNotNull()).withColumn("_time", F.col(order[0]).cast("bigint")), order[0], splits)
    longs = (pa.list_(pa.int64()), "array<bigint>")
    out = composed(rows, series, order, "_time", lambda: ThinStep(wait_us), {"begin": longs, "last": longs}, lambda last, told: last_after(last, told, wait_us), (pa.int64(), "bigint"), lambda last: ThinJudge(wait_us, last), ("_through", pa.bool_(), "boolean"))
    return out.where("_through").select(*df.columns)


def first_by_label(signals: DataFrame, label: str = "label", index: str = "signal_index") -> DataFrame:
    """One signal per label: the one with the lowest index, as look-ups by label resolve."""
    best = signals.groupBy(label).agg(F.min(index).alias(index))
    return signals.join(best, [label, index], "left_semi")


def matched_drivers(services: DataFrame, drivers: DataFrame) -> DataFrame:
    """device_id and the driver of its first service that any driver handles."""
    known = services.join(drivers, "service_uuid")
    return known.groupBy("device_id").agg(F.min_by("driver", "service_order").alias("driver"), F.min("service_order").alias("service_order"))


def appended(first: DataFrame, more: DataFrame, index: str = "signal_index") -> DataFrame:
    """Both signal tables, those of `more` numbered on after the last of `first`."""
    top = first.agg(F.coalesce(F.max(index) + 1, F.lit(0)).alias("_top"))
    return first.unionByName(more.crossJoin(F.broadcast(top)).withColumn(index, F.col(index) + F.col("_top")).drop("_top"))
