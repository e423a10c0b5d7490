"""Changing a series' samples: linear grids, fixed epochs, point reduction for plots, rational rates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.design import Polyphase
from ..functions.kernels import hull, largest_triangle, polyphase_outputs, polyphase_taps
from .series import parts_before, so_far, stretched, with_starts


def _in_windows(df: DataFrame, series: str, order: tuple[str, ...]) -> DataFrame:
    """df with what `linear` needs to know of a row's series, by a window over each series."""
    w, whole = Window.partitionBy(series).orderBy(*order), Window.partitionBy(series)
    rows = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(whole))
    return rows.withColumn("_t0", F.min("ms").over(whole)).withColumn("_t1", F.max("ms").over(whole)).withColumn("_t", F.lead("ms").over(w)).withColumn("_v", F.lead("value").over(w))


def _in_stretches(df: DataFrame, series: str, order: tuple[str, ...], splits: Sequence[float] | None) -> DataFrame:
    """The same by stretches of time: a stretch's last row is followed by the first of the series' next one."""
    placed = stretched(df, order[0], splits)
    first = F.min_by(F.struct("ms", "value"), F.struct(*order))
    totals = placed.groupBy(series, "_part").agg(F.count(F.lit(1)).alias("_c"), F.min("ms").alias("_a"), F.max("ms").alias("_b"), first.alias("_first"))
    whole, after = Window.partitionBy(series), Window.partitionBy(series).orderBy("_part")
    known = F.struct(
        F.coalesce(F.sum("_c").over(parts_before(series)), F.lit(0)).alias("before"), F.sum("_c").over(whole).alias("n"), F.min("_a").over(whole).alias("t0"), F.max("_b").over(whole).alias("t1"),
        F.lead("_first").over(after).alias("next"),
    )
    both, w = with_starts(placed, totals, series, {"_known": known}, order)
    both = both.withColumn("_known", F.first("_known").over(so_far(w))).withColumn("_i", F.row_number().over(w) - 2 + F.col("_known.before"))
    both = both.withColumn("_ends", F.lead("_row").over(w).isNull()).withColumn("_t", F.lead("ms").over(w)).withColumn("_v", F.lead("value").over(w)).where("_row = 1")
    follows = lambda own, next: F.when(F.col("_ends"), F.col(f"_known.next.{next}")).otherwise(F.col(own))
    return both.select(*df.columns, "_i", *[F.col(f"_known.{x}").alias(f"_{x}") for x in ("n", "t0", "t1")], follows("_t", "ms").alias("_t"), follows("_v", "value").alias("_v"))


def linear(df: DataFrame, n: int, series: str = "series", order: tuple[str, ...] = ("ms", "event_id"), long: bool = True, splits: Sequence[float] | None = None) -> DataFrame:
    """series, k, ms, value: n points evenly over each series' span (ms, value), by linear interpolation.

    In this order: n samples stay as they are; n = 1 takes the middle one (the earlier of two); a series without duration
    gives its first sample n times; otherwise the ends are the first and last sample and inner times are cut to whole ms.
    Every segment between neighbours puts out the grid points that it covers, so there is no join and no state. Long series are worked
    on in stretches of time, each by itself; for many short ones (long=False) one sort by series does.
    """
    if n < 1:
        return df.select(series, F.lit(0).cast("bigint").alias("k"), F.col("ms").cast("double").alias("ms"), "value").limit(0)
    rows = _in_stretches(df, series, order, splits) if long else _in_windows(df, series, order)
    step = (F.col("_t1") - F.col("_t0")) / float(max(n - 1, 1))
    same, flat = F.col("_n") == n, F.col("_t1") == F.col("_t0")
    middle, last = F.col("_i") == F.floor((F.col("_n") - 1) / 2), F.col("_i") == F.col("_n") - 1
    none = F.array().cast("array<bigint>")
    lo = F.floor((F.col("ms") - F.col("_t0")) / step) + 1
    hi = F.least(F.floor((F.col("_t") - F.col("_t0")) / step), F.lit(n - 2).cast("bigint"))
    inner = F.when(F.col("_t").isNotNull() & (lo <= hi), F.sequence(lo, hi)).otherwise(none)
    ends = F.concat(F.when(F.col("_i") == 0, F.array(F.lit(0).cast("bigint"))).otherwise(none), F.when(last, F.array(F.lit(n - 1).cast("bigint"))).otherwise(none))
    ks = (
        F.when(same, F.array(F.col("_i").cast("bigint")))
        .when(F.lit(n == 1), F.when(middle, F.array(F.lit(0).cast("bigint"))).otherwise(none))
        .when(flat, F.when(F.col("_i") == 0, F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).otherwise(none))
        .otherwise(F.concat(ends, inner))
    )
    out = rows.withColumn("k", F.explode(ks))
    own = same | F.lit(n == 1) | flat | ((F.col("_i") == 0) & (F.col("k") == 0)) | (last & (F.col("k") == n - 1))
    at = F.col("_t0") + F.col("k") * step
    mixed = F.col("value") + (F.col("_v") - F.col("value")) * (at - F.col("ms")) / (F.col("_t") - F.col("ms"))
    return out.select(series, "k", F.when(own, F.col("ms")).otherwise(F.floor(at).cast("double")).alias("ms"), F.when(own, F.col("value")).otherwise(mixed).alias("value"))


def span(df: DataFrame, epoch_us: int) -> tuple[int, int]:
    """Start of the epoch of df's first us and end of that of its last; (0, 0) where it has none."""
    first, last = df.agg(F.min("us"), F.max("us")).first()
    return (0, 0) if first is None else (first // epoch_us * epoch_us, (last // epoch_us + 1) * epoch_us)


def whole_epochs(df: DataFrame, epoch_us: int, start_us: int, stop_us: int) -> DataFrame:
    """df's rows with record, the epoch from start_us that they are in; the epoch in which the recording stops is not complete and goes."""
    records = max(stop_us - start_us, 0) // epoch_us
    record = F.floor((F.col("us") - start_us) / epoch_us)
    return df.withColumn("record", record).where((F.col("us") >= start_us) & (F.col("record") < records))


def epochs(df: DataFrame, epoch_us: int, samples: int, start_us: int | None = None, end_us: int | None = None, series: str = "series", own_span: bool = False) -> DataFrame:
    """series, record, k, value, is_filled: each epoch of each series as exactly `samples` points, zeros where it has none.

    Each (series, epoch) is resampled by itself; epochs without rows are made from the list of series and meet those with rows as
    (series, record), not sample by sample. Start and end are those of all rows by default; rows outside those given are left out. own_span: a
    series has the epochs from its own first to its own last row only (records are numbered from the common start all the
    same), so that many short series over a long time do not fill it with zeros.
    """
    if start_us is None or end_us is None:
        first, after = span(df, epoch_us)
        start_us, end_us = first if start_us is None else start_us, after if end_us is None else end_us
    own = df.where((F.col("us") >= start_us) & (F.col("us") < end_us)).withColumn("record", F.floor((F.col("us") - start_us) / epoch_us))
    keyed = own.select(F.struct(series, "record").alias("series"), (F.col("us") / 1000.0).alias("ms"), "event_id", "value")
    points = linear(keyed, samples, long=False).select(F.col(f"series.{series}").alias(series), F.col("series.record").alias("record"), "k", "value")
    there = own.groupBy(series, "record").agg(F.lit(1).alias("there"))
    if own_span:
        spans = there.groupBy(series).agg(F.min("record").alias("a"), F.max("record").alias("b"))
    else:
        records = -(-(end_us - start_us) // epoch_us)
        spans = df.where(F.lit(records > 0)).select(series).distinct().select(series, F.lit(0).cast("bigint").alias("a"), F.lit(records - 1).cast("bigint").alias("b"))
    grid = spans.select(F.col(series).alias("_s"), F.explode(F.sequence("a", "b")).alias("_r"))
    empty = grid.join(there, F.col("_s").eqNullSafe(F.col(series)) & (F.col("_r") == F.col("record")), "left_anti")
    zeros = empty.select(F.col("_s").alias(series), F.col("_r").alias("record"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(samples - 1).cast("bigint"))).alias("k"), F.lit(None).cast("double").alias("value"))
    full = points.withColumn("value", F.col("value").cast("double")).unionByName(zeros)
    return full.withColumn("is_filled", F.col("value").isNull()).withColumn("value", F.coalesce("value", F.lit(0.0)))


#: Runs of fewer rows than this are not worth a hull.
SHORT_RUN = 16


def lttb(df: DataFrame, n: int, series: str = "series", time: str = "us", splits: Sequence[float] | None = None) -> DataFrame:
    """series, time, value of the n points that show each series' shape best (largest triangle, three buckets).

    Which point a bucket gives depends on the one before, so buckets must be gone through in order. But with the point before and
    the mean of the bucket after given, a triangle's area is the absolute value of a linear form in the point, so the largest belongs
    to a corner of the convex hull of the bucket, or of a part of it. Rows are numbered in stretches of time, the tasks reduce every run of a bucket to
    its hull, count and sums, and only hulls, a few points each, stream through the chain of a series. Points on an edge of a hull stay, so that the
    first of equal triangles still wins; all points of a curve without noise are corners, and it is reduced no further than its rows.

    All points where the series has no more than n, or n < 3. Rows without a number go. The null series is one like others. Rows without a time
    are the series' last ones; a triangle with such a point is none, so a bucket whose triangles all have one gives its first point.
    """
    rows = df.where(F.col("value").isNotNull() & ~F.isnan("value")).select(F.col(series).alias("series"), F.col(time).alias("t"), F.col("value").cast("double").alias("value"))
    names = lambda out: out.select(F.col("series").alias(series), F.col("t").alias(time), "value")
    if n < 3:
        return names(rows)
    placed = stretched(rows, "t", splits)
    placed = placed.withColumn("_part", F.when(F.col("t").isNull(), F.lit(1 << 62)).otherwise(F.col("_part")))
    totals = placed.groupBy("series", "_part").agg(F.count(F.lit(1)).alias("_c"), F.min("t").alias("_a"))
    whole = Window.partitionBy("series")
    known = F.struct(F.coalesce(F.sum("_c").over(parts_before("series")), F.lit(0)).alias("before"), F.sum("_c").over(whole).alias("size"), F.min("_a").over(whole).alias("base"))
    both, w = with_starts(placed, totals, "series", {"_known": known}, ("t", "value"))
    both = both.withColumn("_known", F.first("_known").over(so_far(w))).withColumn("_at", F.row_number().over(w) - 2).withColumn("seq", F.col("_at") + F.col("_known.before")).where("_row = 1")
    sized = both.select("series", "t", "value", "seq", (F.col("_at") == 0).alias("opens"), F.col("_known.size").alias("size"), F.col("_known.base").alias("base"))

    # bucket j begins at floor(j * width) + 1; the first row is before all of them, the last after
    width = F.when(F.col("size") > n, (F.col("size") - 2) / float(n - 2))
    begins = lambda j: F.floor(j * width) + 1
    guess = F.floor((F.col("seq") - 1) / width)
    bucket = F.when(begins(guess + 1) <= F.col("seq"), guess + 1).when(begins(guess) > F.col("seq"), guess - 1).otherwise(guess)
    bucket = F.when(F.col("seq") == 0, F.lit(-1)).otherwise(F.least(bucket, F.lit(n - 2)))
    key, kind = (rows.schema[c].dataType.simpleString() for c in ("series", "t"))
    points = f"array<struct<seq:bigint,t:{kind},value:double>>"
    hulls = sized.withColumn("bucket", bucket.cast("bigint")).mapInArrow(lambda batches: _hulls(batches, n), f"series {key}, bucket bigint, base {kind}, size bigint, n bigint, timed bigint, st double, sv double, points {points}")
    ordered = hulls.repartition("series").sortWithinPartitions("series", "bucket")
    return names(ordered.mapInArrow(lambda batches: _chained(batches, n), f"series {key}, t {kind}, value double"))


def _hulls(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """A row for each run of rows of one bucket: their number, how many have a time, the sums of time (from the series' first) and value, and
    the points of the hull; of rows without a time, the first and the last.

    Rows of a series' stretch come together, and `opens` marks the first of them: places alone do not tell a series from another one whose rows
    come next. Any parts of a bucket will do.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, seq = batch["bucket"].to_numpy(), batch["seq"].to_numpy()
        value, timed = batch["value"].to_numpy(), batch["t"].is_valid().to_numpy(zero_copy_only=False)
        since = _since(batch["t"], batch["base"])
        opens = batch["opens"].to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(seq) != 1) | np.diff(timed) | opens[1:]) + 1
        first, after = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(seq)]])
        whole = batch["size"].to_numpy()[first] <= n
        reduced = lambda a, b: a + hull(since[a:b], value[a:b]) if timed[a] else np.array([a, b - 1])
        kept = [np.arange(a, b) if all_of or b - a < SHORT_RUN else reduced(a, b) for a, b, all_of in zip(first.tolist(), after.tolist(), whole.tolist())]
        flat, ends = np.concatenate(kept), np.cumsum([0, *map(len, kept)])
        points = pa.StructArray.from_arrays([batch["seq"].take(pa.array(flat)), batch["t"].take(pa.array(flat)), batch["value"].take(pa.array(flat))], ["seq", "t", "value"])
        head = pa.array(first)
        yield pa.RecordBatch.from_arrays(
            [
                batch["series"].take(head), batch["bucket"].take(head), batch["base"].take(head), batch["size"].take(head), pa.array(after - first), pa.array(np.add.reduceat(timed.astype(np.int64), first)),
                pa.array(np.add.reduceat(np.where(timed, since, 0.0), first)), pa.array(np.add.reduceat(value, first)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), points),
            ],
            ["series", "bucket", "base", "size", "n", "timed", "st", "sv", "points"],
        )


def _since(t: pa.Array, base: pa.Array) -> np.ndarray:
    """How long after the series' first time each is; NaN where there is none."""
    zero = pa.scalar(0, t.type)
    since = (t.fill_null(zero).to_numpy() - base.fill_null(zero).to_numpy()).astype(np.float64)
    return np.where(t.is_valid().to_numpy(zero_copy_only=False), since, np.nan)


@dataclass
class Bucket:
    """The points of a bucket's hulls, their places in the series, and what its mean is made of."""

    which: int
    whole: bool
    n: int
    timed: int
    st: float
    sv: float
    seq: list[np.ndarray]
    since: list[np.ndarray]
    value: list[np.ndarray]
    rows: list[pa.StructArray]

    def pick(self, place: int) -> pa.StructArray:
        """The point at this place of all hulls together."""
        for rows in self.rows:
            if place < len(rows):
                return rows.slice(place, 1)
            place -= len(rows)
        raise IndexError(place)


def _chained(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The points that are kept, from the hulls of each series in the order of its buckets; two buckets' hulls are held: one is all there,
    the other, which may still grow, gives the mean for it."""
    now, key, last = object(), None, None
    held: Bucket | None = None
    growing: Bucket | None = None
    out: list[tuple[pa.Array, pa.StructArray]] = []

    def chosen(b: Bucket, following: Bucket | None) -> None:
        nonlocal last
        if b.whole:
            out.extend((key, rows) for rows in b.rows)
            return
        since, value, seq = np.concatenate(b.since), np.concatenate(b.value), np.concatenate(b.seq)
        if b.which in (-1, n - 2):  # the first row, and the last of all
            at = int(np.argmin(seq) if b.which < 0 else np.argmax(seq))
        else:
            order = np.argsort(seq, kind="stable")
            timed = order[~np.isnan(since[order])]
            at = int(order[0])
            if len(timed) and following.timed and not np.isnan(last[0]):
                at = int(timed[largest_triangle(*last, since[timed], value[timed], following.st / following.timed, following.sv / following.n)])
        last = (since[at], value[at])
        out.append((key, b.pick(at)))

    def flushed() -> pa.RecordBatch:
        keys = pa.concat_arrays([k.take(pa.array(np.zeros(len(r), np.int64))) for k, r in out])
        rows = pa.concat_arrays([r for _, r in out])
        out.clear()
        return pa.RecordBatch.from_arrays([keys, rows.field("t"), rows.field("value")], ["series", "t", "value"])

    for batch in batches:
        who, columns = batch["series"].to_pylist(), {c: batch[c].to_pylist() for c in ("bucket", "size", "n", "timed", "st", "sv")}
        flat, lengths = batch["points"].flatten(), batch["points"].value_lengths().to_numpy()
        ends = np.cumsum(lengths)
        since = _since(flat.field("t"), batch["base"].take(pa.array(np.repeat(np.arange(len(who)), lengths))))
        seq, value = flat.field("seq").to_numpy(), flat.field("value").to_numpy()
        for i, (name, a, b) in enumerate(zip(who, (ends - lengths).tolist(), ends.tolist())):
            which = columns["bucket"][i]
            piece = Bucket(which, columns["size"][i] <= n, columns["n"][i], columns["timed"][i], columns["st"][i], columns["sv"][i], [seq[a:b]], [since[a:b]], [value[a:b]], [flat.slice(a, b - a)])
            if growing is not None and name == now and growing.which == which:
                growing.n, growing.timed, growing.st, growing.sv = growing.n + piece.n, growing.timed + piece.timed, growing.st + piece.st, growing.sv + piece.sv
                growing.seq, growing.since, growing.value, growing.rows = growing.seq + piece.seq, growing.since + piece.since, growing.value + piece.value, growing.rows + piece.rows
                continue
            if held is not None:
                chosen(held, growing)
            held, growing = growing, piece
            if key is None or name != now:
                if held is not None:
                    chosen(held, None)  # the last bucket of the series before
                now, key, held = name, batch["series"].slice(i, 1), None
        if out:
            yield flushed()
    for b, following in ((held, growing), (growing, None)):
        if b is not None:
            chosen(b, following)
    if out:
        yield flushed()


def chunked(df: DataFrame, size: int, series: str = "series") -> DataFrame:
    """series, chunk, t (of its first sample), n and the values in order, from (series, n, t, value)."""
    grouped = df.groupBy(series, F.floor(F.col("n") / size).alias("chunk")).agg(F.min("t").alias("t"), F.count(F.lit(1)).alias("samples"), F.array_sort(F.collect_list(F.struct("n", "value"))).alias("a"))
    return grouped.select(series, "chunk", "t", "samples", F.col("a.value").alias("values"))


def polyphase(df: DataFrame, filt: Polyphase, series: str = "series", chunk_samples: int = 1 << 15) -> DataFrame:
    """series, n, t, value at the filter's rate, from (series, seq, value) at the input rate.

    Output n uses phase p = n M mod L and inputs floor(n M / L) - j. A series is cut into chunks that overlap by a filter's length,
    so the longest one is resampled by as many tasks as it has chunks. Inputs that are not there, such as those before the
    first, are left out and the taps that remain are weighed up.
    """
    up, down = filt.up, filt.down
    taps, length = polyphase_taps(filt)
    longest = taps.shape[1]
    kind = df.schema[series].dataType.simpleString()
    own = df.select(F.col(series).alias("series"), "seq", F.col("value").cast("double").alias("value"))
    last = own.groupBy("series").agg(F.floor((F.max("seq") * up + up - 1) / down).alias("last"))
    # a chunk has the inputs of a filter's length before it too
    chunk = F.floor(F.col("seq") / chunk_samples)
    rows = own.select("series", "seq", "value", F.explode(F.sequence(chunk, F.floor((F.col("seq") + longest - 1) / chunk_samples))).alias("chunk"))
    chunks = rows.groupBy("series", "chunk").agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("rows"))
    packed = chunks.join(last.withColumnRenamed("series", "_s"), F.col("series").eqNullSafe(F.col("_s"))).drop("_s")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (which, inputs, end) in enumerate(zip(batch["chunk"].to_pylist(), batch["rows"], batch["last"].to_pylist())):
                start = which * chunk_samples - (longest - 1)
                at = inputs.values.field("seq").to_numpy() - start
                size = max(int(at.max()) + 1, min(chunk_samples + longest - 1, end * down // up - start + 1))
                x, there = np.zeros(size), np.zeros(size)
                x[at], there[at] = inputs.values.field("value").to_numpy(), 1.0
                # outputs n with the newest input floor(n M / L) in this chunk
                n = np.arange(-(-which * chunk_samples * up // down), min(-(-(which + 1) * chunk_samples * up // down) - 1, end) + 1)
                y, good = polyphase_outputs(taps, length, up, down, x, there, start, n)
                value = y[good]
                key = batch["series"].take(pa.array(np.full(len(value), i)))
                yield pa.RecordBatch.from_arrays([key, pa.array(n[good]), pa.array(value)], ["series", "n", "value"])

    out = packed.mapInArrow(of, f"series {kind}, n bigint, value double")
    return out.select(F.col("series").alias(series), "n", (F.col("n") / filt.rate - filt.delay_s).alias("t"), "value")
