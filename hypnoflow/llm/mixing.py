"""Mixing sources to target weights by Poisson replication, in built-in functions only.

The mean repetition rate of a source is (its target share x output rows) / its rows. Every row draws a Poisson count
with that mean by inverting the distribution at a uniform number hashed from the seed and the row (its doc_id, text and number
among rows that are equal in these and in the source), is exploded by that count, and all copies are dealt out by a seeded hash of
the same and sorted by it in each partition: a global shuffle. So rows that share an id, or have none, draw each by itself
and lie apart.

Equal rows are numbered without meeting in one task: they are written once, spread over NUMBERING parts, counted in each
and numbered on from part to part.

Defined results: a null source is a source of its own; documents with null or empty text count as any other (and alike); a source
with weight 0 goes; an empty table gives an empty one; columns other
than doc_id and source are carried along, but for names that begin with mix_ and are this operator's own.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcastable, durable, repeats_apart, without

#: A rate above this is drawn as a sum of independent Poisson counts of at most this mean, so that exp(-mean) holds.
RATE_STEP = 256.0
#: Counts of one such draw stay below this: the tail beyond is under 2**-53.
COUNT_LIMIT = 1024
#: Equal rows are numbered in so many parts.
NUMBERING = 1024


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the md5 of the parts joined by colons."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: Mapping[str, float], default_weight: float = 1.0, out_rows: int | None = None) -> DataFrame:
    """source, n_rows, rate: the mean number of copies of each of its documents.

    weights: relative weight by source; others get default_weight each. out_rows: expected rows of the mix, as many as
    docs has by default.
    """
    if default_weight < 0 or any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    known = [x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))]
    weight = F.coalesce(F.create_map(*known)[F.col("source")] if known else F.lit(None).cast("double"), F.lit(float(default_weight)))
    counts = durable(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))).withColumn("weight", weight)
    total, rows = counts.agg(F.sum("weight"), F.sum("n_rows")).first()
    if not total:
        return counts.select("source", "n_rows", F.lit(0.0).alias("rate"))
    share = F.col("weight") / F.lit(float(total)) * F.lit(float(rows if out_rows is None else out_rows))
    return counts.select("source", "n_rows", (share / F.col("n_rows")).alias("rate"))


def cumulative(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson distribution, until the tail is below what a double resolves."""
    last = F.least(F.ceil(rate + 12 * F.sqrt(rate) + 20), F.lit(COUNT_LIMIT - 1)).cast("int")
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), F.array(first).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])


def numbered(docs: DataFrame) -> DataFrame:
    """docs with mix_row: the number, from 1, among the rows with equal doc_id, source and text (a null text like an empty one)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn("mix_hash", F.xxhash64(F.col("doc_id").cast("string"), F.col("doc_id").isNull(), "source", F.col("source").isNull(), text))
    _, once, again = repeats_apart(keyed, "mix_hash", "mix_row")
    names = [*docs.columns, "mix_row"]
    once = once.withColumn("mix_row", F.lit(1).cast("bigint"))
    if again is None:
        return once.select(names)
    parts = again.withColumn("mix_part", F.pmod("mix_row", F.lit(NUMBERING)))
    counts = parts.groupBy("mix_hash", "mix_part").agg(F.count(F.lit(1)).alias("mix_n"))
    before = Window.partitionBy("mix_hash").orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("mix_hash", "mix_part", F.coalesce(F.sum("mix_n").over(before), F.lit(0)).alias("mix_start"))
    local = F.row_number().over(Window.partitionBy("mix_hash", "mix_part").orderBy("mix_row"))
    apart = parts.withColumn("mix_row", local).join(starts, ["mix_hash", "mix_part"]).withColumn("mix_row", F.col("mix_row") + F.col("mix_start"))
    return once.select(names).union(apart.select(names))


def replicate(docs: DataFrame, weights: Mapping[str, float], default_weight: float = 1.0, out_rows: int | None = None, seed: int = 0) -> DataFrame:
    """docs with a row for each copy, in shuffled order, and the columns mix_rate, mix_row, mix_copy and mix_key (its place in the order)."""
    own = ("mix_rate", "mix_row", "mix_copy", "mix_key", "mix_source", "mix_parts", "mix_cdf", "mix_part", "mix_count", "mix_hash", "mix_n", "mix_start", "mix_name")
    docs = without(docs, *own)
    parts = F.greatest(F.ceil(F.col("rate") / RATE_STEP), F.lit(1)).cast("int")
    table = rates(docs, weights, default_weight, out_rows).select(F.col("source").alias("mix_source"), F.col("rate").alias("mix_rate"), parts.alias("mix_parts"), cumulative(F.col("rate") / parts).alias("mix_cdf"))
    table = broadcastable(durable(table), 8 * F.size("mix_cdf") + F.coalesce(F.octet_length("mix_source"), F.lit(0)) + 64)
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")), F.col("mix_row").cast("string"))
    drawn = numbered(docs).withColumn("mix_name", name).join(table, F.col("source").eqNullSafe(F.col("mix_source")))
    drawn = drawn.withColumn("mix_part", F.explode(F.sequence(F.lit(1), F.col("mix_parts"))))
    count = F.size(F.filter("mix_cdf", lambda c: c < uniform(F.lit(str(seed)), F.col("mix_name"), F.col("mix_part").cast("string"))))
    copies = drawn.withColumn("mix_count", count).where("mix_count > 0")
    copies = copies.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_count"))))
    copies = copies.withColumn("mix_copy", F.col("mix_copy") + (F.col("mix_part") - 1) * COUNT_LIMIT)
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), F.col("mix_name"), F.col("mix_copy").cast("string")).cast("binary"))
    dealt = copies.withColumn("mix_key", key).select(*docs.columns, "mix_rate", "mix_row", "mix_copy", "mix_key")
    return dealt.repartition("mix_key").sortWithinPartitions("mix_key")
