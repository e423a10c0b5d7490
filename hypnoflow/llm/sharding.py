"""Sharding by a two-pass external shuffle.

Pass one scatters the records into memory-sized buckets by a seeded hash of the whole record's id and text. Pass two
loads each bucket, shuffles it by Fisher-Yates with a generator seeded by (seed, bucket) and puts it out. The buckets
one after another are the shuffled stream, cut into shards whose row counts differ by one at most (law `rows`).

Rows that repeat id and text would all go to one bucket. They are found by counting the hashes, and each gets a number
that is hashed with it (and written with it first, so that it stays the same if a task runs again). So copies are spread
over all buckets like other rows, and a bucket holds about bucket_bytes, or one record where that is larger.

Defined results: a null text counts ROW_BYTES like an empty one and stays null; empty texts, repeated rows and repeated ids are records
like others; an empty table gives an empty result; fewer rows than shards leave some shards empty; other columns are
carried along, but for shard, slot and the names beginning with shard_ that are this operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import repeats_apart, without

#: Bytes that pass two may hold at once for a bucket; twice that is needed while its pieces are put together.
BUCKET_BYTES = 16 << 20
#: What a row counts for besides its text.
ROW_BYTES = 64
#: Offsets (16 bytes a bucket) are broadcast up to so many buckets.
BROADCAST_BUCKETS = 1_000_000


def text_bytes(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def text_crc(text: str = "text") -> Column:
    return F.coalesce(F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")), F.lit(0)).cast("bigint")


def shuffle_into_shards(docs: DataFrame, shards: int, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs in shuffled order with shard (int, from 0) and slot (long, gapless from 0 in each shard)."""
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = docs.sparkSession
    docs = without(docs, "shard", "slot", "shard_hash", "shard_row", "shard_bucket", "shard_start")
    seen, once, again = repeats_apart(docs.withColumn("shard_hash", F.xxhash64(F.lit(seed), "doc_id", "text")), "shard_hash", "shard_row", text_bytes() + ROW_BYTES)
    rows, total = (int(x or 0) for x in seen.agg(F.sum("n"), F.sum("bytes")).first())
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, -(-total // bucket_bytes), min(width, rows // 64))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "shard_hash", "shard_row"), F.lit(buckets)).alias("shard_bucket")
    no_row = F.lit(0).cast("bigint").alias("shard_row")
    names = docs.columns
    dealt, places = once.select("*", no_row), seen.where("n = 1").select("shard_hash", no_row)
    if again is not None:
        dealt, places = dealt.select(*names, "shard_hash", "shard_row").union(again.select(*names, "shard_hash", "shard_row")), places.union(again.select("shard_hash", "shard_row"))
    # the histogram gives every bucket's place in the stream
    counts = places.select(bucket).groupBy("shard_bucket").count().toArrow().sort_by("shard_bucket")
    n = counts["count"].to_numpy()
    offsets = spark.createDataFrame(pa.table({"shard_bucket": counts["shard_bucket"], "shard_start": pa.array(np.cumsum(n) - n, pa.int64())}))
    dealt = dealt.select("*", bucket).join(F.broadcast(offsets) if counts.num_rows <= BROADCAST_BUCKETS else offsets, "shard_bucket")
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def shuffled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        n, start = table.num_rows, table["shard_start"][0].as_py()
        # a set order first: what a lost executor's task is given again may arrive in another
        known = pa.compute.sort_indices(table, [("shard_hash", "ascending"), ("shard_row", "ascending")]).to_numpy()
        order = np.arange(n)
        np.random.Generator(np.random.PCG64([seed, table["shard_bucket"][0].as_py()])).shuffle(order)  # Fisher-Yates
        place, order, table = np.arange(start, start + n), known[order], table.select(names)
        shard = place * shards // max(rows, 1)
        slot = place - -(-shard * rows // shards)
        for at in range(0, n, 512):
            out = table.take(pa.array(order[at : at + 512]))
            out = out.append_column("shard", pa.array(shard[at : at + 512], pa.int32())).append_column("slot", pa.array(slot[at : at + 512], pa.int64()))
            yield from out.to_batches()

    return dealt.groupBy("shard_bucket").applyInArrow(shuffled, schema)


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 0) -> None:
    """The shards as folders of Parquet files, each row with its slot; a bucket's task writes to the few shards it spans."""
    shuffle_into_shards(docs, shards, seed).write.partitionBy("shard").parquet(path)
