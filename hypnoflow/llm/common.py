"""What several operators share: tables, the shared folder, samples bounded by a hash."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if it has been counted and its rows take no more than this.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on one machine, where that is unset, a temporary one."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder under the shared one that nothing needs any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder, so that no later step goes back beyond it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_of(column: str) -> Column:
    """crc32 of a column as text; 0 where null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0))


def unit_hash(*columns: str | Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns and the seed only."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) / F.lit(float(1 << 52))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names, in whatever case."""
    lower = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in lower])


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


def rows_about(df: DataFrame, n: int, *columns: str, seed: int, rows: int | None = None) -> DataFrame:
    """About n rows of df, all of them where it has fewer: those whose hash is under n / count."""
    rows = df.count() if rows is None else rows
    return df if rows <= n else df.where(unit_hash(*columns, seed=seed) < n / rows)


def broadcastable(df: DataFrame, row_bytes: Column | int) -> DataFrame:
    """df, marked for broadcast if its rows, so many bytes each, are small together. df should be cheap to read (durable)."""
    size = df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def repeats_apart(df: DataFrame, key: str, row: str, size: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(seen, once, again) of df with a long column `key`, never null, that rows share which are to be told apart.

    seen: key, n and bytes (the sum of size) of every key; once: the rows whose key no other has; again: the others, each with a
    number of its own in the column `row`, written once so that a row read anew has the number it had; None where there are none.
    """
    seen = durable(df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.lit(0) if size is None else size).alias("bytes")))
    many = seen.where("n > 1").select(key)
    if many.isEmpty():
        return seen, df, None
    many = broadcastable(many, 16)
    again = durable(df.join(many, key, "left_semi").withColumn(row, F.monotonically_increasing_id()))
    return seen, df.join(many, key, "left_anti"), again
