"""Embedding whitening: principal components of quantised vectors, each scaled to variance one.

Vectors become whole numbers x = floor(scale * c) + shift. Their number n and sums S are exact, so n * x - S is an exact integer and a
row is centred with one rounding, (n * x - S) / n, before anything is multiplied. MLlib's RowMatrix adds up the Gramian of
these rows (a task holds one dim * dim matrix, tasks are combined in a tree); divided by n it is the covariance, whose
eigenvectors the driver finds: dim * dim numbers, whatever the table. The matrix that whitens is broadcast, and rows are projected in
mapInPandas, a batch at a time. The error of the result is measured on the whitened rows themselves, in a pass of their own.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do those of another length than
the most frequent (the smaller of equally frequent ones; none of those fits the matrix); rows that repeat count each and are
returned each. Components are numbered from 1 by falling eigenvalue; of both signs of an eigenvector that which makes its largest
entry (the first of equals) positive is taken. A component without variance (its eigenvalue is nothing beside the largest, as
where there are fewer rows than dimensions) cannot be scaled: its whitened value is null, and the error is measured without it. deviation is null where
a long cannot hold it. An empty table gives an empty result. A quantised component of 2^27 or more is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import finite_vector, floors, usual_length

#: An eigenvalue at or under this share of the largest is none.
LEAST = 1e-12


@dataclass
class Fit:
    """n rows with sums S; values and vectors (columns) of the covariance by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @property
    def good(self) -> np.ndarray:
        """Which components have variance."""
        return self.values > LEAST * max(self.values[0], 0.0)

    def scaled(self, components: int) -> np.ndarray:
        """The matrix that whitens a centred row, a column for each component; zeros where there is no variance."""
        root = np.sqrt(np.where(self.good, self.values, np.inf))
        return (self.vectors / root)[:, :components]

    def explained(self) -> np.ndarray:
        """Each eigenvalue's share of the trace; 0 where there is no variance at all."""
        trace = self.values.sum()
        return np.maximum(self.values, 0.0) / trace if trace > 0 else np.zeros(len(self.values))


def whole_numbers(df: DataFrame, dim: int, scale: float, shift: int, id: str, vector: str) -> DataFrame:
    """id (as text, so that none is rounded), x of the rows that take part."""
    rows = df.where(finite_vector(vector) & (F.size(vector) == dim))
    return rows.select(F.col(id).cast("string").alias("id"), F.transform(floors(vector, scale), lambda x: x + F.lit(shift).cast("bigint")).alias("x"))


def fit(rows: DataFrame, dim: int) -> Fit | None:
    """The principal components of rows (x); None where there are no rows."""
    totals = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")).collect()  # dim rows
    if not totals:
        return None
    n, sums = totals[0].n, [int(r.s) for r in sorted(totals, key=lambda r: r.i)]
    whole = F.array(*[F.lit(s).cast("decimal(38,0)") for s in sums]).cast("array<bigint>")
    centred = F.zip_with("x", whole, lambda x, s: (x * F.lit(n).cast("bigint") - s).cast("double") / F.lit(float(n)))
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(centred).alias("row")), "row")
    gram = RowMatrix(vectors, n, dim).computeGramianMatrix().toArray()
    values, columns = np.linalg.eigh((gram + gram.T) / (2.0 * n))
    values, columns = values[::-1], columns[:, ::-1]
    sign = np.sign(columns[np.abs(columns).argmax(axis=0), np.arange(dim)])
    return Fit(n, sums, values, columns * np.where(sign == 0, 1.0, sign))


def projected(column: pd.Series, n: int, sums: np.ndarray, scaled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S of each row, exact, and the whitened row."""
    exact = np.stack(column.to_numpy()).astype(np.int64) * n - sums
    return exact, (exact / float(n)) @ scaled


def deviations(exact: np.ndarray) -> list[int | None]:
    """Each row's sum of squares, exact; None where a long cannot hold it."""
    if float(np.abs(exact).max(initial=0)) ** 2 * exact.shape[1] < 2.0**62:
        return (exact * exact).sum(axis=1).tolist()
    wide = exact.astype(object)
    return [int(v) if v < 1 << 63 else None for v in (wide * wide).sum(axis=1)]


def whiten(df: DataFrame, components: int = 32, scale: float = 64.0, shift: int = 1_000_000, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: a row for each row of df that takes part and each component."""
    spark, kind = df.sparkSession, df.schema[id].dataType.simpleString()
    schema = "id string, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    dim = usual_length(df, vector)
    rows = whole_numbers(df, dim, scale, shift, id, vector)
    found = fit(rows, dim) if dim else None
    if found is None:
        return spark.createDataFrame([], schema).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id)
    if found.n * (shift + (1 << 27)) >= 1 << 62:
        raise ValueError(f"{found.n} rows are more than whole numbers of 64 bits can centre")
    n, some = found.n, min(components, dim)
    good = found.good[:some]
    shared = spark.sparkContext.broadcast((np.array(found.sums, np.int64), found.scaled(some), found.explained()[:some]))

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What a task adds to the whitened rows' sums and products."""
        sums, scaled, _ = shared.value
        total = np.zeros((some + 1, some))
        for frame in frames:
            if len(frame):
                _, w = projected(frame["x"], n, sums, scaled)
                total += np.vstack([w.sum(axis=0), w.T @ w])
        yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

    added = rows.select("x").mapInPandas(moments, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # 33 * 32 numbers
    total = np.zeros((some + 1) * some)
    total[[r.i for r in added]] = [r.v for r in added]
    mean, product = total.reshape(some + 1, some)[0] / n, total.reshape(some + 1, some)[1:] / n
    error = float(np.abs(product - np.outer(mean, mean) - np.eye(some))[np.ix_(good, good)].max(initial=0.0))

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, scaled, explained = shared.value
        for frame in frames:
            if not len(frame):
                continue
            exact, w = projected(frame["x"], n, sums, scaled)
            w[:, ~good] = np.nan  # null in the result
            deviation = pd.array(deviations(exact), dtype="Int64")
            yield pd.DataFrame({
                "id": np.repeat(frame["id"].to_numpy(), some), "component": np.tile(np.arange(1, some + 1, dtype=np.int32), len(frame)), "n": n,
                "deviation": deviation.repeat(some), "whitened": w.ravel(), "explained": np.tile(explained, len(frame)), "identity_error": error,
            })

    out = rows.mapInPandas(of, schema)
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id)
