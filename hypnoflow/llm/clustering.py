"""Centroid clustering by Lloyd's rounds on distinct vectors of whole numbers, each weighed by how often it is there.

Vectors are quantised to floor(scale * x). Equal ones are grouped, with their multiplicities, before anything else: counts
are combined on the map side, so a vector that fills a third of the table is one row from then on. A round reads the distinct vectors once;
every task adds up its clusters' weighted sums in whole numbers and puts out k * dim of them, so a round shuffles and collects a few
thousand numbers whatever the table. Sums, means (exact floors) and distances are integers: the result does not depend on
how rows are dealt to tasks. At the end each row meets its distinct vector's assignment again by a SHA-256 of the vector, so that vectors are not
shuffled a second time; vectors that are more than 1 / HEAVY of all rows, HEAVY at most, are broadcast, since their rows would
meet in one task.

Defined results: vectors that are null, of another length than `dim`, or hold null or non-finite components take no part;
zero vectors do. Rows that repeat count each. The centroids begin as the rows with the smallest SHA-256 of "seed:id",
in order (rows without an id come last, and rows of one hash in the order of their vectors); fewer rows than k make fewer
centroids, and an empty table an empty result. Of equally near centroids the smaller number wins; a centroid that nothing is
assigned to stays where it is. A quantised component of 2^27 or more is an error. Columns of the result's names are
replaced, whatever their case.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, unused, without
from .vectors import LARGEST, finite_vector, floors

#: A vector with more than this share of the rows is heavy; there are at most so many.
HEAVY = 1024
ADDED = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def assigned(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the smaller number of equals, and the squared distance; exact."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    # floats hold these integers as long as they are under 2^53, and multiply faster
    kind = np.float64 if 4 * top * top * max(x.shape[1], 1) < 1 << 53 else np.int64
    a, c = x.astype(kind), centroids.astype(kind)
    d = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best].astype(np.int64)


def _sums(x: np.ndarray, n: np.ndarray) -> list[int]:
    """Weighted sums of the components, as Python integers."""
    small = int(np.abs(x).max(initial=0)) * int(n.sum()) < 1 << 62
    return (n @ x if small else n.astype(object) @ x.astype(object)).tolist()


def digest(x: str | Column) -> Column:
    """A vector's name: the SHA-256 of its components in decimal, joined by commas."""
    return F.unhex(F.sha2(F.array_join(x, ",").cast("binary"), 256))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """x, n of rows with a vector x of whole numbers, written once."""
    return durable(rows.groupBy("x").agg(F.count(F.lit(1)).alias("n")))


def lloyd(distinct: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """The centroids after so many rounds over distinct (x, n)."""
    dim = centroids.shape[1]
    for _ in range(rounds):
        now = centroids

        def totals(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            count, sums = [0] * len(now), [[0] * dim for _ in now]
            for batch in batches:
                x, n = matrix(batch["x"], dim), batch["n"].to_numpy()
                own, _ = assigned(x, now)
                for c in np.unique(own).tolist():
                    mine = own == c
                    count[c] += int(n[mine].sum())
                    sums[c] = [a + b for a, b in zip(sums[c], _sums(x[mine], n[mine]))]
            # in decimal text: a sum may be more than a long holds
            out = [(c, i, str(v)) for c in range(len(now)) if count[c] for i, v in enumerate([*sums[c], count[c]])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(col) for col in zip(*out)], ["cluster", "i", "total"])

        found = distinct.mapInArrow(totals, "cluster bigint, i bigint, total string").groupBy("cluster", "i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        new = [[int(v) for v in row] for row in now]
        of: dict[int, dict[int, int]] = {}
        for r in found.collect():  # k * (dim + 1) numbers
            of.setdefault(r.cluster, {})[r.i] = int(r.total)
        for c, values in of.items():
            new[c] = [values[i] // values[dim] for i in range(dim)]
        centroids = np.array(new, np.int64)
    return centroids


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, seed: int = 1, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The rows of df that take part, with cluster int, distance (squared, to the final centroid), cluster_inertia, inertia (distances added up over
    the cluster's rows and over all) and centroid_sha256 (of the final centroid's components in decimal, joined by commas)."""
    if 4 * dim * LARGEST * LARGEST > 1 << 62:
        raise ValueError(f"squared distances of {dim} components may be more than a long holds")
    own = without(df, *ADDED)
    x, key = unused(own, "x"), unused(own, "key")
    rows = own.where(finite_vector(vector) & (F.size(vector) == dim)).withColumn(x, floors(vector, scale).cast("array<int>"))
    distinct = distinct_vectors(rows.select(F.col(x).alias("x")))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")).cast("binary"), 256)
    first = rows.select(hashed.alias("h"), F.col(x).alias("x")).orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    centroids = lloyd(distinct, np.array([r.x for r in first], np.int64).reshape(len(first), dim), rounds if first else 0)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest, distance = assigned(matrix(batch["x"], dim), centroids)
            yield pa.RecordBatch.from_arrays([batch["key"], batch["n"], pa.array(nearest.astype(np.int32)), pa.array(distance)], ["key", "n", "cluster", "distance"])

    told = durable(distinct.select("x", "n", digest("x").alias("key")).mapInArrow(last, "key binary, n bigint, cluster int, distance bigint"))
    weighed = F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n"))
    parts = told.groupBy("cluster").agg(weighed.alias("inertia"), F.sum("n").alias("n")).collect()  # k rows
    total, count = sum(int(r.inertia) for r in parts), sum(r.n for r in parts)
    text = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    stats = df.sparkSession.createDataFrame([(r.cluster, int(r.inertia), total, text[r.cluster]) for r in parts], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")

    named = rows.withColumn(key, digest(x)).drop(x)
    told = told.withColumnRenamed("key", key)
    light = told.select(key, "cluster", "distance")
    heavy = told.where(F.col("n") * HEAVY > count).select(key, "cluster", "distance")
    if heavy.isEmpty():
        out = named.join(light, key)
    else:
        heavy = F.broadcast(heavy)  # each has more than 1 / HEAVY of the rows: fewer than HEAVY
        out = named.join(heavy, key).unionByName(named.join(heavy, key, "left_anti").join(light, key))
    return out.join(F.broadcast(stats), "cluster").select(*own.columns, *ADDED)
