"""Approximate nearest neighbours by cosine with a hash-prefix forest.

Each of TREES trees gives every vector a string of BITS bits, the sides of random hyperplanes it lies on; a tree is the
sorted array of these strings. A query descends in all trees to its longest-prefix matches and then ascends in all of
them at once, a bit at a time, until at least M candidates share the prefixes; it compares itself with these exactly.

On Spark the sorted arrays are cut into blocks by their first p bits, blocks too large for a task into pieces; only
strings and keys are in them, packed. One pass over the strings counts, for every query and prefix length, what all
trees have (descent); from the sums follows where the query stops; a second pass gives the keys of what lies within that
prefix (ascent). A query's keys are made distinct over the trees, and each vector meets the queries that ask for it once.
A query whose prefixes hold more than CROWDED candidates, as among near copies of one vector, is compared with them
in pieces of blocks instead, so that no list of pairs is made, and one whose prefixes hold a good part of the table (1 / ROOT of
its distinct vectors or more) ascends to the root: it meets every row once instead of many rows in many trees. M and p come from a bounded sample of
CALIBRATION queries, compared with all rows in blocks: M is what leads to TARGET of their true neighbours, p the shortest prefix that any of them
needed, and how many distinct vectors the candidates of all trees are comes from them too. Queries left with fewer than k neighbours ascend to the root. There, a few
megabytes of queries at a time are broadcast, every task keeps the k + 1 best of its rows for each, and only these are shuffled.

Equal vectors are indexed once, with their k + 1 smallest ids (no other can be among anyone's k nearest), so a vector that
fills a third of the table costs one row. They are told by a hash, and only vectors whose hash is there twice are shuffled.

Defined results: vectors that are null, zero, empty, of another length than the table's most frequent (the smaller if
equally frequent), or hold null or non-finite components take no part, neither as queries nor as candidates; repeated ids are
one candidate each time they hold another vector; floats and doubles are measured as they are, other numbers as doubles; ties go to the smaller id; fewer than k candidates are all returned.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcastable, durable, rows_about

TREES = 20
BITS = 32
SEED = 17
CALIBRATION = 64
#: What calibration asks for, so that 0.9 is found in all.
TARGET = 0.93
#: Index rows and query rows of one piece of a block.
PIECE = 4096
QUERY_PIECE = 1024
#: Blocks are made of at most so many first bits.
MOST_BITS = 12
#: A query with more candidates than this over all trees is compared with them in pieces.
CROWDED = 16_384
#: To gather a candidate by its key costs about as much as to pass so many rows in a block: a query whose prefixes hold more
#: distinct vectors than this share of the table ascends to the root at once.
ROOT = 16
#: Bytes of the queries that are broadcast together to meet all rows, and rows that meet them at once.
ROOT_BYTES, ROOT_ROWS = 4 << 20, 512
#: Bytes of vectors that one task fetches from.
FETCH_BYTES = 16 << 20


def valid_vector(v: str = "embedding") -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(v).isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def planes(dim: int, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, trees * bits)).astype(np.float32)


def strings(x: np.ndarray, normals: np.ndarray, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """For each row of x, its hash string in every tree, as an integer whose highest bit comes first."""
    side = ((x / np.abs(x).max(axis=1, keepdims=True)).astype(np.float32) @ normals > 0).reshape(len(x), trees, bits)
    return side.astype(np.int64) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def common_prefix(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """How many first bits agree."""
    differ = (a ^ b).astype(np.float64)
    return bits - np.frexp(differ)[1]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a with those of b, each summed the same way wherever it is computed."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return np.clip((a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1)), -1.0, 1.0)


def nearest(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query position, row position and exact cosine of each query's k best rows, ties to the smaller id."""
    cosine = unit(queries) @ unit(rows).T
    if len(rows) > k:
        least = np.partition(cosine, len(rows) - k, axis=1)[:, len(rows) - k, None]
        q, r = np.nonzero(cosine >= least - 1e-12)
    else:
        q, r = (x.ravel() for x in np.indices(cosine.shape))
    score = exact(queries[q], rows[r])
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    start = np.searchsorted(q, np.arange(len(queries)))
    kept = np.arange(len(q)) - start[q] < k
    return q[kept], r[kept], score[kept]


def zeroed(v: str = "embedding") -> Column:
    """The vector without negative zeros, so that equal ones are equal bits."""
    return F.transform(v, lambda x: F.when(x == 0, x * 0 + F.abs(x)).otherwise(x))


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """key, embedding, ids (its k + 1 smallest, in order), id (the smallest) of every distinct vector of rows (vec_id, key, embedding)."""
    many = durable(rows.groupBy("key").count().where("count > 1").select("key"))
    alone = rows
    if not many.isEmpty():
        many = broadcastable(many, 16)
        alone = rows.join(many, "key", "left_anti")
    alone = alone.select("key", "embedding", F.array("vec_id").alias("ids"))
    again = rows.join(many, "key", "left_semi").distinct()
    again = again.withColumn("n", F.row_number().over(Window.partitionBy("key", "embedding").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    again = durable(again.groupBy("key", "embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    return alone.union(again).withColumn("id", F.col("ids")[0])


def calibrate(classes: DataFrame, queries: DataFrame, normals: np.ndarray, k: int) -> tuple[int, int, float]:
    """M and p, from CALIBRATION queries against all rows, and the share of their candidates over all trees that are distinct."""
    sample = rows_about(queries, CALIBRATION, "key", seed=3).toArrow().slice(0, 4 * CALIBRATION)
    dim = len(normals)
    if not sample.num_rows:
        return 1, 0, 1.0
    own_ids = sample["key"].to_numpy()
    own = matrix(sample["embedding"], dim)
    own_strings = strings(own, normals)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(own), BITS + 1), np.int64)
        apart = np.zeros((len(own), BITS + 1), np.int64)
        out = ["q", "level", "n", "apart", "id", "score"]
        for batch in (b.slice(i, PIECE) for b in batches for i in range(0, b.num_rows, PIECE)):
            rows, ids = matrix(batch["embedding"], dim), batch["key"].to_numpy(zero_copy_only=False)
            level = np.zeros((len(own), len(rows)), np.int64)
            codes = strings(rows, normals)
            for t in range(TREES):
                shared = common_prefix(own_strings[:, t, None], codes[None, :, t])
                level = np.maximum(level, shared)
                for q in range(len(own)):
                    counts[q] += np.bincount(shared[q], minlength=BITS + 1)
            for q in range(len(own)):
                apart[q] += np.bincount(level[q], minlength=BITS + 1)
            q, r, score = nearest(own, rows, ids, k + 1)
            none = pa.array(np.zeros(len(q), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(level[q, r]), none, none, pa.array(ids[r]), pa.array(score)], out)
        q, level = (x.ravel() for x in np.indices(counts.shape))
        low = np.full(len(q), -9.0)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(level), pa.array(counts.ravel()), pa.array(apart.ravel()), pa.array(np.full(len(q), -1)), pa.array(low)], out)

    told = classes.select("key", "embedding").mapInArrow(of, "q bigint, level bigint, n bigint, apart bigint, id bigint, score double")
    told = durable(told)
    sums = told.where("n > 0").groupBy("q", "level").agg(F.sum("n").alias("n"), F.sum("apart").alias("apart")).toPandas()
    best = told.where("n = 0 and score > -2").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k + 1).toPandas()
    at = np.zeros((len(own), BITS + 2), np.int64)
    distinct = np.zeros_like(at)
    at[sums["q"], sums["level"]], distinct[sums["q"], sums["level"]] = sums["n"], sums["apart"]
    # rows that share at least so many bits, over all trees, and how many of them are distinct
    at, distinct = (x[:, ::-1].cumsum(axis=1)[:, ::-1] for x in (at, distinct))
    best = best[best["id"].to_numpy() != own_ids[best["q"].to_numpy()]]
    if not len(best):
        return 1, 0, 1.0
    asked = np.sort(at[best["q"].to_numpy(), best["level"].to_numpy() + 1] + 1)
    m = int(asked[min(len(asked) - 1, int(np.ceil(TARGET * len(asked))) - 1)])
    stops = [max((x for x in range(BITS + 1) if at[q, x] >= m), default=0) for q in range(len(own))]
    every = np.arange(len(own))
    return m, min(min(stops), MOST_BITS), float(distinct[every, stops].sum() / max(at[every, stops].sum(), 1))


def _pieces(rows: DataFrame, normals: np.ndarray, p: int, trees: int, carried: list[str]) -> DataFrame:
    """rows with tree, block (the first p bits) and string, once for each tree."""
    dim = len(normals)
    fields = [f for f in rows.schema.fields if f.name in carried]
    text = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in fields), pa.array(list(strings(matrix(batch["embedding"], dim), normals)[:, :trees]), pa.list_(pa.int64()))], [*(f.name for f in fields), "strings"])

    hashed = rows.select(*dict.fromkeys([*(f.name for f in fields), "embedding"])).mapInArrow(of, f"{text}, strings array<bigint>")
    spread = hashed.select(*[f.name for f in fields], F.posexplode("strings").alias("tree", "string"))
    return spread.withColumn("block", F.shiftright("string", BITS - p))


def _met(index: DataFrame, queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Index and query rows in one table, keyed by the pieces (tree, block, i, j) in which each query meets each row."""
    i, j = F.pmod("key", F.col("index_pieces")), F.pmod("key", F.col("query_pieces"))
    a = index.join(F.broadcast(blocks), ["tree", "block"]).withColumn("i", i).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("query_pieces") - 1)))
    b = queries.join(F.broadcast(blocks), ["tree", "block"]).withColumn("j", j).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("index_pieces") - 1)))
    drop = ["index_pieces", "query_pieces"]
    both = a.withColumn("asks", F.lit(False)).drop(*drop).unionByName(b.withColumn("asks", F.lit(True)).drop(*drop), allowMissingColumns=True)
    return both.groupBy("tree", "block", "i", "j")


def _blocks(index: DataFrame, queries: DataFrame) -> DataFrame:
    """tree, block, index_pieces, query_pieces of the blocks that queries reach; at most TREES * 2**MOST_BITS rows."""
    n = lambda c: F.greatest(F.ceil(F.count(F.lit(1)) / c), F.lit(1)).cast("bigint")
    return index.groupBy("tree", "block").agg(n(PIECE).alias("index_pieces")).join(queries.groupBy("tree", "block").agg(n(QUERY_PIECE).alias("query_pieces")), ["tree", "block"])


PACKED = "tree int, block int, i int, j int, asks boolean, strings array<bigint>, keys array<bigint>, stops array<bigint>"


def block_sizes(rows: DataFrame, normals: np.ndarray, p: int) -> np.ndarray:
    """How many of rows (key, embedding) are in each block, as (tree, block); TREES * 2**MOST_BITS numbers at most."""
    dim = len(normals)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros((TREES, 1 << p), np.int64)
        for batch in batches:
            blocks = strings(matrix(batch["embedding"], dim), normals) >> (BITS - p)
            for t in range(TREES):
                sizes[t] += np.bincount(blocks[:, t], minlength=1 << p)
        t, b = np.nonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(b, pa.int32()), pa.array(sizes[t, b])], ["tree", "block", "n"])

    got = rows.select("embedding").mapInArrow(of, "tree int, block int, n bigint").groupBy("tree", "block").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((TREES, 1 << p), np.int64)
    out[got["tree"].to_numpy(), got["block"].to_numpy()] = got["n"].to_numpy()
    return out


def packed(rows: DataFrame, normals: np.ndarray, p: int, pieces: tuple[np.ndarray, np.ndarray], asks: bool, keys: bool) -> DataFrame:
    """The strings of rows (key, embedding, and stop if they ask), as sorted runs keyed by the pieces (tree, block, i, j) they belong to.

    pieces: by (tree, block), into how many pieces its index rows and its queries are cut; a query piece meets every index piece.
    """
    dim = len(normals)
    own, other = (pieces[1], pieces[0]) if asks else pieces
    columns = ["key", "embedding", *(["stop"] if asks and "stop" in rows.columns else [])]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch["key"].to_numpy()
            stop = batch["stop"].to_numpy() if "stop" in columns else np.zeros(len(key), np.int64)
            codes = strings(matrix(batch["embedding"], dim), normals)
            out: list[tuple] = []
            for t in range(TREES):
                block = codes[:, t] >> (BITS - p)
                piece = key % np.maximum(own[t, block], 1)
                order = np.lexsort((codes[:, t], piece, block))
                order = order[other[t, block[order]] > 0]  # blocks that the other side does not reach stay behind
                if not len(order):
                    continue
                starts = np.flatnonzero(np.concatenate([[True], (np.diff(block[order]) != 0) | (np.diff(piece[order]) != 0)]))
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
                    run = order[a:b]
                    first = int(block[run[0]])
                    held = (codes[run, t], key[run] if keys or asks else key[:0], stop[run] if asks else stop[:0])
                    for o in range(int(other[t, first])):
                        out.append((t, first, *((o, int(piece[run[0]])) if asks else (int(piece[run[0]]), o)), asks, *held))
            if out:
                kinds = [pa.int32()] * 4 + [pa.bool_()] + [pa.list_(pa.int64())] * 3
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], ["tree", "block", "i", "j", "asks", "strings", "keys", "stops"])

    return rows.select(*columns).mapInArrow(of, PACKED)


def _flat(table: pa.Table, column: str) -> np.ndarray:
    return table[column].combine_chunks().flatten().to_numpy() if table.num_rows else np.empty(0, np.int64)


def _range(sorted_strings: np.ndarray, string: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Where in the sorted array the strings lie that share the first `level` bits."""
    width = np.left_shift(np.int64(1), BITS - np.asarray(level, np.int64))
    low = string // width * width
    return np.searchsorted(sorted_strings, low), np.searchsorted(sorted_strings, low + width)


def descend(index: DataFrame, queries: DataFrame, m: int, p: int) -> DataFrame:
    """key, stop, n: the longest prefix at which the trees together have m candidates for the query, p where none has; and how many."""

    def of(table: pa.Table) -> pa.Table:
        asks = table["asks"]
        rows, asking = table.filter(pa.compute.invert(asks)), table.filter(asks)
        stored, own = np.sort(_flat(rows, "strings")), _flat(asking, "strings")
        counts = np.stack([np.subtract(*_range(stored, own, x)[::-1]) for x in range(p, BITS + 1)], axis=1) if len(own) else np.zeros((0, BITS + 1 - p), np.int64)
        return pa.table({"key": _flat(asking, "keys"), "counts": pa.array(list(counts), pa.list_(pa.int64()))})

    found = index.union(queries).groupBy("tree", "block", "i", "j").applyInArrow(of, "key bigint, counts array<bigint>")
    sums = found.groupBy("key").agg(*[F.sum(F.col("counts")[x - p]).alias(f"n{x}") for x in range(p, BITS + 1)])
    stop = F.coalesce(*[F.when(F.col(f"n{x}") >= m, F.lit(x)) for x in range(BITS, p - 1, -1)], F.lit(p))
    n = F.coalesce(*[F.when(F.col(f"n{x}") >= m, F.col(f"n{x}")) for x in range(BITS, p - 1, -1)], F.col(f"n{p}"))
    return sums.select("key", stop.cast("bigint").alias("stop"), n.alias("n"))


def gather(index: DataFrame, queries: DataFrame) -> DataFrame:
    """q, keys: the keys within the prefix at which each query stops, one list for each tree and piece."""

    def of(table: pa.Table) -> pa.Table:
        asks = table["asks"]
        rows, asking = table.filter(pa.compute.invert(asks)), table.filter(asks)
        stored, keys = _flat(rows, "strings"), _flat(rows, "keys")
        order = np.argsort(stored, kind="stable")
        lo, hi = _range(stored[order], _flat(asking, "strings"), _flat(asking, "stops"))
        return pa.table({"q": _flat(asking, "keys"), "keys": pa.array([keys[order[a:b]] for a, b in zip(lo.tolist(), hi.tolist())], pa.list_(pa.int64()))})

    return index.union(queries).groupBy("tree", "block", "i", "j").applyInArrow(of, "q bigint, keys array<bigint>").where(F.size("keys") > 0)


def fetch(classes: DataFrame, queries: DataFrame, candidates: DataFrame, k: int, dim: int, blocks: int) -> DataFrame:
    """q, key, id, ids, score: the k + 1 best of each query's candidates in each of `blocks` parts of the classes.

    A part's vectors are held, and the queries that ask for some of them stream past.
    """
    kind = classes.schema["embedding"].dataType.simpleString()
    schema = f"part int, asks boolean, key bigint, ids array<bigint>, embedding {kind}"
    asked = candidates.groupBy("q").agg(F.flatten(F.collect_list("keys")).alias("keys")).join(queries, F.col("q") == F.col("key")).select("q", "keys", "embedding")

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, q, keys, row = [], [], [], []
            for i, (own, wanted) in enumerate(zip(batch["q"].to_pylist(), batch["keys"])):
                wanted = np.unique(wanted.values.to_numpy())
                at = wanted % blocks
                order = np.argsort(at, kind="stable")
                starts = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) != 0])).tolist()
                for a, b in zip(starts, [*starts[1:], len(order)]):
                    part.append(int(at[order[a]]))
                    q.append(own)
                    keys.append(wanted[order[a:b]])
                    row.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([True] * len(q)), pa.array(q, pa.int64()), pa.array(keys, pa.list_(pa.int64())), batch["embedding"].take(pa.array(row, pa.int64()))], ["part", "asks", "key", "ids", "embedding"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, held = None, [], None  # rows of the part, until the first query asks
        for batch in batches:
            parts, asks = batch["part"].to_numpy(), batch["asks"].to_numpy(zero_copy_only=False)
            bounds = np.flatnonzero(np.concatenate([[True], (np.diff(parts) != 0) | (asks[1:] != asks[:-1])])).tolist()
            for a, b in zip(bounds, [*bounds[1:], batch.num_rows]):
                rows = batch.slice(a, b - a)
                if parts[a] != now:
                    now, kept, held = parts[a], [], None
                if not asks[a]:
                    kept.append(rows)
                    continue
                if held is None:
                    whole = pa.Table.from_batches(kept).combine_chunks() if kept else None
                    key = whole["key"].to_numpy() if kept else np.empty(0, np.int64)
                    order = np.argsort(key)
                    held = whole, key[order], order, matrix(whole["embedding"], dim) if kept else np.zeros((0, dim))
                    kept = []
                whole, key, order, x = held
                if whole is None:
                    continue
                wanted = rows["ids"].flatten().to_numpy()
                asking = np.repeat(np.arange(rows.num_rows), rows["ids"].value_lengths().to_numpy())
                at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
                good = key[at] == wanted
                at, asking = order[at[good]], asking[good]
                y, first = matrix(rows["embedding"], dim), np.array([i[0] for i in whole["ids"].to_pylist()], np.int64)
                score = np.concatenate([exact(y[asking[i : i + (1 << 14)]], x[at[i : i + (1 << 14)]]) for i in range(0, len(at), 1 << 14)] or [np.empty(0)])
                best = np.lexsort((first[at], -score, asking))
                start = np.searchsorted(asking[best], np.arange(rows.num_rows))
                best = best[np.arange(len(best)) - start[asking[best]] <= k]
                at, asking = pa.array(at[best]), pa.array(asking[best])
                yield pa.RecordBatch.from_arrays([rows["key"].take(asking), *(whole[c].combine_chunks().take(at) for c in ("key", "id", "ids")), pa.array(score[best])], ["q", "key", "id", "ids", "score"])

    stored = classes.select(F.pmod("key", F.lit(blocks)).cast("int").alias("part"), F.lit(False).alias("asks"), "key", "ids", "embedding")
    met = stored.union(asked.mapInArrow(parted, schema)).repartition("part").sortWithinPartitions("part", "asks")
    return met.select("*", F.when(~F.col("asks"), F.col("ids")[0]).alias("id")).mapInArrow(scored, "q bigint, key bigint, id bigint, ids array<bigint>, score double")


def ascend(index: DataFrame, queries: DataFrame, blocks: DataFrame, k: int, dim: int) -> DataFrame:
    """q, key, id, ids, score: the k + 1 best classes of each piece within each query's prefix, for queries with crowds of candidates."""

    def of(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        rows, own = table.filter(pa.array(~asks)), table.filter(pa.array(asks))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if rows.num_rows and own.num_rows:
            rows = rows.take(pa.array(np.argsort(rows["string"].to_numpy(), kind="stable")))
            x, y, ids = matrix(rows["embedding"], dim), matrix(own["embedding"], dim), rows["id"].to_numpy()
            lo, hi = _range(rows["string"].to_numpy(), own["string"].to_numpy(), own["stop"].to_numpy())
            spans, which = np.unique(np.stack([lo, hi], axis=1), axis=0, return_inverse=True)
            which = which.ravel()
            for s, (a, b) in enumerate(spans.tolist()):
                if b > a:
                    asking = np.flatnonzero(which == s)
                    q, r, score = nearest(y[asking], x[a:b], ids[a:b], k + 1)
                    found.append((asking[q], r + a, score))
        q, r, score = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"q": own["key"].take(pa.array(q)), "key": rows["key"].take(pa.array(r)), "id": rows["id"].take(pa.array(r)), "ids": rows["ids"].take(pa.array(r)), "score": pa.array(score, pa.float64())})

    return _met(index, queries, blocks).applyInArrow(of, "q bigint, key bigint, id bigint, ids array<bigint>, score double")


def _best(found: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from candidate classes and the queries of each class."""
    top = Window.partitionBy("q").orderBy(F.desc("score"), "id", "key")
    classes = found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1).select("q", "ids", "score")
    each = asked.join(classes, "q").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _dense(classes: DataFrame, queries: DataFrame, normals: np.ndarray, p: int, trees: int, k: int) -> DataFrame:
    """What ascend finds for queries (key, embedding, stop), each class once."""
    index = _pieces(classes, normals, p, trees, ["key", "id", "ids", "embedding"])
    asking = _pieces(queries, normals, p, trees, ["key", "embedding", "stop"])
    found = ascend(index, asking, _blocks(index, asking), k, len(normals))
    return found.groupBy("q", "key", "id").agg(F.first("ids").alias("ids"), F.max("score").alias("score"))


def rooted(classes: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    """q, key, id, ids, score: the k + 1 best classes of each task's rows for every query (key, embedding), by comparison with all rows.

    Queries are broadcast ROOT_BYTES at a time; what is found for them is written before the next ones come.
    """
    spark = classes.sparkSession
    parts = max(1, -(-queries.count() * dim * 8 // ROOT_BYTES))
    kind = "q bigint, key bigint, id bigint, ids array<bigint>, score double"
    found = []
    for part in range(parts):
        block = queries.select("key", "embedding").where(F.pmod(F.xxhash64(F.lit("root"), "key"), F.lit(parts)) == part).toArrow()
        if not block.num_rows:
            continue
        shared = spark.sparkContext.broadcast((block["key"].to_numpy(), matrix(block["embedding"], dim)))

        def of(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asking, y = shared.value
            held: list[tuple[np.ndarray, np.ndarray, pa.Table]] = []  # query, score, class

            def best() -> None:
                q, score = (np.concatenate([h[i] for h in held]) for i in (0, 1))
                rows = pa.concat_tables([h[2] for h in held]).combine_chunks()
                order = np.lexsort((rows["id"].to_numpy(), -score, q))
                start = np.searchsorted(q[order], np.arange(len(asking)))
                order = order[np.arange(len(order)) - start[q[order]] <= k]
                held[:] = [(q[order], score[order], rows.take(pa.array(order)))]

            for batch in (b.slice(i, ROOT_ROWS) for b in batches for i in range(0, b.num_rows, ROOT_ROWS)):
                q, r, score = nearest(y, matrix(batch["embedding"], dim), batch["id"].to_numpy(), k + 1)
                held.append((q, score, pa.Table.from_batches([batch.select(["key", "id", "ids"])]).take(pa.array(r))))
                if len(held) > 8:
                    best()
            if held:
                best()
                q, score, rows = held[0]
                for i in range(0, len(q), 1 << 14):
                    cut = slice(i, i + (1 << 14))
                    yield pa.RecordBatch.from_arrays([pa.array(asking[q[cut]]), *(rows[c].slice(i, 1 << 14).combine_chunks() for c in ("key", "id", "ids")), pa.array(score[cut])], ["q", "key", "id", "ids", "score"])

        found.append(durable(classes.select("key", "id", "ids", "embedding").mapInArrow(of, kind)))
        shared.destroy()
    return functools.reduce(DataFrame.union, found) if found else spark.createDataFrame([], kind)


def neighbours(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every valid row for which is_query holds."""
    spark = vectors.sparkSession
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    own = F.col("embedding").cast(f"array<{element if element in ('float', 'double') else 'double'}>")
    valid = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), own.alias("embedding"), is_query.alias("asks")).where(F.col("vec_id").isNotNull() & valid_vector())
    sizes = valid.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim, count = (sizes["dim"], sizes["count"]) if sizes else (1, 0)
    valid = valid.where(F.size("embedding") == dim).withColumn("embedding", zeroed()).withColumn("key", F.xxhash64("embedding"))
    classes = classes_of(valid.select("vec_id", "key", "embedding"), k)
    asking = valid.where("asks")
    asked = durable(asking.select(F.col("vec_id").alias("query_id"), F.col("key").alias("q")).distinct())
    queries = durable(asking.groupBy("key").agg(F.first("embedding").alias("embedding")))
    normals = planes(dim)
    m, p, distinct = calibrate(classes, queries, normals, k)
    index_sizes, query_sizes = block_sizes(classes, normals, p), block_sizes(queries, normals, p)
    pieces = -(-index_sizes // PIECE), -(-query_sizes // QUERY_PIECE)
    stops = durable(descend(packed(classes, normals, p, pieces, False, False), packed(queries, normals, p, pieces, True, True), m, p))
    stopping = queries.join(stops, "key")
    many, crowd = F.col("n") * F.lit(distinct) * ROOT >= count, F.col("n") > CROWDED
    to_root, to_pieces, to_gather = (x or 0 for x in stops.agg(*[F.sum(c.cast("int")) for c in (many, ~many & crowd, ~many & ~crowd)]).first())
    found = []
    if to_gather:
        keys = gather(packed(classes, normals, p, pieces, False, True), packed(stopping.where(~many & ~crowd), normals, p, pieces, True, True))
        parts = max(1, -(-count * dim * 8 // FETCH_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), count // PIECE))
        found.append(fetch(classes, queries, keys, k, dim, parts))
    if to_pieces:
        found.append(_dense(classes, stopping.where(~many & crowd), normals, p, TREES, k))
    if to_root:
        found.append(rooted(classes, stopping.where(many), k, dim))
    if not found:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    found = functools.reduce(DataFrame.union, (f.select("q", "key", "id", "ids", "score") for f in found))
    answers = durable(_best(found, asked, k))
    # who has fewer than k, though there are as many, ascends to the root
    full = answers.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k, max(count - 1, 0)))
    short = durable(asked.join(full, "query_id", "left_anti"))
    if short.isEmpty():
        return answers
    again = queries.join(short.select(F.col("q").alias("key")).distinct(), "key", "left_semi")
    return answers.join(short, "query_id", "left_anti").unionByName(_best(rooted(classes, again, k, dim), short, k))
