"""SimHash near-duplicates found with pivot distance tables.

A text's fingerprint has a bit for each of 64 positions, set if more than half of its shingles' hashes have it.
Fingerprints within `distance` = 2 differing bits are linked; a document's class is its connected component.

Search. Equal fingerprints are one. Two fingerprints within 2 bits agree on at least two of four 16-bit blocks, so each
is dealt to six buckets, by pair of blocks. In a bucket, the Hamming distances of every fingerprint to 16 reference
fingerprints are computed once; a pair whose distances to some reference differ by more than 2 is discarded (triangle
inequality), and only survivors are compared bit by bit. A bucket's links are put out as stars of its own components.

A bucket of more than BUCKET_LIMIT fingerprints, such as many near copies of one text make, is dealt again by which
six of eight bytes agree (28 buckets): there at most 2**16 different fingerprints can meet, and each looks up its 136
neighbours in the two free bytes, without a pivot table. So nothing is left out, and no task holds more than the bound.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked like any other; a text
of fewer words than a shingle has its whole sequence as its one shingle; rows that repeat a doc_id are one document, so
their classes are one (not in `keep_one`, where each text counts by itself); a null doc_id keeps its row and counts as larger than any other; columns besides doc_id and text are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, broadcastable, durable, unused
from .components import components

SEED = 42
SHINGLE = 3
DISTANCE = 2
BUCKET_LIMIT = 4096
#: What a row's key takes in a broadcast table.
KEY_BYTES = 48
#: Reference fingerprints: fixed, drawn once with this seed.
PIVOTS = np.random.default_rng(2002).integers(0, 1 << 64, 16, dtype=np.uint64, endpoint=False)
BLOCK_PAIRS = list(combinations(range(4), 2))
BYTE_PAIRS = list(combinations(range(8), 2))
#: All ways to change one or two of sixteen bits.
FLIPS = np.array([1 << i for i in range(16)] + [1 << i | 1 << j for i, j in combinations(range(16), 2)], dtype=np.int64)
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """The 64-bit fingerprint of the whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()  # splits at \x20 and \x09-\x0D
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(n, len(words))
    count = len(words) - k + 1
    hashed, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.fromiter((hashed(joined[a:b], seed) for a, b in zip(starts[:count].tolist(), ends[k - 1 :].tolist())), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, CHUNK):
        part = hashes[at : at + CHUNK].byteswap().view(np.uint8).reshape(-1, 8)  # highest byte first
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big")


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, text_key (a hash of the text), fp: the fingerprint as a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), n) for t in batch["text"]), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], pa.array(fps.view(np.int64))], ["doc_id", "text_key", "fp"])

    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return read.mapInArrow(of, "doc_id bigint, text_key bigint, fp bigint")


def linked_pairs(fps: np.ndarray, left: np.ndarray, right: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the index pairs, those within DISTANCE; table: distances to the references, one row each."""
    for column in range(table.shape[1]):
        near = np.abs(table[left, column] - table[right, column]) <= DISTANCE
        left, right = left[near], right[near]
        if not len(left):
            return left, right
    close = np.bitwise_count(fps[left] ^ fps[right]) <= DISTANCE
    return left[close], right[close]


def stars(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n, the smallest index reachable over the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def bucket_links(fps: np.ndarray, runs: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links in each run [lo, hi) of fps, as (fingerprint, least fingerprint of its component in the run)."""
    table = np.stack([np.bitwise_count(fps ^ p) for p in PIVOTS], axis=1).astype(np.int8)
    # short runs are paired together, by offset: position i with i + 1, i + 2, ... of the same run
    short = [(lo, hi) for lo, hi in runs if hi - lo <= 64]
    if short:
        end = np.zeros(len(fps), np.int64)
        for lo, hi in short:
            end[lo:hi] = hi
        lefts, rights = [], []
        for d in range(1, max(hi - lo for lo, hi in short)):
            left = np.flatnonzero(np.arange(len(fps)) + d < end)
            a, b = linked_pairs(fps, left, left + d, table)
            lefts.append(a)
            rights.append(b)
        left, right = np.concatenate(lefts), np.concatenate(rights)
        if len(left):
            root = stars(len(fps), left, right)
            own = np.flatnonzero(root != np.arange(len(fps)))
            yield fps[own], fps[root[own]]
    for lo, hi in (r for r in runs if r[1] - r[0] > 64):
        order = lo + np.argsort(table[lo:hi, 0], kind="stable")  # sorted by the first distance: a window of it is enough
        first = table[order, 0]
        last = np.searchsorted(first, first + DISTANCE, side="right")
        root = np.arange(hi - lo)
        for at in range(0, hi - lo, 256):
            take = np.arange(at, min(at + 256, hi - lo))
            lengths = last[take] - take - 1
            left = np.repeat(take, lengths)
            right = np.arange(len(left)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + left + 1
            a, b = linked_pairs(fps, order[left], order[right], table)
            if len(a):
                # what one block links is merged into the components so far
                ends = np.flatnonzero(root != np.arange(hi - lo))
                root = stars(hi - lo, np.concatenate([a - lo, ends]), np.concatenate([b - lo, root[ends]]))
        own = np.flatnonzero(root != np.arange(hi - lo))
        if len(own):
            yield fps[lo + own], fps[lo + root[own]]


def lookup_links(fps: np.ndarray, which: int, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links in a run that differs in the two bytes numbered `which` only, by looking up neighbours."""
    i, j = BYTE_PAIRS[which]
    own = fps[lo:hi]
    free = ((own >> np.uint64(8 * i)) & np.uint64(255)).astype(np.int64) << 8 | ((own >> np.uint64(8 * j)) & np.uint64(255)).astype(np.int64)
    at = np.full(1 << 16, -1, np.int64)
    at[free] = np.arange(hi - lo)
    lefts, rights = [], []
    for flip in FLIPS:
        other = at[free ^ flip]
        left = np.flatnonzero(other > np.arange(hi - lo))
        lefts.append(left)
        rights.append(other[left])
    root = stars(hi - lo, np.concatenate(lefts), np.concatenate(rights))
    moved = np.flatnonzero(root != np.arange(hi - lo))
    if len(moved):
        yield own[moved], own[root[moved]]


def _links(sorted_rows: DataFrame, lookup: bool) -> DataFrame:
    """Edges of rows (which, key, fp) that come sorted by which and key, whole runs in a partition."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64)] * 3

        def out(which: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.flatnonzero((np.diff(which) != 0) | (np.diff(key) != 0)) + 1
            bounds = np.concatenate([[0], new, [len(fp)]])
            wide = np.flatnonzero(np.diff(bounds) > 1)
            runs = list(zip(bounds[wide].tolist(), bounds[wide + 1].tolist()))
            own = fp.view(np.uint64)
            found = [x for lo, hi in runs for x in lookup_links(own, int(which[lo]), lo, hi)] if lookup else list(bucket_links(own, runs)) if runs else []
            for a, b in found:
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            now = [np.concatenate([r, batch[c].to_numpy(zero_copy_only=False).astype(np.int64)]) for r, c in zip(rest, ("which", "key", "fp"))]
            if not len(now[0]):
                continue
            # the last run may go on in the next batch
            cut = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = cut[-1] + 1 if len(cut) else 0
            yield from out(*(x[:cut] for x in now)) if cut else ()
            rest = [x[cut:] for x in now]
        if len(rest[0]):
            yield from out(*rest)

    return sorted_rows.mapInArrow(of, "a bigint, b bigint")


def _dealt(fps: DataFrame, keys: list) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), k.alias("key")) for i, k in enumerate(keys)])).alias("d")
    return fps.select("fp", each).select(F.col("d.which").alias("which"), F.col("d.key").alias("key"), "fp")


def _in_runs(dealt: DataFrame) -> DataFrame:
    """dealt with each bucket whole in a partition, its rows one after the other.

    The partitions are by a hash of the bucket, not by its columns: a repartition by the columns of a join before it is left out of the plan,
    and where that join is then done by broadcast, tasks read shares of all buckets.
    """
    return dealt.repartition(F.xxhash64("which", "key")).sortWithinPartitions("which", "key")


def links(fps: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (a, b) that connect every two of the distinct fingerprints within DISTANCE."""
    block = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    dealt = _dealt(fps, [F.shiftleft(block(i), 16).bitwiseOR(block(j)) for i, j in BLOCK_PAIRS])
    sizes = dealt.groupBy("which", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = durable(sizes)
    hot = kept.where(F.col("n") > bucket_limit).drop("n")
    cold = dealt.join(kept.where(F.col("n") <= bucket_limit).drop("n"), ["which", "key"], "left_semi")
    found = _links(_in_runs(cold), lookup=False)
    if not hot.isEmpty():
        crowded = dealt.join(hot, ["which", "key"], "left_semi").select("fp").distinct()
        masks = [sum(0xFF << 8 * b for b in range(8) if b not in pair) for pair in BYTE_PAIRS]
        again = _dealt(crowded, [F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])
        found = found.union(_links(_in_runs(again), lookup=True))
    return found


def id_links(marked: DataFrame) -> DataFrame | None:
    """Edges (a, b) between the fingerprints of each doc_id that has several; None where there are none. marked should be cheap to read."""
    seen = marked.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("_last"))
    many = durable(seen.where("b < _last").select("doc_id", "b"))
    if many.isEmpty():
        return None
    return marked.join(broadcastable(many, KEY_BYTES), "doc_id").where("fp != b").select(F.col("fp").alias("a"), "b")


def near_duplicates(docs: DataFrame, bucket_limit: int = BUCKET_LIMIT, by_id: bool = True) -> DataFrame:
    """doc_id, text_key, fp, root (the class as a fingerprint), component_id (its smallest doc_id) for every document.

    by_id: texts that rows of one doc_id have are linked too, as a document reaches what any of its texts does.
    """
    marked = durable(fingerprints(docs))
    distinct = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = links(distinct.select("fp"), bucket_limit)
    own = id_links(marked) if by_id else None
    roots = components(found if own is None else found.union(own))
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = classes.join(named, "root").select("fp", "root", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def hexadecimal(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class: that with the smallest doc_id, a null one last. Of rows with its id and text, one stays.

    Rows that are repeated are known from the fingerprints' table, without the texts. They are reduced in the tasks that read
    them, before anything is shuffled; the others meet the list of kept rows by a key that each has alone.
    """
    names = [unused(docs, k) for k in ("k0", "k1", "k2")]
    found = durable(near_duplicates(docs, by_id=False).select("root", *_row_key("doc_id", F.col("text_key"), names)))
    order = F.struct(names[1], names[0], names[2])
    kept = found.groupBy("root").agg(F.min(order).alias("k")).select(*[F.col(f"k.{n}").alias(n) for n in names])
    many = durable(found.groupBy(*names).count().where("count > 1").select(*names))
    keyed = docs.select("*", *_row_key("doc_id", F.xxhash64("text"), names))
    if many.isEmpty():
        return keyed.join(kept, names, "left_semi").select(docs.columns)
    if many.count() * KEY_BYTES > BROADCAST_BYTES:
        return keyed.dropDuplicates(names).join(kept, names, "left_semi").select(docs.columns)
    once = keyed.join(F.broadcast(many), names, "left_anti").join(kept, names, "left_semi")
    again = keyed.join(F.broadcast(many.join(kept, names, "left_semi")), names, "left_semi").dropDuplicates(names)
    return once.union(again.select(once.columns)).select(docs.columns)


def _row_key(doc_id: str, text_key: Column, names: list[str]) -> list[Column]:
    """An id, null or not, and a text's hash as columns that are never null."""
    return [F.coalesce(F.col(doc_id).cast("bigint"), F.lit(0)).alias(names[0]), F.col(doc_id).isNull().alias(names[1]), text_key.alias(names[2])]
