"""Quality by nearest-neighbour voting in a latent-semantic space.

Texts become counts of character runs (1 to 3 long, taken once as they are written and once by kind of character), with
log frequencies and inverse document frequencies, scaled to length one and projected on the RANK strongest singular
directions of the labelled sample. The labelled vectors (at most SAMPLE rows of RANK doubles, 3 MB) are broadcast;
every document's cosines with all of them are computed exactly, in blocks, and its NEIGHBOURS nearest (of equally near
ones, those of the lower hashes) vote for their labels, each weighted by its similarity.

Defined results: a null or empty text, and any text if nothing is labelled, gets the share of label 1 among the labelled
rows (0.5 if there are none); whole texts count; rows that repeat a doc_id are scored each by its own text; labelled rows
with the same text and label are learned once, however often they are there; null labels and ids are not learned; columns besides text are carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, rows_about

FEATURES = 1 << 12
#: At most so many labelled texts are learned from.
SAMPLE = 6000
RANK = 64
NEIGHBOURS = 25
#: Similarity is raised to this power before it weighs a vote.
SHARPNESS = 4
BLOCK = 256


def _kinds() -> np.ndarray:
    """By code point: a letter case, digit, space or other kind; ASCII marks stand for themselves."""
    out = np.full(1 << 16, 1, np.uint64)
    for i in range(1 << 16):
        c = chr(i)
        out[i] = 2 if c.islower() else 3 if c.isupper() else 4 if c.isdigit() else 5 if c == " " else 6 if c == "\n" else i if i < 128 else 1
    return out


_KIND = _kinds()


def counts_of(text: str | None) -> np.ndarray:
    """FEATURES counts: the runs as written in the lower half, those by kind in the upper one."""
    code = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(code):
        return np.zeros(FEATURES, np.float32)
    half = FEATURES // 2
    shift = np.uint64(64 - int(math.log2(half)))
    out = []
    for c in (code.astype(np.uint64), _KIND[np.minimum(code, (1 << 16) - 1)]):
        two = c[:-1] * np.uint64(0x9E3779B1) + c[1:]
        three = two[:-1] * np.uint64(0x85EBCA77) + c[2:]
        mixed = np.concatenate([c + np.uint64(1 << 40), two + np.uint64(1 << 41), three])
        out.append(np.bincount(((mixed * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64), minlength=half))
    return np.concatenate(out).astype(np.float32)


@dataclass
class Space:
    """idf and directions of the space; vectors and labels of the labelled rows; prior: the share of label 1."""

    idf: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors in the space of rows of counts; zero where there is nothing."""
        out = (weighted(counts, self.idf) @ self.directions).astype(float)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        cosine = np.round(self.project(counts) @ self.vectors.T, 12)
        k = min(NEIGHBOURS, len(self.labels))
        least = np.partition(cosine, len(self.labels) - k, axis=1)[:, len(self.labels) - k, None]
        near = cosine >= least
        tied = near.sum(axis=1) > k
        if tied.any():
            nearer, equal = cosine[tied] > least[tied], cosine[tied] == least[tied]
            near[tied] = nearer | equal & (equal.cumsum(axis=1) <= k - nearer.sum(axis=1, keepdims=True))
        row, which = np.nonzero(near)
        weight = np.maximum(cosine[row, which], 0) ** SHARPNESS
        total, vote = np.bincount(row, weight, len(cosine)), np.bincount(row, weight * self.labels[which], len(cosine))
        return np.where((total > 0) & (counts.sum(axis=1) > 0), np.clip(vote / np.maximum(total, 1e-300), 0, 1), self.prior)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    for half in (x[:, : FEATURES // 2], x[:, FEATURES // 2 :]):  # both views weigh alike
        half /= np.maximum(np.linalg.norm(half, axis=1, keepdims=True), 1e-12)
    return x


@dataclass
class Sample:
    """Sparse rows of counts, of which only a block is dense at a time, and their labels."""

    start: np.ndarray
    at: np.ndarray
    n: np.ndarray
    labels: np.ndarray

    def blocks(self) -> Iterator[np.ndarray]:
        for lo in range(0, len(self.labels), BLOCK):
            hi = min(lo + BLOCK, len(self.labels))
            out = np.zeros((hi - lo, FEATURES), np.float32)
            span = slice(self.start[lo], self.start[hi])
            out[np.repeat(np.arange(hi - lo), np.diff(self.start[lo : hi + 1])), self.at[span]] = self.n[span]
            yield out


def fit_space(sample: Sample, rank: int = RANK) -> Space:
    labels = sample.labels
    if not len(labels):
        return Space(np.ones(FEATURES, np.float32), np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5)
    idf = (np.log((1 + len(labels)) / (1 + sum((b > 0).sum(axis=0) for b in sample.blocks()))) + 0.1).astype(np.float32)
    gram = np.zeros((FEATURES, FEATURES), np.float32)
    for b in sample.blocks():
        x = weighted(b, idf)
        gram += x.T @ x
    # the strongest directions by subspace iteration: the full decomposition of the Gram matrix would take ten times the memory
    basis = np.linalg.qr(np.random.default_rng(1).standard_normal((FEATURES, min(rank, FEATURES) + 16)).astype(np.float32))[0]
    for _ in range(20):
        basis = np.linalg.qr(gram @ basis)[0]
    values, turn = np.linalg.eigh(basis.T @ gram @ basis)
    space = Space(idf, np.ascontiguousarray((basis @ turn)[:, ::-1][:, :rank]).astype(np.float32), np.zeros((0, rank), np.float32), labels.astype(float), float(labels.mean()))
    space.vectors = np.concatenate([space.project(b) for b in sample.blocks()])
    return space


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [counts_of(t.as_py()) for t in batch["text"]]
        at = [np.flatnonzero(r) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch["label"], batch["u"], pa.array([a.astype(np.int16) for a in at], pa.list_(pa.int16())), pa.array([r[a] for r, a in zip(rows, at)], pa.list_(pa.float32()))], ["label", "u", "at", "n"]
        )


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, rank: int = RANK, seed: int = 5) -> Space:
    """The space of at most `sample` labelled texts; labels has doc_id and the label column, 0 or 1."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("label")).distinct()
    known = known.join(docs.select(F.col("doc_id").alias("label_id")).distinct(), "label_id", "left_semi")
    # a little more than asked for, as texts may repeat; small by this bound, so the documents are not shuffled to meet it
    drawn = rows_about(durable(known), int(1.3 * sample), "label_id", seed=seed)
    met = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("label_id"))
    # an id or a text that is there many times is one row for each text and label before the bound is applied
    once = durable(met.groupBy("label", F.xxhash64(F.lit(seed), F.coalesce("text", F.lit(""))).alias("u")).agg(F.min("text").alias("text")))
    key = F.struct("u", "label")
    last = once.select(key.alias("last")).orderBy("last").limit(sample).agg(F.max("last").alias("last"))
    rows = once.join(F.broadcast(last), key <= F.col("last")).select("label", "u", "text")  # last is one row
    got = rows.mapInArrow(_counted, "label int, u bigint, at array<smallint>, n array<float>").toArrow()
    got = got.take(pa.array(np.argsort(got["u"].to_numpy(), kind="stable"))).combine_chunks()
    at, n = (got[c].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.float32())) for c in ("at", "n"))
    start = np.concatenate([[0], np.cumsum(got["at"].combine_chunks().value_lengths().to_numpy() if got.num_rows else [])]).astype(np.int64)
    return fit_space(Sample(start, at.flatten().to_numpy().astype(np.int64), n.flatten().to_numpy(), got["label"].to_numpy().astype(float)), rank)


def score(docs: DataFrame, space: Space) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier)."""
    spread = docs.sparkSession.sparkContext.broadcast(space)
    kept = [f for f in docs.schema.fields if f.name.lower() != "score"]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = spread.value
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                found = own.score(np.stack([counts_of(t.as_py()) for t in batch["text"]]))
                yield pa.RecordBatch.from_arrays([batch[f.name] for f in kept] + [pa.array(found, pa.float64())], [*(f.name for f in kept), "score"])

    return docs.select(*[f.name for f in kept]).mapInArrow(of, schema)
