"""Language identification in two levels: first the language family, then one-versus-one machines within it.

Texts are lower-cased, everything but letters is taken as one space, and runs of 1 to 3 characters are hashed into
FEATURES counts, scaled to length one. Linear support vector machines (hinge loss, dual coordinate descent) decide: one
against the rest for each family, then one for each pair of languages in the winning family, whose votes are counted,
margins breaking ties. Training uses at most SAMPLE distinct texts a language, and SAMPLE_IN_ALL of all, those of the lowest hashes in the whole table.
The sample, which is bounded, goes to a few tasks, and each trains its share of the machines from it; only the weights (FEATURES
floats a machine) go to the driver and from there to the executors.

Families are those of the languages' codes, told by their first part ("pt-BR" and "pt_PT" are both Romance, and so told apart one against one);
labels that are no known codes, and those of families of more than FAMILY_MOST labels, are grouped by the cosine of their mean features, at
most FAMILY_MOST together. So machines grow with the number of labels, not with its square.

Machines only compare languages and must name one of them for anything. So a model also knows how likely each language's own
texts are (mean log-likelihood of a text's runs under the counts of all of them, each text without itself), if asked for, and `usual` is
false for what is far below that: letter junk, and languages that were not learned. It does not depend on how many there are.

Defined results: `und` with score 0 where the text is null or has no letter; with nothing to learn from, every text is
`und` (and usual, if it has a letter); with one language, all texts get it with score 1; a null label is not learned, an empty one is a
language of that name; of more than MOST_LANGUAGES labels those with the most distinct texts are learned (the first in the alphabet of equals);
whole texts count, however long; repeated rows are predicted alike; columns besides text are carried along.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.series import percentile
from .common import broadcastable, durable, unit_hash

FEATURES = 1 << 15
#: At most so many texts a language are learned from, and so many of all languages, the same share of each.
SAMPLE, SAMPLE_IN_ALL = 400, 20_000
#: The model is bounded: at most so many labels are learned.
MOST_LANGUAGES = 500
#: At most so many labels are a family; labels that are no known codes are one if the cosine of their mean features is at least NEAR.
FAMILY_MOST, NEAR = 12, 0.9
#: Mean features are folded to so many numbers.
FOLDED = 1 << 10
PENALTY = 20.0
#: Added to the counts of all features, so that an unseen one has a likelihood.
SMOOTHING = 0.01
#: A text is usual down to so many nats a run under all but a hundredth of the texts, and short ones, which vary, to
#: SHORT_SLACK / sqrt(distinct runs) further.
SLACK, SHORT_SLACK = 1.5, 8.0
#: The share of a language's texts that may be less likely than a usual one, counts' unit, and how many of them are shuffled together.
USUAL, UNIT, BLOCK = 0.01, 1 << 20, 1 << 9
#: A long text counts as this many runs at most in its language's likelihoods, so that none of them is the language.
RUNS_LIMIT = 3000.0
#: Families of language codes of two and three letters.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi", "eng", "deu", "ger", "nld", "dut", "swe", "dan", "nor", "nob", "nno", "isl", "afr", "fry", "ltz", "yid"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la", "fra", "fre", "spa", "ita", "por", "ron", "rum", "cat", "glg", "oci", "lat"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk", "rus", "ukr", "bel", "pol", "ces", "cze", "slk", "slv", "hrv", "srp", "bos", "bul", "mkd"),
    "uralic": ("fi", "et", "hu", "fin", "est", "hun"),
    "baltic": ("lt", "lv", "lit", "lav"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tur", "aze", "kaz", "uzb", "kir"),
    "indic": ("hi", "ur", "bn", "mr", "gu", "pa", "ne", "hin", "urd", "ben", "mar", "guj", "pan", "nep"),
    "semitic": ("ar", "he", "mt", "am", "ara", "heb", "mlt", "amh"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def known_family(label: str) -> str | None:
    """The family of a language code, by its first part; None where it is not known."""
    return FAMILY_OF.get(re.split("[-_]", label.lower())[0])


def families_of(means: dict[str, np.ndarray]) -> dict[str, str]:
    """The family of each label, from the labels' mean features, which have length one."""
    out: dict[str, str] = {}
    named: dict[str | None, list[str]] = {}
    for label in sorted(means):
        named.setdefault(known_family(label), []).append(label)
    for name, labels in named.items():
        if name is not None and len(labels) <= FAMILY_MOST:
            out |= dict.fromkeys(labels, name)
            continue
        near = np.stack([means[x] for x in labels]) @ np.stack([means[x] for x in labels]).T
        # a family that is too large is cut around the labels that are furthest apart; among others, what is near enough is a family
        seeds = [0]
        while len(seeds) * FAMILY_MOST < len(labels) if name is not None else near[:, seeds].max(axis=1).min() < NEAR:
            seeds.append(int(near[:, seeds].max(axis=1).argmin()))
        size = dict.fromkeys(seeds, 0)
        for i in sorted(range(len(labels)), key=lambda i: (i not in size, -near[i, seeds].max(), i)):
            free = [s for s in size if size[s] < FAMILY_MOST and (name is not None or near[i, s] >= NEAR)]
            best = max(free, key=lambda s: near[i, s], default=i)
            size[best] = size.get(best, 0) + 1
            out[labels[i]] = f"{name or ''}~{labels[best]}"
    return out


_LETTER = np.array([chr(i).isalpha() for i in range(1 << 16)])


def feature_indices(text: str | None) -> np.ndarray:
    """The hashed index of every run of 1 to 3 characters; empty where the text has no letter."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    low = code < 1 << 16
    letter = _LETTER[np.where(low, code, 0)]
    if not low.all():
        letter[~low] = [chr(c).isalpha() for c in code[~low]]
    if not letter.any():
        return np.empty(0, np.int64)
    code = np.where(letter, code, 32)
    kept = letter | np.concatenate([[True], letter[:-1]])
    code = np.concatenate([[32], code[kept], [32]]).astype(np.uint64)
    two = code[:-1] * np.uint64(0x9E3779B1) + code[1:]
    three = two[:-1] * np.uint64(0x85EBCA77) + code[2:]
    mixed = np.concatenate([code + np.uint64(1 << 40), two + np.uint64(1 << 41), three])
    return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - int(math.log2(FEATURES)))).astype(np.int64)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the text's feature vector of length one."""
    found = feature_indices(text)
    if not len(found):
        return found, np.empty(0, np.float32)
    counts = np.bincount(found, minlength=FEATURES)
    at = np.flatnonzero(counts)
    value = np.sqrt(counts[at])
    return at, (value / np.linalg.norm(value)).astype(np.float32)


def train_svm(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, rounds: int = 30, seed: int = 7, close: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine by dual coordinate descent on sparse rows; the bias is a constant feature.

    It ends after `rounds` passes, or when no row's gradient in a pass was further than `close` from what its bounds ask for.
    """
    n = len(sign)
    weights, bias, alpha = np.zeros(FEATURES), 0.0, np.zeros(n)
    rows = [(at, value.astype(float)) for at, value in rows]
    size = [float(value @ value) + 1.0 for _, value in rows]
    cost = PENALTY * n / (2.0 * np.where(sign > 0, (sign > 0).sum(), (sign < 0).sum()))  # classes count alike
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(n).tolist():
            at, value = rows[i]
            slope = sign[i] * (weights[at] @ value + bias) - 1.0
            new = min(max(alpha[i] - slope / size[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                weights[at] += step * value
                bias += step
                alpha[i] = new
                worst = max(worst, abs(slope))
        if worst <= close:
            break
    return weights, bias


@dataclass
class Model:
    """weights: a column for each machine, those of the families first; pairs: by family, (column, first, second language)."""

    languages: list[str] = field(default_factory=list)
    family_of: dict[str, str] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    pairs: dict[str, list[tuple[int, str, str]]] = field(default_factory=dict)
    #: By language: log-likelihood of each feature, and the least mean of a usual text.
    likelihood: dict[str, tuple[np.ndarray, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.families = sorted(set(self.family_of.values()))
        self.members = {f: [x for x in self.languages if self.family_of[x] == f] for f in self.families}

    def predict(self, text: str | None) -> tuple[str, float]:
        return self._predict(*features(text))

    def predict_usual(self, text: str | None) -> tuple[str, float, bool]:
        """Language and score, and whether the text is like those that this language, or another, was learned from."""
        at, value = features(text)
        lang, score = self._predict(at, value)
        if lang not in self.likelihood:
            return lang, score, len(at) > 0
        share, slack = value.astype(float) ** 2, SHORT_SLACK / math.sqrt(len(at))
        # the machines may be wrong about a short text; that is no reason to take it for junk
        own = [self.likelihood[lang], *(x for name, x in self.likelihood.items() if name != lang)]
        return lang, score, any(share @ log[at] >= least - slack for log, least in own)

    def _margins(self, at: np.ndarray, value: np.ndarray, first: int, after: int) -> tuple[np.ndarray, np.ndarray]:
        margin = value @ self.weights[at, first:after] + self.bias[first:after]
        return margin, 1 / (1 + np.exp(-2.0 * margin.astype(float)))

    def _predict(self, at: np.ndarray, value: np.ndarray) -> tuple[str, float]:
        if not len(at) or not self.languages:
            return "und", 0.0
        which, score = 0, 1.0
        if len(self.families) > 1:
            margin, sure = self._margins(at, value, 0, len(self.families))
            which = int(np.argmax(margin))
            score = float(sure[which] / sure.sum())
        family = self.families[which]
        members, pairs = self.members[family], self.pairs[family]
        if len(members) == 1:
            return members[0], score
        first = pairs[0][0]  # a family's pairs stand together
        margin, sure = self._margins(at, value, first, first + len(pairs))
        votes = dict.fromkeys(members, 0.0)
        for column, a, b in pairs:
            own = float(margin[column - first])
            votes[a if own >= 0 else b] += 1 + min(abs(own), 100.0) / 1000  # margins break ties
        best = max(members, key=lambda x: votes[x])
        shares = [sure[c - first] if a == best else 1 - sure[c - first] for c, a, b in pairs if best in (a, b)]
        return best, float(score * min(shares))


def runs_of(value: np.ndarray) -> tuple[np.ndarray, float]:
    """The share of each feature in a text's runs, and how many runs the text counts as."""
    share = value.astype(float) ** 2
    return share, min(1 / share.min(), RUNS_LIMIT)  # the rarest run of a text is mostly there once


def learn_likelihood(labelled: DataFrame, languages: list[str]) -> dict[str, tuple[np.ndarray, float]]:
    """By language: log-likelihood of each feature, and the least mean of a text that is usual in it, from all rows with text and lang.

    Every distinct text of a language counts once: a row with copies has its share of that. The tasks add up a vector of counts for each
    language (the languages are bounded), which are shuffled in blocks; counts are whole multiples of 1 / UNIT, so their sums are exact. Then
    each text's mean under the counts without itself is made, a number a text, and the threshold is their exact hundredth.
    """
    rows = labelled.where(F.col("lang").isin(languages) & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("lang", "text").alias("h"))
    many = durable(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    weighed = rows.join(broadcastable(many, 48), "h", "left") if not many.isEmpty() else rows.withColumn("n", F.lit(None).cast("bigint"))

    def each(batch: pa.RecordBatch) -> Iterator[tuple[int, str, np.ndarray, np.ndarray, float]]:
        for i, lang in enumerate(batch["lang"].to_pylist()):
            at, value = features(batch["text"][i].as_py())
            if len(at):
                yield i, lang, at, *runs_of(value)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            copies = batch["n"].fill_null(1).to_numpy()
            for i, lang, at, share, n in each(batch):
                held.setdefault(lang, np.zeros(FEATURES, np.int64))[at] += np.rint(share * (n * UNIT / copies[i])).astype(np.int64)
        for lang, counts in held.items():
            blocks = counts.reshape(-1, BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(blocks)), pa.array(range(len(blocks)), pa.int32()), pa.array(list(blocks), pa.list_(pa.int64()))], ["lang", "block", "counts"])

    def added(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(c.values.to_numpy() for c in table["counts"])
        return pa.table({"lang": [key[0].as_py()], "block": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([total], pa.list_(pa.int64()))})

    kind = "lang string, block int, counts array<bigint>"
    parts = weighed.select("lang", "text", "n").mapInArrow(counted, kind).groupBy("lang", "block").applyInArrow(added, kind).toArrow()
    counts: dict[str, np.ndarray] = {}
    for lang, block, own in zip(parts["lang"].to_pylist(), parts["block"].to_pylist(), parts["counts"]):
        counts.setdefault(lang, np.zeros(FEATURES))[block * BLOCK : (block + 1) * BLOCK] = own.values.to_numpy() / UNIT
    spread = labelled.sparkSession.sparkContext.broadcast({lang: (c, c.sum()) for lang, c in counts.items()})  # FEATURES numbers for each language

    def without_itself(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = spread.value
        for batch in batches:
            found = []
            for i, lang, at, share, n in each(batch):
                own, total = known[lang]
                found.append((i, share @ np.log((np.maximum(own[at] - share * n, 0) + SMOOTHING) / (total - n + SMOOTHING * FEATURES))))
            kept = batch.select(["lang", "h"]).take(pa.array([i for i, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([x for _, x in found], pa.float64())], ["lang", "h", "own"])

    means = rows.select("lang", "h", "text").mapInArrow(without_itself, "lang string, h bigint, own double")
    once = durable(means.groupBy("lang", "h").agg(F.min("own").alias("own")))
    least = {r["lang"]: r["value"] for r in percentile(once, "lang", USUAL, "lower", "own").collect()}
    spread.unpersist()
    return {lang: (np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * FEATURES)).astype(np.float32), least[lang] - SLACK) for lang, c in sorted(counts.items())}


def drawn_features(labelled: DataFrame, sample: int, seed: int) -> DataFrame:
    """lang, h, u, at, value: the features of at most `sample` distinct texts a language, those of the lowest hashes."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", "text", F.xxhash64(F.lit(seed), "text").alias("h"), unit_hash("text", seed=seed).alias("u"))
    # copies count once; the estimate, within a few hundredths, needs no shuffle
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    sample = min(sample, max(SAMPLE_IN_ALL // max(len(counts), 1), 1))
    # a little more than asked for, so that chance leaves enough, then the lowest hashes of each language
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 1.3 * sample / max(r["n"], 1))))])
    drawn = rows.where(F.col("u") < share[F.col("lang")]) if counts else rows.limit(0)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()  # of what is drawn, a little over `sample` a language
        for batch in batches:
            fresh = []
            for i, key in enumerate(zip(batch["lang"].to_pylist(), batch["h"].to_pylist())):
                if key not in seen:
                    seen.add(key)
                    fresh.append(i)
            found = [(i, *features(batch["text"][i].as_py())) for i in fresh]
            found = [x for x in found if len(x[1])]
            own = batch.select(["lang", "h", "u"]).take(pa.array([i for i, *_ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array([a.astype(np.int32) for _, a, _ in found], pa.list_(pa.int32())), pa.array([v for *_, v in found], pa.list_(pa.float32()))], ["lang", "h", "u", "at", "value"])

    made = drawn.mapInArrow(of, "lang string, h bigint, u double, at array<int>, value array<float>")
    once = made.withColumn("r", F.row_number().over(Window.partitionBy("lang", "h").orderBy("u"))).where("r = 1")
    least = once.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("u", "h"))).where(F.col("r") <= sample)
    return durable(least.drop("r"))


def _sparse(table: pa.Table) -> tuple[pa.Table, list[tuple[np.ndarray, np.ndarray]]]:
    """The table in a set order, and its rows' indices and values."""
    table = table.sort_by([("lang", "ascending"), ("u", "ascending"), ("h", "ascending")])
    return table, [(at.values.to_numpy(), value.values.to_numpy()) for at, value in zip(table["at"], table["value"])]


def train(labelled: DataFrame, sample: int = SAMPLE, seed: int = 11, usual: bool = False) -> Model:
    """A model from rows with text and lang. usual: it also knows what is usual in each language, which all rows are read for twice more."""
    spark = labelled.sparkSession
    drawn = drawn_features(labelled, sample, seed)

    def averaged(table: pa.Table) -> pa.Table:
        table, rows = _sparse(table)
        mean = np.zeros(FOLDED)
        for at, value in rows:
            np.add.at(mean, at % FOLDED, value)
        return pa.table({"lang": table["lang"][:1], "mean": pa.array([(mean / np.linalg.norm(mean)).tobytes()])})

    told = drawn.groupBy("lang").applyInArrow(averaged, "lang string, mean binary").toArrow().to_pylist()  # MOST_LANGUAGES rows
    if not told:
        return Model()
    languages = sorted(r["lang"] for r in told)
    family_of = families_of({r["lang"]: np.frombuffer(r["mean"]) for r in told})
    families = sorted(set(family_of.values()))
    machines: list[tuple[list[str], list[str]]] = []  # the languages on either side
    if len(families) > 1:
        machines += [([x for x in languages if family_of[x] == f], [x for x in languages if family_of[x] != f]) for f in families]
    pairs: dict[str, list[tuple[int, str, str]]] = {f: [] for f in families}
    for f in families:
        for a, b in combinations([x for x in languages if family_of[x] == f], 2):
            pairs[f].append((len(machines), a, b))
            machines.append(([a], [b]))

    weights, bias = np.zeros((FEATURES, len(machines)), np.float32), np.zeros(len(machines), np.float32)
    if machines:
        shares = min(len(machines), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))

        def trained(key: tuple, table: pa.Table) -> pa.Table:
            table, rows = _sparse(table)
            label = np.array(table["lang"].to_pylist(), object)
            out = []
            for m in range(key[0].as_py(), len(machines), shares):
                side = np.where(np.isin(label, machines[m][0]), 1.0, 0.0) - np.isin(label, machines[m][1])
                own = np.flatnonzero(side)
                w, b = train_svm([rows[i] for i in own.tolist()], side[own])
                out.append((m, w.astype(np.float32).tobytes(), b))
            return pa.table({c: pa.array(x, k) for c, x, k in zip(("machine", "weights", "bias"), zip(*out), (pa.int32(), pa.binary(), pa.float64()))})

        # each share of the machines gets the whole sample, which is bounded, once
        every = drawn.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        made = every.repartition(shares, "share").groupBy("share").applyInArrow(trained, "machine int, weights binary, bias double").toArrow()
        for m, w, b in zip(made["machine"].to_pylist(), made["weights"], made["bias"].to_pylist()):
            weights[:, m], bias[m] = np.frombuffer(w.as_py(), np.float32), b
    return Model(languages, family_of, weights, bias, pairs, learn_likelihood(labelled, languages) if usual else {})


def identify(docs: DataFrame, model: Model, usual: str | None = None) -> DataFrame:
    """docs with lang_pred and score, and whether the text is usual in a column of that name, if one is given."""
    spread = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES floats for each machine
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *([T.StructField(usual, T.BooleanType())] if usual else [])]
    kept = [f for f in docs.schema.fields if f.name.lower() not in {a.name.lower() for a in added}]
    schema = T.StructType([*kept, *added])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = spread.value
        for batch in batches:
            found = [(own.predict_usual if usual else own.predict)(t.as_py()) for t in batch["text"]]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in zip(range(len(added)), (pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch[f.name] for f in kept] + columns, [f.name for f in schema.fields])

    return docs.select(*[f.name for f in kept]).mapInArrow(of, schema)
