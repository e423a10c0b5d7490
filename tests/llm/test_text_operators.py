"""Language, quality, near-duplicates, contamination, mixing, sharding: edge cases and brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hypnoflow.llm import components, decontam, langid, mixing, quality, sharding, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, Shard int, mix_key int, text_key string, hit_id int"
VOCAB = {
    "en": "the and of that is was for with this from house river night sleep train window".split(),
    "de": "der die und das ist nicht mit für über schlaf nacht fenster straße können wasser schön".split(),
    "fr": "le la les et des une que dans pour avec être forêt nuit sommeil fenêtre où".split(),
    "es": "el los las y que una para con por está noche sueño ventana año niño calle".split(),
}


def sentence(rng, lang, n):
    return " ".join(rng.choice(VOCAB[lang]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(160):
        lang = list(VOCAB)[i % 4]
        out.append((i, sentence(rng, lang, rng.randrange(8, 60)), lang, f"src{rng.choice([0, 0, 0, 1, 2])}"))
    out += [(200, None, "en", "src1"), (201, "", "en", None), (202, "12 34 ##", None, "src1"), (203, out[3][1], "fr", "src0"), (203, out[3][1], "fr", "src0"), (None, "Une nuit", None, "src2"), (None, None, None, None)]
    out.append((204, " ".join(sentence(rng, "en", 30) for _ in range(3000)), "en", "src0"))
    out += [(300 + i, out[0][1], "en", "src0") for i in range(60)]  # a hot group of copies
    return [(a, b, c, d, len(b) if b else None, "x", 1, 2, "k", 4) for a, b, c, d in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_language(spark, docs, none, rows):
    model = langid.train(docs)
    got = langid.identify(docs, model).select("text", "lang", "lang_pred", "score").collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    known = [r for r in got if r.lang and r.text and any(c.isalpha() for c in r.text) and len(r.text) > 40 and r.text not in (rows[0][1], rows[3][1])]
    assert sum(r.lang == r.lang_pred for r in known) / len(known) > 0.99
    assert langid.identify(none, model).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.train(none)).collect()} == {"und"}
    one = langid.train(docs.where("lang = 'de'"))
    assert one.predict("Nacht") == ("de", 1.0)


def test_held_out_languages(spark):
    rng = random.Random(9)
    make = lambda n: [(sentence(rng, lang, 25), lang) for lang in VOCAB for _ in range(n)]
    model = langid.train(spark.createDataFrame(make(40), "text string, lang string"))
    assert all(model.predict(t)[0] == lang for t, lang in make(40))
    assert model.families == ["germanic", "romance"] and len(model.pairs["romance"]) == 1


def test_quality(spark, docs, none, rows):
    rng = random.Random(3)
    made = [(1000 + i, sentence(rng, "en", 30) if i % 2 else " ".join(rng.choice(["$$$", "buy!!", "###", "|"]) for _ in range(30)), i % 2) for i in range(120)]
    texts = spark.createDataFrame([(a, b) for a, b, _ in made], "doc_id bigint, text string")
    labels = spark.createDataFrame([(a, q) for a, _, q in made[:80]] + [(5000, None), (None, 1)], "doc_id bigint, quality int")
    space = quality.fit(texts, labels)
    got = {r.doc_id: r.score for r in quality.score(texts, space).collect()}
    assert all((got[a] >= 0.3) == bool(q) for a, _, q in made[80:])
    scored = quality.score(docs, space).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert all(r.score == space.prior for r in scored if not r.text)
    assert quality.score(none, space).count() == 0
    bare = quality.fit(texts, labels.limit(0))
    assert {r.score for r in quality.score(texts, bare).collect()} == {0.5}
    # each vote from exact cosines, one by one
    counts = np.stack([quality.counts_of(b) for _, b, _ in made])
    vectors = space.project(counts)
    for v, s in zip(vectors, space.score(counts)):
        cosine = [math.fsum(a * b for a, b in zip(v, x)) for x in space.vectors]
        near = sorted(range(len(cosine)), key=lambda i: (-round(cosine[i], 12), i))[: quality.NEIGHBOURS]
        w = [max(cosine[i], 0) ** quality.SHARPNESS for i in near]
        assert abs(sum(x * space.labels[i] for x, i in zip(w, near)) / sum(w) - s) < 1e-6


def test_quality_of_tied_neighbours():
    vectors = np.eye(4)[[0] * 30 + [1] * 5]  # more equal ones than vote
    labels = np.array([1.0] * 10 + [0.0] * 20 + [1.0] * 5)
    space = quality.Space(np.ones(quality.FEATURES, np.float32), np.zeros((quality.FEATURES, 4), np.float32), vectors, labels, 0.5)
    space.project = lambda counts: np.array([[1.0, 0, 0, 0], [0.6, 0.8, 0, 0], [0, 0, 1.0, 0]])
    w = [0.8**4] * 5 + [0.6**4] * 20
    want = [10 / 25, sum(x * y for x, y in zip(w, [1.0] * 5 + [1.0] * 10 + [0.0] * 10)) / sum(w), 0.5]
    assert np.allclose(space.score(np.ones((3, quality.FEATURES), np.float32)), want, atol=1e-12)


def test_quality_learns_no_more_than_its_bound(spark):
    rng = random.Random(8)
    rows = [(1, f"{sentence(rng, 'en', 6)} {i}") for i in range(3000)] + [(2, "the same")] * 3000 + [(i, sentence(rng, "de", 9)) for i in range(3, 400)]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 400)] * 3 + [(2, 1)], "doc_id bigint, quality int")
    space = quality.fit(texts, labels, sample=200)
    assert len(space.labels) == len(space.vectors) == 200 and 0 < space.prior < 1
    few = quality.fit(texts.where("doc_id = 2"), labels, sample=200)
    assert sorted(few.labels) == [0.0, 1.0]  # one text, once for each of its labels


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(ids, fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and find(i) != find(j):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("limit", [simhash.BUCKET_LIMIT, 2])
def test_near_duplicates(docs, none, rows, limit):
    fps = [plain_fingerprint(r[1]) for r in rows]
    want = Counter(zip((r[0] for r in rows), fps, plain_components([r[0] for r in rows], fps)))
    got = simhash.near_duplicates(docs, limit).select("doc_id", simhash.hexadecimal().alias("fp"), "component_id").collect()
    # rows that share an id share nothing else here, so both sides count alike
    assert Counter((r.doc_id, int(r.fp, 16), r.component_id) for r in got) == want
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_near_duplicates_of_repeated_ids(spark, monkeypatch, broadcast):
    monkeypatch.setattr("hypnoflow.llm.common.BROADCAST_BYTES", broadcast)
    texts = ["one two three four", "the river by night", "sleep is far away", "a train in the fog", "no more", "last words here"]
    # 5 has two texts, 7 shares one of them and has a third; null ids are no document of their own
    rows = [(5, texts[0]), (5, texts[1]), (7, texts[1]), (7, texts[2]), (3, texts[2]), (9, texts[3]), (9, texts[3]), (None, texts[4]), (None, texts[5]), (8, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == Counter([(5, 3), (5, 3), (7, 3), (7, 3), (3, 3), (9, 9), (9, 9), (None, None), (None, 8), (8, 8)])
    assert Counter(r.text for r in simhash.keep_one(docs).collect()) == Counter(texts)


@pytest.mark.parametrize("limit", [4096, 40])
def test_links_of_close_fingerprints(spark, limit):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 30)
    fps = {int(b) for b in base}
    for b in base[:6]:
        x = int(b)
        for _ in range(60):  # chains and balls of near copies
            y = x ^ 1 << int(rng.integers(0, 63)) ^ (1 << int(rng.integers(0, 63)) if rng.random() < 0.5 else 0)
            fps.add(y)
            x = y if rng.random() < 0.3 else x
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    got = {r.node: r.root for r in components.components(simhash.links(df, limit)).collect()}
    want = plain_components(fps, fps)
    assert [got.get(f, f) for f in fps] == want


@pytest.mark.parametrize("limit", [4096, 20])
def test_links_where_joins_become_broadcasts(spark, limit):
    """A join that is planned with a shuffle and turns out small is done by broadcast; a bucket's fingerprints are to stay together."""
    rng = np.random.default_rng(5)
    centres = [int(b) for b in rng.integers(0, 1 << 62, 8)]
    fps = sorted({b ^ 1 << int(i) ^ 1 << int(j) for b in centres for i, j in rng.integers(0, 62, (60, 2))} | {int(b) for b in rng.integers(0, 1 << 62, 300)})
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint").repartition(7)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.node: r.root for r in components.components(simhash.links(df, limit)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert [got.get(f, f) for f in fps] == plain_components(fps, fps)


def test_keep_one(docs, rows):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    fps = [plain_fingerprint(r[1]) for r in rows]
    classes = plain_components([r[0] for r in rows], fps)
    assert sorted(x for x in got if x is not None) == sorted({c for c in classes if c is not None})
    assert simhash.fingerprint("a b") == plain_fingerprint("a b") and simhash.fingerprint(" \n") == 0


def test_pivots_discard_no_link():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps = np.unique(np.concatenate([fps, fps[:80] ^ np.uint64(1 << 40), fps[:60] ^ np.uint64(5)]))
    i, j = np.triu_indices(len(fps), 1)
    table = np.stack([np.bitwise_count(fps ^ p) for p in simhash.PIVOTS], axis=1).astype(np.int8)
    a, b = simhash.linked_pairs(fps, i, j, table)
    near = np.bitwise_count(fps[i] ^ fps[j]) <= 2
    assert set(zip(a, b)) == set(zip(i[near], j[near]))


def test_components_of_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)]
    df = spark.createDataFrame(chain + star + [(5, 5)], "a bigint, b bigint")
    got = {r.node: r.root for r in components.components(df).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(200, 260)} == {7} and 5 not in got
    assert components.components(df.limit(0)).count() == 0


def plain_shingles(text):
    w = [x for x in re.split("[\x00-/:-@\\[-`{-\xbf -⁯　-〿]+", (text or "").lower()) if x]
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_contained_items(spark, docs, none, rows, monkeypatch):
    rng = random.Random(11)
    long = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    items = [(i, long(rng.randrange(5, 60))) for i in range(30)] + [(40, None), (41, ""), (42, "Two words"), (43, rows[5][1]), (43, rows[5][1])]
    texts = []
    for d in range(60):
        parts = [long(rng.randrange(20, 400))]
        if d % 3 == 0:
            w = items[d % 30][1].split()
            cut = rng.randrange(0, max(1, len(w) // 8))
            parts.insert(0, long(10))
            parts.append(", ".join(w[cut:]).upper())
        texts.append((d, " ".join(parts)))
    texts += [(70, "two -- WORDS!"), (71, "these two words"), (72, None), (73, ""), (None, items[2][1]), (3, long(30)), (3, items[4][1])]
    all_docs = spark.createDataFrame(texts, "doc_id bigint, text string").unionByName(docs.select("doc_id", "text"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = {}
    for d, t in texts + [(r[0], r[1]) for r in rows]:
        have = plain_shingles(t)
        for i, x in items:
            s = plain_shingles(x)
            if s and len(s & have) >= 0.8 * len(s) - 1e-9:
                want[d, i] = max(want.get((d, i), 0), len(s & have))
    got = {(r.doc_id, r.item_id): r.n_common for r in decontam.contained_items(all_docs, bench).collect()}
    assert got == want and len(want) > 20
    with monkeypatch.context() as m:  # a table so small that all its bits are set lets all shingles through
        m.setattr(decontam, "MOST_BITS", 64)
        assert {(r.doc_id, r.item_id): r.n_common for r in decontam.contained_items(all_docs, bench).collect()} == want
    clean = decontam.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    dirty = lambda t: any(plain_shingles(x) and len(plain_shingles(x) & plain_shingles(t)) >= 0.8 * len(plain_shingles(x)) - 1e-9 for _, x in items)
    assert Counter(r.doc_id for r in clean.collect()) == Counter(r[0] for r in rows if not dirty(r[1]))
    assert decontam.contained_items(none, bench).count() == 0 and decontam.contained_items(all_docs, bench.limit(0)).count() == 0


def test_sketches_are_wide_enough(spark):
    bench = spark.createDataFrame([(i, " ".join(f"x{j}" for j in range(n + 4))) for i, n in enumerate((1, 2, 3, 5, 8, 40, 63, 64))], "item_id bigint, text string")
    words = decontam.words_of(F.col("text"))
    items = bench.select("item_id", decontam.hashes_of(words).alias("item_hashes"), F.size(F.array_distinct(decontam.shingles_of(words))).alias("n_item"))
    k = {r.item_id: r["count"] for r in decontam.sketches(items, 0.8).groupBy("item_id").count().collect()}
    for i, n in enumerate((1, 2, 3, 5, 8, 40, 63, 64)):
        assert k[i] > n - math.ceil(0.8 * n)


def poisson_copies(doc_id, text, number, rate, seed):
    """Copies of a row by the rule of the operator, by itself."""
    parts, total = max(1, math.ceil(rate / mixing.RATE_STEP)), 0
    body = hashlib.md5((text or "").encode()).hexdigest()
    for part in range(1, parts + 1):
        h = hashlib.md5(f"{seed}:{'null' if doc_id is None else doc_id}:{body}:{number}:{part}".encode()).hexdigest()
        u, m = (int(h[:13], 16) + 0.5) / 2**52, rate / parts
        p = c = math.exp(-m)
        k = 0
        while c < u and k < 1000:
            k += 1
            p *= m / k
            c += p
        total += k
    return total


def test_mixing_of_repeated_and_absent_ids(spark):
    rows = [(None, f"text {i}", "a") for i in range(3000)] + [(7, "same", "b")] * 3000 + [(8, None, "b")] * 1500 + [(i, "x", "c") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    for seed in range(10):
        got = mixing.replicate(docs, {}, seed=seed)
        made = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
        assert set(made) == {"a", "b", "c"} and all(abs(n - 3000) < 5 * math.sqrt(3000) for n in made.values())
    spread = got.repartition(16, "mix_key").withColumn("at", F.spark_partition_id()).groupBy("at").agg(F.sum((F.col("doc_id") == 7).cast("int")).alias("same"), F.count("*").alias("n")).collect()
    assert len(spread) == 16 and all(0.1 < r.same / r.n < 0.35 for r in spread)
    assert sorted({r.mix_row for r in got.where("doc_id = 7").select("mix_row").distinct().collect()})[-1] > 2900


def test_mixing(docs, none, rows):
    mixed = mixing.replicate(docs, {"src0": 1.0, "src1": 6.0, "src2": 0.0}, default_weight=1.0, out_rows=3000, seed=3)
    assert [c for c in mixed.columns if not c.startswith("mix_")] == [c for c in docs.columns if c != "mix_key"]
    got = mixed.collect()
    n = Counter(r[3] for r in rows)
    made = Counter(r.source for r in got)
    assert "src2" not in made
    for s, w in (("src0", 1), ("src1", 6), (None, 1)):
        mean = 3000 * w / 8
        assert abs(made[s] - mean) < 6 * math.sqrt(mean * (1 + 1 / n[s])) + 6 * mean / math.sqrt(n[s] * max(mean / n[s], 1))
    # each count is the inverse of the distribution at the hashed number, equal rows being numbered
    rate = {r.source: r.mix_rate for r in got}
    numbers, want = Counter(), Counter()
    for d, text, _, source, *_ in rows:
        numbers[d, source, text or ""] += 1
        if source in rate:
            want[d, source, text or ""] += poisson_copies(d, text, numbers[d, source, text or ""], rate[source], 3)
    assert Counter((r.doc_id, r.source, r.text or "") for r in got) == Counter({k: v for k, v in want.items() if v})
    assert len({(r.doc_id, r.text or "", r.source, r.mix_row, r.mix_copy) for r in got}) == len(got)
    keys = [r.mix_key for r in got]
    assert sum(a > b for a, b in zip(keys, keys[1:])) < 8  # sorted in each partition
    assert mixing.replicate(none, {}).count() == 0
    assert mixing.replicate(docs, {}, default_weight=0.0).count() == 0
    with pytest.raises(ValueError):
        mixing.replicate(docs, {"src0": -1.0})


@pytest.mark.parametrize("bucket_bytes", [sharding.BUCKET_BYTES, 20_000])
def test_sharding(docs, none, rows, bucket_bytes):
    out = sharding.shuffle_into_shards(docs, 7, seed=2, bucket_bytes=bucket_bytes)
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(7))
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    again = {(r.shard, r.slot): r.doc_id for r in sharding.shuffle_into_shards(docs, 7, seed=2, bucket_bytes=bucket_bytes).collect()}
    assert again == {(r.shard, r.slot): r.doc_id for r in got}
    other = {(r.shard, r.slot): r.doc_id for r in sharding.shuffle_into_shards(docs, 7, seed=3, bucket_bytes=bucket_bytes).collect()}
    assert other != again
    assert sharding.shuffle_into_shards(none, 7).count() == 0
    few = sharding.shuffle_into_shards(docs.limit(3), 7).collect()
    assert len(few) == 3 and all(r.slot == 0 for r in few)


def test_sharding_spreads_repeated_rows(spark):
    rows = [(i, f"text number {i}") for i in range(6000)] + [(77, "again and again")] * 6000 + [(None, None)] * 3000 + [(None, "")] * 1500
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    out = sharding.shuffle_into_shards(docs, 24, seed=4, bucket_bytes=100_000)
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    for kind, n in ((lambda r: r.doc_id == 77, 6000), (lambda r: r.text is None, 3000), (lambda r: r.text == "", 1500)):
        per = Counter(r.shard for r in got if kind(r))
        assert len(per) == 24 and all(abs(c - n / 24) < 6 * math.sqrt(n / 24) for c in per.values())


def test_sharding_order_is_the_plain_two_pass_shuffle(spark):
    rows = [(i, f"text number {i}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    hashed = docs.select("doc_id", F.xxhash64(F.lit(9), "doc_id", "text").alias("h")).withColumn("g", F.xxhash64(F.lit(9), "h", F.lit(0).cast("bigint"))).collect()
    total = sum(len(t) + sharding.ROW_BYTES for _, t in rows)
    buckets = max(-(-total // 5000), 4)
    scattered = {}
    for r in hashed:
        scattered.setdefault(r.g % buckets, []).append((r.h, r.doc_id))
    stream = []
    for bucket in sorted(scattered):
        own = [d for _, d in sorted(scattered[bucket])]
        order = np.arange(len(own))
        np.random.Generator(np.random.PCG64([9, bucket])).shuffle(order)
        stream += [own[i] for i in order]
    got = sharding.shuffle_into_shards(docs, 7, seed=9, bucket_bytes=5000).orderBy("shard", "slot").collect()
    assert [r.doc_id for r in got] == stream
    assert [r.shard for r in got] == [i * 7 // 700 for i in range(700)]


def test_many_rows_without_text_are_many_tasks(spark):
    docs = spark.range(200_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    out = sharding.shuffle_into_shards(docs, 3, bucket_bytes=1 << 20).withColumn("at", F.spark_partition_id())
    assert {r.shard: r["count"] for r in out.groupBy("shard").count().collect()} == {0: 66667, 1: 66667, 2: 66666}


def test_written_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "s"), 5, seed=1)
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().count() == 5


def test_language_learns_distinct_texts(spark, monkeypatch):
    rng = random.Random(12)
    few = [(sentence(rng, "de", 25), "de") for _ in range(3)] * 1000  # copies only
    hot = [(sentence(rng, "en", 25), "en")] * 2000 + [(sentence(rng, "en", 25), "en") for _ in range(300)]
    rows = few + hot + [("12 34", "en"), ("über", None)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    learned = langid.drawn_features(docs, 60, 11).collect()
    assert len({(r.lang, r.h) for r in learned}) == len(learned)
    assert Counter(r.lang for r in learned) == {"de": 3, "en": 60}  # all texts of the one, as many as asked for of the other
    model = langid.train(docs, sample=60)
    assert model.languages == ["de", "en"]
    assert all(model.predict(t)[0] == lang for t, lang in few[:3])


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_likelihoods_come_from_all_distinct_texts(spark, monkeypatch, broadcast):
    monkeypatch.setattr("hypnoflow.llm.common.BROADCAST_BYTES", broadcast)
    rng = random.Random(21)
    rows = [(sentence(rng, lang, rng.randrange(1, 40)), lang) for lang, n in (("en", 150), ("de", 90), ("fr", 1)) for _ in range(n)]
    docs = spark.createDataFrame(rows + rows[:40] * 3 + [("12 34", "en"), (None, "de"), ("night", None)], "text string, lang string").repartition(5)
    got = langid.train(docs, sample=20, usual=True).likelihood  # the machines' sample has no say in it
    assert list(got) == ["de", "en", "fr"] and langid.train(docs, sample=20).likelihood == {}
    for lang, (log, least) in got.items():
        texts = [langid.features(t) for t in sorted({t for t, x in rows if x == lang})]
        counts, size = np.zeros(langid.FEATURES), [min(1 / (v.astype(float) ** 2).min(), langid.RUNS_LIMIT) for _, v in texts]
        for (at, v), n in zip(texts, size):
            counts[at] += v.astype(float) ** 2 * n
        smooth = langid.SMOOTHING
        own = [v.astype(float) ** 2 @ np.log((np.maximum(counts[at] - v.astype(float) ** 2 * n, 0) + smooth) / (counts.sum() - n + smooth * langid.FEATURES)) for (at, v), n in zip(texts, size)]
        assert np.allclose(log, np.log((counts + smooth) / (counts.sum() + smooth * langid.FEATURES)), atol=1e-3)
        assert math.isclose(least, np.quantile(own, 0.01, method="lower") - langid.SLACK, abs_tol=1e-2)


def test_machines_against_plain_svm():
    rng = np.random.default_rng(2)
    n, dim = 60, 12
    x = rng.standard_normal((n, dim)) * (rng.random((n, dim)) < 0.5)
    x[:, 0] = 1.0
    sign = np.where(x @ rng.standard_normal(dim) + 0.7 * rng.standard_normal(n) > 0, 1.0, -1.0)
    rows = [(np.flatnonzero(v), v[np.flatnonzero(v)].astype(np.float32)) for v in x]
    w, b = langid.train_svm(rows, sign, rounds=4000, close=1e-7)
    cost = langid.PENALTY * n / (2 * np.where(sign > 0, (sign > 0).sum(), (sign < 0).sum()))
    plain = np.zeros((n, langid.FEATURES))
    for i, (at, v) in enumerate(rows):
        plain[i, at] = v
    primal = lambda w, b: 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - sign * (plain @ w + b))).sum()
    # the dual by plain projected gradient on the whole matrix: its value bounds every primal one from below
    q = np.outer(sign, sign) * (plain @ plain.T + 1)
    alpha, step = np.zeros(n), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(60_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, cost)
    dual = alpha.sum() - 0.5 * alpha @ q @ alpha
    assert dual - 1e-6 <= primal(w, b) <= dual * 1.001 + 1e-3


def test_twenty_languages(spark):
    rng = random.Random(1)
    codes = [c for codes in langid.FAMILIES.values() for c in codes][:20]
    words = {c: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 8))) for _ in range(60)] for c in codes}
    make = lambda n: [(" ".join(rng.choice(words[c]) for _ in range(20)), c) for c in codes for _ in range(n)]
    model = langid.train(spark.createDataFrame(make(40) + [("", "en"), ("zzz zzz", "")], "text string, lang string"))
    assert sorted(model.languages) == sorted([*codes, ""])
    assert np.mean([model.predict(t)[0] == c for t, c in make(5)]) > 0.98


def test_many_labels(spark, monkeypatch):
    """More labels than are learned, copies not counted; a sample that is bounded in all; labels that are no codes."""
    rng = random.Random(4)
    words = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(20)] for _ in range(130)]
    make = lambda n: [(" ".join(rng.choices(words[i], k=15)), f"x{i:03}") for i in range(130) for _ in range(n)]
    rows = make(5) + [(" ".join(words[3]), "rare")] * 50
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 130)
    monkeypatch.setattr(langid, "SAMPLE_IN_ALL", 520)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    assert set(Counter(r.lang for r in langid.drawn_features(df, 400, 11).collect()).values()) == {4}
    model = langid.train(df)
    assert model.languages == [f"x{i:03}" for i in range(130)] and max(map(len, model.members.values())) <= langid.FAMILY_MOST
    assert np.mean([model.predict(t)[0] == lang for t, lang in make(1)]) > 0.95


def test_variants_are_told_apart_one_against_one(spark):
    rng = random.Random(5)
    made = []
    for lang, extra in (("pt-BR", "você ônibus trem"), ("pt_PT", "autocarro comboio tu"), ("nor", "ikke og jeg"), ("zh-cn", "men le de"), ("q1", "zug zag"), ("q2", "zug zog")):
        base = {"pt": "casa não mais uma para", "no": "hus en til som", "zh": "ni hao ma shi", "q1": "wuwu wawa zuzu", "q2": "wuwu wawa zuzu"}[lang[:2]].split() * 3
        made += [(" ".join(rng.choices(base + extra.split(), k=30)), lang) for _ in range(40)]
    model = langid.train(spark.createDataFrame(made, "text string, lang string"))
    assert model.family_of["pt-BR"] == model.family_of["pt_PT"] == "romance" and model.family_of["nor"] == "germanic"
    assert [x[1:] for x in model.pairs["romance"]] == [("pt-BR", "pt_PT")]
    assert model.family_of["q1"] == model.family_of["q2"] != model.family_of["zh-cn"]
    assert np.mean([model.predict(t)[0] == lang for t, lang in made]) > 0.95


def test_families_by_mean_features():
    unit = lambda *v: np.array(v) / np.linalg.norm(v)
    means = {"a1": unit(1, 0, 0), "a2": unit(1, 0.1, 0), "b1": unit(0, 1, 0), "c1": unit(0, 0, 1), "c2": unit(0, 0.1, 1), "en": unit(1, 0, 0), "de-AT": unit(0, 1, 0), "": unit(0, 1, 1)}
    got = langid.families_of(means)
    assert got["a1"] == got["a2"] and got["c1"] == got["c2"] and len({got[x] for x in ("a1", "b1", "c1", "")}) == 4 and got["en"] == got["de-AT"] == "germanic"
    many = {f"en-{i:03}": unit(math.cos(i), math.sin(i), 0.5) for i in range(40)} | {f"q{i:03}": unit(1, i / 10_000, 0) for i in range(40)}
    got = langid.families_of(many)
    sizes = Counter(got.values())
    assert len(got) == 80 and max(sizes.values()) <= langid.FAMILY_MOST and sum(f.startswith("germanic~") for f in sizes) == 4


def test_keep_one_of_repeated_rows(spark, monkeypatch):
    rows = [(5, "one text that is there again and again")] * 4000 + [(None, "no id at all, many times")] * 2000 + [(i, f"{i} {sentence(random.Random(i), 'en', 30)}") for i in range(10, 300)] + [(None, None)] * 50
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, k1 int").repartition(6)
    want = Counter({r: 1 for r in rows})
    assert Counter((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()) == want
    plan = simhash.keep_one(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") + plan.count("HashAggregate") + plan.count("ObjectHashAggregate") > 1
    monkeypatch.setattr(simhash, "BROADCAST_BYTES", 0)
    assert Counter((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()) == want
