"""The whole pipeline against a plain version of every stage's rule."""

import random
from collections import Counter

import pytest
from test_text_operators import VOCAB, plain_components, plain_fingerprint, plain_shingles, poisson_copies, sentence

import corpus_pipeline


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    items = [(i, " ".join(f"b{rng.randrange(500)}" for _ in range(rng.randrange(8, 40)))) for i in range(6)] + [(9, None)]
    rows = []
    for i in range(240):
        lang = list(VOCAB)[i % 4]
        text = sentence(rng, lang, rng.randrange(20, 80))
        if i % 12 == 0:
            text = f"{text} {items[i % 6][1].title()}. {sentence(rng, lang, 10)}"
        rows.append((i, text, lang, "src0" if i % 3 else f"src{i % 5}"))
    rows += [(300 + i, rows[7][1], "en", "src0") for i in range(80)]  # a hot group of copies
    rows += [(500, None, "en", "src1"), (501, "", None, "src1"), (502, "1 2 3 !!", "en", None), (503, rows[20][1].upper(), "de", None), (None, rows[9][1], "de", "src2"), (504, items[1][1], "en", "src3")]
    folder = tmp_path_factory.mktemp("tables")
    docs = [(a, b, c, d, len(b or "")) for a, b, c, d in rows]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, items


def test_stages(spark, tables):
    folder, docs, items = tables
    now = spark.read.parquet(f"{folder}/documents.parquet")
    names, got = [], []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, folder)
        out.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        names.append(now.columns)
        got.append([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in now.collect()])
    assert all(c == ["doc_id", "text", "lang", "source", "n_chars"] for c in names[:-1])
    # language: only what has no letters goes, here
    want = [d for d in docs if d[1] and any(c.isalpha() for c in d[1])]
    assert Counter(got[0]) == Counter(want)
    # near-duplicates: the smallest id of each component
    classes = plain_components([d[0] for d in want], [plain_fingerprint(d[1]) for d in want])
    want = [d for d, c in zip(want, classes) if d[0] == c]
    assert Counter(got[1]) == Counter(want)
    tests = [s for s in (plain_shingles(x) for _, x in items) if s]
    want = [d for d in want if not any(len(s & plain_shingles(d[1])) >= 0.8 * len(s) - 1e-9 for s in tests)]
    assert Counter(got[2]) == Counter(want) and len(want) < len(got[1])
    n = Counter(d[3] for d in want)
    weight = {s: corpus_pipeline.MIX_WEIGHTS.get(s, 1.0) for s in n}
    rate = {s: weight[s] / sum(weight.values()) * len(want) / n[s] for s in n}
    want = [d for d in want for _ in range(poisson_copies(d[0], d[1], 1, rate[d[3]], corpus_pipeline.MIX_SEED))]
    assert Counter(got[3]) == Counter(want)
    assert Counter(got[4]) == Counter(want)
    counts = Counter(r.shard for r in now.collect())
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    assert Counter((r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, folder).collect()) == Counter((r.doc_id, r.shard, r.slot) for r in now.collect())


def test_empty_table(spark, tables, tmp_path):
    folder, _, _ = tables
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_language_stage_rejects_junk_and_unlearned(spark):
    rng = random.Random(4)
    plain = [(i, sentence(rng, lang, rng.randrange(1, 60)), lang) for i, lang in enumerate(list(VOCAB) * 60)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    junk = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(4, 10))) for _ in range(rng.randrange(3, 40))) for _ in range(30)]
    finnish = "yö talo juna ikkuna uni katu vesi kaunis eilen meidän työ hyvää kissa nukkuu pöydällä koska sataa".split()
    other = [" ".join(rng.choice(finnish) for _ in range(rng.randrange(5, 40))) for _ in range(30)]
    rows = plain + [(1000 + i, t, None) for i, t in enumerate(junk + other + ["быстрая лиса", "12 34"])]
    got = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "").collect()
    assert {r.doc_id for r in got} == {i for i, _, _ in plain}


def test_language_stage_keeps_all_where_nothing_is_learned(spark):
    rows = [(1, "Some plain text.", None), (2, "Une nuit", None), (3, "1 2 !", None), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()} == {1, 2}


def test_language_stage_keeps_short_texts_of_many_families(spark):
    rng = random.Random(6)
    words = [["".join(rng.choice(f"{a}{b}{c}ei") for _ in range(5)) for _ in range(12)] for a, b, c in zip("bcdfghjklmnp", "qrstvwxzbcdf", "aouaouaouaou")]
    rows = [(i, " ".join(rng.choice(words[i % 12]) for _ in range(rng.randrange(2, 9))), f"x{i % 12}") for i in range(480)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert corpus_pipeline.identify_language(spark, docs, "").count() == 480
