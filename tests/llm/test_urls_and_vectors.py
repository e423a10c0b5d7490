"""Address verdicts, clustering and whitening: edge cases, and brute force."""

import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from hypnoflow.llm import clustering, queries, urlfilter, vectors, whitening

INF, NAN = float("inf"), float("nan")


def plain_verdict(url, rules, strict, soft):
    """By splitting the address at its marks, and its words at what is no letter or digit."""
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = re.split("[?#]", url.split("://", 1)[1])[0]
    host, slash, path = rest.partition("/")
    host, path = "".join(c.lower() if c.isascii() else c for c in host), slash + path
    fits = [(len(r), r, v) for v, r in rules if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    words = set("".join(c if c.isalnum() else " " for c in (host + path).lower()).split())
    blocked = words & set(strict) or len(words & set(soft)) >= 2
    rule = max(fits)[1:] if fits else None
    return host, path, rule and rule[0], rule[1] if rule else "block" if blocked else "allow"


def test_verdicts_against_a_plain_version(spark):
    rng = random.Random(11)
    words = [*urlfilter.STRICT, *urlfilter.SOFT, "news", "freedom", "winter", "badminton", "sexton", "trackers", "écam", "camé", "hot9", "x"]
    urls = []
    for _ in range(600):
        host = rng.choice(["", "www.", "WWW.", "m."]) + rng.choice("-.").join(rng.choices(words, k=rng.randrange(1, 4))) + rng.choice([".example.com", ".Example.net", ".org", ".xnet", ".net", ":80", ""])
        path = "".join(rng.choice("/-_.+") + rng.choice(words) for _ in range(rng.randrange(4)))
        urls.append(f"{rng.choice(['http', 'https', ''])}://{host}{rng.choice(['', '/en', '/en/', '/es/', '/fr/', '/fr'])}{path}{rng.choice(['', '?q=casino', '#xxx', '?a://porn/b'])}")
    urls += [None, "", "casino", "casino://", "://", ":///", "http://", "http://?casino", "http://com/", "http://com", "http://xcom/a", "a://b://porn/c", "http://porn\nx.org/", "http://" + "a." * 3000 + "com/x", "http://net/es/", "http://net/es", "http://net/ES/", "http://www.example.com/en/casino", "http://a.www.example.com/en/x", "http://www.example.com/de/"]
    got = urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").repartition(3), queries.URL_RULES).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(r.url, queries.URL_RULES, urlfilter.STRICT, urlfilter.SOFT), r.url
    assert {r.verdict for r in got} == {"allow", "block"} and {r.rule for r in got} >= {"com/", "net/es/", "net/fr/", "example.com/en/", "www.example.com/en/"}


def test_terms_boundaries_and_weights(spark):
    def of(url, **how):
        r = urlfilter.judge(spark.createDataFrame([(url,)], "url string"), **how).first()
        return r.verdict, r.strict_terms, r.soft_terms

    assert of("http://a.org/casino-royale") == ("block", ["casino"], [])
    assert of("http://casinos2.org/acasino/casinoa") == ("allow", [], [])
    assert of("http://a.org/free/free-free") == ("allow", [], ["free"])  # one soft term, however often
    assert of("http://a.org/free_BETS") == ("block", [], ["bets", "free"])
    assert of("http://a.org/%63asino") == ("block", ["casino"], [])
    assert of("http://a.org/?casino") == ("allow", [], [])
    assert of("http://a.org/one-two/red", strict=["one-two"], soft=["two", "red"]) == ("block", ["one-two"], ["red", "two"])
    assert of("http://a.org/casino", strict=[], soft=[]) == ("allow", [], [])
    assert of("http://a.org/dup", strict=["dup"], soft=["dup"]) == ("block", ["dup"], [])
    with pytest.raises(ValueError):
        urlfilter.judge(spark.createDataFrame([("x",)], "url string"), [("maybe", "a/")])


def test_verdicts_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "http://a.net/fr/x", "h", "v", 2.0)], "page_id int, url string, HOST string, Verdict string, other double")
    got = urlfilter.judge(df, queries.URL_RULES)
    assert got.columns == ["page_id", "url", "other", "host", "path", "rule", "verdict", "strict_terms", "soft_terms"]
    assert tuple(got.first())[:7] == (1, "http://a.net/fr/x", 2.0, "a.net", "/fr/x", "net/fr/", "block")
    assert urlfilter.judge(df.limit(0)).count() == 0
    rules = urlfilter.Rules([("block", "ab.com/"), ("allow", "com/en/"), ("block", "example.org/")])
    assert rules.find("ab.com", "/en/") == ("ab.com/", "block") and rules.find("x.com", "/en/") == ("com/en/", "allow") and rules.find("myexample.org", "/") is None


def plain_clusters(rows, k, rounds, scale=64, seed=1):
    """vec_id, cluster, distance by whole numbers of Python, row by row."""
    q = [(i, [math.floor(scale * Fraction(float(c))) for c in v]) for i, v in rows]
    order = sorted(q, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        mine = [[] for _ in centroids]
        for _, v in q:
            mine[near(v)[1]].append(v)
        centroids = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(mine, centroids)]
    return [(i, *near(v)[::-1]) for i, v in q], centroids


@pytest.mark.parametrize("heavy", [clustering.HEAVY, 2])
def test_clusters_against_a_plain_version(spark, monkeypatch, heavy):
    monkeypatch.setattr(clustering, "HEAVY", heavy)  # 2: no vector is heavy
    rng = np.random.default_rng(12)
    x = rng.normal(0, 1.5, (400, 8)).astype(np.float32)
    x[100:230] = x[7]  # a third of the rows are one vector
    x[300:310] = -x[7]
    x[310] = 0.0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[6].tolist()), (5, x[5].tolist()), (None, x[3].tolist()), (None, x[3].tolist())]
    bad = [(900, None), (901, []), (902, [1.0] * 7), (903, [1.0] * 9), (904, [NAN] + [0.0] * 7), (905, [INF] + [0.0] * 7), (906, [None] + [0.0] * 7)]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows + bad], "vec_id bigint, embedding array<float>, Cluster string").repartition(5)
    got = clustering.cluster(df, k=6, rounds=3, dim=8)
    assert got.columns == ["vec_id", "embedding", *clustering.ADDED]
    got = got.collect()
    want, centroids = plain_clusters(rows, 6, 3)
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(want, key=key)
    total = sum(d for _, _, d in want)
    for r in got:
        assert r.inertia == total and r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_few_rows_and_large_components(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    of = lambda rows, **how: sorted((r.vec_id, r.cluster, r.distance) for r in clustering.cluster(frame(rows), dim=2, **how).collect())
    assert of([]) == [] and of([(1, None)]) == []
    assert of([(1, [0.5, -0.01])]) == [(1, 0, 0)]
    # equal starts: the later ones stay empty and where they are
    same = of([(i, [1.0, 1.0]) for i in range(40)], k=4)
    assert {(c, d) for _, c, d in same} == {(0, 0)} and len(same) == 40
    # sums of large components do not overflow
    wide = [(i, [2.0**20 * (i % 3 - 1), -(2.0**20)]) for i in range(90)]
    want, _ = plain_clusters(wide, 3, 3)
    assert of(wide, k=3) == sorted(want)
    assert clustering._sums(np.array([[1 << 26, -1]]), np.array([1 << 40])) == [1 << 66, -(1 << 40)]
    with pytest.raises(Exception, match="beyond"):
        of([(1, [1e30, 0.0])])
    with pytest.raises(ValueError):
        clustering.cluster(frame([]), dim=1 << 10)


def test_integers_are_exact_either_way():
    rng = np.random.default_rng(3)
    for top in (40, 1 << 26):  # floats hold the first, not the second
        x, c = rng.integers(-top, top, (50, 16)), rng.integers(-top, top, (5, 16))
        c[3] = c[1]
        best, distance = clustering.assigned(x, c)
        plain = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c)) for v in x]
        assert [(d, b) for d, b in zip(distance.tolist(), best.tolist())] == plain


def plain_whitened(x, components):
    """n, deviations, whitened, explained of whole-number rows, with exact means."""
    n, d = x.shape
    sums = [int(s) for s in x.sum(axis=0)]
    exact = [[n * int(a) - s for a, s in zip(row, sums)] for row in x]
    centred = np.array(exact, dtype=float) / n
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    values, columns = values[::-1], columns[:, ::-1]
    return [sum(a * a for a in row) for row in exact], centred @ columns[:, :components] / np.sqrt(values[:components]), values / values.sum()


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(13)
    x = (rng.standard_normal((700, 12)) @ rng.standard_normal((12, 12)) * 0.4 + 3).astype(np.float32)
    x[200:430] = x[0]  # a third of the rows are one vector
    big = (1 << 60) + 1
    ids = [big + i for i in range(698)] + [None, big]
    bad = [(1, None), (2, []), (3, [1.0] * 11), (4, [NAN] * 12), (5, [INF] + [1.0] * 11), (6, [None] + [1.0] * 11)]
    df = spark.createDataFrame([(i, v.tolist(), "w") for i, v in zip(ids, x)] + [(i, v, "w") for i, v in bad], "vec_id bigint, embedding array<float>, Whitened string").repartition(4)
    got = whitening.whiten(df, components=5).collect()
    q = np.floor(64 * x.astype(float)).astype(np.int64) + 1_000_000
    deviation, white, share = plain_whitened(q, 5)
    assert len(got) == 700 * 5 and {r.component for r in got} == {1, 2, 3, 4, 5} and {r.n for r in got} == {700}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    mine = {}
    for r in got:
        mine.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
        assert abs(r.explained / share[r.component - 1] - 1) < 1e-9
    for c in range(5):
        want = sorted((str(i), d, w) for i, d, w in zip(ids, deviation, white[:, c]))
        have = sorted((str(i), d, w) for (i, d), parts in mine.items() for w in parts[c + 1])
        assert [v[:2] for v in want] == [v[:2] for v in have]
        a, b = np.array([v[2] for v in want]), np.array([v[2] for v in have])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
    again = whitening.whiten(df.repartition(7), components=5).where("vec_id = 1152921504606846980").orderBy("component").collect()
    first = sorted((r for r in got if r.vec_id == 1152921504606846980), key=lambda r: r.component)
    assert np.allclose([r.whitened for r in first], [r.whitened for r in again], atol=1e-9)  # the same signs


def test_whitening_without_variance(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    assert whitening.whiten(frame([])).count() == 0 and whitening.whiten(frame([(1, None)])).schema["vec_id"].dataType.simpleString() == "int"
    one = whitening.whiten(frame([(7, [1.0, 2.0])])).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, 0.0), (2, 0, None, 0.0, 0.0)]
    # two rows span one direction
    two = sorted(whitening.whiten(frame([(1, [0.0, 0.0]), (2, [1.0, 1.0])])).collect(), key=lambda r: (r.vec_id, r.component))
    assert [r.whitened and round(r.whitened, 9) for r in two] == [-1.0, None, 1.0, None] and [round(r.explained, 9) for r in two] == [1.0, 0.0, 1.0, 0.0]
    assert two[0].deviation == 2 * 64**2 and two[0].identity_error < 1e-9


def test_deviations_beyond_a_long():
    x = np.array([[1 << 31, 5], [1 << 32, 0]], dtype=np.int64)
    assert whitening.deviations(x) == [(1 << 62) + 25, None]
    assert whitening.deviations(np.array([[3, 4]])) == [25]


def test_usual_length(spark):
    df = spark.createDataFrame([([1.0],), ([1.0],), ([1.0, 2.0],), ([2.0, 2.0],), ([None, 1.0],), (None,)], "v array<double>")
    assert vectors.usual_length(df, "v") == 1 and vectors.usual_length(df.limit(0), "v") == 0
    assert df.select(F.count_if(vectors.finite_vector("v"))).first()[0] == 4
