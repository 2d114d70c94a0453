"""Searches of vectors and URL rules against brute force."""

import random

import numpy as np
import pytest

from cardloom.llm import blocks, queries, topk, urlfilter, vptree
from cardloom.llm.common import Scratch


def vectors(spark, X, ids, bad=True):
    rows = [(int(i), [float(v) for v in x], 0) for i, x in zip(ids, X)]
    if bad:
        rows += [(900_000, None, 0), (900_020, [], 0), (900_040, [float("nan")] * X.shape[1], 0), (900_060, [float("inf")] * X.shape[1], 0), (None, [1.0] * X.shape[1], 0), (900_100, [0.0] * X.shape[1], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)


def brute(X, ids, every, k, zero_counts=True):
    out = {}
    for q, qi in zip(X, ids):
        if qi % every == 0 and (zero_counts or np.any(q)):
            own = sorted((-float(q @ x), int(i)) for x, i in zip(X, ids) if i != qi and (zero_counts or np.any(x)))[:k]
            out[int(qi)] = [i for _, i in own]
    return out


def by_query(rows):
    out = {}
    for x in sorted(rows, key=lambda x: (x["query_id"], x["rank"])):
        out.setdefault(x["query_id"], []).append(x["vec_id"])
    return out


def sample(n=700, dim=12, seed=0):
    r = np.random.default_rng(seed)
    X = r.normal(size=(n, dim)).astype(np.float32)
    X[n // 2 : n // 2 + n // 3] = X[0]  # a third is one vector
    X[5] = 0
    return X, np.arange(n) * 2


def test_exact_top_k_is_exact(spark):
    X, ids = sample()
    whole = np.floor(256 * X.astype(float))
    got = blocks.search_shards(blocks.sound_vectors(vectors(spark, X, ids), "vec_id", "embedding", True), 50, 5, topk.branch_and_bound(5, 4), "long", shard_rows=150, query_rows=8).collect()
    own = {q: v for q, v in by_query(got).items() if q < 900_000}
    zero = {int(i): [j for _, j in sorted((0, int(j)) for j in ids if j != i)[:5]] for i in ids if i % 50 == 0 and not whole[i // 2].any()}
    want = brute(whole, ids, 50, 5)
    # the zero vector 900100 is a candidate of every query, and a query itself
    for q, found in own.items():
        scores = sorted([(-float(whole[q // 2] @ x), int(i)) for x, i in zip(whole, ids) if i != q] + [(0.0, 900_100)])[:5]
        assert found == [i for _, i in scores]
    assert set(own) == set(want) and all(zero[q] == want[q] for q in zero)


def test_top_k_of_huge_components(spark):
    X = np.array([[1e30, 1.0], [-1e30, 2.0], [3.0, 4.0], [1e12, 1e12]])
    got = topk.exact_top_k(vectors(spark, X, [0, 50, 100, 3], bad=False), k=2).collect()
    assert by_query(got)[0] == [3, 100] and by_query(got)[100] == [0, 3]
    assert next(x for x in got if x["query_id"] == 0)["score"] == 2**63 - 1


def test_tree_at_factor_one_is_exact(spark):
    X, ids = sample(seed=3)
    X *= np.random.default_rng(1).uniform(0.2, 3, (len(X), 1)).astype(np.float32)  # inner product is not cosine
    X[300:500] = X[0]
    got = blocks.search_shards(blocks.sound_vectors(vectors(spark, X, ids), "vec_id", "embedding", False), 20, 20, vptree.vantage_point_index(20, 1.0, 16), "double", shard_rows=200, query_rows=30).collect()
    assert by_query(got) == brute(X.astype(float), ids, 20, 20, zero_counts=False)


def lengths_and_shapes():
    r = np.random.default_rng(0)
    n = 4000
    unit = lambda X: X / np.linalg.norm(X, axis=1)[:, None]
    U = unit(r.normal(size=(n, 64)))
    one = lambda by: np.where(np.arange(n)[:, None] == 7, by, 1.0)
    clusters = r.normal(size=(40, 64))[r.integers(0, 40, n)] + 0.3 * r.normal(size=(n, 64))
    many = unit(clusters)
    many[1000:2500] = many[0]
    return {
        "equal": U, "0.8 to 1.2": U * r.uniform(0.8, 1.2, (n, 1)), "0.5 to 2": U * r.uniform(0.5, 2, (n, 1)), "log-normal": U * np.exp(0.3 * r.normal(size=(n, 1))),
        "one ten times as long": U * one(10.0), "one of 1e9": U * one(1e9), "clusters": clusters, "clusters, one vector many times": many, "clusters, log-normal": clusters * np.exp(0.5 * r.normal(size=(n, 1))),
        "two dimensions": r.normal(size=(n, 2)), "eight dimensions": r.normal(size=(n, 8)), "five in 64": r.normal(size=(n, 5)) @ r.normal(size=(5, 64)),
    }


SHAPES = lengths_and_shapes()


@pytest.mark.parametrize("factor", [vptree.FACTOR, 1.0])
@pytest.mark.parametrize("name", SHAPES)
def test_recall_whatever_the_lengths(name, factor):
    X = SHAPES[name]
    ids = np.arange(len(X))
    asks = ids % 40 == 0
    found = vptree.vantage_point_index(20, factor)(ids, X)(ids[asks], X[asks])
    got = {}
    for q, v in zip(*found[:2]):
        got.setdefault(int(q), []).append(int(v))
    want = brute(X, ids, 40, 20)
    scores = X[asks] @ X.T
    hits = sum(len(set(got[q]) & set(v)) for q, v in want.items()) / sum(map(len, want.values()))
    assert hits >= 0.9
    if factor == 1:  # the same scores; equal ones may differ in the last bit of another order of summing
        for s, (q, v) in zip(scores, want.items()):
            assert np.allclose(s[got[q]], s[v], rtol=1e-9)


def test_ties_of_unlike_vectors_go_to_smaller_ids():
    X = np.repeat(np.eye(2), 400, 0)
    X = np.c_[X, np.random.default_rng(0).permutation(800)]  # the third component meets a zero
    ids = np.arange(800)
    found = vptree.vantage_point_index(20, 1.0, 16)(ids, X)(np.array([5000]), np.array([[1.0, 0, 0]]))
    assert found[1].tolist() == list(range(20))


def test_shards_get_queries_in_blocks(spark):
    X, ids = sample(500, 8, 4)
    for rows in (64, 10_000):
        got = blocks.search_shards(blocks.sound_vectors(vectors(spark, X, ids, bad=False), "vec_id", "embedding", True), 20, 5, topk.branch_and_bound(5, 4), "long", shard_rows=rows, query_rows=7).collect()
        assert by_query(got) == brute(np.floor(256 * X.astype(float)), ids, 20, 5)


def test_unlike_dimensions_and_clashing_names(spark):
    from pyspark.sql import functions as F

    both = vectors(spark, np.eye(3), [0, 20, 21], bad=False).union(vectors(spark, np.eye(2), [40, 41], bad=False))
    both = both.withColumns({"rank": F.lit("x"), "query_id": F.lit(1), "dim": F.lit(9)})
    assert by_query(vptree.nearest_neighbours(both).collect()) == {0: [20, 21], 20: [0, 21], 40: [41]}
    assert by_query(topk.exact_top_k(both, every=20).collect()) == {0: [20, 21], 20: [0, 21], 40: [41]}


def test_long_vectors_among_short_ones_are_exact():
    r = np.random.default_rng(5)
    X = r.normal(size=(300, 6))
    X[::7] *= 1e15
    X[3], X[6], X[9] = 1e200, -1e200, 1e306
    ids = np.arange(300)
    asks = np.array([0, 3, 7, 9, 10, 20])
    found = topk.branch_and_bound(5, 2)(ids, X)(asks, X[asks])
    whole = [[topk._whole(v) for v in x] for x in X.tolist()]
    for q in asks.tolist():
        want = sorted(((-min(max(sum(a * b for a, b in zip(whole[q], whole[i])), topk.LOW), topk.HIGH), i) for i in range(300) if i != q))[:5]
        own = found[0] == q
        assert [(-int(s), int(v)) for s, v in zip(found[2][own], found[1][own])] == want


def test_searches_of_small_and_empty_tables(spark):
    X = np.eye(3, dtype=np.float32)
    rows = vectors(spark, X, [0, 20, 21], bad=False)
    assert by_query(vptree.nearest_neighbours(rows).collect()) == {0: [20, 21], 20: [0, 21]}
    twice = rows.union(rows)
    assert by_query(topk.exact_top_k(twice).collect()) == {0: [20, 21]}
    assert vptree.nearest_neighbours(rows.where("false")).count() == 0 and topk.exact_top_k(rows.where("false")).count() == 0
    assert vptree.nearest_neighbours(rows.where("vec_id = 0")).count() == 0


# ---------------------------------------------------------------- urls

RULES = queries.URL_RULES
LISTED = queries.LISTED_HOSTS


def brute_url(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[2], max(fits)[3]
    return host, path, None, "block" if any(host == h or host.endswith("." + h) for h in LISTED) else "allow"


def urls():
    r = random.Random(1)
    out = [None, "", "no scheme", "http://", "http://com", "HTTP://WWW.Example.COM/en/x?q#f", "x://a.com?://b", "http://é.COM/", "ftp://net/es/", "http://a..com/", "http://.com/", "http://com./x", "http://spam-farm.example.org", "http://a.b.spam-farm.example.net:8080/x"]
    for _ in range(400):
        host = ".".join(r.choice(["www", "a", "example", "spam-farm", "Net", "com"]) for _ in range(r.randint(0, 3))) + r.choice([".com", ".net", ".org", ".example.com", ""])
        out.append(f"http://{host}{r.choice(['', '/', '/en/', '/es/', '/fr/x', '/e', '?en/', '#/en/'])}{r.choice(['', 'page', '?a=1', '#b'])}")
    return out


@pytest.mark.parametrize("bits", [urlfilter.MAX_BITS, 1])
def test_urls_against_brute_force(spark, bits):
    """Once by the cascades, once past their size, by joins."""
    own = urls()
    rows = [(i, u, "x") for i, u in enumerate(own)] + [(3, own[7], "x")]
    pages = spark.createDataFrame([(*x, "x", "x") for x in rows], "page_id long, url string, host string, rule string, _k0 string")
    got = urlfilter.judge_urls(pages, *urlfilter.rule_tables(spark, RULES, LISTED), max_bits=bits).collect()
    assert sorted((x["page_id"], x["host"], x["path"], str(x["rule"]), x["verdict"]) for x in got) == sorted((i, h, p, str(rule), v) for i, u, _ in rows for h, p, rule, v in [brute_url(u)])
    assert urlfilter.judge_urls(pages.where("false"), *urlfilter.rule_tables(spark, RULES, LISTED)).count() == 0


def test_a_cascade_is_exact_for_its_universe(spark):
    from pyspark.sql import functions as F

    s = Scratch(spark, "t")
    for every in (2, 3, 100, 5000):  # half listed, few listed, one
        keys = s.put(spark.createDataFrame([(f"key{i}", i % every == 0) for i in range(3000)], "key string, listed boolean"), "keys")
        cascade = urlfilter.Cascade(keys, s)
        assert len(cascade.levels) > 1 or every == 5000
        assert keys.where(cascade.has(F.col("key")) != F.col("listed")).count() == 0


def test_filters_are_sized_by_the_ratio():
    assert urlfilter.filter_size(1000, 300_000, True) == (12992, 9)  # 13 bits a key
    assert urlfilter.filter_size(1000, 1000, False) == (1472, 1)
    assert urlfilter.filter_size(0, 0, True) == (64, 1)


def test_a_table_of_many_rules(spark):
    r = random.Random(4)
    rules = sorted({(r.choice(["com", "a.com", "b.a.com", "org", "x.org"]), "/" + "".join(r.choice("ab/") for _ in range(r.randint(0, 6)))) for _ in range(150)})
    rules = [(h, p, r.choice(["allow", "block"])) for h, p in rules]
    own = [f"http://{r.choice(['', 'b.', 'c.'])}{r.choice(['a.com', 'x.org', 'org', 'com'])}/{''.join(r.choice('ab/') for _ in range(r.randint(0, 8)))}" for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(own)), "page_id long, url string")
    got = {x["page_id"]: (x["rule"], x["verdict"]) for x in urlfilter.judge_urls(pages, *urlfilter.rule_tables(spark, rules, ["c.x.org"])).collect()}

    def want(url):
        host, _, path = url.removeprefix("http://").partition("/")
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and f"/{path}".startswith(p)]
        return max(fits)[2:] if fits else (None, "block" if host == "c.x.org" or host.endswith(".c.x.org") else "allow")

    assert got == {i: want(u) for i, u in enumerate(own)}
