"""Components, embedding links, url decisions and the pipeline."""

import random

import numpy as np

import corpus_pipeline
from vintage.llm import nn_descent, queries, url_filter
from vintage.llm.components import components


def roots(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return {x: root(x) for x in list(parent)}


def test_components(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, i) for i in range(1001, 1100)]
    cloud = [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    pairs = [(a, b) for a, b in chain + star + cloud if a != b]
    got = components(spark.createDataFrame([*pairs, (7, 7), (None, 1)], "a long, b long")).collect()
    assert {r.node: r.component for r in got} == roots(pairs)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embedding_links(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(150):  # families of one to eight near copies
        centre = rng.normal(size=24)
        for _ in range(int(rng.integers(1, 9))):
            v = centre + rng.normal(size=24) * 0.06
            rows.append((len(rows), [float(np.float32(x)) for x in v], k % 3))
    n = len(rows)
    rows += [(n + i, rows[0][1], rows[0][2]) for i in range(5)]  # equal vectors
    rows += [(n + 5, rows[0][1], 99), (n + 6, rows[0][1], None), (n + 7, None, 0), (n + 8, [0.0] * 24, 0), (n + 9, [1.0, None], 0), (n + 10, [float("nan")] * 24, 0), (n + 11, [], 0), (n + 12, rows[0][1][:5], 0)]
    got = {r.vec_id: r for r in nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a, b) for k, (a, u, p) in enumerate(good) for b, v, q in good[:k] if p == q and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98]
    assert len(links) > 150
    of, degree = roots(links), {i: 0 for i in got}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    found = sum(r.n_links for r in got.values())
    assert all(r.n_links <= degree[i] for i, r in got.items()) and found >= 0.98 * 2 * len(links)
    assert sum(r.component_id == of.get(i, i) for i, r in got.items()) >= 0.98 * len(got)
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert nn_descent.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_url_rules_and_aliases(spark):
    link = '<link rel="canonical" href="%s">'
    rows = [
        (1, "https://A.Example.net/en/x", ""),
        (2, "http://shop.net/p", None),
        (3, "https://mirror.example.com/fr/1", link % "http://shop.net/p"),  # alias of a blocked page
        (4, "https://b.example.com/fr/2", '<meta http-equiv="refresh" content="0; url=https://c.example.com/fr/3">'),
        (5, "https://c.example.com/fr/3", link % "https://x.org/fr/home"),  # reaches an allowed page
        (6, "https://c.example.com/de/3", ""),
        (7, "no scheme", ""),
        (8, None, "<p>"),
        (9, "https://mirror.example.com/fr/1/?utm_source=a#top", ""),
        (10, "http://x?/y://z", ""),
        (11, "https://notnet/", ""),
        (12, "https://www.net/", ""),
        (12, "https://www.net/", ""),
    ]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert len(got) == len(rows)
    assert by[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert by[2] == ("shop.net", "/p", "net/", "block")
    assert by[3][2:] == (None, "block") and by[9][2:] == (None, "block")
    assert by[4][2:] == (None, "allow") and by[5][2:] == (None, "allow")
    assert by[6][2:] == ("example.com/de/", "block")
    assert by[7] == ("", "", None, "allow") and by[8] == ("", "", None, "allow")
    assert by[10][:2] == ("x", "") and by[11][2] is None and by[12][2] == "net/"
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = queries.table(spark, folder, "documents")
    counts, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0 and counts[4] == counts[5]
    assert corpus_pipeline.run(spark, folder).count() == counts[-1]
