"""Centroid clustering against plain integers, by one vector at a time."""

import hashlib

import numpy as np
import pytest

from vintage.llm import centroids


def brute(rows, k=16, turns=3, dims=64, scale=64):
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    digest = lambda i: "~" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    of = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(turns):
        mine = [of(v)[1] for _, v in kept]
        for j in range(len(c)):
            group = [v for (_, v), m in zip(kept, mine, strict=True) if m == j]
            if group:
                c[j] = [sum(col) // len(group) for col in zip(*group, strict=True)]
    last = [of(v) for _, v in kept]
    own = [sum(d for d, m in last if m == j) for j in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted([(i, j, d, own[j], sum(own), sha[j]) for (i, _), (d, j) in zip(kept, last, strict=True)], key=repr)


def frame(spark, rows, dims_type="float"):
    # columns named as the operator names its own
    return spark.createDataFrame([(i, v, 1, "b", 2) for i, v in rows], f"vec_id long, embedding array<{dims_type}>, block int, data string, n int").repartition(6)


def vectors(rng, n, dims=64):
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=dims) * 0.2 + 0.3 * rng.normal() * (k % 5)]) for k in range(n)]
    rows += [(3, rows[4][1]), (5, rows[5][1]), (None, rows[6][1]), (n, None), (n + 1, []), (n + 2, rows[0][1][:-1]), (n + 3, [*rows[0][1][:-1], None]), (n + 4, [*rows[0][1][:-1], float("nan")]), (n + 5, [*rows[0][1][:-1], float("-inf")])]
    return rows


def test_equal_to_plain_integers(spark, monkeypatch):
    monkeypatch.setattr(centroids, "ROWS", 37)  # many blocks
    rows = vectors(np.random.default_rng(41), 400)
    rows += [(1000 + k, rows[9][1]) for k in range(300)]  # a third are copies
    got = centroids.clustered(frame(spark, rows))[0].collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows)


def test_ties_empty_clusters_and_few_vectors(spark):
    same = [(k, [0.5] * 64) for k in range(40)]  # all centroids equal: every vector goes to number 0
    got = centroids.clustered(frame(spark, same))[0].collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(same) and {r.cluster for r in got} == {0}
    few = vectors(np.random.default_rng(42), 7)
    assert sorted([tuple(r) for r in centroids.clustered(frame(spark, few))[0].collect()], key=repr) == brute(few)
    assert centroids.clustered(frame(spark, []))[0].count() == 0 and centroids.clustered(frame(spark, [(1, None)]))[0].count() == 0


def test_other_shapes_and_large_components(spark):
    rng = np.random.default_rng(43)
    rows = [(k, (rng.normal(size=21) * 10.0 ** int(rng.integers(0, 7))).tolist()) for k in range(200)]
    got, means = centroids.clustered(frame(spark, rows, "double"), k=5, turns=2, dims=21, scale=10)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(rows, 5, 2, 21, 10) and means.shape == (5, 21)
    with pytest.raises(Exception, match="64 bits"):
        centroids.clustered(frame(spark, [(1, [1e30] * 64)], "double"))[0].collect()


def test_vectors_stay_where_they_are(spark):
    rows = vectors(np.random.default_rng(44), 200)
    table = centroids.shards(centroids.kept_vectors(frame(spark, rows)), 64, 64)
    seeds = centroids.first_centroids(centroids.kept_vectors(frame(spark, rows)), 16, 64)
    assigned = centroids.nearest(centroids.partial_distances(table, seeds), 16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = table.select("block", "shard", "data").join(assigned, "block")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1, plan
