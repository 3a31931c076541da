"""Sweeps against brute force: as-of joins with many late bars, ranges and coverage of one busy id."""

import datetime as dt
import random

from vintage.operators import pit, versions

DAY = lambda k: dt.date(2020, 1, 1) + dt.timedelta(k)
TIME = lambda k: dt.datetime(2020, 1, 1) + dt.timedelta(hours=k)


def test_asof_join_when_most_bars_come_late(spark):
    rng = random.Random(101)
    bars = [(rng.choice(["a", "a", "a", "b", "c"]), DAY(rng.randint(0, 60)), TIME(24 * rng.randint(0, 120) + rng.choice([0, 0, 7])), float(i), f"h{i:04d}") for i in range(800)]
    spine = [(rng.choice(["a", "b", "d"]), DAY(rng.randint(0, 70)), TIME(24 * rng.randint(0, 130) + rng.choice([0, 7, 9]))) for _ in range(400)] + [("a", None, TIME(3000)), ("a", DAY(3), None)]
    frame = spark.createDataFrame(bars, "security_id string, effective_date date, available_at timestamp, close double, version_hash string")
    asked = spark.createDataFrame(spine, "security_id string, effective_date date, as_of timestamp")
    want = {}
    for s, d, a in set(spine):
        fits = [b for b in bars if b[0] == s and d and a and b[1] <= d and b[2] <= a]
        want[s, d, a] = max(((b[2], b[1], b[4], b[3]) for b in fits), default=(None,) * 4)[3]
    for lag in (1, 30, 400):
        got = pit.read_asof_join(frame, asked, lag_days=lag).collect()
        assert {(r.security_id, r.effective_date, r.as_of): r.close for r in got} == want and len(got) == len(want)
    plan = pit.read_asof_join(frame, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ranges_and_coverage_of_a_busy_id(spark):
    rng = random.Random(102)
    rows = [(rng.choice(["a", "a", "b", "c", None]), rng.choice(["x", "y"]), DAY(rng.randint(0, 900)) if rng.random() < 0.97 else None, i) for i in range(400)]
    asks = [(rng.choice(["a"] * 20 + ["b", None]), "x", DAY(k), DAY(k + rng.randint(-1, 3))) for k in (rng.randint(0, 900) for _ in range(300))]
    table = spark.createDataFrame(rows, "security_id string, source_id string, effective_date date, n int")
    requests = spark.createDataFrame(asks, "security_id string, source_id string, start date, end date")
    inside = lambda i, d: any(s == i and lo <= d <= hi for s, _, lo, hi in asks)
    assert sorted(r.n for r in pit.in_ranges(table, requests).collect()) == sorted(n for i, _, d, n in rows if i and d and inside(i, d))
    open_ = spark.createDataFrame([("b", None, DAY(300)), ("c", DAY(500), None), ("c", None, None)], "security_id string, start date, end date")
    assert sorted(r.n for r in pit.in_ranges(table, open_).collect()) == sorted(n for i, _, d, n in rows if d and (i == "b" and d <= DAY(300) or i == "c"))
    got = sorted((repr((r.security_id, r.source_id, r.start, r.end)), r.covered) for r in versions.covered(requests, table).collect())
    assert got == sorted((repr(q), any(i == q[0] and s == q[1] and d and q[2] <= d <= q[3] for i, s, d, _ in rows if i)) for q in asks)
    assert pit.in_ranges(table, requests.filter("1 = 0")).count() == 0 and versions.covered(requests, table.filter("1 = 0")).filter("covered").count() == 0
