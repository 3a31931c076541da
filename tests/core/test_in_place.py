"""Recursive columns, readouts and incremental runs leave wide rows where their windows have them."""

import datetime as dt
import random

from pyspark.sql import functions as F

from vintage.functions.exprs import half_up
from vintage.operators import flow, indicators, readouts

AS_OF = "2030-01-01"
SCHEMA = "security_id string, effective_date date, available_at timestamp, open double, high double, low double, close double, volume long"


def bars(spark, **lengths):
    rng, rows = random.Random(5), []
    for security, n in lengths.items():
        close = 100.0
        for k in range(n):
            close *= 1 + rng.gauss(0, 0.02)
            rows.append((security, dt.date(2020, 1, 1) + dt.timedelta(k), dt.datetime(2029, 1, 1), close * 1.001, close * 1.01, close * 0.99, close, rng.randint(1, 9) * 1000))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_indicators_take_one_shuffle_and_no_join(spark):
    got = plan(indicators.compute_all(bars(spark, a=3), AS_OF))
    assert got.count("Exchange hashpartitioning") == 1 and "Join" not in got and "FlatMapGroupsInPandas" not in got


def test_coverage_shuffles_bars_and_counts_only(spark):
    got = plan(indicators.coverage(indicators.compute_all(bars(spark, a=3), AS_OF)))
    assert got.count("Exchange hashpartitioning") == 2 and "Join" not in got


def test_a_security_goes_on_in_the_next_batch(spark):
    b, shown = bars(spark, a=37, b=1, c=9, d=23, e=12), lambda: indicators.compute_all(b, AS_OF).orderBy("security_id", "effective_date").select(*indicators.RECURSIVE).collect()
    want = shown()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = shown()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 82 and got == want


def test_readouts_leave_the_history_in_place(spark):
    """Rows are shuffled and sorted once a branch, and what is joined is a row a security."""
    b = bars(spark, a=3)
    got = plan(readouts.compute(b, AS_OF, {}))
    assert "Exchange hashpartitioning(security_id" in got and not [x for x in got.split("\n") if "Exchange" in x and "effective_date" in x]
    assert len([x for x in got.split("\n") if "Sort [" in x and "effective_date" in x]) == 2


def test_runs_store_no_wide_row_and_give_each_row_once(spark, tmp_path):
    b, stored = bars(spark, a=40, b=25, c=12), []

    def settle(df, name):
        stored.append(df.columns)
        df.write.parquet(f"{tmp_path}/{name}-{len(stored)}")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}-{len(stored)}")

    day, state, found = F.datediff("effective_date", F.lit(dt.date(2020, 1, 1))), None, []
    for lo, hi in ((0, 12), (12, 25), (25, 40)):
        facts, state = flow.appended(b.filter((day >= lo) & (day < hi)), AS_OF, state, None, settle, b.filter(day >= hi))
        found += [(r.security_id, r.effective_date, r.gap_fill) for r in facts.select("security_id", "effective_date", "gap_fill").collect()]
    assert all("sma_20" not in names for names in stored)
    want = [(r.security_id, r.effective_date, r.gap_fill) for r in indicators.compute_all(b, AS_OF).select("security_id", "effective_date", "gap_fill").collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_half_up_rounds_as_round_does(spark):
    values = [0.0, 0.5, 1.5, 2.5, -0.5, -2.5, -0.3, 0.12345, -0.12345, 0.00004, 123456789.98765, 3e17, -3e17, float("inf"), None]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    for places in (0, 4):
        got = rows.select(half_up("x", places).alias("a"), F.round("x", places).alias("b")).collect()
        assert [str(r.a) for r in got] == [str(r.b) for r in got]
