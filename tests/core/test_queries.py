"""Registered queries against their DuckDB SQL on the smallest tables, and reads by long lists of ids."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__
from vintage.operators import pit

FOLDER = "/root/testdata/sf0.001"
#: One of each kind; the driver compares all of them.
NAMES = ("facts_fundamentals", "facts_top_movers", "facts_wide_fundamentals", "facts_social_posts", "asof_join", "market_breadth", "bars_adjusted", "bars_asof_range", "version_hashes", "replayed_hash", "fetch_manifests", "archived_payloads", "streamed_daily_bars", "streamed_bar_versions", "deduplicated_stream", "latest_lists", "bulk_text_bars", "dataset_versions", "peer_states", "fundamental_states", "valuation_category", "open_days")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value.replace(tzinfo=None) if getattr(value, "tzinfo", None) else value


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    got, want = __spark_entry__.queries()[name](spark, FOLDER).toArrow(), duck.sql(__spark_entry__.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names) and want.num_rows > 0
    rows = [sorted(zip(*[map(plain, t[c].to_pylist()) for c in sorted(t.column_names)], strict=True), key=repr) for t in (got, want)]
    assert rows[0] == rows[1]


def test_every_query_of_the_engine_has_sql():
    assert not [n for n in __spark_entry__.queries() if n not in __spark_entry__.oracle_sql() and not re.match(r"op\d|pipeline$", n)]


def test_long_lists_of_ids(spark):
    rows = spark.createDataFrame([(f"s{i}", i) for i in range(500)], "security_id string, n int")
    ids = [f"s{i}" for i in range(0, 500, 2)]
    for some in (ids, ids[:100], spark.createDataFrame([(i,) for i in ids], "x string")):
        want = {i for i in ids[:100]} if some is not ids and isinstance(some, list) else set(ids)
        assert {r.security_id for r in pit.among(rows, "security_id", some).collect()} == want
    assert pit.among(rows, "security_id", None).count() == 500 and pit.among(rows, "security_id", []).count() == 0


def test_asof_join_carries_only_what_is_asked(spark):
    plan = __spark_entry__.queries()["asof_join"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "close" in plan and "volume" not in plan and plan.count("named_struct(bar_date") == 0  # bar_date is part of the rank


def test_orders_are_dealt_before_they_become_long_bodies(spark):
    plan = __spark_entry__.queries()["facts_wide_fundamentals"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    dealt, bodies = (max(i for i, line in enumerate(plan) if word in line) for word in ("Repartition", "fiscalDateEnding"))
    assert dealt > bodies  # below them
