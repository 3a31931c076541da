"""Operators on hand-made facts: visibility, precedence, adjustment, identity, events, metrics, states."""

import datetime as dt
import hashlib
import json

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vintage.operators import adjust, calendar, derived, fundamentals, identity, indicators, pit, quality, readouts, versions
from vintage.plans.schemas import DATASETS

BAR = "security_id string, effective_date date, available_at timestamp, source_id string, open double, high double, low double, close double, volume long"


def day(s):
    return dt.date.fromisoformat(s)


def at(s):
    return dt.datetime.fromisoformat(s)


def bar(sec, d, known, source, close, volume=100):
    return (sec, day(d), at(known), source, close, close + 1, close - 1, close, volume)


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame([
        bar("a", "2026-01-05", "2026-01-05 16:00", "eodhd", 203.5), bar("a", "2026-01-05", "2026-01-06 08:00", "eodhd", 204.0),
        bar("b", "2026-01-05", "2026-01-05 16:00", "tiingo", 100.0), bar("b", "2026-01-05", "2026-01-06 16:00", "eodhd", 999.0),
        bar("b", "2026-01-07", "2026-01-07 16:00", "eodhd", 101.0),
    ], BAR)


@pytest.fixture(scope="module")
def priorities(spark):
    return pit.source_priorities(spark, {"bars_daily": ["tiingo", "yahoo", "eodhd"]})


def closes(df):
    return {(r.security_id, str(r.effective_date)): r.close for r in df.collect()}


def test_restatement_is_a_new_version(bars, priorities):
    assert closes(pit.bars_asof(bars, "2026-01-05 16:00", priorities))["a", "2026-01-05"] == 203.5  # inclusive
    assert closes(pit.bars_asof(bars, "2026-01-06 09:00", priorities))["a", "2026-01-05"] == 204.0
    assert closes(pit.bars_asof(bars, "2026-01-05 15:59", priorities)) == {}


def test_priority_beats_freshness(bars, priorities):
    assert closes(pit.bars_asof(bars, "2026-02-01", priorities))["b", "2026-01-05"] == 100.0
    assert closes(pit.bars_asof(bars, "2026-02-01"))["b", "2026-01-05"] == 999.0


def test_as_of_is_required_and_ranges_are_inclusive(bars):
    with pytest.raises(ValueError):
        pit.bars_asof(bars, None)
    got = closes(pit.bars_asof(bars, "2026-02-01", ids=["b"], start="2026-01-07", end="2026-01-07"))
    assert got == {("b", "2026-01-07"): 101.0}


def test_panel_and_asof_join(spark, bars, priorities):
    spine = spark.createDataFrame([("a", day("2026-01-06"), at("2026-01-05 18:00")), ("a", day("2026-01-04"), at("2026-02-01 00:00")), ("b", day("2026-01-08"), at("2026-01-06 00:00"))], "security_id string, effective_date date, as_of timestamp")
    assert closes(pit.read_panel(bars, spine, "2026-02-01", priorities)) == {("a", "2026-01-06"): 204.0, ("b", "2026-01-08"): 101.0}
    assert closes(pit.read_asof_join(bars, spine, priorities)) == {("a", "2026-01-06"): 203.5, ("a", "2026-01-04"): None, ("b", "2026-01-08"): 100.0}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("xyz"), st.integers(0, 9), st.integers(0, 9), st.integers(1, 99)), min_size=1, max_size=40), st.integers(0, 12))
def test_nothing_from_the_future(spark, rows, now):
    base = dt.datetime(2026, 1, 1)
    facts = [(s, (base + dt.timedelta(days=e)).date(), base + dt.timedelta(days=e + k), "s", float(c)) for s, e, k, c in rows]
    df = spark.createDataFrame(facts, "security_id string, effective_date date, available_at timestamp, source_id string, close double")
    as_of = base + dt.timedelta(days=now)
    got = {(r.security_id, r.effective_date): r.available_at for r in pit.bars_asof(df, as_of.isoformat(" ")).collect()}
    want = {}
    for s, e, k, _, _ in facts:
        if k <= as_of and e <= as_of.date():
            want[s, e] = max(want.get((s, e), k), k)
    assert got == want


def test_splits_only_when_knowable(spark, bars):
    actions = spark.createDataFrame([("a", "split", day("2026-01-10"), at("2026-01-11 00:00"), 2.0, 1.0), ("a", "split", day("2026-01-12"), at("2026-01-12 00:00"), 3.0, 0.0)], "security_id string, action_type string, effective_date date, available_at timestamp, ratio_numerator double, ratio_denominator double")
    before = adjust.bars_adjusted_asof(bars, actions, "2026-01-10 12:00")
    after = adjust.bars_adjusted_asof(bars, actions, "2026-01-31")
    assert closes(before)["a", "2026-01-05"] == 204.0 and closes(after)["a", "2026-01-05"] == 102.0
    assert after.filter("security_id = 'a'").first().volume == 200
    assert closes(adjust.bars_adjusted_asof(bars, actions, "2026-01-31", ex_date_aware=True))["a", "2026-01-05"] == 102.0
    assert closes(adjust.bars_adjusted_asof(bars, None, "2026-01-31"))["a", "2026-01-05"] == 204.0
    with pytest.raises(ValueError):
        adjust.bars_adjusted_asof(bars, actions, "2026-01-31", mode="total_return")


def test_symbols_are_reused(spark):
    master = spark.createDataFrame([("old", "TKR", "Old", day("2020-01-01"), day("2023-01-01"), at("2020-01-01 00:00")), ("new", "TKR", "New", day("2023-01-01"), None, at("2023-01-01 00:00"))], "security_id string, symbol string, name string, effective_start date, effective_end date, available_at timestamp")
    asked = spark.createDataFrame([("TKR", day("2022-12-31")), ("TKR", day("2023-01-01")), ("NONE", day("2023-01-01"))], "symbol string, date date")
    got = {(r.symbol, str(r.date)): r.security_id for r in identity.resolve(asked, master).collect()}
    assert got == {("TKR", "2022-12-31"): "old", ("TKR", "2023-01-01"): "new", ("NONE", "2023-01-01"): None}
    back = identity.reverse_resolve(spark.createDataFrame([("new", day("2024-01-01"))], "security_id string, date date"), master).first()
    assert (back.symbol, back.name) == ("TKR", "New")
    assert [r.security_id for r in identity.search(master, "tk", "2023-01-01").collect()] == ["new", "old"]  # inclusive end
    assert identity.with_cik(spark.createDataFrame([("aapl",)], "ticker string"), spark.createDataFrame([("AAPL", 320193)], "ticker string, cik long")).first().cik == "0000320193"


def test_calendar(spark):
    cal = calendar.trading_calendar(spark, "2026-01-01", "2026-01-31", spark.createDataFrame([("XNYS", day("2026-01-01")), ("XNYS", day("2026-01-19"))], "exchange string, day date"), "NYSE")
    days = spark.createDataFrame([("XNYS", day("2026-01-18")), ("XNYS", day("2026-01-20")), ("XNYS", day("2026-01-01"))], "exchange string, day date")
    prev = {str(r.day): str(r.session) for r in calendar.previous_trading_day(days, cal).collect()}
    assert prev == {"2026-01-18": "2026-01-16", "2026-01-20": "2026-01-20", "2026-01-01": "None"}
    assert {str(r.day): str(r.shifted) for r in calendar.shift_trading_days(days, cal, 1).collect()}["2026-01-18"] == "2026-01-20"
    assert calendar.open_closed(cal, "2026-01-17", "2026-01-20").filter("is_open").count() == 1


def test_merge_is_idempotent(spark, bars):
    rows = versions.version_hash(bars)
    keys = ["security_id", "effective_date", "source_id"]
    assert versions.insert_only(rows, None, keys).count() == 5
    assert versions.insert_only(rows.unionByName(rows), rows, keys).count() == 0
    changed = versions.version_hash(bars.withColumn("close", F.col("close") + 1e-3))
    assert versions.insert_only(changed, rows, keys).count() == 5
    assert versions.insert_only(versions.version_hash(bars.withColumn("close", F.col("close") + 1e-13)), rows, keys).count() == 0
    assert versions.compact(rows.unionByName(rows), keys).count() == 5
    nameless = versions.version_hash(bars.filter("close = 101").withColumn("security_id", F.lit(None).cast("string")))
    assert versions.insert_only(nameless, nameless, keys).count() == 1  # null keys never match
    assert versions.insert_only(nameless, nameless, keys, null_safe=True).count() == 0


def test_version_hash_is_of_compact_json(spark):
    rows = spark.createDataFrame([("é\n", None, 1.5, dt.date(1998, 1, 2), dt.datetime(1998, 1, 2, 3, 4, 5), 7)], "b string, a string, d double, day date, seen timestamp, n long")
    want = {"a": None, "b": "é\n", "d": 1.5, "day": "1998-01-02", "n": 7, "seen": "1998-01-02 03:04:05"}
    text = json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert versions.version_hash(rows).first().version_hash == hashlib.sha256(text.encode()).hexdigest()


def test_gaps_and_coverage(spark, bars):
    assert [(r.security_id, str(r.effective_date)) for r in versions.missing_dates(bars).collect()] == [("b", "2026-01-06")]
    req = spark.createDataFrame([("a", "eodhd", day("2026-01-01"), day("2026-01-31")), ("a", "tiingo", day("2026-01-01"), day("2026-01-31"))], "security_id string, source_id string, start date, end date")
    assert {r.source_id: r.covered for r in versions.covered(req, bars).collect()} == {"eodhd": True, "tiingo": False}


def test_quality(spark, bars):
    bad = bars.withColumn("quality_status", F.lit("valid")).withColumn("low", F.when(F.col("security_id") == "b", F.lit(None).cast("double")).otherwise(F.col("low")))
    assert {r.security_id: r.quality_status for r in quality.market_sanity(bad).collect()} == {"a": "valid", "b": "quarantined"}
    good, wrong = quality.validated(DATASETS["macro_series"], spark.createDataFrame([("x", "2026-01-01", "1.5"), (None, "nonsense", "2")], "series_id string, effective_date string, value string"))
    assert good.count() == 0 and {"series_id", "effective_date"} <= set(wrong.filter("value = 2").first().violations)
    assert len(DATASETS) == 24


def test_macro_steps_skip_days_that_a_month_lacks(spark):
    rows = [("g", day(d), at("2026-01-01 00:00"), "s", v) for d, v in (("2024-03-31", 4.0), ("2025-02-28", 3.8), ("2025-03-28", 4.0), ("2025-03-31", 5.0))]
    got = {(r.series_id, str(r.effective_date)): round(r.value, 6) for r in derived.macro_transforms(spark.createDataFrame(rows, "series_id string, effective_date date, available_at timestamp, source_id string, value double"), "2026-06-01").collect()}
    assert got == {("g_MOM", "2025-03-28"): 0.052632, ("g_YOY", "2025-03-31"): 0.25}


def test_events(spark):
    tx = spark.createDataFrame([("a", day("2026-01-15"), at("2026-01-16 00:00"), "P", 5000.0), ("a", day("2026-01-20"), at("2026-01-21 00:00"), "S", 3000.0), ("a", day("2026-02-19"), at("2026-02-20 00:00"), "P", 1.0)], "security_id string, effective_date date, available_at timestamp, transaction_code string, value double")
    got = [(r.buy_count, r.sell_count, r.net_value) for r in derived.insider_clusters(tx, "2026-03-01").orderBy("effective_date").collect()]
    assert got == [(1, 0, 5000.0), (1, 1, 2000.0), (1, 1, -2999.0)]


def walk(n=400, seed=1):
    rng = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    return pd.DataFrame({"security_id": "w", "effective_date": pd.date_range("2024-01-01", periods=n).date, "available_at": pd.Timestamp("2025-12-01"), "open": c * 1.001, "high": c * 1.02, "low": c * 0.98, "close": c, "volume": rng.integers(1000, 9000, n)})


def test_recursive_indicators_by_plain_loops(spark):
    p = walk()
    got = indicators.compute_all(spark.createDataFrame(p), "2026-01-01").orderBy("effective_date").toPandas()
    c = p["close"].to_numpy()

    def ema(x, n):
        out, a = [], 2 / (n + 1)
        for v in x:
            out.append(v if not out else a * v + (1 - a) * out[-1])
        return np.array(out)

    assert np.allclose(got["ema_12"], ema(c, 12)) and np.allclose(got["macd"], ema(c, 12) - ema(c, 26))
    assert np.allclose(got["macd_ema"], ema(ema(c, 12) - ema(c, 26), 9))
    k = [np.nan] * 10
    for i in range(10, len(c)):
        change, path = abs(c[i] - c[i - 10]), np.abs(np.diff(c[i - 10 : i + 1])).sum()
        sc = (change / path * (2 / 3 - 2 / 31) + 2 / 31) ** 2
        prev = c[i - 10] if np.isnan(k[-1]) else k[-1]
        k.append(prev + sc * (c[i] - prev))
    assert np.allclose(got["kama_10"], k, equal_nan=True)
    assert np.allclose(got["rsi_14"][:14], 100 - 100 / 101) and (got["chop_14"][:13] == 0).all() and (got["stoch_k_14"][:13] == 50).all()
    assert got["sma_20"].isna().sum() == 19 and got["ultimate_osc"].notna().all()
    assert np.allclose(got["linreg_channel_middle"].dropna(), got["sma_20"].dropna())
    assert got["beta_20d"].isna().all() if "beta_20d" in got else True


def test_beta_against_itself(spark):
    b = spark.createDataFrame(walk(120))
    got = indicators.compute_all(b, "2026-01-01", b).orderBy("effective_date").toPandas()
    assert np.allclose(got["beta_20d"].dropna(), 1) and np.allclose(got["alpha"].dropna(), 0, atol=1e-9) and np.allclose(got["corr_spy"].dropna(), 1)
    assert got["beta_20d"].first_valid_index() == 21


def fact(item, fy, q, value, kind="quarter", measure="flow", known="2026-01-01 00:00"):
    end = dt.date(fy, q * 3, 28)
    return ("t", kind, end, measure, "s", item, float(value), "USD", at(known), None, f"FY{fy}Q{q}", f"{item}{fy}{q}{kind}{known}")


FACTS = "security_id string, period_kind string, period_end date, measurement_kind string, statement_type string, line_item string, value double, currency string, available_at timestamp, source_priority long, fiscal_period string, version_hash string"


def test_fourth_quarter_is_derived(spark):
    rows = [fact("revenue", 2024, q, 100 * q) for q in (1, 2, 3)] + [fact("revenue", 2024, 4, 1000, "fiscal_year")] + [fact("net_income", 2024, q, -5) for q in (1, 2, 3, 4)]
    rows += [fact("revenue", 2024, 2, 250, known="2026-02-01 00:00")]  # restated later
    df = spark.createDataFrame(rows, FACTS)

    def values(as_of):
        return {r.metric_id: (r.value, r.quality_status) for r in fundamentals.period_metrics(df, as_of).collect()}

    early, late = values("2026-01-15"), values("2026-02-15")
    assert early["fundamentals.scale.revenue_ttm"] == (1000.0, "valid") == late["fundamentals.scale.revenue_ttm"]
    quarters = fundamentals.standalone_quarters(fundamentals.latest_facts(df, "2026-01-15")).filter("line_item = 'revenue' AND q = 4").first()
    assert quarters.value == 400.0 and len(quarters.hashes) == 4
    assert abs(early["fundamentals.profitability.net_margin_ttm"][0] + 2.0) < 1e-9
    gap = spark.createDataFrame([fact("revenue", 2024, q, 1) for q in (1, 2, 4)] + [fact("revenue", 2023, 4, 1)], FACTS)
    assert fundamentals.period_metrics(gap, "2026-02-01").count() == 0  # not consecutive


def test_threshold_states(spark):
    text = '[profile.p]\ndefinition_id = "momentum.rsi_14"\nmethod = "percentile"\npercentiles.low = { operator = "lte", percentile = 0.2 }\npercentiles.high = { operator = "between", min_percentile = 0.21, max_percentile = 1.0 }\n'
    p = readouts.load_profiles(text)["momentum.rsi_14"]
    df = spark.createDataFrame([(1.0, 0.2, 9), (1.0, 0.205, 9), (1.0, 0.9, 9), (None, 0.1, 9), (1.0, 0.1, 1)], "v double, below double, n int")
    got = [r.s for r in df.select(readouts.resolve_state(p, F.col("v"), F.col("n"), F.col("below"), 5).alias("s")).collect()]
    assert got == ["low", "unavailable", "high", "unavailable", "unavailable"]
    with pytest.raises(ValueError):
        readouts.load_profiles('[profile.x]\ndefinition_id = "no.such"\nmethod = "discrete"\n')


def test_places_among_peers(spark):
    from vintage.operators import fundamentals

    rows = [(f"s{i}", "m", float(v), "big") for i, v in enumerate([5, 1, 3, 3, 2, 9, None and 0 or 7])] + [("n", "m", None, "big"), ("a", "m", 1.0, "few"), ("b", "m", 2.0, "few"), ("c", "m", 3.0, None)]
    metrics = spark.createDataFrame([(s, m, v, 1) for s, m, v, _ in rows], "security_id string, metric_id string, value double, n int").drop("n")
    groups = spark.createDataFrame([(s, g) for s, _, _, g in rows] + [("a", "few")], "security_id string, peer_group string")
    got = {r.security_id: (r.peer_count, r.peer_percentile, r.peer_state) for r in fundamentals.with_peers(metrics, groups).collect()}
    values = {s: v for s, _, v, g in rows if g == "big" and v is not None}
    for s, v in values.items():
        share = sum(w < v for w in values.values()) / (len(values) - 1)
        assert got[s] == (6, share, "top_quartile" if share >= 0.75 else "mid_range" if share >= 0.25 else "bottom_quartile")
    assert got["n"] == (0, None, "unavailable") and got["a"] == (1, None, "raw_value") and got["c"] == (0, None, "raw_value")
    assert len(got) == len(rows)
