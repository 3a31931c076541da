"""Normalizers, archive, bulk files and streams."""

import datetime as dt
import json

from pyspark.sql import functions as F

from vintage.sources import archive, normalize
from vintage.streaming import ingest

PAYLOAD = "body string, subject string, source_id string, source_fetch_id string, ingestion_run_id string, content_hash string, available_at timestamp"


def payload(spark, *bodies, source="src", subject="sec_x"):
    rows = [(b if isinstance(b, str) else json.dumps(b), subject, source, "f", "r", "h") for b in bodies]
    return spark.createDataFrame(rows, PAYLOAD.rsplit(",", 1)[0]).withColumn("available_at", F.lit("2026-01-10 12:00:00").cast("timestamp"))


def test_macro_and_wrappers(spark):
    rows = [{"date": "2026-01-01", "value": "1.5"}, {"date": "2026-01-02", "value": "."}, {"date": "2026-01-03", "value": ""}]
    for body in (rows, {"observations": rows}, {"data": rows}):
        got = normalize.macro_series(payload(spark, body)).collect()
        assert [(r.series_id, str(r.effective_date), r.value, r.quality_status) for r in got] == [("sec_x", "2026-01-01", 1.5, "valid")]


def test_bars_and_charts(spark):
    got = normalize.bars(payload(spark, [{"date": "2026-01-05T00:00:00Z", "open": 1, "close": 2.5}])).first()
    assert (str(got.effective_date), got.open, got.close, got.high, got.volume) == ("2026-01-05", 1.0, 2.5, 0.0, 0)
    chart = {"timestamp": [86400, 172800], "open": [1, None], "high": [2, None], "low": [1, None], "close": [1.5, None], "volume": [10, None]}
    assert [(str(r.effective_date), r.close) for r in normalize.chart_bars(payload(spark, chart)).collect()] == [("1970-01-02", 1.5)]


def test_ratios(spark):
    body = [{"date": "2025-01-10", "splitRatio": r} for r in ("2:1", "3/2", "bad", None)]
    got = [(r.ratio_numerator, r.ratio_denominator) for r in normalize.splits(payload(spark, body)).collect()]
    assert got == [(2.0, 1.0), (3.0, 2.0), (1.0, 1.0), (1.0, 1.0)]
    both = {"dividends": {"historical": [{"exDividendDate": "2025-02-01", "dividendAmount": "0.5"}, {"exDividendDate": "x", "dividendAmount": "1"}, {"exDividendDate": "2025-02-02", "dividendAmount": "None"}]}, "splits": {"historical": [{"exDate": "2025-03-01", "splitRatio": "4:1"}, {"exDate": "2025-03-01", "splitRatio": "4"}]}}
    assert sorted((r.action_type, str(r.effective_date)) for r in normalize.historical_actions(payload(spark, both)).collect()) == [("dividend", "2025-02-01"), ("split", "2025-03-01")]


def test_sentiment_and_sessions(spark):
    msgs = normalize.message_sentiment(payload(spark, {"messages": [{"id": 1, "sentiment": "Bullish", "created_at": "2026-01-01T00:00:00Z"}, {"id": 2, "sentiment": None, "created_at": "2026-01-01T00:00:00Z"}]})).collect()
    assert [(r.sentiment_score, r.sentiment_label) for r in msgs] == [(1.0, "Bullish"), (0.0, "Neutral")]
    ents = normalize.entity_sentiment(payload(spark, [{"uuid": "u", "published_at": "2026-01-02T10:00:00Z", "entities": [{"symbol": "A", "sentiment_score": 0.5}, {"symbol": "", "sentiment_score": None}]}])).collect()
    assert [r.annotation_id for r in ents] == ["src_u_A", "src_u"]
    hours = normalize.hour_earnings(payload(spark, {"earningsCalendar": [{"symbol": s, "date": "2026-01-01", "hour": h} for s, h in (("A", "bmo"), ("B", "amc"), ("C", ""), ("", "bmo"))]})).collect()
    assert [(r.security_id, r.session) for r in hours] == [("A", "morning"), ("B", "afternoon"), ("C", "regular")]
    cal = normalize.earnings_calendar(payload(spark, [{"code": "AAPL.US", "date": "2026-01-01", "time": "BeforeMarket"}])).first()
    assert (cal.security_id, cal.session) == ("AAPL", "morning")


def test_fundamentals(spark):
    lists = [{"year": 2025, "quarter": 2, "date": "2025-06-30", "statementData": {"incomeStatement": [{"dataCode": "revenue", "value": 7}, {"dataCode": "", "value": 1}], "balanceSheet": [{"dataCode": "cash", "value": None}]}}]
    got = normalize.fundamentals(payload(spark, lists)).collect()
    assert [(r.fiscal_period, r.line_item, r.value, r.period_kind) for r in got] == [("FY2025Q2", "revenue", 7.0, "quarter")]
    wide = {"incomeStatement": {"quarterlyReports": [{"fiscalDateEnding": "2025-06-30", "totalRevenue": "100", "netIncome": "None", "unknown": "1"}], "annualReports": [{"fiscalDateEnding": "2025-12-31", "totalRevenue": "400"}]}, "overview": {"EPS": "1.5", "Beta": ""}, "earnings": {"quarterlyEarnings": [{"fiscalDateEnding": "2025-06-30", "reportedEPS": "0.4"}]}}
    got = sorted((r.statement_type, r.fiscal_period, r.period_kind, r.line_item, r.value) for r in normalize.wide_fundamentals(payload(spark, wide)).collect())
    assert got == [("earnings", "FY2025Q2", "quarter", "reported_eps", 0.4), ("income_statement", "FY2025Q2", "quarter", "revenue", 100.0), ("income_statement", "FY2025Q4", "fiscal_year", "revenue", 400.0), ("overview", "OVERVIEW", "snapshot", "eps", 1.5)]


def test_every_normalizer_survives_odd_bodies(spark):
    odd = payload(spark, "[]", "{}", "not json", "null", '[{"x": 1}]', '{"data": {"children": []}}')
    for f in normalize.NORMALIZERS.values():
        cols = f(odd)
        assert {"available_at", "content_hash", "quality_status"} <= set(cols.columns)
        cols.collect()
    posts = {"data": {"children": [{"data": {"id": "p", "title": "t", "created_utc": 86400, "ups": 3}}, {"data": {"id": ""}}]}}
    got = normalize.social_posts(payload(spark, posts)).collect()
    assert [(str(r.effective_date), json.loads(r.engagement_json)) for r in got] == [("1970-01-02", {"ups": 3, "comments": 0})]


def test_archive(spark, tmp_path):
    p = spark.createDataFrame([("a",), ("a",), ("b",)], "body string")
    archive.write_archive(archive.new_payloads(p), str(tmp_path / "raw"))
    stored = spark.read.parquet(str(tmp_path / "raw"))
    assert stored.count() == 2 and archive.new_payloads(p, stored).count() == 0
    assert archive.read_raw(stored, stored.filter("body = 'a'").select("content_hash")).first().body == "a"
    one = archive.new_payloads(p.filter("body = 'a'"), stored)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(prefix" in one or "PartitionFilters: [(prefix" in one, one  # one folder of the archive


def test_bulk_files(spark, tmp_path):
    folder = tmp_path / "daily" / "us" / "nasdaq stocks" / "1"
    folder.mkdir(parents=True)
    (folder / "aapl.us.txt").write_text("<DATE>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>\n20260105,1,2,0.5,1.5,100\nbad,row,x,x,x,x\n")
    other = tmp_path / "daily" / "us" / "nyse indices"
    other.mkdir(parents=True)
    (other / "spx.us.txt").write_text("<DATE>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>\n20260105,1,2,0.5,1.5,100\n")
    got = archive.read_bulk_bars(spark, str(tmp_path / "daily")).collect()
    assert [(r.symbol, r.exchange, r.kind, str(r.effective_date), r.close, r.volume) for r in got] == [("AAPL", "nasdaq", "stocks", "2026-01-05", 1.5, 100)]


def test_bulk_text_comes_back_under_any_name(spark, tmp_path):
    """Also below a folder that is called like a kind, from a task that runs again, and with values missing."""
    path = str(tmp_path / "old stocks" / "daily")
    rows = [(s, x, k, d, 1.5, None, 0.5, float(i), i) for i, (s, x, k) in enumerate([("AAPL", "nasdaq", "stocks"), ("^SPX", "nyse", "etfs"), ("BRK B", "nyse", "stocks"), ("A+B%2B", "nyse", "stocks"), ("Q", "nyse", "bonds")]) for d in (dt.date(2026, 1, 6), dt.date(2026, 1, 5), None)]
    bars = spark.createDataFrame(rows, "symbol string, exchange string, kind string, effective_date date, open double, high double, low double, close double, volume long")
    for _ in range(2):
        archive.write_bulk_text(bars, path)
    got = archive.read_bulk_bars(spark, path).select(*bars.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((r for r in rows if r[3] and r[2] != "bonds"), key=repr)
    lines = (tmp_path / "old stocks" / "daily" / "us" / "nasdaq stocks" / "aapl.us.txt").read_text().splitlines()
    assert lines[0] == "<DATE>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>" and lines[2:] == ["20260105,1.5,,0.5,0.0,0", "20260106,1.5,,0.5,0.0,0"]


def test_stream_ingest_is_exactly_once(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "bars")
    source.mkdir()
    line = {"body": json.dumps([{"date": "2026-01-05", "close": 2}]), "subject": "s", "source_id": "x", "source_fetch_id": "f", "ingestion_run_id": "r", "content_hash": "h", "available_at": "2026-01-10T12:00:00.000Z"}
    keys = ["security_id", "effective_date", "source_id"]
    for k, close in enumerate((2, 2, 3)):
        line["body"] = json.dumps([{"date": "2026-01-05", "close": close}])
        (source / f"{k}.json").write_text(json.dumps(line) + "\n")
        ingest.ingest(ingest.payload_stream(spark, str(source), PAYLOAD), normalize.bars, table, keys, str(tmp_path / "state")).awaitTermination()
    assert sorted(r.close for r in spark.read.parquet(table).collect()) == [2.0, 3.0]
