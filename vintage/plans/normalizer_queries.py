"""One query for each normalizer: payload bodies are written from the orders by SQL that both engines read,
the normalizer reads them, and the oracle states the facts straight from the orders' columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import archive, normalize
from . import views
from .queries import ORACLE_SQL, QUERIES, finite

#: k numbers a payload, d is its date, sec and sym name what it is about, hi and lo are small numbers.
ORDERS = "SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, concat('sec_', CAST(o_custkey % 50 AS STRING)) AS sec, concat('SYM', CAST(o_custkey % 40 AS STRING)) AS sym, o_orderkey % 1000 AS hi, o_orderkey % 8 AS lo FROM orders"
AT = "CAST(d AS TIMESTAMP) + INTERVAL 30 HOUR"


def text(sql: str) -> str:
    return f"CAST({sql} AS STRING)"


def obj(**fields: str) -> str:
    """A JSON object of text values by SQL; a value that begins with # is written without quotes."""
    parts = [f"'\"{n}\":', {text(e[1:])}" if e.startswith("#") else f"'\"{n}\":\"', {text(e)}, '\"'" for n, e in fields.items()]
    return "concat('{', " + ", ',', ".join(parts) + ", '}')"


def arr(*items: str) -> str:
    return "concat('[', " + ", ',', ".join(items) + ", ']')"


def under(**parts: str) -> str:
    return "concat('{', " + ", ',', ".join(f"'\"{n}\":', {x}" for n, x in parts.items()) + ", '}')"


TAIL = "available_at, source_id, source_fetch_id, sha256(body) AS raw_payload_hash, ingestion_run_id, sha256(body) AS content_hash, '' AS version_hash, CAST(1 AS BIGINT) AS schema_version, CAST({parser} AS BIGINT) AS parser_version, 'valid' AS quality_status"
NUMBER = "CAST(concat(CAST(hi AS STRING), '.', CAST(lo AS STRING)) AS DOUBLE)"
TEXT = "concat(CAST(hi AS STRING), '.', CAST(lo AS STRING))"


def payloads(body: str, source: str) -> str:
    return f"SELECT *, {body} AS body, sec AS subject, '{source}' AS source_id, concat('fetch_', {text('k')}) AS source_fetch_id, 'run' AS ingestion_run_id, {AT} AS available_at FROM ({ORDERS}) o"


def facts(name: str, dataset: str, source: str, body: str, *expected: str, parser: int = 1, long: bool = False) -> None:
    """expected: SELECT lists (with an optional WHERE behind a |) over the payloads, one for each kind of record.
    long: bodies are long, so the orders are dealt over the cores before they become bodies."""

    def run(spark, sf_dir):
        views.load(spark, sf_dir, "orders")
        if long:
            normalize.spread(spark.table("orders")).createOrReplaceTempView("orders")
        rows = spark.sql(payloads(body, source)).withColumn("content_hash", archive.content_hash(F.col("body")))
        got = normalize.normalizer(dataset, source)(rows)
        return got.select(*[finite(c).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes])

    run.__name__, run.__doc__ = name, f"Facts of {dataset} from bodies of {source}."
    QUERIES[name] = run
    tail = TAIL.format(parser=parser)
    parts = [f"SELECT {cols}, {tail} FROM p" + (f" WHERE {where}" if where else "") for cols, _, where in (e.partition("|") for e in expected)]
    ORACLE_SQL[name] = f"WITH p AS ({payloads(body, source)}) " + " UNION ALL ".join(parts)


DAY = text("d")
facts("facts_macro_series", "macro_series", "fred", under(observations=arr(obj(date="d", value=TEXT), obj(date="d", value="'.'"), obj(date="d", value="''"))), f"sec AS series_id, d AS effective_date, {NUMBER} AS value")
facts("facts_econ_indicator", "macro_series", "alphav", under(data=arr(obj(date="d", value=TEXT), obj(date="'unknown'", value=TEXT), obj(date="d", value="'.'"))), f"sec AS series_id, d AS effective_date, {NUMBER} AS value")
facts("facts_economic_calendar", "economic_calendar", "cal", arr(obj(date="d", event="sym", country="'DE'"), obj(eventDate="d", eventName="concat('late ', sym)"), obj(date="d")),
      f"concat('cal_', sym, '_', {DAY}) AS event_id, d AS effective_date, 'DE' AS country", f"concat('cal_late ', sym, '_', {DAY}), d, 'US'")
_none = "CAST(NULL AS TIMESTAMP)"
facts("facts_bars", "lake_bars", "eodhd", arr(obj(date=f"concat({DAY}, 'T00:00:00')", open="#hi", high=TEXT, low="'bad'", close="#lo", volume="#k")),
      f"sec AS security_id, d AS effective_date, {_none} AS source_published_at, available_at AS ingested_at, {_none} AS validated_at, CAST(hi AS DOUBLE) AS open, {NUMBER} AS high, CAST(0 AS DOUBLE) AS low, CAST(lo AS DOUBLE) AS close, k AS volume")
_stamp = "694224000 + k % 1000000 * 86"
facts("facts_chart_bars", "lake_bars", "yahoo", under(timestamp=arr(text(_stamp), text("0")), open=arr(text("hi"), text("1")), high=arr(TEXT, text("2")), low=arr(text("lo"), text("0")), close=arr(text("lo + 1"), "'null'"), volume=arr(text("k"), text("5"))),
      f"sec AS security_id, CAST(make_timestamp(({_stamp}) * 1000000) AS DATE) AS effective_date, CAST(hi AS DOUBLE) AS open, {NUMBER} AS high, CAST(lo AS DOUBLE) AS low, CAST(lo + 1 AS DOUBLE) AS close, k AS volume")
_at = f"make_timestamp(({_stamp}) * 1000000)"
facts("facts_news", "news_articles", "finnhub", arr(obj(id="#k", headline="sym", summary="concat('about ', sec)", url="concat('http://x/', CAST(k AS STRING))", source="'wire'", datetime=f"#{_stamp}"), obj(id="''", headline="sym")),
      f"concat('finnhub_', {text('k')}) AS article_id, CAST({_at} AS DATE) AS effective_date, sym AS title, concat('about ', sec) AS description, concat('http://x/', {text('k')}) AS url, sha256(concat(sym, 'about ', sec)) AS text_hash, {_at} AS published_at, 'wire' AS source_name")
facts("facts_uuid_news", "news_articles", "marketaux", under(data=arr(obj(uuid="k", title="sym", description="''", snippet="sec", url="'u'", source="'s'", published_at=f"concat({DAY}, 'T06:30:00Z')"), obj(title="sym"))),
      f"concat('marketaux_', {text('k')}) AS article_id, d AS effective_date, sym AS title, sec AS description, 'u' AS url, sha256(sym) AS text_hash, CAST(d AS TIMESTAMP) + INTERVAL 390 MINUTE AS published_at, 's' AS source_name")


def annotation(i: str, day: str, kind: str, score: str, label: str, hashed: str, security: str) -> str:
    none = "CAST(NULL AS VARCHAR)"
    return f"{i} AS annotation_id, {day} AS effective_date, '{kind}' AS annotation_kind, {score} AS sentiment_score, {label} AS sentiment_label, {none} AS model_version, {none} AS prompt_version, {none} AS taxonomy_version, {none} AS source_dataset_version, sha256({hashed}) AS input_text_hash, {security} AS security_id"


facts("facts_news_sentiment", "sentiment_annotations", "finnhub", arr(obj(id="#k", headline="sym", summary="sec", related="sym", datetime=f"#{_stamp}"), obj(headline="sym")), annotation(f"concat('finnhub_', {text('k')})", f"CAST({_at} AS DATE)", "news_sentiment", "CAST(NULL AS DOUBLE)", "''", "concat(sym, sec)", "sym"))
facts("facts_entity_sentiment", "sentiment_annotations", "marketaux", under(data=arr(f"concat('{{\"uuid\":\"', {text('k')}, '\",\"title\":\"', sym, '\",\"description\":\"', sec, '\",\"published_at\":\"', {DAY}, '\",\"entities\":', {arr(obj(symbol='sym', sentiment_score='#' + TEXT), obj(symbol='sec', sentiment_score='#lo'))}, '}}')")),
      annotation(f"concat('marketaux_', {text('k')}, '_', sym)", "d", "news_sentiment", NUMBER, "''", "concat(sym, sec)", "sym"), annotation(f"concat('marketaux_', {text('k')}, '_', sec)", "d", "news_sentiment", "CAST(lo AS DOUBLE)", "''", "concat(sym, sec)", "sec"))
_mood = "CASE WHEN lo < 3 THEN 'Bullish' WHEN lo < 6 THEN 'Bearish' ELSE '' END"
facts("facts_message_sentiment", "sentiment_annotations", "stocktwits", under(messages=arr(obj(id="#k", sentiment=_mood, body="sym", created_at=f"concat({DAY}, 'T10:00:00')"), obj(body="sym"))),
      annotation(f"concat('stocktwits_', {text('k')})", "d", "social_sentiment", "CASE WHEN lo < 3 THEN 1.0::DOUBLE WHEN lo < 6 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END", f"CASE WHEN lo < 6 THEN {_mood} ELSE 'Neutral' END", "sym", "sec"))
facts("facts_analyst_estimates", "analyst_estimates", "finnhub", arr(obj(period="d", strongBuy="#lo", buy="#hi", hold="'x'", sell="''", strongSell="#lo + 1", targetMean=TEXT, targetHigh="#hi", targetLow="'None'"), obj(buy="#hi")),
      f"sec AS security_id, d AS effective_date, lo AS strong_buy, hi AS buy, CAST(0 AS BIGINT) AS hold, CAST(0 AS BIGINT) AS sell, lo + 1 AS strong_sell, {NUMBER} AS target_mean, CAST(hi AS DOUBLE) AS target_high, CAST(NULL AS DOUBLE) AS target_low")
_time = "CASE WHEN lo < 3 THEN 'BeforeMarket' WHEN lo < 6 THEN 'AfterMarket' ELSE 'Unknown' END"
facts("facts_earnings_calendar", "earnings_calendar", "eodhd", arr(obj(code="concat(sym, '.US')", date="d", time=_time), obj(code="sym", date="''")), "sym AS security_id, d AS effective_date, d AS report_date, CASE WHEN lo < 3 THEN 'morning' WHEN lo < 6 THEN 'afternoon' ELSE 'regular' END AS session")
_hour = "CASE WHEN lo < 2 THEN 'BMO' WHEN lo < 4 THEN 'amc' WHEN lo < 6 THEN 'dmh' ELSE '' END"
facts("facts_hour_earnings", "earnings_calendar", "finnhub", under(earningsCalendar=arr(obj(symbol="sym", date="d", hour=_hour), obj(date="d"))), "sym AS security_id, d AS effective_date, d AS report_date, CASE WHEN lo < 2 THEN 'morning' WHEN lo < 6 THEN 'afternoon' ELSE 'regular' END AS session")
_change = "hi - 500"
facts("facts_insider_tx", "insider_tx", "finnhub", under(data=arr(obj(year="year(d)", month="month(d)", change=f"#{_change}"), obj(year="year(d)"))),
      f"sec AS security_id, CAST(date_trunc('month', d) AS DATE) AS effective_date, '' AS filer_cik, '' AS issuer_cik, CASE WHEN {_change} >= 0 THEN 'P' ELSE 'S' END AS transaction_code, CAST(greatest({_change}, 0) AS DOUBLE) AS shares, CAST(0 AS DOUBLE) AS price, CAST(0 AS DOUBLE) AS value")
_known = f"CAST({AT} AS DATE)"
facts("facts_attention", "attention_metrics", "ape", under(results=arr(obj(mentions="#hi", mentions_24h_ago="#lo", upvotes="'x'", rank="#lo + 1", name="sym"))),
      f"sec AS security_id, {_known} AS effective_date, 'all-stocks' AS cohort, hi AS mentions, lo AS mentions_24h_ago, CAST(NULL AS BIGINT) AS upvotes, lo + 1 AS rank, CAST(NULL AS BIGINT) AS rank_24h_ago, sym AS name", parser=2)


def statement(day: str, fiscal: str, kind: str, measure: str, statement_type: str, item: str, value: str) -> str:
    return f"sec AS security_id, {day} AS effective_date, available_at AS source_published_at, available_at AS ingested_at, {_none} AS validated_at, {fiscal} AS fiscal_period, '{kind}' AS period_kind, {day} AS period_end, '{measure}' AS measurement_kind, '{statement_type}' AS statement_type, '{item}' AS line_item, {value} AS value, 'USD' AS currency, 'USD' AS source_currency, 'raw' AS unit, CAST(NULL AS BIGINT) AS source_priority"


_fy = f"concat('FY', {text('year(d)')}, 'Q', {text('quarter(d)')})"
_lists = under(incomeStatement=arr(obj(dataCode="'revenue'", value="#hi"), obj(dataCode="'ebit'", value="'n/a'")), cashFlow=arr(obj(dataCode="'ncfo'", value="#lo"), obj(dataCode="''", value="#lo")))
facts("facts_fundamentals", "fundamentals", "tiingo", arr(f"concat('{{\"year\":', {text('year(d)')}, ',\"quarter\":', {text('quarter(d)')}, ',\"date\":\"', {DAY}, '\",\"statementData\":', {_lists}, '}}')"),
      statement("d", _fy, "quarter", "income_statement", "income_statement", "revenue", "CAST(hi AS DOUBLE)"), statement("d", _fy, "quarter", "income_statement", "income_statement", "ebit", "CAST(0 AS DOUBLE)"), statement("d", _fy, "quarter", "cash_flow", "cash_flow", "ncfo", "CAST(lo AS DOUBLE)"))
_year = f"concat('FY', {text('year(d)')}, 'Q4')"
_reports = lambda q, a, **items: under(**{q: arr(obj(fiscalDateEnding="d", **items), obj(fiscalDateEnding="'none'", **items)), a: arr(obj(fiscalDateEnding="d", **items))})
_wide = {
    "incomeStatement": ("quarterlyReports", "annualReports", "totalRevenue", "flow", "income_statement", "revenue"), "balanceSheet": ("quarterlyReports", "annualReports", "totalShareholderEquity", "instant", "balance_sheet", "total_equity"),
    "cashFlow": ("quarterlyReports", "annualReports", "operatingCashflow", "flow", "cash_flow", "operating_cash_flow"), "sharesOutstanding": ("quarterly", "annual", "sharesOutstanding", "overview", "overview", "shares_outstanding"),
    "earnings": ("quarterlyEarnings", "annualEarnings", "reportedEPS", "earnings", "earnings", "reported_eps"), "earningsEstimates": ("quarterly", "annual", "estimatedRevenue", "earnings", "earnings", "estimated_revenue"),
}
facts("facts_wide_fundamentals", "fundamentals", "alphav", under(**{s: _reports(q, a, **{field: TEXT, "reportedCurrency": "'USD'"}) for s, (q, a, field, *_) in _wide.items()}, overview=obj(MarketCapitalization="#hi", Name="sym", PERatio="'None'", Beta=TEXT)),
      *[statement("d", fiscal, kind, measure, st, item, NUMBER) for *_, measure, st, item in _wide.values() for fiscal, kind in ((_fy, "quarter"), (_year, "fiscal_year"))],
      *[statement(_known, "'OVERVIEW'", "snapshot", "overview", "overview", item, value) for item, value in (("market_capitalization", "CAST(hi AS DOUBLE)"), ("beta", NUMBER))], long=True)


def action(kind: str, num: str = "NULL", den: str = "NULL", amount: str = "NULL", currency: str = "NULL", where: str = "") -> str:
    return f"sec AS security_id, d AS effective_date, '{kind}' AS action_type, CAST({num} AS DOUBLE) AS ratio_numerator, CAST({den} AS DOUBLE) AS ratio_denominator, CAST({amount} AS DOUBLE) AS dividend_amount, CAST({currency} AS VARCHAR) AS dividend_currency|{where}"


_ratio = f"concat({text('lo + 1')}, ':', {text('hi + 1')})"
facts("facts_historical_actions", "corp_actions", "alphav", under(dividends=under(historical=arr(obj(exDividendDate="d", dividendAmount=TEXT), obj(exDividendDate="d", dividendAmount="'None'"))), splits=under(historical=arr(obj(exDate="d", splitRatio=_ratio), obj(exDate="d", splitRatio="'2'"), obj(exDate="d", splitRatio="'a:1'")))),
      action("dividend", amount=NUMBER, currency="'USD'"), action("split", "lo + 1", "hi + 1"))
facts("facts_splits", "corp_actions", "eodhd_splits", arr(obj(date="d", splitRatio=f"CASE WHEN lo < 4 THEN {_ratio} ELSE concat({text('lo')}, '/2') END"), obj(date="d", split="'odd'")), action("split", "CASE WHEN lo < 4 THEN lo + 1 ELSE lo END", "CASE WHEN lo < 4 THEN hi + 1 ELSE 2 END"), action("split", "1", "1"))
facts("facts_insider_transactions", "insider_transactions", "alphav", under(data=arr(obj(transaction_date="d", executive="sym", executive_title="'CFO'", acquisition_or_disposal="CASE WHEN lo < 4 THEN 'Acquisition' ELSE 'D' END", shares="#hi", share_price="CASE WHEN lo < 2 THEN '' ELSE '2.5' END"), obj(transaction_date="d", shares="'x'"))),
      "sec AS security_id, d AS effective_date, d AS transaction_date, sym AS insider_name, 'CFO' AS insider_title, CASE WHEN lo < 4 THEN 'buy' ELSE 'sell' END AS transaction_type, CAST(hi AS DOUBLE) AS shares, CASE WHEN lo < 2 THEN 0.0::DOUBLE ELSE 2.5::DOUBLE END AS price")
facts("facts_institutional_holdings", "institutional_holdings", "alphav", under(holdings=arr(obj(date_reported="d", holder="sym", shares="#hi", value=TEXT, percent_change="'None'"), obj(holder="sym", shares="#hi"))),
      f"sec AS security_id, d AS effective_date, sym AS holder_name, CAST(hi AS DOUBLE) AS shares, {NUMBER} AS value, d AS date_reported, CAST(NULL AS DOUBLE) AS percent_change")
_mover = lambda p: arr(obj(ticker="sym", price=p, change_amount="#lo", change_percentage="'1.5'", volume="#k"))
_moved = lambda kind, p: f"sym AS security_id, {_known} AS effective_date, '{kind}' AS mover_type, {p} AS price, CAST(lo AS DOUBLE) AS change_amount, 1.5::DOUBLE AS change_percent, CAST(k AS DOUBLE) AS volume"
facts("facts_top_movers", "top_movers", "alphav", under(top_gainers=_mover(TEXT), most_actively_traded=arr(obj(ticker="''")), top_losers=_mover("#hi")), _moved("top_gainers", NUMBER), _moved("top_losers", "CAST(hi AS DOUBLE)"))
facts("facts_etf_profiles", "etf_profiles", "alphav", obj(symbol="sym", name="CASE WHEN lo < 4 THEN '' ELSE 'Fund' END", net_assets="#k", expense_ratio=TEXT, dividend_yield="'n/a'"),
      f"sec AS security_id, {_known} AS effective_date, CASE WHEN lo < 4 THEN sym ELSE 'Fund' END AS name, 'ETF' AS asset_type, CAST(k AS DOUBLE) AS net_assets, {NUMBER} AS expense_ratio, CAST(NULL AS DOUBLE) AS dividend_yield")
facts("facts_ipo_calendar", "ipo_calendar", "finnhub", under(ipoCalendar=arr(obj(symbol="sym", companyName="sec", exchange="'NYSE'", date=f"CASE WHEN lo < 4 THEN '' ELSE {DAY} END", status="'priced'"), obj(companyName="sec"))),
      f"sym AS symbol, CASE WHEN lo < 4 THEN {_known} ELSE d END AS effective_date, sec AS company_name, 'NYSE' AS exchange, CASE WHEN lo >= 4 THEN d END AS offer_date, 'priced' AS status")
facts("facts_congress_trades", "congress_trades", "quiver", arr(obj(transaction_id="k", ticker="sym", politician="sec", transaction_date="d", type="'Purchase'", amount_range="'1-5'"), obj(id="#-k", symbol="sec", politician_id="'P1'", direction="'SALE'", amount="'7'"), obj(id="k")),
      f"{text('k')} AS transaction_id, sec AS politician_id, sym AS security_id, d AS effective_date, 'purchase' AS direction, '1-5' AS amount_range", f"{text('-k')}, 'P1', sec, {_known}, 'sale', '7'")
_post = lambda **f: under(data=obj(**f))
facts("facts_social_posts", "social_posts", "reddit", under(data=under(children=arr(_post(id="k", title="sym", selftext="sec", subreddit="'stocks'", created_utc=f"#{_stamp}", ups="#hi", num_comments="#lo"), _post(id="'x'", title="sym"), _post(title="sym")))),
      f"sha256({text('k')}) AS post_id_hash, CAST({_at} AS DATE) AS effective_date, 'reddit' AS platform, 'stocks' AS venue, CAST(NULL AS VARCHAR) AS parent_id_hash, sha256(concat(sym, sec)) AS text_hash, {_at} AS published_at, concat('{{\"ups\":', {text('hi')}, ',\"comments\":', {text('lo')}, '}}') AS engagement_json",
      f"sha256('x'), {_known}, 'reddit', '', CAST(NULL AS VARCHAR), sha256(sym), available_at, '{{\"ups\":0,\"comments\":0}}'")


def dividends(spark, sf_dir):
    """Facts of corp_actions from dividend bodies, for which the table's normalizer is given by hand."""
    rows = views.view(spark, sf_dir, payloads(DIVIDENDS, "eodhd_div"), "orders").withColumn("content_hash", archive.content_hash(F.col("body")))
    return normalize.dividends(rows)


DIVIDENDS = arr(obj(date="d", dividend=TEXT, currency="'EUR'"), obj(date="d", amount="#lo"))
QUERIES["facts_dividends"] = dividends
ORACLE_SQL["facts_dividends"] = f"WITH p AS ({payloads(DIVIDENDS, 'eodhd_div')}) " + " UNION ALL ".join(f"SELECT {a.partition('|')[0]}, {TAIL.format(parser=1)} FROM p" for a in (action("dividend", amount=NUMBER, currency="'EUR'"), action("dividend", amount="lo", currency="'USD'")))
