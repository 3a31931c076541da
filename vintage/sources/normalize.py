"""Normalizers: archived JSON payloads to typed fact rows, each one from_json, explode and project.

A payload row has body, subject (the security, symbol or series that was asked for, where there is one),
source_id, source_fetch_id, ingestion_run_id, content_hash and available_at. A body is a list of records or
an object that holds them under observations, data, messages or results. Every field is read as text and cast
with try_cast, so a malformed value is null and never stops a job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WRAPPERS = ("observations", "data", "messages", "results")


def _struct(names: str, *more: str) -> str:
    return "struct<" + ",".join([*[f"`{n}`:string" for n in names.split()], *more]) + ">"


def _is_list() -> Column:
    return F.ltrim("body").startswith("[")


def records(payloads: DataFrame, names: str, *more: str, under: tuple[str, ...] = WRAPPERS) -> DataFrame:
    """One row per record, as the struct column r, beside the payload's columns."""
    one = _struct(names, *more)
    wrapped = F.from_json("body", "struct<" + ",".join(f"`{w}`:array<{one}>" for w in under) + ">")
    listed = F.from_json("body", f"array<{one}>")
    return payloads.select("*", F.explode(F.when(_is_list(), listed).otherwise(F.coalesce(*[wrapped[w] for w in under]))).alias("r"))


def whole(payloads: DataFrame, schema: str) -> DataFrame:
    """The body as one object m; of a list its first."""
    return payloads.select("*", F.when(_is_list(), F.get(F.from_json("body", f"array<{schema}>"), F.lit(0))).otherwise(F.from_json("body", schema)).alias("m"))


def _given(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def _first(*cs: Column) -> Column:
    return F.coalesce(*[F.when(_given(c), c) for c in cs])


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


#: How sources write that there is no number.
NO_NUMBER = ("None", "none", "null", "N/A", "n/a", "NA", "-", ".", "")


def _num(c: Column) -> Column:
    """A number; null for 'None', empty and malformed text. Each failed cast costs an exception, so common words
    for nothing are not tried."""
    return F.when(c.isin(*NO_NUMBER), F.lit(None)).otherwise(c).try_cast("double")


def _count(c: Column) -> Column:
    return F.coalesce(c.try_cast("double").cast("long"), F.lit(0).cast("long"))


def _day(c: Column) -> Column:
    return F.substring(c, 1, 10).try_cast("date")


def _hash(*cs: Column) -> Column:
    return F.sha2(F.concat(*[_text(c) for c in cs]), 256)


def _facts(df: DataFrame, *cols: Column, parser: int = 1) -> DataFrame:
    """The fact's columns and the lineage tail."""
    return df.select(*cols, F.col("available_at"), F.col("source_id"), "source_fetch_id", F.col("content_hash").alias("raw_payload_hash"), "ingestion_run_id", "content_hash", F.lit("").alias("version_hash"), F.lit(1).cast("long").alias("schema_version"), F.lit(parser).cast("long").alias("parser_version"), F.lit("valid").alias("quality_status"))


def _known_day() -> Column:
    return F.to_date("available_at")


R = lambda name: F.col("r")[name]


def macro_series(p: DataFrame) -> DataFrame:
    d = records(p, "date value").filter(_given(R("value")) & (R("value") != "."))
    return _facts(d, F.col("subject").alias("series_id"), _day(R("date")).alias("effective_date"), _num(R("value")).alias("value"))


def econ_indicator(p: DataFrame) -> DataFrame:
    return macro_series(p).filter("effective_date IS NOT NULL")


def economic_calendar(p: DataFrame) -> DataFrame:
    d = records(p, "date eventDate event eventName country").withColumns({"day": _first(R("date"), R("eventDate")), "name": _first(R("event"), R("eventName"))}).filter("day IS NOT NULL AND name IS NOT NULL")
    return _facts(d, F.concat_ws("_", "source_id", "name", "day").alias("event_id"), _day(F.col("day")).alias("effective_date"), F.coalesce(R("country"), F.lit("US")).alias("country"))


def bars(p: DataFrame) -> DataFrame:
    d = records(p, "date open high low close volume")
    prices = [F.coalesce(_num(R(c)), F.lit(0.0)).alias(c) for c in ("open", "high", "low", "close")]
    none = F.lit(None).cast("timestamp")
    return _facts(d, F.col("subject").alias("security_id"), F.regexp_replace(R("date"), "T.*$", "").try_cast("date").alias("effective_date"), none.alias("source_published_at"), F.col("available_at").alias("ingested_at"), none.alias("validated_at"), *prices, _count(R("volume")).alias("volume"))


def chart_bars(p: DataFrame) -> DataFrame:
    """Bars from parallel arrays: timestamp, open, high, low, close, volume."""
    m = "struct<timestamp:array<bigint>,open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<bigint>>"
    d = whole(p, m).select("*", F.inline(F.arrays_zip(*[F.col("m")[c].alias(c) for c in ("timestamp", "open", "high", "low", "close", "volume")]))).filter("close IS NOT NULL")
    return _facts(d, F.col("subject").alias("security_id"), F.to_date(F.timestamp_seconds("timestamp")).alias("effective_date"), *[F.col(c) for c in ("open", "high", "low", "close", "volume")])


def _news(d: DataFrame, article: Column, title: Column, text: Column, hashed: Column, day: Column, at: Column) -> DataFrame:
    return _facts(d, F.concat_ws("_", "source_id", article).alias("article_id"), day.alias("effective_date"), _text(title).alias("title"), _text(text).alias("description"), _text(R("url")).alias("url"), _hash(title, hashed).alias("text_hash"), at.alias("published_at"), _text(R("source")).alias("source_name"))


def news(p: DataFrame) -> DataFrame:
    d = records(p, "id headline summary url source datetime").filter(_given(R("id")))
    at = F.timestamp_seconds(F.coalesce(R("datetime").try_cast("long"), F.lit(0)))
    return _news(d, R("id"), R("headline"), R("summary"), R("summary"), F.to_date(at), at)


def uuid_news(p: DataFrame) -> DataFrame:
    d = records(p, "uuid title description snippet url source published_at").filter(_given(R("uuid")))
    at = F.coalesce(F.replace(R("published_at"), F.lit("Z"), F.lit("")).try_cast("timestamp"), F.col("available_at"))
    return _news(d, R("uuid"), R("title"), _first(R("description"), R("snippet")), R("description"), _day(R("published_at")), at)


def _sentiment(d: DataFrame, annotation: Column, day: Column, kind: str, score: Column, label: Column, hashed: Column, security: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return _facts(d, annotation.alias("annotation_id"), day.alias("effective_date"), F.lit(kind).alias("annotation_kind"), score.cast("double").alias("sentiment_score"), label.alias("sentiment_label"), *[none.alias(c) for c in ("model_version", "prompt_version", "taxonomy_version", "source_dataset_version")], hashed.alias("input_text_hash"), _text(security).alias("security_id"))


def news_sentiment(p: DataFrame) -> DataFrame:
    d = records(p, "id headline summary related datetime").filter(_given(R("id")))
    day = F.to_date(F.timestamp_seconds(F.coalesce(R("datetime").try_cast("long"), F.lit(0))))
    return _sentiment(d, F.concat_ws("_", "source_id", R("id")), day, "news_sentiment", F.lit(None), F.lit(""), _hash(R("headline"), R("summary")), R("related"))


def entity_sentiment(p: DataFrame) -> DataFrame:
    d = records(p, "uuid title description published_at", "entities:array<struct<symbol:string,sentiment_score:double>>").filter(_given(R("uuid"))).select("*", F.explode("r.entities").alias("e"))
    name = F.concat_ws("_", "source_id", R("uuid"), F.when(_given(F.col("e.symbol")), F.col("e.symbol")))
    return _sentiment(d, name, _day(R("published_at")), "news_sentiment", F.col("e.sentiment_score"), F.lit(""), _hash(R("title"), R("description")), F.col("e.symbol"))


def message_sentiment(p: DataFrame) -> DataFrame:
    d = records(p, "id sentiment body created_at").filter(_given(R("id")))
    score = F.when(R("sentiment") == "Bullish", 1.0).when(R("sentiment") == "Bearish", -1.0).otherwise(0.0)
    return _sentiment(d, F.concat_ws("_", "source_id", R("id")), _day(R("created_at")), "social_sentiment", score, F.coalesce(_first(R("sentiment")), F.lit("Neutral")), _hash(R("body")), F.col("subject"))


def analyst_estimates(p: DataFrame) -> DataFrame:
    d = records(p, "period strongBuy buy hold sell strongSell targetMean targetHigh targetLow").filter(_given(R("period")))
    return _facts(d, F.col("subject").alias("security_id"), _day(R("period")).alias("effective_date"), *[_count(R(a)).alias(b) for a, b in (("strongBuy", "strong_buy"), ("buy", "buy"), ("hold", "hold"), ("sell", "sell"), ("strongSell", "strong_sell"))], *[_num(R(f"target{x}")).alias(f"target_{x.lower()}") for x in ("Mean", "High", "Low")])


def _report(d: DataFrame, security: Column, session: Column) -> DataFrame:
    return _facts(d, security.alias("security_id"), _day(R("date")).alias("effective_date"), _day(R("date")).alias("report_date"), session.alias("session"))


def earnings_calendar(p: DataFrame) -> DataFrame:
    d = records(p, "code date time").filter(_given(R("code")) & _given(R("date")))
    when = F.lower(_text(R("time")))
    return _report(d, F.substring_index(R("code"), ".", 1), F.when(~when.contains("market"), "regular").when(when.contains("before"), "morning").otherwise("afternoon"))


def hour_earnings(p: DataFrame) -> DataFrame:
    d = records(p, "symbol date hour", under=("earningsCalendar",)).filter(_given(R("symbol")) & _given(R("date")))
    hour = F.lower(_text(R("hour")))
    return _report(d, R("symbol"), F.when(hour.isin("bmo", "am"), "morning").when(hour.isin("dmh", "amc", "pm"), "afternoon").otherwise("regular"))


def insider_tx(p: DataFrame) -> DataFrame:
    d = records(p, "year month change").filter(_given(R("year")) & _given(R("month")))
    change = F.coalesce(_num(R("change")), F.lit(0.0))
    return _facts(d, F.col("subject").alias("security_id"), F.concat(R("year"), F.lit("-"), F.lpad(R("month"), 2, "0"), F.lit("-01")).try_cast("date").alias("effective_date"), F.lit("").alias("filer_cik"), F.lit("").alias("issuer_cik"), F.when(change >= 0, "P").otherwise("S").alias("transaction_code"), F.greatest(change, F.lit(0.0)).alias("shares"), F.lit(0.0).alias("price"), F.lit(0.0).alias("value"))


def attention(p: DataFrame, cohort: str = "all-stocks") -> DataFrame:
    d = records(p, "mentions mentions_24h_ago upvotes rank rank_24h_ago name")
    return _facts(d, F.col("subject").alias("security_id"), _known_day().alias("effective_date"), F.lit(cohort).alias("cohort"), _count(R("mentions")).alias("mentions"), _count(R("mentions_24h_ago")).alias("mentions_24h_ago"), *[R(c).try_cast("long").alias(c) for c in ("upvotes", "rank", "rank_24h_ago")], _first(R("name")).alias("name"), parser=2)


def _statement(d: DataFrame, day: Column, fiscal: Column, kind: Column, measure: Column, statement: Column, item: Column, value: Column) -> DataFrame:
    at, none = F.col("available_at"), F.lit(None)
    return _facts(d, F.col("subject").alias("security_id"), day.alias("effective_date"), at.alias("source_published_at"), at.alias("ingested_at"), none.cast("timestamp").alias("validated_at"), fiscal.alias("fiscal_period"), kind.alias("period_kind"), day.alias("period_end"), measure.alias("measurement_kind"), statement.alias("statement_type"), item.alias("line_item"), value.alias("value"), F.lit("USD").alias("currency"), F.lit("USD").alias("source_currency"), F.lit("raw").alias("unit"), none.cast("long").alias("source_priority"))


def fundamentals(p: DataFrame) -> DataFrame:
    """Statement lists to long form. Quarters are called 'quarter', as the metrics read them."""
    item = "array<struct<dataCode:string,value:string>>"
    d = records(p, "year quarter date", f"statementData:struct<incomeStatement:{item},balanceSheet:{item},cashFlow:{item},overview:{item}>").filter(_given(R("year")) & _given(R("quarter")) & _given(R("date")))

    def named(statement: str):
        return lambda x: F.struct(F.lit(statement).alias("statement"), x.dataCode.alias("item"), x.value.alias("value"))

    parts = [F.transform(F.coalesce(R("statementData")[k], F.array().cast(item)), named(s)) for k, s in (("incomeStatement", "income_statement"), ("balanceSheet", "balance_sheet"), ("cashFlow", "cash_flow"), ("overview", "overview"))]
    d = d.select("*", F.explode(F.concat(*parts)).alias("x")).filter(_given(F.col("x.item")) & F.col("x.value").isNotNull())
    return _statement(d, _day(R("date")), F.concat(F.lit("FY"), R("year"), F.lit("Q"), R("quarter")), F.lit("quarter"), F.col("x.statement"), F.col("x.statement"), F.col("x.item"), F.coalesce(_num(F.col("x.value")), F.lit(0.0)))


#: Reported fields and their line items.
LINE_ITEMS = {
    "totalRevenue": "revenue", "grossProfit": "gross_profit", "costOfRevenue": "cost_of_revenue", "operatingIncome": "operating_income", "netIncome": "net_income", "ebit": "ebit", "ebitda": "ebitda",
    "researchAndDevelopment": "research_development", "sellingGeneralAndAdministrative": "selling_general_admin", "operatingExpenses": "operating_expense", "incomeTaxExpense": "income_tax_expense",
    "depreciationAndAmortization": "depreciation_amortization", "interestExpense": "interest_expense", "interestIncome": "interest_income", "netInterestIncome": "net_interest_income",
    "totalAssets": "total_assets", "totalCurrentAssets": "current_assets", "cashAndCashEquivalentsAtCarryingValue": "cash_and_equivalents", "inventory": "inventory", "currentNetReceivables": "accounts_receivable",
    "totalNonCurrentAssets": "non_current_assets", "propertyPlantEquipment": "property_plant_equipment", "totalLiabilities": "total_liabilities", "totalCurrentLiabilities": "current_liabilities",
    "shortTermDebt": "short_term_debt", "longTermDebt": "long_term_debt", "totalShareholderEquity": "total_equity", "retainedEarnings": "retained_earnings", "commonStockSharesOutstanding": "shares_outstanding",
    "currentAccountsPayable": "accounts_payable", "goodwill": "goodwill", "intangibleAssets": "intangible_assets", "currentDebt": "short_term_debt", "shortLongTermDebtTotal": "total_debt",
    "operatingCashflow": "operating_cash_flow", "capitalExpenditures": "capital_expenditure", "dividendPayout": "dividends_paid", "stockBasedCompensation": "stock_based_compensation",
    "cashflowFromInvestment": "investing_cash_flow", "cashflowFromFinancing": "financing_cash_flow", "depreciationDepletionAndAmortization": "depreciation_amortization", "changeInInventory": "change_in_inventory",
}
#: Overview fields and their line items.
OVERVIEW_ITEMS = {
    "MarketCapitalization": "market_capitalization", "EnterpriseValue": "enterprise_value", "PERatio": "pe_ratio", "EPS": "eps", "DividendYield": "dividend_yield", "BookValue": "book_value", "PriceToBookRatio": "pb_ratio",
    "Beta": "beta", "ProfitMargin": "profit_margin", "RevenueTTM": "revenue_ttm", "QuarterlyEarningsGrowthYOY": "earnings_growth_yoy", "QuarterlyRevenueGrowthYOY": "revenue_growth_yoy", "ReturnOnEquityTTM": "roe", "ReturnOnAssetsTTM": "roa",
}
_EARNINGS = {"reportedEPS": "reported_eps", "estimatedEPS": "estimated_eps", "surprise": "eps_surprise", "surprisePercentage": "eps_surprise_pct"}
_ESTIMATES = {"estimatedEPS": "estimated_eps", "estimatedRevenue": "estimated_revenue", "numberOfAnalysts": "analyst_count"}


def spread(payloads: DataFrame) -> DataFrame:
    """Payloads over as many tasks as there are cores, if their files make fewer: parsing large bodies takes
    longer than moving them. A table of many files stays as it is."""
    cores = payloads.sparkSession.sparkContext.defaultParallelism
    return payloads.repartition(cores) if payloads.rdd.getNumPartitions() < cores else payloads


def wide_fundamentals(p: DataFrame) -> DataFrame:
    """Wide reports to long form: three statements by quarter and year, overview, shares, earnings, estimates.
    A report is a map; a body is parsed and exploded once, and its fields meet the fixed list of line items."""
    reports = "array<map<string,string>>"
    sections = {"incomeStatement": ("quarterlyReports", "annualReports"), "balanceSheet": ("quarterlyReports", "annualReports"), "cashFlow": ("quarterlyReports", "annualReports"), "sharesOutstanding": ("quarterly", "annual"), "earnings": ("quarterlyEarnings", "annualEarnings"), "earningsEstimates": ("quarterly", "annual")}
    schema = "struct<" + ",".join(f"{s}:struct<{q}:{reports},{a}:{reports}>" for s, (q, a) in sections.items()) + ",overview:map<string,string>>"
    kinds = {"incomeStatement": ("income_statement", "flow", LINE_ITEMS), "balanceSheet": ("balance_sheet", "instant", LINE_ITEMS), "cashFlow": ("cash_flow", "flow", LINE_ITEMS), "sharesOutstanding": ("overview", "overview", {"sharesOutstanding": "shares_outstanding"}), "earnings": ("earnings", "earnings", _EARNINGS), "earningsEstimates": ("earnings", "earnings", _ESTIMATES)}

    fields = [(section, field, item, statement, measure) for section, (statement, measure, names) in kinds.items() for field, item in names.items()]
    fields += [("overview", field, item, "overview", "overview") for field, item in OVERVIEW_ITEMS.items()]
    p = spread(p)
    known_fields = p.sparkSession.createDataFrame(fields, "section string, field string, item string, statement string, measure string")

    def named(section: str, kind: str):
        return lambda r: F.struct(F.lit(section).alias("section"), F.lit(kind).alias("kind"), r.alias("report"))

    # the body is parsed once; an overview is one more report, dated by the day on which it was known
    found = [F.coalesce(F.transform(F.col("m")[section][key], named(section, kind)), F.array()) for section in kinds for key, kind in zip(sections[section], ("quarter", "fiscal_year"), strict=True)]
    found.append(F.transform(F.filter(F.array("m.overview"), lambda m: m.isNotNull()), named("overview", "snapshot")))
    d = whole(p, schema).select("*", F.explode(F.concat(*found)).alias("x")).drop("body", "m").select("*", "x.*").drop("x")
    d = d.withColumn("end", F.when(F.col("kind") == "snapshot", _known_day()).otherwise(_day(F.col("report")["fiscalDateEnding"]))).filter("end IS NOT NULL")
    # the dimension of fields is a fixed list; only its fields are tried as numbers, as the filter goes below the join
    listed = F.col("field").isin(*sorted({field for _, field, *_ in fields}))
    d = d.select("*", F.explode("report").alias("field", "raw")).drop("report").withColumn("number", _num(F.when(listed, F.col("raw")))).filter("number IS NOT NULL").drop("raw").join(F.broadcast(known_fields), ["section", "field"])
    quarter = F.when(F.col("kind") == "quarter", F.quarter("end")).otherwise(4)
    fiscal = F.when(F.col("kind") == "snapshot", "OVERVIEW").otherwise(F.concat(F.lit("FY"), F.year("end").cast("string"), F.lit("Q"), quarter.cast("string")))
    return _statement(d, F.col("end"), fiscal, F.col("kind"), F.col("measure"), F.col("statement"), F.col("item"), F.col("number"))


def _action(d: DataFrame, day: Column, kind: str, num: Column, den: Column, amount: Column, currency: Column) -> DataFrame:
    return _facts(d, F.col("subject").alias("security_id"), day.alias("effective_date"), F.lit(kind).alias("action_type"), num.cast("double").alias("ratio_numerator"), den.cast("double").alias("ratio_denominator"), amount.cast("double").alias("dividend_amount"), currency.cast("string").alias("dividend_currency"))


def historical_actions(p: DataFrame) -> DataFrame:
    """Dividends and splits a:b of one object; a bad date, amount or ratio is left out."""
    d = whole(p, "struct<dividends:struct<historical:array<struct<exDividendDate:string,dividendAmount:string,currency:string>>>,splits:struct<historical:array<struct<exDate:string,splitRatio:string>>>>")
    none = F.lit(None)
    div = d.select("*", F.explode("m.dividends.historical").alias("r"))
    div = _action(div, _day(R("exDividendDate")), "dividend", none, none, _num(R("dividendAmount")), F.coalesce(R("currency"), F.lit("USD"))).filter("effective_date IS NOT NULL AND dividend_amount IS NOT NULL")
    spl = d.select("*", F.explode("m.splits.historical").alias("r")).filter(R("splitRatio").contains(":"))
    parts = F.split(R("splitRatio"), ":", 2)
    spl = _action(spl, _day(R("exDate")), "split", _num(F.get(parts, F.lit(0))), _num(F.get(parts, F.lit(1))), none, none).filter("effective_date IS NOT NULL AND ratio_numerator IS NOT NULL AND ratio_denominator IS NOT NULL")
    return div.unionByName(spl)


def splits(p: DataFrame) -> DataFrame:
    """Ratios a:b or a/b; anything else is 1 to 1."""
    d = records(p, "date splitRatio split")
    parts = F.split(F.coalesce(_first(R("splitRatio"), R("split")), F.lit("")), "[:/]", 2)
    num, den = _num(F.get(parts, F.lit(0))), _num(F.get(parts, F.lit(1)))
    ok = num.isNotNull() & den.isNotNull()
    return _action(d, _day(R("date")), "split", F.when(ok, num).otherwise(1.0), F.when(ok, den).otherwise(1.0), F.lit(None), F.lit(None))


def dividends(p: DataFrame) -> DataFrame:
    d = records(p, "date dividend amount currency")
    return _action(d, _day(R("date")), "dividend", F.lit(None), F.lit(None), F.coalesce(_num(R("dividend")), _num(R("amount")), F.lit(0.0)), F.coalesce(R("currency"), F.lit("USD")))


def insider_transactions(p: DataFrame) -> DataFrame:
    d = records(p, "transaction_date executive executive_title acquisition_or_disposal shares share_price", under=("data",))
    kind = F.when(F.lower(_text(R("acquisition_or_disposal"))).startswith("acq"), "buy").otherwise("sell")
    day = _day(R("transaction_date"))
    return _facts(d, F.col("subject").alias("security_id"), day.alias("effective_date"), day.alias("transaction_date"), _text(R("executive")).alias("insider_name"), _text(R("executive_title")).alias("insider_title"), kind.alias("transaction_type"), _num(R("shares")).alias("shares"), F.coalesce(_num(R("share_price")), F.lit(0.0)).alias("price")).filter("effective_date IS NOT NULL AND shares IS NOT NULL")


def institutional_holdings(p: DataFrame) -> DataFrame:
    d = records(p, "date_reported holder shares value percent_change", under=("holdings",))
    day = _day(R("date_reported"))
    return _facts(d, F.col("subject").alias("security_id"), day.alias("effective_date"), _text(R("holder")).alias("holder_name"), _num(R("shares")).alias("shares"), _num(R("value")).alias("value"), day.alias("date_reported"), _num(R("percent_change")).alias("percent_change")).filter("effective_date IS NOT NULL AND shares IS NOT NULL")


def top_movers(p: DataFrame) -> DataFrame:
    kinds = ("top_gainers", "top_losers", "most_actively_traded")
    mover = "array<" + _struct("ticker price change_amount change_percentage volume") + ">"
    d = whole(p, "struct<" + ",".join(f"{k}:{mover}" for k in kinds) + ">")

    def named(kind: str):
        return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("x"))

    lists = [F.transform(F.coalesce(F.col("m")[k], F.array().cast(mover)), named(k)) for k in kinds]
    d = d.select("*", F.explode(F.concat(*lists)).alias("e")).select("*", F.col("e.kind").alias("kind"), F.col("e.x").alias("r")).filter(_given(R("ticker")))
    return _facts(d, R("ticker").alias("security_id"), _known_day().alias("effective_date"), F.col("kind").alias("mover_type"), _num(R("price")).alias("price"), _num(R("change_amount")).alias("change_amount"), _num(R("change_percentage")).alias("change_percent"), _num(R("volume")).alias("volume"))


def etf_profile(p: DataFrame) -> DataFrame:
    d = whole(p, _struct("symbol name net_assets expense_ratio dividend_yield")).filter(_given(F.col("m.symbol")))
    return _facts(d, F.col("subject").alias("security_id"), _known_day().alias("effective_date"), _first(F.col("m.name"), F.col("m.symbol")).alias("name"), F.lit("ETF").alias("asset_type"), *[_num(F.col(f"m.{c}")).alias(c) for c in ("net_assets", "expense_ratio", "dividend_yield")])


def ipo_calendar(p: DataFrame) -> DataFrame:
    d = records(p, "symbol companyName exchange date status", under=("ipoCalendar",)).filter(_given(R("symbol")))
    return _facts(d, R("symbol").alias("symbol"), F.coalesce(_day(R("date")), _known_day()).alias("effective_date"), _text(R("companyName")).alias("company_name"), _text(R("exchange")).alias("exchange"), _day(R("date")).alias("offer_date"), _text(R("status")).alias("status"))


def congress_trades(p: DataFrame) -> DataFrame:
    d = records(p, "transaction_id id ticker symbol politician politician_id transaction_date type direction amount amount_range")
    d = d.withColumns({"tx": _first(R("transaction_id"), R("id")), "sec": _first(R("ticker"), R("symbol"))}).filter("tx IS NOT NULL AND sec IS NOT NULL")
    return _facts(d, F.col("tx").alias("transaction_id"), F.coalesce(_first(R("politician"), R("politician_id")), F.lit("")).alias("politician_id"), F.col("sec").alias("security_id"), F.coalesce(_day(R("transaction_date")), _known_day()).alias("effective_date"), F.lower(F.coalesce(R("type"), R("direction"), F.lit(""))).alias("direction"), F.coalesce(R("amount"), R("amount_range"), F.lit("")).alias("amount_range"))


def social_posts(p: DataFrame, platform: str = "reddit") -> DataFrame:
    post = _struct("id title selftext subreddit", "created_utc:double", "ups:bigint", "num_comments:bigint")
    d = whole(p, f"struct<data:struct<children:array<struct<data:{post}>>>>").select("*", F.explode("m.data.children").alias("c")).select("*", F.col("c.data").alias("r")).filter(_given(R("id")))
    at = F.coalesce(F.when(R("created_utc") != 0, F.timestamp_seconds(R("created_utc"))), F.col("available_at"))
    zero = lambda c: F.coalesce(R(c), F.lit(0).cast("long"))
    return _facts(d, F.sha2(R("id"), 256).alias("post_id_hash"), F.to_date(at).alias("effective_date"), F.lit(platform).alias("platform"), _text(R("subreddit")).alias("venue"), F.lit(None).cast("string").alias("parent_id_hash"), _hash(R("title"), R("selftext")).alias("text_hash"), at.alias("published_at"), F.to_json(F.struct(zero("ups").alias("ups"), zero("num_comments").alias("comments"))).alias("engagement_json"))


#: Which normalizer reads a dataset's payloads, by (dataset, source) or, for other sources, by dataset.
NORMALIZERS: dict[tuple[str, str | None], Callable[[DataFrame], DataFrame]] = {
    ("macro_series", None): macro_series, ("macro_series", "alphav"): econ_indicator, ("economic_calendar", None): economic_calendar, ("lake_bars", None): bars, ("lake_bars", "yahoo"): chart_bars,
    ("news_articles", None): news, ("news_articles", "marketaux"): uuid_news, ("sentiment_annotations", None): news_sentiment, ("sentiment_annotations", "marketaux"): entity_sentiment, ("sentiment_annotations", "stocktwits"): message_sentiment,
    ("analyst_estimates", None): analyst_estimates, ("earnings_calendar", None): earnings_calendar, ("earnings_calendar", "finnhub"): hour_earnings, ("insider_tx", None): insider_tx, ("attention_metrics", None): attention,
    ("fundamentals", None): fundamentals, ("fundamentals", "alphav"): wide_fundamentals, ("corp_actions", None): splits, ("corp_actions", "alphav"): historical_actions, ("insider_transactions", None): insider_transactions,
    ("institutional_holdings", None): institutional_holdings, ("top_movers", None): top_movers, ("etf_profiles", None): etf_profile, ("ipo_calendar", None): ipo_calendar, ("congress_trades", None): congress_trades, ("social_posts", None): social_posts,
}


def normalizer(dataset: str, source_id: str | None = None) -> Callable[[DataFrame], DataFrame]:
    found = NORMALIZERS.get((dataset, source_id)) or NORMALIZERS.get((dataset, None))
    if not found:
        raise KeyError(f"no normalizer for {dataset}")
    return found
