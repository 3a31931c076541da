"""Fundamental metrics from versioned statement facts: quarters, trailing years, ratios, growth, valuation.

All securities run in one plan: newest facts, standalone quarters, trailing sums, one wide row a security,
and the metrics in long form."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pit import fundamental_metrics_asof, known

VERSION = "1.0.0"
FLOWS = ("revenue", "gross_profit", "operating_income", "ebitda", "net_income", "operating_cash_flow", "capital_expenditure", "diluted_eps")
INSTANTS = ("cash_and_equivalents", "short_term_debt", "long_term_debt", "total_debt", "current_assets", "current_liabilities", "total_equity")


def latest_facts(facts: DataFrame, as_of) -> DataFrame:
    """One row per reported number: the source with the lowest priority number, then the newest version."""
    keys = ["security_id", "period_kind", "period_end", "measurement_kind", "statement_type", "line_item"]
    order = [F.coalesce("source_priority", F.lit(999)), F.desc("available_at"), F.col("version_hash")]
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return known(facts, as_of).withColumn("__n", n).filter("__n = 1").drop("__n")


def with_fiscal(facts: DataFrame) -> DataFrame:
    """fy and q from the fiscal period; the year falls back to the period's end."""
    year = F.regexp_extract("fiscal_period", r"(20\d{2}|19\d{2})", 1)
    quarter = F.regexp_extract("fiscal_period", r"Q([1-4])", 1)
    return facts.withColumns({"fy": F.when(year != "", year.cast("int")).otherwise(F.year("period_end")), "q": F.when(quarter != "", quarter.cast("int"))})


def standalone_quarters(facts: DataFrame) -> DataFrame:
    """Quarterly flows, with Q4 as the fiscal year less its first three quarters where only it is missing:
    security_id, line_item, fy, q, value, period_end, available_at, currency, ends, hashes. Facts that call
    their quarters 'quarterly' count too."""
    f = with_fiscal(facts.filter("measurement_kind = 'flow'")).filter("value IS NOT NULL")
    cell = F.struct("available_at", "value", "period_end", "currency", "version_hash")
    is_q = F.col("period_kind").isin("quarter", "quarterly")
    keys = ["security_id", "line_item", "fy"]
    wide = f.groupBy(*keys).agg(*[F.max(F.when(is_q & (F.col("q") == k), cell)).alias(f"q{k}") for k in range(1, 5)], F.max(F.when(F.col("period_kind") == "fiscal_year", cell)).alias("year"))
    parts = [F.col(f"q{k}") for k in (1, 2, 3)] + [F.col("year")]
    can = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull() & parts[3].isNotNull()

    def given(k: int) -> Column:
        c = F.col(f"q{k}")
        return F.when(c.isNotNull(), F.struct(F.lit(k).alias("q"), c.value.alias("value"), c.period_end.alias("period_end"), c.available_at.alias("available_at"), c.currency.alias("currency"), F.array(c.period_end.cast("string")).alias("ends"), F.array(c.version_hash).alias("hashes")))

    currency = F.when((parts[0].currency == parts[3].currency) & (parts[1].currency == parts[3].currency) & (parts[2].currency == parts[3].currency), parts[3].currency)
    fourth = F.when(can, F.struct(F.lit(4).alias("q"), (parts[3].value - parts[0].value - parts[1].value - parts[2].value).alias("value"), parts[3].period_end.alias("period_end"), F.greatest(*[p.available_at for p in parts]).alias("available_at"), currency.alias("currency"), F.array(*[p.period_end.cast("string") for p in parts]).alias("ends"), F.array(*[p.version_hash for p in parts]).alias("hashes")))
    return wide.select(*keys, F.inline(F.array_compact(F.array(given(1), given(2), given(3), F.coalesce(given(4), fourth)))))


def trailing_years(quarters: DataFrame) -> DataFrame:
    """For each security and line item the sum of its last four quarters, if consecutive (``ago`` 0), and of
    the four before (``ago`` 1). Capital expenditure counts by size."""
    w = Window.partitionBy("security_id", "line_item").orderBy("fy", "q")
    four = w.rowsBetween(-3, 0)
    at = F.col("fy") * 4 + F.col("q")
    value = F.when(F.col("line_item") == "capital_expenditure", F.abs("value")).otherwise(F.col("value"))
    same = F.min("currency").over(four) == F.max("currency").over(four)
    d = quarters.withColumns({"at": at, "v": value})
    d = d.withColumns({"ttm": F.sum("v").over(four), "whole": (F.count("*").over(four) == 4) & (F.col("at") - F.min("at").over(four) == 3), "known_at": F.max("available_at").over(four), "one_currency": F.when(same & (F.count("currency").over(four) == 4), F.max("currency").over(four)), "all_ends": F.flatten(F.collect_list("ends").over(four)), "all_hashes": F.flatten(F.collect_list("hashes").over(four)), "back": F.row_number().over(Window.partitionBy("security_id", "line_item").orderBy(F.desc("fy"), F.desc("q")))})
    return d.filter("back IN (1, 5) AND whole").select("security_id", "line_item", ((F.col("back") - 1) / 4).cast("int").alias("ago"), F.col("ttm").alias("value"), "period_end", F.col("known_at").alias("available_at"), F.col("one_currency").alias("currency"), F.col("all_ends").alias("ends"), F.col("all_hashes").alias("hashes"))


def latest_instants(facts: DataFrame) -> DataFrame:
    """The newest balance of each line item."""
    best = F.max(F.struct("period_end", "available_at", "value", "currency", F.array(F.col("period_end").cast("string")).alias("ends"), F.array("version_hash").alias("hashes")))
    return facts.filter("measurement_kind = 'instant' AND value IS NOT NULL").groupBy("security_id", "line_item").agg(best.alias("b")).select("security_id", "line_item", "b.*")


def _combine(a: Column, b: Column, value: Column) -> Column:
    """A derived number of two others, null when either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(value.alias("value"), F.greatest(a.period_end, b.period_end).alias("period_end"), F.greatest(a.available_at, b.available_at).alias("available_at"), F.when(a.currency == b.currency, a.currency).alias("currency"), F.concat(a.ends, b.ends).alias("ends"), F.concat(a.hashes, b.hashes).alias("hashes")))


def _metric(metric_id: str, unit: str, basis: str, kind: str, item: Column, value: Column, state: Column, currency: Column) -> Column:
    category = metric_id.split(".")[1]
    return F.when(item.isNotNull(), F.struct(F.lit(metric_id).alias("metric_id"), F.lit(category).alias("category"), F.lit(kind).alias("period_kind"), item.period_end.alias("period_end"), item.available_at.alias("available_at"), value.cast("double").alias("value"), F.lit(unit).alias("unit"), currency.cast("string").alias("currency"), F.to_json(item.ends).alias("source_period_ends"), F.to_json(item.hashes).alias("source_version_hashes"), F.lit(basis).alias("calculation_basis"), state.alias("quality_status")))


def _plain(metric_id: str, kind: str, basis: str, item: Column) -> Column:
    return _metric(metric_id, "currency", basis, kind, item, item.value, F.lit("valid"), item.currency)


def _ratio(metric_id: str, a: Column, b: Column, basis: str, kind: str = "ttm", scale: float = 1.0) -> Column:
    """a / b; a divisor that isn't positive has no meaning."""
    ok = b.value > 0
    return _metric(metric_id, "percent" if scale == 100 else "multiple", basis, kind, _combine(a, b, a.value), F.when(ok, F.try_divide(a.value, b.value) * scale), F.when(ok, "valid").otherwise("not_meaningful"), F.lit(None))


def _growth(metric_id: str, now: Column, then: Column, basis: str) -> Column:
    ok = then.value > 0
    return _metric(metric_id, "percent", basis, "ttm", _combine(now, then, now.value), F.when(ok, (F.try_divide(now.value, then.value) - 1) * 100), F.when(ok, "valid").otherwise("not_meaningful"), F.lit(None))


def period_metrics(facts: DataFrame, as_of) -> DataFrame:
    """The eighteen period metrics of every security, one row each where their inputs exist."""
    f = latest_facts(facts, as_of)
    ttm, mrq = trailing_years(standalone_quarters(f)), latest_instants(f)
    cell = F.struct("value", "period_end", "available_at", "currency", "ends", "hashes")
    pick = lambda item, ago: F.first(F.when((F.col("line_item") == item) & (F.col("ago") == ago), cell), ignorenulls=True)
    flows = ttm.groupBy("security_id").agg(*[pick(i, 0).alias(i) for i in FLOWS], *[pick(i, 1).alias(f"{i}_ago") for i in ("revenue", "diluted_eps", "ebitda")])
    stocks = mrq.groupBy("security_id").agg(*[F.first(F.when(F.col("line_item") == i, cell), ignorenulls=True).alias(i) for i in INSTANTS])
    d = flows.join(stocks, "security_id", "full")
    c = {n: F.col(n) for n in (*FLOWS, *INSTANTS)}
    d = d.withColumn("fcf", _combine(c["operating_cash_flow"], c["capital_expenditure"], c["operating_cash_flow"].value - c["capital_expenditure"].value))
    d = d.withColumn("debt", F.coalesce(c["total_debt"], _combine(c["short_term_debt"], c["long_term_debt"], c["short_term_debt"].value + c["long_term_debt"].value)))
    d = d.withColumn("net_debt", _combine(F.col("debt"), c["cash_and_equivalents"], F.col("debt.value") - c["cash_and_equivalents"].value))
    p = "fundamentals."
    metrics = [
        _plain(p + "scale.revenue_ttm", "ttm", "sum of four quarters", c["revenue"]),
        _plain(p + "scale.ebitda_ttm", "ttm", "sum of four quarters", c["ebitda"]),
        *[_ratio(p + f"profitability.{n}_margin_ttm", c[i], c["revenue"], f"{i}_ttm / revenue_ttm * 100", scale=100.0) for n, i in (("gross", "gross_profit"), ("operating", "operating_income"), ("ebitda", "ebitda"), ("net", "net_income"))],
        _ratio(p + "profitability.fcf_margin_ttm", F.col("fcf"), c["revenue"], "free_cash_flow_ttm / revenue_ttm * 100", scale=100.0),
        _ratio(p + "cash_flow_quality.cfo_to_net_income_ttm", c["operating_cash_flow"], c["net_income"], "operating_cash_flow_ttm / net_income_ttm"),
        _ratio(p + "cash_flow_quality.fcf_conversion_ttm", F.col("fcf"), c["net_income"], "free_cash_flow_ttm / net_income_ttm"),
        *[_growth(p + f"growth.{n}_yoy_ttm", c[i], F.col(f"{i}_ago"), f"{i}_ttm / {i}_ttm_1y_ago - 1") for n, i in (("revenue", "revenue"), ("eps_diluted", "diluted_eps"), ("ebitda", "ebitda"))],
        _plain(p + "financial_health.cash_and_equivalents_mrq", "mrq", "latest balance", c["cash_and_equivalents"]),
        _plain(p + "financial_health.total_debt_mrq", "mrq", "latest balance", F.col("debt")),
        _plain(p + "financial_health.net_debt_mrq", "mrq", "total_debt_mrq - cash_and_equivalents_mrq", F.col("net_debt")),
        _ratio(p + "financial_health.net_debt_to_ebitda_ttm", F.col("net_debt"), c["ebitda"], "net_debt_mrq / ebitda_ttm"),
        _ratio(p + "financial_health.current_ratio_mrq", c["current_assets"], c["current_liabilities"], "current_assets_mrq / current_liabilities_mrq", "mrq"),
        _ratio(p + "financial_health.debt_to_equity_mrq", F.col("debt"), c["total_equity"], "total_debt_mrq / total_equity_mrq", "mrq"),
    ]
    return d.select("security_id", F.inline(F.array_compact(F.array(*metrics)))).withColumns({"metric_version": F.lit(VERSION), "calculation_version": F.lit(VERSION), "source_id": F.lit("derived")})


def estimate_metrics(estimates: DataFrame, earnings: DataFrame, as_of) -> DataFrame:
    """(security_id, metric_id, value, available_at): price targets and the share of buy ratings of the newest
    estimate, and the days to the next report after ``as_of``."""
    newest = known(estimates, as_of).groupBy("security_id").agg(F.max(F.struct("effective_date", "available_at", "strong_buy", "buy", "hold", "sell", "strong_sell", "target_mean", "target_high", "target_low")).alias("e")).select("security_id", "e.*")
    total = F.col("strong_buy") + F.col("buy") + F.col("hold") + F.col("sell") + F.col("strong_sell")
    p = "fundamentals.estimates."
    items = [F.struct(F.lit(p + n).alias("metric_id"), v.cast("double").alias("value")) for n, v in (("target_price", F.col("target_mean")), ("target_high", F.col("target_high")), ("target_low", F.col("target_low")), ("buy_ratio", F.when(total > 0, (F.col("strong_buy") + F.col("buy")) / total.cast("double") * 100)))]
    out = newest.select("security_id", "available_at", F.inline(F.array(*items))).filter("value IS NOT NULL").select("security_id", "metric_id", "value", "available_at")
    today = F.lit(as_of).cast("date")
    following = known(earnings, as_of).filter(F.col("report_date") > today).groupBy("security_id").agg(F.min(F.struct("report_date", "available_at")).alias("n"))
    return out.unionByName(following.select("security_id", F.lit("fundamentals.events.days_to_earnings").alias("metric_id"), F.datediff("n.report_date", today).cast("double").alias("value"), F.col("n.available_at").alias("available_at")))


#: Valuation metrics and the per-share inputs that they divide a price by.
VALUATION = {
    "fundamentals.valuation.price_to_earnings_ttm": "fundamentals.profitability.diluted_eps_ttm",
    "fundamentals.valuation.price_to_sales_ttm": "fundamentals.scale.revenue_per_share_ttm",
    "fundamentals.valuation.price_to_fcf_ttm": "fundamentals.cash_flow_quality.fcf_per_share_ttm",
}


def widened(metric_ids: list[str] | None) -> list[str] | None:
    """Metric ids to read for a request: a valuation needs its input."""
    return None if metric_ids is None else list(dict.fromkeys([*metric_ids, *[VALUATION[m] for m in metric_ids if m in VALUATION]]))


def metrics_with_valuation(metrics: DataFrame, bars: DataFrame, as_of, priorities: DataFrame | None = None, metric_ids: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """Metrics as of a time, and prices divided by their per-share inputs; inputs read only for that are left
    out. bars: one per cell. State of a valuation: unavailable without a price or in another currency than
    USD, not_meaningful for an input that isn't positive."""
    wide = None if categories is None else list({*categories, *({"profitability", "scale", "cash_flow_quality"} if "valuation" in categories else ())})
    read = fundamental_metrics_asof(metrics, as_of, priorities, categories=wide, metric_ids=widened(metric_ids)).select("security_id", "metric_id", "category", "period_end", "available_at", "value", "unit", "currency", "quality_status")
    price = known(bars, as_of).groupBy("security_id").agg(F.max(F.struct("effective_date", "close", F.col("available_at").alias("priced_at"))).alias("price"))
    wanted = {v: i for v, i in VALUATION.items() if metric_ids is None or v in metric_ids} if categories is None or "valuation" in categories else {}
    shown = read if metric_ids is None else read.filter(F.col("metric_id").isin(metric_ids))
    shown = shown if categories is None else shown.filter(F.col("category").isin(categories))
    if not wanted:
        return shown
    names = F.create_map(*[F.lit(x) for v, i in wanted.items() for x in (i, v)])
    inputs = read.filter(F.col("metric_id").isin(list(wanted.values()))).join(price, "security_id", "left")
    none, foreign, low = F.col("price").isNull(), F.col("currency").isNotNull() & (F.col("currency") != "USD"), F.coalesce(F.col("value") <= 0, F.lit(True))
    state = F.when(none | foreign, "unavailable").when(low, "not_meaningful").otherwise("valid")
    valued = inputs.select("security_id", names[F.col("metric_id")].alias("metric_id"), F.lit("valuation").alias("category"), "period_end", F.when(none, F.lit(as_of).cast("timestamp")).otherwise(F.greatest("available_at", "price.priced_at")).alias("available_at"), F.when(state == "valid", F.try_divide(F.col("price.close"), F.col("value"))).alias("value"), F.lit("multiple").alias("unit"), F.lit(None).cast("string").alias("currency"), state.alias("quality_status"))
    return shown.unionByName(valued)


def glossary(spark: SparkSession, text: str) -> DataFrame:
    """(metric_id, unit, profile_id, method, bands) from TOML: the dimension of metrics, some dozen rows."""
    raw = tomllib.loads(text)
    rows = []
    for metric, (unit, profile) in raw["metric"].items():
        told = raw["profile"][profile]
        rows.append((metric, unit, profile, told["method"], [(b["state"], b["tone"], b["state"].replace("_", " "), b.get("min"), b.get("max")) for b in told["bands"]]))
    return spark.createDataFrame(rows, "metric_id string, unit string, profile_id string, method string, bands array<struct<state:string,tone:string,label:string,lo:double,hi:double>>")


#: States, tones and labels of a metric's place among its peers.
PEER_BANDS = ((0.75, "top_quartile", "green", "top quartile of peers"), (0.25, "mid_range", "neutral", "middle of peers"), (0.0, "bottom_quartile", "red", "bottom quartile of peers"))


def with_peers(metrics: DataFrame, groups: DataFrame, least: int = 5) -> DataFrame:
    """Each metric's place among the values that its peer group has of it: peer_count (others with a value),
    peer_percentile (the share of them that are lower; null without a value or with fewer than ``least`` of
    them) and the state, tone and label of its quartile. groups: security_id, peer_group; a security without
    a group, or with a null one, has no peers. Equal values share the lowest place. Values are counted
    before they are ranked, so a task ranks the distinct values of a metric in a group, not its rows."""
    given = metrics.join(groups.filter("peer_group IS NOT NULL").dropDuplicates(["security_id"]), "security_id", "left")
    keys = ["metric_id", "peer_group"]
    counts = given.filter("value IS NOT NULL AND peer_group IS NOT NULL").groupBy(*keys, "value").agg(F.count("*").alias("n"))
    own = Window.partitionBy(*keys)
    below = F.coalesce(F.sum("n").over(own.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select(*keys, "value", below.alias("below"), (F.sum("n").over(own) - 1).alias("others"))
    d = given.join(placed, [*keys, "value"], "left")
    enough = F.col("others") >= least
    share = F.when(enough, F.try_divide("below", "others"))
    band = F.when(F.col("value").isNull(), F.struct(F.lit("unavailable").alias("state"), F.lit("gray").alias("tone"), F.lit("unavailable").alias("label")))
    band = band.when(~F.coalesce(enough, F.lit(False)), F.struct(F.lit("raw_value").alias("state"), F.lit("gray").alias("tone"), F.lit("raw value (peer data insufficient)").alias("label")))
    for low, state, tone, label in PEER_BANDS:
        band = band.when(share >= low, F.struct(F.lit(state).alias("state"), F.lit(tone).alias("tone"), F.lit(label).alias("label")))
    return d.select(*metrics.columns, "peer_group", F.coalesce("others", F.lit(0).cast("long")).alias("peer_count"), share.alias("peer_percentile"), band.state.alias("peer_state"), band.tone.alias("peer_tone"), band.label.alias("peer_label"))


def with_display(metrics: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """A state and a printed value, and, given the ``glossary``, the threshold's state, tone and label: the
    first band with lo <= value < hi; a metric whose profile only gives context is contextual, one that is
    ranked among peers shows its raw value, since no peer table exists. No value is unavailable."""
    shown = F.when(F.col("value").isNull(), "n/a").when(F.col("unit") == "percent", F.format_string("%.2f%%", "value")).when(F.col("unit") == "multiple", F.format_string("%.2fx", "value")).otherwise(F.format_string("%.2f", "value"))
    d = metrics.withColumns({"state": F.when(F.col("value").isNull(), F.col("quality_status")).otherwise("available"), "display_value": shown})
    if dimension is None:
        return d
    fits = F.get(F.filter("bands", lambda x: (x.lo.isNull() | (F.col("value") >= x.lo)) & (x.hi.isNull() | (F.col("value") < x.hi))), F.lit(0))
    gray = lambda state, label: F.struct(F.lit(state).alias("state"), F.lit("gray").alias("tone"), F.lit(label).alias("label"))
    band = F.when(F.col("value").isNull(), gray("unavailable", "unavailable")).when(F.col("method") == "context", gray("contextual", "contextual")).when(F.col("method") == "peer_percentile", gray("raw_value", "raw value (peer data insufficient)"))
    band = band.when(fits.isNull() & F.col("method").isNotNull(), gray("available", "available")).when(fits.isNotNull(), F.struct(fits.state.alias("state"), fits.tone.alias("tone"), fits.label.alias("label")))
    d = d.join(F.broadcast(dimension.select("metric_id", "profile_id", "method", "bands")), "metric_id", "left").withColumn("band", band)
    return d.select(*[c for c in d.columns if c not in ("bands", "band", "method")], F.col("band.state").alias("threshold_state"), F.col("band.tone").alias("threshold_tone"), F.col("band.label").alias("threshold_label"))
