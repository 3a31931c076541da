"""Registered queries of metrics, readouts and panels in full, and their DuckDB SQL.

Nested results are shown as text: elements joined by commas, fields by colons, doubles as ten-thousandths."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.exprs import finite
from ..operators import derived, fundamentals, indicators, panels, readouts
from . import indicator_sql, views
from .indicator_sql import OFF, W, div, lag, over, roll
from .more_queries import CELLS, REPORTS, facts, profiles, shared_folder
from .queries import BEST, ORACLE_SQL, QUERIES, RECURSIVE_BEST, best, query, rounded
from .views import AS_OF, BENCHMARK

CONFIG = Path(__file__).resolve().parents[2] / "config"


def dimension(spark):
    return fundamentals.glossary(spark, (CONFIG / "fundamental_metrics.toml").read_text())


# ---- fundamentals -------------------------------------------------------------------------------------

FLOWS = {"revenue": "rev", "gross_profit": "gp", "operating_income": "oi", "ebitda": "oi + rev / 7", "net_income": "ni", "operating_cash_flow": "cfo", "capital_expenditure": "debt / 4", "diluted_eps": "ni / 1000000"}
STOCKS = {"cash_and_equivalents": "cfo", "total_debt": "debt", "current_assets": "gp", "current_liabilities": "oi", "total_equity": "rev - debt"}


def _end(q: str = "q", fy: str = "fy") -> str:
    return f"CAST(last_day(make_date(CAST({fy} AS INT), CAST({q} * 3 AS INT), 1)) AS DATE)"


def _hashed(item: str, q: str, kind: str) -> str:
    return f"sha256(concat_ws('|', security_id, {item}, 'FY' || fy || 'Q' || {q}, '{kind}'))"


def _items(pairs: dict[str, str]) -> str:
    return f"unnest([{', '.join(f"'{i}'" for i in pairs)}]) AS item, unnest([{', '.join(pairs.values())}]) AS value"


_derived = "q = 4 AND CAST(split_part(security_id, '_', 2) AS INT) % 2 = 0"
_KNOWN = f"CAST({_end()} AS TIMESTAMP) + INTERVAL 40 DAY <= TIMESTAMP '{AS_OF}'"
_PICK = ", ".join(f"any_value(t) FILTER (WHERE item = '{i}' AND back = 1) AS {i}" for i in FLOWS) + ", " + ", ".join(f"any_value(t) FILTER (WHERE item = '{i}' AND back = 5) AS {i}_ago" for i in ("revenue", "diluted_eps", "ebitda"))
_both = lambda a, b, v: f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {{'value': {v}, 'pe': greatest({a}.pe, {b}.pe), 'at': greatest({a}.at, {b}.at), 'ends': {a}.ends || {b}.ends, 'hashes': {a}.hashes || {b}.hashes}} END"
#: Of each security the trailing years (ago: one year before), the newest balances, free cash flow and net debt.
METRIC_STEPS = f"""{CELLS}, q0 AS (SELECT c.*, fy * 4 + q AS ix, {_derived} AS derived FROM cells c WHERE {_KNOWN} AND (NOT ({_derived}) OR (SELECT count(*) FROM cells d WHERE d.security_id = c.security_id AND d.fy = c.fy AND d.q < 4) = 3)),
    q1 AS (SELECT security_id, fy, q, ix, derived, {_items(FLOWS)} FROM q0),
    q2 AS (SELECT *, {_end()} AS pe, CASE WHEN derived THEN [{_end('1')}, {_end('2')}, {_end('3')}, {_end('4')}] ELSE [{_end()}] END AS ends, CASE WHEN derived THEN [{_hashed('item', '1', 'quarter')}, {_hashed('item', '2', 'quarter')}, {_hashed('item', '3', 'quarter')}, {_hashed('item', '4', 'fiscal_year')}] ELSE [{_hashed('item', 'q', 'quarter')}] END AS hashes FROM q1),
    q3 AS (SELECT security_id, item, pe, count(*) OVER w AS n, ix - min(ix) OVER w AS gap, {{'value': sum(value) OVER w, 'pe': pe, 'at': CAST(pe AS TIMESTAMP) + INTERVAL 40 DAY, 'ends': flatten(list(ends) OVER w), 'hashes': flatten(list(hashes) OVER w)}} AS t, row_number() OVER (PARTITION BY security_id, item ORDER BY ix DESC) AS back FROM q2 WINDOW w AS (PARTITION BY security_id, item ORDER BY ix ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
    flows AS (SELECT security_id, {_PICK} FROM q3 WHERE n = 4 AND gap = 3 GROUP BY 1),
    s1 AS (SELECT security_id, fy, q, {_items(STOCKS)} FROM (SELECT * FROM cells WHERE {_KNOWN} QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY fy DESC, q DESC) = 1)),
    s2 AS (SELECT security_id, item, {{'value': value, 'pe': {_end()}, 'at': CAST({_end()} AS TIMESTAMP) + INTERVAL 40 DAY, 'ends': [{_end()}], 'hashes': [{_hashed('item', 'q', 'quarter')}]}} AS t FROM s1),
    stocks AS (SELECT security_id, {', '.join(f"any_value(t) FILTER (WHERE item = '{i}') AS {i}" for i in STOCKS)} FROM s2 GROUP BY 1),
    m0 AS (SELECT * FROM flows FULL JOIN stocks USING (security_id)),
    m AS (SELECT *, {_both('operating_cash_flow', 'capital_expenditure', 'operating_cash_flow.value - capital_expenditure.value')} AS fcf, {_both('total_debt', 'cash_and_equivalents', 'total_debt.value - cash_and_equivalents.value')} AS net_debt FROM m0)"""


def _row(metric: str, kind: str, item: str, value: str, unit: str, currency: str, basis: str, state: str) -> str:
    sign = {"percent": "%", "multiple": "x", "currency": ""}[unit]
    v = f"CAST({value} AS DOUBLE)"
    return f"""SELECT security_id, 'fundamentals.{metric}' AS metric_id, '{metric.split('.')[0]}' AS category, '{kind}' AS period_kind, x.pe AS period_end, x.at AS available_at, round({v} + {OFF}, 4) AS value, '{unit}' AS unit, CAST({currency} AS VARCHAR) AS currency,
        '["' || array_to_string(x.ends, '","') || '"]' AS source_period_ends, '["' || array_to_string(x.hashes, '","') || '"]' AS source_version_hashes, '{basis}' AS calculation_basis, {state} AS quality_status, '1.0.0' AS metric_version, '1.0.0' AS calculation_version, 'derived' AS source_id,
        CASE WHEN {v} IS NULL THEN {state} ELSE 'available' END AS state, coalesce(printf('%.2f{sign * 2 if sign == '%' else sign}', {v}), 'n/a') AS display_value FROM (SELECT *, {item} AS x FROM m) WHERE x IS NOT NULL"""


def _plain(metric: str, kind: str, item: str, basis: str) -> str:
    return _row(metric, kind, item, "x.value", "currency", "'USD'", basis, "'valid'")


def _ratio(metric: str, a: str, b: str, basis: str, kind: str = "ttm", scale: int = 1) -> str:
    return _row(metric, kind, _both(a, b, f"{a}.value"), f"CASE WHEN {b}.value > 0 THEN {a}.value / {b}.value * {scale} END", "percent" if scale == 100 else "multiple", "NULL", basis, f"CASE WHEN {b}.value > 0 THEN 'valid' ELSE 'not_meaningful' END")


def _growth(name: str, item: str) -> str:
    return _row(f"growth.{name}_yoy_ttm", "ttm", _both(item, f"{item}_ago", f"{item}.value"), f"CASE WHEN {item}_ago.value > 0 THEN ({item}.value / {item}_ago.value - 1) * 100 END", "percent", "NULL", f"{item}_ttm / {item}_ttm_1y_ago - 1", f"CASE WHEN {item}_ago.value > 0 THEN 'valid' ELSE 'not_meaningful' END")


METRICS_SQL = " UNION ALL ".join([
    _plain("scale.revenue_ttm", "ttm", "revenue", "sum of four quarters"), _plain("scale.ebitda_ttm", "ttm", "ebitda", "sum of four quarters"),
    *[_ratio(f"profitability.{n}_margin_ttm", i, "revenue", f"{i}_ttm / revenue_ttm * 100", scale=100) for n, i in (("gross", "gross_profit"), ("operating", "operating_income"), ("ebitda", "ebitda"), ("net", "net_income"))],
    _ratio("profitability.fcf_margin_ttm", "fcf", "revenue", "free_cash_flow_ttm / revenue_ttm * 100", scale=100), _ratio("cash_flow_quality.cfo_to_net_income_ttm", "operating_cash_flow", "net_income", "operating_cash_flow_ttm / net_income_ttm"), _ratio("cash_flow_quality.fcf_conversion_ttm", "fcf", "net_income", "free_cash_flow_ttm / net_income_ttm"),
    _growth("revenue", "revenue"), _growth("eps_diluted", "diluted_eps"), _growth("ebitda", "ebitda"),
    _plain("financial_health.cash_and_equivalents_mrq", "mrq", "cash_and_equivalents", "latest balance"), _plain("financial_health.total_debt_mrq", "mrq", "total_debt", "latest balance"), _plain("financial_health.net_debt_mrq", "mrq", "net_debt", "total_debt_mrq - cash_and_equivalents_mrq"),
    _ratio("financial_health.net_debt_to_ebitda_ttm", "net_debt", "ebitda", "net_debt_mrq / ebitda_ttm"), _ratio("financial_health.current_ratio_mrq", "current_assets", "current_liabilities", "current_assets_mrq / current_liabilities_mrq", "mrq"), _ratio("financial_health.debt_to_equity_mrq", "total_debt", "total_equity", "total_debt_mrq / total_equity_mrq", "mrq"),
])


@query(f"WITH {METRIC_STEPS} {METRICS_SQL}")
def fundamental_metrics_all(spark, sf_dir):
    """All metrics with their lineage and display values."""
    got = fundamentals.with_display(fundamentals.period_metrics(facts(spark, sf_dir), AS_OF))
    return got.withColumn("value", F.round(F.col("value") + OFF, 4))


_bands = {  # of the discrete profiles among the eighteen
    "cash_flow_quality": ((0.5, "low", "amber"), (1.0, "median_range", "gray"), (None, "high", "gray")), "growth": ((-1.0, "contracting", "red"), (1.0, "stable", "gray"), (None, "expanding", "green")), "net_debt_to_ebitda_ttm": ((2.0, "low", "gray"), (4.0, "median_range", "amber"), (None, "high", "red")),
    "current_ratio_mrq": ((1.0, "low", "red"), (2.0, "median_range", "amber"), (None, "high", "gray")), "debt_to_equity_mrq": ((0.5, "low", "gray"), (2.0, "median_range", "amber"), (None, "high", "red")),
}


def _banded(field: int) -> str:
    one = lambda bands: "CASE " + " ".join(f"WHEN value < {b[0]} THEN '{b[field]}'" if b[0] is not None else f"ELSE '{b[field]}'" for b in bands) + " END"
    return "CASE WHEN value IS NULL THEN '" + ("unavailable", "gray")[field - 1] + "' " + " ".join(f"WHEN contains(metric_id, '.{k}') THEN {one(b)}" for k, b in _bands.items()) + f" ELSE '{('contextual', 'gray')[field - 1]}' END"


@query(f"WITH {METRIC_STEPS}, a AS ({METRICS_SQL}) SELECT security_id, metric_id, {_banded(1)} AS threshold_state, {_banded(2)} AS threshold_tone, replace({_banded(1)}, '_', ' ') AS threshold_label FROM a")
def fundamental_states(spark, sf_dir):
    """Metrics classified by the bands of their threshold profiles."""
    got = fundamentals.with_display(fundamentals.period_metrics(facts(spark, sf_dir), AS_OF), dimension(spark))
    return got.select("security_id", "metric_id", "threshold_state", "threshold_tone", "threshold_label")


_INPUTS = {"price_to_earnings_ttm": ("profitability.diluted_eps_ttm", "s_acctbal / 100", "USD"), "price_to_sales_ttm": ("scale.revenue_per_share_ttm", "s_acctbal / 10 + 1", "USD"), "price_to_fcf_ttm": ("cash_flow_quality.fcf_per_share_ttm", "s_acctbal / 50", "EUR")}
_PER_SHARE = " UNION ALL ".join(f"SELECT concat('sec_', CAST(s_suppkey AS STRING)) AS security_id, 'fundamentals.{i}' AS metric_id, '{i.split('.')[0]}' AS category, CAST({v} AS DOUBLE) AS value, '{c}' AS currency FROM supplier" for i, v, c in _INPUTS.values())


@query(f"""{BEST}, p AS (SELECT security_id, arg_max(close, effective_date) AS close FROM best GROUP BY 1), i AS ({_PER_SHARE}),
    v AS (SELECT i.security_id, CASE {' '.join(f"WHEN metric_id = 'fundamentals.{i}' THEN 'fundamentals.valuation.{n}'" for n, (i, _, _) in _INPUTS.items())} END AS metric_id, value, close, CASE WHEN close IS NULL OR currency <> 'USD' THEN 'unavailable' WHEN value <= 0 THEN 'not_meaningful' ELSE 'valid' END AS quality_status FROM i LEFT JOIN p ON i.security_id = p.security_id)
    SELECT security_id, metric_id, 'valuation' AS category, CASE WHEN quality_status = 'valid' THEN round(close / value + {OFF}, 4) END AS value, quality_status FROM v""")
def valuation_category(spark, sf_dir):
    """All valuations of a request by category, whose inputs are read but not returned."""
    views.load(spark, sf_dir, "supplier")
    m = spark.sql(_PER_SHARE).selectExpr("*", "DATE '1998-03-31' AS period_end", "TIMESTAMP '1998-05-01 00:00:00' AS available_at", "'currency' AS unit", "'valid' AS quality_status", "'x' AS source_id", "'' AS version_hash")
    got = fundamentals.metrics_with_valuation(m, best(spark, sf_dir), AS_OF, categories=["valuation"])
    return got.select("security_id", "metric_id", "category", F.round(F.col("value") + OFF, 4).alias("value"), "quality_status")


# ---- readouts -----------------------------------------------------------------------------------------

_five = over(5)
_slope5 = lambda c: f"CASE WHEN count({c}) {_five} = 5 THEN (2 * {c} + {lag(c)} - {lag(c, 3)} - 2 * {lag(c, 4)}) / 10 END"  # noqa: E731  least squares over five equally spaced rows
_ok = lambda c: f"CASE WHEN NOT isnan({c}) AND NOT isinf({c}) THEN {c} END"
_bench = f"SELECT effective_date, {div('close', lag('close'))} - 1 AS m1, {div('close', lag('close', 21))} - 1 AS m21 FROM best WHERE security_id = '{BENCHMARK}'"
READOUT_STEPS = f"""{indicator_sql.steps('best', BENCHMARK)}, mk AS ({_bench}),
    y0 AS (SELECT w.*, mk.m1, mk.m21, {_ok(div('high - low', 'close'))} AS h_range, {_ok(div('realized_vol_21', 'realized_vol_63'))} AS h_vol, abs(close - pc) AS step, row_number() OVER (PARTITION BY security_id ORDER BY effective_date DESC) AS back FROM wide w LEFT JOIN mk USING (effective_date)),
    y1 AS (SELECT *, {roll('avg', 'step', 14)} AS h_move, {_ok(div('1 + ' + roll('sum', 'ret', 21), '1 + ' + roll('sum', 'm1', 21)) + ' - 1')} AS rs21, {_ok(div('close', lag('close', 10)) + ' - 1')} AS roc10, {_ok(div('close', lag('close', 21)) + ' - 1')} AS roc21, {_slope5('v')} AS v_slope, avg(v) {_five} AS v_mean5, {roll('max', 'close', 20)} AS hi20, {roll('min', 'close', 20)} AS lo20 FROM y0),
    y AS MATERIALIZED (SELECT *, {_slope5('rs21')} AS rs_slope FROM y1), nw AS (SELECT * FROM y WHERE back = 1)"""
VALUES = {
    "price_action.daily_move": "(close - pc) / nullif(pc, 0)", "price_action.intraday_volatility": "h_range", "price_action.gap": "(open - pc) / nullif(pc, 0)", "trend.regime": "adx_14", "trend.directional_bias": "di_plus_14 - di_minus_14", "trend.strength": "adx_14", "momentum.rsi_14": "rsi_14",
    "momentum.macd_cross": "macd - macd_ema", "momentum.quality": "(roc10 + roc21) / 2", "volatility.atr_percent": "atr_pct", "volatility.bollinger_width": "bandwidth", "volatility.regime": "h_vol", "participation.rvol": "rvol",
    "participation.volume_trend": "CASE WHEN v_mean5 <> 0 THEN v_slope / v_mean5 WHEN v_slope IS NOT NULL THEN 0.0 END", "market_regime.breakout_state": "(close - lo20) / nullif(hi20 - lo20, 0)", "market_regime.keltner_touch": "CASE WHEN keltner_middle <> 0 THEN (close - keltner_middle) / nullif((keltner_upper - keltner_lower) / 2, 0) END",
    "relative_strength.vs_benchmark": "CASE WHEN m21 > -1 THEN (1 + roc21) / nullif(1 + m21, 0) - 1 END", "relative_strength.regime": "rs_slope",
}
HISTORY = {"h_range": "h_range", "h_move": "h_move", "h_atr": "atr_pct", "h_width": "bandwidth", "h_vol": "h_vol", "h_rvol": "rvol"}


def _band(bands, value: str) -> str:
    tests = [(b.state, " AND ".join(x for x in (f"{value} >= {b.lo}" if b.lo is not None else "", f"{value} <= {b.hi}" if b.hi is not None else "") if x) or "TRUE") for b in bands]
    return "CASE " + " ".join(f"WHEN {t} THEN '{s}'" for s, t in tests) + " END" if tests else "CAST(NULL AS VARCHAR)"


def readout_sql(name: str) -> str:
    r, p = readouts.READOUTS[name], profiles()[name]
    past = HISTORY.get(r.ranked)
    below = f"(SELECT avg(CASE WHEN {past} IS NULL OR isnan({past}) OR isinf({past}) THEN NULL WHEN {past} < nw.x THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM y h WHERE h.security_id = nw.security_id)" if past else "CAST(NULL AS DOUBLE)"
    zone = _band(p.zones, "abs(v)" if name == "market_regime.keltner_touch" else "v")
    by_rank = f"CASE WHEN below IS NOT NULL THEN {_band(p.percentiles, 'below')} END" if p.percentiles and r.ranked else "CAST(NULL AS VARCHAR)"
    state = {"discrete": zone, "percentile": by_rank, "combined": f"coalesce(CASE WHEN {by_rank} IS NOT NULL THEN {zone} END, {by_rank}, {zone})"}[p.method]
    short = f"n < {r.lookback}" if r.ranked else "FALSE"
    sign = lambda x: f"CASE WHEN {x} > 0 THEN 'upward' WHEN {x} < 0 THEN 'downward' ELSE 'mixed' END"
    way = {"none": "'not_applicable'", "sign": sign("v"), "fifty": sign("v - 50"), "state": "state", "both": "CASE WHEN roc10 > 0 AND roc21 > 0 THEN 'upward' WHEN roc10 < 0 AND roc21 < 0 THEN 'downward' ELSE 'mixed' END", "breakout": "CASE state WHEN 'breaking_out' THEN 'upward' WHEN 'reversing' THEN 'downward' ELSE 'mixed' END"}[r.orientation]
    among = lambda states: f"state IN ({', '.join(f"'{s}'" for s in states)})" if states else "FALSE"
    inner = f"SELECT security_id, rn AS n, roc10, roc21, x, CASE WHEN rn >= {r.lookback} THEN x END AS v, {below} AS below FROM (SELECT *, {_ok(f'CAST({VALUES[name]} AS DOUBLE)')} AS x FROM nw) nw"
    stated = f"SELECT *, CASE WHEN v IS NULL OR {short} THEN 'unavailable' ELSE coalesce({state}, 'unavailable') END AS state FROM ({inner})"
    return f"""SELECT security_id, '{name}' AS definition_id, round(v + {OFF}, {min(r.places, 4)}) AS value, state, CASE WHEN v IS NULL THEN 'not_applicable' ELSE {way} END AS orientation, CASE WHEN {among(r.attention)} THEN 'elevated' ELSE 'normal' END AS attention,
        CASE WHEN state = 'blown' THEN 'extreme' WHEN {among(r.risk)} THEN 'elevated' ELSE 'normal' END AS risk, CASE WHEN state = '{r.good}' THEN 'green' WHEN {among(readouts.GRAY)} THEN 'gray' WHEN {among(r.bad)} THEN 'red' WHEN {among(r.amber)} THEN 'amber' ELSE 'gray' END AS color FROM ({stated})"""


def readouts_all(spark, sf_dir):
    """All eighteen readouts of all securities."""
    b = best(spark, sf_dir)
    got = readouts.compute(b, AS_OF, profiles(), b.filter(F.col("security_id") == BENCHMARK), places=12)
    places = F.element_at(F.create_map(*[F.lit(x) for n, r in readouts.READOUTS.items() for x in (n, min(r.places, 4))]), F.col("definition_id"))
    two, four = F.round(F.col("value") + OFF, 2), F.round(F.col("value") + OFF, 4)
    return got.withColumn("value", F.when(places == 2, two).otherwise(four))


QUERIES["readouts_all"] = readouts_all
ORACLE_SQL["readouts_all"] = f"{RECURSIVE_BEST}, {READOUT_STEPS} " + " UNION ALL ".join(readout_sql(n) for n in readouts.READOUTS)


# ---- panels -------------------------------------------------------------------------------------------


def cents(c: Column) -> Column:
    """A double as whole ten-thousandths, in text."""
    return F.round(c * 10000 + 0.1234).cast("long").cast("string")


def told(nested: str, *fields: Column | str) -> Column:
    """A nested array as text."""
    one = lambda x: F.concat_ws(":", *[F.coalesce(cents(x[f[1:]]) if f.startswith("~") else x[f].cast("string"), F.lit("-")) for f in fields])
    return F.array_join(F.transform(nested, one), ",")


_cents = lambda c: f"CAST(CAST(round(({c}) * 10000 + 0.1234) AS BIGINT) AS VARCHAR)"
_finite = lambda c: f"CASE WHEN isnan({c}) OR isinf({c}) THEN NULL ELSE {c} END"
SUMMARY = """px AS (SELECT *, lag(close) OVER (PARTITION BY security_id ORDER BY effective_date) AS prev, row_number() OVER (PARTITION BY security_id ORDER BY effective_date DESC) AS back FROM best),
    ps AS (SELECT security_id, max(effective_date) AS last_date, arg_max(close, effective_date) AS last_close, any_value(prev) FILTER (WHERE back = 1) AS prev_close, arg_min(close, effective_date) AS first_close, max(high) AS max_high, min(low) AS min_low, count(*) AS n_bars FROM px GROUP BY 1)"""
_CARD = ("sma_20", "rsi_14", "atr_pct")


@query(f"""{RECURSIVE_BEST}, {indicator_sql.steps('best')}, {SUMMARY}, tr AS (SELECT security_id, string_agg({_cents('close')}, ',' ORDER BY effective_date) AS trend FROM px WHERE back <= 120 GROUP BY 1),
    li AS (SELECT security_id, {', '.join(f"arg_max({_finite(c)}, effective_date) FILTER (WHERE {_finite(c)} IS NOT NULL) AS {c}" for c in _CARD)} FROM wide GROUP BY 1)
    SELECT security_id, last_date, last_close, prev_close, first_close, max_high, min_low, n_bars, round(last_close / prev_close - 1 + {OFF}, 4) AS change_pct, trend, {', '.join(f'round({c} + {OFF}, 4) AS {c}' for c in _CARD)} FROM ps JOIN tr USING (security_id) JOIN li USING (security_id)""")
def summary_cards(spark, sf_dir):
    """Price summary, trend and newest indicators of each security."""
    b = best(spark, sf_dir)
    got = panels.summary_card(b, indicators.finite_indicators(b).select("security_id", "effective_date", *_CARD), AS_OF)
    return got.withColumns({"trend": F.array_join(F.transform("trend", cents), ","), **{c: F.round(F.col(c) + OFF, 4) for c in ("change_pct", *_CARD)}})


_day = f"CAST(TIMESTAMP '{AS_OF}' AS DATE)"
_PARTS = {
    "indicators": f"SELECT security_id, effective_date || ':' || {_cents('sma_20')} || ':' || {_cents('e12')} || ':' || {_cents('rsi_14')} AS x, effective_date AS o, row_number() OVER ({W} DESC) AS back FROM wide",
    "insider": f"SELECT security_id, effective_date || ':' || transaction_code || ':' || {_cents('value')} AS x, (effective_date, transaction_code, value) AS o, row_number() OVER ({W} DESC, available_at DESC, event_id DESC) AS back FROM ({views.INSIDER_SQL}) i WHERE available_at <= TIMESTAMP '{AS_OF}'",
    "earnings": f"SELECT security_id, report_date || ':regular' AS x, report_date AS o, 1 AS back FROM ({REPORTS}) r WHERE report_date BETWEEN {_day} AND {_day} + 90",
    "attention": f"SELECT security_id, effective_date || ':' || sum(mentions) AS x, effective_date AS o, 1 AS back FROM ({views.ATTENTION_SQL}) a WHERE available_at <= TIMESTAMP '{AS_OF}' AND effective_date >= {_day} - 30 GROUP BY security_id, effective_date",
}
_LIMIT = {"indicators": 1, "insider": 10, "earnings": 1, "attention": 1}


def stored(spark, df, name: str):
    """A table written once in the folder that executors share, and read by all that follows."""
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@query(f"""{RECURSIVE_BEST}, {READOUT_STEPS}, {SUMMARY}, {', '.join(f"p_{n} AS (SELECT security_id, string_agg(x, ',' ORDER BY o) AS {n} FROM ({sql}) WHERE back <= {_LIMIT[n]} GROUP BY 1)" for n, sql in _PARTS.items())},
    ro AS ({" UNION ALL ".join(readout_sql(n) for n in readouts.READOUTS)}), p_readouts AS (SELECT security_id, string_agg(definition_id || ':' || state, ',' ORDER BY definition_id) AS readouts FROM ro GROUP BY 1)
    SELECT security_id, last_date, last_close, n_bars, indicators, insider, earnings, attention, readouts, concat_ws(',', {', '.join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n in (*_PARTS, 'readouts'))}) AS missing, CASE WHEN attention IS NOT NULL THEN 'attention' ELSE '' END AS experimental, CAST({_day} - last_date AS INT) AS days_since_bar
    FROM ps {' '.join(f'LEFT JOIN p_{n} USING (security_id)' for n in (*_PARTS, 'readouts'))}""")
def decision_panel(spark, sf_dir):
    """Nested facts of each security, all from one table of indicators."""
    b = stored(spark, best(spark, sf_dir), "panel-bars")
    insider = views.view(spark, sf_dir, views.INSIDER_SQL, "events")
    attention = views.view(spark, sf_dir, views.ATTENTION_SQL, "events")
    views.load(spark, sf_dir, "orders")
    earnings = spark.sql(REPORTS).withColumn("session", F.lit("regular"))
    bench = b.filter(F.col("security_id") == BENCHMARK)
    shown = ("sma_20", "ema_12", "rsi_14")
    # only what is read below is computed and stored
    wide = indicators.compute_all(b, AS_OF, bench, carry=indicators.PRICES).select("security_id", "effective_date", "available_at", *indicators.PRICES, *dict.fromkeys((*readouts.INPUTS, *shown)))
    ind = stored(spark, wide, "panel-indicators")
    read = readouts.compute(b, AS_OF, profiles(), bench, computed=ind)
    got = panels.decision_panel(b.select("security_id"), b, AS_OF, indicators=ind.select("security_id", "effective_date", "available_at", *shown), insider=insider, earnings=earnings, attention=attention, readouts=read)
    text = {"indicators": told("indicators", "effective_date", "~sma_20", "~ema_12", "~rsi_14"), "insider": told("insider", "effective_date", "transaction_code", "~value"), "earnings": told("earnings", "report_date", "session"), "attention": told("attention", "effective_date", "mentions"), "readouts": told("readouts", "definition_id", "state"), "missing": F.array_join("missing", ","), "experimental": F.array_join("experimental", ",")}
    return got.withColumns(text).select("security_id", "last_date", "last_close", "n_bars", *text, "days_since_bar")


@query(f"""WITH a0 AS ({views.ATTENTION_SQL}), a AS (SELECT security_id, effective_date, CAST(sum(mentions) AS BIGINT) AS mentions FROM a0 GROUP BY 1, 2), d0 AS (SELECT *, lag(mentions) OVER (PARTITION BY security_id, cohort ORDER BY effective_date) AS pm FROM a0),
    d AS (SELECT security_id, effective_date, avg(CASE WHEN pm <> 0 THEN (mentions - pm) / pm::DOUBLE * 100 END) AS delta FROM d0 GROUP BY 1, 2), s AS ({views.SENTIMENT_SQL}), sd AS (SELECT security_id, effective_date, avg(CASE sentiment_label WHEN 'Bullish' THEN 1.0::DOUBLE ELSE 0 END) AS bu, avg(CASE sentiment_label WHEN 'Bearish' THEN 1.0::DOUBLE ELSE 0 END) AS be FROM s GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY effective_date DESC) = 1),
    t AS (SELECT security_id, string_agg(mentions, ',' ORDER BY effective_date) AS trend FROM (SELECT *, row_number() OVER ({W} DESC) AS back FROM a) WHERE back <= 30 GROUP BY 1), l AS (SELECT DISTINCT ON (security_id) * FROM a ORDER BY security_id, effective_date DESC)
    SELECT l.security_id, l.effective_date, l.mentions, round(delta + {OFF}, 4) AS mention_delta_pct, round(bu + {OFF}, 4) AS bullish, round(be + {OFF}, 4) AS bearish, CASE WHEN bu IS NOT NULL THEN round(greatest(0.0::DOUBLE, 1 - bu - be) + {OFF}, 4) END AS neutral, trend
    FROM l LEFT JOIN d ON l.security_id = d.security_id AND l.effective_date = d.effective_date LEFT JOIN sd ON l.security_id = sd.security_id LEFT JOIN t ON l.security_id = t.security_id ORDER BY l.mentions DESC, l.security_id LIMIT 25""")
def attention_leaderboard(spark, sf_dir):
    """The 25 securities with most mentions on their latest day, with deltas, sentiment split and trend."""
    attention = views.view(spark, sf_dir, views.ATTENTION_SQL, "events")
    sentiment = derived.sentiment_split(views.view(spark, sf_dir, views.SENTIMENT_SQL, "labels"), "2100-01-01")
    got = panels.attention_leaderboard(attention, derived.attention_deltas(attention, "2100-01-01"), sentiment, "2100-01-01")
    return got.withColumns({"trend": F.array_join(F.col("trend").cast("array<string>"), ","), **{c: F.round(F.col(c) + OFF, 4) for c in ("mention_delta_pct", "bullish", "bearish", "neutral")}})
