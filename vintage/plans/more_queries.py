"""More registered queries: fundamentals, readouts, panels, normalizers, archive and streaming."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import functions as F

from ..operators import fundamentals, identity, panels, pit, readouts
from ..sources import archive, normalize
from . import views
from .queries import BARS, BEST, MASTER, W, best, lagged, query, roll, rounded
from .views import AS_OF


def shared_folder(spark, name: str) -> str:
    """A new path in the folder that the driver and all executors share, spark.checkpoint.dir."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


CELLS = f"""cells AS (SELECT security_id, fy, q, sum(total) AS rev, coalesce(sum(CASE WHEN segment IN ('BUILDING', 'AUTOMOBILE') THEN total END), 0) AS gp, coalesce(sum(CASE segment WHEN 'BUILDING' THEN total END), 0) AS oi,
    coalesce(sum(CASE segment WHEN 'FURNITURE' THEN total END), 0) - coalesce(sum(CASE segment WHEN 'AUTOMOBILE' THEN total END), 0) / 2 AS ni, coalesce(sum(CASE segment WHEN 'HOUSEHOLD' THEN total END), 0) AS cfo, coalesce(sum(CASE segment WHEN 'MACHINERY' THEN total END), 0) AS debt
    FROM ({views.FUNDAMENTALS_SQL}) f GROUP BY 1, 2, 3)"""


def facts(spark, sf_dir):
    """Statement facts of each nation: quarters known 40 days after their end. Nations with an even number
    report the year instead of the fourth quarter."""
    cells = views.view(spark, sf_dir, f"WITH {CELLS} SELECT * FROM cells", "orders", "customer")
    even = F.substring_index("security_id", "_", -1).cast("int") % 2 == 0
    items = {"revenue": "rev", "gross_profit": "gp", "operating_income": "oi", "ebitda": "oi + rev / 7", "net_income": "ni", "operating_cash_flow": "cfo", "capital_expenditure": "-debt / 4", "diluted_eps": "ni / 1000000"}
    stock = {"cash_and_equivalents": "cfo", "total_debt": "debt", "current_assets": "gp", "current_liabilities": "oi", "total_equity": "rev - debt"}

    def long(d, pairs, measure):
        return d.select("*", F.inline(F.array(*[F.struct(F.lit(i).alias("line_item"), F.expr(e).cast("double").alias("value")) for i, e in pairs.items()])), F.lit(measure).alias("measurement_kind"))

    flows = long(cells, items, "flow")
    year = flows.groupBy("security_id", "fy", "line_item", "measurement_kind").agg(F.sum("value").alias("value"), F.max("q").alias("q")).filter("q = 4").withColumn("period_kind", F.lit("fiscal_year"))
    quarter = flows.filter(~(even & (F.col("q") == 4))).withColumn("period_kind", F.lit("quarter"))
    instant = long(cells, stock, "instant").withColumn("period_kind", F.lit("quarter"))
    cols = ["security_id", "fy", "q", "line_item", "value", "measurement_kind", "period_kind"]
    f = quarter.select(cols).unionByName(year.select(cols)).unionByName(instant.select(cols))
    end = F.last_day(F.make_date("fy", F.col("q") * 3, F.lit(1)))
    f = f.withColumns({"period_end": end, "available_at": F.date_add(end, 40).cast("timestamp"), "fiscal_period": F.concat(F.lit("FY"), F.col("fy").cast("string"), F.lit("Q"), F.col("q").cast("string")), "statement_type": F.lit("x"), "currency": F.lit("USD"), "source_priority": F.lit(None).cast("long")})
    return f.withColumn("version_hash", F.sha2(F.concat_ws("|", "security_id", "line_item", "fiscal_period", "period_kind"), 256))


@query(f"""WITH {CELLS}, k AS (SELECT *, fy * 4 + q AS ix FROM cells c WHERE CAST(last_day(make_date(CAST(fy AS INT), CAST(q * 3 AS INT), 1)) AS TIMESTAMP) + INTERVAL 40 DAY <= TIMESTAMP '{AS_OF}'
      AND (q < 4 OR CAST(split_part(security_id, '_', 2) AS INT) % 2 = 1 OR (SELECT count(*) FROM cells d WHERE d.security_id = c.security_id AND d.fy = c.fy AND d.q < 4) = 3)),
    t AS (SELECT security_id, ix, (count(*) OVER w) = 4 AND ix - (min(ix) OVER w) = 3 AS ok, sum(rev) OVER w AS rev, sum(gp) OVER w AS gp, sum(oi) OVER w AS oi, sum(ni) OVER w AS ni, sum(cfo) OVER w AS cfo, (sum(debt) OVER w) / 4 AS capex,
      row_number() OVER (PARTITION BY security_id ORDER BY ix DESC) AS back FROM k WINDOW w AS (PARTITION BY security_id ORDER BY ix ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
    n AS (SELECT * FROM t WHERE back = 1 AND ok), p AS (SELECT * FROM t WHERE back = 5 AND ok), m AS (SELECT DISTINCT ON (security_id) * FROM cells WHERE CAST(last_day(make_date(CAST(fy AS INT), CAST(q * 3 AS INT), 1)) AS TIMESTAMP) + INTERVAL 40 DAY <= TIMESTAMP '{AS_OF}' ORDER BY security_id, fy DESC, q DESC)
    SELECT security_id, 'fundamentals.scale.revenue_ttm' AS metric_id, round(rev, 4) AS value, 'valid' AS quality_status FROM n
    UNION ALL SELECT security_id, 'fundamentals.profitability.gross_margin_ttm', round(CASE WHEN rev > 0 THEN gp / rev * 100 END, 4), CASE WHEN rev > 0 THEN 'valid' ELSE 'not_meaningful' END FROM n
    UNION ALL SELECT security_id, 'fundamentals.profitability.fcf_margin_ttm', round(CASE WHEN rev > 0 THEN (cfo - capex) / rev * 100 END, 4), CASE WHEN rev > 0 THEN 'valid' ELSE 'not_meaningful' END FROM n
    UNION ALL SELECT security_id, 'fundamentals.cash_flow_quality.cfo_to_net_income_ttm', round(CASE WHEN ni > 0 THEN cfo / ni END, 4), CASE WHEN ni > 0 THEN 'valid' ELSE 'not_meaningful' END FROM n
    UNION ALL SELECT n.security_id, 'fundamentals.growth.revenue_yoy_ttm', round(CASE WHEN p.rev > 0 THEN (n.rev / p.rev - 1) * 100 END, 4), CASE WHEN p.rev > 0 THEN 'valid' ELSE 'not_meaningful' END FROM n JOIN p ON n.security_id = p.security_id
    UNION ALL SELECT n.security_id, 'fundamentals.financial_health.net_debt_to_ebitda_ttm', round(CASE WHEN n.oi + n.rev / 7 > 0 THEN (m.debt - m.cfo) / (n.oi + n.rev / 7) END, 4), CASE WHEN n.oi + n.rev / 7 > 0 THEN 'valid' ELSE 'not_meaningful' END FROM n JOIN m ON n.security_id = m.security_id
    UNION ALL SELECT security_id, 'fundamentals.financial_health.current_ratio_mrq', round(CASE WHEN oi > 0 THEN gp / oi END, 4), CASE WHEN oi > 0 THEN 'valid' ELSE 'not_meaningful' END FROM m""")
def fundamental_metrics(spark, sf_dir):
    shown = ["scale.revenue_ttm", "profitability.gross_margin_ttm", "profitability.fcf_margin_ttm", "cash_flow_quality.cfo_to_net_income_ttm", "growth.revenue_yoy_ttm", "financial_health.net_debt_to_ebitda_ttm", "financial_health.current_ratio_mrq"]
    got = fundamentals.period_metrics(facts(spark, sf_dir), AS_OF).filter(F.col("metric_id").isin([f"fundamentals.{s}" for s in shown]))
    return rounded(got.select("security_id", "metric_id", "value", "quality_status"), 4)


ESTIMATES = "SELECT concat('sec_', CAST(o_custkey % 100 AS STRING)) AS security_id, CAST(o_orderdate AS DATE) AS effective_date, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY AS available_at, max(o_orderkey) % 7 AS strong_buy, max(o_orderkey) % 5 AS buy, max(o_orderkey) % 3 AS hold, max(o_orderkey) % 2 AS sell, CAST(0 AS BIGINT) AS strong_sell, max(o_totalprice) AS target_mean FROM orders GROUP BY 1, 2, 3"
REPORTS = "SELECT DISTINCT concat('sec_', CAST(o_custkey % 100 AS STRING)) AS security_id, CAST(o_orderdate AS DATE) AS report_date, TIMESTAMP '1992-01-01 00:00:00' AS available_at FROM orders"


@query(f"""WITH e AS ({ESTIMATES}), n AS (SELECT DISTINCT ON (security_id) * FROM e WHERE available_at <= TIMESTAMP '1997-06-30 00:00:00' ORDER BY security_id, effective_date DESC), r AS ({REPORTS})
    SELECT security_id, 'fundamentals.estimates.target_price' AS metric_id, round(target_mean, 4) AS value FROM n
    UNION ALL SELECT security_id, 'fundamentals.estimates.buy_ratio', round((strong_buy + buy)::DOUBLE / (strong_buy + buy + hold + sell) * 100, 4) FROM n WHERE strong_buy + buy + hold + sell > 0
    UNION ALL SELECT security_id, 'fundamentals.events.days_to_earnings', CAST(min(report_date) - DATE '1997-06-30' AS DOUBLE) FROM r WHERE report_date > DATE '1997-06-30' GROUP BY 1""")
def estimate_metrics(spark, sf_dir):
    views.load(spark, sf_dir, "orders")
    none = F.lit(None).cast("double")
    got = fundamentals.estimate_metrics(spark.sql(ESTIMATES).withColumns({"target_high": none, "target_low": none}), spark.sql(REPORTS), "1997-06-30 00:00:00")
    return rounded(got.select("security_id", "metric_id", "value"), 4)


@query(f"""{BEST}, p AS (SELECT security_id, arg_max(close, effective_date) AS close FROM best GROUP BY 1), i AS (SELECT concat('sec_', CAST(s_suppkey AS STRING)) AS security_id, s_acctbal / 100 AS eps FROM supplier)
    SELECT i.security_id, round(CASE WHEN p.close IS NOT NULL AND eps > 0 THEN p.close / eps END, 4) AS value, CASE WHEN p.close IS NULL THEN 'unavailable' WHEN eps <= 0 THEN 'not_meaningful' ELSE 'valid' END AS quality_status FROM i LEFT JOIN p ON i.security_id = p.security_id""")
def valuation(spark, sf_dir):
    """Price over earnings of each security, from per-share inputs."""
    inputs = views.view(spark, sf_dir, "SELECT concat('sec_', CAST(s_suppkey AS STRING)) AS security_id, s_acctbal / 100 AS value FROM supplier", "supplier")
    m = inputs.selectExpr("security_id", "'fundamentals.profitability.diluted_eps_ttm' AS metric_id", "'profitability' AS category", "DATE '1998-03-31' AS period_end", "TIMESTAMP '1998-05-01 00:00:00' AS available_at", "value", "'currency' AS unit", "'USD' AS currency", "'valid' AS quality_status", "'x' AS source_id", "'' AS version_hash")
    got = fundamentals.metrics_with_valuation(m, best(spark, sf_dir), AS_OF, metric_ids=["fundamentals.valuation.price_to_earnings_ttm"])
    return rounded(got.select("security_id", "value", "quality_status"), 4)


def profiles():
    return readouts.load_profiles((Path(__file__).resolve().parents[2] / "config/threshold_profiles.toml").read_text())


@query(f"""{BEST}, b AS (SELECT *, {lagged('close')} AS pc, {lagged('close', 10)} AS p10, {lagged('close', 21)} AS p21, row_number() OVER ({W}) AS n, row_number() OVER (PARTITION BY security_id ORDER BY effective_date DESC) AS back,
      {roll('max', 'close', 20)} AS hi, {roll('min', 'close', 20)} AS lo FROM best), l AS (SELECT * FROM b WHERE back = 1),
    h AS (SELECT b.security_id, avg(CASE WHEN (b.high - b.low) / b.close < (l.high - l.low) / l.close THEN 1.0::DOUBLE ELSE 0 END) AS below, any_value(l.n) AS n, any_value((l.high - l.low) / l.close) AS v FROM b JOIN l ON b.security_id = l.security_id GROUP BY 1),
    d AS (SELECT security_id, CASE WHEN n >= 2 THEN (close - pc) / pc END AS v FROM l), g AS (SELECT security_id, CASE WHEN n >= 2 THEN (open - pc) / pc END AS v FROM l),
    m AS (SELECT security_id, CASE WHEN n >= 22 THEN (close / p10 - 1 + close / p21 - 1) / 2 END AS v FROM l), k AS (SELECT security_id, CASE WHEN n >= 21 THEN (close - lo) / nullif(hi - lo, 0) END AS v FROM l)
    SELECT security_id, 'price_action.daily_move' AS definition_id, round(v, 6) AS value, CASE WHEN v IS NULL THEN 'unavailable' WHEN v BETWEEN -0.005 AND 0.005 THEN 'flat' WHEN v >= 0.005 THEN 'up' ELSE 'down' END AS state FROM d
    UNION ALL SELECT security_id, 'price_action.gap', round(v, 6), CASE WHEN v IS NULL THEN 'unavailable' WHEN v BETWEEN -0.003 AND 0.003 THEN 'no_gap' WHEN v >= 0.003 THEN 'gap_up' ELSE 'gap_down' END FROM g
    UNION ALL SELECT security_id, 'momentum.quality', round(v, 6), CASE WHEN v IS NULL THEN 'unavailable' WHEN v >= 0.001 THEN 'constructive' WHEN v <= -0.001 THEN 'weak' ELSE 'neutral' END FROM m
    UNION ALL SELECT security_id, 'market_regime.breakout_state', round(v, 4), CASE WHEN v IS NULL THEN 'unavailable' ELSE 'range' END FROM k
    UNION ALL SELECT security_id, 'price_action.intraday_volatility', round(CASE WHEN n >= 2 THEN v END, 6), CASE WHEN n < 2 THEN 'unavailable' WHEN below <= 0.2 THEN 'low' WHEN below BETWEEN 0.21 AND 0.7 THEN 'normal' WHEN below BETWEEN 0.71 AND 0.9 THEN 'elevated' WHEN below >= 0.91 THEN 'extreme' ELSE 'unavailable' END FROM h""")
def readout_states(spark, sf_dir):
    """Five readouts of all securities that plain SQL states shortly."""
    got = readouts.compute(best(spark, sf_dir), AS_OF, profiles())
    return got.filter(F.col("definition_id").isin("price_action.daily_move", "price_action.gap", "momentum.quality", "market_regime.breakout_state", "price_action.intraday_volatility")).select("security_id", "definition_id", "value", "state")


@query(f"""{BEST}, x AS (SELECT *, {lagged('close')} AS pc FROM best) SELECT security_id, max(effective_date) AS last_date, arg_max(close, effective_date) AS last_close, round(arg_max(close, effective_date) / arg_max(pc, effective_date) - 1, 6) AS change_pct,
    round(max(high), 6) AS max_high, round(min(low), 6) AS min_low, count(*) AS n_bars FROM x GROUP BY 1""")
def price_summary(spark, sf_dir):
    got = panels.price_summary(best(spark, sf_dir), AS_OF)
    return rounded(got.select("security_id", "last_date", "last_close", "change_pct", "max_high", "min_low", "n_bars"))


@query(f"{BARS} SELECT security_id, effective_date, source_id, available_at FROM bars WHERE available_at <= TIMESTAMP '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY security_id, source_id ORDER BY effective_date DESC, available_at DESC) <= 10")
def newest_rows(spark, sf_dir):
    return panels.newest_rows(views.bars(spark, sf_dir), AS_OF, 10, ("security_id", "source_id")).select("security_id", "effective_date", "source_id", "available_at")


@query(f"WITH m AS ({MASTER}), h AS (SELECT symbol, security_id, name, CASE WHEN starts_with(symbol, 'SYM1') THEN 0 WHEN contains(symbol, 'SYM1') OR contains(upper(name), 'SYM1') THEN 1 END AS rank FROM m WHERE effective_start <= DATE '1994-01-01' AND (effective_end IS NULL OR effective_end >= DATE '1994-01-01')) SELECT symbol, security_id, rank FROM h WHERE rank IS NOT NULL ORDER BY rank, symbol, security_id LIMIT 20")
def symbol_search(spark, sf_dir):
    views.load(spark, sf_dir, "supplier")
    return identity.search(spark.sql(MASTER), "sym1", "1994-01-01").select("symbol", "security_id", "rank")


PAYLOADS = "SELECT concat('[', array_join(collect_list(to_json(named_struct('date', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'open', value, 'high', value + 1, 'low', value - 1, 'close', value, 'volume', event_id))), ','), ']') AS body, concat('sec_', CAST(user_id AS STRING)) AS subject FROM events GROUP BY user_id"


def payloads(spark, sf_dir):
    """One JSON body per user, as a bar payload."""
    p = views.view(spark, sf_dir, PAYLOADS, "events")
    return p.withColumns({"source_id": F.lit("eodhd"), "source_fetch_id": F.sha2("subject", 256), "ingestion_run_id": F.lit("run"), "content_hash": archive.content_hash(F.col("body")), "available_at": F.lit("1998-01-01").cast("timestamp")})


@query("SELECT concat('sec_', CAST(user_id AS STRING)) AS security_id, CAST(ts AS DATE) AS effective_date, value AS close, value + 1 AS high, event_id AS volume FROM events")
def normalized_bars(spark, sf_dir):
    got = normalize.normalizer("lake_bars", "eodhd")(payloads(spark, sf_dir))
    return rounded(got.select("security_id", "effective_date", "close", "high", "volume"))


@query(f"WITH m AS ({views.MACRO_SQL}) SELECT series_id, effective_date, round(value, 4) AS value FROM m WHERE available_at <= TIMESTAMP '1996-01-01 00:00:00'")
def macro_series_asof(spark, sf_dir):
    return rounded(pit.macro_series_asof(views.view(spark, sf_dir, views.MACRO_SQL, "orders"), "1996-01-01 00:00:00").select("series_id", "effective_date", "value"), 4)
