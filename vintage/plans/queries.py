"""Registered queries over the test tables, and the DuckDB SQL that checks them.

Every query reads whole tables. Doubles are rounded to six places on both sides, since engines add in
different orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import finite, half_up
from ..operators import adjust, calendar, derived, identity, indicators, pit, quality, versions
from . import indicator_sql, views
from .views import AS_OF, BENCHMARK

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Columns that both engines get by equal operations on equal inputs: exact, so they aren't rounded.
EXACT = ("open", "high", "low", "close", "raw_close", "true_range", "pivot_high", "pivot_low", "last_close")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(finite(c), places).alias(c) if t == "double" and c not in EXACT else F.col(c) for c, t in df.dtypes])


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.bars_asof(views.bars(spark, sf_dir), AS_OF, views.priorities(spark))


W = "PARTITION BY security_id ORDER BY effective_date"
PRIORITY = "CASE source_id WHEN 'src_n' THEN 0 WHEN 'src_a' THEN 1 ELSE 999 END"
BARS = f"WITH bars AS ({views.BARS_SQL})"
BEST = f"""{BARS}, best AS (SELECT * EXCLUDE (n) FROM (
    SELECT *, row_number() OVER (PARTITION BY security_id, effective_date ORDER BY {PRIORITY}, available_at DESC, source_id) AS n
    FROM bars WHERE available_at <= TIMESTAMP '{AS_OF}' AND effective_date <= CAST(TIMESTAMP '{AS_OF}' AS DATE)) WHERE n = 1)"""
PRICES = "open, high, low, close"


def roll(agg: str, c: str, n: int) -> str:
    over = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({c}) {over} = {n} THEN {agg}({c}) {over} END)"


def lagged(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) OVER ({W})"


@query(f"{BEST} SELECT security_id, effective_date, close, round({roll('avg', 'close', 20)}, 6) AS sma_20 FROM best")
def bars_asof_sma(spark, sf_dir):
    return rounded(best(spark, sf_dir).select("security_id", "effective_date", "close", indicators.sma(20).alias("sma_20")))


@query(f"{BEST} SELECT security_id, effective_date, source_id, available_at, {PRICES}, volume FROM best")
def bars_asof(spark, sf_dir):
    return rounded(best(spark, sf_dir).select("security_id", "effective_date", "source_id", "available_at", "open", "high", "low", "close", "volume"))


SPLIT_CTE = f""", sp AS ({views.SPLITS_SQL}), f AS (SELECT security_id, max(factor) AS factor FROM (
    SELECT security_id, exp(sum(ln(ratio_numerator / ratio_denominator)) OVER (PARTITION BY security_id ORDER BY effective_date)) AS factor
    FROM sp WHERE available_at <= TIMESTAMP '{AS_OF}') GROUP BY 1)"""


@query(f"""{BEST}, sp AS ({views.SPLITS_SQL}) SELECT b.security_id, b.effective_date,
    round(coalesce(exp(sum(ln(s.ratio_numerator / s.ratio_denominator))), 1.0), 6) AS adjustment_factor FROM best b
    LEFT JOIN sp s ON s.security_id = b.security_id AND s.effective_date > b.effective_date AND s.available_at <= TIMESTAMP '{AS_OF}' GROUP BY 1, 2""")
def bars_adjusted_ex_date(spark, sf_dir):
    got = adjust.bars_adjusted_asof(views.bars(spark, sf_dir), views.splits(spark, sf_dir), AS_OF, ex_date_aware=True, priorities=views.priorities(spark))
    return got.select("security_id", "effective_date", F.round("adjustment_factor", 6).alias("adjustment_factor"))


SPINE = "spine AS (SELECT concat('sec_', CAST(s_suppkey AS STRING)) AS security_id, CAST(d AS DATE) AS effective_date, CAST(d AS TIMESTAMP) + INTERVAL 2 DAY AS as_of FROM supplier, generate_series(TIMESTAMP '1997-01-03', TIMESTAMP '1997-12-26', INTERVAL 7 DAY) t(d))"


@query(f"""{BEST}, {SPINE} SELECT s.security_id, s.effective_date, b.effective_date AS bar_date, b.close AS close
    FROM spine s ASOF JOIN best b ON s.security_id = b.security_id AND s.effective_date >= b.effective_date""")
def panel(spark, sf_dir):
    got = pit.read_panel(views.bars(spark, sf_dir), views.spine(spark, sf_dir), AS_OF, views.priorities(spark))
    return rounded(got.select("security_id", "effective_date", "bar_date", "close"))


@query(f"""{BARS}, {SPINE}, j AS (SELECT s.security_id, s.effective_date, s.as_of, b.effective_date AS bar_date, b.source_id, b.close,
    row_number() OVER (PARTITION BY s.security_id, s.effective_date, s.as_of ORDER BY CASE b.source_id WHEN 'src_n' THEN 0 WHEN 'src_a' THEN 1 ELSE 999 END, b.available_at DESC, b.effective_date DESC, b.source_id DESC) AS n
    FROM spine s LEFT JOIN bars b ON s.security_id = b.security_id AND b.effective_date <= s.effective_date AND b.available_at <= s.as_of)
    SELECT security_id, effective_date, as_of, bar_date, source_id, close FROM j WHERE n = 1""")
def asof_join(spark, sf_dir):
    bars = views.bars(spark, sf_dir).select("security_id", "effective_date", "available_at", "source_id", "close")
    got = pit.read_asof_join(bars, views.spine(spark, sf_dir), views.priorities(spark))
    return rounded(got.select("security_id", "effective_date", "as_of", "bar_date", "source_id", "close"))


@query(f"""{BARS}, {SPINE} SELECT s.security_id, s.effective_date, s.as_of, b.source_id, b.close AS close
    FROM spine s LEFT JOIN bars b ON s.security_id = b.security_id AND b.effective_date = s.effective_date AND b.available_at <= s.as_of""")
def spine_join(spark, sf_dir):
    return rounded(pit.read_spine_join(views.bars(spark, sf_dir), views.spine(spark, sf_dir)).select("security_id", "effective_date", "as_of", "source_id", "close"))


def _indicator_query(name: str, columns: dict[str, str], places: int = 6) -> None:
    """A query of some finite-window indicators, each checked by its own SQL."""

    def run(spark, sf_dir):
        return rounded(indicators.finite_indicators(best(spark, sf_dir)).select("security_id", "effective_date", *columns), places)

    run.__name__ = name
    QUERIES[name] = run
    body = ", ".join(f"{sql[1:]} AS {c}" if sql.startswith("!") else f"round({sql}, {places}) + 0.0::DOUBLE AS {c}" for c, sql in columns.items())  # !: exact; + 0.0: no negative zero
    ORACLE_SQL[name] = f"""{BEST}, b0 AS (SELECT *, CAST(volume AS DOUBLE) AS v, row_number() OVER ({W}) AS rn, {lagged('close')} AS pc, {lagged('high')} AS ph, {lagged('low')} AS pl, (high + low + close) / 3 AS tp FROM best),
        b AS (SELECT *, close - pc AS ch, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, ln(close / pc) AS lr,
        CASE WHEN close > pc THEN close - pc WHEN pc IS NOT NULL THEN 0.0 END AS gain, CASE WHEN close < pc THEN pc - close WHEN pc IS NOT NULL THEN 0.0 END AS loss FROM b0)
        SELECT security_id, effective_date, {body} FROM b"""


_s20, _sd20 = roll("avg", "close", 20), roll("stddev_samp", "close", 20)
_indicator_query("indicators_trend", {
    "sma_50": roll("avg", "close", 50), "sma_200": roll("avg", "close", 200), "bb_upper": f"{_s20} + 2 * {_sd20}", "bb_lower": f"{_s20} - 2 * {_sd20}", "bandwidth": f"4 * {_sd20} / {_s20}",
    "dist_to_ma_20": f"close / {_s20} - 1", "above_ma_50": f"!close > {roll('avg', 'close', 50)}", "donchian_upper": roll("max", "high", 20), "donchian_lower": roll("min", "low", 20),
    "linreg_slope_20": f"CASE WHEN rn >= 20 THEN regr_slope(close, rn) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END",
    "wma_20": "(" + " + ".join(f"{20 - k} * " + (lagged("close", k) if k else "close") for k in range(20)) + ") / 210",
    "aroon_up_25": f"CASE WHEN rn >= 25 THEN 100.0 * list_position(list(high) OVER ({W} ROWS BETWEEN 24 PRECEDING AND CURRENT ROW), max(high) OVER ({W} ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)) / 25 END",
})
_indicator_query("indicators_returns", {f"return_{n}": f"close / {lagged('close', n)} - 1" for n in (1, 5, 21, 63, 126, 252)} | {
    "log_return": "lr", "roc_12": f"(close / {lagged('close', 12)} - 1) * 100", "gap_pct": "open / pc - 1", "realized_vol_21": f"{roll('stddev_samp', 'lr', 21)} * sqrt(252)", "realized_vol_63": f"{roll('stddev_samp', 'lr', 63)} * sqrt(252)",
    "pct_off_52w_high": f"close / {roll('max', 'high', 252)} - 1", "is_new_52w_low": f"!low <= {roll('min', 'low', 252)}", "inside_bar": "!high <= ph AND low >= pl", "outside_bar": "!high > ph AND low < pl",
})
_hl = f"nullif({roll('max', 'high', 14)} - {roll('min', 'low', 14)}, 0)"
_g, _l = roll("avg", "gain", 14), roll("avg", "loss", 14)
_indicator_query("indicators_momentum", {
    "rsi_14": f"CASE WHEN {_l} = 0 OR {_l} IS NULL THEN (CASE WHEN {_g} = 0 OR {_g} > 0 OR {_g} IS NULL THEN 100 - 100 / 101.0::DOUBLE END) ELSE 100 - 100 / (1 + {_g} / {_l}) END",
    "williams_r_14": f"-100 * ({roll('max', 'high', 14)} - close) / {_hl}", "stoch_k_14": f"coalesce(100 * (close - {roll('min', 'low', 14)}) / {_hl}, 50)",
    "cmo_14": f"100 * ({roll('sum', 'gain', 14)} - {roll('sum', 'loss', 14)}) / nullif({roll('sum', 'gain', 14)} + {roll('sum', 'loss', 14)}, 0)",
    "bop": "(close - open) / nullif(high - low, 0)",
})
_indicator_query("indicators_volume", {
    "obv": f"sum(CASE WHEN pc IS NULL OR ch > 0 THEN v WHEN ch < 0 THEN -v ELSE 0 END) OVER ({W})", "vwap": f"sum(tp * v) OVER ({W}) / sum(v) OVER ({W})", "rvol": f"v / {roll('avg', 'v', 20)}",
    "avg_dollar_volume_20": roll("avg", "close * v", 20), "vpt": f"sum((close / pc - 1) * v) OVER ({W})", "volume_spike": f"!(v / {roll('avg', 'v', 20)} > 2.5) OR (v > {roll('avg', 'v', 20)} + 2.5 * coalesce({roll('stddev_samp', 'v', 20)}, 1.0))",
}, places=2)
_indicator_query("indicators_volatility", {
    "true_range": "!tr", "atr_14": roll("avg", "tr", 14), "atr_pct": f"{roll('avg', 'tr', 14)} / close * 100", "range_expansion": f"tr / {roll('avg', 'tr', 14)}",
    "chop_14": f"CASE WHEN {_hl} IS NULL THEN 0.0 ELSE 100 * log10({roll('avg', 'tr', 14)} * 14 / {_hl}) / log10(14) END",
    "pivot_high": f"!CASE WHEN count(high) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) = 11 AND high = max(high) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) THEN high END",
})


def as_shown(df: DataFrame) -> DataFrame:
    """Indicators rounded as their SQL rounds them."""
    return df.select(*[half_up(finite(c) + indicator_sql.OFF, indicator_sql.places(c)).alias(c) if t == "double" and c not in EXACT else F.col(c) for c, t in df.dtypes])


RECURSIVE_BEST = BEST.replace("WITH", "WITH RECURSIVE", 1)


@query(f"{RECURSIVE_BEST}, {indicator_sql.steps('best', BENCHMARK)} SELECT security_id, effective_date, TIMESTAMP '{AS_OF}' AS available_at, 'derived' AS source_id, {indicator_sql.listed(indicator_sql.names(True))} FROM wide")
def technical_indicators(spark, sf_dir):
    """All indicators of all securities, the recursive ones too."""
    b = best(spark, sf_dir)
    return as_shown(indicators.compute_all(b, AS_OF, b.filter(F.col("security_id") == BENCHMARK)))


ABOVE = ", ".join(f"CASE WHEN {roll('avg', 'close', n)} IS NOT NULL THEN CAST(close > {roll('avg', 'close', n)} AS INT) END AS a{n}" for n in (50, 200))


@query(f"""{BEST}, st AS (SELECT security_id, effective_date, close, {ABOVE} FROM best), dates AS (SELECT DISTINCT effective_date FROM best), secs AS (SELECT DISTINCT security_id FROM best),
    held AS (SELECT d.effective_date, st.a50, st.a200 FROM dates d CROSS JOIN secs s ASOF JOIN st ON st.security_id = s.security_id AND d.effective_date >= st.effective_date),
    sh AS (SELECT effective_date, 100 * avg(a50) AS a50, 100 * avg(a200) AS a200 FROM held GROUP BY 1)
    SELECT 'pct_above_50ma' AS metric_id, effective_date, round(a50, 6) AS value FROM sh UNION ALL SELECT 'pct_above_200ma', effective_date, round(a200, 6) FROM sh
    UNION ALL SELECT 'sector_all_pct_above_50ma', effective_date, round(a50, 6) FROM sh UNION ALL SELECT 'sector_all_pct_above_200ma', effective_date, round(a200, 6) FROM sh
    UNION ALL SELECT 'ratio_risk', d.effective_date, round(x.close / y.close, 6) FROM dates d LEFT JOIN best x ON x.security_id = 'sec_1' AND x.effective_date = d.effective_date LEFT JOIN best y ON y.security_id = 'sec_2' AND y.effective_date = d.effective_date""")
def market_breadth(spark, sf_dir):
    return rounded(derived.market_breadth(best(spark, sf_dir), AS_OF, {"risk": ("sec_1", "sec_2")}))


RS = " UNION ALL ".join(f"SELECT security_id, effective_date, {n} AS win, close / {lagged('close', n)} - 1 AS r FROM best" for n in derived.RS_WINDOWS)


@query(f"""{BEST}, r AS ({RS}), x AS (SELECT a.security_id, a.effective_date, a.win, a.r - m.r AS rs FROM r a JOIN r m ON m.security_id = '{BENCHMARK}' AND m.effective_date = a.effective_date AND m.win = a.win WHERE a.r - m.r IS NOT NULL)
    SELECT security_id, effective_date, win AS "window", round(rs, 6) AS rs_return, round(CASE WHEN count(*) OVER (PARTITION BY effective_date, win) > 1 THEN
    (rank() OVER (PARTITION BY effective_date, win ORDER BY rs) + (count(*) OVER (PARTITION BY effective_date, win, rs) - 1) / 2.0::DOUBLE - 1) / count(*) OVER (PARTITION BY effective_date, win) * 100 END, 6) AS rs_percentile FROM x""")
def relative_strength(spark, sf_dir):
    b = best(spark, sf_dir)
    return rounded(derived.relative_strength(b, b.filter(F.col("security_id") == BENCHMARK), AS_OF))


@query(f"""{BEST}, p AS (SELECT effective_date, max(CASE security_id WHEN 'sec_1' THEN close END) AS a, max(CASE security_id WHEN 'sec_2' THEN close END) AS b, max(CASE security_id WHEN 'sec_3' THEN close END) AS c, max(CASE security_id WHEN 'sec_4' THEN close END) AS d
    FROM best WHERE security_id IN ('sec_1', 'sec_2', 'sec_3', 'sec_4') GROUP BY 1)
    SELECT 'sec_1' AS series_id, effective_date, round(a + {indicator_sql.OFF}, 4) AS value FROM p UNION ALL SELECT 'sec_2', effective_date, round(b + {indicator_sql.OFF}, 4) FROM p UNION ALL SELECT 'sec_3', effective_date, round(c + {indicator_sql.OFF}, 4) FROM p
    UNION ALL SELECT 'sec_4', effective_date, round(d + {indicator_sql.OFF}, 4) FROM p UNION ALL SELECT 'contango_3m_spot', effective_date, round(c - b + {indicator_sql.OFF}, 4) FROM p UNION ALL SELECT 'contango_front_ratio', effective_date, round(a / b + {indicator_sql.OFF}, 4) FROM p""")
def vol_term_structure(spark, sf_dir):
    got = derived.vol_term_structure(best(spark, sf_dir), AS_OF, ("sec_1", "sec_2", "sec_3", "sec_4"))
    return got.withColumn("value", F.round(F.col("value") + indicator_sql.OFF, 4))


@query(f"""WITH m AS ({views.MACRO_SQL}), k AS (SELECT * FROM m WHERE available_at <= TIMESTAMP '{AS_OF}')
    SELECT a.series_id || '_YOY' AS series_id, a.effective_date, round(a.value / b.value - 1, 6) AS value FROM k a JOIN k b ON a.series_id = b.series_id AND b.effective_date = CAST(a.effective_date - INTERVAL 12 MONTH AS DATE) WHERE b.value <> 0
    UNION ALL SELECT a.series_id || '_MOM', a.effective_date, round(a.value / b.value - 1, 6) FROM k a JOIN k b ON a.series_id = b.series_id AND b.effective_date = CAST(a.effective_date - INTERVAL 1 MONTH AS DATE) WHERE b.value <> 0""")
def macro_transforms(spark, sf_dir):
    return rounded(derived.macro_transforms(views.view(spark, sf_dir, views.MACRO_SQL, "orders"), AS_OF))


@query(f"""WITH i AS ({views.INSIDER_SQL}) SELECT security_id, effective_date, transaction_code, round(value, 6) AS value,
    CAST(sum(CASE transaction_code WHEN 'P' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS buy_count, CAST(sum(CASE transaction_code WHEN 'S' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS sell_count,
    round(sum(CASE transaction_code WHEN 'P' THEN value WHEN 'S' THEN -value ELSE 0 END) OVER w, 4) AS net_value
    FROM i WINDOW w AS (PARTITION BY security_id ORDER BY effective_date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW)""")
def insider_clusters(spark, sf_dir):
    got = derived.insider_clusters(views.view(spark, sf_dir, views.INSIDER_SQL, "events"), "2100-01-01")
    return got.select("security_id", "effective_date", "transaction_code", F.round("value", 6).alias("value"), "buy_count", "sell_count", F.round("net_value", 4).alias("net_value"))


@query(f"""WITH a AS ({views.ATTENTION_SQL}), l AS (SELECT *, lag(mentions) OVER w AS pm, lag(upvotes) OVER w AS pu FROM a WINDOW w AS (PARTITION BY security_id, cohort ORDER BY effective_date))
    SELECT security_id, cohort, effective_date, mentions, round(CASE WHEN pm <> 0 THEN (mentions - pm) / pm::DOUBLE * 100 END, 6) AS mention_delta_pct,
    round(CASE WHEN mentions > 0 THEN upvotes / mentions::DOUBLE END, 6) AS upvote_ratio, round(CASE WHEN pu <> 0 THEN (upvotes - pu) / pu::DOUBLE * 100 END, 6) AS upvote_delta_pct FROM l""")
def attention_deltas(spark, sf_dir):
    return rounded(derived.attention_deltas(views.view(spark, sf_dir, views.ATTENTION_SQL, "events"), "2100-01-01"))


@query(f"""WITH s AS ({views.SENTIMENT_SQL}) SELECT security_id, effective_date, round(avg(CASE WHEN lower(sentiment_label) LIKE '%bullish%' THEN 1.0::DOUBLE ELSE 0 END), 6) AS positive_ratio,
    round(avg(sentiment_score), 6) AS mean_score, count(*) AS n_annotations FROM s GROUP BY 1, 2""")
def sentiment_ratios(spark, sf_dir):
    return rounded(derived.sentiment_ratios(views.view(spark, sf_dir, views.SENTIMENT_SQL, "labels"), AS_OF))


@query(f"""WITH s AS ({views.SENTIMENT_SQL}), d AS (SELECT security_id, effective_date, avg(CASE sentiment_label WHEN 'Bullish' THEN 1.0::DOUBLE ELSE 0 END) AS bu, avg(CASE sentiment_label WHEN 'Bearish' THEN 1.0::DOUBLE ELSE 0 END) AS be FROM s GROUP BY 1, 2)
    SELECT security_id, effective_date, round(bu, 6) AS bullish, round(be, 6) AS bearish, round(greatest(0, 1 - bu - be), 6) AS neutral FROM d QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY effective_date DESC) = 1""")
def sentiment_split(spark, sf_dir):
    return rounded(derived.sentiment_split(views.view(spark, sf_dir, views.SENTIMENT_SQL, "labels"), AS_OF))


@query(f"{BARS} SELECT security_id, effective_date, source_id, CASE WHEN low <= open AND low <= close AND open <= high AND close <= high AND volume >= 0 AND open >= 0 THEN 'valid' ELSE 'quarantined' END AS quality_status FROM bars")
def market_sanity(spark, sf_dir):
    return quality.market_sanity(views.bars(spark, sf_dir).withColumn("quality_status", F.lit("valid"))).select("security_id", "effective_date", "source_id", "quality_status")


@query(f"""{BARS}, s AS (SELECT security_id, min(effective_date) AS lo, max(effective_date) AS hi FROM bars GROUP BY 1), d AS (SELECT security_id, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS effective_date FROM s)
    SELECT security_id, effective_date FROM d EXCEPT SELECT security_id, effective_date FROM bars""")
def missing_dates(spark, sf_dir):
    return versions.missing_dates(views.bars(spark, sf_dir))


CAL = "cal AS (SELECT session, row_number() OVER (ORDER BY session) AS ordinal FROM (SELECT DISTINCT effective_date AS session FROM bars WHERE dayofweek(effective_date) BETWEEN 1 AND 5))"


def _calendar(spark, sf_dir):
    days = views.bars(spark, sf_dir).filter(F.weekday("effective_date") < 5).select(F.lit("XNYS").alias("exchange"), F.col("effective_date").alias("session"))
    return calendar.numbered(days)


@query(f"{BARS}, {CAL}, s AS (SELECT security_id, min(effective_date) AS lo, max(effective_date) AS hi FROM bars GROUP BY 1) SELECT security_id, session AS effective_date FROM s JOIN cal ON session BETWEEN lo AND hi EXCEPT SELECT security_id, effective_date FROM bars")
def missing_sessions(spark, sf_dir):
    return versions.missing_sessions(views.bars(spark, sf_dir), _calendar(spark, sf_dir))


@query(f"""{BARS}, {CAL}, d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), p AS (SELECT d.day, c.session, c.ordinal FROM d ASOF LEFT JOIN cal c ON d.day >= c.session)
    SELECT p.day, n.session AS shifted, EXISTS (SELECT 1 FROM cal c WHERE c.session = p.day) AS is_open FROM p LEFT JOIN cal n ON n.ordinal = p.ordinal + 5""")
def shifted_sessions(spark, sf_dir):
    cal = _calendar(spark, sf_dir)
    views.load(spark, sf_dir, "orders")
    days = spark.sql("SELECT DISTINCT 'XNYS' AS exchange, CAST(o_orderdate AS DATE) AS day FROM orders")
    return calendar.is_trading_day(calendar.shift_trading_days(days, cal, 5), cal).select("day", "shifted", "is_open")


MASTER = """SELECT concat('sec_', CAST(s_suppkey AS STRING)) AS security_id, concat('SYM', CAST(s_suppkey % 40 AS STRING)) AS symbol, s_name AS name, '' AS figi, lpad(CAST(s_suppkey AS STRING), 10, '0') AS cik,
    DATE '1992-01-01' + CAST((s_suppkey - s_suppkey % 40) * 10 AS INT) AS effective_start, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE DATE '1992-01-01' + CAST((s_suppkey - s_suppkey % 40) * 10 + 399 AS INT) END AS effective_end,
    CAST(DATE '1992-01-02' + CAST((s_suppkey - s_suppkey % 40) * 10 AS INT) AS TIMESTAMP) AS available_at FROM supplier"""
REQUESTS = "SELECT DISTINCT concat('SYM', CAST(o_custkey % 40 AS STRING)) AS symbol, CAST(o_orderdate AS DATE) AS date FROM orders"


@query(f"""WITH m AS ({MASTER}), r AS ({REQUESTS}) SELECT r.symbol, r.date, m.security_id FROM r LEFT JOIN m ON m.symbol = r.symbol AND m.effective_start <= r.date AND (m.effective_end IS NULL OR m.effective_end > r.date)
    QUALIFY row_number() OVER (PARTITION BY r.symbol, r.date ORDER BY m.available_at DESC, m.effective_start DESC, m.security_id DESC) = 1""")
def resolved_symbols(spark, sf_dir):
    views.load(spark, sf_dir, "supplier", "orders")
    return identity.resolve(spark.sql(REQUESTS), spark.sql(MASTER)).select("symbol", "date", "security_id")


@query(f"WITH m AS ({MASTER}) SELECT symbol, security_id, 'sec_' || substr(sha256('{{\"source_key\":\"' || cik || '\"}}'), 1, 24) AS minted_id, name FROM m WHERE effective_start <= DATE '1994-01-01' AND (effective_end IS NULL OR effective_end >= DATE '1994-01-01')")
def universe(spark, sf_dir):
    views.load(spark, sf_dir, "supplier")
    master = spark.sql(MASTER)
    minted = master.select("security_id", identity.mint_security_id(F.col("figi"), F.col("cik"), F.lit(""), F.lit("")).alias("minted_id"))
    return identity.universe(master, "1994-01-01").join(minted, "security_id").select("symbol", "security_id", "minted_id", "name")


@query(f"""{BARS} SELECT a.security_id, a.effective_date, a.source_id AS source_a, b.source_id AS source_b, round(abs(a.close - b.close) / abs(b.close) * 100, 6) AS diff_pct FROM bars a JOIN bars b ON a.security_id = b.security_id AND a.effective_date = b.effective_date AND a.source_id < b.source_id
    WHERE abs(a.close - b.close) / abs(b.close) * 100 > 5""")
def reconciled_sources(spark, sf_dir):
    return rounded(quality.reconcile(views.bars(spark, sf_dir), "close", 5.0).select("security_id", "effective_date", "source_a", "source_b", "diff_pct"))


@query(f"{BARS}, m AS ({views.MACRO_SQL}) SELECT 'lake_bars' AS dataset, count(*) AS n_rows, max(effective_date) AS last_effective_date, max(available_at) AS last_available_at, 'ok' AS status FROM bars UNION ALL SELECT 'macro_series', count(*), max(effective_date), max(available_at), 'ok' FROM m")
def dataset_health(spark, sf_dir):
    tables = {"lake_bars": views.bars(spark, sf_dir), "macro_series": views.view(spark, sf_dir, views.MACRO_SQL, "orders")}
    return quality.health(tables).drop("schema_version")


@query(f"{BARS} SELECT security_id, effective_date, source_id, available_at FROM bars WHERE available_at > TIMESTAMP '1995-06-30 00:00:00'")
def insert_only_merge(spark, sf_dir):
    """What a merge of all bars adds to a table that holds those of the first years; twice the batch adds no more."""
    rows = versions.version_hash(views.bars(spark, sf_dir))
    existing = rows.filter(F.col("available_at") <= F.lit("1995-06-30").cast("timestamp"))
    return versions.insert_only(rows.unionByName(rows), existing, ["security_id", "effective_date", "source_id"]).select("security_id", "effective_date", "source_id", "available_at")


@query(f"{BARS} SELECT year(available_at) AS commit_seq, count(*) AS n_rows, min(available_at) AS first_available_at, max(available_at) AS last_available_at FROM bars WHERE year(available_at) <= 1996 GROUP BY 1")
def pinned_commits(spark, sf_dir):
    rows = views.bars(spark, sf_dir).withColumn("commit_seq", F.year("available_at").cast("long"))
    return versions.commits(versions.pinned(rows, 1996))
