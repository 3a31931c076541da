"""Registered queries of reads, upkeep, archive and streams that show whole rows, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adjust, calendar, identity, indicators, panels, pit, quality, readouts, versions
from ..plans.schemas import DATASETS
from ..sources import archive, normalize
from ..streaming import ingest
from . import indicator_sql, normalizer_queries, views
from .indicator_sql import OFF
from .more_queries import payloads, profiles, shared_folder
from .panel_queries import READOUT_STEPS, readout_sql, stored
from .queries import BARS, BEST, CAL, MASTER, PRICES, RECURSIVE_BEST, SPLIT_CTE, _calendar, best, query
from .views import AS_OF

PRICE = "round({c} + {off}, 4) AS {c}"


def _off(df, *cols: str):
    return df.withColumns({c: F.round(F.col(c) + OFF, 4) for c in cols})


# ---- reads --------------------------------------------------------------------------------------------


@query(f"""{BEST}{SPLIT_CTE} SELECT b.security_id, effective_date, {', '.join(f'round({c} / coalesce(factor, 1.0) + {OFF}, 4) AS {c}' for c in ('open', 'high', 'low', 'close'))}, CAST(round(volume * coalesce(factor, 1.0), 0) AS BIGINT) AS volume, round(coalesce(factor, 1.0), 6) AS adjustment_factor FROM best b LEFT JOIN f ON b.security_id = f.security_id""")
def bars_adjusted(spark, sf_dir):
    """Prices over the split factor. The operator's own rounding is left out, as ties go one way or the
    other by the last bit of the division."""
    got = adjust.bars_adjusted_asof(views.bars(spark, sf_dir), views.splits(spark, sf_dir), AS_OF, places=None, priorities=views.priorities(spark))
    return _off(got, "open", "high", "low", "close").select("security_id", "effective_date", "open", "high", "low", "close", "volume", F.round("adjustment_factor", 6).alias("adjustment_factor"))


@query(f"""{BEST} SELECT 'raw' AS mode, security_id, effective_date, close, 1.0::DOUBLE AS adjustment_factor FROM best UNION ALL SELECT 'no_actions', security_id, effective_date, close, 1.0::DOUBLE FROM best UNION ALL SELECT 'unusable_actions', security_id, effective_date, close, 1.0::DOUBLE FROM best""")
def price_modes(spark, sf_dir):
    """Raw bars by request, factor 1 without actions, and raw bars for actions that can't be used."""
    bars, p = views.bars(spark, sf_dir), views.priorities(spark)
    modes = {"raw": (views.splits(spark, sf_dir), "raw"), "no_actions": (None, "split_adjusted"), "unusable_actions": (views.splits(spark, sf_dir).drop("ratio_numerator"), "split_adjusted")}
    out = None
    for name, (actions, mode) in modes.items():
        got = adjust.bars_adjusted_asof(bars, actions, AS_OF, mode, places=None, priorities=p)
        one = got.select(F.lit(name).alias("mode"), "security_id", "effective_date", "close", (F.col("adjustment_factor") if "adjustment_factor" in got.columns else F.lit(1.0)).alias("adjustment_factor"))
        out = one if out is None else out.unionByName(one)
    return out


_now = "2100-01-01 00:00:00"


@query(f"{BEST.replace(AS_OF, _now)} SELECT security_id, effective_date, source_id, available_at, close FROM best")
def bars_latest(spark, sf_dir):
    return pit.bars_latest(views.bars(spark, sf_dir), _now, priorities=views.priorities(spark)).select("security_id", "effective_date", "source_id", "available_at", "close")


RANGES = "SELECT concat('sec_', CAST(s_suppkey AS STRING)) AS security_id, CAST(DATE '1994-01-01' + CAST(s_suppkey % 900 AS INT) AS DATE) AS start, CASE WHEN s_suppkey % 5 > 0 THEN CAST(DATE '1995-01-01' + CAST(s_suppkey % 900 AS INT) AS DATE) END AS end_ FROM supplier"


@query(f"{BEST}, r AS ({RANGES}) SELECT b.security_id, b.effective_date, b.close FROM best b JOIN r ON b.security_id = r.security_id AND b.effective_date >= r.start AND (r.end_ IS NULL OR b.effective_date <= r.end_)")
def bars_asof_range(spark, sf_dir):
    """Bars of every supplier's own range of dates; the securities come as a table."""
    views.load(spark, sf_dir, "supplier")
    r = spark.sql(RANGES).withColumnRenamed("end_", "end")
    got = pit.bars_asof(views.bars(spark, sf_dir), AS_OF, views.priorities(spark), ids=r.select("security_id"))
    return pit.project(pit.in_ranges(got, r), ["security_id", "effective_date", "close", "no_such_column"])


@query(f"{BARS}, e AS (SELECT DISTINCT 'bars_daily' AS dataset, source_id FROM bars UNION ALL SELECT DISTINCT 'events', concat('src_', event_type) FROM events), p AS (SELECT *, CASE WHEN dataset = 'bars_daily' AND source_id = 'src_n' THEN 0 WHEN dataset = 'bars_daily' AND source_id = 'src_a' THEN 1 ELSE 999 END AS priority FROM e) SELECT dataset, source_id FROM p QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY priority, source_id) = 1")
def preferred_sources(spark, sf_dir):
    enabled = views.bars(spark, sf_dir).select(F.lit("bars_daily").alias("dataset"), "source_id").distinct()
    events = views.view(spark, sf_dir, "SELECT DISTINCT 'events' AS dataset, concat('src_', event_type) AS source_id FROM events", "events")
    return pit.preferred_source(views.priorities(spark), enabled.unionByName(events))


@query(f"WITH p AS ({normalizer_queries.payloads(normalizer_queries.arr(normalizer_queries.obj(date='d', value=normalizer_queries.TEXT)), 'fred')}) SELECT sec AS series_id, d AS effective_date, {normalizer_queries.NUMBER} AS value, available_at, source_id, 'valid' AS quality_status FROM p")
def without_audit(spark, sf_dir):
    """Facts without the columns that tell where they come from."""
    rows = views.view(spark, sf_dir, normalizer_queries.payloads(normalizer_queries.arr(normalizer_queries.obj(date="d", value=normalizer_queries.TEXT)), "fred"), "orders").withColumn("content_hash", archive.content_hash(F.col("body")))
    return pit.without_audit(normalize.macro_series(rows))


# ---- quality ------------------------------------------------------------------------------------------

_ODD = "SELECT concat('sec_', CAST(o_custkey % 50 AS STRING)) AS security_id, CAST(o_orderdate AS DATE) AS effective_date, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS available_at, 's' AS source_id, CASE WHEN o_orderkey % 7 > 0 THEN 'all' END AS cohort, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE CAST(o_orderkey % 11 - 1 AS STRING) END AS mentions, o_orderkey % 3 AS mentions_24h_ago, o_orderkey AS upvotes, 'f' AS source_fetch_id, 'r' AS raw_payload_hash, 'i' AS ingestion_run_id, CAST(o_orderkey AS STRING) AS content_hash, 'v' AS version_hash, 1 AS schema_version, 1 AS parser_version, 'valid' AS quality_status FROM orders"


@query(f"WITH p AS ({_ODD}), x AS (SELECT *, TRY_CAST(mentions AS BIGINT) AS m FROM p) SELECT content_hash, concat_ws(',', CASE WHEN cohort IS NULL THEN 'cohort' END, CASE WHEN m IS NULL OR m < 0 THEN 'mentions' END) AS violations FROM x")
def validated_rows(spark, sf_dir):
    """Rows of a dataset with the columns that don't fit its schema; none for those that do."""
    good, bad = quality.validated(DATASETS["attention_metrics"], views.view(spark, sf_dir, _ODD, "orders"))
    return good.select("content_hash", F.lit("").alias("violations")).unionByName(bad.select("content_hash", F.array_join("violations", ",").alias("violations")))


@query(f"{BARS} SELECT security_id, effective_date, source_id, available_at FROM bars WHERE effective_date >= CAST(DATE '1998-06-30' - INTERVAL 18 MONTH AS DATE)")
def retained_bars(spark, sf_dir):
    return quality.retained(views.bars(spark, sf_dir), AS_OF, 18).select("security_id", "effective_date", "source_id", "available_at")


# ---- versions and archive ------------------------------------------------------------------------------

_SIMPLE = "SELECT o_orderkey AS k, o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS day, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 90 MINUTE AS moment, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS customer FROM orders"
_JSON = """concat('{"customer":', coalesce(CAST(customer AS VARCHAR), 'null'), ',"day":"', day, '","k":', k, ',"moment":"', strftime(moment, '%Y-%m-%d %H:%M:%S'), '","priority":"', priority, '"}')"""


@query(f"WITH t AS ({_SIMPLE}) SELECT k, sha256({_JSON}) AS version_hash, CAST(1 AS BIGINT) AS normalization_version FROM t")
def version_hashes(spark, sf_dir):
    return versions.version_hash(views.view(spark, sf_dir, _SIMPLE, "orders")).select("k", "version_hash", "normalization_version")


_part = lambda k: f"CAST('0x' || substr(h, {1 + 15 * k}, 15) AS BIGINT)"
REPLAYED = f"""WITH t AS ({_SIMPLE}), h AS (SELECT sha256({_JSON}) AS h FROM t), s AS (SELECT count(*) AS n_rows, {', '.join(f'bit_xor({_part(k)}) AS x{k}, CAST(sum({_part(k)} % 2147483647) AS BIGINT) AS s{k}' for k in range(4))} FROM h)
    SELECT n_rows, sha256(concat('{{"n_rows":', n_rows, {', '.join(f"',\"x{k}\":', x{k}" for k in range(4))}, {', '.join(f"',\"s{k}\":', s{k}" for k in range(4))}, '}}')) AS digest FROM s"""


@query(REPLAYED)
def replayed_hash(spark, sf_dir):
    """The digest of a table in another order of rows."""
    return versions.replay_hash(views.view(spark, sf_dir, _SIMPLE, "orders").repartition(7, "priority"))


@query(REPLAYED)
def golden_copy(spark, sf_dir):
    """A frozen copy and its digest."""
    return archive.freeze_output(views.view(spark, sf_dir, _SIMPLE, "orders"), shared_folder(spark, "golden"))


KEYS = ["security_id", "effective_date", "source_id"]
_ROWS = "security_id, effective_date, source_id, available_at, close"


@query(f"{BARS} SELECT {_ROWS} FROM bars")
def compacted_bars(spark, sf_dir):
    """Twice the bars compact to once."""
    rows = versions.version_hash(views.bars(spark, sf_dir))
    return versions.compact(rows.unionByName(rows), KEYS).select(*_ROWS.split(", "))


@query("SELECT concat('sec_', CAST(user_id AS STRING)) AS security_id, CAST(ts AS DATE) AS effective_date, value AS close, event_id AS volume, TIMESTAMP '1999-01-01 00:00:00' AS available_at FROM events")
def reparsed_bars(spark, sf_dir):
    """Archived bodies behind known facts, normalized again under a new knowledge time."""
    # stored: a body lists events in the order in which a shuffle brings them, so its hash holds for one run only
    p = stored(spark, payloads(spark, sf_dir), "payloads")
    got = versions.reparse(normalize.bars(p).select("content_hash"), p, normalize.bars, F.lit("1999-01-01").cast("timestamp"))
    return got.select("security_id", "effective_date", "close", "volume", "available_at")


_BODIES = "SELECT o_orderkey AS k, concat('{\"customer\":', CAST(o_custkey % 500 AS STRING), '}') AS body, o_orderkey % 2 AS half FROM orders"


@query(f"WITH b AS ({_BODIES}) SELECT 'archived' AS part, sha256(body) AS content_hash, substr(sha256(body), 1, 2) AS prefix, body FROM b WHERE half = 0 GROUP BY body UNION ALL SELECT 'new', sha256(body), substr(sha256(body), 1, 2), body FROM b GROUP BY body HAVING max(1 - half) = 0")
def archived_payloads(spark, sf_dir):
    """Half of the payloads archived by content and read back by hash, and of all those that are new then."""
    p, path = views.view(spark, sf_dir, _BODIES, "orders"), shared_folder(spark, "archive")
    archive.write_archive(archive.new_payloads(p.filter("half = 0").select("body")), path)
    stored = spark.read.parquet(path)
    new = archive.new_payloads(p.select("body"), stored)
    cols = ["content_hash", "prefix", "body"]
    back = archive.read_raw(stored, stored.select("content_hash"))
    return back.select(F.lit("archived").alias("part"), *cols).unionByName(new.select(F.lit("new").alias("part"), *cols))


_FETCHES = "SELECT event_type AS source_id, 'e' AS endpoint, event_id, 200 AS status, coalesce(props, '') AS body, ts AS fetched_at FROM events"


@query(f"""WITH f AS ({_FETCHES}) SELECT source_id, endpoint, fetched_at, sha256(concat('{{"source_id":"', source_id, '","endpoint":"e","params":[{{"key":"a","value":"x"}},{{"key":"id","value":"', event_id, '"}}]}}')) AS request_hash, status, CAST(octet_length(encode(body)) AS BIGINT) AS byte_size, sha256(body) AS content_hash, CAST(1 AS BIGINT) AS parser_version FROM f""")
def fetch_manifests(spark, sf_dir):
    f = views.view(spark, sf_dir, _FETCHES, "events").withColumn("params", F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("a"), F.lit("x")))
    return archive.manifest(f)


_md5 = lambda *x: f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(x)})), 1, 7) AS BIGINT)"
_unit = lambda k: f"({_md5('security_id', 'i', f"'{k}'")} % 10000 / 10000.0::DOUBLE)"


@query(f"""WITH s AS (SELECT concat('sec_', CAST(s_suppkey AS STRING)) AS security_id, unnest(range(0, 252)) AS i FROM supplier), c AS (SELECT *, round((50 + {_md5('security_id')} % 200) * (1 + 0.1::DOUBLE * sin(i / 20.0::DOUBLE)) * (1 + 0.02::DOUBLE * ({_unit(0)} - 0.5)), 4) AS close FROM s), o AS (SELECT *, round(close * (1 + 0.01::DOUBLE * ({_unit(1)} - 0.5)), 4) AS open FROM c)
    SELECT security_id, CAST(DATE '1998-01-01' - CAST(251 - i AS INT) AS DATE) AS effective_date, round(open + {OFF}, 2) AS open, round(round(greatest(open, close) * (1 + 0.01::DOUBLE * {_unit(2)}), 4) + {OFF}, 2) AS high, round(round(least(open, close) * (1 - 0.01::DOUBLE * {_unit(3)}), 4) + {OFF}, 2) AS low, round(close + {OFF}, 2) AS close, 1000000 + {_md5('security_id', 'i', "'4'")} % 1000000 AS volume FROM o""")
def synthetic_history(spark, sf_dir):
    symbols = views.view(spark, sf_dir, "SELECT concat('sec_', CAST(s_suppkey AS STRING)) AS security_id FROM supplier", "supplier")
    return archive.synthetic_bars(symbols, "1998-01-01").withColumns({c: F.round(F.col(c) + OFF, 2) for c in ("open", "high", "low", "close")})


@query(f"{BEST} SELECT security_id AS symbol, 'stocks' AS kind, effective_date, {PRICES}, volume FROM best")
def bulk_bars(spark, sf_dir):
    """Bars written as the sorted bulk store, and read back."""
    path = shared_folder(spark, "bulk")
    rows = best(spark, sf_dir).select(F.col("security_id").alias("symbol"), F.lit("stocks").alias("kind"), "effective_date", "open", "high", "low", "close", "volume")
    archive.write_bulk_bars(rows, path)
    return spark.read.parquet(path)


@query(f"{BARS}, m AS ({views.MACRO_SQL}), h AS (SELECT 'lake_bars' AS dataset, max(effective_date) AS latest FROM bars UNION ALL SELECT 'macro_series', max(effective_date) FROM m UNION ALL SELECT 'nothing', NULL) SELECT dataset, CASE dataset WHEN 'lake_bars' THEN 10 ELSE 2000 END AS max_staleness_days, CAST(DATE '1999-06-30' - latest AS INT) AS days_old, coalesce(CAST(DATE '1999-06-30' - latest AS INT) > CASE dataset WHEN 'lake_bars' THEN 10 ELSE 2000 END, TRUE) AS is_stale FROM h")
def stale_datasets(spark, sf_dir):
    """Staleness of three datasets: too old, new enough, and without rows."""
    limits = spark.createDataFrame([("lake_bars", 10), ("macro_series", 2000), ("nothing", 2000)], "dataset string, max_staleness_days int")
    bars, macro = views.bars(spark, sf_dir), views.view(spark, sf_dir, views.MACRO_SQL, "orders")
    return quality.staleness(quality.health({"lake_bars": bars, "macro_series": macro, "nothing": bars.filter("1 = 0")}), limits, "1999-06-30")


# ---- identity and calendar ------------------------------------------------------------------------------


@query("SELECT lower(s_name) AS ticker, CAST(s_suppkey AS BIGINT) AS k, CASE WHEN s_suppkey % 3 > 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 10, '0') END AS cik FROM supplier")
def tickers_with_cik(spark, sf_dir):
    s = views.view(spark, sf_dir, "SELECT s_name AS ticker, CAST(s_suppkey AS BIGINT) AS k FROM supplier", "supplier")
    return identity.with_cik(s.select(F.lower("ticker").alias("ticker"), "k"), s.filter("k % 3 > 0").select("ticker", F.col("k").alias("cik")))


@query(f"WITH m AS ({MASTER}) SELECT security_id, symbol, effective_start FROM m WHERE CAST(split_part(security_id, '_', 2) AS INT) % 2 = 1")
def registered_securities(spark, sf_dir):
    """What registering all suppliers adds to a master that has half of them; doing so twice adds no more."""
    views.load(spark, sf_dir, "supplier")
    master = versions.version_hash(spark.sql(MASTER))
    had = master.filter("CAST(substring_index(security_id, '_', -1) AS INT) % 2 = 0")
    return versions.insert_only(master.unionByName(master), had, ["security_id", "symbol", "effective_start"]).select("security_id", "symbol", "effective_start")


@query("""WITH off AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE day(o_orderdate) = 1), d AS (SELECT CAST(d AS DATE) AS day FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1997-12-31', INTERVAL 1 DAY) t(d)),
    s AS (SELECT day, dayofweek(day) BETWEEN 1 AND 5 AND day NOT IN (SELECT day FROM off) AS is_open FROM d) SELECT 'XNYS' AS exchange, day, is_open, CASE WHEN is_open THEN sum(CAST(is_open AS INT)) OVER (ORDER BY day) END::INT AS ordinal FROM s""")
def open_days(spark, sf_dir):
    """Open and closed days of an exchange by another of its names, with holidays from the orders."""
    off = views.view(spark, sf_dir, "SELECT DISTINCT 'XNYS' AS exchange, CAST(o_orderdate AS DATE) AS day FROM orders WHERE day(o_orderdate) = 1", "orders")
    cal = calendar.trading_calendar(spark, "1995-01-01", "1997-12-31", off, "NYSE")
    days = calendar.open_closed(cal, "1995-01-01", "1997-12-31")
    return days.join(cal.select("exchange", F.col("session").alias("day"), "ordinal"), ["exchange", "day"], "left").select("exchange", "day", "is_open", "ordinal")


# ---- readouts and lists ----------------------------------------------------------------------------------


@query(f"""{BARS.replace('WITH', 'WITH RECURSIVE', 1)}, {BEST.split(', best AS', 1)[1].join(['best AS', ''])}, {CAL}, first_ AS (SELECT coalesce((SELECT c.session FROM cal c WHERE c.ordinal = (SELECT max(ordinal) FROM cal WHERE session <= DATE '1997-01-01') - 253), (SELECT min(session) FROM cal)) AS s), warm AS (SELECT best.* FROM best, first_ WHERE effective_date >= s), {indicator_sql.steps('warm')}
    SELECT security_id, effective_date, {indicator_sql.listed(['sma_200', 'rsi_14', 'ema_26'])} FROM wide WHERE effective_date >= DATE '1997-01-01'""")
def indicators_after_warmup(spark, sf_dir):
    """Chosen indicators from a date on, with the sessions of the longest look-back before it."""
    from .queries import as_shown

    got = indicators.chosen(best(spark, sf_dir), AS_OF, ["sma_200", "rsi_14", "ema_26"], "1997-01-01", readouts.max_lookback(), _calendar(spark, sf_dir))
    return as_shown(got)


_STORED = "regexp_replace(security_id, '^sec_', '')::INT % 2 = 0"


@query(f"{RECURSIVE_BEST}, {READOUT_STEPS.replace('nw AS (SELECT * FROM y WHERE back = 1)', f'nw AS (SELECT * REPLACE (CASE WHEN {_STORED} THEN 25.0::DOUBLE ELSE rsi_14 END AS rsi_14) FROM y WHERE back = 1)')} " + " UNION ALL ".join(readout_sql(n) for n in ("momentum.rsi_14", "trend.directional_bias")))
def stored_readouts(spark, sf_dir):
    """Readouts of which half the securities have a stored RSI, which is preferred."""
    b = best(spark, sf_dir)
    bench = b.filter(F.col("security_id") == views.BENCHMARK)
    names = ["adx_14", "di_plus_14", "di_minus_14", "macd", "macd_ema", "atr_pct", "bandwidth", "rvol", "realized_vol_21", "realized_vol_63", "keltner_upper", "keltner_middle", "keltner_lower"]
    none = F.lit(None).cast("double")
    stored = b.filter("CAST(substring_index(security_id, '_', -1) AS INT) % 2 = 0").select("security_id", "effective_date", "available_at", F.lit(25.0).alias("rsi_14"), *[none.alias(c) for c in names])
    got = readouts.compute(b, AS_OF, profiles(), bench, stored=stored, places=12).filter(F.col("definition_id").isin("momentum.rsi_14", "trend.directional_bias"))
    return got.withColumn("value", F.round(F.col("value") + OFF, 2))


_lists = {
    "insider": (views.INSIDER_SQL, "transaction_code || '/' || event_id", "events"),
    "attention": (views.ATTENTION_SQL, "cohort || '/' || mentions", "events"),
    "analyst": (views.ANALYST_SQL, "rating || '/' || buys", "orders"),
    "news": (views.NEWS_SQL, "source_name || '/' || article_id", "documents"),
    "earnings": (views.EARNINGS_SQL, "session || '/' || order_id", "orders"),
    "macro": (views.MACRO_LIST_SQL, "series_id || '/' || n_orders", "orders"),
}


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{n}' AS list, security_id, CAST(row_number() OVER (PARTITION BY security_id ORDER BY effective_date DESC, available_at DESC, value DESC) AS INT) AS rank, effective_date, value FROM (SELECT security_id, effective_date, available_at, {v} AS value FROM ({sql}) a)) WHERE rank <= 20" for n, (sql, v, _) in _lists.items()))
def latest_lists(spark, sf_dir):
    """The newest insider transactions, mentions, estimates, articles and earnings dates of each security and
    values of each macro series."""
    tables = {n: (views.view(spark, sf_dir, sql, t).withColumn("shown", F.expr(v)).drop("value"), "shown") for n, (sql, v, t) in _lists.items()}
    return panels.latest_lists(tables, _now, 20)


@query(f"SELECT * FROM ({views.INSIDER_SQL}) i ORDER BY event_id DESC LIMIT 500")
def browsed_rows(spark, sf_dir):
    """A page of a dataset, by its number."""
    return panels.browse(views.view(spark, sf_dir, views.INSIDER_SQL, "events"), _now, 500, order="event_id")


# ---- streams ---------------------------------------------------------------------------------------------


def _finished(frame, path: str, state: str) -> None:
    frame.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


@query("SELECT concat('sec_', CAST(user_id AS STRING)) AS security_id, CAST(ts AS DATE) AS effective_date, value AS close, event_id AS volume FROM events")
def ingested_bars(spark, sf_dir):
    """Payload files ingested as a stream, and all of them again by a stream that has forgotten them."""
    files, table = shared_folder(spark, "payload-files"), shared_folder(spark, "ingested")
    rows = payloads(spark, sf_dir)
    rows.repartition(4).write.json(files)
    for k in range(2):
        stream = ingest.payload_stream(spark, files, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes))
        ingest.ingest(stream, normalize.bars, table, KEYS + ["volume"], shared_folder(spark, f"ingest-state-{k}")).awaitTermination()
    return spark.read.parquet(table).select("security_id", "effective_date", "close", "volume")


@query(f"WITH b AS ({_BODIES}) SELECT DISTINCT sha256(body) AS content_hash, body FROM b")
def deduplicated_stream(spark, sf_dir):
    """Each payload once, from a stream that brings most of them many times."""
    files, out = shared_folder(spark, "repeated"), shared_folder(spark, "deduplicated")
    rows = views.view(spark, sf_dir, _BODIES, "orders").select("body", F.lit("1998-01-01").cast("timestamp").alias("available_at"))
    rows.write.parquet(files)
    got = ingest.deduplicated(spark.readStream.schema(rows.schema).parquet(files))
    _finished(got, out, shared_folder(spark, "deduplicated-state"))
    return spark.read.schema(got.schema).parquet(out).select("content_hash", "body")


_TICKS = "SELECT concat('sec_', CAST(user_id AS STRING)) AS security_id, ts, event_id AS tick_id, value AS price, 1 AS size FROM events"
_DAILY = "SELECT security_id, CAST(ts AS DATE) AS effective_date, arg_min(price, (ts, tick_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, tick_id)) AS close, CAST(sum(size) AS BIGINT) AS volume FROM {t} GROUP BY 1, 2"
_LAST = "(SELECT max(CAST(ts AS DATE)) FROM t)"


@query(f"""WITH t AS ({_TICKS}), early AS (SELECT * FROM t WHERE tick_id % 10 > 0), a AS ({_DAILY.format(t='early')}), b AS ({_DAILY.format(t='t')}), told AS (SELECT * FROM a WHERE effective_date < (SELECT CAST(max(ts) - INTERVAL 2 DAY AS DATE) FROM early))
    SELECT *, 1 AS version FROM told UNION ALL (SELECT *, 2 FROM (SELECT b.* FROM b SEMI JOIN told USING (security_id, effective_date) EXCEPT SELECT * FROM told))""")
def streamed_daily_bars(spark, sf_dir):
    """What a stream tells of nine tenths of the events, by its watermark alone, and the versions that the
    other tenth makes of those days when it comes later. Days that the watermark hasn't passed aren't told."""
    all_ticks = views.view(spark, sf_dir, _TICKS, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    files, out = shared_folder(spark, "ticks"), shared_folder(spark, "bars-told")
    all_ticks.filter("tick_id % 10 > 0").write.parquet(files)
    told = ingest.daily_bars(spark.readStream.schema(all_ticks.schema).parquet(files))
    state = shared_folder(spark, "ticks-state")
    _finished(told, out, state)
    bars = spark.read.schema(told.schema).parquet(out)
    late = ingest.late_versions(all_ticks, bars, "2100-01-01").drop("available_at")
    return bars.withColumn("version", F.lit(1)).unionByName(late.withColumn("version", F.lit(2)))


_KNOWN = """SELECT concat('sec_', CAST(user_id AS STRING)) AS security_id, CAST(ts AS TIMESTAMP) AS ts, event_id AS tick_id, value AS price, 1 AS size,
    CASE WHEN event_id % 10 = 0 THEN CAST(CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 4 DAY AS TIMESTAMP) WHEN event_id % 10 = 1 THEN CAST(ts AS TIMESTAMP) + INTERVAL 6 DAY
    ELSE CAST(ts AS TIMESTAMP) + INTERVAL 1 HOUR END AS available_at FROM events"""


@query(f"""WITH t AS (SELECT *, CAST(ts AS DATE) AS effective_date, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 3 DAY AS deadline FROM ({_KNOWN})),
    k AS (SELECT DISTINCT security_id, effective_date, deadline, greatest(available_at, deadline) AS known FROM t),
    b AS (SELECT k.security_id, k.effective_date, k.deadline, k.known, arg_min(price, (ts, tick_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, tick_id)) AS close, CAST(sum(size) AS BIGINT) AS volume
          FROM k JOIN t ON t.security_id = k.security_id AND t.effective_date = k.effective_date AND greatest(t.available_at, t.deadline) <= k.known GROUP BY 1, 2, 3, 4)
    SELECT security_id, effective_date, known AS available_at, CAST(row_number() OVER (PARTITION BY security_id, effective_date ORDER BY known) AS INT) AS version, open, high, low, close, volume
    FROM b WHERE known > deadline OR deadline < (SELECT max(available_at) FROM t)""")
def streamed_bar_versions(spark, sf_dir):
    """Daily bars with all their versions from a stream alone: a fifth of the ticks get known after their day
    was told. The files come in the order in which their ticks got known."""
    files, out = shared_folder(spark, "known-ticks"), shared_folder(spark, "bar-versions")
    ticks = views.view(spark, sf_dir, _KNOWN, "events")
    lo, hi = ticks.agg(F.min("available_at"), F.max("available_at")).first()
    cuts = [lo + (hi - lo) * k / 4 for k in range(5)] if lo else []
    for k in range(len(cuts) - 1):
        inside = F.col("available_at").between(F.lit(cuts[k]), F.lit(cuts[k + 1])) & ((F.col("available_at") > F.lit(cuts[k])) | F.lit(k == 0))
        ticks.filter(inside).coalesce(1).write.mode("append").parquet(files)
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(files)
    told = ingest.bar_versions(stream)
    _finished(told, out, shared_folder(spark, "bar-versions-state"))
    return spark.read.schema(told.schema).parquet(out)
