"""Registered queries of table upkeep: compaction, coverage, chunks, reparse, backfill, registry, staleness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity, indicators, quality, versions
from . import indicator_sql, views
from .queries import BARS, BEST, MASTER, RECURSIVE_BEST, as_shown, best, query
from .views import AS_OF

@query(f"""{BARS}, r AS (SELECT DISTINCT concat('sec_', CAST(o_custkey % 200 AS STRING)) AS security_id, concat('src_', substr('nar', CAST(o_custkey % 3 + 1 AS INT), 1)) AS source_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS start FROM orders)
    SELECT security_id, source_id, start, EXISTS (SELECT 1 FROM bars b WHERE b.security_id = r.security_id AND b.source_id = r.source_id AND b.effective_date BETWEEN r.start AND r.start + INTERVAL 6 DAY) AS covered FROM r""")
def covered_requests(spark, sf_dir):
    views.load(spark, sf_dir, "orders")
    req = spark.sql("SELECT DISTINCT concat('sec_', CAST(o_custkey % 200 AS STRING)) AS security_id, concat('src_', substr('nar', CAST(o_custkey % 3 + 1 AS INT), 1)) AS source_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS start FROM orders")
    return versions.covered(req.withColumn("end", F.date_add("start", 6)), views.bars(spark, sf_dir)).drop("end")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def first_chunks(spark, sf_dir):
    rows = views.view(spark, sf_dir, "SELECT user_id, event_type, event_id FROM events", "events")
    return versions.first_chunk_wins(rows, ["user_id", "event_type"], "event_id")


@query(f"{BEST} SELECT DISTINCT security_id, effective_date FROM bars WHERE effective_date >= CAST(CAST(TIMESTAMP '{AS_OF}' AS DATE) - INTERVAL 24 MONTH AS DATE) EXCEPT SELECT security_id, effective_date FROM best WHERE source_id = 'src_n'")
def backfilled_bars(spark, sf_dir):
    """Dates of the last two years that the first source lacks."""
    have = best(spark, sf_dir).filter("source_id = 'src_n'")
    return versions.backfill_missing(views.bars(spark, sf_dir), have, "1998-06-30", 2).select("security_id", "effective_date").distinct()


@query("SELECT user_id AS symbol, max(ts) AS at FROM events GROUP BY 1 HAVING arg_max(event_type, (ts, event_id)) <> 'error'")
def active_symbols(spark, sf_dir):
    """Users whose latest event is no error, as a registry of symbols whose errors remove them."""
    e = views.view(spark, sf_dir, "SELECT user_id AS symbol, ts AS at, event_id, CASE WHEN event_type = 'error' THEN ts END AS removed_at FROM events", "events")
    # one version a time: of equal times the last event
    once = e.groupBy("symbol", "at").agg(F.max_by("removed_at", "event_id").alias("removed_at"))
    return identity.registry(once).select("symbol", "at")


@query(f"{BARS} SELECT 'lake_bars' AS dataset, source_id, max(available_at) AS last_ingested_at FROM bars GROUP BY 2")
def last_ingestions(spark, sf_dir):
    return quality.last_ingestion({"lake_bars": views.bars(spark, sf_dir)})


@query(f"WITH m AS ({MASTER}), r AS (SELECT security_id, DATE '1995-01-01' AS date FROM m) SELECT r.security_id, r.date, m.symbol, m.name FROM r LEFT JOIN m ON m.security_id = r.security_id AND m.effective_start <= r.date QUALIFY row_number() OVER (PARTITION BY r.security_id ORDER BY m.effective_start DESC) = 1")
def reverse_resolved(spark, sf_dir):
    views.load(spark, sf_dir, "supplier")
    master = spark.sql(MASTER)
    return identity.reverse_resolve(master.select("security_id", F.lit("1995-01-01").cast("date").alias("date")), master)


@query(f"""{RECURSIVE_BEST}, warm AS (SELECT * FROM best WHERE effective_date >= CAST(DATE '1997-01-01' - INTERVAL 400 DAY AS DATE)), {indicator_sql.steps('warm')}
    SELECT security_id, effective_date, {indicator_sql.listed(["sma_20", "sma_50", "sma_200", "ema_12", "ema_26", "macd", "macd_ema", "macd_histogram"])} FROM wide WHERE effective_date >= DATE '1997-01-01'""")
def chosen_indicators(spark, sf_dir):
    """Named indicators from a date on, with warm-up history before it."""
    return as_shown(indicators.chosen(best(spark, sf_dir), AS_OF, ["sma", "ema", "macd"], "1997-01-01"))
