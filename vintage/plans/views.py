"""The domain's inputs, derived by Spark from the test tables; the same rules as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-06-30 00:00:00"
BENCHMARK = "sec_1"
PRECEDENCE = {"bars_daily": ["src_n", "src_a"]}

#: One body of SQL that Spark and DuckDB both read, so that both start from equal rows.
BARS_SQL = """
    SELECT concat('sec_', CAST(l_suppkey AS STRING)) AS security_id, CAST(l_shipdate AS DATE) AS effective_date,
           concat('src_', lower(l_returnflag)) AS source_id,
           CASE WHEN l_linestatus = 'F' THEN CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY
                ELSE CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) + INTERVAL 5 DAY END AS available_at,
           min_by(l_extendedprice / l_quantity, l_orderkey * 100 + l_linenumber) AS open,
           max(l_extendedprice / l_quantity * (1 + l_tax)) AS high,
           min(l_extendedprice / l_quantity * (1 - l_discount)) AS low,
           max_by(l_extendedprice / l_quantity * (1 + l_tax / 2 - l_discount / 2), l_orderkey * 100 + l_linenumber) AS close,
           CAST(sum(l_quantity) AS BIGINT) AS volume
    FROM lineitem GROUP BY 1, 2, 3, 4
"""
SPLITS_SQL = """
    SELECT concat('sec_', CAST(s_suppkey AS STRING)) AS security_id, 'split' AS action_type,
           CAST(DATE '1995-01-01' + CAST(s_suppkey % 900 AS INT) AS DATE) AS effective_date,
           CAST(CAST(DATE '1995-01-02' + CAST(s_suppkey % 900 AS INT) AS DATE) AS TIMESTAMP) AS available_at,
           CAST(2 + s_suppkey % 3 AS DOUBLE) AS ratio_numerator, CAST(1 AS DOUBLE) AS ratio_denominator
    FROM supplier WHERE s_suppkey % 2 = 0
"""
MACRO_SQL = """
    SELECT concat('macro_', substr(o_orderpriority, 1, 1)) AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS effective_date,
           CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS TIMESTAMP) + INTERVAL 40 DAY AS available_at,
           'src_o' AS source_id, round(sum(o_totalprice), 2) AS value
    FROM orders GROUP BY 1, 2, 3
"""
INSIDER_SQL = """
    SELECT concat('sec_', CAST(user_id % 50 AS STRING)) AS security_id, CAST(ts AS DATE) AS effective_date,
           CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY AS available_at, 'src_e' AS source_id,
           CASE WHEN event_type = 'purchase' THEN 'P' ELSE 'S' END AS transaction_code, event_id, value
    FROM events WHERE event_type IN ('purchase', 'error')
"""
ATTENTION_SQL = """
    SELECT concat('sec_', CAST(user_id % 50 AS STRING)) AS security_id, event_type AS cohort, CAST(ts AS DATE) AS effective_date,
           CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY AS available_at, 'src_e' AS source_id,
           count(*) AS mentions, CAST(count(CASE WHEN value > 10 THEN 1 END) AS BIGINT) AS upvotes
    FROM events GROUP BY 1, 2, 3, 4
"""
ANALYST_SQL = """
    SELECT concat('sec_', CAST(o_custkey % 50 AS STRING)) AS security_id, CAST(o_orderdate AS DATE) AS effective_date,
           CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY AS available_at, 'src_o' AS source_id,
           substr(o_orderpriority, 1, 1) AS rating, count(*) AS buys
    FROM orders GROUP BY 1, 2, 3, 4, 5
"""
NEWS_SQL = """
    SELECT concat('sec_', CAST(doc_id % 50 AS STRING)) AS security_id, CAST(DATE '1997-01-01' + CAST(doc_id % 500 AS INT) AS DATE) AS effective_date,
           CAST(CAST(DATE '1997-01-02' + CAST(doc_id % 500 AS INT) AS DATE) AS TIMESTAMP) AS available_at, 'src_d' AS source_id,
           coalesce(source, 'unknown') AS source_name, doc_id AS article_id
    FROM documents
"""
EARNINGS_SQL = """
    SELECT concat('sec_', CAST(o_custkey % 50 AS STRING)) AS security_id, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS effective_date,
           CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 2 DAY AS available_at, 'src_o' AS source_id,
           CASE WHEN o_orderstatus = 'F' THEN 'bmo' ELSE 'amc' END AS session, o_orderkey AS order_id
    FROM orders
"""
#: A series counts as what a list is about.
MACRO_LIST_SQL = """
    SELECT concat('macro_', substr(o_orderpriority, 1, 1)) AS security_id, concat('macro_', substr(o_orderpriority, 1, 1)) AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS effective_date,
           CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS TIMESTAMP) + INTERVAL 40 DAY AS available_at, 'src_o' AS source_id, count(*) AS n_orders
    FROM orders GROUP BY 1, 2, 3, 4
"""
SENTIMENT_SQL = """
    SELECT concat('sec_', CAST(doc_id % 50 AS STRING)) AS security_id, CAST(DATE '1998-01-01' + CAST(doc_id % 90 AS INT) AS DATE) AS effective_date,
           CAST(CAST(DATE '1998-01-02' + CAST(doc_id % 90 AS INT) AS DATE) AS TIMESTAMP) AS available_at,
           CASE WHEN quality = 1 AND toxic = 0 THEN 'Bullish' WHEN toxic = 1 THEN 'Bearish' ELSE 'Neutral' END AS sentiment_label,
           CAST(quality - toxic AS DOUBLE) AS sentiment_score
    FROM labels
"""
FUNDAMENTALS_SQL = """
    SELECT concat('co_', CAST(c_nationkey AS STRING)) AS security_id, year(o_orderdate) AS fy, quarter(o_orderdate) AS q,
           c_mktsegment AS segment, round(sum(o_totalprice), 2) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4
"""


def load(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register tables as views of this session under their own names."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    load(spark, sf_dir, *tables)
    return spark.sql(sql)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, BARS_SQL, "lineitem")


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SPLITS_SQL, "supplier")


def priorities(spark: SparkSession) -> DataFrame:
    from ..operators.pit import source_priorities

    return source_priorities(spark, PRECEDENCE)


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly dates of 1997 for each security, known two days later."""
    load(spark, sf_dir, "supplier")
    s = spark.sql("SELECT concat('sec_', CAST(s_suppkey AS STRING)) AS security_id FROM supplier")
    s = s.select("security_id", F.explode(F.expr("sequence(DATE '1997-01-03', DATE '1997-12-26', INTERVAL 7 DAY)")).alias("effective_date"))
    return s.withColumn("as_of", F.date_add("effective_date", 2).cast("timestamp"))
