"""Panels over many securities at once: nested arrays a security, leaderboards and newest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import finite
from .pit import known


def newest_rows(table: DataFrame, as_of, n: int = 10, by: tuple[str, ...] = ("security_id",), order: str = "effective_date") -> DataFrame:
    """The n newest rows of each security known at ``as_of``."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(order), F.desc("available_at")))
    return known(table, as_of).withColumn("__n", rank).filter(F.col("__n") <= n).drop("__n")


def latest_lists(tables: dict[str, tuple[DataFrame, str]], as_of, n: int = 50) -> DataFrame:
    """The n newest rows of each security in each of several tables: list, security_id, rank, effective_date
    and the value of one column as text. tables: name -> (table, column); as many rows a security as a page
    shows."""
    out = None
    for name, (table, column) in tables.items():
        rank = F.row_number().over(Window.partitionBy("security_id").orderBy(F.desc_nulls_last("effective_date"), F.desc("available_at"), F.desc("value")))
        one = known(table, as_of).withColumn("value", F.col(column).cast("string")).withColumn("rank", rank).filter(F.col("rank") <= n)
        one = one.select(F.lit(name).alias("list"), "security_id", "rank", "effective_date", "value")
        out = one if out is None else out.unionByName(one)
    return out


def browse(table: DataFrame, as_of, limit: int = 500, order: str = "effective_date") -> DataFrame:
    """The newest rows of a dataset, nulls last; the limit is the page that a browser shows."""
    return known(table, as_of).orderBy(F.desc_nulls_last(order), F.desc("available_at")).limit(limit)


def price_summary(bars: DataFrame, as_of) -> DataFrame:
    """last, previous and first close, the highest high and lowest low, dates and the change of each
    security. bars: one per cell."""
    b = known(bars, as_of).withColumn("prev", F.lag("close").over(Window.partitionBy("security_id").orderBy("effective_date")))
    got = b.groupBy("security_id").agg(F.max(F.struct("effective_date", "close", "prev")).alias("l"), F.min(F.struct("effective_date", "close")).alias("f"), F.max("high").alias("max_high"), F.min("low").alias("min_low"), F.count("*").alias("n_bars"))
    return got.select("security_id", F.col("l.effective_date").alias("last_date"), F.col("l.close").alias("last_close"), F.col("l.prev").alias("prev_close"), (F.try_divide("l.close", "l.prev") - 1).alias("change_pct"), F.col("f.close").alias("first_close"), "max_high", "min_low", "n_bars")


def summary_card(bars: DataFrame, indicators: DataFrame, as_of, trend: int = 120) -> DataFrame:
    """Price summary, the last ``trend`` closes in date order and the last finite value of each indicator."""
    newest = newest_rows(bars, as_of, trend).groupBy("security_id").agg(F.sort_array(F.collect_list(F.struct("effective_date", "close"))).alias("t"))
    names = [c for c, t in indicators.dtypes if t == "double"]
    lasts = indicators.groupBy("security_id").agg(*[F.max(F.when(finite(c).isNotNull(), F.struct("effective_date", c))).alias(c) for c in names])
    lasts = lasts.select("security_id", *[F.col(c)[c].alias(c) for c in names])
    return price_summary(bars, as_of).join(newest.select("security_id", F.col("t.close").alias("trend")), "security_id", "left").join(lasts, "security_id", "left")


def attention_leaderboard(attention: DataFrame, deltas: DataFrame, sentiment: DataFrame, as_of, k: int = 25, trend: int = 30) -> DataFrame:
    """The k securities with most mentions on their latest day, with deltas, sentiment split and a trend."""
    a = known(attention, as_of).groupBy("security_id", "effective_date").agg(F.sum("mentions").alias("mentions"))
    latest = a.groupBy("security_id").agg(F.max(F.struct("effective_date", "mentions")).alias("l")).select("security_id", "l.*")
    top = latest.orderBy(F.desc("mentions"), "security_id").limit(k)
    d = deltas.groupBy("security_id", "effective_date").agg(F.avg("mention_delta_pct").alias("mention_delta_pct"))
    near = F.row_number().over(Window.partitionBy("security_id").orderBy(F.desc("effective_date")))
    t = a.join(F.broadcast(top.select("security_id")), "security_id").withColumn("__n", near).filter(F.col("__n") <= trend).groupBy("security_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("effective_date", "mentions"))), lambda x: x.mentions).alias("trend"))
    return top.join(d, ["security_id", "effective_date"], "left").join(sentiment.drop("effective_date"), "security_id", "left").join(t, "security_id", "left")


def _nested(table: DataFrame, name: str) -> DataFrame:
    cols = [c for c in table.columns if c != "security_id"]
    return table.groupBy("security_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))


#: Parts of a panel that are experimental.
EXPERIMENTAL = ("attention",)


def decision_panel(securities: DataFrame, bars: DataFrame, as_of, indicators: DataFrame | None = None, metrics: DataFrame | None = None, insider: DataFrame | None = None, earnings: DataFrame | None = None, attention: DataFrame | None = None, readouts: DataFrame | None = None, earnings_days: int = 90, attention_days: int = 30, rows: int = 10) -> DataFrame:
    """One row per security: its price summary and nested facts, with ``missing``, the names of the parts that
    have nothing for it, and ``experimental``, those it has that may still change in meaning. Nested lists are bounded: the newest indicator row, the newest transactions, the
    reports of the coming and the attention of the past days, and one row per metric and readout."""
    today = F.lit(as_of).cast("date")
    out = securities.select("security_id").distinct().join(price_summary(bars, as_of), "security_id", "left")
    parts: dict[str, DataFrame] = {}
    if indicators is not None:
        parts["indicators"] = _nested(newest_rows(indicators, as_of, 1), "indicators")
    if metrics is not None:
        parts["metrics"] = _nested(metrics.select("security_id", "metric_id", "value"), "metrics")
    if insider is not None:
        parts["insider"] = _nested(newest_rows(insider, as_of, rows).select("security_id", "effective_date", "transaction_code", "value"), "insider")
    if earnings is not None:
        coming = known(earnings, as_of).filter(F.col("report_date").between(today, F.date_add(today, earnings_days)))
        parts["earnings"] = _nested(coming.select("security_id", "report_date", "session"), "earnings")
    if attention is not None:
        past = known(attention, as_of).filter(F.col("effective_date") >= F.date_sub(today, attention_days))
        parts["attention"] = _nested(past.groupBy("security_id", "effective_date").agg(F.sum("mentions").alias("mentions")), "attention")
    if readouts is not None:
        parts["readouts"] = _nested(readouts.select("security_id", "definition_id", "value", "state"), "readouts")
    for part in parts.values():
        out = out.join(part, "security_id", "left")
    missing = F.array_compact(F.array(F.when(F.col("n_bars").isNull(), F.lit("bars")), *[F.when(F.col(p).isNull(), F.lit(p)) for p in parts]))
    experimental = F.array_compact(F.array(*[F.when(F.col(p).isNotNull(), F.lit(p)) for p in EXPERIMENTAL if p in parts])).cast("array<string>")
    return out.withColumns({"missing": missing, "experimental": experimental, "days_since_bar": F.datediff(today, "last_date")})
