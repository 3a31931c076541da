"""Trading calendars as tables: (exchange, session, ordinal), with joins instead of look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Other names of exchanges.
ALIASES = {"NYSE": "XNYS", "NASDAQ": "XNAS", "LSE": "XLON", "TSE": "XTKS", "HKEX": "XHKG", "US": "XNYS"}


def numbered(sessions: DataFrame) -> DataFrame:
    """(exchange, session) with ordinals; a calendar has a few hundred rows a year."""
    return sessions.distinct().withColumn("ordinal", F.row_number().over(Window.partitionBy("exchange").orderBy("session")))


def trading_calendar(spark: SparkSession, start, end, holidays: DataFrame | None = None, exchange: str = "XNYS") -> DataFrame:
    """Weekdays from start to end without the holidays of the exchange (exchange, day)."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("session"))
    days = days.filter(F.weekday("session") < 5).withColumn("exchange", F.lit(ALIASES.get(exchange, exchange)))
    if holidays is not None:
        off = holidays.select("exchange", F.col("day").cast("date").alias("session"))
        days = days.join(F.broadcast(off), ["exchange", "session"], "left_anti")
    return numbered(days.select("exchange", "session"))


def is_trading_day(days: DataFrame, calendar: DataFrame) -> DataFrame:
    c = calendar.select("exchange", F.col("session").alias("day"), F.lit(True).alias("__open"))
    return days.join(c, ["exchange", "day"], "left").withColumn("is_open", F.coalesce("__open", F.lit(False))).drop("__open")


def previous_trading_day(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """The latest session on or before each (exchange, day), as ``session`` and ``ordinal``; null before the first."""
    asked = days.select("exchange", F.col("day").cast("date").alias("day")).distinct()
    rows = calendar.select("exchange", F.col("session").alias("day"), F.struct("session", "ordinal").alias("s"), F.lit(0).alias("asked")).unionByName(asked.select("*", F.lit(None).cast("struct<session:date,ordinal:int>").alias("s"), F.lit(1).alias("asked")))
    w = Window.partitionBy("exchange").orderBy("day", "asked").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("s", F.last("s", ignorenulls=True).over(w)).filter("asked = 1").select("exchange", "day", "s.*")


def shift_trading_days(days: DataFrame, calendar: DataFrame, n: int) -> DataFrame:
    """The session n sessions after (before, if negative) the latest one up to each day, as ``shifted``."""
    at = previous_trading_day(days, calendar).withColumn("__to", F.col("ordinal") + n)
    c = calendar.select("exchange", F.col("ordinal").alias("__to"), F.col("session").alias("shifted"))
    return at.join(c, ["exchange", "__to"], "left").select("exchange", "day", "shifted")


def sessions_in(calendar: DataFrame, start, end) -> DataFrame:
    return calendar.filter(F.col("session").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def open_closed(calendar: DataFrame, start, end) -> DataFrame:
    """Every day of the range with is_open, for each exchange."""
    days = calendar.select("exchange").distinct().select("exchange", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    return is_trading_day(days, calendar)
