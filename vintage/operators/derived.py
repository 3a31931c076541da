"""Derived datasets: breadth, relative strength, volatility term structure, macro transforms, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import history, ieee_div, lag, rolling
from .pit import known, macro_series_asof

RS_WINDOWS = (1, 5, 21, 63, 126, 252)


def market_breadth(bars: DataFrame, as_of, ratios: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(metric_id, effective_date, value): the share of securities whose last close is above its 50 and 200
    day mean, carried over dates that a security lacks, and ratios of two closes. bars: one per cell."""
    b = known(bars, as_of).select("security_id", "effective_date", "close")
    b = b.withColumns({f"above_{n}": (F.col("close") > rolling(F.avg, "close", n)).cast("int") for n in (50, 200)})
    # a state holds from its date to the day before the security's next one
    spans = b.withColumn("next", F.lead("effective_date").over(history()))
    # (every change is on a date with bars, and every date with bars has one)
    # each state counts +1 at its date and -1 at the next: running sums over dates replace the product of dates
    # and securities
    change = lambda n, at, sign: F.when(F.col(at).isNotNull(), F.struct(F.lit(n).alias("n"), F.col(at).alias("effective_date"), (F.col(f"above_{n}").isNotNull().cast("int") * sign).alias("k"), (F.coalesce(f"above_{n}", F.lit(0)) * sign).alias("a")))
    changes = spans.select(F.inline(F.array_compact(F.array(*[change(n, at, sign) for n in (50, 200) for at, sign in (("effective_date", 1), ("next", -1))]))))
    daily = changes.groupBy("n", "effective_date").agg(F.sum("k").alias("k"), F.sum("a").alias("a"))
    w = Window.partitionBy("n").orderBy("effective_date").rowsBetween(Window.unboundedPreceding, 0)  # one row a date
    share = daily.select("n", "effective_date", (100.0 * F.try_divide(F.sum("a").over(w), F.sum("k").over(w))).alias("value"))
    names = F.explode(F.array(F.lit("pct_above_"), F.lit("sector_all_pct_above_")))
    out = share.select(names.alias("name"), "n", "effective_date", "value").select(F.concat("name", F.col("n").cast("string"), F.lit("ma")).alias("metric_id"), "effective_date", "value")
    if ratios:
        close = lambda security: F.max(F.when(F.col("security_id") == security, F.col("close")))
        daily = known(bars, as_of).groupBy("effective_date").agg(*[F.struct(F.lit(f"ratio_{name}").alias("metric_id"), F.try_divide(close(x), close(y)).alias("value")).alias(f"r{k}") for k, (name, (x, y)) in enumerate(ratios.items())])
        out = out.unionByName(daily.select(F.col("effective_date"), F.inline(F.array(*[f"r{k}" for k in range(len(ratios))]))))
    return out


def relative_strength(bars: DataFrame, benchmark: DataFrame, as_of, percentile: bool = True) -> DataFrame:
    """(security_id, effective_date, window, rs_return, rs_percentile): returns less the benchmark's over the
    same date, and the rank among securities on each date and window."""
    b = known(bars, as_of).select("security_id", "effective_date", "close")
    m = known(benchmark, as_of).select(F.lit("b").alias("security_id"), "effective_date", "close")
    own = b.select("security_id", "effective_date", *[(ieee_div("close", lag("close", n)) - 1).alias(f"r{n}") for n in RS_WINDOWS])
    ref = m.select("effective_date", *[(ieee_div("close", lag("close", n)) - 1).alias(f"m{n}") for n in RS_WINDOWS])
    both = own.join(F.broadcast(ref), "effective_date")
    rows = both.select("security_id", "effective_date", F.inline(F.array(*[F.struct(F.lit(n).alias("window"), (F.col(f"r{n}") - F.col(f"m{n}")).alias("rs_return")) for n in RS_WINDOWS]))).filter(F.col("rs_return").isNotNull())
    if not percentile:
        return rows.withColumn("rs_percentile", F.lit(None).cast("double"))
    day = Window.partitionBy("effective_date", "window")
    ties = F.count("*").over(Window.partitionBy("effective_date", "window", "rs_return"))
    rank = F.rank().over(day.orderBy("rs_return")) + (ties - 1) / 2.0
    n = F.count("*").over(day)
    return rows.withColumn("rs_percentile", F.when(n > 1, (rank - 1) / n * 100))


#: What the four series of the term structure are.
VOL_SERIES = ("VIX9D", "VIX", "VIX3M", "VIX6M")


def vol_term_structure(levels: DataFrame, as_of, series: tuple[str, str, str, str] = VOL_SERIES) -> DataFrame:
    """(series_id, effective_date, value): the level of each series on every date (null where it has none),
    contango of three months over spot, and the front ratio. levels: security_id, effective_date, close."""
    nine, spot, three, _ = series
    wide = known(levels, as_of).filter(F.col("security_id").isin(*series)).groupBy("effective_date").pivot("security_id", list(series)).agg(F.max("close"))
    items = [F.struct(F.lit(s).alias("series_id"), F.col(s).alias("value")) for s in series]
    items += [F.struct(F.lit("contango_3m_spot").alias("series_id"), (F.col(three) - F.col(spot)).alias("value")), F.struct(F.lit("contango_front_ratio").alias("series_id"), F.try_divide(F.col(nine), F.col(spot)).alias("value"))]
    return wide.select("effective_date", F.inline(F.array(*items))).select("series_id", "effective_date", "value")


def macro_transforms(series: DataFrame, as_of) -> DataFrame:
    """(series_id, effective_date, value): <id>_YOY and <id>_MOM, the change against the same day a year and a
    month before. A day that month doesn't have gives no row, and neither does a zero or missing base."""
    s = macro_series_asof(series, as_of).select("series_id", "effective_date", "value").filter("value IS NOT NULL")
    out = None
    for name, months in (("YOY", -12), ("MOM", -1)):
        shifted = F.add_months("effective_date", months)
        now = s.filter(F.day(shifted) == F.day("effective_date")).select("series_id", "effective_date", "value", shifted.alias("base_date"))
        base = s.select("series_id", F.col("effective_date").alias("base_date"), F.col("value").alias("base")).filter("base != 0")
        one = now.join(base, ["series_id", "base_date"]).select(F.concat("series_id", F.lit(f"_{name}")).alias("series_id"), "effective_date", (F.col("value") / F.col("base") - 1).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def insider_clusters(tx: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Each transaction with the counts of purchases and sales and the net value of the days up to its own."""
    at = F.unix_date("effective_date")
    w = Window.partitionBy("security_id").orderBy(at).rangeBetween(-days, 0)
    is_p, is_s = F.col("transaction_code") == "P", F.col("transaction_code") == "S"
    value = F.when(is_p, F.col("value")).when(is_s, -F.col("value")).otherwise(0.0)
    return known(tx, as_of).select("security_id", "effective_date", "transaction_code", "value", F.sum(is_p.cast("long")).over(w).alias("buy_count"), F.sum(is_s.cast("long")).over(w).alias("sell_count"), F.sum(value).over(w).alias("net_value"))


def attention_deltas(attention: DataFrame, as_of) -> DataFrame:
    """Percent changes of mentions and upvotes against the cohort's previous row, and upvotes a mention."""
    w = Window.partitionBy("security_id", "cohort").orderBy("effective_date")

    def change(c: str) -> Column:
        prev = F.lag(c).over(w)
        return F.when(prev != 0, (F.col(c) - prev) / prev.cast("double") * 100)

    return known(attention, as_of).select("security_id", "cohort", "effective_date", "mentions", change("mentions").alias("mention_delta_pct"), F.when(F.col("mentions") > 0, F.col("upvotes") / F.col("mentions").cast("double")).alias("upvote_ratio"), change("upvotes").alias("upvote_delta_pct"))


def sentiment_ratios(sentiment: DataFrame, as_of) -> DataFrame:
    bullish = F.lower("sentiment_label").contains("bullish")
    return known(sentiment, as_of).groupBy("security_id", "effective_date").agg(F.avg(F.coalesce(bullish, F.lit(False)).cast("double")).alias("positive_ratio"), F.avg("sentiment_score").alias("mean_score"), F.count("*").alias("n_annotations"))


def sentiment_split(sentiment: DataFrame, as_of) -> DataFrame:
    """Bullish, bearish and neutral shares of each security's latest day."""
    s = known(sentiment, as_of)
    label = F.lower(F.coalesce("sentiment_label", F.lit("")))
    daily = s.groupBy("security_id", "effective_date").agg(F.avg(label.contains("bullish").cast("double")).alias("bullish"), F.avg(label.contains("bearish").cast("double")).alias("bearish"))
    latest = daily.groupBy("security_id").agg(F.max(F.struct("effective_date", "bullish", "bearish")).alias("d")).select("security_id", "d.*")
    return latest.withColumn("neutral", F.greatest(F.lit(0.0), 1 - F.col("bullish") - F.col("bearish")))
