"""Split-adjusted prices from the corporate actions known at ``as_of``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pit import bars_asof, known

MODES = ("raw", "split_adjusted")
ACTION_COLUMNS = {"security_id", "action_type", "effective_date", "available_at", "ratio_numerator", "ratio_denominator"}


def _splits(corp_actions: DataFrame, as_of) -> DataFrame:
    return known(corp_actions.filter("action_type = 'split'"), as_of).select("security_id", "effective_date", F.ln(F.try_divide("ratio_numerator", "ratio_denominator")).alias("step"))


def split_factors(corp_actions: DataFrame, as_of) -> DataFrame:
    """One factor per security: the largest running product of its splits' ratios. Splits with a zero or
    missing denominator count for nothing."""
    w = Window.partitionBy("security_id").orderBy("effective_date").rowsBetween(Window.unboundedPreceding, 0)
    running = _splits(corp_actions, as_of).withColumn("factor", F.exp(F.sum("step").over(w)))
    return running.groupBy("security_id").agg(F.max("factor").alias("factor"))


def _adjusted(df: DataFrame, places: int | None) -> DataFrame:
    factor = F.coalesce("factor", F.lit(1.0))
    prices = {c: F.col(c) / factor for c in ("open", "high", "low", "close")}
    prices = prices if places is None else {c: F.round(x, places) for c, x in prices.items()}
    return df.withColumns(prices | {"volume": F.round(F.col("volume") * factor, 0).cast("long"), "adjustment_factor": factor}).drop("factor")


def bars_adjusted_asof(bars: DataFrame, corp_actions: DataFrame | None, as_of, mode: str = "split_adjusted", ex_date_aware: bool = False, places: int | None = 4, **how) -> DataFrame:
    """Bars with prices divided and volumes multiplied by the factor, prices rounded to ``places`` (None: not
    at all). By default it applies to every bar; ``ex_date_aware`` takes only splits after a bar's date.
    Without a table of actions the factor is 1; a table that lacks their columns can't adjust anything, and
    the bars come back raw."""
    if mode not in MODES:
        raise ValueError(f"price mode must be one of {MODES}")
    best = bars_asof(bars, as_of, **how)
    if mode == "raw" or corp_actions is not None and not ACTION_COLUMNS <= set(corp_actions.columns):
        return best
    if corp_actions is None:
        return _adjusted(best.withColumn("factor", F.lit(1.0)), places)
    if not ex_date_aware:
        return _adjusted(best.join(split_factors(corp_actions, as_of), "security_id", "left"), places)
    # splits and bars in one running sum, from the newest date back: no join by inequality
    steps = _splits(corp_actions, as_of).groupBy("security_id", "effective_date").agg(F.sum("step").alias("step"))
    both = best.withColumns({"step": F.lit(None).cast("double"), "is_bar": F.lit(0)}).unionByName(steps.withColumn("is_bar", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("security_id").orderBy(F.desc("effective_date"), "is_bar").rowsBetween(Window.unboundedPreceding, 0)
    return _adjusted(both.withColumn("factor", F.exp(F.coalesce(F.sum("step").over(w), F.lit(0.0)))).filter("is_bar = 0").drop("step", "is_bar"), places)
