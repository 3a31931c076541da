"""Window expressions of one step come once in its plan, however often formulas name them."""

from pyspark.sql import functions as F

from vintage.functions.exprs import Shared, ieee_div, or_nan
from vintage.operators import indicators
from vintage.sources import archive


def test_each_window_once(spark):
    bars = spark.createDataFrame([("a", None, float(k), float(k), k) for k in range(3)], "security_id string, effective_date date, high double, low double, volume long")
    s = Shared()
    ratio = or_nan(ieee_div(s.rolling(F.max, "high", 2), s.rolling(F.min, "low", 2)), 1.0)
    d = s.add(bars, {"ratio": ratio})
    assert len(s.windows) == 4 and d.columns == [*bars.columns, "ratio"]
    assert d._jdf.queryExecution().optimizedPlan().toString().count("windowspecdefinition") == 4


def test_first_step_repeats_no_window(spark):
    schema = "security_id string, effective_date date, open double, high double, low double, close double, volume long"
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        plan = indicators.finite_indicators(spark.createDataFrame([], schema))._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("specifiedwindowframe") < 200  # 400 where formulas repeat them


def test_few_symbols_make_rows_in_many_tasks(spark):
    symbols = spark.createDataFrame([(f"s{k}",) for k in range(50)], "security_id string").coalesce(1)
    bars = archive.synthetic_bars(symbols, "1998-01-01", 3)
    assert bars.rdd.getNumPartitions() > 8 and bars.count() == 150
